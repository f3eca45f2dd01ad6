"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation.  Each source turn may be kept, relabelled, merged into the turn
before it, or preceded by an empty turn; dynamic programming over the automaton
of legal turns finds the cheapest choice, and the repaired sequence is rendered.

Costs of a stretch of turns form a small matrix over the automaton's states, and
stretches compose in the (min, +) semiring.  So a conversation may be cut
anywhere: rows are range-partitioned by conversation and turn, each task sends
the matrices of the (at most two) conversations it shares with its neighbours,
the driver composes those, and each task then repairs its own stretch between
the states it was told.  Pieces of text stay with their source rows: joined in
order, the pieces of a conversation are its rendered form.

Defined cases: null or unknown roles are relabelled at a low cost; null text is
empty; null conversation ids form one conversation; null turns come first; equal
turns are ordered by role and text; repeated rows are turns of their own; an
empty table gives no row; control marks inside a text are defused; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

ROLES = ("system", "user", "assistant")
#: States: nothing yet, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal next states.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of the repairs.
KEEP, MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 0, 1, 3, 4, 1
INFINITE = 10**9


def options(role: str | None) -> list[tuple[int, int, int, str, int | None]]:
    """(from, to, cost, action, inserted state) of each way to take in one turn; cheap and plain ways first."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    as_role = lambda s: KEEP if s == own else RELABEL if own else RELABEL_UNKNOWN
    out = []
    for a in range(4):
        for b in LEGAL[a]:
            out.append((a, b, as_role(b), "keep" if b == own else "relabel", None))
        if a != START:
            out.append((a, a, MERGE + as_role(a), "merge", None))
        for m in LEGAL[a]:
            for b in LEGAL[m]:
                out.append((a, b, INSERT + as_role(b), "keep" if b == own else "relabel", m))
    return out


OPTIONS = {role: options(role) for role in (*ROLES, None)}


def step_matrix(role: str | None) -> np.ndarray:
    m = np.full((4, 4), INFINITE, np.int64)
    for a, b, cost, _, _ in OPTIONS[role]:
        m[a, b] = min(m[a, b], cost)
    return m


STEPS = {role: step_matrix(role) for role in OPTIONS}


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INFINITE)


def identity() -> np.ndarray:
    return np.where(np.eye(4, dtype=bool), 0, INFINITE)


def stretch_matrix(roles: list[str | None]) -> np.ndarray:
    m = identity()
    for r in roles:
        m = compose(m, STEPS[r])
    return m


def repair(roles: list[str | None], entry: int = START, leave: int | None = None) -> list[tuple[int, str, int | None]]:
    """(state, action, inserted state) of each turn on the cheapest way from `entry` to `leave` (any state if None)."""
    cost = [INFINITE] * 4
    cost[entry] = 0
    back = []
    for r in roles:
        new, how = [INFINITE] * 4, [None] * 4
        for a, b, c, action, inserted in OPTIONS[r]:
            if cost[a] + c < new[b]:
                new[b], how[b] = cost[a] + c, (a, action, inserted)
        cost = new
        back.append(how)
    state = min(range(4), key=lambda s: cost[s]) if leave is None else leave
    out = []
    for how in reversed(back):
        before, action, inserted = how[state]
        out.append((state, action, inserted))
        state = before
    return out[::-1]


def composed(edges: list[tuple[int, int, object, np.ndarray]]) -> dict[tuple[int, int], tuple[int, int, bool, bool]]:
    """Entry and exit states, and whether the conversation begins and ends there, of the stretches at partitions' edges.

    edges: (partition, 0 for its first or 1 for its last conversation, key, matrix), a sole conversation once as 0.
    """
    chains: list[list] = []
    for e in sorted(edges, key=lambda e: e[:2]):
        last = chains[-1][-1] if chains else None
        if last is not None and last[0] != e[0] and last[2] == e[2]:
            chains[-1].append(e)
        else:
            chains.append([e])
    out = {}
    for chain in chains:
        costs = [np.where(np.arange(4) == START, 0, INFINITE)]
        for e in chain:
            costs.append(np.minimum((costs[-1][:, None] + e[3]).min(axis=0), INFINITE))
        state = int(costs[-1].argmin())
        for i in range(len(chain) - 1, -1, -1):
            before = int((costs[i] + chain[i][3][:, state]).argmin())
            out[chain[i][0], chain[i][1]] = (before, state, i == 0, i == len(chain) - 1)
            state = before
    return out


def defused(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def rendered(roles: list[str | None], texts: list[str | None], place: tuple[int, int | None, bool, bool]) -> list[tuple[int, str, str, str]]:
    """(source index, role, action, piece) of each turn and insertion of a stretch."""
    entry, leave, begins, ends = place
    out = []
    first = begins
    for i, (state, action, inserted) in enumerate(repair(roles, entry, leave)):
        if inserted is not None:
            out.append((i, ROLES[inserted - 1], "insert", ("" if first else CLOSE) + OPEN.format(ROLES[inserted - 1])))
            first = False
        head = "\n" if action == "merge" else ("" if first else CLOSE) + OPEN.format(ROLES[state - 1])
        first = False
        out.append((i, ROLES[state - 1], action, head + defused(texts[i])))
    if ends and out:
        i, role, action, piece = out[-1]
        out[-1] = (i, role, action, piece + CLOSE)
    return out


def stretches(batches):
    """(key, rows) of each run of equal conversation ids in a task's sorted rows."""
    key, rows, any_row = None, [], False
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if any_row and row[0] != key:
                yield key, rows
                rows = []
            key, any_row = row[0], True
            rows.append(row)
    if any_row:
        yield key, rows


def known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn (null for an inserted one), ordinal (ascending along a conversation), role, action, piece."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    dealt = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text"))

    def edge_matrices(batches):
        pid = TaskContext.get().partitionId()
        ends = []
        for key, part in stretches(batches):
            m = (repr(key), stretch_matrix([known(r[2]) for r in part]).ravel().tolist())
            ends[1:] = [m] if ends else []
            ends = ends or [m]
        yield pa.RecordBatch.from_arrays([pa.array([pid] * len(ends), pa.int64()), pa.array(range(len(ends)), pa.int64()), pa.array([e[0] for e in ends], pa.string()), pa.array([e[1] for e in ends], pa.list_(pa.int64()))], ["pid", "side", "key", "costs"])

    edges = dealt.mapInArrow(edge_matrices, "pid bigint, side bigint, key string, costs array<bigint>").collect()  # two rows a partition at most
    places = turns.sparkSession.sparkContext.broadcast(composed([(r.pid, r.side, r.key, np.array(r.costs).reshape(4, 4)) for r in edges]))

    def run(batches):
        pid = TaskContext.get().partitionId()
        types = [None, None]
        held: list[tuple] = []
        ordinal = pid << 32

        def flush():
            columns = list(zip(*held, strict=True))
            kind = (types[0], types[1], pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind, strict=True)], ["conv_id", "turn", "ordinal", "role", "action", "piece"])

        def typed():
            for b in batches:
                types[:] = b.schema.field("conv_id").type, b.schema.field("turn").type
                yield b

        # a stretch is known to be the last of its task only when the next one is asked for
        runs, side = stretches(typed()), 0
        now = next(runs, None)
        while now is not None:
            after = next(runs, None)
            place = (START, None, True, True)
            if side == 0 or after is None:
                place = places.value[pid, min(side, 1)]
            key, part = now
            for i, role, action, piece in rendered([known(r[2]) for r in part], [r[3] for r in part], place):
                held.append((key, None if action == "insert" else part[i][1], ordinal, role, action, piece))
                ordinal += 1
            if len(held) >= 4096:
                yield flush()
                held.clear()
            now, side = after, side + 1
        if held:
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ordinal bigint, role string, action string, piece string")
