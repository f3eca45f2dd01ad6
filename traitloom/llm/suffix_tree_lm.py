"""LM scoring by a probabilistic suffix tree, beside a unigram base score.

Symbols are classes of the bytes of a normalised text (lower-cased words joined
by single spaces, then one end symbol); `ALPHABET` gives the rule.  A context of
up to `DEPTH` symbols is retained where its next-symbol distribution diverges
from that of its suffix: the sum of n(x) * ln(p(x | context) / p(x | suffix))
must reach `least_gain` nats.  All such contexts form the tree, however many.
Distributions are smoothed towards the suffix's.  A symbol's probability is that
at the longest suffix of its history in the tree.

The tree is never in one place.  N-grams are dealt by the `NEAR` symbols before
their last, so a range holds the whole tree below those symbols; it gives a block
A and B of each of its n-grams, whose probability is A + B * p with p that at
depth `NEAR`.  The tree to depth `NEAR`, which the alphabet bounds, is broadcast.

Counting and scoring are exact over all documents.  Documents are dealt into
blocks of about `block_bytes` by hash.  A block sends its distinct words as
sorted arrays, cut by hash range; ranges are summed over all blocks, and each
block gets back the counts of its own words in the order it sent them.  So no
task holds more than a block or a range, and neither words nor counts go
through the driver.  The driver only sees two totals and the n-grams of `NEAR` + 1
symbols.

Defined cases: null text counts as empty (its end alone); without training
documents N and V are 0 and the tree is its root with a uniform distribution;
repeated rows count and are scored as often as they occur; null ids are in
training iff `trains` says so for them; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_view, materialise, slices
from .hashing import mix, word_hashes

DEPTH = 5
#: Symbols that n-grams are dealt by.
NEAR = 3
BITS = 6
END, SPACE_SYMBOL = 0, 1


def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each byte, and the number of bytes of each symbol."""
    of = np.zeros(256, np.int64)
    of[0x20] = SPACE_SYMBOL
    for i in range(26):
        of[ord("a") + i] = 2 + i
    of[ord("0") : ord("9") + 1] = 28
    for k, c in enumerate(".,-'"):
        of[ord(c)] = 29 + k
    rest = [b for b in range(0x01, 0x80) if not of[b]]
    of[[b for b in rest if b >= 0x20 and b != 0x7F]] = 33
    of[[b for b in rest if b < 0x20 or b == 0x7F]] = 34
    for b in range(0x80, 0xC0):
        of[b] = 35 + (b - 0x80) // 4
    for b in range(0xC0, 0x100):
        of[b] = 51 if b <= 0xC2 else 52 if b == 0xC3 else 53 if b < 0xD0 else 54 if b < 0xE0 else 55 if b < 0xF0 else 56
    sizes = np.bincount(of, minlength=57)
    sizes[END] = 1
    return of, sizes


ALPHABET, SIZES = alphabet()
N_SYMBOLS = len(SIZES)


def stream(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of some texts, each with DEPTH ends before it and one after; starts (with the end); whether a position counts."""
    parts = [b"\0" * DEPTH + b" ".join(w).replace(b"\0", b"\1") + b"\0" for w in words]
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    symbols = ALPHABET[np.frombuffer(b"".join(parts), np.uint8)]
    counts = np.ones(len(symbols), bool)
    for k in range(DEPTH):
        counts[starts[:-1] + k] = False
    return symbols, starts, counts


def grams(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The code of context and next symbol at each position that counts; the next symbol has the lowest bits."""
    s = symbols.astype(np.int64)
    code = s[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        code |= s[DEPTH - k : len(s) - k] << (BITS * k)
    return code[counts[DEPTH:]]


def tallied(keys: list[np.ndarray], values: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their number of occurrences or sum of values."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if values is None:
        return np.unique(k, return_counts=True)
    order = np.argsort(k, kind="stable")
    k, v = k[order], np.concatenate(values)[order] if values else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(v, first) if len(k) else v


def texts_of(table: pa.Table):
    """(rows, texts) pieces of a block, each of a bounded number of bytes."""
    texts = [x or b"" for x in table.column("text").to_pylist()]
    for i, j in slices(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 20):
        yield i, j, texts[i:j]


def distinct_words(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct word hashes of a block, and for each piece its hashes and where each text's begin."""
    hashes, starts = [], []
    for _, _, texts in texts_of(table):
        h, s = word_hashes(texts)
        hashes.append(h)
        starts.append(s)
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64), hashes, starts


BLOCK = "kind string, block bigint, part bigint, keys binary, counts binary"


def context_parts(codes: np.ndarray, parts_log2: int) -> np.ndarray:
    """The range of each n-gram, by its last `NEAR` symbols before the next."""
    near = (codes >> BITS) & ((1 << BITS * NEAR) - 1)
    return (mix(near.astype(np.uint64)) & np.uint64((1 << parts_log2) - 1)).astype(np.int64)


def count_block(parts_log2: int):
    """A block's distinct words, cut into ranges of their top bits, and its n-grams; both with their counts in training."""

    def run(key, table):
        block = key[0].as_py()
        known, hashes, starts = distinct_words(table)
        trains = np.array(table.column("trains").to_pylist(), bool)
        n = np.zeros(len(known), np.uint32)
        codes: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        for (i, j, texts), h, s in zip(texts_of(table), hashes, starts, strict=True):
            of = np.repeat(trains[i:j], np.diff(s))
            k, c = np.unique(h[of], return_counts=True)
            n[np.searchsorted(known, k)] += c.astype(np.uint32)
            symbols, ends, counts = stream([t.lower().split() for t in texts])
            if len(symbols):
                used = np.repeat(trains[i:j], np.diff(ends))[DEPTH:][counts[DEPTH:]]
                k, c = np.unique(grams(symbols, counts) << 1 | used, return_counts=True)
                codes.append(k >> 1)
                weights.append(c * (k & 1))
        rows = []
        edges = np.searchsorted(known, (np.arange(1, 1 << parts_log2, dtype=np.uint64) << np.uint64(64 - parts_log2)) if parts_log2 else np.zeros(0, np.uint64))
        for p, (a, b) in enumerate(zip([0, *edges], [*edges, len(known)], strict=True)):
            if a < b:
                rows.append(("word", block, p, known[a:b].tobytes(), n[a:b].tobytes()))
        if codes:
            k, c = tallied(codes, weights)
            part = context_parts(k, parts_log2)
            order = np.argsort(part, kind="stable")
            k, c, part = k[order], c[order].astype(np.uint32), part[order]
            cut = np.searchsorted(part, np.arange((1 << parts_log2) + 1))
            for p, (a, b) in enumerate(itertools.pairwise(cut.tolist())):
                if a < b:
                    rows.append(("gram", block, p, k[a:b].tobytes(), c[a:b].tobytes()))
        return table_of(rows)

    return run


def table_of(rows: list[tuple]) -> pa.Table:
    c = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], ["kind", "block", "part", "keys", "counts"])


class Level:
    """The contexts of one depth that pass the divergence test, and their n-grams."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], shorter: tuple[np.ndarray, np.ndarray], depth: int, least_count: int, least_gain: float):
        """grams, shorter: n-grams of depth + 1 and of depth symbols, ascending, with their counts."""
        (codes, n), (below, m) = grams, shorter
        contexts, of = np.unique(codes >> BITS, return_inverse=True)
        total = np.bincount(of, n, len(contexts))
        suffixes, under = np.unique(below >> BITS, return_inverse=True)
        whole = np.bincount(under, m, len(suffixes))
        mask = (1 << BITS * depth) - 1
        at = np.searchsorted(below, codes & mask)
        ratio = (n / total[of]) / (m[at] / whole[under[at]])
        gain = np.bincount(of, n * np.log(ratio), len(contexts))
        keep = (total >= least_count) & (gain >= least_gain)
        self.depth, self.contexts, self.totals = depth, contexts[keep], total[keep]
        self.codes, self.n = codes[keep[of]], n[keep[of]]

    def step(self, codes: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of each n-gram: its probability at this depth is a + b times that at the suffix."""
        code = codes & ((1 << BITS * (self.depth + 1)) - 1)
        total, inside = found_at(self.contexts, self.totals, code >> BITS)
        n, _ = found_at(self.codes, self.n, code)
        return np.where(inside, n / (total + smooth), 0.0), np.where(inside, smooth / (total + smooth), 1.0)


def found_at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key wanted, 0 where it isn't there; and whether it is."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    inside = keys[at] == wanted
    return np.where(inside, values[at], 0), inside


def cut_to(codes: np.ndarray, n: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last `symbols` symbols of n-grams."""
    return tallied([codes & ((1 << BITS * symbols) - 1)], [n])


def levels(codes: np.ndarray, n: np.ndarray, first: int, last: int, least_count: int, least_gain: float) -> list[Level]:
    counted = {d: cut_to(codes, n, d + 1) for d in range(first - 1, last + 1)}
    return [Level(counted[d], counted[d - 1], d, least_count, least_gain) for d in range(first, last + 1)]


def sum_part(least_count: int, least_gain: float, smooth: float):
    """Sums a range over all blocks.

    Words: each block's counts in its own order, and a row of totals.  N-grams: A and B of each block's own, in its
    order, and a row of those of `NEAR` + 1 symbols.
    """

    def run(key, table):
        kind, part = key[0].as_py(), key[1].as_py()
        blocks, keys, counts = (table.column(c).to_pylist() for c in ("block", "keys", "counts"))
        every = [np.frombuffer(x, np.int64 if kind == "gram" else np.uint64) for x in keys]
        distinct, inverse = np.unique(np.concatenate(every), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([np.frombuffer(x, np.uint32) for x in counts]), len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in every])
        if kind == "gram":
            seen = total > 0
            ab = np.zeros((2, len(distinct)))
            ab[1] = 1
            for level in levels(distinct[seen], total[seen], NEAR + 1, DEPTH, least_count, least_gain):
                a, b = level.step(distinct, smooth)
                ab = ab * b
                ab[0] += a
            ab = ab.astype(np.float32)
            rows = [("gram", b, part, None, np.ascontiguousarray(ab[:, inverse[e - len(x) : e]]).tobytes()) for b, x, e in zip(blocks, every, ends.tolist(), strict=True)]
            near, n = cut_to(distinct[seen], total[seen], NEAR + 1)
            rows.append(("near", -1, part, near.tobytes(), n.tobytes()))
            return table_of(rows)
        rows = [("word", b, part, None, total[inverse[e - len(x) : e]].tobytes()) for b, x, e in zip(blocks, every, ends.tolist(), strict=True)]
        rows.append(("totals", -1, part, None, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()))
        return table_of(rows)

    return run


class NearTree:
    """The root and the tree to depth `NEAR`."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, least_count: int, least_gain: float, smooth: float):
        self.smooth = smooth
        self.root = np.zeros(N_SYMBOLS)
        self.root += np.bincount(codes & ((1 << BITS) - 1), n, N_SYMBOLS)
        self.root = (self.root + 1) / (self.root.sum() + N_SYMBOLS)
        self.levels = levels(codes, n, 1, NEAR, least_count, least_gain)

    def logs(self, codes: np.ndarray, ab: np.ndarray) -> np.ndarray:
        """log10 probability of the next symbol's bytes of each n-gram."""
        x = codes & ((1 << BITS) - 1)
        p = self.root[x]
        for level in self.levels:
            a, b = level.step(codes, self.smooth)
            p = a + b * p
        return np.log10(ab[0] + ab[1] * p) - np.log10(SIZES[x])


class SuffixTree:
    """A tree held whole, as an automaton: what score() does in ranges, for small trees.

    States have their transitions and log10 probabilities; state 0 is the root.
    `contexts` holds {(length, code): {symbol: n}}; codes have the most recent symbol in the lowest bits.
    """

    def __init__(self, root: dict[int, int], contexts: dict[tuple[int, int], dict[int, int]], smooth: float = 4.0):
        names = {(0, 0)} | set(contexts)
        # A walk can only reach a context through its prefixes, and must find a suffix of whatever it reads.
        todo = list(names)
        while todo:
            d, code = todo.pop()
            if d:
                for other in ((d - 1, code >> BITS), (d - 1, code & ((1 << BITS * (d - 1)) - 1))):
                    if other not in names:
                        names.add(other)
                        todo.append(other)
        order = sorted(names)
        index = {c: i for i, c in enumerate(order)}
        p = np.zeros((len(order), N_SYMBOLS))
        self.next = np.zeros((len(order), N_SYMBOLS), np.int32)
        for i, (d, code) in enumerate(order):
            n = np.zeros(N_SYMBOLS)
            seen = root if not d else contexts.get((d, code), {})
            n[list(seen)] = list(seen.values())
            if not d:
                p[i] = (n + 1) / (n.sum() + N_SYMBOLS)
            else:
                above = p[index[d - 1, code & ((1 << BITS * (d - 1)) - 1)]]
                p[i] = (n + smooth * above) / (n.sum() + smooth)
            for x in range(N_SYMBOLS):
                length, longer = min(d + 1, DEPTH), ((code << BITS) | x) & ((1 << BITS * DEPTH) - 1)
                while (length, longer & ((1 << BITS * length) - 1)) not in index:
                    length -= 1
                self.next[i, x] = index[length, longer & ((1 << BITS * length) - 1)]
        self.log = (np.log10(p) - np.log10(SIZES)).astype(np.float32)
        self.states = len(order)

    def scores(self, words: list[list[bytes]], window: int = 256) -> np.ndarray:
        """log10 probability of each text.  Windows are walked side by side, from DEPTH symbols before their start."""
        if not words:
            return np.zeros(0)
        symbols, starts, counts = stream(words)
        n = len(symbols)
        wide = -(-n // window)
        padded = np.concatenate((np.zeros(DEPTH, np.int64), symbols, np.zeros(wide * window - n, np.int64)))
        at = np.arange(wide) * window
        state = np.zeros(wide, np.int64)
        step, log = self.next.ravel(), self.log.ravel()
        out = np.zeros((window, wide), np.float32)
        for t in range(window + DEPTH):
            k = state * N_SYMBOLS + padded[at + t]
            if t >= DEPTH:
                np.take(log, k, out=out[t - DEPTH])
            state = np.take(step, k).astype(np.int64)
        flat = out.T.ravel()[:n].astype(np.float64) * counts
        return np.add.reduceat(flat, starts[:-1])


def score(docs: DataFrame, trains: Column, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20, least_count: int = 8, least_gain: float = 12.0, smooth: float = 4.0, more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, any more columns asked for, n_tokens, n_known, train_tokens, base_score and score of each document."""
    view = doc_view(docs, id_col, text_col, F.coalesce(trains, F.lit(False)).alias("trains"), *more)
    kept = [c for c in view.columns if c not in ("text", "trains")]
    types = [f"`{c}` {view.schema[c].dataType.simpleString()}" for c in kept]
    total = view.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts_log2 = min(16, max(0, math.ceil(math.log2(blocks))))
    dealt = view.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt = dealt.repartition(blocks, "block") if blocks > 1 else dealt
    sums = materialise(dealt.groupBy("block").applyInArrow(count_block(parts_log2), BLOCK).groupBy("kind", "part").applyInArrow(sum_part(least_count, least_gain, smooth), BLOCK))
    totals = np.zeros(2, np.int64)
    ends = view.where("trains").count()
    for r in sums.where("kind = 'totals'").select("counts").toLocalIterator():
        totals += np.frombuffer(r.counts, np.int64)
    n, v = int(totals[0]) + ends, int(totals[1]) + (ends > 0)
    near = [(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in sums.where("kind = 'near'").select("keys", "counts").toLocalIterator()]
    tree = NearTree(*tallied([k for k, _ in near], [c for _, c in near]), least_count, least_gain, smooth)
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(key, table, back):
        known, hashes, starts = distinct_words(table)
        back = back.sort_by("part")
        of = {kind: back.filter(pc.equal(back.column("kind"), kind)).column("counts").to_pylist() for kind in ("word", "gram")}
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in of["word"]]) if of["word"] else np.zeros(0, np.int64)
        pieces = []
        for _, _, texts in texts_of(table):
            symbols, edges, counted = stream([t.lower().split() for t in texts])
            own, at = np.unique(grams(symbols, counted), return_inverse=True)
            pieces.append((own, at.astype(np.int32), edges[:-1] - DEPTH * np.arange(len(texts))))
        codes = np.unique(np.concatenate([own for own, _, _ in pieces])) if pieces else np.zeros(0, np.int64)
        gram_log = np.zeros(len(codes))
        if len(codes):
            order = np.argsort(context_parts(codes, parts_log2), kind="stable")
            gram_log[order] = shared.value.logs(codes[order], np.concatenate([np.frombuffer(x, np.float32).reshape(2, -1) for x in of["gram"]], axis=1))
        logs = np.log10((counts + 1) / (n + v + 1))
        end_log = math.log10((ends + 1) / (n + v + 1))
        n_tokens, n_known, base, scores = [], [], [], []
        for (own, place, begins), h, s in zip(pieces, hashes, starts, strict=True):
            at = np.searchsorted(known, h)
            run_known = np.concatenate(([0], np.cumsum(counts[at] > 0)))
            run_log = np.concatenate((logs[at], [0.0]))
            n_tokens.append(np.diff(s) + 1)
            n_known.append(run_known[s[1:]] - run_known[s[:-1]] + (ends > 0))
            base.append(np.where(np.diff(s) > 0, np.add.reduceat(run_log, s[:-1]), 0.0) + end_log)
            scores.append(np.add.reduceat(gram_log[np.searchsorted(codes, own)][place], begins))
        new = [np.concatenate(x) if x else np.zeros(0) for x in (n_tokens, n_known, base, scores)]
        columns = [*(table.column(c) for c in kept), pa.array(new[0].astype(np.int64)), pa.array(new[1].astype(np.int64)), pa.array(np.full(table.num_rows, n, np.int64)), pa.array(new[2].astype(float)), pa.array(new[3].astype(float))]
        return pa.Table.from_arrays(columns, [*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = sums.where("block >= 0").select("kind", "block", "part", "counts")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ", ".join([*types, "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"]))
