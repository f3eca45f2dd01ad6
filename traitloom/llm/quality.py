"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `span` bytes.  Each passage is encoded by the
frequencies of neighbouring byte classes and by how its words repeat.  Labels
are known for documents only, so gated attention learns which passages count:

    h = tanh(A x + a),  w = softmax over the bag of g . (tanh(V h) * sigmoid(U h)),
    score = sigmoid(c . sum(w h) + d)

The network is trained in numpy on a bounded sample of labelled rows (`per_class`
a class, texts of up to `row_bytes`), each with all its passages; scoring
reads every passage of every document in one pass without a shuffle.  A passage's
features depend on its own bytes only, and scores are given to nine places, so
neither order nor partitioning changes them.

Defined cases: null or empty text is a bag of one empty passage and is scored
like any other; without labelled rows every score is 0.5; labels other than 0
and 1, null ones and those without a document are left out; repeated label rows
count as often as they occur, as far as the sample goes; repeated documents get
equal scores; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, doc_view
from .hashing import SPACE, RangeHash, spans_of


def byte_classes() -> np.ndarray:
    """16 classes of bytes."""
    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOUBCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n\r", "\t", ".,", ";:", "!?", "'\"`", "()[]{}", "#$%&*", "+-=<>_/~^", "@|\\"]
    table = np.full(256, 15, np.uint16)  # the rest: control bytes and those of longer characters
    for k, group in enumerate(groups):
        table[[ord(c) for c in group]] = k
    return table


CLASSES = byte_classes()
N_CLASSES = 16
N_FEATURES = N_CLASSES * N_CLASSES + 5


def cut(texts: list[bytes], span: int) -> tuple[list[bytes], np.ndarray]:
    """Passages of all texts (one empty passage for an empty text) and the owner of each."""
    passages, owner = [], []
    for k, t in enumerate(texts):
        n = max(1, -(-len(t) // span))
        passages += [t[i * span : (i + 1) * span] for i in range(n)]
        owner += [k] * n
    return passages, np.array(owner, np.int64)


def encode(passages: list[bytes]) -> np.ndarray:
    """(passages, N_FEATURES) float32."""
    n = len(passages)
    out = np.zeros((n, N_FEATURES), np.float32)
    sizes = np.fromiter(map(len, passages), np.int64, n)
    a = np.frombuffer(b" ".join(passages) + b" ", np.uint8)
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(n), sizes + 1)
    c = CLASSES[a].astype(np.int64)
    inside = np.ones(len(a), bool)
    inside[ends - 1] = False  # the blank after each passage
    pair = owner[:-1] * (N_CLASSES * N_CLASSES) + c[:-1] * N_CLASSES + c[1:]
    counts = np.bincount(pair[inside[:-1] & inside[1:]], minlength=n * N_CLASSES * N_CLASSES).reshape(n, -1)
    out[:, : N_CLASSES * N_CLASSES] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    s, e = spans_of(~SPACE[a])
    if len(s):
        words = RangeHash(a).of(s, e)
        of = np.searchsorted(ends, s, side="right")
        total = np.maximum(np.bincount(of, minlength=n), 1)
        for k, lag in enumerate((1, 2, 3)):
            if len(words) > lag:
                same = (words[lag:] == words[:-lag]) & (of[lag:] == of[:-lag])
                out[:, 256 + k] = np.bincount(of[lag:][same], minlength=n) / total
        keyed = np.unique(words ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        out[:, 259] = np.bincount(of[keyed], minlength=n) / total
        out[:, 260] = np.minimum(np.bincount(of, weights=e - s, minlength=n) / total, 30) / 10
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionBag:
    def __init__(self, hidden: int = 32, attention: int = 16, span: int = 512, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
        self.span = span
        self.params = {"A": draw(hidden, N_FEATURES), "a": np.zeros(hidden, np.float32), "V": draw(attention, hidden), "U": draw(attention, hidden), "g": draw(attention), "c": draw(hidden), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags in order; starts: where each bag begins."""
        p = self.params
        n = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["A"].T + p["a"])
        t, s = np.tanh(h @ p["V"].T), sigmoid(h @ p["U"].T)
        e = (t * s) @ p["g"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        w = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(w[:, None] * h, starts)
        return {"n": n, "h": h, "t": t, "s": s, "w": w, "z": z, "score": sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.params, self.forward(x, starts)
        dl = ((f["score"] - y) * weight / len(y)).astype(np.float32)
        dz = np.repeat(dl[:, None] * p["c"], f["n"], axis=0)
        dw = (f["h"] * dz).sum(axis=1)
        de = f["w"] * (dw - np.repeat(np.add.reduceat(f["w"] * dw, starts), f["n"]))
        dt = de[:, None] * p["g"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * p["g"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["w"][:, None] * dz + dt @ p["V"] + ds @ p["U"]
        dp = dh * (1 - f["h"] ** 2)
        return {"A": dp.T @ x, "a": dp.sum(axis=0), "V": dt.T @ f["h"], "U": ds.T @ f["h"], "g": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def train(self, bags: list[list[bytes]], y: np.ndarray, weight: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> AttentionBag:
        rng = np.random.default_rng(seed)
        x = [encode(b) for b in bags]
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        step, steps = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(bags), batch):
                step += 1
                pick = order[i : i + batch]
                starts = np.concatenate(([0], np.cumsum([len(x[k]) for k in pick])))[:-1]
                now = rate * (1 - 0.95 * step / steps)
                for k, g in self.gradients(np.concatenate([x[k] for k in pick]), starts, y[pick], weight[pick]).items():
                    g = g + decay * self.params[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.params[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def scores(self, texts: list[bytes], block: int = 2048) -> np.ndarray:
        """The score of each text; passages are encoded in blocks, and a bag may reach over many."""
        passages, owner = cut(texts, self.span)
        p = self.params
        n, hidden = len(texts), len(p["a"])
        top = np.full(n, -np.inf)
        parts = []
        for i in range(0, len(passages), block):
            h = np.tanh(encode(passages[i : i + block]).astype(np.float64) @ p["A"].T + p["a"])
            e = (np.tanh(h @ p["V"].T) * sigmoid(h @ p["U"].T)) @ p["g"]
            np.maximum.at(top, owner[i : i + block], e)
            parts.append((h, e))
        z, total = np.zeros((n, hidden)), np.zeros(n)
        at = 0
        for h, e in parts:
            of = owner[at : at + len(e)]
            w = np.exp(e - top[of])
            np.add.at(total, of, w)
            np.add.at(z, of, w[:, None] * h)
            at += len(e)
        return sigmoid(z @ p["c"] / total + p["d"]).round(9)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1500, row_bytes: int = 1 << 16, span: int = 512) -> AttentionBag | None:
    """Trains on a bounded sample, chosen by a hash of the label rows; classes are weighted back to their own shares.

    At most `per_class` label rows a class, twice as many documents in all, and texts of up to `row_bytes`.
    """
    marked = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("y")).where("doc IS NOT NULL AND y IN (0, 1)")
    counts = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    if not counts:
        return None
    parts = [marked.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(per_class) for y in counts]
    sample = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])  # at most 2 * per_class rows
    view = doc_view(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(b""))).where(F.octet_length("text") <= row_bytes)
    held = view.join(F.broadcast(sample), F.col("doc_id") == F.col("doc")).select("y", F.xxhash64("doc").alias("k"), "text")
    rows = held.orderBy("k", "y", F.md5("text")).limit(2 * per_class).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.k, r.y, r.text))
    y = np.array([r.y for r in rows], np.float32)
    share = {k: n / sum(counts.values()) for k, n in counts.items()}
    weight = np.array([share[int(v)] / max(1e-9, float((y == v).mean())) for v in y], np.float32)
    return AttentionBag(span=span).train([cut([bytes(r.text)], span)[0] for r in rows], y, weight)


def score(docs: DataFrame, model: AttentionBag | None, *, id_col: str = "doc_id", text_col: str = "text", more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, any more columns asked for, and the score of each document."""
    view = doc_view(docs, id_col, text_col, *more)
    kept = [c for c in view.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for b in chunks(batch, "text", 1 << 20):
                texts = [x or b"" for x in b.column("text").to_pylist()]
                s = np.full(len(texts), 0.5) if shared.value is None else shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(s, pa.float64())], [*kept, "score"])

    types = ", ".join(f"`{c}` {view.schema[c].dataType.simpleString()}" for c in kept)
    return view.mapInArrow(run, f"{types}, score double")
