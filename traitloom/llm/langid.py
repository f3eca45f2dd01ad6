"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in passages of `span` bytes.  Each direction has one recurrent
unit with a gate f and a candidate n:

    f = sigmoid(Wf[x] + Uf h),  n = tanh(Wn[x] + f * (Un h)),  h' = n + f * (h - n)

A softmax over both directions' states labels every byte position; a document's
probabilities are the mean over all of its positions.  The network is trained in
numpy by backpropagation through time with Adam on all passages of a bounded
sample of labelled rows (`per_language` texts of a language, of up to `row_bytes`
each), whatever the number of languages, and then labels every byte of every
document in one pass without a shuffle.

Defined cases: null text, or text without a letter, is `und` with score 0;
without any labelled row every text is `und`; repeated rows get the same label;
ties between languages go to the first in sorted order; other columns are
ignored (predict) or passed through (keep_identified).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, doc_view

PAD = 256
UNDETERMINED = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    """2 sigmoid(2x) - 1; exp is the faster call here."""
    x *= 2
    sigmoid(x)
    x *= 2
    x -= 1
    return x


class ByteTagger:
    """Parameters of both directions: input rows W (2H, 257), recurrent U (2H, H); output O (L, 2H), c (L, 1)."""

    def __init__(self, labels: list[str], hidden: int = 8, span: int = 128, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden, self.span = labels, hidden, span
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.params = {f"{k}{d}": v for d in "<>" for k, v in (("W", draw(2 * hidden, PAD + 1, scale=0.3)), ("U", draw(2 * hidden, hidden, scale=0.3)))}
        self.params |= {"O": draw(len(labels), 2 * hidden, scale=0.3), "c": np.zeros((len(labels), 1), np.float32)}

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, H, B) of one direction over bytes x (T, B), as seen after each position."""
        w, u, n = self.params["W" + d], self.params["U" + d], self.hidden
        t_len, b = x.shape
        out = np.empty((t_len, n, b), np.float32)
        h = np.zeros((n, b), np.float32)
        for t in range(t_len) if d == ">" else range(t_len - 1, -1, -1):
            g = np.take(w, x[t], axis=1)
            r = u @ h
            f = g[:n]
            f += r[:n]
            sigmoid(f)
            a = g[n:]
            q = r[n:]
            a += q * f if keep is not None else np.multiply(q, f, out=q)
            tanh(a)
            new = out[t]
            np.subtract(h, a, out=new)
            new *= f
            new += a
            if keep is not None:
                keep.append((t, h, f, a, q))
            h = new
        return out

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(L, N) label probabilities of N positions."""
        n = self.hidden
        z = self.params["O"][:, :n] @ forward + self.params["O"][:, n:] @ backward + self.params["c"]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        return z

    def pooled(self, texts: list[bytes], block: int = 2048) -> np.ndarray:
        """(documents, labels) mean probabilities over all byte positions."""
        lengths = np.array([len(t) for t in texts], np.int64)
        spans = -(-lengths // self.span)
        total = int(spans.sum())
        flat = np.full(total * self.span, PAD, np.uint16)
        starts = np.concatenate(([0], np.cumsum(spans)))[:-1] * self.span
        for s, t in zip(starts.tolist(), texts, strict=True):
            flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
        x = flat.reshape(total, self.span)
        owner = np.repeat(np.arange(len(texts)), spans)
        sums = np.zeros((total, len(self.labels)))
        for i in range(0, total, block):
            part = np.ascontiguousarray(x[i : i + block].T)
            forward, backward = self.states(part, ">"), self.states(part, "<")
            real = part != PAD
            acc = np.zeros((len(self.labels), part.shape[1]), np.float32)
            for t in range(self.span):
                acc += self.probabilities(forward[t], backward[t]) * real[t]
            sums[i : i + block] = acc.T
        out = np.stack([np.bincount(owner, sums[:, k], len(texts)) for k in range(len(self.labels))], axis=1)
        return out / np.maximum(lengths, 1)[:, None]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all real positions of passages x (T, B) with labels y (B)."""
        n, (t_len, b) = self.hidden, x.shape
        kept: dict[str, list] = {">": [], "<": []}
        h = {d: self.states(x, d, kept[d]) for d in kept}
        real = (x != PAD).astype(np.float32)
        real /= max(real.sum(), 1)
        out: dict[str, np.ndarray] = {k: np.zeros_like(v) for k, v in self.params.items()}
        into = {d: np.empty_like(h[d]) for d in kept}
        for t in range(t_len):
            e = self.probabilities(h[">"][t], h["<"][t])
            e[y, np.arange(b)] -= 1
            e *= real[t]
            out["O"][:, :n] += e @ h[">"][t].T
            out["O"][:, n:] += e @ h["<"][t].T
            out["c"] += e.sum(axis=1, keepdims=True)
            into[">"][t], into["<"][t] = self.params["O"][:, :n].T @ e, self.params["O"][:, n:].T @ e
        for d in kept:
            u = self.params["U" + d]
            carry = np.zeros((n, b), np.float32)
            to_input = np.empty((t_len, 2 * n, b), np.float32)
            da = np.empty((2 * n, b), np.float32)
            for t, before, f, a, q in reversed(kept[d]):
                carry += into[d][t]
                dn = carry * (1 - f) * (1 - a * a)
                to_input[t, n:] = dn
                to_input[t, :n] = (carry * (before - a) + dn * q) * f * (1 - f)
                da[:n], da[n:] = to_input[t, :n], dn * f
                carry = carry * f + u.T @ da
                out["U" + d] += da @ before.T
            seen = x.ravel()
            out["W" + d] = np.stack([np.bincount(seen, to_input[:, k].ravel(), PAD + 1) for k in range(2 * n)]).astype(np.float32)
        return out

    def train(self, passages: list[bytes], labels: list[str], *, steps: int = 240, batch: int = 256, rate: float = 0.03, seed: int = 11) -> ByteTagger:
        rng = np.random.default_rng(seed)
        index = {x: i for i, x in enumerate(self.labels)}
        y = np.array([index[x] for x in labels])
        x = np.full((len(passages), self.span), PAD, np.uint16)
        for i, p in enumerate(passages):
            if rng.random() < 0.2:  # so that the network also meets short texts
                p = p[: 1 + int(rng.integers(self.span))]
            x[i, : len(p)] = np.frombuffer(p[: self.span], np.uint8)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        step = 0
        while step < steps:
            order = rng.permutation(len(y))
            for i in range(0, min(len(y), (steps - step) * batch), batch):
                step += 1
                pick = order[i : i + batch]
                now = rate * (1 - 0.9 * step / steps)
                for k, g in self.gradients(np.ascontiguousarray(x[pick].T), y[pick]).items():
                    np.clip(g, -1, 1, out=g)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.params[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, row_bytes: int = 1 << 16, span: int = 128, hidden: int = 8) -> ByteTagger | None:
    """Trains on all passages of about `per_language` distinct labelled texts of each language, of up to `row_bytes`.

    The sample is chosen by a hash of the text, so it doesn't depend on partitioning.
    """
    text = F.col(text_col).cast("binary")
    labelled = docs.where(F.col(lang_col).isNotNull() & F.octet_length(text).between(1, row_bytes)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_language / n))])
    key = F.xxhash64("lang", "text")
    chosen = labelled.where((F.pmod(key, F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    once = chosen.groupBy("lang", key.alias("k")).agg(F.first("text").alias("text"))
    rows = sorted(once.collect(), key=lambda r: (r.k, r.lang, r.text))
    passages = [(r.lang, bytes(r.text[i : i + span])) for r in rows for i in range(0, len(r.text), span)]
    if not passages:
        return ByteTagger(sorted(counts), hidden, span)
    return ByteTagger(sorted(counts), hidden, span).train([p for _, p in passages], [x for x, _ in passages])


def labelled_batches(batches: Iterator[pa.RecordBatch], model: ByteTagger | None, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    for batch in batches:
        for b in chunks(batch, text_col):
            texts = [x.encode() if isinstance(x, str) else x or b"" for x in b.column(text_col).to_pylist()]
            if model is None:
                yield b, [UNDETERMINED] * len(texts), [0.0] * len(texts)
                continue
            p = model.pooled(texts)
            best = p.argmax(axis=1)
            known = [has_letter(t) for t in texts]
            yield b, [model.labels[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known, strict=True)], [min(1.0, s) if ok else 0.0 for s, ok in zip(p.max(axis=1).tolist(), known, strict=True)]


def predict(docs: DataFrame, model: ByteTagger | None, *, id_col: str = "doc_id", text_col: str = "text", more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, any more columns asked for, lang_pred and score of each document."""
    view = doc_view(docs, id_col, text_col, *more)
    kept = [c for c in view.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b, labels, scores in labelled_batches(batches, shared.value, "text"):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    types = ", ".join(f"`{c}` {view.schema[c].dataType.simpleString()}" for c in kept)
    return view.mapInArrow(run, f"{types}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ByteTagger | None, *, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The documents whose language is determined with a score of at least `least`; columns as they were."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b, labels, scores in labelled_batches(batches, shared.value, text_col):
            yield b.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(labels, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
