"""Quality figures of the trained and approximate operators: python -m traitloom.llm.measure SF_DIR

Prints one JSON line: held-out accuracy of language and quality labels, recall of the
nearest neighbours against brute force, and bits per byte of held-out texts under the
suffix tree, a unigram of bytes and a model of fixed order (three bytes before).
"""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries
from .common import read, space_words


def language(spark: SparkSession, sf_dir: str) -> float:
    """Share of held-out documents with a label whose predicted language is theirs."""
    both = queries.op2_language_id(spark, sf_dir).where("held_out AND lang_pred <> 'und'").join(read(spark, sf_dir, "documents").select("doc_id", "lang").where("lang IS NOT NULL"), "doc_id")
    return both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]


def quality(spark: SparkSession, sf_dir: str) -> float:
    """Share of held-out labelled documents on the right side of 0.7."""
    both = queries.op4_quality(spark, sf_dir).where("held_out").join(read(spark, sf_dir, "labels").where("quality IN (0, 1)"), "doc_id")
    return both.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]


def recall(spark: SparkSession, sf_dir: str) -> float:
    """Share of the true five nearest rows that the search finds, over all its queries."""
    found: dict[int, set] = {}
    for r in queries.op5_ann(spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    e = read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x)) AND exists(embedding, x -> x <> 0)").select("vec_id", "embedding").toArrow()
    ids, x = e.column("vec_id").to_numpy(), np.array(e.column("embedding").to_pylist(), float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0).tolist():
        s = u @ u[q]
        s[ids == ids[q]] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        hits, total = hits + len(set(best.tolist()) & found[int(ids[q])]), total + len(best)
    return hits / max(1, total)


def codes(texts: list[bytes], order: int) -> np.ndarray:
    """Every byte with the `order` before it as one number; each text has zeros before it and one after."""
    a = np.frombuffer(b"".join(b"\0" * order + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    real = np.concatenate([np.arange(len(t) + order + 1) >= order for t in texts])
    out = a.copy()
    for k in range(1, order + 1):
        out[k:] |= a[:-k] << (8 * k)
    return out[real]


def fixed_order(train: list[bytes], held: list[bytes], order: int, smooth: float = 4.0) -> float:
    """Bits of the held-out texts: counts of each order, smoothed towards the next lower one."""
    grams, own = codes(train, order), codes(held, order)
    p = np.full(len(own), 1 / 257)
    for k in range(order + 1):
        mask = (1 << 8 * (k + 1)) - 1
        seen, n = np.unique(grams & mask, return_counts=True)
        contexts, of = np.unique(seen >> 8, return_inverse=True)
        total = np.bincount(of, n)
        at = np.minimum(np.searchsorted(seen, own & mask), len(seen) - 1)
        hit = np.where(seen[at] == own & mask, n[at], 0)
        at = np.minimum(np.searchsorted(contexts, (own & mask) >> 8), len(contexts) - 1)
        whole = np.where(contexts[at] == (own & mask) >> 8, total[at], 0)
        p = (hit + smooth * p) / (whole + smooth)
    return float(-np.log2(p).sum())


def bits(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Bits per byte of held-out texts, normalised as the tree reads them, their ends included."""
    scored: DataFrame = queries.op9_lm_score(spark, sf_dir).where("held_out")
    texts = read(spark, sf_dir, "documents").select(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held"), "text").toLocalIterator()
    sides: tuple[list[bytes], list[bytes]] = ([], [])
    for r in texts:
        sides[r.held].append(b" ".join(space_words((r.text or "").encode())))
    n = sum(len(t) + 1 for t in sides[1])
    tree = -scored.agg(F.sum("score")).first()[0] / np.log10(2)
    return {"tree": tree / n, "byte_unigram": fixed_order(*sides, 0) / n, "fixed_order_3": fixed_order(*sides, 3) / n}


def main() -> None:
    from ..session import local_session

    spark, d = local_session(8, "8g"), sys.argv[1]
    figures = {"language_accuracy": language(spark, d), "quality_accuracy": quality(spark, d), "ann_recall": recall(spark, d)} | {f"bits_per_byte_{k}": v for k, v in bits(spark, d).items()}
    print(json.dumps({k: round(v, 4) for k, v in figures.items()}))
    spark.stop()


if __name__ == "__main__":
    main()
