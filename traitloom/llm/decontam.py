"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every window of `n` consecutive item words (a shorter, non-empty item is one
window) is hashed into a set which tasks probe with the windows of each
training document.  A hash hit is verified word by word before it counts.

The item table is broadcast only after its size is read: a window is a few words of
text and about 60 bytes of the set, so `max_block_bytes` of text bound it.  Above
that the items are cut into blocks by hash, each block scans all
documents, and the partial hits of a document are merged afterwards.

Defined cases: null or word-less text has no words and no hit; null or empty
items have no window; an item without id is left out; repeated items count
once; repeated documents are reported once per row; tables may be empty; other
columns are ignored (annotate) or passed through (clean).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPANS, alnum_words, bound_batches, chunks, doc_view, united

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class WindowSet:
    """The distinct windows of some items, by length: sorted hashes, word ids, and places in a list of the items of each."""

    def __init__(self, items: Iterable[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text or b"")], np.int32)
            if m := min(n, len(ids)):
                found.setdefault(m, []).append((np.lib.stride_tricks.sliding_window_view(ids, m), len(self.names)))
                self.names.append(name)
        self.tables = []
        for m, windows in sorted(found.items()):
            rows = np.ascontiguousarray(np.concatenate([w for w, _ in windows]))
            owner = np.repeat([k for _, k in windows], [len(w) for w, _ in windows])
            distinct, of = np.unique(rows.view(f"V{4 * m}").ravel(), return_inverse=True)
            grams = distinct.view(np.int32).reshape(-1, m)
            of, owner = np.divmod(np.unique(of.ravel() * len(self.names) + owner), len(self.names))
            edges = np.searchsorted(of, np.arange(len(grams) + 1))
            hashes = self.hashed(grams.T)
            order = np.argsort(hashes, kind="stable")
            self.tables.append((m, hashes[order], grams[order], edges[order], edges[order + 1], owner.astype(np.int32)))

    @staticmethod
    def hashed(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            out = (out ^ c.astype(np.uint64)) * BASE
            out ^= out >> np.uint64(29)
        return out

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(start, length, items) of every verified window in word ids, where 0 is no item's word."""
        out = []
        holes = np.concatenate(([0], np.cumsum(ids == 0)))
        for m, hashes, grams, first, last, owner in self.tables:
            if len(ids) < m:
                continue
            at = np.flatnonzero(holes[m:] == holes[:-m])
            if not len(at):
                continue
            probe = self.hashed([ids[at + j] for j in range(m)])
            place = np.searchsorted(hashes, probe)
            same = hashes[np.minimum(place, len(hashes) - 1)] == probe
            for i, h in zip(at[same].tolist(), place[same].tolist(), strict=True):
                word, value = ids[i : i + m], hashes[h]
                while h < len(hashes) and hashes[h] == value:
                    if np.array_equal(grams[h], word):
                        out.append((i, m, [self.names[k] for k in owner[first[h] : last[h]].tolist()]))
                        break
                    h += 1
        return out

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: its number of words, the maximal hit word ranges, and the items that occur."""
        known, sizes = [], []
        for text in texts:
            words = alnum_words(text or b"")
            sizes.append(len(words))
            known.extend(map(self.vocabulary.get, words, repeat(0)))
            known.append(0)
        ends = np.cumsum(np.array(sizes, dtype=np.int64) + 1)
        found: list[list[tuple[int, int, list[str]]]] = [[] for _ in texts]
        for i, m, names in self.hits(np.array(known, dtype=np.int64)):
            d = int(np.searchsorted(ends, i, side="right"))
            found[d].append((i - int(ends[d] - sizes[d] - 1), m, names))
        for n_words, hits in zip(sizes, found, strict=True):
            spans: list[tuple[int, int]] = []
            for i, m, _ in sorted(hits, key=lambda x: x[:2]):
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], i + m))
                else:
                    spans.append((i, i + m))
            yield n_words, spans, sorted({x for _, _, names in hits for x in names})


def window_blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, max_block_bytes: int) -> Iterator[WindowSet]:
    """Window sets over blocks of items, each read only after its size is known to be bounded."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item IS NOT NULL AND octet_length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // max_block_bytes)) if total > max_block_bytes else 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield WindowSet(((r.item, bytes(r.text)) for r in part.toLocalIterator()), n)


def annotate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, spans (hit word ranges, maximal, ascending) and items (sorted as strings) of each document."""
    spark = docs.sparkSession
    view = doc_view(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    id_type = view.schema["doc_id"].dataType.simpleString()
    parts = []
    for windows in window_blocks(benchmark, item_col, item_text_col, n, max_block_bytes):
        shared = spark.sparkContext.broadcast(windows)

        def scan(batches, shared=shared):
            for batch in batches:
                for b in chunks(batch, "text"):
                    rows = list(shared.value.scan(b.column("text").to_pylist()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("doc_id"),
                            b.column("key"),
                            pa.array([r[0] for r in rows], pa.int64()),
                            pa.array([[{"start": i, "stop": j} for i, j in r[1]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                            pa.array([r[2] for r in rows], pa.list_(pa.string())),
                        ],
                        ["doc_id", "key", "n_words", "spans", "items"],
                    )

        parts.append(view.mapInArrow(scan, f"doc_id {id_type}, key bigint, n_words bigint, spans {SPANS}, items array<string>"))
    return (parts[0] if len(parts) == 1 else merged(parts)).drop("key")


def merged(parts: list[DataFrame]) -> DataFrame:
    """Joins the partial hits of item blocks; key tells apart texts that share an id."""
    whole = parts[0].select("doc_id", "key", "n_words")
    found = parts[0].where("size(items) > 0")
    for p in parts[1:]:
        found = found.unionByName(p.where("size(items) > 0"))
    found = found.distinct().groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.select(F.col("doc_id").alias("k"), F.col("key").alias("t"), united("s").alias("spans"), "items")
    return whole.join(found, F.col("doc_id").eqNullSafe(F.col("k")) & F.col("key").eqNullSafe(F.col("t")), "left").select(
        "doc_id", "key", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = 4 << 20) -> DataFrame:
    """The documents without any hit, all columns as they were; blocks of items filter one after another."""
    spark = docs.sparkSession
    bound_batches(spark)
    out = docs
    for windows in window_blocks(benchmark, item_col, item_text_col, n, max_block_bytes):
        shared = spark.sparkContext.broadcast(windows)

        def keep(batches, shared=shared):
            for batch in batches:
                for b in chunks(batch, text_col):
                    texts = [x.encode() if isinstance(x, str) else x for x in b.column(text_col).to_pylist()]
                    yield b.filter(pa.array([not r[1] for r in shared.value.scan(texts)], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
