"""Removal of repeated byte strings by two-stage suffix sorting.

Every byte covered by a string of `size` bytes that also starts anywhere else is
removed.  The work is narrowed before it is sorted:

1. Texts that occur more than once (by a 128-bit digest) and have `size` bytes are
   removed whole; what is sorted of such a text is sorted once.
2. The starts of all strings of a text are cut into runs that share a
   content-defined anchor, so equal strings always meet under one anchor.
   Anchors that occur once are done, before anything else is shuffled of them; runs whose whole context occurs twice (by two
   64-bit hashes, the anchor's and the context's) are removed whole.
3. What is left, runs that agree in part with others of their anchor, is sorted.
   Contexts of an anchor are brought together and their suffixes sorted in two
   stages: those smaller than their successors directly, to `size` bytes; all
   others are induced from them by a scan of the first-byte buckets in
   ascending order.  The common prefixes of neighbours, compared byte by byte, then
   tell the repeated starts.

With `words`, strings of that many words are found as well where they are shorter
than `size`: these are few, so each is hashed and counted (a longer one is found
by its bytes).

An anchor with very many contexts is cut into groups by hash; each group also
sends one hash per distinct start, which are counted across groups.

Defined cases: null text counts as empty; texts shorter than `size` are kept;
repeated rows are copies like any other; words are cut at ASCII blanks; matches never cross documents; an empty
table gives no row; other columns, whatever their names, are ignored (find) or passed through (remove_repeats).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, anchor_runs
from .common import SPANS, beside, bound_batches, discard, joined_texts, last_written, slices, united, unused, written
from .hashing import RangeHash, mix


#: Suffixes whose first bytes are held for comparison at a time.
DIRECT = 100_000


def big_endian(data: bytes, ahead: int) -> np.ndarray:
    """The eight bytes from each position on as a number that orders like them; zeros follow the end."""
    padded = np.frombuffer(data + bytes(ahead + 8), np.uint8)
    return np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))


def sorted_directly(data: bytes, first: np.ndarray, depth: int) -> np.ndarray:
    """Starts (ascending) of some suffixes, ordered by their first `depth` bytes: by eight as a number, and ties of those by comparison, `DIRECT` at a time."""
    if not len(first):
        return first
    key = big_endian(data, 8)[first].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    first, key = first[order], key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    stop = np.append(start[1:], len(first))
    start, stop = start[stop - start > 1], stop[stop - start > 1]
    for i, j in slices(stop - start, DIRECT):
        at = np.concatenate([np.arange(a, z) for a, z in zip(start[i:j].tolist(), stop[i:j].tolist(), strict=True)])
        first[at] = sorted(first[at].tolist(), key=lambda x: data[x : x + depth])
    return first


def two_stage_order(data: bytes, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first `depth` bytes."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    if not n:
        return np.zeros(0, np.int32)
    differs = np.append(a[1:] != a[:-1], True)
    # for each position, where its run of equal bytes ends
    end = np.minimum.accumulate(np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]
    after = np.append(a, np.uint8(0))[end + 1]
    small = (end < n - 1) & (a[end] < after)  # smaller than its successor
    sorted_small = sorted_directly(data, np.flatnonzero(small).astype(np.int32), depth)
    counts = np.bincount(a, minlength=256)
    bucket_end = np.cumsum(counts)
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1  # the empty suffix
    of = a[sorted_small]
    n_small = np.bincount(of, minlength=256)
    small_start = bucket_end - n_small
    rank[sorted_small] = small_start[of] + np.arange(len(of)) - np.concatenate(([0], np.cumsum(n_small)))[of]
    large = np.flatnonzero(~small).astype(np.int32)
    large = large[np.argsort(a[large], kind="stable")]
    cut = np.concatenate(([0], np.cumsum(np.bincount(a[large], minlength=256))))
    for c in np.flatnonzero(np.diff(cut)).tolist():
        part = large[cut[c] : cut[c + 1]]
        at = bucket_end[c] - counts[c]
        level = end[part] - part  # 0: its successor starts with a smaller byte and has its place
        for k in np.unique(level).tolist():
            now = part[level == k]
            now = now[np.argsort(rank[now + 1], kind="stable")]
            rank[now] = at + np.arange(len(now))
            at += len(now)
    order = np.empty(n, np.int32)
    order[rank[:n]] = np.arange(n, dtype=np.int32)
    return order


def shared_prefixes(data: bytes, order: np.ndarray, size: int) -> np.ndarray:
    """Whether the common prefix of each suffix (of at least `size` bytes) and the next one has `size` bytes: a hash rules out most, then bytes are compared."""
    h = RangeHash(np.frombuffer(data, np.uint8)).of(order, order + size)
    pair = np.flatnonzero(h[1:] == h[:-1])
    del h
    out = np.zeros(max(0, len(order) - 1), bool)
    out[pair] = [data[i : i + size] == data[j : j + size] for i, j in zip(order[pair].tolist(), order[pair + 1].tolist(), strict=True)]
    return out


def repeated_starts(data: bytes, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the string of `size` bytes at each start (ascending, distinct) also stands at another; and whether an equal one comes earlier in order."""
    order = two_stage_order(data, size)
    wanted = np.zeros(len(data) + 1, bool)
    wanted[starts] = True
    order = order[wanted[order]]
    same = shared_prefixes(data, order, size)
    hit = np.append(same, False)
    hit[1:] |= same
    later = np.concatenate((np.zeros(min(1, len(order)), bool), same))
    back = np.argsort(order)
    return hit[back], later[back]


ANCHORS = "num bigint, digest binary, first int, last int, anchor bigint, context bigint"


def runs_of(batches, size: int):
    """Runs of every text of at least `size` bytes; its digest stands in the first one only."""
    for b, texts, buffer, starts in joined_texts(batches, "text", 1 << 19):
        if not len(buffer):
            continue
        hashes = RangeHash(np.frombuffer(buffer, np.uint8))
        who, found = [], []
        for k, t in enumerate(texts):
            if len(t) >= size:
                o = int(starts[k])
                a, h, s, e = anchor_runs(hashes, o, o + len(t), size)
                context = hashes.of(s, e + size) ^ mix((a - s).astype(np.uint64))
                found.append(((s - o).astype(np.int32), (e - o).astype(np.int32), h.view(np.int64), context.view(np.int64)))
                who.append(np.full(len(a), k))
        if found:
            at = np.concatenate(who)
            columns = [np.concatenate([f[i] for f in found]) for i in range(4)]
            again = np.concatenate(([False], at[1:] == at[:-1]))
            yield pa.RecordBatch.from_arrays([b.column("num").take(pa.array(at)), b.column("digest").take(pa.array(at, mask=again)), *map(pa.array, columns)], [c.split()[0] for c in ANCHORS.split(", ")])


SHORT = "digest binary, start bigint, stop bigint, hash binary"


def short_windows(batches, words: int, size: int):
    """Every string of `words` words, from its first word's start to its last one's end, that is shorter than `size` bytes."""
    for b, texts, buffer, starts in joined_texts(batches, "text", 1 << 19):
        a = np.frombuffer(buffer, np.uint8)
        inside = ~((a == 0x20) | ((a >= 0x09) & (a <= 0x0D)))
        who, found, hashes = [], [], []
        for k, t in enumerate(texts):
            o = int(starts[k])
            edge = np.diff(np.concatenate(([0], inside[o : o + len(t)].astype(np.int8), [0])))
            first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            first, stop = first[: max(0, len(first) - words + 1)], stop[words - 1 :]
            few = stop - first < size
            found.append(np.stack([first[few], stop[few]]))
            who.append(np.full(int(few.sum()), k))
            hashes += [hashlib.md5(t[x:y]).digest() for x, y in found[-1].T.tolist()]
        if hashes:
            start, stop = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(np.concatenate(who))), pa.array(start), pa.array(stop), pa.array(hashes, pa.binary())], [c.split()[0] for c in SHORT.split(", ")])


FOUND = "digest binary, start bigint, stop bigint, hash bigint, place bigint"


def sort_contexts(batches, size: int, limit: int = 1 << 20):
    """Contexts come ordered by anchor and part; batches of whole groups are sorted together."""
    held: list[tuple] = []
    total, key = 0, None

    def flush():
        rows = list({(r[0], r[1], r[3], r[4]): r for r in held}.values())  # repeated rows are one context
        data = b"".join(r[5] for r in rows)
        sizes = np.array([len(r[5]) for r in rows], np.int64)
        offset = np.cumsum(sizes) - sizes
        many = sizes - size + 1
        base = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(rows)), many)
        starts = np.arange(int(many.sum())) - base[owner] + offset[owner]
        hit, later = repeated_starts(data, starts, size)
        place = starts - offset[owner] + np.array([r[4] for r in rows], np.int64)[owner]
        digests = pa.array([r[3] for r in rows], pa.binary())
        # ranges of neighbouring repeated starts
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))) | np.concatenate(([0], (owner[1:] != owner[:-1]).astype(np.int8), [0])))
        a, z = edge[:-1], edge[1:] - 1
        keep = hit[np.minimum(a, max(len(hit) - 1, 0))] if len(a) else np.zeros(0, bool)
        a, z = a[keep], z[keep]
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([digests.take(pa.array(owner[a])), pa.array(place[a]), pa.array(place[z] + size), none, none], [c.split()[0] for c in FOUND.split(", ")])
        split = np.flatnonzero(np.array([r[2] > 1 for r in rows], bool)[owner] & ~later)
        if len(split):
            h = RangeHash(np.frombuffer(data, np.uint8)).of(starts[split], starts[split] + size) ^ mix(np.array([r[0] for r in rows], np.int64)[owner[split]].view(np.uint64))
            one = np.array([int.from_bytes(r[3][:8], "big") for r in rows], np.uint64)[owner[split]]
            yield pa.RecordBatch.from_arrays(
                [digests.take(pa.array(owner[split])), pa.array(place[split]), pa.array(place[split] + size), pa.array(h.view(np.int64)), pa.array(mix(place[split].astype(np.uint64) ^ one).view(np.int64))],
                [c.split()[0] for c in FOUND.split(", ")],
            )

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "part", "parts", "digest", "first", "context")), strict=True):
            if total >= limit and row[:2] != key:
                yield from flush()
                held, total = [], 0
            key = row[:2]
            held.append(row)
            total += len(row[5])
    if held:
        yield from flush()


def find(docs: DataFrame, *, text_col: str = "text", size: int = 400, words: int | None = None, group_contexts: int = 6000) -> DataFrame:
    """digest (of the text's bytes) and spans of every text that loses anything."""
    if size < GRAM + 8:
        raise ValueError(f"size must be at least {GRAM + 8}")
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    view = docs.select(text.alias("text")).select(F.unhex(F.md5("text")).alias("digest"), "text")
    return last_written(docs.sparkSession, lambda: repeats(view, size, words, group_contexts))


def repeats(every: DataFrame, size: int, words: int | None, group_contexts: int) -> DataFrame:
    """digest, spans of every text of `every` (digest, text) that loses anything."""
    spark, place = every.sparkSession, F.xxhash64("num", "first")
    view = every.where(F.octet_length("text") >= size)
    copies = view.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("bigint").alias("size"))
    copied = written(copies.where("n > 1").select("digest", F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").alias("stop")).alias("span")))
    anchors = written(view.withColumn("num", F.monotonically_increasing_id()).mapInArrow(lambda b: runs_of(b, size), ANCHORS))
    names = written(anchors.where("digest IS NOT NULL").select("num", "digest"))
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    several = written(anchors.drop("digest").join(often, "anchor"))
    discard(spark, [anchors.written_to])
    # per context whether it stands in more than one place, and per anchor whether any does not
    contexts = several.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("lo"))
    groups = contexts.groupBy("anchor").agg(F.max((F.col("n") == 1).cast("int")).alias("partial"), F.count("*").alias("m"))
    known = contexts.join(groups, "anchor").select("anchor", "context", "lo", (F.col("n") > 1).alias("full"), "partial", F.ceil(F.col("m") / group_contexts).cast("int").alias("parts"))
    flagged = written(several.join(known, ["anchor", "context"]))
    discard(spark, [several.written_to])
    full = flagged.where("full").select("num", F.col("first").cast("bigint").alias("start"), (F.col("last") + size).cast("bigint").alias("stop"))
    # one place of each context is sorted, however often it stands in one text
    detail = flagged.where(F.col("partial") == 1).where(~F.col("full") | (place == F.col("lo"))).join(names, "num")
    part = F.pmod(F.xxhash64("digest", "first"), F.col("parts")).cast("int").alias("part")
    wanted = written(detail.groupBy("digest").agg(F.collect_list(F.struct(F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "anchor", part, "parts")).alias("runs")))
    # copies of a text are one row of it before anything is brought together
    texts = view.join(beside(wanted.select("digest"), wanted.count()), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    cut = texts.join(wanted, "digest").select("digest", F.explode("runs").alias("r"), "text")
    cut = cut.select("r.anchor", "r.part", "r.parts", "digest", "r.first", F.substring("text", F.col("r.first").cast("int") + 1, (F.col("r.last") - F.col("r.first") + size).cast("int")).alias("context"))
    sorted_groups = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    found = written(sorted_groups.mapInArrow(lambda b: sort_contexts(b, size), FOUND))
    across = found.where("hash IS NOT NULL")
    shared = across.groupBy("hash").agg(F.min("place").alias("l"), F.max("place").alias("h")).where("l < h").select("hash")
    spans = full.join(names, "num").select("digest", "start", "stop").unionByName(found.where("hash IS NULL").select("digest", "start", "stop")).unionByName(across.join(shared, "hash", "left_semi").select("digest", "start", "stop"))
    if words:
        short = written(every.mapInArrow(lambda b: short_windows(b, words, size), SHORT))
        twice = short.groupBy("hash").count().where("count > 1").select("hash")
        spans = spans.unionByName(short.join(twice, "hash", "left_semi").select("digest", "start", "stop"))
    partly = spans.join(copied, "digest", "left_anti").groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("s"))
    return partly.select("digest", united("s").alias("spans")).unionByName(copied.select("digest", F.array("span").alias("spans")))


def inward(text: Column, spans: Column) -> Column:
    """Ranges that cut no UTF-8 character: a character partly inside stays whole outside."""
    inside = lambda at: F.hex(F.substring(text, at.cast("int") + 1, F.lit(1))).between("80", "BF")
    ahead = lambda at: at + F.when(~inside(at), 0).when(~inside(at + 1), 1).when(~inside(at + 2), 2).otherwise(3)
    back = lambda at: at - F.when(~inside(at), 0).when(~inside(at - 1), 1).when(~inside(at - 2), 2).otherwise(3)
    return F.transform(spans, lambda x: F.struct(ahead(x["start"]).alias("start"), back(x["stop"]).alias("stop")))


def remove_repeats(docs: DataFrame, *, text_col: str = "text", size: int = 400, words: int | None = None, whole_characters: bool = False) -> DataFrame:
    """The documents with all their columns, and as the last three: the text's bytes, the removed ranges, and what is left as bytes.

    These are named whole, spans and kept, lengthened where a column has that name.
    """
    whole, spans, kept, digest = unused(docs, "whole", "spans", "kept", "digest")
    found = find(docs, text_col=text_col, size=size, words=words).select(F.col("digest").alias(digest), F.col("spans").alias(spans))
    found = beside(found, found.agg(F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()[0])  # by the number of all spans
    out = docs.withColumn(whole, F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).withColumn(digest, F.unhex(F.md5(whole))).join(found, digest, "left")
    ranges = inward(F.col(whole), F.col(spans)) if whole_characters else F.col(spans)
    none = F.expr(f"cast(array() as {SPANS})")
    out = out.withColumn(spans, F.when(F.col(spans).isNull(), none).otherwise(ranges))
    ends = F.array_append(F.transform(spans, lambda x: x["start"]), F.octet_length(whole).cast("bigint"))
    begins = F.array_prepend(F.transform(spans, lambda x: x["stop"]), F.lit(0).cast("bigint"))
    pieces = F.zip_with(begins, ends, lambda a, z: F.struct(a.cast("int").alias("a"), (z - a).cast("int").alias("n")))
    left = F.aggregate(pieces, F.lit(b""), lambda acc, p: F.when(p["n"] > 0, F.concat(acc, F.substring(whole, p["a"] + 1, p["n"]))).otherwise(acc))
    return out.withColumn(kept, F.when(F.size(spans) == 0, F.col(whole)).otherwise(left)).select(*docs.columns, whole, spans, kept)
