"""Approximate nearest neighbours by an adaptive dimension scan.

Unit vectors are turned by one random rotation, so that a few leading columns
estimate a whole distance, and are dealt into inverted lists by the nearest of
some centroids.  Within each probed list, partial distances grow column block
by column block; after each block a hypothesis test abandons the candidates
whose estimate lies too far above the query's k-th distance so far
(`eps` is the test's width in standard deviations).  What survives is scored by
its cosine in double precision on the original vectors.  Blocks are matrix
products while many candidates are left, and single rows once few are.

Centroids are fitted on about `sample` rows, chosen by a hash of the vector; every
row is indexed.  The index is one table in the order of its lists, so a list may
hold any share of all rows: tasks read stretches of it, each with the queries that
probe its lists.  Queries are broadcast in blocks of at most `block_queries`, with
the nearest rows of their lists among the first `SEEDS` of the sample, so that a
k-th distance is known from the start; a task sends on what is nearer.
Of equal vectors in a stretch only the k + 1 least ids are compared, as ties go to
smaller ids.

Vectors without structure have neighbours in many lists: there the share of lists
that must be probed for a recall is the same at any size, so the work grows with
queries times rows.

Defined cases: ids must be integers; vectors that are null, zero, or hold null or
non-finite components take no part, neither as queries nor as candidates; vectors
of different lengths are never compared; ties go to the smaller id; rows that
repeat an id and vector count once, and an id with several vectors takes one place
with its best score; fewer than k candidates are all returned; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import written

#: Rows of a list that are compared at a time.
CHUNK = 1024
#: Rows of the sample that queries are compared with first.
SEEDS = 4096
#: Pairs whose exact score is computed at a time.
PAIRS = 1 << 16


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0].astype(np.float32)


def centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 23) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c.astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def column_blocks(dim: int, step: int) -> list[tuple[int, int]]:
    return [(a, min(a + step, dim)) for a in range(0, dim, step)]


def adaptive_scan(q: np.ndarray, v: np.ndarray, limit: np.ndarray, *, eps: float = 2.1, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of rotated unit rows whose squared distance is at most the query's limit, but for pairs that a test abandons."""
    dim = q.shape[1]
    near = np.zeros((len(q), len(v)), np.float32)
    qi = vi = d = None
    for a, z in column_blocks(dim, step):
        bound = (limit if z == dim else limit * ((z / dim) * (1 + eps / math.sqrt(z)) ** 2)) + 1e-5
        if d is None:
            near += (q[:, a:z] ** 2).sum(1)[:, None] + (v[:, a:z] ** 2).sum(1) - 2 * (q[:, a:z] @ v[:, a:z].T)
            alive = near <= bound[:, None]
            if z == dim or np.count_nonzero(alive) < alive.size / 16:
                qi, vi = np.nonzero(alive)
                d = near[qi, vi]
        else:
            d = d + ((q[qi, a:z] - v[vi, a:z]) ** 2).sum(1)
            keep = d <= bound[qi]
            qi, vi, d = qi[keep], vi[keep], d[keep]
    return qi, vi


class Nearest:
    """The k nearest rows of each query so far."""

    def __init__(self, q: np.ndarray, turned: np.ndarray, ids: np.ndarray, score: np.ndarray, near: np.ndarray):
        """score, near: scores and ids of rows known from the start, best first; -inf where there is none."""
        self.q, self.turned, self.ids, self.k = q, turned, ids, score.shape[1]
        self.score, self.id = score.copy(), near.copy()
        self.limit = self.limits(np.arange(len(q)))

    def limits(self, some: np.ndarray) -> np.ndarray:
        """Squared distances of the k-th rows."""
        last = self.score[some, -1]
        return np.where(last > -np.inf, 2 - 2 * last, np.inf).astype(np.float32)

    def add(self, of: np.ndarray, v: np.ndarray, turned: np.ndarray, ids: np.ndarray, eps: float) -> None:
        """Compares the queries `of` with some rows."""
        qi, vi = adaptive_scan(self.turned[of], turned, self.limit[of], eps=eps)
        qi = of[qi]
        other = self.ids[qi] != ids[vi]
        qi, vi = qi[other], vi[other]
        if not len(qi):
            return
        s = np.concatenate([cosine(self.q[qi[i : i + PAIRS]], v[vi[i : i + PAIRS]]) for i in range(0, len(qi), PAIRS)])
        last = self.score[qi, -1]
        better = (s > last) | ((s == last) & (ids[vi] < self.id[qi, -1]))
        if not better.any():
            return
        qi, s, new = qi[better], s[better], ids[vi[better]]
        some = np.unique(qi)
        qi = np.concatenate((qi, np.repeat(some, self.k)))
        s = np.concatenate((s, self.score[some].ravel()))
        new = np.concatenate((new, self.id[some].ravel()))
        order = np.lexsort((-s, new, qi))  # an id takes one place, with its best score
        qi, s, new = qi[order], s[order], new[order]
        first = np.concatenate(([True], (qi[1:] != qi[:-1]) | (new[1:] != new[:-1]))) | (s == -np.inf)
        qi, s, new = qi[first], s[first], new[first]
        order = np.lexsort((new, -s, qi))
        qi, s, new = qi[order], s[order], new[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = rank < self.k
        self.score[qi[top], rank[top]] = s[top]
        self.id[qi[top], rank[top]] = new[top]
        self.limit[some] = self.limits(some)


def fewest(values: list[bytes], ids: np.ndarray, most: int) -> np.ndarray:
    """Rows to compare of a stretch in the order of values and ids: the first `most` distinct ids of each value."""
    n = len(values)
    same = np.fromiter((i > 0 and values[i] == values[i - 1] for i in range(n)), bool, n)
    again = same & np.concatenate(([False], ids[1:] == ids[:-1]))
    distinct = np.cumsum(~again)
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    return np.flatnonzero(~again & (distinct - distinct[start] < most))


def search(vectors: DataFrame, is_query, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, probe_share: float = 0.4, eps: float = 2.1, block_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row for which `is_query` (of column vec_id) holds."""
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer")
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), value.alias("v")).where(fine & F.col("vec_id").isNotNull())
    id_type = rows.schema["vec_id"].dataType.simpleString()
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # a row a length
    found = [part for r in sizes for part in near_rows(rows.where(F.size("v") == r.d), r.d, r.n, is_query, k, sample, probe_share, eps, block_queries)]
    if not found:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    best = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select(F.col("query_id").cast(id_type), "rank", F.col("vec_id").cast(id_type), "score")


def near_rows(rows: DataFrame, dim: int, n: int, is_query, k: int, sample: int, probe_share: float, eps: float, block_queries: int) -> list[DataFrame]:
    """query_id, vec_id, score of the nearest rows in each stretch of an index over vectors of one length; one table a block of queries."""
    spark = rows.sparkSession
    turn = rotation(dim)
    key = F.xxhash64("v")
    picked = rows.where(F.pmod(key, F.lit(1 << 30)) / float(1 << 30) < min(1.0, sample / n)).groupBy("v").agg(F.min("vec_id").alias("vec_id")).toArrow()
    if not picked.num_rows:  # few rows, none of them chosen
        picked = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy("vec_id").limit(sample).toArrow()
    known_ids = picked.column("vec_id").to_numpy().astype(np.int64)
    order = np.argsort(known_ids)
    known_ids, known = known_ids[order], np.array(picked.column("v").to_pylist(), np.float64)[order]
    fitted = unit(known).astype(np.float32)
    c = centroids(fitted, max(1, min(round(6 * math.sqrt(n)), len(fitted) // 8)))
    shared = spark.sparkContext.broadcast(c)
    seed_lists = (fitted[:SEEDS] @ c.T).argmax(axis=1)

    def dealt(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, dim)
                of = (unit(x).astype(np.float32) @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), b.column("vec_id").cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["list", "vec_id", "v"])

    in_lists = rows.mapInArrow(dealt, "list int, vec_id bigint, v binary")
    index = written(in_lists.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "v", "vec_id"))
    held = np.zeros(len(c), np.int64)
    for r in index.groupBy("list").count().collect():
        held[r.list] = r["count"]
    asked = index.where(is_query).select("vec_id", "v").distinct()
    blocks = -(-asked.count() // block_queries)
    asked = written(asked) if blocks > 1 else asked
    out = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block).toArrow()
        if not mine.num_rows:
            continue
        q, ids = rows_of(mine.column("v").to_pylist(), dim), mine.column("vec_id").to_numpy()
        u = unit(q).astype(np.float32)
        # the nearest lists, and more where these hold few rows
        order = np.argsort(-(u @ c.T), axis=1)
        before = np.cumsum(held[order], axis=1) - held[order]
        probed = np.zeros((len(u), len(c)), bool)
        probed[np.arange(len(u))[:, None], order] = (np.arange(len(c)) < max(1, math.ceil(probe_share * len(c)))) | (before < 64 * k)
        near = u @ fitted[:SEEDS].T
        near[~probed[:, seed_lists] | (ids[:, None] == known_ids[:SEEDS])] = -np.inf
        seeds = np.argsort(-near, axis=1, kind="stable")[:, :k]
        score, near_ids = np.full((len(u), k), -np.inf), np.zeros((len(u), k), np.int64)
        for r in range(seeds.shape[1]):
            some = np.flatnonzero(near[np.arange(len(u)), seeds[:, r]] > -np.inf)
            score[some, r], near_ids[some, r] = cosine(q[some], known[seeds[some, r]]), known_ids[seeds[some, r]]
        order = np.lexsort((near_ids, -score))
        score, near_ids = np.take_along_axis(score, order, 1), np.take_along_axis(near_ids, order, 1)
        qi, rank = np.nonzero(score > -np.inf)
        known_pairs = pa.table({"query_id": ids[qi], "vec_id": near_ids[qi, rank], "score": score[qi, rank]})
        if known_pairs.num_rows:
            out.append(spark.createDataFrame(known_pairs.to_pandas()))
        asks = spark.sparkContext.broadcast((q, u @ turn, ids, score, near_ids, np.packbits(probed, axis=1)))
        found = index.mapInArrow(scan(asks, turn, len(c), dim, eps), "query_id bigint, vec_id bigint, score double")
        out.append(written(found) if blocks > 1 else found)
    return out


def scan(asks, turn: np.ndarray, lists: int, dim: int, eps: float):
    """Compares stretches of an index with the queries that probe their lists."""

    def run(batches):
        q, turned, ids, score, near, packed = asks.value
        probed = np.unpackbits(packed, axis=1, count=lists).astype(bool).T.copy()
        best = Nearest(q, turned, ids, score, near)
        for b in batches:
            if not b.num_rows:
                continue
            of, row_ids, values = b.column("list").to_numpy(), b.column("vec_id").to_numpy(), b.column("v").to_pylist()
            keep = fewest(values, row_ids, best.k + 1)
            of, row_ids, v = of[keep], row_ids[keep], rows_of([values[i] for i in keep.tolist()], dim)
            flat = unit(v).astype(np.float32) @ turn
            edges = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                asking = np.flatnonzero(probed[of[i]])
                for a in range(i, j, CHUNK) if len(asking) else ():
                    z = min(a + CHUNK, j)
                    best.add(asking, v[a:z], flat[a:z], row_ids[a:z], eps)
        seeded = (best.id[:, :, None] == near[:, None]) & (best.score[:, :, None] == score[:, None])
        qi, rank = np.nonzero((best.score > -np.inf) & ~seeded.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(best.id[qi, rank]), pa.array(best.score[qi, rank])], ["query_id", "vec_id", "score"])

    return run
