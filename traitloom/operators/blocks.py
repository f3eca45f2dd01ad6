"""Rows against all rows, a block of rows at a time.

A block of at most `block` rows is broadcast, every task adds what it gives to
its own rows, and the sums so far are written before the next block.  So memory
holds a block and a batch whatever the number of rows; time is quadratic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import unused, written

#: Values of a block times values of a batch piece that are compared at a time.
PIECE = 256


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by differences, so that equal rows are at distance 0."""
    return np.sqrt(np.stack([((b - r) ** 2).sum(1) for r in a])) if len(a) else np.zeros((0, len(b)))


def against_all(df: DataFrame, key: str, columns: list[str], state: str, start, add: Callable, block: int = 8192) -> DataFrame:
    """The columns `key` and `columns` with `state` (an array of doubles), folded over blocks of all rows.

    start(n) gives the states of n rows; add(states, rows, others) their new states, with rows and others as dictionaries of arrays.
    """
    spark = df.sparkSession
    (part,) = unused(df, "block__")
    fields = [key, *columns]
    rows = written(df.select(*fields, F.lit(None).cast("array<double>").alias(state)))
    n = rows.count()
    blocks = max(1, -(-2 * n // block)) if n > block else 1
    source = rows.select(*fields, F.pmod(F.xxhash64(key), F.lit(blocks)).alias(part))
    schema = rows.schema
    arrays = lambda t: {c: matrix(t.column(c)) if pa.types.is_list(t.schema.field(c).type) else np.array(t.column(c).to_pylist()) for c in fields}
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(arrays(source.where(F.col(part) == k).select(*fields).toArrow()))

        def run(batches, shared=shared, first=k == 0):
            for b in batches:
                for i in range(0, b.num_rows, PIECE):
                    piece = b.slice(i, PIECE)
                    own = arrays(piece)
                    states = start(piece.num_rows) if first else [np.array(s) for s in piece.column(state).to_pylist()]
                    new = add(states, own, shared.value)
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in fields), pa.array([list(map(float, s)) for s in new], pa.list_(pa.float64()))], [*fields, state])

        rows = written(rows.mapInArrow(run, schema))
    return rows


def k_distances(df: DataFrame, key: str, k: int, block: int = 8192) -> DataFrame:
    """key, and the distance of each row of `features` to its k-th nearest row, itself included (null with fewer rows)."""

    def add(states, own, others):
        d = distances(own["features"], others["features"])
        return [np.sort(np.concatenate((s, r)))[:k] for s, r in zip(states, d, strict=True)]

    near = against_all(df, key, ["features"], "near__", lambda n: [np.zeros(0)] * n, add, block)
    return near.select(key, F.get("near__", k - 1).alias("distance"))
