"""Findings of the second round: each test fails on the code before."""

import duckdb
import numpy as np
import pytest

from traitloom.operators import kernels
from traitloom.plans.catalog import ORACLE_SQL, QUERIES


def test_equal_lines_are_pooled_as_in_the_sql(spark, tmp_path):
    """Lines off the edges, on an edge and outside, standing one, two and three times; one has no order."""
    lines = [(k, p, s, q) for k, (p, s, q) in enumerate([(24, 2, 2.0), (12 * 5 + 3, 1, 1.0), (0, 0, 0.0), (12 * 4 + 5, 9, 9.0)])]
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT k * 10 + n AS l_orderkey, 1::INT AS l_linenumber, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, q::DOUBLE AS l_quantity FROM (VALUES " + ", ".join(map(str, lines)) + ") v(k, p, s, q), range(1, 4) r(n), range(n) c(copy)")
    con.execute("CREATE TABLE orders AS SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey <> 11")
    for t in ("lineitem", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = QUERIES["lines_inside"](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL["lines_inside"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.count() > 0


@pytest.mark.parametrize(
    ("name", "small"),
    [
        ("flip_heavy", 0), ("mask_by_points", 0), ("masks_not_inside", 0), ("reconstruct", 0), ("bound_box", 0), ("patterns_individual", 0), ("patterns_two_stage", 3),
        ("raw_segment", 0), ("resize_height", 0), ("avg_image_two_level", 0), ("pad_to_size", 0), ("equalize", 0),
    ],
)
def test_pixels_are_not_sent_to_the_driver(spark, tmp_path, name, small):
    """No table of pixels is broadcast, however small Spark takes it for; the groups of two-stage patterns, a table of their own, are read thrice."""
    duckdb.sql(f"COPY (SELECT range::BIGINT AS p_partkey, 'b' || range % 3 AS p_brand, 't' || range % 2 AS p_type FROM range(1, 30)) TO '{tmp_path}/part.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= small


def test_groups_of_many_rows_go_block_by_block(monkeypatch):
    """Pairs in a temporary file, a few rows at a time, give what pairs in memory give; 13,080 rows, a group at 60 times sf0.1, are not refused."""
    assert kernels.largest_group(13_080, 64, "affinity") and kernels.largest_group(13_080, 64, "tsne")
    x = np.random.default_rng(3).normal(0, 1, (61, 5)) + np.arange(61)[:, None] % 3 * 6
    whole = kernels.affinity(x), kernels.tsne(x, perplexity=8, rounds=20), kernels.median_square(x)
    monkeypatch.setattr(kernels, "BLOCK_BYTES", 8 * 61 * 4)
    monkeypatch.setattr(kernels, "HELD_BYTES", 0)
    assert len(kernels.row_blocks(61)) == 16
    assert (kernels.affinity(x) == whole[0]).all() and np.allclose(kernels.tsne(x, perplexity=8, rounds=20), whole[1]) and np.isclose(kernels.median_square(x), whole[2])
    assert np.isclose(whole[2], np.median(kernels.distances(x) ** 2))
