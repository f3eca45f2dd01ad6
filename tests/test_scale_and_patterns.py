"""Numbering and ranks on large tables, blocks of all pairs, mixtures, patterns, prompts, sinks."""

import itertools
import json
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import blocks, cluster, kernels, masks, metrics, patterns, records
from traitloom.sources import images, project
from traitloom.sources import records as sources

ROWS = 5_000_000


@pytest.fixture(scope="module")
def wide(spark):
    """Five million rows, in no order, with columns beside the key."""
    key = F.xxhash64("id")
    return spark.range(ROWS).select(key.alias("key"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("payload"), (F.col("id") % 97).alias("place__"))


def test_numbering_a_large_wide_table(wide):
    out = metrics.numbered(wide, ["key"], "k")
    assert out.columns == [*wide.columns, "k"]
    r = out.agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.countDistinct("k").alias("d")).first()
    assert (r.n, r.lo, r.hi, r.d) == (ROWS, 1, ROWS, ROWS)
    step = out.select("k", "key").withColumn("b", F.floor(F.col("k") / 100_000)).groupBy("b").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in itertools.pairwise(step))


def test_chunks_and_split_of_a_large_wide_table(wide):
    sizes = records.chunked(wide, ["key"], 1000).groupBy("chunk").count().agg(F.count("*").alias("n"), F.max("chunk").alias("hi"), F.min("count").alias("lo")).first()
    assert (sizes.n, sizes.hi, sizes.lo) == (ROWS // 1000, ROWS // 1000 - 1, 1000)
    parts = {r.part: r["count"] for r in records.split_train_test(wide, "key", 0.2).groupBy("part").count().collect()}
    assert parts == {"Train": ROWS * 4 // 5, "Test": ROWS // 5}


def test_auroc_of_many_scores(spark):
    n = ROWS
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / float(1 << 52)).alias("score"), "id")
    df = df.select("score", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100)) < F.col("score") * 60 + 20).cast("int").alias("label"), F.lit("x").alias("more"))
    t = df.select("score", "label").toArrow()
    s, y = t.column("score").to_numpy(), t.column("label").to_numpy()
    rank = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1.0  # scores are distinct
    want = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (n - y.sum()))
    assert len(np.unique(s)) == n and records.auroc(df).first().auroc == pytest.approx(want, abs=1e-9)


def test_silhouette_is_the_same_in_blocks(spark):
    rng = np.random.default_rng(1)
    x, label = rng.normal(size=(90, 3)), rng.integers(0, 4, 90)
    label[label == 3] = 2
    label[7] = 9
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "id bigint, features array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for i in range(90):
        a = d[i][label == label[i]].sum() / max(1, (label == label[i]).sum() - 1)
        b = min(d[i][label == k].mean() for k in set(label.tolist()) - {label[i]})
        want[i] = 0.0 if (label == label[i]).sum() == 1 else (b - a) / max(a, b)
    for block in (8192, 20):
        got = {r.id: r.silhouette for r in cluster.silhouette(df, "id", block).collect()}
        assert got == pytest.approx(want)
        near = {r.id: r.distance for r in blocks.k_distances(df, "id", 4, block).collect()}
        assert near == pytest.approx({i: np.sort(d[i])[3] for i in range(90)})
    curve = np.sort([np.sort(d[i])[3] for i in range(90)]).tolist()
    assert cluster.knee_radius(df, "id").first().eps == pytest.approx(cluster.knee(curve))


def test_mixture_regularises_its_covariances(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal([0, 0], [1, 0.3], (300, 2)), rng.normal([6, 5], [0.5, 1], (200, 2))])
    x = np.concatenate((x, np.full((len(x), 1), 4.0)), axis=1)  # a constant column has no variance of its own
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    out, model = cluster.fitted(df, "gaussian_mixture", 2, reg=1e-3)
    rows = out.orderBy("id").collect()
    label = np.array([r.label for r in rows])
    assert len(set(label[:300])) == 1 and len(set(label[300:])) == 1 and label[0] != label[-1]
    assert np.allclose([sum(r.probability) for r in rows], 1) and np.allclose(model.covariances[:, 2, 2], 1e-3)
    first = model.weights[label[0]], model.means[label[0]]
    assert first[0] == pytest.approx(0.6, abs=1e-3) and np.allclose(first[1], x[:300].mean(0), atol=1e-2)
    with pytest.raises(ValueError):
        cluster.fitted(df, "agglomerative", 2)


def ward_by_all_pairs(x, n):
    groups = [[i] for i in range(len(x))]
    while len(groups) > n:
        cost = {(a, b): len(g) * len(h) / (len(g) + len(h)) * ((x[g].mean(0) - x[h].mean(0)) ** 2).sum() for (a, g), (b, h) in itertools.combinations(enumerate(groups), 2)}
        a, b = min(cost, key=cost.get)
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_linkage_and_density_match_all_pairs():
    rng = np.random.default_rng(3)
    for seed in range(5):
        x = rng.normal(size=(40, 2)) + rng.integers(0, 3, 40)[:, None] * 4
        got = kernels.agglomerative(x, 4)
        assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got.tolist())} == ward_by_all_pairs(x, 4)
        d = kernels.distances(x)
        label = kernels.dbscan(x, 0.9, 4)
        core = (d <= 0.9).sum(1) >= 4
        for i, j in itertools.combinations(np.flatnonzero(core), 2):
            assert d[i, j] > 0.9 or label[i] == label[j]
        assert all((label[i] == -1) == (not core[i] and not (core & (d[i] <= 0.9)).any()) for i in range(40))


def test_hdbscan_finds_dense_groups_of_different_density():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.6, (40, 2)), rng.uniform(-20, 25, (12, 2))])
    label = kernels.hdbscan(x)
    assert len(set(label[:40].tolist()) - {-1}) == 1 and len(set(label[40:80].tolist()) - {-1}) == 1
    assert (label[:40] >= 0).mean() > 0.9 and (label[40:80] >= 0).mean() > 0.8 and (label[80:] == -1).mean() >= 0.6
    assert set(label[:40].tolist()) - {-1} != set(label[40:80].tolist()) - {-1}
    assert kernels.hdbscan(x[:5]).tolist() == [-1] * 5
    assert kernels.largest_group(10**7, 64, "hdbscan") is False and kernels.largest_group(10**5, 64, "dbscan") and not kernels.largest_group(10**5, 64, "affinity")


def test_tsne_keeps_groups_apart():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(k * 8, 1, (25, 10)) for k in range(3)])
    y = kernels.tsne(x, perplexity=8)
    of = np.repeat(np.arange(3), 25)
    d = kernels.distances(y)
    np.fill_diagonal(d, np.inf)
    assert (of[d.argmin(1)] == of).mean() > 0.95


def relation(spark, arrays):
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "img_id bigint, y bigint, x bigint, r bigint, g bigint, b bigint")


@pytest.mark.parametrize("how", ["individually", "group", "together"])
def test_patterns_take_the_mean_of_their_cluster(spark, how):
    rng = np.random.default_rng(6)
    arrays = {k: np.array([[20, 20, 20], [200, 30, 30], [30, 200, 40]])[rng.integers(0, 3, (6, 6))] + rng.integers(0, 6, (6, 6, 3)) + 10 * (k % 2) for k in range(4)}
    arrays[2][0, :3] = 0
    px = relation(spark, arrays)
    groups = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "img_id bigint, group string")
    options = {"individually": {"individually": True}, "group": {"groups": groups}, "together": {}}[how]
    got = {(r.img_id, r.y, r.x): (r.r, r.g, r.b) for r in patterns.patterns(px, 3, **options).collect()}
    scope = {"individually": lambda k: k, "group": lambda k: {0: "a", 2: "a", 1: "b", 3: ""}[k], "together": lambda k: 0}[how]
    assert len(got) == 144 and all(got[2, 0, x] == (0, 0, 0) for x in range(3))
    members = {}
    for (k, y, x), c in got.items():
        if arrays[k][y, x].any():
            members.setdefault((scope(k), c), []).append(arrays[k][y, x])
    for (_, c), pixels in members.items():
        assert np.abs(np.mean(pixels, axis=0) - c).max() <= 0.5 + 1e-9
    assert max(sum(1 for s, _ in members if s == scope(k)) for k in arrays) <= 3


def test_two_stages_end_with_few_colours(spark):
    rng = np.random.default_rng(7)
    px = relation(spark, {k: rng.integers(1, 255, (8, 8, 3)) for k in range(5)})
    assert patterns.two_stage_patterns(px, 4, 3).select("r", "g", "b").distinct().count() <= 3


def test_suppression_matches_a_loop(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k % 6), int(k), float(rng.integers(0, 9)), *[float(v) for v in (a, b, a + w, b + h)]) for k, (a, b, w, h) in enumerate(rng.integers(1, 12, (60, 4)))]
    got = {(r.img_id, r.box_id) for r in masks.boxes_kept(spark.createDataFrame(rows, "img_id bigint, box_id bigint, score double, x0 double, y0 double, x1 double, y1 double"), 0.3).collect()}
    want = set()
    for img in range(6):
        kept = []
        for r in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[2], r[1])):
            inside = lambda s, r=r: max(0, min(r[5], s[5]) - max(r[3], s[3])) * max(0, min(r[6], s[6]) - max(r[4], s[4]))
            area = lambda s: (s[5] - s[3]) * (s[6] - s[4])
            if all(inside(s) / (area(r) + area(s) - inside(s)) <= 0.3 for s in kept):
                kept.append(r)
        want |= {(img, r[1]) for r in kept}
    assert got == want


def test_erosion_of_a_rectangle(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 255, (7, 9))
    df = spark.createDataFrame([(1, y, x, int(a[y, x])) for y in range(7) for x in range(9)], "img_id bigint, y bigint, x bigint, gray bigint")
    for size, lowest in itertools.product((2, 3, 5), (True, False)):
        got = {(r.y, r.x): r.gray for r in masks.neighbour_extreme(df, size, lowest).collect()}
        half = size // 2
        for y, x in itertools.product(range(7), range(9)):
            part = a[max(0, y - size + 1 + half) : y + half + 1, max(0, x - size + 1 + half) : x + half + 1]
            assert got[y, x] == (part.min() if lowest else part.max())


def test_longest_run_and_parts():
    m = np.zeros((12, 20), bool)
    m[5, 2:17] = True
    length, x0, y0, x1, y1 = kernels.longest_run(m)
    assert (length, sorted((x0, x1)), y0, y1) == (15.0, [2.0, 16.0], 5.0, 5.0)
    labels = np.full((6, 6), -1)
    labels[:2, :2] = 0
    labels[3:, 3:] = 0
    labels[0, 5] = 1
    assert np.unique(kernels.part_patches(labels, 2)).tolist() == [0, 1, 2]
    gray = np.full((30, 30), 200.0)
    gray[:, 15] = 20
    parts = kernels.edge_patches(gray)
    assert parts[5, 2] != parts[5, 28] and parts[5, 2] and parts[5, 28] and not parts[5, 15]


def test_gabor_texture_retinex_and_lines_by_hand():
    """Kernels on images whose answer is known: stripes, flat areas, symmetric shapes."""
    y, x = np.mgrid[0:48, 0:48]
    upright = (128 + 100 * np.sin(x * 2 * np.pi / 6))[..., None]
    flat = np.full((48, 48, 1), 90.0)
    one, other = kernels.gabor_means(upright), kernels.gabor_means(np.swapaxes(upright, 0, 1))
    keys = sorted(one)
    assert one[keys[0]] != pytest.approx(one[keys[1]], rel=0.2)
    assert one[keys[0]] == pytest.approx(other[keys[1]], rel=0.15)
    texture = kernels.texture_facts(flat)
    assert texture["rms_contrast"] == pytest.approx(0) and texture["edge_density"] == pytest.approx(0)
    assert kernels.texture_facts(upright)["rms_contrast"] > 0.1
    spot = np.zeros((30, 31, 1))
    spot[5:25, 10:21] = 200
    facts = kernels.line_metrics(spot)
    assert facts["overlap_sym"] == pytest.approx(max(0, facts["overlap_sym"])) and all(v is None or math.isfinite(v) for v in facts.values())


@pytest.mark.parametrize("strategy", ["ellipse", "polygon", "skeleton_hough"])
def test_blobs_are_turned_about_their_best_line(strategy):
    """A wedge that leans at 40 degrees ends upright, its heavy end on top."""
    y, x = np.mgrid[0:90, 0:90]
    t = np.deg2rad(40)
    along, off = (x - 45) * np.cos(t) + (y - 45) * np.sin(t), -(x - 45) * np.sin(t) + (y - 45) * np.cos(t)
    blob = np.where((np.abs(along) < 35) & (np.abs(off) < 7 + along / 8), 200.0, 0.0)[..., None]
    out = kernels.upright_by_lines(blob, strategy)[..., 0] > 0
    h, w = out.shape
    assert h > 60 and w < 34 and out[: h // 2].sum() > out[h // 2 :].sum()
    # directions are 6 degrees apart: 3 degrees off move a side of 14 pixels by 2 x 1.8 over half the length of 70; chords join corners
    assert strategy == "polygon" or (out & out[:, ::-1]).sum() / out.sum() > 0.74
    lines = kernels.candidate_lines(blob[..., 0] > 0, strategy)
    assert lines and min(abs((a - t + np.pi / 2) % np.pi - np.pi / 2) for a, _, _ in lines) < 0.15
    assert kernels.candidate_lines(np.zeros((5, 5), bool), strategy) == []


def test_kernels_on_image_rows_equal_those_on_pixels(spark):
    rng = np.random.default_rng(10)
    arrays = {k: rng.integers(0, 255, (9, 7, 3)).astype(np.uint8) for k in range(3)}
    rows = spark.createDataFrame([(k, 7, 9, 3, bytearray(np.ascontiguousarray(a[..., ::-1]).tobytes())) for k, a in arrays.items()], "img_id bigint, width int, height int, n_channels int, data binary")
    mean = lambda a: {"r": a[..., 0].mean(), "spread": a.std()}
    got = {r.img_id: (r.r, r.spread) for r in kernels.of_image_rows(rows, mean, ["r", "spread"]).collect()}
    same = {r.img_id: (r.r, r.spread) for r in kernels.facts_of(relation(spark, arrays), mean, ["r", "g", "b"], ["r", "spread"]).collect()}
    assert got.keys() == same.keys() and all(got[k] == pytest.approx(same[k]) for k in got) and got[1][0] == pytest.approx(arrays[1][..., 0].mean())


def test_tiff_to_png(spark):
    a = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    for order, packed in (("<", False), (">", True)):
        data = zlib.compress(a.tobytes()) if packed else a.tobytes()
        tags = [(256, 4, 1, 6), (257, 4, 1, 4), (258, 3, 1, 8), (259, 3, 1, 8 if packed else 1), (273, 4, 1, 8 + 2 + 12 * 8 + 4), (277, 3, 1, 3), (279, 4, 1, len(data)), (284, 3, 1, 1)]
        body = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags))
        for tag, kind, n, value in tags:
            body += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        body += struct.pack(order + "I", 0) + data
        assert np.array_equal(images.tiff(body), a)
        files = spark.createDataFrame([("/x/one.tif", bytearray(body)), ("/x/bad.tif", bytearray(b"II*"))], "path string, content binary")
        got = images.tiffs_to_png(files, 2).collect()
        assert [r.name for r in got] == ["one.png"] and bytes(got[0].data)[:8] == b"\x89PNG\r\n\x1a\n"
        raw = zlib.decompress(bytes(got[0].data)[41 : 41 + struct.unpack(">I", bytes(got[0].data)[33:37])[0]])
        small = a.reshape(2, 2, 3, 2, 3).mean(axis=(1, 3)).round().astype(np.uint8)
        assert raw == b"".join(b"\0" + small[k].tobytes() for k in range(2))


def test_pixels_of_image_rows(spark):
    a = np.arange(2 * 3 * 4, dtype=np.uint8)
    rows = [("i", 3, 2, 4, bytearray(a.tobytes())), ("g", 2, 1, 1, bytearray(b"\x07\x09"))]
    got = {(r.img_id, r.y, r.x): (r.r, r.g, r.b, r.alpha) for r in images.pixels(spark.createDataFrame(rows, "img_id string, width int, height int, n_channels int, data binary")).collect()}
    bgra = a.reshape(2, 3, 4)
    assert got == {("i", y, x): tuple(map(int, bgra[y, x][[2, 1, 0, 3]])) for y in range(2) for x in range(3)} | {("g", 0, 0): (7, 7, 7, None), ("g", 0, 1): (9, 9, 9, None)}


def test_folders_are_zipped_and_cleared(spark, tmp_path):
    d = tmp_path / "tree"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("one")
    (d / "sub" / "b.bin").write_bytes(b"\0" * 100_000)
    assert project.zip_folder(spark, str(d), str(tmp_path / "out.zip")) == 2
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert sorted(z.namelist()) == ["a.txt", "sub/b.bin"] and z.read("a.txt") == b"one"
    assert project.clear_folder(spark, str(d)) == 0 and (d / "a.txt").exists()
    assert project.clear_folder(spark, str(d), confirmed=True) == 2 and d.exists() and not list(d.iterdir())


def test_pages_are_fetched_with_retries(spark, tmp_path):
    marks = str(tmp_path)

    def fetch(params):
        from pathlib import Path

        if params["per_page"] == 0:
            return json.dumps({"total_results": 5})
        mark = Path(marks, f"tried{params['page']}")
        if params["page"] == 2 and not mark.exists():
            mark.touch()
            raise OSError("busy")
        if params["page"] == 3:
            raise OSError("gone")
        return json.dumps({"results": [{"id": params["page"] * 10}]})

    got = {r.page: (r.body, r.reason) for r in sources.observation_pages(spark, fetch, {"q": 1}, per_page=2, retries=2, pause=0).collect()}
    assert got[1][0] and got[2][0] and got[2][1] is None and got[3] == (None, "OSError: gone")
    assert sources.total_records(fetch, {}) == 5 and sources.total_records(lambda p: "no json", {}) == 0


def test_rest_imports_without_the_optional_subpackage(tmp_path):
    """With the subpackage and the pipeline out of sight the contract still answers, with the other queries only."""
    import os
    import subprocess
    import sys

    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("traitloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert len(q) > 100 and set(s) <= set(q) and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in q)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
