"""Record processing, clustering, sources, project, models and streaming."""

import itertools
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom import schemas
from traitloom.functions import ids
from traitloom.operators import cluster, models, records
from traitloom.sources import images, project
from traitloom.sources import records as sources
from traitloom.streaming import ingest


def test_id_forms(spark):
    names = ["INAT-1-1.jpg", "INAT-1-2_mask.png", "OBS-7.jpg", "nodash", "a.jpg.png_segment.png"]
    df = spark.createDataFrame([(n,) for n in names], "name string").select(ids.image_id(F.col("name")).alias("i"))
    assert [r.i for r in df.collect()] == ["INAT-1-1", "INAT-1-2", "OBS-7", "nodash", "a"]
    got = spark.createDataFrame([("INAT-1-2",), ("OBS-7",), ("nodash",)], "i string").select(ids.observation_id(F.col("i")).alias("o"), ids.metric_observation_id(F.col("i")).alias("m"), ids.record_id(F.col("i")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("INAT-1", "INAT-1-2", "INAT-1"), ("OBS", "OBS-7", "OBS-7"), ("", "nodash", "nodash")]


def test_keep_first_and_null_groups(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    once = records.first_per_key(df, ["k"], ["o"])
    assert {(r.k, r.v) for r in once.collect()} == {("a", "y"), ("b", "z")}
    assert records.first_per_key(once, ["k"], ["o"]).exceptAll(once).count() == 0
    g = spark.createDataFrame([(i, None if i < 3 else "s") for i in range(9)], "id int, species string")
    assert records.sample_per_group(g, "species", 4, "id").count() == 4
    assert records.sample_per_group(g, "species", 99, "id").count() == 6


def test_outer_fill_by_type(spark):
    a = spark.createDataFrame([(1, 5)], "id int, n int")
    b = spark.createDataFrame([(2, "x")], "id int, s string")
    assert {tuple(r) for r in records.outer_filled(a, b, "id").collect()} == {(1, 5, "-1"), (2, -1, "x")}


def test_upsert_keeps_old_values(spark):
    old = spark.createDataFrame([("1", "a", "b"), ("2", "c", None)], "id string, p string, q string")
    new = spark.createDataFrame([("1", None, "z"), ("3", "n", None)], "id string, p string, q string")
    assert {tuple(r) for r in records.merged_codings(old, new, ["p", "q"]).collect()} == {("1", "a", "z"), ("2", "c", None), ("3", "n", None)}


def test_rank_sums(spark):
    lists = [[1, 2, 3, 4, 5, 6, 7], [7, 6, 5, 4, 3, 2, 1], [1, 7, 2, 6, 3, 5, 4]]
    df = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(zip(*lists, strict=True))], "n int, a double, b double, c double")
    best = cluster.rank_sums(df).orderBy("total", "n").first().n
    rank = lambda v: [1 + sum(x > y for x in v) for y in v]
    totals = [sum(t) for t in zip(*map(rank, lists), strict=True)]
    assert totals[best] == min(totals)


def vectors(spark, n=40):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.normal(5 * (i % 2), 0.3, 3)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, label int, features array<double>"), rows


def test_scores_match_numpy(spark):
    df, rows = vectors(spark)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        a = d[i, (y == y[i])].sum() / ((y == y[i]).sum() - 1)
        b = d[i, y != y[i]].mean()
        s.append((b - a) / max(a, b))
    got = {r.id: r.silhouette for r in cluster.silhouette(df, "id").collect()}
    assert np.allclose([got[i] for i in range(len(x))], s)
    m = [x[y == k].mean(0) for k in (0, 1)]
    w = sum(((x[y == k] - m[k]) ** 2).sum() for k in (0, 1))
    b = sum((y == k).sum() * ((m[k] - x.mean(0)) ** 2).sum() for k in (0, 1))
    assert cluster.calinski_harabasz(df).first().ch == pytest.approx(b * (len(x) - 2) / w)


def test_fits_find_separate_groups(spark):
    df, rows = vectors(spark)
    for algorithm in ("kmeans", "bisecting_kmeans", "gaussian_mixture"):
        out, _ = cluster.fitted(df.drop("label"), algorithm, 2)
        pairs = {(r.label, rows[r.id][1]) for r in out.collect()}
        assert len(pairs) == 2
    assert cluster.find_n(df.drop("label"), 2, 4, "ch") == 2
    with pytest.raises(ValueError):
        cluster.find_n(df, 1, 3, "db")
    assert cluster.principal_components(df, 20, "id").select(F.size("features").alias("n")).first().n == 3


def test_tie_goes_to_the_least_key(spark):
    df = spark.createDataFrame([(2, "g", [0.0]), (1, "g", [2.0])], "id int, g string, features array<double>")
    assert cluster.exemplars(df, "g", "id").first().id == 1


def test_centroid_values_keep_group_sums(spark):
    df = spark.createDataFrame([(i, i % 3, float(i * i)) for i in range(20)], "id int, label int, v double")
    sums = lambda t: {r.label: pytest.approx(r.s) for r in t.groupBy("label").agg(F.sum("v").alias("s")).collect()}
    assert sums(cluster.centroid_values(df, ["v"])) == sums(df)


def test_largest_cluster_passes_small_groups(spark):
    df = spark.createDataFrame([("big", k) for k in (0, 0, 0, 1, 1, 2)] + [("small", 1), ("small", 2)], "s string, label int")
    got = sorted((r.s, r.label) for r in cluster.largest_cluster(df, "s").collect())
    assert got == [("big", 0)] * 3 + [("small", 1), ("small", 2)]


def test_archives_and_csv(spark, tmp_path):
    text = 'gbifID\tspecies\tnote\n1\tAeshna mixta\t"open quote\n2\tAeshna isoceles\tplain\n'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("occurrence.txt", text)
    (tmp_path / "occ.txt").write_text(text)
    (tmp_path / "m.xml").write_text('<eml packageId="10.15468/dl.x"><title/></eml>')
    want = [("1", '"open quote', None), ("2", "plain", None)]
    columns = ["gbifID", "note", "missing"]
    assert [tuple(r) for r in sources.archive_member(spark, str(tmp_path / "a.zip"), "occurrence.txt", columns).collect()] == want
    assert [tuple(r) for r in sources.unquoted_tsv(spark, str(tmp_path / "occ.txt"), columns).collect()] == want
    assert sources.archive_identifier(spark, str(tmp_path / "m.xml")).first().package_id == "10.15468/dl.x"
    (tmp_path / "e.csv").write_text("image_name,0,1,other\nINAT-1-1.png,0.5,x,7\n")
    e = sources.encodings(spark, str(tmp_path / "e.csv")).first()
    assert (e.img_id, list(e.features)) == ("INAT-1-1", [0.5, None])


def test_pages_of_observations(spark):
    one = {"id": 5, "user": {"id": 9}, "observed_on": "2020-01-02", "location": "1.5,2.5", "taxon": {"name": "Aeshna mixta"}, "license_code": None, "photos": [{"url": "http://x/square.jpg"}], "annotations": [{"controlled_attribute_id": 1, "controlled_value_id": 2}], "tags": ["a", "b"]}
    body = json.dumps({"results": [one, one, {**one, "id": 6, "location": None}]})
    raw = sources.observations_of_pages(spark.createDataFrame([(body,)], "body string"))
    rows = {r.obs_id: r for r in records.rebuilt_records(raw).collect()}
    assert set(rows) == {"INAT-5", "INAT-6"} and rows["INAT-6"].latitude is None
    r = rows["INAT-5"]
    assert (r.img_id, r.genus, r.latitude, r.img_url, r.annotations) == ("INAT-5-1", "Aeshna", 1.5, "http://x/medium.jpg", ["1:2"])


def test_intervals_cover_without_gaps():
    from datetime import datetime, timedelta

    start = datetime(2008, 1, 1)
    at = [start + timedelta(hours=h * h) for h in range(100)]
    parts = list(sources.split_intervals(lambda a, z: sum(a <= t < z for t in at), start, start + timedelta(days=500), 10))
    assert parts[0][0] == start and all(x[1] == y[0] for x, y in itertools.pairwise(parts))


def test_downloads_report_errors(spark):
    df = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "")], "key string, img_url string")

    def fetch(url):
        if url == "bad":
            raise OSError("no route")
        return url.encode()

    got = {r.key: (r.ok, r.reason) for r in sources.downloaded(df, fetch, 2).collect()}
    assert got == {"a": (True, None), "b": (False, "OSError: no route"), "c": (False, "empty")}


def test_png_round_trip_and_pixels(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (3, 4, 3))
    px = spark.createDataFrame([("INAT-1-1", y, x, *map(int, a[y, x])) for y in range(3) for x in range(4)], "img_id string, y int, x int, r int, g int, b int")
    blob = images.encoded(px, "segment").first()
    assert blob.name == "INAT-1-1_segment.png"
    (tmp_path / blob.name).write_bytes(blob.content)
    got = images.pixels(images.image_files(spark, str(tmp_path)))
    assert got.select("img_id", "y", "x", "r", "g", "b").exceptAll(px).count() == 0 and got.count() == 12
    assert images.ids_in_folder(spark, str(tmp_path)).first().stage == "segment"


def test_project_stages(spark, tmp_path):
    p = project.Project(spark, str(tmp_path / "p")).create()
    blobs = spark.createDataFrame([("a-1.jpg", bytearray(b"1")), ("b-1.jpg", bytearray(b"2")), ("a-1_mask.png", bytearray(b"3"))], "name string, content binary")
    images.write_blobs(blobs, p.path("blobs"))
    assert {r.img_id for r in p.ids_to_mask().collect()} == {"b-1"}
    p.note_failed(spark.createDataFrame([("b-1",)], "img_id string"))
    assert p.ids_to_mask().count() == 0
    report = {r.img_id: r.deleted for r in p.delete(spark.createDataFrame([("a-1",), ("zz",)], "img_id string"), "mask").collect()}
    assert report == {"a-1": True, "zz": False}
    assert {r.stage for r in p.status().collect()} == {"image"}


def test_model_slots(spark):
    df = spark.createDataFrame([("a", bytearray(b"xx")), ("b", bytearray(b""))], "img_id string, data binary")
    got = {r.img_id: r.features for r in models.features(df, lambda: lambda batch: [[float(len(b))] if b else None for b in batch]).collect()}
    assert got == {"a": [2.0], "b": None}
    m = {r.img_id: (r.ok, r.reason) for r in models.masks(df, lambda: lambda batch: [bytes(batch[0])[:1] or None]).collect()}
    assert m == {"a": (True, None), "b": (False, "no detection")}


def test_repeated_ingestion_adds_nothing(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("obs_id,v\n1,x\n1,y\n2,z\n")
    run = lambda n: ingest.take_new(ingest.arriving(spark, str(folder), "obs_id string, v string"), target, str(tmp_path / f"c{n}")).awaitTermination()
    run(1)
    (folder / "b.csv").write_text("obs_id,v\n2,q\n3,r\n")
    run(1)
    run(2)  # a lost checkpoint reads all again
    assert sorted(r.obs_id for r in spark.read.parquet(target).collect()) == ["1", "2", "3"]
    assert len(schemas.DARWIN_CORE) == 33
