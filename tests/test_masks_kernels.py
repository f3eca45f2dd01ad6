"""Filters on small masks, and kernels against brute-force versions."""

import numpy as np
import pandas as pd
import pytest

from traitloom.operators import kernels, masks


def gray_table(spark, images):
    return spark.createDataFrame([(k, y, x, int(v)) for k, a in images.items() for (y, x), v in np.ndenumerate(np.array(a))], "img_id string, y long, x long, gray long")


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.img_id, {})[r.y, r.x] = r.gray
    return out


def test_filter_chain_names_the_first_failure(spark):
    z = np.zeros((5, 5), int)
    dot, edge, full, tall = z.copy(), z.copy(), z + 255, z.copy()
    dot[2, 2], edge[0, 2:4], edge[1, 2] = 255, 255, 255
    tall[1:4, 2] = 255
    g = gray_table(spark, {"empty": z, "dot": dot, "edge": edge, "full": full, "tall": tall})
    got = {r.img_id: r.reason for r in masks.filter_reasons(g, (0.1, 0.9), (0.4, 2.0)).collect()}
    assert got == {"empty": "empty", "dot": "prop", "edge": "edge", "full": "prop", "tall": "hw"}


def test_erosion_and_dilation_match_brute_force(spark):
    a = np.random.default_rng(1).integers(0, 256, (6, 7))
    g = gray_table(spark, {"a": a})
    for lowest, f in ((True, np.min), (False, np.max)):
        got = back(masks.neighbour_extreme(g, 3, lowest))["a"]
        assert all(got[y, x] == f(a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]) for y in range(6) for x in range(7))


def test_bounding_padding_and_flip(spark):
    a = np.zeros((4, 4), int)
    a[3, 1:3] = 9
    g = gray_table(spark, {"a": a})
    assert back(masks.bounded(g))["a"] == {(0, 0): 9, (0, 1): 9}
    assert back(masks.heavy_side_up(g))["a"][0, 1] == 9
    assert len(back(masks.padded(g, 6, 8))["a"]) == 48
    assert masks.padded(g, 3, 8).count() == 0


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for s in map(tuple, np.argwhere(mask)):
        if label[s]:
            continue
        n += 1
        todo = [s]
        label[s] = n
        while todo:
            y, x = todo.pop()
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not label[q]:
                    label[q] = n
                    todo.append(q)
    return label


def test_components_match_flood_fill():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m = rng.random((9, 11)) < 0.4
        assert np.array_equal(kernels.components(m), flood(m))


def test_shape_of_a_square_and_holes():
    a = np.zeros((8, 8, 1))
    a[2:6, 2:6] = 255
    f = kernels.shape_facts(a)
    assert f["area"] == 16 and f["solidity"] == pytest.approx(1) and f["length_width_ratio"] == pytest.approx(1) and f["circularity"] == pytest.approx(4 * np.pi * 16 / 12**2)
    a[3, 3] = 0
    assert kernels.filled(a[..., 0] > 0).sum() == 16
    assert kernels.shape_facts(np.zeros((3, 3, 1))) == {}


def test_largest_part_removes_islands():
    a = np.zeros((6, 9, 1))
    a[1:5, 1:5], a[2, 7] = 255, 255
    assert kernels.largest_part(a).sum() == 16 * 255


def test_blurs_keep_constants_and_medians_are_exact():
    a = np.full((7, 7, 1), 50.0)
    for f in (kernels.gaussian, kernels.median, kernels.bilateral):
        assert np.allclose(f(a), 50)
    b = np.random.default_rng(4).integers(0, 256, (6, 6, 1)).astype(float)
    assert kernels.median(b, 3)[2, 3, 0] == np.median(b[1:4, 2:5, 0])


def test_resize_match_and_clahe():
    a = np.arange(16.0).reshape(4, 4, 1)
    assert np.allclose(kernels.resized(a, 4, 4), a) and kernels.resized_by(a, share=0.5).shape == (2, 2, 1)
    c = np.random.default_rng(5).integers(0, 256, (20, 20))
    assert np.abs(kernels.matched(c, np.bincount(c.ravel(), minlength=256)) - c).max() <= 1
    out = kernels.clahe(c[..., None].astype(float))
    assert out.min() >= 0 and out.max() <= 255


def test_symmetry_and_upright():
    a = np.zeros((9, 9, 1))
    a[2:7, 4] = 255
    assert kernels.symmetry(a)["symmetry"] == 1
    b = np.zeros((9, 9, 1))
    b[4, 1:8] = 255
    up = kernels.upright(b)
    assert up.shape[0] > up.shape[1]


def test_patches_split_two_colours():
    lab = np.zeros((8, 8, 3))
    lab[:, 4:] = 60
    labels = kernels.patches(lab)
    assert labels.max() == 2 and len(np.unique(labels[:, :4])) == 1


def test_small_group_clustering():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.05, (12, 2)) for c in ((0, 0), (3, 3), (0, 3))])
    truth = np.repeat(range(3), 12)
    same = lambda a, b: len(set(zip(a, b, strict=True))) == 3
    assert same(kernels.agglomerative(x, 3), truth) and same(kernels.dbscan(x, 0.5), truth) and same(kernels.affinity(x), truth)
    assert kernels.dbscan(np.array([[0.0, 0], [9, 9]]), 0.5).tolist() == [-1, -1]
    y = np.concatenate([x[:12], [[9.0, 9.0]]])
    assert kernels.isolation_scores(y).argmax() == 12


def test_kernels_run_per_image(spark):
    g = gray_table(spark, {"a": np.eye(3, dtype=int) * 255, "b": np.zeros((2, 2), int)})
    rows = {r.img_id: r.area for r in kernels.facts_of(g, kernels.shape_facts, ["gray"], ["area"]).collect()}
    assert rows["a"] == 3 and (rows["b"] is None or np.isnan(rows["b"]))
    assert kernels.on_images(g, lambda a: 255 - a, ["gray"]).where("img_id = 'b'").toPandas()["gray"].tolist() == [255] * 4
    assert isinstance(kernels.cells("a", np.zeros((2, 2, 1)), ["gray"]), pd.DataFrame)
