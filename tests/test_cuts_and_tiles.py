"""Pointers followed to their ends, and the similarity matrix in tiles, against brute force."""

import math

import numpy as np
import pytest

from textloom.operators import cluster, vectors


def ends(parent):
    found = {}
    for i in parent:
        at = i
        while parent[at] != at:
            at = parent[at]
        found[i] = at
    return found


def forest(n, seed):
    rng = np.random.default_rng(seed)
    return {i: int(rng.integers(max(0, i - 5), i + 1)) for i in range(n)}


SHAPES = {
    "chain": {i: max(0, i - 1) for i in range(300)},
    "star": dict.fromkeys(range(300), 0),
    "star of chains": {i: 0 if i < 50 else i - 50 for i in range(300)},
    "forest": forest(300, 3),
    "all alone": {i: i for i in range(20)},
}


@pytest.mark.parametrize("shape", SHAPES)
def test_follow_equals_walking(spark, shape):
    links = spark.createDataFrame(list(SHAPES[shape].items()), "doc_id long, root long").repartition(5)
    rows = cluster.follow(links).collect()
    assert len(rows) == len(SHAPES[shape])
    assert {r.doc_id: r.root for r in rows} == ends(SHAPES[shape])


def test_a_shared_root_is_asked_for_in_shares(spark):
    links = spark.createDataFrame([(i, 0) for i in range(5000)], "doc_id long, root long")
    ahead = spark.createDataFrame([(0, 9)], "root long, next long")
    joined = cluster._shared(links, ahead, cluster._shares(5000))
    assert joined.count() == 5000 and joined.where("next <> 9").isEmpty()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # The rows meet their answer by root and share; only distinct places are joined by root alone.
    assert "Aggregate [root" in plan and "share" in plan


def test_cut_of_a_chain(spark):
    n, heights = 60, np.random.default_rng(5).permutation(59)
    order = np.argsort(heights)
    tree = [(int(s) + 1, int(i), int(i) + 1, float(heights[i])) for s, i in enumerate(order)]
    tree = spark.createDataFrame(tree, "step long, left long, right long, height double")
    for k in (2, 7, n):
        cuts = sorted(int(i) for i in order[n - k :])
        found = {r.doc_id: r.cluster for r in cluster.cut_k(tree, k).collect()}
        assert found == {i: sum(c < i for c in cuts) for i in range(n)}


def vectors_frame(spark, points, ids):
    rows = [(i, None if p is None else [float(x) for x in p]) for i, p in zip(ids, points)]
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame(rows, f"doc_id {kind}, vec array<double>").repartition(3)


@pytest.mark.parametrize("side", [1, 4, 7, 100])
def test_tiles_cover_the_matrix_once(spark, side):
    points = [*np.random.default_rng(2).normal(size=(20, 3)), np.zeros(3), np.ones(3), np.ones(3), None]
    vecs = vectors_frame(spark, points, list(range(24)))
    tiles = vectors.similarity_tiles(vecs, side).collect()
    blocks = math.ceil(23 / side)
    assert sorted((t.row_block, t.col_block) for t in tiles) == [(a, b) for a in range(blocks) for b in range(blocks)]
    for t in tiles:
        assert len(t.row_ids) <= side and len(t.cosines) == len(t.row_ids) * len(t.col_ids)
    rows = vectors.tiles_long(vectors.similarity_tiles(vecs, side)).collect()
    assert len(rows) == 23 * 23
    for r in rows:
        a, b = points[r.doc1], points[r.doc2]
        size = np.linalg.norm(a) * np.linalg.norm(b)
        assert r.cosine == pytest.approx(float(a @ b / size) if size else 0.0, abs=1e-6)


def test_wide_view_and_written_tiles(spark, tmp_path):
    points = np.random.default_rng(4).normal(size=(9, 4))
    vecs = vectors_frame(spark, points, [f"d{i}" for i in range(9)])
    vectors.write_tiles(vectors.similarity_tiles(vecs, 4), str(tmp_path / "tiles"))
    tiles = spark.read.parquet(str(tmp_path / "tiles"))
    assert tiles.count() == 9
    wide = {r.doc_id: r for r in vectors.tiles_wide(tiles, ["d7", "d0"]).collect()}
    expected = {r.doc_id: r for r in vectors.similarity_wide(vecs, ["d7", "d0"]).collect()}
    assert wide.keys() == expected.keys()
    for name, row in wide.items():
        assert (row.sim_d7, row.sim_d0) == pytest.approx((expected[name].sim_d7, expected[name].sim_d0))


def test_tiles_of_nothing(spark):
    vecs = spark.createDataFrame([], "doc_id long, vec array<double>")
    assert vectors.similarity_tiles(vecs).count() == 0
    with pytest.raises(ValueError):
        vectors.similarity_tiles(vecs, 0)
