"""Blocks of vectors that meet as they lie: every pair of documents, nothing shuffled per pair."""

import math

import numpy as np
import pytest

from tests.test_vectors import frame
from textloom.operators import vectors


def test_ids_on_many_rows_count_as_rows_do(spark):
    vecs = frame(spark, [[1, 0], [1, 0], [0, 1], [0, 1], [1, 0]], [5, 5, 5, 7, None])
    pairs = sorted(tuple(r) for r in vectors.cosine_pairs(vecs, 0.5, expand_copies=True).collect())
    assert pairs == [(5, 7, 1.0), (7, 5, 1.0)]
    vecs = frame(spark, [[1, 0], [1, 0], [1, 0]], [5, 5, 7])
    pairs = sorted(tuple(r) for r in vectors.cosine_pairs(vecs, 0.5, expand_copies=True).collect())
    assert pairs == [(5, 7, 1.0)] * 2 + [(7, 5, 1.0)] * 2


@pytest.mark.parametrize("what", ["tiles", "pairs"])
def test_no_vector_is_shuffled_per_pair_of_blocks(spark, monkeypatch, what):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    vecs = frame(spark, np.random.default_rng(8).normal(size=(200, 4)))
    met = vectors.similarity_tiles(vecs, 16) if what == "tiles" else vectors.cosine_pairs(vecs, 0.2)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Generate" not in plan


def test_blocks_of_far_cells_do_not_meet(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6)) * 5
    points = np.vstack([c + rng.normal(size=(40, 6)) * 0.01 for c in centres])
    points = vectors._padded(vectors._units(frame(spark, points)).withColumnRenamed("doc_id", "id")).persist()
    pivots = vectors._pivots(points, 320)
    packed, radius = vectors._cells_packed(points, pivots, 320, 7)
    rows = packed.collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(320))
    for r in rows:
        d = vectors._distances(vectors._unpacked(r.vecs, r.ids), pivots)
        assert np.allclose([r.low, r.high], [d.min(axis=0), d.max(axis=0)])
        assert (d[np.arange(len(d)), r.cells] <= radius[r.cells]).all()
    assert len(rows) >= math.isqrt(3 * spark.sparkContext.defaultParallelism)
