"""Blocks of cells: a target is sent on once per block, and nothing is lost."""

import math

import numpy as np
import pytest

from textloom.operators import vectors
from tests.test_vectors import clustered, cosines, frame


def test_a_target_is_sent_once_per_block_not_once_per_cell(spark):
    points = np.random.default_rng(3).normal(size=(1000, 6))
    df = vectors._padded(vectors._units(frame(spark, points)).withColumnRenamed("doc_id", "id")).persist()
    sent, met = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def kernel(q_ids, q, t_ids, t):
        import pandas as pd

        sent.add(len(t_ids))
        met.add(len(q_ids) * len(t_ids))
        return pd.DataFrame({"q": q_ids[:0]})

    vectors._blocked(df, df, kernel, "q long", within=2.0).collect()
    assert met.value == 1000 * 1000
    blocks = math.ceil(math.sqrt(3 * spark.sparkContext.defaultParallelism)) + 1
    assert sent.value <= blocks * 1000 < math.isqrt(1000) // 2 * 1000


def test_near_cells_share_a_group():
    pivots = np.array([[0.0], [10.0], [1.0], [11.0], [50.0], [2.0]])
    groups = vectors._groups(pivots, {0: 3, 1: 4, 2: 3, 3: 4, 5: 30}, 8)
    assert groups[4] == -1 and groups[0] == groups[2] and groups[1] == groups[3]
    assert len({groups[0], groups[1], groups[5]}) == 3
    assert vectors._groups(pivots, {}, 8).max() == -1


def test_pairs_with_text_keys_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 2)
    points = clustered(4)[:40]
    ids = [f"d{i:02}" for i in range(len(points))]
    sims = cosines(points)
    found = vectors.cosine_pairs(frame(spark, points, ids), 0.9, expand_copies=True).collect()
    expected = {(a, b): sims[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids) if i != j and sims[i, j] >= 0.9}
    assert {(r.doc1, r.doc2): r.cosine for r in found} == pytest.approx(expected)


def test_best_targets_find_all_ties_and_repeated_ids():
    rng = np.random.default_rng(6)
    t = np.round(rng.normal(size=(900, 3)), 1)
    t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)
    ids = np.sort(rng.integers(0, 500, 900))
    q = t[:50]
    found = vectors.best_targets(4)(ids[:50], q, ids, t)
    sims = np.rint(q @ t.T * 1e6).astype(int)
    for i in range(50):
        others = sorted((-sims[i, j], j) for j in range(900) if ids[j] != ids[i])[:4]
        mine = found.iloc[4 * i : 4 * i + 4]
        assert mine["t"].tolist() == [ids[j] for _, j in others]
        assert mine["sim"].tolist() == [-s / 1e6 for s, _ in others]
