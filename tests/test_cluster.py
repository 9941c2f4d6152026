"""Clustering against brute force on small planted and random data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import cluster, ward


def frame(spark, points, ids=None, **columns):
    ids = list(range(len(points))) if ids is None else ids
    rows = [
        (i, [float(x) for x in p], *[c[j] for c in columns.values()])
        for j, (i, p) in enumerate(zip(ids, points))
    ]
    kind = "string" if isinstance(ids[0], str) else "long"
    extra = "".join(f", {name} int" for name in columns)
    return spark.createDataFrame(rows, f"doc_id {kind}, vec array<double>{extra}").repartition(3)


def planted(groups=4, each=12, dim=5, seed=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 20
    points = np.vstack([c + rng.normal(size=(each, dim)) for c in centres])
    return points, np.repeat(np.arange(groups), each)


def greedy_ward(points):
    """One merge at a time: heights and, for each step, the sets merged."""
    active = {i: (np.array(p, float), 1, frozenset([i])) for i, p in enumerate(points)}
    merges = []
    while len(active) > 1:
        best = None
        ids = sorted(active)
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                (c1, n, _), (c2, m, _) = active[ids[x]], active[ids[y]]
                h = math.sqrt(2 * n * m / (n + m) * ((c1 - c2) ** 2).sum())
                if best is None or h < best[0]:
                    best = (h, ids[x], ids[y])
        h, a, b = best
        (c1, n, s1), (c2, m, s2) = active[a], active.pop(b)
        active[a] = ((c1 * n + c2 * m) / (n + m), n + m, s1 | s2)
        merges.append((h, s1 | s2))
    return merges


def same_partition(found, expected):
    groups = {}
    for doc, label in found.items():
        groups.setdefault(label, set()).add(doc)
    return sorted(map(sorted, groups.values())) == sorted(map(sorted, expected))


@pytest.mark.parametrize("rows", [1 << 14, 4])
def test_ward_equals_one_merge_at_a_time(spark, monkeypatch, rows):
    monkeypatch.setattr(ward, "BROADCAST_ROWS", rows)
    points = np.random.default_rng(1).normal(size=(30, 3))
    tree = [r.asDict() for r in cluster.ward_linkage(frame(spark, points)).orderBy("step").collect()]
    merges = greedy_ward(points)
    assert [r["step"] for r in tree] == list(range(1, 30))
    assert np.allclose([r["height"] for r in tree], [h for h, _ in merges], atol=1e-6)
    assert [r["size"] for r in tree] == [len(s) for _, s in merges]
    members = {i: {i} for i in range(30)}
    for row, (_, expected) in zip(tree, merges):
        members[row["left"]] = members[row["left"]] | members.pop(row["right"])
        assert members[row["left"]] == set(expected)


@pytest.mark.parametrize("rows", [1 << 14, 2])
def test_ward_with_ties_and_text_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(ward, "BROADCAST_ROWS", rows)
    points = [[0, 0], [0, 1], [0, 2], [0, 3], [10, 0], [10, 0], [10, 0]]
    ids = [f"d{i}.txt" for i in range(7)]
    tree = cluster.ward_linkage(frame(spark, points, ids)).orderBy("step").collect()
    assert len(tree) == 6 and tree[-1]["size"] == 7
    copies = [(r.left, r.right, r.height, r["size"]) for r in tree[:2]]
    assert copies == [("d4.txt", "d5.txt", 0.0, 2), ("d4.txt", "d6.txt", 0.0, 3)]
    assert np.allclose([r.height for r in tree], [h for h, _ in greedy_ward(points)])


def test_ward_with_many_equal_distances(spark, monkeypatch):
    """On a grid nearly all heights are ties; every path must end with a full tree."""
    points = [[x, y] for x in range(4) for y in range(4)]
    for rows in (1 << 14, 3):
        monkeypatch.setattr(ward, "BROADCAST_ROWS", rows)
        tree = cluster.ward_linkage(frame(spark, points)).collect()
        assert len(tree) == 15 and max(r["size"] for r in tree) == 16
        total = ((np.array(points) - np.mean(points, axis=0)) ** 2).sum()
        assert sum(r.height**2 / 2 for r in tree) == pytest.approx(total)
        assert [r.height for r in sorted(tree, key=lambda r: r.step)] == sorted(r.height for r in tree)


def test_only_clusters_that_lost_their_nearest_are_scored(spark, monkeypatch):
    points, _ = planted(groups=5, each=10)
    asked, score = [], ward._score_places
    monkeypatch.setattr(ward, "_score_places", lambda s, asking, alive, *a: (asked.append((len(asking), len(alive))), score(s, asking, alive, *a)))
    cluster.ward_linkage(frame(spark, points)).collect()
    assert asked[0] == (50, 50) and any(a < n for a, n in asked) and sum(a for a, _ in asked) < sum(n for _, n in asked)


def test_cells_find_what_all_pairs_give(spark):
    """Cells and their limits change nothing of what is found."""
    points, _ = planted(groups=6, each=60)
    block = ward._nearest_in_block
    active = frame(spark, points).select(F.col("doc_id").alias("id"), "vec", F.lit(1).cast("long").alias("size")).persist()
    found = {r.id: r for r in ward._scored(active, active, "bigint").collect()}
    whole = block(*[active.toPandas()] * 2)
    assert {r.id: (r.left, r.right, r.height) for r in whole.itertuples()} == {i: (r.left, r.right, r.height) for i, r in found.items()}


@pytest.fixture(scope="module")
def planted_tree(spark):
    points, labels = planted()
    return points, labels, cluster.ward_linkage(frame(spark, points)).persist()


def test_cut_recovers_planted_clusters(planted_tree):
    points, labels, tree = planted_tree
    cut = {r.doc_id: r.cluster for r in cluster.cut_k(tree, 4).collect()}
    assert len(cut) == len(points) and set(cut.values()) == {0, 1, 2, 3}
    assert same_partition(cut, [np.nonzero(labels == g)[0].tolist() for g in range(4)])
    all_alone = cluster.cut_k(tree, len(points)).collect()
    assert sorted(r.cluster for r in all_alone) == list(range(len(points)))
    for bad in (1, len(points) + 1):
        with pytest.raises(ValueError):
            cluster.cut_k(tree, bad)


def test_cut_candidates_count_clusters(planted_tree):
    _, _, tree = planted_tree
    heights = [r.height for r in tree.collect()]
    cuts = {r.fraction: r for r in cluster.cut_candidates(tree).collect()}
    for fraction, row in cuts.items():
        assert row.height == pytest.approx(fraction * max(heights))
        assert row.clusters == 1 + sum(h > fraction * max(heights) for h in heights)
    # A lower cut never gives fewer clusters.
    assert cuts[0.3].clusters >= cuts[0.5].clusters >= cuts[0.7].clusters


def test_ward_over_micro_clusters(spark):
    points, labels = planted()
    centres, micro = cluster.micro_clusters(frame(spark, points), 12)
    tree = cluster.ward_linkage(centres, sizes="size").persist()
    assert tree.agg(F.max("size")).first()[0] == len(points)
    cut = cluster.cut_k(tree, 4).withColumnRenamed("doc_id", "micro")
    found = {r.doc_id: r.cluster for r in micro.join(cut, "micro").collect()}
    assert len(found) == len(points)
    assert same_partition(found, [np.nonzero(labels == g)[0].tolist() for g in range(4)])


def test_kmeans_assigns_to_nearest_centre_and_repeats(spark):
    points, labels = planted()
    vecs = frame(spark, points).persist()
    fit = cluster.kmeans(vecs, 4)
    found = {r.doc_id: r.cluster for r in cluster.membership(fit, vecs).collect()}
    centres = fit.centres
    nearest = ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    assert [found[i] for i in range(len(points))] == nearest.tolist()
    assert same_partition(found, [np.nonzero(labels == g)[0].tolist() for g in range(4)])
    again = {r.doc_id: r.cluster for r in cluster.membership(cluster.kmeans(vecs, 4), vecs).collect()}
    assert again == found
    with pytest.raises(ValueError):
        cluster.kmeans(vecs, 1)


def test_elbow_falls_and_starts_at_total_spread(spark):
    points, _ = planted()
    costs = [r.wss for r in cluster.elbow(frame(spark, points), range(1, 5)).orderBy("k").collect()]
    assert costs[0] == pytest.approx(((points - points.mean(0)) ** 2).sum())
    assert all(a >= b for a, b in zip(costs, costs[1:]))


def test_kmeans_from_start_equals_lloyd(spark):
    rng = np.random.default_rng(3)
    points, start = rng.normal(size=(60, 4)), rng.integers(0, 3, 60)
    expected = start.copy()
    for _ in range(3):
        centres = np.array([points[expected == c].mean(0) for c in range(3)])
        expected = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    df = frame(spark, points, cluster=start.tolist())
    found = {r.doc_id: r.cluster for r in cluster.kmeans_from(df, 3).collect()}
    assert [found[i] for i in range(60)] == expected.tolist()


def brute_silhouette(points, labels):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(labels)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) - {own})
        scores.append((b - a) / max(a, b))
    return np.array(scores)


def test_silhouette_with_a_singleton(spark):
    rng = np.random.default_rng(5)
    points, labels = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    labels[0] = 3
    df = frame(spark, points, cluster=labels.tolist())
    found = {r.doc_id: r.silhouette for r in cluster.silhouette_points(df).collect()}
    assert np.allclose([found[i] for i in range(40)], brute_silhouette(points, labels), atol=1e-9)
    assert found[0] == 0.0


@pytest.mark.parametrize("measure", ["squared", "euclidean"])
def test_choose_k_finds_planted_number(spark, measure):
    points, _ = planted(groups=3)
    table = cluster.choose_k(frame(spark, points), max_k=5, n_init=2, measure=measure)
    assert [r.k for r in table.where("chosen").collect()] == [3]
    assert [r.k for r in table.orderBy("k").collect()] == [2, 3, 4, 5]


def test_choose_k_with_two_documents(spark):
    rows = cluster.choose_k(frame(spark, [[0, 0], [1, 1]])).collect()
    assert [(r.k, r.chosen) for r in rows] == [(2, True)]


def test_cluster_reports(spark):
    members = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "doc_id string, cluster int")
    sizes = [tuple(r) for r in cluster.cluster_sizes(members).collect()]
    assert sizes == [(0, 1, 33.3), (1, 2, 66.7)]
    assert [tuple(r) for r in cluster.cluster_members(members).collect()] == [(0, "c"), (1, "a"), (1, "b")]
    assert {r.cluster: r.doc_id for r in cluster.cluster_reps(members).collect()} == {0: "c", 1: "a"}


def test_kmeans_from_a_start_with_a_gap(spark):
    points = [[0.0], [1.0], [10.0], [11.0]]
    start = frame(spark, points, cluster=[0, 0, 2, 2])
    assert dict(cluster.kmeans_from(start, 1).collect()) == {0: 0, 1: 0, 2: 2, 3: 2}


def test_ward_refuses_vectors_that_are_not_finite(spark):
    with pytest.raises(Exception, match="not finite"):
        cluster.ward_linkage(frame(spark, [[0.0], [1.0], [float("nan")]])).collect()


def test_all_k_share_a_pass_and_end_as_each_alone(spark, monkeypatch):
    points, _ = planted(groups=4, each=50, dim=3)
    rng = np.random.default_rng(5)
    vecs = frame(spark, points + rng.normal(size=points.shape) * 8).unionByName(spark.createDataFrame([(-1, None)], "doc_id long, vec array<double>")).persist()
    monkeypatch.setattr(cluster, "CORESET", 40)  # the starts see a part of the rows
    rows = np.array([r.vec for r in vecs.where("vec is not null").collect()])
    alone = {k: cluster.kmeans(vecs, k, n_init=3) for k in range(2, 7)}
    passes, moves = [], cluster._moves
    monkeypatch.setattr(cluster, "_moves", lambda v, centres: (passes.append(sorted(centres)), moves(v, centres))[1])
    found = cluster.fits(vecs, range(2, 7), n_init=3)
    assert passes[0] == [2, 3, 4, 5, 6] and len(passes) <= 51
    assert all(set(b) <= set(a) for a, b in zip(passes, passes[1:])) and sum(map(len, passes)) > len(passes)
    for k, fit in found.items():
        assert fit.cost == pytest.approx(alone[k].cost, rel=1e-9)
        assert np.allclose(fit.centres, alone[k].centres)
        assert fit.cost == pytest.approx(((rows[:, None, :] - fit.centres[None]) ** 2).sum(axis=2).min(axis=1).sum(), rel=1e-9)
