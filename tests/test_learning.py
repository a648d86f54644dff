"""Learners: exact values where they have a closed form, otherwise quality on planted groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import dense
from graphloom.operators import evaluate, factors, graph, matrix, networks
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.storage import stored

SIZE, GROUPS = 12, 3


def planted():
    rng = np.random.default_rng(7)
    n = SIZE * GROUPS
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.7 if a // SIZE == b // SIZE else 0.03)]


@pytest.fixture(scope="module")
def groups(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in planted()], "src long, dst long, weight double")
    return PropertyGraph.from_edges(stored(graph.symmetrized(edges)))


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.abs(np.eye(GROUPS)[k // SIZE] * 0.5 + rng.random(GROUPS))]) for k in range(SIZE * GROUPS)]
    return spark.createDataFrame(rows, "id long, features array<double>")


@pytest.fixture(scope="module")
def marks(spark):
    part = lambda k: "train" if k % 3 == 0 else "val" if k % 3 == 1 else "test"
    return spark.createDataFrame([(k, k // SIZE, part(k)) for k in range(SIZE * GROUPS)], "id long, y int, part string")


def apart(vectors):
    """Mean cosine within groups less that between them."""
    found = {r["id"]: np.array(r["vec"]) for r in vectors.collect()}
    assert sorted(found) == list(range(SIZE * GROUPS))
    x = np.array([found[k] / max(np.linalg.norm(found[k]), 1e-12) for k in sorted(found)])
    same = np.arange(len(x))[:, None] // SIZE == np.arange(len(x)) // SIZE
    cos = x @ x.T
    return cos[same].mean() - cos[~same].mean()


def adjacency():
    a = np.zeros((SIZE * GROUPS,) * 2)
    for u, v in planted():
        a[u, v] = a[v, u] = 1
    return a


def test_gradients_of_dense_layers_match_differences():
    rng = np.random.default_rng(0)
    for kind in ("softmax", "sigmoid"):
        weights = [rng.standard_normal((4, 5)), rng.standard_normal(5), rng.standard_normal((5, 3)), rng.standard_normal(3)]
        net = dense.DenseNet(weights, kind, (0.0, 0.3))
        x, target, ids = rng.standard_normal((6, 4)), np.eye(3)[[0, 1, 2, 0, 1, 2]], np.arange(6)
        found, _ = net.gradients(x, target, ids, 1)
        for w, g in zip(weights, found):
            at = tuple(0 for _ in w.shape)
            kept, losses = w[at], []
            for d in (1e-5, -1e-5):
                w[at] = kept + d
                losses.append(net.gradients(x, target, ids, 1)[1])
            w[at] = kept
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_dropout_keeps_the_mean_and_is_a_function_of_the_id():
    scale = dense.kept(np.arange(5000), 8, 0.25, 3)
    assert scale.mean() == pytest.approx(1, abs=0.02)
    assert (dense.kept(np.array([17]), 8, 0.25, 3) == scale[17]).all()


def test_partition_sums_over_many_partitions_and_none(spark):
    rows = spark.range(1000, numPartitions=7).select("id")
    add = lambda batch: np.arange(200.0) * dense.numbers_of(batch, "id").sum()
    assert dense.partition_sums(rows, add, 200)[3] == 3 * 499500
    assert not dense.partition_sums(rows.where("id < 0"), add, 200).any()


def test_convolution_propagates_like_matrices(groups, features, spark):
    held = networks.supports(matrix.renormalised(matrix.matrix(groups.edges), features.select("id")))
    a = adjacency() + np.eye(SIZE * GROUPS)
    hat = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    x = np.array([r["features"] for r in features.orderBy("id").collect()])
    found = networks._spread(held, features.withColumnRenamed("features", "z"), "z", GROUPS).orderBy("id").collect()
    assert np.allclose([r["z"] for r in found], hat @ x)
    back = networks._gathered(held, features.withColumnRenamed("features", "z"), "z", GROUPS, 1).orderBy("id").collect()
    assert np.allclose([r["z"] for r in back], hat.T @ x)


def test_convolutions_in_one_process_equal_those_over_partitions(groups, features, marks, monkeypatch):
    terms = [matrix.renormalised(matrix.matrix(groups.edges), features.select("id")), matrix.identity(features.select("id"))]
    run = lambda: networks.train_convolution(features, networks.supports(*terms), marks, GROUPS, hidden=5, epochs=3, dropout=0.4)
    (one, first), (two, second) = run(), (monkeypatch.setattr(networks, "LOCAL_BYTES", 0), run())[1]
    assert all(a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a]) for a, b in zip(first, second)) and len(first) == len(second) == 3
    for a, b in zip(sorted(one.collect()), sorted(two.collect())):
        assert a.id == b.id and np.allclose(a.hidden, b.hidden) and np.allclose(a.probs, b.probs)


@pytest.mark.parametrize("kind", ["gcn", "cheby"])
def test_graph_convolutions_learn_groups(groups, features, marks, kind):
    more = dict(epochs=6, rate=0.2, dropout=0.0, decay=0.0, patience=0)
    learn = networks.gcn if kind == "gcn" else lambda *a, **m: networks.gcn_chebyshev(*a, order=2, **m)
    found, history = learn(groups.edges, features, marks, GROUPS, **more)
    assert history[-1]["loss"] < history[0]["loss"]
    rows = found.join(marks.where("part = 'test'"), "id").withColumn("mask", F.lit(True))
    assert evaluate.masked_accuracy(rows).first()[0] > 0.8


def test_chebyshev_terms_take_the_largest_eigenvalue(groups, features, marks, monkeypatch):
    ids = [r["id"] for r in features.select("id").orderBy("id").collect()]
    a = np.zeros((len(ids), len(ids)))
    for r in groups.edges.collect():
        a[ids.index(r["src"]), ids.index(r["dst"])] = r["weight"]
    lap = np.eye(len(ids)) - a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    seen = []
    monkeypatch.setattr(networks, "_convolved", lambda terms, *rest: seen.extend(terms))
    networks.gcn_chebyshev(groups.edges, features, marks, GROUPS, order=1)
    got = np.zeros_like(lap)
    for r in seen[1].collect():
        got[ids.index(r["i"]), ids.index(r["j"])] = r["v"]
    top = np.linalg.eigvalsh(lap).max()
    assert top < 1.9 and np.allclose(got, 2 / top * lap - np.eye(len(ids)), atol=0.01)


def test_chebyshev_terms_are_not_made_in_one_process(groups, features, marks, monkeypatch):
    made, keep = [], networks.stored
    monkeypatch.setattr(networks, "stored", lambda df, name: (made.append((name, [r["s"] for r in df.select("s").distinct().collect()] if name == "supports" else None)), keep(df, name))[1])
    run = lambda: networks.gcn_chebyshev(groups.edges, features, marks, GROUPS, largest=1.7, hidden=5, epochs=3, dropout=0.4)
    one, first = run()
    assert ("supports", [0]) in made and len(made) == 4
    monkeypatch.setattr(networks, "stored", keep)
    held = networks.supports(*matrix.chebyshev(matrix.scaled_laplacian(matrix.matrix(groups.edges), features.select("id"), 1.7), features.select("id"), 3))
    two, second = networks.train_convolution(features.select("id", networks.N.l1_normalised(F.col("features")).alias("features")), held, marks, GROUPS, hidden=5, epochs=3, dropout=0.4)
    assert all(a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a]) for a, b in zip(first, second)) and len(first) == len(second) == 3
    for a, b in zip(sorted(one.collect()), sorted(two.collect())):
        assert a.id == b.id and np.allclose(a.hidden, b.hidden) and np.allclose(a.probs, b.probs)


def test_dense_network_learns_features_and_stops_early(features, marks):
    found, net = networks.mlp(features, marks, GROUPS, dropout=0.0, epochs=15, rate=0.1)
    assert net.history[-1]["loss"] < net.history[0]["loss"]
    assert found.count() == SIZE * GROUPS
    _, early = networks.mlp(features, marks, GROUPS, dropout=0.0, epochs=30, rate=5.0, patience=1)
    assert len(early.history) < 30


def test_line_separates_groups(groups):
    assert apart(factors.line(groups, 8, order=3, epochs=12, rate=0.2)) > 0.2


def test_draws_follow_their_shares(spark):
    shares = spark.createDataFrame([(1, 0.7), (2, 0.1), (3, 0.15), (4, 0.05)], "id long, prob double")
    table, buckets = factors.drawing_table(shares, "id", "prob")
    draws = spark.range(20000).select(F.col("id").alias("n"))
    found = {r["id"]: r["count"] for r in factors.drawn(draws, table, buckets, factors._fraction(F.col("n"))).groupBy("id").count().collect()}
    assert sum(found.values()) == 20000
    assert found[1] == pytest.approx(14000, abs=300) and found[4] == pytest.approx(1000, abs=150)


def test_sdne_separates_groups_and_checks_its_size(groups):
    assert apart(factors.sdne(groups, (16, 4), epochs=15, rate=0.05)) > 0.2
    assert factors.sdne(groups, (8, 3), epochs=1, by_pair=True).count() == SIZE * GROUPS
    with pytest.raises(ValueError, match="weights"):
        factors.sdne(groups, (10_000_000, 2))


def test_tadw_matches_dense_algebra(groups, features):
    a, x = adjacency(), np.array([r["features"] for r in features.orderBy("id").collect()])
    p = a / a.sum(0)
    m, t, lamb, half = (p + p @ p) / 2, x.T, 0.2, 2
    h = np.random.default_rng(32).standard_normal((half, GROUPS))
    for _ in range(3):
        b = h @ t
        w = np.linalg.solve(2 * b @ b.T + lamb * np.eye(half), 2 * b @ m.T)
        system = np.kron(w @ w.T, t @ t.T) + lamb * np.eye(half * GROUPS)
        h = np.linalg.solve(system, (w @ m.T @ t.T).reshape(-1)).reshape(half, GROUPS)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    found = factors.tadw(groups, features, 4, lamb, rounds=3).orderBy("id").collect()
    assert np.allclose([r["vec"] for r in found], np.hstack([unit(w.T), unit(t.T @ h.T)]), atol=1e-6)


def test_lle_spans_the_smallest_singular_vectors(groups):
    a = adjacency()
    away = np.eye(len(a)) - a / a.sum(1, keepdims=True)
    _, s, vt = np.linalg.svd(away)
    found = np.array([r["vec"] for r in factors.lle(groups, 3).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(away @ found, axis=0), s[::-1][1:4], atol=1e-5)
    assert np.allclose(np.abs(found.T @ vt[::-1][1:4].T), np.eye(3), atol=1e-4)


def test_principal_components_match_numpy(features):
    x = np.array([r["features"] for r in features.orderBy("id").collect()])
    found = np.array([r["vec"] for r in networks.principal_components(features.withColumnRenamed("features", "vec"), 2).orderBy("id").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2]
    assert np.allclose(found.var(0), values) and np.allclose(found.mean(0), 0)


def test_links_and_labels_are_predicted_from_vectors(spark, groups):
    vectors = spark.createDataFrame([(k, [float(z) for z in np.eye(GROUPS)[k // SIZE] + 0.1]) for k in range(SIZE * GROUPS)], "id long, vec array<double>")
    pairs = spark.createDataFrame([(a, b, int(a // SIZE == b // SIZE), "train" if (a + b) % 2 else "test") for a in range(36) for b in range(a + 1, 36)], "u long, v long, label int, part string")
    scored, _ = networks.link_prediction(pairs, vectors, epochs=15, rate=0.05, patience=0)
    assert scored.count() == pairs.where("part = 'test'").count()
    assert evaluate.roc_auc(scored).first()[0] > 0.95
    labels = spark.createDataFrame([(k, str(k), [f"g{k // SIZE}"]) for k in range(SIZE * GROUPS)], "line_no long, id string, labels array<string>")
    scores = networks.rank_labels(vectors.select(F.col("id").cast("string"), "vec"), labels, 0.5)
    assert scores.first()["micro"] == 1.0


def test_masks_and_label_numbers(spark, features):
    labels = spark.createDataFrame([(2, "a", ["y"]), (1, "b", ["x", "y"])], "line_no long, id string, labels array<string>")
    assert sorted(map(tuple, networks.label_indicator(labels).collect())) == [("a", 1), ("b", 0)]
    index = spark.createDataFrame([(3,), (3,), (5,)], "idx long")
    assert sorted(r["id"] for r in networks.sample_mask(features.select("id"), index).where("mask").collect()) == [3, 5]
