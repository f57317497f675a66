"""Neighbour search, spanning trees, density clusters and layouts against plain numpy."""

import numpy as np
import pytest
from exact_density import density_labels, spanning_tree

from colloquy import shared
from colloquy.operators import cluster, dedup, density, forest, layout, similarity, vector_index
from colloquy.shared import scratch


def frame(spark, x, name="row_idx"):
    return spark.createDataFrame([(i, None if v is None else [float(t) for t in v]) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def blobs(n, dims=12, centres=8, scale=0.25, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(scale=scale, size=(n, dims))


def plain_top(x, asked, k, least=0.0):
    u = x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    out = set()
    for q in asked:
        s = u @ u[q]
        order = [int(i) for i in np.lexsort((np.arange(len(x)), -np.round(s, 9))) if i != q and s[i] >= least and np.any(x[i])][:k]
        out |= {(q, i, r + 1) for r, i in enumerate(order)}
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    x = blobs(3000)
    x[500:900] = x[500]  # a large group of copies
    x[7] = 0
    return x, frame(spark, x)


def test_index_recall_and_exact_mode(spark, corpus, monkeypatch):
    x, rows = corpus
    monkeypatch.setattr(vector_index, "BLOCK", 200)
    path = scratch(spark, "index")
    vector_index.write_index(rows, path, "row_idx", rows_per_cell=100, sample=1500)
    asked = rows.where("row_idx % 100 = 0").withColumnRenamed("row_idx", "query_id")
    want = plain_top(x, range(0, 3000, 100), 10)
    exact = vector_index.search_index(spark, path, asked, 10, probe=None, key="row_idx").collect()
    assert {(r.query_id, r.row_idx, r["rank"]) for r in exact} == want
    near = vector_index.search_index(spark, path, asked, 10, key="row_idx").collect()
    # copies at the same similarity are as good as one another
    level = {q: min(np.round(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i]), 9) for a, i, _ in want if a == q) for q in range(0, 3000, 100)}
    assert sum(r.similarity >= level[r.query_id] - 1e-9 for r in near) / len(want) >= 0.9
    assert spark.read.parquet(f"{path}/rows").count() == 2999
    assert spark.read.parquet(f"{path}/cells").agg({"n": "sum"}).first()[0] == 2999


def test_index_recall_of_vectors_without_groups(spark):
    x = np.random.default_rng(3).normal(size=(3000, 24))
    rows, path = frame(spark, x), scratch(spark, "index")
    vector_index.write_index(rows, path, "row_idx", rows_per_cell=30)
    asked = rows.where("row_idx % 25 = 0").withColumnRenamed("row_idx", "query_id")
    want = {(q, i) for q, i, _ in plain_top(x, range(0, 3000, 25), 10, -1.0)}
    got = {(r.query_id, r.row_idx) for r in vector_index.search_index(spark, path, asked, 10, key="row_idx").collect()}
    assert len(got & want) / len(want) >= 0.9
    few = {(r.query_id, r.row_idx) for r in vector_index.search_index(spark, path, asked, 10, probe=8, key="row_idx").collect()}
    assert len(few & want) / len(want) < 0.9  # as many cells as were always visited before
    assert 8 < spark.read.parquet(f"{path}/cells").first().probe < 100


def test_exact_search_without_an_index(spark, corpus):
    x, rows = corpus
    asked = rows.where("row_idx % 300 = 0 or row_idx = 7").withColumnRenamed("row_idx", "query_id")
    got = similarity.top_k_many(rows, asked, 5, 0.2, key="row_idx").collect()
    assert {(r.query_id, r.row_idx, r["rank"]) for r in got} == plain_top(x, range(0, 3000, 300), 5, 0.2)
    small = vector_index.search_exact(rows, asked, 5, 0.2, key="row_idx", rows_per_cell=60).collect()
    assert {(r.query_id, r.row_idx, r["rank"]) for r in small} == plain_top(x, range(0, 3000, 300), 5, 0.2)
    assert similarity.top_k_many(rows.where("false"), asked, key="row_idx").count() == 0
    assert similarity.top_k_many(rows, asked.where("false"), key="row_idx").count() == 0


def test_empty_index(spark, corpus):
    path = scratch(spark, "index")
    vector_index.write_index(corpus[1].where("row_idx = 7"), path, "row_idx")
    assert vector_index.search_index(spark, path, corpus[1].limit(3).withColumnRenamed("row_idx", "query_id"), key="row_idx").count() == 0


def labels_of(spark, x, size, samples, method="eom", **options):
    got = {r.row_idx: r.cluster_id for r in density.density_clusters(frame(spark, x), size, samples, method, auto=False, **options).collect()}
    return np.array([got[i] for i in range(len(x))])


@pytest.mark.parametrize("size,samples,method,in_task", [(5, 1, "eom", 10_000), (3, 2, "leaf", 0), (4, 4, "eom", 20)])
def test_complete_graph_gives_the_exact_clusters(spark, size, samples, method, in_task):
    x = blobs(160, 6, 5, 0.4, seed=size)
    x[20:50], x[3] = x[20], x[4]  # copies
    want = density_labels(vector_index.unit_rows(x), size, samples, method)
    assert (want >= 0).any() and (want == -1).any()
    assert labels_of(spark, x, size, samples, method, neighbours=200, in_task=in_task).tolist() == want.tolist()


def test_neighbour_graph_gives_nearly_the_exact_tree(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 150)
    x = np.concatenate([blobs(700, 10, 6, 0.15, seed=9), np.random.default_rng(2).normal(size=(200, 10))])
    u = vector_index.unit_rows(x)
    graph = density.neighbour_graph(frame(spark, x), 16, 6, 60)
    assert len(graph.centroids) == 15
    tree, _ = density.reachability_tree(graph, 1, in_task=100)
    first = {r.id: r.first for r in graph.points.collect()}
    found = {(min(first[r.u], first[r.v]), max(first[r.u], first[r.v])) for r in tree.collect()}
    want = {(int(min(a, b)), int(max(a, b))) for a, b, _ in spanning_tree(u, 1)}
    assert len(found) == len(x) - 1 and len(found & want) >= 0.9 * len(want)
    # with core distances many weights are equal, so the tree isn't unique, but its weight is
    total = sum(r.w for r in density.reachability_tree(graph, 3)[0].collect())
    assert total <= 1.01 * spanning_tree(u, 3)[:, 2].sum()


def test_tree_of_rounds_and_of_one_task_agree(spark):
    rng = np.random.default_rng(3)
    n = 120
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (900, 2)).tolist() if a != b} | {(i, i + 1) for i in range(n - 1)}
    edges = spark.createDataFrame([(float(rng.integers(0, 40)), a, b) for a, b in sorted(pairs)], "w double, u long, v long")
    one, rounds = (sorted(map(tuple, forest.spanning_tree(edges, spark.range(n), in_task=k).collect())) for k in (10_000, 0))
    assert one == rounds and len(one) == n - 1


def test_merge_sizes_of_a_chain_and_a_star(spark):
    for pairs in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(i // 2, i) for i in range(1, 60)]):
        rng = np.random.default_rng(len(pairs))
        order = rng.permutation(len(pairs)).tolist()
        tree = spark.createDataFrame([(float(w), u, v) for w, (u, v) in zip(order, pairs)], "w double, u long, v long")
        n = max(v for _, v in pairs) + 1
        chains, leaves = forest.merge_tree(tree, in_task=0)
        got = {r.w: sorted((r.below, r.hang)) for r in forest.merge_sizes(chains, leaves, spark.range(n).selectExpr("id", "1L AS weight")).collect()}
        root, size, want = list(range(n)), [1] * n, {}
        for w, (u, v) in sorted(zip(order, pairs)):
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            want[float(w)] = sorted((size[u], size[v]))
            root[v], size[u] = u, size[u] + size[v]
        assert got == want


def test_few_rows(spark):
    x = blobs(3, 4)
    assert density.density_clusters(frame(spark, [None, None])).toPandas().cluster_id.tolist() == [-2, -2]
    assert density.density_clusters(frame(spark, [x[0], None])).orderBy("row_idx").toPandas().cluster_id.tolist() == [0, -2]
    assert density.density_clusters(frame(spark, [x[0]] * 7 + [None])).orderBy("row_idx").toPandas().cluster_id.tolist() == [-1] * 7 + [-2]
    assert density.density_clusters(frame(spark, x).where("false")).count() == 0


def preserved(x, y, k=10):
    """Share of the exact neighbours by direction that are neighbours in the plane."""
    def near(d):
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :k]

    u = vector_index.unit_rows(x)
    a, b = near(2 - 2 * u @ u.T), near(((y[:, None] - y[None]) ** 2).sum(axis=2))
    return np.mean([len(set(p) & set(q)) / k for p, q in zip(a.tolist(), b.tolist())])


def test_layout_keeps_neighbours(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK_ROWS", 150)  # several blocks that learn of one another
    monkeypatch.setattr(layout, "SAMPLE", 200)
    x = blobs(500, 16, 12, 0.25, seed=1)
    rows = frame(spark, [*x, None])
    got = layout.graph_layout(rows).toPandas().sort_values("row_idx")
    assert got.row_idx.tolist() == list(range(500))
    flat = cluster.layout_2d(rows).toPandas().sort_values("row_idx")
    own, plain = preserved(x, got[["x", "y"]].to_numpy()), preserved(x, flat[["x", "y"]].to_numpy())
    assert own >= 0.3 and own >= 1.4 * plain, (own, plain)


def test_eigenvectors_of_the_graph(spark):
    graph = layout.fuzzy_graph(density.neighbour_graph(frame(spark, blobs(120, 5, 3, 0.5)), 8).edges)
    got = layout.eigenvectors(graph, 2, sweeps=40).toPandas().sort_values("id")
    ids = got.id.tolist()
    w = np.zeros((120, 120))
    for r in graph.collect():
        w[ids.index(r.i), ids.index(r.j)] = r.w
    assert np.allclose(w, w.T)
    d = w.sum(axis=1)
    n = w / np.sqrt(d[:, None] * d)
    values, vectors = np.linalg.eigh(n)
    x = got[["x0", "x1"]].to_numpy()
    assert np.allclose(x.T @ x, np.eye(2), atol=1e-6)
    assert np.allclose(np.diag(x.T @ n @ x), values[::-1][1:3], atol=1e-3)


def test_layout_of_few_rows(spark):
    x = blobs(2, 4)
    assert layout.graph_layout(frame(spark, [None])).count() == 0
    assert [tuple(r) for r in layout.graph_layout(frame(spark, x[:1])).collect()] == [(0, 0.0, 0.0)]
    assert sorted(tuple(r)[1:] for r in layout.graph_layout(frame(spark, x)).collect()) == [(0.0, 0.0), (1.0, 0.0)]
    assert layout.graph_layout(frame(spark, blobs(9, 4))).count() == 9
    a, b = layout.curve(0.1, 1.0)
    assert a == pytest.approx(1.577, abs=2e-3) and b == pytest.approx(0.895, abs=2e-3)


def test_semantic_pairs_move_only_rows_that_meet(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(1500, 32))
    x[700:730] = x[:30] + 0.02
    tables = {}
    monkeypatch.setattr(dedup, "materialise", lambda df, name: tables.setdefault(name, shared.materialise(df, name)))
    monkeypatch.setattr(dedup, "SLICE", 97)
    got = {(r.i, r.j) for r in dedup.semantic_pairs(frame(spark, x), 0.95).collect()}
    u = vector_index.unit_rows(x)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.95)) if i < j} and len(got) == 30
    assert tables["met"].count() < 10 * 1500  # of more than sixty buckets for each row


def test_layout_sends_no_row_per_vector_through_the_driver(spark, monkeypatch):
    plans, x = [], blobs(400)
    keep = lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), shared.materialise(df, name))[1]
    monkeypatch.setattr(layout, "materialise", keep)
    got = layout.graph_layout(frame(spark, x), rounds=1)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    # the row per cell that deals rows into blocks is broadcast, nothing else
    assert sum(p.count("BroadcastExchange") for p in plans) <= 1


def test_neighbours_travel_a_row_per_visit(spark, monkeypatch):
    x, found = blobs(600), []
    keep = lambda *a: (found.append(vector_index.meet(*a)), found[-1])[1]
    monkeypatch.setattr(density, "meet", keep)
    graph = density.neighbour_graph(frame(spark, x), 16, 4, 60)
    assert found[0].count() <= 4 * 600  # not one per neighbour
    rows = {}
    for r in graph.edges.collect():
        rows.setdefault(r.i, []).append((r["rank"], r.d, r.j))
    assert len(rows) == 600 and all([k for k, _, _ in sorted(v)] == list(range(1, 17)) and sorted(v) == [(k + 1, d, j) for k, (d, j) in enumerate(sorted((d, j) for _, d, j in v))] for v in rows.values())


def test_tree_of_plain_distances_joins_no_core_distances(spark, monkeypatch):
    plans, spanning = [], forest.spanning_tree
    monkeypatch.setattr(forest, "spanning_tree", lambda edges, *a: (plans.append(edges._jdf.queryExecution().optimizedPlan().toString()), spanning(edges, *a))[1])
    graph = density.neighbour_graph(frame(spark, blobs(200)), 8)
    tree, _ = density.reachability_tree(graph, 1)
    assert tree.count() == 199 and "Join" not in plans[0] and "Aggregate" not in plans[0]


def test_long_chains_of_pointers_take_few_tables(spark, monkeypatch):
    names = []
    monkeypatch.setattr(forest, "materialise", lambda df, name: (names.append(name), shared.materialise(df, name))[1])
    chain = spark.range(1000).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS to")
    assert {(r.id, r.root) for r in forest.follow(chain, in_task=0).collect()} == {(i, 0) for i in range(1000)}
    assert len(names) <= 7  # twelve where a table is a jump


@pytest.mark.parametrize("most", [1, 5])
def test_first_of_rows_among_many_columns(most):
    cost = np.random.default_rng(4).integers(0, 40, (30, 500)).astype(float)
    cost[3], cost[4, 2:], cost[5, :490], cost[6, ::2] = np.inf, np.inf, np.nan, np.nan
    i, j = vector_index.first_of_rows(cost, most)
    for r in range(30):
        want = [c for c in np.lexsort((np.arange(500), cost[r])) if np.isfinite(cost[r, c])][:most]
        assert j[i == r].tolist() == want
