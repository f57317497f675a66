"""Greedy semantic duplicates against the row-order rule."""

import numpy as np
import pytest

from colloquy import shared
from colloquy.operators import dedup, forest, ranks


def plain_greedy(links):
    """j -> (first kept partner, similarity)."""
    near = {}
    for i, j, s in links:
        near.setdefault(j, []).append((i, s))
    gone = {}
    for j in sorted(near):
        kept = [(i, s) for i, s in sorted(near[j]) if i not in gone]
        if kept:
            gone[j] = kept[0]
    return gone


def got(spark, links, most):
    pairs = spark.createDataFrame(links, "i long, j long, sim double")
    return {r.row_idx: (r.kept_idx, r.similarity) for r in dedup.greedy_keep(pairs, pairs, most=most).collect()}


@pytest.mark.parametrize("most", [200_000, 60, 8])
def test_greedy_in_bounded_groups(spark, most):
    rng = np.random.default_rng(most)
    links = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 120, (170, 2)).tolist() if a != b}
    links |= {(i, 150) for i in range(40)} | {(130, i) for i in range(160, 185)}  # rows of more links than a task takes
    links = [(i, j, round(float(rng.random()), 6)) for i, j in sorted(links)]
    assert got(spark, links, most) == plain_greedy(links)


def test_rounds_of_a_long_chain(spark, monkeypatch):
    calls = []
    for module in (dedup, forest, ranks):
        monkeypatch.setattr(module, "materialise", lambda df, name: (calls.append(name), shared.materialise(df, name))[1])
    links = [(i, i + 1, 0.96) for i in range(10_000)]
    assert got(spark, links, 200_000) == {j: (j - 1, 0.96) for j in range(1, 10_001, 2)}
    assert len(calls) < 12
    assert {(r.id, r.comp) for r in forest.components(spark.range(3000).selectExpr("id AS u", "id + 1 AS v"), in_task=0).collect()} == {(i, 0) for i in range(3001)}
    assert len(calls) < 12 + 90


def test_copies_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 8))
    x = np.concatenate([x, x[:10] + rng.normal(scale=0.1, size=(10, 8)), np.repeat(x[3:4], 60, axis=0), np.repeat(x[35:36], 5, axis=0), np.zeros((2, 8))])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(order, x)] + [(999, None)], "row_idx long, embedding array<double>")
    seen = []
    pairs = dedup.semantic_pairs
    monkeypatch.setattr(dedup, "semantic_pairs", lambda *a, **k: (seen.append(pairs(*a, **k)), seen[-1])[1])
    rows = {r.row_idx: (r.kept_idx, round(r.similarity, 9)) for r in dedup.semantic(df, 0.9).collect()}
    y = np.empty_like(x)
    y[order] = x
    u = y / np.maximum(1e-300, np.linalg.norm(y, axis=1, keepdims=True))
    links = [(i, j, round(float(u[i] @ u[j]), 9)) for j in range(len(u)) for i in range(j) if u[i] @ u[j] >= 0.9]
    assert rows == plain_greedy(links)
    assert seen[0].count() < 60
