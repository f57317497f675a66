"""The first earlier row alike of each row, as the SQL of semantic_dedup has it."""

import duckdb
import numpy as np
import pytest

from colloquy import queries as core
from colloquy.operators import dedup


def plain_first(u, keys, threshold):
    """key -> (first earlier key alike, similarity)."""
    out = {}
    for n in np.argsort(keys):
        near = [m for m in np.argsort(keys) if keys[m] < keys[n] and u[m] @ u[n] >= threshold]
        if near:
            out[int(keys[n])] = (int(keys[near[0]]), round(float(u[near[0]] @ u[n]), 9))
    return out


def test_query_names_the_first_row_alike_as_its_sql(spark, tmp_path):
    # each like the next, none like the one after that: row 2 is like row 1, which goes itself
    angles = np.arange(6) * 0.3
    x = np.concatenate([np.stack([np.zeros(6), np.cos(angles), np.sin(angles)], 1), np.eye(3)[:1]]).astype(np.float32)
    rows = [(10 * n + 1, v.tolist(), 0) for n, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.sql(core.oracle_sql()["semantic_dedup"]).fetchall()}
    assert {r.row_idx: (r.kept_idx, r.similarity) for r in core.queries()["semantic_dedup"](spark, str(tmp_path)).collect()} == want
    assert {j: i for j, (i, _) in want.items() if j < 60} == {11: 1, 21: 11, 31: 21, 41: 31, 51: 41}


@pytest.mark.parametrize("block, tile", [(65_536, (2048, 1024)), (40, (16, 8)), (7, (3, 2))])
def test_first_earlier_over_blocks_and_tiles(spark, block, tile):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(40, 12))
    x = np.concatenate([base, base + rng.normal(scale=0.2, size=base.shape), base[:20] + rng.normal(scale=0.3, size=(20, 12)), np.repeat(base[:1], 60, 0) + rng.normal(scale=0.01, size=(60, 12)), np.zeros((2, 12))])
    keys = rng.permutation(len(x)) * 3 + 5
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x)] + [(2, None)], "row_idx long, embedding array<double>").repartition(3)
    u = x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    got = {r.j: (r.i, round(r.sim, 9)) for r in dedup.first_earlier(df, 0.93, block=block, tile=tile).collect()}
    assert got == plain_first(u, keys, 0.93) and len(got) > 80


def test_first_earlier_confirms_what_small_floats_find(spark):
    # all within 1e-6 of the threshold: the first twenty are below it, so the last row's first is the next
    angles = np.arccos(0.95) + np.linspace(1e-6, -1e-6, 40)
    x = np.concatenate([np.stack([np.cos(angles), np.sin(angles)], 1), [[1.0, 0.0]]])
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "row_idx long, embedding array<double>")
    got = {r.j: r.i for r in dedup.first_earlier(df, 0.95).collect()}
    assert got == {j: 0 for j in range(1, 40)} | {40: 20}
    assert 40 not in {r.j for r in dedup.first_earlier(df.where("row_idx < 20 or row_idx = 40"), 0.95).collect()}


def test_first_alike_of_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 8))
    x = np.concatenate([x, x[:10] + rng.normal(scale=0.1, size=(10, 8)), np.repeat(x[3:4], 60, axis=0), np.repeat(x[35:36], 5, axis=0), np.zeros((2, 8))])
    keys = rng.permutation(len(x))
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x)] + [(999, None)], "id long, embedding array<double>")
    u = x[: len(x) - 2] / np.linalg.norm(x[: len(x) - 2], axis=1, keepdims=True)
    got = {r.id: (r.kept_idx, round(r.similarity, 9)) for r in dedup.first_alike(df, 0.9, key="id").collect()}
    assert got == plain_first(u, keys[: len(u)], 0.9)
    none = spark.createDataFrame([(1, None)], "row_idx long, embedding array<double>")
    assert dedup.first_alike(none, 0.9).count() == 0
