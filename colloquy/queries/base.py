"""The registry of queries and what their modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that says the same to DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


def draws_sql(values: str, levels: int, replicates: int, seed: int = 42, group: str = "") -> str:
    """CTEs that repeat the draws of ``bootstrap.resample`` in SQL: ``lv`` (place, value, m) of the query ``values`` (value), ``d`` (b, place, k)."""
    ctes = [
        f"vals AS ({values})",
        "lv AS (SELECT row_number() OVER (ORDER BY value) - 1 AS place, value, m FROM (SELECT value, count(*) AS m FROM vals WHERE value IS NOT NULL GROUP BY value))",
        f"n_0_{levels} AS (SELECT b, (SELECT sum(m) FROM lv)::BIGINT AS n FROM (SELECT unnest(range({replicates})) AS b))",
    ]
    leaves, stack = [], [(0, levels)]
    while stack:
        lo, hi = stack.pop(0)
        if hi - lo == 1:
            leaves.append(f"SELECT b, {lo} AS place, n AS k FROM n_{lo}_{hi}")
            continue
        mid, at = (lo + hi) // 2, f"{lo}_{hi}"
        ctes += [
            f"p_{at} AS (SELECT sum(m) FILTER (WHERE place < {mid})::DOUBLE / sum(m)::DOUBLE AS p FROM lv WHERE place >= {lo} AND place < {hi})",
            f"c_{at} AS (SELECT n, k, sum(exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * ln(p) + (n - k) * ln(1 - p))) OVER (PARTITION BY n ORDER BY k) AS c FROM (SELECT n, unnest(range(n + 1)) AS k FROM (SELECT DISTINCT n FROM n_{at})), p_{at})",
            f"u_{at} AS (SELECT b, n, ('0x' || substr(md5('{seed}:{group}:0:' || b || ':{lo}:{hi}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM n_{at})",
            f"k_{at} AS (SELECT b, n, coalesce(min(k) FILTER (WHERE c >= u), n) AS k FROM u_{at} JOIN c_{at} USING (n) GROUP BY b, n)",
            f"n_{lo}_{mid} AS (SELECT b, k AS n FROM k_{at})",
            f"n_{mid}_{hi} AS (SELECT b, n - k AS n FROM k_{at})",
        ]
        stack += [(lo, mid), (mid, hi)]
    return "WITH " + ", ".join([*ctes, f"d AS ({' UNION ALL '.join(leaves)})"])
