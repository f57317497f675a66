"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session's temp folder or the warehouse folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"file://{tempfile.gettempdir()}/colloquy-shared"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_colloquy"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: that cuts the lineage, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = 1 << 25) -> DataFrame:
    """``df``, the columns of a scan, dealt out evenly if its files are few and small.

    A file of one row group is one task, however many cores stand idle, and what is costly here is the
    work per row. Inputs of as many files as cores, or of more than ``most`` bytes, aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    few = 0 < len(df._jdf.inputFiles()) < cores and int(str(plan.stats().sizeInBytes())) <= most
    return df.repartition(cores) if few else df
