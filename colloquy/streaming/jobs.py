"""Queued runs as a stream: an inbox of job files, processed in micro-batches.

A job file names a run. A batch claims the run, scores its cases, appends results below
``results/run_id=...`` and moves the run on. The claim names the stream's batch, which keeps its
number over a restart: a batch that is run again takes up the runs that it had claimed when it died
and leaves alone those that it had finished. The stream's checkpoint acknowledges jobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import Catalog

JOB = "run_id string"


def publish(spark: SparkSession, inbox: str, run_id: str) -> None:
    spark.createDataFrame([(run_id,)], JOB).coalesce(1).write.mode("append").json(inbox)


def process_run(catalog: Catalog, run_id: str, evaluate: Callable[[DataFrame], DataFrame], results: str, by: str = "") -> str:
    """Claim, evaluate and finish one run; returns its status."""
    if not catalog.claim(run_id, by):
        now = catalog.run(run_id)
        return now.status if now else "missing"
    try:
        lines = catalog.get_lines(catalog.run(run_id).input_key)
        if lines is None:
            raise FileNotFoundError(catalog.run(run_id).input_key)
        out = f"{results}/run_id={run_id}"
        evaluate(lines).write.mode("overwrite").parquet(out)
        done = catalog.spark.read.parquet(out).agg(F.count("*").alias("n"), F.avg("accuracy").alias("a")).first()
        if catalog.run(run_id).status == "cancelled":
            catalog.attach_to_cancelled(run_id, out, done.a, done.n, done.n)
            return "cancelled"
        catalog.progress(run_id, done.n, done.n, done.a)
        catalog.complete(run_id, out, done.a)
        return "completed"
    except Exception as e:  # a run fails with its error; the stream goes on
        catalog.fail(run_id, f"{type(e).__name__}: {e}")
        return "failed"


def worker(spark: SparkSession, catalog: Catalog, inbox: str, results: str, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Process the inbox, one file at a time; with ``once`` until it is empty."""
    def batch(jobs: DataFrame, epoch: int) -> None:
        for row in jobs.select("run_id").distinct().collect():  # at most a file of job names
            process_run(catalog, row.run_id, evaluate, results, f"{checkpoint}#{epoch}")

    stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).json(inbox)
    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def new_run(catalog: Catalog, inbox: str, lines: DataFrame, config: str = "{}", title: str = "") -> str:
    """Store the input, create the queued run and publish its job."""
    run_id = uuid.uuid4().hex
    catalog.put_lines(f"runs/{run_id}/input", lines)
    catalog.create_run(config, f"runs/{run_id}/input", run_id, title, total=lines.count())
    publish(catalog.spark, inbox, run_id)
    return run_id
