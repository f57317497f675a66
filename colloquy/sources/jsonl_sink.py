"""A JSONL writer with a commit: tasks count, digest and tally what they write, so no second pass does.

A task writes its lines to one file of a staging folder and returns the file's name, rows, bytes and
digest as its commit message. The job's commit moves the files of the tasks that counted into the
target, writes a manifest with a row per file, and drops the staging folder; so what failed, repeated
or speculative attempts left behind goes too, and an aborted job leaves nothing. A driver that dies
leaves a staging folder, which scans don't see.

    part-00000-<job>.jsonl    the lines
    _commits/<job>.json       a row per file: job, file, rows, bytes, digest
    _tallies/<job>/           counts of the levels of the tallied columns, one small file per task
    _staging-<job>/           while a job runs

The digest is the number of lines and the sum of their crc32, so a scan can repeat it in any split
(``damaged``). Tallies are kept in memory up to a bound and go to the task's tally file beyond it;
Spark adds them up (``tallies``). Paths are those of pyarrow's file systems (file, hdfs, s3, gs); on
an object store a move is a copy there. Overwriting removes the earlier files after the new ones are
in place: a scan at that moment sees both, as with any folder of plain files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "job string, file string, rows long, bytes long, digest long"


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote; no file where it had no rows."""

    file: str | None
    rows: int
    bytes: int
    digest: int
    tally: str | None


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _children(store, folder: str) -> list:
    from pyarrow import fs

    return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))


class CommitSink(DataSource):
    """Options: path; prefix of the files (part); levels that a task's tally holds in memory (100000).

    The first column holds the lines, the others are tallied together. An append adds files, an
    overwrite replaces all that earlier jobs wrote.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_commit"

    def writer(self, schema, overwrite: bool):
        return CommitWriter(self.options["path"], self.options.get("prefix", "part"), int(self.options.get("levels", 100_000)), overwrite)


class CommitWriter(DataSourceArrowWriter):
    def __init__(self, path: str, prefix: str, levels: int, overwrite: bool):
        self.path, self.prefix, self.levels, self.overwrite = path.rstrip("/"), prefix, levels, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, base = _filesystem(self.path)
        staging = f"{base}/_staging-{self.job}"
        store.create_dir(staging, recursive=True)
        task = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        rows = size = digest = 0
        counts, out, tally = Counter(), None, None

        def flush():
            nonlocal tally
            if counts:
                tally = tally or store.open_output_stream(f"{staging}/tally-{task}")
                tally.write("".join(json.dumps({"levels": k, "n": n}, ensure_ascii=False) + "\n" for k, n in counts.items()).encode())
                counts.clear()

        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                lines = [x.encode() for x in batch.column(0).to_pylist()]
                out = out or store.open_output_stream(f"{staging}/data-{task}")
                chunk = b"\n".join(lines) + b"\n"
                out.write(chunk)
                rows, size, digest = rows + len(lines), size + len(chunk), digest + sum(map(zlib.crc32, lines))
                if batch.num_columns > 1:
                    counts.update(zip(*(c.to_pylist() for c in batch.columns[1:])))
                    if len(counts) > self.levels:
                        flush()
            flush()
        finally:
            for stream in (out, tally):
                if stream:
                    stream.close()
        return Written(task if out else None, rows, size, digest, task if tally else None)

    def commit(self, messages) -> None:
        store, base = _filesystem(self.path)
        staging = f"{base}/_staging-{self.job}"
        told = [m for m in messages if m]
        here = [x for x in _children(store, base) if not x.base_name.startswith("_staging-")]
        kept = ("_commits", "_tallies")  # folders whose contents are replaced
        earlier = [x.path for x in here if x.base_name not in kept] + [y.path for x in here if x.base_name in kept for y in _children(store, x.path)]
        for folder in ("_commits", f"_tallies/{self.job}"):
            store.create_dir(f"{base}/{folder}", recursive=True)
        names = {m.file: f"{self.prefix}-{m.file.split('-')[0]}-{self.job}.jsonl" for m in told if m.file}
        moves = [(f"{staging}/tally-{m.tally}", f"{base}/_tallies/{self.job}/{m.tally}.json") for m in told if m.tally]
        moves += [(f"{staging}/data-{file}", f"{base}/{name}") for file, name in names.items()]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: store.move(*m), moves))
        with store.open_output_stream(f"{base}/_commits/{self.job}.json") as out:
            for m in told:
                if m.file:
                    out.write((json.dumps({"job": self.job, "file": names[m.file], "rows": m.rows, "bytes": m.bytes, "digest": m.digest}) + "\n").encode())
        if self.overwrite:
            for path in earlier:
                self._drop(store, path)
        self._drop(store, staging)

    def abort(self, messages) -> None:
        store, base = _filesystem(self.path)
        self._drop(store, f"{base}/_staging-{self.job}")

    @staticmethod
    def _drop(store, path: str) -> None:
        info = store.get_file_info(path)
        if info.is_file:
            store.delete_file(path)
        elif info.type.name == "Directory":
            store.delete_dir(path)


def json_line() -> Column:
    """The row as compact JSON with null fields kept."""
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def save(rows: DataFrame, path: str, tally: dict[str, Column] | None = None, mode: str = "overwrite", prefix: str = "part", **options) -> None:
    """Write ``rows`` as JSON lines; ``tally`` names columns whose combinations are counted on the way."""
    levels = [c.cast("string").alias(f"_{n}") for n, c in (tally or {}).items()]
    save_lines(rows.select(json_line().alias("value"), *levels), path, mode, prefix, **options)


def save_lines(lines: DataFrame, path: str, mode: str = "overwrite", prefix: str = "part", **options) -> None:
    """Write finished lines, the first column; the others are tallied."""
    lines.sparkSession.dataSource.register(CommitSink)
    lines.write.format("jsonl_commit").mode(mode).options(path=path, prefix=prefix, **options).save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """job, file, rows, bytes, digest of every file that a commit put in place."""
    return spark.read.schema(MANIFEST).json(f"{path}/_commits")


def tallies(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The tallied columns by ``names`` and n, over all tasks and jobs."""
    rows = spark.read.schema("levels array<string>, n long").option("recursiveFileLookup", "true").json(f"{path}/_tallies")
    rows = rows.select(*(F.col("levels")[i].alias(c) for i, c in enumerate(names)), "n")
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, found_rows of files whose lines aren't those of their commit: lost, cut, changed or foreign ones."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    found = lines.groupBy("file").agg(F.count("*").alias("found_rows"), F.sum(F.crc32(F.encode("value", "utf-8"))).alias("found"))
    both = manifest(spark, path).join(found, "file", "full")
    return both.where(~(F.col("rows").eqNullSafe(F.col("found_rows")) & F.col("digest").eqNullSafe(F.col("found")))).select("file", "rows", "found_rows")


def save_with_report(records: DataFrame, path: str, label: Column, field: Column, width: int = 80) -> None:
    """Records and, after them, counts by label, by field and by both as comment lines that the scans skip.

    The records are read once: the report comes from the tallies of the tasks that wrote them. An
    empty label shows as such, fields are cut to ``width`` characters, and each part is ordered by
    count, most first, then by name. The report's files sort behind those of the records.
    """
    spark = records.sparkSession
    save(records, path, {"field": F.substring(F.coalesce(field, F.lit("")), 1, width), "label": F.coalesce(label, F.lit(""))})
    counts = tallies(spark, path, ["field", "label"])
    total = manifest(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("string").alias("rows"))
    shown = F.when(F.col("label") == "", F.lit("(пусто)")).otherwise(F.col("label"))
    n = F.col("n").cast("string")

    def part(place: int, title: str, keys: list[str], *cells: Column) -> DataFrame:
        rows = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
        order = [F.lit(place).alias("p"), (-F.col("n")).alias("o"), F.struct(*(F.lower(k) for k in keys), *keys).cast("string").alias("k")]
        head = spark.range(1).select(F.lit(place).alias("p"), F.lit(None).cast("long").alias("o"), F.lit("").alias("k"), F.lit(title).alias("line"))
        return head.unionByName(rows.select(*order, F.concat_ws("\t", *cells).alias("line")))

    head = total.select(F.lit(0).alias("p"), F.lit(None).cast("long").alias("o"), F.lit("").alias("k"), F.concat(F.lit("records: "), "rows").alias("line"))
    report = head.unionByName(part(1, "by label", ["label"], n, shown)).unionByName(part(2, "by field", ["field"], n, F.col("field")))
    report = report.unionByName(part(3, "by field and label", ["field", "label"], n, F.col("field"), shown))
    clean = F.regexp_replace("line", r"[\r\n]+", " ")
    notes = report.orderBy("p", F.col("o").asc_nulls_first(), "k").select(F.concat(F.lit("# "), clean).alias("value"))
    save_lines(notes, path, "append", "report")
