"""Catalog of runs, judge presets and samples as Parquet tables below one root.

A change writes a new version beside the old one and then creates the next numbered pointer file,
which no two writers can: the one that comes too late looks at the new version and decides again. So
readers always see a whole version, and a claim is won once.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "runs": "id string, status string, title string, description string, config string, input_key string, results_key string, error string, avg_accuracy double, progress_done int, progress_total int, claimed_by string, created_at timestamp, updated_at timestamp",
    "presets": "id string, name string, description string, config string, is_default boolean, created_at timestamp, updated_at timestamp",
    "samples": "id string, name string, description string, data_key string, case_count int, annotated_count int, label_mode string, criteria_json string, created_at timestamp, updated_at timestamp",
    "versions": "version int, applied_at timestamp",
}
#: Which states a run may leave for which.
MOVES = {"running": ("queued",), "completed": ("running",), "failed": ("queued", "running"), "cancelled": ("queued", "running")}


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointer(self, table: str) -> tuple[int, str | None]:
        """Number and version of the newest pointer that is written; (0, None) of a new table."""
        fs, folder = self._fs(f"{self.root}/{table}")
        if not fs.exists(folder):
            return 0, None
        found = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("current-")]
        for path in sorted(found, key=lambda p: p.getName(), reverse=True):
            stream = fs.open(path)
            version = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if version.endswith("\n"):
                return int(path.getName()[8:]), version.strip()
        return 0, None

    def _point(self, table: str, number: int, version: str) -> bool:
        """Create a pointer; False if another writer has created it."""
        fs, path = self._fs(f"{self.root}/{table}/current-{number:012d}")
        try:
            stream = fs.create(path, False)
        except Exception as e:  # the JVM's exceptions arrive wrapped
            if "exist" in str(e).lower():
                return False
            raise
        stream.write(bytearray(f"{version}\n".encode()))
        stream.close()
        return True

    def _read(self, name: str, version: str | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{version}")

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._pointer(name)[1])

    def _change(self, name: str, change, attempts: int = 20) -> bool:
        """Replace the rows by ``change(rows)``; False if that is None. Decided again when another writer was first."""
        for _ in range(attempts):
            number, version = self._pointer(name)
            rows = change(self._read(name, version))
            if rows is None:
                return False
            fresh = f"v-{uuid.uuid4().hex}"
            rows.coalesce(1).write.parquet(f"{self.root}/{name}/{fresh}")
            if self._point(name, number + 1, fresh):
                return True
        raise RuntimeError(f"{name}: {attempts} writers were first")

    def _add(self, name: str, row: tuple) -> None:
        """Add a row, in place of one with the same id."""
        new = self.spark.createDataFrame([row], SCHEMAS[name])
        self._change(name, lambda rows: rows.where(F.col(rows.columns[0]) != row[0]).unionByName(new))

    def migrate(self, latest: int = 4) -> list[int]:
        """Record the versions that aren't applied yet, in order."""
        new: list[int] = []

        def missing(rows: DataFrame) -> DataFrame | None:
            done = {r.version for r in rows.collect()}
            new[:] = [v for v in range(1, latest + 1) if v not in done]
            return rows.unionByName(self.spark.createDataFrame([(v, _now()) for v in new], SCHEMAS["versions"])) if new else None

        self._change("versions", missing)
        return new

    def put_lines(self, key: str, lines: DataFrame) -> None:
        lines.select("value").write.mode("overwrite").text(f"{self.root}/blobs/{key}")

    def get_lines(self, key: str) -> DataFrame | None:
        fs, p = self._fs(f"{self.root}/blobs/{key}")
        return self.spark.read.text(f"{self.root}/blobs/{key}") if fs.exists(p) else None

    # --- runs

    def create_run(self, config: str = "{}", input_key: str = "", run_id: str | None = None, title: str = "", description: str = "", total: int = 0) -> str:
        run_id = run_id or uuid.uuid4().hex
        row = (run_id, "queued", title, description, config, input_key or f"runs/{run_id}/input", None, None, None, 0, max(0, total), None, _now(), _now())
        self._add("runs", row)
        return run_id

    def run(self, run_id: str):
        return self.table("runs").where(F.col("id") == run_id).first()

    def recent_runs(self, limit: int = 50, search: str | None = None) -> DataFrame:
        """Newest first; ``search`` looks in title, description, id and the config's scenario."""
        rows = self.table("runs")
        if search:
            scenario = F.try_variant_get(F.try_parse_json("config"), "$.scenario_id", "string")
            hit = F.lit(False)
            for c in (F.col("title"), F.col("description"), F.col("id"), scenario):
                hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(search.lower()))
            rows = rows.where(hit)
        return rows.orderBy(F.col("created_at").desc()).limit(limit)

    def _move(self, run_id: str, states: tuple[str, ...], also=None, **changes) -> bool:
        """Change a run that is in one of the states (or meets ``also``); whether it was."""
        def moved(rows: DataFrame) -> DataFrame | None:
            now = rows.where(F.col("id") == run_id).first()
            if now is None or not (now.status in states or (also is not None and also(now))):
                return None
            new = {k: v(now) if callable(v) else v for k, v in changes.items()} | {"updated_at": _now()}
            types = dict(rows.dtypes)
            return rows.withColumns({c: F.when(F.col("id") == run_id, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in new.items()})

        return self._change("runs", moved)

    def claim(self, run_id: str, by: str = "") -> bool:
        """Take a queued run, or take up again one that ``by`` had claimed when it died."""
        return self._move(run_id, MOVES["running"], lambda r: bool(by) and r.status == "running" and r.claimed_by == by, status="running", claimed_by=by)

    def progress(self, run_id: str, done: int, total: int, accuracy: float | None) -> None:
        self._move(run_id, ("running",), progress_done=done, progress_total=total, avg_accuracy=accuracy)

    def complete(self, run_id: str, results_key: str, accuracy: float | None) -> bool:
        return self._move(run_id, MOVES["completed"], status="completed", results_key=results_key, avg_accuracy=accuracy, progress_done=lambda r: r.progress_total)

    def fail(self, run_id: str, error: str) -> bool:
        return self._move(run_id, MOVES["failed"], status="failed", error=error[:8000])

    def cancel(self, run_id: str) -> bool:
        return self._move(run_id, MOVES["cancelled"], status="cancelled")

    def attach_to_cancelled(self, run_id: str, results_key: str, accuracy: float | None, done: int, total: int) -> None:
        self._move(run_id, ("cancelled",), results_key=results_key, avg_accuracy=accuracy, progress_done=done, progress_total=total)

    # --- presets

    def save_preset(self, name: str, config: str, description: str = "", preset_id: str | None = None, is_default: bool = False) -> str:
        if not name.strip():
            raise ValueError("a preset needs a name")
        rows = self.table("presets")
        old = rows.where(F.col("id") == preset_id).first() if preset_id else None
        if preset_id and old is None:
            raise KeyError(preset_id)
        preset_id = preset_id or uuid.uuid4().hex
        row = (preset_id, name.strip(), description, config, is_default, old.created_at if old else _now(), _now())
        new = self.spark.createDataFrame([row], SCHEMAS["presets"])

        def saved(rows: DataFrame) -> DataFrame:
            rest = rows.where(F.col("id") != preset_id)
            return (rest.withColumn("is_default", F.lit(False)) if is_default else rest).unionByName(new)

        self._change("presets", saved)
        return preset_id

    def presets(self) -> DataFrame:
        return self.table("presets").orderBy(F.col("is_default").desc(), "name")

    def preset(self, preset_id: str):
        return self.table("presets").where(F.col("id") == preset_id).first()

    def default_preset(self):
        return self.table("presets").where("is_default").orderBy(F.col("updated_at").desc()).first()

    def delete(self, table: str, key: str) -> bool:
        """Delete a row and, of a sample, its cases."""
        row = self.table(table).where(F.col("id") == key).first()
        gone = self._change(table, lambda rows: None if rows.where(F.col("id") == key).isEmpty() else rows.where(F.col("id") != key))
        if gone and row is not None and "data_key" in row:
            fs, path = self._fs(f"{self.root}/blobs/{row.data_key}")
            fs.delete(path, True)
        return gone

    # --- samples

    def save_sample(self, name: str, lines: DataFrame, description: str = "", label_mode: str = "binary", criteria_json: str | None = None, annotated: int = 0, sample_id: str | None = None) -> str:
        if not name.strip():
            raise ValueError("a sample needs a name")
        n = lines.where(F.trim("value") != "").count()
        if not n:
            raise ValueError("a sample needs cases")
        old = self.table("samples").where(F.col("id") == sample_id).first() if sample_id else None
        sample_id = sample_id or uuid.uuid4().hex
        key = f"judge-samples/{sample_id}/data"
        self.put_lines(key, lines)
        row = (sample_id, name.strip(), description, key, n, annotated, label_mode, criteria_json, old.created_at if old else _now(), _now())
        self._add("samples", row)
        return sample_id

    def samples(self, limit: int = 100) -> DataFrame:
        return self.table("samples").orderBy(F.col("updated_at").desc()).limit(limit)

    def sample_by_name(self, name: str):
        return self.table("samples").where(F.col("name") == name.strip()).first()

    def sample_lines(self, sample_id: str) -> DataFrame | None:
        row = self.table("samples").where(F.col("id") == sample_id).first()
        return self.get_lines(row.data_key) if row else None
