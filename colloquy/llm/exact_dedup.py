"""Exact dedup through a log-structured merge index.

The index lives in hash shards of the digest space, so any number of tasks builds it at once:

1. every task digests its documents into a memtable, which joins equal texts after comparing
   their bytes, and flushes it as a run of one entry per text (smallest identifier, count);
2. the entries, not the texts, are dealt by digest; a shard takes them through memtables into
   sorted runs with a Bloom filter each, and compaction merges the runs, keeping the smallest
   identifier and adding the counts. A shard that holds ``shard_entries`` writes its merged run out
   and starts afresh; a last compaction, an aggregation by digest that spills, merges what shards
   wrote, so a worker's memory has a bound whatever the data;
3. a digest that stands in more than one run is a hit. The texts of hits are read again (a bitmap
   of fixed size picks them) and compared byte for byte with the text that stays, in two rounds:
   within a salt first, so that no digest gathers in one task. Texts that share a digest but not
   their bytes are regrouped by the text itself.

A group of any size sends one entry per run into a shuffle, never its members; these learn what
became of their text from the entry of their own run.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, checked_broadcast, column_of, id_bitmap, materialise, partitions, pick, positional, small_batches

_TO_SPACE = bytes(32 if c in (32, 9, 10, 11, 12, 13) else c for c in range(256))
_SPACES = re.compile(b" {2,}")
_RUN_SCHEMA = "doc_id long, run long, seq long, first_seq long, digest binary, n long, first_id long"
_INDEX_SCHEMA = "digest binary, none boolean, keep_id long, keep_run long, keep_seq long, group_size long, runs long"


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each run of white space turned into one space; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE)
    return _SPACES.sub(b" ", raw) if b"  " in raw else raw


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _runs(digest, memtable_bytes: int):
    """Task: documents -> one row each, naming the entry of its run that holds the same text."""

    def flush(rows, counts, run):
        cols = list(zip(*rows)) if rows else [()] * 4
        ids, seqs, firsts, digests = cols
        n = [counts[s] if s == f else None for s, f in zip(seqs, firsts)]
        by_seq = dict(zip(seqs, ids))
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([run] * len(ids), pa.int64()), pa.array(seqs, pa.int64()), pa.array(firsts, pa.int64()), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array([by_seq[f] for f in firsts], pa.int64())],
            names=["doc_id", "run", "seq", "first_seq", "digest", "n", "first_id"],
        )

    def task(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        rows, table, counts, size, seq, runs = [], {}, {}, 0, 0, 0

        def ended():
            # the smallest identifier stands for its text; null comes after every number
            best = {}
            for doc_id, s, key, _ in rows:
                now = (doc_id is None, doc_id or 0, s)
                if key not in best or now < best[key]:
                    best[key] = now
            return flush([(d, s, best[k][2], g) for d, s, k, g in rows], {best[k][2]: c for k, c in counts.items()}, part | runs)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text in zip(ids, texts):
                data = normalise(text)
                d = digest(data)
                held = table.setdefault(d, [])
                for key, other in held:  # a hit in the memtable: the bytes decide
                    if other == data:
                        break
                else:
                    key = (d, len(held))
                    held.append((key, data))
                    size += len(data) + 200
                counts[key] = counts.get(key, 0) + 1
                rows.append((doc_id, seq, key, d))
                seq += 1
                size += 100
                if size > memtable_bytes:
                    yield ended()
                    rows, table, counts, size, runs = [], {}, {}, 0, runs + 1
        if rows:
            yield ended()

    return task


class SortedRun:
    """An immutable sorted run of fixed-width digests with its Bloom filter."""

    def __init__(self, digests: np.ndarray, values: list):
        order = np.argsort(digests, kind="stable")
        self.digests, self.values = digests[order], [values[i] for i in order]
        self.bits = max(64, 1 << int(np.ceil(np.log2(len(values) * 10 + 1))))
        self.filter = np.zeros(self.bits, bool)
        for h in self._slots(self.digests):
            self.filter[h] = True

    def _slots(self, digests: np.ndarray):
        raw = np.zeros((len(digests), 16), np.uint8)
        given = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), -1)[:, :16]
        raw[:, : given.shape[1]] = given
        raw = raw.view(np.uint64)
        a, b = raw[:, 0], raw[:, 1] | np.uint64(1)
        return [((a + np.uint64(i) * b) % np.uint64(self.bits)).astype(np.int64) for i in range(4)]

    def probe(self, digests: np.ndarray) -> np.ndarray:
        """Position of each digest, or -1; only digests that pass the filter are searched."""
        out = np.full(len(digests), -1)
        if not len(digests):
            return out
        may = np.logical_and.reduce([self.filter[h] for h in self._slots(digests)])
        if may.any():
            at = np.minimum(np.searchsorted(self.digests, digests[may]), len(self.digests) - 1)
            out[may] = np.where(self.digests[at] == digests[may], at, -1)
        return out


def _merge(a: tuple, b: tuple) -> tuple:
    """Two entries of a digest: the smallest identifier stays, the counts add up."""
    return (*min(a[:4], b[:4]), a[4] + b[4], a[5] + b[5])


class MergeIndex:
    """Memtable, sorted runs, compaction. An entry is (no id, id, run, seq, documents, runs)."""

    def __init__(self, memtable: int = 50_000, fanout: int = 8):
        self.most, self.fanout, self.table, self.runs = memtable, fanout, {}, []

    def put(self, digest: bytes, entry: tuple) -> None:
        held = self.table.get(digest)
        self.table[digest] = _merge(held, entry) if held else entry
        if len(self.table) >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.table:
            digests = _fixed(self.table)
            values = list(self.table.values())
            for run in self.runs:  # hits go to the run that has them, so a digest stands in one run
                at = run.probe(digests)
                for i in np.flatnonzero(at >= 0):
                    run.values[at[i]] = _merge(run.values[at[i]], values[i])
                fresh = np.flatnonzero(at < 0)
                digests, values = digests[fresh], [values[i] for i in fresh]
            if len(values):
                self.runs.append(SortedRun(digests, values))
            self.table = {}
            if len(self.runs) >= self.fanout:
                self.compact()

    def compact(self) -> None:
        if len(self.runs) > 1:
            self.runs = [SortedRun(np.concatenate([r.digests for r in self.runs]), [v for r in self.runs for v in r.values])]

    def __len__(self) -> int:
        return len(self.table) + sum(len(r.values) for r in self.runs)

    def entries(self):
        """All entries in the order of their digests; the index is empty afterwards."""
        self.flush()
        self.compact()
        runs, self.runs = self.runs, []
        for run in runs:
            yield from zip(run.digests.tolist(), run.values)


def _fixed(table) -> np.ndarray:
    """Digests as fixed-width keys; the hex form keeps trailing zero bytes."""
    return np.array([k.hex().encode() for k in table])


def _index(memtable: int, most: int):
    def written(index):
        entries = index.entries()
        while part := list(itertools.islice(entries, 20_000)):
            yield pa.record_batch(
                [pa.array([bytes.fromhex(d.decode()) for d, _ in part], pa.binary()), pa.array([v[0] for _, v in part]), *(pa.array([v[k] for _, v in part], pa.int64()) for k in range(1, 6))],
                names=["digest", "none", "keep_id", "keep_run", "keep_seq", "group_size", "runs"],
            )

    def task(batches):
        index = MergeIndex(memtable)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for d, doc_id, run, seq, n in zip(*cols):
                index.put(d, (doc_id is None, doc_id or 0, run, seq, n, 1))
            if len(index) > most:
                yield from written(index)
        yield from written(index)

    return task


def _hits(digest, bitmap: np.ndarray, memtable_bytes: int):
    """Task: the texts whose digest may stand in several runs, each once."""

    def task(batches):
        seen, size = set(), 0
        for batch in batches:
            got = []
            for text in batch.column(0).to_pylist():
                data = normalise(text)
                d = digest(data)
                slot = int.from_bytes(d[:7], "big") % (bitmap.size << 6)
                if int(bitmap[slot >> 6]) >> (slot & 63) & 1 and (d, data) not in seen:
                    if size > memtable_bytes:
                        seen, size = set(), 0
                    seen.add((d, data))
                    size += len(data) + 200
                    got.append((d, data))
            yield pa.record_batch([pa.array([d for d, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())], names=["digest", "data"])

    return task


def _verify(batches):
    """Task over rows ordered by digest: each distinct text of a digest once, compared by its bytes."""
    last, held = None, set()
    for batch in batches:
        got = []
        for d, data in zip(batch.column("digest").to_pylist(), batch.column("data").to_pylist()):
            if d != last:
                last, held = d, set()
            if data not in held:
                held.add(data)
                got.append((d, data))
        yield pa.record_batch([pa.array([d for d, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())], names=["digest", "data"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, memtable_bytes: int = 32 << 20, memtable_entries: int = 50_000, shard_entries: int = 400_000) -> DataFrame:
    """One row per document: doc_id, run, seq, keep_id, group_size, kept, digest.

    Texts are equal when identical after each run of white space became one space; null counts as
    empty, so null and empty texts form one group. The row with the smallest id stays; a null id
    comes after all numbers; of rows that tie, exactly one stays. An empty table gives no rows.
    Other columns of ``docs`` are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    rows = materialise(src.mapInArrow(_runs(digest, memtable_bytes), _RUN_SCHEMA), "dedup-runs")
    entries = rows.where(F.col("n").isNotNull()).select("digest", "doc_id", "run", "seq", "n")
    shards = entries.repartition(partitions(spark), "digest").mapInArrow(_index(memtable_entries, shard_entries), _INDEX_SCHEMA)
    merged = shards.groupBy("digest").agg(F.min(F.struct("none", "keep_id", "keep_run", "keep_seq")).alias("k"), F.sum("group_size").alias("group_size"), F.sum("runs").alias("runs"))
    index = materialise(merged.select("digest", F.when(~F.col("k.none"), F.col("k.keep_id")).alias("keep_id"), "k.keep_run", "k.keep_seq", "group_size", "runs"), "dedup-index")

    several = index.where("runs > 1").select("digest")
    slot = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    bitmap = id_bitmap(several.select(slot.alias("slot")), "slot")
    torn = None
    if bitmap.any():
        texts = src.select("text").mapInArrow(_hits(digest, bitmap, memtable_bytes), "digest binary, data binary")
        n = partitions(spark)
        once = texts.withColumn("salt", (F.rand(7) * 16).cast("int")).repartition(n, "digest", "salt").sortWithinPartitions("salt", "digest").select("digest", "data").mapInArrow(_verify, "digest binary, data binary")
        twice = once.repartition(n, "digest").sortWithinPartitions("digest").mapInArrow(_verify, "digest binary, data binary")
        torn = materialise(twice.groupBy("digest").count().where("count > 1").select("digest"), "dedup-torn")
        torn = None if torn.isEmpty() else torn
    # a run's entries look the index up, one for each text; the run's rows then look their entry up
    told = rows.where(F.col("n").isNotNull()).select("run", "first_seq", "digest").join(index.drop("runs"), "digest")
    told = materialise(told.drop("digest"), "dedup-told")
    same = rows.select("doc_id", "run", "seq", "first_seq", "digest").join(told, ["run", "first_seq"])
    if torn is None:
        return _decided(same)
    # a digest that several texts share: the text itself is the key
    whole = _decided(same.join(torn, "digest", "left_anti"))
    tagged = src.withColumn("data", F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE_CLASS}+", " ")).select("doc_id", "data")
    parted = tagged.groupBy("data").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    hashed = tagged.join(parted, "data").mapInArrow(_with_digest(digest), "doc_id long, keep_id long, group_size long, digest binary").join(torn, "digest", "left_semi")
    own = hashed.select("doc_id", F.lit(None).cast("long").alias("run"), F.lit(None).cast("long").alias("seq"), "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "digest")
    return whole.unionByName(own)


def _with_digest(digest):
    def task(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).select(["doc_id", "keep_id", "group_size"])
            yield t.append_column("digest", pa.array([digest(x.encode()) for x in batch.column("data").to_pylist()], pa.binary())).to_batches()[0] if batch.num_rows else pa.record_batch([pa.array([], pa.int64())] * 3 + [pa.array([], pa.binary())], names=["doc_id", "keep_id", "group_size", "digest"])

    return task


def _decided(joined: DataFrame) -> DataFrame:
    kept = (F.col("run") == F.col("keep_run")) & (F.col("seq") == F.col("keep_seq"))
    return joined.select("doc_id", "run", "seq", "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rules as in ``exact_groups``: null texts count as empty, the smallest id stays, and of rows
    that tie on id and text one stays.
    """
    decided = exact_groups(docs, id_col, text_col).where("not kept")
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = materialise(decided.select("doc_id", "digest", same_id.alias("tie")).distinct(), "dedup-gone")
    inner, names = positional(docs)
    text = F.regexp_replace(F.coalesce(F.col(column_of(names, text_col)), F.lit("")), f"{SPACE_CLASS}+", " ")
    keyed = inner.withColumn("own_id", F.col(column_of(names, id_col)).cast("long")).withColumn("own_digest", F.unhex(F.sha2(text.cast("binary"), 256)))
    on = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_digest") == F.col("digest"))
    lost, tied = checked_broadcast(gone.where("not tie")), checked_broadcast(gone.where("tie"))
    out = keyed.join(lost, on, "left_anti")
    if not tied.isEmpty():
        one = out.join(tied, on, "left_semi").dropDuplicates(["own_id", "own_digest"])
        out = out.join(tied, on, "left_anti").unionByName(one)
    return out.select(*inner.columns).toDF(*docs.columns)
