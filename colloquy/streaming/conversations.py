"""Conversation dedupe of cases that arrive late, as a stateful stream.

What is kept of a conversation is the place of its best case: length of the history, time, order. A
case goes out when it beats that, so the last one that went out for a conversation is the one that
``operators.dedup.by_conversation`` keeps, however the cases were split into batches.

Conversations are dealt over ``BUCKETS`` states by a hash of their key, since a call of Python per
conversation costs milliseconds and a case that it takes costs microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import by_conversation

#: A checkpoint stays with the number that it was begun with.
BUCKETS = 1024
#: The conversations of a bucket as an Arrow stream of ``_HELD``.
STATE = "held binary"
#: Key, place of the best case so far (times compare as texts, as in the batch form) and when it is forgotten, in ms of event time.
_HELD = pa.schema([("key", pa.string()), ("hist_len", pa.int64()), ("ts", pa.string()), ("o", pa.int64()), ("until", pa.int64())])


def _packed(held: dict[str, tuple]) -> bytes:
    columns = zip(*((k, *v) for k, v in held.items()))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _HELD)], schema=_HELD))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, tuple]:
    key, *rest = (c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns)
    return dict(zip(key, zip(*rest)))


def _better(horizon_ms: int, order: str):
    def task(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(bytes(state.get[0])) if state.exists else {}
        now, touched, parts, won = state.getCurrentWatermarkMs(), set(), [], {}
        for rows in () if state.hasTimedOut else batches:
            here: dict[str, int] = {}
            columns = (rows["conv_key"], rows["hist_len"], rows["ts"].fillna(""), rows[order], rows["at_ms"])
            for n, (key, length, ts, o, at) in enumerate(zip(*(c.tolist() for c in columns))):
                old, until = held.get(key), max(at, now) + horizon_ms
                touched.add(key)
                if old is None or (length, ts, o) > old[:3]:
                    here[key] = n
                    held[key] = (length, ts, o, max(until, old[3]) if old else until)
                elif until > old[3]:
                    held[key] = (*old[:3], until)
            won |= dict.fromkeys(here, len(parts))
            if here:
                parts.append((list(here), rows.iloc[list(here.values())]))
        # those without a case in this batch are forgotten when the watermark has passed their time
        held = {k: v for k, v in held.items() if v[3] >= now or k in touched}
        if held:
            state.update((_packed(held),))
            state.setTimeoutTimestamp(max(now, min(v[3] for v in held.values())))
        elif state.exists:
            state.remove()
        for p, (keys, rows) in enumerate(parts):
            rows = rows[[won[k] == p for k in keys]].drop(columns=["at_ms", "bucket"])
            if len(rows):
                yield rows

    return task


def better_cases(cases: DataFrame, horizon: str = "7 days", order: str = "row_idx") -> DataFrame:
    """Rows of the stream ``cases`` that beat what their conversation had, with all their columns; update mode.

    ``cases`` has conv_key, hist_len, ts (text, may be null), ``order`` (whole number, unique) and
    event_time (timestamp, not null). Of a batch only the best row of a conversation goes out. A
    conversation without a case for ``horizon`` of event time is forgotten: a case after that goes
    out as its first. Cases that are older than the newest by more than ``horizon`` are dropped as
    too late. Rows without a key all go out, with no state.
    """
    spark = cases.sparkSession
    ms = int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00 UTC' + interval {horizon}) AS ms").first().ms)
    has_key = F.coalesce(F.col("conv_key"), F.lit("")) != ""
    keyed = cases.where(has_key).withColumn("hist_len", F.col("hist_len").cast("long")).withColumn(order, F.col(order).cast("long"))
    dealt = keyed.withColumn("at_ms", F.unix_millis("event_time")).withColumn("bucket", F.pmod(F.xxhash64("conv_key"), F.lit(BUCKETS)))
    best = dealt.withWatermark("event_time", horizon).groupBy("bucket").applyInPandasWithState(_better(ms, order), keyed.schema, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    rest = cases.where(~has_key).withColumn("hist_len", F.col("hist_len").cast("long")).withColumn(order, F.col(order).cast("long"))
    return best.unionByName(rest)


def write_better(cases: DataFrame, path: str, checkpoint: str, horizon: str = "7 days", order: str = "row_idx") -> StreamingQuery:
    """Run ``better_cases`` until the input is used up; each batch is a folder below ``path``, so a repeated one replaces itself."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return better_cases(cases, horizon, order).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(written: DataFrame, order: str = "row_idx") -> DataFrame:
    """The case that stands for each conversation among all that went out."""
    return by_conversation(written, order)
