"""The trace source against a local server of traces, and conversations that arrive in any split."""

import json
import threading
import urllib.parse
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from colloquy.operators import dedup
from colloquy.sources import traces
from colloquy.streaming import conversations

DAY = datetime(2024, 3, 1)


@pytest.fixture()
def server():
    """Pages of ``rows`` by user, name and time; every request is kept in ``asked``."""
    rows, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append(q)
            found = [r for r in rows if all(r[k] == q[k] for k in ("userId", "name") if k in q)]
            found = [r for r in found if q.get("fromTimestamp", "") <= r["timestamp"] < q.get("toTimestamp", "9")]
            found.sort(key=lambda r: (r["timestamp"], r["id"]), reverse=q.get("orderBy", "").endswith("desc"))
            n, page = int(q["limit"]), int(q["page"])
            body = json.dumps({"data": found[(page - 1) * n : page * n], "meta": {"totalPages": -(-len(found) // n)}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", rows, asked
    http.shutdown()


def trace(i):
    t = DAY + timedelta(minutes=i)
    return {"id": f"t{i:04}", "name": ("chat", "search")[i % 2], "userId": f"u{i % 5}", "timestamp": t.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "metadata": {"i": i}, "tags": ["x"]}


def test_filters_reach_the_request(spark, server):
    host, rows, asked = server
    rows += [trace(i) for i in range(200)]
    traces.register(spark)
    reader = spark.read.format("dialog_traces").option("host", host).option("limit", "20")
    plain = reader.load()
    source = reader.option("narrow", "true").load()
    low, high = "2024-03-01T01:00:00.000000Z", "2024-03-01T02:00:00.000000Z"
    got = source.where((F.col("userId") == "u3") & (F.col("name") == "search") & (F.col("timestamp") >= low) & (F.col("timestamp") < high))
    assert sorted(r.id for r in got.collect()) == [f"t{i:04}" for i in range(60, 120) if i % 5 == 3 and i % 2]
    assert all(q["userId"] == "u3" and q["name"] == "search" and q["page"] == "1" for q in asked)
    assert {(q["fromTimestamp"], q["toTimestamp"]) for q in asked} == {("2024-03-01T00:59:59.000000Z", "2024-03-01T02:00:01.000000Z")}
    del asked[:]
    # without the option nothing is narrowed, and a frame serves several queries
    assert plain.where(F.col("userId") == "u3").count() == 40
    assert plain.where(F.col("id").isin("t0001", "t0002") | (F.col("userId") == "u9")).count() == 2
    assert not any("userId" in q for q in asked) and {q["page"] for q in asked} == {str(p) for p in range(1, 11)}


def test_a_given_option_and_odd_times(spark):
    given = {"userId": "a", "fromTimestamp": "2024-03-02T00:00:00Z"}
    E, G, L = traces.EqualTo, traces.GreaterThan, traces.LessThan
    assert traces.narrowed(given, [E(("userId",), "b"), G(("timestamp",), "2024-03-01T00:00:00Z"), G(("timestamp",), "soon"), L(("timestamp",), "2024")]) == given
    assert traces.narrowed({}, [E(("userId", "x"), "b"), E(("tags",), "b"), E(("name",), None)]) == {}
    assert traces.narrowed({"what": "observations"}, [E(("type",), "TOOL"), L(("startTime",), "2024-03-01T00:00:00+02:00")]) == {"what": "observations", "type": "TOOL", "toStartTime": "2024-02-29T22:00:01.000000Z"}


def test_a_stream_reads_no_page_twice(spark, server, tmp_path):
    host, rows, asked = server
    rows += [trace(i) for i in range(70)]
    traces.register(spark)

    def run():
        source = spark.readStream.format("dialog_traces").option("host", host).option("limit", "20").load()
        q = source.select("id").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [f"t{i:04}" for i in range(70)]
    del asked[:]
    assert len(run()) == 70 and not [q for q in asked if q["limit"] == "20"]  # a restart with nothing new
    rows += [trace(i) for i in range(70, 95)]
    assert run() == [f"t{i:04}" for i in range(95)]
    assert {q["fromTimestamp"] for q in asked if q["limit"] == "20"} == {"2024-03-01T01:09:00.000001Z"}


@pytest.mark.parametrize("files", (1, 5))
def test_late_cases_end_in_the_rows_of_the_batch(spark, tmp_path, files):
    rows = [(i, f"c{i * 7 % 11}" if i % 9 else None, i * 13 % 6, None if i % 4 == 0 else f"2024-03-01 00:{i * 17 % 60:02}", DAY + timedelta(minutes=i * 29 % 97)) for i in range(120)]
    cases = spark.createDataFrame(rows, "row_idx long, conv_key string, hist_len int, ts string, event_time timestamp")
    cases.repartition(files, "row_idx").write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(cases.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    conversations.write_better(arriving, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    written = spark.read.parquet(f"{tmp_path}/out")
    told = sorted(r.row_idx for r in conversations.settled(written).collect())
    assert told == sorted(r.row_idx for r in dedup.by_conversation(cases).collect())
    assert written.where("conv_key is not null").count() < 106


def test_a_conversation_is_forgotten_after_its_horizon(spark, tmp_path):
    schema = "row_idx long, conv_key string, hist_len int, ts string, event_time timestamp"
    batches = [[(1, "a", 9, "x", DAY)], [(2, "b", 1, "x", DAY + timedelta(days=3))], [(3, "b", 1, "y", DAY + timedelta(days=6))], [(4, "a", 2, "x", DAY + timedelta(days=6))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        conversations.write_better(arriving, f"{tmp_path}/out", f"{tmp_path}/cp", "1 day").awaitTermination()
    got = [r.row_idx for r in spark.read.parquet(f"{tmp_path}/out").orderBy("row_idx").collect()]
    assert got == [1, 2, 3, 4]  # the short case of a comes after its horizon, so it counts as new


def test_conversations_share_states(spark, tmp_path, monkeypatch):
    """Four buckets for fifty conversations: what goes out is what each conversation alone would send, and only the silent ones are forgotten."""
    monkeypatch.setattr(conversations, "BUCKETS", 4)
    schema = "row_idx long, conv_key string, hist_len int, ts string, event_time timestamp"
    at = lambda day: DAY + timedelta(days=day)
    batches = [
        [(k, f"c{k}", 5, "x", at(0)) for k in range(50)] + [(100, "c7", 6, "x", at(0)), (101, "c8", 4, "x", at(0))],
        [(200 + k, f"c{k}", 5 + k % 2, "a", at(1)) for k in range(40)],
        [(300, "new", 1, "x", at(3.5))],
        [(400 + k, f"c{k}", 1, "x", at(3)) for k in range(38, 42)],
        [(500, "new", 0, "x", at(3)), (501, "c41", 2, "x", at(3))],
    ]
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = conversations.write_better(arriving, f"{tmp_path}/out", f"{tmp_path}/cp", "36 hours")
        query.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert max(states) <= 4
        sent = {r.row_idx for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        out.append(sorted(sent - {i for s in out for i in s}))
    assert out[0] == [k for k in range(50) if k != 7] + [100]
    assert out[1] == [200 + k for k in range(40) if k % 2 and k != 7]  # of equal length 6, "x" beats "a" for c7
    assert out[2] == [300]
    assert out[3] == [440, 441]  # c40 and c41 were silent for 36 hours; c38 and c39 weren't
    assert out[4] == [501]
