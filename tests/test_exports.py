"""The writer with a commit, and marks of many terms."""

import json
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy.functions import highlight
from colloquy.sources import jsonl, jsonl_sink


def rows_of(spark, n, parts=3):
    level = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("ж\n"), (F.col("id") % 3).cast("string")))
    return spark.range(0, n, 1, parts).select("id", level.alias("level"))


def visible(folder):
    return sorted(p.name for p in Path(folder).iterdir() if not p.name.startswith("_"))


def staged(folder):
    return [p.name for p in Path(folder).iterdir() if p.name.startswith("_staging")]


@pytest.mark.parametrize("levels", [1, 100])
def test_tasks_count_what_they_write(spark, tmp_path, levels):
    path = f"file://{tmp_path}/out"
    jsonl_sink.save(rows_of(spark, 50), path, {"a": F.col("level"), "odd": F.col("id") % 2}, levels=levels)
    told = jsonl_sink.manifest(spark, path).collect()
    files = {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*.jsonl")}
    assert {r.file for r in told} == set(files) and sum(r.rows for r in told) == 50
    for r in told:
        lines = files[r.file].split(b"\n")[:-1]
        assert (r.rows, r.bytes, r.digest) == (len(lines), len(files[r.file]), sum(map(zlib.crc32, lines)))
    objects = [json.loads(x) for f in files.values() for x in f.decode().split("\n") if x]
    assert sorted(o["id"] for o in objects) == list(range(50)) and all("level" in o for o in objects)
    want = {}
    for o in objects:
        key = (o["level"], str(o["id"] % 2))
        want[key] = want.get(key, 0) + 1
    assert {(r.a, r.odd): r.n for r in jsonl_sink.tallies(spark, path, ["a", "odd"]).collect()} == want
    assert jsonl_sink.damaged(spark, path).isEmpty() and not staged(tmp_path / "out")


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    jsonl_sink.save(rows_of(spark, 20), path)
    before = visible(tmp_path / "out")
    broken = rows_of(spark, 30).select(F.when(F.col("id") == 25, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        jsonl_sink.save(broken, path)
    assert visible(tmp_path / "out") == before and jsonl_sink.damaged(spark, path).isEmpty()
    assert jsonl.strict(jsonl.numbered_lines(spark, path)).count() == 20
    with pytest.raises(Exception, match="no"):
        jsonl_sink.save(broken, f"file://{tmp_path}/new")
    assert not (tmp_path / "new").exists() or not visible(tmp_path / "new")


def test_append_overwrite_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    for _ in range(2):
        jsonl_sink.save(rows_of(spark, 10), path, {"a": F.col("level")}, mode="append")
    assert spark.read.text(path).count() == 20
    assert jsonl_sink.tallies(spark, path, ["a"]).agg(F.sum("n")).first()[0] == 20
    jsonl_sink.save(rows_of(spark, 7), path, {"a": F.col("level")})
    assert spark.read.text(path).count() == 7 and jsonl_sink.damaged(spark, path).isEmpty()
    assert jsonl_sink.tallies(spark, path, ["a"]).agg(F.sum("n")).first()[0] == 7
    jsonl_sink.save(rows_of(spark, 0), path)
    assert spark.read.text(path).isEmpty() and jsonl_sink.manifest(spark, path).isEmpty() and jsonl_sink.damaged(spark, path).isEmpty()


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    jsonl_sink.save(rows_of(spark, 30), path)
    cut, changed, gone = sorted((tmp_path / "out").glob("*.jsonl"))
    cut.write_bytes(b"\n".join(cut.read_bytes().split(b"\n")[:-2]) + b"\n")
    changed.write_bytes(changed.read_bytes().replace(b'"id":1', b'"id":3', 1))
    gone.unlink()
    (tmp_path / "out" / "foreign.jsonl").write_text("{}\n")
    got = {r.file: (r.rows, r.found_rows) for r in jsonl_sink.damaged(spark, path).collect()}
    assert got == {cut.name: (10, 9), changed.name: (10, 10), gone.name: (10, None), "foreign.jsonl": (None, 1)}


def test_report_follows_the_records(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(1, "a", "x\ty"), (2, None, "B\nc"), (3, "a", None), (4, "b", "B\nc")], "id int, label string, field string")
    jsonl_sink.save_with_report(df, path, F.col("label"), F.col("field"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.jsonl")))
    body, notes = text.split("# ", 1)
    assert [json.loads(x)["id"] for x in body.splitlines()] == [1, 2, 3, 4]
    assert ("# " + notes).splitlines() == [
        "# records: 4", "# by label", "# 2\ta", "# 1\t(пусто)", "# 1\tb", "# by field", "# 2\tB c", "# 1\t", "# 1\tx\ty",
        "# by field and label", "# 1\t\ta", "# 1\tB c\t(пусто)", "# 1\tB c\tb", "# 1\tx\ty\ta",
    ]
    assert sorted(r.i for r in jsonl.strict(jsonl.numbered_lines(spark, path)).select(F.try_variant_get("obj", "$.id", "int").alias("i")).collect()) == [1, 2, 3, 4]


def by_regex(text, terms):
    clean = sorted({t.strip() for t in terms if t and t.strip()}, key=lambda t: (-len(t), t))
    kept = []
    for t in clean:
        if not any(t.lower() in k.lower() for k in kept):
            kept.append(t)
    return [m.span() for m in re.finditer("|".join(map(re.escape, kept)), text, re.I)] if kept else []


@pytest.mark.parametrize("seed", range(4))
def test_spans_against_an_alternation(seed):
    rnd = random.Random(seed)
    for _ in range(200):
        word = lambda n: "".join(rnd.choice("abAжЖ \\.") for _ in range(rnd.randint(0, n)))
        terms, text = [word(5) for _ in range(rnd.randint(0, 8))], word(60)
        assert [(s, s + n) for s, n in highlight.find(text, tuple(terms))] == by_regex(text, terms)


def test_ten_thousand_terms(spark):
    rnd = random.Random(9)
    terms = sorted({"".join(rnd.choice("abcdef") for _ in range(rnd.randint(4, 9))) for _ in range(10_500)})[:10_000]
    texts = ["".join(rnd.choice("abcdefgG ") for _ in range(300)) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("terms", F.lit(terms))
    got = {r.i: r.s for r in df.select("i", highlight.spans(F.col("t"), F.col("terms")).alias("s")).collect()}
    outer = [t for t in terms if not any(t in k and t != k for k in terms)]
    pattern = re.compile("|".join(sorted(outer, key=lambda t: -len(t))), re.I)
    assert {i: s and [(x.start, x.start + x.length) for x in s] for i, s in got.items() if texts[i]} == {i: [m.span() for m in pattern.finditer(t)] for i, t in enumerate(texts) if t}
    assert got[5] is None and got[6] == []


def test_marks_of_each_row(spark):
    rows = [(0, "a<b & Straße ſun", ["<B", "SUN", None, " "]), (1, "İx\nix", ["ix"]), (2, "same", None), (3, "same", []), (4, None, ["x"])]
    df = spark.createDataFrame(rows, "i int, t string, k array<string>")
    got = {r.i: (r.m, r.h) for r in df.select("i", highlight.marked(F.col("t"), F.col("k")).alias("m"), highlight.marked_html(F.col("t"), F.col("k")).alias("h")).collect()}
    assert got[0] == ("a**<b** & Straße **ſun**", "a<mark>&lt;b</mark> &amp; Straße <mark>ſun</mark>")
    assert got[1] == ("**İx**\n**ix**", "<mark>İx</mark><br><mark>ix</mark>")
    assert got[2] == got[3] == ("same", "same") and got[4] == (None, None)


def test_marks_and_their_number_in_one_walk(spark):
    rows = [("The cat, the CAT.", '["cat", "the", "he"]'), ("none", '["cat"]'), (None, '["cat"]'), ("cat", None), ("", '["cat"]'), ("Ж и ж", '["ж"]'), ('a"b\\', '["\\"b\\\\"]')]
    df = spark.createDataFrame(rows, "text string, terms string").select(highlight.marked_and_counted(F.col("text"), F.col("terms")).alias("r")).select("r.marked", "r.n")
    assert [tuple(r) for r in df.collect()] == [("**The** **cat**, **the** **CAT**.", 4), ("none", 0), (None, 0), ("cat", 0), ("", 0), ("**Ж** и **ж**", 2), ('a**"b\\**', 1)]
