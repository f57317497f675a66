import base64
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from colloquy.llm import langid, mixing, url_rules, warc
from colloquy.llm.common import id_bitmap, in_bitmap, scratch
from colloquy.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, key string"


# --- URL rules


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, after = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = after[: min((after.find(c) for c in "?#" if c in after), default=len(after))]
    hits = [(len(r), v, r) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    _, verdict, rule = max(hits, default=(0, "allow", None))
    return host, path, rule, verdict


def test_url_rules_equal_brute_force(spark):
    rnd = random.Random(4)
    labels, paths = ["a", "b", "com", "org", "xa", "A", ""], ["/", "/x", "/x/y", "/x/y/z", "", "?q=/x", "#/x", "/é/x"]
    rules = {".".join(rnd.choice(labels[:5]) for _ in range(rnd.randint(1, 4))) + rnd.choice(paths[:4]): rnd.choice(["allow", "block"]) for _ in range(60)}
    rules = list(rules.items()) + URL_RULES
    urls = ["http://" * rnd.randint(0, 1) + ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 5))) + rnd.choice(paths) for _ in range(800)]
    urls += [None, "", "://", "nothing", "http://", "http://org", "http://ORG/a", "http://example.org/es/1", "http://m.example.org/es/1"] + ["http://com/fr/1"] * 300
    pages = spark.createDataFrame([(i, u, None, "h", "k") for i, u in enumerate(urls)], PAGES)
    got = url_rules.match_rules(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(urls[r.page_id], rules), urls[r.page_id]


def test_url_rules_of_odd_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    pages = spark.createDataFrame([(None, "http://a.org/"), (1, None), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string")
    assert url_rules.match_rules(pages.where("false"), rules).count() == 0
    assert sorted(r.verdict + str(r.rule) for r in url_rules.match_rules(pages, rules).collect()) == ["allowNone"] + ["alloworg/"] * 3
    assert {r.verdict for r in url_rules.match_rules(pages, rules.where("false"), default="block").collect()} == {"block"}


# --- WARC


def test_chunks_round_trip_and_reject_cuts():
    for n in (0, 1, 15, 16, 17, 1000):
        assert warc.unchunked(warc.chunked(bytes(range(256)) * 4, 16) if n == 1000 else warc.chunked(b"x" * n, 16)) == (bytes(range(256)) * 4 if n == 1000 else b"x" * n)
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(b"x" * 100, 16)[:-20])
    assert warc.unchunked(b"3;name=value\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


@pytest.mark.parametrize("least_bytes", [0, 5])
def test_warc_round_trip(spark, least_bytes):
    html = [None, "", "<p>é字\r\n\r\nWARC/1.1\r\n\r\n</p>", "long é " * 9000, "long é " * 9000, "abcd", "abcd", "abcdefg", "abcdefg", "abcdefg"]
    rows = [(i, f"http://x.org/{i} \r\n", h, "", "") for i, h in enumerate(html)] + [(None, None, "abcdefg", None, None)]
    path = scratch(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), path, least_bytes=least_bytes, segment_bytes=700, chunk_bytes=100)
    got = {r.page_id: r for r in warc.read_digests(spark, path).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r[0])
    for page, _, text, *_ in rows:
        raw = (text or "").encode()
        last = max(p for p in groups[text or ""] if p is not None)
        revisit = len(raw) >= least_bytes and page != last
        assert tuple(got[page]) == (page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last if revisit else None)
    full = {r.page_id: r.payload for r in warc.read_warc(spark, path).where("record_type = 'response'").collect()}
    assert all(bytes(p).decode() == (html[k] or "") for k, p in full.items() if k is not None)


def test_archives_are_members_with_names_that_resolve(spark):
    """Every record is a gzip member; a revisit names the record id of the response it repeats; ids are unique."""
    import gzip
    from pathlib import Path

    html = ["one", "two", "one", "one", "x" * 3000, "y" * 50, None]
    rows = [(i - 3, f"http://x.org/{i}", h) for i, h in enumerate(html)] + [(None, "u", "y" * 50), (9, "u", "twice"), (9, "u", "twice"), (2, "u", "twice")]
    path = scratch(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, segment_bytes=900, chunk_bytes=100, archive_bytes=4500)
    files = sorted(Path(path.removeprefix("file://")).glob("part-*"))
    assert len(files) > 2  # no more than five records in one
    fields = []
    for file in files:
        members = list(warc._members(file.read_bytes()))
        for member in members:
            ((f, _),) = warc.parse_records(member)
            fields.append(f)
        assert gzip.decompress(file.read_bytes()) == b"".join(members)
    ids = [f["warc-record-id"] for f in fields]
    assert len(ids) == len(set(ids)) == len(rows) + 3
    responses = {f["warc-record-id"]: f for f in fields if f["warc-type"] == "response"}
    for f in fields:
        if f["warc-type"] == "revisit" and warc._page(f["warc-refers-to"]) != 9:
            assert responses[f["warc-refers-to"]]["warc-payload-digest"] == f["warc-payload-digest"]
    got = warc.read_digests(spark, path).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got if r.page_id is not None) == sorted((p, len(h or "")) for p, _, h in rows if p is not None)


def test_cut_members_raise():
    import gzip

    with pytest.raises(ValueError):
        list(warc._members(gzip.compress(b"a record") + gzip.compress(b"another" * 50)[:-9]))


def test_warc_of_nothing(spark):
    path = scratch(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.read_digests(spark, path).count() == 0


def test_wrong_total_length_raises():
    import pyarrow as pa

    row = pa.RecordBatch.from_pylist([{"origin": "o", "total": 9, "page_id": 1, "record_type": "response", "payload_digest": "", "segments": [{"number": 1, "block": b"abc"}]}])
    with pytest.raises(ValueError):
        list(warc._reassembled([row]))


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, target, full = {s: weights[i % 3] for i, s in enumerate(order)}, {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        among = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / among for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_targets(spark, odd_docs, no_docs):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.choice((0, 1, 5, 40, 400))), rnd.choice(["b", "a", "c", None, "d", "e"][: 1 + i % 6])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_copies(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 400
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_copies(docs.repartition(2)).collect()), key=str)
    copies = {r.doc_id: r.copies for r in got}
    out = defaultdict(int)
    for r in mixing.mix(docs).collect():
        out[r.doc_id] += 1
    assert dict(out) == {k: c for k, c in copies.items() if c}
    assert mixing.mix_copies(no_docs).count() == mixing.mix(no_docs).count() == 0
    mixed, plan = mixing.mix(odd_docs), mixing.mix_copies(odd_docs).collect()
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in plan) and len(plan) == odd_docs.count()


def test_mix_gives_copies_to_the_source_that_the_plan_names(spark):
    """Texts that stand under two sources, also with the same id, and rows that repeat id, text and source."""
    rows = [(i, f"word{i} and more", s) for i in range(100) for s in ("a", "b")] + [(i, "one two three", "c") for i in (7, 7, 7, 8)] + [(None, "x y", None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan, out = defaultdict(int), defaultdict(int)
    for r in mixing.mix_copies(docs).collect():
        plan[(r.doc_id, r.source)] += r.copies
    for r in mixing.mix(docs).collect():
        out[(r.doc_id, r.source)] += 1
    assert dict(out) == {k: n for k, n in plan.items() if n}


# --- language identification


def test_languages(spark, odd_docs, no_docs):
    rnd = random.Random(7)
    words = {"en": "the of and to in is that with was for".split(), "de": "der die und das nicht ein mit auf für über".split(), "fr": "le la les et une dans pour être où ça".split()}
    rows = [(i, " ".join(rnd.choice(words[l]) for _ in range(rnd.randint(5, 60))), l) for i, l in enumerate(rnd.choice(list(words)) for _ in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample_rows=150)
    got = langid.predict(docs, model).collect()
    held = [r for r in got if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(held) > 40
    truth = {d: l for d, _, l in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    odd = {r.doc_id: r for r in langid.predict(odd_docs, model).collect()}
    assert all(odd[d].lang_pred == "und" and odd[d].score == 0 for d in (3, 4, 5, 9)) and odd[8].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in odd.values())
    kept = langid.keep_known(odd_docs, model)
    assert kept.columns == odd_docs.columns and {3, 4, 5, 9}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == odd_docs.count() - 4
    assert langid.predict(no_docs, model).count() == 0
    empty = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}


def test_a_language_of_one_text_in_many_rows_is_learned(spark):
    """Repeated rows and texts without a letter don't count toward the sample's slices."""
    for k in range(3):
        rows = [(i, f"plain words number {i} of table {k}", "en") for i in range(500)]
        rows += [((100_002, 100_004, 100_006)[k], "ein einziger Text", "de")] * 2000 + [(200_000 + i, f"{i} --- {k}", "eo") for i in range(2000)] + [(300_000 + i, "unu teksto", "eo") for i in range(5)]
        rows = [(d, t, l) for d, t, l in rows if zlib.crc32(str(d).encode()) % 5]
        assert any(l == "de" for _, _, l in rows)
        model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100)
        assert model.languages == ["de", "en", "eo"]


def test_without_labels_only_texts_without_a_letter_go(spark, odd_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_known(docs, langid.fit(docs))
    assert kept.columns == docs.columns and {3, 4, 5, 9}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == docs.count() - 4


def test_kernel_and_ridge_equal_the_plain_formulas():
    """Kernels by sets of hashed n-grams, the Nystroem map and ridge regression written out for few texts."""
    import math

    import numpy as np

    rnd = random.Random(31)
    texts = [" ".join(rnd.choice(["abc", "bcd", "xyz", "Été", "zzz q"]) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    langs = [rnd.choice("uvw") for _ in texts]

    def grams(text):
        raw = text.lower().encode()
        whole = {(n, int.from_bytes(raw[i : i + n], "big")) for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
        return {(((g + n * 0x3C6EF372) * 0x9E3779B1) % 2**32) >> (32 - langid.BITS) for n, g in whole}

    sets = [grams(t) for t in texts]
    assert all(set(np.flatnonzero(langid.presence(t))) == s for t, s in zip(texts, sets))
    packed = np.array([np.packbits(langid.presence(t)) for t in texts])
    model = langid.train(packed, langs, landmarks=12, ridge=0.01)
    chosen = [next(i for i, p in enumerate(packed) if (p == mark).all()) for mark in model.landmarks]
    k = np.array([[len(s & sets[c]) / math.sqrt(len(s) * len(sets[c])) for c in chosen] for s in sets])
    # ridge regression in the space of the landmarks, by its normal equations in kernel form
    values, vectors = np.linalg.eigh(k[chosen])
    keep = values > 1e-6 * values.max()
    phi = k @ (vectors[:, keep] * values[keep] ** -0.5)
    y = np.array([[1.0 if l == m else -1.0 for m in sorted(set(langs))] for l in langs])
    ones = np.column_stack([phi, np.ones(len(phi))])
    penalty = np.diag([0.01 * len(phi)] * phi.shape[1] + [0.0])
    want = ones @ np.linalg.solve(ones.T @ ones + penalty, ones.T @ y)
    got = k @ model.weights + model.bias
    assert np.allclose(got, want, atol=1e-4)
    batch = __import__("pyarrow").record_batch({"doc_id": list(range(len(texts))), "text": texts, "held_out": [False] * len(texts)})
    (told,) = langid._predict(model)(iter([batch]))
    assert told.column("lang_pred").to_pylist() == [model.languages[i] for i in want.argmax(axis=1)]
    assert np.allclose(told.column("score").to_numpy(), np.clip((1 + want.max(axis=1)) / 2, 0, 1), atol=1e-4)


def test_the_sample_is_bounded_and_has_rare_languages(spark, monkeypatch):
    rows = [(1, f"one id many texts {i}", "aa") for i in range(3000)] + [(i, "the same text", "aa") for i in range(2000)]
    rows += [(5000 + i, f"seldom seen {i}", "bb") for i in range(6)] + [(6000 + i, f"x{i} y", f"l{i}") for i in range(30)]
    seen = {}
    monkeypatch.setattr(langid, "train", lambda packed, langs, landmarks: seen.update(langs=langs))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100)
    assert len(seen["langs"]) <= 100 and {"aa", "bb"} <= set(seen["langs"]) and seen["langs"].count("aa") >= 30
    assert langid.shares([("a", 5), ("b", 1000), ("c", 1000)], 100) == [("a", 5), ("b", 47), ("c", 48)]


def test_a_contradicted_language_goes(spark):
    rnd = random.Random(9)
    words = {"en": "the of and to in is that with was for".split(), "de": "der die und das nicht ein mit auf über für".split()}
    rows = [(i, " ".join(rnd.choice(words[l]) for _ in range(60)), l) for i, l in enumerate(rnd.choice(list(words)) for _ in range(300))]
    rows += [(1000, " ".join(words["en"] * 6), "de"), (1001, " ".join(words["en"] * 6), None), (1002, " ".join(words["en"] * 6), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, TEXT string, Lang string")
    kept = {r.doc_id for r in langid.keep_known(docs, langid.fit(docs.where("doc_id < 1000"))).collect()}
    assert kept == {r[0] for r in rows} - {1000}


def test_held_out_labels_are_not_learned(spark):
    import zlib

    rows = [(i, "abc def ghi", "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else "yy") for i in range(100)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["yy"]


def test_bitmap_loses_nothing(spark):
    import numpy as np

    ids = [0, 1, -1, 63, 64, 2**40 + 5, -(2**50)]
    bitmap = id_bitmap(spark.createDataFrame([(i,) for i in ids], "i long"), "i", bits=1 << 12)
    assert in_bitmap(bitmap, np.array(ids)).all() and not in_bitmap(bitmap, np.array([2, 65])).any()
