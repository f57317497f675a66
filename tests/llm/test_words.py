"""Packing, source divergence and importance resampling against plain Python and SQL."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from colloquy.llm import divergence, importance, packing, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aab  béß字💩1２'s.,!-ΣσİǺͅÁ\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0  　"


def key(v):
    return (v is not None, v)


def renamed(docs):
    """The same rows with names in other case and columns whose names clash with the operators' own."""
    extra = [f"doc_id AS {n}" for n in ("tie", "free", "term", "n", "src", "block", "rank", "score", "part")]
    return docs.selectExpr("doc_id AS Doc_ID", "text AS TEXT", "lang AS Lang", "source AS Source", *extra)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_importance_resampling"])
def test_query_equals_its_sql(spark, con, name):
    got = queries.queries()[name](spark, DATA)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*rel.columns).collect()), key=lambda r: tuple(map(key, r))) == sorted(rel.fetchall(), key=lambda r: tuple(map(key, r)))


# packing


def test_units_give_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    tok, encode, rnd = Tokenizer.from_file(JSON), packing.WordEncoder(JSON, most=500), random.Random(3)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for t in texts + ["a<|endoftext|>b <|startoftext|> x<|endoftext|>.", "I'll we've 'S it's, 's.", "a" * 3000, "\x00 a\x00b"]:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def plain_cost(places, penalties, window):
    """Least cost of cutting at the last place, over all earlier places for each."""
    p, cost = [0, *places], [0]
    for j in range(1, len(p)):
        steps = [(cost[i], p[j] - p[i]) for i in range(j) if p[j] - p[i] <= window]
        cost.append(penalties[j - 1] + min(c + (0 if n & (n - 1) == 0 else window - n) for c, n in steps))
    return cost[-1]


def test_cuts_cost_as_little_as_any():
    rnd = random.Random(1)
    for _ in range(300):
        window = rnd.choice([8, 13, 16, 20])
        places = np.unique(np.cumsum([rnd.randint(1, min(window, 6)) for _ in range(rnd.randint(1, 60))]))
        penalties = np.array([rnd.randint(0, 5) for _ in places])
        cuts, paid, a = packing.best_cuts(places, penalties, window, True), dict(zip(places.tolist(), penalties.tolist())), 0
        cost = 0
        for b in cuts:
            assert 0 < b - a <= window
            cost, a = cost + paid[b] + (0 if (b - a) & (b - a - 1) == 0 else window - (b - a)), b
        assert a == places[-1] and cost == plain_cost(places.tolist(), penalties.tolist(), window)
        open_end = packing.best_cuts(places, penalties, window, False)
        assert places[-1] - open_end[-1] < window


def check_packed(docs, sequences, window, end_id):
    """Every id of every document lies in exactly one piece and sequences are gapless; returns (tokens, padding)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    want = collections.Counter(b"".join(int(i).to_bytes(4, "little") for i in tok.encode(d.text or "", add_special_tokens=False).ids + ([] if end_id is None else [end_id])) for d in docs)
    want.pop(b"", None)
    pieces, padding, total = collections.defaultdict(list), 0, 0
    for s in sequences:
        assert len(s.ids) == 4 * sum(s.length) <= 4 * window and all(n > 0 for n in s.length)
        n, at = sum(s.length), 0
        padding, total = padding + (0 if n & (n - 1) == 0 else window - n), total + n
        for d, start, length, whole in zip(s.doc_id, s.start, s.length, s.doc_tokens):
            pieces[s.sequence_id].append((d, start, length, whole, bytes(s.ids[4 * at : 4 * (at + length)])))
            at += length
    found, open_ = collections.Counter(), b""
    for _, parts in sorted(pieces.items()):
        for _, start, length, whole, ids in parts:
            assert start == len(open_) // 4
            open_ += ids
            if len(open_) == 4 * whole:
                found[open_] += 1
                open_ = b""
    assert not open_ and found == want
    return total, padding


@pytest.mark.parametrize("end_id,window,stretch", [(2, 4096, 1 << 19), (2, 64, 500), (None, 50, 300)])
def test_packing_of_odd_rows(spark, odd_docs, no_docs, end_id, window, stretch):
    docs = renamed(odd_docs)
    rows = packing.pack(docs, JSON, end_id=end_id, window=window, stretch=stretch).collect()
    total, padding = check_packed(odd_docs.collect(), rows, window, end_id)
    assert window > 64 or padding < total / 10
    assert packing.pack(no_docs, JSON).count() == 0 == packing.piece_digests(packing.pack(no_docs, JSON)).count()


def test_packing_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sequences = packing.pack(docs, JSON)
    total, padding = check_packed(docs.collect(), sequences.collect(), 4096, 2)
    assert padding < 0.05 * total
    crc, offsets = {}, collections.defaultdict(int)
    for s in sequences.collect():
        at = 0
        for d, start, n in zip(s.doc_id, s.start, s.length):
            crc[d, start] = (n, zlib.crc32(s.ids[4 * at : 4 * (at + n)]), s.sequence_id, at)
            at += n
    got = queries.op11_packing(spark, DATA)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.sequence_id, r.offset) for r in got.collect()} == crc


def test_sentences_end_behind_marks():
    encode = packing.WordEncoder(JSON)
    ids = np.frombuffer(encode('One two. "Three four!" It is 3.14 now… Done'.encode()), "<u4")
    from tokenizers import Tokenizer

    shown = [Tokenizer.from_file(JSON).id_to_token(int(ids[i - 1])) for i in encode.sentence_ends(ids)]
    assert len(shown) == 3 and shown[0] == ".</w>" and shown[1].startswith("!")


# source divergence


def plain_divergence(rows, least, top):
    docs = [(r.lang or "", r.source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r.text or ""))) for r in rows]
    df, own, whole = collections.Counter(), collections.Counter(), collections.Counter()
    for lang, source, words in docs:
        for w in set(words):
            df[lang, w] += 1
        for w in words:
            own[lang, source, w] += 1
            whole[lang, w] += 1
    out = []
    for lang in {d[0] for d in docs}:
        kept = [w for (x, w), n in df.items() if x == lang and n >= least]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        size = {s: sum(own[lang, s, w] for w in kept) for s in sources}

        def p(n, of):
            return 1 + 10**9 * (n + 5) // (of + 5 * len(kept))

        for s in sources:
            pairs = [(sum(abs(p(own[lang, s, w], size[s]) - p(own[lang, o, w], size[o])) for w in kept), o) for o in sources if o != s]
            terms = [(p(own[lang, s, w], size[s]) - p(whole[lang, w], sum(size.values())), w) for w in kept if own[lang, s, w]]
            for part, found, most in (("pair", pairs, None), ("term", [t for t in terms if t[0] > 0], top)):
                for i, (v, item) in enumerate(sorted(found, key=lambda t: (-t[0], t[1].encode()))[:most]):
                    out.append((lang, s, part, item, v, i + 1))
    return sorted(out)


@pytest.mark.parametrize("block,tile,top", [(1024, 128, 50), (3, 2, 2), (7, 3, 5)])
def test_divergence_in_small_tiles(spark, odd_docs, block, tile, top):
    rnd = random.Random(block)
    words = [w + x for w in ("Aa", "bé", "字", "c1d", "É") for x in ("", "x", "Yz")]
    rows = [(i, " ".join(rnd.choices(words[: 3 + i % 13], k=i % 40)), rnd.choice(["en", "fr", None]), rnd.choice([None, "s1", "s2", "s3", "\U0001f600", "ｘ", "S"])) for i in range(150)]
    rows += [(0, "only one", "xx", "lonely"), (0, None, "yy", "a"), (0, None, "yy", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").unionByName(odd_docs.select("doc_id", "text", "lang", "source"))
    got = divergence.source_divergence(renamed(docs), least=4, top=top, block=block, tile=tile)
    assert sorted(map(tuple, got.collect())) == plain_divergence(docs.collect(), 4, top)


def test_divergence_without_kept_terms_or_rows(spark, odd_docs, no_docs):
    assert divergence.source_divergence(no_docs).count() == 0
    got = divergence.source_divergence(odd_docs, least=1000)
    assert sorted(map(tuple, got.collect())) == plain_divergence(odd_docs.collect(), 1000, 50)


def test_counts_are_whole_when_a_task_empties_its_memory(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("text", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source").coalesce(1)

    def counted(**bounds):
        df = docs.mapInArrow(divergence._count(**bounds), divergence._COUNTS).groupBy("lang", "source", "term").sum("n", "docs")
        return sorted(map(tuple, df.collect()))

    assert counted(most_words=100, most_entries=1000) == counted()


def test_shares_are_exact():
    rnd = random.Random(2)
    for _ in range(200):
        of, v = rnd.randint(0, 10**15), rnd.randint(1, 10**6)
        n = rnd.randint(0, of)
        assert divergence.share(np.array([n]), of, v)[0] == 1 + 10**9 * (n + 5) // (of + 5 * v)
    assert divergence.share(np.array([7]), 7, 1)[0] == 1 + 10**9


# importance resampling


def plain_importance(rows, target, buckets=10_000):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return words, [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = collections.Counter(), collections.Counter()
    for r in rows:
        s.update(features(r.text)[1])
    for r in target:
        t.update(features(r.text)[1])
    of_s, of_t = s.total() + buckets, t.total() + buckets
    out, able = [], []
    for r in rows:
        words, found = features(r.text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t))) for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            able.append(out[-1])
    for i, row in enumerate(sorted(able, key=lambda x: (-x[3], key(x[0])))[: len(able) * 25 // 100]):
        row[4] = i + 1
    return sorted(map(tuple, out), key=lambda r: tuple(map(key, r)))


def test_importance_of_odd_rows(spark, odd_docs, no_docs):
    text = " ".join(["Wörter"] * 3 + [f"w{i}" for i in range(30)])
    more = spark.createDataFrame([(i, text + f" tail{i % 3} " + "x" * (150 if i % 2 else 99)) for i in range(100, 130)] + [(None, text)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "lang", "source").unionByName(more, allowMissingColumns=True)
    target = spark.createDataFrame([("w1 w2 w3 tail1",), (None,), ("",)], "text string")
    want = plain_importance(docs.collect(), target.collect())
    got = importance.importance_resample(renamed(docs), target)
    assert sorted(map(tuple, got.collect()), key=lambda r: tuple(map(key, r))) == want
    assert sum(r[4] is not None for r in want) > 5
    assert importance.importance_resample(no_docs, target).count() == 0
    empty = importance.importance_resample(odd_docs, no_docs).collect()
    assert sorted(map(tuple, empty), key=lambda r: tuple(map(key, r))) == plain_importance(odd_docs.collect(), [])


def test_states_go_on_from_the_parent():
    trie = importance.WordTrie()
    words = [b"a", b"word", "été".encode(), b"x" * 98, b"y" * 99, b"z" * 500]
    ids = [trie.index[w] for w in words]
    trie.grow()
    edges = np.array([a << 32 | b for a in ids for b in ids])
    assert trie.children(edges).tolist() == [zlib.crc32(a + b" " + b) for a in words for b in words]


def test_totals_are_whole_when_a_task_empties_its_memory(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").coalesce(1)
    few = docs.mapInArrow(importance._totals(500, most_words=100), "bucket int, n long")
    assert sorted(map(tuple, few.collect())) == [(b, n) for b, n in enumerate(importance.bucket_totals(docs, buckets=500).tolist()) if n]
