import hashlib
import random
import re

import numpy as np
import pytest

from colloquy.llm import exact_dedup, fingerprint, line_dedup, mixing, near_dedup
from colloquy.llm.shingles import shared, shingle_sets

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def brute_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(SPACE.sub(" ", r.text or ""), []).append(r.doc_id)
    return {t: (min((d for d in ids if d is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda b: hashlib.sha256(b).digest()[:1]])
def test_exact_groups(spark, odd_docs, digest):
    """Also with a digest of one byte, where the bytes must tell texts apart."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("ab  c\t") for _ in range(rnd.randint(0, 4))) for _ in range(600)] + [None] * 5
    docs = docs_of(spark, texts).repartition(6)
    for table in (docs, odd_docs):
        want = brute_groups(table.collect())
        got = exact_dedup.exact_groups(table, digest=digest, memtable_bytes=2000, memtable_entries=20, shard_entries=50).collect()
        assert len(got) == table.count()
        text = {r.doc_id: SPACE.sub(" ", r.text or "") for r in table.collect()}
        for g in got:
            assert (g.keep_id, g.group_size) == want[text[g.doc_id]]
        if digest is exact_dedup.sha256:
            assert sum(g.kept for g in got) == len(want)


def test_exact_dedup_keeps_one_row_and_all_columns(spark, odd_docs, no_docs):
    out = exact_dedup.exact_dedup(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(SPACE.sub(" ", r.text or "") for r in out.collect()) == sorted(brute_groups(odd_docs.collect()))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6, 7, 8, 9, 10, 11]
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_merge_index_keeps_smallest():
    rnd, index, want = random.Random(2), exact_dedup.MergeIndex(memtable=7, fanout=3), {}
    for i in range(2000):
        d, doc = hashlib.sha256(bytes([rnd.randrange(90)])).digest(), rnd.randrange(10**6)
        index.put(d, (False, doc, 0, i, 1, 1))
        best, n = want.get(d, (doc, 0))
        want[d] = (min(best, doc), n + 1)
    assert {bytes.fromhex(d.decode()): (v[1], v[4]) for d, v in index.entries()} == want


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets, need=(4, 5)):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and need[1] * len(sets[i] & sets[j]) >= need[0] * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(root(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def families(seed, n=40, size=8, words=60):
    """Texts in families of edited copies, many of them near the threshold."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = ["", None, "one", "ONE", "one two", "  one\ttwo "]
    for _ in range(n):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(rnd.randint(1, size)):
            copy = list(base)
            for _ in range(rnd.randint(0, 5)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_shingle_sets_have_the_sizes_of_sets_of_words():
    texts = [*families(4, 5), "A b\x0bC\x85d \xa0 e", "x " * 5000]
    for k in (1, 2, 5):
        hashed, plain = shingle_sets(texts, k), brute_sets(texts, k)
        assert [len(s) for s in hashed] == [len(s) for s in plain]
        for i in range(0, len(texts), 3):
            for j in range(0, len(texts), 7):
                assert shared(hashed[i], hashed[j]) == len(plain[i] & plain[j])


@pytest.mark.parametrize("shingle,block", [(2, 512), (2, 4), (5, 512)])
def test_near_groups_equal_brute_force(spark, shingle, block):
    texts = families(9)
    sets = brute_sets(texts, shingle)
    want = brute_components(list(range(len(texts))), sets)
    got = near_dedup.near_groups(docs_of(spark, texts).repartition(5), shingle=shingle, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_large_family_in_blocks(spark):
    """A family in which most pairs are near the threshold goes through leaders, pivots and blocks."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for _ in range(rnd.randint(0, 8)):
            copy[rnd.randrange(80)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = near_dedup.near_groups(docs_of(spark, texts), shingle=2, block=16).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(list(range(300)), brute_sets(texts, 2))


@pytest.mark.parametrize("block", [3, 1000])
def test_blocks_join_what_all_pairs_join(spark, block):
    """One bucket of sets of many sizes, each a component of its own: blocks by size lose no link."""
    rng = random.Random(5)
    sets = [sorted({(a * 1000 + k) << 20 for k in range(n)} | {(1 << 50) + rng.randrange(1 << 20) for _ in range(extra)}) for a in (1, 2) for n in (4, 5, 8, 10, 16, 20, 25, 40, 50, 61) for extra in (0, 0, 1, 3)]
    sets = [list(x) for x in sorted(set(map(tuple, sets)))]
    names = [bytes([i]) for i in range(len(sets))]
    told = spark.createDataFrame([(b"k", c, len(x), c, names[0], len(sets) > block) for c, x in zip(names, sets)], "bucket binary, class binary, size long, label binary, main binary, wide boolean")
    stored = spark.createDataFrame([(c, np.array(x, np.uint64).tobytes()) for c, x in zip(names, sets)], "class binary, items binary")

    def groups(links):
        root = {c: c for c in names}
        for a, b in links:
            a, b = root[a], root[b]
            root = {c: min(a, b) if r in (a, b) else r for c, r in root.items()}
        return root

    linked = [(a, b) for a, x in zip(names, sets) for b, y in zip(names, sets) if a < b and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})]
    found = [(bytes(r.a), bytes(r.b)) for r in near_dedup.block_links(told, stored, 4, 5, block).collect()]
    assert all((min(p), max(p)) in linked for p in found)
    assert groups(found) == groups(linked) and len(set(groups(linked).values())) < len(sets)


def test_near_dedup_of_odd_tables(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(odd_docs).collect()}
    assert {(2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (7, 6, False), (None, 10, True)} <= got
    out = near_dedup.near_dedup(odd_docs)
    assert out.columns == odd_docs.columns and {2, 7}.isdisjoint(r.doc_id for r in out.collect())
    assert near_dedup.near_groups(no_docs).count() == near_dedup.near_dedup(no_docs).count() == 0


def near_chain():
    """Three texts of which the middle one is near both others, and these aren't near each other."""
    left, middle, right = ([f"w{i}" for i in range(100)] for _ in range(3))
    left[:6], right[-6:] = (f"x{i}" for i in range(6)), (f"y{i}" for i in range(6))
    left[30], right[60] = "x", "y"
    return [" ".join(x) for x in (left, middle, right)]


def test_texts_under_null_ids_are_compared(spark):
    left, middle, right = near_chain()
    docs = spark.createDataFrame([(5, left), (None, middle), (7, right), (8, "other words"), (None, "more of them"), (None, "a b c d e f g"), (None, "A b c d e f g")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs, shingle=2).collect()}
    assert got == {(5, 5, True), (None, 5, True), (7, 5, False), (8, 8, True), (None, None, True)}
    left_over = [(r.doc_id, r.text.lower()) for r in near_dedup.near_dedup(docs, shingle=2).collect()]
    assert sorted(left_over, key=str) == sorted([(5, left), (8, "other words"), (None, "more of them"), (None, "a b c d e f g")], key=str)


def test_near_dedup_of_repeated_ids(spark):
    """Only the near copy goes of an id with a clean text too, and of near copies under the smallest id one stays."""
    left, middle, right = near_chain()
    rows = [(1, left), (1, middle), (2, right), (2, "a clean text"), (3, "one more"), (3, "one more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.text) for r in near_dedup.near_dedup(docs, shingle=2).collect()]
    assert sorted(out)[1:] == sorted(rows[3:]) and out.count((1, left)) + out.count((1, middle)) == 1
    groups = near_dedup.near_groups(docs, shingle=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in groups) == [(1, 1, False), (1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (3, 3, True)]


def test_min_max_signature():
    a, b = near_dedup.coefficients(200)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    x, y = np.unique(pool[:2000]), np.unique(pool[1000:])
    agree = np.mean(near_dedup.signature(x, a, b) == near_dedup.signature(y, a, b))
    assert abs(agree - 1 / 3) < 0.08


def test_bands_hold_a_permutation_once():
    """On one item minimum and maximum are equal, so a band with both would repeat a value."""
    a, b = near_dedup.coefficients(near_dedup.HASHES)
    sig = near_dedup.signature(np.array([12345], np.uint64), a, b)
    rows = near_dedup.ROWS
    assert all(len(set(sig[i : i + rows])) == rows for i in range(0, len(sig) // rows * rows, rows))


# --- fingerprints


def test_edited_fingerprints(spark, odd_docs, no_docs):
    texts = families(6, 12) + ["é字" * 7, "\U0001f600" * 5]
    rows = fingerprint.edited_fingerprints(docs_of(spark, texts).repartition(3), k=64).collect()
    sets = brute_sets([t for t in texts], 5)
    same = {}
    for r in rows:
        text, after = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
        old, new = (brute_case_sets(t) for t in (text, edited))
        if old | new:
            assert abs(r.near_edited - len(old & new) / len(old | new)) < 0.3
        assert 0 <= r.near_next <= 1
    assert fingerprint.edited_fingerprints(no_docs).count() == 0
    got = fingerprint.edited_fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    (one,) = fingerprint.edited_fingerprints(docs_of(spark, ["abcd efgh"])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one.near_next == 1


def xxh64(data: bytes, seed: int) -> int:
    import xxhash

    v = xxhash.xxh64(data, seed=seed).intdigest()
    return v - (1 << 64) if v >> 63 else v


def brute_sketch(text, k, n=5):
    """Bottom-k by the published hash: a value's hash is the seed of the next one's; the first seed is 42."""
    hashed = [xxh64(w.encode(), 42) for w in WORD.findall(text or "")]

    def joined(values):
        seed = 42
        for v in values:
            seed = xxh64(v.to_bytes(8, "little", signed=True), seed % (1 << 64))
        return seed

    if len(hashed) >= n:
        found = {joined(hashed[i : i + n]) for i in range(len(hashed) - n + 1)}
    elif hashed:
        found = {xxh64(n.to_bytes(4, "little"), joined(hashed) % (1 << 64))}
    else:
        found = set()
    return sorted(found)[:k]


def brute_likeness(a, b, k):
    merged = sorted({*a, *b})[:k]
    return len(set(merged) & set(a) & set(b)) / len(merged) if merged else 1.0


def as_text(sketch):
    import base64

    return base64.b64encode(b"".join(x.to_bytes(8, "big", signed=True) for x in sketch)).decode()


@pytest.mark.parametrize("k", [16, 128])
def test_fingerprints_equal_a_plain_bottom_k(spark, k):
    """Sketches, both likenesses and the edited texts, value for value; null and repeated ids too."""
    texts = families(16, 9) + ["é字 b\x85 c\x0bd " * 7, "\U0001f600 " * 5, "a b c d", "a b c d e", " ", "x"]
    rows = list(enumerate(texts)) + [(None, f"no id {i} " * 4) for i in range(40)] + [(7, f"the same id {i} of many") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    chain = sorted(((d is not None, d or 0), xxh64((t or "").encode(), 42), t or "") for d, t in rows)
    want = []
    for i, ((numbered, d), _, text) in enumerate(chain):
        after = chain[(i + 1) % len(chain)][2]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, changed = (brute_sketch(t, k) for t in (text, after, edited))
        want.append((d if numbered else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), brute_likeness(own, changed, k), brute_likeness(own, other, k)))
    got = fingerprint.edited_fingerprints(docs, k=k)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_an_id_of_many_rows_fills_many_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(None, f"n{i}") for i in range(300)] + [(5, f"t{i}") for i in range(400)] + [(i, "x") for i in range(-50, 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    parts = docs.withColumn("part", fingerprint._ranges(docs, 20)).groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 130 and len(parts) >= 16


def brute_case_sets(text, k=5):
    w = WORD.findall(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1500, 4500))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a"), 256).alias("a"), fingerprint.sketch(F.col("b"), 256).alias("b"), fingerprint.sketch(F.concat_ws(" ", "a", "b"), 256).alias("ab"))
    r = df.select(
        fingerprint.resemblance(F.col("a"), F.col("b"), 256).alias("r"), fingerprint.containment(F.col("a"), F.col("b"), 256).alias("c"), fingerprint.distinct_shingles(F.col("a"), 256).alias("n"),
        F.size(F.array_except(fingerprint.merge(F.col("a"), F.col("b"), 256), "ab")).alias("off"),
    ).first()
    assert abs(r.r - 1 / 3) < 0.1 and abs(r.c - 1 / 2) < 0.12 and abs(r.n / 2996 - 1) < 0.25 and r.off <= 4


# --- line runs


def brute_line_runs(docs, least):
    """Lines that lie in a run of at least ``least`` words that some earlier document or place has."""
    rows = []
    for d, t in docs:
        lines = [(i, x.rstrip(" "), len(WORD.findall(x))) for i, x in enumerate((t or "").split("\n"))]
        rows.append((d, [x for x in lines if x[2]]))
    gone = set()
    for bi, (d, b) in enumerate(rows):
        for ai in range(bi + 1):
            a = rows[ai][1]
            for off in range(-len(a) + 1, len(b)):
                if ai == bi and off <= 0:
                    continue
                run, words = [], 0
                for p in range(max(0, off), min(len(b), len(a) + off) + 1):
                    if p < min(len(b), len(a) + off) and b[p][1] == a[p - off][1]:
                        run.append(b[p][0])
                        words += b[p][2]
                    else:
                        if words >= least:
                            gone |= {(d, i) for i in run}
                        run, words = [], 0
    return gone


def test_line_runs(spark):
    rnd = random.Random(12)

    def line(n):
        return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))

    passages = ["\n".join(line(rnd.choice((4, 9, 30, 60))) for _ in range(rnd.randint(1, 8))) for _ in range(6)] + [line(80)]
    docs = []
    for d in range(60):
        parts = [line(rnd.randint(1, 20)) for _ in range(rnd.randint(1, 6))] + ["Short note.", "", "All rights reserved."]
        for _ in range(rnd.randint(0, 3)):
            parts.insert(rnd.randrange(len(parts)), rnd.choice(passages))
        docs.append((d, "\n".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = line_dedup.line_dedup(df).collect()
    gone = {(r.doc_id, i) for r in got for i in r.removed}
    assert gone == brute_line_runs(docs, 50)
    # of a passage of 50 words or more every occurrence but the first goes
    text, later = dict(docs), 0
    for passage in passages:
        lines = passage.split("\n")
        if len(passage.split()) >= 50:
            for d, at in [(d, at) for d, t in docs for at in range(t.count("\n") + 1) if t.split("\n")[at : at + len(lines)] == lines][1:]:
                assert {(d, at + i) for i in range(len(lines))} <= gone
                later += 1
    assert later > 20
    for r in got:
        assert r.text == "\n".join(x for i, x in enumerate(text[r.doc_id].split("\n")) if (r.doc_id, i) not in gone)


def test_line_runs_that_the_first_document_has_in_part(spark):
    """Every run of 50 words goes from later documents, also where the first occurrence of a part has no more of it."""
    rnd = random.Random(21)

    def line(n):
        return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))

    docs = []
    for case in range(60):
        parts = [line(n) for n in ((20, 30, 20), (30, 26, 30), (9, 60, 9, 12), (4, 25, 4, 30, 7))[case % 4]]
        low = rnd.randrange(len(parts))
        some = [parts[low:], parts[: low + 1], parts[low : low + 1]][case % 3]
        for body in (parts[1:2], some, parts, parts, [*some, line(8), *parts]):
            docs.append((len(docs), "\n".join([line(12), *body, line(12)])))
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    gone = {(r.doc_id, i) for r in got for i in r.removed}
    assert {(3, 1), (3, 2), (3, 3)} <= gone  # 20 + 30 + 20 words, of which the first document has 30
    assert gone == brute_line_runs(docs, 50)


def test_line_runs_do_not_depend_on_other_documents(spark):
    """A run of 49 words stays and one of 50 goes, whatever else the documents share with a third; repeated rows count once."""
    rnd = random.Random(5)

    def line(n):
        return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))

    docs, gone = [], set()
    for case in range(24):
        words = 49 + case % 2
        run = [line(n) for n in (20, 10, words - 30)]
        other = [line(60), line(70)]
        at = len(docs)
        docs.append((at, "\n".join([line(12), *run, line(12), *(other[:1] if case % 4 > 1 else [])])))
        docs.append((at + 1, "\n".join([line(12), *run, line(12), *(other[1:] if case % 4 > 1 else [])])))
        docs.append((at + 2, "\n".join([line(5), *other])))
        gone |= {(at + 1, i) for i in (1, 2, 3)} if words == 50 else set()
        gone |= {(at + 2, 1), (at + 2, 2)} if case % 4 > 1 else set()
    assert gone == brute_line_runs(docs, 50)
    rows = docs + [docs[k % 3] for k in range(300)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {(r.doc_id, i) for r in got for i in r.removed} == gone


def test_runs_name_their_source(spark):
    passage = "\n".join(" ".join(f"p{k}q{i}" for i in range(30)) for k in range(4))
    docs = spark.createDataFrame([(1, f"own one\n{passage}\nend"), (2, passage), (3, f"{passage}\nx y\n{passage}")], "doc_id long, text string")
    lines = line_dedup.winnow(line_dedup.line_table(docs.selectExpr("*", "xxhash64(text) AS tie")))
    got = sorted((r.doc_id, r.p, r.upto, r.a_id, r.a_p) for r in line_dedup.repeated_runs(lines).collect())
    assert got == [(2, 0, 4, 1, 1), (3, 0, 4, 1, 1), (3, 5, 9, 1, 1)]


def test_column_names_in_any_case(spark):
    """Operators that return whole rows find their columns in any case, beside columns of clashing names."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "a", 0), (2, text, "a", 1), (3, "other words here", "b", 2)], "Doc_ID long, TEXT string, Source string, tie int")
    docs = docs.selectExpr("*", "tie AS digest", "tie AS c0", "tie AS doc")
    for kept in (exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs)):
        assert kept.columns == docs.columns and sorted(r.tie for r in kept.collect()) == [0, 2]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {r.tie for r in mixed.collect()} <= {0, 1, 2}
    assert line_dedup.line_dedup(docs).count() == fingerprint.fingerprints(docs).count() == 3


def test_trailing_white_space_of_lines(spark):
    lines = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4)]
    ends = ["", "\r", " \t\x0b", "\x0c \r"]
    docs = [(k, "".join(x + end + "\n" for x in lines)) for k, end in enumerate(ends)]
    docs.append((len(docs), "".join(" " + x + "\x85\n" for x in lines)))  # only trailing white space of the class
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: [], 1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3], 4: []}


def test_a_document_of_one_line_many_times(spark):
    """50,000 equal short lines: linear work, and what lies beyond the first occurrence of a span goes."""
    import time

    docs = spark.createDataFrame([(1, "\n".join(["same old line"] * 50_000)), (2, "a b c")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[1].n_lines == 50_000 and got[1].removed_lines >= 49_980 and got[1].text.startswith("same old line")
    assert got[2].text == "a b c" and time.time() - began < 60


def test_line_dedup_of_odd_tables(spark, odd_docs, no_docs):
    assert line_dedup.line_dedup(no_docs).count() == 0
    got = line_dedup.line_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert [r.text for r in got if r.doc_id == 3] == [None]
    assert all(not r.removed for r in got)
