"""The pipeline's stages one after the other, each against brute force on its own input."""

import base64
import math
import random
import re
from collections import Counter

import corpus_pipeline

from colloquy.llm import langid
from colloquy.llm.common import materialise
from test_dedup import WORD, brute_components, brute_sets
from test_other import brute_targets

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_mix(rows):
    """Whole rows and their copies: one grid of integers over each source in the order of size and id."""
    sizes, order = Counter(), {}
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
        order.setdefault(r.source, []).append((len(WORD.findall(r.text or "")), r.doc_id, r))
    targets, offset, out = brute_targets(sizes), random.Random(42).random(), Counter()
    for source, own in order.items():
        for k, (_, _, row) in enumerate(sorted(own, key=lambda x: x[:2])):
            if sizes[source]:
                low, high = (math.floor(i * targets[source] / sizes[source] + offset) for i in (k, k + 1))
                out[row] += min(3, high - low)
    return +out


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("*", "doc_id").toDF("doc_id", "text", "lang", "source", "n_chars", "class")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, ""), f"test-{name}")
        seen[name] = before.collect(), docs.collect()
        if name != "byte_bpe":
            assert docs.columns == names
    before, after = seen["language_id"]
    told = {r.doc_id: r for r in langid.predict(spark.createDataFrame(before), langid.fit(spark.createDataFrame(before))).collect()}
    lettered = {r.doc_id for r in before if r.text and any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in after} == lettered - {r.doc_id for r in before if r.lang and told[r.doc_id].lang_pred != r.lang and told[r.doc_id].score >= langid.SURE}
    before, after = seen["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(SPACE.sub(" ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    before, after = seen["near_dedup"]
    ids = [r.doc_id for r in before]
    assert {r.doc_id for r in after} == set(brute_components(ids, brute_sets([r.text for r in before], 5)).values())
    before, after = seen["mixing"]
    assert Counter(after) == brute_mix(before)
    before, after = seen["byte_bpe"]
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in after) == sorted((r.doc_id, own.encode_ordinary(r.text)) for r in before)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "test-empty")
        assert docs.count() == 0
