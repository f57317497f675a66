"""The vocabulary of topics and its ladder of settings."""

import pytest

from colloquy.operators import topics


def vocabulary(spark, rows):
    counts, setting = topics.topic_vocabulary(spark.createDataFrame(rows, "cluster_id int, text string"), "text")
    return {(r.cluster_id, r.term): r.n for r in counts.collect()}, setting


def long(words, i):
    return f"{words} unique{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} filler filler filler filler"


def test_strict_setting_counts_topics_not_texts(spark):
    rows = [(i % 3, long(("kiwi plum", "plum", "fig fig")[i % 3], i)) for i in range(120)] + [(-1, long("fig the", 0))]
    got, s = vocabulary(spark, rows)
    assert s == topics.Setting("tokens", True, 2, 0.95)
    # kiwi stands in one topic, filler in all four, the is a stop word
    assert got[(0, "plum")] == 40 and got[(2, "fig")] == 80 and got[(-1, "fig")] == 1
    assert not {"kiwi", "filler", "the"} & {t for _, t in got}


def test_few_documents_need_one_topic(spark):
    got, s = vocabulary(spark, [(i % 3, long("kiwi" if i % 3 else "fig", i)) for i in range(30)])
    assert s.min_df == 1 and (0, "fig") in got and (1, "kiwi") in got


@pytest.mark.parametrize(
    "text, setting, term",
    [
        ("Same Words", topics.Setting("tokens", False, 1, 1.0), "same"),
        ("12 34", topics.Setting("words", False, 1, 1.0), "12"),
        ("x y", topics.Setting("grams", False, 1, 1.0), " x "),
    ],
)
def test_alike_texts_go_down_the_ladder(spark, text, setting, term):
    got, s = vocabulary(spark, [(i % 2, text) for i in range(8)])
    assert s == setting and got[(0, term)] == 4


def test_ladder_order():
    assert [s.max_df for s in topics.ladder(500, False)] == [0.95, 0.95, 1.0, 1.0, 1.0]
    assert [s.terms for s in topics.ladder(500, True)] == ["tokens", "words", "grams", "tokens", "tokens"]
    assert [topics.least_topics(n) for n in (0, 99, 100, 10_000)] == [1, 1, 2, 2]


def test_nothing_to_count_raises(spark):
    with pytest.raises(ValueError, match="2 texts, 0 with content"):
        vocabulary(spark, [(0, ""), (1, None)])


def test_keywords_leave_noise_out(spark):
    rows = [(i % 2, long(("kiwi", "fig")[i % 2], i)) for i in range(40)] + [(-1, long("plum", 3))]
    df = spark.createDataFrame(rows, "cluster_id int, text string")
    got = {r.cluster_id: {w.term for w in r.words} for r in topics.topic_keywords(df, "text", top=100).collect()}
    assert set(got) == {0, 1} and "kiwi" in got[0] - got[1] and "fig" in got[1] - got[0]
    assert not {"plum", "filler"} & (got[0] | got[1])


def test_character_grams_stay_within_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" Ab  cde",), ("",), ("x",)], "t string")
    got = [r.g for r in df.select(topics.char_ngrams(F.col("t")).alias("g")).collect()]
    assert got == [[" ab", "ab ", " cd", "cde", "de ", " ab ", " cde", "cde ", " cde "], [], [" x "]]
