"""Removal of repeated runs of lines by winnowing, with DataFrame functions only.

Lengths are counted in words, so that one long line weighs as much as many short ones. A gram at a
line is the hash of the lines from there on that start within ``gram_words`` words; a window at a
line holds the grams of the lines that start within the next ``window_words`` words. The minimum of
each window is a fingerprint. A run of whole lines of at least ``gram_words + window_words`` words
contains a window of its own, so wherever it stands it has the same fingerprint there, and only
windows whose fingerprint has another position are looked at again.

Around such a fingerprint the text is extended both ways: from each line whose window picked it on,
and back from each line that ends such a window's run, by whole lines until there are
``gram_words + window_words`` words. The positions of equal extensions are joined to the first of
them, never to one another, so a group of n places costs n rows. Joined positions of the same two
documents at the same distance make up one run with its source; the lines of the later runs go.

The guarantee: a line goes if and only if it lies in a run of at least ``gram_words + window_words``
words of whole lines that also stands at an earlier place. Joining the bare fingerprints to their
first position and extending there wouldn't give that, as the first place of a fingerprint may have
less of a run than the second; so what is joined is the position with its extension.

The first occurrence of a line is never deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, checked_broadcast, materialise, partitions, pick

GRAM_WORDS, WINDOW_WORDS = 25, 25


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, tie, line, pos (among lines with words), h, h2, words: one row per line with words.

    h and h2 are independent 64-bit hashes: h finds places, both together tell contents apart.
    """
    words = F.size(F.filter(F.split("text_line", f"{SPACE_CLASS}+"), lambda w: w != ""))
    rows = docs.select("doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("line", "text_line"))
    rows = rows.select("doc_id", "tie", "line", F.rtrim("text_line", F.lit(SPACES)).alias("own"), words.alias("words")).where("words > 0")
    rows = rows.select("doc_id", "tie", "line", F.xxhash64("own").alias("h"), F.xxhash64(F.lit("again"), "own").alias("h2"), "words")
    # rows that repeat id and text are one document; they go line by line, before its lines meet
    rows = rows.distinct().repartition(partitions(docs.sparkSession), "doc_id", "tie")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("line")) - 1)


def winnow(lines: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``lines`` with start (words before the line) and pick: gram and pos of the minimum of its window."""
    doc = Window.partitionBy("doc_id", "tie")
    rows = lines.withColumn("start", F.sum("words").over(doc.orderBy("pos")) - F.col("words"))
    ahead = doc.orderBy("start")
    span = ahead.rangeBetween(0, gram_words - 1)
    rows = rows.withColumn("span", F.collect_list("h").over(span)).withColumn("span_words", F.sum("words").over(span))
    rows = rows.withColumn("gram", F.when(F.col("span_words") >= gram_words, F.struct(F.xxhash64("span").alias("g"), F.col("pos").alias("p")))).drop("span", "span_words")
    return rows.withColumn("pick", F.min("gram").over(ahead.rangeBetween(0, window_words - 1))).drop("gram", "start")


def _same(other: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(f"{other}_id")) & (F.col("tie") == F.col(f"{other}_tie"))


def extensions(lines: DataFrame, least_words: int) -> DataFrame:
    """doc_id, tie, g, p, lines: fingerprints extended both ways to the shortest runs of ``least_words`` words.

    ``lines`` has wanted: whether the fingerprint of the line's window stands elsewhere too. A run
    starts at a line whose window is wanted, or ends at a line and starts at one. g, 128 bits, tells
    contents apart, p is the pos of the first line and lines their number.
    """
    doc = Window.partitionBy("doc_id", "tie")
    rows = lines.select("doc_id", "tie", "pos", "h", "h2", "words", "wanted", F.sum("words").over(doc.orderBy("pos")).alias("end"))
    rows = rows.withColumn("start", F.col("end") - F.col("words"))
    ahead, back = doc.orderBy("start").rangeBetween(0, least_words - 1), doc.orderBy("end").rangeBetween(1 - least_words, 0)
    for name, frame in (("ahead", ahead), ("back", back)):
        rows = rows.withColumn(name, F.collect_list("h").over(frame)).withColumn(f"{name}2", F.collect_list("h2").over(frame)).withColumn(f"{name}_words", F.sum("words").over(frame))
    rows = rows.withColumn("back_wanted", F.first("wanted").over(back))

    def run(name, p):
        return F.struct(F.struct(F.xxhash64(name).alias("x"), F.xxhash64(f"{name}2").alias("y")).alias("g"), p.alias("p"), F.size(name).alias("lines"))

    # a run up to a line that is too short without the line is also the run from its first line on
    found = F.array(
        F.when(F.col("wanted") & (F.col("ahead_words") >= least_words), run("ahead", F.col("pos"))),
        F.when(F.col("back_wanted") & (F.col("back_words") - F.col("words") >= least_words), run("back", F.col("pos") - F.size("back") + 1)),
    )
    return rows.select("doc_id", "tie", F.explode(F.array_compact(found)).alias("s")).select("doc_id", "tie", "s.g", "s.p", "s.lines")


def repeated_runs(lines: DataFrame, least_words: int = GRAM_WORDS + WINDOW_WORDS) -> DataFrame:
    """doc_id, tie, p, upto, a_id, a_tie, a_p: runs of lines p to upto - 1 that stand earlier at (a_id, a_tie, a_p).

    ``lines`` comes from ``winnow``. Runs of one document may overlap where their sources differ.
    """
    prints = materialise(lines.where("pick is not null").select("doc_id", "tie", "pick.g", "pick.p").distinct().select("doc_id", "tie", "g"), "line-prints")
    shared = materialise(prints.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "line-shared")
    again = materialise(prints.join(shared, "g").select(F.col("doc_id").alias("n_id"), F.col("tie").alias("n_tie")).distinct(), "line-documents")
    near = lines.withColumn("g", F.col("pick.g")).drop("pick").join(again, _same("n"), "left_semi")
    near = materialise(near.join(shared.withColumn("wanted", F.lit(True)), "g", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False))), "line-candidates")

    found = materialise(extensions(near, least_words), "line-extensions")
    place = F.struct(F.col("doc_id").isNotNull().alias("numbered"), "doc_id", "tie", "p")
    first = found.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select("g", F.col("first.doc_id").alias("a_id"), F.col("first.tie").alias("a_tie"), F.col("first.p").alias("a_p")), "line-first")
    later = found.join(first, "g").where(~(_same("a") & (F.col("p") == F.col("a_p"))))
    # extensions of one document that lie at the same distance from their first places and touch are one run
    side = Window.partitionBy("doc_id", "tie", "a_id", "a_tie", F.col("p") - F.col("a_p")).orderBy("p", "lines")
    reach = F.max(F.col("p") + F.col("lines")).over(side.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("begins", F.coalesce((F.col("p") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("begins").over(side))
    runs = runs.groupBy("doc_id", "tie", "a_id", "a_tie", (F.col("p") - F.col("a_p")).alias("shift"), "run").agg(F.min("p").alias("p"), F.max(F.col("p") + F.col("lines")).alias("upto"))
    return runs.select("doc_id", "tie", "p", "upto", "a_id", "a_tie", (F.col("p") - F.col("shift")).alias("a_p"))


def repeated_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, tie, line, words of each line to delete. ``docs`` has doc_id, text, tie."""
    lines = materialise(winnow(line_table(docs), gram_words, window_words), "lines")
    runs = repeated_runs(lines, gram_words + window_words)
    gone = runs.select(F.col("doc_id").alias("b_id"), F.col("tie").alias("b_tie"), F.explode(F.sequence(F.col("p"), F.col("upto") - 1)).alias("b_pos"))
    gone = materialise(gone.distinct(), "line-repeats")
    return lines.join(gone, _same("b") & (F.col("pos") == F.col("b_pos")), "left_semi").select("doc_id", "tie", "line", "words")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """Per row: doc_id, text without later repeats, n_lines, removed_lines, removed_words, removed (line numbers from 0).

    Lines end at line feeds; lines without words never match and stay. Trailing white space doesn't
    tell lines apart. Documents are ordered by id (null first), then by a hash of the text; the
    first occurrence of a run stays. A null text gives a null text and no lines. Rows that repeat
    both id and text count as one document and get the same text. An empty table gives no rows.
    """
    src = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("tie", F.xxhash64("text"))
    gone = repeated_lines(src, gram_words, window_words)
    gone = gone.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list("line")).alias("removed"), F.sum("words").alias("removed_words"))
    gone = checked_broadcast(materialise(gone.withColumnsRenamed({"doc_id": "g_id", "tie": "g_tie"}), "line-gone"), arrays="removed")
    out = src.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")), "left")
    lines = F.split("text", "\n")

    def without(own):
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "removed"), lambda i: F.get(own, i)), "\n")

    # the lines are bound once to a lambda variable; as an expression they'd be split per line
    left = F.element_at(F.transform(F.array(lines), without), 1)
    none = F.array().cast("array<int>")
    return out.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left).alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("removed_lines"), F.coalesce("removed_words", F.lit(0).cast("long")).alias("removed_words"), F.coalesce("removed", none).alias("removed"))
