"""Document fingerprints: bottom-k sketches of hashed word shingles, with DataFrame functions only.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's shingles in ascending order.
Sketches of parts merge to the sketch of the whole, and two of them estimate resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, partitions, pick

K, SHINGLE = 128, 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Bottom-k sketch of a text.

    Words are runs of characters other than space and x09-x0D. A text of fewer words than a shingle
    gives its whole sequence as one shingle; null and wordless texts give an empty sketch.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        full = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, shingle))))
        return F.when(F.size(h) >= shingle, F.slice(full, F.lit(1), F.greatest(F.size(h) - (shingle - 1), F.lit(0)))).when(F.size(h) > 0, F.array(F.xxhash64(h, F.lit(shingle)))).otherwise(F.lit(None).cast("array<bigint>"))

    # the hashed words are bound once to a lambda variable; as an expression they'd be computed per element
    one = F.element_at(F.transform(F.array(hashed), shingles), 1)
    return bottom(F.coalesce(one, F.array().cast("array<bigint>")), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance; two empty sketches have 1, an empty and another 0."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    whole = F.size(merge(a, b, k))
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    r = resemblance(a, b, k)
    n, m = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (n + m) / (1 + r) / n))


def as_string(a: Column) -> Column:
    """The sketch as base64 of its big-endian hashes, in one line."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), "\r\n", "")


def _part_of(value: Column, bounds: list[int], wide: int = 32) -> Column:
    """How many of the sorted bounds are at most ``value``, through blocks of bounds."""
    if not bounds:
        return F.lit(0)
    blocks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    heads = F.lit([b[0] for b in blocks])
    i = F.size(F.filter(heads, lambda b: b <= value))
    inner = F.get(F.array(*[F.lit(b) for b in blocks]), i - 1)
    return F.when(value.isNull() | (i == 0), F.lit(0)).otherwise((i - 1) * wide + F.size(F.filter(inner, lambda b: b <= value)))


def _ranges(docs: DataFrame, m: int) -> Column:
    """The range of a row with doc_id and tie: about ``m`` ranges in ascending order of both, null ids first.

    At most 2 m numbers reach the driver. An id (or null) that fills several ranges is cut by its
    ties, which are hashes and so fall evenly into parts.
    """
    told = docs.agg(F.percentile_approx("doc_id", [i / m for i in range(1, m)], 20 * m).alias("b"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("n")).first()
    bounds = told.b or []
    share = F.col("tie") / F.lit(2.0**64) + 0.5
    no_id = max(1, -(-m * told.nulls // max(1, told.n)))
    apart = sorted(set(bounds))
    times = [bounds.count(b) for b in apart]
    # rows below the first bound fill one range, rows from a bound on as many as the bound stands for
    first = [no_id, *(no_id + 1 + sum(times[:i]) for i in range(len(apart)))]
    i = _part_of(F.col("doc_id"), apart)
    within = F.when(F.col("doc_id") == F.get(F.lit(apart), i - 1), F.least(F.floor(share * F.get(F.lit(times), i - 1)).cast("int"), F.get(F.lit(times), i - 1) - 1)).otherwise(F.get(F.lit(times), i - 1) - 1) if apart else F.lit(0)
    return F.when(F.col("doc_id").isNull(), F.least(F.floor(share * no_id).cast("int"), F.lit(no_id - 1))).otherwise(F.get(F.lit(first), i) + F.coalesce(within, F.lit(0)))


def with_next(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each row with the next in ascending order of id.

    Rows are dealt over ranges of ids, each of which gets a copy of the first row of the range that
    follows; so the texts are shuffled once and no range needs another. Null ids come first; equal
    ids are ordered by a hash of their texts. After the last row comes the first.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    keyed = keyed.withColumn("part", _ranges(keyed, 4 * partitions(spark)))
    # a row per range: its first document
    firsts = keyed.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("f")).orderBy("part").collect()
    firsts = [(r.part, r.f.doc_id, r.f.tie) for r in firsts]
    parts = [f[0] for f in firsts]
    guests = spark.createDataFrame([(p, d, t, parts[i - 1]) for i, (p, d, t) in enumerate(firsts)], "g_part int, g_id long, g_tie long, g_to int")
    on = (F.col("part") == F.col("g_part")) & F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie"))
    visiting = keyed.join(F.broadcast(guests), on).select("doc_id", "text", "tie", F.col("g_to").alias("part"), F.lit(1).alias("guest"))
    rows = keyed.select("doc_id", "text", "tie", "part", F.lit(0).alias("guest")).unionByName(visiting)
    rows = rows.withColumn("sketch", sketch(F.col("text"), k, shingle))
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    return rows.select("doc_id", "guest", "text", "sketch", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch")).where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, n_chars, fingerprint (string), sketch and estimated distinct shingles."""
    rows = pick(docs, doc_id=(id_col, None), text=(text_col, "string")).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), sketch(F.col("text"), k, shingle).alias("sketch"))
    return rows.select("doc_id", "n_chars", as_string(F.col("sketch")).alias("fingerprint"), "sketch", distinct_shingles(F.col("sketch"), k).alias("shingles"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document. Null texts count as empty; an empty table gives no rows; a single
    document is its own next. Ids may be null or repeat. Other columns are not read.
    """
    rows = with_next(pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")), k, shingle)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), k, shingle).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
