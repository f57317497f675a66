"""Near-duplicate detection by min-max hashing.

Each of ``hashes`` permutations of a document's shingle set yields two signature values, its
minimum and its maximum, so 64 evaluations give 128 values; both agree between two sets with
probability equal to their Jaccard resemblance. Bands of ``rows`` values find candidates, and every
link is confirmed on the full sets. Minimum and maximum of a permutation stand in different bands:
on small sets they agree together less often than apart.

Nothing is enumerated within a group:

* documents with equal sets form one class, and only classes go on;
* in each band bucket the smallest class is the leader; a class is compared with one leader first,
  and the links found join classes into components; then with the leaders of its other buckets that
  are in other components, and then with one more member of the main component of its buckets;
* only buckets that still hold several components are looked at again: there every member outside
  the main component is compared with every member of another component whose set is of a size that
  the similarity allows, in blocks of bounded size to which the sets, not the pairs, are dealt. So
  every candidate pair is compared, differs too much in size or lies in one component already.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chars, checked_broadcast, column_of, id_bitmap, in_bitmap, materialise, pick, positional, small_batches
from .shingles import shared, shingle_sets

HASHES, ROWS = 64, 5
_SET_SCHEMA = "doc_id long, tie long, n_shingles long, class binary, bands binary"


def coefficients(hashes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, hashes, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima under all permutations, then the maxima, so that no band has both of one permutation."""
    low, high = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(items), 2048):
        x = np.multiply.outer(a, items[i : i + 2048])
        x += b[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.concatenate([low, high])


def class_of(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def band_keys(sig: np.ndarray, rows: int) -> bytes:
    bands = len(sig) // rows
    return b"".join(hashlib.blake2b(sig[i * rows : (i + 1) * rows].tobytes(), digest_size=8, salt=i.to_bytes(4, "little")).digest() for i in range(bands))


def _sign(shingle: int, hashes: int, rows: int):
    def task(batches):
        a, b = coefficients(hashes)
        known: set[bytes] = set()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n, cls, bands = [], [], []
            for i, j in by_chars(texts, 1 << 19):
                for items in shingle_sets(texts[i:j], shingle):
                    n.append(len(items))
                    key = class_of(items) if len(items) else None
                    cls.append(key)
                    if key is None or key in known:
                        bands.append(None)  # the class has been signed in this task
                        continue
                    if len(known) > 500_000:
                        known.clear()
                    known.add(key)
                    bands.append(band_keys(signature(items, a, b), rows))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "tie", "n_shingles", "class", "bands"])

    return task


def _sets(shingle: int, bitmap: np.ndarray):
    """Task: the sets of (row_key, text) whose key is in the bitmap, each class once per task."""

    def task(batches):
        known: set[bytes] = set()
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap, batch.column(0).to_numpy(zero_copy_only=False))))
            texts, cls, sets = batch.column(1).to_pylist(), [], []
            for i, j in by_chars(texts, 1 << 19):
                for items in shingle_sets(texts[i:j], shingle):
                    key = class_of(items)
                    if len(items) and key not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known.add(key)
                        cls.append(key)
                        sets.append(items.tobytes())
            yield pa.record_batch([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], names=["class", "items"])

    return task


def _compare(batches):
    for batch in batches:
        both = []
        for x, y in zip(batch.column("items_a"), batch.column("items_b")):
            u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            common = shared(u, v)
            both.append((common, len(u) + len(v) - common))
        c, u = zip(*both) if both else ((), ())
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(c, pa.int64()), pa.array(u, pa.int64())], names=["a", "b", "common", "whole"])


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Intersection and union sizes of the pairs (a, b) of classes."""
    left = sets.select(F.col("class").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("class").alias("b"), F.col("items").alias("items_b"))
    wide = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
    return wide.mapInArrow(_compare, "a binary, b binary, common long, whole long").dropDuplicates(["a", "b"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node that the edges (a, b) reach from it; nodes without edges are absent.

    Labels spread along edges and then jump to their label's label, so the rounds grow with the
    logarithm of a path's length. Each round is written, and only two numbers reach the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b"), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        step = near.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        step = materialise(step, f"{name}-step")
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        after = materialise(jump.select("node", F.least("label", F.coalesce("further", "label")).alias("label")), f"{name}-labels")
        moved = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was")
        if moved.isEmpty():
            return after
        labels = after


def relabelled(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels after the links (a, b) between labelled or unlabelled classes join their components."""
    tag = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    named = links.select("a", "b").join(tag, "a", "left").join(tag.withColumnsRenamed({"a": "b", "la": "lb"}), "b", "left")
    over = components(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), name)
    over = over.select(F.col("node").alias("label"), F.col("label").alias("root"))
    old = labels.join(over, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    fresh = over.select(F.col("label").alias("node"), F.col("root").alias("label")).join(labels.select("node"), "node", "left_anti")
    return materialise(old.unionByName(fresh), f"{name}-labels")


def _blocks(num: int, den: int):
    """Group: members of a bucket's block -> links between members of different labels."""

    def group(table: pa.Table) -> pa.Table:
        rows = table.select(["stray", "class", "label", "items"]).to_pylist()
        xs, ys = [r for r in rows if r["stray"]], [r for r in rows if not r["stray"]]
        found = []
        if xs and ys:
            sets = [np.frombuffer(r["items"], np.uint64) for r in ys]
            size, all_ = np.array([len(s) for s in sets]), np.concatenate(sets)
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            names = np.array([r["label"].hex() for r in ys])
            joined: dict[str, str] = {}

            def root(x: str) -> str:
                while x in joined:
                    x = joined[x]
                return x

            for r in xs:
                x, own = np.frombuffer(r["items"], np.uint64), r["label"].hex()
                if all(n == own for n in names):
                    continue
                k = np.minimum(np.searchsorted(x, all_), len(x) - 1)
                common = np.add.reduceat((x[k] == all_).astype(np.int64), at)
                for j in np.flatnonzero((common * den >= (len(x) + size - common) * num) & (names != own)):
                    p, q = root(own), root(str(names[j]))
                    if p != q:  # one link joins two components
                        joined[max(p, q)] = min(p, q)
                        found.append((r["class"], ys[j]["class"]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return group


def block_links(open_: DataFrame, sets: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links (a, b) within the buckets of ``open_`` (bucket, class, size, label, main, wide).

    Members outside the main component stand as x, all as y; x blocks and y blocks of a bucket meet
    in one group each, so a group holds about two blocks whatever the size of its bucket. Linked sets
    differ in size by a factor of den / num at most. So a wide bucket, one of more than a block, is cut
    into bands of that factor, in which an x meets the y of its own band and of the two beside it,
    and a y goes nowhere that no x of a fitting size stands.
    """
    step = math.log(max(den / num, 1.05)) * (1 + 1e-9)  # a little wide, so that rounding parts no pair
    band = F.when(F.col("wide"), F.floor(F.log("size") / step)).otherwise(F.lit(0)).cast("long")
    rows = materialise(open_.select("bucket", "class", "size", "label", (F.col("label") != F.col("main")).alias("stray"), "wide", band.alias("band")), "near-bands")
    beside = F.explode(F.when(F.col("wide"), F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array("band")))
    x = rows.where("stray").select("bucket", "band", "class", "label", "size")
    y = rows.select("bucket", "class", "label", "size", beside.alias("band"))
    # written, so that its size is known and a bucket with many members can be split in the join
    strays = materialise(x.groupBy("bucket", "band").agg(F.count("*").alias("n_x"), F.min("size").alias("least"), F.max("size").alias("most")), "near-strays")
    y = materialise(y.join(strays, ["bucket", "band"]).where(f"size * {den} >= least * {num} and size * {num} <= most * {den}").drop("least", "most", "size"), "near-fitting")
    # strays are y as well, so a band of one label has nothing to join
    cells = y.groupBy("bucket", "band").agg(F.ceil(F.max("n_x") / block).alias("x_blocks"), F.ceil(F.count("*") / block).alias("y_blocks"), (F.min("label") < F.max("label")).alias("several"))
    cells = materialise(cells.where("several").drop("several"), "near-cells")

    def nth(n):
        return F.pmod(F.xxhash64("class", F.lit(n)), F.col(n)).cast("int")

    def upto(n):
        return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    x = x.join(cells, ["bucket", "band"]).select("bucket", "band", nth("x_blocks").alias("i"), upto("y_blocks").alias("j"), F.lit(True).alias("stray"), "class", "label")
    y = y.join(cells, ["bucket", "band"]).select("bucket", "band", upto("x_blocks").alias("i"), nth("y_blocks").alias("j"), F.lit(False).alias("stray"), "class", "label")
    full = x.unionByName(y).join(sets.dropDuplicates(["class"]), "class")
    return full.groupBy("bucket", "band", "i", "j").applyInArrow(_blocks(num, den), "a binary, b binary")


def _judged(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, hashes: int, rows: int, block: int) -> DataFrame:
    """One row per document: doc_id, tie (hash of the text), n_shingles, component_id, first.

    ``first`` marks one document of each component: the smallest id's, null last, then the smallest tie's.
    """
    small_batches(docs.sparkSession)
    at_least = Fraction(str(similarity))
    num, den = at_least.numerator, at_least.denominator
    src = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    row_key = F.coalesce("doc_id", "tie")
    signed = materialise(src.mapInArrow(_sign(shingle, hashes, rows), _SET_SCHEMA), "near-signed")
    has = signed.where("class is not null")
    classes = materialise(has.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "tie")).alias("first"), F.min(row_key).alias("row_key"), F.count("*").alias("docs"), F.max("n_shingles").alias("size"), F.max("bands").alias("bands")), "near-classes")

    count = 2 * hashes // rows
    key = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(F.col("bands"), i * 8 + 1, F.lit(8))))
    spread = classes.select("class", "size", key.alias("bucket"))
    buckets = materialise(spread.groupBy("bucket").agg(F.min("class").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader"), "near-buckets")
    members = materialise(spread.join(buckets, "bucket"), "near-members")

    first = materialise(members.where("class <> leader").groupBy(F.col("class").alias("b")).agg(F.min("leader").alias("a")), "near-first")
    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select("row_key")
    sets = materialise(src.select(row_key.alias("row_key"), "text").mapInArrow(_sets(shingle, id_bitmap(wanted, "row_key")), "class binary, items binary"), "near-sets")

    led = materialise(compare(first, sets), "near-led")
    linked = F.expr(f"common * {den} >= whole * {num}")
    labels = components(led.where(linked), "near-stars")

    def placed() -> DataFrame:
        """Members of buckets that hold several labels, with their label and the bucket's main one."""
        own = labels.select(F.col("node").alias("class"), "label")
        rows = materialise(members.join(own, "class", "left").withColumn("label", F.coalesce("label", "class")), "near-placed")
        per = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.max_by("class", F.xxhash64("class", "bucket")).alias("pivot")).groupBy("bucket")
        per = per.agg(F.max_by(F.struct("label", "pivot"), F.struct("n", "label")).alias("m"), F.count("*").alias("labels"), F.sum("n").alias("n")).where("labels > 1")
        per = materialise(per.select("bucket", F.col("m.label").alias("main"), F.col("m.pivot").alias("pivot"), (F.col("n") > block).alias("wide")), "near-mixed")
        return materialise(rows.join(per, "bucket"), "near-open")

    def join_pairs(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-pairs")
        return relabelled(labels, materialise(compare(pairs, sets).where(linked), f"{name}-links"), name)

    open_ = placed()
    own = labels.select(F.col("node").alias("leader"), F.col("label").alias("leader_label"))
    apart = open_.join(own, "leader", "left").where(F.col("label") != F.coalesce("leader_label", "leader"))
    labels = join_pairs(apart.select(F.col("class").alias("a"), F.col("leader").alias("b")), "near-leaders")
    open_ = placed()
    labels = join_pairs(open_.where("label <> main").select(F.col("class").alias("a"), F.col("pivot").alias("b")), "near-pivots")
    open_ = placed()
    labels = relabelled(labels, materialise(block_links(open_, sets, num, den, block), "near-blocks"), "near-all")

    named = classes.select("class", "first", "docs").join(labels.select(F.col("node").alias("class"), "label"), "class", "left")
    named = named.withColumn("label", F.coalesce("label", "class"))
    least = materialise(named.groupBy("label").agg(F.min("first").alias("least"), F.sum("docs").alias("docs")).where("docs > 1").drop("docs"), "near-least")
    named = materialise(named.select("class", "label").join(least, "label").select("class", "least"), "near-named")
    out = signed.select("doc_id", "tie", "n_shingles", "class").join(named, "class", "left")
    first = F.col("least").isNull() | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tie") == F.col("least.tie")))
    return out.select("doc_id", "tie", "n_shingles", F.coalesce("least.doc_id", "doc_id").alias("component_id"), first.alias("first"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, hashes: int = HASHES, rows: int = ROWS, block: int = 512) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the resemblance of their shingle sets is at least ``similarity``;
    ``component_id`` is the smallest id that links reach. Texts without words (and null) have empty
    sets and are linked with nothing. A null id never names a component unless all ids of it are
    null; such rows have a null component. Rows with a null id are compared like others and always
    kept. Rows that repeat an id are judged by their own texts; of several texts under a component's
    smallest id the one with the smallest hash is kept. An empty table gives no rows. Other columns
    are not read.
    """
    judged = _judged(docs, id_col, text_col, shingle, similarity, hashes, rows, block)
    return judged.select("doc_id", "n_shingles", "component_id", (F.col("first") | F.col("doc_id").isNull()).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, hashes: int = HASHES, rows: int = ROWS, block: int = 512) -> DataFrame:
    """The documents that stay, one of each group, with all their columns (groups as in ``near_groups``).

    A row is known by its id and text, so other texts under the id of a dropped row stay. A row with a
    null id stays only if nothing else of its group has an id; of several such rows one text stays.
    """
    judged = _judged(docs, id_col, text_col, shingle, similarity, hashes, rows, block)
    gone = materialise(judged.where("not first").select("doc_id", "tie").distinct(), "near-gone")
    inner, names = positional(docs)
    same = F.col(column_of(names, id_col)).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col(column_of(names, text_col)).cast("string")) == F.col("tie"))
    out = inner.join(checked_broadcast(gone), same, "left_anti")
    return out.toDF(*docs.columns)
