"""Audit of how far the sources of a language differ in their words.

Tasks count terms per (lang, source) and send a row per distinct term. Kept terms are dealt over
blocks by hash; a block is a dense int64 matrix of sources by terms. All pairs of its rows are
compared by broadcasting, which gives a partial matrix of pair sums, and each source keeps a heap of
its most overused terms. Partial matrices are summed and heaps merged over blocks.

A language of many sources has its rows cut into tiles of ``TILE`` sources, and a block exists once
per pair of tiles, so a matrix never has more than 2 TILE rows and about ``BLOCK`` columns.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, pick, small_batches
from .word_ids import ALPHABETIC, WordIndex, row_numbers, totals, word_slices

LEAST, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
BLOCK, TILE = 1024, 128
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(most_words: int = 1 << 20, most_entries: int = 1 << 22):
    """Task: rows of texts -> lang, source, term, occurrences, documents; bounded by words and entries held."""

    def rows(index, groups, held):
        keys, n, docs = totals(*map(np.concatenate, zip(*held)))
        words = pa.array(list(index), pa.binary()).cast(pa.string())
        langs, sources = (pa.array(list(c), pa.string()) for c in zip(*groups))
        for i in range(0, len(keys), 1 << 16):
            k = keys[i : i + (1 << 16)]
            g = pa.array(k & 0xFFFFFFFF)
            cols = [langs.take(g), sources.take(g), words.take(pa.array(k >> 32)), pa.array(n[i : i + len(k)]), pa.array(docs[i : i + len(k)])]
            yield pa.record_batch(cols, names=["lang", "source", "term", "n", "docs"])

    def task(batches):
        index, groups, held, size = WordIndex(), {}, [], 0
        for batch, start, end, ids, ends in word_slices(batches, ALPHABETIC, index):
            part = batch.slice(start, end - start)
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())], np.int64)
            # once per document and term, then once per group and term
            own, n = np.unique(row_numbers(ends) << 32 | ids, return_counts=True)
            keys, n, docs = totals((own & 0xFFFFFFFF) << 32 | group[own >> 32], n, np.ones(len(own), np.int64))
            held.append((keys, n, docs))
            size += len(keys)
            if size > most_entries:
                held = [totals(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
            if 2 * size > most_entries or len(index) > most_words:
                yield from rows(index, groups, held)
                index.clear()
                groups, held, size = {}, [], 0
        if size:
            yield from rows(index, groups, held)

    return task


def share(count: np.ndarray, total, terms: int, scale: int = SCALE, prior: int = PRIOR) -> np.ndarray:
    """1 + floor(scale * (count + prior) / (total + prior * terms)), exact: digit by digit in int64.

    Exact as long as ten times the denominator stays below 2 ** 63.
    """
    rest = np.asarray(count, np.int64) + prior
    of = np.asarray(total, np.int64) + prior * terms
    out = rest // of
    rest = rest - out * of
    for _ in range(len(str(scale)) - 1):
        rest = rest * 10
        digit = rest // of
        out, rest = out * 10 + digit, rest - digit * of
    return out + 1


def _tile(top: int, tile: int, most_cells: int = 1 << 22):
    """One block of one pair of tiles -> partial pair sums (i, j, value) and the heap of each source (i, term, value)."""

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lang, number, a, b = (k.as_py() for k in key)
        rows = rows.combine_chunks()
        head = rows["term"].is_null().to_numpy()
        src, n, lang_n = (rows[c].to_numpy() for c in ("src", "n", "lang_n"))
        order = np.argsort(src[head])
        own, size = src[head][order], n[head][order]
        lang_size, kept = int(lang_n[head][0]), int(rows["v"].to_numpy()[head][0])
        cells = rows["term"].drop_null()
        terms = pc.unique(cells)
        terms = terms.take(pc.sort_indices(terms))
        at = pc.index_in(cells, terms).to_numpy()
        count, total = np.zeros((len(own), len(terms)), np.int64), np.zeros(len(terms), np.int64)
        count[np.searchsorted(own, src[~head]), at] = n[~head]
        total[at] = lang_n[~head]
        out = {"i": [], "j": [], "term": [], "value": []}
        p = share(count, size[:, None], kept) if len(terms) else count
        # a kept term that neither tile has isn't a column: its difference, that of no occurrence, is
        # added for all kept terms once, in block 0, and taken off again for each column
        none = share(np.zeros(len(own), np.int64), size, kept) if kept else np.zeros(len(own), np.int64)
        unseen = (kept if number == 0 else 0) - len(terms)
        left, right = np.flatnonzero(own // tile == a), np.flatnonzero(own // tile == b)
        step = max(1, most_cells // max(1, len(right) * len(terms)))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            sums = np.abs(p[i][:, None, :] - p[right][None, :, :]).sum(axis=2) + unseen * np.abs(none[i][:, None] - none[right][None, :])
            x, y = np.nonzero(i[:, None] < right[None, :])
            out["i"] += own[i[x]].tolist()
            out["j"] += own[right[y]].tolist()
            out["term"] += [None] * len(x)
            out["value"] += sums[x, y].tolist()
        if a == b and len(terms):
            over = p - share(total, lang_size, kept)
            for i, (c, f) in enumerate(zip(count, over)):
                found = np.flatnonzero((c > 0) & (f > 0))
                best = heapq.nsmallest(top, zip((-f[found]).tolist(), found.tolist()))
                out["i"] += [int(own[i])] * len(best)
                out["j"] += [None] * len(best)
                out["term"] += terms.take(pa.array([k for _, k in best], pa.int64())).to_pylist()
                out["value"] += [-f for f, _ in best]
        cols = [pa.array([lang] * len(out["i"]), pa.string()), pa.array(out["i"], pa.int32()), pa.array(out["j"], pa.int32()), pa.array(out["term"], pa.string()), pa.array(out["value"], pa.int64())]
        return pa.table(cols, names=["lang", "i", "j", "term", "value"])

    return work


def kept_terms(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, lang_n, first: counts of the terms that stand in at least ``least`` documents of their language.

    ``lang_n`` counts the whole language; ``first`` is true for one row of each (lang, term). Null
    texts, languages and sources count as empty.
    """
    small_batches(docs.sparkSession)
    named = {"text": (text_col, "string"), "lang": (lang_col, "string"), "source": (source_col, "string")}
    rows = pick(docs, **named).select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    # dealt by (lang, term), which serves the sums per source as well as those per language
    dealt = rows.mapInArrow(_count(), _COUNTS).repartition("lang", "term")
    whole = Window.partitionBy("lang", "term")
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole), "first": F.col("source") == F.min("source").over(whole)})
    return counts.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", "first")


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, tile: int = TILE, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that occurs.

    Part ``pair`` has a row per other source of the language: the sum over its kept terms of the
    difference of their smoothed shares; part ``term`` the ``top`` terms whose share in the source
    exceeds the language's most. Ranks go by value descending, then item.

    Null texts, languages and sources count as empty strings. A language without kept terms has pair
    rows of value 0; a group without terms has the shares of zero counts; a language of one source
    has no pair rows. Repeated rows count each time, ids and other columns aren't read, and an empty
    table gives no rows. Texts are counted whole, whatever their length.
    """
    named = {"lang": (lang_col, "string"), "source": (source_col, "string")}
    counts = materialise(kept_terms(docs, least, text_col, lang_col, source_col), "divergence-terms")
    occurring = pick(docs, **named).select(*(F.coalesce(c, F.lit("")).alias(c) for c in named)).distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("first").alias("v"))
    groups = occurring.join(sizes, ["lang", "source"], "left").fillna(0, ["size", "v"])
    by_lang = Window.partitionBy("lang")  # a row per source
    groups = groups.withColumns({
        "src": (F.row_number().over(by_lang.orderBy("source")) - 1).cast("int"), "sources": F.count("*").over(by_lang),
        "lang_size": F.sum("size").over(by_lang), "v": F.sum("v").over(by_lang),
    })
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block)).cast("int"))
    groups = materialise(groups.withColumn("tiles", F.ceil(F.col("sources") / tile).cast("int")), "divergence-groups")

    own = F.floor(F.col("src") / tile).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    tiles = F.explode(F.transform(others, lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b")))).alias("t")
    named = groups.select("lang", "source", "src", "tiles", "blocks")
    number = F.pmod(F.xxhash64("term"), F.col("blocks").cast("long")).cast("int")
    cells = counts.join(checked_broadcast(named), ["lang", "source"]).select("lang", number.alias("block"), "src", "term", "n", "lang_n", F.lit(None).cast("long").alias("v"), tiles)
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "src", F.lit(None).cast("string").alias("term"), F.col("size").alias("n"), F.col("lang_size").alias("lang_n"), "v", "tiles")
    heads = heads.select("lang", "block", "src", "term", "n", "lang_n", "v", tiles)
    rows = cells.unionByName(heads).select("lang", "block", "t.a", "t.b", "src", "term", "n", "lang_n", "v")
    found = materialise(rows.groupBy("lang", "block", "a", "b").applyInArrow(_tile(top, tile), "lang string, i int, j int, term string, value long"), "divergence-tiles")

    sums = found.where("term is null").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "value").select("lang", "p.i", "p.j", "value")
    name_i = checked_broadcast(groups.select("lang", F.col("src").alias("i"), "source"))
    name_j = checked_broadcast(groups.select("lang", F.col("src").alias("j"), F.col("source").alias("item")))
    pairs = both.join(name_i, ["lang", "i"]).join(name_j, ["lang", "j"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = found.where("term is not null").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(F.col("value").desc(), "term"))).where(F.col("rank") <= top)
    terms = terms.join(name_i, ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return pairs.unionByName(terms)
