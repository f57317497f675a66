"""Resampling of documents toward a target distribution by hashed word n-grams.

Within a task the words of a slice of texts form a trie of two levels: a node is a word, its
children the words that follow it. A node holds how often its path occurs and the CRC state of its
path, so a child's CRC goes on from its parent's state and no n-gram is ever spelt out. Counts of
nodes become totals of buckets, which are merged over all tasks. In a second pass the same tries
carry the gain of each path's bucket, and a document's weight is the mean over the paths that its
words walk.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import rank_within
from .common import materialise, pick, small_batches
from .word_ids import ALPHANUMERIC, WordIndex, word_slices

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7


@functools.lru_cache(128)
def _shift(n: int) -> np.ndarray:
    """What ``n`` appended bytes do to a CRC state, which is linear: an image for each value of each of its four bytes."""
    appended = bytes(n)
    bits = [zlib.crc32(appended, 1 << i) ^ zlib.crc32(appended, 0) for i in range(32)]
    image = np.zeros((4, 256), np.uint32)
    for i, bit in enumerate(bits):
        byte, low = i >> 3, 1 << (i & 7)
        image[byte, low : 2 * low] = image[byte, :low] ^ np.uint32(bit)
    return image


class WordTrie:
    """Nodes of one and two words. The first level stays from slice to slice, the second is that of one slice."""

    LONG = 100

    def __init__(self):
        self.index = WordIndex()
        self.clear()

    def clear(self) -> None:
        self.index.clear()
        self.words: list[bytes] = []
        self.state, self.step, self.length = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int64)

    def grow(self) -> None:
        """Nodes for the words that are new: the state of the word, and that of the word behind a space, as a child appends it."""
        new = list(self.index)[len(self.words) :]
        if new:
            n = len(new)
            self.words += new
            self.state = np.concatenate([self.state, np.fromiter(map(zlib.crc32, new), np.uint32, n)])
            self.step = np.concatenate([self.step, np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, n)])
            self.length = np.concatenate([self.length, np.fromiter(map(len, new), np.int64, n) + 1])

    def children(self, edges: np.ndarray) -> np.ndarray:
        """States of the second level: each parent's state moved on by its child's bytes."""
        parent, word = edges >> 32, edges & 0xFFFFFFFF
        state, length = self.state[parent], self.length[word]
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            if n > self.LONG:
                state[own] = [zlib.crc32(b" " + self.words[w], s) for w, s in zip(word[own].tolist(), state[own].tolist())]
            else:
                image, s = _shift(n), state[own]
                state[own] = image[0, s & 255] ^ image[1, s >> 8 & 255] ^ image[2, s >> 16 & 255] ^ image[3, s >> 24] ^ self.step[word[own]]
        return state


def _edges(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps from a word to the next one of its document, and the places of their first words."""
    inside = np.ones(max(0, len(ids) - 1), bool)
    inside[ends[(ends > 0) & (ends < len(ids))] - 1] = False
    at = np.flatnonzero(inside)
    return ids[at] << 32 | ids[at + 1], at


def _totals(buckets: int, most_words: int = 1 << 20):
    """Task: texts -> bucket, n; at most a row per bucket, whatever the size of the task."""

    def task(batches):
        trie, total = WordTrie(), np.zeros(buckets, np.int64)

        def add(states, counts):
            nonlocal total
            total = total + np.bincount(states % buckets, counts, buckets).astype(np.int64)

        for _, _, _, ids, ends in word_slices(batches, ALPHANUMERIC, trie.index):
            trie.grow()
            add(trie.state, np.bincount(ids, minlength=len(trie.words)))
            edges, counts = np.unique(_edges(ids, ends)[0], return_counts=True)
            add(trie.children(edges), counts)
            if len(trie.words) > most_words:
                trie.clear()
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return task


def bucket_totals(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket; the driver gets a row per bucket, not per feature."""
    small_batches(docs.sparkSession)
    found = pick(docs, text=(text_col, "string")).mapInArrow(_totals(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares in the target and in the raw texts, per bucket, in doubles."""
    of_raw, of_target = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_raw / ((s + 1.0) * of_target))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _weights(gains: np.ndarray, most_words: int = 1 << 20):
    """Task: rows -> doc_id, tie, n_words, n_features, weight, along the paths that the words of a row walk."""

    def task(batches):
        trie = WordTrie()
        for batch, start, end, ids, ends in word_slices(batches, ALPHANUMERIC, trie.index):
            trie.grow()
            gain = gains[trie.state % len(gains)][ids]
            steps, at = _edges(ids, ends)
            edges, walked = np.unique(steps, return_inverse=True)
            gain[at] += gains[trie.children(edges) % len(gains)][walked]
            before = np.concatenate([[0], np.cumsum(gain)])
            words = np.diff(ends, prepend=0)
            n = words + np.maximum(words - 1, 0)
            weight = (before[ends] - before[ends - words]) // np.maximum(n, 1)
            rows = batch.slice(start, end - start)
            yield pa.record_batch([rows.column("doc_id"), rows.column("tie"), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "tie", "n_words", "n_features", "weight"])
            if len(trie.words) > most_words:
                trie.clear()

    return task


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``.

    Features are all runs of one and two words. ``weight`` is the floored mean of the gains of a
    row's features, 0 without any; ``score`` adds Gumbel noise from a hash of seed and id, so the
    floor(percent N / 100) highest scores are a draw without replacement among the N rows of at
    least ``least_words`` words. ``rank`` numbers the draw; other rows have none.

    Null and empty texts have no words, texts are read whole. A null id hashes as an empty string and
    stands before others among equal scores; rows that repeat an id get the same noise and count one
    by one, ties by a hash of the text. An empty ``docs`` gives no rows; an empty target leaves
    smoothed shares. Other columns aren't read.
    """
    gains = bucket_gains(bucket_totals(docs, text_col, buckets), bucket_totals(target, target_col, buckets))
    rows = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("tie", F.xxhash64("text"))
    told = rows.mapInArrow(_weights(gains), "doc_id long, tie long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    told = materialise(told.withColumn("score", F.col("weight") + noise), "importance-scores")
    able = F.col("n_words") >= least_words
    drawn = told.where(able).count() * percent // 100
    ranked = rank_within(told.where(able), [], [F.col("score").desc(), F.col("doc_id"), F.col("tie")]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    out = ranked.unionByName(told.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
