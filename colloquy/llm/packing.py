"""Packing of tokenized documents into sequences, in their order, by dynamic programming.

Documents stand one after the other in ascending order of id. A sequence is a window of that stream
of at most ``window`` tokens; it is padded to ``window`` unless its length is a power of two. Cuts
fall at document ends, at sentence ends or, at a price, inside a sentence, and are chosen to make
the padding plus the penalties of cut documents least:

    cost(j) = penalty(j) + min(window - p(j) + min over p(j) - window <= p(i) < p(j) of cost(i) + p(i),
                               min over powers of two n of cost at p(j) - n)

The inner minimum moves over a sliding window, so a monotone queue gives it in constant time.

Each range of documents is packed by a task of its own. A task works on a stretch of the stream at a
time: it commits the windows of the best path and carries what is behind the last one to the next
stretch, so memory is bounded by the stretch (or one longer document) and only the last sequence of
a task ends where no cut was chosen.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import deque
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, pick, small_batches

WINDOW, SENTENCE_PENALTY, INSIDE_PENALTY, STRETCH = 4096, 4, 16, 1 << 19
#: Inside a stretch without a cut, so many tokens lie between the places where one is allowed.
INSIDE_EVERY = 32
_MARKS, _CLOSING = (".", "!", "?", "…", "。", "！", "？"), "\"')]}"
_SEQUENCE = "sequence_id long, ids binary, doc_id array<long>, start array<long>, length array<long>, doc_tokens array<long>"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct unit between ASCII white space once.

    For tokenizers that drop white space and never match across it: then the ids of a text are those
    of its units. A unit of Latin letters with marks behind it is the word and the marks. A probe is
    encoded both ways first; a tokenizer that differs gets whole texts.
    """

    def __init__(self, path: str, most: int = 900_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tokenize, marks = tok.model.tokenize, punctuation.encode()

        def encoded(data: bytes) -> bytes:
            return array("I", tok.encode(data.decode(), add_special_tokens=False).ids).tobytes()

        def word(data: bytes) -> bytes:
            return array("I", [t.id for t in tokenize(data.decode().lower())]).tobytes() if data.isalpha() else encoded(data)

        class Units(dict):
            missed = 0

            def __missing__(self, unit: bytes) -> bytes:
                stem = unit.rstrip(marks)
                if len(stem) == len(unit) or not stem:
                    out = word(unit)
                elif stem.isalpha() or ((text := stem.decode().lower()).isalpha() and max(text) < "ɐ"):
                    out = self[stem] + self[unit[len(stem) :]]
                else:
                    out = encoded(unit)
                if len(self) < most:
                    if len(unit) < 100:
                        self[unit] = out
                else:  # full: common units are in; only as many misses as there are units call for a new start
                    self.missed += 1
                    if self.missed > most:
                        self.clear()
                        self.missed = 0
                return out

        self._units, self._whole = Units(), encoded
        probe = "The quick brown\tfox's été, (a) b2b: 3.14!\n\nIt wasn't…  Straightforward ÉTÉ.".encode()
        self._by_unit = b"".join(map(self._units.__getitem__, probe.split())) == encoded(probe)

        def mark(i: int) -> str:
            return (tok.id_to_token(i) or "").removesuffix("</w>")

        shown = tuple(tok.pre_tokenizer.pre_tokenize_str(m)[0][0] for m in _MARKS)
        size = tok.get_vocab_size()
        #: Per id: whether a sentence may end there, and whether it can't start there.
        self.ends = np.array([mark(i).rstrip(_CLOSING).endswith(shown) for i in range(size)] + [False])
        self.goes_on = np.array([mark(i).isdigit() for i in range(size)] + [False])

    def __call__(self, data: bytes | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        if not data:
            return b""
        return b"".join(map(self._units.__getitem__, data.split())) if self._by_unit else self._whole(data)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places behind a mark that ends a sentence, within the ids."""
        known = np.minimum(ids, len(self.ends) - 1)
        return np.flatnonzero(self.ends[known[:-1]] & ~self.goes_on[known[1:]]) + 1


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """A Python worker serves many tasks; what it has encoded stays in its memory."""
    return WordEncoder(path)


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int, last: bool) -> list[int]:
    """Ascending places at which windows end, from candidate places (ascending, above 0) and their penalties.

    With ``last`` the final place must be one; without, the path may end anywhere in the last window.
    No two neighbouring candidates are more than ``window`` apart. Among equal costs the earliest
    start of a window wins.
    """
    at = np.concatenate([[0], places])
    # windows of a power of two: pairs of candidates so far apart
    here, there = [], []
    for k in range(window.bit_length()):
        found = np.searchsorted(at, at - (1 << k))
        same = np.flatnonzero((at[found] == at - (1 << k)) & (1 << k <= window))
        here.append(same)
        there.append(found[same])
    here, there = np.concatenate(here), np.concatenate(there)
    order = here.argsort(kind="stable")
    first = np.searchsorted(here[order], np.arange(len(at) + 1)).tolist()
    there, p, penalty = there[order].tolist(), at.tolist(), [0, *penalties.tolist()]
    cost, parent, reach = [0] * len(p), [0] * len(p), [0] * len(p)  # reach is cost plus place
    queue = deque([0])
    for j in range(1, len(p)):
        low = p[j] - window
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = reach[i] + window - p[j]
        for k in there[first[j] : first[j + 1]]:
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], parent[j] = best + penalty[j], i
        reach[j] = value = cost[j] + p[j]
        while queue and reach[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    j = len(p) - 1
    if not last:
        tail = int(np.searchsorted(at, at[-1] - window, side="right"))
        j = min(range(max(1, tail), len(p)), key=lambda k: (cost[k], -k))
    cuts = []
    while j:
        cuts.append(p[j])
        j = parent[j]
    return cuts[::-1]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, window: int, sentence_penalty: int, inside_penalty: int, every: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and penalties: document ends free, sentence ends, and places inside where neither is near.

    In the last window of a last stretch every place is one, so that what is left can be cut into
    powers of two.
    """
    places = np.unique(np.concatenate([doc_ends, sentence_ends, [total]]))
    before = np.concatenate([[0], places[:-1]])
    wide = np.flatnonzero(places - before > 2 * every)
    inside = [np.arange(a + every, b, every) for a, b in zip(before[wide].tolist(), places[wide].tolist())]
    if last:
        inside.append(np.arange(max(1, total - window), total))
    every_place = np.unique(np.concatenate([places, *inside]))
    penalties = np.full(len(every_place), inside_penalty, np.int64)
    penalties[np.searchsorted(every_place, sentence_ends)] = sentence_penalty
    penalties[np.searchsorted(every_place, doc_ends)] = 0
    return every_place, penalties


def _pack(tokenizer: str, end_id: int | None, window: int, sentence_penalty: int, inside_penalty: int, every: int, stretch: int):
    def task(batches):
        from pyspark import TaskContext

        encoder, shard, made = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        held, size = [], 0  # doc_id, tokens of the document, start of what is held, its ids

        def packed(last: bool):
            nonlocal held, size, made
            lengths = [len(h[3]) for h in held]
            bounds = np.cumsum(lengths)
            inner = [encoder.sentence_ends(h[3]) + b - n for h, b, n in zip(held, bounds.tolist(), lengths) if n > 1]
            sentences = np.setdiff1d(np.concatenate(inner), bounds) if inner else np.empty(0, np.int64)
            # where a stretch ends in the middle of a document its end isn't known; whole documents are held, so it is
            places, penalties = candidates(bounds, sentences, int(bounds[-1]), window, sentence_penalty, inside_penalty, every, last)
            cuts = best_cuts(places, penalties, window, last)
            ids = np.concatenate([h[3] for h in held])
            starts = bounds - lengths
            rows = [[] for _ in range(6)]
            a = 0
            for b in cuts:
                i, j = int(np.searchsorted(bounds, a, side="right")), int(np.searchsorted(starts, b))
                parts = [(h[0], h[2] + max(0, a - s), min(b, e) - max(a, s), h[1]) for h, s, e in zip(held[i:j], starts[i:j].tolist(), bounds[i:j].tolist())]
                for c, v in zip(rows, ((shard << 33) | made, ids[a:b].tobytes(), *map(list, zip(*parts)))):
                    c.append(v)
                made, a = made + 1, b
                if len(rows[0]) == 64:
                    yield _batch(rows)
                    rows = [[] for _ in range(6)]
            if rows[0]:
                yield _batch(rows)
            i = int(np.searchsorted(bounds, a, side="right"))
            held = [(h[0], h[1], h[2] + max(0, a - s), h[3][max(0, a - s) :]) for h, s in zip(held[i:], starts[i:].tolist())]
            size = sum(len(h[3]) for h in held)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = np.frombuffer(encoder(text.as_py()) + end, "<u4")
                if not len(ids):
                    continue
                held.append((doc_id, len(ids), 0, ids))
                size += len(ids)
                if size >= stretch:
                    yield from packed(False)
        if held:
            yield from packed(True)

    return task


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4]
    return pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=["sequence_id", "ids", "doc_id", "start", "length", "doc_tokens"])


def pack(
    docs: DataFrame, tokenizer: str, end_id: int | None = 2, window: int = WINDOW, sentence_penalty: int = SENTENCE_PENALTY, inside_penalty: int = INSIDE_PENALTY,
    every: int = INSIDE_EVERY, stretch: int = STRETCH, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per sequence: sequence_id, ids (little-endian unsigned 32-bit) and, for each piece in it, doc_id, start (ids of
    its document before it), length and doc_tokens.

    Pieces follow one another without a gap, documents in ascending order of id within a task and
    sequence ids in ascending order over all. Every id of every document lies in exactly one piece.

    Null texts count as empty: they have ``end_id`` alone, or without one no piece. Null ids come
    first; rows that repeat an id stand one after the other, each with its own pieces. Long texts are
    encoded whole and cut like any other. Other columns aren't read; an empty table gives no sequences.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # equal ids are told apart by their texts, equal rows by any number: their order is free
    keyed = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumns({"tie": F.xxhash64("text"), "free": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "free"]
    dealt = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return dealt.mapInArrow(_pack(tokenizer, end_id, window, sentence_penalty, inside_penalty, every, stretch), _SEQUENCE)


def _digests(batches):
    for batch in batches:
        names = ["doc_id", "start", "length", "doc_tokens"]
        counts = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        flat = {n: batch.column(batch.schema.get_field_index(n)).flatten() for n in names}
        length = flat["length"].to_numpy()
        first = np.concatenate([[0], np.cumsum(counts)])
        before = np.concatenate([[0], np.cumsum(length)])
        offset = before[:-1] - np.repeat(before[first[:-1]], counts)
        raw = [memoryview(b) for b in batch.column(1).to_pylist()]
        owner = np.repeat(np.arange(len(raw)), counts)
        crc = [zlib.crc32(raw[i][4 * o : 4 * (o + n)]) for i, o, n in zip(owner.tolist(), offset.tolist(), length.tolist())]
        sequence = batch.column(0).take(pa.array(owner))
        cols = [flat["doc_id"], flat["start"], flat["length"], pa.array(crc, pa.int64()), flat["doc_tokens"], sequence, pa.array(offset, pa.int64())]
        yield pa.record_batch(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def piece_digests(sequences: DataFrame) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return sequences.mapInArrow(_digests, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
