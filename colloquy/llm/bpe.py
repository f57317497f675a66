"""Byte-level BPE with padded matrices of pieces.

Pieces of similar length form one matrix, a row each, padded on the right. In each round every row
merges its leftmost pair of minimum rank: ranks come from a hash table of token pairs, and the row
is compacted by a gather. Rows without a mergeable pair leave the matrix. Pieces beyond the widest
bucket, which would need a round per merge over the whole width, go through a heap with the same
order of merges.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_chars, pick, small_batches, space_parts

WIDEST = 256
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines of base64 token and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Open-addressing hash table from pairs of tokens to the rank of their concatenation."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        keys, values = [], []
        for t, r in rank.items():
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(k)
        while len(k):
            free = self.keys[at] == -1
            self.keys[at[free]] = k[free]
            won = self.keys[at] == k
            self.values[at[won]] = v[won]
            k, v, at = k[~won], v[~won], (at[~won] + 1) & self.mask

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; pairs of padding (-1) or without a token get the largest integer."""
        k = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(k)
        out = np.where(self.keys[at] == k, self.values[at], _NONE)
        open_ = np.flatnonzero((self.keys[at] != k) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == k[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class MatrixBPE:
    """Ids of byte pieces, equal to merging the lowest-ranked pair first, leftmost on ties."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.rank, self.pairs = tokens, {t: i for i, t in enumerate(tokens)}, PairTable(tokens)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)  # a piece that is a token stays whole
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif not p:
                out[i] = np.empty(0, np.int32)
            elif len(p) > WIDEST:
                out[i] = self._heap(p)
            else:
                buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for j in range(0, len(rows), step):
                part = rows[j : j + step]
                for i, ids in zip(part, self._matrix([pieces[k] for k in part], width)):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces])
        m = np.where(np.arange(width) < size[:, None], self.byte[raw], -1).astype(np.int32)
        r = self.pairs.get(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        done, where = [None] * len(pieces), np.arange(len(pieces))
        while len(m):
            at = r.argmin(axis=1)  # the first of equal minima: leftmost
            low = r[np.arange(len(m)), at]
            stop = low == _NONE
            for k in np.flatnonzero(stop):
                done[where[k]] = m[k, : size[k]].copy()
            m, r, at, low, where, size = m[~stop], r[~stop], at[~stop], low[~stop], where[~stop], size[~stop] - 1
            if not len(m):
                break
            n, wide = len(m), int(size.max())
            row = np.arange(n)
            m[row, at] = low  # a merged token's id is its rank
            cols = np.arange(wide)
            src = np.minimum(cols + (cols > at[:, None]), m.shape[1] - 1)
            m = np.where(cols < size[:, None], np.take_along_axis(m, src, axis=1), -1)
            cols = np.arange(max(1, wide - 1))
            src = np.minimum(cols + (cols > at[:, None]), r.shape[1] - 1)
            r = np.where(cols < size[:, None] - 1, np.take_along_axis(r, src, axis=1), _NONE)
            for side in (-1, 0):  # the pairs on either side of the merged token are new
                k = at + side
                ok = np.flatnonzero((k >= 0) & (k + 1 < size))
                r[ok, k[ok]] = self.pairs.get(m[ok, k[ok]], m[ok, k[ok] + 1])
        return done

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs.get(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(x), i, ids[i], ids[i + 1]) for i, x in enumerate(first.tolist()) if x != int(_NONE)]
        heapq.heapify(heap)
        alive = [True] * n
        tokens, rank = self.tokens, self.rank
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = low, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for left in (prev[i], i):
                if left >= 0 and nxt[left] < n:
                    x, y = ids[left], ids[nxt[left]]
                    new = rank.get(tokens[x] + tokens[y])
                    if new is not None:
                        heapq.heappush(heap, (new, left, x, y))
        return np.array([t for t, ok in zip(ids, alive) if ok], np.int32)


class TextEncoder:
    """Whole texts to ids; a unit between spaces is encoded once while it is remembered."""

    def __init__(self, path: str, pattern: str, most: int = 250_000):
        import regex

        self.bpe, self.find, self.most = MatrixBPE(load_ranks(path)), regex.compile(pattern).findall, most
        self.units: dict[str, bytes] = {}
        self.missed = 0
        self.decimal = [str(i) for i in range(len(self.bpe.tokens))]

    def _coded(self, units: set[str]) -> dict[str, bytes]:
        units = list(units)
        pieces = [(u,) if u[1:].isalpha() and u[0] == " " else self.find(u) for u in units]
        known = list({p for ps in pieces for p in ps})
        coded = self.bpe.encode([p.encode("utf-8", "surrogatepass") for p in known])
        ids = {p: x.astype("<u4").tobytes() for p, x in zip(known, coded)}
        return {u: b"".join(map(ids.__getitem__, ps)) for u, ps in zip(units, pieces)}

    def __call__(self, texts: list) -> list[np.ndarray]:
        """The ids of each text."""
        cut = []
        for t in texts:
            head, *rest = space_parts(t or "")
            cut.append(([head] if head else []) + [" " + p for p in rest])
        fresh = self._coded(set().union(*cut) - self.units.keys())
        self.units.update(fresh)
        out = [np.frombuffer(b"".join(map(self.units.__getitem__, u)), "<u4") for u in cut]
        if len(self.units) <= self.most:
            return out
        # full: common units are in; only as many misses as there are units call for a new start
        self.missed += len(fresh)
        if self.missed > self.most:
            self.units.clear()
            self.missed = 0
        for u in fresh:
            self.units.pop(u, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bpe.tokens.__getitem__, ids))


@functools.cache
def _encoder(path: str, pattern: str) -> TextEncoder:
    """A Python worker serves many tasks; what it has encoded stays in its memory."""
    return TextEncoder(path, pattern)


def _encode(path: str, pattern: str, keep_ids: bool):
    def task(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            n, a, b, kept = [], [], [], []
            for i, j in by_chars(texts, 1 << 19):
                for coded in encoder(texts[i:j]):
                    own = coded.tolist()
                    n.append(len(own))
                    a.append(hashlib.sha256(",".join(map(encoder.decimal.__getitem__, own)).encode()).hexdigest())
                    b.append(hashlib.sha256(encoder.decode(own)).hexdigest())
                    if keep_ids:
                        kept.append(coded)
            cols, names = [ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept).view("<i4") if kept else np.empty(0, "<i4"))))
                names.append("ids")
            yield pa.record_batch(cols, names=names)

    return task


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int>.

    ``ranks`` is the path of a rank file and ``pattern`` cuts a text into pieces; a cut may only
    bind one leading space to a piece. Ids are decoded again, and decoded_sha256 is that of the
    bytes. Null texts count as empty; ids may be null or repeat; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(_encode(ranks, pattern, keep_ids), out)
