"""Token ids in a binary format of shuffled planes.

Documents are tokenized in ascending order and their ids cut into blocks of a fixed size. A block
of n ids is transposed: byte plane p holds byte p of every id (bit plane p its bit p), so that the
slowly changing high planes compress to almost nothing. Each plane is compressed with zstandard on
its own.

The format is a folder with two Parquet tables, so that any store that Spark can write will do and
a lost task is simply written again:

``blocks``  shard, block, start (ids of the shard before it), n_ids, planes (compressed, one after
            the other), plane_bytes (their sizes), and for each document of the block its doc_no in
            the shard, doc_id, fragment number and number of ids;
``chunks``  the chunk index: shard, block, start (ids of the whole file before it), n_ids, n_bytes,
            first_doc_no, last_doc_no. A reader finds the blocks of a range of ids there.

Shards follow one another in ascending order of document.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, pick, small_batches, space_parts

BLOCK_IDS = 1 << 16
_BLOCKS = (
    "shard int, block long, start long, n_ids long, planes binary, plane_bytes array<int>, "
    "doc_no array<long>, doc_id array<long>, fragment array<int>, part_ids array<long>"
)
_PARTS = "shard int, doc_no long, doc_id long, fragment int, at long, n long, crc long"


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 1) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids: 4 byte planes, or 32 bit planes."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = [np.ascontiguousarray(raw[:, p]) for p in range(4)]
    if bits:
        planes = [np.packbits((planes[p >> 3] >> (p & 7)) & 1) for p in range(32)]
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of ``to_planes``; four planes are byte planes, 32 bit planes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]
    if len(raw) == 32:
        loose = [np.unpackbits(p, count=n) for p in raw]
        raw = [sum((loose[8 * q + i] << np.uint8(i) for i in range(1, 8)), loose[8 * q]) for q in range(4)]
    return np.stack(raw, axis=1).reshape(-1).view("<u4")


class UnitEncoder:
    """Encodes whole texts with the tokenizers library, each distinct unit between spaces once.

    The pre-tokenizer binds one leading space to what follows and never matches across the cuts of
    ``space_parts``, so the ids of a text are those of its units one after the other; and it cuts a
    unit where ``pattern`` does, so the ids of a unit are those of its pieces. The library looks for
    the strings of added tokens first; a text that has one is given to it as a whole.
    """

    def __init__(self, path: str, pattern: str, most: int = 900_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = sorted({t.content for t in tok.get_added_tokens_decoder().values()})
        find = regex.compile(pattern).findall

        def encoded(text: str) -> bytes:
            return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

        model = tok.model

        def word(unit: str) -> bytes:
            """An alphabetic unit with its space: the library's merges on the byte-level form."""
            return array("I", [t.id for t in model.tokenize("\u0120" + unit)]).tobytes() if unit.isascii() else encoded(" " + unit)

        if any(word(w) != encoded(" " + w) for w in ("the", "Word", "thshouerst", "A")):  # another pre-tokenizer
            def word(unit: str) -> bytes:
                return encoded(" " + unit)

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if piece[0] == " " and piece[1:].isalpha():
                    return units[piece[1:]]
                out = encoded(piece)  # a piece, or what stands behind a line end
                if len(piece) < 100:
                    if len(self) >= most // 6:
                        self.clear()
                    self[piece] = out
                return out

        def composed(unit: str) -> bytes:
            """A unit that isn't a word: by its plain cuts if it has no others, else by the pattern."""
            stem = unit.rstrip(punctuation)
            if stem.isalpha():  # a word and one run of marks
                return units[stem] + pieces[unit[len(stem) :]]
            head, line_end, tail = unit.partition("\n")
            if line_end and head and tail and not head[-1].isspace() and not tail[0].isspace():
                return units[head] + pieces[line_end] + pieces[tail]
            return b"".join(map(pieces.__getitem__, find(" " + unit)))

        class Units(dict):
            missed = 0

            def __missing__(self, unit: str) -> bytes:
                if unit.isalpha():
                    out = word(unit)
                else:
                    out = composed(unit)
                    if "\n" in unit:  # two words and a line end seldom meet again
                        return out
                if len(self) < most:
                    if len(unit) < 100:
                        self[unit] = out
                else:  # full: common units are in; only as many misses as there are units call for a new start
                    self.missed += 1
                    if self.missed > most:
                        self.clear()
                        self.missed = 0
                return out

        pieces, units = Pieces(), Units()
        self._first, self._units, self._added = encoded, units, added

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if any(a in text for a in self._added):
            return self._first(text)
        head, *rest = space_parts(text)
        return (self._first(head) if head else b"") + b"".join(map(self._units.__getitem__, rest))


@functools.cache
def _encoder(path: str, pattern: str) -> UnitEncoder:
    """A Python worker serves many tasks; what it has encoded stays in its memory."""
    return UnitEncoder(path, pattern)


def _write(path: str, pattern: str, end_id: int | None, block_ids: int, bits: bool):
    def task(batches):
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), _encoder(path, pattern)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        held, parts, block, start, doc_no = bytearray(), [], 0, 0, 0

        def flush(n):
            nonlocal held, parts, block, start
            ids = np.frombuffer(bytes(held[: 4 * n]), "<u4")
            planes = to_planes(ids, bits)
            cols = list(zip(*parts)) or [()] * 4
            row = [[shard], [block], [start], [n], [b"".join(planes)], [[len(p) for p in planes]], *([list(c)] for c in cols)]
            held, parts, block, start = held[4 * n :], [], block + 1, start + n
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, _types)], names=_names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py()) + end
                left, fragment, at = len(data) // 4, 0, 0
                while True:
                    room = block_ids - len(held) // 4
                    n = min(room, left)
                    held += data[at : at + 4 * n]
                    parts.append((doc_no, doc_id, fragment, n))
                    left, fragment, at = left - n, fragment + 1, at + 4 * n
                    if len(held) == 4 * block_ids:
                        yield flush(block_ids)
                    if not left:
                        break
                doc_no += 1
        if parts:
            yield flush(len(held) // 4)

    return task


_names = ["shard", "block", "start", "n_ids", "planes", "plane_bytes", "doc_no", "doc_id", "fragment", "part_ids"]
_types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, bits: bool = False) -> None:
    """Tokenize every whole text and write the format below ``path`` in ascending order of id.

    ``tokenizer`` is the path of a tokenizer file of the tokenizers library whose pre-tokenizer cuts
    by ``pattern``.

    Strings of added tokens in a text get those tokens' ids, as the library's plain call gives them.
    Null texts count as empty and still get ``end_id``. Null ids come first; rows that repeat an id
    stand one after the other. An empty table writes a file of no blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    # equal ids are told apart by their texts, so that no id is bound to one shard
    tie = F.xxhash64("text").alias("tie")
    dealt = src.select("*", tie).repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text").mapInArrow(_write(tokenizer, pattern, end_id, block_ids, bits), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = read_blocks(spark, path)
    offsets = _offsets(blocks)
    index = blocks.select("shard", "block", "start", "n_ids", F.aggregate("plane_bytes", F.lit(0), lambda a, x: a + x).alias("n_bytes"), F.array_min("doc_no").alias("first_doc_no"), F.array_max("doc_no").alias("last_doc_no"))
    index.join(F.broadcast(offsets), "shard").withColumn("start", F.col("start") + F.col("shard_start")).drop("shard_start").write.parquet(f"{path}/chunks")


def _offsets(blocks: DataFrame) -> DataFrame:
    """Ids before each shard. There is a row for each task of the writer, whatever its size."""
    sizes = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for shard, n in sizes:
        rows.append((shard, before))
        before += n
    return blocks.sparkSession.createDataFrame(rows, "shard int, shard_start long")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def _ids_of(row_planes, sizes, n) -> np.ndarray:
    ends = np.cumsum(sizes)
    return from_planes([row_planes[e - s : e] for s, e in zip(sizes, ends)], n)


def _read(batches):
    """Task: blocks -> one row per part of a document, with the crc32 of its ids."""
    for batch in batches:
        out = [[] for _ in range(7)]
        for r in batch.to_pylist():
            raw = memoryview(_ids_of(r["planes"], r["plane_bytes"], r["n_ids"]).tobytes()) if r["n_ids"] else b""
            at = 0
            for doc_no, doc_id, fragment, n in zip(r["doc_no"], r["doc_id"], r["fragment"], r["part_ids"]):
                for c, v in zip(out, (r["shard"], doc_no, doc_id, fragment, r["start"] + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]))):
                    c.append(v)
                at += n
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names=["shard", "doc_no", "doc_id", "fragment", "at", "n", "crc"])


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the crc32 polynomial, in reflected bit order."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def crc32_joined(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of a sequence from the crc32 and the bytes of each part."""
    out = 0
    for crc, n in zip(crcs, sizes):
        shift, power, k = 1 << 31, 1 << 23, n  # 1, and x to the 8th
        while k:
            if k & 1:
                shift = _times(shift, power)
            power, k = _times(power, power), k >> 1
        out = _times(out, shift) ^ crc
    return out


def _joined(batches):
    for batch in batches:
        crc = [c[0] if len(c) == 1 else crc32_joined(c, [4 * k for k in n]) for c, n in zip(batch.column("crcs").to_pylist(), batch.column("ns").to_pylist())]
        yield pa.record_batch([batch.column("shard"), batch.column("doc_id"), batch.column("at"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the written file: doc_id, start, n_tokens, ids_crc32."""
    blocks = read_blocks(spark, path)
    parts = blocks.mapInArrow(_read, _PARTS).groupBy("shard", "doc_no").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("fragment", "n", "crc"))).alias("parts"))
    parts = parts.select("shard", "doc_id", "at", "n_tokens", F.col("parts.crc").alias("crcs"), F.col("parts.n").alias("ns"))
    whole = parts.mapInArrow(_joined, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return whole.join(F.broadcast(_offsets(blocks)), "shard").select("doc_id", (F.col("at") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of the whole file; only the blocks of the range are read."""
    end = start + count
    chunks = spark.read.parquet(f"{path}/chunks").where((F.col("start") < end) & (F.col("start") + F.col("n_ids") > start))
    rows = read_blocks(spark, path).select("shard", "block", "n_ids", "planes", "plane_bytes").join(F.broadcast(chunks.select("shard", "block", F.col("start").alias("at"))), ["shard", "block"]).orderBy("at").collect()
    found = [_ids_of(bytes(r.planes), r.plane_bytes, r.n_ids)[max(0, start - r["at"]) : max(0, end - r["at"])] for r in rows]
    return np.concatenate(found) if found else np.empty(0, "<u4")
