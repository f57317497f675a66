"""What the training-data operators share: text units, filters, columns by name, bounded broadcasts."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise, scratch, shared_dir, spread  # noqa: F401

#: White space of the word and line contracts: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Every character that any tokenizer counts as white space, and the ASCII separators that some do.
_UNICODE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_PAIR = re.compile(" [" + re.escape(_UNICODE_SPACE) + "]")
_SAFE_CUT = re.compile(" (?=[^" + re.escape(_UNICODE_SPACE) + "])")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), 20 << 20)


def space_parts(text: str) -> list[str]:
    """Cut ``text`` before each space that a non-space character follows.

    The first part stands as it is; every later part stood behind one space, which is not part of
    it. A pre-tokenizer that binds one leading space to a word never matches across such a cut, so
    the parts can be encoded one by one.
    """
    if text.endswith(" ") or _ODD_PAIR.search(text):
        return _SAFE_CUT.split(text)
    return text.split(" ")


def by_chars(texts: list, most: int):
    """Slices of ``texts`` of about ``most`` characters each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def id_bitmap(ids: DataFrame, column: str, bits: int = 1 << 24) -> np.ndarray:
    """A bitmap of fixed size in which the bit of every id of ``ids`` is set.

    Its ``bits`` bound what the driver collects and the tasks receive, whatever the data: a full
    bitmap lets more rows through and loses none, and callers join exactly afterwards.
    """
    slot = F.pmod(F.col(column), F.lit(bits)).cast("long")
    words = (
        ids.where(F.col(column).isNotNull())
        .groupBy(F.shiftright(slot, 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("v"))
    )
    out = np.zeros(bits >> 6, dtype=np.int64)
    table = words.toArrow()
    out[table["w"].to_numpy()] = table["v"].to_numpy()
    return out


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = np.mod(ids, bitmap.size << 6)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def checked_broadcast(df: DataFrame, most: int = 200_000, arrays: str | None = None, most_items: int = 2_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it is small; otherwise Spark picks a shuffled join.

    Small is at most ``most`` rows and, with ``arrays`` naming an array column, at most
    ``most_items`` items in it altogether. ``df`` should be a written table, as it is read twice.
    """
    items = F.sum(F.size(arrays)) if arrays else F.lit(0)
    size = df.limit(most + 1).agg(F.count("*").alias("n"), items.alias("items")).first()
    return F.broadcast(df) if size.n <= most and (size["items"] or 0) <= most_items else df


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... and the new name of each; then no name can clash."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), {name: c for name, c in reversed(list(zip(docs.columns, new)))}


def column_of(names: dict[str, str], name: str) -> str:
    """The entry of ``names`` for a column name, which is matched exactly first, then in any case."""
    return names.get(name) or {k.lower(): v for k, v in reversed(names.items())}[name.lower()]


def pick(docs: DataFrame, **columns: tuple[str, str | None]) -> DataFrame:
    """The named columns only, alias=(name, type or None to keep it); names as in ``column_of``."""
    inner, names = positional(docs)
    found = {alias: F.col(column_of(names, name)) for alias, (name, _) in columns.items()}
    return inner.select(*((c.cast(columns[a][1]) if columns[a][1] else c).alias(a) for a, c in found.items()))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of whole texts travel in Arrow batches of at most ``rows``, so that a batch stays small in
    the JVM and in Python; a lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
