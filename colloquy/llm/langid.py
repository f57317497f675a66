"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams of 1 to 3 bytes that both have (blended
spectrum, presence only), over the geometric mean of their own numbers. Landmark texts give a
Nyström approximation of it, on which one-versus-rest kernel ridge regression is solved in closed
form. A batch of texts is scored by two matrix products: presence bits by landmarks, and kernels by
weights.

The model is fitted on a bounded sample of labelled rows: at most ``sample_rows`` in all, shared out
evenly among the languages, so that rare ones are learned too. Everything else covers whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_chars, pick, small_batches

BITS, LONGEST = 16, 3
SAMPLE_ROWS, LANDMARKS, RIDGE = 2000, 96, 1e-2
SURE = 0.9
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams of the lower-cased text occur."""
    seen = np.zeros(1 << BITS, bool)
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    gram = raw
    for n in range(1, LONGEST + 1):
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | raw[n - 1 :]
        seen[((gram + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    return seen


@dataclass
class Model:
    """Landmarks (packed presence bits), their sizes, weights from kernels to languages."""

    languages: list[str]
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def prepared(self) -> tuple[np.ndarray, np.ndarray]:
        """Columns that any landmark has, and the landmarks on them."""
        bits = np.unpackbits(self.landmarks, axis=1).astype(bool)
        columns = np.flatnonzero(bits.any(axis=0))
        return columns, bits[:, columns].T.astype(np.float32)


def kernels(seen: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    return (seen @ landmarks) / np.sqrt(np.maximum(1, np.outer(sizes, landmark_sizes)))


def train(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on packed presence bits; landmarks are taken from the languages in turn, one of each at least."""
    languages = sorted(set(langs))
    rows = {l: [i for i, x in enumerate(langs) if x == l] for l in languages}
    turns = [rows[l][k] for k in range(max(map(len, rows.values()), default=0)) for l in languages if k < len(rows[l])]
    chosen = turns[: max(landmarks, len(languages))]
    sizes = np.array([int(np.unpackbits(r).sum()) for r in packed])
    model = Model(languages, packed[chosen], sizes[chosen], np.zeros((len(chosen), len(languages))), np.zeros(len(languages)))
    columns, z = model.prepared()
    k = np.concatenate([kernels(np.unpackbits(packed[i : i + 128], axis=1)[:, columns].astype(np.float32), sizes[i : i + 128], z, model.sizes) for i in range(0, len(packed), 128)]).astype(float)
    values, vectors = np.linalg.eigh(k[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström map: kernels to coordinates
    phi = k @ root
    y = np.array([[1.0 if l == m else -1.0 for m in languages] for l in langs])
    centre, mean = phi.mean(axis=0), y.mean(axis=0)
    p = phi - centre
    w = np.linalg.solve(p.T @ p + ridge * len(p) * np.eye(p.shape[1]), p.T @ (y - mean))
    model.weights, model.bias = root @ w, mean - centre @ w
    return model


def _features(batches):
    for batch in batches:
        bits = [np.packbits(presence(t)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("lang"), pa.array(bits, pa.binary())], names=["lang", "bits"])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shares(counts: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """``most`` rows shared out evenly: a language with fewer rows than its share leaves the rest to the others."""
    out, left = [], most
    for i, (lang, n) in enumerate(sorted(counts, key=lambda c: (c[1], c[0]))):
        take = min(n, left // (len(counts) - i))
        out.append((lang, take))
        left -= take
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Train on at most ``sample_rows`` labelled rows that aren't held out.

    The ``sample_rows`` most frequent languages take part, each with an even share of the rows (or
    all its rows), chosen by a hash of id and text; rows that repeat both count once. Texts without a
    letter and rows without id or language aren't used. There are at least as many landmarks as
    languages. Of a table without a usable row nothing is learned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = pick(docs, doc_id=(id_col, None), text=(text_col, "string"), lang=(lang_col, "string"))
    labelled = src.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    labelled = labelled.withColumn("o", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    # what counts is what can be drawn: texts with a letter, repeated rows once
    counts = labelled.select("lang", "doc_id", "o").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()
    quota = shares([(r.lang, r.n) for r in counts], sample_rows)
    n = {r.lang: r.n for r in counts}
    # a slice by hash, all rows or 4 (take + 25) expected, so that it falls short of ``take`` with a
    # probability below 1e-12; the rank then cuts it to size
    slices = [(lang, take, min(1.0, 4 * (take + 25) / n[lang])) for lang, take in quota if take]
    if not slices:
        return _nothing()
    slices = spark.createDataFrame(slices, "lang string, take int, part double")
    dice = labelled.join(F.broadcast(slices), "lang").where(F.pmod("o", F.lit(1 << 30)) < F.col("part") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))
    table = dice.dropDuplicates(["lang", "doc_id", "o"]).withColumn("rank", rank).where("rank <= take").orderBy("lang", "o", "doc_id").select("text", "lang").mapInArrow(_features, "lang string, bits binary").toArrow()
    if not table.num_rows:
        return _nothing()
    packed = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    return train(packed, table["lang"].to_pylist(), landmarks)


def _nothing() -> Model:
    return Model([], np.zeros((0, 1 << (BITS - 3)), np.uint8), np.zeros(0), np.zeros((0, 0)), np.zeros(0))


def _predict(model: Model):
    def task(batches):
        columns, z = model.prepared() if model.languages else (None, None)
        for batch in batches:
            texts, langs, scores = batch.column("text").to_pylist(), [], []
            for i, j in by_chars(texts, 1 << 19):
                part = texts[i:j]
                known = [k for k, t in enumerate(part) if t and model.languages and any(map(str.isalpha, t))]
                own, own_scores = [UNKNOWN] * len(part), [0.0] * len(part)
                for q in range(0, len(known), 256):
                    some = known[q : q + 256]
                    seen, sizes = np.zeros((len(some), len(columns)), np.float32), np.zeros(len(some))
                    for r, k in enumerate(some):
                        bits = presence(part[k])
                        seen[r], sizes[r] = bits[columns], np.count_nonzero(bits)
                    margins = kernels(seen, sizes, z, model.sizes) @ model.weights + model.bias
                    for k, m in zip(some, margins):
                        best = int(m.argmax())
                        own[k], own_scores[k] = model.languages[best], float(np.clip((1 + m[best]) / 2, 0, 1))
                langs += own
                scores += own_scores
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return task


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. The
    prediction depends on the text alone. Ids may be null or repeat; an empty table gives no rows.
    """
    src = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("held_out", held_out(F.col("doc_id")))
    return src.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", sure: float = SURE) -> DataFrame:
    """The rows that the prediction doesn't reject, with all their columns.

    Rejected are texts without a language (``und``), and rows whose own language the model knows and
    contradicts with a score of at least ``sure``: a page that claims one language and is written in
    another. Rows without a language of their own are judged by their text alone. Where nothing was
    learned, only texts without a letter go.
    """
    names = [c.lower() for c in docs.columns]
    text_at = docs.columns.index(text_col) if text_col in docs.columns else names.index(text_col.lower())
    lang_at = docs.columns.index(lang_col) if lang_col in docs.columns else names.index(lang_col.lower())

    def task(batches):
        judge, known = _predict(model), set(model.languages)
        for batch in batches:
            text = batch.column(text_at)
            if not known:
                yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in text.to_pylist()], pa.bool_()))
                continue
            fed = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), text, pa.nulls(batch.num_rows, pa.bool_())], names=["doc_id", "text", "held_out"])
            (told,) = judge(iter([fed]))
            rows = zip(told.column("lang_pred").to_pylist(), told.column("score").to_pylist(), batch.column(lang_at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and not (own in known and own != x and score >= sure) for x, score, own in rows], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
