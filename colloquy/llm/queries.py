"""The queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fingerprint, importance, langid, line_dedup, mixing, packing, token_planes, url_rules, warc
from .common import read_table, scratch
from .exact_dedup import exact_groups
from .near_dedup import near_groups


def _vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_planes.write_tokens(read_table(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"), _pattern(), end_id=0)
    return token_planes.read_digests(spark, path)


#: The rules of the URL query.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_rules.match_rules(read_table(spark, sf_dir, "pages"), rules)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read_digests(spark, path)


def op4_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_copies(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), _pattern(), keep_ids=False)


def op7_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_groups(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(read_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_planes, op2_url_rules, op3_warc, op4_systematic_mixing, op5_line_winnowing, op6_byte_bpe, op7_string_kernels, op8_minhash_near_dedup, op9_bottom_k, op10_exact_dedup, op11_packing, op12_source_divergence, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    import random
    import zlib

    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in URL_RULES)
    return {
        "op2_url_rules": rf"""
            WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES {rules}),
            r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM r),
            u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, row_number() OVER () AS n FROM h),
            m AS (SELECT u.*, rules.rule, rules.verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, verdict DESC) AS k
                FROM u LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
        "op3_warc": r"""
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
            d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest FROM p),
            w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM d)
            SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM w""",
        "op4_systematic_mixing": rf"""
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
            s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::BIGINT AS weight FROM d GROUP BY source),
            l AS (SELECT *, row_number() OVER o AS pos, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
                (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS among FROM s WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
            f AS (SELECT *, min(CASE WHEN rest * weight <= cap * among THEN pos END) OVER () AS first_at FROM l),
            t AS (SELECT a.source, a.source_size, CASE WHEN a.first_at IS NULL OR a.pos < a.first_at THEN a.cap::DOUBLE ELSE (b.rest * a.weight)::DOUBLE / b.among::DOUBLE END AS target FROM f a LEFT JOIN f b ON b.pos = a.first_at),
            k AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
            SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN source_size > 0 THEN least(floor((k * target) / source_size + {random.Random(42).random()!r}::DOUBLE) - floor(((k - 1) * target) / source_size + {random.Random(42).random()!r}::DOUBLE), 3)::BIGINT * size ELSE 0 END::BIGINT AS taken FROM k""",
        "op10_exact_dedup": r"""
            WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM t WINDOW w AS (PARTITION BY text_sha256)""",
        "op12_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
            w AS (SELECT row_no, lang, source, unnest(words) AS term FROM d),
            t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_no) AS docs FROM w GROUP BY ALL),
            l AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING sum(docs) >= 30),
            k AS (SELECT lang, source, term, t.n FROM t JOIN l USING (lang, term)),
            g AS (SELECT DISTINCT lang, source FROM d),
            gs AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN k ON g.lang = k.lang AND g.source = k.source GROUP BY ALL),
            ls AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY ALL),
            p AS (SELECT lang, source, term, coalesce(k.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 5)::HUGEINT) // (gs.total + 5 * v)::HUGEINT AS p FROM gs JOIN ls USING (lang) JOIN l USING (lang) LEFT JOIN k USING (lang, source, term)),
            q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS q FROM l JOIN ls USING (lang)),
            pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
            over_ AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
            SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
            UNION ALL SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS r FROM over_ QUALIFY r <= 50""",
        "op13_importance_resampling": rf"""
            WITH crc AS (SELECT {[zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)]} AS step),
            w AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
            b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
            f AS (SELECT row_no, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w),
            e AS (SELECT unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM b),
            x AS (SELECT feature, hex(encode(feature)) AS digits FROM (SELECT DISTINCT feature FROM f UNION SELECT DISTINCT feature FROM e)),
            y AS (SELECT feature, list_reduce(list_transform(range(len(digits) // 2), lambda i: CAST('0x' || substr(digits, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
                lambda c, v: xor(c >> 8, step[CAST((xor(c, v) & 255) + 1 AS INT)]), 4294967295::BIGINT) AS c FROM x, crc),
            h AS (SELECT feature, xor(c, 4294967295::BIGINT) % 10000 AS bucket FROM y),
            s AS (SELECT bucket, count(*) AS s FROM f JOIN h USING (feature) GROUP BY bucket),
            t AS (SELECT bucket, count(*) AS t FROM e JOIN h USING (feature) GROUP BY bucket),
            z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000 AS of_raw, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000 AS of_target),
            gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * of_raw / ((s + 1.0::DOUBLE) * of_target)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), z),
            m AS (SELECT row_no, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN h USING (feature) JOIN gain USING (bucket) GROUP BY row_no),
            r AS (SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight,
                CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (row_no)),
            c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
            k AS (SELECT *, count_if(n_words >= 20) OVER () AS able, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS k FROM c)
            SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN k <= 25 * able // 100 THEN k END AS rank FROM k""",
    }
