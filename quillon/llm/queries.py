"""The registered queries opN_<name> of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, licenses, near_dedup, packing, pii, quality, sharding, token_files, warc
from .common import read_table, scratch_path


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(read_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(read_table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packages")
    warc.write_packages(warc.captures(read_table(spark, sf_dir, "pages")), path)
    return warc.read_packages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.check_columns(spark, path)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.digest_columns(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shards,
        op2_near_duplicates,
        op3_personal_data,
        op4_quality,
        op5_warc,
        op6_licenses,
        op7_packing,
        op8_exact_duplicates,
        op9_token_files,
        op10_decontamination,
    )
}

_EXACT = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT k, array_to_string(words[i:i + 4], ' ') AS x FROM (SELECT k, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS same FROM s a JOIN s b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS k, min(doc_id) AS low FROM reach JOIN w ON w.k = b GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
FROM w LEFT JOIN n USING (k) LEFT JOIN lowest USING (k)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b
"""

_WORDS = f"regexp_extract_all({_LOW}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

_LEAKS = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
items AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i:i + 9], ' ') AS x FROM (SELECT item, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
places AS (SELECT k, n, i, array_to_string(words[i:i + n - 1], ' ') AS x FROM (SELECT k, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(words) >= n)),
found AS (SELECT k, p.n AS n, i, item FROM places p JOIN items USING (n, x)),
hit AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT k, n, i FROM found)) GROUP BY 1),
told AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN told USING (k)
"""

SQL: dict[str, str] = {
    "op2_near_duplicates": _NEAR,
    "op5_warc": _WARC,
    "op6_licenses": licenses.scan_sql(),
    "op8_exact_duplicates": _EXACT,
    "op10_decontamination": _LEAKS,
}
