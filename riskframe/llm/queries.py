"""The operators as queries over whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm import (
    bit_slices, decontaminate, langid, pack, pitman_yor, quality, shard, simhash, suffix_levels, token_links, topk, toxicity, warc
)
from riskframe.llm.common import read_table

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.occurrence_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLES["op10_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
patterns AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM patterns),
places AS (
    SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN lengths ON len(w) >= m)),
found AS (SELECT doc_id, item_id, m, i FROM places JOIN patterns USING (m, p)),
hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM found) GROUP BY 1),
items AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_report(read_table(spark, sf_dir, "documents"))


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, F.col("vec_id") % 50 == 0)


ORACLES["op8_topk"] = """
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(embedding) > 0),
s AS (
    SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.x, e.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM e AS q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate_pages(read_table(spark, sf_dir, "pages"))[1]


# Base32 of the 160-bit digest: 32 groups of five bits, read off its hexadecimal digits.
ORACLES["op6_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (
    SELECT page_id, html, array_to_string(list_transform(range(1, 41),
        lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
            [instr('0123456789abcdef', h[i])]), '') AS b FROM p),
digests AS (
    SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[5*i+1] AS INT) + 8 * CAST(b[5*i+2] AS INT)
            + 4 * CAST(b[5*i+3] AS INT) + 2 * CAST(b[5*i+4] AS INT) + CAST(b[5*i+5] AS INT)]), '') AS payload_digest
    FROM bits),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM firsts
"""


@query
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(read_table(spark, sf_dir, "documents"))


@query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(read_table(spark, sf_dir, "documents"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op11_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(read_table(spark, sf_dir, "documents"))


@query
def op13_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLES["op13_bit_slices"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
totals AS (SELECT count(*) AS docs, sum(len(w)) AS tokens FROM d WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counted AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM counted, totals GROUP BY term),
parts AS (
    SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // tokens))) AS part
    FROM counted JOIN weights USING (term), totals),
scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


@query
def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align(read_table(spark, sf_dir, "documents"))
