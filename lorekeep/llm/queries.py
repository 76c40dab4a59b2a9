"""The opN_ queries with production parameters, and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import documents
from lorekeep.llm.decontamination import contamination
from lorekeep.llm.exact_dedup import exact_dedup
from lorekeep.llm.licenses import scan_licenses
from lorekeep.llm.line_dedup import line_components
from lorekeep.llm.mixing import mix
from lorekeep.llm.near_dedup import near_duplicates
from lorekeep.llm.pii import KINDS, find_pii, span_list
from lorekeep.llm.sharding import shard
from lorekeep.llm.toxicity import toxicity
from lorekeep.llm.warc import warc_round_trip


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), max_repetition=2.0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), shards=24)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def is_kind(kind: str):
        return lambda x: x["kind"] == kind

    found = find_pii(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "more")).alias("spans"),
        F.size(F.filter("more", is_kind("secret"))).cast("long").alias("n_secret"),
        (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), digest=True)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(documents(spark, sf_dir), similarity=0.8)


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_sharding": op4_sharding,
        "op5_pii": op5_pii,
        "op6_warc": op6_warc,
        "op7_licenses": op7_licenses,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_line_dedup": op10_line_dedup,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
            b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
            s AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
            k AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
            z AS (SELECT DISTINCT n FROM k),
            p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
            h AS (SELECT doc_id, i, n, item FROM p JOIN k USING (n, win)),
            c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
            t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
                   sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
        "op6_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
            g AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
            SELECT p.page_id, strlen(p.t) AS payload_bytes, sha256(p.t) AS payload_digest,
                   CASE WHEN strlen(p.t) >= 100 AND p.page_id <> g.first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN strlen(p.t) >= 100 AND p.page_id <> g.first THEN g.first END AS refers_to
            FROM p JOIN g USING (t)""",
        "op8_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
            FROM d JOIN g USING (t)""",
        "op9_minhash_near_dedup": f"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
            x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
            e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
                  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
            r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
            SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
            FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(g)""",
    }
