"""Queries on keys that hold most of the rows (problem 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.operators.skew import heavy_keys, salted_distinct_count


def p5_found(spark, d):
    return heavy_keys(spark.read.parquet(f"{d}/block_entries.parquet")).select("key_kind", "key_text")


def p5_block_counts(spark, d):
    e = spark.read.parquet(f"{d}/block_entries.parquet").where(F.col("block_id").isNotNull())
    return salted_distinct_count(e, ["interlink_id", "block_id"], ["uri"], "entries")


def p5_restriction_counts(spark, d):
    e = spark.read.parquet(f"{d}/block_entries.parquet").where(F.col("restriction_value").isNotNull())
    return salted_distinct_count(e, ["restriction_value"], ["interlink_id", "block_id", "uri"], "entries")


QUERIES = {"p5_found": p5_found, "p5_block_counts": p5_block_counts, "p5_restriction_counts": p5_restriction_counts}

SQL = {
    "p5_found": """
        WITH d AS (SELECT DISTINCT interlink_id, block_id, uri FROM block_entries), t AS (SELECT count(*) AS n FROM d),
        k AS (SELECT 'block' AS key_kind, interlink_id || '#' || block_id AS key_text, count(*) AS n FROM d GROUP BY ALL
              UNION ALL
              SELECT 'restriction', restriction_value, count(*) FROM
                (SELECT DISTINCT restriction_value, interlink_id, block_id, uri FROM block_entries) GROUP BY ALL)
        SELECT key_kind, key_text FROM k, t WHERE key_text IS NOT NULL AND k.n * 100 > t.n * 3""",
    "p5_block_counts": """
        SELECT interlink_id, block_id, count(*) AS entries
        FROM (SELECT DISTINCT interlink_id, block_id, uri FROM block_entries WHERE block_id IS NOT NULL) GROUP BY ALL""",
    "p5_restriction_counts": """
        SELECT restriction_value, count(*) AS entries FROM
        (SELECT DISTINCT restriction_value, interlink_id, block_id, uri FROM block_entries WHERE restriction_value IS NOT NULL)
        GROUP BY ALL""",
}
