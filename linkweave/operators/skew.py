"""Per-key results when a few keys hold most of the rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.cluster import HOT_PARTS

SALTS = 64


def hot_key_table(df: DataFrame, keys: list[str], parts: int = HOT_PARTS) -> DataFrame:
    """The key tuples that hold more than 1/parts of df's rows (so fewer than parts of them), from map-side counts."""
    total = df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") * parts > total).drop("__n")


def with_salt(df: DataFrame, keys: list[str], spread: list[str], salts: int = SALTS, parts: int = HOT_PARTS) -> DataFrame:
    """df with ``__salt``: 0 for ordinary keys; for hot keys a number below salts, drawn by a hash of the spread columns.

    The hash makes the draw repeatable, so a task that is run again gives the same partials, and puts equal values of
    the spread columns under one salt, so distinct values can be counted per salt and added up.
    """
    hot = F.broadcast(hot_key_table(df, keys, parts).withColumn("__hot", F.lit(True)))
    same = None
    renamed = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], "__hot")
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__h_{k}"))
        same = c if same is None else same & c
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    out = df.join(renamed, same, "left")
    return out.withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(F.lit(0))).drop("__hot", *[f"__h_{k}" for k in keys])


def salted_distinct_count(df: DataFrame, keys: list[str], values: list[str], out: str, salts: int = SALTS) -> DataFrame:
    """Number of distinct values per key, balanced however uneven the keys are.

    Stage one drops repeated (key, salt, values) before and after the shuffle and counts per (key, salt); stage two
    adds the partial counts by key. Nulls among the values are values; a key that is null is a group of its own, as in
    GROUP BY. An empty table gives no rows. Columns other than keys and values are ignored.
    """
    # salted before the distinct, on the raw rows: copies of one value share a salt
    salted = with_salt(df.select(*keys, *values), keys, values, salts)
    once = salted.groupBy(*keys, "__salt", *values).agg(F.count(F.lit(1)).alias("__copies"))
    partial = once.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__part"))
    return partial.groupBy(*keys).agg(F.sum("__part").alias(out))


def salted_aggregate(df: DataFrame, keys: list[str], spread: list[str], partial: dict, merge: dict, salts: int = SALTS) -> DataFrame:
    """Any aggregate that can be merged: partial aggregates per (key, salt), then merge by key.

    partial: {column: aggregate over df}; merge: {result: aggregate over the partial columns}. Same null, tie and
    empty-table behaviour as GROUP BY.
    """
    salted = with_salt(df, keys, spread, salts)
    parts = salted.groupBy(*keys, "__salt").agg(*[e.alias(c) for c, e in partial.items()])
    return parts.groupBy(*keys).agg(*[e.alias(c) for c, e in merge.items()])


def heavy_keys(entries: DataFrame, share: tuple[int, int] = (3, 100)) -> DataFrame:
    """Blocks and restriction values that hold more than share of the distinct entries (interlink_id, block_id, uri).

    Out come key_kind, key_text and entries, the number of distinct entries of the key. A null key (block_id,
    interlink_id or restriction_value) is no key, but its entries count in the total.
    """
    entry = ["interlink_id", "block_id", "uri"]
    e = entries.select(*entry, "restriction_value")
    block = F.concat(F.col("interlink_id"), F.lit("#"), F.col("block_id").cast("string"))
    keyed = e.select(
        *entry,
        F.explode(
            F.array(
                F.struct(F.lit("all").alias("key_kind"), F.lit("").alias("key_text")),
                F.struct(F.lit("block").alias("key_kind"), block.alias("key_text")),
                F.struct(F.lit("restriction").alias("key_kind"), F.col("restriction_value").alias("key_text")),
            )
        ).alias("k"),
    ).select(*entry, "k.key_kind", "k.key_text")
    keyed = keyed.where(F.col("key_text").isNotNull())
    counts = salted_distinct_count(keyed, ["key_kind", "key_text"], entry, "entries")
    # The total is one of the counts; the largest total there is stands in a single row of the same table.
    total = counts.where(F.col("key_kind") == "all").agg(F.coalesce(F.max("entries"), F.lit(0)).alias("t")).first()["t"]
    return counts.where((F.col("key_kind") != "all") & (F.col("entries") * share[1] > F.lit(total) * share[0]))
