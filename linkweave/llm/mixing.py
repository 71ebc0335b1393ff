"""Mixing sources to target weights by systematic sampling (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.cluster import Scratch, checked_broadcast
from linkweave.llm.tokens import VOCABULARY, encode

#: mix_targets is a configuration table; a larger one is joined by a shuffle.
TARGET_ROWS = 10_000


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """id, kept columns and ``n_tokens`` of the whole text; a null text has 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(encode(t.as_py(), vocabulary)) if t.is_valid else 0 for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*b.schema.names[1:], "n_tokens"])

    rows = docs.select(F.col(text_col).alias("__text"), id_col, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", n_tokens bigint"
    return rows.mapInArrow(count, schema)


def _digest(column: str, seed: int):
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(column).cast("string")))


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 42, vocabulary: str = VOCABULARY, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(repeats, report) of a mix in which each source gets target_weight of the total tokens, as far as it reaches.

    repeats: source, doc_id, n_tokens, repeats, with a row for every document used at least once. report: a row for each
    source of targets, with tokens, capacity (tokens times max_repeats), wanted tokens, emitted tokens, actual_share and
    falls_short: every document was emitted max_repeats times, and still fewer tokens than wanted. With ``size``, a column of
    docs takes the place of the tokens (null counts 0), and nothing is encoded. The total counts each document of a source in targets once; others, with a null source too, are left out.

    Every document of a source is expected min(max_repeats, wanted / tokens) times. Documents stand in order of size, then
    of a seeded hash (MD5); expected copies are summed up along that order within the source, one random offset per source is
    added, and a document is emitted once for each integer that its step crosses, so at most max_repeats times. The sums
    need no source in one place: rows are range partitioned by source and size, each partition sums its own rows, and only
    one total per partition and source is summed over. Equal documents under several ids are separate documents. A source
    without documents or with empty texts only has actual_share 0; with no targets there are no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    goals = checked_broadcast(goals, TARGET_ROWS)
    used = docs.where(F.col("source").isNotNull()).join(goals.select("source"), "source", "left_semi")
    if size is None:
        counted = scratch.cut(token_counts(used, "doc_id", "text", ["source"], vocabulary))
    else:
        counted = scratch.cut(used.select("doc_id", "source", F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n_tokens")))
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    total = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()["t"]
    plan = scratch.cut(
        goals.join(sums, "source", "left")
        .na.fill(0, ["tokens", "documents"])
        .withColumn("wanted", F.coalesce("target_weight", F.lit(0.0)) * F.lit(total))
        .withColumn("capacity", F.col("tokens") * F.coalesce("max_repeats", F.lit(0)))
        .withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.coalesce("max_repeats", F.lit(0)).cast("double"), F.try_divide("wanted", F.col("tokens").cast("double")))).otherwise(0.0))
        .withColumn("offset", F.conv(F.substring(_digest("source", seed), 1, 8), 16, 10).cast("double") / 2.0**32)
        .coalesce(1)
    )
    plan_b = checked_broadcast(plan.select("source", "rate", "offset"), TARGET_ROWS)
    order = ["source", "n_tokens", "__h", "doc_id"]
    ranged = scratch.cut(
        counted.withColumn("__h", _digest("doc_id", seed)).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).join(plan_b, "source")
    )
    own = Window.partitionBy("source", "__part")
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("source", "__part").agg(F.sum("rate").alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0.0))).drop("__sum")
    # at most (sources + partitions) rows, since the partitions are ranges
    stepped = ranged.join(checked_broadcast(parts, 100_000), ["source", "__part"])
    upto = F.col("__before") + F.sum("rate").over(own.orderBy("n_tokens", "__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # rounded, so that the sums of equal rates meet an integer exactly however they were added up
    high = F.floor(F.round(upto + F.col("offset"), 6))
    low = F.floor(F.round(upto - F.col("rate") + F.col("offset"), 6))
    repeats = scratch.cut(stepped.withColumn("repeats", (high - low).cast("int")).where("repeats > 0").select("source", "doc_id", "n_tokens", "repeats"))
    emitted = repeats.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("emitted_tokens"), F.max("repeats").alias("most_repeats"))
    mixed = repeats.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("repeats")), F.lit(0)).alias("t")).first()["t"]
    report = (
        plan.join(emitted, "source", "left")
        .na.fill(0, ["emitted_tokens", "most_repeats"])
        .withColumn("falls_short", (F.col("emitted_tokens") == F.col("capacity")) & (F.col("emitted_tokens") < F.col("wanted")))
        .withColumn("actual_share", F.when(F.lit(mixed) > 0, F.col("emitted_tokens") / F.lit(max(mixed, 1))).otherwise(0.0))
        .select("source", "target_weight", "max_repeats", "documents", "tokens", "capacity", "wanted", "emitted_tokens", "most_repeats", "actual_share", "falls_short")
    )
    return repeats, report
