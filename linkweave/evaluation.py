"""Quality of links against reference links, and work on the reference links themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = ["source_uri", "target_uri"]


def confusion(scored: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row of tp, tn, fp, fn over scored reference pairs (confidence, label); predicted are those at the threshold or above.

    Pairs with a null label count nowhere; a null or NaN confidence counts as below. An empty table gives zeros.
    """
    hit = F.coalesce((F.col("confidence") >= threshold) & ~F.isnan("confidence"), F.lit(False))
    count = lambda c, n: F.coalesce(F.count_if(c), F.lit(0)).alias(n)
    yes = F.col("label")
    return scored.agg(count(hit & yes, "tp"), count(~hit & ~yes, "tn"), count(hit & ~yes, "fp"), count(~hit & yes, "fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, 1).otherwise(b))


def quality(counts: DataFrame) -> DataFrame:
    """precision, recall, f_measure, specificity and Matthews' coefficient of confusion counts; 0 where a denominator is 0."""
    return counts.select(*_quality_columns())


def _quality_columns() -> list[Column]:
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [
        precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f_measure"), _ratio(tn, tn + fp).alias("specificity"),
        _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    ]


def graded_score(scored: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row, score: the harmonic mean of the positive and the negative pairs' scores, each 1 minus the mean error.

    The error of a wrongly placed pair is the square of ``threshold - confidence / threshold`` for positives (the division binds
    first, as the measure is defined) and of ``(confidence - threshold) / (1 - threshold)`` for negatives. Null where either
    class is missing or both scores cancel out; a null or NaN confidence counts as -1.
    """
    c = F.coalesce(F.nanvl("confidence", F.lit(-1.0)), F.lit(-1.0))
    below, above = F.lit(threshold) - c / F.lit(threshold), (c - F.lit(threshold)) / F.lit(1.0 - threshold if threshold < 1 else float("nan"))
    bad_positive = F.when(F.col("label") & (c < threshold), below * below).otherwise(0.0)
    bad_negative = F.when(~F.col("label") & (c >= threshold), above * above).otherwise(0.0)
    n = scored.agg(F.count_if("label").alias("np"), F.count_if(~F.col("label")).alias("nn"), F.sum(bad_positive).alias("ep"), F.sum(bad_negative).alias("en"))
    p = 1.0 - F.try_divide("ep", F.col("np").cast("double"))
    q = 1.0 - F.try_divide("en", F.col("nn").cast("double"))
    return n.select(F.try_divide(2.0 * p * q, p + q).alias("score"))


def link_status(links: DataFrame, reference: DataFrame) -> DataFrame:
    """links with status: correct or incorrect as the reference's label says, undecided where the pair isn't in it."""
    known = reference.where(F.col("label").isNotNull()).groupBy(*LINK).agg(F.bool_or("label").alias("__label"))
    status = F.when(F.col("__label"), "correct").when(~F.col("__label"), "incorrect").otherwise("undecided")
    return links.join(known, LINK, "left").withColumn("status", status).drop("__label")


def reference_status(scored: DataFrame) -> DataFrame:
    """Scored reference pairs with right: positives at 0 or above, negatives below."""
    return scored.withColumn("right", F.when(F.col("label"), F.col("confidence") >= 0).otherwise(F.col("confidence") < 0))


def decide(reference: DataFrame, links: DataFrame, label: bool | None) -> DataFrame:
    """The reference with the links moved to a label, or taken out for None."""
    rest = reference.select(*LINK, "label").join(links.select(*LINK), LINK, "left_anti")
    return rest if label is None else rest.unionByName(links.select(*LINK).distinct().withColumn("label", F.lit(label)))


def with_negatives(positive: DataFrame) -> DataFrame:
    """Reference links with as many negatives: each source with the target of the next pair, the last with the first's.

    Pairs stand in order of source, then target; the order is a range sort, and the next pair is found by its number, so
    no task holds all pairs. A negative that is also a positive pair is left out.
    """
    pairs = positive.select(*LINK).distinct()
    n = pairs.count()
    if not n:
        return pairs.withColumn("label", F.lit(True))
    numbered = ranked(pairs, LINK)
    following = numbered.select(F.pmod(F.col("__k") - 1, F.lit(n)).alias("__k"), F.col("target_uri").alias("__next"))
    wrong = numbered.join(following, "__k").select("source_uri", F.col("__next").alias("target_uri")).join(pairs, LINK, "left_anti")
    return pairs.withColumn("label", F.lit(True)).unionByName(wrong.withColumn("label", F.lit(False)))


def import_reference(spark, path: str) -> DataFrame:
    """Reference links of a file; where it has no negative ones, they are made as with_negatives does."""
    from linkweave.sources.sinks import read_alignment

    links = read_alignment(spark, path).select(*LINK, "label")
    return with_negatives(links) if links.where(~F.col("label")).isEmpty() else links


def compare_files(spark, generated: str, reference: str) -> DataFrame:
    """One row of confusion counts and quality of a file of links against one of reference links.

    A reference pair counts as predicted if the links have it, whatever its confidence.
    """
    from linkweave.sources.sinks import read_alignment

    found = read_alignment(spark, generated).where("label").select(*LINK).distinct().withColumn("confidence", F.lit(1.0))
    counts = confusion(read_alignment(spark, reference).select(*LINK, "label").distinct().join(found, LINK, "left"), 0.5)
    return counts.select("*", *_quality_columns())


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __k, its row's number from 0 in the order: ranges are sorted in parallel, and only their sizes are summed up."""
    from pyspark.sql import Window

    from linkweave.cluster import Scratch

    sorted_ = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*order)
    table = Scratch(df.sparkSession, "ranked").cut(sorted_)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    starts = table.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return table.withColumn("__own", own).join(F.broadcast(starts), "__part").withColumn("__k", F.col("__own") + F.col("__start")).drop("__own", "__start", "__part")


def percent(confidence: Column) -> Column:
    """A confidence as a percentage, -1 being 0."""
    return (confidence + 1) * 50


def first_by_uri(entities, order: list[str]) -> object:
    """Entities with one row per uri: the first in the order of the given columns, then of all others, so copies don't matter."""
    from pyspark.sql import Window

    from linkweave.plans.engine import Entities

    df = entities.df
    rest = [c for c in df.columns if c not in ("uri", *order)]
    rank = F.row_number().over(Window.partitionBy("uri").orderBy(*order, *[F.col(c).cast("string") for c in rest]))
    return Entities(df.withColumn("__rank", rank).where("__rank = 1").drop("__rank"), entities.columns)


def cache_reference_entities(source, target, reference: DataFrame, folder: str):
    """The entities of both sides that reference links name, written to the folder and read back: all that evaluating a rule on the
    links needs. Links in either direction are meant as source to target; entities nobody names are left out."""
    from linkweave.plans.engine import Entities
    from linkweave.sources.readers import read_cache, write_cache

    out = []
    for name, side, column in (("source", source, "source_uri"), ("target", target, "target_uri")):
        named = reference.select(F.col(column).alias("uri")).distinct()
        path = f"{folder.rstrip('/')}/{name}"
        write_cache(Entities(side.df.join(named, "uri", "left_semi"), side.columns), path)
        out.append(read_cache(reference.sparkSession, path))
    return tuple(out)
