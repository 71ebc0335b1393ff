"""The N best items of every group, exactly, with score histograms as a safe first cut (problem 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.cluster import HOT_PARTS

BINS = 256


def top_n_per_group(df: DataFrame, group: list[str], item: str, score: str, limit: str, max_limit: int, low: float, high: float, bins: int = BINS) -> DataFrame:
    """The first ``limit`` items of each group by score descending, then item ascending (code points).

    df: at most one row per (group, item), score neither null nor NaN and within [low, high]; limit is a column, constant
    within a group and never above max_limit. A histogram of each group's scores is built by map-side counts. From its top
    downwards it gives the lower edge of the bin in which the limit-th item lies: at least limit items reach that edge, so
    no row below it can be kept. Every group of more than limit items is cut at its edge. The edges of the hot groups, those with
    more than 1/HOT_PARTS of all rows, are fewer than HOT_PARTS and are broadcast, so their rows are cut where they lie; other
    groups' rows meet their edges in the shuffle that ranks them. What is left is ranked exactly. Ties on score go by item; empty input gives no rows; other columns are kept.
    """
    width = (high - low) / bins
    bin_of = F.least(F.greatest(F.floor((F.col(score) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    binned = df.withColumn("__bin", bin_of)
    histogram = binned.groupBy(*group, "__bin").agg(F.count(F.lit(1)).alias("__n"), F.max(limit).alias("__limit"))
    # one row per group, at most `bins` numbers: (bin, count) pairs from the top down
    per_group = histogram.groupBy(*group).agg(
        F.sum("__n").alias("__rows"),
        F.max("__limit").alias("__limit"),
        F.reverse(F.array_sort(F.collect_list(F.struct("__bin", "__n")))).alias("__h"),
    )
    # walk down until limit items are reached: the state is (items so far, bin reached)
    walked = F.aggregate(
        "__h",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(bins).alias("edge")),
        lambda acc, b: F.when(acc["seen"] >= F.col("__limit"), acc).otherwise(F.struct((acc["seen"] + b["__n"]).alias("seen"), b["__bin"].alias("edge"))),
    )
    total = histogram.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("t")).first()["t"]
    edges = per_group.where(F.col("__rows") > F.col("__limit")).select(*[F.col(g).alias(f"__g_{g}") for g in group], walked["edge"].alias("__edge"), (F.col("__rows") * HOT_PARTS > F.lit(total)).alias("__hot"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group])
    extra = ["__edge", "__hot", *[f"__g_{g}" for g in group]]
    with_hot = binned.join(F.broadcast(edges.where("__hot")), same, "left")
    hot = with_hot.where(F.col("__bin") >= F.col("__edge")).drop(*extra)
    rest = with_hot.where(F.col("__edge").isNull()).drop(*extra).join(edges.where(~F.col("__hot")), same, "left")
    rest = rest.where(F.col("__edge").isNull() | (F.col("__bin") >= F.col("__edge"))).drop(*extra)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item).asc()))
    ranked = lambda kept: kept.drop("__bin").withColumn("rank", rank).where(F.col("rank") <= max_limit).where(F.col("rank") <= F.col(limit))
    return ranked(hot).unionByName(ranked(rest))


def best_links(links: DataFrame, filters: DataFrame) -> DataFrame:
    """The links that each interlink's threshold and limit keep: (interlink_id, source_uri, target_uri, confidence, rank).

    filters has one row per interlink (a configuration table; more than 10,000 rows are joined by a shuffle). Interlinks
    without a limit, or with one below 1, give nothing. Links with a null, NaN or too low confidence are dropped, as are
    those without a source or target; repeated pairs count once, with their highest confidence. A null threshold is 1.0.
    """
    from linkweave.cluster import checked_broadcast

    limited = filters.where(F.col("link_limit") >= 1).select("interlink_id", F.coalesce("filter_threshold", F.lit(1.0)).alias("__t"), F.col("link_limit").alias("__limit"))
    max_limit = limited.agg(F.max("__limit")).first()[0] or 0
    rows = links.select("interlink_id", "source_uri", "target_uri", "confidence").join(checked_broadcast(limited, 10_000), "interlink_id")
    rows = rows.where(F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.col("confidence") >= F.col("__t")) & F.col("source_uri").isNotNull() & F.col("target_uri").isNotNull())
    pairs = rows.groupBy("interlink_id", "source_uri", "target_uri").agg(F.max("confidence").alias("confidence"), F.max("__limit").alias("__limit"))
    return top_n_per_group(pairs, ["interlink_id", "source_uri"], "target_uri", "confidence", "__limit", max_limit, -1.0, 1.0).drop("__limit")
