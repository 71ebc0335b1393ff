"""Consolidating pairwise matches into groups: connected components by minimum labels (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.cluster import Scratch, checked_broadcast, measured, skew_safe_lookup


def _both_ways(edges: DataFrame) -> DataFrame:
    pair = lambda x, y: F.struct(F.col(x).alias("n"), F.col(y).alias("m"))
    return edges.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.n", "e.m")


def _smaller_first(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) for every node that an edge joins to another one; label is the smallest node of its component.

    edges: columns a and b of one orderable type (strings go by code point). Nulls and self-links join nothing; repeated
    edges and either direction count once; no edges give no rows; other columns are ignored.

    Nodes get numbers in their own order by one range sort, so rounds move pairs of longs. In each round every node takes
    the smallest label among itself and its neighbours; pointer jumping (label := label of label) then runs until no label
    changes, edges are moved to the labels, and edges within a label vanish. Each round at least halves the nodes that are
    left. Every round's labels are a written table, so a lost executor costs no earlier round. Labels that hold a large
    share of the nodes are looked up by a broadcast of those labels alone (skew_safe_lookup).
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    raw = scratch.cut(_smaller_first(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())))
    names = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # the sort makes the id order the node order: partitions are ranges, and ids grow with partition and row
    nodes = scratch.cut(names.repartitionByRange("node").sortWithinPartitions("node").withColumn("id", F.monotonically_increasing_id()))
    for c in ("a", "b"):
        raw_c = skew_safe_lookup(raw, c, nodes, "node").drop(c).withColumnRenamed("id", c)
        step = scratch.cut(raw_c)
        scratch.drop(raw)
        raw = step
    current, levels = raw, []
    while measured(current)["rows"]:
        least = _both_ways(current).groupBy("n").agg(F.min("m").alias("m"))
        labels = scratch.cut(least.select("n", F.least("n", "m").alias("p")))
        while True:
            # fewer rows move each time; a root is its own label
            far = labels.select(F.col("n").alias("q"), F.col("p").alias("pp"))
            jumped = skew_safe_lookup(labels, "p", far, "q").select("n", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
            jumped = scratch.cut(jumped, moved=F.count_if("moved"))
            scratch.drop(labels)
            labels, moved = jumped, measured(jumped)["moved"]
            if not moved:
                break
        levels.append(labels)
        ends = labels.select("n", "p")
        half = scratch.cut(skew_safe_lookup(current, "a", ends, "n").select(F.col("p").alias("a"), "b"))
        moved = skew_safe_lookup(half, "b", ends, "n").select("a", F.col("p").alias("b"))
        after = scratch.cut(_smaller_first(moved))
        scratch.drop(current, half)
        current = after
    if not levels:
        return nodes.select("node", F.col("node").alias("label"))
    # a label of one round is a node of a later one, or final
    out = levels[0]  # a cut table, whose rows are known
    for later in levels[1:]:
        out = scratch.cut(skew_safe_lookup(out, "p", later.select(F.col("n").alias("q"), F.col("p").alias("pp")), "q", "left").select("n", F.coalesce("pp", "p").alias("p")))
    named = out.join(nodes.withColumnRenamed("id", "n"), "n")
    return skew_safe_lookup(named, "p", nodes.select("id", F.col("node").alias("label")), "id").select("node", "label")


def sameas_edges(alignment: DataFrame, links: DataFrame, filters: DataFrame) -> DataFrame:
    """(a, b): positive reference links, and owl:sameAs links whose confidence is a number and reaches the threshold."""
    same = filters.where(F.col("link_type") == "owl:sameAs").select("interlink_id", F.coalesce("filter_threshold", F.lit(1.0)).alias("__t"))
    sure = links.join(checked_broadcast(same, 10_000), "interlink_id").where(F.col("confidence").isNotNull() & ~F.isnan("confidence") & (F.col("confidence") >= F.col("__t")))
    pick = [F.col("source_uri").alias("a"), F.col("target_uri").alias("b")]
    return alignment.where(F.col("positive")).select(*pick).unionByName(sure.select(*pick))
