"""Matching of incoming batches against known entities with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.plans.engine import Entities, LinkJob, limit_links
from linkweave.plans.rules import LinkRule

#: The statement about an entity that matched nothing.
RESULT, UNKNOWN = "matchingResult", "UnknownInstance"


@dataclass(frozen=True)
class ServerConfig:
    """Whether entities that match nothing join the targets, and whether they are reported."""

    write_unknown: bool = False
    return_unknown: bool = False
    apply_limit: bool = False


class StreamMatcher:
    """Matches batches of entities, as the source side of each rule, against the rule's targets.

    known(spark) gives a rule's first targets. State is Parquet under ``folder``, one directory per batch: a batch that is run again
    replaces its own directories, so results don't double. Entities that match nothing are added with the target's columns, so
    later batches can match them.
    """

    def __init__(self, spark: SparkSession, rules: list[LinkRule], known: dict[str, Entities], as_source: Callable[[DataFrame, LinkRule], Entities], as_target: Callable[[DataFrame, LinkRule], Entities], folder: str, config: ServerConfig = ServerConfig()):
        self.spark, self.rules, self.known = spark, rules, known
        self.as_source, self.as_target, self.folder, self.config = as_source, as_target, folder.rstrip("/"), config

    def _read(self, what: str, before: int | None = None) -> DataFrame | None:
        """The rows of all batches, or of those before one; None if nothing was written."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return None
        df = self.spark.read.option("basePath", f"{self.folder}/{what}").parquet(f"{self.folder}/{what}")
        return df if before is None else df.where(F.col("batch") < before)

    def targets(self, rule: LinkRule, before: int | None = None) -> Entities:
        known = self.known[rule.id]
        more = self._read(f"added/{rule.id}", before)
        if more is None:
            return known
        return Entities(known.df.unionByName(more.select(*known.df.columns)).dropDuplicates(["uri"]), known.columns)

    def compact(self, before: int) -> None:
        """Makes one directory of the entities that the batches before one added, so state is read from few files.

        The new directory stands beside the old ones until those are deleted, and targets() counts a uri once, so a run that stops
        half-way loses and doubles nothing. Only batches that won't be run again belong before the one given."""
        sc = self.spark.sparkContext
        for rule in self.rules:
            rows = self._read(f"added/{rule.id}", before)
            if rows is None:
                continue
            root, new = f"{self.folder}/added/{rule.id}", f"batch={-before}"
            old = {f"batch={r['batch']}" for r in rows.select("batch").distinct().collect()} - {new}  # one row per batch
            rows.drop("batch").dropDuplicates(["uri"]).write.mode("overwrite").parquet(f"{self.folder}/compacted/{rule.id}")
            self.spark.read.parquet(f"{self.folder}/compacted/{rule.id}").write.mode("overwrite").parquet(f"{root}/{new}")
            for name in (*(f"{root}/{x}" for x in old), f"{self.folder}/compacted/{rule.id}"):
                path = sc._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def match(self, batch: DataFrame, batch_id: int) -> None:
        """One batch: the function for foreachBatch."""
        batch = batch.persist()
        try:
            unmatched = None
            for rule in self.rules:
                incoming = self.as_source(batch, rule)
                links = LinkJob(rule, Entities(incoming.df.dropDuplicates(["uri"]), incoming.columns), self.targets(rule, batch_id)).all_links()
                if self.config.apply_limit:
                    links = limit_links(links, rule.filter.limit)
                out = f"{self.folder}/links/rule={rule.id}/batch={batch_id}"
                links.write.mode("overwrite").parquet(out)
                done = self.spark.read.schema(links.schema).parquet(out)
                alone = incoming.df.select("uri").distinct().join(done.select(F.col("source_uri").alias("uri")), "uri", "left_anti").join(done.select(F.col("target_uri").alias("uri")), "uri", "left_anti")
                if self.config.write_unknown:
                    added = self.as_target(batch, rule)
                    rows = added.df.select("uri", *[F.col(added.columns[p]).alias(c) for p, c in self.known[rule.id].columns.items()])
                    rows.dropDuplicates(["uri"]).join(alone, "uri", "left_semi").write.mode("overwrite").parquet(f"{self.folder}/added/{rule.id}/batch={batch_id}")
                unmatched = alone if unmatched is None else unmatched.join(alone, "uri", "left_semi")
            if self.config.return_unknown and unmatched is not None:
                unmatched.write.mode("overwrite").parquet(f"{self.folder}/unknown/batch={batch_id}")
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Runs the stream; by default all that is there, in batches, then stops."""
        return stream.writeStream.foreachBatch(self.match).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def links(self) -> DataFrame:
        df = self._read("links")
        return self.spark.createDataFrame([], "source_uri string, target_uri string, confidence double, rule string, batch int") if df is None else df

    def unknown(self) -> DataFrame:
        """URIs that no rule linked."""
        df = self._read("unknown")
        return self.spark.createDataFrame([], "uri string, batch int") if df is None else df

    def unknown_lines(self, namespace: str) -> DataFrame:
        """The report of unknown entities as N-Triples, under a namespace for its two terms."""
        return self.unknown().select(F.format_string("<%s>  <%s>  <%s> .", "uri", F.lit(namespace + RESULT), F.lit(namespace + UNKNOWN)).alias("line"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """An extension: drops repeated keys that arrive within the delay, with state bounded by a watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
