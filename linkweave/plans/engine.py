"""Link jobs: from two datasets and a rule to links."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.cluster import Scratch, fits, skew_safe_join
from linkweave.operators.metrics import FREQUENT
from linkweave.plans.compiler import Compiler, Entity, Keys, comparisons
from linkweave.plans.rules import Aggregate, LinkRule, Output, paths_of, variable_of
from linkweave.values import Values

#: A side of fewer rows than this may be sent to all tasks.
SMALL_SIDE = 100_000
#: Entities of equal values stand together, so many to a row.
CHUNK = 512
#: What a key costs, in comparisons of two values: it is made, sent to another task and looked up there.
KEY_COST = 300


@dataclass
class Entities:
    """Entities of a dataset: df with a column ``uri``, and for each path its column, a string or an array of strings."""

    df: DataFrame
    columns: dict[str, str]
    #: Whether it is known that no uri stands twice.
    once: bool = False


def table_entities(df: DataFrame, uri: Column | str, paths: dict[str, Column | str], once: bool = False) -> Entities:
    """Entities from a table. Each path is a column: arrays of strings are sets, other columns one value each, as text.

    Rows whose uri is null are left out. A path that is null has no values. Other columns don't go along.
    once: no uri stands twice, which is not checked.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    names = {p: f"p{k}" for k, p in enumerate(paths)}
    df = df.select(as_col(uri).cast("string").alias("uri"), *[as_col(c).alias(names[p]) for p, c in paths.items()]).where(F.col("uri").isNotNull())
    kinds = dict(df.dtypes)
    df = df.select("uri", *[(F.array_distinct(F.col(n).cast("array<string>")) if kinds[n].startswith("array") else F.col(n).cast("string")).alias(n) for n in names.values()])
    return Entities(df, names, once)


class LinkJob:
    """A rule over two datasets. Nothing runs until an action on one of the DataFrames it gives."""

    def __init__(self, rule: LinkRule, source: Entities, target: Entities):
        #: Whether the parts of the rule's max are rules of their own: a confidence of one that is no number leaves the others as they are.
        self.apart = False
        self.rule, self.once, self.sides = rule, (source.once, target.once), (source, target)
        source = self._plain(source, rule.source.variable)
        target = self._plain(target, rule.target.variable)
        self.columns = (source.columns, target.columns)
        self.compiler = Compiler(rule, self._entity(source, rule.source.variable, "s"), self._entity(target, rule.target.variable, "t"))
        self.source = self.compiler.with_inputs(self._renamed(source, "s"), 0)
        self.target = self.compiler.with_inputs(self._renamed(target, "t"), 1)

    def _plain(self, e: Entities, variable: str) -> Entities:
        """Only the columns that the rule uses."""
        used = [p for p in paths_of(self.rule.condition) if variable_of(p) == variable]
        columns = {p: e.columns[p] for p in used}
        return Entities(e.df.select("uri", *dict.fromkeys(columns.values())), columns, e.once)

    @staticmethod
    def _renamed(e: Entities, side: str) -> DataFrame:
        return e.df.select(*[F.col(c).alias(f"{side}_{c}") for c in e.df.columns])

    @staticmethod
    def _entity(e: Entities, variable: str, side: str) -> Entity:
        kinds = dict(e.df.dtypes)
        return Entity(variable, {p: Values(F.col(f"{side}_{c}"), kinds[c].startswith("array")) for p, c in e.columns.items()})

    def candidates(self) -> DataFrame:
        """Pairs of entities to compare: those that share a blocking key, or all where the rule has no keys."""
        return self._pairs(self.source, self.target, self.compiler.keys_of(self.rule.condition) if self.rule.blocking else None)

    def _small(self) -> int | None:
        """Which side is small enough to be sent to all tasks, 1 for the target, or None. It is looked up once."""
        if not hasattr(self, "_small_side"):
            self._small_side = next((k for k, df in ((1, self.target), (0, self.source)) if fits(df, SMALL_SIDE)), None)
        return self._small_side

    def _pairs(self, source: DataFrame, target: DataFrame, keys: Keys | None) -> DataFrame:
        """Pairs of rows that share a key, once for each key they share; all pairs without keys."""
        if keys is not None and keys.many > 1:
            left = source.withColumn("__key", F.explode(keys.source))
            right = target.withColumn("__key", F.explode(keys.target))
            return skew_safe_join(left, right, "__key").drop("__key")
        key = lambda df, k: df if keys is None else df.withColumn("__key", F.explode(k))
        small = self._small()
        if small is None:
            if keys is None:
                return source.crossJoin(target)
            return skew_safe_join(key(source, keys.source), key(target, keys.target), "__key").drop("__key")
        # few files or row groups make few tasks, and each row may meet many
        spark = source.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        spread = lambda df, c: df.repartition(tasks, c if c in df.columns else f"{c[:2]}uri")
        if small:
            left, right = spread(source, "s_uris"), target
        else:
            left, right = spread(target, "t_uris"), source
        if keys is None:
            return left.crossJoin(F.broadcast(right))
        own = (keys.source, keys.target) if small else (keys.target, keys.source)
        return key(left, own[0]).join(F.broadcast(key(right, own[1])), "__key").drop("__key")

    def _grouped(self, side: int) -> DataFrame:
        """The different values of a side, each with the uris of its entities, in order, CHUNK to a row: what is equal is compared once."""
        df, s = (self.source, self.target)[side], "st"[side]
        values = [f"{s}_{c}" for c in dict.fromkeys(self.columns[side][p] for p in self.compiler.used(side))] + [c for c in self.compiler.columns[side] if c not in self.compiler.sketches(side)]
        place = F.row_number().over(Window.partitionBy(*values).orderBy(f"{s}_uri"))
        rows = df.select(f"{s}_uri", *values).distinct().withColumn("__part", F.floor((place - 1) / CHUNK))
        return rows.groupBy(*values, "__part").agg(F.sort_array(F.collect_list(f"{s}_uri")).alias(f"{s}_uris")).drop("__part").withColumns(self.compiler.sketches(side))

    def _repeated(self) -> bool:
        """Whether an entity stands twice on a side, with other values."""
        for k, (df, uri) in enumerate(((self.source, "s_uri"), (self.target, "t_uri"))):
            if not self.once[k] and df.groupBy(uri).count().where("count > 1").limit(1).count():
                return True
        return False

    def _keys(self, node, least: float, source: DataFrame, target: DataFrame) -> Keys | None:
        """The keys that find a part's pairs with the least work."""
        if not self.rule.blocking:
            # all pairs count; what an equality rules out needs no look
            return self.compiler.equal(node, least)
        keys = self.compiler.keys_of(node, least)
        if keys is not None and (c := self.compiler.sets(node, least)) is not None:
            each = [df.select(F.explode(k).alias("__key")) for df, k in ((source, keys.source), (target, keys.target))]
            often = each[0].unionByName(each[1]).groupBy("__key").count().orderBy(F.col("count").desc(), "__key").limit(FREQUENT).collect()
            return self.compiler.rarest(c, least, [r["__key"] for r in reversed(often)]) or keys
        if keys is None or keys.coarse is None or not keys.coarse.once:
            return keys
        per_key = lambda df, k: df.select(F.explode(k).alias("__key")).groupBy("__key").count()
        left, right = per_key(source, keys.coarse.source), per_key(target, keys.coarse.target).withColumnRenamed("count", "others")
        met = left.join(right, "__key").agg(F.sum(F.col("count").cast("double") * F.col("others")).alias("met"), F.sum(F.col("count") + F.col("others")).alias("rows")).first()
        return keys.coarse if (met["met"] or 0) <= KEY_COST * keys.many * (met["rows"] or 0) else keys

    def _found(self, least: float) -> DataFrame:
        """(s_uris, t_uris, confidence): groups of entities of equal values whose confidence is at least that, each pair once."""
        source, target = self._grouped(0), self._grouped(1)
        root = self.rule.condition
        alone = lambda c: F.nanvl(F.coalesce(self.compiler.operator(c), F.lit(-1.0)), F.lit(-1.0))
        value = F.greatest(*[alone(c) for c in root.children]) if self.apart and len(root.children) > 1 else self.compiler.confidence()
        parts = root.children if isinstance(root, Aggregate) and root.function == "max" and self.rule.blocking else (root,)
        all_keys = [self._keys(c, least, source, target) for c in parts]
        if None in all_keys:
            parts, all_keys = (root,), [self._keys(root, least, source, target)]
        out = None
        for k, keys in enumerate(all_keys):
            pairs = self._pairs(source, target, keys)
            if len(parts) > 1:
                # a part's own pairs are those that no part before it finds
                reached = [alone(c) >= least for c in parts[: k + 1]]
                pairs = reduce(lambda df, c: df.where(~c), reached[:k], pairs.where(reached[k]))
            elif (cond := self.compiler.necessary(least)) is not None:
                pairs = pairs.where(cond)
            links = pairs.withColumn("confidence", value).where(F.nanvl("confidence", F.lit(-1.0)) >= least).select("s_uris", "t_uris", "confidence")
            if keys is not None and not keys.once:
                links = links.groupBy("s_uris", "t_uris").agg(F.max("confidence").alias("confidence"))
            out = links if out is None else out.unionByName(links)
        return out

    def _scored(self, pairs: DataFrame, missing: float = -1.0) -> DataFrame:
        if (cond := self.compiler.necessary()) is not None and missing == -1.0:
            pairs = pairs.where(cond)
        return pairs.withColumn("confidence", self.compiler.confidence(missing))

    def _least(self, mode: str) -> float:
        return 0.0 if mode == "engine" else max(self.rule.filter.threshold, 0.0)

    def all_links(self, mode: str = "engine", self_join: bool = False, digits: int | None = None) -> DataFrame:
        """(source_uri, target_uri, confidence) of all matches, each pair once with its highest confidence.

        mode 'engine' keeps confidences of 0 or more, 'filter' those that reach the rule's filter threshold. With self_join the
        sides are one dataset: of a pair only one direction is kept, and no entity is linked to itself. digits: to round to.
        """
        found = self._found(self._least(mode))
        if digits is not None:
            found = found.withColumn("confidence", F.round("confidence", digits))
        links = found.select(F.explode("s_uris").alias("source_uri"), "t_uris", "confidence").select("source_uri", F.explode("t_uris").alias("target_uri"), "confidence")
        if self_join:
            links = links.where(F.col("source_uri") < F.col("target_uri"))
        if self._repeated():
            links = links.groupBy("source_uri", "target_uri").agg(F.max("confidence").alias("confidence"))
        return links

    def links(self, mode: str = "engine", self_join: bool = False, digits: int | None = None) -> DataFrame:
        """The matches under the rule's limit of links per source entity, if it has one. digits: to round to, after ranking."""
        limit = self.rule.filter.limit
        if limit is None:
            return self.all_links(mode, self_join, digits)
        if self_join or self._repeated():
            links = limit_links(self.all_links(mode, self_join), limit)
        else:
            # entities of equal values have the same best targets
            found = self._found(self._least(mode)).select("s_uris", "confidence", F.slice("t_uris", 1, limit).alias("t_uris"))
            if limit == 1:
                best = found.groupBy("s_uris").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.get("t_uris", F.lit(0)).alias("t"))).alias("x"))
                best = best.select("s_uris", F.col("x.t").alias("target_uri"), F.abs("x.c").alias("confidence"))
            else:
                rank = F.row_number().over(Window.partitionBy("s_uris").orderBy(F.col("confidence").desc(), F.col("target_uri")))
                best = found.select("s_uris", F.explode("t_uris").alias("target_uri"), "confidence").withColumn("__rank", rank).where(F.col("__rank") <= limit)
            links = best.select(F.explode("s_uris").alias("source_uri"), "target_uri", "confidence")
        return links if digits is None else links.withColumn("confidence", F.round("confidence", digits))

    def explained(self) -> DataFrame:
        """The detailed evaluation: missing values count 0, so pairs without values link too; with the tree of confidences.

        Where no value is missing the pairs are those of the keys; entities that miss one meet all others."""
        source, target = self._grouped(0), self._grouped(1)
        whole = [self.compiler.complete(k) for k in (0, 1)]
        keys = self._keys(self.rule.condition, 0.0, source, target)
        if keys is None:
            pairs = self._pairs(source, target, None)
        else:
            pairs = self._pairs(source.where(whole[0]), target.where(whole[1]), keys)
            pairs = pairs if (cond := self.compiler.necessary()) is None else pairs.where(cond)
            pairs = pairs if keys.once else pairs.dropDuplicates(["s_uris", "t_uris"])
            pairs = pairs.unionByName(self._pairs(source.where(~whole[0]), target, None)).unionByName(self._pairs(source.where(whole[0]), target.where(~whole[1]), None))
        scored = self._scored(pairs, 0.0).where(F.nanvl("confidence", F.lit(-1.0)) >= 0).withColumn("details", self.compiler.details())
        each = scored.select(F.explode("s_uris").alias("source_uri"), "t_uris", "confidence", "details")
        return each.select("source_uri", F.explode("t_uris").alias("target_uri"), "confidence", "details")

    def score_pairs(self, pairs: DataFrame, missing: float = -1.0) -> DataFrame:
        """pairs (source_uri, target_uri, ...) with the rule's confidence; pairs of unknown entities are left out."""
        both = pairs.join(self.source.withColumnRenamed("s_uri", "source_uri"), "source_uri").join(self.target.withColumnRenamed("t_uri", "target_uri"), "target_uri")
        scored = both.withColumn("confidence", self.compiler.confidence(missing))
        return scored.select(*pairs.columns, "confidence")

    def write(self, links: DataFrame, outputs: tuple[Output, ...] | None = None) -> list[str]:
        """Offers the links to every output, the rule's own unless others are given, and gives the sinks. They are made once."""
        from linkweave.registry import lookup

        outputs = self.rule.outputs if outputs is None else outputs
        scratch = Scratch(links.sparkSession, "links") if len(outputs) > 1 else None
        links = scratch.cut(links) if scratch else links
        for o in outputs:
            sink = lookup("sink", o.sink)(**o.params)
            sink.write(window(links, o.min_confidence, o.max_confidence), self.rule.link_type)
        return [o.sink for o in outputs]


def limit_links(links: DataFrame, limit: int | None) -> DataFrame:
    """At most ``limit`` links of each source entity: the highest confidences, ties by target_uri. None: all, once each."""
    links = links.groupBy("source_uri", "target_uri").agg(F.max("confidence").alias("confidence"))
    if limit is None:
        return links
    rank = F.row_number().over(Window.partitionBy("source_uri").orderBy(F.col("confidence").desc(), F.col("target_uri")))
    return links.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def window(links: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """The links whose confidence is at least low and below high."""
    if low is not None:
        links = links.where(F.col("confidence") >= low)
    return links if high is None else links.where(F.col("confidence") < high)


def sorted_page(links: DataFrame, page: int = 0, size: int = 100, descending: bool = True) -> DataFrame:
    """One page of the links by confidence; ties by source, then target."""
    order = F.col("confidence").desc() if descending else F.col("confidence").asc()
    return links.orderBy(order, "source_uri", "target_uri").offset(page * size).limit(size)


def containing(links: DataFrame, text: str, values: list[str] | None = None) -> DataFrame:
    """The links with the text, in any case, in a URI or in one of the given array columns."""
    low = text.lower()
    hit = F.contains(F.lower("source_uri"), F.lit(low)) | F.contains(F.lower("target_uri"), F.lit(low))
    for c in values or []:
        hit = hit | F.exists(c, lambda v: F.contains(F.lower(v), F.lit(low)))
    return links.where(hit)


def merged(*links: DataFrame) -> DataFrame:
    """Links of several rules together, each pair once with its highest confidence."""
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return limit_links(out, None)


def union_job(*jobs: LinkJob) -> LinkJob:
    """Rules over the same entities as one: its links are those of merged(), but each pair is found once, so no pairs are put together."""
    first = jobs[0]
    if any(c.threshold is None for j in jobs for c in comparisons(j.rule.condition)):
        raise ValueError("a threshold that comes from a rule's filter is not that of other rules")
    rule = replace(first.rule, condition=Aggregate("max", tuple(j.rule.condition for j in jobs)), blocking=all(j.rule.blocking for j in jobs))
    job = LinkJob(rule, *first.sides)
    job.apart = True
    return job
