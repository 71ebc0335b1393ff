"""Paths such as ?a/rdfs:label[@lang = 'en'] and restrictions such as ?a rdf:type dbo:City, as text, trees and DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def resolve(term: str, prefixes: dict[str, str]) -> str:
    """The URI of <uri>, prefix:name or a; an unknown prefix is an error."""
    if term == "a":
        return RDF_TYPE
    if term.startswith("<") and term.endswith(">"):
        return term[1:-1]
    prefix, colon, name = term.partition(":")
    if not colon:
        raise ValueError(f"no URI: {term}")
    if prefix not in prefixes:
        raise ValueError(f"unknown prefix: {prefix}")
    return prefixes[prefix] + name


def shorten(uri: str, prefixes: dict[str, str]) -> str:
    """prefix:name of the longest namespace that begins the URI, else <uri>."""
    best = max(((p, ns) for p, ns in prefixes.items() if uri.startswith(ns)), key=lambda x: len(x[1]), default=None)
    return f"<{uri}>" if best is None else f"{best[0]}:{uri[len(best[1]):]}"


@dataclass(frozen=True)
class Step:
    """forward, backward, lang or property; the property's URI where there is one; operator and value of a filter."""

    kind: str
    property: str = ""
    op: str = ""
    value: str = ""


@dataclass(frozen=True)
class ParsedPath:
    variable: str
    steps: tuple[Step, ...]


_TERM = r"(<[^>]*>|[^\s/\\\[\]<>=!']+)"
_STEP = re.compile(rf"\s*(?:([/\\])\s*{_TERM}|\[\s*(@lang|{_TERM[1:-1]})\s*(>=|<=|!=|=|>|<)\s*('[^']*'|\"[^\"]*\"|[^\]\s]+)\s*\])")


def parse_path(text: str, prefixes: dict[str, str]) -> ParsedPath:
    m = re.match(r"\s*\?([A-Za-z0-9_]+)", text)
    if not m:
        raise ValueError(f"a path begins with a variable: {text}")
    steps, at = [], m.end()
    while at < len(text.rstrip()):
        s = _STEP.match(text, at)
        if not s:
            raise ValueError(f"can't read the path at {text[at:]!r}")
        direction, term, subject, op, value = s.groups()
        if direction:
            steps.append(Step("forward" if direction == "/" else "backward", resolve(term, prefixes)))
        else:
            value = value[1:-1] if value[0] in "'\"" else resolve(value, prefixes) if ":" in value else value
            steps.append(Step("lang", "", op, value) if subject == "@lang" else Step("property", resolve(subject, prefixes), op, value))
        at = s.end()
    return ParsedPath(m.group(1), tuple(steps))


def _compare(col: Column, op: str, value: str) -> Column:
    if op in ("=", "!="):
        return col == value if op == "=" else col != value
    # order: of numbers where both are, else of texts
    number = col.try_cast("double")
    try:
        bound = F.lit(float(value))
    except ValueError:
        bound = F.lit(None).cast("double")
    of = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    return F.coalesce(of(number, bound), of(col, F.lit(value)))


def path_values(triples: DataFrame, path: ParsedPath, entities: DataFrame | None = None, itself: bool = False) -> DataFrame:
    """(uri, value): what the path reaches from each entity, each value once. entities: a column uri; None: all subjects.

    A path without steps has no values, or with ``itself`` the URI. Language and property filters keep values that pass;
    a value without a language has the language ''. Each step is an equi-join on the property's triples alone.
    """
    if entities is None:
        entities = triples.where(F.col("s_kind") == "resource").select(F.col("s").alias("uri")).distinct()
    now = entities.select("uri", F.col("uri").alias("value"), F.lit("").alias("lang"))
    if not path.steps and not itself:
        return now.select("uri", "value").limit(0)
    for s in path.steps:
        if s.kind == "lang":
            now = now.where(_compare(F.coalesce("lang", F.lit("")), s.op, s.value))
            continue
        of = triples.where(F.col("p") == s.property)
        if s.kind == "forward":
            now = now.join(of.select(F.col("s").alias("value"), F.col("o").alias("__o"), F.col("o_lang").alias("__l")), "value").select("uri", F.col("__o").alias("value"), F.col("__l").alias("lang"))
        elif s.kind == "backward":
            now = now.join(of.select(F.col("o").alias("value"), F.col("s").alias("__s")), "value").select("uri", F.col("__s").alias("value"), F.lit("").alias("lang"))
        else:
            now = now.join(of.where(_compare(F.col("o"), s.op, s.value)).select(F.col("s").alias("value")).distinct(), "value", "left_semi")
    return now.select("uri", "value").distinct()


@dataclass(frozen=True)
class Condition:
    """The path holds at least one of the values."""

    path: ParsedPath
    values: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


_TRIPLE = re.compile(r"\s*\?(\w+)\s+(<[^>]*>|\S+)\s+(<[^>]*>|\"(?:[^\"\\]|\\.)*\"(?:@\w+|\^\^\S+)?|'[^']*'|\?\w+|[^\s{}]+?)\s*(?:\.(?=\s|$|\})|;|$)")


def _closes(text: str) -> int:
    """Where the brace that begins the text is closed."""
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if not depth:
            return k
    raise ValueError(f"a brace isn't closed in {text!r}")


def parse_restriction(text: str, prefixes: dict[str, str]):
    """A tree of Condition, And and Or of triple patterns, joined by '.' or UNION; None for an empty text."""
    text = text.strip()
    if text.endswith("."):
        text = text[:-1].rstrip()
    if not text:
        return None
    while text.startswith("{") and _closes(text) == len(text) - 1:
        text = text[1:-1].strip().removesuffix(".").rstrip()
    groups = re.findall(r"\{([^{}]*)\}", text)
    if groups:
        rest = re.sub(r"\{[^{}]*\}", " ", text).split()
        if any(w.upper() != "UNION" for w in rest) or len(rest) != len(groups) - 1:
            raise ValueError(f"can't read the restriction {text!r}")
        parts = tuple(parse_restriction(g, prefixes) for g in groups)
        return parts[0] if len(parts) == 1 else Or(parts)
    found, at = [], 0
    while at < len(text):
        m = _TRIPLE.match(text, at)
        if not m:
            raise ValueError(f"can't read the restriction at {text[at:]!r}")
        var, prop, obj = m.groups()
        step = (Step("forward", resolve(prop, prefixes)),)
        if obj.startswith("?"):
            found.append(Condition(ParsedPath(var, step), ()))
        else:
            value = re.match(r"[\"'](.*)[\"'](?:@\w+|\^\^\S+)?$", obj, re.S)
            found.append(Condition(ParsedPath(var, step), (value.group(1) if value else resolve(obj, prefixes),)))
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    return found[0] if len(found) == 1 else And(tuple(found))


def restricted(triples: DataFrame, restriction) -> DataFrame:
    """(uri): the entities that meet the restriction; all resource subjects without one. A variable as object: any value."""
    if restriction is None:
        return triples.where(F.col("s_kind") == "resource").select(F.col("s").alias("uri")).distinct()
    if isinstance(restriction, Condition):
        got = triples.where((F.col("p") == restriction.path.steps[0].property) & (F.col("s_kind") == "resource"))
        if restriction.values:
            got = got.where(F.col("o").isin(list(restriction.values)))
        return got.select(F.col("s").alias("uri")).distinct()
    parts = [restricted(triples, p) for p in restriction.parts]
    if isinstance(restriction, And):
        return reduce(lambda a, b: a.join(b, "uri", "left_semi"), parts)
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def restriction_column(restriction, columns: dict[str, Column]) -> Column:
    """The restriction over a table: columns gives, by property URI, a column of arrays or single values."""
    if restriction is None:
        return F.lit(True)
    if isinstance(restriction, Condition):
        col = columns[restriction.path.steps[0].property]
        return col.isNotNull() if not restriction.values else col.isin(list(restriction.values))
    parts = [restriction_column(p, columns) for p in restriction.parts]
    return reduce((lambda a, b: a & b) if isinstance(restriction, And) else (lambda a, b: a | b), parts)


def entities_of(triples: DataFrame, restriction, paths: dict[str, ParsedPath], uris: DataFrame | None = None, itself: bool = False):
    """Entities with the values of each path as an array, empty where a path reaches nothing. uris limits them to a list."""
    from linkweave.plans.engine import Entities

    out = restricted(triples, restriction)
    if uris is not None:
        out = out.join(uris.select("uri").distinct(), "uri", "left_semi")
    base, names = out, {}
    for k, (text, path) in enumerate(paths.items()):
        names[text] = f"p{k}"
        sets = path_values(triples, path, base, itself).groupBy("uri").agg(F.collect_set("value").alias(f"p{k}"))
        out = out.join(sets, "uri", "left")
    cols = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in names.values()]
    return Entities(out.select("uri", *cols), names)


def frequent_paths(triples: DataFrame, entities: DataFrame | None = None, forward: int = 100, backward: int = 10) -> DataFrame:
    """(path, direction, frequency): the most used properties, by triples over the triples of the most used one."""
    from pyspark.sql import Window

    def top(col: str, direction: str, limit: int) -> DataFrame:
        rows = triples if entities is None else triples.join(entities.select(F.col("uri").alias(col)), col, "left_semi")
        counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "p").limit(limit)
        most = F.max("n").over(Window.partitionBy(F.lit(1)))  # over at most `limit` rows
        return counts.select(F.col("p").alias("path"), F.lit(direction).alias("direction"), (F.col("n") / most).alias("frequency"))

    return top("s", "forward", forward).unionByName(top("o", "backward", backward))


def frequent_paths_sample(triples: DataFrame, entities: DataFrame | None = None, sample: int = 100, least: float = 0.7, limit: int = 100) -> DataFrame:
    """(path, frequency): properties that more than ``least`` of a sample of entities have, with their share."""
    some = restricted(triples, None) if entities is None else entities.select("uri")
    some = some.orderBy(F.xxhash64("uri"), "uri").limit(sample)
    n = some.count()
    held = triples.join(F.broadcast(some.withColumnRenamed("uri", "s")), "s", "left_semi").select("s", "p").distinct().groupBy("p").agg((F.count(F.lit(1)) / F.lit(max(n, 1))).alias("frequency"))
    return held.where(F.col("frequency") > least).select(F.col("p").alias("path"), "frequency").orderBy(F.col("frequency").desc(), "path").limit(limit)


def frequent_restrictions(triples: DataFrame, least: float = 0.999) -> DataFrame:
    """(path, value): properties that nearly all entities have, with the one value that nearly all of these share."""
    n = restricted(triples, None).count()
    per = triples.select("s", "p", "o").distinct().groupBy("p", "o").agg(F.count(F.lit(1)).alias("n"))
    held = triples.select("s", "p").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least * n)
    return per.join(held, "p").where(F.col("n") >= least * F.col("m")).select(F.col("p").alias("path"), F.col("o").alias("value"))
