"""Sources: N-Triples and N-Quads files, inline RDF, written entity caches, tables, SPARQL endpoints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.registry import register

TRIPLE_SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_lang string, o_datatype string, g string"
_IRI, _NODE = r"<([^>\s]*)>", r"(<[^>\s]*>|_:\S+)"
_LITERAL = r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>\s]*)>)?'
LINE = rf"^\s*{_NODE}\s*{_IRI}\s*(?:{_NODE}|{_LITERAL})\s*{_NODE}?\s*\.\s*(?:#.*)?$"


def _unescaped(c: Column) -> Column:
    """Text with its escapes undone. A \\u escape is read by the JSON reader, which has the same ones; a \\U escape becomes one or two."""
    hexed = lambda n: F.lpad(F.hex(n), 4, "0")

    def short(text: Column, digits: Column) -> Column:
        v = F.conv(digits, 16, 10).cast("bigint") - 65536
        pair = F.concat(F.lit("\\u"), hexed(F.lit(0xD800) + F.shiftright(v, 10)), F.lit("\\u"), hexed(F.lit(0xDC00) + v.bitwiseAND(F.lit(1023))))
        return F.replace(text, F.concat(F.lit("\\U"), digits), F.when(v < 0, F.concat(F.lit("\\u"), F.substring(digits, 5, 4))).otherwise(pair))

    long = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\U([0-9A-Fa-f]{8})"), 1))
    fixed = F.regexp_replace(F.when(F.contains(c, F.lit("\\U")), F.aggregate(long, c, short)).otherwise(c), r"\\'", "'")
    parsed = F.from_json(F.concat(F.lit('{"v":"'), fixed, F.lit('"}')), "v string")["v"]
    return F.when(F.contains(c, F.lit("\\")), F.coalesce(parsed, c)).otherwise(c)


def parse_lines(lines: DataFrame, column: str = "value", on_error: str = "fail") -> DataFrame:
    """Triples of lines in N-Triples or N-Quads. Empty lines and comments are left out; another line that can't be read fails the
    job, or with on_error='skip' is left out too."""
    part = lambda k: F.regexp_extract(column, LINE, k)
    readable = F.col(column).rlike(LINE)
    if on_error == "fail":
        wrong = F.raise_error(F.concat(F.lit("no N-Triples line: "), F.substring(column, 1, 200))).cast("boolean")
        readable = F.when(readable, True).when(F.col(column).rlike(r"^\s*(#.*)?$"), False).otherwise(wrong)
    good = lines.where(readable)
    node = lambda c: F.when(F.startswith(c, F.lit("<")), F.substring(c, 2, 2**31 - 1).substr(F.lit(1), F.length(c) - 2)).otherwise(c)
    kind = lambda c: F.when(F.startswith(c, F.lit("_:")), F.lit("blank")).otherwise(F.lit("resource"))
    is_node = part(3) != ""
    return good.select(
        node(part(1)).alias("s"),
        kind(part(1)).alias("s_kind"),
        part(2).alias("p"),
        F.when(is_node, node(part(3))).otherwise(_unescaped(part(4))).alias("o"),
        F.when(is_node, kind(part(3))).otherwise(F.lit("literal")).alias("o_kind"),
        F.when(is_node, F.lit("")).otherwise(part(5)).alias("o_lang"),
        F.when(is_node, F.lit("")).otherwise(part(6)).alias("o_datatype"),
        node(part(7)).alias("g"),
    )


def read_ntriples(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Triples of a file or folder of N-Triples or N-Quads: read in splits, line by line."""
    return parse_lines(spark.read.text(path), on_error=on_error)


_TTL = re.compile(r"""\s+|\#[^\n]*|(<[^>\s]*>)|(\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?:@([A-Za-z0-9-]+)|\^\^(<[^>]*>|[^\s;,.\]]+))?|(@prefix|@base|PREFIX|BASE)|([\[\](){};,.])(?![0-9])|(_:[\w-]+|[\w.-]*:[\w%.-]*[\w%-]|[\w.-]*:|\ba\b|[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?|true|false)""", re.X)


def parse_turtle(text: str, base: str = "") -> list[tuple]:
    """Triples of a Turtle text: prefixes, 'a', ';' and ',' lists, literals, numbers, booleans and anonymous nodes.

    For inline documents; collections in parentheses are an error. Large data belongs into N-Triples.
    """
    from linkweave.plans.paths import RDF_TYPE

    tokens, at = [], 0
    while at < len(text):
        m = _TTL.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read Turtle at {text[at : at + 40]!r}")
        if m.lastindex:
            tokens.append(m)
        at = m.end()
    prefixes, out, k, blanks = {}, [], 0, 0

    def escape(s: str) -> str:
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], m[1]), s)

    def iri(word: str) -> str:
        if word.startswith("<"):
            body = word[1:-1]
            return body if ":" in body else base + body
        prefix, _, name = word.partition(":")
        return prefixes[prefix] + name

    def punct() -> str:
        return tokens[k].group(6) or "" if k < len(tokens) else ""

    def term():
        """A node as (kind, value, lang, datatype)."""
        nonlocal k, blanks
        m = tokens[k]
        if punct() == "[":
            k += 1
            blanks += 1
            node = ("blank", f"_:b{blanks}", "", "")
            if punct() != "]":
                predicates(node)
            if punct() != "]":
                raise ValueError("a ] is missing")
            k += 1
            return node
        k += 1
        if m.group(1):
            return ("resource", iri(m.group(1)), "", "")
        if m.group(2):
            raw = m.group(2)
            return ("literal", escape(raw[3:-3] if raw.startswith('"""') else raw[1:-1]), m.group(3) or "", iri(m.group(4)) if m.group(4) else "")
        word = m.group(7)
        if word is None:
            raise ValueError(f"no term: {m.group()!r}")
        if word == "a":
            return ("resource", RDF_TYPE, "", "")
        if word.startswith("_:"):
            return ("blank", word, "", "")
        xsd = "http://www.w3.org/2001/XMLSchema#"
        if word in ("true", "false"):
            return ("literal", word, "", xsd + "boolean")
        if re.fullmatch(r"[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?", word):
            return ("literal", word, "", xsd + ("double" if "e" in word.lower() else "decimal" if "." in word else "integer"))
        return ("resource", iri(word), "", "")

    def predicates(subject) -> None:
        nonlocal k
        while True:
            p = term()
            while True:
                o = term()
                out.append((subject[1], subject[0], p[1], o[1], o[0], o[2], o[3], ""))
                if punct() != ",":
                    break
                k += 1
            while punct() == ";":
                k += 1
            if k >= len(tokens) or punct() in (".", "]"):
                return

    while k < len(tokens):
        word = tokens[k].group(5)
        if word:
            if "base" in word.lower():
                base = tokens[k + 1].group(1)[1:-1]
                k += 2
            else:
                prefixes[tokens[k + 1].group(7).rstrip(":")] = tokens[k + 2].group(1)[1:-1]
                k += 3
            if punct() == ".":
                k += 1
            continue
        subject = term()
        if punct() != ".":
            predicates(subject)
        if punct() == ".":
            k += 1
    return out


def parse_rdf_xml(text: str) -> list[tuple]:
    """Triples of an RDF/XML text: descriptions, typed nodes, nested nodes, literals with language or datatype."""
    import xml.etree.ElementTree as ET

    from linkweave.plans.paths import RDF_TYPE

    rdf, xml = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/XML/1998/namespace}"
    out, blanks = [], 0
    plain = lambda tag: tag[1:].replace("}", "")

    def node(e, lang: str) -> tuple[str, str]:
        nonlocal blanks
        if (about := e.get(rdf + "about")) is not None:
            me = ("resource", about)
        elif (given := e.get(rdf + "nodeID")) is not None:
            me = ("blank", "_:" + given)
        else:
            blanks += 1
            me = ("blank", f"_:x{blanks}")
        lang = e.get(xml + "lang", lang)
        add = lambda p, kind, o, l="", d="": out.append((me[1], me[0], p, o, kind, l, d, ""))  # noqa: E731, E741
        if e.tag != rdf + "Description":
            add(RDF_TYPE, "resource", plain(e.tag))
        for name, value in e.attrib.items():
            if not name.startswith((rdf, xml)):
                add(plain(name), "literal", value, lang)
        for c in e:
            p, own = plain(c.tag), c.get(xml + "lang", lang)
            if (r := c.get(rdf + "resource")) is not None:
                add(p, "resource", r)
            elif (r := c.get(rdf + "nodeID")) is not None:
                add(p, "blank", "_:" + r)
            elif len(c):
                for inner in c:
                    kind, value = node(inner, own)
                    add(p, kind, value)
            else:
                d = c.get(rdf + "datatype", "")
                add(p, "literal", c.text or "", "" if d else own, d)
        return me

    root = ET.fromstring(text)
    for e in root if root.tag == rdf + "RDF" else [root]:
        node(e, root.get(xml + "lang", ""))
    return out


_FORMATS = {"N-TRIPLE": "nt", "N-TRIPLES": "nt", "NT": "nt", "N-QUADS": "nt", "TURTLE": "ttl", "TTL": "ttl", "N3": "ttl", "RDF/XML": "xml", "RDF": "xml"}


def _kind(format: str) -> str:
    if format.upper() not in _FORMATS:
        raise ValueError(f"no RDF format: {format}")
    return _FORMATS[format.upper()]


def inline_rdf(spark: SparkSession, text: str, format: str, on_error: str = "fail") -> DataFrame:
    """Triples of a text in the configuration itself."""
    kind = _kind(format)
    if kind == "nt":
        return parse_lines(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"), on_error=on_error)
    return spark.createDataFrame(parse_turtle(text) if kind == "ttl" else parse_rdf_xml(text), TRIPLE_SCHEMA)


@register("source", "rdf", "Inline RDF")
def rdf_source(input: str, format: str):
    return lambda spark: inline_rdf(spark, input, format)


@register("source", "file", "RDF file")
def file_source(file: str, format: str = "N-TRIPLE", onError: str = "fail"):  # noqa: N803
    """N-Triples are read in splits; a line that can't be read fails the job unless onError is 'skip'. Turtle and RDF/XML files are documents, each read whole by one task."""
    kind = _kind(format)

    def read(spark: SparkSession) -> DataFrame:
        if kind == "nt":
            return read_ntriples(spark, file, onError)
        parse = parse_turtle if kind == "ttl" else parse_rdf_xml

        def rows(batches):
            import pandas as pd

            names = [f.split()[0] for f in TRIPLE_SCHEMA.split(", ")]
            for b in batches:
                for text in b["value"]:
                    yield pd.DataFrame(parse(text), columns=names)

        return spark.read.text(file, wholetext=True).mapInPandas(rows, TRIPLE_SCHEMA)

    return read


@register("source", "cache", "Entity cache")
def cache_source(dir: str):
    """Entities written by write_cache."""
    return lambda spark: read_cache(spark, dir)


def write_cache(entities, path: str) -> None:
    """Entities as Parquet, with the paths of their columns in the columns' names."""
    df = entities.df
    for p, c in entities.columns.items():
        df = df.withColumn(c, F.col(c).alias(c, metadata={"path": p}))
    df.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str):
    from linkweave.plans.engine import Entities

    df = spark.read.parquet(path)
    return Entities(df, {f.metadata["path"]: f.name for f in df.schema.fields if "path" in f.metadata})


@register("source", "sparqlEndpoint", "SPARQL endpoint")
def sparql_source(endpointURI: str, login: str = "", password: str = "", graph: str = "", pageSize: int = 1000, instanceList: str = "", pauseTime: int = 0, retryCount: int = 3, retryPause: int = 1000, pages: int = 1):  # noqa: N803
    """Triples from an endpoint, in pages; see linkweave.sources.sparql."""

    def read(spark: SparkSession, property: str = "") -> DataFrame:
        from linkweave.sources.sparql import SparqlDataSource

        spark.dataSource.register(SparqlDataSource)
        given = {"endpoint": endpointURI, "login": login, "password": password, "graph": graph, "page_size": pageSize, "uris": instanceList, "pause_ms": pauseTime, "retries": retryCount, "retry_pause_ms": retryPause, "readers": pages, "property": property}
        return spark.read.format("sparql").options(**{k: str(v) for k, v in given.items()}).load()

    return read
