"""Sinks for links: N-Triples and Alignment XML, as files or in memory; and readers of reference links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.registry import register

SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"


def ntriples(links: DataFrame, link_type: str = SAME_AS, gap: str = "  ") -> DataFrame:
    """One line per link, in the column line; terms are ``gap`` apart: two spaces, or one as the distributed writer has it."""
    return links.select(F.format_string(f"<%s>{gap}<%s>{gap}<%s> .", "source_uri", F.lit(link_type), "target_uri").alias("line"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def alignment_cells(links: DataFrame, link_type: str = SAME_AS) -> DataFrame:
    """One Alignment cell per link, in the column line."""
    relation = "=" if link_type == SAME_AS else link_type
    cell = F.concat(
        F.lit('<map><Cell><entity1 rdf:resource="'), _escaped(F.col("source_uri")), F.lit('"/><entity2 rdf:resource="'), _escaped(F.col("target_uri")),
        F.lit('"/><relation>'), _escaped(F.lit(relation)), F.lit('</relation><measure rdf:datatype="http://www.w3.org/2001/XMLSchema#float">'), F.col("confidence").cast("string"), F.lit("</measure></Cell></map>"),
    )
    return links.select(cell.alias("line"))


# Head and foot of an Alignment document, whose format is public.
HEADER = ['<?xml version="1.0" encoding="utf-8" standalone="no"?>', '<rdf:RDF xmlns="http://knowledgeweb.semanticweb.org/heterogeneity/alignment#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xsd="http://www.w3.org/2001/XMLSchema#">', "<Alignment>"]
FOOTER = ["</Alignment>", "</rdf:RDF>"]
FORMATS = {"ntriples": ntriples, "alignment": alignment_cells}


class FileSink:
    def __init__(self, file: str, format: str):
        if format not in FORMATS:
            raise ValueError(f"no link format: {format}")
        self.file, self.format = file, format

    def write(self, links: DataFrame, link_type: str) -> None:
        """A folder of text parts. An Alignment has its head in the first part's order: with head and foot it is one file."""
        lines = FORMATS[self.format](links, link_type)
        if self.format == "alignment":
            # a document has to be one file; the lines go through one task as a stream
            spark = links.sparkSession
            part = lambda k, xs: spark.createDataFrame([(k, i, x) for i, x in enumerate(xs)], "k int, i int, line string")
            body = lines.select(F.lit(1).alias("k"), F.lit(0).alias("i"), "line")
            lines = part(0, HEADER).unionByName(body).unionByName(part(2, FOOTER)).repartition(1).sortWithinPartitions("k", "i").select("line")
        lines.write.mode("overwrite").text(self.file)


class MemorySink:
    """Keeps the links as a temporary view."""

    def __init__(self, name: str):
        self.name = name

    def write(self, links: DataFrame, link_type: str) -> None:
        links.withColumn("link_type", F.lit(link_type)).createOrReplaceTempView(self.name)


@register("sink", "file", "File")
def file_sink(format: str, file: str = "output"):
    return FileSink(file, format)


@register("sink", "memory", "Memory")
def memory_sink(name: str = "links"):
    return MemorySink(name)


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(source_uri, target_uri, label, confidence) of reference links, by the file's extension.

    nt: positive links of confidence 0; n3debug: positive, '[confidence]: <s> <p> <o> .'; xml: '=' positive, '!=' negative.
    """
    if path.endswith(".xml"):
        text = spark.read.text(path, lineSep="</Cell>")
        get = lambda p: F.regexp_extract("value", p, 1)
        plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
        cells = text.select(
            plain(get(r'<entity1\s+rdf:resource="([^"]*)"')).alias("source_uri"), plain(get(r'<entity2\s+rdf:resource="([^"]*)"')).alias("target_uri"),
            get(r"<relation>\s*([^<]*?)\s*</relation>").alias("relation"), get(r"<measure[^>]*>\s*([^<]*?)\s*</measure>").try_cast("double").alias("confidence"),
        )
        return cells.where(F.col("relation").isin("=", "!=")).select("source_uri", "target_uri", (F.col("relation") == "=").alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    pattern = r"^\s*(?:\[([^\]]*)\]:)?\s*<([^>]*)>\s*<([^>]*)>\s*<([^>]*)>\s*\."
    get = lambda k: F.regexp_extract("value", pattern, k)
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(get(2).alias("source_uri"), get(4).alias("target_uri"), F.lit(True).alias("label"), F.coalesce(get(1).try_cast("double"), F.lit(0.0)).alias("confidence"))
