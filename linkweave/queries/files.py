"""Queries that write files and read them back: RDF sources, caches, sinks and reference links."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkweave import evaluation as ev
from linkweave.cluster import Scratch
from linkweave.plans import engine as en
from linkweave.queries.links import FLAGSHIP, customers, job, rule, suppliers
from linkweave.queries.links import SQL as LINK_SQL
from linkweave.registry import lookup
from linkweave.sources import readers, sinks


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark, name):
    """A folder of its own in the shared one, which goes when the driver ends."""
    return f"{Scratch(spark, name).root}/{uuid.uuid4().hex}"


def _quoted(c):
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _label_lines(spark, d, graph=False):
    """A line for each label: its row, the property, the text, and the source as its graph."""
    rows = _t(spark, d, "path_values").where(F.col("prop_path") == "rdfs:label").select("row_id", "source_id", F.explode("value_set").alias("v")).where("v is not null")
    parts = [F.lit("<urn:row:"), F.col("row_id").cast("string"), F.lit("> <urn:label> "), _quoted(F.col("v")), F.lit("@en")]
    if graph:
        parts += [F.lit(" <urn:graph:"), F.coalesce(F.lower(F.trim("source_id")), F.lit("none")), F.lit(">")]
    return rows.select(F.concat(*parts, F.lit(" .")).alias("value"))


def _read_back(spark, d, graph=False):
    path = _folder(spark, "nt")
    _label_lines(spark, d, graph).write.text(path)
    return lookup("source", "file")(file=path, format="N-QUADS" if graph else "N-TRIPLE")(spark)


def src_file_ntriples(spark, d):
    return _read_back(spark, d).select(F.col("s").alias("subject"), "p", F.col("o").alias("text"), F.col("o_lang").alias("lang"))


def src_file_quads(spark, d):
    return _read_back(spark, d, True).groupBy(F.col("g").alias("graph")).agg(F.count(F.lit(1)).alias("labels"), F.countDistinct("o").alias("texts"))


def src_file_turtle(spark, d):
    lines = _t(spark, d, "nation").select(F.concat(F.lit("@prefix t: <urn:t:> .\nt:n"), F.col("n_nationkey").cast("string"), F.lit(" a t:Nation ; t:name "), _quoted(F.col("n_name")), F.lit(" ; t:region t:r"), F.col("n_regionkey").cast("string"), F.lit(" .")).alias("value"))
    path = _folder(spark, "ttl")
    lines.repartition("value").write.option("lineSep", "\n").text(path)
    triples = lookup("source", "file")(file=path, format="TURTLE")(spark)
    return triples.select(F.col("s").alias("subject"), "p", "o", "o_kind")


def src_inline(spark, d):
    """The regions as a text in the configuration."""
    text = "".join(f'<urn:r:{r["r_regionkey"]}> <urn:name> "{r["r_name"]}" .\n' for r in _t(spark, d, "region").toLocalIterator())
    return lookup("source", "rdf")(input=text, format="N-TRIPLES")(spark).select(F.col("s").alias("subject"), F.col("o").alias("name"))


def src_cache(spark, d):
    """Links of entities that were written to a cache and read again."""
    job_ = job(spark, d, FLAGSHIP)
    sides = []
    for side in (customers(_t(spark, d, "customer")), suppliers(_t(spark, d, "supplier"))):
        path = _folder(spark, "cache")
        readers.write_cache(side, path)
        sides.append(lookup("source", "cache")(dir=path)(spark))
    return en.LinkJob(job_.rule, *sides).all_links(digits=6)


def dedup_by_uri(spark, d):
    """Of several rows of an order's customer the first order counts."""
    e = en.table_entities(_t(spark, d, "orders"), F.concat(F.lit("c:"), F.col("o_custkey")), {"?a/order": F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "?a/status": "o_orderstatus"})
    first = ev.first_by_uri(e, [e.columns["?a/order"]])
    return first.df.select("uri", F.col(e.columns["?a/order"]).alias("order_key"), F.col(e.columns["?a/status"]).alias("status"))


def _positive(spark, d):
    a = _t(spark, d, "alignment_links").where(F.col("positive") & F.col("source_uri").isNotNull() & F.col("target_uri").isNotNull())
    return a.select("source_uri", "target_uri").distinct().withColumn("confidence", F.lit(0.5))


def _written(spark, links, format, suffix):
    path = f"{_folder(spark, format)}{suffix}"
    lookup("sink", "file")(format=format, file=path).write(links, sinks.SAME_AS)
    return path


def ref_ntriples(spark, d):
    """Reference links written by the file sink and read again."""
    path = _written(spark, _positive(spark, d), "ntriples", ".nt")
    return sinks.read_alignment(spark, path).select("source_uri", "target_uri", "label")


def ref_alignment(spark, d):
    path = _written(spark, _positive(spark, d), "alignment", ".xml")
    return sinks.read_alignment(spark, path).select("source_uri", "target_uri", "label", "confidence")


def fmt_ntriples_distributed(spark, d):
    """Lines as the distributed writer has them, terms one space apart."""
    return sinks.ntriples(_positive(spark, d), gap=" ")


def ref_import(spark, d):
    """Reference links of a file without negative ones: those are made."""
    path = _written(spark, _positive(spark, d), "ntriples", ".nt")
    return ev.import_reference(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("source_uri").alias("sources"))


def ref_compare_files(spark, d):
    """The matches of the sameAs interlinks as a file against the reference as a file."""
    m = _t(spark, d, "match_links").where(F.col("source_uri").isNotNull() & F.col("target_uri").isNotNull() & (F.col("confidence") >= 0.8) & ~F.isnan("confidence"))
    found = _written(spark, m.select("source_uri", "target_uri").distinct().withColumn("confidence", F.lit(1.0)), "ntriples", ".nt")
    reference = _written(spark, _positive(spark, d), "ntriples", ".nt")
    return ev.compare_files(spark, found, reference).select("tp", "fn")


def eval_reference_cache(spark, d):
    """Reference pairs scored on cached entities: each customer with the supplier of its number modulo 10."""
    pairs = _t(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("source_uri"), F.concat(F.lit("s:"), (F.col("c_custkey") % 10 + 1)).alias("target_uri"))
    sides = ev.cache_reference_entities(customers(_t(spark, d, "customer")), suppliers(_t(spark, d, "supplier")), pairs, _folder(spark, "reference"))
    scored = en.LinkJob(rule(FLAGSHIP), *sides).score_pairs(pairs)
    return scored.groupBy((F.col("confidence") >= 0).alias("links")).agg(F.count(F.lit(1)).alias("pairs"))


QUERIES = {
    f.__name__: f
    for f in (src_file_ntriples, src_file_quads, src_file_turtle, src_inline, src_cache, dedup_by_uri, ref_ntriples, ref_alignment, fmt_ntriples_distributed, ref_import, ref_compare_files, eval_reference_cache)
}

POSITIVE = "SELECT DISTINCT source_uri, target_uri FROM alignment_links WHERE positive AND source_uri IS NOT NULL AND target_uri IS NOT NULL"
LABELS = "SELECT row_id, lower(trim(source_id)) AS s, v FROM (SELECT row_id, source_id, unnest(value_set) AS v FROM path_values WHERE prop_path = 'rdfs:label') WHERE v IS NOT NULL"
SQL = {
    "src_file_ntriples": f"SELECT 'urn:row:' || row_id AS subject, 'urn:label' AS p, v AS text, 'en' AS lang FROM ({LABELS})",
    "src_file_quads": f"SELECT 'urn:graph:' || coalesce(s, 'none') AS graph, count(*) AS labels, count(DISTINCT v) AS texts FROM ({LABELS}) GROUP BY ALL",
    "src_file_turtle": """
        SELECT 'urn:t:n' || n_nationkey AS subject, p, o, k AS o_kind FROM nation, (VALUES (1), (2), (3)) t(x), LATERAL (SELECT
            CASE x WHEN 1 THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' WHEN 2 THEN 'urn:t:name' ELSE 'urn:t:region' END AS p,
            CASE x WHEN 1 THEN 'urn:t:Nation' WHEN 2 THEN n_name ELSE 'urn:t:r' || n_regionkey END AS o, CASE x WHEN 2 THEN 'literal' ELSE 'resource' END AS k)""",
    "src_inline": "SELECT 'urn:r:' || r_regionkey AS subject, r_name AS name FROM region",
    "src_cache": LINK_SQL["link_all"],
    "eval_reference_cache": f"""
        WITH p AS (SELECT 'c:' || c_custkey AS source_uri, 's:' || (c_custkey % 10 + 1) AS target_uri FROM customer), l AS ({LINK_SQL["link_all"]})
        SELECT l.source_uri IS NOT NULL AS links, count(*) AS pairs FROM p LEFT JOIN l USING (source_uri, target_uri) GROUP BY 1""",
    "dedup_by_uri": "SELECT 'c:' || o_custkey AS uri, lpad(min(o_orderkey)::VARCHAR, 12, '0') AS order_key, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey",
    "ref_ntriples": f"SELECT source_uri, target_uri, true AS label FROM ({POSITIVE})",
    "ref_alignment": f"SELECT source_uri, target_uri, true AS label, 0.5::DOUBLE AS confidence FROM ({POSITIVE})",
    "fmt_ntriples_distributed": f"SELECT '<' || source_uri || '> <http://www.w3.org/2002/07/owl#sameAs> <' || target_uri || '> .' AS line FROM ({POSITIVE})",
    "ref_import": f"""
        WITH p AS ({POSITIVE}), k AS (SELECT *, row_number() OVER (ORDER BY source_uri, target_uri) - 1 AS k, count(*) OVER () AS n FROM p),
        w AS (SELECT a.source_uri, b.target_uri FROM k a JOIN k b ON b.k = (a.k + 1) % a.n), x AS (SELECT * FROM w EXCEPT ALL SELECT w.* FROM w SEMI JOIN p USING (source_uri, target_uri))
        SELECT true AS label, count(*) AS links, count(DISTINCT source_uri) AS sources FROM p UNION ALL SELECT false, count(*), count(DISTINCT source_uri) FROM x""",
    "ref_compare_files": f"""
        WITH p AS ({POSITIVE}), m AS (SELECT DISTINCT source_uri, target_uri FROM match_links WHERE confidence >= 0.8 AND NOT isnan(confidence))
        SELECT count(m.source_uri) AS tp, count(*) - count(m.source_uri) AS fn FROM p LEFT JOIN m USING (source_uri, target_uri)""",
}
