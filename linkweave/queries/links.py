"""Queries of linkage rules, filters, sinks, paths, evaluation and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkweave import evaluation as ev
from linkweave.cluster import Scratch, shared_dir
from linkweave.plans import engine as en
from linkweave.plans import paths as pa
from linkweave.plans.rules import Aggregate, Compare, Dataset, Filter, LinkRule, PathInput, TransformInput, paths_of
from linkweave.sources import sinks
from linkweave.sources.readers import TRIPLE_SCHEMA


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(side, name):
    return PathInput(f"?{side}/{name}")


def _digits(side, name):
    return TransformInput("numReduce", (_path(side, name),))


def rule(condition, limit=None, threshold=1.0, blocking=True, id="rule"):
    return LinkRule(id, Dataset("left", "a"), Dataset("right", "b"), condition, Filter(threshold, limit), blocking=blocking)


def customers(df):
    return en.table_entities(df, F.concat(F.lit("c:"), F.col("c_custkey")), {"?a/name": "c_name", "?a/nation": "c_nationkey", "?a/balance": "c_acctbal"})


def suppliers(df):
    return en.table_entities(df, F.concat(F.lit("s:"), F.col("s_suppkey")), {"?b/name": "s_name", "?b/nation": "s_nationkey", "?b/balance": "s_acctbal"})


SAME_NATION = Compare("equality", _path("a", "nation"), _path("b", "nation"), 0.5, required=True)
LIKE_NUMBER = Compare("levenshteinDistance", _digits("a", "name"), _digits("b", "name"), 3.0)
FLAGSHIP = Aggregate("min", (SAME_NATION, LIKE_NUMBER))


def job(spark, d, condition, **kw):
    return en.LinkJob(rule(condition, **kw), customers(_t(spark, d, "customer")), suppliers(_t(spark, d, "supplier")))


def rounded(links):
    return links.select("source_uri", "target_uri", F.round("confidence", 6).alias("confidence"))


def names(spark, d, side):
    return en.table_entities(_t(spark, d, "part").select("p_name").distinct(), "p_name", {f"?{side}/name": "p_name"}, once=True)


PLACE_PATHS = {"label": "rdfs:label", "geo": "wgs:geometry", "code": "ogz:postcode"}


def places(spark, d, source, side, names=tuple(PLACE_PATHS)):
    """Places of one source: sets of labels, places on the map and codes, as far as named. Any row of a uri says its source, in any case and padding."""
    rows = _t(spark, d, "path_values").select("uri", F.lower(F.trim("source_id")).alias("source"), "prop_path", F.explode_outer("value_set").alias("v"))
    of = lambda p: F.collect_set(F.when(F.col("prop_path") == p, F.col("v")))
    sets = rows.groupBy("uri").agg(F.max("source").alias("source"), *[of(PLACE_PATHS[n]).alias(n) for n in names]).where(F.col("source") == source)
    # read several times: for the keys and for the pairs
    return en.table_entities(Scratch(spark, "places").cut(sets.drop("source")), "uri", {f"?{side}/{n}": n for n in names}, once=True)


def place_job(spark, d, condition, left="gazette_north", right="cityregister"):
    names = lambda side: [n for n in PLACE_PATHS if f"?{side}/{n}" in paths_of(condition)]
    return en.LinkJob(rule(condition), places(spark, d, left, "a", names("a")), places(spark, d, right, "b", names("b")))


def link_flagship(spark, d):
    return job(spark, d, FLAGSHIP, limit=1).links(digits=6)


def link_all(spark, d):
    return job(spark, d, FLAGSHIP).all_links(digits=6)


def link_cross(spark, d):
    return job(spark, d, FLAGSHIP, blocking=False).all_links(digits=6)


def link_blocked_equality(spark, d):
    return job(spark, d, SAME_NATION).all_links(digits=6)


def link_blocked_levenshtein(spark, d):
    return job(spark, d, Compare("levenshteinDistance", _digits("a", "name"), _digits("b", "name"), 2.0)).all_links(digits=6)


def link_blocked_levenshtein_norm(spark, d):
    condition = Compare("levenshtein", _path("a", "name"), _path("b", "name"), 0.4)
    return en.LinkJob(rule(condition), names(spark, d, "a"), names(spark, d, "b")).all_links(digits=6)


def link_blocked_num(spark, d):
    return job(spark, d, Compare("num", _path("a", "balance"), _path("b", "balance"), 5.0)).all_links(digits=6)


def link_blocked_date(spark, d):
    day = lambda t, c, side: en.table_entities(_t(spark, d, t).select(F.date_format(c, "yyyy-MM-dd").alias("day")).distinct(), "day", {f"?{side}/day": "day"}, once=True)
    condition = Compare("date", _path("a", "day"), _path("b", "day"), 2.0, params={"maxDays": "2"})
    return en.LinkJob(rule(condition), day("orders", "o_orderdate", "a"), day("lineitem", "l_shipdate", "b")).all_links(digits=6)


def link_blocked_wgs84(spark, d):
    links = place_job(spark, d, Compare("wgs84", _path("a", "geo"), _path("b", "geo"), 2.0)).all_links()
    return links.select("source_uri", "target_uri", F.round("confidence", 4).alias("confidence"))


def _label_words(side):
    return TransformInput("tokenize", (TransformInput("lowerCase", (_path(side, "label"),)),))


def link_blocked_jaccard(spark, d):
    return place_job(spark, d, Compare("jaccard", _label_words("a"), _label_words("b"), 0.5)).all_links(digits=6)


def link_self_dedup(spark, d):
    condition = Compare("levenshteinDistance", _path("a", "name"), _path("b", "name"), 5.0)
    return rounded(en.LinkJob(rule(condition), names(spark, d, "a"), names(spark, d, "b")).all_links(self_join=True))


def link_max(spark, d):
    condition = Aggregate("max", (Compare("equality", _digits("a", "name"), _digits("b", "name"), 0.5), Compare("num", _path("a", "balance"), _path("b", "balance"), 3.0)))
    return job(spark, d, condition).all_links(digits=6)


def link_average(spark, d):
    condition = Aggregate("average", (Compare("levenshteinDistance", _digits("a", "name"), _digits("b", "name"), 2.0, weight=3), Compare("equality", _path("a", "nation"), _path("b", "nation"), 0.5, weight=1)))
    return job(spark, d, condition).all_links(digits=6)


def link_multi_rule_union(spark, d):
    return en.union_job(*[job(spark, d, c) for c in (FLAGSHIP, Compare("num", _path("a", "balance"), _path("b", "balance"), 3.0))]).all_links(digits=6)


def link_jaro_winkler(spark, d):
    low = lambda side: TransformInput("lowerCase", (_path(side, "label"),))
    condition = Aggregate("min", (Compare("equality", _digits("a", "code"), _digits("b", "code"), 0.5, required=True), Compare("jaroWinkler", low("a"), low("b"), 0.1)))
    return place_job(spark, d, condition).all_links(digits=6)


def link_reference_pairs(spark, d):
    pairs = _t(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("source_uri"), F.concat(F.lit("s:"), F.col("c_nationkey")).alias("target_uri"))
    return rounded(job(spark, d, FLAGSHIP).score_pairs(pairs))


def link_detailed(spark, d):
    """The detailed evaluation, one row per node of the tree."""
    links = job(spark, d, FLAGSHIP).explained().select("source_uri", "target_uri", F.explode("details").alias("x"))
    return links.select("source_uri", "target_uri", "x.node", "x.parent", "x.function", F.round("x.value", 6).alias("value"))


CLEAN = "confidence IS NOT NULL AND NOT isnan(confidence)"


def _match_links(spark, d):
    return _t(spark, d, "match_links").where(CLEAN)


def filter_limit(spark, d):
    return en.limit_links(_match_links(spark, d), 3)


def filter_distinct(spark, d):
    return en.limit_links(_match_links(spark, d), None)


def filter_threshold(spark, d):
    return job(spark, d, FLAGSHIP, threshold=0.6).all_links(mode="filter", digits=6)


def output_window(spark, d):
    return en.window(_match_links(spark, d).select("link_id", "confidence"), 0.3, 0.6)


def link_page(spark, d):
    return en.sorted_page(en.limit_links(_match_links(spark, d), None), 2)


def link_text_filter(spark, d):
    return en.containing(_match_links(spark, d).select("link_id", "source_uri", "target_uri"), "HERB")


def links_by_uri(spark, d):
    """Semi and anti joins: links of the places that have a label, and the places without a link."""
    labelled = _t(spark, d, "path_values").where(F.col("prop_path") == "rdfs:label").select(F.col("uri").alias("source_uri"))
    return _t(spark, d, "match_links").select("link_id", "source_uri").join(labelled, "source_uri", "left_semi")


def unlinked_uris(spark, d):
    links = _t(spark, d, "match_links")
    ends = links.select(F.explode(F.array("source_uri", "target_uri")).alias("uri"))
    return _t(spark, d, "path_values").select("uri").distinct().join(ends, "uri", "left_anti")


def fmt_ntriples(spark, d):
    return sinks.ntriples(_match_links(spark, d))


def fmt_alignment(spark, d):
    return sinks.alignment_cells(en.window(_match_links(spark, d), 0.01), "urn:near")


LINKS = "source_uri, target_uri, round(confidence, 6) AS confidence"
CS = """SELECT 'c:' || c_custkey AS source_uri, 's:' || s_suppkey AS target_uri, c_nationkey = s_nationkey AS same,
        levenshtein(regexp_replace(c_name, '[^0-9]+', '', 'g'), regexp_replace(s_name, '[^0-9]+', '', 'g')) AS d,
        abs(length(regexp_replace(c_name, '[^0-9]+', '', 'g')) - length(regexp_replace(s_name, '[^0-9]+', '', 'g'))) AS dl,
        abs(c_acctbal - s_acctbal) AS gap FROM customer, supplier"""
FLAG_ALL = f"SELECT source_uri, target_uri, 1 - d / 3.0 AS confidence FROM ({CS}) WHERE same AND d <= 3 AND dl < 3"
TOP1 = f"SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY confidence DESC, target_uri) AS k FROM ({FLAG_ALL})"
CLEAN_SQL = "(SELECT * FROM match_links WHERE confidence IS NOT NULL AND NOT isnan(confidence))"
DISTINCT_SQL = f"(SELECT source_uri, target_uri, max(confidence) AS confidence FROM {CLEAN_SQL} GROUP BY ALL)"
PLACES = "(SELECT DISTINCT uri, x FROM (SELECT uri, unnest(value_set) AS x FROM path_values WHERE uri IN (SELECT uri FROM path_values GROUP BY uri HAVING max(lower(trim(source_id))) = '{}') AND prop_path = '{}') WHERE x IS NOT NULL)"
GEO = r"""(SELECT uri, try_cast(s[CASE WHEN p THEN 2 ELSE 1 END] AS DOUBLE) AS lat, try_cast(s[CASE WHEN p THEN 1 ELSE 2 END] AS DOUBLE) AS lon FROM
    (SELECT uri, starts_with(x, 'POINT') AS p, string_split(trim(regexp_replace(x, '[^0-9.+ -]', '', 'g')), ' ') AS s FROM {}) WHERE len(s) = 2)"""
KM = "degrees(acos(least(greatest(sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon)), -1), 1))) * 60 * 1.1515 * 1.609344"
WORDS = r"(SELECT uri, list_distinct(flatten(list(string_split_regex(lower(x), '\s')))) AS w FROM {} GROUP BY uri)"
AVG = """SELECT source_uri, target_uri, (kl * lev + ke * eq) / nullif(kl + ke, 0) AS confidence FROM (SELECT *,
    CASE WHEN lev > 0 THEN 27 WHEN lev < 0 THEN 30 ELSE 0 END AS kl, CASE WHEN eq > 0 THEN 9 WHEN eq < 0 THEN 10 ELSE 0 END AS ke FROM
    (SELECT source_uri, target_uri, CASE WHEN dl >= {gate} THEN -1.0 ELSE greatest(1 - d / 2.0, -1) END AS lev, CASE WHEN same THEN 1.0 ELSE -1.0 END AS eq FROM ({cs})))""".format(gate=2 * (1 - (1 - 1 / 0.75 + 0.9)), cs=CS)

SQL = {
    "link_flagship": f"SELECT {LINKS} FROM ({TOP1}) WHERE k = 1",
    "link_all": f"SELECT {LINKS} FROM ({FLAG_ALL})",
    "link_cross": f"SELECT {LINKS} FROM ({FLAG_ALL})",
    "link_blocked_equality": f"SELECT source_uri, target_uri, 1.0::DOUBLE AS confidence FROM ({CS}) WHERE same",
    "link_blocked_levenshtein": f"SELECT source_uri, target_uri, round(1 - d / 2.0, 6) AS confidence FROM ({CS}) WHERE d <= 2 AND dl < 2",
    "link_blocked_levenshtein_norm": """
        WITH n AS (SELECT DISTINCT p_name AS n FROM part), p AS (SELECT x.n AS a, y.n AS b, greatest(length(x.n), length(y.n)) AS m FROM n x, n y)
        SELECT a AS source_uri, b AS target_uri, round(1 - levenshtein(a, b) / m / 0.4, 6) AS confidence FROM p
        WHERE abs(length(a) - length(b)) < 0.4 * m AND 1 - levenshtein(a, b) / m / 0.4 >= 0""",
    "link_blocked_num": f"SELECT source_uri, target_uri, round(1 - gap / 5 / 5, 6) AS confidence FROM ({CS}) WHERE 1 - gap / 5 / 5 >= 0",
    "link_blocked_date": """
        WITH a AS (SELECT DISTINCT o_orderdate::DATE AS a FROM orders), b AS (SELECT DISTINCT l_shipdate::DATE AS b FROM lineitem),
        p AS (SELECT a, b, abs((day(a) - day(b)) + 30 * (month(a) - month(b)) + 365 * (year(a) - year(b))) AS d FROM a, b)
        SELECT a::VARCHAR AS source_uri, b::VARCHAR AS target_uri, round(1 - d / 2, 6) AS confidence FROM p WHERE d <= 2""",
    "link_blocked_wgs84": f"""
        SELECT a.uri AS source_uri, b.uri AS target_uri, round(max(1 - {KM} / 2), 4) AS confidence
        FROM {GEO.format(PLACES.format('gazette_north', 'wgs:geometry'))} a, {GEO.format(PLACES.format('cityregister', 'wgs:geometry'))} b
        WHERE {KM} <= 2 GROUP BY ALL""",
    "link_blocked_jaccard": f"""
        SELECT source_uri, target_uri, round(1 - (1 - i / u) / 0.5, 6) AS confidence FROM (
            SELECT a.uri AS source_uri, b.uri AS target_uri, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(a.w || b.w)) AS u
            FROM {WORDS.format(PLACES.format('gazette_north', 'rdfs:label'))} a, {WORDS.format(PLACES.format('cityregister', 'rdfs:label'))} b)
        WHERE 1 - (1 - i / u) / 0.5 >= 0""",
    "link_self_dedup": """
        WITH n AS (SELECT DISTINCT p_name AS n FROM part)
        SELECT x.n AS source_uri, y.n AS target_uri, round(1 - levenshtein(x.n, y.n) / 5, 6) AS confidence FROM n x, n y
        WHERE x.n < y.n AND abs(length(x.n) - length(y.n)) < 5 AND levenshtein(x.n, y.n) <= 5""",
    "link_max": f"SELECT source_uri, target_uri, round(greatest(CASE WHEN d = 0 THEN 1 ELSE -1 END, greatest(1 - gap / 9, -1)), 6) AS confidence FROM ({CS}) WHERE d = 0 OR 1 - gap / 9 >= 0",
    "link_average": f"SELECT {LINKS} FROM ({AVG}) WHERE confidence >= 0",
    "link_multi_rule_union": f"""
        SELECT source_uri, target_uri, round(max(confidence), 6) AS confidence FROM
        ({FLAG_ALL} UNION ALL SELECT source_uri, target_uri, 1 - gap / 9 FROM ({CS}) WHERE 1 - gap / 9 >= 0) GROUP BY ALL""",
    "link_reference_pairs": f"""
        SELECT source_uri, target_uri, round(CASE WHEN NOT same THEN -1 WHEN dl >= 3 THEN -1 ELSE greatest(1 - d / 3, -1) END, 6) AS confidence
        FROM ({CS}) JOIN (SELECT 'c:' || c_custkey AS source_uri, 's:' || c_nationkey AS target_uri FROM customer) USING (source_uri, target_uri)""",
    "link_detailed": f"""
        WITH p AS (SELECT source_uri, target_uri, round(1 - d / 3, 6) AS v FROM ({CS}) WHERE same AND d <= 3 AND dl < 3)
        SELECT source_uri, target_uri, 0 AS node, NULL::INT AS parent, 'min' AS function, v AS value FROM p
        UNION ALL SELECT source_uri, target_uri, 1, 0, 'equality', 1.0 FROM p UNION ALL SELECT source_uri, target_uri, 2, 0, 'levenshteinDistance', v FROM p""",
    "filter_limit": f"""
        SELECT source_uri, target_uri, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY confidence DESC, target_uri) AS k FROM {DISTINCT_SQL}) WHERE k <= 3""",
    "filter_distinct": f"SELECT * FROM {DISTINCT_SQL}",
    "filter_threshold": f"SELECT {LINKS} FROM ({FLAG_ALL}) WHERE confidence >= 0.6",
    "output_window": f"SELECT link_id, confidence FROM {CLEAN_SQL} WHERE confidence >= 0.3 AND confidence < 0.6",
    "link_page": f"SELECT * FROM {DISTINCT_SQL} ORDER BY confidence DESC, source_uri, target_uri LIMIT 100 OFFSET 200",
    "link_text_filter": f"SELECT link_id, source_uri, target_uri FROM {CLEAN_SQL} WHERE contains(lower(source_uri), 'herb') OR contains(lower(target_uri), 'herb')",
    "links_by_uri": "SELECT link_id, source_uri FROM match_links WHERE source_uri IN (SELECT uri FROM path_values WHERE prop_path = 'rdfs:label')",
    "unlinked_uris": "SELECT DISTINCT uri FROM path_values WHERE uri NOT IN (SELECT source_uri FROM match_links UNION SELECT target_uri FROM match_links)",
    "fmt_ntriples": f"SELECT '<' || source_uri || '>  <http://www.w3.org/2002/07/owl#sameAs>  <' || target_uri || '> .' AS line FROM {CLEAN_SQL}",
    "fmt_alignment": f"""
        SELECT '<map><Cell><entity1 rdf:resource="' || source_uri || '"/><entity2 rdf:resource="' || target_uri || '"/><relation>urn:near</relation><measure rdf:datatype="http://www.w3.org/2001/XMLSchema#float">'
        || confidence || '</measure></Cell></map>' AS line FROM {CLEAN_SQL} WHERE confidence >= 0.01""",
}

# Triples: places with their paths, and customers with nations and regions; documents with a language.
PREFIXES = {p: f"{p}:" for p in ("rdfs", "rdf", "ogz", "wgs", "skos", "t")}


def place_triples(spark, d):
    v = _t(spark, d, "path_values").select(F.col("uri").alias("s"), F.col("prop_path").alias("p"), F.explode("value_set").alias("o")).where("o is not null")
    return _as_triples(v.withColumn("o_lang", F.lit("")))


def world_triples(spark, d):
    c, n, r = (_t(spark, d, t) for t in ("customer", "nation", "region"))
    at = lambda p, c: F.concat(F.lit(p), F.col(c))
    rows = [
        c.select(at("c:", "c_custkey").alias("s"), F.lit("t:nation").alias("p"), at("n:", "c_nationkey").alias("o")),
        c.select(at("c:", "c_custkey").alias("s"), F.lit("t:segment").alias("p"), F.col("c_mktsegment").alias("o")),
        c.select(at("c:", "c_custkey").alias("s"), F.lit("t:balance").alias("p"), F.col("c_acctbal").cast("string").alias("o")),
        n.select(at("n:", "n_nationkey").alias("s"), F.lit("t:region").alias("p"), at("r:", "n_regionkey").alias("o")),
        r.select(at("r:", "r_regionkey").alias("s"), F.lit("t:name").alias("p"), F.col("r_name").alias("o")),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    docs = _t(spark, d, "documents").select(at("d:", "doc_id").alias("s"), F.lit("t:source").alias("p"), F.col("source").alias("o"), F.coalesce("lang", F.lit("")).alias("o_lang")).where("o is not null")
    return _as_triples(out.withColumn("o_lang", F.lit("")).unionByName(docs))


def _as_triples(df):
    have = {"s": F.col("s"), "s_kind": F.lit("resource"), "p": F.col("p"), "o": F.col("o"), "o_kind": F.lit("literal"), "o_lang": F.col("o_lang"), "o_datatype": F.lit(""), "g": F.lit("")}
    return df.select(*[have[c.split()[0]].alias(c.split()[0]) for c in TRIPLE_SCHEMA.split(", ")])


def _by_path(text, triples=world_triples):
    return lambda spark, d: pa.path_values(triples(spark, d), pa.parse_path(text, PREFIXES))


def _restricted(text):
    return lambda spark, d: pa.restricted(place_triples(spark, d), pa.parse_restriction(text, PREFIXES))


def path_entities(spark, d):
    """Entities with two optional paths, each as a sorted list."""
    got = pa.entities_of(place_triples(spark, d), pa.parse_restriction("?a rdf:type ogz:Museum .", PREFIXES), {p: pa.parse_path(p, PREFIXES) for p in ("?a/rdfs:label", "?a/ogz:founded")})
    return got.df.select("uri", F.array_join(F.array_sort("p0"), "|").alias("labels"), F.array_join(F.array_sort("p1"), "|").alias("founded"))


def frequent_paths(spark, d):
    return pa.frequent_paths(place_triples(spark, d)).select("path", "direction", F.round("frequency", 6).alias("frequency"))


def frequent_paths_sample(spark, d):
    return pa.frequent_paths_sample(place_triples(spark, d))


def frequent_restrictions(spark, d):
    return pa.frequent_restrictions(place_triples(spark, d), 0.3)


PLACE = "(SELECT uri, prop_path AS p, x FROM (SELECT uri, prop_path, unnest(value_set) AS x FROM path_values) WHERE x IS NOT NULL)"
SQL |= {
    "path_forward": f"SELECT DISTINCT uri, x AS value FROM {PLACE} WHERE p = 'rdfs:label'",
    "path_backward": "SELECT DISTINCT 'n:' || c_nationkey AS uri, 'c:' || c_custkey AS value FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)",
    "path_multi_hop": "SELECT DISTINCT 'c:' || c_custkey AS uri, r_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "path_lang_filter": "SELECT DISTINCT 'd:' || doc_id AS uri, source AS value FROM documents WHERE lang = 'en' AND source IS NOT NULL",
    "path_property_filter": "SELECT DISTINCT 'c:' || c_custkey AS uri, 'n:' || c_nationkey AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
    "path_order_filter": "SELECT DISTINCT 'c:' || c_custkey AS uri, c_mktsegment AS value FROM customer WHERE c_acctbal >= 5000",
    "restrict_and": f"SELECT uri FROM {PLACE} WHERE p = 'rdf:type' AND x = 'ogz:Museum' INTERSECT SELECT uri FROM {PLACE} WHERE p = 'rdf:type' AND x = 'ogz:Place'",
    "restrict_union": f"SELECT DISTINCT uri FROM {PLACE} WHERE p = 'rdf:type' AND x IN ('ogz:Museum', 'ogz:Library', 'ogz:School')",
    "path_entities": f"""
        SELECT t.uri, coalesce((SELECT string_agg(DISTINCT x, '|' ORDER BY x) FROM {PLACE} l WHERE l.uri = t.uri AND l.p = 'rdfs:label'), '') AS labels,
               coalesce((SELECT string_agg(DISTINCT x, '|' ORDER BY x) FROM {PLACE} l WHERE l.uri = t.uri AND l.p = 'ogz:founded'), '') AS founded
        FROM (SELECT DISTINCT uri FROM {PLACE} WHERE p = 'rdf:type' AND x = 'ogz:Museum') t""",
    "frequent_paths": f"""
        WITH n AS (SELECT p, count(*) AS n FROM {PLACE} GROUP BY p), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, p) AS k, max(n) OVER () AS m FROM n)
        SELECT p AS path, d AS direction, round(n / m, 6) AS frequency FROM k, (VALUES ('forward', 100), ('backward', 10)) t(d, most) WHERE k <= most""",
    "frequent_restrictions": f"""
        WITH n AS (SELECT count(DISTINCT uri) AS n FROM {PLACE}), m AS (SELECT p, count(DISTINCT uri) AS m FROM {PLACE} GROUP BY p),
        o AS (SELECT p, x, count(DISTINCT uri) AS c FROM {PLACE} GROUP BY ALL)
        SELECT o.p AS path, x AS value FROM o JOIN m USING (p), n WHERE m >= 0.3 * n AND c >= 0.3 * m""",
}


def _scored(spark, d):
    """Reference links with the highest confidence of their match, if there is one."""
    ref = _t(spark, d, "alignment_links").where("positive is not null").groupBy("source_uri", "target_uri").agg(F.bool_or("positive").alias("label"))
    return ref.join(en.limit_links(_match_links(spark, d).select("source_uri", "target_uri", "confidence"), None), ev.LINK, "left")


def eval_confusion(spark, d):
    return ev.confusion(_scored(spark, d), 0.8)


def eval_prf(spark, d):
    q = ev.quality(ev.confusion(_scored(spark, d), 0.8))
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


def eval_score(spark, d):
    return ev.graded_score(_scored(spark, d), 0.9).select(F.round("score", 6).alias("score"))


def eval_status(spark, d):
    ref = _t(spark, d, "alignment_links").select("source_uri", "target_uri", F.col("positive").alias("label"))
    return ev.link_status(_t(spark, d, "match_links").select("link_id", "source_uri", "target_uri"), ref)


def eval_reference(spark, d):
    return ev.reference_status(_scored(spark, d).where(F.col("confidence").isNotNull())).select("source_uri", "target_uri", "right")


def _positive(spark, d):
    return _t(spark, d, "alignment_links").where("positive").select("source_uri", "target_uri")


def align_negatives(spark, d):
    return ev.with_negatives(_positive(spark, d))


def align_decide(spark, d):
    ref = _positive(spark, d).distinct().withColumn("label", F.lit(True))
    return ev.decide(ref, _t(spark, d, "match_links").select("source_uri", "target_uri"), False)


SCORED = f"""(SELECT source_uri, target_uri, label, confidence FROM (SELECT source_uri, target_uri, bool_or(positive) AS label FROM alignment_links
    WHERE positive IS NOT NULL GROUP BY ALL) LEFT JOIN {DISTINCT_SQL} USING (source_uri, target_uri))"""
COUNTS = """SELECT count(*) FILTER (label AND h) AS tp, count(*) FILTER (NOT label AND NOT h) AS tn, count(*) FILTER (NOT label AND h) AS fp,
    count(*) FILTER (label AND NOT h) AS fn FROM (SELECT label, coalesce(confidence >= 0.8, false) AS h FROM {})""".format(SCORED)
SQL |= {
    "eval_confusion": COUNTS,
    "eval_prf": f"""
        WITH c AS ({COUNTS}), q AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)
        SELECT round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f_measure,
        round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
        round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM q""",
    "eval_score": f"""
        WITH s AS (SELECT label, coalesce(confidence, -1) AS c FROM {SCORED}),
        e AS (SELECT 1 - sum(CASE WHEN label AND c < 0.9 THEN pow(0.9 - c / 0.9, 2) ELSE 0 END) / count(*) FILTER (label) AS p,
                     1 - sum(CASE WHEN NOT label AND c >= 0.9 THEN pow((c - 0.9) / (1 - 0.9), 2) ELSE 0 END) / count(*) FILTER (NOT label) AS n FROM s)
        SELECT round(2 * p * n / (p + n), 6) AS score FROM e""",
    "eval_status": """
        SELECT link_id, m.source_uri, m.target_uri, CASE WHEN label THEN 'correct' WHEN NOT label THEN 'incorrect' ELSE 'undecided' END AS status
        FROM match_links m LEFT JOIN (SELECT source_uri, target_uri, bool_or(positive) AS label FROM alignment_links WHERE positive IS NOT NULL GROUP BY ALL) r USING (source_uri, target_uri)""",
    "eval_reference": f'SELECT source_uri, target_uri, CASE WHEN label THEN confidence >= 0 ELSE confidence < 0 END AS "right" FROM {SCORED} WHERE confidence IS NOT NULL',
    "align_negatives": """
        WITH p AS (SELECT DISTINCT source_uri, target_uri FROM alignment_links WHERE positive),
        n AS (SELECT source_uri, coalesce(lead(target_uri) OVER w, first_value(target_uri) OVER w) AS target_uri FROM p WINDOW w AS (ORDER BY source_uri, target_uri))
        SELECT source_uri, target_uri, true AS label FROM p UNION ALL (SELECT source_uri, target_uri, false FROM n ANTI JOIN p USING (source_uri, target_uri))""",
    "align_decide": """
        WITH p AS (SELECT DISTINCT source_uri, target_uri FROM alignment_links WHERE positive), m AS (SELECT DISTINCT source_uri, target_uri FROM match_links)
        SELECT source_uri, target_uri, true AS label FROM p ANTI JOIN m USING (source_uri, target_uri) UNION ALL SELECT source_uri, target_uri, false FROM m""",
}


def _streamed(spark, d, config):
    from linkweave.streaming.matcher import StreamMatcher

    r = rule(FLAGSHIP, id="flagship")
    schema = _t(spark, d, "customer").schema
    folder = f"{shared_dir(spark)}/linkweave-stream-{uuid.uuid4().hex}"
    as_target = lambda batch, _: en.table_entities(batch, F.concat(F.lit("c:"), F.col("c_custkey")), {"?b/name": "c_name", "?b/nation": "c_nationkey", "?b/balance": "c_acctbal"})
    m = StreamMatcher(spark, [r], {r.id: suppliers(_t(spark, d, "supplier"))}, lambda batch, _: customers(batch), as_target, folder + "/state", config)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(d)
    m.start(stream, folder + "/checkpoint").awaitTermination()
    return m


def stream_match(spark, d):
    from linkweave.streaming.matcher import ServerConfig

    return rounded(_streamed(spark, d, ServerConfig()).links())


def stream_unknown(spark, d):
    from linkweave.streaming.matcher import ServerConfig

    return _streamed(spark, d, ServerConfig(return_unknown=True)).unknown().select("uri")


def stream_write_back(spark, d):
    """The targets after a batch whose unmatched entities have joined them."""
    from linkweave.streaming.matcher import ServerConfig

    m = _streamed(spark, d, ServerConfig(write_unknown=True))
    return m.targets(m.rules[0]).df.select("uri")


UNKNOWN_SQL = f"SELECT 'c:' || c_custkey AS uri FROM customer WHERE 'c:' || c_custkey NOT IN (SELECT source_uri FROM ({FLAG_ALL}))"
SQL |= {
    "stream_match": f"SELECT {LINKS} FROM ({FLAG_ALL})",
    "stream_unknown": UNKNOWN_SQL,
    "stream_write_back": f"SELECT 's:' || s_suppkey AS uri FROM supplier UNION ALL {UNKNOWN_SQL}",
}

_FUNCTIONS = (
    link_flagship, link_all, link_cross, link_blocked_equality, link_blocked_levenshtein, link_blocked_levenshtein_norm, link_blocked_num, link_blocked_date, link_blocked_wgs84, link_blocked_jaccard,
    link_self_dedup, link_max, link_average, link_multi_rule_union, link_jaro_winkler, link_reference_pairs, link_detailed, filter_limit, filter_distinct, filter_threshold, output_window, link_page,
    link_text_filter, links_by_uri, unlinked_uris, fmt_ntriples, fmt_alignment, path_entities, frequent_paths, frequent_paths_sample, frequent_restrictions, eval_confusion, eval_prf, eval_score,
    eval_status, eval_reference, align_negatives, align_decide, stream_match, stream_unknown, stream_write_back,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {
    "path_forward": _by_path("?a/rdfs:label", place_triples),
    "path_backward": _by_path("?a\\t:nation"),
    "path_multi_hop": _by_path("?a/t:nation/t:region/t:name"),
    "path_lang_filter": _by_path("?a/t:source[@lang = 'en']"),
    "path_property_filter": _by_path("?a/t:nation[t:region = 'r:1']"),
    "path_order_filter": _by_path("?a[t:balance >= 5000]/t:segment"),
    "restrict_and": _restricted("?a rdf:type ogz:Museum . ?a rdf:type ogz:Place ."),
    "restrict_union": _restricted("{ { ?a rdf:type ogz:Museum } UNION { ?a rdf:type ogz:Library } UNION { ?a rdf:type ogz:School } }"),
}
