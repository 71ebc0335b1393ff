"""Queries of transformers, distance measures and aggregators."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkweave.cluster import checked_broadcast
from linkweave.registry import lookup
from linkweave.values import Values

LABELS = "SELECT row_id, list_distinct(value_set) AS v FROM path_values WHERE prop_path = 'rdfs:label' AND value_set IS NOT NULL"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tr(function, table, key, column, **params):
    """A query of a transformer over a column of single values."""

    def run(spark, d):
        f = lookup("transformer", function)(**params)
        return _t(spark, d, table).select(key, f([Values(F.col(column).cast("string"), False)]).col.alias("result"))

    return run


def _sets(function, **params):
    """A query of a transformer over the label sets: one row per value of the result."""

    def run(spark, d):
        f = lookup("transformer", function)(**params)
        rows = _t(spark, d, "path_values").where((F.col("prop_path") == "rdfs:label") & F.col("value_set").isNotNull())
        return rows.select("row_id", F.explode(f([Values(F.filter("value_set", lambda v: v.isNotNull()))]).col).alias("result"))

    return run


def _concat_sets(spark, d):
    f = lookup("transformer", "concat")(glue="-")
    rows = _t(spark, d, "path_values").where((F.col("prop_path") == "rdfs:label") & F.col("value_set").isNotNull())
    return rows.select("row_id", F.explode(f([Values(F.filter("value_set", lambda v: v.isNotNull())), Values(F.array(F.lit("x"), F.lit("y")))]).col).alias("result"))


def _concat(spark, d):
    f = lookup("transformer", "concat")(glue="-")
    return _t(spark, d, "part").select("p_partkey", f([Values(F.col("p_name"), False), Values(F.col("p_brand"), False)]).col.alias("result"))


def _logarithm(spark, d):
    f = lookup("transformer", "logarithm")(base="2")
    out = f([Values(F.col("p_size").cast("string"), False)]).col
    return _t(spark, d, "part").select("p_partkey", F.round(out.cast("double"), 6).alias("result"))


def _convert_charset(spark, d):
    """Every text of value_set, read as if its bytes in ISO-8859-1 were UTF-8."""
    f = lookup("transformer", "convertCharset")(sourceCharset="ISO-8859-1", targetCharset="UTF-8")
    rows = _t(spark, d, "input_values").select("value_id", F.posexplode("value_set").alias("at", "v")).where("v is not null")
    return rows.select("value_id", "at", f([Values(F.col("v"), False)]).col.alias("result"))


QUERIES = {
    "tr_replace": _tr("replace", "part", "p_partkey", "p_name", search=" ", replace="_"),
    "tr_regex_replace": _tr("regexReplace", "part", "p_partkey", "p_name", regex="([aeiou])[a-z]", replace="<$1>"),
    "tr_concat": _concat,
    "tr_concat_sets": _concat_sets,
    "tr_remove_blanks": _tr("removeBlanks", "part", "p_partkey", "p_name"),
    "tr_lower": _tr("lowerCase", "customer", "c_custkey", "c_mktsegment"),
    "tr_upper": _tr("upperCase", "part", "p_partkey", "p_name"),
    "tr_num_reduce": _tr("numReduce", "customer", "c_custkey", "c_name"),
    "tr_alpha_reduce": _tr("alphaReduce", "customer", "c_custkey", "c_name"),
    "tr_remove_special": _tr("removeSpecialChars", "customer", "c_custkey", "c_name"),
    "tr_strip_prefix": _tr("stripPrefix", "customer", "c_custkey", "c_name", prefix="Customer#"),
    "tr_strip_postfix": _tr("stripPostfix", "part", "p_partkey", "p_brand", postfix="1"),
    "tr_strip_uri_prefix": _tr("stripUriPrefix", "path_values", "row_id", "uri"),
    "tr_logarithm": _logarithm,
    "tr_remove_empty": _sets("removeEmptyValues"),
    "tr_tokenize": _sets("tokenize", regex=r"\s"),
    "tr_stem": _tr("stem", "part", "p_partkey", "p_name"),
    "tr_convert_charset": _convert_charset,
}

SQL = {
    "tr_replace": "SELECT p_partkey, replace(p_name, ' ', '_') AS result FROM part",
    "tr_regex_replace": r"SELECT p_partkey, regexp_replace(p_name, '([aeiou])[a-z]', '<\1>', 'g') AS result FROM part",
    "tr_concat": "SELECT p_partkey, p_name || '-' || p_brand AS result FROM part",
    "tr_concat_sets": f"SELECT row_id, x || '-' || y AS result FROM (SELECT row_id, unnest(v) AS x FROM ({LABELS})), (VALUES ('x'), ('y')) t(y) WHERE x IS NOT NULL",
    "tr_remove_blanks": "SELECT p_partkey, replace(p_name, ' ', '') AS result FROM part",
    "tr_lower": "SELECT c_custkey, lower(c_mktsegment) AS result FROM customer",
    "tr_upper": "SELECT p_partkey, upper(p_name) AS result FROM part",
    "tr_num_reduce": "SELECT c_custkey, regexp_replace(c_name, '[^0-9]+', '', 'g') AS result FROM customer",
    "tr_alpha_reduce": r"SELECT c_custkey, regexp_replace(c_name, '[^\pL]+', '', 'g') AS result FROM customer",
    "tr_remove_special": r"SELECT c_custkey, regexp_replace(c_name, '[^\d\pL\w]+', '', 'g') AS result FROM customer",
    "tr_strip_prefix": "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS result FROM customer",
    "tr_strip_postfix": "SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN left(p_brand, length(p_brand) - 1) ELSE p_brand END AS result FROM part",
    "tr_strip_uri_prefix": "SELECT row_id, regexp_extract(uri, '[^/#]*$') AS result FROM path_values",
    "tr_logarithm": "SELECT p_partkey, round(ln(p_size) / ln(2), 6) AS result FROM part",
    "tr_remove_empty": f"SELECT row_id, x AS result FROM (SELECT row_id, unnest(v) AS x FROM ({LABELS})) WHERE x <> ''",
    "tr_tokenize": rf"""
        WITH x AS (SELECT row_id, unnest(v) AS x FROM ({LABELS})),
        t AS (SELECT row_id, CASE WHEN x = '' THEN [''] ELSE regexp_split_to_array(regexp_replace(x, '(\s)+$', ''), '\s') END AS t FROM x WHERE x IS NOT NULL)
        SELECT DISTINCT row_id, unnest(t) AS result FROM t""",
}

# Distances of pairs of part names and of other columns; limits and thresholds as a comparison at threshold 4 would give.
NAMES = "SELECT DISTINCT p_name AS a FROM part"
PAIRS = f"FROM ({NAMES}) x, (SELECT DISTINCT p_name AS b FROM part) y"


def _m(metric, limit=4.0, **params):
    def run(spark, d):
        a = _t(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
        pairs = a.crossJoin(checked_broadcast(a.withColumnRenamed("a", "b"), 10_000))  # the distinct names are a few dozen
        dist = lookup("metric", metric)(**params).distance(Values(F.col("a"), False), Values(F.col("b"), False), limit, float("inf"))
        return pairs.select("a", "b", F.round(F.when(dist != float("inf"), dist), 6).alias("distance"))

    return run


def _words(metric):
    """A measure of sets, over the sets of words of the names."""

    def run(spark, d):
        a = _t(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
        pairs = a.crossJoin(checked_broadcast(a.withColumnRenamed("a", "b"), 10_000))
        split = lookup("transformer", "tokenize")()
        side = lambda c: split([Values(F.col(c), False)])
        return pairs.select("a", "b", F.round(lookup("metric", metric)().distance(side("a"), side("b"), 1.0, 1.0), 6).alias("distance"))

    return run


def _order_pairs(metric, fmt, **params):
    """A measure of each order's date and that of its customer's first order."""

    def run(spark, d):
        o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", fmt).alias("day"))
        first = o.groupBy("o_custkey").agg(F.min("day").alias("first"))
        dist = lookup("metric", metric)(**params).distance(Values(F.col("day"), False), Values(F.col("first"), False), 1.0, 1e18)
        return o.join(first, "o_custkey").select("o_orderkey", dist.alias("distance"))

    return run


def _m_num(spark, d):
    p = _t(spark, d, "part")
    dist = lookup("metric", "num")(maxDistance="2").distance(Values(F.col("p_size").cast("string"), False), Values(F.col("p_partkey").cast("string"), False), 0.5, 1e18)
    return p.select("p_partkey", F.round(dist, 6).alias("distance"))


def _m_wgs84(spark, d):
    a = _t(spark, d, "path_values").where(F.col("prop_path") == "wgs:geometry").select("row_id", F.explode("value_set").alias("v")).where("v is not null")
    one = a.groupBy("row_id").agg(F.min("v").alias("v"))
    dist = lookup("metric", "wgs84")(unit="km").distance(Values(F.col("v"), False), Values(F.lit("POINT(13.3989 52.5006)"), False), 1.0, 1e18)
    return one.select("row_id", F.round(F.when(dist != float("inf"), dist), 4).alias("distance"))


QUERIES |= {
    "m_levenshtein_distance": _m("levenshteinDistance"),
    "m_levenshtein_norm": _m("levenshtein", 0.5),
    "m_qgrams": _m("qGrams", 1.0),
    "m_equality": _m("equality"),
    "m_inequality": _m("inequality"),
    "m_jaro": _m("jaro"),
    "m_jaro_winkler": _m("jaroWinkler"),
    "m_jaccard": _words("jaccard"),
    "m_dice": _words("dice"),
    "m_num": _m_num,
    "m_date": _order_pairs("date", "yyyy-MM-dd", maxDays=1),
    "m_datetime": _order_pairs("dateTime", "yyyy-MM-dd'T'HH:mm:ss"),
    "m_wgs84": _m_wgs84,
}

WORDS = "list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS v"
SQL |= {
    "m_levenshtein_distance": f"SELECT a, b, CASE WHEN abs(length(a) - length(b)) < 4 THEN levenshtein(a, b)::DOUBLE END AS distance {PAIRS}",
    "m_levenshtein_norm": f"SELECT a, b, CASE WHEN abs(length(a) - length(b)) < 0.5 * greatest(length(a), length(b)) THEN round(levenshtein(a, b) / greatest(length(a), length(b)), 6) END AS distance {PAIRS}",
    "m_qgrams": f"""
        WITH g AS (SELECT a AS n, unnest([substr('#' || a || '#', k, 2) for k in range(1, length(a) + 2)]) AS g FROM ({NAMES})),
        c AS (SELECT n, g, count(*) AS c FROM g GROUP BY ALL), s AS (SELECT n, sum(c) AS s FROM c GROUP BY n),
        i AS (SELECT x.n AS a, y.n AS b, sum(least(x.c, y.c)) AS i FROM c x JOIN c y USING (g) GROUP BY ALL)
        SELECT x.n AS a, y.n AS b, round(1 - 2 * coalesce(i, 0) / (x.s + y.s), 6) AS distance
        FROM s x CROSS JOIN s y LEFT JOIN i ON i.a = x.n AND i.b = y.n""",
    "m_equality": f"SELECT a, b, CASE WHEN a = b THEN 0.0 ELSE 1.0 END::DOUBLE AS distance {PAIRS}",
    "m_inequality": f"SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS distance {PAIRS}",
    "m_jaccard": f"SELECT a, b, round(1 - len(list_intersect(u, v)) / len(list_distinct(u || v)), 6) AS distance FROM (SELECT a, b, {WORDS} {PAIRS})",
    "m_dice": f"SELECT a, b, round(1 - 2 * len(list_intersect(u, v)) / (len(u) + len(v)), 6) AS distance FROM (SELECT a, b, {WORDS} {PAIRS})",
    "m_num": "SELECT p_partkey, round(abs(p_size - p_partkey) / (0.5 * 2), 6) AS distance FROM part",
    "m_date": """
        WITH f AS (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY ALL)
        SELECT o_orderkey, abs((day(o_orderdate) - day(f)) + 30 * (month(o_orderdate) - month(f)) + 365 * (year(o_orderdate) - year(f)))::DOUBLE AS distance
        FROM orders JOIN f USING (o_custkey)""",
    "m_datetime": """
        WITH f AS (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY ALL),
        s AS (SELECT o_orderkey, o_orderdate AS a, f AS b FROM orders JOIN f USING (o_custkey)),
        g AS (SELECT *, (day(a) - day(b)) + 30 * (month(a) - month(b)) + 365 * (year(a) - year(b)) AS days FROM s)
        SELECT o_orderkey, abs(days * 86400 + 3600 * (hour(a) - hour(b)) + 60 * (minute(a) - minute(b)) + second(a) - second(b))::DOUBLE AS distance FROM g""",
    "m_wgs84": r"""
        WITH v AS (SELECT row_id, min(x) AS v FROM (SELECT row_id, unnest(value_set) AS x FROM path_values WHERE prop_path = 'wgs:geometry') WHERE x IS NOT NULL GROUP BY ALL),
        p AS (SELECT row_id, v, string_split(trim(regexp_replace(v, '[^0-9.+ -]', '', 'g')), ' ') AS s FROM v),
        c AS (SELECT row_id, CASE WHEN len(s) = 2 THEN try_cast(s[CASE WHEN starts_with(v, 'POINT') THEN 2 ELSE 1 END] AS DOUBLE) END AS lat,
              CASE WHEN len(s) = 2 THEN try_cast(s[CASE WHEN starts_with(v, 'POINT') THEN 1 ELSE 2 END] AS DOUBLE) END AS lon FROM p)
        SELECT row_id, round(degrees(acos(least(greatest(sin(radians(lat)) * sin(radians(52.5006)) + cos(radians(lat)) * cos(radians(52.5006)) * cos(radians(lon - 13.3989)), -1), 1))) * 60 * 1.1515 * 1.609344, 4) AS distance
        FROM c""",
}


def _common(a, b):
    """SQL of the letters of a that b has near the same place, each letter of b used once: a fold over the letters of a."""
    w = f"CAST(ceil(least(length({a}), length({b})) / 2.0) AS BIGINT)"
    first = f"[{{'rest': {b}, 'out': '', 'c': '', 'i': 0::BIGINT}}]"
    letters = f"list_transform(range(1, length({a}) + 1), lambda i: {{'rest': '', 'out': '', 'c': substr({a}, i, 1), 'i': i}})"
    low, high = f"greatest(1, x.i - {w})", f"least(x.i + {w}, length({b}))"
    at = f"CASE WHEN {high} >= {low} THEN strpos(substr(acc.rest, {low}, {high} - {low} + 1), x.c) ELSE 0 END"
    used = f"{low} + {at} - 1"
    step = f"CASE WHEN {at} = 0 THEN {{'rest': acc.rest, 'out': acc.out, 'c': '', 'i': 0::BIGINT}} ELSE {{'rest': substr(acc.rest, 1, {used} - 1) || chr(1) || substr(acc.rest, {used} + 1), 'out': acc.out || x.c, 'c': '', 'i': 0::BIGINT}} END"
    return f"(list_reduce(list_concat({first}, {letters}), lambda acc, x: {step})).out"


JARO = f"""
    SELECT a, b, CASE WHEN one = '' OR two = '' THEN 1.0 ELSE 1 - (length(one) / length(a) + length(two) / length(b)
        + (length(one) - len(list_filter(range(1, least(length(one), length(two)) + 1), lambda k: substr(one, k, 1) <> substr(two, k, 1))) // 2) / length(one)) / 3 END AS d
    FROM (SELECT a, b, {_common("a", "b")} AS one, {_common("b", "a")} AS two {PAIRS})"""
SQL |= {
    "m_jaro": f"SELECT a, b, round(d, 6) AS distance FROM ({JARO})",
    "m_jaro_winkler": f"""
        SELECT a, b, round(d - 0.1 * d * CASE WHEN a[:4] = b[:4] THEN least(4, length(a), length(b)) WHEN a[:3] = b[:3] THEN 3 WHEN a[:2] = b[:2] THEN 2 WHEN a[:1] = b[:1] THEN 1 ELSE 0 END, 6) AS distance
        FROM ({JARO})""",
}

def _agg(function, weights=(1, 1), missing=False, **params):
    """An aggregator over two confidences made of the customers' balance and number; null where the second is missing."""

    def run(spark, d):
        c = _t(spark, d, "customer")
        a, b = F.col("c_acctbal") / 10000.0, (F.col("c_custkey") % 21 - 10) / 10.0
        b = F.when(F.col("c_custkey") % 5 != 0, b) if missing else b
        values = [(weights[0], a), (weights[1], F.coalesce(b, F.lit(-1.0)))]
        out = lookup("aggregator", function)(**params).evaluate(values)
        if missing == "required":
            out = F.when(b.isNotNull(), out)
        return c.select("c_custkey", F.round(F.when(~F.isnan(out), out), 9).alias("confidence"))

    return run


AB = "SELECT c_custkey, c_acctbal / 10000.0 AS a, (c_custkey % 21 - 10) / 10.0 AS b FROM customer"
MISSING = f"SELECT c_custkey, a, CASE WHEN c_custkey % 5 <> 0 THEN b END AS b FROM ({AB})"


def _average(w1, w2, source, b="b"):
    k = lambda v, w: f"(CASE WHEN {v} > 0 THEN {9 * w} WHEN {v} < 0 THEN {10 * w} ELSE 0 END)"
    return f"SELECT c_custkey, round(({k('a', w1)} * a + {k('b', w2)} * b) / nullif({k('a', w1)} + {k('b', w2)}, 0), 9) AS confidence FROM (SELECT c_custkey, a, {b} AS b FROM ({source}))"


def _nested(spark, d):
    c = _t(spark, d, "customer")
    a, b = F.col("c_acctbal") / 10000.0, (F.col("c_custkey") % 21 - 10) / 10.0
    inner = lookup("aggregator", "min")().evaluate([(1, a), (1, b)])
    return c.select("c_custkey", F.round(lookup("aggregator", "max")().evaluate([(1, inner), (1, b * F.lit(0.5))]), 9).alias("confidence"))


QUERIES |= {
    "agg_average": _agg("average"),
    "agg_weights": _agg("average", (3, 2)),
    "agg_max": _agg("max"),
    "agg_min": _agg("min"),
    "agg_quadratic_mean": _agg("quadraticMean", (1, 2)),
    "agg_geometric_mean": _agg("geometricMean", (1, 2)),
    "agg_missing": _agg("average", missing=True),
    "agg_required_missing": _agg("average", missing="required"),
    "agg_nested": _nested,
}
SQL |= {
    "agg_average": _average(1, 1, AB),
    "agg_weights": _average(3, 2, AB),
    "agg_max": f"SELECT c_custkey, round(greatest(a, b), 9) AS confidence FROM ({AB})",
    "agg_min": f"SELECT c_custkey, round(least(a, b), 9) AS confidence FROM ({AB})",
    "agg_quadratic_mean": f"SELECT c_custkey, round(sqrt((a * a + 2 * b * b) / 3), 9) AS confidence FROM ({AB})",
    "agg_geometric_mean": f"SELECT c_custkey, CASE WHEN a * b * b >= 0 THEN round(pow(a * b * b, 1.0 / 3), 9) END AS confidence FROM ({AB})",
    "agg_missing": _average(1, 1, MISSING, "coalesce(b, -1.0)"),
    "agg_required_missing": f"SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN confidence END AS confidence FROM ({_average(1, 1, AB)})",
    "agg_nested": f"SELECT c_custkey, round(greatest(least(a, b), b * 0.5), 9) AS confidence FROM ({AB})",
}
