"""Queries of the llm operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_matches(spark, d):
    from linkweave.llm.entities import match_entities

    return match_entities(_t(spark, d, "path_values"))


def p1_found(spark, d):
    return p1_matches(spark, d).select("uri_a", "uri_b")


def p2_found(spark, d):
    from linkweave.llm.components import connected_components, sameas_edges

    edges = sameas_edges(_t(spark, d, "alignment_links"), _t(spark, d, "match_links"), _t(spark, d, "link_filters"))
    return connected_components(edges, "a", "b").select(F.col("node").alias("uri"), F.col("label").alias("group_uri"))


def p3_found(spark, d):
    from linkweave.cluster import Scratch
    from linkweave.llm.lookalike import label_forms, lookalike_pairs

    return lookalike_pairs(Scratch(spark, "forms").cut(label_forms(_t(spark, d, "path_values"))))


def p3_classes(spark, d):
    from linkweave.cluster import Scratch
    from linkweave.llm.lookalike import label_forms, lookalike_classes

    return lookalike_classes(Scratch(spark, "forms").cut(label_forms(_t(spark, d, "path_values"))))


def p3_forms(spark, d):
    from linkweave.llm.lookalike import label_forms

    return label_forms(_t(spark, d, "path_values"))


def p4_repairs(spark, d):
    from linkweave.llm.charsets import garbled_values

    return garbled_values(_t(spark, d, "input_values"))


def p4_found(spark, d):
    return p4_repairs(spark, d).select("value_id").distinct()


def p6_found(spark, d):
    from linkweave.llm.topk import best_links

    return best_links(_t(spark, d, "match_links"), _t(spark, d, "link_filters")).select("interlink_id", "source_uri", "target_uri")


def p7_found(spark, d):
    from linkweave.llm.leakage import find_leaks

    return find_leaks(_t(spark, d, "documents"), _t(spark, d, "benchmark_items"))


#: Words within which all of an item's words must stand in a document, in any order.
NEAR = 200


def p7_near(spark, d):
    from linkweave.llm.leakage import find_leaks

    return find_leaks(_t(spark, d, "documents"), _t(spark, d, "benchmark_items"), window=NEAR)


def p8_found(spark, d):
    return p8_report(spark, d).where("falls_short").select("source")


def p8_report(spark, d):
    from linkweave.llm.mixing import mix_sources

    return mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def p8_repeats(spark, d):
    from linkweave.llm.mixing import mix_sources

    return mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p8_repeats_by_chars(spark, d):
    from linkweave.llm.mixing import mix_sources

    return mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), size="n_chars")[0].select("source", "doc_id", "repeats")


def p9_found(spark, d):
    return p9_pieces(spark, d).where("n_pieces > 1 and piece_no = 0").select("doc_id")


def p9_pieces(spark, d):
    from linkweave.llm.splitting import split_documents

    return split_documents(_t(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p3_found, p3_forms, p3_classes, p4_found, p4_repairs, p6_found, p7_found, p7_near, p8_found, p8_report, p8_repeats, p8_repeats_by_chars, p9_found, p9_pieces)}


def _form(column: str) -> str:
    """The one form of a text in DuckDB, by lists of its own."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    # Wide forms lie at a constant distance; narrow kana, spaces, hyphens and look-alikes stand above what they become.
    wide, plain = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    narrow = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
    kana = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a"
    spaces, hyphens = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", "\u2010\u2011\u2012\u2013\u2212\u02d7\u2043\ufe63"
    alike = "АВЕЅІЈКМНОРСТУХҮԌԚԜӀӏаеѕіјорсухһԁԛԝѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳνЀЁЇѐёїΆΈΊΌΎό"
    latin = "ABESIJKMHOPCTYXYGQWIlaesijopcyxhdqwvABEZHIKMNOPTYXocjvÈËÏèëïÁÉÍÓÝó"
    single = wide + narrow + spaces + hyphens
    text = f"translate({column}, {quoted(single)}, {quoted(plain + kana + ' ' * len(spaces) + '-' * len(hyphens))})"
    for ligature, letters in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}.items():
        text = f"replace({text}, '{ligature}', '{letters}')"
    unseen = r"'[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}\x{034F}\x{061C}\x{180E}]'"
    text = f"nfc_normalize(regexp_replace({text}, {unseen}, '', 'g'))"
    return f"nfc_normalize(translate({text}, {quoted(alike)}, {quoted(latin)}))"


def _sql() -> dict[str, str]:
    forms = f"""
        SELECT row_id, value, {_form("value")} AS form FROM
        (SELECT DISTINCT row_id, unnest(value_set) AS value FROM path_values WHERE prop_path IN ('rdfs:label', 'skos:altLabel'))
        WHERE value IS NOT NULL"""
    return {
        "p2_found": """
            WITH RECURSIVE e AS (
                SELECT source_uri AS a, target_uri AS b FROM alignment_links WHERE positive
                UNION SELECT m.source_uri, m.target_uri FROM match_links m JOIN link_filters f USING (interlink_id)
                WHERE f.link_type = 'owl:sameAs' AND m.confidence IS NOT NULL AND NOT isnan(m.confidence)
                  AND m.confidence >= coalesce(f.filter_threshold, 1.0)),
            s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
            r(a, b) AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
            SELECT a AS uri, least(a, min(b)) AS group_uri FROM r GROUP BY a""",
        "p3_forms": forms,
        "p3_found": f"""
            WITH v AS MATERIALIZED ({forms})
            SELECT DISTINCT a.row_id AS row_id_a, b.row_id AS row_id_b
            FROM v a JOIN v b ON a.form = b.form AND a.row_id < b.row_id AND a.value <> b.value""",
        "p3_classes": f"""
            WITH v AS MATERIALIZED ({forms})
            SELECT form, count(DISTINCT value) AS spellings, count(DISTINCT row_id) AS members FROM v GROUP BY form HAVING count(DISTINCT value) > 1""",
        "p6_found": """
            WITH p AS (
                SELECT m.interlink_id, source_uri, target_uri, max(confidence) AS confidence, max(link_limit) AS n
                FROM match_links m JOIN link_filters f USING (interlink_id)
                WHERE link_limit IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence)
                  AND confidence >= coalesce(filter_threshold, 1.0) GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY interlink_id, source_uri ORDER BY confidence DESC, target_uri) AS k FROM p)
            SELECT interlink_id, source_uri, target_uri FROM r WHERE k <= n""",
        "p7_found": r"""
            WITH dw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS k FROM documents),
            iw AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS k FROM benchmark_items),
            dg AS (SELECT doc_id, string_agg(w, ' ') OVER x AS g, count(*) OVER x AS n FROM dw WINDOW x AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
            ig AS (SELECT item_id, string_agg(w, ' ') OVER x AS g, count(*) OVER x AS n FROM iw WINDOW x AS (PARTITION BY item_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g, n) WHERE n = 12""",
        "p7_near": rf"""
            WITH dw AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), 1) AS k FROM documents),
            iw AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM benchmark_items),
            n AS (SELECT item_id, count(*) AS n FROM iw GROUP BY item_id),
            c AS MATERIALIZED (SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, w FROM dw) JOIN iw USING (w) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) = n),
            p AS MATERIALIZED (SELECT c.doc_id, c.item_id, dw.w, dw.k FROM c JOIN iw ON iw.item_id = c.item_id JOIN dw ON dw.doc_id = c.doc_id AND dw.w = iw.w),
            s AS (SELECT a.doc_id, a.item_id, a.k, count(DISTINCT b.w) AS m FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.k BETWEEN a.k AND a.k + {NEAR - 1} GROUP BY a.doc_id, a.item_id, a.k)
            SELECT DISTINCT s.doc_id, s.item_id FROM s JOIN n USING (item_id) WHERE m = n.n""",
        "p8_repeats_by_chars": """
            WITH d AS (SELECT source, doc_id, coalesce(n_chars, 0) AS size FROM documents WHERE source IN (SELECT source FROM mix_targets)),
            t AS (SELECT sum(size) AS total FROM d),
            s AS (SELECT source, sum(size) AS size, max(max_repeats) AS most, max(target_weight) AS w FROM d JOIN mix_targets USING (source) GROUP BY source),
            r AS (SELECT source, CASE WHEN size > 0 THEN least(most::DOUBLE, w * total / size) ELSE 0 END AS rate,
                  ('0x' || substr(md5('42:' || source), 1, 8))::BIGINT / 4294967296.0 AS o FROM s, t),
            c AS (SELECT source, doc_id, rate, o, sum(rate) OVER (PARTITION BY source ORDER BY size, md5('42:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN r USING (source))
            SELECT source, doc_id, (floor(round(upto + o, 6)) - floor(round(upto - rate + o, 6)))::INT AS repeats FROM c
            WHERE floor(round(upto + o, 6)) > floor(round(upto - rate + o, 6))""",
    }


SQL = _sql()
