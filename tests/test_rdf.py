"""RDF texts and files, paths, restrictions, path statistics, caches, SPARQL."""

import io
import json

import pytest
from pyspark.sql import functions as F

from linkweave.plans import engine as en
from linkweave.plans import paths as P
from linkweave.registry import lookup
from linkweave.sources import readers, sparql

PRE = {"ex": "http://ex.example/", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
TTL = r'''@prefix ex: <http://ex.example/> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
# a comment
ex:a a ex:City, ex:Place ; rdfs:label "Bonn"@de , "Bonn (City)"@en, 'plain' ; ex:size 12 ; ex:in ex:r ; ex:note """two
lines \"quoted\" é""" .
ex:b a ex:Town ; rdfs:label "Ulm"@en ; ex:in ex:r ; ex:size 2.5 ; ex:open true ; ex:head [ ex:name "X" ] .
ex:r rdfs:label "Rhine"@de .
_:n rdfs:label "nobody" .
'''


def triples(spark):
    return readers.inline_rdf(spark, TTL, "TURTLE").cache()


def values(df):
    return sorted(map(tuple, df.collect()))


def test_turtle(spark):
    rows = {(r["s"].rpartition("/")[2], r["p"].rpartition("/")[2].rpartition("#")[2], r["o"], r["o_kind"], r["o_lang"]) for r in triples(spark).collect()}
    assert ("a", "label", "Bonn", "literal", "de") in rows and ("a", "size", "12", "literal", "") in rows
    assert ("a", "note", 'two\nlines "quoted" é', "literal", "") in rows
    assert ("b", "open", "true", "literal", "") in rows and any(r[1] == "name" and r[2] == "X" for r in rows)
    with pytest.raises(ValueError):
        readers.parse_turtle("ex:a ex:b (1 2) .")


def test_ntriples_file_and_inline(spark, tmp_path):
    text = '<http://e/s> <http://e/p> "a \\"b\\" \\u00e9\\n"@en .\n# no triple\n_:b <http://e/p> <http://e/o> <http://e/g> .\n<http://e/s> <http://e/p> "1"^^<http://e/int> .\nbroken line\n'
    (tmp_path / "x.nt").write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match="no N-Triples line: broken line"):
        lookup("source", "file")(file=str(tmp_path / "x.nt"), format="N-TRIPLE")(spark).collect()
    got = lookup("source", "file")(file=str(tmp_path / "x.nt"), format="N-TRIPLE", onError="skip")(spark)
    assert values(got.select("s", "s_kind", "o", "o_kind", "o_lang", "o_datatype", "g")) == [
        ("_:b", "blank", "http://e/o", "resource", "", "", "http://e/g"), ("http://e/s", "resource", "1", "literal", "", "http://e/int", ""), ("http://e/s", "resource", 'a "b" é\n', "literal", "en", "", "")]
    assert values(readers.inline_rdf(spark, text, "N-TRIPLE", "skip")) == values(got)
    with pytest.raises(ValueError):
        readers.inline_rdf(spark, text, "CSV")


def test_rdf_xml(spark, tmp_path):
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://ex.example/"><ex:City rdf:about="http://ex.example/a" ex:code="7">
      <ex:label xml:lang="de">Bonn</ex:label><ex:in rdf:resource="http://ex.example/r"/><ex:head><rdf:Description><ex:name>X</ex:name></rdf:Description></ex:head></ex:City></rdf:RDF>"""
    (tmp_path / "x.rdf").write_text(xml)
    got = {(r["p"].rpartition("/")[2].rpartition("#")[2], r["o"], r["o_lang"]) for r in lookup("source", "file")(file=str(tmp_path / "x.rdf"), format="RDF/XML")(spark).collect()}
    assert {("type", "http://ex.example/City", ""), ("code", "7", ""), ("label", "Bonn", "de"), ("in", "http://ex.example/r", ""), ("name", "X", "")} <= got


def test_paths(spark):
    t = triples(spark)
    at = lambda text, **kw: [(u.rpartition("/")[2], v) for u, v in values(P.path_values(t, P.parse_path(text, PRE), **kw))]
    assert at("?a/rdfs:label[@lang='de']") == [("a", "Bonn"), ("r", "Rhine")]
    assert at("?a/rdfs:label[ @lang = '' ]") == [("a", "plain")]
    assert at("?a/ex:in/rdfs:label") == [("a", "Rhine"), ("b", "Rhine")]
    assert at("?a\\ex:in") == [("r", "http://ex.example/a"), ("r", "http://ex.example/b")]
    assert at("?a[ex:size >= 3]/rdfs:label[@lang = 'en']") == [("a", "Bonn (City)")]
    assert at("?a/<http://ex.example/size>") == [("a", "12"), ("b", "2.5")]
    assert at("?a[rdf:type = ex:Town]/ex:size") == [("b", "2.5")]
    assert at("?a") == [] and at("?a", itself=True)[0][0] == "a"
    for bad in ("rdfs:label", "?a/nope:x", "?a[rdfs:label ~ 'x']"):
        with pytest.raises(ValueError):
            P.parse_path(bad, PRE)
    assert P.shorten("http://ex.example/x", PRE) == "ex:x" and P.shorten("urn:x", PRE) == "<urn:x>"


def test_restrictions(spark):
    t = triples(spark)
    of = lambda text: [u.rpartition("/")[2] for (u,) in values(P.restricted(t, P.parse_restriction(text, PRE)))]
    assert of("?a rdf:type ex:City .") == ["a"]
    assert of("?a a ex:City . ?a a ex:Place") == ["a"]
    assert of("{ { ?a a ex:City } UNION { ?a a <http://ex.example/Town> . } }") == ["a", "b"]
    assert of('?a rdfs:label "Ulm"@en') == ["b"]
    assert of("?a ex:size ?x") == ["a", "b"]
    assert of("") == ["a", "b", "r"]
    for bad in ("?a rdf:type", "{ ?a a ex:City } AND { ?a a ex:Town }", "?a a nope:City", "{ ?a a ex:City"):
        with pytest.raises(ValueError):
            P.parse_restriction(bad, PRE)
    df = spark.createDataFrame([("x", "1"), ("y", None)], "kind string, size string")
    cond = P.restriction_column(P.parse_restriction('?a ex:kind "x" . ?a ex:size ?s', PRE), {PRE["ex"] + "kind": F.col("kind"), PRE["ex"] + "size": F.col("size")})
    assert df.where(cond).count() == 1


def test_entities_statistics_and_cache(spark, tmp_path):
    t = triples(spark)
    e = P.entities_of(t, None, {p: P.parse_path(p, PRE) for p in ("?a/rdfs:label", "?a/ex:size")})
    rows = {r["uri"].rpartition("/")[2]: (sorted(r["p0"]), r["p1"]) for r in e.df.collect()}
    assert rows["r"] == (["Rhine"], []) and rows["b"] == (["Ulm"], ["2.5"])
    only = P.entities_of(t, None, {}, spark.createDataFrame([("http://ex.example/a",), ("urn:none",)], "uri string"))
    assert only.df.count() == 1
    readers.write_cache(e, str(tmp_path / "cache"))
    back = lookup("source", "cache")(dir=str(tmp_path / "cache"))(spark)
    assert back.columns == e.columns and back.df.count() == 3
    freq = P.frequent_paths(t, backward=3)
    top = freq.where("direction = 'forward'").orderBy(F.desc("frequency")).first()
    assert top["path"].endswith("label") and top["frequency"] == 1.0
    assert P.frequent_paths_sample(t, least=0.5).count() == 4
    assert P.frequent_restrictions(t, 0.6).count() >= 1 and P.frequent_paths(t.limit(0)).count() == 0


def test_table_entities_keep_clashing_names(spark):
    df = spark.createDataFrame([("u", "x", ["a", "a", None]), (None, "y", [])], "uri string, p0 string, p1 array<string>")
    e = en.table_entities(df, "uri", {"?a/one": "p1", "?a/two": "p0"})
    assert e.df.count() == 1 and e.df.first()["p1"] == "x"


def test_sparql_pages_and_retries(monkeypatch):
    rows = [{"s": {"type": "uri", "value": f"urn:{k}"}, "p": {"type": "uri", "value": "urn:p"}, "o": {"type": "literal", "value": str(k), "xml:lang": "en"}} for k in range(5)]
    asked = []

    def answer(request):
        asked.append(request.full_url)
        if len(asked) == 2:
            raise OSError("busy")
        page = int(request.full_url.split("OFFSET+")[1].split("+")[0])
        return io.StringIO(json.dumps({"results": {"bindings": rows[page : page + 2]}}))

    monkeypatch.setattr(sparql.urllib.request, "urlopen", answer)
    reader = sparql.SparqlReader({"endpoint": "http://e.example/sparql", "page_size": "2", "retry_pause_ms": "1", "uris": "urn:1 urn:2", "graph": "urn:g"})
    got = list(reader.read(reader.partitions()[0]))
    assert [r[3] for r in got] == list("01234") and got[0][5] == "en" and len(asked) == 4
    assert "FROM <urn:g>" in reader.query(0) and "VALUES ?s { <urn:1> <urn:2> }" in reader.query(0)
    monkeypatch.setattr(sparql.urllib.request, "urlopen", lambda r: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        sparql.SparqlReader({"endpoint": "http://e.example", "retries": "1", "retry_pause_ms": "1"}).fetch("x")
    assert len(sparql.SparqlReader({"endpoint": "x", "readers": "3"}).partitions()) == 3
