"""Sinks, reference links, quality, streams, uneven keys, and the entry points."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkweave import evaluation as ev
from linkweave.cluster import Scratch, checked_broadcast, hot_keys, measured, skew_safe_lookup
from linkweave.operators import skew
from linkweave.plans import engine as en
from linkweave.plans.rules import Compare, Dataset, Filter, LinkRule, PathInput
from linkweave.registry import lookup
from linkweave.sources import sinks
from linkweave.streaming.matcher import ServerConfig, StreamMatcher

LINKS = "source_uri string, target_uri string, confidence double"
REF = "source_uri string, target_uri string, label boolean"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sinks_and_readers(spark, tmp_path):
    links = spark.createDataFrame([("urn:a", "urn:b&c", 0.5), ("urn:d", "urn:e", 1.0)], LINKS)
    assert rows(sinks.ntriples(links))[0] == ("<urn:a>  <http://www.w3.org/2002/07/owl#sameAs>  <urn:b&c> .",)
    assert rows(sinks.ntriples(links, "urn:p", " "))[0] == ("<urn:a> <urn:p> <urn:b&c> .",)
    for fmt, name in (("ntriples", "o.nt"), ("alignment", "o.xml")):
        lookup("sink", "file")(file=str(tmp_path / name), format=fmt).write(links, sinks.SAME_AS)
    back = sinks.read_alignment(spark, str(tmp_path / "o.xml"))
    assert rows(back) == [("urn:a", "urn:b&c", True, 0.5), ("urn:d", "urn:e", True, 1.0)]
    text = "".join(p.read_text() for p in (tmp_path / "o.xml").glob("part*"))
    assert text.index("<Alignment>") < text.index("<Cell>") < text.index("</Alignment>")
    assert rows(sinks.read_alignment(spark, str(tmp_path / "o.nt"))) == [("urn:a", "urn:b&c", True, 0.0), ("urn:d", "urn:e", True, 0.0)]
    (tmp_path / "d.n3debug").write_text("[0.25]: <urn:a> <urn:p> <urn:b> .\nnonsense\n")
    assert rows(sinks.read_alignment(spark, str(tmp_path / "d.n3debug"))) == [("urn:a", "urn:b", True, 0.25)]
    with pytest.raises(ValueError):
        lookup("sink", "file")(format="csv")


def test_quality(spark):
    scored = spark.createDataFrame([("a", "b", 0.95, True), ("c", "d", 0.5, True), ("e", "f", 0.95, False), ("g", "h", -1.0, False), ("i", "j", None, False), ("k", "l", float("nan"), True), ("m", "n", 1.0, None)], LINKS + ", label boolean")
    c = ev.confusion(scored, 0.9)
    assert c.first().asDict() == {"tp": 1, "tn": 2, "fp": 1, "fn": 2}
    q = ev.quality(c).first()
    assert q["precision"] == 0.5 and q["recall"] == pytest.approx(1 / 3) and q["f_measure"] == pytest.approx(0.4) and q["specificity"] == pytest.approx(2 / 3) and q["mcc"] == pytest.approx(0.0)
    none = ev.quality(ev.confusion(scored.limit(0))).first()
    assert list(none) == [0.0] * 5 and ev.graded_score(scored.limit(0)).first()[0] is None
    p = 1 - ((0.9 - 0.5 / 0.9) ** 2 + (0.9 + 1 / 0.9) ** 2) / 3
    n = 1 - ((0.95 - 0.9) / 0.1) ** 2 / 3
    assert ev.graded_score(scored.where("label is not null"), 0.9).first()[0] == pytest.approx(2 * p * n / (p + n))


def test_reference_links(spark):
    ref = spark.createDataFrame([("a", "b", True), ("c", "d", False), ("x", "y", None)], REF)
    links = spark.createDataFrame([("a", "b", 0.1), ("c", "d", 0.9), ("e", "f", 0.2)], LINKS)
    assert {r["source_uri"]: r["status"] for r in ev.link_status(links, ref).collect()} == {"a": "correct", "c": "incorrect", "e": "undecided"}
    assert rows(ev.decide(ref, links.limit(1), False).where("source_uri = 'a'")) == [("a", "b", False)]
    assert ev.decide(ref, links, None).count() == 1
    pos = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "3"), ("d", "1")], "source_uri string, target_uri string")
    got = rows(ev.with_negatives(pos))
    # d's next is a's own target 1, which d has already
    assert [r for r in got if not r[2]] == [("a", "2", False), ("b", "3", False), ("c", "1", False)] and len([r for r in got if r[2]]) == 4
    assert ev.with_negatives(pos.limit(0)).count() == 0
    assert spark.range(1).select(ev.percent(F.lit(-1.0)), ev.percent(F.lit(1.0))).first() == (0.0, 100.0)


def test_reference_files(spark, tmp_path):
    (tmp_path / "ref.nt").write_text("<urn:a> <urn:p> <urn:1> .\n<urn:b> <urn:p> <urn:2> .\n")
    got = ev.import_reference(spark, str(tmp_path / "ref.nt"))
    assert rows(got) == [("urn:a", "urn:1", True), ("urn:a", "urn:2", False), ("urn:b", "urn:1", False), ("urn:b", "urn:2", True)]
    cell = '<map><Cell><entity1 rdf:resource="urn:{}"/><entity2 rdf:resource="urn:{}"/><relation>{}</relation><measure>1.0</measure></Cell></map>\n'
    (tmp_path / "ref.xml").write_text("<Alignment>" + cell.format("a", 1, "=") + cell.format("b", 2, "=") + cell.format("a", 2, "!=") + "</Alignment>")
    assert ev.import_reference(spark, str(tmp_path / "ref.xml")).count() == 3
    (tmp_path / "links.nt").write_text("<urn:a> <urn:p> <urn:1> .\n<urn:a> <urn:p> <urn:2> .\n<urn:x> <urn:p> <urn:y> .\n")
    r = ev.compare_files(spark, str(tmp_path / "links.nt"), str(tmp_path / "ref.xml")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 0) and r["precision"] == 0.5


def test_stream_in_three_batches(spark, tmp_path):
    rule = LinkRule("r", Dataset("in", "a"), Dataset("known", "b"), Compare("levenshteinDistance", PathInput("?a/name"), PathInput("?b/name"), 2.0), Filter(1.0, 1))
    schema = "id string, name string"
    known = en.table_entities(spark.createDataFrame([("k1", "berlin"), ("k2", "berlim")], schema), "id", {"?b/name": "name"})
    as_source = lambda df, r: en.table_entities(df, "id", {"?a/name": "name"})
    as_target = lambda df, r: en.table_entities(df, "id", {"?b/name": "name"})
    src = tmp_path / "in"
    for k, batch in enumerate(([("n1", "berlin"), ("n2", "paris")], [("n3", "pariz"), ("n4", None)], [("n5", "rome")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(src / f"b{k}"))
    m = StreamMatcher(spark, [rule], {"r": known}, as_source, as_target, str(tmp_path / "state"), ServerConfig(True, True, True))
    for k in range(3):
        m.match(spark.read.parquet(str(src / f"b{k}")), k)
    m.match(spark.read.parquet(str(src / "b1")), 1)  # a batch that is run again
    got = {(r["source_uri"], r["target_uri"]) for r in m.links().collect()}
    assert got == {("n1", "k1"), ("n3", "n2")} and m.links().count() == 2
    assert {r["uri"] for r in m.unknown().collect()} == {"n2", "n4", "n5"}
    assert m.unknown_lines("urn:v:").where(F.col("line") == "<n5>  <urn:v:matchingResult>  <urn:v:UnknownInstance> .").count() == 1
    quiet = StreamMatcher(spark, [rule], {"r": known}, as_source, as_target, str(tmp_path / "quiet"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    assert quiet.links().count() == 0
    quiet.start(stream, str(tmp_path / "check")).awaitTermination()
    # without a limit n1 matches both; nothing was added, so n3 matches nobody
    assert {(r["source_uri"], r["target_uri"]) for r in quiet.links().collect()} == {("n1", "k1"), ("n1", "k2")}


def test_uneven_keys(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, 1, 2]), f"u{rng.randrange(300)}", rng.choice(["x", None])) for _ in range(3000)]
    df = spark.createDataFrame(data, "interlink_id string, block_id int, uri string, restriction_value string").withColumn("__salt_", F.lit(1))
    got = {r[0]: r[1] for r in skew.salted_distinct_count(df, ["interlink_id"], ["block_id", "uri"], "n").collect()}
    want = collections.Counter(k for k, *_ in {d[:3] for d in data})
    assert got == want
    sums = skew.salted_aggregate(df, ["interlink_id"], ["uri"], {"p": F.sum("block_id"), "c": F.count(F.lit(1))}, {"s": F.sum("p"), "n": F.sum("c")})
    assert {r[0]: (r[1], r[2]) for r in sums.collect()} == {k: (sum(d[1] or 0 for d in data if d[0] == k), sum(d[0] == k for d in data)) for k in {d[0] for d in data}}
    entries = {d[:3] for d in data}
    n = collections.Counter(("block", f"{a}#{b}") for a, b, _ in entries if a is not None and b is not None) + collections.Counter(("restriction", r) for r, *_ in {(d[3], *d[:3]) for d in data} if r)
    assert {tuple(r) for r in skew.heavy_keys(df).collect()} == {(*k, c) for k, c in n.items() if c * 100 > 3 * len(entries)}
    assert skew.heavy_keys(df.limit(0)).count() == 0 and skew.salted_distinct_count(df.limit(0), ["interlink_id"], ["uri"], "n").count() == 0


def test_hot_lookup_and_scratch(spark, monkeypatch):
    import linkweave.cluster as cluster

    found = cluster.hot_keys
    monkeypatch.setattr(cluster, "hot_keys", lambda df, key: found(df, key, 100))
    left = spark.createDataFrame([("hot" if k % 2 else f"k{k}", k) for k in range(2000)] + [(None, -1)], "k string, v int")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{k}", 2) for k in range(0, 1500)], "key string, w int")
    assert hot_keys(left, "k", 100) == ["hot"] and hot_keys(left, "k") == []
    for how in ("inner", "left"):
        got = skew_safe_lookup(left, "k", table, "key", how).select("v", "w").collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(left.join(table.withColumnRenamed("key", "k"), "k", how).select("v", "w").rdd.map(tuple).collect())
    s = Scratch(spark, "test")
    t = s.cut(left, most=F.max("v"))
    assert measured(t) == {"rows": 2001, "most": 1999} and measured(left)["rows"] == 2001
    s.drop(t)
    assert "broadcast" in checked_broadcast(table, 5000)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in checked_broadcast(table, 10)._jdf.queryExecution().logical().toString().lower()


def test_entry_points(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80 and "p5_found" in q
    assert any(n.startswith("p1_") for n in q) == (entry._llm() is not None)
    df = entry.entry(spark)
    assert df.columns == ["source_uri", "target_uri", "confidence"] and df.count() == 62


def test_nothing_in_the_core_imports_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "linkweave"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "linkweave.llm" not in f.read_text(), f
