"""Blocking keys that stay selective, joins on uneven keys, readers that don't lose lines, entities by URI."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from linkweave import cluster
from linkweave import evaluation as ev
from linkweave.operators import metrics
from linkweave.plans.engine import table_entities
from linkweave.registry import lookup
from linkweave.sources import readers


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_deletion_keys_miss_no_near_pair(spark, tau, monkeypatch):
    monkeypatch.setattr(metrics, "DELETE_UP_TO", {1: 6, 2: 5, 3: 4})
    rng = random.Random(tau)
    # also lengths on both sides of the bound, where keys change their kind
    words = sorted({"".join(rng.choice("ab0") for _ in range(rng.randrange(0, 9))) for _ in range(70)})
    source, target = metrics.Levenshtein().keys(float(tau), float(tau) + 1)
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", source(F.col("w")).alias("s"), target(F.col("w")).alias("t"))
    rows = [r for r in df.collect() if r["w"] is not None or r["s"] == r["t"] == []]
    assert len(rows) == len(words) + 1
    keys = {r["w"]: (set(r["s"]), set(r["t"])) for r in rows if r["w"] is not None}
    for a, b in itertools.product(words, words):
        if distance(a, b) <= tau:
            assert keys[a][0] & keys[b][1], (a, b)


def test_padded_numbers_block_well(spark):
    df = spark.createDataFrame([(f"{k * 7919 % 100_000:09d}",) for k in range(400)], "w string")
    source, target = metrics.Levenshtein().keys(2.0, 3.0)
    left = df.select(F.col("w").alias("a"), F.explode(source(F.col("w"))).alias("k"))
    right = df.select(F.col("w").alias("b"), F.explode(target(F.col("w"))).alias("k"))
    assert left.join(right, "k").select("a", "b").distinct().count() < 0.25 * 400 * 400


def test_join_on_uneven_keys(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HOT_LEAST", 50)
    monkeypatch.setattr(cluster.hot_keys, "__defaults__", (50,))
    left = spark.createDataFrame([("hot", k) for k in range(300)] + [(f"k{k}", k) for k in range(40)] + [(None, 1)], "key string, x int")
    right = spark.createDataFrame([("hot", k) for k in range(200)] + [(f"k{k}", k) for k in range(20)] + [(None, 2)], "key string, y int")
    assert cluster.hot_keys(left, "key") == ["hot"]
    got = sorted(map(tuple, cluster.skew_safe_join(left, right, "key").select("key", "x", "y").collect()))
    assert got == sorted([("hot", a, b) for a in range(300) for b in range(200)] + [(f"k{k}", k, k) for k in range(20)])
    assert cluster.skew_safe_join(left.limit(0), right, "key").count() == 0


def test_lines_that_cannot_be_read(spark):
    good = [r'<a:s> <a:p> "smile \U0001F600 and é and \U000000E9 \"q\" \\U" .', "# note", "", "  "]
    read = lambda lines, **kw: readers.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), **kw)
    assert [r["o"] for r in read(good).collect()] == ['smile \U0001f600 and é and é "q" \\U']
    with pytest.raises(Exception, match="no N-Triples line: <a:s> oops"):
        read([*good, "<a:s> oops"]).collect()
    assert read([*good, "<a:s> oops"], on_error="skip").count() == 1
    assert lookup("source", "rdf")(input="<a:s> <a:p> <a:o> .", format="NT")(spark).count() == 1


def test_first_entity_of_a_uri(spark):
    df = spark.createDataFrame([("u", "2", "b"), ("u", "1", "z"), ("u", "1", "z"), ("u", "1", "c"), ("v", None, None), (None, "1", "x")], "uri string, n string, t string")
    e = table_entities(df, "uri", {"?a/n": "n", "?a/t": "t"})
    rows = sorted((r["uri"], r[e.columns["?a/n"]], r[e.columns["?a/t"]]) for r in ev.first_by_uri(e, [e.columns["?a/n"]]).df.collect())
    assert rows == [("u", "1", "c"), ("v", None, None)]


def test_reference_entities_are_cached(spark, tmp_path):
    a = table_entities(spark.createDataFrame([("a1", "x"), ("a2", "y")], "u string, v string"), "u", {"?a/v": "v"})
    b = table_entities(spark.createDataFrame([("b1", "x"), ("b2", "y")], "u string, v string"), "u", {"?b/v": "v"})
    pairs = spark.createDataFrame([("a1", "b2"), ("a1", "gone")], "source_uri string, target_uri string")
    source, target = ev.cache_reference_entities(a, b, pairs, f"file://{tmp_path}")
    assert [r["uri"] for r in source.df.collect()] == ["a1"] and [r["uri"] for r in target.df.collect()] == ["b2"]
    assert source.columns == a.columns


def test_stream_state_is_compacted(spark, tmp_path):
    from linkweave.plans.rules import Compare, Dataset, LinkRule, PathInput
    from linkweave.streaming.matcher import StreamMatcher

    rule = LinkRule("r", Dataset("left", "a"), Dataset("right", "b"), Compare("equality", PathInput("?a/v"), PathInput("?b/v"), 0.5))
    known = table_entities(spark.createDataFrame([("k", "x")], "u string, v string"), "u", {"?b/v": "v"})
    m = StreamMatcher(spark, [rule], {"r": known}, None, None, f"file://{tmp_path}")
    for batch, uris in ((0, "ab"), (1, "bc"), (2, "d"), (3, "e")):
        rows = spark.createDataFrame([(u, u.upper()) for u in uris], "uri string, v string").withColumnRenamed("v", known.columns["?b/v"])
        rows.write.parquet(f"file://{tmp_path}/added/r/batch={batch}")
    state = lambda before=None: sorted(r["uri"] for r in m.targets(rule, before).df.collect())
    assert state() == list("abcdek") and state(3) == list("abcdk")
    m.compact(2)
    assert state() == list("abcdek") and state(2) == list("abck") and sorted(p.name for p in (tmp_path / "added/r").glob("batch*")) == ["batch=-2", "batch=2", "batch=3"]
    m.compact(4)
    assert state() == list("abcdek") and [p.name for p in (tmp_path / "added/r").glob("batch*")] == ["batch=-4"]
