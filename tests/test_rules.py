"""Rules: blocked joins against all pairs, a plain evaluator, limits, XML."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from linkweave.plans import engine as en
from linkweave.plans import xml_io
from linkweave.plans.compiler import Compiler
from linkweave.plans.rules import Aggregate, Compare, Dataset, Filter, LinkRule, Output, PathInput, TransformInput

A, B = (lambda n: PathInput(f"?a/{n}")), (lambda n: PathInput(f"?b/{n}"))


def rule(condition, **kw):
    blocking = kw.pop("blocking", True)
    return LinkRule("r", Dataset("x", "a"), Dataset("y", "b"), condition, Filter(**kw), blocking=blocking)


def entities(spark, side, rows):
    df = spark.createDataFrame(rows, "uri string, name string, number string, tags array<string>")
    return en.table_entities(df, "uri", {f"?{side}/{c}": c for c in ("name", "number", "tags")})


def data(spark, seed=1, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    make = lambda p: [(f"{p}{k}", rng.choice([None, word(), word()]), rng.choice([None, "x", str(rng.randrange(20)), str(rng.uniform(0, 9))]), rng.choice([None, [], [word()], [word(), word(), None]])) for k in range(n)]
    return entities(spark, "a", make("s")), entities(spark, "b", make("t"))


NAME = Compare("levenshteinDistance", A("name"), B("name"), 2.0)
NORM = Compare("levenshtein", A("name"), B("name"), 0.5)
SAME = Compare("equality", A("name"), B("name"), 0.5)
NUM = Compare("num", A("number"), B("number"), 1.5)
TAGS = Compare("jaccard", A("tags"), B("tags"), 0.8)
ANY_TAG = Compare("equality", TransformInput("lowerCase", (A("tags"),)), TransformInput("lowerCase", (B("tags"),)), 0.5, required=True)
GRAMS = Compare("qGrams", A("name"), B("name"), 0.7)
RULES = [
    NAME, NORM, SAME, NUM, TAGS, GRAMS, Aggregate("min", (NAME, NUM)), Aggregate("min", (ANY_TAG, NORM)), Aggregate("max", (NAME, NUM, TAGS)), Aggregate("max", (SAME, Aggregate("min", (NUM, ANY_TAG)))),
    Aggregate("average", (NAME, NUM)), Aggregate("average", (Compare("levenshteinDistance", A("name"), B("name"), 1.0, weight=5), NUM)), Aggregate("average", (SAME, NORM), params={"positiveWeight": "2", "negativeWeight": "5"}),
    Aggregate("quadraticMean", (NAME, NUM)), Aggregate("geometricMean", (SAME, NUM)), Compare("levenshteinDistance", B("name"), A("name"), 1.0),
]


@pytest.mark.parametrize("condition", RULES, ids=range(len(RULES)))
def test_blocked_equals_all_pairs(spark, condition):
    s, t = data(spark, 7)
    rows = lambda blocking: sorted((r["source_uri"], r["target_uri"], round(r["confidence"], 9)) for r in en.LinkJob(rule(condition, blocking=blocking), s, t).all_links().collect())
    assert rows(True) == rows(False)


def test_keys_exist_where_they_should(spark):
    s, t = data(spark)
    for c, has in ((NAME, True), (Aggregate("quadraticMean", (NAME, NUM)), False), (Compare("jaro", A("name"), B("name"), 0.3), False), (Compare("equality", A("name"), B("name"), 1.0), False), (Aggregate("average", (NAME, NUM)), True)):
        assert (en.LinkJob(rule(c), s, t).compiler.keys() is not None) == has


def plain(node, x, y, limit=0.0):
    """The rule over two dicts of sets, written down directly; None where it can't be computed."""
    if isinstance(node, Compare):
        get = lambda i: {v for v in (x if i.path.startswith("?a") else y)[i.path[3:]] or [] if v is not None}
        u, v = get(node.source), get(node.target)
        if not u or not v:
            return None
        t = node.threshold

        def d(p, q):
            if node.metric == "equality":
                return float(p != q)
            if node.metric == "num":
                try:
                    return abs(float(p) - float(q)) / (t * (1 - limit))
                except ValueError:
                    return math.inf
            if abs(len(p) - len(q)) >= t * (1 - limit):
                return math.inf
            row = list(range(len(q) + 1))
            for i, c in enumerate(p, 1):
                row, last = [i], row
                for j, e in enumerate(q, 1):
                    row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != e)))
            return row[-1]

        return max(1 - min(d(p, q) for p in u for q in v) / t, -1)
    total = sum(c.weight for c in node.children)
    values = []
    for c in node.children:
        lim = 1 - (1 - limit) / (c.weight / total) + 0.9 if node.function == "average" else limit
        v = plain(c, x, y, lim)
        if v is None and c.required:
            return None
        values.append((c.weight, -1.0 if v is None else v))
    if node.function in ("min", "max"):
        return {"min": min, "max": max}[node.function](v for _, v in values)
    k = [(w * (9 if v > 0 else 10 if v < 0 else 0), v) for w, v in values]
    return sum(f * v for f, v in k) / sum(f for f, _ in k) if any(f for f, _ in k) else math.nan


@pytest.mark.parametrize("condition", [NAME, SAME, Aggregate("min", (NAME, NUM)), Aggregate("max", (SAME, NUM)), Aggregate("average", (NAME, NUM)), Aggregate("average", (Aggregate("max", (SAME, NAME), required=True), NUM))], ids=range(6))
def test_against_plain_evaluation(spark, condition):
    s, t = data(spark, 9)
    read = lambda e: {r["uri"]: {p[3:]: (r[c] if isinstance(r[c], list) else None if r[c] is None else [r[c]]) for p, c in e.columns.items()} for r in e.df.collect()}
    xs, ys = read(s), read(t)
    want = {}
    for (a, x), (b, y) in itertools.product(xs.items(), ys.items()):
        v = plain(condition, x, y)
        if v is not None and v >= 0:
            want[a, b] = round(v, 9)
    got = {(r["source_uri"], r["target_uri"]): round(r["confidence"], 9) for r in en.LinkJob(rule(condition), s, t).all_links().collect()}
    assert got == want and want


def test_limit_and_ties(spark):
    links = spark.createDataFrame([("a", "z", 0.5), ("a", "y", 0.5), ("a", "x", 0.4), ("a", "x", 0.1), ("b", "q", 1.0)], "source_uri string, target_uri string, confidence double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(en.limit_links(links, 1)) == [("a", "y", 0.5), ("b", "q", 1.0)]
    assert rows(en.limit_links(links, None)) == [("a", "x", 0.4), ("a", "y", 0.5), ("a", "z", 0.5), ("b", "q", 1.0)]
    assert rows(en.limit_links(links.limit(0), 3)) == []
    assert rows(en.window(links, 0.4, 1.0)) == [("a", "x", 0.4), ("a", "y", 0.5), ("a", "z", 0.5)]
    assert [r["target_uri"] for r in en.sorted_page(links, 1, 2).collect()] == ["z", "x"]
    assert rows(en.containing(links, "Q")) == [("b", "q", 1.0)]


def test_self_join_has_no_mirrored_pair(spark):
    s, _ = data(spark, 3)
    t = en.Entities(s.df, {p.replace("?a", "?b"): c for p, c in s.columns.items()})
    pairs = {(r["source_uri"], r["target_uri"]) for r in en.LinkJob(rule(NAME), s, t).all_links(self_join=True).collect()}
    assert pairs and all(a < b for a, b in pairs)


def test_required_detailed_and_empty(spark):
    s = entities(spark, "a", [("s1", "ab", None, None), ("s2", None, None, None), (None, "ab", None, None)])
    t = entities(spark, "b", [("t1", "ab", None, None)])
    both = Aggregate("max", (Compare("levenshteinDistance", A("name"), B("name"), 2.0, required=True), NUM))
    assert [(r["source_uri"], r["confidence"]) for r in en.LinkJob(rule(both), s, t).all_links().collect()] == [("s1", 1.0)]
    detailed = en.LinkJob(rule(both), s, t).explained().collect()
    assert {r["source_uri"]: r["confidence"] for r in detailed} == {"s1": 1.0, "s2": 0.0}
    assert [d["function"] for d in detailed[0]["details"]] == ["max", "levenshteinDistance", "num"]
    assert en.LinkJob(rule(None), s, t).all_links().count() == 0
    assert en.LinkJob(rule(NAME), en.Entities(s.df.limit(0), s.columns), t).links().count() == 0


def test_threshold_zero_links_nothing_exactly_equal(spark):
    # a distance of 0 over a threshold of 0 is no number, which is no link
    s, t = entities(spark, "a", [("s", "ab", None, None)]), entities(spark, "b", [("t", "ab", None, None)])
    assert en.LinkJob(rule(Compare("equality", A("name"), B("name"))), s, t).all_links().count() == 0


def test_default_threshold_comes_from_the_filter(spark):
    s, t = entities(spark, "a", [("s", "abcdefghij", None, None)]), entities(spark, "b", [("t", "abcdefghix", None, None)])
    got = en.LinkJob(rule(Compare("levenshtein", A("name"), B("name")), threshold=0.8), s, t).all_links().first()
    assert got["confidence"] == pytest.approx(0.5)
    assert en.LinkJob(rule(Compare("levenshtein", A("name"), B("name")), threshold=0.8), s, t).all_links("filter").count() == 0


CONFIG = """<Config>
  <Prefixes><Prefix id="rdfs" namespace="http://www.w3.org/2000/01/rdf-schema#"/><Prefix id="ex" namespace="http://ex.example/"/><Prefix id="owl" namespace="http://www.w3.org/2002/07/owl#"/></Prefixes>
  <DataSources>
    <DataSource id="left" type="rdf"><Param name="format" value="TURTLE"/><Param name="input" value="@prefix ex: &lt;http://ex.example/&gt; . @prefix rdfs: &lt;http://www.w3.org/2000/01/rdf-schema#&gt; . ex:a a ex:City ; rdfs:label 'Bonn'@de, 'Bonn City'@en . ex:b a ex:Town ; rdfs:label 'Ulm' ."/></DataSource>
    <DataSource id="right" type="rdf"><Param name="format" value="N-TRIPLE"/><Param name="input" value='&lt;http://ex.example/x&gt; &lt;http://www.w3.org/2000/01/rdf-schema#label&gt; "BONN" .'/></DataSource>
  </DataSources>
  <Interlinks><Interlink id="cities">
    <LinkType>owl:sameAs</LinkType>
    <SourceDataset dataSource="left" var="a"><RestrictTo>?a a ex:City</RestrictTo></SourceDataset>
    <TargetDataset dataSource="right" var="b"/>
    <LinkCondition><Aggregate type="max"><Compare metric="levenshteinDistance" threshold="2.0" required="true" weight="2">
      <TransformInput function="lowerCase"><Input path="?a/rdfs:label[@lang = 'de']"/></TransformInput>
      <TransformInput function="lowerCase"><Input path="?b/rdfs:label"/></TransformInput></Compare></Aggregate></LinkCondition>
    <Filter threshold="0.9" limit="1"/>
    <Outputs><Output type="memory" minConfidence="0.5"><Param name="name" value="kept"/></Output></Outputs>
  </Interlink></Interlinks>
</Config>"""


def test_configuration_runs_and_round_trips(spark):
    c = xml_io.read_configuration(CONFIG)
    r = c.rules[0]
    assert r.filter == Filter(0.9, 1) and r.blocking and r.outputs == (Output("memory", {"name": "kept"}, 0.5, None),)
    ((_, job),) = xml_io.rule_jobs(spark, c)
    links = job.links()
    assert [tuple(x) for x in links.collect()] == [("http://ex.example/a", "http://ex.example/x", 1.0)]
    assert job.write(links, c.outputs_of(r)) == ["memory"] and spark.table("kept").count() == 1
    again = xml_io.read_configuration(xml_io.write_configuration(c))
    assert again.rules == c.rules and again.sources == c.sources and again.merge(c).sources == c.sources


@pytest.mark.parametrize("bad", ["<Config><Nonsense/></Config>", '<Interlink id="i"><LinkType>owl:x</LinkType></Interlink>', CONFIG.replace('metric="levenshteinDistance"', 'metric="nope"'), CONFIG.replace("owl:sameAs", "foo:bar"), CONFIG.replace('required="true"', 'required="perhaps"')])
def test_bad_configurations(bad):
    with pytest.raises((ValueError, KeyError)):
        xml_io.read_configuration(bad)


def test_inputs_become_columns_of_their_side(spark):
    s, t = data(spark)
    job = en.LinkJob(rule(Compare("equality", TransformInput("lowerCase", (A("name"),)), TransformInput("lowerCase", (B("name"),)), 0.5)), s, t)
    assert isinstance(job.compiler, Compiler) and any(c.startswith("s_i") for c in job.source.columns)
    plan = job.all_links()._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert job.candidates().where(F.lit(False)).count() == 0


def linked(df):
    return sorted((r["source_uri"], r["target_uri"], round(r["confidence"], 9)) for r in df.collect())


@pytest.mark.parametrize("condition", [NAME, Aggregate("min", (Compare("equality", A("number"), B("number"), 0.5, required=True), NAME)), Aggregate("average", (NAME, NUM)), TAGS], ids=range(4))
def test_keys_of_a_filter_threshold_miss_nothing(spark, condition):
    """the keys follow the filter's threshold, and edits stay whole numbers where 1 minus the threshold isn't one."""
    s, t = data(spark, 5)
    for least in (0.5, 0.6, 1.0):
        every = [x for x in linked(en.LinkJob(rule(condition, blocking=False), s, t).all_links()) if x[2] >= least]
        assert linked(en.LinkJob(rule(condition, threshold=least), s, t).all_links("filter")) == every
    near = entities(spark, "a", [("s", "abcdefghij", None, None)]), entities(spark, "b", [("t", "abcdefghix", None, None)])
    assert len(linked(en.LinkJob(rule(Compare("levenshteinDistance", A("name"), B("name"), 10.0), threshold=0.9), *near).all_links("filter"))) == 1
    job = en.LinkJob(rule(NAME), s, t)
    few, all_ = (job.target.select(F.size(job.compiler.keys(m)[1]).alias("n")).agg(F.sum("n")).first()[0] for m in (0.5, 0.0))
    assert few < all_


def test_sketches_rule_out_no_near_texts(spark):
    """texts within a distance have sketches that say so."""
    from linkweave.operators.metrics import Levenshtein

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aabcqé0123") for _ in range(rng.randrange(0, 9)))
    df = spark.createDataFrame([(word(), word()) for _ in range(3000)] + [("aaaaaaaa", "a"), ("", "")], "x string, y string")
    m = Levenshtein()
    told = df.select(F.levenshtein("x", "y").alias("d"), *[m.near(m.sketch(F.col("x")), m.sketch(F.col("y")), k).alias(f"n{k}") for k in (0, 1, 3)]).collect()
    assert all(r[f"n{k}"] for r in told for k in (0, 1, 3) if r["d"] <= k) and not all(r["n1"] for r in told)
