"""Groups of matches and the best links, against plain versions."""

import math
import random

from pyspark.sql import functions as F

from linkweave.llm.components import connected_components, sameas_edges
from linkweave.llm.topk import best_links, top_n_per_group


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


def components(spark, pairs):
    df = spark.createDataFrame(pairs, "source string, node string").withColumn("label", F.lit("other"))
    return {r["node"]: r["label"] for r in connected_components(df, "source", "node").collect()}


def test_components_random_chains_and_stars(spark):
    rng = random.Random(3)
    name = lambda k: f"n{k:04d}é" if k % 7 else f"N{k}"
    chain = list(range(150))
    rng.shuffle(chain)
    pairs = [(name(a), name(b)) for a, b in zip(chain, chain[1:], strict=False)]
    pairs += [("hub", f"leaf{k}") if k % 2 else (f"leaf{k}", "hub") for k in range(200)]
    pairs += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(50)]
    pairs += [("self", "self"), (None, "x"), ("x", None), pairs[0], pairs[0][::-1]]
    got, want = components(spark, pairs), union_find(pairs)
    assert got == want and "self" not in got and "x" not in got


def test_components_of_nothing(spark):
    assert components(spark, []) == {}
    assert components(spark, [("a", "a"), (None, None)]) == {}


def test_edges_follow_threshold_and_type(spark):
    align = spark.createDataFrame([("a", "b", True), ("c", "d", False), ("e", "f", None)], "source_uri string, target_uri string, positive boolean")
    links = spark.createDataFrame([("s", "g", "h", 0.9), ("s", "i", "j", 0.7), ("s", "k", "l", float("nan")), ("s", "m", "n", None), ("r", "o", "p", 1.0), ("u", "q", "r", 1.0), ("u", "t", "u", 0.99)], "interlink_id string, source_uri string, target_uri string, confidence double")
    filters = spark.createDataFrame([("s", "owl:sameAs", 0.8), ("r", "skos:related", 0.1), ("u", "owl:sameAs", None)], "interlink_id string, link_type string, filter_threshold double")
    assert sorted(map(tuple, sameas_edges(align, links, filters).collect())) == [("a", "b"), ("g", "h"), ("q", "r")]


FILTERS = "interlink_id string, filter_threshold double, link_limit int"


def plain_best(links, filters):
    best = {}
    for i, s, t, c in links:
        th, n = next(((th, n) for f, th, n in filters if f == i), (None, None))
        if n is None or s is None or t is None or c is None or math.isnan(c) or c < (1.0 if th is None else th):
            continue
        best[i, s, t] = max(c, best.get((i, s, t), -9))
    out = set()
    for i, s in {k[:2] for k in best}:
        n = next(n for f, _, n in filters if f == i)
        ranked = sorted((-c, t) for (j, u, t), c in best.items() if (j, u) == (i, s))
        out |= {(i, s, t) for _, t in ranked[:n]}
    return out


def test_best_links(spark):
    rng = random.Random(4)
    filters = [("a", 0.2, 3), ("b", None, 2), ("c", 0.0, None), ("d", -1.0, 1)]
    conf = lambda: rng.choice([None, float("nan"), 1.0, round(rng.uniform(-1, 1), 1), rng.uniform(-1, 1)])
    links = [(rng.choice("abcde"), rng.choice(["hot", "hot", "hot", f"s{rng.randrange(30)}", None]), rng.choice([f"t{rng.randrange(400)}", f"é{rng.randrange(9)}", None]), conf()) for _ in range(4000)]
    df = spark.createDataFrame(links, "interlink_id string, source_uri string, target_uri string, confidence double").withColumn("link_limit", F.lit(99)).withColumn("rank", F.lit(0))
    got = best_links(df, spark.createDataFrame(filters, FILTERS))
    assert {tuple(r)[:3] for r in got.collect()} == plain_best(links, filters)
    assert got.count() == len(plain_best(links, filters))
    assert best_links(df.limit(0), spark.createDataFrame(filters, FILTERS)).count() == 0
    assert best_links(df, spark.createDataFrame([], FILTERS)).count() == 0


def test_histogram_keeps_ties_at_the_edge(spark):
    rows = [("g", f"i{k:03d}", 0.5, 10) for k in range(500)] + [("g", "top", 0.9, 10), ("h", "only", -1.0, 10)]
    df = spark.createDataFrame(rows, "g string, i string, s double, n int")
    got = [r["i"] for r in top_n_per_group(df, ["g"], "i", "s", "n", 10, -1.0, 1.0).where("g = 'g'").orderBy("rank").collect()]
    assert got == ["top"] + [f"i{k:03d}" for k in range(9)]


def test_every_group_above_its_limit_is_cut(spark):
    # hot and ordinary groups, null groups, ties across the cut
    rows = [("i", f"s{k % 7}" if k % 3 else "hot", f"t{k:04d}", (k * 37 % 101) / 101, 3) for k in range(900)] + [("i", None, f"t{k}", 0.5, 3) for k in range(9)]
    df = spark.createDataFrame(rows, "g string, s string, item string, score double, n int")
    got = sorted((r["s"] or "", r["rank"], r["item"]) for r in top_n_per_group(df, ["g", "s"], "item", "score", "n", 3, -1.0, 1.0).collect())
    groups = {}
    for g, s, item, score, n in rows:
        groups.setdefault(s or "", []).append((-score, item))
    assert got == sorted((s, k + 1, item) for s, v in groups.items() for k, (_, item) in enumerate(sorted(v)[:3]))
