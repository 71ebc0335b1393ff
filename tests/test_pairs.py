"""Pairs of entities: equal values compared once, limits, rules put together, the detailed evaluation."""

import pytest
from test_rules import NAME, NUM, A, B, data, entities, linked, rule

from linkweave.plans import engine as en
from linkweave.plans.rules import Aggregate, Compare

FLAG = Aggregate("min", (Compare("equality", A("number"), B("number"), 0.5, required=True), NAME))


def test_pairs_are_not_shuffled(spark):
    """pairs that meet in one key are not put together again; an entity with two values still links once."""
    s = entities(spark, "a", [("s1", None, "1", None), ("s2", None, "1", None), ("s2", None, "2", None), ("s2", None, "2", None)])
    t = entities(spark, "b", [("t1", None, "1", None), ("t2", None, "2", None)])
    same = Compare("equality", A("number"), B("number"), 0.5)
    assert linked(en.LinkJob(rule(same), s, t).all_links()) == [("s1", "t1", 1.0), ("s2", "t1", 1.0), ("s2", "t2", 1.0)]
    once = lambda e: en.Entities(e.df.dropDuplicates(["uri"]), e.columns, True)
    plan = en.LinkJob(rule(same), once(s), once(t)).all_links()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [source_uri" not in plan


@pytest.mark.parametrize("limit", [1, 2])
def test_limit_of_groups(spark, limit):
    """the best targets of equal entities are those of each."""
    s, t = data(spark, 9)
    assert linked(en.LinkJob(rule(NAME, limit=limit), s, t).links()) == linked(en.limit_links(en.LinkJob(rule(NAME), s, t).all_links(), limit))


def test_all_pairs_join_by_what_must_be_equal(spark):
    """with blocking off an equality that a min needs is the join's condition."""
    s, t = data(spark, 3)
    plan = en.LinkJob(rule(FLAG, blocking=False), s, t).all_links()._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_as_one(spark):
    """rules put together find what each finds."""
    s, t = data(spark, 4)
    jobs = [en.LinkJob(rule(c), s, t) for c in (FLAG, NUM)]
    assert linked(en.union_job(*jobs).all_links()) == linked(en.merged(*[j.all_links() for j in jobs]))


def test_detailed_without_all_pairs(spark):
    """the detailed evaluation finds the pairs without values, too, and explains the rest by keys."""
    s, t = data(spark, 6)
    keyed, every = (linked(en.LinkJob(rule(c, blocking=b), s, t).explained()) for c, b in ((FLAG, True), (Aggregate("min", FLAG.children[1:]), True)))
    assert {x[:2] for x in linked(en.LinkJob(rule(FLAG), s, t).all_links())} <= {x[:2] for x in keyed}
    blank = {r["uri"] for r in s.df.where(f"{s.columns['?a/number']} is null").collect()}
    assert blank <= {x[0] for x in keyed} and every
