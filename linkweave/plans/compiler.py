"""Rules to columns: confidences, their details, and blocking keys. Limits and thresholds are folded into constants."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.plans.rules import Aggregate, Compare, Input, LinkRule, Operator, PathInput, TransformInput, paths_of, variable_of
from linkweave.registry import lookup
from linkweave.values import Values

NAN = float("nan")
#: Added to radii of confidences that are no whole numbers, so that rounding loses no pair.
MARGIN = 1e-9


@dataclass(frozen=True)
class Entity:
    """A side of the pairs: the variable of its paths and the Values of each path."""

    variable: str
    values: dict[str, Values]


class Keys(NamedTuple):
    """Arrays of keys of a source and a target entity, by which pairs meet."""

    #: How selective they are; less is better.
    rank: int
    source: Column
    target: Column
    #: Whether a pair shares one key at most.
    once: bool = False
    #: About how many keys an entity has.
    many: int = 1
    #: Fewer, less selective keys of the same pairs.
    coarse: Keys | None = None


class Compiler:
    def __init__(self, rule: LinkRule, source: Entity, target: Entity):
        self.rule, self.sides = rule, (source, target)
        self.ready: list[tuple[Input, str | None, Values]] = []
        self.columns: tuple[dict[str, Column], dict[str, Column]] = ({}, {})
        self.sketched: set[str] = set()
        if rule.condition is not None:
            self._make_ready(rule.condition)

    def _make_ready(self, node: Operator) -> None:
        """Inputs of one entity become columns of its side, before any pair is made, and so does what a measure makes of them."""
        if isinstance(node, Aggregate):
            for c in node.children:
                self._make_ready(c)
            return
        metric = lookup("metric", node.metric)(**node.params)
        for i in (node.source, node.target):
            side = next((k for k, s in enumerate(self.sides) if variables_of(i) == {s.variable}), None)
            if side is None:
                continue
            raw = self._known(i, None)
            if raw is None:
                raw = self.input(i)
                if isinstance(i, TransformInput):
                    raw = self._column(side, raw)
                    self.ready.append((i, None, raw))
            made = metric.prepared(raw)
            if made.prepared and self._known(i, node.metric) is None:
                self.ready.append((i, node.metric, self._column(side, made)))
            if not raw.many and self._known(i, f"{node.metric} sketch") is None and (sketch := metric.sketch(raw.col)) is not None:
                self.ready.append((i, f"{node.metric} sketch", self._column(side, Values(sketch, False, True))))
                self.sketched.add(list(self.columns[side])[-1])

    def _column(self, side: int, v: Values) -> Values:
        name = f"{'st'[side]}_i{len(self.columns[side])}"
        self.columns[side][name] = v.col
        return Values(F.col(name), v.many, v.prepared)

    def _known(self, node: Input, metric: str | None) -> Values | None:
        return next((v for n, m, v in self.ready if m == metric and n == node), None)

    def with_inputs(self, df: DataFrame, side: int) -> DataFrame:
        """A side's entities with the columns of its inputs, in the order in which they build on each other."""
        for name, col in self.columns[side].items():
            df = df.withColumn(name, col)
        return df

    def input(self, node: PathInput | TransformInput) -> Values:
        """The values of an input. A path of an unknown variable has none."""
        if (known := self._known(node, None)) is not None:
            return known
        if isinstance(node, PathInput):
            for side in self.sides:
                if variable_of(node.path) == side.variable:
                    if node.path not in side.values:
                        raise KeyError(f"no values for the path {node.path}")
                    return side.values[node.path]
            return Values(F.array().cast("array<string>"))
        return lookup("transformer", node.function)(**node.params)([self.input(i) for i in node.inputs])

    def distance(self, c: Compare, limit: float = 0.0) -> Column:
        threshold = self.rule.threshold_of(c)
        # confidences end at -1, which a distance of twice the threshold gives
        worst = 2 * threshold if threshold > 0 else 0.0
        a, b = (self._known(i, c.metric) or self.input(i) for i in (c.source, c.target))
        return lookup("metric", c.metric)(**c.params).distance(a, b, threshold * (1.0 - limit), worst)

    def compare(self, c: Compare, limit: float) -> Column:
        """The confidence of a comparison, null where a side has no values; at threshold 0, NaN for equal and -1 for others."""
        threshold = self.rule.threshold_of(c)
        d = self.distance(c, limit)
        # the distance stands once in each, as every further use would compute it again; NaN is above all numbers
        conf = F.greatest(1.0 - d / F.lit(threshold), F.lit(-1.0)) if threshold > 0 else F.when((d > 0) & ~F.isnan(d), F.lit(-1.0)).otherwise(F.lit(NAN))
        return F.when(self.present(c), conf)

    def present(self, node: Operator) -> Column:
        """Whether a node's confidence can be computed: both inputs have values, all required children can be computed."""
        if isinstance(node, Compare):
            return self.input(node.source).present() & self.input(node.target).present()
        return reduce(lambda a, b: a & b, [self.present(c) for c in node.children if c.required], F.lit(bool(node.children)))

    def operator(self, node: Operator, limit: float = 0.0, missing: float = -1.0) -> Column:
        """The confidence of a node; null where it can't be computed. missing stands for children without one."""
        if isinstance(node, Compare):
            return self.compare(node, limit)
        agg = lookup("aggregator", node.function)(**node.params)
        total = sum(c.weight for c in node.children)
        children = [self.operator(c, agg.child_limit(limit, c.weight / total), missing) for c in node.children]
        out = agg.evaluate([(c.weight, F.coalesce(x, F.lit(missing))) for c, x in zip(node.children, children, strict=True)])
        return F.when(self.present(node), out) if any(c.required for c in node.children) else out

    def confidence(self, missing: float = -1.0) -> Column:
        """The confidence of the rule; what can't be computed gives ``missing``: -1, or 0 in the detailed evaluation."""
        if self.rule.condition is None:
            return F.lit(missing)
        return F.coalesce(self.operator(self.rule.condition, 0.0, missing), F.lit(missing))

    def details(self) -> Column:
        """The tree of confidences, flattened: one struct per node with its id, parent, kind, function, value and values."""
        out: list[Column] = []

        def visit(node: Operator, parent: int, limit: float) -> None:
            k = len(out)
            none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
            out.append(None)
            if isinstance(node, Compare):
                first = lambda n: n.path if isinstance(n, PathInput) else first(n.inputs[0])
                ends = [F.lit(first(node.source)), self.input(node.source).as_array(), F.lit(first(node.target)), self.input(node.target).as_array()]
                function, kind = node.metric, "compare"
            else:
                ends, function, kind = [none, empty, none, empty], node.function, "aggregate"
            cols = [F.lit(k), F.lit(parent if parent >= 0 else None).cast("int"), F.lit(kind), F.lit(function), self.operator(node, limit, 0.0), *ends]
            names = ["node", "parent", "kind", "function", "value", "source_path", "source_values", "target_path", "target_values"]
            out[k] = F.struct(*[c.alias(n) for c, n in zip(cols, names, strict=True)])
            if isinstance(node, Aggregate):
                agg, total = lookup("aggregator", node.function)(**node.params), sum(c.weight for c in node.children)
                for c in node.children:
                    visit(c, k, agg.child_limit(limit, c.weight / total))

        if self.rule.condition is not None:
            visit(self.rule.condition, -1, 0.0)
        return F.array(*out)

    def necessary(self, m: float = 0.0) -> Column | None:
        """A cheap condition that all links of at least confidence m meet: of a min (or a single comparison), each child without a Python measure.

        Edit distances are only counted up to the radius, and only where the texts' lengths allow it."""
        root = self.rule.condition
        nodes = root.children if isinstance(root, Aggregate) and root.function == "min" else (root,) if isinstance(root, Compare) else ()
        cheap = [c for c in nodes if isinstance(c, Compare) and c.metric not in ("jaro", "jaroWinkler") and not _in_python(c)]
        conds = [self._near(c, m) for c in cheap if c.metric == "levenshteinDistance" and self.rule.threshold_of(c) > 0]
        if len(cheap) < len(nodes):
            conds += [self.compare(c, 0.0) >= 0 for c in cheap]
        return reduce(lambda a, b: a & b, conds) if conds else None

    def _near(self, c: Compare, m: float) -> Column:
        """Whether a comparison's distance can give confidence m."""
        a, b = (self._known(i, c.metric) or self.input(i) for i in (c.source, c.target))
        threshold, metric = self.rule.threshold_of(c), lookup("metric", c.metric)(**c.params)
        radius = threshold * (1.0 - m)
        within = metric.distance(a, b, threshold, radius) <= radius + MARGIN
        x, y = (self._known(i, f"{c.metric} sketch") for i in (c.source, c.target))
        return within if x is None or y is None else metric.near(x.col, y.col, radius + MARGIN) & within

    def sets(self, node: Operator | None, m: float) -> Compare | None:
        """The comparison of sets that a part of the rule is, if it is one."""
        return node if isinstance(node, Compare) and node.metric in ("jaccard", "dice") and self.rule.threshold_of(node) > 0 and not flipped(self.rule, self.rule.condition) else None

    def rarest(self, c: Compare, m: float, frequent: list[str]) -> Keys | None:
        """Keys of the rare elements of sets that are compared."""
        metric, radius = lookup("metric", c.metric)(**c.params), self.rule.threshold_of(c) * (1.0 - m) + MARGIN
        both = metric.rarest_keys(self.input(c.source), self.input(c.target), radius, frequent)
        return None if both is None else Keys(metric.rank, *both, many=10)

    def complete(self, side: int) -> Column:
        """Whether an entity has values for all comparisons, as far as they are its own."""
        variable = self.sides[side].variable
        found = [self.input(i).present() for c in comparisons(self.rule.condition) for i in (c.source, c.target) if variables_of(i) == {variable}]
        return reduce(lambda a, b: a & b, found, F.lit(True))

    def sketches(self, side: int) -> dict[str, Column]:
        """The sketches among a side's columns: what is left of them when equal values are put together is far less to make."""
        return {n: c for n, c in self.columns[side].items() if n in self.sketched}

    def used(self, side: int) -> list[str]:
        """The paths of a side that pairs are compared by as they are; the others only go into columns of the side."""
        found: list[str] = []
        for c in comparisons(self.rule.condition):
            for i in (c.source, c.target):
                if isinstance(i, PathInput) or len(variables_of(i)) > 1:
                    found += [p for p in paths_of(i) if variable_of(p) == self.sides[side].variable]
        return list(dict.fromkeys(found))

    def keys(self, m: float = 0.0) -> tuple[Column, Column] | None:
        """Arrays of keys of a source and a target entity: all pairs of confidence m or more share one. None if there are none."""
        found = self.keys_of(self.rule.condition, m)
        return None if found is None else (found.source, found.target)

    def keys_of(self, node: Operator | None, m: float = 0.0) -> Keys | None:
        """Keys of a part of the rule, of which the confidence is to be m or more."""
        # a comparison may take its first input from the target; such rules are rare and get no keys
        return None if node is None or flipped(self.rule, self.rule.condition) else self._keys(node, m, 0.0)

    def equal(self, node: Operator | None, m: float = 0.0) -> Keys | None:
        """Of a min (or a single comparison), the values that must be equal, as keys; None if there are none."""
        nodes = node.children if isinstance(node, Aggregate) and node.function == "min" else (node,) if isinstance(node, Compare) else ()
        return next((k for c in nodes if isinstance(c, Compare) and c.metric == "equality" and (k := self.keys_of(c, m)) is not None), None)

    def _keys(self, node: Operator, m: float, limit: float) -> Keys | None:
        if isinstance(node, Compare):
            if m <= -1:
                return None
            threshold = self.rule.threshold_of(node)
            a, b = self.input(node.source), self.input(node.target)
            metric = lookup("metric", node.metric)(**node.params)
            radius = threshold * (1.0 - m) + (MARGIN if m != 0 else 0.0)
            both = metric.key_arrays(a, b, radius, threshold * (1.0 - limit)) if threshold > 0 else None
            if both is None:
                return None
            return Keys(metric.rank, *both, metric.meets_once and not a.many and not b.many, metric.keys_each(radius))
        agg = lookup("aggregator", node.function)(**node.params)
        total = sum(c.weight for c in node.children)
        limits = [agg.child_limit(limit, c.weight / total) for c in node.children]
        if node.function == "max":
            each = [self._keys(c, m, x) for c, x in zip(node.children, limits, strict=True)]
            if not each or any(e is None for e in each):
                return None
            prefixed = lambda k, keys: F.transform(keys, lambda v: F.concat(F.lit(f"{k}|"), v))
            named = lambda side: F.flatten(F.array(*[prefixed(k, e[side]) for k, e in enumerate(each)]))
            return Keys(max(e.rank for e in each), named(1), named(2), many=sum(e.many for e in each))
        bounds = agg.child_bounds(m, [c.weight for c in node.children])
        each = [e for c, b, x in zip(node.children, bounds, limits, strict=True) if b is not None and (e := self._keys(c, b, x)) is not None]
        if not each:
            return None
        each.sort(key=lambda e: e.rank)
        if len(each) > 1 and agg.__class__.__name__ == "Minimum" and each[1].rank <= 5:
            # both must be met, so pairs of keys are keys, and far more selective
            one, two = each[:2]
            cross = lambda x, y: F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: F.concat(p, F.lit("\x1f"), q))))
            return Keys(one.rank, cross(one.source, two.source), cross(one.target, two.target), one.once and two.once, one.many * two.many, one)
        return each[0]


def _in_python(c: Compare) -> bool:
    def uses(n) -> bool:
        return isinstance(n, TransformInput) and (n.function in ("stem", "convertCharset") or any(uses(i) for i in n.inputs))

    return uses(c.source) or uses(c.target)


def flipped(rule: LinkRule, node: Operator) -> bool:
    """Whether any comparison takes its first input from the target or mixes both entities in one input."""
    if isinstance(node, Aggregate):
        return any(flipped(rule, c) for c in node.children)

    return not (variables_of(node.source) <= {rule.source.variable} and variables_of(node.target) <= {rule.target.variable})


def comparisons(node: Operator | None) -> list[Compare]:
    """All comparisons of a rule's tree."""
    return [] if node is None else [node] if isinstance(node, Compare) else [c for x in node.children for c in comparisons(x)]


def variables_of(node: Input) -> set[str]:
    return {variable_of(node.path)} if isinstance(node, PathInput) else set().union(*[variables_of(i) for i in node.inputs])
