"""Aggregators: one confidence from several, row by row. Null stands for a confidence that can't be computed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.registry import register

NAN = float("nan")


class Aggregator:
    def evaluate(self, weighted: list[tuple[int, Column]]) -> Column:
        raise NotImplementedError

    def child_limit(self, limit: float, weight: float) -> float:
        """The limit for a child with this share of the weight."""
        return limit

    def child_bounds(self, m: float, weights: list[int]) -> list[float | None]:
        """For each child the confidence it must reach for the whole to reach m; None if none is certain."""
        return [None] * len(weights)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


class Average(Aggregator):
    def __init__(self, positive: int, negative: int):
        self.positive, self.negative = positive, negative

    def evaluate(self, weighted):
        if not weighted:
            return F.lit(None).cast("double")
        # a fold, so that each child is computed once
        children = F.array(*[F.struct(F.lit(float(w)).alias("w"), c.cast("double").alias("c")) for w, c in weighted])

        def add(sums, x):
            factor = x["w"] * F.when(x["c"] > 0, float(self.positive)).when(x["c"] < 0, float(self.negative)).otherwise(0.0)
            return F.struct((sums["above"] + F.when(factor != 0, factor * x["c"]).otherwise(0.0)).alias("above"), (sums["total"] + factor).alias("total"))

        start = F.struct(F.lit(0.0).alias("above"), F.lit(0.0).alias("total"))
        return F.aggregate(children, start, add, lambda sums: F.coalesce(F.try_divide(sums["above"], sums["total"]), F.lit(NAN)))

    def child_limit(self, limit, weight):
        return 1.0 - (1.0 - limit) / weight + self.positive / self.negative

    def child_bounds(self, m, weights):
        out = []
        for k, w in enumerate(weights):
            rest = sum(weights) - w
            # all others at +1; a child that is exactly zero is skipped, so no bound above zero holds
            bound = min(0.0, (m * (self.positive * rest + self.negative * w) - self.positive * rest) / (self.negative * w))
            out.append(bound if bound > -1 else None)
        return out


class Maximum(Aggregator):
    def evaluate(self, weighted):
        return F.greatest(*[c for _, c in weighted]) if len(weighted) > 1 else weighted[0][1] if weighted else F.lit(None).cast("double")


class Minimum(Aggregator):
    def evaluate(self, weighted):
        return F.least(*[c for _, c in weighted]) if len(weighted) > 1 else weighted[0][1] if weighted else F.lit(None).cast("double")

    def child_bounds(self, m, weights):
        return [m] * len(weights)


class QuadraticMean(Aggregator):
    def evaluate(self, weighted):
        if not weighted:
            return F.lit(None).cast("double")
        return F.sqrt(_sum([F.lit(float(w)) * F.pow(c, F.lit(2.0)) for w, c in weighted]) / F.lit(float(sum(w for w, _ in weighted))))


class GeometricMean(Aggregator):
    def evaluate(self, weighted):
        if not weighted:
            return F.lit(None).cast("double")
        product = reduce(lambda a, b: a * b, [F.pow(c, F.lit(float(w))) for w, c in weighted])
        return F.pow(product, F.lit(1.0 / sum(w for w, _ in weighted)))


@register("aggregator", "average", "Average")
def average(positiveWeight: int = 9, negativeWeight: int = 10):  # noqa: N803
    return Average(positiveWeight, negativeWeight)


@register("aggregator", "max", "Maximum")
def maximum():
    return Maximum()


@register("aggregator", "min", "Minimum")
def minimum():
    return Minimum()


@register("aggregator", "quadraticMean", "Quadratic mean")
def quadratic_mean():
    return QuadraticMean()


@register("aggregator", "geometricMean", "Geometric mean")
def geometric_mean():
    return GeometricMean()
