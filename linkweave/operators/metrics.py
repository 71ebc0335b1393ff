"""Distance measures. Each gives a distance column of two operands' Values, and keys by which close operands meet.

A distance is 0 for equal operands, infinite where there is none. keys(radius) gives a pair of functions, for the source's and the
target's values, each to an array of strings, such that any two values within the radius share a string; None if there
are no such keys. All keys are exact: no pair within the radius is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.registry import register
from linkweave.values import Values

INF = float("inf")
Keys = tuple[Callable[[Column], Column], Callable[[Column], Column]]


class Metric:
    #: How selective the keys are, for choosing among several; less is better.
    rank = 9
    #: Whether two single values share one key at most.
    meets_once = False

    def keys_each(self, radius: float) -> int:
        """About how many keys a value has."""
        return 10

    def prepare(self, s: Column) -> Column:
        """What the measure needs of a text; it is made once per entity, not per pair."""
        return s

    def prepared(self, v: Values) -> Values:
        if v.prepared or type(self).prepare is Metric.prepare:
            return v
        return Values(F.transform(v.as_array(), self.prepare), True, True) if v.many else Values(self.prepare(v.col), False, True)

    def sketch(self, s: Column) -> Column | None:
        """A number made of a text, once per entity, that shows for most pairs that they are far apart; None if there is none."""
        return None

    def near(self, x: Column, y: Column, radius: float) -> Column:
        """Of two sketches: whether the texts can be within the radius."""
        raise NotImplementedError

    def distance(self, a: Values, b: Values, limit: float, worst: float) -> Column:
        """The smallest distance of any two values. From ``worst`` on, the caller doesn't care how far."""
        a, b = self.prepared(a), self.prepared(b)
        if not a.many and not b.many:
            return self.of(a.col, b.col, limit, worst)
        right = b.as_array()
        return F.array_min(F.flatten(F.transform(a.as_array(), lambda x: F.transform(right, lambda y: self.of(x, y, limit, worst)))))

    def of(self, x: Column, y: Column, limit: float, worst: float) -> Column:
        raise NotImplementedError

    def keys(self, radius: float, limit: float) -> Keys | None:
        return None

    def key_arrays(self, a: Values, b: Values, radius: float, limit: float) -> tuple[Column, Column] | None:
        keys = self.keys(radius, limit)
        if keys is None:
            return None
        lift = lambda v, f: F.flatten(F.transform(v.as_array(), f)) if v.many else F.coalesce(f(v.col), F.array().cast("array<string>"))
        return F.array_distinct(lift(a, keys[0])), F.array_distinct(lift(b, keys[1]))


def _text(*parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _segment(length: Column, tau: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of segment i when a string is cut evenly into tau + 1 segments, the longer ones last."""
    n = (tau + 1).cast("int")
    short = F.floor(length / n).cast("int")
    first_long = n - length % n
    start = i * short + F.greatest(i - first_long, F.lit(0))
    return start.cast("int"), (short + F.when(i >= first_long, 1).otherwise(0)).cast("int")


def edit_keys(tau_of: Callable[[Column], Column], longest: Callable[[Column], tuple[Column, Column]]) -> Keys:
    """Keys for edit distances by partition: one of tau + 1 segments of the target's string stands unchanged in the source's.

    tau_of: edits allowed, by the target's length; longest: the target's shortest and greatest length, by the source's. With i
    edits to the left of segment i or to its right it can only be shifted so far, which bounds the places to look at. Strings
    too short to be cut get a key of their own, shared by all sources they can reach.
    """

    def target(s: Column) -> Column:
        n = F.length(s)
        tau = tau_of(n)

        def segment(i: Column) -> Column:
            start, size = _segment(n, tau, i)
            return _text(n, i, F.substring(s, start + 1, size))

        cut = F.transform(F.sequence(F.lit(0), tau), segment)
        return F.when(s.isNull(), F.array().cast("array<string>")).when(n <= tau, F.array(F.lit("short"))).otherwise(cut)

    def source(s: Column) -> Column:
        n = F.length(s)
        low, high = longest(n)

        def of_length(m: Column) -> Column:
            tau = tau_of(m)

            def of_segment(i: Column) -> Column:
                start, size = _segment(m, tau, i)
                off = n - m
                lo = F.greatest(F.lit(0), start - i, start + off - (tau - i))
                hi = F.least(n - size, start + i, start + off + (tau - i))
                places = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
                return F.transform(places, lambda p: _text(m, i, F.substring(s, p + 1, size)))

            cut = F.flatten(F.transform(F.sequence(F.lit(0), tau), of_segment))
            return F.when((m > tau) & (F.abs(n - m) <= tau), cut).otherwise(F.array().cast("array<string>"))

        lengths = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        some = F.flatten(F.transform(lengths, of_length))
        short = F.when(low <= tau_of(low), F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
        return F.when(s.isNull(), F.array().cast("array<string>")).otherwise(F.concat(some, short))

    return source, target


#: Greatest length up to which strings are blocked by what is left of them after deletions, by the edits allowed: some 200 keys.
DELETE_UP_TO = {1: 60, 2: 18, 3: 9}


def _without(s: Column, tau: int) -> Column:
    """The string and all that is left of it after up to tau deletions."""
    level = F.array(s)
    levels = [level]
    for _ in range(tau):
        one_less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda x: F.length(x) > 0), one_less)))
        levels.append(level)
    return F.array_distinct(F.flatten(F.array(*levels)))


def delete_keys(tau: int, partition: Keys) -> Keys:
    """Keys for edit distances up to tau: strings so near become one by at most tau deletions from each. Such keys stay selective where
    all strings share a long part, as padded numbers do. Targets longer than DELETE_UP_TO go by partition instead."""
    most = DELETE_UP_TO[tau]
    none = F.array().cast("array<string>")
    marked = lambda s: F.transform(_without(s, tau), lambda x: F.concat(F.lit("-"), x))
    source_part, target_part = partition

    def target(s: Column) -> Column:
        return F.when(s.isNull(), none).when(F.length(s) <= most, marked(s)).otherwise(target_part(s))

    def source(s: Column) -> Column:
        n = F.length(s)
        short = F.when(n <= most + tau, marked(s)).otherwise(none)
        long = F.when(n + tau > most, source_part(s)).otherwise(none)
        return F.when(s.isNull(), none).otherwise(F.concat(short, long))

    return source, target


class Levenshtein(Metric):
    """Edit distance; infinite where the lengths differ by the limit or more."""

    rank = 5

    def keys_each(self, radius):
        return {0: 1, 1: 10, 2: 46, 3: 130}.get(math.floor(radius), 200)

    def sketch(self, s):
        """How often letters of 16 kinds occur, up to 4 times, each count as so many bits."""
        move = lambda name, x, n: F.call_function(name, x, n)

        def count(all, x):
            at = F.ascii(x) % 16 * 4
            one_more = (move("shiftright", all, at).bitwiseAND(F.lit(15)) * 2 + 1).bitwiseAND(F.lit(15)).cast("long")
            return F.when(F.length(x) == 0, all).otherwise(all.bitwiseOR(move("shiftleft", one_more, at)))

        return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), count)

    def near(self, x, y, radius):
        # an edit takes one letter away, adds one, or does both
        return F.bit_count(x.bitwiseXOR(y)) <= 2 * math.floor(radius)

    def of(self, x, y, limit, worst):
        gate = F.abs(F.length(x) - F.length(y)) >= limit
        if math.isfinite(worst) and worst < 2**30:
            # -1, for more than the bound, becomes a number that is far beyond it
            d = F.levenshtein(x, y, max(0, math.ceil(worst))).bitwiseAND(F.lit(2**31 - 1))
        else:
            d = F.levenshtein(x, y)
        return F.when(gate, F.lit(INF)).otherwise(d.cast("double"))

    def keys(self, radius, limit):
        tau = math.floor(radius)
        # beyond this the keys are more than they save
        if tau < 0 or tau > 8:
            return None
        if tau not in DELETE_UP_TO:
            return edit_keys(lambda n: F.lit(tau), lambda n: (F.greatest(n - tau, F.lit(0)), n + tau))
        span = lambda n: (F.greatest(n - tau, F.lit(DELETE_UP_TO[tau] + 1)), n + tau)
        return delete_keys(tau, edit_keys(lambda n: F.lit(tau), span))


class NormalizedLevenshtein(Metric):
    """Edit distance over the longer length; the gate is that of the edit distance with the limit times that length."""

    rank = 6

    def of(self, x, y, limit, worst):
        scale = F.greatest(F.length(x), F.length(y))
        gate = (F.abs(F.length(x) - F.length(y)) >= F.lit(limit) * scale) | (scale == 0)
        return F.when(gate, F.lit(INF)).otherwise(F.levenshtein(x, y) / F.when(scale == 0, 1).otherwise(scale))

    def keys(self, radius, limit):
        if not 0 <= radius < 0.6:
            return None
        # d <= r * max(n, m) and |n - m| <= d, so the longer has at most m / (1 - r) letters; a margin keeps whole numbers in
        tau = lambda m: F.floor(m * F.lit(radius / (1 - radius)) + 1e-9).cast("int")
        span = lambda n: (F.ceil(n * F.lit(1 - radius) - 1e-9).cast("int"), F.floor(n / F.lit(1 - radius) + 1e-9).cast("int"))
        return edit_keys(tau, span)


def jaro_distance(s: str, t: str) -> float:
    """1 minus the Jaro similarity with a match window of half the shorter length, rounded up."""
    if not s or not t:
        return 1.0
    window = math.ceil(min(len(s), len(t)) / 2)

    def common(a: str, b: str) -> list[str]:
        left, out = list(b), []
        for i, c in enumerate(a):
            for j in range(max(0, i - window), min(i + window + 1, len(b))):
                if left[j] == c:
                    out.append(c)
                    left[j] = None
                    break
        return out

    one, two = common(s, t), common(t, s)
    if not one or not two:
        return 1.0
    swaps = sum(a != b for a, b in zip(one, two, strict=False)) // 2
    m = len(one)
    return 1.0 - (m / len(s) + len(two) / len(t) + (m - swaps) / m) / 3.0


def jaro_winkler_distance(s: str, t: str) -> float:
    d, n = jaro_distance(s, t), 0
    while n < min(4, len(s), len(t)) and s[n] == t[n]:
        n += 1
    return d - 0.1 * n * d


class PythonMetric(Metric):
    """A measure of two strings in Python, by Arrow batches; every pair of strings of a batch is computed once."""

    def __init__(self, f: Callable[[str, str], float]):
        self.f = f

    def distance(self, a, b, limit, worst):
        f = self.f

        @F.pandas_udf("double")
        def one(x: pd.Series, y: pd.Series) -> pd.Series:
            known: dict = {}
            out = np.full(len(x), np.nan)
            empty = np.ones(len(x), bool)
            for k, (p, q) in enumerate(zip(x, y, strict=True)):
                if p is not None and q is not None:
                    if (p, q) not in known:
                        known[p, q] = f(p, q)
                    out[k], empty[k] = known[p, q], False
            return pd.Series(out).astype(object).where(~empty, None).astype("Float64")

        @F.pandas_udf("double")
        def many(x: pd.Series, y: pd.Series) -> pd.Series:
            known: dict = {}
            of = lambda p, q: known[p, q] if (p, q) in known else known.setdefault((p, q), f(p, q))
            return pd.Series([min((of(p, q) for p in ps for q in qs), default=None) for ps, qs in zip(x, y, strict=True)], dtype="Float64")

        return one(a.col, b.col) if not a.many and not b.many else many(a.as_array(), b.as_array())


class QGrams(Metric):
    rank = 7

    def __init__(self, q: int):
        self.q = q

    def prepare(self, s):
        return self.grams(s)

    def grams(self, s: Column) -> Column:
        pad = "#" * (self.q - 1)
        t = F.concat(F.lit(pad), s, F.lit(pad))
        n = F.length(t) - (self.q - 1)
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda p: F.substring(t, p, self.q))).otherwise(F.array().cast("array<string>"))

    def of(self, x, y, limit, worst):
        # of each gram, the smaller of its two counts
        a, b = x, y
        count = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))
        shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g)))
        n = F.size(a) + F.size(b)
        return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - F.lit(2.0) * shared / F.when(n == 0, 1).otherwise(n))

    def keys(self, radius, limit):
        if radius >= 1:
            return None
        return self.grams, self.grams


def _itself(s: Column) -> Column:
    return F.when(s.isNull(), F.array().cast("array<string>")).otherwise(F.array(s))


class Equality(Metric):
    rank = 0
    meets_once = True

    def keys_each(self, radius):
        return 1

    def of(self, x, y, limit, worst):
        return F.when(x == y, F.lit(0.0)).otherwise(F.lit(1.0))

    def keys(self, radius, limit):
        return (_itself, _itself) if radius < 1 else None


class Inequality(Metric):
    def of(self, x, y, limit, worst):
        return F.when(x == y, F.lit(1.0)).otherwise(F.lit(0.0))


class _Number(Metric):
    """A measure of the difference of two numbers read from the texts."""

    rank = 2
    #: The source's bins are three, the target's is one.
    meets_once = True
    unit = 1.0

    def keys_each(self, radius):
        return 2

    def number(self, s: Column) -> Column:
        raise NotImplementedError

    def prepare(self, s):
        return self.number(s)

    def of(self, x, y, limit, worst):
        gap = F.abs(x - y)
        size = self.size(limit)
        d = gap if size is None else (gap / F.lit(size) if size > 0 else F.when(gap.isNull() | (gap > 0), F.lit(INF)).otherwise(F.lit(float("nan"))))
        return F.coalesce(d.cast("double"), F.lit(INF))

    def size(self, limit: float) -> float | None:
        """What a difference is divided by; None for nothing."""
        return None

    def keys(self, radius, limit):
        size = self.size(limit)
        wide = radius * (1.0 if size is None else size)
        if not wide > 0 or not math.isfinite(wide):
            return None
        # a margin, so that a difference of just the radius never spans two bins
        bin_of = lambda s: F.floor(self.number(s) / F.lit(wide * (1 + 1e-9)))
        none = F.array().cast("array<string>")
        one = lambda s: F.when(self.number(s).isNull(), none).otherwise(F.array(bin_of(s).cast("string")))
        around = lambda s: F.when(self.number(s).isNull(), none).otherwise(F.array(*[(bin_of(s) + k).cast("string") for k in (-1, 0, 1)]))
        return around, one


class Num(_Number):
    def __init__(self, scale: float):
        self.scale = scale

    def number(self, s):
        x = s.try_cast("double")
        return F.when(~F.isnan(x), x)

    def size(self, limit):
        return limit * self.scale


def _fields(s: Column, pattern: str, units: list[int]) -> Column:
    """Sum of the pattern's groups, each times its unit; a missing group counts 0. Null where the pattern doesn't match."""
    part = lambda k: F.coalesce(F.regexp_extract(s, pattern, k).try_cast("double"), F.lit(0.0))
    total = sum((part(k + 1) * u for k, u in enumerate(units)), F.lit(0.0))
    return F.when(s.rlike(pattern), total)


_ZONE = r"(?:Z|[+-]\d\d:\d\d)?$"
_TIME = r"(\d\d):(\d\d):(\d\d)(?:\.\d+)?"


class Date(_Number):
    """Difference in days, with months of 30 and years of 365 days; the time of day doesn't count."""

    def number(self, s):
        day = _fields(s, r"^(-?\d{4,})(?:-(\d\d))?(?:-(\d\d))?(?:T[0-9:.]+)?" + _ZONE, [365, 30, 1])
        month = _fields(s, r"^--(\d\d)(?:-(\d\d))?" + _ZONE, [30, 1])
        return F.coalesce(day, month, _fields(s, r"^---(\d\d)" + _ZONE, [1]))


class DateTime(_Number):
    """Difference in seconds, with months of 30 and years of 365 days; time zones and fractions don't count."""

    def number(self, s):
        year, month, day = 365 * 86400, 30 * 86400, 86400
        full = _fields(s, r"^(-?\d{4,})(?:-(\d\d))?(?:-(\d\d))?(?:T" + _TIME + ")?" + _ZONE, [year, month, day, 3600, 60, 1])
        return F.coalesce(full, _fields(s, "^" + _TIME + _ZONE, [3600, 60, 1]))


#: Fixed value: kilometres of a degree of a great circle, as the measure counts them.
KM_PER_DEGREE = 60 * 1.1515 * 1.609344


class Wgs84(Metric):
    """Distance on a sphere of two points, 'lat lon' or 'POINT(lon lat)', in kilometres or metres."""

    rank = 1
    #: A target's point is in one cell.
    meets_once = True

    def __init__(self, unit: str, scale: float):
        self.unit, self.scale = (1.0 if unit in ("km", "kilometer") else 1000.0), scale

    def point(self, s: Column) -> tuple[Column, Column]:
        parts = F.split(F.trim(F.regexp_replace(s, "[^0-9.+ -]", "")), " ")
        two = F.size(parts) == 2
        a = F.when(two, F.get(parts, F.lit(0)).try_cast("double"))
        b = F.when(two, F.get(parts, F.lit(1)).try_cast("double"))
        swap = F.startswith(s, F.lit("POINT"))
        lat, lon = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
        return F.when(lon.isNotNull(), lat), F.when(lat.isNotNull(), lon)

    def prepare(self, s):
        lat, lon = self.point(s)
        return F.struct(F.radians(lat).alias("lat"), F.radians(lon).alias("lon"))

    def of(self, x, y, limit, worst):
        la, oa, lb, ob = x["lat"], x["lon"], y["lat"], y["lon"]
        cos = F.sin(la) * F.sin(lb) + F.cos(la) * F.cos(lb) * F.cos(oa - ob)
        # rounding can push equal points out of the cosine's range
        d = F.degrees(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))) * F.lit(KM_PER_DEGREE * self.unit / self.scale)
        # the bounds would make a number of a null
        return F.when(la.isNotNull() & lb.isNotNull(), d).otherwise(F.lit(INF))

    def keys(self, radius, limit):
        km = radius * self.scale / self.unit
        h = km * (1 + 1e-9) / KM_PER_DEGREE + 1e-9
        if not 0 < h < 30:
            return None
        none = F.array().cast("array<string>")

        def cells(band: Column) -> Column:
            """Cells around the band: as wide as the radius reaches at the band's highest latitude."""
            top = F.least(F.greatest(F.abs(band * h - 90), F.abs((band + 1) * h - 90)), F.lit(90.0))
            reach = math.sin(math.radians(h))
            # 0 where the radius reaches around the pole; the quotient is above 1 there
            part = F.degrees(F.asin(F.least(F.lit(reach) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12)), F.lit(1.0))))
            return F.floor(F.lit(360.0) / part).cast("int")

        def cell(lon: Column, n: Column) -> Column:
            return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n - 1).cast("int")

        def around(s: Column, steps: tuple[int, ...]) -> Column:
            """Cells of the point's band and those beside it; every part is computed once, as the variable of a fold."""
            lat, lon = self.point(s)
            point = F.struct(F.floor((lat + 90) / h).cast("int").alias("band"), lon.alias("lon"))
            offsets = F.array(*[F.lit(k) for k in steps])
            # fewer than five cells count as one, also at the poles
            whole = lambda n: F.when(n < 5, 1).otherwise(n)
            of_band = lambda p: F.transform(offsets, lambda i: F.struct((p["band"] + i).alias("band"), whole(cells(p["band"] + i)).alias("n"), p["lon"].alias("lon")))
            of_cell = lambda q: F.transform(offsets, lambda j: _text(q["band"], F.pmod(cell(q["lon"], q["n"]) + j, q["n"])))
            found = F.flatten(F.transform(F.flatten(F.transform(F.array(point), of_band)), of_cell))
            return F.when(lat.isNull(), none).otherwise(F.array_distinct(found))

        def target(s: Column) -> Column:
            return around(s, (0,))

        def source(s: Column) -> Column:
            return around(s, (-1, 0, 1))

        return source, target


#: So many of the most frequent elements are told apart when sets are blocked by their rarest ones.
FREQUENT = 256


class _Sets(Metric):
    """A measure of two sets as wholes."""

    rank = 4

    def distance(self, a, b, limit, worst):
        x, y = F.array_distinct(a.as_array()), F.array_distinct(b.as_array())
        return self.of_sets(F.size(F.array_intersect(x, y)), F.size(x), F.size(y))

    def keys(self, radius, limit):
        return (_itself, _itself) if radius < 1 else None

    def shared(self, near: float) -> tuple[float, float]:
        """For sets at least so near: the elements they share as a part of the sizes' sum, and the least size as a part of the other."""
        raise NotImplementedError

    def rarest_keys(self, a: Values, b: Values, radius: float, frequent: list[str]) -> tuple[Column, Column] | None:
        """Keys by both sizes and an element, of the elements that are rare. frequent: the most frequent ones, rarest first.

        If of n and m elements at least k must be shared, one is among the first n - k + 1 of the one set and the first m - k + 1 of the other, in any order
        that holds for both; here the rare come first."""
        if not radius < 1:
            return None
        part, least = self.shared(1.0 - radius)
        place = F.create_map(*[x for k, e in enumerate(frequent) for x in (F.lit(e), F.lit(k + 1))]) if frequent else None

        def side(v: Values, source: bool) -> Column:
            entry = lambda e: F.struct((F.lit(0) if place is None else F.coalesce(F.try_element_at(place, e), F.lit(0))).alias("k"), e.alias("e"))
            ordered = F.array_sort(F.transform(F.array_distinct(v.as_array()), entry))
            n = F.size(ordered)
            others = F.sequence(F.greatest(F.ceil(n * least - 1e-9), F.lit(1)).cast("int"), F.floor(n / F.lit(least) + 1e-9).cast("int"))

            def of_size(x: Column, m: Column) -> Column:
                first = F.size(x) - F.ceil((F.size(x) + m) * part - 1e-9).cast("int") + 1
                sizes = (F.size(x), m) if source else (m, F.size(x))
                return F.transform(F.slice(x, 1, F.greatest(F.least(first, F.size(x)), F.lit(0))), lambda y: _text(*sizes, y["e"]))

            # a fold over one array, so that it is put in order once
            found = F.flatten(F.transform(F.array(ordered), lambda x: F.flatten(F.transform(others, lambda m: of_size(x, m)))))
            return F.when(n > 0, found).otherwise(F.array().cast("array<string>"))

        return side(a, True), side(b, False)


class Jaccard(_Sets):
    def of_sets(self, shared, x, y):
        union = x + y - shared
        return F.when(union == 0, F.lit(float("nan"))).otherwise(1.0 - shared / F.when(union == 0, 1).otherwise(union))

    def shared(self, near):
        return near / (1 + near), near


class Dice(_Sets):
    def of_sets(self, shared, x, y):
        return F.when(x + y == 0, F.lit(float("nan"))).otherwise(1.0 - F.lit(2.0) * shared / F.when(x + y == 0, 1).otherwise(x + y))

    def shared(self, near):
        return near / 2, near / (2 - near)


def _scale(given: float) -> float:
    return 1.0 if math.isnan(given) else given


@register("metric", "levenshteinDistance", "Levenshtein distance")
def levenshtein_distance(minChar: str = "0", maxChar: str = "z"):  # noqa: N803
    return Levenshtein()


@register("metric", "levenshtein", "Normalized Levenshtein distance")
def levenshtein(minChar: str = "0", maxChar: str = "z"):  # noqa: N803
    return NormalizedLevenshtein()


@register("metric", "jaro", "Jaro distance")
def jaro():
    return PythonMetric(jaro_distance)


@register("metric", "jaroWinkler", "Jaro-Winkler distance")
def jaro_winkler():
    return PythonMetric(jaro_winkler_distance)


@register("metric", "qGrams", "q-grams")
def q_grams(q: int = 2):
    return QGrams(q)


@register("metric", "equality", "Equality")
def equality():
    return Equality()


@register("metric", "inequality", "Inequality")
def inequality():
    return Inequality()


@register("metric", "num", "Numeric difference")
def num(minValue: float = -INF, maxValue: float = INF, maxDistance: float = float("nan")):  # noqa: N803
    return Num(_scale(maxDistance))


@register("metric", "date", "Date")
def date(maxDays: int):  # noqa: N803
    return Date()


@register("metric", "dateTime", "Date and time")
def date_time():
    return DateTime()


@register("metric", "wgs84", "Geographical distance")
def wgs84(unit: str = "km", threshold: float = float("nan")):
    return Wgs84(unit, _scale(threshold))


@register("metric", "jaccard", "Jaccard distance")
def jaccard():
    return Jaccard()


@register("metric", "dice", "Dice distance")
def dice():
    return Dice()
