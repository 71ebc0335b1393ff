"""Known results of measures, transformers and aggregators, as single values and as sets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from linkweave.functions.porter import stem
from linkweave.operators.metrics import jaro_distance, jaro_winkler_distance
from linkweave.registry import describe, lookup
from linkweave.values import Values

JARO = {("SHACKLEFORD", "SHACKELFORD"): 0.970, ("DUNNINGHAM", "CUNNIGHAM"): 0.896, ("NICHLESON", "NICHULSON"): 0.926, ("JONES", "JOHNSON"): 0.790, ("MASSEY", "MASSIE"): 0.889, ("MARHTA", "MARTHA"): 0.944, ("DIXON", "DICKSONX"): 0.767}
WINKLER = {("DUNNINGHAM", "CUNNIGHAM"): 0.896, ("NICHLESON", "NICHULSON"): 0.956, ("JONES", "JOHNSON"): 0.832, ("MASSEY", "MASSIE"): 0.933, ("MARHTA", "MARTHA"): 0.961, ("SEAN", "SUSAN"): 0.805, ("JON", "JOHN"): 0.933}


def test_jaro():
    for (a, b), s in JARO.items():
        assert 1 - jaro_distance(a, b) == pytest.approx(s, abs=0.0006)
    for (a, b), s in WINKLER.items():
        assert 1 - jaro_winkler_distance(a, b) == pytest.approx(s, abs=0.0006)
    assert jaro_distance("", "a") == 1.0 and jaro_distance("ab", "xy") == 1.0


def distance(spark, metric, a, b, limit=1.0, worst=math.inf, **params):
    """The distance of two texts or two lists, each also as sets of one."""
    m = lookup("metric", metric)(**params)
    if isinstance(a, str):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        one = df.select(m.distance(Values(F.col("a"), False), Values(F.col("b"), False), limit, worst)).first()[0]
        many = df.select(m.distance(Values(F.array("a")), Values(F.array("b")), limit, worst)).first()[0]
        assert one == many or (math.isnan(one) and math.isnan(many))
        return one
    return spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(m.distance(Values(F.col("a")), Values(F.col("b")), limit, worst)).first()[0]


@pytest.mark.parametrize(
    ("metric", "a", "b", "params", "limit", "expected"),
    [
        ("levenshteinDistance", "kitten", "sitting", {}, 2.0, 3),
        ("levenshteinDistance", "kitten", "sitting", {}, 1.0, math.inf),
        ("levenshteinDistance", "same", "same", {}, 0.0, math.inf),
        ("levenshteinDistance", "Saturday", "Sunday", {}, 3.0, 3),
        ("levenshtein", "abcd", "abcf", {}, 1.0, 0.25),
        ("levenshtein", "", "", {}, 1.0, math.inf),
        ("jaccard", ["Same", "D1"], ["Same", "D2"], {}, 1.0, 2 / 3),
        ("jaccard", ["A", "B", "C"], ["A", "B", "D"], {}, 1.0, 0.5),
        ("dice", ["A", "B", "C"], ["A", "B", "D"], {}, 1.0, 1 / 3),
        ("qGrams", "abcd", "dcba", {}, 1.0, 1),
        ("qGrams", "ab", "ac", {}, 1.0, 2 / 3),
        ("qGrams", "", "", {}, 1.0, 0),
        ("qGrams", "aaaa", "aa", {}, 1.0, 0.25),
        ("date", "2003-03-01", "2010-09-30", {"maxDays": "1"}, 1.0, 2764),
        ("date", "2010-09-24", "2010-09-30T06:00:00", {"maxDays": "1"}, 1.0, 6),
        ("date", "2024-01-31", "2024-03-01", {"maxDays": "1"}, 1.0, 30),
        ("date", "soon", "2024-03-01", {"maxDays": "1"}, 1.0, math.inf),
        ("dateTime", "2001-10-26T21:32:10", "2001-10-26T21:32:40Z", {}, 1.0, 30),
        ("wgs84", "POINT(-0.124722 51.5081)", "POINT(13.3989 52.5006)", {}, 1.0, 930.8311),
        ("wgs84", "51.5081 -0.124722", "52.5006 13.3989", {"unit": "m"}, 1.0, 930831.1),
        ("wgs84", "12.3 45.6", "12.3 45.6", {}, 1.0, 0),
        ("wgs84", "here", "12.3 45.6", {}, 1.0, math.inf),
        ("num", "0.3", "0.7", {"maxDistance": "1"}, 0.9, 0.444444),
        ("num", "0", "1", {}, 0.9, 1.111111),
        ("num", "x", "1", {}, 0.9, math.inf),
        ("equality", "aaa", "aab", {}, 1.0, 1),
        ("inequality", "aaa", "aaa", {}, 1.0, 1),
        ("equality", ["a", "b"], ["b", "c"], {}, 1.0, 0),
        ("jaro", ["x", "MARHTA"], ["MARTHA"], {}, 1.0, 1 - 0.9444444),
    ],
)
def test_distances(spark, metric, a, b, params, limit, expected):
    got = distance(spark, metric, a, b, limit, **params)
    assert got == pytest.approx(expected, rel=1e-5, abs=1e-5)


@pytest.mark.parametrize(
    ("function", "inputs", "params", "expected"),
    [
        ("alphaReduce", [["a1b0c", "-def-"]], {}, ["abc", "def"]),
        ("numReduce", [["a1b0c"]], {}, ["10"]),
        ("concat", [["abc"], ["def"]], {}, ["abcdef"]),
        ("concat", [["a", "b"], ["x", "y"]], {"glue": "-"}, ["a-x", "a-y", "b-x", "b-y"]),
        ("concat", [["a"], []], {}, []),
        ("lowerCase", [["ABc", "abc"]], {}, ["abc"]),
        ("upperCase", [["abc"]], {}, ["ABC"]),
        ("regexReplace", [["a0b1c2"]], {"regex": "[^0-9]*", "replace": ""}, ["012"]),
        ("replace", [["a b c"]], {"search": " ", "replace": ""}, ["abc"]),
        ("removeBlanks", [["a b c"]], {}, ["abc"]),
        ("removeSpecialChars", [["a.b.c-_"]], {}, ["abc_"]),
        ("stem", [["abolished", "abominations", "ponies", "relational", "as"]], {}, ["abolish", "abomin", "poni", "relat", "as"]),
        ("stripPrefix", [["abc123", "xabc"]], {"prefix": "abc"}, ["123", "xabc"]),
        ("stripPostfix", [["abc123", "123x"]], {"postfix": "123"}, ["abc", "123x"]),
        ("stripUriPrefix", [["http://a.example/resource/Apple", "http://a.example/r#Moon", "plain"]], {}, ["Apple", "Moon", "plain"]),
        ("tokenize", [["a b  c "]], {}, ["a", "b", "", "c"]),
        ("tokenize", [["", "  "]], {}, [""]),
        ("removeEmptyValues", [["", "a"]], {}, ["a"]),
        ("logarithm", [["100", "abc", "0"]], {}, ["2.0", "abc", "-Infinity"]),
        ("convertCharset", [["Ã©", "a"]], {}, ["é", "a"]),
    ],
)
def test_transformers(spark, function, inputs, params, expected):
    f = lookup("transformer", function)(**params)
    df = spark.createDataFrame([tuple(inputs)], ", ".join(f"i{k} array<string>" for k in range(len(inputs))))
    assert df.select(f([Values(F.col(f"i{k}")) for k in range(len(inputs))]).as_array()).first()[0] == expected
    if all(len(i) == 1 for i in inputs):
        one = df.select(f([Values(F.col(f"i{k}")[0], False) for k in range(len(inputs))]).as_array()).first()[0]
        assert one == expected
    # nothing gives nothing
    none = spark.createDataFrame([tuple([] for _ in inputs)], df.schema)
    assert none.select(f([Values(F.col(f"i{k}")) for k in range(len(inputs))]).as_array()).first()[0] == []


def test_parameters():
    with pytest.raises(ValueError, match="maxDays"):
        lookup("metric", "date")(max_days="4")
    with pytest.raises(KeyError):
        lookup("metric", "unheardOf")
    with pytest.raises(LookupError):
        lookup("transformer", "convertCharset")(sourceCharset="no-such")


def test_stemmer_words():
    for w, s in {"caresses": "caress", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adoption": "adopt", "controlling": "control", "rate": "rate", "cease": "ceas"}.items():
        assert stem(w) == s


@pytest.mark.parametrize(
    ("function", "weighted", "expected"),
    [
        ("average", [(1, 1.0), (1, 1.0), (1, 1.0)], 1.0), ("average", [(1, 0.4), (1, 0.5), (1, 0.6)], 0.5), ("average", [(1, 1.0), (1, 0.0)], 1.0), ("average", [(1, 0.0), (1, 0.0)], math.nan),
        ("average", [(1, 1.0), (1, -1.0)], -0.052632), ("average", [(2, 1.0), (1, -1.0)], 0.285714), ("max", [(1, 0.4), (1, 0.5), (1, 0.6)], 0.6), ("min", [(1, 0.4), (1, 0.5), (1, 0.6)], 0.4),
        ("quadraticMean", [(1, 1.0), (1, 0.0)], 0.707107), ("quadraticMean", [(1, 0.4), (2, 0.5), (3, 0.6)], 0.538516), ("quadraticMean", [(1, -1.0), (1, 1.0)], 1.0),
        ("geometricMean", [(2, 0.5), (1, 1.0)], 0.629961), ("geometricMean", [(2, 0.5), (1, 1.0), (5, 0.7)], 0.672866), ("geometricMean", [(10, 0.1), (2, 0.9), (3, 0.2)], 0.153971), ("max", [], None), ("average", [], None),
    ],
)
def test_aggregators(spark, function, weighted, expected):
    got = spark.range(1).select(lookup("aggregator", function)().evaluate([(w, F.lit(v)) for w, v in weighted])).first()[0]
    assert got is None if expected is None else got == pytest.approx(expected, abs=1e-6, nan_ok=True)


def _share(spark, metric, pairs, radius, limit=10.0, **params):
    """For each pair, whether it shares a key, and its distance."""
    m = lookup("metric", metric)(**params)
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = Values(F.col("a"), False), Values(F.col("b"), False)
    keys = m.key_arrays(a, b, radius, limit)
    return df.select("a", "b", F.arrays_overlap(*keys).alias("share"), m.distance(a, b, limit, math.inf).alias("d")).collect()


def test_edit_keys_miss_nothing(spark):
    rng = random.Random(5)
    for metric, radius in (("levenshteinDistance", 0.0), ("levenshteinDistance", 1.0), ("levenshteinDistance", 2.5), ("levenshteinDistance", 4.0), ("levenshtein", 0.2), ("levenshtein", 0.4)):
        pairs = []
        for _ in range(400):
            s = [rng.choice("abc") for _ in range(rng.randrange(0, 14))]
            t = list(s)
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(0, len(t) + 1)
                what = rng.randrange(3)
                if what == 0:
                    t.insert(k, rng.choice("abc"))
                elif t and what == 1:
                    t.pop(min(k, len(t) - 1))
                elif t:
                    t[min(k, len(t) - 1)] = rng.choice("abc")
            pairs.append(("".join(s), "".join(t)))
        rows = _share(spark, metric, pairs, radius, 100.0)
        close = [r for r in rows if r["d"] <= radius]
        assert len(close) > 20 and all(r["share"] for r in close), [r for r in close if not r["share"]][:5]


def test_number_date_and_place_keys_miss_nothing(spark):
    rng = random.Random(6)
    near = lambda x, by: x + rng.uniform(-1.5, 1.5) * by
    numbers = [(str(x), str(near(x, 3.0))) for x in (rng.uniform(-50, 50) for _ in range(400))]
    rows = _share(spark, "num", numbers, 1.0, 3.0)
    assert all(r["share"] for r in rows if r["d"] <= 1.0) and not all(r["share"] for r in rows)
    places = []
    for _ in range(1500):
        lat, lon = rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), rng.uniform(-90, -89)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), -180.0])
        other = max(-90.0, min(90.0, near(lat, 0.4)))
        turn = near(lon, rng.choice([0.4, 5, 90]))
        places.append((f"{lat:.6f} {lon:.6f}", f"{other:.6f} {(turn + 180) % 360 - 180:.6f}"))
    rows = _share(spark, "wgs84", places, 50.0)
    close = [r for r in rows if r["d"] <= 50.0]
    assert len(close) > 200 and all(r["share"] for r in close), [r for r in close if not r["share"]][:3]
    assert sum(r["share"] for r in rows) < len(rows)


def test_describe_lists_parameters(spark):
    rows = {(r["kind"], r["id"]): r for r in describe(spark).collect()}
    assert len([k for k in rows if k[0] == "transformer"]) == 17 and len([k for k in rows if k[0] == "metric"]) == 13
    assert [tuple(p) for p in rows["metric", "date"]["parameters"]] == [("maxDays", "int", None)] or rows["metric", "date"]["parameters"][0]["name"] == "maxDays"
