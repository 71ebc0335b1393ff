"""Transformers: functions on sets of strings. Each factory gives a function of the inputs' Values."""

from __future__ import annotations

import codecs
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions.porter import stem
from linkweave.registry import register
from linkweave.values import Values


def _simple(f):
    """A transformer that maps every value of its first input."""
    return lambda inputs: inputs[0].each(f)


@register("transformer", "replace", "Replace")
def replace(search: str, replace: str):
    return _simple(lambda v: F.replace(v, F.lit(search), F.lit(replace)) if search else v)


@register("transformer", "regexReplace", "Regex replace")
def regex_replace(regex: str, replace: str):
    return _simple(lambda v: F.regexp_replace(v, regex, replace))


@register("transformer", "concat", "Concatenate")
def concat(glue: str = ""):
    """Every combination of a value of each input, joined by glue; nothing if an input has nothing."""

    def crossed(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit(glue), b))))

    def run(inputs: list[Values]) -> Values:
        if not any(i.many for i in inputs):
            out = inputs[0].col
            for i in inputs[1:]:
                out = F.concat(out, F.lit(glue), i.col)
            return Values(out, False)
        out = inputs[0].as_array()
        for i in inputs[1:]:
            out = crossed(out, i.as_array())
        return Values(F.array_distinct(out))

    return run


@register("transformer", "removeBlanks", "Remove blanks")
def remove_blanks():
    return _simple(lambda v: F.replace(v, F.lit(" "), F.lit("")))


@register("transformer", "lowerCase", "Lower case")
def lower_case():
    return _simple(F.lower)


@register("transformer", "upperCase", "Upper case")
def upper_case():
    return _simple(F.upper)


@register("transformer", "numReduce", "Numeric reduce")
def num_reduce():
    return _simple(lambda v: F.regexp_replace(v, "[^0-9]+", ""))


@register("transformer", "alphaReduce", "Alpha reduce")
def alpha_reduce():
    return _simple(lambda v: F.regexp_replace(v, r"[^\pL]+", ""))


@register("transformer", "removeSpecialChars", "Remove special characters")
def remove_special_chars():
    return _simple(lambda v: F.regexp_replace(v, r"[^\d\pL\w]+", ""))


@register("transformer", "stripPrefix", "Strip prefix")
def strip_prefix(prefix: str):
    return _simple(lambda v: F.when(F.startswith(v, F.lit(prefix)), F.substring(v, len(prefix) + 1, 2**31 - 1)).otherwise(v))


@register("transformer", "stripPostfix", "Strip postfix")
def strip_postfix(postfix: str):
    return _simple(lambda v: F.when(F.endswith(v, F.lit(postfix)), F.left(v, F.length(v) - len(postfix))).otherwise(v))


@register("transformer", "stripUriPrefix", "Strip URI prefix")
def strip_uri_prefix():
    return _simple(lambda v: F.regexp_extract(v, r"[^/#]*\z", 0))


def _java_double(v: Column) -> Column:
    """The text as a double the way a JVM parses it; null if it isn't one."""
    return v.try_cast("double")


@register("transformer", "logarithm", "Logarithm")
def logarithm(base: float = 10.0):
    """The logarithm of numbers, as text; other values stay. 0 gives -Infinity, negative numbers NaN."""

    def one(v: Column) -> Column:
        x = _java_double(v)
        log = F.when(x > 0, F.ln(x) / F.lit(math.log(base))).when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
        return F.when(x.isNull(), v).otherwise(log.cast("string"))

    return _simple(one)


@register("transformer", "removeEmptyValues", "Remove empty values")
def remove_empty_values():
    def run(inputs: list[Values]) -> Values:
        v = inputs[0]
        return Values(F.filter(v.col, lambda x: x != ""), True) if v.many else Values(F.when(v.col != "", v.col), False)

    return run


@register("transformer", "tokenize", "Tokenize")
def tokenize(regex: str = r"\s"):
    """The parts between matches, without empty ones at the end; '' has one part, itself."""

    def parts(v: Column) -> Column:
        cut = F.split(v, regex)
        # the last part that isn't empty ends the list; where there is none, only the empty text itself keeps a part
        last = F.array_max(F.transform(cut, lambda p, k: F.when(p != "", k + 1).otherwise(0)))
        return F.when(v == "", F.array(F.lit(""))).otherwise(F.slice(cut, F.lit(1), F.coalesce(last, F.lit(0))))

    return lambda inputs: Values(F.array_distinct(F.flatten(F.transform(inputs[0].as_array(), parts))))


def _per_value(f):
    """A transformer in Python: distinct values of a batch are mapped once."""

    @F.pandas_udf("array<string>")
    def many(col: pd.Series) -> pd.Series:
        known: dict = {}
        return col.map(lambda vs: None if vs is None else [known[v] if v in known else known.setdefault(v, f(v)) for v in vs])

    @F.pandas_udf("string")
    def one(col: pd.Series) -> pd.Series:
        known = {v: f(v) for v in col.dropna().unique()}
        return col.map(known)

    return lambda inputs: Values(F.array_distinct(many(inputs[0].as_array()))) if inputs[0].many else Values(one(inputs[0].col), False)


@register("transformer", "stem", "Porter stemmer")
def stemmer():
    return _per_value(stem)


@register("transformer", "convertCharset", "Convert charset")
def convert_charset(sourceCharset: str = "ISO-8859-1", targetCharset: str = "UTF-8"):  # noqa: N803
    """The text's bytes in the source charset, read in the target charset; what can't be mapped becomes ? or U+FFFD."""
    names = {"x-macroman": "mac_roman", "ibm437": "cp437"}
    source, target = (names.get(c.lower(), c) for c in (sourceCharset, targetCharset))
    codecs.lookup(source), codecs.lookup(target)
    return _per_value(lambda v: v.encode(source, "replace").decode(target, "replace"))
