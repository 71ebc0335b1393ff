"""One form for texts that look alike: width forms, accents, invisible characters, spaces, hyphens, ligatures, look-alikes.

The work is done by DuckDB expressions inside Arrow partitions (problem 3).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.cluster import hot_keys

# Letters of Cyrillic and Greek that have the shape of a Latin letter, each above its Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜӀӏаеѕіјорсухһԁԛԝѵ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYGQWIlaesijopcyxhdqwv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν"
GREEK_AS = "ABEZHIKMNOPTYXocjv"
# Hyphens and dashes of a hyphen's look, beside those with a width decomposition.
HYPHENS = "‐‑‒–−˗⁃﹣"
#: Where characters with decompositions and spaces stand: all blocks but those of ideographs, Hangul and private use.
BLOCKS = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x12000), range(0x1D000, 0x20000))
#: Characters that show nothing: format characters, variation selectors, joiners and fillers.
INVISIBLE = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{034F}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{180B}-\x{180F}]"


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Maps by rule: one character to one (width forms, spaces, hyphens), one to several (ligatures), look-alike to Latin."""
    single, several = dict.fromkeys(HYPHENS, "-"), {}
    latin = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True))
    for c in map(chr, (k for block in BLOCKS for k in block)):
        kind = unicodedata.category(c)
        if kind == "Zs":
            single[c] = " "
            continue
        parts = unicodedata.decomposition(c)
        tag = parts.partition(">")[0][1:] if parts.startswith("<") else ""
        if tag in ("wide", "narrow") or (tag and "LIGATURE" in unicodedata.name(c, "") and kind in ("Ll", "Lu")):
            to = unicodedata.normalize("NFKC", c)
            (single if len(to) == 1 else several)[c] = to
        elif parts and not tag:
            plain = unicodedata.normalize("NFD", c)
            if plain[0] in latin and c not in latin:
                to = unicodedata.normalize("NFC", latin[plain[0]] + plain[1:])
                if len(to) == 1:
                    latin[c] = to
    return single, several, latin


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The DuckDB expression that gives a text's one form; null stays null."""
    single, several, latin = tables()
    text = f"translate({column}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for c, to in several.items():
        text = f"replace({text}, {_quoted(c)}, {_quoted(to)})"
    text = f"nfc_normalize(regexp_replace({text}, {_quoted(INVISIBLE)}, '', 'g'))"
    return f"nfc_normalize(translate({text}, {_quoted(''.join(latin))}, {_quoted(''.join(latin.values()))}))"


def normalize_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with ``out``, the one form of its string ``column``. Case, accents and digit signs are kept apart.

    Null stays null, '' stays ''; a text of invisible characters alone becomes ''. Texts are mapped whole, whatever their length.
    All other columns pass through; ``out`` must not be among them.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    ascii_only = F.coalesce(~F.col(column).rlike("[^\\x00-\\x7F]"), F.lit(True))
    sql = f"SELECT {form_sql('__text')} AS __form FROM batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1")
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]).select(["__text"]))
            form = con.sql(sql).to_arrow_table().column("__form").combine_chunks().cast(pa.string())
            con.unregister("batch")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], form], names=[*b.schema.names[:-1], out])

    # ASCII texts are their own form; they stay in the JVM
    plain = df.where(ascii_only).withColumn(out, F.col(column))
    other = df.where(~ascii_only).withColumn("__text", F.col(column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"
    return other.mapInArrow(run, schema).unionByName(plain)


LABELS = ("rdfs:label", "skos:altLabel")


def label_forms(path_values: DataFrame) -> DataFrame:
    """(row_id, value, form) of every label value: nulls and empty sets give nothing, a repeated value of a row counts once."""
    values = path_values.where(F.col("prop_path").isin(*LABELS)).select("row_id", F.explode(F.array_distinct("value_set")).alias("value"))
    return normalize_column(values.where(F.col("value").isNotNull()), "value", "form")


def lookalike_classes(forms: DataFrame, row: str = "row_id", value: str = "value", form: str = "form") -> DataFrame:
    """(form, spellings, members): each form that is written in several ways, with the number of its spellings and of the rows that
    hold one. One row per class, whatever its size; nulls belong to none. lookalike_members() has the rows of the classes."""
    v = forms.select(F.col(form).alias("form"), F.col(value).alias("v"), F.col(row).alias("r")).where("r is not null and v is not null and form is not null")
    # rows are counted by spelling first, so a frequent form is no burden; a row with two spellings counts once
    once = v.groupBy("form", "v", "r").agg(F.lit(1).alias("one"))
    spelt = once.groupBy("form", "v").agg(F.count(F.lit(1)).alias("n"))
    several = spelt.groupBy("form").agg(F.count(F.lit(1)).alias("spellings")).where("spellings > 1")
    held = once.join(several, "form", "left_semi").groupBy("form", "r").agg(F.lit(1).alias("one")).groupBy("form").agg(F.count(F.lit(1)).alias("members"))
    return several.join(held, "form")


def lookalike_members(forms: DataFrame, row: str = "row_id", value: str = "value", form: str = "form") -> DataFrame:
    """(row, form, value) of the rows of lookalike_classes()."""
    several = forms.where(F.col(value).isNotNull() & F.col(row).isNotNull()).groupBy(form).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo <> __hi").select(form)
    return forms.select(row, form, value).where(F.col(row).isNotNull()).join(several, form, "left_semi").distinct().select(row, form, value)


SALTS = 16


def lookalike_pairs(forms: DataFrame, row: str = "row_id", value: str = "value", form: str = "form") -> DataFrame:
    """(row_id_a, row_id_b): rows that hold values of one form but other code points, row_id_a < row_id_b, each pair once.

    lookalike_classes() and lookalike_members() say the same in one row per form and per member. Forms should be a written table, as
    they are read several times. Forms written in one way only are dropped by a map-side minimum and maximum before any pair is made. Forms that hold a large
    share of the rest are joined in SALTS parts, so no task gets one whole. Nulls match nothing.
    """
    v = forms.select(F.col(row).alias("r"), F.col(value).alias("v"), F.col(form).alias("f")).where("r is not null and v is not null and f is not null")
    mixed = v.groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("f")
    some = v.join(mixed, "f", "left_semi").distinct()
    hot = hot_keys(some, "f")
    is_hot = F.col("f").isin(hot) if hot else F.lit(False)
    a = some.withColumn("s", F.when(is_hot, F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int")).otherwise(0))
    b = some.withColumn("s", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.f") == F.col("b.f")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.r") < F.col("b.r")) & (F.col("a.v") != F.col("b.v"))
    return a.join(b, same).select(F.col("a.r").alias("row_id_a"), F.col("b.r").alias("row_id_b")).distinct()
