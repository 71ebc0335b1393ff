"""Look-alike forms, garbled texts, leaks, mixes and pieces, against plain versions."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.cluster import Scratch
from linkweave.llm import charsets, leakage, lookalike, mixing, splitting, tokens
from linkweave.llm.tokens import encode

# ---- look-alike forms

SAME = [("Kafka", "Kafka"), ("Ｋａｆｋａ", "Kafka"), ("Маlovor", "Malovor"), ("Ηarbour", "Harbour"), ("ﬁn Mofiﬆ", "fin Mofist"), ("é", "é"), ("a b", "a b"), ("a　b", "a b"), ("a‑b", "a-b"), ("a－b", "a-b"), ("a​b﻿­", "ab"), ("ﾀﾞｻﾞ", "ダザ"), ("Ё", "Ë"), ("ё", "ë")]
OTHER = [("½", "1/2"), ("②", "2"), ("№", "No"), ("Ⅳ", "IV"), ("Kafka", "kafka"), ("café", "cafe"), ("a  b", "a b")]


def forms(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "form_ int, text string")
    return {r["text"]: r["f"] for r in lookalike.normalize_column(df, "text", "f").collect()}


def test_forms(spark):
    texts = sorted({t for p in SAME + OTHER for t in p})
    f = forms(spark, [*texts, None, "", "​"])
    for a, b in SAME:
        assert f[a] == f[b], (a, b, f[a], f[b])
    for a, b in OTHER:
        assert f[a] != f[b], (a, b)
    assert f[None] is None and f[""] == "" and f["​"] == ""
    long = "Ｘ" * 300_000
    assert forms(spark, [long])[long] == "X" * 300_000
    with pytest.raises(ValueError):
        lookalike.normalize_column(spark.createDataFrame([("a",)], "text string"), "text", "text")
    assert forms(spark, []) == {}


def test_pairs_against_plain(spark):
    rng = random.Random(2)
    variants = ["abc", "аbc", "ａbc", "ab​c", "xyz", "xyz ", "hot", "hоt", "ｈot"]
    data = [(k, rng.choice(["rdfs:label", "skos:altLabel", "rdf:type"]), rng.choice([None, [], [None, ""], [rng.choice(variants)], [rng.choice(variants[6:]), rng.choice(variants)]])) for k in range(300)]
    df = spark.createDataFrame(data, "row_id long, prop_path string, value_set array<string>").withColumn("value", F.lit(1)).withColumn("form", F.lit(2))
    got = sorted(map(tuple, lookalike.lookalike_pairs(lookalike.label_forms(df)).collect()))
    f = forms(spark, variants + [""])
    sets = {r: {v for v in vs if v is not None} for r, p, vs in data if vs and p != "rdf:type"}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if any(f[x] == f[y] and x != y for x in sets[a] for y in sets[b]))
    assert got == want and want
    assert lookalike.lookalike_pairs(lookalike.label_forms(df.limit(0))).count() == 0


# ---- garbled texts

CLEAN = {
    "polish": ["Żółty Świerk Gór", "Łąka Wież", "Pięść Krńsk"], "czech": ["Štěp Řízhra", "Kůl Měs Příhra", "Čkřek Žlu"], "german": ["Grün Mühbach", "Schöne Äcker", "Hofgrün Straße"],
    "french": ["Forêt Noëve", "Châ Lève Té", "Pré Tîl Çon"], "portuguese": ["São Coração", "Põe Mãe", "Nhã Guaça"], "cyrillic": ["Новый Мост", "Река Тиха", "Град Зима Бор"],
    "greek": ["Κηπος Θαλασσα", "Δρόμος Πύλη", "Νησί Ώρα"], "japanese": ["橋石こせ", "森村たか", "山島川の"],
}


def repairer():
    texts, letters, slots = corpus(), {}, np.zeros(charsets.SLOTS, np.int64)
    for t in texts:
        if (name := charsets.language_of(t)) is not None:
            letters.setdefault(name, set()).update(c for c in t if ord(c) > 127)
            np.add.at(slots, charsets._group_slots(t), 1)
    return charsets.Repairer(charsets.train_dictionaries(texts, {k: "".join(sorted(v)) for k, v in letters.items()}, slots))


def corpus():
    rng = random.Random(1)
    words = {k: [w for t in v for w in t.split()] for k, v in CLEAN.items()}
    return [" ".join(rng.choice(ws) for _ in range(rng.randrange(1, 4))) for ws in words.values() for _ in range(150)] + ["red brick hall", "what? a lake", "see note 3"] * 50


def test_repair():
    fix = repairer()
    for texts in CLEAN.values():
        for t in texts:
            assert fix.repair(t) is None, t
            once = t.encode().decode("latin-1")
            twice = once.encode().decode("latin-1")
            assert fix.repair(once)[0] == t and fix.repair(twice)[0] == t
            if not any("　" <= c for c in t):
                assert fix.repair(t.encode().decode("cp437"))[0] == t
    assert fix.repair("Новый Мост".encode("koi8_r").decode("cp1251"))[0] == "Новый Мост"
    assert fix.repair("Град Зима Бор".encode("cp1251").decode("latin-1"))[0] == "Град Зима Бор"
    assert fix.repair("橋石こせ".encode("shift_jis").decode("latin-1"))[0] == "橋石こせ"
    assert fix.repair("Forêt " + "Noëve".encode().decode("latin-1"))[0] == "Forêt Noëve"
    for lost in ("Gr?n M?hbach", "S�o", "?t?p", "Pi??"):
        assert fix.repair(lost) == (None, "lost")
    for right in ("what? a lake", "red brick hall", "± 5 m 70", "£ 20 fee", "© hall trust", "21 °C", "IRMÃ Ã ROSA", "Ångvik ½", "¿Dónde? Ñuro 12", "", "  "):
        assert fix.repair(right) is None, right


def test_garbled_values(spark):
    good = corpus()
    bad = ["SÃ£o".encode().decode(), "ÐœÐ¾ÑÑ‚ Ð¢Ð¸Ñ…Ð°"]
    data = [(k, [t]) for k, t in enumerate(good)] + [(9001, [None, "", bad[0]]), (9002, None), (9003, []), (9001, [bad[0]]), (9004, ["ok", "S?o T?l"]), (9005, ["Noite Gua?"]), (9006, ["Guaç"]), (9007, ["why not? a lake"])]
    df = spark.createDataFrame(data, "value_id long, value_set array<string>").withColumn("text", F.lit("x")).withColumn("chain", F.lit("y"))
    got = charsets.garbled_values(df).collect()
    assert {r["value_id"] for r in got} == {9001, 9004, 9005} and [r["restored"] for r in got if r["value_id"] == 9001] == ["São", "São"]
    assert charsets.garbled_values(df.limit(0)).count() == 0


def test_dictionaries_train_on_all_texts(spark, monkeypatch):
    rng = random.Random(6)
    parts = ["żół", "świ", "gór", "łąk", "wie", "pię", "krń", "mos", "dąb", "rze"]
    texts = list({" ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(2)) for _ in range(6000)}) + ["red brick hall", "see note", "S?o"]
    df, scratch = spark.createDataFrame([(t,) for t in texts], "t string"), Scratch(spark, "test")
    _, letters, slots = charsets.text_statistics(df, "t")
    trained = charsets.dictionaries_of_all(df, "t", letters, slots, scratch)
    assert trained == charsets.train_dictionaries(texts, letters, slots) and set(trained) == {"polish", "plain"}
    # in several rounds of small groups, every text counts still
    monkeypatch.setattr(charsets, "AT_ONCE", 700)
    monkeypatch.setattr(charsets, "DICTIONARY_BYTES", 4096)
    data, known = charsets.dictionaries_of_all(df, "t", letters, slots, scratch)["polish"]
    assert len(data) <= 4096 and known == trained["polish"][1] and all(p.encode() in data for p in parts)
    fix = charsets.Repairer({"polish": (data, known)})
    for t in texts[:200]:
        assert fix.repair(t) is None and fix.repair(t.encode().decode("latin-1"))[0] == t


def test_long_text_is_tried_whole():
    fix = repairer()
    long = "Forêt Noëve " * 3000
    assert fix.repair(long) is None and fix.repair(long + "Pré".encode().decode("latin-1"))[0] == long + "Pré"


# ---- leaks


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_leaks_against_plain(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(leakage, "SHARD_CHARS", 3000)
    vocab = ["alpha", "beta", "gamma", "Été", "δ", "42"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n# ", "-", "__"]) for _ in range(n))
    items = [(k, text(rng.randrange(0, 40))) for k in range(25)] + [(90, None), (91, ""), (0, "again " * 3)]
    docs = [(k, text(rng.randrange(0, 120))) for k in range(80)] + [(900, None), (901, ""), (902, "word " * 50_000)]
    for k in range(80, 110):
        w = words(rng.choice(items[:25])[1])
        n = rng.choice([11, 12, 13, 30])
        docs.append((k, text(5) + ". " + "; ".join(w[:n]).upper() + " ! " + text(5)))
    docs.append(docs[-1])
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = {(d, i) for d, t in docs if t is not None for i, u in items if u is not None and grams(words(t), 12) & grams(words(u), 12)}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit("y"))
    got = leakage.find_leaks(d, i)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and len(want) > 10
    # blocks of items give the same
    monkeypatch.setattr(leakage, "ITEM_CHARS", 300)
    assert {tuple(r) for r in leakage.find_leaks(d, i).collect()} == want
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


def test_near_against_plain(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40)))) for k in range(60)]
    items = [(0, "a b c"), (1, "h g"), (2, "a z"), (3, "")]
    close = lambda t, u: any(set(u) <= set(t[k : k + 6]) for k in range(len(t)))
    want = {(d, i) for d, t in docs for i, u in items if words(u) and close(words(t), words(u))}
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=6)
    assert {tuple(r) for r in got.collect()} == want and want


def test_index_holds_every_word(spark):
    index = leakage.build_index(spark.createDataFrame([(5, "A b a"), (6, "c")], "doc_id long, text string").coalesce(1), "doc_id", "text").first()
    s = leakage._Shard(index.asDict())
    assert s.of("a").tolist() == [0, 2] and s.of("b").tolist() == [1] and s.of("c").tolist() == [4] and s.ids.tolist() == [5, 6]


# ---- mixes


def test_mix(spark):
    rng = random.Random(11)
    data = [(k, "many", " ".join(["word"] * rng.randrange(1, 60))) for k in range(900)]
    data += [(1000 + k, "few", "x " * 200) for k in range(3)] + [(2000 + k, "mid", "tok en " * rng.randrange(5, 40)) for k in range(120)]
    data += [(3000, None, "left out"), (3001, "unknown", "left out"), (3002, "many", None), (3003, "many", ""), (5, "many", "same id again")]
    targets = [("many", 0.3, 2), ("few", 0.2, 4), ("mid", 0.4, 5), ("absent", 0.1, 3)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("rate", F.lit(7)).withColumn("n_tokens", F.lit(0))
    repeats, report = mixing.mix_sources(docs, spark.createDataFrame(targets, "source string, target_weight double, max_repeats int"))
    tokens = collections.Counter()
    for _, s, t in data:
        tokens[s] += len(encode(t)) if t else 0
    total = sum(tokens[s] for s, *_ in targets)
    rows = {r["source"]: r for r in report.collect()}
    rep = [tuple(r) for r in repeats.collect()]
    for s, w, m in targets:
        r = rows[s]
        assert r["tokens"] == tokens[s] and r["falls_short"] == (tokens[s] * m < w * total)
        rate = min(m, w * total / tokens[s]) if tokens[s] else 0
        mine = [x for x in rep if x[0] == s]
        assert all(x[3] in (int(rate), int(rate) + 1) and x[3] <= m for x in mine)
        assert r["emitted_tokens"] == sum(x[2] * x[3] for x in mine)
        if tokens[s]:
            # copies in all are the expected number, rounded; tokens come close as sizes are sampled evenly
            n = sum(1 for _, src, _ in data if src == s)
            assert abs(sum(x[3] for x in mine) - rate * n) <= 1 and abs(r["emitted_tokens"] - min(w * total, m * tokens[s])) <= 0.05 * w * total + 60
    assert abs(sum(r["actual_share"] for r in rows.values()) - 1) < 1e-9 and rows["absent"]["falls_short"] and rows["few"]["falls_short"]
    again = mixing.mix_sources(docs.repartition(7), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int"))[0]
    assert sorted(map(tuple, again.collect())) == sorted(rep)
    none = mixing.mix_sources(docs.limit(0), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int"))
    assert none[0].count() == 0 and none[1].count() == 4


# ---- pieces


def check_pieces(text, limit, overlap):
    n, pieces = splitting.split_text(text, limit, overlap)
    assert n == len(encode(text)) and all(k == len(encode(p)) <= limit for p, k, _ in pieces)
    starts = [s for *_, s in pieces] + [len(text)]
    assert starts[0] == 0 and starts == sorted(set(starts)) or len(pieces) == 1
    for k, (p, _, s) in enumerate(pieces):
        own = text[s : starts[k + 1]]
        assert p.endswith(own)
        if k:
            repeated = p[: len(p) - len(own)]
            assert text[:s].endswith(repeated) and overlap - 4 <= len(encode(repeated)) <= overlap + 6
    return pieces


@pytest.mark.parametrize("seed", range(4))
def test_pieces_round_trip(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(["value", "größer", "橋の", "x=1", "    indent", "🙂"]) for _ in range(rng.randrange(0, 30)))
    cells = lambda: rng.choice(["# %% [3]", "In [2]:", "```text", "Out[3]:"]) + "\n" + "\n".join(line() for _ in range(rng.randrange(1, 4))) + "\n\n"
    text = "".join(cells() for _ in range(90))
    pieces = check_pieces(text, 400, 40)
    assert len(pieces) > 3
    # most cuts are at cells or blank lines, as cells are far smaller than a piece
    natural = sum(1 for *_, s in pieces[1:] if splitting.CELL_MARK.match(text[s:].encode()) or text[:s].endswith("\n\n"))
    assert natural >= 0.8 * (len(pieces) - 1)


@pytest.mark.parametrize("text", ["a" * 40_000, "橋" * 3000, "🙂é" * 2000, "word " * 6000, "\n" * 9000, " " * 9000, "ab\r\n" * 4000, "x" * 250_000])
def test_pieces_of_odd_texts(text):
    check_pieces(text, 1024, 100)


def test_short_texts_are_one_piece():
    assert splitting.split_text("") == (0, [("", 0, 0)]) and splitting.split_text("one")[1] == [("one", 1, 0)]
    with pytest.raises(ValueError):
        splitting.split_text("a b c d e f g h " * 9, 20, 20)


def test_weak_boundaries_merge_first():
    # four atoms: the strongest boundary is in the middle, so both halves are whole
    assert splitting.merge_atoms([3, 3, 3, 3], [4, 1, 4, 1], 7, 7) == [0, 2]
    assert splitting.merge_atoms([5, 5, 5], [4, 2, 1], 10, 10) == [0, 1] and splitting.merge_atoms([], [], 5, 5) == []
    rng = random.Random(1)
    for _ in range(200):
        sizes, strength = [rng.randrange(1, 9) for _ in range(30)], [rng.randrange(5) for _ in range(30)]
        cuts = splitting.merge_atoms(sizes, strength, 20, 15)
        sums = [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:] + [30], strict=True)]
        assert cuts[0] == 0 and sums[0] <= 20 and all(s <= 15 for s in sums[1:])
        # no two neighbours could still be merged
        assert all(x + y > (20 if k == 0 else 15) for k, (x, y) in enumerate(zip(sums, sums[1:], strict=False)))


def test_split_documents(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (4, "line of words\n" * 2000), (4, "line of words\n" * 2000)], "doc_id long, text string").withColumn("piece", F.lit("x"))
    got = collections.Counter((r["doc_id"], r["n_pieces"]) for r in splitting.split_documents(docs).collect())
    n = len(splitting.split_text("line of words\n" * 2000)[1])
    assert got == {(1, 1): 1, (3, 1): 1, (4, n): 2 * n} and n > 1
    assert splitting.split_documents(docs.limit(0)).count() == 0


def test_whitespace_runs_count_as_in_the_whole_text():
    whole = tokens.encoder()
    rng = random.Random(4)
    for _ in range(40):
        t = "".join(rng.choice(["ab ", "x", "\n", " é", "1", "\t", " " * rng.randrange(5000, 6000), "\n" * 5001, "　" * 5002]) for _ in range(rng.randrange(1, 20)))
        assert encode(t) == whole.encode_ordinary(t)
    assert len(encode("a" + "\n" * 2_000_000 + "b")) > 1


def test_short_texts_have_their_token_counts(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["piece_tokens"], r["piece"]) for r in splitting.split_documents(docs).collect()}
    assert got == {1: (2, 2, "two words"), 2: (0, 0, "")}


def test_leaks_with_more_items_than_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(12)], "doc_id long, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    monkeypatch.setattr(leakage, "ITEM_CHARS", 300)
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).collect())
    assert got == [(k, k) for k in range(12)]
    assert sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items, window=25).collect()) == got
    assert leakage.find_leaks(docs, items, window=15).count() == 0


def test_classes_of_lookalikes(spark):
    rows = [(1, "a", "f"), (2, "á", "f"), (2, "a", "f"), (3, "a", "f"), (4, "b", "g"), (None, "c", "g"), (5, None, "g")]
    forms = spark.createDataFrame(rows, "row_id long, value string, form string")
    assert [tuple(r) for r in lookalike.lookalike_classes(forms).collect()] == [("f", 2, 3)]
    assert sorted(map(tuple, lookalike.lookalike_members(forms).collect())) == [(1, "f", "a"), (2, "f", "a"), (2, "f", "á"), (3, "f", "a")]
    assert lookalike.lookalike_classes(forms.limit(0)).count() == 0
