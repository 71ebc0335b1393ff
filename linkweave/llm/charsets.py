"""Texts garbled by a wrong charset: candidate decodings and the shortest description of them (problem 4)."""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.cluster import Scratch

# The letters beyond ASCII of the languages that get a dictionary each, and its lower-case alphabet's scripts.
ALPHABETS = {
    "polish": "ąćęłńóśźż",
    "czech": "áčďéěíňóřšťúůýž",
    "turkish": "çğıöşüâîû",
    "german": "äöüß",
    "french": "àâæçèéêëîïôùûüÿœ",
    "portuguese": "àáâãçéêíóôõúü",
}
SCRIPTS = {"cyrillic": ("CYRILLIC",), "greek": ("GREEK",), "japanese": ("HIRAGANA", "KATAKANA", "CJK", "KATAKANA-HIRAGANA"), "vietnamese": ("LATIN",)}
VIETNAMESE_BASE, VIETNAMESE_MARKS = set("aeiouyd"), set("̛̣̀́̂̃̆̉")

# Charsets in which UTF-8 may have been read, and pairs (read as, written in) of other charsets.
READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "koi8_r", "cp437", "cp850", "cp852", "cp866", "mac_roman", "shift_jis")
SINGLE = ("cp1252", "latin_1", "cp1250", "cp1251", "koi8_r", "cp437", "cp850", "mac_roman")
WRITTEN_IN = ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "iso8859_7", "cp1250", "iso8859_2", "cp1254", "shift_jis", "euc_jp", "cp437", "cp850", "mac_roman", "cp1252")

#: Bytes that a step of a chain costs beside the text it gives: one that undoes UTF-8, whose bytes prove themselves, and
#: one between other charsets, which nearly any text can take.
UTF8_COST, OTHER_COST = 1, 3
#: A text must get this many bytes shorter, steps included, to count as garbled.
MARGIN = 1
#: Texts that train a dictionary at once, about; of a language with more, each such group trains one, and what these hold trains on.
#: Texts longer than PART characters count in parts, each for itself, so a task holds AT_ONCE x PART characters or about.
AT_ONCE, PART = 20_000, 1024
#: Counters of three-letter groups.
SLOTS = 1 << 16
DICTIONARY_BYTES, LEVEL = 16384, 6
#: A trained dictionary's tables end before this byte; behind them stand pieces of texts.
TABLES_END = 256

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: A question mark or replacement character that stands for a letter: before one, or twice in a row beside one.
LOST = re.compile("�|(?<![^\\W\\d_]\\s)\\?+(?=[^\\W\\d_])|(?<=[^\\W\\d_])\\?{2,}")


@lru_cache(maxsize=None)
def _bytes_of(charset: str) -> dict[str, int]:
    """Byte of each character of a one-byte charset; control characters stand for the bytes the charset leaves free."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _charmap(charset: str) -> dict[int, int]:
    return {ord(c): b for c, b in _bytes_of(charset).items()}


@lru_cache(maxsize=None)
def _utf8_shape(charset: str) -> re.Pattern:
    """What the first two bytes of a UTF-8 sequence look like when read in the charset."""
    first, then = ("".join(re.escape(c) for c, b in _bytes_of(charset).items() if b in r) for r in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return re.compile(f"[{first}][{then}]")


@lru_cache(maxsize=1)
def _any_utf8_shape() -> re.Pattern:
    """What the first two bytes of a UTF-8 sequence look like when read in any of the one-byte charsets."""
    first, then = ("".join(re.escape(x) for x in sorted({x for c in READ_AS if c != "shift_jis" for x, b in _bytes_of(c).items() if b in r})) for r in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return re.compile(f"[{first}][{then}]")


_JAPANESE = re.compile("[\u3000-\u9fff\uff00-\uffef]")


def _may_be_utf8(text: str) -> list[str]:
    """The charsets in which UTF-8 may have been read to give the text."""
    some = [c for c in READ_AS if c != "shift_jis" and _utf8_shape(c).search(text)] if _any_utf8_shape().search(text) else []
    return [*some, "shift_jis"] if _JAPANESE.search(text) else some


def _raw(text: str, charset: str) -> bytes | None:
    """The bytes that, read in the charset, gave the text; None if there are none."""
    if charset == "shift_jis":
        try:
            return text.encode(charset)
        except UnicodeEncodeError:
            return None
    try:
        return codecs.charmap_encode(text, "strict", _charmap(charset))[0]
    except UnicodeEncodeError:
        return None


def _utf8_parts(text: str, charset: str) -> str:
    """The text with every stretch put right that reads as UTF-8 once it is bytes again; the rest stays."""
    if charset == "shift_jis":
        raw = _raw(text, charset)
        try:
            return text if raw is None else raw.decode()
        except UnicodeDecodeError:
            return text
    table, out, n, i = _bytes_of(charset), [], len(text), 0
    while i < n:
        j = i
        while j < n and text[j] in table:
            j += 1
        raw, last = bytes([table[c] for c in text[i:j]]), 0
        for m in _UTF8.finditer(raw):
            try:
                good = m.group().decode()
            except UnicodeDecodeError:
                continue
            out.append(text[i + last : i + m.start()])
            out.append(good)
            last = m.end()
        out.append(text[i + last : j])
        out.append(text[j : j + 1])
        i = j + 1
    return "".join(out)


class Steps:
    """Steps between charsets that can turn a text into one of known letters; member(letter) gives the sets that have the letter.

    For each letter beyond ASCII three bit masks are kept over (read as, written in, set): where the letter's byte is a letter of
    the set in the other charset, where it is one as it stands, and the charsets that have it. Their conjunction over a text's letters
    leaves few steps to try. Charsets of several bytes are always tried."""

    def __init__(self, member: Callable[[str], frozenset[int]], sets: int):
        self.member, self.sets, self.of = member, sets, {}
        self.all = (1 << len(SINGLE) * len(WRITTEN_IN) * sets) - 1

    def _bits(self, c: int, to: int, sets) -> int:
        return sum(1 << ((c * len(WRITTEN_IN) + to) * self.sets + k) for k in sets)

    def masks(self, letter: str) -> tuple[int, int, int]:
        if letter not in self.of:
            mapped = has = 0
            stays, every = self.member(letter), range(self.sets)
            stay = sum(self._bits(c, to, stays) for c in range(len(SINGLE)) for to in range(len(WRITTEN_IN)))
            for c, charset in enumerate(SINGLE):
                byte = _bytes_of(charset).get(letter)
                if byte is None:
                    continue
                for to, other in enumerate(WRITTEN_IN):
                    has |= self._bits(c, to, every)
                    if other in ("shift_jis", "euc_jp"):
                        mapped |= self._bits(c, to, every)
                        continue
                    try:
                        mapped |= self._bits(c, to, self.member(bytes([byte]).decode(other)))
                    except UnicodeDecodeError:
                        pass
            self.of[letter] = mapped, stay, has
        return self.of[letter]

    def tried(self, text: str) -> dict[str, str]:
        """What the text, or each of its words for itself, can have been between one-byte charsets, and the step."""
        found: dict[str, str] = {}
        words = [w for w in re.split(r"(\s+)", text) if w]
        left, changed = self.all, 0
        for w in words:
            if w.isascii():
                continue
            mapped = stay = has = self.all
            for letter in {x for x in w if ord(x) > 127}:
                m, k, h = self.masks(letter)
                mapped, stay, has = mapped & m, stay & k, has & h
            left &= (mapped & has) | (stay & ~has)
            changed |= has
            if not left:
                return found
        left &= changed
        while left:
            at = (left & -left).bit_length() - 1
            step = at // self.sets
            left &= ~(((1 << self.sets) - 1) << step * self.sets)
            c, to = SINGLE[step // len(WRITTEN_IN)], WRITTEN_IN[step % len(WRITTEN_IN)]
            if c == to:
                continue
            raw = _raw(text, c)
            try:
                if raw is not None:
                    good = raw.decode(to)
                else:
                    good = "".join(w if w.isascii() or (r := _raw(w, c)) is None else r.decode(to) for w in words)
            except UnicodeDecodeError:
                continue
            if good != text and good not in found:
                found[good] = f"{c}>{to}"
        return found


def candidates(text: str, steps: Steps) -> dict[str, tuple[str, ...]]:
    """Candidate texts and the shortest chain of steps to each: UTF-8 read in another charset, any number of times over, in part or
    as a whole; a text, or single words of it, read in a one-byte charset but written in another one; and both in any order, the
    latter once. Steps that undo UTF-8 shorten the text, so chains end."""
    found: dict[str, tuple[str, ...]] = {text: ()}
    layer = {text: ()}
    while layer:
        after = {}
        for t, chain in layer.items():
            if t.isascii():
                continue
            for c in _may_be_utf8(t):
                good = _utf8_parts(t, c)
                if good not in found and good not in after:
                    after[good] = (*chain, f"{c}>utf_8")
            if all(x.endswith(">utf_8") for x in chain):
                for good, step in steps.tried(t).items():
                    if good not in found and good not in after:
                        after[good] = (*chain, step)
        found |= after
        layer = after
    del found[text]
    return found


def language_of(text: str) -> str | None:
    """The language whose alphabet holds all of the text's letters, the smallest alphabet first; None if none does.

    Texts in ASCII letters are 'plain'. Symbols and control characters beyond ASCII belong to no language's text."""
    special = {c for c in text.lower() if ord(c) > 127}
    if not special:
        return "plain"
    for name in sorted(ALPHABETS, key=lambda k: len(ALPHABETS[k])):
        if special <= set(ALPHABETS[name]):
            return name
    if all(c.isalpha() or c == "ー" for c in special):
        names = {unicodedata.name(c, "?").split()[0].split("-")[0] for c in special}
        for script in ("cyrillic", "greek", "japanese"):
            if names <= set(SCRIPTS[script]):
                return script
        parts = set("".join(unicodedata.normalize("NFD", c.replace("đ", "d")) for c in special))
        if parts <= VIETNAMESE_BASE | VIETNAMESE_MARKS:
            return "vietnamese"
    return None


@lru_cache(maxsize=None)
def _alphabets_of(letter: str) -> frozenset[int]:
    """The languages, by number, that may have the letter."""
    low, out = letter.lower(), set()
    names = [*ALPHABETS, *SCRIPTS]
    for k, name in enumerate(names):
        if name in ALPHABETS:
            if set(low) <= set(ALPHABETS[name]):
                out.add(k)
        elif name == "vietnamese":
            if low != "" and set(unicodedata.normalize("NFD", low.replace("đ", "d"))) <= VIETNAMESE_BASE | VIETNAMESE_MARKS:
                out.add(k)
        elif low == "ー" or (low.isalpha() and unicodedata.name(low[0], "?").split()[0].split("-")[0] in SCRIPTS[name]):
            out.add(k)
    return frozenset(out)


def _group_slots(text: str) -> np.ndarray:
    """Slots of the text's groups of three letters, with a space before and behind it."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(31))) & np.uint64(SLOTS - 1)).astype(np.int64)


class Describer:
    """Description lengths of texts: bytes of their zstandard frames under per-language dictionaries."""

    def __init__(self, dictionaries: dict[str, tuple[bytes, str]]):
        import zstandard as z

        self.by = {}
        for name, (data, letters) in dictionaries.items():
            d = z.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            how = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
            c = z.ZstdCompressor(dict_data=d, compression_params=how)
            # the encoder looks for no match in the last bytes; a known ending makes them those of the ending
            end = b"\n" + data[-64:]
            self.by[name] = (c, end, len(c.compress(end)), set(letters))

    def length(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        special = {c for c in text if ord(c) > 127}
        least = len(raw) + 1
        for name, (c, end, base, letters) in self.by.items():
            # a dictionary that knows none of the text's letters can't make it much shorter than its bytes
            if name == "plain" or special & letters:
                least = min(least, len(c.compress(raw + end)) - base)
        return least

    def known(self, text: str) -> bool:
        """Whether some language has all the letters of the text."""
        special = {c for c in text if ord(c) > 127}
        return any(special <= letters for _, _, _, letters in self.by.values())


def text_statistics(texts: DataFrame, column: str) -> tuple[dict[str, int], dict[str, str], np.ndarray]:
    """Of all texts: the number in each language, the letters beyond ASCII seen in each, and counts of three-letter groups.

    Groups are counted in SLOTS slots by hash, so what comes to the driver is of fixed size whatever the texts. Texts with
    letters of no language, or with lost letters, don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, letters, slots = Counter(), Counter(), np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if (name := language_of(t)) is not None and not LOST.search(t):
                    texts[name] += 1
                    letters.update((name, c) for c in set(t) if ord(c) > 127)
                    slots += np.bincount(_group_slots(t), minlength=SLOTS) if len(t) > 1000 else 0
                    if len(t) <= 1000:
                        np.add.at(slots, _group_slots(t), 1)
        at = np.flatnonzero(slots)
        rows = [("text", k, 0, n) for k, n in texts.items()] + [("letter", k, ord(c), n) for (k, c), n in letters.items()]
        rows += zip(["group"] * len(at), [""] * len(at), at.tolist(), slots[at].tolist(), strict=True)
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["kind", "name", "at", "n"])

    counted = texts.select(column).mapInArrow(run, "kind string, name string, at bigint, n bigint").groupBy("kind", "name", "at").agg(F.sum("n").alias("n"))
    languages, letters, slots = {}, {}, np.zeros(SLOTS, np.int64)
    for r in counted.collect():  # SLOTS rows at most, and one per language and letter
        if r["kind"] == "text":
            languages[r["name"]] = r["n"]
        elif r["kind"] == "letter":
            letters.setdefault(r["name"], []).append(chr(r["at"]))
        else:
            slots[r["at"]] = r["n"]
    return languages, {k: "".join(sorted(v)) for k, v in letters.items()}, slots


class Trains:
    """Whether a text trains its language's dictionary.

    Texts with letters of no language, or with lost letters, don't. Nor does a text that another charset turns into one whose
    three-letter groups are at least twice as common among all texts: it is likely garbled itself."""

    def __init__(self, slots: np.ndarray):
        self.steps, self.common = Steps(_alphabets_of, len(ALPHABETS) + len(SCRIPTS)), np.log1p(slots)

    def usual(self, text: str) -> float:
        return float(self.common[_group_slots(text)].mean())

    def language(self, text: str) -> str | None:
        """The text's language if it trains."""
        name = language_of(text)
        if name is None or LOST.search(text):
            return None
        if name != "plain":
            least = None
            for c in self.steps.tried(text):
                if language_of(c) is not None:
                    least = self.usual(text) + math.log(2) if least is None else least
                    if self.usual(c) >= least:
                        return None
        return name


def _dictionary(texts: list[str], size: int) -> tuple[bytes, bool]:
    """The dictionary trained on texts of a language, and True; where they are too few, themselves."""
    import zstandard as z

    samples = [t.encode() + b"\n" for t in sorted(texts)]
    try:
        return z.train_dictionary(size, samples, level=LEVEL).as_bytes(), True
    except z.ZstdError:
        return b"".join(samples)[-size:], False


def train_dictionaries(texts: list[str], letters: dict[str, str], slots: np.ndarray) -> dict[str, tuple[bytes, str]]:
    """A dictionary per language with enough texts, beside the letters seen; few texts serve as a dictionary themselves."""
    trains, groups = Trains(slots), {}
    for t in texts:
        if (name := trains.language(t)) is not None:
            groups.setdefault(name, []).append(t)
    return {name: (_dictionary(of, DICTIONARY_BYTES)[0], letters.get(name, "")) for name, of in groups.items()}


def dictionaries_of_all(texts: DataFrame, column: str, letters: dict[str, str], slots: np.ndarray, scratch: Scratch) -> dict[str, tuple[bytes, str]]:
    """train_dictionaries() of all texts, trained in tasks.

    A language of at most AT_ONCE texts is trained on them in one go. The texts of others fall into groups of about that many by
    hash, each group trains a dictionary on all its texts, and the pieces that the groups' dictionaries hold are the texts of the
    next round, which are fewer than half as many. Only the last dictionaries come to the driver."""
    size = DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trains = Trains(slots)
        for b in batches:
            of = [(name, t) for t in b.column(0).to_pylist() if (name := trains.language(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in of], pa.string()) for k in (0, 1)], names=["name", "t"])

    def condensed(key: tuple, group: pa.Table) -> pa.Table:
        data, trained = _dictionary(group.column("t").to_pylist(), size)
        pieces = [t for t in data[TABLES_END if trained else 0 :].decode(errors="ignore").split("\n") if t]
        return pa.table({"name": pa.array([key[0].as_py()] * len(pieces), pa.string()), "t": pa.array(pieces, pa.string())})

    def last(key: tuple, group: pa.Table) -> pa.Table:
        data, _ = _dictionary(group.column("t").to_pylist(), size)
        return pa.table({"name": pa.array([key[0].as_py()], pa.string()), "data": pa.array([data], pa.binary())})

    rows = scratch.cut(texts.select(column).mapInArrow(run, "name string, t string"))
    while many := {r["name"]: -(-r["count"] // AT_ONCE) for r in rows.groupBy("name").count().collect() if r["count"] > AT_ONCE}:
        groups = F.create_map(*[F.lit(x) for k, n in many.items() for x in (k, n)])
        parted = rows.where(F.col("name").isin(*many)).withColumn("part", F.pmod(F.xxhash64("t"), F.element_at(groups, F.col("name"))))
        rows = scratch.cut(rows.where(~F.col("name").isin(*many)).unionByName(parted.groupBy("name", "part").applyInArrow(condensed, "name string, t string")))
    return {r["name"]: (r["data"], letters.get(r["name"], "")) for r in rows.groupBy("name").applyInArrow(last, "name string, data binary").collect()}


class Repairer:
    def __init__(self, dictionaries: dict[str, tuple[bytes, str]]):
        self.describe = Describer(dictionaries)
        sets = [letters for *_, letters in self.describe.by.values()]
        self.steps = Steps(lambda c: frozenset(k for k, v in enumerate(sets) if c in v), max(1, len(sets)))

    def repair(self, text: str) -> tuple[str | None, str] | None:
        """(the original text, the chain) of a garbled text; None for a text that stays. Lost letters have no original."""
        if LOST.search(text):
            return None, "lost"
        if not text.isascii():
            own, best = self.describe.length(text), None
            for good, chain in candidates(text, self.steps).items():
                known = self.describe.known(good)
                if not known and not chain[-1].endswith(">utf_8"):
                    continue  # no language's text: its bytes would be its length, which can't repay the step
                steps = sum(UTF8_COST if x.endswith(">utf_8") else OTHER_COST for x in chain)
                cost = self.describe.length(good) + steps + (0 if known else OTHER_COST)
                if cost + MARGIN <= own and (best is None or (cost, good) < best[:2]):
                    best = (cost, good, chain)
            if best:
                return best[1], " ".join(best[2])
        return None


def repair_texts(df: DataFrame, column: str, dictionaries: dict[str, tuple[bytes, str]]) -> DataFrame:
    """The rows of df whose text is garbled, with ``restored`` (null where letters are lost) and ``chain``, the steps undone.

    Texts in ASCII without a question mark can't be garbled and stay in the JVM; null texts are no texts. Whole texts are tried.
    """
    suspects = df.where(F.col(column).rlike("[^\\x00-\\x7F]|\\?"))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repairer(dictionaries)
        known: dict[str, tuple | None] = {}
        for b in batches:
            keep, restored, chain = [], [], []
            for k, t in enumerate(b.column(at).to_pylist()):
                if t not in known:
                    if len(known) > 100_000:  # a cache, no result
                        known.clear()
                    known[t] = fix.repair(t)
                if (r := known[t]) is not None:
                    keep.append(k)
                    restored.append(r[0])
                    chain.append(r[1])
            rows = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(restored, pa.string()), pa.array(chain, pa.string())], names=[*b.schema.names, "restored", "chain"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", restored string, chain string"
    return suspects.mapInArrow(run, schema)


def lost_endings(texts: DataFrame, distinct: DataFrame, column: str) -> DataFrame:
    """The rows of texts in which a question mark at a word's end stands for a letter, since the word with a letter beyond ASCII in
    its place is a word of some text. restored is null, chain 'lost'. Whether it is one is looked up by a join over all words."""
    words = distinct.select(F.explode(F.split(F.lower(column), r"[^\p{L}\p{M}]+")).alias("w")).where(F.col("w").rlike(r"[^\x00-\x7F]$"))
    stems = words.select(F.expr("substring(w, 1, length(w) - 1)").alias("stem")).distinct()
    marked = texts.where(F.col("text").rlike(r"\p{L}\?(\s|$)"))
    ends = marked.select("value_id", "text", F.explode(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}+)\\?(\\s|$)', 1)")).alias("stem"))
    none = F.lit(None).cast("string")
    return ends.join(stems, "stem", "left_semi").select("value_id", "text").distinct().withColumn("restored", none).withColumn("chain", F.lit("lost"))


def garbled_values(values: DataFrame) -> DataFrame:
    """(value_id, text, restored, chain) of the garbled texts of input_values, each text of a row once.

    Letters and three-letter groups are counted over all distinct texts, and a dictionary for each language is trained on all of
    its texts, of which those longer than PART characters count in parts, each for itself. Every text is then tried against every candidate decoding, whatever source_charset says. Null or empty value_set, null and ''
    values give nothing; rows logged twice each give their rows; an empty table gives none.
    """
    scratch = Scratch(values.sparkSession, "charsets")
    texts = values.select("value_id", F.explode(F.array_distinct("value_set")).alias("text")).where("text is not null and text <> ''")
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(PART))
    parts = F.when(F.length("text") <= PART, F.array("text")).otherwise(F.transform(starts, lambda k: F.substring("text", k, F.lit(PART))))
    distinct = scratch.cut(texts.select(F.explode(parts).alias("t")).distinct())
    _, letters, slots = text_statistics(distinct, "t")
    found = scratch.cut(repair_texts(texts, "text", dictionaries_of_all(distinct, "t", letters, slots, scratch)))
    return found.unionByName(lost_endings(texts, distinct, "t").join(found.select("value_id", "text"), ["value_id", "text"], "left_anti"))
