"""Evaluation passages inside training documents: a distributed positional inverted index (problem 7)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.cluster import Scratch

#: A word is a run of letters and digits; everything else separates (fixed pattern).
SEPARATOR = r"[^\p{L}\p{N}]+"
#: An index shard takes documents until it has this many characters (a longer document is a shard of its own).
SHARD_CHARS = 4_000_000
#: Items are searched in blocks of at most this many characters, so what each task holds of them is bounded.
ITEM_CHARS = 8_000_000

INDEX_SCHEMA = "shard bigint, doc_ids array<bigint>, starts array<int>, terms array<string>, ends array<int>, positions binary"


def words_of(texts: pa.Array) -> pa.ListArray:
    """Words of each text, lower case; null and empty texts have none. Empty strings may stand at both ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.split_pattern_regex(pc.utf8_lower(texts), SEPARATOR)


def _shard(ids: list, texts: list, shard: int, vocabulary: pa.Array | None) -> pa.RecordBatch:
    lists = words_of(pa.array(texts, pa.large_string()))
    words = lists.flatten()
    real = pc.not_equal(words, "")
    doc_of = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)]
    words = words.filter(real)
    # one position is left free between documents, so no phrase runs from one into the next
    position = np.arange(len(words), dtype=np.int64) + doc_of
    counts = np.bincount(doc_of, minlength=len(ids))
    starts = np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
    if vocabulary is not None:
        code = pc.index_in(words, vocabulary)
        held = code.is_valid().to_numpy(zero_copy_only=False)
        code, terms = code.drop_null().to_numpy(zero_copy_only=False), vocabulary
        position = position[held]
    else:
        encoded = words.dictionary_encode()
        code, terms = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    order = np.argsort(code, kind="stable")
    sizes = np.bincount(code, minlength=len(terms))
    there = np.flatnonzero(sizes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([terms.take(pa.array(there)).to_pylist()], pa.list_(pa.string())),
            pa.array([np.cumsum(sizes[there]).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([position[order].astype("<i4").tobytes()], pa.binary()),
        ],
        names=["shard", "doc_ids", "starts", "terms", "ends", "positions"],
    )


def build_index(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str] | None = None) -> DataFrame:
    """The positional index of docs, partitioned by document: one row per shard with its terms and their position lists.

    positions holds, term after term, the ascending word positions of the shard's documents as 32-bit integers; ends are
    the lists' ends, starts the documents' first positions. With a vocabulary only its terms' lists are stored, since no
    other list would be read; positions still count all words. Whole texts are indexed; rows with a null id are left out.
    """
    from pyspark import TaskContext

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = None if vocabulary is None else pa.array(vocabulary, pa.large_string())
        shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t is None:
                    continue
                if ids and size + len(t) > SHARD_CHARS:
                    yield _shard(ids, texts, shard, terms)
                    shard, ids, texts, size = shard + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield _shard(ids, texts, shard, terms)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where(F.col("id").isNotNull())
    return rows.mapInArrow(build, INDEX_SCHEMA)


class _Shard:
    def __init__(self, row: dict):
        self.ids = np.asarray(row["doc_ids"], np.int64)
        self.starts = np.asarray(row["starts"], np.int64)
        positions, ends = np.frombuffer(row["positions"], "<i4"), row["ends"]
        self.lists = {t: positions[a:b] for t, a, b in zip(row["terms"], [0, *ends][: len(ends)], ends, strict=True)}
        self.none = np.empty(0, np.int32)

    def of(self, term: str) -> np.ndarray:
        return self.lists.get(term, self.none)

    def has(self, term: str, at: np.ndarray) -> np.ndarray:
        """Which of the positions `at` carry the term: a merge with its list."""
        held = self.of(term)
        if not len(held) or not len(at):
            return np.zeros(len(at), bool)
        k = np.searchsorted(held, at)
        return held[np.minimum(k, len(held) - 1)] == at

    def block(self, words: list[str]) -> np.ndarray:
        """Positions at which the words stand one after another: offset-adjusted lists, intersected from the rarest on."""
        order = sorted(range(len(words)), key=lambda k: len(self.of(words[k])))
        at = self.of(words[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            at = at[self.has(words[k], at + k)]
        return at

    def runs(self, words: list[str], first: int, size: int, least: int) -> np.ndarray:
        """Positions at which words[first : first + size] stand in a run of at least `least` words of the item."""
        at = self.block(words[first : first + size])
        if not len(at):
            return at
        run = np.full(len(at), size)
        for step, k in ((-1, first - 1), (1, first + size)):
            alive, j = np.ones(len(at), bool), k
            while 0 <= j < len(words) and alive.any():
                alive[alive] = self.has(words[j], at[alive] + (j - first))
                run += alive
                j += step
        return at[run >= least]

    def documents(self, at: np.ndarray) -> np.ndarray:
        """Indexes of the documents that hold the positions."""
        return np.unique(np.searchsorted(self.starts, at, side="right") - 1)

    def near(self, words: list[str], window: int) -> np.ndarray:
        """Indexes of documents in which all the words stand, in any order, within `window` positions.

        Around each place of the rarest term, every other term's list is asked for the place nearest within reach."""
        distinct = sorted(set(words), key=lambda w: len(self.of(w)))
        if not distinct:
            return np.empty(0, np.int64)
        # a window that holds all words starts at one of their places
        starts = np.unique(np.concatenate([self.of(w) for w in distinct]))
        rare = self.of(distinct[0])
        if not len(rare):
            return np.empty(0, np.int64)
        k = np.searchsorted(rare, starts)
        starts = starts[(k < len(rare)) & (rare[np.minimum(k, len(rare) - 1)] - starts < window)]
        doc = np.searchsorted(self.starts, starts, side="right") - 1
        last = np.concatenate([self.starts[1:], [np.iinfo(np.int32).max]])[doc]
        for w in distinct:
            held = self.of(w)
            if not len(held) or not len(starts):
                return np.empty(0, np.int64)
            k = np.searchsorted(held, starts)
            near = held[np.minimum(k, len(held) - 1)]
            ok = (k < len(held)) & (near - starts < window) & (near < last)
            starts, doc, last = starts[ok], doc[ok], last[ok]
        return np.unique(doc)


def _anchors(items: list[tuple[int, list[str]]], least: int, window: int | None) -> dict[str, list[tuple[int, int]]]:
    """Of each item's aligned blocks of words, or of the whole item where order doesn't count, the rarest word among the items
    (of equally rare ones the longest), with the item's place and the block's. Any run of ``least`` words holds a whole block."""
    counts = Counter(w for _, words in items for w in set(words))
    rarest = lambda words: min(words, key=lambda w: (counts[w], -len(w), w))
    size, out = (least + 1) // 2, {}
    for k, (_, words) in enumerate(items):
        if window is not None:
            if words:
                out.setdefault(rarest(words), []).append((k, 0))
        elif len(words) >= least:
            for first in range(0, len(words) - size + 1, size):
                out.setdefault(rarest(words[first : first + size]), []).append((k, first))
    return out


def _search(index: DataFrame, items: list[tuple[int, list[str]]], least: int, window: int | None) -> DataFrame:
    anchors = _anchors(items, least, window)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                # only items of which the shard has a rarest word are looked at
                s, docs, hits = _Shard(row), [], []
                for term in anchors.keys() & s.lists.keys():
                    for k, first in anchors[term]:
                        item, words = items[k]
                        at = s.documents(s.runs(words, first, (least + 1) // 2, least)) if window is None else s.near(words, window)
                        docs.append(s.ids[at])
                        hits.append(np.full(len(at), item, np.int64))
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(hits))], names=["doc_id", "item_id"])

    return index.mapInArrow(search, "doc_id bigint, item_id bigint").distinct()


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for i, t in items.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(t) > ITEM_CHARS:
            yield block
            block, size = [], 0
        block.append((i, [w for w in words_of(pa.array([t]))[0].as_py() if w]))
        size += len(t)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, least: int = 12, window: int | None = None, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id): documents that hold at least ``least`` consecutive words of an item in a row, exactly.

    With ``window``, instead: documents that hold all words of the item, in any order, within that many words. The corpus is
    read and indexed once (build_index, written to the shared folder), with the items' terms alone if the items are no more
    than ITEM_CHARS characters, else with all terms. Each shard looks up the items' rarest terms and compares the items that have
    one there. Items are taken in blocks of at most ITEM_CHARS characters, each of which reads the index. Items with fewer than ``least`` words, null or empty texts match nothing;
    repeated documents and items each give their own rows; an empty table gives none. Ids are integers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    size = items.where(F.col(item_id).isNotNull()).agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    index = out = None
    for block in _blocks(items, item_id, text):
        if index is None:
            vocabulary = sorted({w for _, words in block for w in words}) if size <= ITEM_CHARS else None
            index = scratch.cut(build_index(docs, doc_id, text, vocabulary))
        hits = _search(index, block, least, window)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
