"""Splitting long texts at natural boundaries by agglomerative merging (problem 9)."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.tokens import VOCABULARY, encode, token_lengths

LIMIT, OVERLAP = 4096, 200
#: Tokens kept free in each piece, as encoding a piece alone can take a few more than its share of the whole text.
SLACK = 12
#: Boundary strengths, weakest first: within a run, between words, lines, paragraphs, cells.
RUN, WORD, LINE, PARAGRAPH, CELL = range(5)
#: First lines of a cell in the three styles of the notebooks (fixed pattern).
CELL_MARK = re.compile(rb"# %% \[|# -> output|\[md\]|In \[|Out\[|```[a-z]")
#: Characters of pieces that are handed on at once, about.
BATCH_CHARS = 4_000_000
NAMES = ["id", "n_tokens", "n_pieces", "piece_no", "piece_tokens", "start", "piece"]
#: Atoms of a line that is too long: about this many tokens each.
ATOM_TOKENS = 64


def _atoms(data: bytes, begins: np.ndarray, room: int) -> tuple[list[int], list[int]]:
    """Byte offset of each atom, and the strength of the boundary before it. begins: the tokens' byte offsets."""
    at, strength, blank, p = [], [], True, 0
    lines = data.splitlines(keepends=True)
    ends = np.searchsorted(begins, np.cumsum([0, *map(len, lines)])).tolist()
    for a, b, line in zip(ends[:-1], ends[1:], lines, strict=True):
        cell = CELL_MARK.match(line) is not None
        at.append(p)
        strength.append(CELL if cell else PARAGRAPH if blank else LINE)
        blank = not line.strip()
        if b - a > room:
            # a long line: at spaces where there are any, else between tokens
            last = p
            for k in range(a + ATOM_TOKENS, b, ATOM_TOKENS):
                near = [int(x) for x in begins[k - ATOM_TOKENS // 2 : k] if data[x : x + 1].isspace() and x > last]
                cut = near[-1] if near else int(begins[k])
                while cut < p + len(line) and data[cut] & 0xC0 == 0x80:  # not within a character
                    cut += 1
                if last < cut < p + len(line):
                    at.append(cut)
                    strength.append(WORD if near else RUN)
                    last = cut
        p += len(line)
    return at, strength


def merge_atoms(sizes: list[int], strength: list[int], first_room: int, room: int) -> list[int]:
    """Indexes of the atoms with which pieces begin.

    Adjacent pairs lie in a heap by the strength of the boundary between them, then by their joint size, then by place. The
    weakest is merged while the result fits; a pair that doesn't fit stays apart, as pieces only grow. strength[k] is that
    of the boundary before atom k. The piece at the start has first_room, as it repeats nothing; others have room.
    """
    n = len(sizes)
    if not n:
        return []
    left, right, size, alive = list(range(-1, n - 1)), list(range(1, n + 1)), list(sizes), [True] * n
    heap = [(strength[k], sizes[k - 1] + sizes[k], k) for k in range(1, n)]
    heapq.heapify(heap)
    while heap:
        s, total, k = heapq.heappop(heap)
        if not alive[k]:
            continue
        a = left[k]
        if size[a] + size[k] != total:  # one of the two has grown since
            heapq.heappush(heap, (s, size[a] + size[k], k))
            continue
        if total > (first_room if a == 0 else room):
            continue
        size[a], alive[k], right[a] = total, False, right[k]
        if right[k] < n:
            left[right[k]] = a
            if a == 0:  # the first piece has more room than its neighbour had before
                heapq.heappush(heap, (strength[right[k]], total + size[right[k]], right[k]))
    return [k for k in range(n) if alive[k]]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> tuple[int, list[tuple[str, int, int]]]:
    """Tokens of the text, and its pieces (text, tokens, start): each of at most limit tokens.

    start is the code point of the text at which the piece's own part begins, behind what it repeats of the piece before.
    A text within the limit, also an empty one, is one piece. What is repeated is the last ``overlap`` tokens of the
    piece before, or up to three more where a character would be cut.
    """
    ids = encode(text, vocabulary)
    if len(ids) <= limit:
        return len(ids), [(text, len(ids), 0)]
    data = text.encode("utf-8", "surrogatepass")
    begins = np.concatenate([[0], np.cumsum(token_lengths(vocabulary)[ids])[:-1]])
    slack = SLACK
    while True:
        first_room, room = limit - slack, limit - overlap - slack
        if room < 1:
            raise ValueError("the limit leaves no room beside the overlap")
        at, strength = _atoms(data, begins, room)
        where = np.searchsorted(begins, at + [len(data)])
        sizes = np.diff(where).tolist()
        cuts = [at[k] for k in merge_atoms(sizes, strength, first_room, room)] + [len(data)]
        pieces, fits, own, point = [], True, 0, 0
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = a
            if k:
                j = max(0, int(np.searchsorted(begins, a)) - overlap)
                own = int(begins[j]) if begins[j] < a else a
                while own > 0 and data[own] & 0xC0 == 0x80:
                    own -= 1
            piece = data[own:b].decode("utf-8", "surrogatepass")
            n = len(encode(piece, vocabulary))
            fits &= n <= limit
            pieces.append((piece, n, point))
            point += len(data[a:b].decode("utf-8", "surrogatepass"))
        if fits:
            return len(ids), pieces
        slack *= 2  # a rare text whose pieces encode less well alone


def split_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every document in order: id, n_tokens and n_pieces of the document, piece_no from 0, piece_tokens,
    start (the code point where its own part begins) and piece, its text.

    A text within the limit is one piece. Null texts give no piece; empty ones give an empty piece of 0 tokens; repeated rows give
    repeated pieces; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [[] for _ in NAMES], 0
            for i, t in zip(b.column(0), b.column(1), strict=True):
                n, pieces = split_text(t.as_py(), limit, overlap, vocabulary)
                for k, (piece, tokens, start) in enumerate(pieces):
                    row = (i.as_py(), n, len(pieces), k, tokens, start, piece)
                    size += len(piece)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                if size > BATCH_CHARS:
                    yield batch(out, b.schema.field(0).type)
                    out, size = [[] for _ in NAMES], 0
            if out[0]:
                yield batch(out, b.schema.field(0).type)

    def batch(columns, kind):
        kinds = [kind, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=NAMES)

    schema = f"id {kind}, n_tokens bigint, n_pieces int, piece_no int, piece_tokens bigint, start bigint, piece string"
    return rows.mapInArrow(split, schema).withColumnRenamed("id", id_col)
