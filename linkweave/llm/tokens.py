"""Public byte-level BPE tokenizers. The vocabulary's path is a parameter; nothing is copied or trained."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Where the vocabulary lies on driver and executors, unless a query is given another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The public pre-tokenizer pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of the pattern (fixed value) in runs that long is cut out of the text, as the pattern matcher would run out of
#: stack in far longer ones. The pattern takes a run but for its last character as one piece, or all of it at the text's end;
#: so the tokens are those of the whole text.
LONG_RUN = 5000
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_lengths(path: str = VOCABULARY) -> np.ndarray:
    """Bytes of each token, by id."""
    tokens = encoder(path)._mergeable_ranks
    out = np.zeros(max(tokens.values()) + 1, np.int64)
    for t, k in tokens.items():
        out[k] = len(t)
    return out


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Token ids of the whole text; '' has none."""
    enc = encoder(path)
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in _SPACES.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)
