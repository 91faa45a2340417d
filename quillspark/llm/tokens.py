"""Token ids of whole texts by a public byte-level BPE vocabulary, in independent pieces.

The vocabulary's pre-tokens never reach across a single space between two other characters, so a text is cut there and
each piece, with its space, is encoded on its own; pieces recur, so their ids are kept in a bounded cache. The string of
the vocabulary's special token, which holds no space, is that one token wherever it stands, as its tokenizers file has it.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Pieces kept by each worker, and the longest that is kept.
CACHE, LONGEST = 150_000, 48
#: The vocabulary's special token and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
_blank_run = re.compile(r"\s\s")
_safe = re.compile(r"(?<=\S) (?=\S)")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Pieces(dict):
    """Piece (without its leading space) -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(" " + piece), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> Pieces:
    """ranks_path: a tiktoken file of the byte-level BPE vocabulary (the ids equal those of its tokenizers file)."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        first, *rest = text.split(SPECIAL)
        out = plain(first)
        for part in rest:
            out.append(SPECIAL_ID)
            out += plain(part)
        return out

    return Pieces(encode)


def pieces(text: str) -> list[str]:
    """The text cut at its safe spaces; joined by spaces they give it back."""
    return _safe.split(text) if _blank_run.search(text) else text.split(" ")


def ids_bytes(text: str, enc: Pieces) -> bytes:
    """Ids of the whole text, 4 bytes each."""
    parts = pieces(text)
    head = np.array(enc.encode(parts[0]), "<u4").tobytes()
    return head + b"".join(map(enc.__getitem__, parts[1:]))
