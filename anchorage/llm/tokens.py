"""Byte-level BPE ids of whole texts, with a bounded memo of word-sized units.

A space between two non-space characters always starts a new pre-token of this
pattern, so a text is cut there, every unit is encoded on its own and the ids
are joined. Units are remembered per Python worker; the memo is emptied when it
is full, so memory does not grow with the corpus.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

# The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_UNITS = 300_000
MEMO_CHARS = 64
_NEXT_TO_SPACE = re.compile(r" \s|\s ")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of every byte: itself where visible, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def units(text: str) -> list[str]:
    """The text cut before each lone space; joined they give the text back."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and not _NEXT_TO_SPACE.search(text):
        first, *rest = text.split(" ")
    else:
        first, *rest = _SAFE_CUT.split(text)
    return [first, *[" " + u for u in rest]]


class Encoder:
    """Ids of a byte-level BPE vocabulary file; special-token strings are ordinary text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or order != sorted(order):
            raise ValueError("expected a byte-level BPE whose ids follow its merge order")
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items()}
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._memo: dict[str, bytes] = {}

    def _encoded(self, unit: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(unit), dtype="<u4").tobytes()

    def unit_ids(self, parts: list[str]) -> list[bytes]:
        """Little-endian ids of each unit."""
        memo = self._memo
        try:
            return [memo[u] for u in parts]
        except KeyError:
            pass
        if len(memo) > MEMO_UNITS:
            memo.clear()
        out = []
        for u in parts:
            got = memo.get(u)
            if got is None:
                got = self._encoded(u)
                if len(u) <= MEMO_CHARS:
                    memo[u] = got
            out.append(got)
        return out

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.unit_ids(units(text or "")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder, with its memo, per Python worker."""
    return Encoder(path)


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
