"""Byte-level BPE shared by token counting, encoding and packing.

A text is cut before every space that follows something other than white
space. The split pattern keeps such a space with what comes after it, so no
match crosses a cut and each unit can be looked up on its own. Texts that hold
white space before a space, or control characters on which engines differ, are
matched as a whole instead.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .base import tokenizer_path

#: Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the special string of byte_bpe_50k.json and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |[\x1c-\x1f]"
#: Longer units are computed each time, so that the memo stays small.
MEMO_CHARS = 48
MEMO_UNITS = 250_000

pieces = regex.compile(PATTERN).findall


class Memo:
    """Two generations of a bounded map; the older one goes when the newer is full."""

    def __init__(self, make: Callable[[str], Any], limit: int = MEMO_UNITS):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def __call__(self, key: str) -> Any:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(key) <= MEMO_CHARS:
                if len(self.young) >= self.limit:
                    self.old, self.young = self.young, {}
                self.young[key] = found
        return found


def around_special(text: str) -> list[str]:
    """Ordinary stretches of a text; a special token lies between each two."""
    return text.split(SPECIAL)


class Units:
    """Units of a batch of texts: `words` (distinct), `index` (unit -> word), `starts` (first unit of each text)."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        self.unsafe = np.asarray(pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False), dtype=bool)
        self.texts = texts
        if self.unsafe.any():
            texts = pc.if_else(pa.array(self.unsafe), "", texts)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        self.starts = (offsets[:-1] - offsets[0]).astype(np.int64)
        self.index = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary.to_pylist()
        self.lengths = np.diff(np.append(self.starts, len(self.index)))

    def firsts(self) -> list[str]:
        return [self.words[i] for i in self.index[self.starts]]

    def whole(self) -> list[tuple[int, str]]:
        """Texts that must be matched as a whole, with their row."""
        return [(int(i), self.texts[int(i)].as_py()) for i in np.flatnonzero(self.unsafe)]


def _byte_chars() -> list[str]:
    """Byte-level alphabet by its rule: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class HeapMerger:
    """Number of tokens of a piece: its bytes less the merges that apply.

    Symbols form a linked list; a heap gives the adjacent pair of lowest rank,
    leftmost first. Entries whose pair has changed since are skipped.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(merges)}
        self.chars = _byte_chars()
        self.piece = Memo(self.merge)
        self.unit = Memo(lambda text: sum(map(self.piece, pieces(text))))

    def merge(self, piece: str) -> int:
        chars, rank = self.chars, self.rank.get
        symbols: list[str | None] = [chars[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left is None or j >= n or rank((left, symbols[j])) != r:
                continue
            symbols[i] = left = left + symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := rank((left, symbols[k]))) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank((symbols[h], left))) is not None:
                heapq.heappush(heap, r << 32 | h)
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of any text, special strings as one token each."""
        parts = around_special(text)
        return len(parts) - 1 + sum(self.unit(p) if len(p) <= MEMO_CHARS else sum(map(self.piece, pieces(p))) for p in parts)

    def counts(self, texts: pa.Array) -> np.ndarray:
        units = Units(texts)
        each = np.fromiter((self.count(" " + w) for w in units.words), np.int64, len(units.words))[units.index]
        each[units.starts] = [self.count(w) for w in units.firsts()]
        out = np.add.reduceat(each, units.starts) if len(units.starts) else np.zeros(0, np.int64)
        for i, text in units.whole():
            out[i] = self.count(text)
        return out


@lru_cache(maxsize=2)
def merger(name: str) -> HeapMerger:
    return HeapMerger(tokenizer_path(name))


@lru_cache(maxsize=4)
def encoding(name: str):
    """A tiktoken encoding of a local rank file, without special tokens."""
    import tiktoken

    with open(tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
