"""Words of a batch of texts as arrays, for counting without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that separates words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


class Words:
    """`vocabulary` (distinct words), `index` (word -> vocabulary), `starts` and `counts` of each text's words."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts.cast(pa.string()), "")
        trimmed = pc.ascii_trim_whitespace(self.texts)
        lists = pc.ascii_split_whitespace(trimmed)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts, counts = offsets[:-1] - offsets[0], np.diff(offsets)
        blank = np.asarray(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), dtype=bool)
        if blank.any():  # a blank text splits into one empty word
            keep = np.ones(len(index), bool)
            keep[starts[blank & (counts > 0)]] = False
            index = index[keep]
            counts = np.where(blank, 0, counts)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.index, self.starts, self.counts = index, starts, counts
        self.words: list[str] = coded.dictionary.to_pylist()

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of values, one for each word, over each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.starts + self.counts] - total[self.starts]

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def repeated(self, width: int = 3) -> np.ndarray:
        """Words of each text that lie in a window of `width` words found twice or more in it."""
        n = len(self.index)
        covered = np.zeros(n, bool)
        if n >= width:
            owner = self.owner()
            code = self.index[: n - width + 1].copy()
            for k in range(1, width):  # ranks keep the codes exact for any vocabulary
                code = code * max(1, len(self.words)) + self.index[k : n - width + 1 + k]
                if k < width - 1 and code.max(initial=0) > 2**62 // max(1, len(self.words)):
                    code = np.unique(code, return_inverse=True)[1]
            inside = owner[: n - width + 1] == owner[width - 1 :]
            at = np.flatnonzero(inside)
            order = at[np.lexsort((code[at], owner[at]))]
            same = (code[order][1:] == code[order][:-1]) & (owner[order][1:] == owner[order][:-1])
            twice = np.zeros(len(order), bool)
            twice[1:] |= same
            twice[:-1] |= same
            for k in range(width):
                covered[order[twice] + k] = True
        return self.per_text(covered.astype(np.int64))


def byte_counts(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Sum of table[byte] over each text's UTF-8."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]]


def byte_table(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[ord(c) for c in chars]] = 1
    return table


def word_char_table() -> np.ndarray:
    """1 for each byte that begins a code point other than white space."""
    table = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)
    table[list(SPACE_BYTES)] = 0
    return table
