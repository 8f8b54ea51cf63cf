"""Hashed word and character n-grams of whole texts, and a linear model over them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .training import Sample, Sparse, sparse_logistic
from .wordbatch import Words

#: Buckets of each kind of n-gram: words, pairs of words, characters.
BITS = 16
SIZE = 1 << BITS
CHAR_N = 3
#: Factors that mix two words' hashes into a pair's, code points into an n-gram's, and an n-gram's bits.
PAIR, CHARS, MIX = 1_000_003, 0x01000193, 0x9E3779B1
#: Bytes of text scored at once: character n-grams take some forty times as much for a moment.
SLICE_BYTES = 2 << 20


def char_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every CHAR_N code points of each word between < and >, and how many each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = np.zeros(max(0, len(points) - CHAR_N + 1), np.uint64)
    for k in range(CHAR_N):
        code = (code * np.uint64(CHARS) + points[k : k + len(code)]) & np.uint64(0xFFFFFFFF)
    code = ((code * np.uint64(MIX)) >> np.uint64(16)) & np.uint64(SIZE - 1)
    begins = np.cumsum(size + 2) - size - 2
    at = np.repeat(begins - np.cumsum(size) + size, size) + np.arange(size.sum())
    return code[at].astype(np.int64), size


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:-1] * PAIR + hashes[1:]) >> 5) % SIZE


@dataclass
class Linear:
    beta: np.ndarray
    bias: float

    def of_features(self, x: Sparse) -> np.ndarray:
        return x.dot(self.beta) + self.bias


PACKED = "gaps binary, counts binary, large binary, n_words int"


def matrix(texts: pa.Array) -> Sparse:
    """Features of texts: roots of relative counts of words, pairs of words and character n-grams."""
    words = Words(texts)
    return unpack_features(*pack_features(words), words.counts)


def sample_matrix(sample: Sample) -> Sparse:
    """Features of a sample's texts, worked out by executors."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        words = Words(batch.column(0))
        return [*pack_features(words), pa.array(words.counts, pa.int32())]

    return packed_matrix(sample.collect(run, ["text"], PACKED, SLICE_BYTES))


def packed_matrix(table: pa.Table) -> Sparse:
    """Features in a table's columns of PACKED, held in single precision."""
    gaps, counts, large, n_words = (table[c].combine_chunks() for c in ("gaps", "counts", "large", "n_words"))
    x = unpack_features(gaps, counts, large, n_words.to_numpy(zero_copy_only=False))
    x.row, x.col, x.val = x.row.astype(np.int32), x.col.astype(np.int32), x.val.astype(np.float32)
    return x


def rows_of(x: Sparse, at: np.ndarray) -> Sparse:
    """The given rows of x, in that order."""
    out = Sparse([], [], x.width)
    order = np.argsort(x.row, kind="stable")
    ends = np.cumsum(np.bincount(x.row, minlength=x.n))
    starts = np.concatenate([[0], ends[:-1]])
    take = [order[starts[i] : ends[i]] for i in at]
    out.n = len(at)
    out.row = np.repeat(np.arange(len(at)), [len(t) for t in take])
    pos = np.concatenate(take) if take else np.zeros(0, np.int64)
    out.col, out.val = x.col[pos], x.val[pos]
    return out


def fit_linear(x: Sparse, y: np.ndarray, w: np.ndarray, ridge: float = 1e-5, rounds: int = 60) -> Linear:
    fitted = sparse_logistic(x, y, w, ridge, rounds)
    return Linear(fitted.beta, fitted.bias)


class Scorer:
    """Scores of whole texts under a linear model.

    A text's features are roots of relative counts, so that each bucket of a
    text is counted by sorting codes within the slice.
    """

    def __init__(self, model: Linear):
        self.words, self.pairs, self.chars = (model.beta[k * SIZE : (k + 1) * SIZE] for k in range(3))
        self.bias = model.bias

    def scores(self, words: Words) -> np.ndarray:
        n = len(words.counts)
        out = np.full(n, self.bias)
        for weights, (code, count) in zip((self.words, self.pairs, self.chars), coded(words), strict=False):
            text = code >> BITS
            out += np.bincount(text, weights[code & (SIZE - 1)] * np.sqrt(count / words.counts[text]), n)
        return out


def coded(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of words, pairs and characters: distinct text * SIZE + bucket, ascending, and how often each occurs."""
    if not len(words.index):
        return
    hashes = np.fromiter((zlib.crc32(w.encode()) for w in words.words), np.int64, len(words.words))
    flat, size = char_buckets(words.words)
    first = np.cumsum(size) - size
    owner = words.owner()
    h = hashes[words.index]
    inside = owner[:-1] == owner[1:]
    per = size[words.index]
    steps = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    chars = flat[np.repeat(first[words.index], per) + steps]
    for bucket, of in ((h % SIZE, owner), (pair_buckets(h)[inside], owner[1:][inside]), (chars, np.repeat(owner, per))):
        yield np.unique(of * SIZE + bucket, return_counts=True)


#: A count that is written in the column of large counts.
LARGE = 255


def pack_features(words: Words) -> list[pa.Array]:
    """Binary columns (gaps, counts, large) of each text's features; lossless, and small once compressed.

    gaps has two bytes for each step from a bucket to the next over all three
    kinds; a kind starts anew with a count of 0. Counts of LARGE and more
    follow as four bytes in large.
    """
    n = len(words.counts)
    kinds = list(coded(words)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 3
    sizes = np.stack([np.bincount(code >> BITS, minlength=n) for code, _ in kinds], axis=1)
    starts = (np.cumsum(sizes.ravel() + 1) - sizes.ravel() - 1).reshape(n, 3)  # of each text's kinds, a mark first
    total = int(sizes.sum()) + 3 * n
    gaps, counts = np.zeros(total, np.uint16), np.zeros(total, np.uint32)
    for kind, (code, count) in enumerate(kinds):
        text, bucket = code >> BITS, code & (SIZE - 1)
        first = np.cumsum(sizes[:, kind]) - sizes[:, kind]
        at = np.arange(len(code)) - first[text] + starts[text, kind] + 1
        counts[at] = count
        gap = np.diff(bucket, prepend=0)
        begins = first[sizes[:, kind] > 0]
        gap[begins] = bucket[begins]
        gaps[at] = gap
    per = sizes.sum(axis=1) + 3
    big = counts >= LARGE
    return [_binary(gaps, per), _binary(np.minimum(counts, LARGE).astype(np.uint8), per), _binary(counts[big], np.bincount(np.repeat(np.arange(n), per)[big], minlength=n))]


def _binary(values: np.ndarray, per: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(per)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def unbinary(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer((column.buffers()[2] or b"")[ends[0] : ends[-1]] if ends[-1] > ends[0] else b"", kind)
    return data, np.diff(ends) // np.dtype(kind).itemsize


def unpack_features(gaps: pa.Array, counts: pa.Array, large: pa.Array, n_words: np.ndarray) -> Sparse:
    """The features that pack_features wrote, as `matrix` has them."""
    gap, per = unbinary(gaps, np.uint16)
    count = unbinary(counts, np.uint8)[0].astype(np.int64)
    count[count == LARGE] = unbinary(large, np.uint32)[0]
    out = Sparse([], [], 3 * SIZE)
    out.n = len(per)
    start = np.flatnonzero(count == 0)  # three in each row
    total = np.cumsum(gap, dtype=np.int64)
    kind = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(count))))
    keep = count > 0
    kind = kind[keep]
    out.row = kind // 3
    out.col = total[keep] - total[start][kind] + kind % 3 * SIZE
    out.val = np.sqrt(count[keep] / np.asarray(n_words)[out.row])
    return out

