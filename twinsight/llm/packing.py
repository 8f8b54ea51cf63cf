"""Packing of token sequences by lexical retrieval.

Whole windows of a document are sequences of their own. What is left of
each document is put in order of a lexical sketch and dealt into shards of
bounded size. In a shard, a BM25 inverted index over token ids gives each
seed its nearest unused neighbours, which fill the seed's window.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .base import slices, stage
from .codec import _MATCHER_CHARS, safe_cuts

#: The rank file holds the vocabulary of byte_bpe_50k.json and gives the same ids, in a third of the time.
RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 2048
#: Fixed value: the id that closes a document.
END_ID = 1
SHARD_ROWS = 2048
#: BM25 parameters, and neighbours that are sorted at a time.
K1, B = 1.2, 0.75
NEIGHBOURS = 48
#: Terms in more than one document of so many have a row of weights of all documents instead of a list.
DENSE = 16


def token_ids(text: str, ranks: str = RANKS) -> np.ndarray:
    """Ids of a whole text, special strings as their own id, and END_ID."""
    library = bpe.encoding(ranks)
    out: list[np.ndarray] = []
    for k, ordinary in enumerate(bpe.around_special(text)):
        if k:
            out.append(np.array([bpe.SPECIAL_ID], np.uint32))
        for part in safe_cuts(ordinary):
            if len(part) <= _MATCHER_CHARS:
                out.append(library.encode_to_numpy(part, disallowed_special=()))
            else:
                out += [np.array(library._core_bpe.encode_single_piece(p.encode()), np.uint32) for p in bpe.pieces(part)]
    return np.concatenate([*out, np.array([END_ID], np.uint32)]).astype("<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def sketch(ids: np.ndarray) -> int:
    """Smallest hash of the distinct ids: equal with the probability of the Jaccard similarity."""
    return int(((np.unique(ids).astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(0x7F4A7C15)) & np.uint64(0xFFFFFFFF)).min()) if len(ids) else 0


class Numbering:
    """Sequence ids no other task gives; stages differ in the last bit."""

    def __init__(self, stage_bit: int):
        self.next, self.bit = TaskContext.get().partitionId() << 32, stage_bit

    def __call__(self) -> int:
        self.next += 1
        return self.next << 1 | self.bit


TOKENS = "doc_id long, doc_tokens long, windows array<struct<start:long,crc:long,sequence_id:long>>, tail_start long, tail binary, sketch long"
_window = pa.list_(pa.struct([("start", pa.int64()), ("crc", pa.int64()), ("sequence_id", pa.int64())]))


def tokenise(docs: DataFrame, ranks: str = RANKS, window: int = WINDOW) -> DataFrame:
    """Whole windows of each row's ids, with their checksums, and the ids that are left."""

    if bpe.encoding(ranks).n_vocab > 1 << 16:
        raise ValueError(f"ids of {ranks} don't fit into 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbering(0)
        for batch in batches:
            for part in slices(batch):
                total, windows, starts, tails, sketches = [], [], [], [], []
                for text in part.column(1):
                    ids = token_ids(text.as_py() or "", ranks)
                    whole = len(ids) // window * window
                    windows.append([{"start": at, "crc": crc(ids[at : at + window]), "sequence_id": number()} for at in range(0, whole, window)])
                    total.append(len(ids))
                    starts.append(whole)
                    tails.append(ids[whole:].astype("<u2").tobytes())
                    sketches.append(sketch(ids[whole:]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(windows, _window), pa.array(starts, pa.int64()), pa.array(tails, pa.binary()), pa.array(sketches, pa.int64())],
                    ["doc_id", "doc_tokens", "windows", "tail_start", "tail", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


class Index:
    """BM25 inverted index of a shard: for each term its documents and weights, as a list or, if common, as a row."""

    def __init__(self, tails: list[np.ndarray]):
        n = len(tails)
        size = np.array([len(t) for t in tails])
        code = np.repeat(np.arange(n, dtype=np.int64), size) << 16 | np.concatenate(tails).astype(np.int64)
        code, times = np.unique(code, return_counts=True)
        doc, term = code >> 16, code & 0xFFFF
        frequency = np.bincount(term, minlength=1 << 16)
        idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        weight = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * size[doc] / size.mean()))
        self.terms = term
        self.bounds = np.searchsorted(doc, np.arange(n + 1))
        common = frequency > n // DENSE
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), n), np.float32)
        own = common[term]
        self.rows[self.row[term[own]], doc[own]] = weight[own]
        rare = np.flatnonzero(~own)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.docs, self.gain = doc[rare], weight[rare]
        self.first = np.concatenate([[0], np.cumsum(np.where(common, 0, frequency))])
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for all terms of the seed."""
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        row = self.row[terms]
        total = self.rows[row[row >= 0]].sum(axis=0)
        terms = terms[row < 0]
        lo, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        return total + np.bincount(self.docs[at], self.gain[at], self.n)


def pack_shard(tails: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start within its ids here, length) that use every id once.

    The longest unused document is the seed. Its neighbours follow by score
    while they fit; the best that is left is cut to fill the window, and its
    rest stays for later. What the shard cannot fill is cut to powers of two,
    which need no padding.
    """
    index = Index(tails)
    size = np.array([len(t) for t in tails])
    start = np.zeros(len(tails), np.int64)
    open_ = size > 0
    order = np.lexsort((np.arange(len(tails)), -size))
    out, at = [], 0
    while True:
        while at < len(order) and not open_[order[at]]:
            at += 1
        if at == len(order):
            break
        seed = int(order[at])
        room = window
        pieces: list[tuple[int, int, int]] = []

        def use(doc: int, length: int, pieces=pieces) -> None:
            pieces.append((doc, int(start[doc]), length))
            start[doc] += length
            open_[doc] = start[doc] < size[doc]

        length = min(room, int(size[seed] - start[seed]))
        use(seed, length)
        room -= length
        score = index.scores(seed) if room else None
        while room:
            free = np.flatnonzero(open_)
            if not len(free):
                break
            near = free if len(free) <= NEIGHBOURS else free[np.argpartition(-score[free], NEIGHBOURS)[:NEIGHBOURS]]
            near = near[np.lexsort((near, -score[near]))]
            for doc in near.tolist():
                length = int(size[doc] - start[doc])
                if length <= room:
                    use(doc, length)
                    room -= length
            if room:  # the nearest that is left is longer than the room
                rest = near[open_[near]]
                if len(rest):
                    use(int(rest[0]), room)
                    room = 0
        out += [pieces] if not room else powers(pieces)
    return out


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same ids as sequences whose lengths are powers of two."""
    left = sum(p[2] for p in pieces)
    todo, out = list(reversed(pieces)), []
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        own = []
        while room:
            doc, start, length = todo.pop()
            used = min(room, length)
            own.append((doc, start, used))
            room -= used
            if used < length:
                todo.append((doc, start + used, length - used))
        out.append(own)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(rows: pa.Table, number: Numbering, window: int) -> pa.RecordBatch:
    tails = [np.frombuffer(x, "<u2") for x in rows.column("tail").to_pylist()]
    first, total = rows.column("tail_start").to_pylist(), rows.column("doc_tokens").to_pylist()
    doc, out = [], []
    for pieces in pack_shard(tails, window):
        sequence, offset = number(), 0
        for d, start, length in pieces:
            doc.append(d)
            out.append((first[d] + start, length, crc(tails[d][start : start + length]), total[d], sequence, offset))
            offset += length
    columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks().take(pa.array(doc)), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, ranks: str = RANKS, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs the ids of all whole texts, each closed by END_ID, into sequences of at most `window` ids.

    One row per piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset). A null text is empty and has END_ID alone. Repeated
    rows are packed each for itself; a null doc_id stays null. Other columns
    are not read. An empty table gives an empty result.

    Texts are tokenised once; ids left over are staged. They are dealt out by
    range of (sketch, row hash), so that no sketch, however common, fills a
    partition, and a partition is packed shard by shard.
    """
    coded = stage(tokenise(docs, ranks, window), "tokens")
    whole = coded.select("doc_id", "doc_tokens", F.explode("windows").alias("w"))
    whole = whole.select("doc_id", F.col("w.start").alias("start"), F.lit(window).cast("long").alias("length"), F.col("w.crc").alias("ids_crc32"), "doc_tokens", F.col("w.sequence_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tails = coded.where("length(tail) > 0").select("doc_id", "doc_tokens", "tail_start", "tail", "sketch", F.xxhash64("doc_id", "tail_start", "tail").alias("tie"))
    parts = max(1, math.ceil(coded.where("length(tail) > 0").count() / (4 * shard_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = Numbering(1), [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(shard_rows - n, batch.num_rows)
                held.append(batch.slice(0, take))
                n += take
                batch = batch.slice(take)
                if n == shard_rows:
                    yield _pack(pa.Table.from_batches(held), number, window)
                    held, n = [], 0
        if n:
            yield _pack(pa.Table.from_batches(held), number, window)

    dealt = tails.repartitionByRange(parts, "sketch", "tie").sortWithinPartitions("sketch", "tie")
    return whole.unionByName(dealt.select("doc_id", "doc_tokens", "tail_start", "tail").mapInArrow(run, PIECES))
