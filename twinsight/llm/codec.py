"""Byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .base import map_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A text longer than this is cut where the split pattern cannot reach across.
CUT_CHARS = 32_768

#: Before a space that follows something other than white space.
_boundary = re.compile(r"(?<=\S)(?= )")
#: The library's matcher backtracks over white space; longer stretches without a cut go piece by piece.
_MATCHER_CHARS = 400_000


def safe_cuts(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """Parts of at least `size` characters whose encodings concatenate to that of the text."""
    start = 0
    while len(text) - start > size:
        found = _boundary.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    library = bpe.encoding(vocabulary)
    ids: list[int] = []
    for part in safe_cuts(text):
        if len(part) <= _MATCHER_CHARS:
            ids += library.encode_ordinary(part)
        else:
            for piece in bpe.regex.finditer(bpe.PATTERN, part):
                ids += library._core_bpe.encode_single_piece(piece[0].encode("utf-8"))
    return ids


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> bytes:
    """Raw bytes of ids; they need not be whole characters."""
    return bpe.encoding(vocabulary).decode_bytes(ids)


@lru_cache(maxsize=1)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text; null text: no ids. One row per input row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encode(x or "", vocabulary) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, raw binary) of rows (doc_id, ids); null ids: empty bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [decode(x or [], vocabulary) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return map_batches(coded.select("doc_id", "ids"), run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes and decodes each whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    One row per input row, repeated rows included, without a shuffle; ids stay
    within the batch. A null text counts as empty. Other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, of_ids, of_raw = [], [], []
        decimal = _decimals(bpe.encoding(vocabulary).n_vocab).__getitem__
        for scalar in batch.column(1):
            ids = encode(scalar.as_py() or "", vocabulary)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
            of_raw.append(hashlib.sha256(decode(ids, vocabulary)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
