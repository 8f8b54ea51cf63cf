"""Token counts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe
from .base import map_batches

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Counts the tokens of each whole text: (doc_id, n_bytes, n_tokens, over_limit).

    One row per input row, repeated rows included, without a shuffle. A null
    text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null. Other
    columns of docs are not read. An empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, text = batch.columns
        n = bpe.merger(vocabulary).counts(text)
        size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays([ids, size, pa.array(n), pa.array(np.asarray(n) > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
