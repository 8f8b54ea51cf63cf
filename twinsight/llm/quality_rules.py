"""Quality rules: base counts and a calibrated hashed n-gram classifier."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .base import map_batches
from .hashed import SLICE_BYTES, Linear, Scorer, fit_linear, rows_of, sample_matrix
from .training import Sample, folds, labelled_sample, per_worker, platt, sigmoid
from .wordbatch import Words, byte_counts, byte_table, word_char_table

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW_WORDS = 50, 50, 3
#: A document that passes the base rules is kept at this calibrated probability of good quality.
KEEP_AT = 0.5
PER_CLASS = 1000

_symbols, _word_chars = byte_table(SYMBOLS), word_char_table()


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


@dataclass
class Model:
    linear: Linear | None
    slope: float
    intercept: float

    def scorer(self) -> Scorer | None:
        return Scorer(self.linear) if self.linear else None

    def probabilities(self, scorer: Scorer | None, words: Words) -> np.ndarray:
        z = scorer.scores(words) if scorer else np.zeros(len(words.counts))
        return sigmoid(self.slope * z + self.intercept)


def fit(sample: Sample) -> Model:
    """Probability of good quality. One class alone, or no labels: everything is kept."""
    y, w = sample.labels, sample.weights
    if len(set(y.tolist())) < 2:
        return Model(None, 1.0, 10.0)
    x = sample_matrix(sample)
    k = 3
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        fold[at] = folds(len(at), k)
    z = np.zeros(len(y))
    for f in range(k):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        z[own] = fit_linear(rows_of(x, rest), y[rest], w[rest]).of_features(rows_of(x, own))
    slope, intercept = platt(z, y, w)
    return Model(fit_linear(x, y, w), slope, intercept)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled_sample(docs, labels, "quality", ["text"], per_class=PER_CLASS))


def apply_rules(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """Base counts and verdict of each whole text, one row per input row.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, probability, kept. A null text has no words
    and fails the base rules. Repeated rows, and rows without a doc_id, are
    rated each for itself. Other columns are not read. An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 x 2^16 weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, text = batch.columns
        words = Words(text)
        repeat = words.repeated(WINDOW_WORDS)
        failed = (words.counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words.counts)
        p = shared.value.probabilities(per_worker(shared, Model.scorer), words)
        lines = [duplicate_lines(x.as_py()) for x in pc.fill_null(text, "")]
        counts = [words.counts, byte_counts(text, _word_chars), byte_counts(text, _symbols), lines, repeat]
        arrays = [ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return map_batches(docs.select("doc_id", "text"), run, schema, SLICE_BYTES)
