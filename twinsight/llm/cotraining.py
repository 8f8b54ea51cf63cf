"""Quality classifier by co-training a text view and a page-metadata view.

The text view is a hashed n-gram model of the words. The metadata view sees
lang, source, length and the shape of the page (lines, capitals, digits,
punctuation, repetition), never a word. Both views' features of every
document are worked out once and staged. In each round both views score all
unlabelled documents, and each labels the share it is surest about for the
other. The labelled rows are summed up by label and by their score under the
view that learns from them; within such a group a logistic regression's
residual is nearly the same, so its gradient and curvature follow from the
sums, and every pseudo-labelled document takes part in the fit after one pass.
Each view is then calibrated on labelled documents held out from both, and a
logistic regression of the two calibrated log odds scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column_of, map_batches, new_path, remove, slices
from .hashed import PACKED, SLICE_BYTES, Linear, Scorer, pack_features, packed_matrix, rows_of, unbinary, unpack_features
from .training import AdaGrad, Sample, Sparse, labelled_sample, logistic, per_worker, platt, sigmoid, sparse_logistic
from .wordbatch import Words, byte_counts, byte_table

ROUNDS = 3
#: Part of all unlabelled documents that a view labels for the other, surest first, classes in proportion; grows by this much each round.
CONFIDENT = 0.1
#: Steps of each round's fit; all pseudo-labelled rows together weigh this much of the labelled ones.
STEPS, PSEUDO = 12, 0.5
#: Groups of pseudo-labelled rows of a label, by their score under the view that learns from them, and the scores between groups.
GROUPS, EDGES = 4, (-2.0, 0.0, 2.0)
#: Bins of a view's scores, and the scores between which they lie.
BINS, REACH = 8192, 32.0
#: Bound of the labelled documents of each class that the views are fitted on.
PER_CLASS = 800
KEEP_AT = 0.5
SOURCE_BUCKETS, LANG_BUCKETS = 16, 8

_tables = [byte_table(c) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?", "#*$%&|<>{}[]()=+~^@_\\/", "\n", "!|#$%&*")]


def _one_hot(values: pa.Array, buckets: int) -> np.ndarray:
    at = np.array([zlib.crc32((v or "").encode()) % buckets for v in values.to_pylist()], np.int64)
    return np.eye(buckets)[at] if len(at) else np.zeros((0, buckets))


def page_metadata(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array, words: Words) -> np.ndarray:
    """Features of the metadata view; nulls count as empty or zero."""
    chars = np.nan_to_num(n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
    size = byte_counts(text, np.ones(256, np.uint8)).astype(float)
    shares = [byte_counts(text, t) / np.maximum(size, 1) for t in _tables]
    n = words.counts.astype(float)
    repeated = words.repeated(3) / np.maximum(n, 1)
    own = np.unique(words.owner() * len(words.words) + words.index) // max(1, len(words.words))
    distinct = np.bincount(own, minlength=len(n)) / np.maximum(n, 1)
    word_size = size / np.maximum(n, 1)
    shape = np.column_stack([np.log1p(np.maximum(chars, 0)), np.log1p(size), np.log1p(n), *(10 * np.sqrt(s) for s in shares), repeated, distinct, np.log1p(word_size), n < 20])
    return np.column_stack([shape, _one_hot(lang, LANG_BUCKETS), _one_hot(source, SOURCE_BUCKETS)])


@dataclass
class Model:
    content: Linear | None
    meta: np.ndarray
    scale: np.ndarray
    calibration: np.ndarray  # slope and intercept of each view
    combine: np.ndarray
    rounds: list = field(default_factory=list)  # of each: unlabelled documents scored, labels given to content, to meta

    def scorer(self) -> Scorer | None:
        return Scorer(self.content) if self.content else None

    def scores(self, scorer: Scorer | None, text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
        if scorer is None:
            return np.ones(len(text))
        words = Words(text)
        views = [scorer.scores(words), meta_logit(page_metadata(text, lang, source, n_chars, words), self.meta, self.scale)]
        return self.combined(views)

    def combined(self, views: list[np.ndarray]) -> np.ndarray:
        logits = [np.clip(a * z + b, -12, 12) for z, (a, b) in zip(views, self.calibration, strict=True)]
        return sigmoid(np.column_stack([*logits, np.ones(len(logits[0]))]) @ self.combine)


def meta_logit(x: np.ndarray, beta: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return ((x - scale[0]) / scale[1]) @ beta[:-1] + beta[-1]


FEATURES = f"{PACKED}, meta binary"


def _stage(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage_features(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, str]:
    """(own: struct of the columns in `carry`, doc_id, row number, both views' features) of each document, staged; and where."""

    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.StructArray:
        words = Words(text)
        meta = pa.array([row.tobytes() for row in page_metadata(text, lang, source, n_chars, words)], pa.binary())
        columns = [*pack_features(words), pa.array(words.counts, pa.int32()), meta]
        return pa.StructArray.from_arrays(columns, ["gaps", "counts", "large", "n_words", "meta"])

    made = column_of(run, SLICE_BYTES, f"struct<{FEATURES.replace(' ', ':')}>".replace(",:", ","))("text", "lang", "source", F.col("n_chars").cast("long"))
    rows = docs.select(F.struct(*carry).alias("own"), "doc_id", F.monotonically_increasing_id().alias("row"), made.alias("f"))
    return _stage(rows.select("own", "doc_id", "row", "f.*"), "features")


def _views(batch: pa.RecordBatch) -> tuple[Sparse, np.ndarray]:
    gaps, counts, large, n_words, meta = (batch.column(c) for c in ("gaps", "counts", "large", "n_words", "meta"))
    x = unbinary(meta, np.float64)[0].reshape(batch.num_rows, -1)
    return unpack_features(gaps, counts, large, n_words.to_numpy(zero_copy_only=False)), x


def labelled_rows(features: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the rows that have a label: row >> 5, ascending, and 32 bits of each; a bit for each document at most."""
    rows = features.select("doc_id", "row").join(known.select("doc_id").distinct(), "doc_id").select("row")
    bits = rows.groupBy(F.shiftright("row", 5).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(row & 31 as int)))").alias("bits")).toPandas().sort_values("k")
    return bits["k"].to_numpy(np.int64), bits["bits"].to_numpy(np.int64)


def _unlabelled(row: np.ndarray, bits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, words = bits
    if not len(keys):
        return np.ones(len(row), bool)
    at = np.minimum(np.searchsorted(keys, row >> 5), len(keys) - 1)
    return ~((keys[at] == row >> 5) & ((words[at] >> (row & 31)) & 1 == 1))


#: Values of sums that one row carries.
CHUNK = 1 << 14


def sums(rows: DataFrame, of: Callable[[pa.RecordBatch], list[np.ndarray]], kind: type = np.float64) -> list[np.ndarray]:
    """Sums of the flat arrays that `of` makes of slices; nothing for no rows.

    Added up in each task and then, chunk by chunk, behind a shuffle: the
    driver gets one copy, however many tasks there are. `kind` is that of a
    task's sums on their way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                if part.num_rows:
                    new = of(part)
                    if total is None:
                        total = [np.array(x, float) for x in new]
                    else:
                        for a, x in zip(total, new, strict=True):
                            a += x
        for k, a in enumerate(total or []):
            for at in range(0, len(a), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([a[at : at + CHUNK].astype(kind).tobytes()], pa.binary())], ["k", "at", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(part, kind).astype(float) for part in table["part"].to_pylist())
        return pa.table({"k": table["k"][:1], "at": table["at"][:1], "part": pa.array([total.astype(kind).tobytes()], pa.binary())})

    schema = "k int, at int, part binary"
    found = sorted(rows.mapInArrow(run, schema).groupBy("k", "at").applyInArrow(add, schema).collect())
    return [np.concatenate([np.frombuffer(r["part"], kind).astype(float) for r in found if r["k"] == k]) for k in sorted({r["k"] for r in found})]


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)


def cuts(bins: np.ndarray, share: float, rate: float) -> tuple[int, int]:
    """(lowest bin of ones, highest bin of zeros): the surest share of all rows, classes at the given rate of ones.

    Rows of one bin are taken together, and only on their own side of zero.
    """
    n = share * bins.sum()
    down, up = np.cumsum(bins[::-1])[::-1], np.cumsum(bins)
    ones = int(np.flatnonzero(down >= n * rate)[-1]) if n * rate else BINS
    zeros = int(np.flatnonzero(up >= n * (1 - rate))[0]) if n * (1 - rate) else -1
    return max(ones, BINS // 2), min(zeros, BINS // 2 - 1)


def grouped(x: Sparse, meta: np.ndarray, z: tuple[np.ndarray, np.ndarray], labels: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Of rows that got a label (-1: none) for the text view and the metadata view: sums by group.

    A group is label * GROUPS + the place of the row's own score between
    EDGES. Rows and feature sums of the text view; then rows, feature sums and
    sums of feature products of the metadata view.
    """
    groups = [np.where(y >= 0, y * GROUPS + np.searchsorted(EDGES, s), -1) for y, s in zip(labels, z, strict=True)]
    text, shape = groups
    own = text[x.row] >= 0
    first = np.bincount(text[x.row[own]] * x.width + x.col[own], x.val[own], 2 * GROUPS * x.width)
    count = [np.bincount(g[g >= 0], minlength=2 * GROUPS) for g in groups]
    d = meta.shape[1]
    linear, square = np.zeros((2 * GROUPS, d)), np.zeros((2 * GROUPS, d, d))
    for g in np.unique(shape[shape >= 0]):
        m = meta[shape == g]
        linear[g], square[g] = m.sum(axis=0), m.T @ m
    return [count[0], first, count[1], linear.ravel(), square.ravel()]


def text_gradient(fitted: AdaGrad, n: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum of (probability - label) * features over groups, each taken to have its mean's probability; and over the intercept."""
    r = np.where(n > 0, sigmoid(first @ fitted.beta / np.maximum(n, 1) + fitted.bias) - y, 0.0)
    return r @ first, float(r @ n)


def meta_step(beta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, groups: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, weight: float) -> np.ndarray:
    """One Newton step of a ridge logistic regression over labelled rows and weighted groups."""
    penalty = np.append(np.full(len(beta) - 1, 1.0), 1e-6)
    n, linear, square = groups
    p = sigmoid(x @ beta)
    q = sigmoid(linear @ beta / np.maximum(n, 1))
    gradient = x.T @ (w * (y - p)) + weight * ((labels - q) @ linear) - penalty * beta
    curve = lambda v: np.maximum(v * (1 - v), 1e-6)
    hessian = (x * (w * curve(p))[:, None]).T @ x + weight * np.tensordot(curve(q), square, 1) + np.diag(penalty)
    step = np.linalg.solve(hessian, gradient)
    return beta + step * min(1, 4 / max(np.abs(step).max(), 1e-12))


def fit(sample: Sample, features: DataFrame, rounds: int = ROUNDS) -> Model:
    """Model of a sample whose columns are those of `features`, and of all unlabelled rows of `features`.

    One class alone, or no labels: everything scores 1.
    """
    y, w = sample.labels.astype(float), sample.weights
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::4]] = True  # every fourth of each class is for calibration only
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return Model(None, np.zeros(1), np.zeros((2, 1)), np.zeros((2, 2)), np.zeros(3))
    rows = sample.frame.select("at", *(field.split()[0] for field in FEATURES.split(", "))).toArrow().sort_by("at")
    text = packed_matrix(rows)
    meta = unbinary(rows["meta"].combine_chunks(), np.float64)[0].reshape(len(y), -1)

    def moments(batch: pa.RecordBatch) -> list[np.ndarray]:
        x = unbinary(batch.column("meta"), np.float64)[0].reshape(batch.num_rows, -1)
        return [np.array([len(x)]), x.sum(axis=0), (x**2).sum(axis=0)]

    n, first, second = sums(features.select("meta"), moments)
    mean = first / n
    scale = np.stack([mean, np.maximum(np.sqrt(np.maximum(second / n - mean**2, 0)), 1e-3)])
    scaled = np.column_stack([(meta - scale[0]) / scale[1], np.ones(len(y))])

    rate = float(np.average(y, weights=w))
    own = np.flatnonzero(~held)
    x_text, x_meta, y_own, w_own = rows_of(text, own), scaled[own], y[own], w[own]
    content = sparse_logistic(x_text, y_own, w_own, 1e-5, 60)
    beta = logistic(x_meta[:, :-1], y_own, w_own, ridge=1.0)
    spark = features.sparkSession
    bits = spark.sparkContext.broadcast(labelled_rows(features, sample.known))
    of_group = np.repeat([0.0, 1.0], GROUPS)
    done = []
    for k in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast((content.beta, content.bias, beta))

        def scored(batch: pa.RecordBatch, shared=shared) -> tuple:
            x, m = _views(batch)
            weights, bias, b = shared.value
            open_ = _unlabelled(batch.column("row").to_numpy(zero_copy_only=False), bits.value)
            return x, m, x.dot(weights) + bias, meta_logit(m, b, scale), open_

        def histograms(batch: pa.RecordBatch, scored=scored) -> list[np.ndarray]:
            _, _, *z, open_ = scored(batch)
            return [np.bincount(bin_of(v[open_]), minlength=BINS) for v in z]

        needed = features.drop("own", "doc_id")
        both = sums(needed, histograms)
        if not both or not both[0].sum():
            break
        of_text, of_meta = (cuts(b, CONFIDENT * k, rate) for b in both)

        def taught(batch: pa.RecordBatch, scored=scored, of_text=of_text, of_meta=of_meta) -> list[np.ndarray]:
            x, m, *z, open_ = scored(batch)
            label = lambda v, cut: np.where(open_ & (bin_of(v) >= cut[0]), 1, np.where(open_ & (bin_of(v) <= cut[1]), 0, -1))
            m = np.column_stack([(m - scale[0]) / scale[1], np.ones(len(m))])
            return grouped(x, m, tuple(z), (label(z[1], of_meta), label(z[0], of_text)))

        n_text, first, n_meta, linear, square = sums(needed, taught, np.float32)
        first, linear, square = first.reshape(2 * GROUPS, -1), linear.reshape(2 * GROUPS, -1), square.reshape(2 * GROUPS, len(beta), len(beta))
        given = [int(n_text.sum()), int(n_meta.sum())]
        weight = [PSEUDO * w_own.sum() / g if g else 0.0 for g in given]
        mass = w_own.sum() * (1 + PSEUDO * (given[0] > 0))
        for _ in range(STEPS):
            r = w_own * (sigmoid(x_text.dot(content.beta) + content.bias) - y_own)
            gradient, of_bias = text_gradient(content, n_text, first, of_group)
            content.step((x_text.t_dot(r) + weight[0] * gradient) / mass, (r.sum() + weight[0] * of_bias) / mass)
            beta = meta_step(beta, x_meta, y_own, w_own, (n_meta, linear, square), of_group, weight[1])
        done.append((int(both[0].sum()), *given))
        shared.unpersist()
    bits.unpersist()
    fitted = Linear(content.beta, content.bias)
    z = [fitted.of_features(text)[held], scaled[held] @ beta]
    calibration = np.array([platt(v, y[held], w[held]) for v in z])
    logits = np.column_stack([np.clip(a * v + b, -12, 12) for v, (a, b) in zip(z, calibration, strict=True)])
    return Model(fitted, beta, scale, calibration, logistic(logits, y[held], w[held], ridge=1.0), done)


def _trained(docs: DataFrame, labels: DataFrame, carry: list[str]) -> tuple[DataFrame, str, Model]:
    features, path = stage_features(docs, carry)
    sample = labelled_sample(features, labels, "quality", [field.split()[0] for field in FEATURES.split(", ")], per_class=PER_CLASS)
    return features, path, fit(sample, features)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    _, path, model = _trained(docs, labels, ["doc_id"])
    remove(docs.sparkSession, path)
    return model


def _rated(features: DataFrame, model: Model) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast(model)  # 3 x 2^16 weights

    def run(*columns: pa.Array) -> pa.Array:
        model = shared.value
        if model.content is None:
            return pa.array(np.ones(len(columns[0])))
        x, m = _views(pa.RecordBatch.from_arrays(list(columns), names))
        return pa.array(model.combined([model.content.of_features(x), meta_logit(m, model.meta, model.scale)]))

    names = [field.split()[0] for field in FEATURES.split(", ")]
    return features.select("own", column_of(run, SLICE_BYTES)(*names).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """What score_documents gives under a model trained on docs, from the features staged for training."""
    features, _, model = _trained(docs, labels, ["doc_id"])
    return _rated(features, model).select("own.doc_id", "score", (F.col("score") >= keep_at).alias("kept"))


def filter_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that score at least keep_at under a model trained on docs, all columns as they are.

    Rows travel with their features, so texts are read once. What holds for
    keep_good's odd rows holds here.
    """
    features, _, model = _trained(docs, labels, docs.columns)
    return _rated(features, model).where(F.col("score") >= keep_at).select("own.*")


def score_documents(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, score, kept) of each whole text, one row per input row.

    score is the calibrated probability of good quality. Null text, lang,
    source and n_chars count as empty or zero. Repeated rows, and rows without
    a doc_id, are scored each for itself. Other columns are not read. An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 x 2^16 weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.scores(per_worker(shared, Model.scorer), *batch.columns[1:])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= keep_at)], ["doc_id", "score", "kept"])

    return map_batches(docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")), run, "doc_id long, score double, kept boolean", SLICE_BYTES)


def keep_good(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that score at least keep_at, all columns as they are, without a shuffle.

    Null text, lang, source and n_chars count as empty or zero. Repeated rows,
    and rows without a doc_id, are rated each for itself. An empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rated = column_of(lambda *columns: pa.array(shared.value.scores(per_worker(shared, Model.scorer), *columns)), SLICE_BYTES)
    return docs.where(rated("text", "lang", "source", F.col("n_chars").cast("long")) >= keep_at)
