"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches, stage
from .links import Forest, components

RADIUS = 3
SEED = 42
SHINGLE_WORDS = 3
TILE_ROWS = 4096
#: Rows of a tile that are compared at once.
CHUNK_ROWS = 256


def fingerprint(text: bytes, seed: int = SEED, words: int = SHINGLE_WORDS) -> int:
    """64 bits; each is 1 if it is set in over half of the shingles' hashes. No words: zero."""
    tokens = text.lower().split()  # bytes: A-Z only, and white space is space and 0x09-0x0D
    if not tokens:
        return 0
    digest = xxhash.xxh64_digest
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    hashes = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, seed: int = SEED, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number), one row per input row; null text: zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = pc.fill_null(batch.column(1), "").cast(pa.binary())
        fp = np.array([fingerprint(x.as_py(), seed, words) for x in raw], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _compare(batch: pa.RecordBatch, radius: int) -> pa.RecordBatch:
    """A spanning forest of the links of each tile pair."""
    u, v = [], []
    for row in batch.to_pylist():
        fp_a, fp_b = (np.array(row[k], np.int64).view(np.uint64) for k in ("fps_a", "fps_b"))
        reps = np.array(row["reps_a"] + row["reps_b"], np.int64)
        ones_a, ones_b = np.bitwise_count(fp_a), np.bitwise_count(fp_b)
        # Within a tile pair, stretches of one chunk are skipped by population count as well.
        order_a, order_b = np.argsort(ones_a, kind="stable"), np.argsort(ones_b, kind="stable")
        sorted_b = ones_b[order_b].astype(np.int64)
        forest = Forest(len(reps))
        for at in range(0, len(fp_a), CHUNK_ROWS):
            rows = order_a[at : at + CHUNK_ROWS]
            lo, hi = int(ones_a[rows[0]]) - radius, int(ones_a[rows[-1]]) + radius
            cols = order_b[np.searchsorted(sorted_b, lo) : np.searchsorted(sorted_b, hi, "right")]
            if len(cols):
                i, j = np.nonzero(np.bitwise_count(fp_a[rows, None] ^ fp_b[cols]) <= radius)
                forest.link(rows[i], cols[j] + len(fp_a))
        child, root = forest.edges()
        keep = reps[child] != reps[root]
        u.append(reps[child][keep])
        v.append(reps[root][keep])
    join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([join(u), join(v)], ["u", "v"])


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) between representatives whose fingerprints differ in at most `radius` bits.

    `prints`: (fp, rep), each fp once. The links returned connect the same
    representatives as all links do.

    Fingerprints that differ in at most `radius` bits agree on one of
    radius + 1 blocks of bits, so tiles hold fingerprints that share some low
    bits of a block: as many bits as keep a tile near `tile_rows`. A tile
    further holds one band of population counts, radius + 1 wide; tiles two
    bands apart differ beyond the radius and are never paired. Tiles that
    are still too large are dealt out by hash, and all their chunks meet.
    """
    blocks = radius + 1
    width = 64 // blocks
    n = prints.count()
    bits = min(width, max(0, math.ceil(math.log2(max(1, n / tile_rows)))))
    low = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << bits) - 1)).alias("low")) for k in range(blocks)]
    dealt = prints.select("fp", "rep", F.explode(F.array(*low)).alias("b"), (F.bit_count("fp") / F.lit(blocks)).cast("int").alias("band"))
    dealt = dealt.select("fp", "rep", "b.block", "b.low", "band")
    key = ["block", "low", "band"]
    sizes = dealt.groupBy(key).agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("chunks"))
    sizes = stage(sizes, "tile-sizes")

    # Only the few tiles beyond the limit need more than one chunk.
    large = sizes.where("chunks > 1")
    chunked = dealt.join(large, key, "left").select("fp", "rep", *key, F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    tiles = chunked.groupBy(*key, "chunk").agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
    tiles = stage(tiles, "tiles")

    one = sizes.select("block", "low", F.col("band").alias("band_a"), F.col("chunks").alias("n_a"))
    other = sizes.select("block", "low", F.col("band").alias("band_b"), F.col("chunks").alias("n_b"))
    near = one.select("*", F.explode(F.array(F.col("band_a"), F.col("band_a") + 1)).alias("band_b")).join(other, ["block", "low", "band_b"])
    pairs = near.select("block", "low", "band_a", "band_b", "n_b", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)).alias("chunk_a"))
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("chunk_b")).where("band_a < band_b or chunk_a <= chunk_b")
    side = lambda s: tiles.select("block", "low", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "chunk", "fps", "reps")))
    met = pairs.join(side("a"), ["block", "low", "band_a", "chunk_a"]).join(side("b"), ["block", "low", "band_b", "chunk_b"])
    return map_batches(met.select("fps_a", "reps_a", "fps_b", "reps_b"), lambda batch: _compare(batch, radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links all documents by fingerprint: (doc_id, fingerprint, component_id), one row per input row.

    A null text counts as empty; texts without words have fingerprint zero
    and link like any other. Repeated rows repeat in the result. Rows without
    a doc_id take part under no name: their component_id is that of the
    documents they link with, or null. Other columns are not read. An empty
    table gives an empty result.
    """
    marked = stage(fingerprints(docs), "fingerprints")
    prints = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "prints")
    found = components(links(prints, radius)).withColumnRenamed("node", "rep")
    named = prints.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = stage(named, "named")
    return marked.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one of each group: that with the smallest doc_id. All columns stay.

    Of rows that repeat a doc_id one stays; rows without a doc_id all stay.
    """
    linked = near_duplicates(docs, radius)
    gone = linked.where("component_id < doc_id").select("doc_id").distinct()
    gone = stage(gone, "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
