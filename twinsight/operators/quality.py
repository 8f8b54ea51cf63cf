"""Validation roll-ups, counts, image checks and manifests' statistics."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_FACES = 4
MAX_BYTES, MAX_VERTICES = 5 * 1024 * 1024, 200_000


def mesh_valid(faces: Column, vertices: Column) -> Column:
    return F.coalesce((faces >= MIN_FACES) & (vertices >= MIN_FACES), F.lit(False))


def within_limits(length: Column, vertices: Column) -> Column:
    return F.coalesce((length <= MAX_BYTES) & (vertices <= MAX_VERTICES), F.lit(False))


def rollup(rows: DataFrame, mode: str, tier: str, status: str, source_label: str = "source") -> DataFrame:
    """(level, key, n): totals by mode, tier and status, and of all, in one pass; a null tier is a source."""
    known = rows.select(F.col(mode).alias("mode"), F.coalesce(F.col(tier), F.lit(source_label)).alias("tier"), F.col(status).alias("status"))
    sets = known.groupingSets([["mode"], ["tier"], ["status"], []], "mode", "tier", "status").agg(F.grouping_id("mode", "tier", "status").alias("g"), F.count("*").alias("n"))
    level = F.when(F.col("g") == 3, "mode").when(F.col("g") == 5, "tier").when(F.col("g") == 6, "status").otherwise("all")
    return sets.select(level.alias("level"), F.coalesce("mode", "tier", "status", F.lit("all")).alias("key"), "n")


def top_with_rest(rows: DataFrame, key: str, k: int, rest: str = "other") -> DataFrame:
    """(key, n): the k most common values by count, then key; all others together."""
    counts = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "key").limit(k).select("key", F.lit(True).alias("top"))
    return counts.join(top, "key", "left").groupBy(F.when(F.col("top"), F.col("key")).otherwise(F.lit(rest)).alias("key")).agg(F.sum("n").alias("n"))


def face_ratios(clones: DataFrame, sources: DataFrame) -> DataFrame:
    """clones (clone_id, source_uid, faces, vertices) with source_faces, face_ratio and valid."""
    s = sources.select(F.col("uid").alias("source_uid"), F.col("faces").alias("source_faces"))
    return clones.join(s, "source_uid").select("clone_id", "source_uid", "faces", "source_faces", F.round(F.col("faces") / F.greatest("source_faces", F.lit(1)), 3).alias("face_ratio"), mesh_valid(F.col("faces"), F.col("vertices")).alias("valid"))


def image_label(alpha_max: Column, foreground: Column, deviation: Column, exists: Column, corrupt: Column, ndim: Column) -> Column:
    """Of pixel statistics; the order of the checks matters."""
    return (
        F.when(~exists, "missing").when(corrupt, "corrupt").when(ndim < 3, "flat_color")
        .when((alpha_max == 0) | (foreground < 10), "blank_alpha").when(deviation < 1.0, "flat_color").otherwise("ok")
    )


#: Fixed values of the format: samples of a pixel by colour type; first column, first row and steps of an interlaced image's passes.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(raw: bytes, height: int, stride: int, reach: int) -> np.ndarray:
    """Bytes (height, stride) of filtered rows; a pixel has `reach` bytes.

    A byte depends on those to its left and above, so the pixels of a diagonal
    are worked out at once.
    """
    lines = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    kinds, width = lines[:, 0], stride // reach
    body = lines[:, 1:].reshape(height, width, reach)
    got = np.zeros((height + 1, width + 1, reach), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = got[y + 1, x], got[y, x + 1], got[y, x]
        off = [np.abs(left + up - corner - v) for v in (left, up, corner)]
        nearest = np.where((off[0] <= off[1]) & (off[0] <= off[2]), left, np.where(off[1] <= off[2], up, corner))
        add = np.choose(kinds[y][:, None], (np.zeros_like(left), left, up, (left + up) // 2, nearest))
        got[y + 1, x + 1] = (body[y, x] + add) & 255
    return got[1:, 1:].reshape(height, stride).astype(np.uint8)


def _samples(rows: np.ndarray, width: int, samples: int, depth: int, scale: int) -> np.ndarray:
    """8-bit samples (height, width, samples) of unfiltered rows; of 16 bits the high ones."""
    if depth >= 8:
        return rows.reshape(len(rows), width, samples, depth // 8)[..., 0]
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1]) * scale)[:, :width, None]


def read_png(raw: bytes) -> np.ndarray:
    """8-bit samples of a PNG: (h, w) of grey values or palette places, else (h, w, channels)."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at < len(raw):
        (size,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    samples, flat, at = SAMPLES[colour], zlib.decompress(b"".join(data)), 0
    scale = 255 // ((1 << depth) - 1) if depth < 8 and colour == 0 else 1
    pixels = np.zeros((height, width, samples), np.uint8)
    for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            stride = -(-w * samples * depth // 8)
            rows = _unfilter(flat[at : at + h * (stride + 1)], h, stride, max(1, samples * depth // 8))
            pixels[y::dy, x::dx] = _samples(rows, w, samples, depth, scale)
            at += h * (stride + 1)
    return pixels[:, :, 0] if samples == 1 else pixels


def image_stats(files: DataFrame) -> DataFrame:
    """(path, exists, corrupt, ndim, alpha_max, foreground, deviation) of files (path, content)."""

    def run(parts):
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                if content is None:
                    rows.append((path, False, False, 0, 0, 0, 0.0))
                    continue
                try:
                    px = read_png(bytes(content))
                    alpha = px[:, :, 3] if px.ndim == 3 and px.shape[2] == 4 else np.full(px.shape[:2], 255)
                    seen = px[alpha > 0][:, :3] if px.ndim == 3 else px[alpha > 0]
                    rows.append((path, True, False, px.ndim, int(alpha.max()), int((alpha > 0).sum()), float(seen.std()) if seen.size else 0.0))
                except Exception:  # any fault of a file is its label
                    rows.append((path, True, True, 0, 0, 0, 0.0))
            yield pd.DataFrame(rows, columns=["path", "exists", "corrupt", "ndim", "alpha_max", "foreground", "deviation"])

    return files.select("path", "content").mapInPandas(run, "path string, exists boolean, corrupt boolean, ndim int, alpha_max int, foreground long, deviation double")


def check_images(files: DataFrame) -> DataFrame:
    """(path, status) of files (path, content)."""
    s = image_stats(files)
    return s.select("path", image_label(*(F.col(c) for c in ("alpha_max", "foreground", "deviation", "exists", "corrupt", "ndim"))).alias("status"))
