"""Sources, sinks, selectors and images at the edges of the engine."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsight.operators import encode, geometry, quality, reporting, retrieval, stats, truth
from twinsight.sources import manifests, sinks


def filtered(rows: np.ndarray, reach: int, kinds) -> bytes:
    """Rows of bytes under filters, by the format's definition, a byte at a time."""
    out = b""
    for y, line in enumerate(rows.astype(int)):
        kind = int(kinds[y])
        got = []
        for i, v in enumerate(line):
            left = line[i - reach] if i >= reach else 0
            up = rows[y - 1].astype(int)[i] if y else 0
            corner = rows[y - 1].astype(int)[i - reach] if y and i >= reach else 0
            p = left + up - corner
            near = min((left, up, corner), key=lambda c, p=p: abs(p - c))
            got.append((v - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        out += bytes([kind, *got])
    return out


def png(raw: bytes, width: int, height: int, depth: int, colour: int, interlaced: int = 0) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = zlib.compress(raw)
    parts = chunk(b"IDAT", data[: len(data) // 2]) + chunk(b"IDAT", data[len(data) // 2 :])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + parts + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "samples"), [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
def test_png_filters(colour, samples, depth):
    rng = np.random.default_rng(colour + depth)
    px = rng.integers(0, 256, (11, 7, samples, depth // 8), dtype=np.uint8)
    rows = px.reshape(11, -1)
    got = quality.read_png(png(filtered(rows, samples * depth // 8, rng.integers(0, 5, 11)), 7, 11, depth, colour))
    want = px[..., 0]
    assert np.array_equal(got, want[..., 0] if samples == 1 else want)


@pytest.mark.parametrize(("depth", "colour", "scale"), [(1, 0, 255), (2, 0, 85), (4, 0, 17), (4, 3, 1)])
def test_png_of_few_bits(depth, colour, scale):
    rng = np.random.default_rng(depth)
    px = rng.integers(0, 1 << depth, (5, 9))
    rows = np.stack([np.packbits([int(b) for v in line for b in f"{v:0{depth}b}"]) for line in px])
    got = quality.read_png(png(filtered(rows, 1, rng.integers(0, 5, 5)), 9, 5, depth, colour))
    assert np.array_equal(got, px * scale)


@pytest.mark.parametrize(("width", "height"), [(13, 10), (1, 1), (3, 2)])
def test_interlaced_png(width, height):
    rng = np.random.default_rng(width)
    px = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
    raw = b""
    for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        part = px[y::dy, x::dx]
        if part.size:
            raw += filtered(part.reshape(len(part), -1), 4, rng.integers(0, 5, len(part)))
    assert np.array_equal(quality.read_png(png(raw, width, height, 8, 6, 1)), px)


def test_labels_of_valid_kinds_of_png(spark):
    rng = np.random.default_rng(1)
    deep = rng.integers(0, 256, (16, 16, 6), dtype=np.uint8).reshape(16, -1)
    rows = [("deep", bytearray(png(filtered(deep, 6, [4] * 16), 16, 16, 16, 2))), ("palette", bytearray(png(filtered(deep[:, :16], 1, [1] * 16), 16, 16, 8, 3))), ("cut", bytearray(png(filtered(deep, 6, [4] * 16), 16, 16, 16, 2)[:200]))]
    got = {r["path"]: r["status"] for r in quality.check_images(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"deep": "ok", "palette": "flat_color", "cut": "corrupt"}


@pytest.mark.parametrize(("ranges", "per"), [(1, 1), (4, 2), (64, 16), (200, 1)])
def test_sums_of_rows_before(spark, ranges, per):
    keys = [None, *range(-20, 80)]
    rows = spark.createDataFrame([(k, (k or 0) % 7) for k in keys], "k long, v long").repartition(5)
    got = {r["k"]: r["_before"] for r in stats.with_before(rows, "k", F.col("v"), ranges, per).collect()}
    upto, want = 0, {}
    for k in keys:
        want[k] = upto
        upto += (k or 0) % 7
    assert got == want
    assert stats.with_before(rows.limit(0), "k", F.col("v")).count() == 0


def test_medians_of_real_and_text_values(spark):
    rng = np.random.default_rng(2)
    x = sorted(rng.normal(size=3001).tolist())
    rows = spark.createDataFrame([(v, f"{v:.9f}") for v in x], "x double, t string").repartition(4)
    got = stats.upper_median_of(rows, "x").first()
    assert (got["upper_median"], got["n"]) == (x[1500], 3001)
    assert stats.upper_median_of(rows, "t").first()["upper_median"] == sorted(f"{v:.9f}" for v in x)[1500]
    assert [r["x"] for r in stats.every_nth(rows, "x", 3).orderBy("x").collect()] == [x[0], x[1000], x[2000]]


def test_distances_of_all_pairs_of_a_group(spark):
    rng = np.random.default_rng(3)
    clouds = {k: rng.normal(size=(int(rng.integers(1, 9)), 3)) for k in range(12)}
    rows = [(k, 0 if k < 9 else 1, c.tolist()) for k, c in clouds.items()] + [(20, 0, []), (21, 0, None), (22, None, [[0.0, 0.0, 0.0]])]
    df = spark.createDataFrame(rows, "model_id long, source_uid long, points array<array<double>>")
    for salts in (1, 5):
        got = {(r["a"], r["b"]): (r["chamfer"], r["hausdorff"]) for r in geometry.group_distances(df, salts, block=2).collect()}
        assert set(got) == {(a, b) for a in range(12) for b in range(a + 1, 12) if (a < 9) == (b < 9)}
        for (a, b), (chamfer, hausdorff) in got.items():
            d = np.linalg.norm(clouds[a][:, None] - clouds[b][None], axis=2)
            assert chamfer == pytest.approx((d.min(0).mean() + d.min(1).mean()) / 2)
            assert hausdorff == pytest.approx(max(d.min(0).max(), d.min(1).max()))


def test_files_of_views_and_meshes(spark, tmp_path):
    for mode, model, view in (("lfd", "m1", 0), ("lfd", "m1", 11), ("lfd", "m0", 3), ("textured", "m2", 1)):
        (tmp_path / mode / model).mkdir(parents=True, exist_ok=True)
        (tmp_path / mode / model / f"view_{view:02d}.png").write_bytes(b"x")
    views = manifests.list_views(spark, str(tmp_path))
    assert {(r["mode"], r["model_id"], r["view_idx"]) for r in views.collect()} == {("lfd", "m1", 0), ("lfd", "m1", 11), ("lfd", "m0", 3), ("textured", "m2", 1)}
    assert [r["model_id"] for r in manifests.model_dirs(views, "lfd").collect()] == ["m0", "m1"]
    texts = [("a", bytearray(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")), ("b", bytearray(b"v 0 0 0\n")), ("c", None), ("d", bytearray(b"\xff\xfe"))]
    got = {r["path"]: r for r in geometry.load_obj(spark.createDataFrame(texts, "path string, content binary")).collect()}
    assert got["a"]["faces"] == [[0, 1, 2]] and len(got["a"]["vertices"]) == 3
    assert all(got[k]["vertices"] is None and got[k]["faces"] is None for k in "bcd")


def test_renderer_boundary(spark):
    mesh = spark.createDataFrame([("m", [[0.0, 0.0, 0.0]] * 3, [[0, 1, 2]], 4, [float(k) for k in range(16)])], "model_id string, vertices array<array<double>>, faces array<array<int>>, view_idx int, mvp array<float>")
    draw = lambda: lambda v, f, mvp, mode: f"{mode}:{len(v)}:{len(f)}:{mvp[3, 3]:.0f}".encode()
    got = {r["mode"]: bytes(r["content"]) for r in encode.render_views(mesh, draw).collect()}
    assert got == {"textured": b"textured:3:1:15", "lfd": b"lfd:3:1:15"}


def test_catalogs_and_curves(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"chair": ["u1", "u2"], "none": []}))
    assert {tuple(r) for r in manifests.landed_catalog(spark, str(tmp_path / "c.json")).collect()} == {("chair", "u1"), ("chair", "u2")}
    kind = "c struct<thresholds:array<double>,f1_scores:array<double>,precision_scores:array<double>,recall_scores:array<double>>"
    curve = spark.createDataFrame([(([0.1, 0.2], [0.5, 0.6], [0.7, 0.8], [0.3, 0.4]),)], kind)
    got = curve.select(manifests.curve_points(F.col("c")))
    assert got.columns == ["threshold", "f1", "precision", "recall"]
    assert [tuple(r) for r in got.collect()] == [(0.1, 0.5, 0.7, 0.3), (0.2, 0.6, 0.8, 0.4)]


def test_reports_and_edges(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0.5), (1, 3, None)], "id_a long, id_b long, dist double")
    sinks.write_edges(rows, str(tmp_path / "e"), "chamfer")
    sinks.write_edges(rows.limit(1), str(tmp_path / "e"), "hausdorff")
    sinks.write_edges(rows.limit(1), str(tmp_path / "e"), "hausdorff")  # a rerun replaces its own metric
    assert {(r["metric"], r["n"]) for r in spark.read.parquet(str(tmp_path / "e")).groupBy("metric").agg(F.count("*").alias("n")).collect()} == {("chamfer", 2), ("hausdorff", 1)}
    sinks.write_json(rows.repartition(3), str(tmp_path / "j"), one_file=True)
    assert len(list((tmp_path / "j").glob("part-*"))) == 1 and spark.read.json(str(tmp_path / "j")).count() == 2
    lines = [r["line"] for r in sinks.console_table(rows.orderBy("id_b"), {"id_b": 4, "dist": 6}).collect()]
    assert lines == ["2     0.5   ", "3     -     "]


def test_guards_of_mesh_files(spark):
    sizes = [(0, 0), (quality.MAX_BYTES, quality.MAX_VERTICES), (quality.MAX_BYTES + 1, 3), (3, quality.MAX_VERTICES + 1), (None, 3)]
    got = spark.createDataFrame(sizes, "length long, vertices long").select(quality.within_limits(F.col("length"), F.col("vertices")).alias("fits")).collect()
    assert [r["fits"] for r in got] == [True, True, False, False, False]


def test_relevant_pairs(spark):
    t = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "model_id string, source_uid string")
    assert {(r["q"], r["c"]) for r in truth.relevance_pairs(t).collect()} == {("a", "b"), ("b", "a")}
    assert {(r["model_id"], r["n_relevant"]) for r in truth.group_sizes(t).collect()} == {("a", 1), ("b", 1), ("c", 0)}


def test_tier_of_unknown_ids(spark):
    m = spark.createDataFrame([(1, True, None), (2, False, "T1"), (3, False, "T2"), (4, None, None)], "id long, is_source boolean, tier string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(retrieval.of_tier(m, "T1")) == [2, 4]
    assert ids(retrieval.of_tier(m, "T1", sources=True)) == [1, 2, 4]
    assert ids(retrieval.of_tier(m, "all")) == [1, 2, 3, 4]


def test_tables_behind_figures(spark):
    long = spark.createDataFrame([("x", "T1", 0.5), ("x", "T2", 0.25), ("y", "T1", 0.125)], "config string, tier string, v double")
    assert [tuple(r) for r in reporting.crossed(long, "config", "tier", ["T1", "T2"], "v").collect()] == [("x", 0.5, 0.25), ("y", 0.125, 0.0)]
    assert [r["config"] for r in reporting.in_order(long.select("config").distinct(), "config", ["y", "z", "x"]).collect()] == ["y", "x"]
    assert [r["tier"] for r in reporting.ranked(long, "v", "config").collect()] == ["T1", "T2", "T1"]
    one = spark.createDataFrame([(None, 0.5), (0.25, 0.75)], "embedding_precision double, precision double")
    assert [r["precision"] for r in reporting.tier_precision(one).collect()] == [0.5, 0.25]
    assert reporting.tier_precision(long).first()["precision"] == 0.0
