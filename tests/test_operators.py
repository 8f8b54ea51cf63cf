"""Small cases whose results are known by hand."""

import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsight.functions import verdicts
from twinsight.functions.vectors import cosine, l2_normalise
from twinsight.functions.sql import register
from twinsight.operators import aggregate, ann, audit, blocks, cluster, encode, geometry, quality, rescore, retrieval, stats, truth
from twinsight.sources import manifests, sinks
from twinsight.streaming import ingest


def vectors(spark, rows):
    return spark.createDataFrame([(i, g, [float(x) for x in v]) for i, g, v in rows], "id long, grp long, vector array<double>")


def test_average_precision_by_hand(spark):
    # query 0: relevant 1 and 2, of which 1 is first and 2 third among 1, 3, 2
    v = vectors(spark, [(0, 7, [1, 0]), (1, 7, [1, 0.1]), (2, 7, [0, 1]), (3, 8, [1, 0.5])])
    ranks = blocks.relevant_ranks(v, v)
    assert {(r["c"], r["rank"]) for r in ranks.where("q = 0").collect()} == {(1, 1), (2, 3)}
    sizes = spark.createDataFrame([(0, 3), (3, 0)], "q long, n_relevant long")  # one relevant item is out of reach
    m = retrieval.query_metrics(ranks, sizes).collect()
    assert len(m) == 1 and m[0]["ap"] == pytest.approx((1 / 1 + 2 / 3) / 3) and m[0]["p10"] == pytest.approx(0.2)


def test_ties_go_by_id_and_zero_vectors_stay_zero(spark):
    v = vectors(spark, [(0, 1, [1, 0]), (5, 1, [1, 1]), (3, 2, [1, 1]), (4, 2, [0, 0])])
    near = [(r["c"], r["rank"]) for r in blocks.nearest(v, v, 2).where("q = 0").orderBy("rank").collect()]
    assert near == [(3, 1), (5, 2)]
    assert spark.range(1).select(l2_normalise(F.array(F.lit(0.0), F.lit(0.0))).alias("x")).first()["x"] == [0.0, 0.0]


def test_tiles_do_not_change_results(spark):
    rng = np.random.default_rng(0)
    v = vectors(spark, [(i, i % 5, rng.normal(size=6)) for i in range(60)]).cache()
    one = {tuple(r) for r in blocks.relevant_ranks(v, v).select("q", "c", "rank").collect()}
    many = {tuple(r) for r in blocks.relevant_ranks(v, v, tile_rows=7).select("q", "c", "rank").collect()}
    assert one == many and len(one) == 60 * 11
    assert {tuple(r) for r in blocks.nearest(v, v, 4).select("q", "c").collect()} == {tuple(r) for r in blocks.nearest(v, v, 4, tile_rows=7).select("q", "c").collect()}


def test_metrics_are_invariant_to_rotation_and_scale(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    a, b = (vectors(spark, [(i, i % 4, r) for i, r in enumerate(y)]) for y in (x, 3 * x @ q))
    places = lambda v: {tuple(r) for r in blocks.relevant_ranks(v, v).select("q", "c", "rank").collect()}
    assert places(a) == places(b)


def test_verdicts(spark):
    rows = spark.createDataFrame([("NO_EVIDENCE",), ("some evidence",), (None,)], "r string")
    assert [r[0] for r in rows.select(verdicts.is_evidence(F.col("r"))).collect()] == [False, True, False]


def test_judge_retries_then_gives_up(spark):
    def client():
        calls = {"n": 0}

        def ask(prompt, a, b):
            calls["n"] += 1
            if prompt == "bad" or calls["n"] == 1:
                raise OSError("down")
            return "EVIDENCE"

        return ask

    pairs = spark.createDataFrame([("good", b"1", b"2"), ("bad", b"1", None)], "prompt string, a binary, b binary").coalesce(1)
    got = {r["prompt"]: r["reply"] for r in rescore.ask(pairs, client, retries=2, wait=0.0).collect()}
    assert got == {"good": "EVIDENCE", "bad": None}


def test_missing_views_and_replies_are_uncertain_and_uncounted(spark):
    c = spark.createDataFrame([(1, 2, 0.9, None, True), (1, 3, 0.8, "DIFFERENT", False), (1, 4, 0.7, "different", True)], "q long, c long, sim double, reply string, has_views boolean")
    got = {r["c"]: (r["stage2"], r["counted"]) for r in rescore.screened(c).collect()}
    assert got == {2: ("UNCERTAIN", False), 3: ("UNCERTAIN", False), 4: ("DIFFERENT", True)}


def test_thresholds_below_the_mined_floor_are_refused(spark):
    with pytest.raises(ValueError):
        audit.by_threshold(spark.createDataFrame([], "a long, b long, sim double, split_a string, split_b string"), [0.9], 0.95)


def test_unknown_models_are_their_own_group(spark):
    t = truth.ground_truth(spark.createDataFrame([("a",)], "uid string"), spark.createDataFrame([("a_T1_v0", "a", "T1")], "clone_id string, source_uid string, tier string"))
    got = {r["model_id"]: r["source_uid"] for r in truth.resolve_sources(spark.createDataFrame([("a_T1_v0",), ("zz",)], "model_id string"), t).collect()}
    assert got == {"a_T1_v0": "a", "zz": "zz"}


def test_upper_median_and_empty_tables(spark):
    v = spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "x int")
    assert stats.upper_median_of(v, "x").first()["upper_median"] == 3
    assert stats.upper_median_of(v.limit(0), "x").count() == 0
    none = vectors(spark, [])
    assert blocks.nearest(none, none, 3).count() == 0 and blocks.similar(none, none, 0.1).count() == 0


def test_single_and_missing_views(spark):
    v = spark.createDataFrame([(1, 1, "b"), (1, 2, "c")], "model_id int, view_idx int, path string")
    m = spark.createDataFrame([(1,), (2,)], "model_id int")
    assert [r["path"] for r in aggregate.fill_views(v, m, 3).orderBy("view_idx").collect()] == ["b", "b", "c"]


def test_signed_ranks_with_ties(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (3.0, 0.0), (2.0, 2.0)], "a double, b double")
    r = stats.wilcoxon(rows, "a", "b").first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (3, 4.5, 1.5)


def test_obj_text():
    v, f = geometry.parse_obj("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0\nf 1/1/1 2/1 3 4\n")
    assert len(v) == 4 and f == [[0, 1, 2], [0, 2, 3]]
    assert geometry.parse_obj("v 0 0\nf 1 2 3") is None and geometry.parse_obj("") is None and geometry.parse_obj("v a b c") is None


def test_unit_cube_area_and_volume(spark):
    corners = [(float(x), float(y), float(z)) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    faces = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    v = spark.createDataFrame([("m", i, *c) for i, c in enumerate(corners)], "model_id string, v int, x double, y double, z double")
    f = spark.createDataFrame([("m", i, *t) for i, t in enumerate(faces)], "model_id string, face int, a int, b int, c int")
    r = geometry.areas(v, f).first()
    assert r["area"] == pytest.approx(6) and abs(r["volume"]) == pytest.approx(1)


def test_failing_edit_is_a_row(spark):
    def broken(v, f, rng):
        raise RuntimeError("no decimation here")

    mesh = spark.createDataFrame([("m", [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], [[0, 1, 2]])], "uid string, vertices array<array<double>>, faces array<array<int>>")
    r = geometry.make_clones(mesh, 1, edits={"T3": broken}).first()
    assert r["error"] == "no decimation here" and r["vertices"] is None


def png(pixels: np.ndarray) -> bytes:
    h, w, c = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_checks(spark):
    rng = np.random.default_rng(0)
    fine = rng.integers(0, 255, (20, 20, 4), dtype=np.uint8)
    fine[..., 3] = 255
    clear, flat = fine.copy(), np.full((20, 20, 4), 200, np.uint8)
    clear[..., 3] = 0
    rows = [("ok", bytearray(png(fine))), ("clear", bytearray(png(clear))), ("flat", bytearray(png(flat))), ("bad", bytearray(b"x")), ("none", None)]
    got = {r["path"]: r["status"] for r in quality.check_images(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"ok": "ok", "clear": "blank_alpha", "flat": "flat_color", "bad": "corrupt", "none": "missing"}


def test_manifests_tensors_and_results(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"uids": ["a", "b"], "category_map": {"a": "chair"}, "model_paths": {}}))
    got = manifests.source_models(manifests.read_json(spark, str(tmp_path / "s.json"), manifests.SOURCE_MANIFEST)).collect()
    assert {(r["uid"], r["category"]) for r in got} == {("a", "chair"), ("b", None)}
    (tmp_path / "c.json").write_text(json.dumps([{"clone_id": "a_T1_v0", "source_uid": "a", "tier": "T1"}]))
    assert manifests.read_json(spark, str(tmp_path / "c.json"), manifests.CLONE_MANIFEST).first()["faces"] is None
    buffer = io.BytesIO()
    np.savez(buffer, model_ids=np.array(["a", "b"]), embeddings=np.ones((2, 3, 4), np.float32))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "enc_base_lfd.npz").write_bytes(buffer.getvalue())
    t = manifests.load_tensors(spark, str(tmp_path / "t"))
    assert t.count() == 6 and t.first()["encoder"] == "enc_base" and t.first()["mode"] == "lfd"
    sinks.write_tensors(t, str(tmp_path / "views"))
    assert spark.read.parquet(str(tmp_path / "views")).where("mode = 'lfd'").count() == 6
    (tmp_path / "r.json").write_text(json.dumps({"x_y_z_mean8": {"mAP": 0.5}, "view_ablation": {"n1": 0.2}}))
    assert manifests.results_long(spark, str(tmp_path / "r.json")).collect()[0]["value"] == 0.5
    assert manifests.view_ablation(spark, str(tmp_path / "r.json")).first()["map"] == 0.2


def test_discovery(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "clones" / "T1").mkdir(parents=True)
    (tmp_path / "src" / "m_1.obj").write_text("v 0 0 0")
    (tmp_path / "clones" / "T1" / "m_1_T1_v0.obj").write_text("v 0 0 0")
    got = {(r["model_id"], r["source_uid"], r["tier"]) for r in manifests.discover(spark, str(tmp_path / "src"), str(tmp_path / "clones")).collect()}
    assert got == {("m_1", "m_1", None), ("m_1_T1_v0", "m_1", "T1")}
    assert manifests.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "src")]).endswith("src")


def test_work_resumes(spark, tmp_path):
    work, done = spark.range(20), str(tmp_path / "done")
    sinks.run_in_batches(spark, work.where("id < 5"), done, ["id"], lambda b: b, 2)
    sinks.run_in_batches(spark, work, done, ["id"], lambda b: b, 2)
    assert sorted(r["id"] for r in spark.read.parquet(done).collect()) == list(range(20))


def test_streams(spark, tmp_path):
    v = vectors(spark, [(i, 0, [1.0, i / 10]) for i in range(6)])
    v.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.score_stream(ingest.read_embeddings(spark, str(tmp_path / "in"), v.schema), v, 0.99, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r["q"], r["c"]) for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["q"], r["c"]) for r in blocks.similar(v, v, 0.99).collect()}


def test_plans_limit_before_they_shuffle(spark):
    v = vectors(spark, [(i, 0, [1.0, i / 10]) for i in range(6)])
    plan = blocks.nearest(v, v, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_cosine_and_memory(spark):
    assert spark.range(1).select(cosine(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("x")).first()["x"] == pytest.approx(2**-0.5)
    assert ann.memory_mb(1_000_000, 768, "flat") == pytest.approx(3072)


def test_density_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (9, 0))] + [rng.uniform(-30, 40, (8, 2))])
    labels = cluster.density_labels(x)
    assert len(set(labels[labels >= 0])) == 3 and (labels[120:] == -1).sum() >= 6
    for k in range(3):
        own = labels[40 * k : 40 * k + 40]
        assert len(set(own[own >= 0])) == 1 and (own >= 0).mean() > 0.9
    v = vectors(spark, [(i, i % 2, p) for i, p in enumerate(x)])
    assert cluster.cluster(v).count() == len(x)


def test_encoder_boundary(spark):
    def make():
        def embed(images):
            if b"bad" in images:
                raise ValueError("cannot read")
            return np.array([[len(i), 1.0] for i in images])

        return embed

    rows = spark.createDataFrame([(1, 0, bytearray(b"xyz")), (1, 1, bytearray(b"bad")), (2, 0, None)], "model_id int, view_idx int, content binary")
    got = {(r["model_id"], r["view_idx"]): r["embedding"] for r in encode.embed_views(rows, make).collect()}
    assert got[1, 1] == got[2, 0] == [0.0, 1.0] and got[1, 0][0] == pytest.approx(3 / 10**0.5)


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select vec_dot(array(1D, 2D), array(3D, 4D)) d, vec_cosine(array(1D, 0D), array(1D, 1D)) c, vec_normalise(array(0D, 0D)) z, safe_div(1D, 0D) s").first()
    assert (r["d"], r["z"], r["s"]) == (11, [0, 0], 0) and r["c"] == pytest.approx(2**-0.5)


def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = spark.range(300).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 97).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.windowed(stream, "1 hour", delay="30 days").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in ingest.windowed(rows, "1 hour").collect()}
    dup = rows.select("ts", "event_type").unionByName(rows.select("ts", "event_type"))
    dup.repartition(2).write.parquet(str(tmp_path / "dup"))
    once = ingest.deduplicated(spark.readStream.schema(dup.schema).parquet(str(tmp_path / "dup")), ["ts", "event_type"], "30 days")
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 300


class Fixed:
    """A generator whose uniform draws are the middle of their range and whose noise is its deviation."""

    def __init__(self):
        self.real, self.scales, self.noise = np.random.default_rng(3), [], []

    def uniform(self, a, b, n=None):
        if n:
            self.scales.append((a, b))
        return (a + b) / 2 if n is None else np.full(n, (a + b) / 2)

    def normal(self, mean, deviation, shape):
        self.noise.append(deviation)
        return np.full(shape, mean + deviation)

    def choice(self, *args, **kwargs):
        return self.real.choice(*args, **kwargs)


def grid(n):
    v = np.array([[x, y, 0.0] for x in range(n + 1) for y in range(n + 1)]) * 7
    at = lambda x, y: x * (n + 1) + y
    return v, np.array([t for x in range(n) for y in range(n) for t in ((at(x, y), at(x + 1, y), at(x, y + 1)), (at(x + 1, y), at(x + 1, y + 1), at(x, y + 1)))])


@pytest.mark.parametrize(("tier", "scale", "noise", "faces"), [("T3", (0.7, 1.5), 0.03, 50), ("T4", (0.6, 1.6), 0.04, 40), ("T5", (0.7, 1.4), 0.025, 200)])
def test_edits_scale_noise_and_faces(tier, scale, noise, faces):
    """Noise is in the mesh's own units, whatever its extent; T4 removes an exact number of faces."""
    v, f = grid(5)
    rng = Fixed()
    got, left = geometry.EDITS[tier](v, f, rng)
    assert rng.scales == [scale] and rng.noise == [pytest.approx(noise)] and len(left) == faces
    if tier == "T3":
        assert np.allclose(got, v * 1.1 + 0.03)
    if tier == "T4":
        assert set(left.ravel()) == set(range(len(got)))
    if tier == "T5":
        assert np.ptp(got[:, 0]) == pytest.approx(35 * 1.05)


def test_t4_keeps_four_faces():
    v, f = grid(2)
    _, left = geometry.edit_t4(v, f[:4], np.random.default_rng(0))
    assert len(left) == 4  # a tenth and more would leave fewer, and 5 % of four is none


def test_obj_lines_may_be_indented():
    assert geometry.parse_obj("  v 0 0 0\n\tv 1 0 0\n v  0 1 0 \n   f 1//2 2/1 3 ") == ([[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 1, 2]])


def test_points_of_surfaces(spark):
    """Points lie on the triangles, their numbers follow areas; without area they are vertices, no more than there are."""
    flat = ("flat", [[0.0, 0.0, 0.0], [3.0, 0.0, 0.0], [0.0, 1.0, 0.0], [3.0, 1.0, 0.0], [3.0, 4.0, 0.0]], [[0, 1, 2], [1, 3, 2], [2, 3, 4]])
    line = ("line", [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0, 0.0]], [[0, 1, 2]])
    meshes = spark.createDataFrame([flat, line], "model_id string, vertices array<array<double>>, faces array<array<int>>")
    got = geometry.sample_surface(meshes, 4000).toPandas()
    p = got[got.model_id == "flat"]
    assert len(p) == 4000 and (p.z == 0).all() and p.x.between(0, 3).all() and p.y.between(0, 4).all()
    assert (p.y <= 1).mean() == pytest.approx(3 / 7.5, abs=0.03)  # rectangle 3 x 1 beside a triangle of 4.5
    rest = got[got.model_id == "line"]
    assert len(rest) == 3 and set(rest.x) <= {0.0, 1.0, 2.0}


def test_density_without_a_matrix(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (60, 3)) for c in (0, 4, 9)] + [rng.uniform(-20, 20, (15, 3))])
    whole = cluster.density_labels(x)
    monkeypatch.setattr(cluster, "CHUNK_DISTANCES", 1000)
    assert (cluster.density_labels(x) == whole).all() and len(set(whole.tolist()) - {-1}) == 3


def test_roles_tiers_and_configurations(spark, tmp_path):
    from twinsight.operators import reporting
    from twinsight.sources import sinks

    rows = [("s", True, None), ("a", False, "T1"), ("b", False, "T2"), ("x", None, None)]
    m = spark.createDataFrame(rows, "model_id string, is_source boolean, tier string")
    ids = lambda d: {r["model_id"] for r in d.collect()}
    assert ids(retrieval.of_tier(m, "T1")) == {"a", "x"} and ids(retrieval.of_tier(m, "T2", sources=True)) == {"s", "b", "x"} and len(ids(retrieval.of_tier(m, "all"))) == 4
    assert ids(reporting.select_roles(m, ["source"])) == {"s"} and ids(reporting.select_roles(m, ["clone"], ["T2"])) == {"b"}
    assert ids(reporting.select_roles(m, ["source", "clone"], ["T1"])) == {"s", "a"} and len(ids(reporting.select_roles(m))) == 4
    r = spark.createDataFrame([("clip_mean_8", "plain", 0.5), ("clip_max_8", "shaded", 0.7), ("dino_mean_8", "shaded", 0.9), (None, "plain", 0.7)], "config string, mode string, ap double")
    names = lambda **k: {x["config"] for x in reporting.configurations(r, **k).collect()}
    assert names(starts="clip") == {"clip_mean_8", "clip_max_8"} and names(contains="mean", lacks="dino") == {"clip_mean_8"} and len(names()) == 3
    modes = {x["mode"]: x for x in reporting.render_modes(r, ["ap"]).collect()}
    assert modes["plain"]["ap_gain"] == 0 and modes["shaded"]["ap_gain"] == pytest.approx(0.2) and modes["shaded"]["n"] == 2
    both = {x["mode"]: (x["n"], x["ap"]) for x in sinks.write_both(r, f"file://{tmp_path}/out", ["mode"], ["ap"]).collect()}
    assert both == {"plain": (2, pytest.approx(0.6)), "shaded": (2, pytest.approx(0.8))}
    assert spark.read.parquet(f"file://{tmp_path}/out/detailed").count() == 4


@pytest.mark.parametrize("tile", [7, 4096])
def test_places_and_sums_by_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(blocks, "PART_TILES", 2)
    monkeypatch.setattr(blocks, "TILE_RELEVANT", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(45, 4))
    x[10:20] = x[3]  # ties
    ids, grp = np.arange(45) * 7 % 101 - 30, np.where(np.arange(45) < 25, 1, np.arange(45))  # one group holds most
    v = vectors(spark, [(int(i), int(g), r) for i, g, r in zip(ids, grp, x)]).cache()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    want = set()
    for a in range(45):
        order = sorted((b for b in range(45) if b != a), key=lambda b: (-sims[a, b], ids[b]))
        want |= {(ids[a], ids[b], k + 1) for k, b in enumerate(order) if grp[a] == grp[b]}
    assert {tuple(r) for r in blocks.relevant_ranks(v, v, tile_rows=tile).select("q", "c", "rank").collect()} == want
    upper = [(a, b) for a in range(45) for b in range(45) if ids[a] < ids[b]]
    pairs = {(r["q"], r["c"]) for r in blocks.similar(v, v, 0.4, ordered=True, tile_rows=tile).collect()}
    assert pairs == {(ids[a], ids[b]) for a, b in upper if sims[a, b] >= 0.4}
    assert sum(r["n"] for r in blocks.histogram(v, -1.0, 0.1, 21, tile_rows=tile).collect()) == len(upper)
    for kind in (True, False):
        some = np.sort([sims[a, b] for a, b in upper if (grp[a] == grp[b]) == kind])
        at = [0, len(some) // 2, len(some) - 1]
        assert blocks.class_places(v, {kind: at}, bins=64, tile_rows=tile)[kind] == pytest.approx(some[at], abs=1e-8)


def test_stages_are_written_and_not_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def judge():
        import uuid

        def answer(prompt, a, b):
            (calls / uuid.uuid4().hex).write_text(prompt)
            if "screen" in prompt:
                return "DIFFERENT" if b == b"x" else "LIKELY_DUPLICATE"
            return "EVIDENCE" if a == b else "NO_EVIDENCE"

        return answer

    near = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.7), (1, 5, 0.6)], "q long, c long, sim double")
    have = [(m, v, bytearray(b"same")) for m in (1, 2) for v in range(4)] + [(3, v, bytearray(b"x")) for v in range(4)] + [(5, 0, bytearray(b"same")), (5, 2, bytearray(b"same"))]
    views = spark.createDataFrame(have, "model_id long, view_idx int, content binary")
    args = (near, views, judge, str(tmp_path / "run"), "screen", "angle %d", 4, 3)
    rows = {r["c"]: (r["stage2"], r["counted"], r["evidence_count"], r["outcome"]) for r in rescore.run_stages(*args).collect()}
    assert rows == {
        2: ("LIKELY_DUPLICATE", True, 4, "confirmed"),
        3: ("DIFFERENT", True, None, "stage2"),
        4: ("UNCERTAIN", False, 0, "stage3"),  # no views: uncertain, all angles skipped
        5: ("LIKELY_DUPLICATE", True, 2, "stage3"),
    }
    evidence = spark.read.parquet(str(tmp_path / "run" / "evidence"))
    assert evidence.where("reply = 'SKIPPED'").count() == 4 + 2
    asked = sorted(f.read_text() for f in calls.iterdir())
    assert len(asked) == 3 + 4 + 2 and asked.count("angle 180") == 2
    again = rescore.run_stages(*args)
    assert again.count() == 4 and len(list(calls.iterdir())) == len(asked)
    truth_ = spark.createDataFrame([(1, 1, None), (2, 1, "T1"), (3, 9, "T2"), (4, 9, "T1"), (5, 1, "T3")], "model_id long, source_uid long, tier string")
    table = {(r["method"], r["tier"]): (r["tp"], r["fp"], r["relevant"]) for r in rescore.compare(again, truth_, near.select("q").distinct()).collect()}
    assert table["embedding", "all"] == (2, 2, 2) and table["rescorer", "all"] == (1, 0, 2)
    assert table["embedding", "T1"] == (1, 1, 1) and table["rescorer", "T3"] == (0, 0, 1)


def test_probes_are_counted_before_they_are_broadcast(spark, monkeypatch):
    v = vectors(spark, [(1, 0, [1, 0]), (2, 0, [0, 1]), (3, 0, [1, 0.1])])
    probes = spark.createDataFrame([(9, [1.0, 0.0])], "q long, qv array<double>")
    assert {(r["q"], r["c"]) for r in ingest.score_small(v, probes, 0.9).collect()} == {(9, 1), (9, 3)}
    monkeypatch.setattr(ingest, "MAX_PROBES", 0)
    with pytest.raises(ValueError, match="score_stream"):
        ingest.score_small(v, probes, 0.9)


@pytest.mark.parametrize("tile", [3, None])
def test_whole_rankings_in_one_task_by_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 3)), 1)
    x[10:18] = x[3]  # ties
    ids, grp = np.arange(40) * 11 % 97 - 20, np.arange(40) % 3
    v = spark.createDataFrame([(int(i), int(g), [float(y) for y in r], float(i)) for i, g, r in zip(ids, grp, x)], "id long, grp long, vector array<double>, mark double").cache()

    def want(sims, least=-9.0):
        for a in range(40):
            order = sorted((b for b in range(40) if b != a and sims[a, b] >= least), key=lambda b: (-np.round(sims[a, b], 12), ids[b]))
            yield from ((ids[a], ids[b], k + 1, len(order), round(sims[a, b], 9)) for k, b in enumerate(order) if grp[a] == grp[b])

    def found(**how):
        each = lambda r: [(r.q, int(c), int(p), r.pool, float(s)) for c, p, s, m in zip(r.ids, r.places, r.sims, r.marks, strict=True) if m == c]
        rows = blocks.ranked(v, v, each, "q long, c long, rank long, pool long, sim double", tile_rows=tile, **how).collect()
        assert len(rows) == len({(r["q"], r["c"]) for r in rows})
        return {(r["q"], r["c"], r["rank"], r["pool"], round(r["sim"], 9)) for r in rows}

    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert found() == set(want(u @ u.T))
    assert found(least=0.2, raw=True) == set(want(x @ x.T, 0.2))


def test_rankings_of_large_groups_stay_in_their_tasks(spark):
    v = vectors(spark, [(i, i % 2, [1.0, i / 50]) for i in range(50)])
    plan = retrieval.ranked_metrics(v, v)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "relevant" not in plan.replace("n_relevant", "")
    ranks = blocks.relevant_ranks(v, v)
    sizes = v.select(F.col("id").alias("q"), F.lit(24).alias("n_relevant"))
    order = ["q", "n_relevant", "ap", "p1", "p5", "p10", "r10", "r50"]
    one = retrieval.query_metrics(ranks, sizes).select(order).orderBy("q").collect()
    two = retrieval.ranked_metrics(v, v).select(order).orderBy("q").collect()
    assert [tuple(r) for r in two] == [pytest.approx(tuple(r)) for r in one]


def test_hashed_and_listed_neighbours_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TILE_ROWS", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 6))
    x[20:50] = x[4]  # more copies than neighbours asked for
    v = vectors(spark, [(i * 3, 0, r) for i, r in enumerate(x)]).cache()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)

    def want(may):
        return {(a * 3, b * 3, k + 1) for a in range(90) for k, b in enumerate(sorted((b for b in range(90) if b != a and may(a, b)), key=lambda b: (-sims[a, b], b))[:5])}

    got = lambda df: {tuple(r) for r in df.select("q", "c", "rank").collect()}
    assert got(blocks.nearest(v, v, 5)) == want(lambda a, b: True)
    h = np.floor(u @ ann._projections(6, 3, 42) / 0.5)
    assert got(ann.hashed_neighbours(v, v, 5, bucket=0.5, tables=3, within=1.0)) == want(lambda a, b: (h[a] == h[b]).any() and sims[a, b] > 0.5)
    index = ann.InvertedFile(v, 4)
    cell = {r["id"] // 3: r["cell"] for r in index.lists.collect()}
    far = ((u[:, None] - np.array(index.centroids)[None]) ** 2).sum(-1).argsort(axis=1, kind="stable")[:, :2]
    assert got(index.search(v, 5, 2)) == want(lambda a, b: cell[b] in far[a])
    for found in (ann.hashed_neighbours(v, v, 5), index.search(v, 5, 2)):  # pairs are compared in tiles, not joined by bucket or cell
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "cell#" not in plan.split("MapInArrow")[0]


def test_distances_of_many_pairs_at_once(spark, monkeypatch):
    monkeypatch.setattr(geometry, "CLOUD_TILE", 20)
    monkeypatch.setattr(geometry, "PAIR_POINTS", 12)  # clouds of four points go pair by pair
    rng = np.random.default_rng(2)
    cloud = {f"m{k:03}": np.round(rng.normal(size=(2 + k % 3, 3)), 2) for k in range(60)}
    df = spark.createDataFrame([(k, int(k[1:]) % 7 == 0, [[float(y) for y in p] for p in c]) for k, c in cloud.items()], "model_id string, source_uid boolean, points array<array<double>>")
    found = geometry.group_distances(df)
    got = found.collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == 9 * 8 // 2 + 51 * 50 // 2
    for r in got:
        assert r["a"] < r["b"] and (r["chamfer"], r["hausdorff"]) == pytest.approx(geometry._both_ways(cloud[r["a"]], cloud[r["b"]], 512))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # tiles, not a row for each pair
