"""Meshes and point sets: distances, boxes, areas, normals, cameras and the graded edits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ring of cameras, field of view, clip planes relative to the camera's distance.
RING_VIEWS, RING_ELEVATION = 8, 30.0
FOV, NEAR, FAR = 45.0, 0.01, 20.0


def directed_nearest(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b, from, i, d): distance of each point of one cloud to the nearest of the other, both ways."""
    side = lambda s: points.select(F.col("model_id").alias(s), F.col("pt_idx").alias(f"i{s}"), F.struct("x", "y", "z").alias(f"p{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    d = F.sqrt(F.pow(F.col("pa.x") - F.col("pb.x"), 2) + F.pow(F.col("pa.y") - F.col("pb.y"), 2) + F.pow(F.col("pa.z") - F.col("pb.z"), 2))
    both = both.withColumn("d", d)
    there = both.groupBy("a", "b", F.col("ia").alias("i")).agg(F.min("d").alias("d")).withColumn("way", F.lit("ab"))
    back = both.groupBy("a", "b", F.col("ib").alias("i")).agg(F.min("d").alias("d")).withColumn("way", F.lit("ba"))
    return there.unionByName(back)


def cloud_distances(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b, chamfer, hausdorff): half the sum of both mean, and the larger of both greatest, nearest distances."""
    ways = directed_nearest(pairs, points).groupBy("a", "b", "way").agg(F.avg("d").alias("mean"), F.max("d").alias("most"))
    return ways.groupBy("a", "b").agg((F.sum("mean") / 2).alias("chamfer"), F.max("most").alias("hausdorff"))


def _least(x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
    """Distance of each point of x to the nearest of y."""
    return np.concatenate([np.sqrt(((x[k : k + block, None] - y[None]) ** 2).sum(-1)).min(1) for k in range(0, len(x), block)])


def _both_ways(x: np.ndarray, y: np.ndarray, block: int) -> tuple[float, float]:
    """Chamfer and Hausdorff distance."""
    ab, ba = _least(x, y, block), _least(y, x, block)
    return (ab.mean() + ba.mean()) / 2, max(ab.max(), ba.max())


#: Clouds and points of a tile, pairs of clouds that a kernel works on at once, and pairs of points up to which it does.
CLOUD_TILE, TILE_POINTS, PAIR_BLOCK, PAIR_POINTS = 1024, 1 << 17, 16384, 4096


def _pairs_of_tiles(x: list[np.ndarray], y: list[np.ndarray], block: int) -> tuple[np.ndarray, np.ndarray]:
    """(chamfer, hausdorff) matrices of all clouds of x with all of y; clouds of as many points are worked on together."""
    chamfer, hausdorff = np.empty((2, len(x), len(y)))
    sizes = [np.array([len(c) for c in t]) for t in (x, y)]
    for n in np.unique(sizes[0]):
        for m in np.unique(sizes[1]):
            rows, cols = np.flatnonzero(sizes[0] == n), np.flatnonzero(sizes[1] == m)
            if n * m > PAIR_POINTS:
                for i in rows:
                    for j in cols:
                        chamfer[i, j], hausdorff[i, j] = _both_ways(x[i], y[j], block)
                continue
            p, q = (np.ascontiguousarray(np.stack([t[k] for k in at]).transpose(1, 2, 0)) for t, at in ((x, rows), (y, cols)))  # points, coordinates, clouds
            step = max(1, PAIR_BLOCK // len(cols))
            for k in range(0, len(rows), step):
                part = p[:, :, k : k + step, None]
                there, back = (np.full((c, part.shape[2], len(cols)), np.inf) for c in (n, m))
                for i in range(n):
                    for j in range(m):
                        d = np.square(part[i, 0] - q[j, 0])
                        for axis in range(1, part.shape[1]):
                            step_d = part[i, axis] - q[j, axis]
                            d += np.square(step_d, out=step_d)
                        np.minimum(there[i], d, out=there[i])
                        np.minimum(back[j], d, out=back[j])
                np.sqrt(there, out=there)
                np.sqrt(back, out=back)
                at = np.ix_(rows[k : k + step], cols)
                chamfer[at] = (there.mean(0) + back.mean(0)) / 2
                hausdorff[at] = np.maximum(there.max(0), back.max(0))
    return chamfer, hausdorff


def group_distances(clouds: DataFrame, salts: int | None = None, block: int = 512) -> DataFrame:
    """(a, b, chamfer, hausdorff) of all pairs a < b of one group, from clouds (model_id, source_uid, points array<array<double>>).

    A cloud without points or a null one has no distances. Each group is dealt
    into `salts` parts (by default of about CLOUD_TILE clouds or TILE_POINTS points) that travel as
    one row each; two parts meet once, in a task of their own, where all
    their pairs are worked out together.
    """
    have = clouds.where((F.size("points") > 0) & F.col("source_uid").isNotNull())
    kind = dict(clouds.dtypes)["model_id"]
    numbers = {"tinyint": np.int8, "smallint": np.int16, "int": np.int32, "bigint": np.int64}.get(kind, object)
    needed = F.ceil(F.greatest(F.count("*") / CLOUD_TILE, F.sum(F.size("points")) / TILE_POINTS)) if salts is None else F.lit(salts)
    parts = have.groupBy("source_uid").agg(needed.cast("int").alias("parts"))
    dealt = have.join(parts, "source_uid").withColumn("part", F.pmod(F.xxhash64("model_id"), F.col("parts")).cast("int"))
    tiles = dealt.groupBy("source_uid", "parts", "part").agg(F.collect_list(F.struct("model_id", "points")).alias("clouds"))  # of one part
    a = tiles.select("source_uid", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"), F.col("clouds").alias("a"))
    b = tiles.select("source_uid", F.col("part").alias("j"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("clouds").alias("b"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, y = ([np.array(c["points"], float) for c in row[t]] for t in "ab")
                ids, others = (np.array([c["model_id"] for c in row[t]], numbers) for t in "ab")
                for at in range(0, len(x), 64):
                    chamfer, hausdorff = _pairs_of_tiles(x[at : at + 64], y, block)
                    before = ids[at : at + 64, None] < others
                    pair = before if row["i"] == row["j"] else before | (ids[at : at + 64, None] > others)  # a part meets itself from both sides
                    i, j = np.nonzero(pair)
                    first, second, turn = ids[at : at + 64][i], others[j], ~before[i, j]
                    first, second = np.where(turn, second, first), np.where(turn, first, second)
                    yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(chamfer[i, j]), pa.array(hausdorff[i, j])], ["a", "b", "chamfer", "hausdorff"])

    return a.join(b, ["source_uid", "i", "j"]).select("i", "j", "a", "b").mapInArrow(run, f"a {kind}, b {kind}, chamfer double, hausdorff double")


def cloud_distances_blocked(pairs: DataFrame, clouds: DataFrame, block: int = 512) -> DataFrame:
    """The same for large clouds (model_id, points array<array<double>>): numpy blocks, no row for a pair of points."""
    side = lambda s: clouds.select(F.col("model_id").alias(s), F.col("points").alias(f"p{s}"))

    def run(parts):
        for part in parts:
            rows = [(a, b, *_both_ways(np.stack(x), np.stack(y), block)) for a, b, x, y in zip(part["a"], part["b"], part["pa"], part["pb"], strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b", "chamfer", "hausdorff"])

    kind = dict(clouds.dtypes)["model_id"]
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, f"a {kind}, b {kind}, chamfer double, hausdorff double")


def area_volume_distance(area_a: Column, area_b: Column, volume_a: Column, volume_b: Column) -> Column:
    """1 - mean of the area and volume ratios; null unless both areas are positive."""
    ratio = F.least(area_a, area_b) / F.greatest(area_a, area_b)
    low, high = F.least(F.abs(volume_a), F.abs(volume_b)) + 1e-10, F.greatest(F.abs(volume_a), F.abs(volume_b)) + 1e-10
    return F.when((area_a > 0) & (area_b > 0), 1 - (ratio + low / high) / 2)


def area_distance(area_a: Column, area_b: Column) -> Column:
    """1 - area ratio; null unless both are positive. Not comparable with area_volume_distance."""
    return F.when((area_a > 0) & (area_b > 0), 1 - F.least(area_a, area_b) / F.greatest(area_a, area_b))


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def face_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces (model_id, face, a, b, c) with corner structs pa, pb, pc of vertices (model_id, v, x, y, z)."""
    out = faces
    for k in "abc":
        out = out.join(vertices.select("model_id", F.col("v").alias(k), F.struct("x", "y", "z").alias(f"p{k}")), ["model_id", k])
    return out


def _normal() -> list[Column]:
    edge = lambda k: [F.col(f"p{k}.{i}") - F.col(f"pa.{i}") for i in "xyz"]
    return _cross(edge("b"), edge("c"))


def _length(v: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(model_id, area, volume) of each mesh; volume by signed tetrahedra."""
    full = face_corners(vertices, faces)
    p = lambda k: [F.col(f"p{k}.{i}") for i in "xyz"]
    tetra = sum((a * n for a, n in zip(p("a"), _cross(p("b"), p("c")), strict=True)), F.lit(0.0)) / 6
    return full.groupBy("model_id").agg((F.sum(_length(_normal())) / 2).alias("area"), F.sum(tetra).alias("volume"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(model_id, v, nx, ny, nz): unit sums of the unit normals of the faces at each vertex."""
    full = face_corners(vertices, faces)
    n = _normal()
    size = F.greatest(_length(n), F.lit(1e-8))
    flat = full.select("model_id", F.explode(F.array("a", "b", "c")).alias("v"), *((x / size).alias(f"n{i}") for x, i in zip(n, "xyz", strict=True)))
    total = flat.groupBy("model_id", "v").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in "xyz"))
    length = F.greatest(_length([F.col(f"n{i}") for i in "xyz"]), F.lit(1e-8))
    return total.select("model_id", "v", *((F.col(f"n{i}") / length).alias(f"n{i}") for i in "xyz"))


def boxes(points: DataFrame) -> DataFrame:
    """(model_id, centre, extent, diagonal) of the axis-parallel box of points (model_id, x, y, z)."""
    b = points.groupBy("model_id").agg(*(f(i).alias(f"{n}{i}") for i in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    size = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in "xyz"]
    return b.select("model_id", *(((F.col(f"lo{i}") + F.col(f"hi{i}")) / 2).alias(f"c{i}") for i in "xyz"), F.greatest(*size).alias("extent"), _length(size).alias("diagonal"))


def normalise_box(points: DataFrame) -> DataFrame:
    """Points centred on their box and divided by its largest extent; a box without extent is only centred."""
    joined = points.join(boxes(points), "model_id")
    scale = F.when(F.col("extent") > 0, F.col("extent")).otherwise(F.lit(1.0))
    return joined.select("model_id", "pt_idx", *(((F.col(i) - F.col(f"c{i}")) / scale).alias(i) for i in "xyz"))


def normalise_abs(points: DataFrame) -> DataFrame:
    """Points centred on their box and divided by the largest absolute coordinate, into [-1, 1]."""
    centred = points.join(boxes(points), "model_id").select("model_id", "pt_idx", *((F.col(i) - F.col(f"c{i}")).alias(i) for i in "xyz"))
    most = centred.groupBy("model_id").agg(F.greatest(*(F.max(F.abs(F.col(i))) for i in "xyz")).alias("most"))
    scale = F.greatest("most", F.lit(1e-8))
    return centred.join(most, "model_id").select("model_id", "pt_idx", *((F.col(i) / scale).alias(i) for i in "xyz"))


def cameras(spark: SparkSession, n_ring: int = RING_VIEWS, elevation: float = RING_ELEVATION) -> DataFrame:
    """(view_idx, azimuth, elevation): a ring, then the 20 corners of a dodecahedron; y points up.

    The corners are those of a cube, signs counting up in binary, then for
    each pair of signs one on each coordinate plane.
    """
    phi = F.lit((1 + math.sqrt(5)) / 2)
    sign = lambda bit: (2 * F.pmod(F.floor(bit), F.lit(2)) - 1).cast("double")
    n = F.col("id")
    ring = spark.range(n_ring).select(n.cast("int").alias("view_idx"), (n * 360.0 / n_ring).alias("azimuth"), F.lit(elevation).alias("elevation"))
    cube = spark.range(8).select((n + n_ring).cast("int").alias("view_idx"), sign(n / 4).alias("x"), sign(n / 2).alias("y"), sign(n).alias("z"))
    long, short, plane = sign(n / 6) * phi, sign(n / 3) / phi, F.pmod(n, F.lit(3))
    zero = F.lit(0.0)
    pick = lambda a, b, c: F.when(plane == 0, a).when(plane == 1, b).otherwise(c)
    planes = spark.range(12).select((n + n_ring + 8).cast("int").alias("view_idx"), pick(zero, sign(n / 6) / phi, long).alias("x"), pick(long, zero, short).alias("y"), pick(short, sign(n / 3) * phi, zero).alias("z"))
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    corners = cube.unionByName(planes).select("view_idx", F.degrees(F.atan2("x", "z")).alias("azimuth"), F.degrees(F.asin(F.col("y") / r)).alias("elevation"))
    return ring.unionByName(corners)


def camera_position(azimuth: Column, elevation: Column, radius: Column) -> list[Column]:
    az, el = F.radians(azimuth), F.radians(elevation)
    return [radius * F.cos(el) * F.sin(az), radius * F.sin(el), radius * F.cos(el) * F.cos(az)]


def view_matrices(points: DataFrame, views: DataFrame) -> DataFrame:
    """(model_id, view_idx, mvp array<float> of 16, row-major): projection times look-at for each model and view."""
    b = boxes(points).select("model_id", "cx", "cy", "cz", "diagonal")
    spread = b.crossJoin(F.broadcast(views))  # a fixed number of views

    def matrices(part: pd.DataFrame) -> list:
        out = []
        for r in part.itertuples():
            centre, radius = np.array([r.cx, r.cy, r.cz]), max(1.5 * r.diagonal, 0.5)
            az, el = math.radians(r.azimuth), math.radians(r.elevation)
            eye = centre + radius * np.array([math.cos(el) * math.sin(az), math.sin(el), math.cos(el) * math.cos(az)])
            ahead = (centre - eye) / radius
            up = np.array([0.0, 1.0, 0.0]) if abs(ahead[1]) < 0.999 else np.array([0.0, 0.0, 1.0])
            right = np.cross(ahead, up)
            right /= np.linalg.norm(right)
            frame = np.stack([right, np.cross(right, ahead), -ahead])
            look = np.eye(4)
            look[:3, :3], look[:3, 3] = frame, -frame @ eye
            near, far, f = NEAR * radius, FAR * radius, 1 / math.tan(math.radians(FOV) / 2)
            project = np.zeros((4, 4))
            project[0, 0] = project[1, 1] = f
            project[2, 2], project[2, 3], project[3, 2] = (far + near) / (near - far), 2 * far * near / (near - far), -1
            out.append((project @ look).astype(np.float32).ravel().tolist())
        return out

    kind = dict(points.dtypes)["model_id"]
    return spread.mapInPandas(lambda parts: (p[["model_id", "view_idx"]].assign(mvp=matrices(p)) for p in parts), f"model_id {kind}, view_idx int, mvp array<float>")


def parse_obj(text: str | None) -> tuple[list, list] | None:
    """Vertices and triangles of OBJ text; None for fewer than 3 vertices, no face, or any error.

    Only v and f lines count. A corner v/vt/vn is its v; ids start at 1; a
    face of more corners is a fan.
    """
    vertices, faces = [], []
    try:
        for line in (text or "").splitlines():
            kind, *rest = line.split() or [""]
            if kind == "v":
                vertices.append([float(x) for x in rest[:3]])
            elif kind == "f":
                own = [int(x.split("/")[0]) - 1 for x in rest]
                faces += [[own[0], own[k], own[k + 1]] for k in range(1, len(own) - 1)]
    except (ValueError, IndexError):
        return None
    fine = len(vertices) >= 3 and faces and all(len(v) == 3 for v in vertices)
    return (vertices, faces) if fine else None


def load_obj(files: DataFrame) -> DataFrame:
    """(path, vertices, faces) of files (path, content binary); both null where parse_obj gives None."""

    def run(parts):
        for part in parts:
            got = [parse_obj(bytes(c).decode("utf-8", "replace") if c is not None else None) for c in part["content"]]
            yield pd.DataFrame({"path": part["path"], "vertices": [g and g[0] for g in got], "faces": [g and g[1] for g in got]})

    return files.select("path", "content").mapInPandas(run, "path string, vertices array<array<double>>, faces array<array<int>>")


def sample_surface(meshes: DataFrame, n: int = 2000) -> DataFrame:
    """(model_id, pt_idx, x, y, z): n points of each mesh (model_id, vertices, faces), by area, seeded by its id.

    A mesh without area gives points drawn from its vertices, no more than it has.
    """

    def run(parts):
        for part in parts:
            for model, v, f in zip(part["model_id"], part["vertices"], part["faces"], strict=True):
                v, f = np.array(v.tolist(), float), np.array(f.tolist(), int)
                rng = np.random.default_rng(int.from_bytes(str(model).encode()[-8:].rjust(8, b"\0"), "little"))
                a, b, c = (v[f[:, k]] for k in range(3))
                area = np.linalg.norm(np.cross(b - a, c - a), axis=1) / 2
                if area.sum() < 1e-10:
                    p = v[rng.integers(0, len(v), min(n, len(v)))]
                else:
                    t = rng.choice(len(f), n, p=area / area.sum())
                    r, s = np.sqrt(rng.random(n)), rng.random(n)
                    p = (1 - r)[:, None] * a[t] + (r * (1 - s))[:, None] * b[t] + (r * s)[:, None] * c[t]
                yield pd.DataFrame({"model_id": model, "pt_idx": np.arange(len(p), dtype=np.int32), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    kind = dict(meshes.dtypes)["model_id"]
    return meshes.select("model_id", "vertices", "faces").mapInPandas(run, f"model_id {kind}, pt_idx int, x double, y double, z double")


def _rotation(rng: np.random.Generator) -> np.ndarray:
    axis = rng.normal(size=3)
    x, y, z = axis / np.linalg.norm(axis)
    t = rng.uniform(0, 2 * math.pi)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * (k @ k)


def _jitter(v: np.ndarray, rng: np.random.Generator, scale: tuple, noise: tuple) -> np.ndarray:
    """A scale for each axis, then noise in the mesh's own units, its deviation drawn once."""
    return v * rng.uniform(*scale, 3) + rng.normal(0, rng.uniform(*noise), v.shape)


def edit_t1(v, f, rng):
    """Values as a single-precision file keeps them."""
    return v.astype(np.float32).astype(float), f


def edit_t2(v, f, rng):
    """Uniform scale and rotation."""
    return v * rng.uniform(0.5, 2.0) @ _rotation(rng).T, f


def edit_t3(v, f, rng):
    """Scale per axis and noise; decimation is left to a mesh library."""
    return _jitter(v, rng, (0.7, 1.5), (0.01, 0.05)), f


def without_faces(f: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """All but n faces, drawn without putting back; their order stays."""
    return np.delete(f, rng.choice(len(f), n, replace=False), axis=0)


def edit_t4(v, f, rng):
    """10 to 30 % of the faces gone (5 % if fewer than four stay), with the vertices that nothing uses any more; then scale and noise."""
    kept = without_faces(f, int(len(f) * rng.uniform(0.1, 0.3)), rng)
    if len(kept) < 4:
        kept = without_faces(f, int(len(f) * 0.05), rng)
    used, again = np.unique(kept, return_inverse=True)
    return _jitter(v[used], rng, (0.6, 1.6), (0.02, 0.06)), again.reshape(-1, 3)


def edit_t5(v, f, rng):
    """Every triangle into four, at its edges' middles, in meshes of up to 50,000 faces; then scale and noise; decimation is left to a mesh library."""
    if len(f) <= 50_000:
        edges = np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1)
        unique, at = np.unique(edges, axis=0, return_inverse=True)
        ab, bc, ca = (at.ravel()[k * len(f) : (k + 1) * len(f)] + len(v) for k in range(3))
        v = np.concatenate([v, v[unique].mean(axis=1)])
        a, b, c = f.T
        f = np.concatenate([np.stack(x, 1) for x in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))])
    return _jitter(v, rng, (0.7, 1.4), (0.01, 0.04)), f


#: Tiers by name; callers may add their own.
EDITS = {"T1": edit_t1, "T2": edit_t2, "T3": edit_t3, "T4": edit_t4, "T5": edit_t5}


def make_clones(meshes: DataFrame, variants: int = 3, seed: int = 42, edits: dict | None = None) -> DataFrame:
    """Clones of each mesh (uid, vertices, faces) in every tier and variant; an error is a row too, never swallowed."""
    table = edits or EDITS
    spine = meshes.sparkSession.createDataFrame([(t, v) for t in table for v in range(variants)], "tier string, variant int")

    def run(parts):
        for part in parts:
            for r in part.itertuples():
                error = v = f = None
                try:
                    rng = np.random.default_rng([seed, r.variant, *str(r.uid).encode(), *r.tier.encode()])
                    v, f = table[r.tier](np.array(r.vertices.tolist(), float), np.array(r.faces.tolist(), int), rng)
                    if len(f) < 4:
                        raise ValueError("fewer than 4 faces are left")
                except Exception as e:
                    error, v, f = str(e)[:200], None, None
                yield pd.DataFrame([[f"{r.uid}_{r.tier}_v{r.variant}", str(r.uid), r.tier, r.variant, None if v is None else v.tolist(), None if f is None else f.tolist(), error]], columns=["clone_id", "source_uid", "tier", "variant", "vertices", "faces", "error"])

    return meshes.select("uid", "vertices", "faces").crossJoin(F.broadcast(spine)).mapInPandas(run, "clone_id string, source_uid string, tier string, variant int, vertices array<array<double>>, faces array<array<int>>, error string")
