"""Point clouds, boxes, areas, normals and cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators import geometry
from .fixtures import M, models, points, sources, view_of
from .registry import query

_PT = f"""with {M}, pt as (select model_id, v::int as pt_idx, e[8*v+1] as x, e[8*v+2] as y, e[8*v+3] as z from m cross join range(8) r(v))"""
_P = f"""{_PT}, pr as (select a.model_id as a, b.model_id as b from m a join m b on a.source_uid = b.source_uid and a.model_id <> b.model_id where a.is_source)"""
_P_ALL = f"""{_PT}, pr as (select a.model_id as a, b.model_id as b from m a join m b on a.source_uid = b.source_uid and a.model_id < b.model_id)"""
_D_OF = """, d as (select a, b, p.pt_idx as i, o.pt_idx as j, sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2) + pow(p.z - o.z, 2)) as d from pr join pt p on p.model_id = a join pt o on o.model_id = b),
n as (select a, b, 'ab' as way, min(d) as d from d group by a, b, i union all select a, b, 'ba', min(d) from d group by a, b, j),
w as (select a, b, way, avg(d) as mean, max(d) as most from n group by a, b, way)"""
_D = _P + _D_OF


def _clouds(m: DataFrame) -> DataFrame:
    """(model_id, points): eight points of three coordinates each."""
    at = lambda v: F.array(*(F.col("e")[8 * v + k] for k in range(3)))
    return m.select("model_id", F.array(*(at(v) for v in range(8))).alias("points"))


def _pairs(m: DataFrame) -> DataFrame:
    return sources(m).select(F.col("model_id").alias("a"), "source_uid").join(m.select(F.col("model_id").alias("b"), "source_uid"), "source_uid").where("a <> b").select("a", "b")


@query(f"{_D} select a, b, round(sum(mean) / 2, 6) as chamfer, round(max(most), 6) as hausdorff from w group by a, b")
def chamfer_hausdorff(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    return geometry.cloud_distances(_pairs(m), points(m)).select("a", "b", F.round("chamfer", 6).alias("chamfer"), F.round("hausdorff", 6).alias("hausdorff"))


@query(f"{_D} select a, b, round(sum(mean) / 2, 6) as chamfer, round(max(most), 6) as hausdorff from w group by a, b")
def chamfer_hausdorff_blocked(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    return geometry.cloud_distances_blocked(_pairs(m), _clouds(m)).select("a", "b", F.round("chamfer", 6).alias("chamfer"), F.round("hausdorff", 6).alias("hausdorff"))


@query(f"{_P_ALL}{_D_OF} select a, b, round(sum(mean) / 2, 6) as chamfer, round(max(most), 6) as hausdorff from w group by a, b")
def group_distances(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of each group, sources or not."""
    m = models(spark, d)
    out = geometry.group_distances(m.select("model_id", "source_uid").join(_clouds(m), "model_id"))
    return out.select("a", "b", F.round("chamfer", 6).alias("chamfer"), F.round("hausdorff", 6).alias("hausdorff"))


@query(f"""{_P}, g as (select model_id, case when e[10] < -0.2 then 0.0 else sqrt(list_dot_product(e[1:8], e[1:8])) end as area, e[9] as volume from m)
select a, b, round(case when x.area > 0 and y.area > 0 then 1 - least(x.area, y.area) / greatest(x.area, y.area) end, 6) as area_distance,
round(case when x.area > 0 and y.area > 0 then 1 - (least(x.area, y.area) / greatest(x.area, y.area) + (least(abs(x.volume), abs(y.volume)) + 1e-10) / (greatest(abs(x.volume), abs(y.volume)) + 1e-10)) / 2 end, 6) as area_volume_distance
from pr join g x on x.model_id = a join g y on y.model_id = b""")
def area_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    g = m.select("model_id", F.when(F.col("e")[9] < -0.2, 0.0).otherwise(norm(view_of("e", F.lit(0)))).alias("area"), F.col("e")[8].alias("volume"))
    both = _pairs(m).join(g.toDF("a", "xa", "xv"), "a").join(g.toDF("b", "ya", "yv"), "b")
    c = [F.col(k) for k in ("xa", "ya", "xv", "yv")]
    return both.select("a", "b", F.round(geometry.area_distance(c[0], c[1]), 6).alias("area_distance"), F.round(geometry.area_volume_distance(*c), 6).alias("area_volume_distance"))


_BOX = f"""{_P}, b as (select model_id, (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy, (min(z) + max(z)) / 2 as cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as extent,
sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) as diagonal from pt group by model_id)"""


@query(f"{_BOX} select model_id, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz, round(extent, 6) as extent, round(diagonal, 6) as diagonal from b")
def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = geometry.boxes(points(models(spark, d)))
    return b.select("model_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "extent", "diagonal")))


@query(f"{_BOX} select model_id, pt_idx, round((x - cx) / extent, 6) as x, round((y - cy) / extent, 6) as y, round((z - cz) / extent, 6) as z from pt join b using (model_id)")
def normalise_box(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.normalise_box(points(models(spark, d)))
    return p.select("model_id", "pt_idx", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"{_BOX}, c as (select model_id, pt_idx, x - cx as x, y - cy as y, z - cz as z from pt join b using (model_id)), k as (select model_id, greatest(max(abs(x)), max(abs(y)), max(abs(z)), 1e-8) as k from c group by model_id) select model_id, pt_idx, round(x / k, 6) as x, round(y / k, 6) as y, round(z / k, 6) as z from c join k using (model_id)")
def normalise_abs(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.normalise_abs(points(models(spark, d)))
    return p.select("model_id", "pt_idx", *(F.round(c, 6).alias(c) for c in "xyz"))


def _mesh(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each model's eight points as a strip of six triangles."""
    p = points(m)
    return p.withColumnRenamed("pt_idx", "v"), p.where("pt_idx < 6").select("model_id", F.col("pt_idx").alias("face"), F.col("pt_idx").alias("a"), (F.col("pt_idx") + 1).alias("b"), (F.col("pt_idx") + 2).alias("c"))


_F = f"""{_P}, f as (select a.model_id, a.pt_idx as face, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as "by", b.z as bz, c.x as cx, c.y as cy, c.z as cz
from pt a join pt b on b.model_id = a.model_id and b.pt_idx = a.pt_idx + 1 join pt c on c.model_id = a.model_id and c.pt_idx = a.pt_idx + 2),
k as (select *, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) as nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as ny, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) as nz from f)"""


@query(f"""{_F} select model_id, round(sum(sqrt(nx*nx + ny*ny + nz*nz)) / 2, 6) as area, round(sum((ax * ("by" * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - "by" * cx)) / 6), 6) as volume from k group by model_id""")
def mesh_areas(spark: SparkSession, d: str) -> DataFrame:
    a = geometry.areas(*_mesh(models(spark, d)))
    return a.select("model_id", F.round("area", 6).alias("area"), F.round("volume", 6).alias("volume"))


@query(f"""{_F}, u as (select model_id, face, nx / greatest(sqrt(nx*nx + ny*ny + nz*nz), 1e-8) as nx, ny / greatest(sqrt(nx*nx + ny*ny + nz*nz), 1e-8) as ny, nz / greatest(sqrt(nx*nx + ny*ny + nz*nz), 1e-8) as nz from k),
t as (select model_id, (face + o)::int as v, sum(nx) as nx, sum(ny) as ny, sum(nz) as nz from u cross join range(3) r(o) group by model_id, face + o)
select model_id, v, round(nx / greatest(sqrt(nx*nx + ny*ny + nz*nz), 1e-8), 6) as nx, round(ny / greatest(sqrt(nx*nx + ny*ny + nz*nz), 1e-8), 6) as ny, round(nz / greatest(sqrt(nx*nx + ny*ny + nz*nz), 1e-8), 6) as nz from t""")
def vertex_normals(spark: SparkSession, d: str) -> DataFrame:
    n = geometry.vertex_normals(*_mesh(models(spark, d)))
    return n.select("model_id", "v", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")))


_PHI = "((1 + sqrt(5)) / 2)"
_CAM = f"""with s as (select 2 * (i // 2) - 1 as s1, 2 * (i % 2) - 1 as s2, i from range(4) r(i)),
v as (select (8 + i)::int as view_idx, (2 * (i // 4) - 1)::double as x, (2 * (i // 2 % 2) - 1)::double as y, (2 * (i % 2) - 1)::double as z from range(8) r(i)
union all select (16 + 3 * i)::int, 0.0, s1 * {_PHI}, s2 / {_PHI} from s union all select (17 + 3 * i)::int, s1 / {_PHI}, 0.0, s2 * {_PHI} from s union all select (18 + 3 * i)::int, s1 * {_PHI}, s2 / {_PHI}, 0.0 from s),
c as (select i::int as view_idx, i * 45.0::double as azimuth, 30.0::double as elevation from range(8) r(i) union all select view_idx, degrees(atan2(x, z)), degrees(asin(y / sqrt(x*x + y*y + z*z))) from v)"""


@query(f"{_CAM} select view_idx, round(azimuth, 6) + 0.0 as azimuth, round(elevation, 6) + 0.0 as elevation, round(2 * cos(radians(elevation)) * sin(radians(azimuth)), 6) + 0.0 as x, round(2 * sin(radians(elevation)), 6) + 0.0 as y, round(2 * cos(radians(elevation)) * cos(radians(azimuth)), 6) + 0.0 as z from c")
def cameras28(spark: SparkSession, d: str) -> DataFrame:
    c = geometry.cameras(spark)
    xyz = geometry.camera_position(F.col("azimuth"), F.col("elevation"), F.lit(2.0))
    return c.select("view_idx", *((F.round(x, 6) + F.lit(0.0)).alias(n) for n, x in zip(("azimuth", "elevation", "x", "y", "z"), (F.col("azimuth"), F.col("elevation"), *xyz), strict=True)))


def _cell(row: int, column: int, value: str) -> str:
    return f"round(({value})::float::double, 3) + 0.0 as m{row}{column}"


_MVP = f"""{_BOX}, {_CAM.removeprefix("with ")},
o as (select model_id, view_idx, cx, cy, cz, greatest(1.5 * diagonal, 0.5) as r, 1 / tan(radians(22.5)) as f,
  cos(radians(elevation)) * sin(radians(azimuth)) as dx, sin(radians(elevation)) as dy, cos(radians(elevation)) * cos(radians(azimuth)) as dz from b cross join c),
a as (select *, dz / sqrt(dx*dx + dz*dz) as rx, 0.0 as ry, -dx / sqrt(dx*dx + dz*dz) as rz, cx + r * dx as ex, cy + r * dy as ey, cz + r * dz as ez from o),
u as (select *, dy * rz - dz * ry as ux, dz * rx - dx * rz as uy, dx * ry - dy * rx as uz from a)
select model_id, view_idx, {", ".join(
    _cell(row, column, value)
    for row, own in enumerate((
        ["f * rx", "f * ry", "f * rz", "-f * (rx * ex + ry * ey + rz * ez)"],
        ["f * ux", "f * uy", "f * uz", "-f * (ux * ex + uy * ey + uz * ez)"],
        ["-20.01 / 19.99 * dx", "-20.01 / 19.99 * dy", "-20.01 / 19.99 * dz", "20.01 / 19.99 * (dx * ex + dy * ey + dz * ez) - 0.4 * r / 19.99"],
        ["-dx", "-dy", "-dz", "dx * ex + dy * ey + dz * ez"],
    ))
    for column, value in enumerate(own)
)} from u"""


@query(_MVP)
def view_matrices(spark: SparkSession, d: str) -> DataFrame:
    """A column for each cell of each model's and view's matrix."""
    out = geometry.view_matrices(points(models(spark, d)), geometry.cameras(spark))
    return out.select("model_id", "view_idx", *((F.round(F.col("mvp")[4 * r + c].cast("double"), 3) + F.lit(0.0)).alias(f"m{r}{c}") for r in range(4) for c in range(4)))


@query()
def clone_meshes(spark: SparkSession, d: str) -> DataFrame:
    """Graded clones of a strip mesh for each source."""
    m = sources(models(spark, d))
    v = points(m).groupBy(F.col("model_id").cast("string").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pt_idx", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"])).alias("vertices"))
    strip = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array(i, i + 1, i + 2))
    made = geometry.make_clones(v.withColumn("faces", strip))
    return made.select("clone_id", "source_uid", "tier", "variant", F.size("vertices").alias("n_vertices"), F.size("faces").alias("n_faces"), "error")


@query()
def surface_points(spark: SparkSession, d: str) -> DataFrame:
    v = _clouds(models(spark, d)).withColumnRenamed("points", "vertices")
    strip = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array(i, i + 1, i + 2))
    return geometry.sample_surface(v.withColumn("faces", strip), 200)
