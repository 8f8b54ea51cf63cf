"""Vector and scalar expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column | str) -> Column:
    """Unit vector; the norm is floored, so a zero vector stays zero."""
    size = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(col(v), lambda x: x / size)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(l2_normalise(a), l2_normalise(b))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b; 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def f1(p: Column | str, r: Column | str) -> Column:
    return safe_div(2 * col(p) * col(r), col(p) + col(r))


def model_parts(model_id: Column | str) -> tuple[Column, Column, Column]:
    """Source id, tier and variant of a clone id {source}_{tier}_v{n}; null for other ids."""
    rx = r"^(.*)_(T\d)_v(\d+)$"
    part = lambda k: F.nullif(F.regexp_extract(col(model_id), rx, k), F.lit(""))
    return part(1), part(2), part(3).cast("int")


def run_tag(*parts: Column | str) -> Column:
    """Parts joined by underscores; null parts are left out."""
    return F.concat_ws("_", *(col(p) for p in parts))


def view_file(view_idx: Column | str) -> Column:
    return F.format_string("view_%02d.png", col(view_idx))


def data_url(content: Column | str) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(col(content)), "\\s", ""))


def short_error(text: Column | str, size: int = 200) -> Column:
    return F.substring(col(text), 1, size)


def quantise_sq8(x: Column, lo: Column, hi: Column) -> Column:
    """8-bit code of x on [lo, hi]; a flat dimension is code 0."""
    return F.when(hi > lo, F.round((x - lo) / (hi - lo) * 255)).otherwise(F.lit(0.0)).cast("int")


def dequantise_sq8(code: Column, lo: Column, hi: Column) -> Column:
    return lo + code / F.lit(255.0) * (hi - lo)
