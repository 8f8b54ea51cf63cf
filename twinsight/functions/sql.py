"""The vector functions for use in SQL text; their bodies are SQL and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_VECTOR = "ARRAY<DOUBLE>"
FUNCTIONS = {
    "vec_dot": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm": (f"a {_VECTOR}", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_normalise": (f"a {_VECTOR}", _VECTOR, "transform(a, x -> x / greatest(sqrt(aggregate(a, 0D, (s, y) -> s + y * y)), 1e-8D))"),
    "vec_cosine": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (greatest(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)), 1e-8D) * greatest(sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 1e-8D))"),
    "safe_div": ("a DOUBLE, b DOUBLE", "DOUBLE", "coalesce(try_divide(a, b), 0D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions temporary SQL functions of the session."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
