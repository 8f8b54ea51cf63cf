"""Views to descriptors: mean, max, single, concatenation with PCA, norms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise

STRATEGIES = ("single", "mean", "max", "concat")


def first_views(views: DataFrame, n: int | None) -> DataFrame:
    """The first n views; the filter reaches the scan."""
    return views if n is None else views.where(F.col("view_idx") < n)


def by_dimension(views: DataFrame, how: str) -> DataFrame:
    """(model_id, emb): element-wise avg or max over views, combined before the shuffle."""
    flat = views.select("model_id", F.posexplode("emb").alias("dim", "val"))
    agg = flat.groupBy("model_id", "dim").agg(getattr(F, how)("val").alias("val"))
    whole = agg.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("dim", "val"))).alias("p"))
    return whole.select("model_id", F.transform("p", lambda p: p["val"]).alias("emb"))


def describe(views: DataFrame, strategy: str, n_views: int | None = None, normalise: bool = True) -> DataFrame:
    """(model_id, emb) of `views` (model_id, view_idx, emb array<double>) by a named strategy."""
    views = first_views(views, n_views)
    if strategy == "single":
        out = views.where("view_idx = 0").select("model_id", "emb")
    elif strategy == "mean":
        out = by_dimension(views, "avg")
    elif strategy == "max":
        out = by_dimension(views, "max")
    elif strategy == "concat":
        order = views.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("view_idx", "emb"))).alias("v"))
        out = order.select("model_id", F.flatten(F.transform("v", lambda v: v["emb"])).alias("emb"))
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return out.select("model_id", l2_normalise("emb").alias("emb")) if normalise else out


def centred(vectors: DataFrame) -> DataFrame:
    """(model_id, emb) less the mean of all."""
    mean = vectors.select(F.posexplode("emb").alias("dim", "val")).groupBy("dim").agg(F.avg("val").alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("mean"))  # one row, as long as a vector
    return vectors.crossJoin(F.broadcast(mean)).select("model_id", F.zip_with("emb", "mean", lambda x, m: x - m).alias("emb"))


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(model_id, emb) projected on the first k components of centred vectors, and the explained shares.

    Spark ML fits the components; its projection doesn't centre, so vectors
    are centred first. k is at most the dimensions and one less than the rows.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = centred(vectors).select("model_id", array_to_vector("emb").alias("features"))
    dim = len(data.first()["features"])
    k = max(1, min(k, dim, data.count() - 1))
    model = PCA(k=k, inputCol="features", outputCol="out").fit(data)
    return model.transform(data).select("model_id", vector_to_array("out").alias("emb")), np.asarray(model.explainedVariance).tolist()


def long_form(vectors: DataFrame, digits: int = 6) -> DataFrame:
    """(model_id, dim, val) with rounded values."""
    return vectors.select("model_id", F.posexplode("emb").alias("dim", "val")).select("model_id", "dim", F.round("val", digits).alias("val"))


def fill_views(views: DataFrame, models: DataFrame, n_views: int) -> DataFrame:
    """A row for each model and view; a missing view takes the path of the model's first; models without views are dropped."""
    have = views.groupBy("model_id").agg(F.min_by("path", "view_idx").alias("first_path"))
    spine = models.select("model_id").join(have, "model_id").withColumn("view_idx", F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))))
    return spine.join(views.select("model_id", "view_idx", "path"), ["model_id", "view_idx"], "left").select("model_id", "view_idx", F.coalesce("path", "first_path").alias("path"))
