"""Declared schemas and scans of manifests, logs, results, views and tensors."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_MANIFEST = "total_models int, total_downloaded int, categories int, category_list array<string>, category_map map<string,string>, uids array<string>, model_paths map<string,string>"
CLONE_MANIFEST = "clone_id string, source_uid string, tier string, tier_name string, variant int, faces int, vertices int"
CLONE_ERRORS = "uid string, tier string, variant int, error string"
CONVERSION_LOG = "uid string, status string, error string, faces int, vertices int, category string, original_format string"
ANGLE = "struct<angle:int,view_idx:int,result:string,evidence:boolean>"
CANDIDATE = f"struct<candidate:string,sim_score:double,stage2_result:string,evidence_count:int,total_views:int,rejected_at:string,angle_details:array<{ANGLE}>>"
PIPELINE_RUN = f"run_tag string, config map<string,string>, stats map<string,bigint>, evaluation map<string,string>, runtime_seconds double, pipeline_results array<struct<query:string,confirmed_duplicates:array<{CANDIDATE}>,rejected:array<{CANDIDATE}>>>"
METRICS = "map<string,double>"


def read_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object, or an array of records, per file; keys that are missing are null."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def source_models(manifest: DataFrame) -> DataFrame:
    """(uid, category, path) of each source."""
    rows = manifest.select(F.explode("uids").alias("uid"), "category_map", "model_paths")
    return rows.select("uid", F.try_element_at("category_map", F.col("uid")).alias("category"), F.try_element_at("model_paths", F.col("uid")).alias("path"))


def results_long(spark: SparkSession, path: str, irregular: tuple[str, ...] = ("view_ablation",)) -> DataFrame:
    """(config_key, metric, value) of a results file {config: {metric: value}}; irregular keys are left out."""
    text = spark.read.option("wholetext", True).text(path)
    flat = text.select(F.explode(F.from_json("value", f"map<string,{METRICS}>")).alias("config_key", "metrics"))
    return flat.where(~F.col("config_key").isin(*irregular)).select("config_key", F.explode("metrics").alias("metric", "value"))


def view_ablation(spark: SparkSession, path: str, key: str = "view_ablation") -> DataFrame:
    """(config_key, map) of a results file's irregular part."""
    text = spark.read.option("wholetext", True).text(path)
    flat = text.select(F.explode(F.from_json("value", f"map<string,{METRICS}>")).alias("k", "metrics")).where(F.col("k") == key)
    return flat.select(F.explode("metrics").alias("config_key", "map"))


def curve_points(curve: Column) -> Column:
    """Rows of a struct of parallel arrays (thresholds, f1_scores, precision_scores, recall_scores)."""
    return F.inline(F.arrays_zip(curve["thresholds"].alias("threshold"), curve["f1_scores"].alias("f1"), curve["precision_scores"].alias("precision"), curve["recall_scores"].alias("recall")))


def config_parts(key: Column) -> dict[str, Column]:
    """family, size, mode, strategy and number of views of a config key family_size_mode_strategyN."""
    part = F.split(key, "_")
    last = F.element_at(part, -1)
    number = F.nullif(F.regexp_extract(last, r"(\d+)$", 1), F.lit("")).cast("int")
    return {"family": part[0], "size": part[1], "mode": part[2], "strategy": F.regexp_replace(last, r"\d+$", ""), "n_views": number}


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, length, name, parent) of files under root; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", "length", F.substring(name, F.lit(1), F.char_length(name) - len(suffix)).alias("name"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"))


def discover(spark: SparkSession, sources: str, clones: str, suffix: str = ".obj") -> DataFrame:
    """(model_id, source_uid, tier, path): sources, and clones in a folder for each tier; a clone's source precedes its last two parts."""
    own = list_files(spark, sources, suffix).select(F.col("name").alias("model_id"), F.col("name").alias("source_uid"), F.lit(None).cast("string").alias("tier"), "path")
    made = list_files(spark, clones, suffix).select(F.col("name").alias("model_id"), F.regexp_extract("name", r"^(.*)_[^_]*_[^_]*$", 1).alias("source_uid"), F.col("parent").alias("tier"), "path")
    return own.unionByName(made)


def list_views(spark: SparkSession, root: str) -> DataFrame:
    """(mode, model_id, view_idx, path) of root/mode/model/view_NN.png."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "view_*.png").load(root).select("path")
    rx = r"([^/]+)/([^/]+)/view_(\d+)\.png$"
    return files.select(*(F.regexp_extract("path", rx, k).alias(n) for k, n in ((1, "mode"), (2, "model_id"))), F.regexp_extract("path", rx, 3).cast("int").alias("view_idx"), "path")


def model_dirs(views: DataFrame, mode: str) -> DataFrame:
    """Models that have views in a mode, sorted."""
    return views.where(F.col("mode") == mode).select("model_id").distinct().orderBy("model_id")


def load_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(encoder, mode, model_id, view_idx, embedding) of .npz files named encoder_mode.npz with model_ids and embeddings (N, views, dim)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                encoder, _, mode = p.rsplit("/", 1)[-1].removesuffix(".npz").rpartition("_")
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    ids, x = z["model_ids"], z["embeddings"]
                for k in range(0, len(ids), 1000):
                    rows = [(encoder, mode, str(i), v, e.astype(np.float32).tolist()) for i, views in zip(ids[k : k + 1000], x[k : k + 1000], strict=True) for v, e in enumerate(views)]
                    yield pd.DataFrame(rows, columns=["encoder", "mode", "model_id", "view_idx", "embedding"])

    return files.mapInPandas(run, "encoder string, mode string, model_id string, view_idx int, embedding array<float>")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, in order of preference."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def landed_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(category, uid) of a landed catalog {category: [uid]}."""
    text = spark.read.option("wholetext", True).text(path)
    flat = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "uids"))
    return flat.select("category", F.explode("uids").alias("uid"))
