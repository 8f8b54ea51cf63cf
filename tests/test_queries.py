"""Every query against its SQL in DuckDB, over the smallest tables."""

import math
import os
import numbers

import duckdb
import pytest

from twinsight.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("NaT", "<NA>"):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, numbers.Number):
        return f"{round(float(value), 5) + 0.0:.5f}"
    return str(value)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, oracle, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = oracle.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_approximate_search_finds_most(spark):
    for name, least in (("ann_ivf", 0.9), ("ann_lsh", 0.9), ("sq8_recall", 0.95), ("ann_pq", 0.3)):
        assert registry.QUERIES[name](spark, DATA).first()["recall"] >= least


def test_product_codes_find_nearly_all(spark):
    assert registry.QUERIES["ann_pq"](spark, DATA).first()["recall"] >= 0.9


def test_bootstrap_encloses_the_mean(spark):
    r = registry.QUERIES["bootstrap_ci"](spark, DATA).first()
    assert r["low"] < r["mean"] < r["high"]


def test_negative_sample(spark):
    pairs = registry.QUERIES["negative_sample"](spark, DATA)
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    assert found and len(found) == len(set(found)) and all(a < b and label[a] != label[b] for a, b in found)


def test_components_explain_most_first(spark):
    shares = [r["share"] for r in registry.QUERIES["agg_concat_pca_k8"](spark, DATA).orderBy("component").collect()]
    assert len(shares) == 8 and shares == sorted(shares, reverse=True)


def test_generators(spark):
    clones = registry.QUERIES["clone_meshes"](spark, DATA).toPandas()
    assert len(clones) == 10 * 5 * 3 and clones.error.isna().all()
    assert (clones[clones.tier == "T5"].n_faces == 24).all()
    models = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert registry.QUERIES["surface_points"](spark, DATA).count() == models * 200
    assert registry.QUERIES["view_matrices"](spark, DATA).count() == models * 28
