"""Plans at size: what must not travel through a shuffle, and what is worked out once."""

import os

import pytest

from twinsight.plans import registry
from twinsight.streaming import ingest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def plan(spark, name: str) -> str:
    return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def ranks_in_tasks(spark, name: str, times: int = 1) -> None:
    """Rankings are made and reduced in a task; relevant pairs, quadratic in a group, are in no exchange."""
    text = plan(spark, name)
    assert text.count("CartesianProduct") == times and "relevant#" not in text.replace("n_relevant#", "") and "before#" not in text


def test_retrieval_map_keeps_pairs_in_tasks(spark):
    ranks_in_tasks(spark, "retrieval_map")


def test_retrieval_by_tier_keeps_pairs_in_tasks(spark):
    ranks_in_tasks(spark, "retrieval_by_tier")


def test_retrieval_pk_rk_keeps_pairs_in_tasks(spark):
    ranks_in_tasks(spark, "retrieval_pk_rk")


def test_ndcg_keeps_pairs_in_tasks(spark):
    ranks_in_tasks(spark, "ndcg")


def test_source_rank_keeps_pairs_in_tasks(spark):
    ranks_in_tasks(spark, "source_rank")


def test_sparse_retrieval_keeps_edges_in_tasks(spark):
    ranks_in_tasks(spark, "sparse_retrieval")


def test_bootstrap_ranks_once(spark):
    ranks_in_tasks(spark, "bootstrap_ci")


def test_view_ablation_keeps_pairs_in_tasks(spark):
    ranks_in_tasks(spark, "view_ablation", 4)


def test_streamed_scoring_reads_its_corpus_once(spark, tmp_path):
    """Twice, for its number of rows and its tiles, and not for each of three batches."""
    v = spark.createDataFrame([(i, 0, [1.0, i / 10]) for i in range(6)], "id long, grp long, vector array<double>")
    v.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    q = ingest.score_stream(ingest.read_embeddings(spark, str(tmp_path / "in"), v.schema), v.mapInArrow(watched, v.schema), 0.99, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    assert seen.value == 2 * 6


def test_view_ablation_joins_nothing_to_its_metrics(spark):
    """Means over all queries need no tier; each of four rankings used to be joined with all models for it."""
    above, *rankings = plan(spark, "view_ablation").split("MapInArrow")
    assert len(rankings) == 4 and "Union" in above and "Join" not in above
