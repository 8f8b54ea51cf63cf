"""Manifests, validation, sampling, upserts, reports and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as fn
from ..operators import quality, reporting, stats
from ..sources import manifests, sinks
from ..streaming import ingest
from .fixtures import M, models, table
from .registry import query


def _profile_sql(value: str, source: str) -> str:
    return f"select min({value})::bigint as min, max({value})::bigint as max, list_sort(list({value}))[count(*) // 2 + 1]::bigint as upper_median, count(*) as n from {source}"


def _profile(rows: DataFrame, value: str) -> DataFrame:
    return stats.upper_median_of(rows, value).select(*(F.col(c).cast("long").alias(c) for c in ("min", "max", "upper_median", "n")))


@query(_profile_sql("p_size", "part"))
def size_profile_part(spark: SparkSession, d: str) -> DataFrame:
    return _profile(table(spark, d, "part"), "p_size")


@query(_profile_sql("n_chars", "documents"))
def size_profile_documents(spark: SparkSession, d: str) -> DataFrame:
    return _profile(table(spark, d, "documents"), "n_chars")


@query("select round(avg(value), 6) as mean, round(median(value), 6) as median, round(max(value), 6) as longest from events")
def duration_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.max("value"), 6).alias("longest"))


@query("""with o as (select o_orderpriority as mode, case when o_custkey % 4 = 0 then 'source' else 'T' || (o_custkey % 5 + 1) end as tier, o_orderstatus as status from orders)
select case grouping_id(mode, tier, status) when 3 then 'mode' when 5 then 'tier' when 6 then 'status' else 'all' end as level, coalesce(mode, tier, status, 'all') as key, count(*) as n from o group by grouping sets ((mode), (tier), (status), ())""")
def validation_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("T"), (F.col("o_custkey") % 5 + 1).cast("string"))).alias("tier"))
    return quality.rollup(o, "o_orderpriority", "tier", "o_orderstatus")


@query("""with c as (select p_type as key, count(*) as n from part group by 1), t as (select key from c order by n desc, key limit 10)
select case when t.key is null then 'other' else c.key end as key, sum(n)::bigint as n from c left join t using (key) group by 1""")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    return quality.top_with_rest(table(spark, d, "part"), "p_type", 10)


@query("""select l_orderkey || '_' || l_linenumber as clone_id, p_partkey::varchar as source_uid, l_quantity::int as faces, p_size as source_faces, round(l_quantity::int / greatest(p_size, 1), 3) as face_ratio, l_quantity::int >= 4 and l_linenumber + 2 >= 4 as valid
from lineitem join part on p_partkey = l_partkey""")
def face_ratios(spark: SparkSession, d: str) -> DataFrame:
    clones = table(spark, d, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("clone_id"), F.col("l_partkey").cast("string").alias("source_uid"), F.col("l_quantity").cast("int").alias("faces"), (F.col("l_linenumber") + 2).alias("vertices"))
    return quality.face_ratios(clones, table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("uid"), F.col("p_size").alias("faces")))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.remaining(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""with n as (select s_suppkey as k, -s_acctbal as v from supplier where s_acctbal < 0 union all select 1000000 + s_suppkey, s_acctbal from supplier where s_acctbal > 5000)
select k, v from n union all select s_suppkey, s_acctbal from supplier where s_suppkey not in (select k from n)""")
def results_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    new = old.where("v < 0").select("k", (-F.col("v")).alias("v")).unionByName(old.where("v > 5000").select((F.col("k") + 1000000).alias("k"), "v"))
    return sinks.upsert(old, new, ["k"])


@query("select p_partkey, p_type from (select *, row_number() over (partition by p_type order by md5('42:' || p_partkey), p_partkey) as k from part) where k <= 5")
def sample_per_category(spark: SparkSession, d: str) -> DataFrame:
    return stats.hash_sample(table(spark, d, "part"), "p_partkey", 5, "p_type").select("p_partkey", "p_type")


@query("select c_custkey from customer order by md5('42:' || c_custkey), c_custkey limit 50")
def sample_queries(spark: SparkSession, d: str) -> DataFrame:
    return stats.hash_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 50)


@query("with n as (select p_partkey, row_number() over (order by p_partkey) - 1 as k, greatest(1, count(*) over () // 5) as step from part) select p_partkey from n where k % step = 0 and k < step * 5")
def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    return stats.every_nth(table(spark, d, "part").select("p_partkey"), "p_partkey", 5)


@query("select md5(text) as h, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def exact_dup_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_IDS = "(1, 'abc_T3_v2', 'dino_base_textured_mean8'), (2, 'x_y_T5_v11', 'clip_large_lfd_max28'), (3, 'plain', 'dino_giant_lfd_single'), (4, null, 'clip_base_textured_concat28')"


@query(f"""select id, nullif(regexp_extract(mid, '^(.*)_(T\\d)_v(\\d+)$', 1), '') as source_uid, nullif(regexp_extract(mid, '^(.*)_(T\\d)_v(\\d+)$', 2), '') as tier, nullif(regexp_extract(mid, '^(.*)_(T\\d)_v(\\d+)$', 3), '')::int as variant,
split_part(cfg, '_', 1) as family, split_part(cfg, '_', 2) as size, split_part(cfg, '_', 3) as mode, regexp_replace(split_part(cfg, '_', 4), '\\d+$', '') as strategy, nullif(regexp_extract(cfg, '(\\d+)$', 1), '')::int as n_views,
concat_ws('_', cfg, mid) as tag, 'view_' || lpad((id * 7)::varchar, 2, '0') || '.png' as file, 'data:image/png;base64,' || to_base64(encode(cfg)) as url, left(repeat(cfg, 20), 200) as error from (values {_IDS}) t(id, mid, cfg)""")
def key_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"select * from values {_IDS} as t(id, mid, cfg)")
    source, tier, variant = fn.model_parts("mid")
    parts = manifests.config_parts(F.col("cfg"))
    return rows.select("id", source.alias("source_uid"), tier.alias("tier"), variant.alias("variant"), *(c.alias(n) for n, c in parts.items()), fn.run_tag("cfg", "mid").alias("tag"), fn.view_file(F.col("id") * 7).alias("file"), fn.data_url(F.encode("cfg", "utf-8")).alias("url"), fn.short_error(F.repeat("cfg", 20)).alias("error"))


_FACTS = "('a', 0.5, 0.25), ('b', 0.0, 0.0), ('c', 1.0, 0.5), ('d', null, 0.5)"


@query(f"select k, coalesce(p / nullif(r, 0), 0) as ratio, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from (values {_FACTS}) t(k, p, r)")
def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"select k, cast(p as double) p, cast(r as double) r from values {_FACTS} as t(k, p, r)")
    return rows.select("k", fn.safe_div("p", "r").alias("ratio"), F.round(fn.f1("p", "r"), 6).alias("f1"))


_LABELS = "(0, 0, 0.0, false, false, 0), (255, 5, 20.0, true, false, 3), (255, 900, 0.4, true, false, 3), (255, 900, 30.0, true, false, 3), (255, 900, 30.0, true, true, 3), (0, 0, 9.0, true, false, 3), (255, 900, 30.0, true, false, 2)"


@query(f"""select row_number() over () as k, case when not e then 'missing' when x then 'corrupt' when n < 3 then 'flat_color' when a = 0 or f < 10 then 'blank_alpha' when s < 1.0 then 'flat_color' else 'ok' end as status from (values {_LABELS}) t(a, f, s, e, x, n)""")
def image_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql("select * from values " + ", ".join(f"({i + 1}L, {r.strip('()')})" for i, r in enumerate(_LABELS.split("), ("))) + " as t(k, a, f, s, e, x, n)")
    return rows.select("k", quality.image_label(*(F.col(c) for c in ("a", "f", "s", "e", "x", "n"))).alias("status"))


@query(f"""with {M}, t as (select source_uid, tier, round(avg(e[1]), 6) as v from m where tier is not null group by all), p as (select source_uid, coalesce(max(v) filter (tier = 'T1'), 0) as "T1", coalesce(max(v) filter (tier = 'T2'), 0) as "T2", coalesce(max(v) filter (tier = 'T3'), 0) as "T3", coalesce(max(v) filter (tier = 'T4'), 0) as "T4", coalesce(max(v) filter (tier = 'T5'), 0) as "T5" from t group by 1)
select source_uid, "T1", "T2", "T3", "T4", "T5", round("T1" + "T2" + "T3" + "T4" + "T5", 5) as total from p""")
def tier_heatmap(spark: SparkSession, d: str) -> DataFrame:
    long = models(spark, d).where("tier is not null").groupBy("source_uid", "tier").agg(F.round(F.avg(F.col("e")[0]), 6).alias("v"))
    return reporting.tier_heatmap(long, "source_uid", "v").withColumn("total", F.round("total", 5))


@query("select event_type, metric, value from (select event_type, round(avg(value), 6) as mean, round(max(value), 6) as most, round(min(value), 6) as least from events group by 1) unpivot (value for metric in (mean, most, least))")
def melted_metrics(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.round(F.min("value"), 6).alias("least"))
    return reporting.melted(wide, ["event_type"], ["mean", "most", "least"])


@query("select n_views, map, round(map - lag(map) over (order by n_views), 6) as gain from (values (1, 0.25), (4, 0.3), (8, 0.45), (28, 0.4)) t(n_views, map)")
def view_gains(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 0.25), (4, 0.3), (8, 0.45), (28, 0.4)], "n_views int, map double")
    return reporting.gains(rows, "n_views", "map")


@query("select p_brand, p_type, n from (select *, row_number() over (partition by p_brand order by n desc, p_type) as k from (select p_brand, p_type, count(*) as n from part group by all)) where k = 1")
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    return reporting.best_by(table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), "p_brand", "n", "p_type")


@query("select models, candidates, calls, round(calls * price, 6) as cost from (select m as models, c as candidates, m * c * 9 as calls, p as price from (values (10000, 5, 0.0000138::double), (1000, 20, 0.00001::double)) t(m, c, p))")
def cost_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(10000, 5, 0.0000138), (1000, 20, 0.00001)], "models int, candidates int, price double")
    calls = F.col("models") * F.col("candidates") * 9
    return rows.select("models", "candidates", calls.alias("calls"), F.round(calls * F.col("price"), 6).alias("cost"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ingest.windowed(ingest.with_time(table(spark, d, "events")), "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""select b + interval 30 minutes * k as start, event_type, count(*) as n, round(sum(value), 4) as total from (select *, time_bucket(interval 30 minutes, ts) as b from events) cross join (values (0), (-1)) r(k) group by all""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ingest.windowed(ingest.with_time(table(spark, d, "events")), "1 hour", "30 minutes")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 1 hour as stop, count(*) as n from s group by user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.sessions(ingest.with_time(table(spark, d, "events")), "1 hour")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query(f"with {M} select a.model_id as q, b.model_id as c, round(list_cosine_similarity(a.e, b.e), 6) as sim from m a join m b on a.model_id <> b.model_id where list_cosine_similarity(a.e, b.e) >= 0.3")
def stream_ingest_score(spark: SparkSession, d: str) -> DataFrame:
    """Streams the embeddings through foreachBatch and reads back what was appended."""
    import tempfile
    import uuid

    from .fixtures import vectors

    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="twinsight-")
    own = f"{top}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings")
    stream = ingest.read_embeddings(spark, f"{d}/embeddings.parque[t]", e.schema)
    incoming = stream.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), fn.doubles("embedding").alias("vector"))
    q = ingest.score_stream(incoming, vectors(models(spark, d)), 0.3, f"{own}/out", f"{own}/checkpoint")
    q.awaitTermination()
    out = spark.read.schema("q long, c long, sim double").option("recursiveFileLookup", True).parquet(f"{own}/out")
    return out.select("q", "c", F.round("sim", 6).alias("sim"))
