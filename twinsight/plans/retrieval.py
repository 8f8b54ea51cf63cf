"""Descriptors, similarity search and ranked-retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalise
from ..operators import aggregate, ann, blocks, retrieval, stats, truth
from .fixtures import M, PAIRS, RANKED, models, sources, table, vectors, views
from .registry import query


def _truth(m: DataFrame) -> DataFrame:
    return m.select("model_id", "source_uid", "tier", "is_source")


@query(f"with {M} select model_id, source_uid, tier, is_source from m")
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    own = m.where("is_source").select(F.col("model_id").alias("uid"))
    made = m.where("not is_source").select(F.col("model_id").alias("clone_id"), "source_uid", "tier")
    labelled = truth.ground_truth(own, made).join(m.where("is_source").select(F.col("model_id").alias("source_model"), F.col("source_uid").alias("label")), F.col("model_id") == F.col("source_model"), "left")
    return labelled.select("model_id", F.coalesce("label", "source_uid").alias("source_uid"), "tier", "is_source")


@query(f"with {M} select model_id, source_uid, count(*) over (partition by source_uid) - 1 as n_relevant from m")
def relevance_groups(spark: SparkSession, d: str) -> DataFrame:
    return truth.group_sizes(_truth(models(spark, d)))


@query(f"with {M}, k as (select * from m where split = 'train'), i as (select vec_id as model_id from embeddings) select i.model_id, coalesce(k.source_uid, i.model_id) as source_uid, k.tier, coalesce(k.is_source, false) as is_source from i left join k using (model_id)")
def resolve_unknown(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    return truth.resolve_sources(m.select("model_id"), _truth(m.where("split = 'train'"))).select("model_id", "source_uid", "tier", "is_source")


_LONG = "select model_id, (d - 1)::int as dim, round(val / greatest(sqrt(sum(val * val) over (partition by model_id)), 1e-8), 6) as val from x"


def _agg_sql(fn: str, n: int) -> str:
    return f"with {M}, x as (select model_id, d, {fn}(e[8*v+d]) as val from m cross join range({n}) r(v) cross join range(1, 9) k(d) group by model_id, d) {_LONG}"


@query(_agg_sql("max", 1))
def agg_single(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.long_form(aggregate.describe(views(models(spark, d)), "single"))


@query(_agg_sql("avg", 8))
def agg_mean8(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.long_form(aggregate.describe(views(models(spark, d)), "mean"))


@query(_agg_sql("avg", 4))
def agg_mean4(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.long_form(aggregate.describe(views(models(spark, d)), "mean", 4))


@query(_agg_sql("max", 8))
def agg_max8(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.long_form(aggregate.describe(views(models(spark, d)), "max"))


@query(f"with {M}, x as (select model_id, d, e[d] as val from m cross join range(1, 65) k(d)) {_LONG}")
def agg_concat(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.long_form(aggregate.describe(views(models(spark, d)), "concat"))


@query(f"with {M}, x as (select model_id, d, 3 * e[d] as val from m cross join range(1, 65) k(d)) {_LONG}")
def l2_normalised(spark: SparkSession, d: str) -> DataFrame:
    scaled = models(spark, d).select("model_id", F.transform("e", lambda x: 3 * x).alias("e"))
    return aggregate.long_form(scaled.select("model_id", l2_normalise("e").alias("emb")))


@query(f"""with {M}, mean as (select d, avg(e[d]) as mu from m cross join range(1, 65) k(d) group by d),
c as (select model_id, list(e[d] - mu order by d) as e from m cross join mean group by model_id),
r as (select a.model_id as q, b.model_id as c, list_cosine_similarity(a.e, b.e) as sim, row_number() over (partition by a.model_id order by round(list_cosine_similarity(a.e, b.e), 12) desc, b.model_id) as k from c a join c b on a.model_id <> b.model_id)
select q, c, round(sim, 6) as sim from r where k <= 5""")
def agg_concat_pca_full(spark: SparkSession, d: str) -> DataFrame:
    """All components: a rotation, so neighbours are those of centred vectors."""
    m = models(spark, d)
    rows = m.count()
    out, _ = aggregate.pca(aggregate.describe(views(m), "concat", normalise=False), 768)
    v = out.select(F.col("model_id").alias("id"), F.lit(0).cast("long").alias("grp"), F.col("emb").alias("vector"))
    return blocks.nearest(v, v, 5, sizes=(rows, rows)).select("q", "c", F.round("sim", 6).alias("sim"))


@query()
def agg_concat_pca_k8(spark: SparkSession, d: str) -> DataFrame:
    _, shares = aggregate.pca(aggregate.describe(views(models(spark, d)), "concat", normalise=False), 8)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(shares)], "component int, share double")


@query(f"""with {M}, v as (select model_id, v::int as view_idx, model_id || '/' || v as path from m cross join range(8) r(v) where e[8*v+1] > 0.05)
select a.model_id, r.v::int as view_idx, coalesce(b.path, a.first_path) as path
from (select model_id, min_by(path, view_idx) as first_path from v group by model_id) a cross join range(8) r(v) left join v b on b.model_id = a.model_id and b.view_idx = r.v""")
def fill_missing_views(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    have = views(m).where("emb[0] > 0.05")  # the others count as not rendered
    have = have.select("model_id", "view_idx", F.concat_ws("/", F.col("model_id").cast("string"), F.col("view_idx").cast("string")).alias("path"))
    return aggregate.fill_views(have, m, 8)


@query(f"with {PAIRS} select q, c, round(sim, 6) as sim from s where q < c order by sim desc, q, c limit 20")
def cosine_pairs_top(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(models(spark, d))
    near = blocks.nearest(v, v, 20).select(F.least("q", "c").alias("q"), F.greatest("q", "c").alias("c"), F.round("sim", 12).alias("sim")).distinct()
    return near.orderBy(F.col("sim").desc(), "q", "c").limit(20).select("q", "c", F.round("sim", 6).alias("sim"))


@query(f"with {PAIRS} select q, c, round(sim, 6) as sim from s where q < c and sim >= 0.3")
def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(models(spark, d))
    return blocks.similar(v, v, 0.3, ordered=True).select("q", "c", F.round("sim", 6).alias("sim"))


@query(f"with {RANKED} select q, c, round(sim, 6) as sim, rnk as rank from r join m on m.model_id = r.q where m.is_source and rnk <= 20")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    return blocks.nearest(vectors(sources(m)), vectors(m), 20).select("q", "c", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


def _metrics(m: DataFrame) -> DataFrame:
    v = vectors(m)
    return retrieval.ranked_metrics(v, v).join(m.select(F.col("model_id").alias("q"), "tier"), "q")


_MEANS = "count(*) as n_queries, round(avg(ap), 6) as map, round(avg(p1), 6) as p1, round(avg(p5), 6) as p5, round(avg(p10), 6) as p10, round(avg(r10), 6) as r10, round(avg(r50), 6) as r50"


@query(f"with {RANKED} select {_MEANS} from ap")
def retrieval_map(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.overall(_metrics(models(spark, d)))


@query(f"with {RANKED} select q, n_relevant, round(ap, 6) as ap, p1, p5, p10, round(r10, 6) as r10, round(r50, 6) as r50 from ap")
def retrieval_pk_rk(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(models(spark, d))
    return m.select("q", "n_relevant", F.round("ap", 6).alias("ap"), "p1", "p5", "p10", F.round("r10", 6).alias("r10"), F.round("r50", 6).alias("r50"))


@query(f"with {RANKED} select coalesce(tier, 'all') as tier, count(*) as n_queries, round(avg(ap), 6) as map, round(avg(p1), 6) as p1 from ap join m on m.model_id = ap.q group by grouping sets ((tier), ()) having tier is not null or grouping(tier) = 1")
def retrieval_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.by_tier(_metrics(models(spark, d)))


def _view_sql(n: int) -> str:
    return f"""select {n} as n_views, round(avg(ap), 6) as map from (
  select q, sum(hit / rnk) / count(*) as ap from (select *, row_number() over (partition by q order by rnk) as hit from (
    select a.model_id as q, b.model_id as c, a.g as gq, b.g as gc, row_number() over (partition by a.model_id order by round(list_cosine_similarity(a.x, b.x), 12) desc, b.model_id) as rnk
    from x{n} a join x{n} b on a.model_id <> b.model_id) where gq = gc) group by q)"""


_VIEWS = (1, 2, 4, 8)


@query(f"with {M}, " + ", ".join(f"x{n} as (select model_id, source_uid as g, list_transform(range(1, 9), lambda d: list_avg(list_transform(range({n}), lambda v: e[8*v+d]))) as x from m)" for n in _VIEWS) + " " + " union all ".join(map(_view_sql, _VIEWS)))
def view_ablation(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    rows = m.count()
    out = None
    for n in _VIEWS:
        emb = aggregate.describe(views(m), "mean", n).join(m.select("model_id", "source_uid"), "model_id")
        v = emb.select(F.col("model_id").alias("id"), F.col("source_uid").alias("grp"), F.col("emb").alias("vector"))
        part = retrieval.overall(retrieval.ranked_metrics(v, v, (rows, rows))).select(F.lit(n).alias("n_views"), "map")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {M} select a.model_id as a, b.model_id as b, round(list_dot_product(a.e, b.e), 6) as sim from m a join m b on a.source_uid = b.source_uid and a.model_id < b.model_id")
def within_group_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d).select("model_id", "source_uid", "e")
    a, b = m.toDF("a", "g", "x"), m.toDF("b", "g", "y")
    return a.join(b, "g").where("a < b").select("a", "b", F.round(dot("x", "y"), 6).alias("sim"))


@query()
def negative_sample(spark: SparkSession, d: str) -> DataFrame:
    return truth.negative_sample(_truth(models(spark, d)), 20)


@query(f"""with {M}, e as (select a.model_id as q, b.model_id as c, a.source_uid = b.source_uid as rel, 1 - list_dot_product(a.e, b.e) as dist from m a join m b on a.model_id <> b.model_id where list_dot_product(a.e, b.e) >= 0.1),
p as (select q, count(*) as pool from e group by q having count(*) >= 10),
r as (select e.*, row_number() over (partition by q order by round(dist, 12), c) as rnk from e join p using (q)),
h as (select q, rnk, row_number() over (partition by q order by rnk) as hit from r where rel),
n as (select model_id as q, count(*) over (partition by source_uid) - 1 as n_relevant from m)
select q, n_relevant, round(coalesce(sum(hit / rnk), 0) / n_relevant, 6) as ap from n join p using (q) left join h using (q) where n_relevant > 0 group by q, n_relevant""")
def sparse_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation on an edge list: absent pairs are out of reach, their relevant items still count."""
    m = models(spark, d)
    v = vectors(m)
    sizes = truth.group_sizes(m.select("model_id", "source_uid")).select(F.col("model_id").alias("q"), "n_relevant")
    return retrieval.reached_metrics(v, v, 0.1, sizes).select("q", "n_relevant", F.round("ap", 6).alias("ap"))


@query(f"""with {RANKED}, g as (select h.q, h.rnk, pow(2.0, case when m.tier is null then 6 else 6 - right(m.tier, 1)::int end) - 1 as gain, h.c from h join m on m.model_id = h.c),
i as (select *, row_number() over (partition by q order by gain desc, c) as k from g)
select q, round(sum(gain / log2(rnk + 1)) / sum(gain / log2(k + 1)), 6) as ndcg from i group by q""")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    grade = F.when(F.col("tier").isNull(), 6).otherwise(6 - F.substring("tier", 2, 1).cast("int"))
    graded = m.select(F.col("model_id").alias("id"), F.col("source_uid").alias("grp"), F.col("e").alias("vector"), grade.cast("double").alias("mark"))
    return retrieval.ranked_ndcg(vectors(m), graded).select("q", F.round("ndcg", 6).alias("ndcg"))


@query(f"with {RANKED} select mq.tier, count(*) as n, round(avg(rnk), 6) as mean_rank, round(avg(sim), 6) as mean_sim from h join m mq on mq.model_id = h.q join m mc on mc.model_id = h.c where mc.is_source group by mq.tier")
def source_rank(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    marked = m.select(F.col("model_id").alias("id"), F.col("source_uid").alias("grp"), F.col("e").alias("vector"), F.col("is_source").cast("double").alias("mark"))
    ranks = retrieval.marked_ranks(vectors(m), marked)
    return ranks.join(m.select(F.col("model_id").alias("q"), "tier"), "q").groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg("sim"), 6).alias("mean_sim"))


@query(f"""with {PAIRS}, a as (select c as model_id, gc as label, arg_max(gq, sim) as cell from s join m on m.model_id = s.q where m.is_source and not exists (select 1 from m k where k.model_id = s.c and k.is_source) group by c, gc),
t as (select label, cell, count(*) as k from a group by label, cell),
x as (select (select sum(k * (k - 1) / 2) from t) as cells, (select sum(k) from t) as n, (select sum(k * (k - 1) / 2) from (select sum(k) as k from t group by label)) as r, (select sum(k * (k - 1) / 2) from (select sum(k) as k from t group by cell)) as c)
select n::bigint as n, round((cells - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 6) as ari from x""")
def adjusted_rand_index(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    near = blocks.nearest(vectors(m.where("not is_source")), vectors(sources(m)), 1)
    both = near.join(m.select(F.col("model_id").alias("q"), F.col("source_uid").alias("label")), "q").join(m.select(F.col("model_id").alias("c"), F.col("source_uid").alias("cell")), "c")
    return stats.adjusted_rand(both, "label", "cell").select("n", F.round("ari", 6).alias("ari"))


@query(f"""with {M}, d as (select round(list_dot_product(a.e[1:8], a.e[9:16]) - list_dot_product(a.e[17:24], a.e[25:32]), 12) as d from m a),
k as (select abs(d) as x, count(*) as k, count(*) filter (d > 0) as up from d where d <> 0 group by abs(d)),
r as (select k, up, coalesce(sum(k) over (order by x rows between unbounded preceding and 1 preceding), 0) + (k + 1) / 2 as rank from k),
s as (select sum(k) as n, sum(rank * up) as wp, sum(rank * (k - up)) as wm, sum(k * k * k - k) as ties from r)
select n::bigint as n, wp as w_plus, wm as w_minus, round((wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) as z from s""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    v = lambda k: F.slice("e", 8 * k + 1, 8)
    return stats.wilcoxon(models(spark, d).select(dot(v(0), v(1)).alias("a"), dot(v(2), v(3)).alias("b")), "a", "b")


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    out = stats.bootstrap(_metrics(models(spark, d)), "q", "ap")
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"""with {M}, b as (select d, min(e[d]) as lo, max(e[d]) as hi from m cross join range(1, 65) k(d) group by d)
select model_id, (d - 1)::int as dim, round((e[d] - lo) / (hi - lo) * 255)::int as code from m cross join b""")
def sq8_codes(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(models(spark, d))
    codes = ann.sq8_encode(v, ann.sq8_bounds(v))
    return codes.select(F.col("id").alias("model_id"), F.posexplode("codes").alias("dim", "code"))


def _exact(v: DataFrame) -> DataFrame:
    return blocks.nearest(v, v, 10)


@query()
def sq8_recall(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(models(spark, d))
    bounds = ann.sq8_bounds(v)
    near = ann.sq8_decode(ann.sq8_encode(v, bounds), bounds).select("id", F.lit(0).cast("long").alias("grp"), "vector")
    return ann.recall(blocks.nearest(v, near, 10), _exact(v), 10)


@query()
def ann_ivf(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(models(spark, d))
    return ann.recall(ann.InvertedFile(v, 16).search(v, 10, 14), _exact(v), 10)


@query()
def ann_pq(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(models(spark, d))
    return ann.recall(ann.ProductCodes(v, 32, 256).search(v, 10, 100), _exact(v), 10)


@query()
def ann_lsh(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(models(spark, d))
    return ann.recall(ann.hashed_neighbours(v, v, 10), _exact(v), 10)


@query("select k, round(4.0 * 64 * (select count(*) from embeddings) / 1e6 * f, 6) as mb from (values ('flat', 1.0), ('sq8', 0.25)) t(k, f)")
def index_memory(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "embeddings").count()
    return spark.createDataFrame([(k, round(ann.memory_mb(n, 64, k), 6)) for k in ("flat", "sq8")], "k string, mb double")
