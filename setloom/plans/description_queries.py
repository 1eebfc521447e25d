"""Queries over vectors of item texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from setloom.operators import descriptions as D
from setloom.plans.base import Model, sql
from setloom.registry import query
from setloom.shared import stash

WORDS = {
    "dv": "SELECT p_partkey AS item_id, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS e FROM (SELECT p_partkey, list_transform(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS b FROM part)",
    "du": "SELECT item_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM dv",
    "dm0": "SELECT bundle_id, k, avg(x) AS x FROM (SELECT bundle_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM inputs JOIN du USING (item_id)) GROUP BY ALL",
    "dm1": "SELECT bundle_id, list(x ORDER BY k) AS m FROM dm0 GROUP BY 1",
    "dmean": "SELECT bundle_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS m FROM dm1",
    "dgt": "SELECT bundle_id, v AS g FROM samples JOIN du USING (item_id) WHERE is_gt",
    "dsim": "SELECT s.bundle_id, s.pos, s.item_id, s.is_gt, list_dot_product(du.v, dmean.m) AS sim, list_dot_product(du.v, dgt.g) AS to_gt FROM samples s JOIN du USING (item_id) JOIN dmean USING (bundle_id) JOIN dgt USING (bundle_id)",
    "dplace": "SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY round(sim, 9) DESC, pos) AS place FROM dsim",
    "drun": "SELECT bundle_id, pred_pos, hit FROM runs WHERE method = 'cooccurrence'",
    "ddet": """SELECT bundle_id, max(item_id) FILTER (WHERE is_gt) AS true_item, max(sim) FILTER (WHERE is_gt) AS gt_sim, avg(sim) FILTER (WHERE NOT is_gt) AS neg_mean, max(sim) FILTER (WHERE NOT is_gt) AS neg_max, max(place) FILTER (WHERE is_gt) AS gt_rank,
        max(pos) FILTER (WHERE place = 1) AS top_pos, max(item_id) FILTER (WHERE place = 1) AS top_item, max(sim) FILTER (WHERE pos = pred_pos) AS pred_sim, max(hit) AS hit, (max(pred_pos) = max(pos) FILTER (WHERE place = 1))::INT AS pred_is_top,
        avg(to_gt) FILTER (WHERE NOT is_gt) AS distractor_mean, max(to_gt) FILTER (WHERE NOT is_gt) AS distractor_max FROM dplace JOIN drun USING (bundle_id) GROUP BY 1""",
}
SIMS = ("gt_sim", "neg_mean", "neg_max", "pred_sim", "distractor_mean", "distractor_max")


def signal(m: Model):
    parts = m.table("part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_type")
    vectors = stash(D.word_vectors(parts, F.concat_ws(" ", "p_name", "p_type")), "word-vectors")
    return D.description_signal(m.samples.withColumn("pos", F.col("pos").cast("long")), m.inputs, vectors, m.runs.where("method = 'cooccurrence'"))


@query("v03_description_detail", sql("SELECT bundle_id, true_item, gt_rank, top_pos, top_item, hit, pred_is_top, " + ", ".join(f"round({c}, 8) AS {c}" for c in SIMS) + " FROM ddet", **WORDS))
def v03(spark, d):
    return signal(Model(spark, d)).select("bundle_id", "true_item", "gt_rank", "top_pos", "top_item", "hit", "pred_is_top", *[F.round(c, 8).alias(c) for c in SIMS])


MEANS = {"hit": "hit_rate", "(gt_rank = 1)::INT": "top1_rate", "1.0 / gt_rank": "mrr", "gt_rank": "gt_rank_mean", "gt_sim": "gt_sim_mean", "neg_mean": "neg_sim_mean", "neg_max": "neg_max_mean", "gt_sim - neg_max": "margin_best_mean", "gt_sim - neg_mean": "margin_mean_mean", "pred_is_top": "pred_is_top_rate", "distractor_mean": "distractor_sim_mean", "distractor_max": "distractor_max_mean"}


@query("v03_description_summary", sql("SELECT split, count(*) AS n, " + ", ".join(f"round(avg({c}), 8) AS {name}" for c, name in MEANS.items()) + " FROM (SELECT *, unnest(['all', CASE WHEN hit = 1 THEN 'llm_hit' ELSE 'llm_miss' END]) AS split FROM ddet) GROUP BY 1", **WORDS))
def v03_summary(spark, d):
    out = D.description_summary(signal(Model(spark, d)))
    return out.select("split", "n", *[F.round(c, 8).alias(c) for c in out.columns if c not in ("split", "n")])
