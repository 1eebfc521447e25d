"""Queries over samples and scored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from setloom.operators import runs as R
from setloom.operators import sampling as S
from setloom.plans.base import Model, sql
from setloom.plans.bundle_queries import rounded
from setloom.registry import query

METHODS = ["popularity", "cooccurrence", "category"]
TIES = {
    "lev": "SELECT method, bundle_id, list_sort(list(DISTINCT score), 'DESC') AS l FROM scores GROUP BY ALL",
    "ties": """SELECT s.method AS signal, s.bundle_id, pos, item_id, is_gt, score, rank() OVER (PARTITION BY s.method, s.bundle_id ORDER BY score DESC) AS min_rank, count(*) OVER (PARTITION BY s.method, s.bundle_id, score) AS eq,
      (score = l[1])::INT AS in_top_tie, l[1] AS top_score, CASE WHEN len(l) > 1 THEN l[1] - l[2] ELSE 0.0 END AS second_margin, sum((score = l[1])::INT) OVER (PARTITION BY s.method, s.bundle_id)::BIGINT AS top_tie_size, (len(l) = 1)::INT AS all_tied, (l = [0.0])::INT AS all_zero, (l[1] > 0)::INT AS positive_signal
      FROM scores s JOIN lev USING (method, bundle_id)""",
    "det": """SELECT r.method, r.bundle_id, r.hit, g.signal, """ + ", ".join(f"{p}.{c} AS {q}_{c}" for p, q in (("g", "gt"), ("p", "pred")) for c in ("score", "min_rank", "in_top_tie", "top_score", "second_margin", "top_tie_size", "all_tied", "all_zero", "positive_signal")) + """,
      g.min_rank + (g.eq - 1) / 2.0 AS gt_avg_rank, p.min_rank + (p.eq - 1) / 2.0 AS pred_avg_rank, (g.in_top_tie = 1 AND g.top_tie_size = 1)::INT AS gt_unique_top1, (p.in_top_tie = 1 AND p.top_tie_size = 1)::INT AS pred_unique_top1
      FROM runs r JOIN ties g ON g.bundle_id = r.bundle_id AND g.pos = r.true_pos LEFT JOIN ties p ON p.bundle_id = r.bundle_id AND p.pos = r.pred_pos AND p.signal = g.signal""",
}


def detail(m: Model):
    return R.signal_rows(m.runs_with_options, METHODS)


def spread(aggregate: str, pairs: dict[str, str]) -> str:
    return ", ".join(f"round({aggregate}({c}), 9) AS {a}" for c, a in pairs.items())


@query("p01_samples", sql("SELECT bundle_id, pos, item_id, is_gt FROM samples"))
def p01(spark, d):
    return Model(spark, d).samples.select("bundle_id", F.col("pos").cast("long").alias("pos"), "item_id", "is_gt")


@query("p10_seeded_truncation", sql("SELECT bundle_id, is_gt, item_id FROM esplit", ev="SELECT bundle_id FROM (SELECT DISTINCT bundle_id, md5('45_' || bundle_id) AS h FROM fixed) ORDER BY h, bundle_id LIMIT 250"))
def p10(spark, d):
    """The evaluation set cut to 250 bundles, which is an option of the model."""
    return Model(spark, d, eval_bundles=250).eval_split.select("bundle_id", "is_gt", "item_id")


@query("p04_fixed_split", sql("SELECT bundle_id, item_id, is_gt FROM fixed"))
def p04(spark, d):
    return Model(spark, d).fixed


@query("p04_fixed_split_first", sql("SELECT bundle_id, item_id, row_number() OVER (PARTITION BY bundle_id ORDER BY item_id) = 1 AS is_gt FROM (SELECT *, count(*) OVER (PARTITION BY bundle_id) AS c FROM test) WHERE c >= 2"))
def p04_first(spark, d):
    return S.fixed_split(Model(spark, d).test, 45, first=True)


@query("p03_hard_negatives")
def p03(spark, d):
    m = Model(spark, d)
    return S.hard_negatives(m.eval_split, m.items, "category", 9, 45).withColumn("place", F.col("place").cast("long"))


AFF = {"aff": "SELECT x.item_id AS a, y.item_id AS b, count(*) AS n FROM train x JOIN train y ON x.bundle_id = y.bundle_id AND x.item_id <> y.item_id WHERE x.item_id IN (SELECT item_id FROM samples) GROUP BY ALL"}


@query("p05_weighted_neighbours", sql("SELECT a, b, n, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY -ln((('0x' || substr(md5('7_' || a || '_' || b), 1, 8))::BIGINT + 0.5) / 4294967296.0) / n, b) AS place FROM aff) WHERE place <= 3", **AFF))
def p05(spark, d):
    from setloom.operators import graph as G

    m = Model(spark, d)
    wanted = m.samples.select("item_id").distinct()
    near = m.train.join(wanted, "item_id", "left_semi")
    pairs = near.select("bundle_id", F.col("item_id").alias("a")).join(m.train.select("bundle_id", F.col("item_id").alias("b")), "bundle_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return S.weighted(pairs, "a", "b", F.col("n"), 3, 7).withColumn("place", F.col("place").cast("long"))


@query("p06_examples", sql("SELECT bundle_id, item_id, place, place = 0 AS is_gt FROM (SELECT bundle_id, item_id, row_number() OVER (PARTITION BY bundle_id ORDER BY md5('13_' || bundle_id || '_' || item_id), item_id) - 1 AS place FROM (SELECT *, count(*) OVER (PARTITION BY bundle_id) AS c FROM train) WHERE c >= 2) WHERE place <= 5"))
def p06(spark, d):
    return S.examples(Model(spark, d).train, 13, 5).withColumn("place", F.col("place").cast("long"))


@query("a27_run_metrics", sql("SELECT method, count(*) AS n, round(avg(hit), 9) AS hit_rate, 1.0::DOUBLE AS valid_ratio, round(avg(hit), 9) AS valid_hit_rate, round(avg((true_rank <= 1)::INT), 9) AS hit_at_1, round(avg((true_rank <= 3)::INT), 9) AS hit_at_3, round(avg((true_rank <= 5)::INT), 9) AS hit_at_5, round(avg(1.0 / true_rank), 9) AS mrr, " + ", ".join(f"round(avg(CASE WHEN true_rank <= {k} THEN 1.0 / log2(true_rank + 1) ELSE 0 END), 9) AS ndcg_at_{k}" for k in (3, 5, 10)) + ", round(avg(true_rank), 9) AS mean_rank, median(true_rank)::DOUBLE AS median_rank FROM runs GROUP BY 1"))
def a27(spark, d):
    return rounded(R.run_metrics(Model(spark, d).runs), "hit_rate", "valid_hit_rate", "hit_at_1", "hit_at_3", "hit_at_5", "mrr", "ndcg_at_3", "ndcg_at_5", "ndcg_at_10", "mean_rank")


@query("w02_tie_stats", sql("SELECT signal AS method, bundle_id, pos, item_id, is_gt, score, min_rank, min_rank + eq - 1 AS max_rank, min_rank + (eq - 1) / 2.0 AS avg_rank, in_top_tie, (in_top_tie = 1 AND top_tie_size = 1)::INT AS unique_top1, top_score - score AS gap_to_top, top_score, second_margin, top_tie_size, all_tied, all_zero, positive_signal FROM ties", **TIES))
def w02(spark, d):
    return R.tie_stats(Model(spark, d).scores.withColumn("pos", F.col("pos").cast("long")), "method", "bundle_id")


QUALITY = {"gt_in_top_tie": "gt_in_top_tie_rate", "gt_unique_top1": "gt_unique_top1_rate", "gt_min_rank": "gt_mean_min_rank", "gt_avg_rank": "gt_mean_avg_rank", "gt_score": "gt_mean_score", "gt_top_score": "mean_top_score", "gt_top_tie_size": "mean_top_tie_size", "gt_all_zero": "all_zero_rate", "gt_all_tied": "all_tied_rate", "gt_positive_signal": "positive_signal_rate", "gt_second_margin": "mean_top_second_margin"}


@query("a29_signal_quality", sql(f"SELECT signal, count(*) AS n, {spread('avg', QUALITY)} FROM (SELECT DISTINCT ON (signal, bundle_id) * FROM det) GROUP BY 1", **TIES))
def a29_quality(spark, d):
    return rounded(R.signal_quality(detail(Model(spark, d))), *QUALITY.values())


RELIANCE = {"pred_in_top_tie": "pred_in_top_tie_rate", "pred_unique_top1": "pred_unique_top1_rate", "pred_min_rank": "pred_mean_min_rank", "pred_avg_rank": "pred_mean_avg_rank", "pred_score": "pred_mean_score"}


@query("a29_method_reliance", sql(f"SELECT method, signal, count(*) AS n, count(pred_min_rank) AS valid_pred_n, round(avg(hit), 9) AS accuracy, {spread('avg', RELIANCE)}, round(avg(hit) FILTER (WHERE pred_in_top_tie = 1), 9) AS hit_when_pred_in_top_tie, round(avg(hit) FILTER (WHERE pred_in_top_tie = 0), 9) AS hit_when_pred_not_in_top_tie, round(avg(pred_in_top_tie) FILTER (WHERE gt_positive_signal = 1), 9) AS pred_in_top_tie_rate_when_positive, round(avg(pred_unique_top1) FILTER (WHERE gt_positive_signal = 1), 9) AS pred_unique_top1_rate_when_positive FROM det GROUP BY ALL", **TIES))
def a29_reliance(spark, d):
    return rounded(R.method_reliance(detail(Model(spark, d))), "accuracy", *RELIANCE.values(), "hit_when_pred_in_top_tie", "hit_when_pred_not_in_top_tie", "pred_in_top_tie_rate_when_positive", "pred_unique_top1_rate_when_positive")


@query("a29_signal_quadrants", sql("SELECT method, signal, CASE WHEN gt_in_top_tie = 1 THEN 'gt_top' ELSE 'gt_not_top' END AS gt_cf_group, CASE WHEN pred_in_top_tie = 1 THEN 'pred_top' ELSE 'pred_not_top' END AS pred_cf_group, count(*) AS n, round(avg(hit), 9) AS accuracy, round(avg(gt_avg_rank), 9) AS mean_gt_avg_rank, round(avg(pred_avg_rank), 9) AS mean_pred_avg_rank, round(avg(gt_top_tie_size), 9) AS mean_top_tie_size FROM det WHERE pred_min_rank IS NOT NULL GROUP BY ALL", **TIES))
def a29_quadrants(spark, d):
    return rounded(R.signal_quadrants(detail(Model(spark, d))), "accuracy", "mean_gt_avg_rank", "mean_pred_avg_rank", "mean_top_tie_size")


ORDER = "CASE {} WHEN 'popularity' THEN 0 WHEN 'cooccurrence' THEN 1 ELSE 2 END"
CELLS = "count(*) FILTER (WHERE l.hit = 1 AND r.hit = 1) AS both_hit, count(*) FILTER (WHERE l.hit = 0 AND r.hit = 0) AS both_fail, count(*) FILTER (WHERE l.hit = 1 AND r.hit = 0) AS left_only, count(*) FILTER (WHERE l.hit = 0 AND r.hit = 1) AS right_only"
ONLY = {"gt_in_top_tie": "right_only_gt_in_top_tie_rate", "gt_unique_top1": "right_only_gt_unique_top1_rate", "pred_in_top_tie": "right_only_pred_in_top_tie_rate", "pred_unique_top1": "right_only_pred_unique_top1_rate", "gt_avg_rank": "right_only_mean_gt_avg_rank", "pred_avg_rank": "right_only_mean_pred_avg_rank"}


@query("a30_signal_pairwise", sql("SELECT l.signal, l.method AS left_method, r.method AS right_method, count(*) AS n, round(avg(l.hit), 9) AS left_accuracy, round(avg(r.hit), 9) AS right_accuracy, " + CELLS + ", " + ", ".join(f"round(avg(r.{c}) FILTER (WHERE l.hit = 0 AND r.hit = 1), 9) AS {a}" for c, a in ONLY.items()) + f" FROM det l JOIN det r ON r.signal = l.signal AND r.bundle_id = l.bundle_id AND {ORDER.format('l.method')} < {ORDER.format('r.method')} GROUP BY ALL", **TIES))
def a30(spark, d):
    return rounded(R.signal_pairwise(detail(Model(spark, d)), METHODS), "left_accuracy", "right_accuracy", *ONLY.values())


@query("j15_method_pairwise", sql(f"SELECT l.method AS left_method, r.method AS right_method, count(*) AS n, round(avg(l.hit), 9) AS left_acc, round(avg(r.hit), 9) AS right_acc, {CELLS} FROM runs l JOIN runs r ON r.bundle_id = l.bundle_id AND {ORDER.format('l.method')} < {ORDER.format('r.method')} GROUP BY ALL"))
def j15(spark, d):
    return rounded(R.pairwise(Model(spark, d).runs, METHODS), "left_acc", "right_acc")


JOINT = {"jo": "SELECT bundle_id, max(hit) FILTER (WHERE method = 'popularity') AS p, max(hit) FILTER (WHERE method = 'cooccurrence') AS c, max(hit) FILTER (WHERE method = 'category') AS g, sum(hit)::INT AS hc, CASE WHEN sum(hit) = 3 THEN 'all_hit' WHEN sum(hit) = 0 THEN 'all_fail' ELSE 'mixed' END AS o FROM runs GROUP BY 1"}
OUT = "count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE o = '{o}') AS {o}, round(avg((o = '{o}')::INT), 9) AS {o}_rate" for o in ("all_hit", "all_fail", "mixed")) + ", round(avg(hc), 9) AS mean_hit_count"
RATES = ("all_hit_rate", "all_fail_rate", "mixed_rate", "mean_hit_count")


@query("a31_joint_outcomes", sql("SELECT o AS joint_outcome, count(*) AS n, round(avg(p), 9) AS popularity_acc, round(avg(c), 9) AS cooccurrence_acc, round(avg(g), 9) AS category_acc, round(count(*) / (SELECT count(*) FROM jo)::DOUBLE, 9) AS rate FROM jo GROUP BY 1", **JOINT))
def a31(spark, d):
    return rounded(R.joint_summary(R.joint(Model(spark, d).runs, METHODS), METHODS), "popularity_acc", "cooccurrence_acc", "category_acc", "rate")


@query("a31_joint_by_category", sql(f"SELECT category AS gt_category, {OUT} FROM jo JOIN heldout USING (bundle_id) GROUP BY 1", **JOINT))
def a31_by(spark, d):
    m = Model(spark, d)
    return rounded(R.joint_by(R.joint(m.runs, METHODS).join(m.heldout.select("bundle_id", F.col("category").alias("gt_category")), "bundle_id"), "gt_category"), *RATES)


@query("a31_joint_by_tags", sql(f"SELECT tag, {OUT} FROM (SELECT DISTINCT jo.*, tag FROM jo JOIN (SELECT bundle_id, category AS tag FROM heldout UNION ALL SELECT i.bundle_id, kind FROM inputs i JOIN it USING (item_id)) USING (bundle_id)) GROUP BY 1", **JOINT))
def a31_tags(spark, d):
    m = Model(spark, d)
    second = m.inputs.join(m.items, "item_id").groupBy("bundle_id").agg(F.collect_list("kind").alias("secondary"))
    rows = R.joint(m.runs, METHODS).join(m.heldout.select("bundle_id", F.col("category").alias("primary_tag")), "bundle_id").join(second, "bundle_id", "left")
    return rounded(R.joint_by_tags(rows, "primary_tag", "secondary"), *RATES)


VIEWS = {
    "vw": "SELECT bundle_id, max(true_rank) FILTER (WHERE method = 'popularity') AS popularity, max(true_rank) FILTER (WHERE method = 'cooccurrence') AS cooccurrence, max(true_rank) FILTER (WHERE method = 'category') AS category FROM runs GROUP BY 1",
    "vs": "SELECT *, least(popularity, cooccurrence, category) AS orc, greatest(popularity, cooccurrence, category) AS wst FROM vw",
    "per": "SELECT *, list_filter([CASE WHEN popularity = orc THEN 'popularity' END, CASE WHEN cooccurrence = orc THEN 'cooccurrence' END, CASE WHEN category = orc THEN 'category' END], lambda x: x IS NOT NULL) AS win, cooccurrence - orc AS regret, " + ", ".join(f"list_filter([CASE WHEN popularity <= {k} THEN 'popularity' END, CASE WHEN cooccurrence <= {k} THEN 'cooccurrence' END, CASE WHEN category <= {k} THEN 'category' END], lambda x: x IS NOT NULL) AS h{k}" for k in (1, 3, 5)) + " FROM vs",
    "lg": " UNION ALL ".join(f"SELECT bundle_id, '{a}' AS view, {a} AS own, least({b}, {c}) AS best, greatest({b}, {c}) AS worst, len(h1) AS nh FROM per" for a, b, c in (("popularity", "cooccurrence", "category"), ("cooccurrence", "popularity", "category"), ("category", "popularity", "cooccurrence"))),
}


def per_view(spark, d):
    return R.views(Model(spark, d).runs.withColumn("true_rank", F.col("true_rank").cast("long")), METHODS, "cooccurrence")


@query("a32_view_oracle", sql("SELECT bundle_id, popularity, cooccurrence, category, orc AS oracle_rank, wst AS worst_rank, wst - orc AS rank_gap, array_to_string(win, '|') AS oracle_winners, len(win) AS num_winners, CASE WHEN len(win) = 1 THEN win[1] ELSE 'Tie' END AS unique_winner, regret, " + ", ".join(f"CASE WHEN len(h{k}) > 0 THEN array_to_string(h{k}, '|') ELSE 'None' END AS pattern_{k}, len(h{k}) AS num_hits_{k}" for k in (1, 3, 5)) + " FROM per", **VIEWS))
def a32(spark, d):
    return per_view(spark, d)


@query("a33_winner_distribution", sql("SELECT CASE WHEN len(win) = 1 THEN win[1] ELSE 'Tie' END AS unique_winner, count(*) AS count, round(count(*) / (SELECT count(*) FROM per)::DOUBLE, 9) AS ratio FROM per GROUP BY 1", **VIEWS))
def a33(spark, d):
    return rounded(R.distribution(per_view(spark, d), "unique_winner"), "ratio")


@query("a33_best_tie_sets", sql("SELECT array_to_string(win, '|') AS oracle_winners, count(*) AS count, round(count(*) / (SELECT count(*) FROM per)::DOUBLE, 9) AS ratio FROM per GROUP BY 1", **VIEWS))
def a33_sets(spark, d):
    return rounded(R.distribution(per_view(spark, d), "oracle_winners"), "ratio")


@query("a33_success_patterns", sql(" UNION ALL ".join(f"SELECT {k} AS k, CASE WHEN len(h{k}) > 0 THEN array_to_string(h{k}, '|') ELSE 'None' END AS success_pattern, len(h{k}) AS num_successful_views, count(*) AS count, round(count(*) / (SELECT count(*) FROM per)::DOUBLE, 9) AS ratio FROM per GROUP BY ALL" for k in (1, 3, 5)), **VIEWS))
def a33_patterns(spark, d):
    return rounded(R.success_patterns(per_view(spark, d)), "ratio")


@query("a34_hit1_margins", sql("SELECT view, count(*) AS hit_at_1_count, count(*) FILTER (WHERE nh = 1) AS focal_only_count, round(avg((nh = 1)::INT), 9) AS focal_only_ratio, count(*) FILTER (WHERE nh = 2) AS shared_with_one, count(*) FILTER (WHERE nh = 3) AS shared_with_two, round(avg(best), 9) AS best_other_mean, median(best)::DOUBLE AS best_other_median, round(avg(best - 1), 9) AS margin_mean, count(*) FILTER (WHERE best >= 3) AS best_other_ge_3, count(*) FILTER (WHERE best >= 5) AS best_other_ge_5, round(avg(worst), 9) AS worst_other_mean, median(worst)::DOUBLE AS worst_other_median FROM lg WHERE own = 1 GROUP BY 1", **VIEWS))
def a34(spark, d):
    return rounded(R.hit1_margins(per_view(spark, d), METHODS), "focal_only_ratio", "best_other_mean", "margin_mean", "worst_other_mean")


@query("a34_unique_hit_ranks", sql("SELECT view AS unique_view, o AS other_view, count(*) AS count, round(avg(r), 9) AS avg_rank, median(r)::DOUBLE AS median_rank FROM (SELECT view, unnest(['popularity', 'cooccurrence', 'category']) AS o, unnest([p.popularity, p.cooccurrence, p.category]) AS r FROM lg JOIN per p USING (bundle_id) WHERE own = 1 AND nh = 1) WHERE o <> view GROUP BY ALL", **VIEWS))
def a34_ranks(spark, d):
    return rounded(R.unique_hit_ranks(per_view(spark, d), METHODS), "avg_rank")


@query("a35_rank_pairwise", sql(" UNION ALL ".join(f"SELECT '{a}' AS view_a, '{b}' AS view_b, count(*) FILTER (WHERE {a} < {b}) AS a_better, count(*) FILTER (WHERE {b} < {a}) AS b_better, count(*) FILTER (WHERE {a} = {b}) AS ties, round(avg({a} - {b}), 9) AS mean_delta, round(avg(abs({a} - {b})), 9) AS mean_abs_delta FROM per" for a, b in (("popularity", "cooccurrence"), ("popularity", "category"), ("cooccurrence", "category"))), **VIEWS))
def a35(spark, d):
    return rounded(R.rank_pairwise(per_view(spark, d), METHODS), "mean_delta", "mean_abs_delta")


@query("a35_regret", sql("SELECT round(avg(regret), 9) AS mean_regret, median(regret)::DOUBLE AS median_regret, count(*) FILTER (WHERE regret > 0) AS gt_0_count, round(avg((regret > 0)::INT), 9) AS gt_0_ratio, count(*) FILTER (WHERE regret >= 3) AS ge_3_count, round(avg((regret >= 3)::INT), 9) AS ge_3_ratio, max(regret) AS max_regret FROM per", **VIEWS))
def a35_regret(spark, d):
    return rounded(R.regret_summary(per_view(spark, d)), "mean_regret", "gt_0_ratio", "ge_3_ratio")


@query("w17_largest_gaps", sql("SELECT view, bundle_id, margin, worst_other, place FROM (SELECT view, bundle_id, best - 1 AS margin, worst AS worst_other, row_number() OVER (PARTITION BY view ORDER BY best DESC, worst DESC, bundle_id) AS place FROM lg WHERE own = 1) WHERE place <= 5", **VIEWS))
def w17(spark, d):
    return R.largest_gaps(per_view(spark, d), METHODS, 5)


@query("w19_best_fixed_view", sql("SELECT method, round(avg(1.0 / true_rank), 9) AS mrr FROM runs GROUP BY 1 ORDER BY avg(1.0 / true_rank) DESC, avg(hit) DESC, method LIMIT 1"))
def w19(spark, d):
    return rounded(R.best_fixed(Model(spark, d).runs).select("method", "mrr"), "mrr")


@query("w16_popularity_fallback", sql("SELECT method, bundle_id, pos, item_id, is_gt FROM (SELECT s.*, row_number() OVER (PARTITION BY method, bundle_id ORDER BY score DESC, coalesce(f, 0) DESC, pos) AS r FROM scores s LEFT JOIN (SELECT item_id, count(*) AS f FROM train GROUP BY 1) USING (item_id)) WHERE r = 1"))
def w16(spark, d):
    m = Model(spark, d)
    return R.first_choices(m.by_method, "freq").withColumn("pos", F.col("pos").cast("long"))


@query("a45_group_counts", sql("SELECT CASE WHEN a.hit = 1 AND b.hit = 1 THEN 'Both_Hit' WHEN a.hit = 0 AND b.hit = 0 THEN 'Both_Miss' WHEN a.hit = 1 AND b.hit = 0 THEN 'A_Hit_Only' ELSE 'B_Hit_Only' END AS \"group\", count(*) AS count, round(count(*) / (SELECT count(*) FROM ev)::DOUBLE, 9) AS ratio FROM runs a JOIN runs b USING (bundle_id) WHERE a.method = 'popularity' AND b.method = 'cooccurrence' GROUP BY 1"))
def a45(spark, d):
    runs = Model(spark, d).runs
    return rounded(R.compared(runs.where("method = 'popularity'"), runs.where("method = 'cooccurrence'")), "ratio")


DIFF = {"dif": "SELECT r.bundle_id, r.hit, (SELECT count(*) FROM inputs i WHERE i.bundle_id = r.bundle_id) AS difficulty FROM runs r WHERE method = 'cooccurrence'"}


@query("a44_difficulty", sql("SELECT difficulty, count(*) AS total, sum(hit)::BIGINT AS hits, (count(*) - sum(hit))::BIGINT AS misses, round(100.0 * sum(hit) / count(*), 1) AS accuracy, round(100.0 * (count(*) - sum(hit)) / (SELECT count(*) - sum(hit) FROM dif), 1) AS error_share FROM dif GROUP BY 1", **DIFF))
def a44(spark, d):
    m = Model(spark, d)
    size = m.inputs.groupBy("bundle_id").agg(F.count("*").alias("difficulty"))
    return R.difficulty(m.runs.where("method = 'cooccurrence'").join(size, "bundle_id"))


@query("a37_input_count_accuracy", sql("SELECT method, CASE WHEN grouping(k) = 1 THEN 'overall' ELSE k::VARCHAR END AS inputs, count(*) AS n, round(avg(hit), 9) AS accuracy FROM (SELECT r.*, (SELECT count(*) FROM inputs i WHERE i.bundle_id = r.bundle_id) AS k FROM runs r) GROUP BY GROUPING SETS ((method, k), (method))"))
def a37(spark, d):
    m = Model(spark, d)
    size = m.inputs.groupBy("bundle_id").agg(F.count("*").alias("inputs"))
    return rounded(R.input_count_accuracy(m.runs.join(size, "bundle_id")), "accuracy")


@query("a48_hard_negative_hits", sql("SELECT r.method, r.hit, count(*) AS n, round(avg(h.k), 9) AS mean_same_category FROM runs r JOIN (SELECT s.bundle_id, count(*) FILTER (WHERE j.category = g.category) AS k FROM samples s JOIN it j USING (item_id) JOIN heldout g ON g.bundle_id = s.bundle_id WHERE NOT s.is_gt GROUP BY 1) h USING (bundle_id) GROUP BY ALL"))
def a48(spark, d):
    m = Model(spark, d)
    goal = m.heldout.select("bundle_id", F.col("category").alias("goal"))
    hard = m.samples.where("not is_gt").join(m.items, "item_id").join(goal, "bundle_id").groupBy("bundle_id").agg(F.count_if(F.col("category") == F.col("goal")).alias("k"))
    return rounded(m.runs.join(hard, "bundle_id").groupBy("method", "hit").agg(F.count("*").alias("n"), F.avg("k").alias("mean_same_category")), "mean_same_category")


@query("a46_baseline_accuracy", sql("SELECT signal AS method, count(*) AS n, round(avg((min_rank = 1)::INT), 9) AS in_top_rate, round(avg((min_rank = 1 AND eq > 1)::INT), 9) AS tie_rate, round(avg(CASE WHEN min_rank = 1 THEN 1.0 / eq ELSE 0 END), 9) AS expected_accuracy FROM ties WHERE is_gt GROUP BY 1", **TIES))
def a46(spark, d):
    ties = R.tie_stats(Model(spark, d).scores, "method", "bundle_id").where("is_gt")
    first = F.col("min_rank") == 1
    size = F.col("max_rank") - F.col("min_rank") + 1
    return rounded(ties.groupBy("method").agg(F.count("*").alias("n"), F.avg(first.cast("int")).alias("in_top_rate"), F.avg((first & (size > 1)).cast("int")).alias("tie_rate"), F.avg(F.when(first, 1.0 / size).otherwise(0.0)).alias("expected_accuracy")), "in_top_rate", "tie_rate", "expected_accuracy")
