"""Further queries: comparisons, categories in vector space, examples, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.operators import compare as K
from setloom.operators import graph as G
from setloom.operators import retrieval as T
from setloom.operators import runs as R
from setloom.operators import sampling as S
from setloom.operators import vectors as V
from setloom.operators.cases import set_cosines
from setloom.plans.base import Model, sql
from setloom.plans.bundle_queries import rounded
from setloom.plans.completion_queries import COUNTS, WIDE, direct
from setloom.plans.run_queries import METHODS, TIES, VIEWS, detail, per_view
from setloom.plans.vector_queries import TEXT, UNIT
from setloom.registry import query

long = lambda df, c: df.withColumn(c, F.col(c).cast("long"))


@query("a36_choice_vs_ranking", sql("SELECT CASE WHEN c.hit = 1 AND r.hit = 1 THEN 'both' WHEN c.hit = 1 THEN 'choice_only' WHEN r.hit = 1 THEN 'ranking_only' ELSE 'neither' END AS outcome, count(*) AS count, round(avg(r.true_rank), 9) AS mean_rank, round(count(*) / (SELECT count(*) FROM ev)::DOUBLE, 9) AS ratio FROM runs c JOIN runs r USING (bundle_id) WHERE c.method = 'popularity' AND r.method = 'cooccurrence' GROUP BY 1"))
def a36(spark, d):
    runs = Model(spark, d).runs
    return rounded(K.choice_against_ranking(runs.where("method = 'popularity'"), runs.where("method = 'cooccurrence'")), "mean_rank", "ratio")


@query("w04_category_ranks", sql("SELECT bundle_id, category, score, first, has_gt, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, first, category) AS place FROM (SELECT bundle_id, category, max(score) AS score, min(pos) AS first, max(is_gt::INT) AS has_gt FROM scores JOIN it USING (item_id) WHERE method = 'cooccurrence' GROUP BY ALL)"))
def w04(spark, d):
    m = Model(spark, d)
    return K.category_ranks(long(m.scores.where("method = 'cooccurrence'"), "pos"), m.items)


@query("v12_neighbour_overlap", sql("SELECT t.a AS node, round(coalesce(c, 0) / 5.0, 9) AS overlap FROM (SELECT DISTINCT a FROM tn) t LEFT JOIN (SELECT tn.a, count(*) AS c FROM tn JOIN vn ON vn.a = tn.a AND vn.b = tn.b GROUP BY 1) x ON x.a = t.a", **UNIT, tn="SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count_w DESC, b) AS r FROM cc WHERE a <> b) WHERE r <= 5", vn="SELECT a, b FROM (SELECT x.category AS a, y.category AS b, row_number() OVER (PARTITION BY x.category ORDER BY round(list_dot_product(x.u, y.u), 9) DESC, y.category) AS r FROM cu x JOIN cu y ON x.category <> y.category) WHERE r <= 5"))
def v12(spark, d):
    m = Model(spark, d)
    graph = G.neighbours(m.cc.where("a <> b").select("a", "b", "count_w"), "count_w", 5).select(F.col("a").alias("node"), F.col("b").alias("neighbour"))
    centers = V.prototypes(m.vectors, m.items, "category").select("category", "unit")
    pairs = centers.select(F.col("category").alias("a"), F.col("unit").alias("ua")).join(F.broadcast(centers.select(F.col("category").alias("b"), F.col("unit").alias("ub")))).where("a <> b")
    space = G.neighbours(pairs.select("a", "b", F.round(X.dot("ua", "ub"), 9).alias("w")), "w", 5).select(F.col("a").alias("node"), F.col("b").alias("neighbour"))
    return rounded(K.neighbour_overlap(graph, space, 5), "overlap")


@query("a47_attribute_bias", sql("SELECT count(*) AS n, round(avg(gt), 9) AS gt_overlap_rate, round(avg(wrong), 9) AS wrong_overlaps, count(*) FILTER (WHERE gt = 1 AND wrong = 0) AS only_gt FROM (SELECT bundle_id, max(y) FILTER (WHERE is_gt) AS gt, coalesce(sum(y) FILTER (WHERE NOT is_gt), 0) AS wrong FROM (SELECT s.bundle_id, s.is_gt, EXISTS (SELECT 1 FROM inputs i JOIN it j USING (item_id) WHERE i.bundle_id = s.bundle_id AND lower(j.kind) = lower(it.kind))::INT AS y FROM samples s JOIN it USING (item_id)) GROUP BY 1)"))
def a47(spark, d):
    m = Model(spark, d)
    return rounded(K.attribute_bias(m.samples, m.inputs, m.items, "kind"), "gt_overlap_rate", "wrong_overlaps")


@query("a52_mapping_stats", sql("SELECT count(*) AS items, count(k) AS mapped, round(count(k) / count(*)::DOUBLE, 9) AS coverage, coalesce(sum(k), 0)::BIGINT AS links, max(k) AS largest FROM it LEFT JOIN (SELECT item_id, count(*) AS k FROM train GROUP BY 1) USING (item_id)"))
def a52(spark, d):
    m = Model(spark, d)
    return rounded(K.mapping_stats(m.train, m.items), "coverage")


@query("a50_unique_view_cases", sql("SELECT category, count(*) AS n FROM per JOIN heldout h USING (bundle_id) WHERE per.cooccurrence = 1 AND per.popularity > 1 AND per.category > 1 GROUP BY h.category", **VIEWS).replace("SELECT category, count(*) AS n FROM per JOIN", "SELECT h.category AS gt_category, count(*) AS n FROM per JOIN"))
def a50(spark, d):
    m = Model(spark, d)
    return K.unique_cases(per_view(spark, d), "cooccurrence", ["popularity", "category"], m.heldout.select("bundle_id", F.col("category").alias("gt_category")), "gt_category")


@query("a51_by_input_count", sql("SELECT CASE WHEN grouping(k) = 1 THEN 'all' ELSE k::VARCHAR END AS inputs, count(*) AS n, round(avg(mrr), 9) AS mrr FROM (SELECT 1.0 / r.true_rank AS mrr, (SELECT count(*) FROM inputs i WHERE i.bundle_id = r.bundle_id) AS k FROM runs r WHERE method = 'cooccurrence') GROUP BY CUBE (k)"))
def a51(spark, d):
    m = Model(spark, d)
    size = m.inputs.groupBy("bundle_id").agg(F.count("*").alias("inputs"))
    return rounded(K.by_input_count(m.runs.where("method = 'cooccurrence'").join(size, "bundle_id").select("inputs", X.reciprocal("true_rank").alias("mrr")), "mrr"), "mrr")


@query("a39_space_summary", sql("SELECT count(*) AS n, round(avg(g), 8) AS left_mean, round(stddev_samp(g), 8) AS left_std, round(avg(s), 8) AS right_mean, round(stddev_samp(s), 8) AS right_std, round(avg(g - s), 8) AS mean_difference FROM (SELECT g.bundle_id, max(g.pair_max) AS g, avg(s.pair_max) AS s FROM pair g JOIN pair s ON s.bundle_id = g.bundle_id AND NOT s.is_gt WHERE g.is_gt GROUP BY 1)", **UNIT))
def a39(spark, d):
    m = Model(spark, d)
    rows = V.against_distractors(V.pair_cosines(m.samples, m.inputs, m.vectors), "pair_max")
    return K.space_summary(rows, "gt_score", "distractor_mean").select("n", *[F.round(c, 8).alias(c) for c in ("left_mean", "left_std", "right_mean", "right_std", "mean_difference")])


CATSIM = {
    "b0": "SELECT bundle_id, k, avg(x) AS x FROM (SELECT bundle_id, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM (SELECT DISTINCT i.bundle_id, category FROM inputs i JOIN it USING (item_id)) JOIN cu USING (category)) GROUP BY ALL",
    "b1": "SELECT bundle_id, list(x ORDER BY k) AS m FROM b0 GROUP BY 1",
    "bm": "SELECT bundle_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS m FROM b1",
    "cc0": "SELECT s.bundle_id, s.pos, s.is_gt, round(list_dot_product(bm.m, cu.u), 8) AS score FROM samples s JOIN it USING (item_id) JOIN cu ON cu.category = it.category JOIN bm ON bm.bundle_id = s.bundle_id",
}


def category_cosines(m: Model):
    centers = V.prototypes(m.vectors, m.items, "category").select("category", "unit")
    sets = m.inputs.join(m.items, "item_id").select("bundle_id", "category").distinct()
    numbered, cosines = set_cosines(sets, centers, 8)
    return long(m.samples, "pos").join(m.items.select("item_id", "category"), "item_id").join(numbered, "bundle_id").join(cosines, ["set", "category"]).select("bundle_id", "pos", "is_gt", "score")


@query("v04_candidate_category_cosine", sql("SELECT bundle_id, pos, is_gt, score FROM cc0", **UNIT, **CATSIM))
def v04(spark, d):
    return category_cosines(Model(spark, d))


@query("a40_candidate_category_summary", sql("SELECT 'category' AS feature, count(*) AS n, round(avg((place <= 1)::INT), 9) AS top1, round(avg((place <= 3)::INT), 9) AS top3, round(avg(1.0 / place), 9) AS mrr, round(avg(place), 9) AS mean_place FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, pos) AS place FROM cc0) WHERE is_gt", **UNIT, **CATSIM))
def a40(spark, d):
    rows = V.placed(category_cosines(Model(spark, d)), "score").withColumn("feature", F.lit("category"))
    return rounded(V.signal_summary(rows, ["feature"]), "top1", "top3", "mrr", "mean_place")


@query("v07_item_content_cosine", sql("SELECT bundle_id, pos, round(list_dot_product(u.v, im.m), 8) AS score FROM samples s JOIN un u USING (item_id) JOIN im USING (bundle_id)", **UNIT))
def v07(spark, d):
    m = Model(spark, d)
    return V.pair_scores(long(m.samples, "pos"), m.inputs, m.vectors).select("bundle_id", "pos", F.round("bundle_mean", 8).alias("score"))


EX = {
    "exm": "SELECT bundle_id, item_id, row_number() OVER (PARTITION BY bundle_id ORDER BY md5('13_' || bundle_id || '_' || item_id), item_id) - 1 AS place FROM (SELECT *, count(*) OVER (PARTITION BY bundle_id) AS c FROM train) WHERE c >= 2",
    "e0": "SELECT bundle_id, k, avg(x) AS x FROM (SELECT bundle_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM exm JOIN un USING (item_id) WHERE place BETWEEN 1 AND 5) GROUP BY ALL",
    "e1": "SELECT bundle_id, list(x ORDER BY k) AS m FROM e0 GROUP BY 1",
    "e2": "SELECT e1.bundle_id AS example, a.item_id AS answer, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS w FROM e1 JOIN exm a ON a.bundle_id = e1.bundle_id AND a.place = 0",
    "es": "SELECT im.bundle_id, example, answer, round(list_dot_product(im.m, w), 8) AS score FROM im, e2",
    "er": "SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, example) AS rank FROM es",
}


@query("c14_similar_example", sql("SELECT bundle_id, example, answer, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY rank) AS r FROM er WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.bundle_id = er.bundle_id AND s.item_id = er.answer)) WHERE r = 1", **UNIT, **EX))
def c14(spark, d):
    """The evaluation bundles against all solved training examples."""
    m = Model(spark, d)
    rows = S.examples(m.train, 13, 5)
    mean = lambda r: V.bundle_vectors(m.vectors, r).select("bundle_id", F.col("embedding").alias("v"))
    answers = rows.where("is_gt").select("bundle_id", F.col("item_id").alias("answer"))
    examples = mean(rows.where("not is_gt")).join(answers, "bundle_id").select(F.col("bundle_id").alias("example"), "answer", F.col("v").alias("w"))
    return T.similar_examples(mean(m.inputs), examples, m.samples, 8)


@query("w15_co_items", sql("SELECT a, b, n, first, place FROM (SELECT a, b, n, first, row_number() OVER (PARTITION BY a ORDER BY n DESC, first, b) AS place FROM (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n, min(x.bundle_id) AS first FROM train x JOIN train y ON y.bundle_id = x.bundle_id AND y.item_id <> x.item_id WHERE x.item_id IN (SELECT item_id FROM inputs) GROUP BY ALL)) WHERE place <= 5"))
def w15(spark, d):
    m = Model(spark, d)
    return K.co_items(m.inputs, m.train, 5)


def completion_block(m, largest: int):
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc(F.round("score", 4)), "category"))
    best = direct(m, largest).withColumn("r", place).where("r <= 3").select("bundle_id", "r", F.concat_ws(" ", "category", X.fixed_point("score", 4)).alias("t"))
    text = best.groupBy("bundle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda s: s["t"]), "; ").alias("block"))
    return m.evaluated.join(text, "bundle_id", "left").select("bundle_id", F.coalesce("block", F.lit("no evidence")).alias("block"))


@query("c04_completion_block", sql("SELECT e.bundle_id, coalesce(string_agg(d.category || ' ' || printf('%.4f', d.score), '; ' ORDER BY d.r), 'no evidence') AS block FROM ev e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY round(score, 4) DESC, category) AS r FROM direct) d ON d.bundle_id = e.bundle_id AND d.r <= 3 GROUP BY 1", **WIDE))
def c04(spark, d):
    return completion_block(Model(spark, d), 5)


@query("c01_affiliate_text", sql("SELECT a AS item_id, string_agg(text, '; ' ORDER BY place) AS text FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, first, b) AS place FROM (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n, min(x.bundle_id) AS first FROM train x JOIN train y ON y.bundle_id = x.bundle_id AND y.item_id <> x.item_id WHERE x.item_id IN (SELECT item_id FROM inputs) GROUP BY ALL)) z JOIN tx ON tx.item_id = b WHERE place <= 3 GROUP BY 1", **TEXT))
def c01(spark, d):
    m = Model(spark, d)
    near = K.co_items(m.inputs, m.train, 3).join(T.item_text(m.items).select(F.col("item_id").alias("b"), "text"), "b")
    return near.groupBy(F.col("a").alias("item_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "; ").alias("text"))


@query("c08_same_category_examples", sql("SELECT s.bundle_id, s.item_id, r.item_id AS example FROM samples s JOIN it USING (item_id) JOIN (SELECT it.category, u.item_id, row_number() OVER (PARTITION BY it.category ORDER BY round(list_dot_product(u.v, cu.u), 9) DESC, u.item_id) AS place FROM un u JOIN it USING (item_id) JOIN cu ON cu.category = it.category) r ON r.category = it.category AND r.place <= 3 WHERE r.item_id <> s.item_id", **UNIT))
def c08(spark, d):
    m = Model(spark, d)
    reps = V.representatives(m.vectors, m.items, "category", 3).select("category", F.col("item_id").alias("example"))
    return m.samples.join(m.items.select("item_id", "category"), "item_id").join(reps, "category").where("example <> item_id").select("bundle_id", "item_id", "example")


@query("j14_signals_wide", sql("SELECT bundle_id, max(gt_min_rank) FILTER (WHERE signal = 'popularity') AS popularity, max(gt_min_rank) FILTER (WHERE signal = 'cooccurrence') AS cooccurrence, max(gt_min_rank) FILTER (WHERE signal = 'category') AS category FROM det WHERE method = 'popularity' GROUP BY 1", **TIES))
def j14(spark, d):
    return detail(Model(spark, d)).where("method = 'popularity'").groupBy("bundle_id").pivot("signal", METHODS).agg(F.first("gt_min_rank"))


@query("j13_outer_merge", sql("SELECT bundle_id, a.hit AS hit_a, b.hit AS hit_b FROM (SELECT * FROM runs WHERE method = 'popularity' AND true_rank <= 5) a FULL JOIN (SELECT * FROM runs WHERE method = 'category' AND true_rank >= 2) b USING (bundle_id)"))
def j13(spark, d):
    runs = Model(spark, d).runs
    side = lambda m, kept, c: runs.where(f"method = '{m}' and {kept}").select("bundle_id", F.col("hit").alias(c))
    return side("popularity", "true_rank <= 5", "hit_a").join(side("category", "true_rank >= 2", "hit_b"), "bundle_id", "full_outer")


@query("j16_bundle_sets", sql("SELECT (SELECT count(*) FROM (SELECT bundle_id FROM test INTERSECT SELECT bundle_id FROM fixed)) AS common, (SELECT count(*) FROM (SELECT bundle_id FROM test EXCEPT SELECT bundle_id FROM fixed)) AS only_test, (SELECT count(*) FROM (SELECT bundle_id FROM fixed EXCEPT SELECT bundle_id FROM test)) AS only_fixed"))
def j16(spark, d):
    m = Model(spark, d)
    a, b = m.test.select("bundle_id"), m.fixed.select("bundle_id")
    return a.intersect(b).agg(F.count("*").alias("common")).join(a.distinct().exceptAll(b.distinct()).agg(F.count("*").alias("only_test"))).join(b.distinct().exceptAll(a.distinct()).agg(F.count("*").alias("only_fixed")))


@query("j07_soft_shared", sql("SELECT s.bundle_id, s.pos, count(DISTINCT l.bundle_id) FILTER (WHERE u.b IS NOT NULL) AS soft_shared, count(DISTINCT l.bundle_id) AS soft_bundles FROM samples s LEFT JOIN sl l ON l.item_id = s.item_id LEFT JOIN un0 u ON u.bundle_id = s.bundle_id AND u.b = l.bundle_id GROUP BY ALL", **UNIT, un0="SELECT DISTINCT i.bundle_id, t.bundle_id AS b FROM inputs i JOIN train t USING (item_id)", sl="SELECT item_id, bundle_id FROM (SELECT n.item_id, t.bundle_id FROM near n JOIN train t ON t.item_id = n.neighbour) x WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.item_id = x.item_id AND t.bundle_id = x.bundle_id)"))
def j07(spark, d):
    m = Model(spark, d)
    soft = V.soft_links(V.nearest(m.vectors, "item_id", 8), m.train).select("item_id", F.col("bundle_id").alias("b"))
    union = m.inputs.join(m.train.select("item_id", F.col("bundle_id").alias("b")), "item_id").select("bundle_id", "b").distinct().withColumn("u", F.lit(1))
    held = long(m.samples, "pos").join(soft, "item_id", "left").join(union, ["bundle_id", "b"], "left")
    return held.groupBy("bundle_id", "pos").agg(F.count_distinct(F.when(F.col("u") == 1, F.col("b"))).alias("soft_shared"), F.count_distinct("b").alias("soft_bundles"))


@query("x02_set_counts", sql("SELECT s.bundle_id, len(list_intersect(a, b)) AS common, len(a) - len(list_intersect(a, b)) AS extra FROM (SELECT s.bundle_id, list(DISTINCT category) AS a FROM samples s JOIN it USING (item_id) GROUP BY 1) s JOIN (SELECT bundle_id, list(DISTINCT category) AS b FROM observed GROUP BY 1) o USING (bundle_id)"))
def x02(spark, d):
    m = Model(spark, d)
    a = m.samples.join(m.items, "item_id").groupBy("bundle_id").agg(F.collect_set("category").alias("a"))
    b = m.observed.groupBy("bundle_id").agg(F.collect_set("category").alias("b"))
    return a.join(b, "bundle_id").select("bundle_id", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.size(F.array_except("a", "b")).cast("long").alias("extra"))


@query("f02_display_text", sql("SELECT item_id, title || ' - ' || kind AS text, trim(category) AS category FROM it"))
def f02(spark, d):
    return T.item_text(Model(spark, d).items)


@query("f21_cosine_pairs", sql("SELECT a.item_id, round(list_dot_product(a.v, b.v), 8) AS cosine FROM un a JOIN un b ON b.item_id = a.item_id + 1", **UNIT))
def f21(spark, d):
    v = Model(spark, d).vectors.select("item_id", "embedding")
    return v.join(v.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("other")), "item_id").select("item_id", F.round(X.cosine("embedding", "other"), 8).alias("cosine"))


@query("f18_sample_keys", sql("SELECT bundle_id, 'base::' || bundle_id || '::' || true_item AS key FROM runs WHERE method = 'popularity'"))
def f18(spark, d):
    return Model(spark, d).runs.where("method = 'popularity'").select("bundle_id", X.sample_key(F.lit("base"), "bundle_id", "true_item").alias("key"))


@query("f25_source_entropy", "SELECT lang, round(sum(-p * log2(p)), 9) AS entropy FROM (SELECT lang, count(*) / sum(count(*)) OVER (PARTITION BY lang)::DOUBLE AS p FROM documents GROUP BY lang, source) GROUP BY 1")
def f25(spark, d):
    n = Model(spark, d).table("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.withColumn("t", F.sum("n").over(Window.partitionBy("lang"))).groupBy("lang").agg(F.round(F.sum(X.entropy_term("n", "t")), 9).alias("entropy"))


@query("f26_score_margins", sql("SELECT method, bundle_id, CASE WHEN len(l) > 1 THEN l[1] - l[2] ELSE 0.0 END AS margin FROM lev", **TIES))
def f26(spark, d):
    return Model(spark, d).scores.groupBy("method", "bundle_id").agg(X.margin(F.collect_list("score")).alias("margin"))


@query("a28_view_and_oracle_metrics", sql("SELECT v AS method, round(avg((r <= 1)::INT), 9) AS hit_at_1, round(avg((r <= 3)::INT), 9) AS hit_at_3, round(avg(1.0 / r), 9) AS mrr, round(avg(r), 9) AS mean_rank FROM (SELECT unnest(['popularity', 'cooccurrence', 'category', 'oracle']) AS v, unnest([popularity, cooccurrence, category, orc]) AS r FROM per) GROUP BY 1", **VIEWS))
def a28(spark, d):
    per = per_view(spark, d)
    long_rows = per.select(F.explode(F.array(*[F.struct(F.lit(v).alias("method"), F.col(c).alias("true_rank")) for v, c in [*[(m, m) for m in METHODS], ("oracle", "oracle_rank")]])).alias("x")).select("x.*").withColumn("hit", X.hit("true_rank", 1)).withColumn("pred_pos", F.lit(0))
    return rounded(R.run_metrics(long_rows).select("method", "hit_at_1", "hit_at_3", "mrr", "mean_rank"), "hit_at_1", "hit_at_3", "mrr", "mean_rank")
