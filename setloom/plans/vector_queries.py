"""Queries over vectors, retrieval contexts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from setloom.functions import exprs as X
from setloom.operators import completion as C
from setloom.operators import retrieval as T
from setloom.operators import vectors as V
from setloom.plans.base import Model, sql
from setloom.plans.bundle_queries import rounded
from setloom.registry import query
from setloom.shared import stash

UNIT = {
    "un": "SELECT item_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM vec",
    "cat0": "SELECT category, i, avg(x::DOUBLE) AS x, count(*) AS n FROM (SELECT category, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vec JOIN it USING (item_id)) GROUP BY ALL",
    "proto": "SELECT category, max(n) AS n, list(x ORDER BY i) AS m FROM cat0 GROUP BY 1",
    "cu": "SELECT category, n, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS u FROM proto",
    "ps": "SELECT s.bundle_id, s.pos, s.item_id, s.is_gt, a.v, b.v AS w FROM samples s JOIN un a ON a.item_id = s.item_id JOIN inputs i ON i.bundle_id = s.bundle_id JOIN un b ON b.item_id = i.item_id",
    "pair": "SELECT bundle_id, pos, item_id, is_gt, avg(list_dot_product(v, w)) AS pair_mean, max(list_dot_product(v, w)) AS pair_max FROM ps GROUP BY ALL",
    "im0": "SELECT bundle_id, k, avg(x) AS x FROM (SELECT bundle_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM inputs JOIN un USING (item_id)) GROUP BY ALL",
    "im1": "SELECT bundle_id, list(x ORDER BY k) AS m FROM im0 GROUP BY 1",
    "im": "SELECT bundle_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS m FROM im1",
    "pl": "SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY round(pair_mean, 9) DESC, pos) AS place, rank() OVER (PARTITION BY bundle_id ORDER BY round(pair_mean, 9) DESC) AS rank FROM pair",
    "near": "SELECT a AS item_id, arg_max(b, (s, -b)) AS neighbour, max(s) AS score FROM (SELECT x.item_id AS a, y.item_id AS b, round(list_dot_product(x.v, y.v), 8) AS s FROM un x JOIN un y ON x.item_id <> y.item_id) GROUP BY 1",
}


BUNDLE_UNIT = {
    "bn0": "SELECT bundle_id, k, avg(x) AS x FROM (SELECT bundle_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM train JOIN un USING (item_id)) GROUP BY ALL",
    "bn1": "SELECT bundle_id, list(x ORDER BY k) AS m FROM bn0 GROUP BY 1",
    "bn": "SELECT bundle_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v FROM bn1",
    "nearb": "SELECT a AS bundle_id, arg_max(b, (s, -b)) AS neighbour FROM (SELECT x.bundle_id AS a, y.bundle_id AS b, round(list_dot_product(x.v, y.v), 8) AS s FROM bn x JOIN bn y ON x.bundle_id <> y.bundle_id) GROUP BY 1",
}


@query("f20_unit_norms", sql("SELECT item_id, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 9) AS norm FROM un", **UNIT))
def f20(spark, d):
    return rounded(V.normalized(Model(spark, d).vectors).select("item_id", X.norm("embedding").alias("norm")), "norm")


@query("a19_category_prototypes", sql("SELECT category, n, round(list_sum(list_transform(m, lambda x: x)), 8) AS total, round(m[1], 8) AS first, round(sqrt(list_sum(list_transform(m, lambda y: y * y))), 8) AS norm FROM proto", **UNIT))
def a19(spark, d):
    m = Model(spark, d)
    p = V.prototypes(m.vectors, m.items, "category")
    return p.select("category", "n", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 8).alias("total"), F.round(F.get("embedding", F.lit(0)), 8).alias("first"), F.round(X.norm("embedding"), 8).alias("norm"))


@query("a20_bundle_vectors", sql("SELECT bundle_id, n, round(m[1] / sqrt(list_sum(list_transform(m, lambda y: y * y))), 8) AS first FROM (SELECT bundle_id, max(n) AS n, list(x ORDER BY k) AS m FROM (SELECT bundle_id, k, avg(x) AS x, count(*) AS n FROM (SELECT bundle_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM train JOIN un USING (item_id)) GROUP BY ALL) GROUP BY 1)", **UNIT))
def a20(spark, d):
    m = Model(spark, d)
    return V.bundle_vectors(m.vectors, m.train).select("bundle_id", "n", F.round(F.get("embedding", F.lit(0)), 8).alias("first"))


@query("w12_nearest_items", sql("SELECT item_id, neighbour, score FROM near", **UNIT))
def w12(spark, d):
    return V.nearest(Model(spark, d).vectors, "item_id", 8)


@query("v09_soft_links", sql("SELECT item_id, bundle_id FROM (SELECT n.item_id, t.bundle_id FROM near n JOIN train t ON t.item_id = n.neighbour) x WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.item_id = x.item_id AND t.bundle_id = x.bundle_id)", **UNIT))
def v09(spark, d):
    m = Model(spark, d)
    return V.soft_links(V.nearest(m.vectors, "item_id", 8), m.train)


@query("v09_bundle_links", sql("SELECT DISTINCT t.item_id, n.neighbour AS bundle_id FROM train t JOIN nearb n USING (bundle_id)", **UNIT, **BUNDLE_UNIT))
def v09_bundles(spark, d):
    m = Model(spark, d)
    return V.bundle_links(m.vectors, m.train, 8)


@query("v01_pair_scores", sql("SELECT p.bundle_id, p.pos, p.item_id, is_gt, round(pair_mean, 8) AS pair_mean, round(pair_max, 8) AS pair_max, round(list_dot_product(u.v, im.m), 8) AS bundle_mean FROM pair p JOIN un u ON u.item_id = p.item_id JOIN im ON im.bundle_id = p.bundle_id", **UNIT))
def v01(spark, d):
    m = Model(spark, d)
    return V.pair_scores(m.samples.withColumn("pos", F.col("pos").cast("long")), m.inputs, m.vectors).select("bundle_id", "pos", "item_id", "is_gt", *[F.round(c, 8).alias(c) for c in ("pair_mean", "pair_max", "bundle_mean")])


@query("v01_signal_summary", sql("SELECT 'pair_mean' AS feature, count(*) AS n, round(avg((place <= 1)::INT), 9) AS top1, round(avg((place <= 3)::INT), 9) AS top3, round(avg(1.0 / place), 9) AS mrr, round(avg(place), 9) AS mean_place FROM pl WHERE is_gt", **UNIT))
def v01_summary(spark, d):
    m = Model(spark, d)
    rows = V.placed(V.pair_cosines(m.samples, m.inputs, m.vectors), "pair_mean").withColumn("feature", F.lit("pair_mean"))
    return rounded(V.signal_summary(rows, ["feature"]), "top1", "top3", "mrr", "mean_place")


@query("a38_signal_by_split", sql("SELECT split, count(*) AS n, round(avg((place <= 1)::INT), 9) AS top1, round(avg((place <= 3)::INT), 9) AS top3, round(avg(1.0 / place), 9) AS mrr, round(avg(place), 9) AS mean_place FROM (SELECT pl.*, unnest(['all', CASE WHEN r.hit = 1 THEN 'hit' ELSE 'miss' END]) AS split FROM pl JOIN runs r ON r.bundle_id = pl.bundle_id AND r.method = 'cooccurrence' WHERE is_gt) GROUP BY 1", **UNIT))
def a38(spark, d):
    m = Model(spark, d)
    rows = V.placed(V.pair_cosines(m.samples, m.inputs, m.vectors), "pair_mean").join(m.runs.where("method = 'cooccurrence'").select("bundle_id", "hit"), "bundle_id")
    split = rows.withColumn("split", F.explode(F.array(F.lit("all"), F.when(F.col("hit") == 1, "hit").otherwise("miss"))))
    return rounded(V.signal_summary(split, ["split"]), "top1", "top3", "mrr", "mean_place")


@query("w03_competition_rank", sql("SELECT bundle_id, pos, place, rank FROM pl", **UNIT))
def w03(spark, d):
    m = Model(spark, d)
    return V.placed(V.pair_cosines(m.samples.withColumn("pos", F.col("pos").cast("long")), m.inputs, m.vectors), "pair_mean").select("bundle_id", "pos", "place", "rank")


@query("w21_distractor_wins", sql("SELECT g.bundle_id, round(avg((round(g.pair_max, 9) > round(s.pair_max, 9))::INT), 9) AS win_rate, round(avg((round(g.pair_max, 9) = round(s.pair_max, 9))::INT), 9) AS tie_rate, round(max(g.pair_max) - avg(s.pair_max), 8) AS margin FROM pair g JOIN pair s ON s.bundle_id = g.bundle_id AND NOT s.is_gt WHERE g.is_gt GROUP BY 1", **UNIT))
def w21(spark, d):
    m = Model(spark, d)
    return V.against_distractors(V.pair_cosines(m.samples, m.inputs, m.vectors), "pair_max").select("bundle_id", F.round("win_rate", 9).alias("win_rate"), F.round("tie_rate", 9).alias("tie_rate"), F.round("margin", 8).alias("margin"))


@query("w07_representatives", sql("SELECT category, item_id, score, place FROM (SELECT it.category, u.item_id, round(list_dot_product(u.v, cu.u), 9) AS score, row_number() OVER (PARTITION BY it.category ORDER BY round(list_dot_product(u.v, cu.u), 9) DESC, u.item_id) AS place FROM un u JOIN it USING (item_id) JOIN cu ON cu.category = it.category) WHERE place <= 3", **UNIT))
def w07(spark, d):
    m = Model(spark, d)
    return V.representatives(m.vectors, m.items, "category", 3)


@query(
    "v08_centroid_scores",
    sql(
        "SELECT m.bundle_id, cu.category, round(list_dot_product(m.m, cu.u), 8) AS score FROM bm m, cu WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.bundle_id = m.bundle_id AND o.category = cu.category)",
        **UNIT,
        b0="SELECT bundle_id, k, avg(x) AS x FROM (SELECT bundle_id, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM observed JOIN cu USING (category)) GROUP BY ALL",
        b1="SELECT bundle_id, list(x ORDER BY k) AS m FROM b0 GROUP BY 1",
        bm="SELECT bundle_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS m FROM b1",
    ),
)
def v08(spark, d):
    m = Model(spark, d)
    centers = V.prototypes(m.vectors, m.items, "category").select("category", "unit")
    return V.centroid_scores(m.observed, centers, "bundle_id", "category", 8)


@query("a53_feature_sanity", sql("SELECT count(*) AS n, 1.0::DOUBLE AS finite_ratio, count(*) FILTER (WHERE nm = 0) AS zero_norms, round(quantile_cont(nm, 0.5), 8) AS norm_median, round(min(nm), 8) AS norm_min, round(max(nm), 8) AS norm_max, (SELECT count(*) FROM vec x JOIN vec y ON y.item_id = x.item_id - 1 AND x.embedding = y.embedding) AS adjacent_duplicates FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS nm FROM vec)"))
def a53(spark, d):
    return V.feature_sanity(Model(spark, d).vectors).select("n", "finite_ratio", "zero_norms", *[F.round(c, 8).alias(c) for c in ("norm_median", "norm_min", "norm_max")], "adjacent_duplicates")


@query("v13_refreshed_vectors", sql("SELECT a.item_id, round(coalesce(b.embedding, a.embedding)[1]::DOUBLE, 8) AS first, b.item_id IS NOT NULL AS replaced FROM vec a LEFT JOIN (SELECT item_id - 1 AS item_id, embedding FROM vec WHERE label < 5) b USING (item_id)"))
def v13(spark, d):
    m = Model(spark, d)
    new = m.vectors.where("label < 5").select((F.col("item_id") - 1).alias("item_id"), "embedding")
    return V.refreshed(m.vectors, new).select("item_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 8).alias("first"), "replaced")


# --- retrieval ------------------------------------------------------------------------------------------------------
IDF = {"idf": "SELECT item_id, ln(((SELECT count(DISTINCT bundle_id) FROM train) + 1.0) / (count(*) + 1)) AS idf FROM train GROUP BY 1"}
CTX = IDF | {"cx": "SELECT bundle_id, context, overlap, w AS idf, row_number() OVER (PARTITION BY bundle_id ORDER BY overlap DESC, w DESC, md5('11_' || bundle_id || '_' || context), context) AS place FROM (SELECT i.bundle_id, t.bundle_id AS context, count(*) AS overlap, round(sum(idf.idf), 9) AS w FROM inputs i JOIN train t USING (item_id) JOIN idf USING (item_id) GROUP BY ALL)"}


@query("c03_bundle_context", sql("SELECT bundle_id, context, overlap, idf, place FROM cx WHERE place <= 5", **CTX))
def c03(spark, d):
    m = Model(spark, d)
    return T.bundle_context(m.inputs, m.train, 5, 11).select("bundle_id", "context", "overlap", "idf", "place")


@query("c03_soft_context", sql("SELECT bundle_id, context, score, overlap, soft_hits, place FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, overlap DESC, soft_hits DESC, w DESC, md5('11_' || bundle_id || '_' || context), context) AS place FROM (SELECT bundle_id, context, coalesce(overlap, 0)::BIGINT AS overlap, coalesce(soft_hits, 0)::BIGINT AS soft_hits, coalesce(overlap, 0) + 0.5::DOUBLE * coalesce(soft_hits, 0) AS score, round(coalesce(w, 0), 9) AS w FROM (SELECT i.bundle_id, t.bundle_id AS context, count(*) AS overlap, sum(idf.idf) AS w FROM inputs i JOIN train t USING (item_id) JOIN idf USING (item_id) GROUP BY ALL) FULL JOIN (SELECT i.bundle_id, s.bundle_id AS context, count(*) AS soft_hits FROM inputs i JOIN sl s USING (item_id) GROUP BY ALL) USING (bundle_id, context))) WHERE place <= 5", **IDF, **UNIT, sl="SELECT item_id, bundle_id FROM (SELECT n.item_id, t.bundle_id FROM near n JOIN train t ON t.item_id = n.neighbour) x WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.item_id = x.item_id AND t.bundle_id = x.bundle_id)"))
def c03_soft(spark, d):
    m = Model(spark, d)
    soft = V.soft_links(V.nearest(m.vectors, "item_id", 8), m.train)
    return T.bundle_context(m.inputs, m.train, 5, 11, soft, 0.5).select("bundle_id", "context", "score", "overlap", "soft_hits", "place")


SHARED = {"un0": "SELECT DISTINCT i.bundle_id, t.bundle_id AS b FROM inputs i JOIN train t USING (item_id)", "sh": "SELECT s.bundle_id, s.pos, s.item_id, s.is_gt, (SELECT count(*) FROM train t JOIN un0 u ON u.b = t.bundle_id AND u.bundle_id = s.bundle_id WHERE t.item_id = s.item_id) AS shared, (SELECT count(*) FROM train t WHERE t.item_id = s.item_id) AS bundles, (SELECT count(*) FROM un0 u WHERE u.bundle_id = s.bundle_id) AS input_bundles FROM samples s"}


@query("j06_shared_bundles", sql("SELECT bundle_id, pos, item_id, is_gt, shared, bundles, input_bundles FROM sh", **SHARED))
def j06(spark, d):
    m = Model(spark, d)
    return T.shared_bundles(m.samples.withColumn("pos", F.col("pos").cast("long")), m.inputs, m.train)


@query("c13_annotated_options", sql("SELECT bundle_id, pos, chr(65 + pos::INT) AS letter, 'shares ' || shared || ' of ' || bundles || CASE WHEN bundles = 1 THEN ' group' ELSE ' groups' END AS note FROM sh", **SHARED))
def c13(spark, d):
    m = Model(spark, d)
    return T.annotated_options(T.shared_bundles(m.samples.withColumn("pos", F.col("pos").cast("long")), m.inputs, m.train))


@query("a43_cooccurrence_column", sql("SELECT round(avg(shared), 9) AS shared_mean, round(avg(bundles), 9) AS bundles_mean, round(avg((bundles = 0)::INT), 9) AS zero_rate, round(avg(shared) FILTER (WHERE is_gt), 9) AS gt_shared_mean FROM sh", **SHARED))
def a43(spark, d):
    m = Model(spark, d)
    rows = T.shared_bundles(m.samples, m.inputs, m.train)
    return rounded(rows.agg(F.avg("shared").alias("shared_mean"), F.avg("bundles").alias("bundles_mean"), F.avg((F.col("bundles") == 0).cast("int")).alias("zero_rate"), F.avg(F.when(F.col("is_gt"), F.col("shared"))).alias("gt_shared_mean")), "shared_mean", "bundles_mean", "zero_rate", "gt_shared_mean")


USERS = {
    "exc": "SELECT bundle_id, item_id FROM samples UNION SELECT bundle_id, item_id FROM inputs",
    "uo": "SELECT i.bundle_id, u.user_id, count(*) AS overlap FROM inputs i JOIN ui u USING (item_id) GROUP BY ALL",
    "ua": "SELECT uo.*, count(*) OVER (PARTITION BY bundle_id, overlap) AS ties FROM uo WHERE EXISTS (SELECT 1 FROM ui u WHERE u.user_id = uo.user_id AND NOT EXISTS (SELECT 1 FROM exc e WHERE e.bundle_id = uo.bundle_id AND e.item_id = u.item_id))",
    "ch": "SELECT bundle_id, user_id, overlap, ties FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY overlap DESC, md5('5_' || bundle_id || '_' || user_id), user_id) AS r FROM ua) WHERE r = 1",
}


def excluded(m: Model):
    return m.samples.select("bundle_id", "item_id").unionByName(m.inputs).distinct()


@query("j08_nearest_user", sql("SELECT bundle_id, user_id, overlap, ties FROM ch", **USERS))
def j08(spark, d):
    m = Model(spark, d)
    return T.nearest_users(m.inputs, m.ui, excluded(m), 5)


@query("c15_user_history", sql("SELECT bundle_id, user_id, item_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, item_id) AS place FROM (SELECT ch.bundle_id, ch.user_id, u.item_id, round(list_dot_product(un.v, im.m), 8) AS score FROM ch JOIN ui u USING (user_id) JOIN un ON un.item_id = u.item_id JOIN im ON im.bundle_id = ch.bundle_id WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE e.bundle_id = ch.bundle_id AND e.item_id = u.item_id))) WHERE place <= 5", **USERS, **UNIT))
def c15(spark, d):
    m = Model(spark, d)
    return T.user_history(T.nearest_users(m.inputs, m.ui, excluded(m), 5), m.ui, excluded(m), m.inputs, m.vectors, 5, 8)


PRIOR = {
    "pri": "SELECT o.bundle_id, c.b AS category, sum(c.binary_w / s.binary_w::DOUBLE) / any_value(z.n) AS p FROM obe o JOIN cc s ON s.a = o.category AND s.b = s.a JOIN cc c ON c.a = o.category AND c.b <> c.a JOIN (SELECT bundle_id, count(*) AS n FROM obe GROUP BY 1) z ON z.bundle_id = o.bundle_id WHERE NOT EXISTS (SELECT 1 FROM obe q WHERE q.bundle_id = o.bundle_id AND q.category = c.b) GROUP BY o.bundle_id, c.b",
    "obe": "SELECT o.* FROM observed o JOIN ev USING (bundle_id)",
    "cm": "SELECT o.bundle_id, t.bundle_id AS context, count(*) AS overlap FROM obe o JOIN tbc t USING (category) GROUP BY ALL",
    "cs": "SELECT cm.*, nc, nq FROM cm JOIN (SELECT bundle_id AS context, count(*) AS nc FROM tbc GROUP BY 1) USING (context) JOIN (SELECT bundle_id, count(*) AS nq FROM obe GROUP BY 1) USING (bundle_id) WHERE nc > overlap",
    "cr": "SELECT cs.bundle_id, cs.context, overlap, round(coalesce(max(p), 0), 9) AS prior, round(overlap / (nq + nc - overlap)::DOUBLE, 9) AS jaccard, round(coalesce(max(p), 0) * overlap / nq, 9) AS score FROM cs JOIN tbc t ON t.bundle_id = cs.context LEFT JOIN pri ON pri.bundle_id = cs.bundle_id AND pri.category = t.category GROUP BY cs.bundle_id, cs.context, overlap, nq, nc",
}


def prior(m: Model, observed):
    cc = stash(m.cc.select("a", "b", F.col("binary_w").alias("n")), "category-graph")  # a row a pair of categories
    return C.mean_support(observed, cc.where("a <> b"), cc.where("a = b").select(F.col("a").alias("category"), "n"))


@query("c06_category_retrieval", sql("SELECT bundle_id, context, prior, overlap, jaccard, score, place FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, prior DESC, overlap DESC, jaccard DESC, md5('3_' || bundle_id || '_' || context), context) AS place FROM cr) WHERE place <= 5", **PRIOR))
def c06(spark, d):
    m = Model(spark, d)
    return T.category_retrieval(m.observed_evaluated, m.train_bc, lambda sets: prior(m, sets), 5, 3)


@query("w10_evidence", sql("SELECT bundle_id, context, key, level, prior, jaccard, place FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY level DESC, prior DESC, jaccard DESC, context) AS place FROM (SELECT cr.*, least(overlap, 3)::BIGINT AS level, key, row_number() OVER (PARTITION BY bundle_id, key ORDER BY least(overlap, 3) DESC, prior DESC, jaccard DESC, context) AS r FROM cr JOIN (SELECT bundle_id AS context, string_agg(category, '|' ORDER BY category) AS key FROM tbc GROUP BY 1) USING (context)) WHERE r = 1) WHERE place <= 5", **PRIOR))
def w10(spark, d):
    m = Model(spark, d)
    return T.evidence(m.observed_evaluated, m.train_bc, lambda sets: prior(m, sets), 5).select("bundle_id", "context", "key", F.col("level").cast("long").alias("level"), "prior", "jaccard", "place")


TEXT = {"tx": "SELECT item_id, category, title || ' - ' || kind AS text FROM it"}


@query("c16_prompts", sql("SELECT bundle_id, 'Complete the set.' || chr(10) || chr(10) || 'Given: ' || g || chr(10) || chr(10) || 'Options:' || chr(10) || o || chr(10) || chr(10) || 'Answer with one letter.' AS prompt FROM (SELECT bundle_id, string_agg(text, '; ' ORDER BY text) AS g FROM inputs JOIN tx USING (item_id) GROUP BY 1) JOIN (SELECT bundle_id, string_agg(chr(65 + pos::INT) || '. ' || text, chr(10) ORDER BY pos) AS o FROM samples JOIN tx USING (item_id) GROUP BY 1) USING (bundle_id)", **TEXT))
def c16(spark, d):
    m = Model(spark, d)
    return T.rendered(m.samples, m.inputs, m.items, "Complete the set.")


@query("c03_context_text", sql("SELECT bundle_id, string_agg('Group ' || place || ': ' || line, chr(10) ORDER BY place) AS context_text FROM (SELECT c.bundle_id, c.place, string_agg(text, '; ' ORDER BY t.item_id) AS line FROM cx c JOIN (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY item_id) AS r FROM train) t ON t.bundle_id = c.context AND t.r <= 5 JOIN tx ON tx.item_id = t.item_id WHERE c.place <= 3 GROUP BY ALL) GROUP BY 1", **CTX, **TEXT))
def c03_text(spark, d):
    m = Model(spark, d)
    return T.context_text(T.bundle_context(m.inputs, m.train, 3, 11), m.train, m.items)


# --- scalar functions on texts and responses ------------------------------------------------------------------------
@query("f01_inline_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def f01(spark, d):
    return Model(spark, d).table("documents").select("doc_id", X.inline("text").alias("text"))


@query("f12_single_choice", "SELECT p_partkey AS item_id, chr((65 + p_partkey % 10)::INT) AS choice FROM part")
def f12(spark, d):
    raw = F.concat(F.element_at(F.array(F.lit("Choice: "), F.lit("answer = "), F.lit("Option"), F.lit("")), (F.col("item_id") % 4 + 1).cast("int")), F.lit(" "), F.chr(65 + F.col("item_id") % 10))
    return Model(spark, d).items.select("item_id", X.single_choice(raw).alias("choice"))


F13_SQL = """
WITH l AS (SELECT p_partkey, p_partkey % 4 AS k, chr((65 + p_partkey % 5)::INT) AS a, chr((65 + (p_partkey + 2) % 5)::INT) AS b FROM part)
SELECT p_partkey AS item_id, list_concat(CASE WHEN k = 3 THEN [a, b] ELSE [a] END, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: x <> a AND NOT (k = 3 AND x = b))) AS ranking, false AS valid FROM l
"""


@query("f13_ranked_choices", F13_SQL)
def f13(spark, d):
    letter, other = F.chr(65 + F.col("item_id") % 5), F.chr(65 + (F.col("item_id") + 2) % 5)
    kind = F.col("item_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('```json\n{"ranking": ["'), letter, F.lit('"]}\n```'))).when(kind == 1, F.concat(F.lit('["'), letter, F.lit('", "'), letter, F.lit('"]'))).when(kind == 2, F.concat(F.lit("best is "), letter, F.lit("."))).otherwise(F.concat(letter, F.lit("1, "), other, F.lit("_2")))
    parsed = Model(spark, d).items.select("item_id", X.ranked_choices(raw, 5).alias("r"))
    return parsed.select("item_id", "r.ranking", "r.valid")


@query("f11_listed_cells", """SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN ['True ' || p_type, 'None of ' || p_brand, NULL] WHEN 1 THEN [p_brand, 'false'] ELSE [] END AS members FROM part""")
def f11(spark, d):
    kind, name = F.col("kind"), F.col("category")
    cell = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("['True "), kind, F.lit("', \"None of "), name, F.lit('", None]'))).when(F.col("item_id") % 3 == 1, F.concat(F.lit('["'), name, F.lit('", False]'))).otherwise(F.concat(F.lit("no list: "), name))
    return Model(spark, d).items.select("item_id", X.listed(cell).alias("members"))


@query("f10_boolish_cells", """SELECT p_partkey AS item_id, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN p_size WHEN 3 THEN 1 ELSE NULL END::INT AS hit FROM part""")
def f10(spark, d):
    cell = F.element_at(F.array(F.lit(" Yes"), F.lit("False"), F.col("p_size").cast("string"), F.lit("1.0"), F.lit("y")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return Model(spark, d).table("part").select(F.col("p_partkey").alias("item_id"), X.boolish(cell).alias("hit"))


@query("f14_rank_metrics", "SELECT p_partkey AS item_id, (p_partkey % 12 + 1 <= 3)::INT AS hit_at_3, round(1.0 / (p_partkey % 12 + 1), 9) AS mrr, round(CASE WHEN p_partkey % 12 + 1 <= 10 THEN 1.0 / log2(p_partkey % 12 + 2) ELSE 0 END, 9) AS ndcg_at_10 FROM part")
def f14(spark, d):
    rank = F.col("item_id") % 12 + 1
    return Model(spark, d).items.select("item_id", X.hit(rank, 3).alias("hit_at_3"), F.round(X.reciprocal(rank), 9).alias("mrr"), F.round(X.ndcg(rank, 10), 9).alias("ndcg_at_10"))


@query("f19_jaccard", sql("SELECT h.bundle_id, round(CASE WHEN len(list_distinct(list_concat(o, p))) = 0 THEN 1 ELSE len(list_intersect(o, p)) / len(list_distinct(list_concat(o, p)))::DOUBLE END, 9) AS jaccard FROM (SELECT bundle_id, list(DISTINCT category) AS o FROM observed GROUP BY 1) h JOIN (SELECT s.bundle_id, list(DISTINCT category) AS p FROM samples s JOIN it USING (item_id) GROUP BY 1) s USING (bundle_id)"))
def f19(spark, d):
    m = Model(spark, d)
    a = m.observed.groupBy("bundle_id").agg(F.collect_set("category").alias("o"))
    b = m.samples.join(m.items, "item_id").groupBy("bundle_id").agg(F.collect_set("category").alias("p"))
    return a.join(b, "bundle_id").select("bundle_id", F.round(X.jaccard("o", "p"), 9).alias("jaccard"))


@query("f33_text_hash", "SELECT doc_id, sha256(text) AS sha, strlen(text)::BIGINT AS n_bytes FROM documents")
def f33(spark, d):
    return Model(spark, d).table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
