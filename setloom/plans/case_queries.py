"""Queries over options, cases, augmented texts, prompts and category vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.operators import cases as K
from setloom.operators import retrieval as T
from setloom.operators import vectors as V
from setloom.plans.base import Model, sql
from setloom.plans.bundle_queries import rounded
from setloom.plans.vector_queries import PRIOR, TEXT, UNIT, prior
from setloom.registry import query
from setloom.shared import stash


def cut(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("f08_answer_index", sql("SELECT bundle_id, max(pos) FILTER (WHERE is_gt)::INT AS place FROM samples GROUP BY 1"))
def f08(spark, d):
    """Answers given by index, by letter, or by the id of the option, in turn."""
    per = Model(spark, d).samples.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda s: s["item_id"]).alias("options"), F.max(F.when(F.col("is_gt"), F.col("item_id"))).alias("answer"), F.max(F.when(F.col("is_gt"), F.col("pos"))).alias("pos"))
    way = F.col("bundle_id") % 3
    told = per.select("bundle_id", "options", "answer", F.when(way == 0, F.col("pos").cast("string")).alias("index"), F.when(way == 1, X.option_letter("pos")).alias("letter"))
    return told.select("bundle_id", X.answer_index("index", "letter", "options", "answer").alias("place"))


@query("f16_split_options", sql("SELECT bundle_id, pos::INT AS pos, text FROM samples JOIN tx USING (item_id)", **TEXT))
def f16(spark, d):
    """Options that were written out with bracketed context, taken apart again."""
    m = Model(spark, d)
    line = F.concat(X.option_letter(F.col("s.pos")), F.lit(". "), F.col("s.text"), F.lit(" [shares 2 of 3 groups]"))
    written = m.samples.join(T.item_text(m.items), "item_id").select("bundle_id", F.struct("pos", "text").alias("s")).withColumn("line", F.struct(F.col("s.pos").alias("pos"), line.alias("line")))
    texts = written.groupBy("bundle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]), "\n").alias("text"))
    return texts.select("bundle_id", F.posexplode(X.split_options("text")).alias("pos", "text"))


@query("j12_runs_by_row", sql("SELECT row, a.bundle_id, a.pred_pos AS first, b.pred_pos AS second, (a.hit = b.hit) AS agree FROM (SELECT *, row_number() OVER (ORDER BY bundle_id) - 1 AS row FROM runs WHERE method = 'popularity') a JOIN (SELECT *, row_number() OVER (ORDER BY bundle_id) - 1 AS row FROM runs WHERE method = 'cooccurrence') b USING (row)"))
def j12(spark, d):
    runs = Model(spark, d).runs
    one, two = (K.by_row(runs.where(F.col("method") == x).select("bundle_id", "pred_pos", "hit"), "bundle_id") for x in ("popularity", "cooccurrence"))
    two = two.select("row", F.col("pred_pos").alias("second"), F.col("hit").alias("hit_2"))
    return one.join(two, "row").select("row", "bundle_id", F.col("pred_pos").alias("first"), "second", (F.col("hit") == F.col("hit_2")).alias("agree"))


@query("x01_union_of_details", sql("SELECT 'runs' AS part, method, bundle_id, true_rank::BIGINT AS rank, NULL::BIGINT AS size FROM runs UNION ALL SELECT 'inputs', NULL, bundle_id, NULL, count(*) FROM inputs GROUP BY bundle_id"))
def x01(spark, d):
    m = Model(spark, d)
    sizes = m.inputs.groupBy("bundle_id").agg(F.count("*").alias("size"))
    return K.stacked({"runs": m.runs.select("method", "bundle_id", F.col("true_rank").cast("long").alias("rank")), "inputs": sizes}).select("part", "method", "bundle_id", "rank", "size")


TAGS = {"tag": "SELECT bundle_id, 'size ' || CASE WHEN count(*) = 1 THEN 'one' WHEN count(*) <= 3 THEN 'few' ELSE 'many' END AS tag FROM inputs GROUP BY 1"}


@query("a55_tag_accuracy", sql("SELECT tag, count(DISTINCT bundle_id) AS n, round(avg(hit::INT) FILTER (WHERE method = 'category'), 9) AS category, round(avg(hit::INT) FILTER (WHERE method = 'cooccurrence'), 9) AS cooccurrence, round(avg(hit::INT) FILTER (WHERE method = 'popularity'), 9) AS popularity FROM runs JOIN tag USING (bundle_id) GROUP BY 1", **TAGS))
def a55(spark, d):
    m = Model(spark, d)
    n = F.count("*")
    tags = m.inputs.groupBy("bundle_id").agg(F.concat(F.lit("size "), F.when(n == 1, "one").when(n <= 3, "few").otherwise("many")).alias("tag"))
    return rounded(K.tag_accuracy(m.runs, tags, ["category", "cooccurrence", "popularity"]), "category", "cooccurrence", "popularity")


@query("c21_unique_cases", sql("SELECT bundle_id, method, true_item, text FROM (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY bundle_id) AS hits FROM runs) JOIN tx ON tx.item_id = true_item WHERE hit AND hits = 1", **{k: v for k, v in TEXT.items()}))
def c21(spark, d):
    m = Model(spark, d)
    return K.unique_cases(m.runs).join(T.item_text(m.items).select(F.col("item_id").alias("true_item"), "text"), "true_item").select("bundle_id", "method", "true_item", "text")


@query("c09_named_items", sql("SELECT item_id, text || ' (' || category || ')' AS text FROM tx", **TEXT))
def c09(spark, d):
    return K.with_names(T.item_text(Model(spark, d).items)).select("item_id", "text")


@query("c11_described_items", sql("SELECT item_id, text || CASE WHEN item_id % 3 = 0 THEN ': ' || lower(kind) ELSE '' END AS text FROM tx JOIN it USING (item_id)", **TEXT))
def c11(spark, d):
    """Descriptions stored for every third item."""
    m = Model(spark, d)
    stored = m.items.where("item_id % 3 = 0").select("item_id", F.lower("kind").alias("description"))
    return K.with_descriptions(T.item_text(m.items), stored).select("item_id", "text")


CO = {
    "co": "SELECT x.item_id, y.item_id AS other, count(*) AS n FROM train x JOIN train y ON x.bundle_id = y.bundle_id AND x.item_id <> y.item_id GROUP BY ALL",
    "cop": "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, other) AS place FROM co",
}


@query("c18_neighbourhood_prompts", sql("SELECT c.item_id, 'Summarise what goes with this item.' || chr(10) || 'Item: ' || any_value(a.text) || chr(10) || string_agg(c.n || ' x ' || b.text, chr(10) ORDER BY place) AS prompt FROM cop c JOIN tx a ON a.item_id = c.item_id JOIN tx b ON b.item_id = c.other WHERE place <= 3 GROUP BY c.item_id", **CO, **TEXT))
def c18(spark, d):
    m = Model(spark, d)
    return K.neighbourhood_prompts(m.train, T.item_text(m.items), 3, "Summarise what goes with this item.")


@query("c19_category_prompts", sql("SELECT category, 'Name this category.' || chr(10) || string_agg(text, chr(10) ORDER BY r) AS prompt FROM (SELECT category, text, row_number() OVER (PARTITION BY category ORDER BY f DESC, item_id) AS r FROM tx JOIN (SELECT item_id, count(*) AS f FROM train GROUP BY 1) USING (item_id)) WHERE r <= 8 GROUP BY 1", **TEXT))
def c19(spark, d):
    m = Model(spark, d)
    return K.category_prompts(m.train, T.item_text(m.items), 8, "Name this category.")


@query("c05_evidence_text", sql("""SELECT bundle_id, string_agg('Example ' || place || ' (' || level || ' shared): ' || replace(key, '|', ', '), chr(10) ORDER BY place) AS block FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY level DESC, prior DESC, jaccard DESC, context) AS place FROM (SELECT cr.*, least(overlap, 3)::BIGINT AS level, key, row_number() OVER (PARTITION BY bundle_id, key ORDER BY least(overlap, 3) DESC, prior DESC, jaccard DESC, context) AS r FROM cr JOIN (SELECT bundle_id AS context, string_agg(category, '|' ORDER BY category) AS key FROM tbc GROUP BY 1) USING (context)) WHERE r = 1) WHERE place <= 3 GROUP BY 1""", **PRIOR))
def c05(spark, d):
    m = Model(spark, d)
    return K.evidence_text(T.evidence(m.observed_evaluated, m.train_bc, lambda sets: prior(m, sets), 3))


CATS = UNIT | {
    "bcv0": "SELECT bundle_id, k, avg(x) AS x, count(*) AS n FROM (SELECT bundle_id, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM tbc JOIN cu USING (category)) GROUP BY ALL",
    "bcv1": "SELECT bundle_id, max(n) AS n, list(x ORDER BY k) AS m FROM bcv0 GROUP BY 1",
    "bcv": "SELECT bundle_id, n, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v FROM bcv1",
    "oc0": "SELECT bundle_id, k, avg(x) AS x FROM (SELECT bundle_id, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM observed JOIN cu USING (category)) GROUP BY ALL",
    "oc1": "SELECT bundle_id, list(x ORDER BY k) AS m FROM oc0 GROUP BY 1",
    "oc": "SELECT bundle_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v FROM oc1",
}


def _category_units(m: Model):
    return V.prototypes(m.vectors, m.items, "category").select("category", "unit")


@query("a21_bundle_category_vectors", sql("SELECT bundle_id, n, round(v[1], 8) AS first FROM bcv", **CATS))
def a21(spark, d):
    m = Model(spark, d)
    return K.category_set_vectors(m.train_bc, _category_units(m)).select("bundle_id", "n", F.round(F.get("embedding", F.lit(0)), 8).alias("first"))


@query("v10_role_categories", sql("SELECT bundle_id, category, score, place FROM (SELECT oc.bundle_id, cu.category, round(list_dot_product(oc.v, cu.u), 8) AS score, row_number() OVER (PARTITION BY oc.bundle_id ORDER BY round(list_dot_product(oc.v, cu.u), 8) DESC, cu.category) AS place FROM oc, cu WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.bundle_id = oc.bundle_id AND o.category = cu.category)) WHERE place <= 3", **CATS))
def v10(spark, d):
    m = Model(spark, d)
    return K.role_categories(m.observed, _category_units(m), 3)


W20_SQL = """
SELECT bundle_id, -t.b AS context, t.s AS score, place FROM (
  SELECT bundle_id, unnest(best) AS t, generate_subscripts(best, 1) AS place FROM (
    SELECT oc.bundle_id, max({'s': round(array_inner_product(oc.v::DOUBLE[64], bcv.v::DOUBLE[64]), 8), 'b': -bcv.bundle_id}, 5) AS best FROM oc, bcv GROUP BY 1))
"""


@query("w20_role_bundles", sql(W20_SQL, **CATS))
def w20(spark, d):
    m = Model(spark, d)
    return K.role_bundles(m.observed, m.train_bc, stash(_category_units(m), "category-units"), 5)


@query("v02_prediction_similarity", sql("SELECT r.method, r.bundle_id, round(avg(list_dot_product(p.v, o.v)), 8) AS mean_other, round(max(list_dot_product(p.v, o.v)), 8) AS max_other FROM runs r JOIN samples s ON s.bundle_id = r.bundle_id AND s.pos = r.pred_pos JOIN un p ON p.item_id = s.item_id JOIN samples t ON t.bundle_id = r.bundle_id AND t.pos <> r.pred_pos JOIN un o ON o.item_id = t.item_id GROUP BY ALL", **UNIT))
def v02(spark, d):
    m = Model(spark, d)
    return cut(K.prediction_similarity(m.runs, m.samples, m.vectors), 8, "mean_other", "max_other")


ALIGN = UNIT | {
    "ctx0": "SELECT i.bundle_id, t.bundle_id AS context, count(*) AS overlap FROM inputs i JOIN train t USING (item_id) GROUP BY ALL",
    "ctx": "SELECT bundle_id, context FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY overlap DESC, context) AS r FROM ctx0) WHERE r <= 3",
    "cv0": "SELECT bundle_id, k, avg(x) AS x FROM (SELECT c.bundle_id, unnest(un.v) AS x, generate_subscripts(un.v, 1) AS k FROM ctx c JOIN train t ON t.bundle_id = c.context JOIN un ON un.item_id = t.item_id WHERE NOT EXISTS (SELECT 1 FROM inputs i WHERE i.bundle_id = c.bundle_id AND i.item_id = t.item_id)) GROUP BY ALL",
    "cv1": "SELECT bundle_id, list(x ORDER BY k) AS m FROM cv0 GROUP BY 1",
    "cv": "SELECT bundle_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v FROM cv1",
    "al": "SELECT s.bundle_id, s.pos, s.is_gt, list_dot_product(cv.v, un.v) AS score FROM samples s JOIN cv USING (bundle_id) JOIN un ON un.item_id = s.item_id",
    "alg": "SELECT bundle_id, max(score) FILTER (WHERE is_gt) AS answer, avg(score) FILTER (WHERE NOT is_gt) AS others, max(score) FILTER (WHERE NOT is_gt) AS best_other FROM al GROUP BY 1",
}


def _alignment(m: Model):
    met = m.inputs.join(m.train.select("item_id", F.col("bundle_id").alias("context")), "item_id").select("bundle_id", "context")
    # dealt by bundle once, for the counts and the places
    met = met.repartition("bundle_id").groupBy("bundle_id", "context").agg(F.count("*").alias("overlap"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("overlap"), "context"))).where("r <= 3")
    return K.context_alignment(best.select("bundle_id", "context"), m.train, m.inputs, m.samples, m.vectors)


@query("v11_context_alignment", sql("SELECT bundle_id, round(answer, 8) AS answer, round(others, 8) AS others, round(best_other, 8) AS best_other FROM alg", **ALIGN))
def v11(spark, d):
    return cut(_alignment(Model(spark, d)), 8, "answer", "others", "best_other")


@query("a41_alignment_summary", sql("SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 7) AS {c}_mean, round(median({c}), 7) AS {c}_median" for c in ("answer", "others", "best_other")) + " FROM alg", **ALIGN))
def a41(spark, d):
    return cut(K.mean_and_median(_alignment(Model(spark, d)), ["answer", "others", "best_other"]), 7, *[f"{c}_{x}" for c in ("answer", "others", "best_other") for x in ("mean", "median")])
