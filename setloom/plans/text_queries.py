"""Context blocks as text, and scores of held-out categories in vector space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.operators import compare as K
from setloom.operators import completion as C
from setloom.operators import graph as G
from setloom.operators import retrieval as T
from setloom.operators import vectors as V
from setloom.plans.base import Model, sql
from setloom.plans.bundle_queries import rounded
from setloom.plans.completion_queries import JUDGE, METRICS, SUMMARY, USER, user_support
from setloom.plans.more_queries import CATSIM, category_cosines
from setloom.plans.vector_queries import TEXT, UNIT
from setloom.registry import query


def joined(rows: DataFrame, key: str, order: str, text: str, separator: str = "; ") -> DataFrame:
    """One text a key from rows in order."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), separator).alias("text"))


COBUY = {"cb": "SELECT x.item_id AS a, y.item_id AS b, count(*) AS n, min(x.user_id) AS first FROM ui x JOIN ui y ON y.user_id = x.user_id AND y.item_id <> x.item_id WHERE x.item_id IN (SELECT item_id FROM inputs) GROUP BY ALL"}


@query("c02_copurchase_text", sql("SELECT a AS item_id, string_agg(text, '; ' ORDER BY place) AS text FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, first, b) AS place FROM cb) z JOIN tx ON tx.item_id = b WHERE place <= 3 GROUP BY 1", **COBUY, **TEXT))
def c02(spark, d):
    m = Model(spark, d)
    near = K.co_items(m.inputs, m.ui.withColumnRenamed("user_id", "bundle_id"), 3).join(T.item_text(m.items).select(F.col("item_id").alias("b"), "text"), "b")
    return joined(near, "a", "place", "text").withColumnRenamed("a", "item_id")


@query("c07_user_prior_text", sql("SELECT bundle_id, string_agg(category || ' ' || printf('%.4f', score), '; ' ORDER BY place) AS text FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY round(score, 4) DESC, pair_support DESC, category) AS place FROM sup) WHERE place <= 3 GROUP BY 1", **USER))
def c07(spark, d):
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc(F.round("score", 4)), F.desc("pair_support"), "category"))
    best = user_support(Model(spark, d)).withColumn("place", place).where("place <= 3").withColumn("line", F.concat_ws(" ", "category", X.fixed_point("score", 4)))
    return joined(best, "bundle_id", "place", "line")


NEIGH = {"nb5": "SELECT a, string_agg(b, ', ' ORDER BY r) AS near FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY binary_w DESC, b) AS r FROM cc WHERE a <> b) WHERE r <= 3 GROUP BY 1"}


@query("c10_neighbour_augmentation", sql("SELECT i.bundle_id, i.item_id, 'often with ' || near AS text FROM inputs i JOIN it USING (item_id) JOIN nb5 ON nb5.a = it.category", **NEIGH))
def c10(spark, d):
    m = Model(spark, d)
    near = joined(G.neighbours(m.cc.where("a <> b").select("a", "b", "binary_w"), "binary_w", 3), "a", "place", "b", ", ").withColumnRenamed("text", "near")
    return m.inputs.join(m.items.select("item_id", F.col("category").alias("a")), "item_id").join(F.broadcast(near), "a").select("bundle_id", "item_id", F.concat(F.lit("often with "), "near").alias("text"))


@query("c12_item_text_by_role", sql("SELECT bundle_id, item_id, 'option' AS role, text || ' [' || category || ']' AS text FROM samples JOIN tx USING (item_id) UNION ALL SELECT i.bundle_id, i.item_id, 'input', text || ' [' || tx.category || '; often with ' || near || ']' FROM inputs i JOIN tx USING (item_id) JOIN nb5 ON nb5.a = tx.category", **TEXT, **NEIGH))
def c12(spark, d):
    m = Model(spark, d)
    near = joined(G.neighbours(m.cc.where("a <> b").select("a", "b", "binary_w"), "binary_w", 3), "a", "place", "b", ", ").withColumnRenamed("text", "near")
    text = T.item_text(m.items)
    options = m.samples.join(text, "item_id").select("bundle_id", "item_id", F.lit("option").alias("role"), F.concat("text", F.lit(" ["), "category", F.lit("]")).alias("text"))
    inputs = m.inputs.join(text, "item_id").join(F.broadcast(near), F.col("category") == F.col("a")).select("bundle_id", "item_id", F.lit("input").alias("role"), F.concat("text", F.lit(" ["), "category", F.lit("; often with "), "near", F.lit("]")).alias("text"))
    return options.unionByName(inputs)


HELD = CATSIM | {
    "o0": "SELECT bundle_id, k, avg(x) AS x FROM (SELECT bundle_id, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM observed JOIN cu USING (category)) GROUP BY ALL",
    "o1": "SELECT bundle_id, list(x ORDER BY k) AS m FROM o0 GROUP BY 1",
    "om": "SELECT bundle_id, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS m FROM o1",
    "vs0": "SELECT om.bundle_id, cu.category, round(list_dot_product(om.m, cu.u), 8) AS score FROM om, cu WHERE NOT EXISTS (SELECT 1 FROM observed o WHERE o.bundle_id = om.bundle_id AND o.category = cu.category)",
    "j_vs0": JUDGE.format(s="vs0"),
}


@query("v06_heldout_category_cosine", sql(f"SELECT 'text_centroid' AS method, {SUMMARY} FROM j_vs0", **UNIT, **HELD))
def v06(spark, d):
    m = Model(spark, d)
    centers = V.prototypes(m.vectors, m.items, "category").select("category", "unit")
    scores = V.centroid_scores(m.observed, centers, "bundle_id", "category", 8)
    return rounded(C.summary(C.judged(scores, m.heldout).withColumn("method", F.lit("text_centroid")), "method"), "coverage", "mean_rank", *METRICS)


@query("v05_input_category_rank", sql("SELECT bundle_id, rank() OVER (PARTITION BY bundle_id ORDER BY score DESC) AS rank, pos FROM cc0", **UNIT, **CATSIM))
def v05(spark, d):
    rows = category_cosines(Model(spark, d))
    return rows.select("bundle_id", F.rank().over(Window.partitionBy("bundle_id").orderBy(F.desc("score"))).cast("long").alias("rank"), "pos")


@query("c17_evidence_prompt", sql("SELECT bundle_id, 'Summarise what these categories have in common: ' || string_agg(category, ', ' ORDER BY category) AS prompt FROM observed JOIN ev USING (bundle_id) GROUP BY 1"))
def c17(spark, d):
    m = Model(spark, d)
    names = m.observed.join(m.evaluated, "bundle_id", "left_semi").groupBy("bundle_id").agg(F.array_join(F.array_sort(F.collect_list("category")), ", ").alias("names"))
    return names.select("bundle_id", F.concat(F.lit("Summarise what these categories have in common: "), "names").alias("prompt"))


@query("f17_urls", "SELECT page_id, CASE WHEN url LIKE '//%' THEN 'https:' || url ELSE url END AS url, '.jpg' AS extension FROM pages")
def f17(spark, d):
    return Model(spark, d).table("pages").select("page_id", X.https("url").alias("url"), X.extension("url").alias("extension"))
