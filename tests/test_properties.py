"""Identities that hold for any data."""

from conftest import SF
from pyspark.sql import functions as F

from setloom.operators import bundles, graph, sampling
from setloom.plans.base import Model


def test_category_graph_is_symmetric_and_its_diagonal_counts_bundles(spark):
    m = Model(spark, SF)
    cc = m.cc.cache()
    assert cc.exceptAll(cc.select(F.col("b").alias("a"), F.col("a").alias("b"), "count_w", "binary_w")).count() == 0
    freq = m.train_bc.groupBy("category").agg(F.count("*").alias("n"))
    assert cc.where("a = b").select(F.col("a").alias("category"), F.col("binary_w").alias("n")).exceptAll(freq).count() == 0


def test_draws_do_not_depend_on_partitioning(spark):
    m = Model(spark, SF)
    a = sampling.fixed_split(m.test, 45)
    b = sampling.fixed_split(m.test.repartition(7, "item_id"), 45)
    assert a.exceptAll(b).count() == 0


def test_samples_hold_one_answer_and_no_bundle_item(spark):
    m = Model(spark, SF)
    per = m.samples.groupBy("bundle_id").agg(F.count_if("is_gt").alias("gt"), F.count("*").alias("n"), F.count_distinct("item_id").alias("d"))
    assert per.where("gt <> 1 or n <> d or n > 10").count() == 0
    assert m.samples.where("not is_gt").join(m.eval_split, ["bundle_id", "item_id"]).count() == 0


def test_quadrants_sum_up(spark):
    m = Model(spark, SF)
    from setloom.operators import runs

    rows = runs.pairwise(m.runs, ["popularity", "cooccurrence", "category"]).collect()
    assert len(rows) == 3
    assert all(r["both_hit"] + r["both_fail"] + r["left_only"] + r["right_only"] == r["n"] for r in rows)


def test_components_of_a_path_and_a_lone_node(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    edges = spark.createDataFrame([("c", "b"), ("d", "c")], "a string, b string")
    assert {r["node"]: r["label"] for r in graph.components(nodes, edges).collect()} == {"a": "a", "b": "b", "c": "b", "d": "b", "e": "e"}


def test_missing_and_blank_categories(spark):
    bi = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3)], "bundle_id long, item_id long")
    items = spark.createDataFrame([(1, " a "), (2, "a"), (3, "  ")], "item_id long, category string")
    rows = {r["bundle_id"]: r for r in bundles.bundle_detail(bi, items).collect()}
    assert (rows[1]["items"], rows[1]["missing"], rows[1]["largest"], rows[1]["category_set"], rows[1]["repeated"]) == (3, 1, 2, "a", 1)
    assert (rows[2]["categories"], rows[2]["missing"], rows[2]["largest"], rows[2]["category_set"]) == (0, 1, 0, "")
