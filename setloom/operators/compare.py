"""Further comparisons: choices against rankings, category ranks, neighbour overlap, attribute bias, mappings, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.operators.graph import pairs_in_turn


def choice_against_ranking(choice: DataFrame, ranking: DataFrame) -> DataFrame:
    """One row an outcome (which of the two hit): count, share and mean rank of the answer in the ranking."""
    both = choice.select("bundle_id", F.col("hit").alias("c")).join(ranking.select("bundle_id", F.col("hit").alias("r"), "true_rank"), "bundle_id")
    outcome = F.when((F.col("c") == 1) & (F.col("r") == 1), "both").when(F.col("c") == 1, "choice_only").when(F.col("r") == 1, "ranking_only").otherwise("neither")
    per = both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("count"), F.avg("true_rank").alias("mean_rank"))
    return per.withColumn("ratio", F.col("count") / F.sum("count").over(Window.partitionBy()))


def category_ranks(scores: DataFrame, items: DataFrame, digits: int = 9) -> DataFrame:
    """Categories of each sample's options by their best score; ties by first position, then name."""
    per = scores.join(items.select("item_id", "category"), "item_id").groupBy("bundle_id", "category").agg(F.max(F.round("score", digits)).alias("score"), F.min("pos").alias("first"), F.max(F.col("is_gt").cast("int")).alias("has_gt"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("score"), "first", "category")).cast("long"))


def neighbour_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """For each node the share of its ``k`` neighbours that two neighbour tables (node, neighbour) have in common."""
    both = a.join(b, ["node", "neighbour"]).groupBy("node").agg(F.count("*").alias("common"))
    return a.select("node").distinct().join(both, "node", "left").select("node", (F.coalesce("common", F.lit(0)) / F.lit(k)).alias("overlap"))


def attribute_bias(samples: DataFrame, inputs: DataFrame, items: DataFrame, attribute: str) -> DataFrame:
    """How often the answer, or a wrong option, shares an attribute value with the inputs."""
    value = items.select("item_id", X.normalized(attribute).alias("v")).where("v <> ''")
    seen = inputs.join(value, "item_id").select("bundle_id", "v").distinct().withColumn("yes", F.lit(1))
    flagged = samples.join(value, "item_id", "left").join(seen, ["bundle_id", "v"], "left")
    per = flagged.groupBy("bundle_id").agg(F.max(F.when(F.col("is_gt"), F.coalesce("yes", F.lit(0)))).alias("gt"), F.sum(F.when(~F.col("is_gt"), F.coalesce("yes", F.lit(0))).otherwise(0)).alias("wrong"))
    return per.agg(F.count("*").alias("n"), F.avg("gt").alias("gt_overlap_rate"), F.avg("wrong").alias("wrong_overlaps"), F.count_if((F.col("gt") == 1) & (F.col("wrong") == 0)).alias("only_gt"))


def mapping_stats(links: DataFrame, items: DataFrame) -> DataFrame:
    """Coverage and sizes of an item -> bundles mapping."""
    per = links.groupBy("item_id").agg(F.count("*").alias("k"))
    return items.select("item_id").join(per, "item_id", "left").agg(F.count("*").alias("items"), F.count("k").alias("mapped"), (F.count("k") / F.count("*")).alias("coverage"), F.coalesce(F.sum("k"), F.lit(0)).alias("links"), F.max("k").alias("largest"))


def unique_cases(per: DataFrame, view: str, others: list[str], labels: DataFrame, key: str) -> DataFrame:
    """Labels (bundle_id, ``key``) of the samples that one view alone ranks first, by count."""
    alone = per.where(F.col(f"`{view}`") == 1)
    for o in others:
        alone = alone.where(F.col(f"`{o}`") > 1)
    return alone.join(labels, "bundle_id").groupBy(key).agg(F.count("*").alias("n"))


def by_input_count(rows: DataFrame, metric: str) -> DataFrame:
    """A metric by number of inputs and for all, over grouping sets."""
    return rows.cube("inputs").agg(F.grouping("inputs").alias("g"), F.count("*").alias("n"), F.avg(metric).alias(metric)).select(F.when(F.col("g") == 1, "all").otherwise(F.col("inputs").cast("string")).alias("inputs"), "n", metric)


def space_summary(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Means, sample deviations and mean difference of two columns."""
    return rows.agg(F.count("*").alias("n"), F.avg(left).alias("left_mean"), F.stddev_samp(left).alias("left_std"), F.avg(right).alias("right_mean"), F.stddev_samp(right).alias("right_std"), F.avg(F.col(left) - F.col(right)).alias("mean_difference"))


def co_items(inputs: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """The ``k`` items that share most bundles with each input item; ties by first shared bundle, then id."""
    def first(met: DataFrame) -> DataFrame:
        per = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("g").alias("first"))
        return per.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "first", "b")).cast("long")).where(F.col("place") <= k)

    return pairs_in_turn(train, "bundle_id", "item_id", first, inputs.select(F.col("item_id").alias("a")).distinct())
