"""How well texts about the items alone point at the answer, against what a method has chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.operators.vectors import dimension, mean_vectors


def word_vectors(texts: DataFrame, text: Column, size: int = 64) -> DataFrame:
    """Rows (item_id, embedding): counts of an item's words in ``size`` places, each word's place drawn by its md5."""
    place = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % size
    places = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), place)
    counts = lambda held: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(held, lambda p: p == i)).cast("double"))
    return texts.select("item_id", X.bound(places, counts).alias("embedding"))  # places are worked out once, not for each coordinate


def description_signal(samples: DataFrame, inputs: DataFrame, vectors: DataFrame, runs: DataFrame, digits: int = 9) -> DataFrame:
    """One row a sample: cosines of the mean input with the answer and the other options, the answer's place, the most similar option, that of the method.

    Inputs without a vector, or with a zero one, are left out; samples without any other input, or with an option that has no
    vector, have no row. ``runs``: one method's (bundle_id, pred_pos, hit).
    """
    unit = vectors.where(F.col("embedding").isNotNull()).select("item_id", X.unit("embedding").alias("v"), X.norm("embedding").alias("norm"))
    # word vectors are far larger than the file they come from, by whose size Spark would broadcast them
    given = inputs.join(unit.where("norm > 0").hint("merge"), "item_id")
    mean = mean_vectors(given, ["bundle_id"], "v", dimension(vectors)).where(X.norm("v") > 0).select("bundle_id", X.unit("v").alias("m"), F.col("n").alias("n_valid_inputs"))
    held = samples.select("bundle_id", "pos", "item_id", "is_gt").join(unit.select("item_id", "v").hint("merge"), "item_id", "left").join(mean.hint("merge"), "bundle_id")
    sample = Window.partitionBy("bundle_id")
    answered = held.withColumn("g", F.first(F.when(F.col("is_gt"), F.col("v")), True).over(sample)).withColumn("known", F.max("is_gt").over(sample)).where("known")
    scored = answered.select("bundle_id", "pos", "item_id", "is_gt", "n_valid_inputs", X.dot("v", "m").alias("sim"), X.dot("v", "g").alias("to_gt"), F.col("v").isNull().alias("gap"))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc(F.round("sim", digits)), "pos")).cast("long"))
    of = lambda f, c, flag: f(F.when(F.col("is_gt") == flag, F.col(c)))
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    predicted = placed.join(runs.select("bundle_id", "pred_pos", "hit"), "bundle_id", "left")
    each = predicted.groupBy("bundle_id").agg(
        of(F.max, "item_id", True).alias("true_item"), F.max("n_valid_inputs").alias("n_valid_inputs"), of(F.max, "sim", True).alias("gt_sim"), of(F.avg, "sim", False).alias("neg_mean"), of(F.max, "sim", False).alias("neg_max"), of(F.max, "place", True).alias("gt_rank"),
        first("pos").alias("top_pos"), first("item_id").alias("top_item"), first("sim").alias("top_sim"), F.max(F.when(F.col("pos") == F.col("pred_pos"), F.col("sim"))).alias("pred_sim"), F.max("pred_pos").alias("pred_pos"), F.max("hit").alias("hit"),
        of(F.avg, "to_gt", False).alias("distractor_mean"), of(F.max, "to_gt", False).alias("distractor_max"), F.max("gap").alias("gap"),
    )
    return each.where("not gap").drop("gap").withColumn("margin_best", F.col("gt_sim") - F.col("neg_max")).withColumn("margin_mean", F.col("gt_sim") - F.col("neg_mean")).withColumn("pred_is_top", (F.col("pred_pos") == F.col("top_pos")).cast("int"))


def description_summary(detail: DataFrame) -> DataFrame:
    """Means over all samples, those that the method hit, and those that it missed; a split without samples has no row."""
    split = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("hit") == 1, "llm_hit").when(F.col("hit") == 0, "llm_miss"))))
    means = {"hit": "hit_rate", "top1": "top1_rate", "mrr": "mrr", "gt_rank": "gt_rank_mean", "gt_sim": "gt_sim_mean", "neg_mean": "neg_sim_mean", "neg_max": "neg_max_mean", "margin_best": "margin_best_mean", "margin_mean": "margin_mean_mean", "pred_is_top": "pred_is_top_rate", "distractor_mean": "distractor_sim_mean", "distractor_max": "distractor_max_mean"}
    rows = detail.withColumn("split", split).withColumn("top1", (F.col("gt_rank") == 1).cast("int")).withColumn("mrr", 1.0 / F.col("gt_rank"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), *[F.avg(c).alias(name) for c, name in means.items()])
