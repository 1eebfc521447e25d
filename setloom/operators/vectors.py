"""Vector operators: prototypes, similarity joins, candidate signals, soft links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.operators.neighbours import Index


def normalized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, X.unit(column))


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The most coordinates that a vector has."""
    return max(0, vectors.agg(F.max(F.size(column))).first()[0] or 0)


def mean_vectors(rows: DataFrame, keys: list[str], column: str = "embedding", size: int | None = None) -> DataFrame:
    """Rows (keys, n, embedding): mean of each group's vectors, coordinate by coordinate, not normalised.

    Coordinates are columns of one aggregate, so a vector is one row, and a group meets in one shuffle. ``size``: the
    dimension, where a caller has it from a smaller table than ``rows``.
    """
    size = dimension(rows, column) if size is None else size
    each = [F.avg(F.get(column, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(size)]
    means = rows.where(F.size(column) > 0).groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size(column)).alias("_size"), *each)
    held = F.array(*[F.col(f"_{i}") for i in range(size)]).cast("array<double>")
    return means.select(*keys, "n", F.slice(held, F.lit(1), F.col("_size")).alias(column))


def prototypes(vectors: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Mean vector, its unit vector and the number of items of each ``key``."""
    joined = vectors.select("item_id", "embedding").join(items.select("item_id", key), "item_id")
    return mean_vectors(joined, [key], size=dimension(vectors)).withColumn("unit", X.unit("embedding"))


def bundle_vectors(vectors: DataFrame, bi: DataFrame) -> DataFrame:
    """Unit mean of the unit vectors of each bundle's items that have one. They are dealt by bundle as stored, not as partial sums and counts."""
    joined = bi.select("bundle_id", "item_id").join(vectors.select("item_id", "embedding"), "item_id").repartition("bundle_id")
    return normalized(mean_vectors(normalized(joined), ["bundle_id"], size=dimension(vectors)))


def nearest(vectors: DataFrame, key: str, digits: int = 9) -> DataFrame:
    """Each row's most similar other row by cosine (ties: least key). Rows (key, neighbour, score)."""
    return Index(vectors, key, digits).nearest(1).drop("place")


def bundle_links(vectors: DataFrame, bi: DataFrame, digits: int = 9) -> DataFrame:
    """Item -> the bundles most similar to its own ones (by their mean vectors). Rows (item_id, bundle_id)."""
    near = nearest(bundle_vectors(vectors, bi), "bundle_id", digits)
    return bi.select("item_id", "bundle_id").join(near.select("bundle_id", "neighbour"), "bundle_id").select("item_id", F.col("neighbour").alias("bundle_id")).distinct()


def soft_links(near: DataFrame, bi: DataFrame) -> DataFrame:
    """Item -> bundles of its most similar item that don't hold it already."""
    linked = near.select("item_id", "neighbour").join(bi.select(F.col("item_id").alias("neighbour"), "bundle_id"), "neighbour").select("item_id", "bundle_id")
    return linked.join(bi.select("item_id", "bundle_id"), ["item_id", "bundle_id"], "left_anti")


def _sides(samples: DataFrame, inputs: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Options (with v) and inputs (with w) that have a vector, dealt by bundle as stored and made units there."""
    raw = vectors.select("item_id", "embedding")
    left = samples.join(raw, "item_id").repartition("bundle_id").withColumn("v", X.unit("embedding")).drop("embedding")
    right = inputs.join(raw, "item_id").select("bundle_id", "embedding").repartition("bundle_id").select("bundle_id", X.unit("embedding").alias("w"))
    return left, right


def pair_cosines(samples: DataFrame, inputs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Options with a vector against the inputs with one: rows (bundle_id, pos, item_id, is_gt, pair_mean, pair_max)."""
    left, right = _sides(samples, inputs, vectors)
    return _cosines(left, right)


def _cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    each = left.join(right, "bundle_id").select("bundle_id", "pos", "item_id", "is_gt", X.dot("v", "w").alias("_cosine"))
    return each.groupBy("bundle_id", "pos", "item_id", "is_gt").agg(F.avg("_cosine").alias("pair_mean"), F.max("_cosine").alias("pair_max"))


def pair_scores(samples: DataFrame, inputs: DataFrame, vectors: DataFrame) -> DataFrame:
    """:func:`pair_cosines`, and the cosine to the mean input (bundle_mean).

    Rows (bundle_id, pos, item_id, is_gt, pair_mean, pair_max, bundle_mean).
    """
    left, right = _sides(samples, inputs, vectors)
    mean = mean_vectors(right, ["bundle_id"], "w", dimension(vectors)).select("bundle_id", X.unit("w").alias("m"))
    against = left.join(mean, "bundle_id").select("bundle_id", "pos", X.dot("v", "m").alias("bundle_mean"))
    return _cosines(left, right).join(against, ["bundle_id", "pos"])


def placed(scores: DataFrame, column: str, keys: list[str] = ["bundle_id"], digits: int = 9) -> DataFrame:  # noqa: B006
    """Stable place by descending score (ties by position) and competition rank."""
    rounded = F.round(column, digits)
    stable = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(rounded), "pos")).cast("long")
    greater = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(rounded))).cast("long")
    return scores.withColumn("place", stable).withColumn("rank", greater)


def signal_summary(placed_rows: DataFrame, groups: list[Column | str]) -> DataFrame:
    """Answer's top-1 and top-3 rates, MRR and mean place."""
    return placed_rows.where("is_gt").groupBy(*groups).agg(F.count("*").alias("n"), F.avg((F.col("place") <= 1).cast("int")).alias("top1"), F.avg((F.col("place") <= 3).cast("int")).alias("top3"), F.avg(1.0 / F.col("place")).alias("mrr"), F.avg("place").alias("mean_place"))


def against_distractors(scores: DataFrame, column: str) -> DataFrame:
    """Per sample: win and tie rate of the answer over the other options and its margin over their mean."""
    goal = scores.where("is_gt").select("bundle_id", F.col(column).alias("g"))
    rest = scores.where("not is_gt").select("bundle_id", F.col(column).alias("s"))
    return goal.join(rest, "bundle_id").groupBy("bundle_id").agg(F.avg((F.round("g", 9) > F.round("s", 9)).cast("int")).alias("win_rate"), F.avg((F.round("g", 9) == F.round("s", 9)).cast("int")).alias("tie_rate"), (F.max("g") - F.avg("s")).alias("margin"), F.max("g").alias("gt_score"), F.avg("s").alias("distractor_mean"))


def representatives(vectors: DataFrame, items: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` items of each group that are nearest to its mean vector."""
    center = prototypes(vectors, items, key).select(key, "unit")
    scored = vectors.select("item_id", "embedding").join(items.select("item_id", key), "item_id").join(F.broadcast(center), key).select(key, "item_id", F.round(X.dot(X.unit("embedding"), "unit"), 9).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "item_id")).cast("long")).where(F.col("place") <= k)


def centroid_scores(sets: DataFrame, centers: DataFrame, group: str, key: str, digits: int = 9) -> DataFrame:
    """Cosine of the mean of a group's key vectors with every other key's: rows (group, key, score), observed keys out.

    ``centers`` (key, unit) is a table of categories, whose number the data model bounds.
    """
    mean = mean_vectors(sets.join(centers, key), [group], "unit", dimension(centers, "unit")).select(group, X.unit("unit").alias("m"))
    scored = mean.join(F.broadcast(centers)).select(group, key, F.round(X.dot("m", "unit"), digits).alias("score"))
    return scored.join(sets.select(group, key), [group, key], "left_anti")


def feature_sanity(vectors: DataFrame) -> DataFrame:
    """One row: vectors, share of finite values, zero norms, quantiles of norms, rows equal to the one before."""
    each = vectors.select("item_id", "embedding", X.norm("embedding").alias("norm"), F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))
    same = vectors.select(F.xxhash64("embedding").alias("h"), F.col("item_id")).alias("x").join(vectors.select(F.xxhash64("embedding").alias("h2"), (F.col("item_id") + 1).alias("item_id")), "item_id").agg(F.count_if(F.col("h") == F.col("h2")).alias("adjacent_duplicates"))
    return each.agg(F.count("*").alias("n"), F.avg(F.col("finite").cast("int")).alias("finite_ratio"), F.count_if(F.col("norm") == 0).alias("zero_norms"), F.percentile("norm", F.lit(0.5)).alias("norm_median"), F.min("norm").alias("norm_min"), F.max("norm").alias("norm_max")).join(F.broadcast(same))


def refreshed(base: DataFrame, new: DataFrame) -> DataFrame:
    """``base`` with the vectors that ``new`` has replaced. Rows (item_id, embedding, replaced)."""
    return base.select("item_id", "embedding").join(new.select("item_id", F.col("embedding").alias("fresh")), "item_id", "left").select("item_id", F.coalesce("fresh", "embedding").alias("embedding"), F.col("fresh").isNotNull().alias("replaced"))
