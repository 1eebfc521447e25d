"""Cases, tags, augmented item texts, summary prompts, and vectors of category sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.operators.neighbours import Index
from setloom.operators.vectors import dimension, mean_vectors
from setloom.shared import stash


def by_row(df: DataFrame, order: str, parts: int = 1024) -> DataFrame:
    """``df`` with the row number (``row``, from 0) in the order of a whole-number key, numbered in ranges of the key that are counted first."""
    ends = df.agg(F.min(order).alias("_least"), F.max(order).alias("_most"))  # one row
    placed = df.join(F.broadcast(ends)).withColumn("_part", F.floor((F.col(order) - F.col("_least")) * parts / (F.col("_most") - F.col("_least") + 1))).drop("_least", "_most")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    numbered = placed.withColumn("_inside", inside).join(counts.select("_part", before.alias("_before")), "_part")
    return numbered.withColumn("row", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def stacked(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables one under another with their names as ``part``; columns that one lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("part", F.lit(name)) for name, df in tables.items()))


def tag_accuracy(runs: DataFrame, tags: DataFrame, methods: list[str]) -> DataFrame:
    """Accuracy of each method by tag, a column a method. ``tags``: (bundle_id, tag), any number a bundle."""
    each = [F.avg(F.when(F.col("method") == m, F.col("hit").cast("int"))).alias(m) for m in methods]
    return runs.join(tags, "bundle_id").groupBy("tag").agg(F.count_distinct("bundle_id").alias("n"), *each)


def unique_cases(runs: DataFrame) -> DataFrame:
    """Bundles that one method alone answers rightly: (bundle_id, method, true_item)."""
    hits = runs.where(F.col("hit").cast("int") == 1)
    alone = hits.groupBy("bundle_id").agg(F.count("*").alias("hits")).where("hits = 1")
    return hits.join(alone, "bundle_id").select("bundle_id", "method", "true_item")


def with_names(texts: DataFrame) -> DataFrame:
    """Item texts with the name of their category, where they have one."""
    return texts.withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit(" ("), X.blank_to_null("category"), F.lit(")")), F.lit(""))))


def with_descriptions(texts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Item texts with their description (item_id, description), where there is one."""
    joined = texts.join(descriptions.select("item_id", X.blank_to_null("description").alias("_d")), "item_id", "left")
    return joined.withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit(": "), "_d"), F.lit("")))).drop("_d")


def neighbourhood_prompts(bi: DataFrame, texts: DataFrame, k: int, task: str) -> DataFrame:
    """Prompt of each item over the ``k`` items that it shares most bundles with."""
    met = bi.join(bi.select("bundle_id", F.col("item_id").alias("other")), "bundle_id").where("item_id <> other").groupBy("item_id", "other").agg(F.count("*").alias("n"))
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "other"))).where(F.col("place") <= k)
    lines = best.join(texts.select(F.col("item_id").alias("other"), "text"), "other").groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "n", "text"))), lambda s: F.concat(s["n"].cast("string"), F.lit(" x "), s["text"])), "\n").alias("lines"))
    return lines.join(texts.select("item_id", "text"), "item_id").select("item_id", F.concat_ws("\n", F.lit(task), F.concat(F.lit("Item: "), "text"), "lines").alias("prompt"))


def category_prompts(bi: DataFrame, texts: DataFrame, k: int, task: str) -> DataFrame:
    """Prompt of each category over the ``k`` items of it that stand in most bundles."""
    freq = bi.groupBy("item_id").agg(F.count("*").alias("f"))
    best = texts.join(freq, "item_id").withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("f"), "item_id"))).where(F.col("r") <= k)
    return best.groupBy("category").agg(F.concat_ws("\n", F.lit(task), F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda s: s["text"])).alias("prompt"))


def evidence_text(evidence: DataFrame) -> DataFrame:
    """A block of lines for the evidence of each bundle (bundle_id, key, level, place)."""
    line = F.concat(F.lit("Example "), F.col("place").cast("string"), F.lit(" ("), F.col("level").cast("string"), F.lit(" shared): "), F.regexp_replace("key", r"\|", ", "))
    return evidence.groupBy("bundle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n").alias("block"))


def category_set_vectors(bc: DataFrame, units: DataFrame) -> DataFrame:
    """Unit mean of the category vectors (category, unit) of each bundle: (bundle_id, n, embedding).

    Vectors are added up once for each set of categories; bundles carry the names of theirs only.
    """
    sets, means = _set_vectors(bc, units)
    return sets.join(means, "names").select("bundle_id", "n", "embedding")


def _set_vectors(bc: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sorted categories with a vector of each bundle (bundle_id, names), and the unit mean of each such list (names, n, embedding)."""
    known = bc.select("bundle_id", "category").join(units.select("category"), "category", "left_semi")
    sets = known.groupBy("bundle_id").agg(F.array_sort(F.collect_list("category")).alias("names"))
    members = sets.select("names").distinct().select("names", F.explode("names").alias("category")).join(units.select("category", "unit"), "category")
    means = mean_vectors(members, ["names"], "unit", dimension(units, "unit"))
    return sets, means.select("names", "n", X.unit("unit").alias("embedding"))


def set_cosines(bc: DataFrame, units: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """The set of categories of each bundle (bundle_id, set: the least bundle that has it), and the cosine of each set's mean with each category (set, category, score).

    Options meet numbers, not vectors; only sets meet the table of categories.
    """
    sets, means = _set_vectors(bc, units)
    sets = stash(sets, "category-sets")
    least = sets.groupBy("names").agg(F.min("bundle_id").alias("set"))
    cosines = least.join(means, "names").join(F.broadcast(units.select("category", "unit"))).select("set", "category", F.round(X.dot("embedding", "unit"), digits).alias("score"))
    return sets.join(least, "names").select("bundle_id", "set"), cosines


def role_categories(observed: DataFrame, units: DataFrame, k: int, digits: int = 8) -> DataFrame:
    """The ``k`` categories nearest to the mean vector of a bundle's observed ones, without these.

    Bundles with the same observed set have the same answer, so sets are compared, not bundles.
    Rows (bundle_id, category, score, place).
    """
    sets = observed.groupBy("bundle_id").agg(F.array_sort(F.collect_set("category")).alias("names")).withColumn("key", F.array_join("names", "|"))
    each = sets.groupBy("key").agg(F.first("names").alias("names"))
    means = category_set_vectors(each.select(F.col("key").alias("bundle_id"), F.explode("names").alias("category")), units).select(F.col("bundle_id").alias("key"), "embedding")
    against = means.join(each, "key").join(units).where(~F.array_contains("names", F.col("category")))
    scored = against.select("key", "category", F.round(X.dot("embedding", "unit"), digits).alias("score"))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "category"))).where(F.col("place") <= k)
    return sets.select("bundle_id", "key").join(best, "key").select("bundle_id", "category", "score", "place")


def role_bundles(observed: DataFrame, train_bc: DataFrame, units: DataFrame, k: int, digits: int = 8) -> DataFrame:
    """The ``k`` training bundles whose categories' mean vector is nearest to that of the observed ones (ties: least bundle).

    Bundles with one category set have one vector, and queries with one observed set have one answer; the index of vectors
    compares sets only, and only with sets that its bounds don't rule out. Rows (bundle_id, context, score, place).
    """
    sets = stash(observed.groupBy("bundle_id").agg(F.array_join(F.array_sort(F.collect_set("category")), "|").alias("key")), "observed-sets")
    asked = sets.groupBy("key").agg(F.min("bundle_id").alias("bundle_id"))
    means = category_set_vectors(observed.join(asked, "bundle_id", "left_semi"), units).select(F.col("bundle_id").alias("q"), F.col("embedding").alias("v"))
    held, vectors = _set_vectors(train_bc, units)
    held = stash(held, "category-sets")
    least = stash(held.groupBy("names").agg(F.min("bundle_id").alias("set")), "sets-least")
    # a set stands for its bundles under the least of them; of each set that is found the first k are opened
    index = Index(least.join(vectors, "names").select("set", "embedding"), "set", digits)
    found = index.first(index.opened(index.top(means, k), k).withColumnRenamed("neighbour", "g"), k)
    inside = F.row_number().over(Window.partitionBy("set").orderBy("neighbour"))
    members = held.join(least, "names").select("set", F.col("bundle_id").alias("neighbour")).withColumn("inside", inside).where(F.col("inside") <= k)
    opened = found.withColumnRenamed("g", "set").join(members, "set").select("q", "neighbour", "score")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "neighbour")).cast("long")
    best = opened.withColumn("place", place).where(F.col("place") <= k)
    return sets.join(asked.withColumnRenamed("bundle_id", "q"), "key").join(best, "q").select("bundle_id", F.col("neighbour").alias("context"), "score", "place")


def prediction_similarity(runs: DataFrame, samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean and largest cosine of the predicted option with the others of its sample: (method, bundle_id, mean_other, max_other)."""
    unit = vectors.select("item_id", X.unit("embedding").alias("v"))
    options = samples.select("bundle_id", "pos", "item_id").join(unit, "item_id")
    predicted = runs.select("method", "bundle_id", F.col("pred_pos").alias("pos")).join(options, ["bundle_id", "pos"]).select("method", "bundle_id", F.col("pos").alias("p"), F.col("v").alias("w"))
    both = predicted.join(options, "bundle_id").where("pos <> p")
    return both.groupBy("method", "bundle_id").agg(F.avg(X.dot("v", "w")).alias("mean_other"), F.max(X.dot("v", "w")).alias("max_other"))


def context_alignment(contexts: DataFrame, train: DataFrame, inputs: DataFrame, samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the mean context item (inputs left out) with the answer and with the other options: (bundle_id, answer, others, best_other)."""
    raw = vectors.select("item_id", "embedding")
    held = contexts.join(train.select(F.col("bundle_id").alias("context"), "item_id"), "context").join(inputs, ["bundle_id", "item_id"], "left_anti")
    # vectors are dealt as they are stored and made units where their bundle is added up: partial means would be four times as wide
    dealt = held.join(raw, "item_id").select("bundle_id", "embedding").repartition("bundle_id").select("bundle_id", X.unit("embedding").alias("v"))
    mean = mean_vectors(dealt, ["bundle_id"], "v", dimension(vectors)).select("bundle_id", X.unit("v").alias("m"))
    # options meet their own vectors first: those without one go, and a mean is moved once, not for each option
    options = samples.select("bundle_id", "is_gt", "item_id").join(raw, "item_id").select("bundle_id", "is_gt", "embedding").repartition("bundle_id")
    scored = options.join(mean, "bundle_id").select("bundle_id", "is_gt", X.dot(X.unit("embedding"), "m").alias("score"))
    of = lambda f, flag: f(F.when(F.col("is_gt") == flag, F.col("score")))
    return scored.groupBy("bundle_id").agg(of(F.max, True).alias("answer"), of(F.avg, False).alias("others"), of(F.max, False).alias("best_other"))


def mean_and_median(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Count, and mean and median of each column, by group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{name}") for c in columns for f, name in ((F.avg, "mean"), (F.median, "median"))])
