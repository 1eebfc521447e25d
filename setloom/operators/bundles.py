"""Statistics of bundles: duplicates, popularity, categories, pairs, itemsets and rules.

Relations are long: ``(bundle_id, item_id)`` and ``(item_id, category)``. Counts are partial aggregates before every
shuffle; totals are one-row relations joined back, not collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X


def dedup_stats(pairs: DataFrame) -> DataFrame:
    """Rows, raw and unique pairs of a bundle relation with duplicates, and how many bundles have any."""
    per = pairs.groupBy("bundle_id").agg(F.count("*").alias("raw"), F.count_distinct("item_id").alias("uniq"))
    return per.agg(
        F.count("*").alias("bundles"), F.sum("raw").alias("raw_pairs"), F.sum("uniq").alias("unique_pairs"), (F.sum("raw") - F.sum("uniq")).alias("removed"), F.count_if(F.col("raw") > F.col("uniq")).alias("bundles_with_duplicates"), F.avg("raw").alias("raw_avg"), F.avg("uniq").alias("unique_avg")
    )


def keep_first(pairs: DataFrame, order: str) -> DataFrame:
    """One row of each (bundle, item): the first in ``order``."""
    first = F.row_number().over(Window.partitionBy("bundle_id", "item_id").orderBy(order))
    return pairs.withColumn("_n", first).where("_n = 1").drop("_n")


def popularity(bi: DataFrame) -> DataFrame:
    return bi.groupBy("item_id").agg(F.count("*").alias("freq"))


def idf(bi: DataFrame) -> DataFrame:
    """ln((N + 1) / (f + 1)) of each item."""
    n = bi.agg(F.count_distinct("bundle_id").alias("n"))
    return popularity(bi).join(F.broadcast(n)).select("item_id", F.log((F.col("n") + 1) / (F.col("freq") + 1)).alias("idf"))


def bundle_categories(bi: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (bundle_id, category, n); items without a category don't count."""
    return bi.join(items.select("item_id", X.blank_to_null("category").alias("category")), "item_id").where("category is not null").groupBy("bundle_id", "category").agg(F.count("*").alias("n"))


def bundle_detail(bi: DataFrame, items: DataFrame) -> DataFrame:
    """Sizes, category set, largest multiplicity and missing categories of each bundle."""
    per = bi.join(items.select("item_id", X.blank_to_null("category").alias("category")), "item_id", "left").groupBy("bundle_id", "category").agg(F.count("*").alias("n"))
    known = F.col("category").isNotNull()
    return per.groupBy("bundle_id").agg(
        F.sum("n").alias("items"), F.count_if(known).alias("categories"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.max(F.when(known, F.col("n"))), F.lit(0)).alias("largest"), X.canonical(F.collect_list("category")).alias("category_set")
    ).withColumn("repeated", (F.col("largest") > 1).cast("int"))


def category_frequency(bc: DataFrame) -> DataFrame:
    """Bundles and items of each category and their shares."""
    totals = bc.agg(F.count_distinct("bundle_id").alias("all_bundles"), F.sum("n").alias("all_items"))
    per = bc.groupBy("category").agg(F.count("*").alias("bundles"), F.sum("n").alias("items"))
    return per.join(F.broadcast(totals)).select("category", "bundles", "items", (F.col("bundles") / F.col("all_bundles")).alias("bundle_ratio"), (F.col("items") / F.col("all_items")).alias("item_ratio"))


def category_pairs(bc: DataFrame) -> DataFrame:
    """Pairs of categories in one bundle with support, conditionals, lift and log2 PMI."""
    sets = bc.select("bundle_id", "category")
    n = sets.agg(F.count_distinct("bundle_id").alias("n"))
    freq = sets.groupBy("category").agg(F.count("*").alias("f"))
    both = sets.alias("a").join(sets.alias("b"), "bundle_id").where("a.category < b.category").groupBy(F.col("a.category").alias("a"), F.col("b.category").alias("b")).agg(F.count("*").alias("count"))
    of = lambda x: freq.select(F.col("category").alias(x), F.col("f").alias(f"f{x}"))
    ratio = F.col("count") * F.col("n") / (F.col("fa") * F.col("fb"))
    return both.join(of("a"), "a").join(of("b"), "b").join(F.broadcast(n)).select("a", "b", "count", (F.col("count") / F.col("n")).alias("support"), (F.col("count") / F.col("fa")).alias("p_b_given_a"), (F.col("count") / F.col("fb")).alias("p_a_given_b"), ratio.alias("lift"), X.pmi(ratio).alias("pmi"))


def set_patterns(bc: DataFrame) -> DataFrame:
    """Whole category sets and how often they occur."""
    sets = bc.groupBy("bundle_id").agg(X.canonical(F.collect_list("category")).alias("category_set"), F.count("*").alias("size"))
    n = sets.agg(F.count("*").alias("n"))
    return sets.groupBy("category_set", "size").agg(F.count("*").alias("count")).join(F.broadcast(n)).select("category_set", "size", "count", (F.col("count") / F.col("n")).alias("ratio"))


def itemsets(bc: DataFrame, largest: int) -> DataFrame:
    """Rows (size, key, count) of all category subsets of bundles with at most ``largest`` members."""
    sets = bc.groupBy("bundle_id").agg(F.array_sort(F.collect_list("category")).alias("names"))
    keys = sets.select(F.explode_outer(X.subsets("names", largest)).alias("s")).select(F.size("s").alias("size"), F.array_join("s", "|").alias("key"))
    return keys.groupBy("size", "key").agg(F.count("*").alias("count"))


def association_rules(bc: DataFrame, largest: int = 2, least: int = 2) -> DataFrame:
    """Rules from one or two categories to another, with joint counts of at least ``least``."""
    n = bc.agg(F.count_distinct("bundle_id").alias("n"))
    counted = itemsets(bc, largest + 1)
    joint = counted.where((F.col("size") > 1) & (F.col("count") >= least)).withColumn("names", F.split("key", r"\|"))
    rules = joint.select(F.col("count").alias("joint"), "names", F.explode("names").alias("consequent")).withColumn("antecedent", F.array_join(F.array_remove("names", F.col("consequent")), "|"))
    base = counted.select(F.col("key").alias("antecedent"), F.col("count").alias("support_a"))
    goal = counted.where("size = 1").select(F.col("key").alias("consequent"), F.col("count").alias("support_c"))
    joined = rules.join(base, "antecedent").join(goal, "consequent").join(F.broadcast(n))
    confidence = F.col("joint") / F.col("support_a")
    up = confidence * F.col("n") / F.col("support_c")
    return joined.select("antecedent", "consequent", "joint", (F.col("joint") / F.col("n")).alias("support"), confidence.alias("confidence"), up.alias("lift"), X.pmi(up).alias("pmi"))


def dataset_summary(bi: DataFrame, items: DataFrame) -> DataFrame:
    """One row: sizes, medians, entropies, most frequent set."""
    detail = bundle_detail(bi, items)
    bc = bundle_categories(bi, items)
    head = detail.agg(F.count("*").alias("bundles"), F.avg("items").alias("items_avg"), F.median("items").alias("items_median"), F.avg("categories").alias("categories_avg"), F.median("categories").alias("categories_median"), F.avg("repeated").alias("repeated_rate"), (F.count_distinct("category_set") / F.count("*")).alias("unique_set_ratio"))
    freq = bc.groupBy("category").agg(F.sum("n").alias("n"))
    bits = freq.select("n", F.sum("n").over(Window.partitionBy()).alias("t")).agg(F.count("*").alias("categories"), F.sum(X.entropy_term("n", "t")).alias("category_entropy"))
    sets = set_patterns(bc)
    best = sets.agg(F.max_by("category_set", F.struct("count", F.col("category_set"))).alias("top_set"), F.max("count").alias("top_set_count"))
    return head.join(F.broadcast(bits)).join(F.broadcast(best))


def input_lengths(bi: DataFrame) -> DataFrame:
    return bi.groupBy("bundle_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("bundles"))


def category_field(items: DataFrame, candidates: list[str]) -> DataFrame:
    """One row a candidate field: rows that are not blank, in the order of preference."""
    counted = items.agg(*[F.count_if(X.blank_to_null(F.col(c).cast("string")).isNotNull()).alias(c) for c in candidates])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("field"), F.col(c).alias("filled")) for i, c in enumerate(candidates)])).alias("x")).select("x.*")


def distinct_ids(samples: DataFrame, *columns: str) -> DataFrame:
    """All ids in some array columns, once."""
    return samples.select(F.explode(F.concat(*columns)).alias("item_id")).distinct()
