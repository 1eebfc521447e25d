"""Which category completes a set: scorers over itemset counts, ranks of the held-out answer, summaries.

Subsets of the observed categories are exploded and joined on their canonical key; joint counts come from the itemsets
that extend the key by one category. Categories that extend none of a set's subsets all have one and the same value: they
are never made, but counted where an answer is ranked (:func:`judged_sparse`), so no set meets the category domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.shared import stash

KS = (1, 3, 5)


def extensions(counts: DataFrame) -> DataFrame:
    """Rows (key, category, joint): itemsets without one member, that member, and the itemset's count."""
    parts = counts.where("size > 1").withColumn("names", F.split("key", r"\|"))
    return parts.select("names", F.col("count").alias("joint"), F.explode("names").alias("category")).select(F.array_join(F.array_remove("names", F.col("category")), "|").alias("key"), "category", "joint")


def observed_sets(observed: DataFrame) -> DataFrame:
    return observed.groupBy("bundle_id").agg(F.array_sort(F.collect_list("category")).alias("names"))


def direct(observed: DataFrame, counts: DataFrame, domain: DataFrame, least: int, largest: int) -> DataFrame:
    """Rows (bundle_id, category, score, support): joint / support of the whole observed set, zeros included.

    Sets that are larger than ``largest`` or rarer than ``least`` have no rows: they are not covered.
    """
    sets = observed_sets(observed).where(F.size("names") <= largest).withColumn("key", F.array_join("names", "|"))
    known = sets.join(counts.where(F.col("count") >= least).select("key", F.col("count").alias("support")), "key")
    every = known.join(F.broadcast(domain.select("category").distinct())).where(~F.array_contains("names", F.col("category")))
    return every.join(extensions(counts), ["key", "category"], "left").select("bundle_id", "category", (F.coalesce("joint", F.lit(0)) / F.col("support")).alias("score"), "support")


def direct_sparse(observed: DataFrame, counts: DataFrame, least: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """As :func:`direct` without zeros: rows (bundle_id, category, score), and (bundle_id, rest), the value of all other categories."""
    sets = observed_sets(observed).where(F.size("names") <= largest).select("bundle_id", F.array_join("names", "|").alias("key"))
    known = stash(sets.join(counts.where(F.col("count") >= least).select("key", F.col("count").alias("support")), "key"), "known-sets")
    rows = known.join(extensions(counts), "key").select("bundle_id", "category", (F.col("joint") / F.col("support")).alias("score"))
    return rows, known.select("bundle_id", F.lit(0.0).alias("rest"))


RULES = {"confidence": 0.0, "lift": 0.0, "pmi": -100.0}


def backoff(observed: DataFrame, counts: DataFrame, least: int, largest: int, bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over the observed set's subsets with support, means weighted by size times support of each rule's value.

    Rows (bundle_id, category, confidence, lift, pmi) for the categories that extend any of these subsets, and the rows
    (bundle_id, rest) of what is covered; a category without a row has the value that ``RULES`` gives for no joint count.
    """
    parts = observed_sets(observed).select("bundle_id", "names", F.explode(X.subsets("names", largest)).alias("part")).select("bundle_id", "names", F.size("part").alias("size"), F.array_join("part", "|").alias("key"))
    known = stash(parts.join(counts.where(F.col("count") >= least).select("key", F.col("count").alias("support")), "key").withColumn("w", F.col("size") * F.col("support")), "known-subsets")
    weights = known.groupBy("bundle_id").agg(F.sum("w").alias("all"))
    share = counts.where("size = 1").select(F.col("key").alias("category"), F.col("count").alias("n")).join(F.broadcast(bundles)).select("category", (F.col("n") / F.col("bundles")).alias("share"))
    met = known.join(extensions(counts), "key").where(~F.array_contains("names", F.col("category"))).join(share, "category", "left")
    value = F.col("joint") / F.col("support")
    up = X.lift(value, F.coalesce("share", F.lit(0.0)))
    log = F.when(F.coalesce("share", F.lit(0.0)) <= 0, 0.0).otherwise(X.pmi(up, zero=RULES["pmi"]))
    sums = met.groupBy("bundle_id", "category").agg(F.sum("w").alias("met"), *[F.sum(F.col("w") * v).alias(r) for r, v in (("confidence", value), ("lift", up), ("pmi", log))])
    mean = lambda r: ((F.col(r) + (F.col("all") - F.col("met")) * RULES[r]) / F.col("all")).alias(r)
    return stash(sums.join(weights, "bundle_id").select("bundle_id", "category", *map(mean, RULES)), "backoff"), weights.select("bundle_id", F.lit(0.0).alias("rest"))


def judged_sparse(rows: DataFrame, rest: DataFrame, observed: DataFrame, domain: DataFrame, heldout: DataFrame, digits: int = 9) -> DataFrame:
    """As :func:`judged`, where the categories of the domain without a row (bundle_id, category, score) have the score of ``rest`` (bundle_id, rest).

    An answer's place follows from the rows with a higher score, the same score and a smaller name, and from how many
    categories have no row at all, or none and a smaller name.
    """
    names = domain.select("category").distinct().withColumn("before", F.row_number().over(Window.orderBy("category")) - 1)  # a table of categories
    total = names.count()
    rows = rows.withColumn("score", F.round("score", digits))
    answers = heldout.select("bundle_id", F.col("category").alias("answer")).join(rest.select("bundle_id", F.round("rest", digits).alias("rest")), "bundle_id", "left")
    own = rows.select("bundle_id", F.col("category").alias("answer"), F.col("score").alias("own"))
    asked = answers.join(own, ["bundle_id", "answer"], "left").withColumn("goal", F.coalesce("own", "rest")).join(names.withColumnRenamed("category", "answer"), "answer", "left")
    first = F.col("category") < F.col("answer")
    met = asked.join(rows, "bundle_id").groupBy("bundle_id", "answer").agg(F.count_if((F.col("score") > F.col("goal")) | ((F.col("score") == F.col("goal")) & first)).alias("better"), F.count("*").alias("rows"), F.count_if(first).alias("rows_before"))
    seen = asked.select("bundle_id", "answer").join(observed.join(names.select("category"), "category", "left_semi"), "bundle_id").groupBy("bundle_id", "answer").agg(F.count("*").alias("seen"), F.count_if(first).alias("seen_before"), F.max(F.col("category") == F.col("answer")).alias("was_seen"))
    n = lambda c: F.coalesce(c, F.lit(0))
    whole = asked.join(met, ["bundle_id", "answer"], "left").join(seen, ["bundle_id", "answer"], "left")
    free = total - n("seen") - n("rows")
    absent = F.when(F.col("rest") > F.col("goal"), free).when(F.col("rest") == F.col("goal"), F.col("before") - n("seen_before") - n("rows_before")).otherwise(0)
    covered = F.col("rest").isNotNull() & (n("seen") < total)
    rank = F.when(covered & F.col("before").isNotNull() & ~F.coalesce("was_seen", F.lit(False)), 1 + n("better") + absent)
    out = whole.select("bundle_id", covered.cast("int").alias("covered"), rank.alias("rank")).groupBy("bundle_id").agg(F.max("covered").alias("covered"), F.min("rank").alias("rank"))
    return out.select("bundle_id", "covered", "rank", X.reciprocal("rank").alias("mrr"), *[X.hit("rank", k).alias(f"hit_at_{k}") for k in KS])


def ranked(scores: DataFrame) -> DataFrame:
    """Places by score, ties by name."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("score"), "category")))


def judged(scores: DataFrame, heldout: DataFrame, digits: int = 9) -> DataFrame:
    """One row a bundle of ``heldout``: covered, rank of the answer (NULL if it was observed), metrics. Scores are rounded before they are compared."""
    placed = ranked(scores.withColumn("score", F.round("score", digits)))
    best = placed.join(heldout.select("bundle_id", "category"), ["bundle_id", "category"], "left_semi").groupBy("bundle_id").agg(F.min("rank").alias("rank"))
    covered = scores.select("bundle_id").distinct().withColumn("covered", F.lit(1))
    out = heldout.select("bundle_id").distinct().join(covered, "bundle_id", "left").join(best, "bundle_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.select("bundle_id", "covered", "rank", X.reciprocal("rank").alias("mrr"), *[X.hit("rank", k).alias(f"hit_at_{k}") for k in KS])


def summary(detail: DataFrame, *keys: str) -> DataFrame:
    """Coverage and metrics by group: of covered rows, or of all if none is covered."""
    some = F.max("covered") == 1
    mean = lambda c: F.when(some, F.avg(F.when(F.col("covered") == 1, F.col(c)))).otherwise(F.avg(c))
    return detail.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("covered").alias("coverage"), F.sum("covered").alias("n_covered"), mean("mrr").alias("mrr"), F.avg(F.when(F.col("covered") == 1, F.col("rank"))).alias("mean_rank"), *[mean(f"hit_at_{k}").alias(f"hit_at_{k}") for k in KS])


def summary_sets(detail: DataFrame) -> DataFrame:
    """The summary for all, by observed size, and by covered, in one pass over grouping sets."""
    metrics = ", ".join(f"avg(CASE WHEN covered = 1 THEN {c} END) AS {c}" for c in ("mrr", *[f"hit_at_{k}" for k in KS]))
    body = f"CASE WHEN grouping(observed_size) = 0 THEN 'observed_size' WHEN grouping(covered) = 0 THEN 'covered' ELSE 'all' END AS grouping, CASE WHEN grouping(observed_size) = 0 THEN observed_size WHEN grouping(covered) = 0 THEN covered END AS value, count(*) AS n, {metrics}"
    return detail.sparkSession.sql(f"SELECT {body} FROM {{d}} GROUP BY GROUPING SETS ((), (observed_size), (covered))", d=detail)


def mean_support(observed: DataFrame, pairs: DataFrame, singles: DataFrame) -> DataFrame:
    """Rows (bundle_id, category, score, pair_support): mean over observed categories of pair / single counts, and the sum of pairs.

    ``pairs``: (a, b, n) both ways; ``singles``: (category, n).
    """
    joined = observed.select("bundle_id", F.col("category").alias("a")).join(singles.where("n > 0").select(F.col("category").alias("a"), F.col("n").alias("d")), "a")
    size = joined.groupBy("bundle_id").agg(F.count("*").alias("size"))
    met = joined.join(pairs, "a").groupBy("bundle_id", F.col("b").alias("category")).agg(F.sum(F.col("n") / F.col("d")).alias("s"), F.sum("n").alias("pair_support"))
    return met.join(size, "bundle_id").select("bundle_id", "category", (F.col("s") / F.col("size")).alias("score"), "pair_support").join(observed, ["bundle_id", "category"], "left_anti")


def quadrants(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Counts of both, only a, only b and neither hitting at ``k``; every label has a row."""
    joined = a.select("bundle_id", F.col(f"hit_at_{k}").alias("x")).join(b.select("bundle_id", F.col(f"hit_at_{k}").alias("y")), "bundle_id")
    label = F.when((F.col("x") == 1) & (F.col("y") == 1), "both").when(F.col("x") == 1, "first_only").when(F.col("y") == 1, "second_only").otherwise("neither")
    found = joined.groupBy(label.alias("quadrant")).agg(F.count("*").alias("n"))
    names = a.sparkSession.createDataFrame([("both",), ("first_only",), ("second_only",), ("neither",)], "quadrant string")
    total = joined.agg(F.count("*").alias("t"))
    return names.join(found, "quadrant", "left").join(F.broadcast(total)).select("quadrant", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("t")).alias("ratio"))
