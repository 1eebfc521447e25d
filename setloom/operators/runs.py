"""Scored runs: tie statistics of signals, method metrics, pairwise and joint comparisons, views, oracles and regret.

Runs are long: one row a (method, bundle). Comparisons join a run with itself on the bundle; nothing is collected.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X


def tie_stats(scores: DataFrame, *keys: str) -> DataFrame:
    """Each option's place among its sample's scores, with all tie rules: least, largest and mean rank, top ties, gaps."""
    w = Window.partitionBy(*keys)
    top = F.max("score").over(w)
    least = F.rank().over(w.orderBy(F.desc("score"))).cast("long")
    equal = F.count("*").over(Window.partitionBy(*keys, "score"))
    out = scores.withColumn("top_score", top).withColumn("min_rank", least).withColumn("max_rank", least + equal - 1).withColumn("levels", F.collect_set("score").over(w))
    tied = F.count_if(F.col("score") == F.col("top_score")).over(w)
    return out.select(
        *scores.columns,
        "min_rank",
        "max_rank",
        ((F.col("min_rank") + F.col("max_rank")) / 2).alias("avg_rank"),
        (F.col("score") == F.col("top_score")).cast("int").alias("in_top_tie"),
        ((F.col("score") == F.col("top_score")) & (tied == 1)).cast("int").alias("unique_top1"),
        (F.col("top_score") - F.col("score")).alias("gap_to_top"),
        "top_score",
        X.margin("levels").alias("second_margin"),
        tied.alias("top_tie_size"),
        (F.size("levels") == 1).cast("int").alias("all_tied"),
        F.forall("levels", lambda x: x == 0).cast("int").alias("all_zero"),
        (F.col("top_score") > 0).cast("int").alias("positive_signal"),
    )


STATS = ("score", "min_rank", "avg_rank", "in_top_tie", "unique_top1", "top_score", "second_margin", "top_tie_size", "all_tied", "all_zero", "positive_signal")


def _stats(own: Column, prefix: str) -> list[Column]:
    """The tie statistics of an option's score among all ``scores`` of its signal (``levels``: each once, best first), NULL if it has none."""
    count = lambda is_: F.size(F.filter("scores", is_)).cast("long")
    least, equal = count(lambda x: x > own) + 1, count(lambda x: x == own)
    top, tied = F.get("levels", F.lit(0)), F.col("tied")
    second = F.when(F.size("levels") > 1, top - F.get("levels", F.lit(1))).otherwise(0.0)
    values = [own, least, least + (equal - 1) / 2, (own == top).cast("int"), ((own == top) & (tied == 1)).cast("int"), top, second, tied, (F.size("levels") == 1).cast("int"), ((F.size("levels") == 1) & (top == 0)).cast("int"), (top > 0).cast("int")]
    return [F.when(own.isNotNull(), v).alias(prefix + s) for s, v in zip(STATS, values, strict=True)]


def signal_rows(runs: DataFrame, signals: list[str]) -> DataFrame:
    """Runs with the tie statistics of their answer and of their prediction for every signal: columns gt_* and pred_*.

    ``runs`` brings each bundle's ``options`` along (pos, and a score a signal), so all comes from the run's own row and
    nothing is joined. Runs without an answer's score have no row.
    """
    known = [c for c in runs.columns if c != "options"]
    at = lambda s, pos: F.get(F.filter("options", lambda o: o["pos"] == F.col(pos)), F.lit(0))[s]
    of = lambda s: F.struct(F.lit(s).alias("signal"), F.sort_array(F.filter(F.transform("options", lambda o: o[s]), lambda x: x.isNotNull()), asc=False).alias("scores"), at(s, "true_pos").alias("gt"), at(s, "pred_pos").alias("pred"))
    each = runs.where("true_pos is not null").select(*known, F.explode(F.array(*[of(s) for s in signals])).alias("of")).where("of.gt is not null").select(*known, "of.*")
    each = each.withColumn("levels", F.array_distinct("scores"))
    each = each.withColumn("tied", F.size(F.filter("scores", lambda x: x == F.get("levels", F.lit(0)))).cast("long"))
    return each.select(*known, "signal", *_stats(F.col("gt"), "gt_"), *_stats(F.col("pred"), "pred_"))


def signal_quality(detail: DataFrame) -> DataFrame:
    once = detail.dropDuplicates(["signal", "bundle_id"])
    rate = {"gt_in_top_tie": "gt_in_top_tie_rate", "gt_unique_top1": "gt_unique_top1_rate", "gt_min_rank": "gt_mean_min_rank", "gt_avg_rank": "gt_mean_avg_rank", "gt_score": "gt_mean_score", "gt_top_score": "mean_top_score", "gt_top_tie_size": "mean_top_tie_size", "gt_all_zero": "all_zero_rate", "gt_all_tied": "all_tied_rate", "gt_positive_signal": "positive_signal_rate", "gt_second_margin": "mean_top_second_margin"}
    return once.groupBy("signal").agg(F.count("*").alias("n"), *[F.avg(c).alias(a) for c, a in rate.items()])


def method_reliance(detail: DataFrame) -> DataFrame:
    valid = F.col("pred_min_rank").isNotNull()
    when = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    positive = F.col("gt_positive_signal") == 1
    return detail.groupBy("method", "signal").agg(
        F.count("*").alias("n"), F.count_if(valid).alias("valid_pred_n"), F.avg("hit").alias("accuracy"), when(valid, "pred_in_top_tie").alias("pred_in_top_tie_rate"), when(valid, "pred_unique_top1").alias("pred_unique_top1_rate"), when(valid, "pred_min_rank").alias("pred_mean_min_rank"), when(valid, "pred_avg_rank").alias("pred_mean_avg_rank"), when(valid, "pred_score").alias("pred_mean_score"),
        when(F.col("pred_in_top_tie") == 1, "hit").alias("hit_when_pred_in_top_tie"), when(F.col("pred_in_top_tie") == 0, "hit").alias("hit_when_pred_not_in_top_tie"), when(positive, "pred_in_top_tie").alias("pred_in_top_tie_rate_when_positive"), when(positive, "pred_unique_top1").alias("pred_unique_top1_rate_when_positive"),
    )


def signal_quadrants(detail: DataFrame) -> DataFrame:
    valid = detail.where("pred_min_rank is not null")
    side = lambda c, p: F.when(F.col(c) == 1, f"{p}_top").otherwise(f"{p}_not_top")
    return valid.groupBy("method", "signal", side("gt_in_top_tie", "gt").alias("gt_cf_group"), side("pred_in_top_tie", "pred").alias("pred_cf_group")).agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("gt_avg_rank").alias("mean_gt_avg_rank"), F.avg("pred_avg_rank").alias("mean_pred_avg_rank"), F.avg("gt_top_tie_size").alias("mean_top_tie_size"))


def _pairs(rows: DataFrame, names: list[str], keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both methods of each pair, in the order of ``names``: columns left_* and right_*. Methods of a key meet in one row, so no side is broadcast."""
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    own = F.struct(order[F.col("method")].alias("i"), "method", *columns)
    met = rows.where(F.col("method").isin(names)).groupBy(*keys).agg(F.collect_list(own).alias("_of"))
    left = met.select(*keys, "_of", F.explode("_of").alias("_l"))
    both = left.select(*keys, "_l", F.explode(F.filter("_of", lambda r: r["i"] > F.col("_l.i"))).alias("_r"))
    return both.select(*keys, *[F.col(f"{p}.{c}").alias(f"{q}_{c}") for p, q in (("_l", "left"), ("_r", "right")) for c in ("method", *columns)])


def _cells(left: Column, right: Column) -> dict[str, Column]:
    return {"both_hit": (left == 1) & (right == 1), "both_fail": (left == 0) & (right == 0), "left_only": (left == 1) & (right == 0), "right_only": (left == 0) & (right == 1)}


def signal_pairwise(detail: DataFrame, names: list[str]) -> DataFrame:
    both = _pairs(detail, names, ["signal", "bundle_id"], ["hit", "gt_in_top_tie", "gt_unique_top1", "gt_avg_rank", "pred_in_top_tie", "pred_unique_top1", "pred_avg_rank"])
    cells = _cells(F.col("left_hit"), F.col("right_hit"))
    only = lambda c: F.avg(F.when(cells["right_only"], F.col(f"right_{c}")))
    return both.groupBy("signal", "left_method", "right_method").agg(
        F.count("*").alias("n"), F.avg("left_hit").alias("left_accuracy"), F.avg("right_hit").alias("right_accuracy"), *[F.count_if(v).alias(k) for k, v in cells.items()],
        only("gt_in_top_tie").alias("right_only_gt_in_top_tie_rate"), only("gt_unique_top1").alias("right_only_gt_unique_top1_rate"), only("pred_in_top_tie").alias("right_only_pred_in_top_tie_rate"), only("pred_unique_top1").alias("right_only_pred_unique_top1_rate"), only("gt_avg_rank").alias("right_only_mean_gt_avg_rank"), only("pred_avg_rank").alias("right_only_mean_pred_avg_rank"),
    )


def pairwise(runs: DataFrame, names: list[str]) -> DataFrame:
    both = _pairs(runs, names, ["bundle_id"], ["hit"]).where("left_hit is not null and right_hit is not null")
    return both.groupBy("left_method", "right_method").agg(F.count("*").alias("n"), F.avg("left_hit").alias("left_acc"), F.avg("right_hit").alias("right_acc"), *[F.count_if(v).alias(k) for k, v in _cells(F.col("left_hit"), F.col("right_hit")).items()])


def run_metrics(runs: DataFrame, n_options: int = 10) -> DataFrame:
    """Metrics of each method from ranks; predictions without a rank count as misses."""
    valid = F.col("pred_pos").isNotNull()
    return runs.groupBy("method").agg(
        F.count("*").alias("n"), F.avg("hit").alias("hit_rate"), F.avg(valid.cast("int")).alias("valid_ratio"), F.avg(F.when(valid, F.col("hit"))).alias("valid_hit_rate"), *[F.avg(X.hit("true_rank", k)).alias(f"hit_at_{k}") for k in (1, 3, 5)], F.avg(X.reciprocal("true_rank")).alias("mrr"), *[F.avg(X.ndcg("true_rank", k)).alias(f"ndcg_at_{k}") for k in (3, 5, min(10, n_options))], F.avg("true_rank").alias("mean_rank"), F.median("true_rank").alias("median_rank")
    )


# --- joint outcomes -------------------------------------------------------------------------------------------------
def joint(runs: DataFrame, names: list[str]) -> DataFrame:
    """One row a bundle: hit of each method, how many hit, and the outcome (all_hit, all_fail, mixed, invalid)."""
    wide = runs.groupBy("bundle_id").pivot("method", names).agg(F.first("hit"))
    hits = [F.col(f"`{n}`") for n in names]
    valid = reduce(lambda a, b: a & b, [h.isNotNull() for h in hits])
    total = reduce(lambda a, b: a + b, [F.coalesce(h, F.lit(0)) for h in hits])
    out = wide.withColumn("valid", valid.cast("int")).withColumn("hit_count", total)
    outcome = F.when(F.col("valid") == 0, "invalid").when(F.col("hit_count") == len(names), "all_hit").when(F.col("hit_count") == 0, "all_fail").otherwise("mixed")
    return out.withColumn("joint_outcome", outcome)


def joint_summary(joined: DataFrame, names: list[str]) -> DataFrame:
    valid = joined.where("valid = 1")
    total = valid.agg(F.count("*").alias("t"))
    return valid.groupBy("joint_outcome").agg(F.count("*").alias("n"), *[F.avg(f"`{n}`").alias(f"{n}_acc") for n in names]).join(F.broadcast(total)).withColumn("rate", F.col("n") / F.col("t")).drop("t")


def joint_by(joined: DataFrame, column: str) -> DataFrame:
    """Outcomes by the value of a column; rows without a value don't count."""
    is_ = lambda o: (F.col("joint_outcome") == o)
    return joined.where(f"valid = 1 and {column} is not null").groupBy(column).agg(F.count("*").alias("n"), *[x for o in ("all_hit", "all_fail", "mixed") for x in (F.count_if(is_(o)).alias(o), F.avg(is_(o).cast("int")).alias(f"{o}_rate"))], F.avg("hit_count").alias("mean_hit_count"))


def joint_by_tags(joined: DataFrame, primary: str, secondary: str) -> DataFrame:
    """Outcomes by tag, primary or secondary; a sample counts once for each of its tags."""
    tags = F.array_distinct(F.filter(F.concat(F.array(primary), F.coalesce(F.col(secondary), F.array().cast("array<string>"))), lambda t: t.isNotNull()))
    return joint_by(joined.withColumn("tag", F.explode(tags)), "tag")


# --- views, oracle, regret ------------------------------------------------------------------------------------------
def views(runs: DataFrame, names: list[str], best_fixed: str) -> DataFrame:
    """One row a bundle with all ranks: oracle and worst rank, winners, regret of the fixed view, hits of each view."""
    wide = runs.groupBy("bundle_id").pivot("method", names).agg(F.first("true_rank"))
    wide = reduce(lambda df, n: df.where(F.col(f"`{n}`").isNotNull()), names, wide)
    ranks = [F.col(f"`{n}`") for n in names]
    out = wide.withColumn("oracle_rank", F.least(*ranks)).withColumn("worst_rank", F.greatest(*ranks))
    winners = F.filter(F.array(*[F.when(r == F.col("oracle_rank"), F.lit(n)) for n, r in zip(names, ranks, strict=True)]), lambda x: x.isNotNull())
    out = out.withColumn("_w", winners).withColumn("rank_gap", F.col("worst_rank") - F.col("oracle_rank")).withColumn("oracle_winners", F.array_join("_w", "|")).withColumn("num_winners", F.size("_w").cast("long")).withColumn("unique_winner", F.when(F.size("_w") == 1, F.get("_w", F.lit(0))).otherwise("Tie")).drop("_w")
    out = out.withColumn("regret", F.col(f"`{best_fixed}`") - F.col("oracle_rank"))
    for k in (1, 3, 5):
        hits = F.filter(F.array(*[F.when(r <= k, F.lit(n)) for n, r in zip(names, ranks, strict=True)]), lambda x: x.isNotNull())
        out = out.withColumn(f"pattern_{k}", F.when(F.size(hits) > 0, F.array_join(hits, "|")).otherwise("None")).withColumn(f"num_hits_{k}", F.size(hits).cast("long"))
    return out


def best_fixed(runs: DataFrame) -> DataFrame:
    """The best method by mrr, hit@1, ndcg@10; one row."""
    return run_metrics(runs).orderBy(F.desc("mrr"), F.desc("hit_at_1"), F.desc("ndcg_at_10"), "method").limit(1)


def distribution(per: DataFrame, column: str) -> DataFrame:
    total = per.agg(F.count("*").alias("t"))
    return per.groupBy(column).agg(F.count("*").alias("count")).join(F.broadcast(total)).select(column, "count", (F.col("count") / F.col("t")).alias("ratio"))


def success_patterns(per: DataFrame) -> DataFrame:
    """Which views hit together at 1, 3 and 5."""
    long = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"pattern_{k}").alias("success_pattern"), F.col(f"num_hits_{k}").alias("num_successful_views")) for k in (1, 3, 5)])).alias("x")).select("x.*")
    total = per.agg(F.count("*").alias("t"))
    return long.groupBy("k", "success_pattern", "num_successful_views").agg(F.count("*").alias("count")).join(F.broadcast(total)).withColumn("ratio", F.col("count") / F.col("t")).drop("t")


def hit1_margins(per: DataFrame, names: list[str]) -> DataFrame:
    """For the samples that each view ranks first: the other views' best and worst ranks."""
    each = []
    for n in names:
        others = [F.col(f"`{o}`") for o in names if o != n]
        best, worst = F.least(*others), F.greatest(*others)
        each.append(per.where(F.col(f"`{n}`") == 1).select(F.lit(n).alias("view"), best.alias("best"), worst.alias("worst"), "num_hits_1"))
    rows = reduce(DataFrame.unionByName, each)
    share = lambda c: F.avg(c.cast("int"))
    return rows.groupBy("view").agg(
        F.count("*").alias("hit_at_1_count"), F.count_if(F.col("num_hits_1") == 1).alias("focal_only_count"), share(F.col("num_hits_1") == 1).alias("focal_only_ratio"), F.count_if(F.col("num_hits_1") == 2).alias("shared_with_one"), F.count_if(F.col("num_hits_1") == 3).alias("shared_with_two"),
        F.avg("best").alias("best_other_mean"), F.median("best").alias("best_other_median"), F.avg(F.col("best") - 1).alias("margin_mean"), F.count_if(F.col("best") >= 3).alias("best_other_ge_3"), F.count_if(F.col("best") >= 5).alias("best_other_ge_5"), F.avg("worst").alias("worst_other_mean"), F.median("worst").alias("worst_other_median"),
    )


def rank_pairwise(per: DataFrame, names: list[str]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [per.select(F.lit(a).alias("view_a"), F.lit(b).alias("view_b"), F.col(f"`{a}`").alias("ra"), F.col(f"`{b}`").alias("rb")) for a, b in combinations(names, 2)])
    return rows.groupBy("view_a", "view_b").agg(F.count_if(F.col("ra") < F.col("rb")).alias("a_better"), F.count_if(F.col("rb") < F.col("ra")).alias("b_better"), F.count_if(F.col("ra") == F.col("rb")).alias("ties"), F.avg(F.col("ra") - F.col("rb")).alias("mean_delta"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("mean_abs_delta"))


def regret_summary(per: DataFrame) -> DataFrame:
    return per.agg(F.avg("regret").alias("mean_regret"), F.median("regret").alias("median_regret"), F.count_if(F.col("regret") > 0).alias("gt_0_count"), F.avg((F.col("regret") > 0).cast("int")).alias("gt_0_ratio"), F.count_if(F.col("regret") >= 3).alias("ge_3_count"), F.avg((F.col("regret") >= 3).cast("int")).alias("ge_3_ratio"), F.max("regret").alias("max_regret"))


def unique_hit_ranks(per: DataFrame, names: list[str]) -> DataFrame:
    """Where one view alone is right: the other views' mean and median ranks, long."""
    rows = reduce(DataFrame.unionByName, [per.where((F.col(f"`{n}`") == 1) & (F.col("num_hits_1") == 1)).select(F.lit(n).alias("unique_view"), F.lit(o).alias("other_view"), F.col(f"`{o}`").alias("r")) for n in names for o in names if o != n])
    return rows.groupBy("unique_view", "other_view").agg(F.count("*").alias("count"), F.avg("r").alias("avg_rank"), F.median("r").alias("median_rank"))


def largest_gaps(per: DataFrame, names: list[str], k: int) -> DataFrame:
    """For each view the ``k`` samples that it ranks first and the others rank lowest."""
    each = []
    for n in names:
        others = [F.col(f"`{o}`") for o in names if o != n]
        each.append(per.where(F.col(f"`{n}`") == 1).select(F.lit(n).alias("view"), "bundle_id", (F.least(*others) - 1).alias("margin"), F.greatest(*others).alias("worst_other")))
    place = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("margin"), F.desc("worst_other"), "bundle_id")).cast("long")
    return reduce(DataFrame.unionByName, each).withColumn("place", place).where(F.col("place") <= k)


# --- two runs, difficulty -------------------------------------------------------------------------------------------
def group_of(a: Column, b: Column) -> Column:
    """A_Hit_Only and so on; whatever matches nothing else is B_Hit_Only."""
    return F.when((a == 1) & (b == 1), "Both_Hit").when((a == 0) & (b == 0), "Both_Miss").when((a == 1) & (b == 0), "A_Hit_Only").otherwise("B_Hit_Only")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    joined = a.select("bundle_id", F.col("hit").alias("x")).join(b.select("bundle_id", F.col("hit").alias("y")), "bundle_id")
    return distribution(joined.select(group_of(F.col("x"), F.col("y")).alias("group")), "group")


def difficulty(rows: DataFrame) -> DataFrame:
    """By difficulty: totals, hits, misses, accuracy and share of all errors in percent."""
    per = rows.groupBy("difficulty").agg(F.count("*").alias("total"), F.sum("hit").alias("hits"), (F.count("*") - F.sum("hit")).alias("misses"))
    every = F.sum("misses").over(Window.partitionBy())
    return per.select("difficulty", "total", "hits", "misses", F.round(100 * F.col("hits") / F.col("total"), 1).alias("accuracy"), F.round(F.coalesce(F.try_divide(100 * F.col("misses"), every), F.lit(0.0)), 1).alias("error_share"))


def input_count_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy by method and number of inputs, with an overall row each, wide by method."""
    long = rows.rollup("method", "inputs").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.grouping("inputs").alias("g")).where("method is not null")
    label = F.when(F.col("g") == 1, "overall").otherwise(F.col("inputs").cast("string"))
    return long.select("method", label.alias("inputs"), "n", "accuracy")


def first_choices(lists: DataFrame, second: str) -> DataFrame:
    """Best option by score, ties by ``second``, then position, from rows (method, bundle_id, options). Rows (method, bundle_id, pos, item_id, is_gt)."""
    best = F.array_max(F.transform("options", lambda o: F.struct(o["score"], o[second], (-o["pos"]).alias("place"), o["item_id"].alias("item_id"), o["is_gt"].alias("is_gt"))))
    return lists.select("method", "bundle_id", best.alias("best")).select("method", "bundle_id", (-F.col("best.place")).alias("pos"), "best.item_id", "best.is_gt")
