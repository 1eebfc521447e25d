"""Co-occurrence graphs as coordinate tables; sparse products are join and aggregate plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.shared import stash


def cooccurrence(rows: DataFrame, group: str, node: str, weight: Column | None = None) -> DataFrame:
    """Rows (a, b, n), a <> b: sum over groups of the product of weights (1 by default)."""
    w = weight if weight is not None else F.lit(1)
    left = rows.select(F.col(group).alias("g"), F.col(node).alias("a"), w.alias("wa"))
    right = rows.select(F.col(group).alias("g"), F.col(node).alias("b"), w.alias("wb"))
    return left.join(right, "g").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("n"))


#: Members of a group that travel in one row, pairs that a task makes, and pairs whose rows are on disk at once.
HELD, PAIRS, PASS = 512, 4_000_000, 1 << 30

#: Shuffle files go when the statement that wrote them has ended, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _lists(rows: DataFrame, group: str, node: str, wanted: DataFrame | None) -> tuple[DataFrame, float]:
    """Rows (g, held, asked, cuts): a group's members, and those of ``wanted``, in rows of about ``HELD``, with the number of these; and how many pairs that makes."""
    each = rows.where(F.col(node).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(node).alias("a"))
    pairs = each.groupBy("g").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
    marked = each if wanted is None else each.join(wanted.distinct().withColumn("w", F.lit(True)), "a", "left")
    cuts = F.ceil(F.col("c") / HELD).cast("int")
    sized = marked.withColumn("c", F.count("*").over(Window.partitionBy("g"))).withColumn("cuts", cuts)
    lists = sized.groupBy("g", F.pmod(F.xxhash64("a"), "cuts").alias("cut")).agg(F.array_sort(F.collect_list("a")).alias("held"), *([] if wanted is None else [F.collect_list(F.when(F.col("w"), F.col("a"))).alias("asked")]), F.max("cuts").alias("cuts"))
    return lists if wanted is not None else lists.withColumn("asked", F.col("held")), pairs


def _spread(lists: DataFrame, parts: int, part: Column | None = None) -> DataFrame:
    """Rows (g, a, b) of the lists' groups, of the ``a`` for which ``part`` holds."""
    one = lists.where("cuts = 1").select("g", "held", F.explode("asked").alias("a"))
    several = lists.where("cuts > 1")
    cross = several.select("g", F.explode("asked").alias("a")).join(several.select("g", "held"), "g").select("g", "held", "a")
    met = one.unionByName(cross)
    met = met if part is None else met.where(part)
    return met.repartition(parts, "a").select("g", "a", F.explode("held").alias("b")).where("a <> b")


def _parts(spark, pairs: float) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS) + 1)


def spread_pairs(rows: DataFrame, group: str, node: str, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (g, a, b), a <> b: nodes of one group, those of ``wanted`` (a) against all, dealt by ``a``.

    What is shuffled is a row for each node and group with the group's members in it, not a row for each pair; the pairs
    are made where they are counted, so grouping by ``a`` or by (a, b) shuffles nothing more. Groups of many members are cut
    into several rows.
    """
    lists, pairs = _lists(rows, group, node, wanted)
    return _spread(lists, _parts(rows.sparkSession, pairs))


def pairs_in_turn(rows: DataFrame, group: str, node: str, of: Callable[[DataFrame], DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """``of`` the :func:`spread_pairs`, which must keep to one ``a`` (grouped by it, ranked within it).

    Where there are more than ``PASS`` pairs, the nodes ``a`` are dealt to shares that take turns: a share's result is stored and
    its shuffle files are deleted before the next one begins. Every pair is met once, and the disk holds one share of them.
    """
    spark = rows.sparkSession
    lists, pairs = _lists(rows, group, node, wanted)
    turns = int(pairs // PASS) + 1
    if turns == 1:
        return of(_spread(lists, _parts(spark, pairs)))
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        lists = stash(lists.drop("cut"), "group-lists")
        share = lambda i: F.pmod(F.xxhash64("a", F.lit(7)), F.lit(turns)) == i
        return reduce(DataFrame.unionByName, [stash(of(_spread(lists, _parts(spark, pairs / turns), share(i))), "pairs-in-turn") for i in range(turns)])
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def _ordered_pairs(groups: DataFrame) -> DataFrame:
    """Rows (low, high) for each pair of a group's sorted distinct members (``held``), each member with itself too."""
    low = groups.select("held", F.posexplode("held").alias("i", "low"))
    return low.select("low", F.explode(F.slice("held", F.col("i") + 1, F.size("held"))).alias("high"))


#: Training bundles of an item up to which each meets the item's options; pairs with more frequent items are counted first.
OFTEN = 256


def shared_groups(options: DataFrame, inputs: DataFrame, train: DataFrame, widest: int = 32) -> DataFrame:
    """Rows (bundle_id, item_id, n): how many times an option and an input of its bundle stand in one training bundle; none where never.

    A bundle's options travel in one row with each input and meet one row an item, with the items of all its training bundles, so
    no pair is dealt or sorted and only options that stand in such a bundle are counted. For inputs in more than ``OFTEN`` training bundles pairs are made in one order, counted, and
    looked up; in training bundles of more than ``widest`` items an option meets the inputs on bundles that hold both, so that
    co-items that are no options are never made.
    """
    train = train.select(F.col("bundle_id").alias("b"), "item_id")
    # one shuffle tells wide bundles and makes the rows of all others: no more than one item beyond ``widest`` is kept of a bundle
    place = F.row_number().over(Window.partitionBy("b").orderBy("item_id"))
    some = train.repartition("b").withColumn("place", place).where(F.col("place") <= widest + 1)
    sets = stash(some.groupBy("b").agg(F.collect_set("item_id").alias("held"), F.max("place").alias("size")), "training-bundles")
    narrow, broad = sets.where(F.col("size") <= widest).select("held"), sets.where(F.col("size") > widest).select("b")
    has_wide = not broad.isEmpty()
    each = narrow.select("held", F.explode("held").alias("given"))
    often = stash(each.groupBy("given").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN).select("given"), "frequent-items")
    has_often = not often.isEmpty()
    given = inputs.select("bundle_id", F.col("item_id").alias("given"))
    lists = options.groupBy("bundle_id").agg(F.collect_list("item_id").alias("wanted"))
    rare = given.join(often, "given", "left_anti") if has_often else given
    asked = rare.join(lists.hint("merge"), "bundle_id").select("given", "bundle_id", "wanted")
    near = (each.join(often, "given", "left_anti") if has_often else each).groupBy("given").agg(F.flatten(F.collect_list("held")).alias("near"))
    met = asked.join(near.hint("merge"), "given").where(F.arrays_overlap("wanted", "near"))
    found = met.select("bundle_id", "near", F.explode(F.array_intersect("wanted", "near")).alias("item_id"))
    found = found.select("bundle_id", "item_id", (F.size("near") - F.size(F.array_remove("near", F.col("item_id")))).cast("long").alias("n"))
    if has_often:
        pairs = _ordered_pairs(narrow.select(F.array_sort("held").alias("held"))).groupBy("low", "high").agg(F.count("*").alias("n"))
        ask = options.select("bundle_id", "item_id").join(given.join(often, "given", "left_semi"), "bundle_id")
        ask = ask.select("bundle_id", "item_id", F.least("item_id", "given").alias("low"), F.greatest("item_id", "given").alias("high"))
        found = found.unionByName(ask.join(pairs, ["low", "high"]).select("bundle_id", "item_id", "n"))
    if has_wide:
        wide = train.join(broad, "b", "left_semi").distinct()
        held = options.select("bundle_id", "item_id").join(wide, "item_id")
        of = inputs.select("bundle_id", "item_id").join(wide, "item_id").groupBy("bundle_id", "b").agg(F.count("*").alias("n"))
        found = found.unionByName(held.join(of, ["bundle_id", "b"]).select("bundle_id", "item_id", "n"))
    return found.groupBy("bundle_id", "item_id").agg(F.sum("n").alias("n"))


def soft_expansion(hard: DataFrame, links: DataFrame, bi: DataFrame, alpha: float) -> DataFrame:
    """Item pairs of a hard graph plus ``alpha`` for each bundle that an item is softly linked with and the other is in."""
    soft = links.select(F.col("item_id").alias("a"), "bundle_id").join(bi.select("bundle_id", F.col("item_id").alias("b")), "bundle_id").where("a <> b").groupBy("a", "b").agg((F.count("*") * F.lit(alpha)).alias("w"))
    return hard.select("a", "b", F.col("n").cast("double").alias("w")).unionByName(soft).groupBy("a", "b").agg(F.sum("w").alias("w"))


def category_graph(bc: DataFrame) -> DataFrame:
    """Rows (a, b, count_w, binary_w) with the diagonal, both directions."""
    left = bc.select("bundle_id", F.col("category").alias("a"), F.col("n").alias("na"))
    right = bc.select("bundle_id", F.col("category").alias("b"), F.col("n").alias("nb"))
    return left.join(right, "bundle_id").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("count_w"), F.count("*").alias("binary_w"))


def transforms(cc: DataFrame, weight: str) -> DataFrame:
    """Rows (a, b, raw, conditional, ppmi) off the diagonal; the conditional divides by the diagonal of a."""
    diagonal = cc.where("a = b").select("a", F.col(weight).alias("d"))
    off = cc.where(f"a <> b and {weight} > 0").select("a", "b", F.col(weight).cast("double").alias("w"))
    sums = off.groupBy("a").agg(F.sum("w").alias("s"))
    total = off.agg(F.sum("w").alias("t"))
    joined = off.join(diagonal, "a", "left").join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b").join(F.broadcast(total))
    log = F.log(F.col("w") * F.col("t") / (F.col("s") * F.col("sb")))
    return joined.select("a", "b", F.col("w").alias("raw"), F.when(F.col("d") > 0, F.col("w") / F.col("d")).otherwise(0.0).alias("conditional"), F.greatest(log, F.lit(0.0)).alias("ppmi"))


def pair_table(cc: DataFrame) -> DataFrame:
    """Pairs a < b with frequencies, conditionals, and lift normalised by the largest diagonal; PMI is natural."""
    freq = cc.where("a = b").select(F.col("a").alias("c"), F.col("binary_w").cast("double").alias("f"))
    top = freq.agg(F.greatest(F.max("f"), F.lit(1.0)).alias("n"))
    of = lambda x: freq.select(F.col("c").alias(x), F.col("f").alias(f"f{x}"))
    joined = cc.where("a < b").join(of("a"), "a").join(of("b"), "b").join(F.broadcast(top))
    up = F.col("binary_w") * F.col("n") / (F.col("fa") * F.col("fb"))
    return joined.select("a", "b", "count_w", "binary_w", (F.col("binary_w") / F.col("fa")).alias("p_b_given_a"), (F.col("binary_w") / F.col("fb")).alias("p_a_given_b"), up.alias("lift"), F.log(up).alias("pmi"), F.greatest(F.log(up), F.lit(0.0)).alias("ppmi"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.orderBy(F.desc("binary_w"), F.desc("count_w"), "a", "b").limit(k)


def neighbours(graph: DataFrame, weight: str, k: int) -> DataFrame:
    """The ``k`` strongest neighbours of each node with their rank; ties by name."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(weight), "b")).cast("long")
    return graph.withColumn("place", place).where(F.col("place") <= k)


def _lowest(both: DataFrame, turn: int) -> DataFrame:
    """Rows (node, to): the lowest ranked of each node and its neighbours, by the nodes themselves in even rounds, by a hash that is new each time in odd ones."""
    if turn % 2 == 0:
        return both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
    rank = lambda x: F.struct(F.xxhash64(x, F.lit(turn)).alias("by"), F.col(x).alias("node"))
    return both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("node"), F.least(rank("a"), "best")["node"].alias("to"))


def link_components(links: DataFrame, counted: list[int] | None = None) -> DataFrame:
    """Rows (node, label) for every node of ``links`` (columns a and b): label is the least node of its component.

    Each round every node goes to the lowest ranked of itself and its neighbours, and the links are contracted. By the
    nodes' own order a star ends in one round; by random ranks, every other round, any graph loses a constant share of
    its nodes in expectation, so the rounds are logarithmic for long chains too. Minima are pre-aggregated, so a node with
    many links is no hot key, and each round is cut off by a stored table. ``counted`` gets the number of each round.
    """
    edges = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stash(_lowest(both, turn), "step")
        moved = step.where("node <> to")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            labels = stash(labels.join(moved.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = edges.join(moved.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a", "left").join(moved.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b", "left")
        left = left.select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")).where("x <> y")
        edges = stash(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if counted is not None:
            counted.append(turn)
        if edges.isEmpty():
            break
        turn += 1
    if turn == 0:
        return labels
    least = labels.groupBy("label").agg(F.min("node").alias("least")).where("least <> label")
    return stash(labels.join(least, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, label), label the least node of the component, nodes without edges included."""
    labels = link_components(edges.select("a", "b"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def graph_stats(categories: DataFrame, cc: DataFrame, weight: str) -> DataFrame:
    """One row: edges, density, degrees, weights, components, isolated nodes."""
    nodes = categories.select(F.col("category").alias("node")).distinct()
    off = cc.where(f"a <> b and {weight} > 0")
    labels = components(nodes, off)
    degree = nodes.join(off.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum(weight).alias("weighted")), "node", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted", F.lit(0)).alias("weighted"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    parts = [
        degree.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("degree_avg"), F.median("degree").alias("degree_median"), F.max("degree").alias("degree_max"), F.avg("weighted").alias("weighted_avg"), F.max("weighted").alias("weighted_max"), (F.sum("weighted") / 2).alias("total_weight")),
        cc.where(f"a = b and {weight} > 0").agg(F.count("*").alias("diagonal")),
        sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest_component"), F.count_if(F.col("size") == 1).alias("isolated")),
    ]
    joined = reduce(lambda x, y: x.join(F.broadcast(y)), parts)
    return joined.withColumn("density", F.coalesce(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1) / 2), F.lit(0.0)))


def profile_scores(observed: DataFrame, profile: DataFrame, value: str) -> DataFrame:
    """Rows (bundle_id, category, score): mean of the profile rows of a bundle's observed categories, those excluded."""
    size = observed.groupBy("bundle_id").agg(F.count("*").alias("size"))
    rows = profile.select("a", F.col("b").alias("target"), F.col(value).alias("v"))
    spread = observed.join(rows, observed["category"] == rows["a"]).groupBy("bundle_id", "target").agg(F.sum("v").alias("s"))
    return spread.join(size, "bundle_id").select("bundle_id", F.col("target").alias("category"), (F.col("s") / F.col("size")).alias("score")).join(observed, ["bundle_id", "category"], "left_anti")
