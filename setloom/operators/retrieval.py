"""Context for a sample: similar bundles, users, evidence and examples, first as rows, then as text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.operators import bundles
from setloom.operators.neighbours import Index
from setloom.shared import stash


def _first(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("place") <= k)


def bundle_context(inputs: DataFrame, train: DataFrame, k: int, seed: int, soft: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """The ``k`` training bundles that share most items with a sample's inputs, then by summed idf, then drawn.

    With soft links a bundle's score is its overlap plus ``alpha`` for each input that is softly linked with it, and
    comes before the overlap.
    """
    weights = bundles.idf(train)
    hard = inputs.join(train.select("item_id", F.col("bundle_id").alias("context")), "item_id").join(weights, "item_id").groupBy("bundle_id", "context").agg(F.count("*").alias("overlap"), F.sum("idf").alias("idf"))
    draw = X.draw(seed, "bundle_id", "context")
    if soft is None:
        return _first(hard.withColumn("idf", F.round("idf", 9)), ["bundle_id"], [F.desc("overlap"), F.desc("idf"), draw, "context"], k)
    loose = inputs.join(soft.select("item_id", F.col("bundle_id").alias("context")), "item_id").groupBy("bundle_id", "context").agg(F.count("*").alias("soft_hits"))
    both = hard.join(loose, ["bundle_id", "context"], "full_outer").select("bundle_id", "context", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("soft_hits", F.lit(0)).alias("soft_hits"), F.round(F.coalesce("idf", F.lit(0.0)), 9).alias("idf"))
    scored = both.withColumn("score", F.col("overlap") + alpha * F.col("soft_hits"))
    return _first(scored, ["bundle_id"], [F.desc("score"), F.desc("overlap"), F.desc("soft_hits"), F.desc("idf"), draw, "context"], k)


def shared_bundles(samples: DataFrame, inputs: DataFrame, train: DataFrame) -> DataFrame:
    """For each option: training bundles with it and any input, bundles with it, and size of the inputs' union."""
    union = inputs.join(train.select("item_id", F.col("bundle_id").alias("b")), "item_id").select("bundle_id", "b").distinct()
    held = samples.join(train.select("item_id", F.col("bundle_id").alias("b")), "item_id").select("bundle_id", "pos", "item_id", "b")
    met = held.join(union.withColumn("_u", F.lit(1)), ["bundle_id", "b"], "left").groupBy("bundle_id", "pos", "item_id").agg(F.count("_u").alias("shared"), F.count("*").alias("bundles"))
    size = union.groupBy("bundle_id").agg(F.count("*").alias("input_bundles"))
    return samples.select("bundle_id", "pos", "item_id", "is_gt").join(met, ["bundle_id", "pos", "item_id"], "left").join(size, "bundle_id", "left").select("bundle_id", "pos", "item_id", "is_gt", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shared", "bundles", "input_bundles")])


def nearest_users(inputs: DataFrame, ui: DataFrame, excluded: DataFrame, seed: int) -> DataFrame:
    """The user who shares most items with a sample's inputs and has history beyond ``excluded``; ties drawn.

    A user with more items than a sample excludes has history beyond them, so only the others' items are looked at. Rows
    (bundle_id, user_id, overlap, ties).
    """
    barred = excluded.select("bundle_id", "item_id").distinct()
    sized = ui.select("user_id", "item_id").join(ui.groupBy("user_id").agg(F.count_distinct("item_id").alias("size")), "user_id")
    met = inputs.select("bundle_id", "item_id").join(sized, "item_id").select("bundle_id", "user_id", "size").repartition("bundle_id")
    met = met.groupBy("bundle_id", "user_id").agg(F.count("*").alias("overlap"), F.max("size").alias("size"))
    every = met.join(barred.groupBy("bundle_id").agg(F.count("*").alias("barred")), "bundle_id", "left").withColumn("sure", F.col("size") > F.coalesce("barred", F.lit(0)))
    doubtful = every.where("not sure").select("bundle_id", "user_id", "overlap")
    history = doubtful.join(ui, "user_id").join(barred, ["bundle_id", "item_id"], "left_anti").select("bundle_id", "user_id").distinct()
    best = F.min(F.struct(X.draw(seed, "bundle_id", "user_id").alias("draw"), "user_id")).alias("best")
    tied = lambda rows: rows.groupBy("bundle_id", "overlap").agg(F.count("*").alias("ties"), best)
    levels = tied(every.where("sure")).unionByName(tied(doubtful.join(history, ["bundle_id", "user_id"], "left_semi")))
    levels = levels.groupBy("bundle_id", "overlap").agg(F.sum("ties").alias("ties"), F.min("best").alias("best"))
    top = levels.groupBy("bundle_id").agg(F.max(F.struct("overlap", "ties", "best")).alias("top"))
    return top.select("bundle_id", "top.best.user_id", "top.overlap", "top.ties")


def user_history(chosen: DataFrame, ui: DataFrame, excluded: DataFrame, inputs: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The ``k`` items of the chosen user's history most similar to the mean input. Rows (bundle_id, user_id, item_id, score, place)."""
    from setloom.operators.vectors import dimension, mean_vectors

    unit = vectors.select("item_id", X.unit("embedding").alias("v"))
    mean = mean_vectors(inputs.join(unit, "item_id"), ["bundle_id"], "v", dimension(vectors)).select("bundle_id", X.unit("v").alias("m"))
    known = ui.join(unit.select("item_id"), "item_id", "left_semi")
    left = chosen.select("bundle_id", "user_id").join(known, "user_id").join(excluded.select("bundle_id", "item_id").distinct(), ["bundle_id", "item_id"], "left_anti")
    scored = left.join(unit, "item_id").join(mean, "bundle_id").select("bundle_id", "user_id", "item_id", F.round(X.dot("v", "m"), digits).alias("score"))
    return _first(scored, ["bundle_id"], [F.desc("score"), "item_id"], k)


def similar_examples(queries: DataFrame, examples: DataFrame, options: DataFrame, digits: int = 9, first: int = 16) -> DataFrame:
    """Most similar example whose answer is no option of the query, with its rank before that filter.

    ``queries`` (bundle_id, v), ``examples`` (example, answer, w): unit vectors. An index gives the ``first`` examples of
    each query; queries whose answers are all options ask for eight times as many, until none is left or all were seen.
    """
    index = Index(examples.select("example", F.col("w").alias("embedding")), "example", digits)
    answers = stash(examples.select(F.col("example").alias("neighbour"), "answer"), "example-answers")
    taken = options.select("bundle_id", F.col("item_id").alias("answer")).distinct()
    left, out, total = stash(queries.select(F.col("bundle_id").alias("q"), "v"), "example-queries"), None, answers.count()
    while True:
        found = index.opened(index.top(left, first), first)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "neighbour")).cast("long")
        placed = found.withColumn("rank", place).where(F.col("rank") <= first).join(answers, "neighbour").select(F.col("q").alias("bundle_id"), F.col("neighbour").alias("example"), "answer", "score", "rank")
        best = stash(_first(placed.join(taken, ["bundle_id", "answer"], "left_anti"), ["bundle_id"], ["rank"], 1).drop("place"), "examples-found")
        out = best if out is None else out.unionByName(best)
        left = stash(left.join(best.select(F.col("bundle_id").alias("q")), "q", "left_anti"), "example-queries")
        if first >= total or left.isEmpty():
            return out.select("bundle_id", "example", "answer", "score", "rank")
        first *= 8


#: Subsets of training sets are indexed up to this size, and those that lack up to so many members; between, a set is looked up by its first members.
INDEXED, LACKING = 4, 3

#: Categories in one word of a mask; draws beyond those wanted that a bound on draws should let through; pairs of one task.
WORD, SPARE, PAIRS = 62, 16, 1 << 22


class _Sets:
    """Observed sets (``query``) against the distinct category sets of training bundles (``key``), by an index of the sets that hold a subset.

    Sets are masks of numbered categories, so a pair moves a few numbers. A query first meets the sets that hold all it
    has and its best category, and little else; what wider rounds could bring is bounded, and a query goes on only if that
    is not below its ``k``-th so far. The few that are left in the end meet every set that shares a category with them.
    """

    def __init__(self, observed: DataFrame, train_bc: DataFrame, prior: Callable[[DataFrame], DataFrame]):
        seen = stash(observed.select("bundle_id", "category").where("category is not null"), "observed-categories")
        held = stash(train_bc.select(F.col("bundle_id").alias("context"), "category").where("category is not null"), "set-categories")
        every = seen.select("category").unionByName(held.select("category")).distinct()
        self.numbers = stash(every.withColumn("c", F.row_number().over(Window.orderBy("category")) - 1), "category-numbers")  # one row a category
        self.n = self.numbers.count()
        self.words = range(max(1, -(-self.n // WORD)))
        self.members = stash(self._masks(held, "context", "m"), "set-members")
        sets = self.members.groupBy(*self._names("m")).agg(F.min("context").alias("key"), F.count("*").alias("size"))
        self.sets = stash(sets.withColumn("ids", self._ids("m")), "category-sets")
        self.largest = self.sets.agg(F.max(self._count("m"))).first()[0] or 0
        ids = F.col("ids")
        few = F.transform(self._subsets(ids, INDEXED), lambda x: F.struct(*[v.alias(p) for v, p in zip(self._mask(x), self._names("p"), strict=True)], (F.size(ids) - F.size(x)).alias("d")))
        lack = F.filter(self._with_none(ids, LACKING), lambda x: F.size(ids) - F.size(x) > INDEXED)
        most = F.transform(lack, lambda x: F.struct(*[F.col(m).bitwiseXOR(v).alias(p) for m, v, p in zip(self._names("m"), self._mask(x), self._names("p"), strict=True)], F.size(x).alias("d")))
        self.index = stash(self.sets.select("key", "size", *self._names("m"), F.inline(F.concat(few, most))), "set-index")
        bundles = stash(self._masks(seen, "bundle_id", "q"), "observed-masks")
        asked = stash(bundles.groupBy(*self._names("q")).agg(F.min("bundle_id").alias("query")).withColumn("ids", self._ids("q")), "observed-sets")
        self.queries = bundles.join(asked, self._names("q")).select("bundle_id", "query")
        one = asked.select(F.col("query").alias("bundle_id"), F.explode("ids").alias("c")).join(F.broadcast(self.numbers), "c").select("bundle_id", "category")
        scores = prior(stash(one, "observed-categories")).select(F.col("bundle_id").alias("query"), "category", F.col("score").alias("p"))
        best = scores.join(F.broadcast(self.numbers), "category").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("p", "c")), asc=False).alias("priors"))
        whole = asked.join(best, "query", "left").withColumn("nq", self._count("q")).withColumn("top", F.coalesce(F.get("priors", F.lit(0))["p"], F.lit(0.0)))
        self.asked = stash(whole, "queries")

    # --- masks
    def _names(self, prefix: str) -> list[str]:
        return [f"{prefix}{w}" for w in self.words]

    def _bits(self, c: Column) -> list[Column]:
        """The words of one category's mask."""
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (c % WORD).cast("int"))
        return [bit] if len(self.words) == 1 else [F.when(F.floor(c / WORD) == w, bit).otherwise(F.lit(0).cast("long")) for w in self.words]

    def _masks(self, rows: DataFrame, key: str, prefix: str) -> DataFrame:
        bits = self._bits(F.col("c"))
        return rows.join(F.broadcast(self.numbers), "category").groupBy(key).agg(*[F.bit_or(b).alias(n) for b, n in zip(bits, self._names(prefix), strict=True)])

    def _has(self, prefix: str, c: Column) -> Column:
        found = F.lit(False)
        for w, name in zip(self.words, self._names(prefix), strict=True):
            found = found | ((F.floor(c / WORD) == w) & (F.getbit(F.col(name), c % WORD) == 1))
        return found

    def _ids(self, prefix: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(max(0, self.n - 1))), lambda c: self._has(prefix, c))

    def _mask(self, ids: Column) -> list[Column]:
        return [F.aggregate(ids, F.lit(0).cast("long"), self._joined(w)) for w in self.words]

    def _joined(self, w: int) -> Callable[[Column, Column], Column]:
        return lambda a, c: a.bitwiseOR(self._bits(c)[w])

    def _count(self, prefix: str, other: str | None = None) -> Column:
        both = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.col(b)) if other else F.col(a))
        return reduce(lambda x, y: x + y, [both(a, b) for a, b in zip(self._names(prefix), self._names(other or prefix), strict=True)])

    @staticmethod
    def _subsets(ids: Column, largest: int) -> Column:
        levels = [F.transform(ids, lambda x: F.array(x))]
        for _ in range(largest - 1):
            levels.append(F.flatten(F.transform(levels[-1], lambda s: F.transform(F.filter(ids, lambda x: x > F.element_at(s, -1)), lambda x: F.array_append(s, x)))))
        return F.concat(*levels)

    def _with_none(self, ids: Column, largest: int) -> Column:
        return F.concat(F.array(F.slice(ids, 1, 0)), self._subsets(ids, largest)) if largest else F.array(F.slice(ids, 1, 0))

    # --- pairs
    def best(self, active: DataFrame) -> DataFrame:
        """Rows of queries with each category of the best prior (``c``)."""
        first = F.filter("priors", lambda e: F.round(e["p"], 9) == F.round("top", 9))
        return active.select("query", "nq", "ids", *self._names("q"), F.explode(F.transform(first, lambda e: e["c"])).alias("c"))

    def near(self, active: DataFrame, without: int, beyond: int, least: Column | None = None) -> DataFrame:
        """Pairs with sets that hold the best category, lack up to ``without`` observed ones (``least`` of them stay), and have so many others that these and the lacking are ``beyond`` at most."""
        ids = F.col("ids")
        gone = F.filter(self._with_none(ids, without), lambda x: F.size(ids) - F.size(x) >= (F.lit(1) if least is None else least))
        rows = self.best(active.where("nq > 0")).withColumn("gone", F.explode(gone))
        rows = rows.select("query", (beyond - F.size("gone")).alias("allowed"), *[F.col(q).bitwiseXOR(g).bitwiseOR(b).alias(p) for q, g, b, p in zip(self._names("q"), self._mask(F.col("gone")), self._bits(F.col("c")), self._names("p"), strict=True)])
        return rows.join(self.index, self._names("p")).where("d <= allowed").select("query", "key", "size", *self._names("m"))

    def holding(self, wanted: DataFrame) -> DataFrame:
        """Pairs of rows (query, part: category numbers) with the sets that hold the part."""
        n = F.size("part")
        looked = F.when((n <= INDEXED) | (n + LACKING >= self.largest), F.col("part")).otherwise(F.slice("part", 1, INDEXED))
        rows = wanted.where(n > 0).select("query", F.array_sort("part").alias("part")).distinct()
        rows = rows.select("query", *[v.alias(f) for v, f in zip(self._mask(F.col("part")), self._names("f"), strict=True)], *[v.alias(p) for v, p in zip(self._mask(looked), self._names("p"), strict=True)])
        whole = reduce(lambda x, y: x & y, [F.col(m).bitwiseAND(F.col(f)) == F.col(f) for m, f in zip(self._names("m"), self._names("f"), strict=True)])
        return rows.join(self.index, self._names("p")).where(whole).select("query", "key", "size", *self._names("m"))

    def sharing(self, active: DataFrame) -> DataFrame:
        """Pairs of sets with a common category."""
        return self.holding(active.select("query", F.explode(F.transform("ids", lambda c: F.array(c))).alias("part")))

    def valued(self, pairs: DataFrame, active: DataFrame) -> DataFrame:
        """Pairs once, with overlap, prior, jaccard, score, of sets that have categories beyond the observed ones and one of these."""
        once = pairs.repartition("query").dropDuplicates(["query", "key"])
        both = once.join(active, "query").withColumn("overlap", self._count("m", "q").cast("long")).withColumn("nc", self._count("m"))
        new = both.where((F.col("overlap") > 0) & (F.col("nc") > F.col("overlap")))
        rows = new.withColumn("p", F.coalesce(F.get(F.filter("priors", lambda e: self._has("m", e["c"])), F.lit(0))["p"], F.lit(0.0)))
        return rows.select("query", "key", "size", *self._names("m"), "nq", "top", "overlap", F.round("p", 9).alias("prior"), F.round(F.col("overlap") / (F.col("nq") + F.col("nc") - F.col("overlap")), 9).alias("jaccard"), F.round(F.col("p") * F.col("overlap") / F.col("nq"), 9).alias("score"))

    def search(self, rounds: list, order: list, k: int, weight: Column) -> DataFrame:
        """The sets of every query up to the level at which their weights reach ``k``, with its ties, and the weights up to and at each level (``upto``, ``level_size``).

        A round is the pairs of active queries to meet, and what must hold of the query and the ``k``-th set (``last``) for no
        later round to matter.
        """
        active, carried, out = self.asked, None, []
        of_query = Window.partitionBy("query")
        by = of_query.orderBy(*order)
        for i, (pairs, settled) in enumerate(rounds):
            every = self.valued(pairs(active), active)
            every = every if carried is None else every.unionByName(carried).dropDuplicates(["query", "key"])
            ranked = every.withColumn("r", F.rank().over(by)).withColumn("upto", F.sum(weight).over(by))
            level = F.min(F.when(F.col("upto") >= k, F.col("r"))).over(of_query)
            top = ranked.withColumn("k_r", level).where("k_r is null or r <= k_r")
            last = F.max(F.when(F.col("r") == F.col("k_r"), F.struct("overlap", "prior", "jaccard", "score"))).over(of_query)
            done = F.lit(True) if settled is None else F.col("last").isNotNull() & F.coalesce(settled, F.lit(False))
            found = stash(top.withColumn("last", last).withColumn("done", done).drop("last", "k_r"), "sets-found")
            out.append(found.where("done"))
            if i + 1 < len(rounds):
                carried = found.where("not done").select(*every.columns)
                active = stash(active.join(found.where("done").select("query").distinct(), "query", "left_anti"), "sets-open")
                if active.isEmpty():
                    break
        return reduce(DataFrame.unionByName, out).drop("done").withColumn("level_size", F.sum(weight).over(Window.partitionBy("query", "r")))

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with the names of their set, joined by a bar (``joined``)."""
        names = self.numbers.agg(F.array_sort(F.collect_list("category")).alias("_names"))  # one row
        return rows.join(F.broadcast(names)).withColumn("joined", F.array_join(F.transform(self._ids("m"), lambda c: F.get("_names", c)), "|")).drop("_names")


def category_retrieval(observed: DataFrame, train_bc: DataFrame, prior: Callable[[DataFrame], DataFrame], k: int, seed: int) -> DataFrame:
    """Training bundles by mean prior of their extra categories weighted by the share of observed ones, then overlap and Jaccard.

    Bundles without any category beyond the observed ones are left out. ``prior`` gives rows (bundle_id, category, score) for
    observed categories; it is asked once a set. Sets are ranked first; those that ``k`` bundles don't stand before are opened.
    Rows (bundle_id, context, score, prior, overlap, jaccard, place).
    """
    sets = _Sets(observed, train_bc, prior)
    order = [F.desc("score"), F.desc("prior"), F.desc("overlap"), F.desc("jaccard")]
    ids = F.col("ids")
    part = lambda rows, x: rows.select("query", x.alias("part"))
    value = lambda lost: F.round(F.col("top") * (F.col("nq") - lost) / F.col("nq"), 9)
    at_top = (F.col("last.score") >= value(0)) & (F.col("last.prior") >= F.round("top", 9)) & (F.col("last.overlap") == F.col("nq"))
    beyond = lambda more: F.col("last.jaccard") > F.round(F.col("nq") / (F.col("nq") + more), 9)

    def lacking(lost: int):
        """Whether sets that lack so many observed categories are worth less at best: score, prior, overlap."""
        overlap = (F.col("nq") - lost).cast("long")
        at_best = F.struct(value(lost).alias("score"), F.round("top", 9).alias("prior"), overlap.alias("overlap"))
        return (overlap <= 0) | (at_best < F.struct(F.col("last.score").alias("score"), F.col("last.prior").alias("prior"), F.col("last.overlap").alias("overlap")))

    rounds = [(lambda active, e=e: sets.near(active, 0, e), at_top & beyond(e + 2)) for e in range(LACKING)]
    rounds += [
        (lambda active: sets.holding(part(sets.best(active), F.array_append(ids, F.col("c")))), at_top),
        (lambda active: sets.holding(part(active, ids)), lacking(1)),
        (lambda active: sets.holding(part(active, F.explode(F.transform(ids, lambda c: F.array_remove(ids, c))))), lacking(2)),
        (sets.sharing, None),
    ]
    better = sets.search(rounds, order, k, F.col("size"))
    return _opened(sets, better, order, k, seed)


def _opened(sets: _Sets, better: DataFrame, order: list, k: int, seed: int) -> DataFrame:
    """The first ``k`` bundles of each query's sets, ties drawn.

    Where many bundles tie, a bound on the draw lets through a few more than are wanted; a bundle that it leaves short meets
    all of them. Keys with many pairs are split by the training bundle.
    """
    wanted = k - (F.col("upto") - F.col("level_size"))
    let = wanted * 2 + SPARE
    limit = F.when((F.col("level_size") > 2 * let) & (F.col("level_size") >= wanted), F.lpad(F.lower(F.hex((let / F.col("level_size") * 2.0**32).cast("long"))), 8, "0"))
    columns = ["key", "prior", "overlap", "jaccard", "score"]
    asked = stash(sets.queries.join(better.select("query", "size", *columns, limit.alias("limit")), "query").drop("query"), "sets-asked")
    hot = stash(asked.groupBy("key").agg(F.ceil(F.sum("size") / PAIRS).cast("int").alias("parts")).where("parts > 1"), "sets-hot")
    members = sets.members.join(sets.sets, sets._names("m")).select("key", "context").join(hot, "key", "left")
    members = members.select("key", "context", F.pmod(F.xxhash64("context"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))

    def drawn(rows: DataFrame) -> DataFrame:
        dealt = rows.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        met = dealt.join(members, ["key", "part"]).withColumn("draw", X.draw(seed, "bundle_id", "context")).where("limit is null or substring(draw, 1, 8) < limit")
        return _first(met.select("bundle_id", "context", *columns[1:], "draw"), ["bundle_id"], [*order, "draw", "context"], k).drop("draw")

    found = stash(drawn(asked), "sets-opened")
    full = found.groupBy("bundle_id").agg(F.count("*").alias("n")).where(F.col("n") == k)
    short = stash(asked.where("limit is not null").select("bundle_id").distinct().join(full, "bundle_id", "left_anti"), "sets-short")
    if short.isEmpty():
        return found
    again = drawn(asked.join(short, "bundle_id", "left_semi").withColumn("limit", F.lit(None).cast("string")))
    return found.join(short, "bundle_id", "left_anti").unionByName(again)


def evidence(observed: DataFrame, train_bc: DataFrame, prior: Callable[[DataFrame], DataFrame], k: int, largest: int = 3) -> DataFrame:
    """Evidence bundles: larger shared subsets first, then prior and Jaccard, one bundle for each category set, ``k`` in all.

    Going through the subsets level by level and skipping used bundles and used category sets gives each bundle at its
    first appearance, that is at its largest level; so ordering sets by (level, prior, jaccard, least bundle) is the same.
    Sets at the highest level with the category of the best prior come first, those that differ least from the observed set
    before others; a query without ``k`` of these meets the rest of the level, and only then all. ``prior`` as above.
    Rows (bundle_id, context, key, level, overlap, prior, jaccard, score, place).
    """
    sets = _Sets(observed, train_bc, prior)
    level = F.least("overlap", F.lit(largest).cast("long"))
    order = [F.desc(level), F.desc("prior"), F.desc("jaccard"), "key"]
    ids, most = F.col("ids"), F.least("nq", F.lit(largest))
    highest = F.explode(F.filter(sets._subsets(ids, largest), lambda t: F.size(t) == most)).alias("part")
    of_level = lambda rows, *more: rows.select("query", *more, highest)
    at_level = F.least("last.overlap", F.lit(largest).cast("long")) >= most
    at_top = at_level & (F.col("last.prior") >= F.round("top", 9))
    beyond = lambda more: F.col("last.jaccard") > F.round(F.col("nq") / (F.col("nq") + more), 9)
    rounds = [(lambda active, e=e: sets.near(active, e, e, most), at_top & beyond(e + 2)) for e in range(1, LACKING + 1)]
    rounds += [
        (lambda active: sets.holding(of_level(sets.best(active), "c").select("query", F.array_append("part", F.col("c")).alias("part"))), at_top),
        (lambda active: sets.holding(of_level(active)), at_level),
        (sets.sharing, None),
    ]
    found = sets.search(rounds, order, k, F.lit(1))
    first = sets.named(_first(found.withColumn("level", level.cast("int")), ["query"], [F.desc("level"), F.desc("prior"), F.desc("jaccard"), "key"], k))
    rows = first.select("query", F.col("key").alias("context"), F.col("joined").alias("key"), "level", "overlap", "prior", "jaccard", "score", "place")
    return sets.queries.join(rows, "query").drop("query")


def item_text(items: DataFrame) -> DataFrame:
    return items.select("item_id", X.inline(X.display_text("title", "kind")).alias("text"), "category")


def context_text(context: DataFrame, train: DataFrame, items: DataFrame, most: int = 5) -> DataFrame:
    """One line a retrieved bundle: up to ``most`` item texts, in id order, joined by a semicolon."""
    rows = context.select("bundle_id", "context", "place").join(train.select(F.col("bundle_id").alias("context"), "item_id"), "context").join(item_text(items), "item_id")
    first = _first(rows.withColumnRenamed("place", "n"), ["bundle_id", "context"], ["item_id"], most)
    lines = first.groupBy("bundle_id", "n", "context").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "; ").alias("line"))
    return lines.groupBy("bundle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: F.concat(F.lit("Group "), s["n"].cast("string"), F.lit(": "), s["line"])), "\n").alias("context_text"))


def rendered(samples: DataFrame, inputs: DataFrame, items: DataFrame, task: str, notes: DataFrame | None = None) -> DataFrame:
    """Prompt of each sample: task, inputs, optional notes (bundle_id, note), lettered options, answer instruction."""
    text = item_text(items)
    given = inputs.join(text, "item_id").groupBy("bundle_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "; ").alias("given"))
    lettered = samples.join(text, "item_id").groupBy("bundle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: F.concat(X.option_letter(s["pos"]), F.lit(". "), s["text"])), "\n").alias("options"))
    joined = given.join(lettered, "bundle_id")
    joined = joined.join(notes, "bundle_id", "left") if notes is not None else joined.withColumn("note", F.lit(None).cast("string"))
    return joined.select("bundle_id", F.concat_ws("\n\n", F.lit(task), F.concat(F.lit("Given: "), "given"), "note", F.concat(F.lit("Options:\n"), "options"), F.lit("Answer with one letter.")).alias("prompt"))


def annotated_options(stats: DataFrame) -> DataFrame:
    """Notes on shared groups beside each option, from its counts."""
    note = F.concat(F.lit("shares "), F.col("shared").cast("string"), F.lit(" of "), F.col("bundles").cast("string"), X.plural("bundles", " group", " groups"))
    return stats.select("bundle_id", "pos", X.option_letter("pos").alias("letter"), note.alias("note"))
