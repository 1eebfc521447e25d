"""Steps whose cost must grow with the input: plans without needless shuffles, with the results of a plain count."""

import collections
import hashlib
import itertools
import random

from setloom.operators import cases, compare, descriptions, graph, retrieval, sampling, vectors
from setloom.functions import exprs as X
from setloom.streaming import sums


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mean_vectors_keeps_a_vector_in_one_row(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0]), (3, []), (4, None)], "k long, embedding array<float>")
    found = vectors.mean_vectors(rows, ["k"])
    assert "Generate" not in plan(found) and plan(found).count("Exchange hash") == 1
    assert {r["k"]: (r["n"], r["embedding"]) for r in found.collect()} == {1: (2, [2.0, 4.0]), 2: (1, [5.0])}


def test_sets_share_one_vector(spark):
    bc = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (4, "x")], "bundle_id long, category string")
    units = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "category string, unit array<double>")
    rows = {r["bundle_id"]: (r["n"], [round(x, 6) for x in r["embedding"]]) for r in cases.category_set_vectors(bc, units).collect()}
    assert rows == {1: (2, [0.707107, 0.707107]), 2: (2, [0.707107, 0.707107]), 3: (1, [1.0, 0.0])}
    assert cases._set_vectors(bc, units)[1].count() == 2  # one vector a set, not a bundle
    numbered, cosines = cases.set_cosines(bc, units, 6)
    assert {r["bundle_id"]: r["set"] for r in numbered.collect()} == {1: 1, 2: 1, 3: 3}
    assert {(r["set"], r["category"]): r["score"] for r in cosines.collect()} == {(1, "a"): 0.707107, (1, "b"): 0.707107, (3, "a"): 1.0, (3, "b"): 0.0}


def test_role_bundles_opens_the_bundles_of_a_set(spark):
    train = spark.createDataFrame([(b, c) for b in (7, 3, 5, 9) for c in "ab"] + [(4, "a"), (6, "b")], "bundle_id long, category string")
    units = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "category string, unit array<double>")
    observed = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "bundle_id long, category string")
    found = collections.defaultdict(list)
    for r in sorted(cases.role_bundles(observed, train, units, 3).collect(), key=lambda r: (r["bundle_id"], r["place"])):
        found[r["bundle_id"]].append(r["context"])
    assert found == {1: [4, 3, 5], 2: [3, 5, 7]}


def test_nearest_user_looks_at_the_items_of_few(spark):
    ui = [(u, i) for u, n in ((1, 2), (2, 12), (3, 3)) for i in range(n)]
    inputs, barred = [(10, 0), (10, 1), (11, 2)], [(10, i) for i in range(4)] + [(11, 2)]
    one = lambda rows, a, b: spark.createDataFrame(rows, f"{a} long, {b} long")
    found = retrieval.nearest_users(one(inputs, "bundle_id", "item_id"), one(ui, "user_id", "item_id"), one(barred, "bundle_id", "item_id"), 5)
    assert "sure" in plan(found) or "barred" in plan(found)  # users with more items than are excluded are known without their items
    rows = {r["bundle_id"]: (r["user_id"], r["overlap"], r["ties"]) for r in found.collect()}
    assert rows[10] == (2, 2, 1) and rows[11][1:] == (1, 2)  # users 1 and 3 have nothing beyond what 10 excludes


def test_pairs_are_made_where_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(graph, "HELD", 4)
    rows = [(g, i) for g in range(6) for i in range(20) if (g * 7 + i * i) % 3]
    df = spark.createDataFrame(rows, "g long, i long")
    per = graph.spread_pairs(df, "g", "i").groupBy("a", "b").count()
    dealt = plan(per).split("Generate explode(held")[0]
    assert "Exchange" not in dealt
    want = collections.Counter((a, b) for (g, a), (h, b) in itertools.product(rows, rows) if g == h and a != b)
    assert {(r["a"], r["b"]): r["count"] for r in per.collect()} == want
    best = compare.co_items(df.where("i = 4").selectExpr("i as item_id"), df.selectExpr("g as bundle_id", "i as item_id"), 3)
    first = {b: min(g for g, i in rows if i == b and (g, 4) in set(rows)) for a, b in want if a == 4}
    assert [r["b"] for r in best.orderBy("place").collect()] == sorted(first, key=lambda b: (-want[4, b], first[b], b))[:3]


def test_options_look_up_counted_pairs(spark):
    train = [(1, i) for i in range(3)] + [(2, i) for i in range(8)] + [(3, 0), (3, 9)]
    options, inputs = [(10, 0), (10, 7), (10, 9), (11, 1)], [(10, 1), (10, 2), (11, 0), (11, 9)]
    want = {}
    for b, o in options:
        n = sum((t, o) in train and (t, i) in train for c, i in inputs if c == b for t in (1, 2, 3))
        want |= {(b, o): n} if n else {}
    two = lambda rows, a: spark.createDataFrame(rows, f"{a} long, item_id long")
    for widest in (1, 4, 32):
        found = graph.shared_groups(two(options, "bundle_id"), two(inputs, "bundle_id"), two(train, "bundle_id"), widest)
        assert {(r["bundle_id"], r["item_id"]): r["n"] for r in found.collect()} == want


def test_pairs_of_a_bundle_are_made_once(spark):
    """A bundle's pairs come from its own row, in one order, so there is no join of training with itself and half as many pairs."""
    groups = spark.createDataFrame([(1, [2, 5, 9]), (2, [5])], "b long, held array<long>")
    pairs = graph._ordered_pairs(groups)
    assert "Join" not in plan(pairs)
    assert sorted((r["low"], r["high"]) for r in pairs.collect()) == [(2, 2), (2, 5), (2, 9), (5, 5), (5, 5), (5, 9), (9, 9)]


def test_alignment_deals_vectors_as_stored(spark):
    """Vectors are dealt by bundle before they are made units and added up, so no partial mean is dealt."""
    rows = lambda some, schema: spark.createDataFrame(some, schema)
    two = "bundle_id long, item_id long"
    contexts, train = rows([(1, 7), (2, 8)], "bundle_id long, context long"), rows([(7, 1), (7, 2), (8, 2), (8, 3)], two)
    samples = rows([(1, 3, True), (1, 4, False), (2, 1, True), (2, 4, False)], two + ", is_gt boolean")
    vectors = rows([(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [5.0, 0.0])], "item_id long, embedding array<float>")
    found = cases.context_alignment(contexts, train, rows([(1, 1), (2, 2)], two), samples, vectors)
    assert plan(found).count("REPARTITION_BY_COL") >= 2
    assert {r["bundle_id"]: (round(r["answer"], 6), round(r["others"], 6)) for r in found.collect()} == {1: (0.0, 1.0), 2: (0.8, 0.0)}


def test_negatives_are_the_first_of_all_draws(spark):
    split = [(b, i) for b in range(30) for i in range(b % 4 + 1)]
    items = [(i,) for i in range(16) if i % 3]
    found = sampling.negatives(spark.createDataFrame(split, "bundle_id long, item_id long"), spark.createDataFrame(items, "item_id long"), 4, 9)
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r["bundle_id"]].add(r["item_id"])
    draws = spark.range(30).crossJoin(spark.range(40).withColumnRenamed("id", "k")).select("id", "k", (X.draw_int(9, "id", "k") % 15).alias("i")).orderBy("id", "k").collect()
    for b in range(30):
        new = dict.fromkeys(r["i"] for r in draws if r["id"] == b and (r["i"],) in items and (b, r["i"]) not in split)
        assert got[b] == set(list(new)[:4])


def test_word_vectors_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(i, f"red {i % 3} ring") for i in range(9)], "item_id long, text string")
    samples = spark.createDataFrame([(b, p, 3 * b % 9 + p, p == 0) for b in range(5) for p in range(3)], "bundle_id long, pos long, item_id long, is_gt boolean")
    inputs, runs = samples.selectExpr("bundle_id", "(item_id + 4) % 9 as item_id").distinct(), samples.where("is_gt").selectExpr("bundle_id", "pos as pred_pos", "1 as hit")
    found = descriptions.description_signal(samples, inputs, descriptions.word_vectors(texts, F.col("text")), runs)
    assert "BroadcastExchange" not in plan(found).split("pred_pos")[-1] and found.count() == 5


def test_running_members_give_the_pairs(spark):
    rows = spark.sql("SELECT u AS user_id, timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, k * 5) AS ts, concat('t', (u * k) % 4) AS event_type FROM (SELECT explode(sequence(1, 7)) AS u), (SELECT explode(sequence(1, 20)) AS k)")
    running = sums.members(rows, "user_id", "event_type").groupBy("g", "w", "node").sum("n")
    kinds = collections.defaultdict(set)
    for r in rows.collect():
        kinds[r["user_id"], r["ts"].date()].add(r["event_type"])
    want = collections.Counter(p for s in kinds.values() for p in itertools.combinations(sorted(s), 2))
    assert {(r["a"], r["b"]): r["n"] for r in sums.member_pairs(running).collect()} == want


def test_options_are_drawn_and_ordered_in_one_row(spark):
    """Options come from a row a bundle, with no shuffle of draws, whether ids have gaps or not."""
    split = [(b, 3 * b + i, i == 0) for b in range(12) for i in range(b % 3 + 2)]
    for ids in (range(60), [1000 * k + i for k in range(3) for i in range(400)], [2**17 - 3 + i for i in range(90)] + list(range(2**17 - 90))):
        items = spark.createDataFrame([(i,) for i in ids], "item_id long")
        found = sampling.options(spark.createDataFrame(split, "bundle_id long, item_id long, is_gt boolean"), items, 5, 45, 41)
        assert "Exchange" not in plan(found) and "Window" not in plan(found)
        there, got = set(ids), collections.defaultdict(list)
        for r in found.collect():
            got[r["bundle_id"]].append((r["pos"], r["item_id"], r["is_gt"]))
        for b in range(12):
            draws = [int(hashlib.md5(f"45_{b}_{k}".encode()).hexdigest()[:8], 16) % (max(ids) + 1) for k in range(40)]
            own = {i for c, i, _ in split if c == b}
            options = [3 * b] + list(dict.fromkeys(i for i in draws if i in there and i not in own))[:4]
            order = sorted(options, key=lambda i: hashlib.md5(f"41_{b}_{i}".encode()).hexdigest())
            assert sorted(got[b]) == [(p, i, i == 3 * b) for p, i in enumerate(order)]


def test_frequent_items_are_counted_and_others_meet_directly(spark, monkeypatch):
    rng = random.Random(5)
    train = [(t, i) for t in range(40) for i in {0, *rng.sample(range(1, 30), rng.randint(1, 9))}]
    options, inputs = [(b, i) for b in range(9) for i in rng.sample(range(30), 6)], [(b, i) for b in range(9) for i in {0, *rng.sample(range(30), 2)}]
    held = collections.defaultdict(set)
    for t, i in train:
        held[t].add(i)
    want = {(b, o): n for b, o in options if (n := sum(o in s and i in s for c, i in inputs if c == b for s in held.values()))}
    two = lambda rows, a: spark.createDataFrame(rows, f"{a} long, item_id long")
    for often in (0, 8, 10**6):
        monkeypatch.setattr(graph, "OFTEN", often)
        found = graph.shared_groups(two(options, "bundle_id"), two(inputs, "bundle_id"), two(train + train[:20], "bundle_id"), 8)
        assert {(r["bundle_id"], r["item_id"]): r["n"] for r in found.collect()} == want


def test_runs_come_from_a_bundle_s_own_row(spark):
    from conftest import SF

    from setloom.plans.base import Model

    m = Model(spark, SF)
    assert "Exchange" not in plan(m.runs) and "Window" not in plan(m.runs)


def test_pair_cosines_move_vectors_as_stored(spark):
    """Vectors are dealt as floats and made units behind the shuffle; the mean input is made only where it is asked for."""
    samples = spark.createDataFrame([(1, 0, 7, True), (1, 1, 8, False)], "bundle_id long, pos int, item_id long, is_gt boolean")
    units = spark.createDataFrame([(7, [3.0, 4.0]), (8, [0.0, 2.0]), (9, [5.0, 0.0])], "item_id long, embedding array<float>")
    found = vectors.pair_cosines(samples, spark.createDataFrame([(1, 9), (1, 8)], "bundle_id long, item_id long"), units)
    assert plan(found).count("REPARTITION_BY_COL") == 2
    assert {r["pos"]: (round(r["pair_mean"], 6), round(r["pair_max"], 6)) for r in found.collect()} == {0: (0.7, 0.8), 1: (0.5, 1.0)}


def test_test_bundles_are_dealt_once(spark):
    from conftest import SF

    from setloom.plans.base import Model

    assert plan(Model(spark, SF).fixed).count("Exchange hashpartitioning") + plan(Model(spark, SF).fixed).count("REPARTITION_BY_COL") <= 2
    assert "ENSURE_REQUIREMENTS" not in plan(Model(spark, SF).fixed)


def test_inputs_meet_one_row_an_item(spark):
    """An input meets its item once, not once for each training bundle that holds it; multiplicity is counted in that row."""
    two = lambda rows, a: spark.createDataFrame(rows, f"{a} long, item_id long")
    train = [(t, i) for t in range(20) for i in (1, 2, 2, 3 + t % 2)]
    found = graph.shared_groups(two([(7, 2), (7, 4), (7, 9), (8, 9)], "bundle_id"), two([(7, 1), (7, 3), (8, 1)], "bundle_id"), two(train, "bundle_id"))
    assert "array_remove" in plan(found)
    assert {(r["bundle_id"], r["item_id"]): r["n"] for r in found.collect()} == {(7, 2): 30, (7, 4): 10}


def test_draws_need_no_join_where_few_ids_are_missing(spark, monkeypatch):
    split = spark.createDataFrame([(b, i, i == b) for b in range(12) for i in (b, b + 5)], "bundle_id long, item_id int, is_gt boolean")
    items = spark.createDataFrame([(i,) for i in range(-2, 60) if i not in (0, 17, 18)], "item_id int")
    assert sampling.missing_ids(sampling.id_runs(items), 60) == [0, 17, 18]
    row = lambda df: sorted(map(tuple, df.collect()))
    kept = sampling.options(split, items, 6, 45, 41)
    assert kept.schema["item_id"].dataType.simpleString() == "int" and kept.count() == 72
    monkeypatch.setattr(sampling, "GAPS", 2)
    assert sampling.missing_ids(sampling.id_runs(items), 60) is None
    assert row(sampling.options(split, items, 6, 45, 41)) == row(kept)
    monkeypatch.setattr(sampling, "GAPS", -100)
    assert row(sampling.options(split, items, 6, 45, 41)) == row(kept)


def test_ties_of_a_signal_come_from_the_bundles_row(spark):
    """Answers and predictions get their ties without a join, so no side is broadcast by the size of its file; pairs of methods too."""
    from setloom.operators import runs

    rng = random.Random(3)
    option = lambda p, goal: (p, 10 * p, p == goal, float(rng.randrange(3)), float(rng.randrange(2)), rng.choice([None, 0.0, 1.0]))
    scored = [(b, [option(p, b % 4) for p in range(4)]) for b in range(40)]
    found = spark.createDataFrame(scored, "bundle_id long, options array<struct<pos int, item_id long, is_gt boolean, popularity double, cooccurrence double, category double>>")
    names = ["popularity", "cooccurrence", "category"]
    per = [(m, b, b % 4, rng.randrange(4), rng.randrange(2)) for b in range(40) for m in names]
    with_options = spark.createDataFrame(per, "method string, bundle_id long, true_pos int, pred_pos int, hit int").join(found, "bundle_id").localCheckpoint()
    detail = runs.signal_rows(with_options, names)
    assert "Join" not in plan(detail) and "Exchange" not in plan(detail)
    each = with_options.select("bundle_id", "options").distinct()
    scores = [each.selectExpr("bundle_id", "inline(options)").selectExpr("bundle_id", "pos", f"{m} score", f"'{m}' signal") for m in names]
    ties = runs.tie_stats(scores[0].union(scores[1]).union(scores[2]).where("score is not null"), "signal", "bundle_id").localCheckpoint()
    want = with_options.drop("options")
    for at, p in (("true_pos", "gt_"), ("pred_pos", "pred_")):
        side = ties.select("bundle_id", "signal", ties["pos"].alias(at), *[ties[s].alias(p + s) for s in runs.STATS])
        want = want.join(side, ["bundle_id", at] + (["signal"] if p == "pred_" else []), "inner" if p == "gt_" else "left")
    columns = sorted(detail.columns)
    assert sorted(map(str, detail.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    pairs = runs.signal_pairwise(detail, names)
    assert "Join" not in plan(pairs)
    hits = {(m, b): h for m, b, _, _, h in per}
    both = [(hits[r["left_method"], b], hits[r["right_method"], b]) for r in pairs.where("signal = 'popularity'").collect() for b in range(40)]
    assert len(both) == 120 and sum(r["right_only"] for r in pairs.where("signal = 'popularity'").collect()) == both.count((0, 1))


def test_scores_broadcast_nothing_by_the_size_of_its_file(spark, monkeypatch):
    """A row's arrays count as one member in a plan's sizes, so sides of scored bundles are dealt however small they look."""
    from conftest import SF
    from setloom.plans import base

    plans = []
    monkeypatch.setattr(base, "stash", lambda df, name: plans.append((name, plan(df))) or df)
    base.Model(spark, SF).scored
    assert [n for n, _ in plans] == ["split", "samples", "scored"] and "BroadcastHashJoin" not in plans[-1][1]


def test_pairs_take_turns_on_disk(spark, monkeypatch):
    """Beyond ``PASS`` pairs the nodes are dealt to shares, each stored before the next, with the same rows and no shuffle files left by them."""
    from setloom import shared

    rows = [(g, i) for g in range(9) for i in range(20) if (g * 7 + i * i) % 3]
    df = spark.createDataFrame(rows, "bundle_id long, item_id long")
    some = df.where("item_id % 4 < 2").select("item_id")
    whole = compare.co_items(some, df, 3)
    monkeypatch.setattr(graph, "PASS", 300)
    for held in (512, 4):
        monkeypatch.setattr(graph, "HELD", held)
        known = set(shared.written)
        found = compare.co_items(some, df, 3)
        new = [x for x in shared.written if x not in known]
        assert sum("pairs-in-turn" in x for x in new) > 2
        assert spark.conf.get(graph.CLEANED, "false") == "false"
        assert sorted(found.collect()) == sorted(whole.collect()) and "Join" not in plan(found)


def test_vectors_are_joined_by_name(spark):
    """Bundle vectors are dealt as stored; an index tells copies by hashes and keeps no table of vectors that the next one replaces."""
    from setloom import shared
    from setloom.operators.neighbours import Index

    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(12)] + [(12, [0.0, 0.0])], "item_id long, embedding array<float>")
    bi = spark.createDataFrame([(b, i) for b in range(6) for i in (b, b + 6)], "bundle_id long, item_id long")
    means = vectors.bundle_vectors(rows, bi)
    assert plan(means).count("REPARTITION_BY_COL") == 1
    known = set(shared.written)
    index = Index(rows, "item_id")
    found = {r["item_id"]: r["neighbour"] for r in index.nearest().collect()}
    assert found == {i: min(j for j in range(12) if j != i and j % 5 == i % 5) for i in range(12)}
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in shared.written if p not in known]
    assert index.n == 5 and not {"vectors", "vector-cells", "vector-queries", "vector-asked"} & set(left)
