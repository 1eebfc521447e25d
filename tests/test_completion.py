"""Completion scorers against brute force over the reference's subset sizes."""

import collections
import itertools

from conftest import SF

from setloom.operators import completion as C
from setloom.plans import completion_queries as Q
from setloom.plans.base import Model


def sets_of(df):
    found = collections.defaultdict(set)
    for r in df.collect():
        found[r["bundle_id"]].add(r["category"])
    return {b: sorted(x) for b, x in found.items()}


def test_backoff_uses_triples_and_direct_sets_of_five(spark):
    m = Model(spark, SF)
    train, seen = sets_of(m.train_bc), sets_of(m.observed)
    counts = collections.Counter(p for x in train.values() for k in range(1, 7) for p in itertools.combinations(x, k))
    domain = sorted({c for x in train.values() for c in x})
    total, weight, whole = collections.Counter(), collections.Counter(), {}
    for b, x in seen.items():
        for c in set(domain) - set(x):
            for p in (p for k in (1, 2, 3) for p in itertools.combinations(x, k) if counts[p] >= 3):
                total[b, c] += len(p) * counts[tuple(sorted((*p, c)))]
                weight[b, c] += len(p) * counts[p]
            if len(x) <= 5 and counts[tuple(x)] >= 3:
                whole[b, c] = counts[tuple(sorted((*x, c)))] / counts[tuple(x)]
    assert any(len(p) == 3 and counts[p] >= 3 for x in seen.values() for p in itertools.combinations(x, 3))
    rows, covered = Q.backoff(m)
    got = {(r["bundle_id"], r["category"]): r["confidence"] for r in rows.collect()}
    assert got.keys() == {k for k in weight if total[k]} and all(abs(got[k] - total[k] / weight[k]) < 1e-9 for k in got)
    assert {r["bundle_id"] for r in covered.collect()} == {b for b, _ in weight}
    got = {(r["bundle_id"], r["category"]): r["score"] for r in Q.direct(m, 5).collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-9 for k in got)
    # ranks among categories that are never made are those among all of them
    key = lambda df: sorted(map(tuple, df.select("bundle_id", "covered", "rank", "mrr", "hit_at_3").collect()), key=str)
    assert key(Q.judged_direct(m, 5)) == key(C.judged(Q.direct(m, 5), m.heldout))
    dense = spark.createDataFrame([(b, c, total[b, c] / w) for (b, c), w in weight.items()], "bundle_id long, category string, score double")
    assert key(Q.judged_backoff(m)["confidence"]) == key(C.judged(dense, m.heldout))


def test_ranks_with_a_rest_that_beats_rows(spark):
    rows = spark.createDataFrame([(1, "b", -5.0), (1, "d", 2.0), (2, "a", 0.0)], "bundle_id long, category string, score double")
    rest = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "bundle_id long, rest double")
    domain = spark.createDataFrame([(c,) for c in "abcdef"], "category string")
    observed = spark.createDataFrame([(1, "a"), (2, "f"), (2, "zz"), (3, "c"), (4, "a"), *[(5, c) for c in "abcdef"]], "bundle_id long, category string")
    heldout = spark.createDataFrame([(1, "b"), (1, "e"), (2, "c"), (3, "c"), (4, "b"), (5, "b")], "bundle_id long, category string")
    got = {r["bundle_id"]: (r["covered"], r["rank"]) for r in C.judged_sparse(rows, rest, observed, domain, heldout).collect()}
    # of 1: d, then c, e, f, then b: the better answer is e; of 2: a, b, c (a as good as the rest); 3 has seen its answer; 4 is not covered
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, None), 4: (0, None), 5: (0, None)}
