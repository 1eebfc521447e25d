"""Category sets against a plain comparison of all pairs, and how many pairs and columns the search moves."""

import hashlib
import random

import pytest

from setloom.operators import retrieval


def tables(spark, categories, bundles, asked, widest, seed):
    rnd = random.Random(seed)
    name = lambda: f"c{int(categories * rnd.random() ** 1.5):03d}"
    train = {b: {name() for _ in range(rnd.randint(1, widest))} for b in range(bundles)}
    observed = {1000 + b: {name() for _ in range(rnd.randint(1, widest - 1))} for b in range(asked)}
    df = lambda sets: spark.createDataFrame([(b, c) for b, s in sets.items() for c in sorted(s)], "bundle_id long, category string")
    # a prior that follows from the observed set, with ties and categories without one
    weight = lambda seen, c: (int(hashlib.md5(f"{min(seen)}{c}".encode()).hexdigest(), 16) % 7) / 7
    every = sorted(set().union(*train.values()))
    prior = {b: {c: weight(seen, c) for c in every if c not in seen and weight(seen, c) > 0} for b, seen in observed.items()}
    rows = spark.createDataFrame([(b, c, p) for b, of in prior.items() for c, p in of.items()], "bundle_id long, category string, score double")
    return train, observed, prior, df(train), df(observed), lambda sets: rows.join(sets.select("bundle_id").distinct(), "bundle_id", "left_semi")


def scored(train, seen, of):
    for t, names in train.items():
        overlap = len(names & seen)
        if overlap and len(names) > overlap:
            p = max((of.get(c, 0.0) for c in names), default=0.0)
            yield t, names, overlap, round(p, 9), round(overlap / len(names | seen), 9), round(p * overlap / len(seen), 9)


@pytest.mark.parametrize("categories, widest, spare", [(9, 5, -8), (30, 8, 16), (140, 10, 16)])
def test_sets_are_those_of_all_pairs(spark, monkeypatch, categories, widest, spare):
    """Also where bounds on draws leave bundles short, where keys are split, and with masks of several words."""
    monkeypatch.setattr(retrieval, "SPARE", spare)
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    train, observed, prior, train_bc, seen, of = tables(spark, categories, 300, 30, widest, categories)
    draw = lambda b, t: hashlib.md5(f"3_{b}_{t}".encode()).hexdigest()
    got = {}
    for r in retrieval.category_retrieval(seen, train_bc, of, 5, 3).collect():
        got.setdefault(r["bundle_id"], []).append((r["place"], r["context"], r["overlap"], r["prior"], r["jaccard"], r["score"]))
    want = {}
    for b, s in observed.items():
        best = sorted(scored(train, s, prior[b]), key=lambda x: (-x[5], -x[3], -x[2], -x[4], draw(b, x[0]), x[0]))[:5]
        if best:
            want[b] = [(i + 1, t, o, p, j, v) for i, (t, _, o, p, j, v) in enumerate(best)]
    assert {b: sorted(x) for b, x in got.items()} == want

    got = {}
    for r in retrieval.evidence(seen, train_bc, of, 5).collect():
        got.setdefault(r["bundle_id"], []).append((r["place"], r["context"], r["key"], r["level"], r["prior"], r["jaccard"]))
    want = {}
    for b, s in observed.items():
        first = {}
        for t, names, o, p, j, _ in scored(train, s, prior[b]):
            key = "|".join(sorted(names))
            first[key] = min(first.get(key, (0, 0, 0, 1 << 60)), (-min(o, 3), -p, -j, t))
        best = sorted((x, key) for key, x in first.items())[:5]
        if best:
            want[b] = [(i + 1, x[3], key, -x[0], -x[1], -x[2]) for i, (x, key) in enumerate(best)]
    assert {b: sorted(x) for b, x in got.items()} == want


def test_few_pairs_meet_where_sets_are_many(spark, monkeypatch):
    """Queries whose nearest sets are there end in the first rounds, and a pair holds numbers only."""
    import itertools

    names = [f"c{i}" for i in range(8)]
    sets = [s for n in range(1, 6) for s in itertools.combinations(names, n)]
    rows = lambda some, first: spark.createDataFrame([(first + i, c) for i, s in enumerate(some) for c in s], "bundle_id long, category string")
    seen = sets[:90]
    pairs = [(1000 + i, c, (int(c[1]) + 1) / 10) for i, s in enumerate(seen) for c in names if c not in s]
    prior = spark.createDataFrame(pairs, "bundle_id long, category string, score double")
    met, valued = [], retrieval._Sets.valued
    monkeypatch.setattr(retrieval._Sets, "valued", lambda self, new, active: met.append(new.count()) or valued(self, new, active))
    found = retrieval.evidence(rows(seen, 1000), rows(sets, 0), lambda s: prior, 3)
    assert found.count() == 3 * len(seen)
    assert sum(met) < len(seen) * 20  # of 218 sets each
