"""Phrases against brute force, with awkward rows, longer phrases and large counts."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from setloom.llm import phrases as P


def brute(rows, longest, least, share):
    """(lang, phrase) to (a, l, r, score, dropped) and words of each language, from the definition."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = {}
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in good.items():
            score, k = min(((10**6 * a * a) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items())
            out[lang, " ".join(p)] = (a, counts[p[:k]], counts[p[k:]], score, inside)
    return out, {k: v for k, v in n.items() if v}


AWKWARD = [(None, "a"), ("", "a"), (" .,\t\n", "a"), ("x", None), ("One two three. one two, ONE two three four", "a"), ("é É one two\x0bthree one two", None), ("deux\xa0mots deux\xa0mots\tdeux\xa0mots", "fr"), ("z z z z z z z", "zz"), ("one two three four", "a")]


@pytest.mark.parametrize("longest,least,share,block", [(3, 2, 50, 1 << 23), (4, 2, 80, 60), (2, 1, 50, 1), (5, 3, 100, 500)])
def test_brute_force(spark, longest, least, share, block):
    draw = random.Random(longest)
    rows = AWKWARD * 2 + [(" ".join(draw.choice(["red", "Fox", "sea", "run.", "to", "be,", "or", "not"]) for _ in range(draw.randrange(40))), draw.choice(["a", "b", None])) for _ in range(60)]
    df = spark.createDataFrame([(t, g, 1, "n") for t, g in rows], "text string, lang string, n int, phrase string").repartition(3)
    found, totals = P.phrases(df, longest, least, share, block_bytes=block)
    want, n = brute(rows, longest, least, share)
    got = found.collect()
    assert {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["score"], r["dropped"]) for r in got} == want and len(got) == len(want)
    assert dict(map(tuple, totals.collect())) == n
    top = P.ranked(found, totals, 7).collect()
    for lang in n:
        order = sorted((-s, -a, p.encode()) for (g, p), (a, _, _, s, gone) in want.items() if g == lang and not gone)[:7]
        assert [(-r["score"], -r["a"], r["phrase"].encode()) for r in sorted((r for r in top if r["lang"] == lang), key=lambda r: r["rank"])] == order
    assert all(r["n"] == n[r["lang"]] for r in top)


def test_products_past_64_bits(spark):
    counts = [(9_999_999_999_999_999, 9_999_999_999_999_999, 9_999_999_999_999_999), (3 * 10**12 + 7, 4 * 10**15 + 1, 5 * 10**12 + 9), (10, 33333333333, 77777777777), (6, 7, 9)]
    got = spark.createDataFrame(counts, "a long, l long, r long").select("a", "l", "r", P.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score")).collect()
    assert all(x["score"] == 10**6 * x["a"] ** 2 // (x["l"] * x["r"]) for x in got)


def test_empty_table(spark):
    df = spark.createDataFrame([("a", "b")], "text string, lang string").where("false")
    found, totals = P.phrases(df)
    assert P.ranked(found, totals).count() == 0 and totals.count() == 0
