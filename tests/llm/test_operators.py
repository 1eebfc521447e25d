"""The operators of the corpus package against brute force, on fixtures with the awkward cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from util import assert_same

import __spark_entry__ as entry
from setloom.llm import decontamination, hmm_scoring, html_extraction, line_dedup, mixing, ngram_jaccard, quality_rules, sharding, substring_dedup, token_counts
from setloom.llm import registry as llm
from setloom.llm._graph import components

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * i % 977}" for i in range(4000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, "a b c d e f g h. One more line here.\nThe second line stands.\nThird line ends."),
    (2, "a b c d e f g h. One more line here.\nThe second line stands.\nThird line ends."),
    (3, None),
    (4, ""),
    (5, "  \n\t "),
    (6, LONG),
    (7, PASSAGE + " tail of seven"),
    (8, "head of eight " + PASSAGE + " and " + PASSAGE),
    (9, "Head of nine\n" + PASSAGE + "\n| a | b | c | d |"),
    (10, "same words " * 40),
    (11, "É É é one TWO three\x0bfour\x0cfive  six"),
    (12, "x"),
    (13, LONG + " more"),
    (None, "a text without an id, " + PASSAGE),
    (14, "one\ntwo\nthree\nfour"),
    (15, "zero\none\ntwo\nthree\nfive"),
    (15, "zero\none\ntwo\nthree\nfive"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "src", 1, "x") for i, t in TEXTS], "doc_id long, text string, source string, n_words int, kept string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_queries_equal_oracles(spark, duck, name):
    assert_same(llm.QUERIES[name](spark, SF), duck, llm.ORACLES[name])


def test_every_dealt_operator_has_a_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_empty_tables(nothing, spark):
    for op in (quality_rules.quality_rules, ngram_jaccard.ngram_jaccard, sharding.sharding, mixing.mixing, line_dedup.line_dedup, substring_dedup.substring_dedup, hmm_scoring.hmm_scoring):
        assert op(nothing).count() == 0
    assert token_counts.token_counts(nothing, *tokenizer()[:2]).count() == 0 and mixing.mixed(nothing).count() == 0 and quality_rules.passing(nothing).count() == 0
    assert decontamination.decontamination(nothing, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert html_extraction.html_extraction(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_rules(docs):
    got = collections.defaultdict(list)
    for r in quality_rules.quality_rules(docs).collect():
        got[r["doc_id"]].append(r)
    assert got[3][0]["n_words"] == 0 and got[3][0]["base_failed"] and not got[3][0]["kept"]
    assert got[10][0]["n_repeat_words"] == 80 and got[10][0]["base_failed"]
    assert got[6][0]["n_words"] == 4000
    for i, t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in range(3)}
        assert got[i][0]["n_words"] == len(w) and got[i][0]["n_repeat_words"] == len(covered)
    assert "|" not in got[9][0]["cleaned_text"]
    assert quality_rules.passing(docs).columns == docs.columns


def brute_components(rows, gram, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < gram else [tuple(w[j : j + gram]) for j in range(len(w) - gram + 1)])
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_jaccard(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard(docs, gram=4, percent=85).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_components([x for x in TEXTS if x[0] is not None], 4, 85)


def test_ngram_jaccard_of_many_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            w[k] = f"u{rng.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, PASSAGE + " " + " ".join(f"v{i}_{k}" for k in range(i % 60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    block, ngram_jaccard.BLOCK = ngram_jaccard.BLOCK, 40
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard(df, gram=4, percent=85).collect()}
    finally:
        ngram_jaccard.BLOCK = block
    assert got == brute_components(rows, 4, 85)


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    n = rng.integers(40, 80, 300)
    v = np.stack([rng.multinomial(k, np.full(64, 1 / 64)) for k in n]).astype(np.int32)
    tree = ngram_jaccard.CountTree(n, v)
    x, y = tree.join(tree, 50)
    expected = {(i, j) for i in range(300) for j in range(300) if 2 * min(n[i], n[j]) >= max(n[i], n[j]) and np.minimum(v[i], v[j]).sum() >= -(-50 * (n[i] + n[j]) // 150)}
    assert set(zip(x.tolist(), y.tolist())) == expected


@pytest.mark.parametrize(("n", "shards"), [(1, 3), (17, 40)])
def test_sharding(docs, n, shards):
    rows = sharding.sharding(docs, shards=shards).collect()
    assert len(rows) == len(TEXTS)
    by_text, slots = {}, collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = {r["doc_id"]: r for r in rows}
    for i, t in TEXTS:
        assert got[i]["size"] == len((t or "").encode()) + 16 and got[i]["text_crc32"] == zlib.crc32((t or "").encode())
        by_text.setdefault(t, set()).add(got[i]["shard"])
    assert all(len(s) == 1 for s in by_text.values())


def test_equal_groups_are_dealt_as_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shards = int(rng.integers(1, 6))
        one = [int(x) for x in rng.integers(0, 50, shards)]
        bulk, size, count = list(one), int(rng.integers(1, 9)), int(rng.integers(0, 60))
        got = sharding.dealt(bulk, size, count)
        times = [0] * shards
        for _ in range(count):
            k = one.index(min(one))
            one[k] += size
            times[k] += 1
        assert bulk == one and got == times


def test_sharding_is_balanced(spark):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(2000)] + [(5000 + i, "copy") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    per = [r["s"] for r in sharding.sharding(df, shards=8).groupBy("shard").sum("size").toDF("shard", "s").collect()]
    assert max(per) - min(per) <= 0.02 * sum(per) / 8


def test_mixing_stays_within_a_block(spark):
    rows = [(i, "a") for i in range(700)] + [(1000 + i, "b") for i in range(200)] + [(2000 + i, "c") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixing(df, weights={"a": 0.5, "b": 0.3, "c": 0.2}, block_size=2).collect()
    assert len(got) == 1000 and {r["period"] for r in got} == {10}
    slot = {}
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
        slot.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in slot.values())
    end, units = min(max(r["slot"] for r in got if r["source"] == s) for s in "abc"), {"a": 5, "b": 3, "c": 2}
    for t in range(1, end):
        for s in "abc":
            done = sum(1 for k, v in slot.items() if k < t and s in v)
            assert abs(done - units[s] * t / 10) < 1
    mix = collections.Counter(r["source"] for r in got if r["in_mix"])
    assert all(abs(mix[s] - units[s] / 10 * sum(mix.values())) < 2 for s in "abc") and mix["c"] == 100


def test_mixing_meets_weights(spark):
    rows = [(i, "a") for i in range(75)] + [(100 + i, "b") for i in range(25)] + [(200 + i, None) for i in range(5)] + [(200, None), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string")

    def shares(**kw):
        return collections.Counter(r["source"] for r in mixing.mixing(df, block_size=1, **kw).collect() if r["in_mix"])

    even = shares(weights={"a": 0.5, "b": 0.5})
    assert even["b"] == 25 and abs(even["a"] - 25) <= 1 and len(even) == 2
    assert shares(weights={"a": 1, "b": 0, "gone": 3}) == {"a": 76}
    assert shares(weights={}) == {}
    assert shares(until="last") == {"a": 76, "b": 25, "": 6}
    assert sorted(shares(power=0.0, resolution=3).values()) in ([6, 6, 6], [6, 6, 7], [6, 7, 7])
    with pytest.raises(ValueError):
        shares(weights={"a": 0.123456789, "b": 0.5})
    with pytest.raises(ValueError):
        shares(weights={"a": -1})


def test_mixed_keeps_columns_whatever_their_names(spark):
    rows = [(i, "ab"[i % 3 > 1], i, i, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int, lane int, h int, whole int")
    got = mixing.mixed(df, until="last", block_size=2)
    assert got.columns == df.columns and sorted(got.collect()) == sorted(df.collect())
    plan = {r["doc_id"]: r["slot"] for r in mixing.mixing(df, until="last", block_size=2).collect()}
    order = [plan[r["doc_id"]] for r in got.collect()]
    assert order == sorted(order)


def test_many_sources_make_a_bounded_period(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id < 1500 then 'big' else 's' || id end as source")
    got = mixing.mixing(df, block_size=1, resolution=50, until="last").collect()
    assert {r["period"] for r in got} == {50} and len({r["slot"] for r in got}) == 3000


def brute_hmm(model, codes, end):
    a = model.start * model.emit[:, np.append(codes, end)[0]]
    for c in np.append(codes, end)[1:]:
        a = (a @ model.step) * model.emit[:, c]
    return math.log10(a.sum())


def test_forward_recursion():
    rng = np.random.default_rng(2)
    emit, step = rng.random((3, 7)), rng.random((3, 3))
    model = hmm_scoring.Model(np.full(3, 1 / 3), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    codes = [rng.integers(0, 6, n) for n in (0, 1, 5, 127, 128, 129, 300)]
    got = hmm_scoring.log_likelihoods(model, codes, 6)
    np.testing.assert_allclose(got[:5], [brute_hmm(model, c, 6) for c in codes[:5]], rtol=1e-9)
    log = 0.0
    x = None
    for c in np.append(codes[6], 6):
        x = model.start * model.emit[:, c] if x is None else (x @ model.step) * model.emit[:, c]
        log += math.log10(x.sum())
        x = x / x.sum()
    assert got[6] == pytest.approx(log)


def test_expectations_are_posteriors():
    rng = np.random.default_rng(4)
    emit, step = rng.random((2, 4)), rng.random((2, 2))
    model = hmm_scoring.Model(np.array([0.4, 0.6]), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    seq = np.array([0, 2, 1, 3])
    first, steps, emitted, like = hmm_scoring.expectations(model, [seq[:-1], np.array([], int)], 3)
    # the second sequence is its end alone
    alone = model.start * model.emit[:, 3]
    first, emitted = first - alone / alone.sum(), emitted - np.outer(alone / alone.sum(), np.arange(4) == 3)
    total, e_first, e_steps, e_emit = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    for path in np.ndindex(2, 2, 2, 2):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for t in range(1, 4):
            p *= model.step[path[t - 1], path[t]] * model.emit[path[t], seq[t]]
        total += p
        e_first[path[0]] += p
        for t in range(4):
            e_emit[path[t], seq[t]] += p
        for t in range(1, 4):
            e_steps[path[t - 1], path[t]] += p
    np.testing.assert_allclose(first, e_first / total, rtol=1e-4)
    np.testing.assert_allclose(emitted, e_emit / total, rtol=1e-4, atol=1e-6)
    np.testing.assert_allclose(steps, e_steps / total, rtol=1e-4)  # steps into padding don't count
    assert like == pytest.approx(math.log10(total) + math.log10(alone.sum()), rel=1e-5)


def plain_expectations(model, codes, end):
    """The textbook recursions in one piece."""
    k, n = model.emit.shape
    first, steps, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, n))
    for c in codes:
        seq = np.append(c, end).astype(int)
        alpha, beta = np.zeros((len(seq), k)), np.ones((len(seq), k))
        x = model.start * model.emit[:, seq[0]]
        alpha[0] = x / x.sum()
        for t in range(1, len(seq)):
            x = (alpha[t - 1] @ model.step) * model.emit[:, seq[t]]
            alpha[t] = x / x.sum()
        for t in range(len(seq) - 2, -1, -1):
            x = model.step @ (model.emit[:, seq[t + 1]] * beta[t + 1])
            beta[t] = x / x.sum()
        after = alpha * beta
        after /= after.sum(axis=1, keepdims=True)
        first += after[0]
        np.add.at(emitted.T, seq, after)
        for t in range(1, len(seq)):
            x = np.outer(alpha[t - 1], model.emit[:, seq[t]] * beta[t]) * model.step
            steps += x / x.sum()
    return first, steps, emitted


def test_training_carries_over_stretches():
    rng = np.random.default_rng(6)
    emit, step = rng.random((3, 9)), rng.random((3, 3))
    model = hmm_scoring.Model(np.array([0.7, 0.2, 0.1]), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    codes = [rng.integers(0, 8, n) for n in (0, 3, 126, 127, 128, 129, 255, 256, 700)]
    for got, expected in zip(hmm_scoring.expectations(model, codes, 8), plain_expectations(model, codes, 8)):
        np.testing.assert_allclose(got, expected, rtol=2e-4, atol=1e-5)


def test_hmm_scores(docs):
    rows = {r["doc_id"]: r for r in hmm_scoring.hmm_scoring(docs, states=2, symbols=8, iterations=1).collect()}
    counts, tokens = collections.Counter(), {}
    for i, t in TEXTS:
        tokens[i] = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0


def brute_model(states, symbols, lookup, iterations):
    """Scores of the fixture, worked out in one place from the words themselves."""
    from setloom.llm._words import slices
    import pyarrow as pa

    every = {i: [w.lower() for w in words(t)] for i, t in TEXTS}
    hash_of = {w: int(next(iter(slices(pa.array([w.decode()]), lower=True))).hashes[0].view(np.int64)) for x in every.values() for w in x}
    train = [every[i] for i, _ in TEXTS if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    counts = collections.Counter(w for x in train for w in x)
    ranked = sorted(counts, key=lambda w: (-counts[w], hash_of[w]))
    least = 0
    held = 0
    for n in sorted(set(counts.values()), reverse=True):
        held += sum(1 for w in counts if counts[w] == n)
        if held > lookup:
            break
        least = n
    known = [w for w in ranked if counts[w] >= least] if len(ranked) > lookup else ranked
    assert len(ranked) > len(known) > symbols  # words of all classes
    code = {w: k if k < symbols else symbols for k, w in enumerate(known)}
    total = sum(counts.values()) + len(train) + 0.5 * (len(counts) + 2)
    middle = sum(counts[w] + 0.5 for w in known[symbols:])
    rest = total - sum(counts[w] + 0.5 for w in known) - len(train) - 0.5
    mass = np.array([counts[w] + 0.5 for w in known[:symbols]] + [middle, rest, len(train) + 0.5])
    background = mass / mass.sum()
    seq = lambda x: np.array([code.get(w, symbols + 1) for w in x], int)
    together = np.zeros((symbols, symbols))
    for x in train:
        own = np.unique(seq(x))
        own = own[own < symbols]
        together[np.ix_(own, own)] += 1
    model = hmm_scoring.first_model(together, background, states)
    smooth = lambda n, t, u, s: (n + (s * t + 1) * u) / (t + s * t + 1)
    for _ in range(iterations):
        first, steps, emitted = plain_expectations(model, [seq(x) for x in train], symbols + 2)
        t = emitted.sum(axis=1)
        emit = np.stack([smooth(emitted[k], t[k], background, 0.5) for k in range(states)])
        model = hmm_scoring.Model((first + 0.1) / (first + 0.1).sum(), (steps + 0.1) / (steps + 0.1).sum(axis=1, keepdims=True), emit)
    expected = {w: np.zeros(states) for w in counts}
    for x in train:
        c = np.append(seq(x), symbols + 2)
        own = [w for w in x if code.get(w, symbols + 1) >= symbols]
        # every such word as a symbol of its own
        names = sorted(set(own))
        place = {w: symbols + 3 + j for j, w in enumerate(names)}
        wide = hmm_scoring.Model(model.start, model.step, np.hstack([model.emit, np.stack([model.emit[:, code.get(w, symbols + 1)] for w in names], axis=1)]) if names else model.emit)
        emitted = plain_expectations(wide, [np.array([place.get(w, k) for w, k in zip(x, c)], int)], symbols + 2)[2]
        for w in names:
            expected[w] += emitted[:, place[w]]
    classes = {symbols: known[symbols:], symbols + 1: [w for w in counts if w not in code]}
    of_class = {k: sum((expected[w] for w in ws), np.zeros(states)) for k, ws in classes.items()}
    unigram = {symbols: lambda w: (counts[w] + 0.5) / middle, symbols + 1: lambda w: (counts[w] + 0.5) / rest}
    out = {}
    for i, x in every.items():
        rows = []
        for w in x:
            k = code.get(w, symbols + 1)
            rows.append(model.emit[:, k] * (1 if k < symbols else smooth(expected.get(w, np.zeros(states)), of_class[k], unigram[k](w), 1.0)))
        rows.append(model.emit[:, symbols + 2])
        a, log = None, 0.0
        for e in rows:
            a = model.start * e if a is None else (a @ model.step) * e
            log += math.log10(a.sum())
            a = a / a.sum()
        out[i] = log
    return out


def test_hmm_scores_equal_brute_force(docs):
    expected = brute_model(2, 8, 560, 2)
    trace = []
    for r in hmm_scoring.hmm_scoring(docs, states=2, symbols=8, lookup=560, iterations=2, trace=trace).collect():
        if r["doc_id"] != 15:
            assert r["score"] == pytest.approx(expected[r["doc_id"]], rel=2e-4), r["doc_id"]
    assert len(trace) == 2


def test_hmm_likelihood_rises(spark):
    trace = []
    df = spark.read.parquet(f"{SF}/documents.parquet")
    hmm_scoring.hmm_scoring(df, iterations=5, smoothing=0.0, trace=trace)
    assert all(b > a for a, b in zip(trace, trace[1:]))


def test_hmm_learns(spark):
    rows = hmm_scoring.op5_hmm_scoring(spark, SF).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


PAGE = "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='sidebar'>links</div>{}<form><input>Search</form><div id=comments><p>Nice!</p></div><footer>bye</footer></body></html>"


def test_html_extraction(spark):
    rows = [
        (1, "http://a.x/1", PAGE.replace("{}", "<article><header><h1>One&amp;only</h1></header><p>First <b>bold</b>\n text<p>Second<br>line &#233;</article>")),
        (2, "http://a.x/2", PAGE.replace("{}", "<div><h1>Two</h1><p>Body two</p><p>Read more on our site</p></div>")),
        (3, None, None),
        (4, "http://b.x/1", ""),
        (5, "http://b.x/2", "<p>open <p title='a>b'>closed <!-- <p>not</p> --> end"),
        (6, "http://b.x/3", "plain text only < 3 & more"),
    ] + [(10 + i, f"http://a.x/{i}", PAGE.replace("{}", f"<div><h1>Head {i}</h1><p>Body {i}</p><p>Read more on our site</p></div>")) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extraction.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "One&only\nFirst bold text\nSecond line é"
    assert got[3] == got[4] == ""
    assert got[5] == "open\nclosed end"
    assert got[6] == "plain text only < 3 & more"
    assert got[13] == "Head 3\nBody 3" or got[13] == "Head 3\nBody 3\nRead more on our site"


def test_wrapper_drops_what_never_varies(spark):
    rows = [(i, f"http://h.x/{i}", f"<body><div>Our site</div><div><h1>Head {i}</h1><p>Body {i}</p></div><div>All about us</div></body>") for i in range(8)]
    got = {r["page_id"]: r for r in html_extraction.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4]["text"] == "Head 4\nBody 4" and got[4]["n_template"] == 2


def test_copies_of_a_page_stay_content(spark):
    rows = [(i, f"http://h.x/{i}", "<body><h1>Same</h1><p>Body</p></body>") for i in range(8)]
    assert {r["text"] for r in html_extraction.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same\nBody"}


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return path, public.PATTERN, Tokenizer.from_file(path)


def test_token_counts_of_prefixes(docs):
    path, pattern, library = tokenizer()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in token_counts.token_counts(docs, path, pattern, budgets=(5, 1024), prefixes=True).collect():
        text = next(t or "" for i, t in TEXTS if i == r["doc_id"])
        assert (r["n_tokens"], r["n_bytes"]) == (count(text), len(text.encode())) and len(r["counts"]) == len(text) + 1
        some = range(0, len(text) + 1, max(1, len(text) // 60))
        assert [r["counts"][k] for k in some] == [count(text[:k]) for k in some]
        assert r["fits_5"] == max(k for k, n in enumerate(r["counts"]) if n <= 5)
    tool = token_counts.counter(path, pattern)
    for text in ("a  b   c \n\n x's don't  ", "日本 text <|endoftext|> ok", "\x1c\x1d a​b", "  lead", "", "ends in spaces   ", " \n "):
        table = tool.tables([text])[0]
        every = [count(text[:k]) for k in range(len(text) + 1)]
        assert [table.at(k) for k in range(len(text) + 1)] == every and table.every().tolist() == every
        assert [table.fits(b) for b in range(table.total + 1)] == [max(k for k, n in enumerate(every) if n <= b) for b in range(table.total + 1)]


def brute_hits(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pattern.findall((t or "").translate(lower))
    out = {}
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for item, text in items:
            x = split(text)
            n = min(10, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination(spark, docs, limit):
    items = [(1, "P3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 unlike"), (2, "second line"), (3, None), (4, "é one two"), (10, PASSAGE), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontamination.decontamination(docs, bench, broadcast_rows=limit).collect()}
    expected = brute_hits(TEXTS, items)
    assert got[7] == expected[7] and expected[7][4] and expected[11][4]
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in expected.items() if k is not None}


def test_line_dedup(docs):
    got = collections.defaultdict(list)
    for r in line_dedup.line_dedup(docs).collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["n_removed"] == 0 and got[2][0]["n_removed"] == 3 and got[2][0]["kept_text"] == ""
    assert got[14][0]["n_removed"] == 0 and [r["kept_text"] for r in got[15]] == ["zero\nfive"] * 2
    assert got[3][0]["n_lines"] == 0


def brute_removed(rows, width):
    owner, split = {}, {}
    for i, t in rows:
        split[i] = w = words(t)
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            owner[k] = min(owner.get(k, i), i)
    out = {}
    for i, w in split.items():
        gone = {j + k for j in range(len(w) - width + 1) if owner[tuple(w[j : j + width])] < i for k in range(width)}
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 0])
def test_substring_dedup(docs, hot):
    got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup.substring_dedup(docs, hot_copies=hot).collect()}
    assert got.pop(None)[1] == 0
    assert got == brute_removed([x for x in TEXTS if x[0] is not None], 50)


def test_substring_dedup_of_overlapping_passages(spark):
    rng = np.random.default_rng(5)
    pool = [f"q{k}" for k in range(400)]
    rows = []
    for i in range(60):
        a = int(rng.integers(0, 300))
        rows.append((i, " ".join([f"r{i}_{k}" for k in range(int(rng.integers(0, 30)))] + pool[a : a + int(rng.integers(40, 100))] + [f"s{i}"])))
    got = {r["doc_id"]: tuple(r)[1:4] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed(rows, 50)


def test_ids_of_any_type(spark, docs):
    named = docs.where("doc_id is not null").selectExpr("concat('id-', lpad(doc_id, 4, '0')) as doc_id", "text")
    plain = docs.where("doc_id is not null")
    name = lambda i: f"id-{i:04d}"
    expected = sorted((name(r["doc_id"]), r["n_shingles"], name(r["component_id"])) for r in ngram_jaccard.ngram_jaccard(plain).collect())
    assert sorted(tuple(r) for r in ngram_jaccard.ngram_jaccard(named).collect()) == expected
    expected = sorted((name(r["doc_id"]), r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(plain).collect())
    assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(named).collect()) == expected
    for op in (quality_rules.quality_rules, sharding.sharding, mixing.mixing, line_dedup.line_dedup, hmm_scoring.hmm_scoring):
        frame = named.withColumn("source", named["text"])
        assert {r["doc_id"] for r in op(frame).collect()} == {name(i) for i, _ in TEXTS if i is not None}
    assert {r["doc_id"] for r in token_counts.token_counts(named, *tokenizer()[:2]).collect()} == {name(i) for i, _ in TEXTS if i is not None}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 2000 - i) for i in range(40)] + [(3000, 3000 + i) for i in range(1, 50)]
    turns = []
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long"), turns).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 + i for i in range(40)} | {2000 - i: 1000 + i for i in range(40)} | {3000 + i: 3000 for i in range(50)}
    assert len(turns) <= 30


def test_line_dedup_of_long_texts(spark):
    import time

    def seconds(n):
        text = "\n".join(f"line {i}" + ("\n \n" if i % 7 == 0 else "") for i in range(n))
        df = spark.createDataFrame([(1, text), (2, text + "\nown\n\nend")], "doc_id long, text string")
        begun = time.perf_counter()
        rows = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
        assert rows[1]["kept_text"] == text and rows[2]["n_removed"] == n
        assert [x for x in rows[2]["kept_text"].split("\n") if x.strip()] == ["own", "end"]
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(40_000) < 30


def test_failed_lines_go_and_others_stay(spark):
    good = " ".join(f"A sentence number{i} that stands{i} here{i}, with enough{i} words." for i in range(12))
    menu = "Home\nAbout us\nContact\nNews\nJobs"
    other, third = (" ".join(w[0] + str(k) + w[1:] for w in good.split(" ")) for k in "89")
    text = f"{good}\n\n{menu}\n{other}\n\nWe use cookies. Click here for our privacy policy.\n{third}"
    long = good + " Our bakery sells every cookie that you can think of. " + good.upper()
    df = spark.createDataFrame([(1, text, 5, "w"), (2, long, 6, "x"), (3, menu, 7, "y"), (4, None, 8, "z")], "doc_id long, text string, whole int, kept string")
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert rows[1]["kept"] and rows[1]["n_failed_lines"] == 6 and rows[1]["cleaned_text"] == f"{good}\n\n{other}\n\n{third}"
    assert rows[2]["cleaned_text"] == long and rows[2]["n_failed_lines"] == 0 and not rows[3]["kept"] and rows[4]["cleaned_text"] == ""
    assert rows[1]["cleaned_chars"] == len(rows[1]["cleaned_text"]) and rows[1]["cleaned_sha256"] == hashlib.sha256(rows[1]["cleaned_text"].encode()).hexdigest()
    assert [tuple(r) for r in quality_rules.passing(df).orderBy("doc_id").collect()] == [(1, rows[1]["cleaned_text"], 5, "w"), (2, long, 6, "x")]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"]: r["cleaned_text"] for r in quality_rules.quality_rules(docs).where("kept").collect()}
    groups = brute_components(list(good.items()), 5, 80)
    one = {i for i in good if groups[i][1] == i}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(i, good[i]) for i in one], bench)
    clean = {i for i in one if not hits[i][4]}
    kept = docs.where(docs["doc_id"].isin(sorted(clean)))
    mix = {r["doc_id"]: r for r in mixing.mixing(kept, power=0.5).where("in_mix").collect()}
    got = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert set(got) == set(mix) and all(r["size"] == len(good[i].encode()) + 16 and r["source"] == (rows[i]["source"] or "") for i, r in got.items())
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the shares of the result are the weights, within a block, and those of every beginning of the mix are its own
    n = collections.Counter(rows[i]["source"] for i in clean)
    root = {s: x**0.5 / sum(y**0.5 for y in n.values()) for s, x in n.items()}
    share = collections.Counter(r["source"] for r in got.values())
    assert len(got) <= len(clean) and all(abs(share[s] - root[s] * len(got)) <= 16 + len(got) / 500 for s in n)
    first = sorted(got.values(), key=lambda r: r["mix_slot"])[: len(got) // 2]
    half = collections.Counter(r["source"] for r in first)
    assert all(abs(half[s] - share[s] / len(got) * len(first)) <= 32 for s in share)
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("source = 'src0' or doc_id % 5 = 0")
    n, share = (collections.Counter(r["source"] for r in df.select("source").collect()) for df in (more, P.to_weights(spark, more, SF)))
    total, roots = sum(share.values()), sum(x**0.5 for x in n.values())
    assert total < sum(n.values()) and all(abs(share[s] - x**0.5 / roots * total) <= 16 + total / 500 for s, x in n.items())
    # given weights hold over what is left
    sources = sorted({rows[i]["source"] for i in clean})[:2]
    P.WEIGHTS = {sources[0]: 0.75, sources[1]: 0.25}
    try:
        mix = collections.Counter(r["source"] for r in P.to_weights(spark, kept, SF).collect())
    finally:
        P.WEIGHTS = None
    assert set(mix) <= set(sources) and abs(mix[sources[0]] - 0.75 * sum(mix.values())) <= 16


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline as P

    text = "This is a sentence of a text that has enough words for the rules. " * 8
    rows = [(1, text + "One.", "a"), (1, text + "One.", "a"), (2, None, None), (3, "", "b"), (None, text + " ".join(f"Word{i} of it." for i in range(60)), None), (4, " ".join(f"Other{i} here." for i in range(80)), "b"), (5, " ".join(f"v{i * i % 9973}." for i in range(9000)), "c")]
    df = spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], "doc_id long, text string, source string, slot int, shard int, whole int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    # the row without an id is like none, its twin is like it; another one holds the item's words
    df = df.unionByName(df.where("doc_id is null")).unionByName(spark.createDataFrame([(None, "no such passage in any text here at all, is there " + " ".join(f"Thing{i} is so." for i in range(60)), "a", 1, 2, 3)], df.schema))
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("x", None), ("y", "no such passage in any text here at all, is there")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = df
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == df.columns, name
        if name.startswith("n-gram"):
            assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 0, 4, 5]
        if name == "benchmark decontamination":
            assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 4, 5]
    assert P.run(spark, str(tmp_path)).count() == got.count()
    df.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_decontamination_without_ids(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), (1, text), (None, "other words"), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", text)], "item_id string, text string")
    for rows in (1_000_000, 0):  # broadcast and shuffled fingerprints
        got = decontamination.decontamination(docs, bench, broadcast_rows=rows).collect()
        assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in got) == [(0, 0), (0, 10), (0, 10), (1, 10)]


def test_hmm_deals_no_word_twice(docs):
    """Rare words are dealt once to meet their expected counts, which carry how often they occur; only numbers go back to the rows."""
    plan = hmm_scoring.hmm_scoring(docs, states=2, symbols=8, lookup=8, iterations=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 2
    begin, different, which = hmm_scoring._numbered(np.array([0, 0, 2, 2, 2]), np.array([7, 5, 9, 7, 9], np.uint64), 4)
    assert begin.tolist() == [0, 2, 2, 4, 4] and different.tolist() == [5, 7, 7, 9] and which.tolist() == [1, 0, 1, 0, 1]


def test_hmm_deals_small_numbers(docs):
    """What is shuffled of a word are whole numbers of two bytes; they stand for all of its occurrences."""
    from setloom import shared

    before = len(shared.written)
    plan = hmm_scoring.hmm_scoring(docs, states=2, symbols=8, lookup=8, iterations=1)._jdf.queryExecution().analyzed().toString()
    path = next(p for p in shared.written[before:] if "/emissions-" in p)
    rows = docs.sparkSession.read.parquet(path).collect()
    assert rows and all(abs(r["n0"] + r["n1"] - r["n"] * 2**14) <= 2 * r["n"] + 2 for r in rows)
    assert "as smallint" in plan and "as float" not in plan
