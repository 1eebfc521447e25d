"""Category completion: direct, backed-off, graph-profile and user scorers, and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from setloom.operators import bundles as B
from setloom.operators import completion as C
from setloom.operators import graph as G
from setloom.plans.base import Model, sql
from setloom.plans.bundle_queries import rounded
from setloom.registry import query
from setloom.shared import stash

METRICS = ("mrr", "hit_at_1", "hit_at_3", "hit_at_5")
JUDGE = """SELECT h.bundle_id, (c.bundle_id IS NOT NULL)::INT AS covered, r.rank, CASE WHEN r.rank > 0 THEN 1.0 / r.rank ELSE 0 END AS mrr, coalesce((r.rank <= 1)::INT, 0) AS hit_at_1, coalesce((r.rank <= 3)::INT, 0) AS hit_at_3, coalesce((r.rank <= 5)::INT, 0) AS hit_at_5
FROM heldout h LEFT JOIN (SELECT DISTINCT bundle_id FROM {s}) c ON c.bundle_id = h.bundle_id
LEFT JOIN (SELECT bundle_id, category, row_number() OVER (PARTITION BY bundle_id ORDER BY round(score, 9) DESC, category) AS rank FROM {s}) r ON r.bundle_id = h.bundle_id AND r.category = h.category"""
MEANS = ", ".join(f"round(CASE WHEN max(covered) = 1 THEN avg({c}) FILTER (WHERE covered = 1) ELSE avg({c}) END, 9) AS {c}" for c in METRICS)
SUMMARY = f"count(*) AS n, round(avg(covered), 9) AS coverage, sum(covered)::BIGINT AS n_covered, {MEANS}, round(avg(rank) FILTER (WHERE covered = 1), 9) AS mean_rank"
COUNTS = {
    "ks": "SELECT bundle_id, unnest(range(1, (1 << len(names)))) AS m, names FROM (SELECT bundle_id, list(category ORDER BY category) AS names FROM tbc GROUP BY 1)",
    "cnt": "SELECT len(p) AS size, array_to_string(p, '|') AS key, count(*) AS count FROM (SELECT list_filter(names, lambda x, i: (m >> (i - 1)::INT) & 1 = 1) AS p FROM ks WHERE bit_count(m) <= 5) GROUP BY ALL",
    "obs": "SELECT bundle_id, list(category ORDER BY category) AS names FROM observed GROUP BY 1",
    "dom": "SELECT DISTINCT category FROM tbc",
    "direct": "SELECT bundle_id, d.category, coalesce(j.count, 0)::DOUBLE / s.count AS score FROM obs o JOIN cnt s ON s.key = array_to_string(o.names, '|') AND s.count >= 3, dom d LEFT JOIN cnt j ON j.key = array_to_string(list_sort(list_append(o.names, d.category)), '|') WHERE len(o.names) <= 4 AND NOT list_contains(o.names, d.category)",
    "parts": "SELECT bundle_id, names, list_filter(names, lambda x, i: (m >> (i - 1)::INT) & 1 = 1) AS p FROM (SELECT bundle_id, names, unnest(range(1, (1 << len(names)))) AS m FROM obs) WHERE bit_count(m) <= 2",
    "bk": "SELECT bundle_id, d.category, len(p) AS size, s.count AS support, coalesce(j.count, 0)::DOUBLE / s.count AS conf FROM parts o JOIN cnt s ON s.key = array_to_string(o.p, '|') AND s.count >= 3, dom d LEFT JOIN cnt j ON j.key = array_to_string(list_sort(list_append(o.p, d.category)), '|') WHERE NOT list_contains(o.names, d.category)",
    "bkr": "SELECT bk.*, conf / (c.count / (SELECT count(DISTINCT bundle_id)::DOUBLE FROM tbc)) AS up FROM bk JOIN cnt c ON c.key = bk.category",
    "backconf": "SELECT bundle_id, category, sum(size * support * conf) / sum(size * support) AS score FROM bkr GROUP BY ALL",
    "backlift": "SELECT bundle_id, category, sum(size * support * up) / sum(size * support) AS score FROM bkr GROUP BY ALL",
    "backpmi": "SELECT bundle_id, category, sum(size * support * CASE WHEN up > 0 THEN log2(up) ELSE -100.0 END) / sum(size * support) AS score FROM bkr GROUP BY ALL",
    "off": "SELECT a, b, count_w::DOUBLE AS w FROM cc WHERE a <> b AND count_w > 0",
    "dia": "SELECT a, count_w::DOUBLE AS d FROM cc WHERE a = b",
    "rs": "SELECT a, sum(w) AS s FROM off GROUP BY 1",
    "tr": "SELECT off.a, off.b, w AS raw_w, CASE WHEN d > 0 THEN w / d ELSE 0 END AS conditional, greatest(ln(w * (SELECT sum(w) FROM off) / (x.s * y.s)), 0) AS ppmi FROM off LEFT JOIN dia USING (a) JOIN rs x ON x.a = off.a JOIN rs y ON y.a = off.b",
} | {f"prof_{v}": f"SELECT o.bundle_id, t.b AS category, sum(t.{c}) / any_value(z.n) AS score FROM observed o JOIN tr t ON t.a = o.category JOIN (SELECT bundle_id, count(*) AS n FROM observed GROUP BY 1) z ON z.bundle_id = o.bundle_id WHERE NOT EXISTS (SELECT 1 FROM observed q WHERE q.bundle_id = o.bundle_id AND q.category = t.b) GROUP BY ALL" for v, c in (("raw", "raw_w"), ("conditional", "conditional"), ("ppmi", "ppmi"))}
#: Subsets of up to three observed categories, and the whole observed set up to five, as the reference takes them; the relations above stop at two and four.
DEEP = COUNTS | {"parts": COUNTS["parts"].replace("bit_count(m) <= 2", "bit_count(m) <= 3")}
WIDE = COUNTS | {"cnt": COUNTS["cnt"].replace("bit_count(m) <= 5", "bit_count(m) <= 6"), "direct": COUNTS["direct"].replace("len(o.names) <= 4", "len(o.names) <= 5")}
JUDGED = {f"j_{s}": JUDGE.format(s=s) for s in ("direct", "backconf", "backlift", "backpmi", "prof_raw", "prof_conditional", "prof_ppmi")}


def direct(m: Model, largest: int = 4):
    counts = B.itemsets(m.train_bc, largest + 1)
    return C.direct(m.observed, counts, m.train_bc, least=3, largest=largest)


def judged_direct(m: Model, largest: int = 4):
    counts = stash(B.itemsets(m.train_bc, largest + 1), "itemsets")
    return C.judged_sparse(*C.direct_sparse(m.observed, counts, 3, largest), m.observed, m.train_bc, m.heldout)


def backoff(m: Model, largest: int = 3):
    counts = stash(B.itemsets(m.train_bc, largest + 1), "itemsets")
    return C.backoff(m.observed, counts, 3, largest, m.train_bc.agg(F.count_distinct("bundle_id").alias("bundles")))


def judged_backoff(m: Model, largest: int = 3) -> dict:
    """The judged scores of each rule."""
    rows, covered = backoff(m, largest)
    return {r: C.judged_sparse(rows.select("bundle_id", "category", F.col(r).alias("score")), covered.select("bundle_id", F.lit(v).alias("rest")), m.observed, m.train_bc, m.heldout) for r, v in C.RULES.items()}


@query("completion_direct_confidence", sql(f"SELECT 'direct_confidence' AS method, {SUMMARY} FROM j_direct", **COUNTS, **JUDGED))
def completion(spark, d):
    m = Model(spark, d)
    return rounded(C.summary(judged_direct(m).withColumn("method", F.lit("direct_confidence")), "method"), "coverage", "mean_rank", *METRICS)


@query("a15_direct_scores", sql("SELECT bundle_id, category, round(score, 9) AS score FROM direct WHERE score > 0", **COUNTS))
def a15(spark, d):
    m = Model(spark, d)
    return rounded(C.direct_sparse(m.observed, stash(B.itemsets(m.train_bc, 5), "itemsets"), 3, 4)[0], "score")


def backoff_methods(m: Model, largest: int):
    every = [judged.withColumn("method", F.lit(r)) for r, judged in judged_backoff(m, largest).items()]
    return rounded(C.summary(every[0].unionByName(every[1]).unionByName(every[2]), "method"), "coverage", "mean_rank", *METRICS)


@query("a16_backoff_methods", sql(" UNION ALL ".join(f"SELECT '{n}' AS method, {SUMMARY} FROM j_{s}" for n, s in (("confidence", "backconf"), ("lift", "backlift"), ("pmi", "backpmi"))), **DEEP, **JUDGED))
def a16(spark, d):
    return backoff_methods(Model(spark, d), 3)


@query("a17_heldout_ranks", sql("SELECT bundle_id, covered, rank, round(mrr, 9) AS mrr, hit_at_1, hit_at_3, hit_at_5 FROM j_direct", **COUNTS, **JUDGED))
def a17(spark, d):
    m = Model(spark, d)
    return rounded(judged_direct(m).withColumn("rank", F.col("rank").cast("long")), "mrr")


@query(
    "a18_grouped_summary",
    sql("SELECT CASE WHEN grouping(observed_size) = 0 THEN 'observed_size' WHEN grouping(covered) = 0 THEN 'covered' ELSE 'all' END AS grouping, CASE WHEN grouping(observed_size) = 0 THEN observed_size WHEN grouping(covered) = 0 THEN covered END AS value, count(*) AS n, " + ", ".join(f"round(avg({c}) FILTER (WHERE covered = 1), 9) AS {c}" for c in METRICS) + " FROM (SELECT j.*, len(o.names)::BIGINT AS observed_size FROM j_direct j JOIN obs o USING (bundle_id)) GROUP BY GROUPING SETS ((), (observed_size), (covered))", **COUNTS, **JUDGED),
)
def a18(spark, d):
    m = Model(spark, d)
    size = m.observed.groupBy("bundle_id").agg(F.count("*").alias("observed_size"))
    return rounded(C.summary_sets(judged_direct(m).join(size, "bundle_id")), *METRICS)


@query("a24_profile_scores", sql("SELECT bundle_id, category, round(score, 9) AS score FROM prof_conditional", **COUNTS))
def a24(spark, d):
    m = Model(spark, d)
    return rounded(G.profile_scores(m.observed, G.transforms(m.cc, "count_w"), "conditional"), "score")


@query("a25_profile_methods", sql(" UNION ALL ".join(f"SELECT '{v}' AS method, {SUMMARY} FROM j_prof_{v}" for v in ("raw", "conditional", "ppmi")), **COUNTS, **JUDGED))
def a25(spark, d):
    m = Model(spark, d)
    table = stash(G.transforms(m.cc, "count_w"), "category-profiles")
    every = [C.judged(G.profile_scores(m.observed, table, v), m.heldout).withColumn("method", F.lit(v)) for v in ("raw", "conditional", "ppmi")]
    return rounded(C.summary(every[0].unionByName(every[1]).unionByName(every[2]), "method"), "coverage", "mean_rank", *METRICS)


QUAD = "SELECT CASE WHEN a.hit_at_3 = 1 AND b.hit_at_3 = 1 THEN 'both' WHEN a.hit_at_3 = 1 THEN 'first_only' WHEN b.hit_at_3 = 1 THEN 'second_only' ELSE 'neither' END AS q FROM j_prof_conditional a JOIN j_backconf b USING (bundle_id)"


def profile_and_backoff(m: Model, largest: int):
    first = C.judged(G.profile_scores(m.observed, G.transforms(m.cc, "count_w"), "conditional"), m.heldout)
    return rounded(C.quadrants(first, judged_backoff(m, largest)["confidence"], 3), "ratio")


@query("a26_quadrants", sql("SELECT v.q AS quadrant, count(qd.q) AS n, round(count(qd.q) / (SELECT count(*) FROM qd)::DOUBLE, 9) AS ratio FROM (VALUES ('both'), ('first_only'), ('second_only'), ('neither')) v(q) LEFT JOIN qd ON qd.q = v.q GROUP BY v.q", **DEEP, **JUDGED, qd=QUAD))
def a26(spark, d):
    return profile_and_backoff(Model(spark, d), 3)


USER = {
    "uc": "SELECT DISTINCT user_id, category FROM ui JOIN it USING (item_id)",
    "us": "SELECT category, count(*) AS n FROM uc GROUP BY 1",
    "up": "SELECT x.category AS a, y.category AS b, count(*) AS n FROM uc x JOIN uc y ON x.user_id = y.user_id AND x.category <> y.category GROUP BY ALL",
    "sup": "SELECT o.bundle_id, up.b AS category, sum(up.n / us.n::DOUBLE) / any_value(z.n) AS score, sum(up.n)::BIGINT AS pair_support FROM observed o JOIN us ON us.category = o.category JOIN up ON up.a = o.category JOIN (SELECT bundle_id, count(*) AS n FROM observed GROUP BY 1) z ON z.bundle_id = o.bundle_id WHERE NOT EXISTS (SELECT 1 FROM observed q WHERE q.bundle_id = o.bundle_id AND q.category = up.b) GROUP BY ALL",
}


def user_support(m: Model):
    uc = m.ui.join(m.items, "item_id").select("user_id", "category").distinct()
    return C.mean_support(m.observed, G.cooccurrence(uc, "user_id", "category"), uc.groupBy("category").agg(F.count("*").alias("n")))


@query("a12_user_category_pairs", sql("SELECT a, b, n FROM up", **USER))
def a12(spark, d):
    m = Model(spark, d)
    return G.cooccurrence(m.ui.join(m.items, "item_id").select("user_id", "category").distinct(), "user_id", "category")


@query("a13_user_support", sql("SELECT bundle_id, category, round(score, 9) AS score, pair_support FROM sup", **USER))
def a13(spark, d):
    return rounded(user_support(Model(spark, d)), "score")


@query("w11_user_prior_topk", sql("SELECT bundle_id, category, round(score, 9) AS score, pair_support, place FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY round(score, 9) DESC, pair_support DESC, us.n DESC, category) AS place FROM sup JOIN us USING (category)) WHERE place <= 3", **USER))
def w11(spark, d):
    from pyspark.sql.window import Window

    m = Model(spark, d)
    single = m.ui.join(m.items, "item_id").select("user_id", "category").distinct().groupBy("category").agg(F.count("*").alias("n"))
    scored = rounded(user_support(m), "score").join(single, "category")
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy(F.desc("score"), F.desc("pair_support"), F.desc("n"), "category")).cast("long")
    return scored.withColumn("place", place).where("place <= 3").select("bundle_id", "category", "score", "pair_support", "place")


@query("a14_graph_prior", sql("SELECT o.bundle_id, c.b AS category, round(sum(c.binary_w / s.binary_w::DOUBLE) / any_value(z.n), 9) AS score, sum(c.binary_w)::BIGINT AS pair_support FROM observed o JOIN cc s ON s.a = o.category AND s.b = s.a JOIN cc c ON c.a = o.category AND c.b <> c.a JOIN (SELECT bundle_id, count(*) AS n FROM observed GROUP BY 1) z ON z.bundle_id = o.bundle_id WHERE NOT EXISTS (SELECT 1 FROM observed q WHERE q.bundle_id = o.bundle_id AND q.category = c.b) GROUP BY o.bundle_id, c.b"))
def a14(spark, d):
    m = Model(spark, d)
    pairs = m.cc.where("a <> b").select("a", "b", F.col("binary_w").alias("n"))
    return rounded(C.mean_support(m.observed, pairs, m.cc.where("a = b").select(F.col("a").alias("category"), F.col("binary_w").alias("n"))), "score")
