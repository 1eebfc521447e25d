"""Queries over bundles, categories and graphs, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from setloom.functions import exprs as X
from setloom.operators import bundles as B
from setloom.operators import graph as G
from setloom.plans.base import Model, sql
from setloom.registry import query

R = lambda c, n=9: F.round(c, n).alias(c)


def rounded(df, *names):
    return df.select(*[R(c) if c in names else F.col(c) for c in df.columns])


@query("s02_incidence", sql("SELECT bundle_id, item_id, count(*) AS value FROM raw GROUP BY ALL"))
def s02(spark, d):
    return Model(spark, d).raw.groupBy("bundle_id", "item_id").agg(F.count("*").alias("value"))


@query("s03_train_bundles", sql("SELECT bundle_id, item_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, item_id ORDER BY pos) AS r, count(DISTINCT item_id) OVER (PARTITION BY bundle_id) AS c FROM raw WHERE bundle_id % 10 < 7) WHERE r = 1 AND c >= 2"))
def s03(spark, d):
    kept = B.keep_first(Model(spark, d).raw.where("bundle_id % 10 < 7"), "pos")
    wide = kept.groupBy("bundle_id").agg(F.count("*").alias("c")).where("c >= 2").select("bundle_id")
    return kept.join(wide, "bundle_id", "left_semi").select("bundle_id", "item_id", "pos")


@query("s06_dimensions", sql("SELECT (SELECT max(o_custkey) + 1 FROM orders) AS num_users, (SELECT max(bundle_id) + 1 FROM bi) AS num_bundles, (SELECT max(item_id) + 1 FROM it) AS num_items"))
def s06(spark, d):
    m = Model(spark, d)
    users = m.table("orders").agg((F.max("o_custkey") + 1).alias("num_users"))
    return users.join(m.bi.agg((F.max("bundle_id") + 1).alias("num_bundles"))).join(m.items.agg((F.max("item_id") + 1).alias("num_items")))


@query("a01_dedup_stats", sql("SELECT count(*) AS bundles, sum(r)::BIGINT AS raw_pairs, sum(u)::BIGINT AS unique_pairs, sum(r - u)::BIGINT AS removed, count(*) FILTER (WHERE r > u) AS bundles_with_duplicates, round(avg(r), 9) AS raw_avg, round(avg(u), 9) AS unique_avg FROM (SELECT bundle_id, count(*) AS r, count(DISTINCT item_id) AS u FROM raw GROUP BY 1)"))
def a01(spark, d):
    return rounded(B.dedup_stats(Model(spark, d).raw), "raw_avg", "unique_avg")


@query("a02_item_popularity", sql("SELECT item_id, count(*) AS freq FROM bi GROUP BY 1"))
def a02(spark, d):
    return B.popularity(Model(spark, d).bi)


@query("a03_item_idf", sql("SELECT item_id, round(ln(((SELECT count(DISTINCT bundle_id) FROM train) + 1.0) / (count(*) + 1)), 9) AS idf FROM train GROUP BY 1"))
def a03(spark, d):
    return rounded(B.idf(Model(spark, d).train), "idf")


@query("a04_bundle_detail", sql("SELECT bundle_id, sum(n)::BIGINT AS items, count(*) AS categories, 0::BIGINT AS missing, max(n) AS largest, string_agg(category, '|' ORDER BY category) AS category_set, (max(n) > 1)::INT AS repeated FROM bc GROUP BY 1"))
def a04(spark, d):
    m = Model(spark, d)
    return B.bundle_detail(m.bi, m.items)


@query("a05_category_frequency", sql("SELECT category, count(*) AS bundles, sum(n)::BIGINT AS items, round(count(*) / (SELECT count(DISTINCT bundle_id) FROM bc)::DOUBLE, 9) AS bundle_ratio, round(sum(n) / (SELECT sum(n) FROM bc)::DOUBLE, 9) AS item_ratio FROM bc GROUP BY 1"))
def a05(spark, d):
    return rounded(B.category_frequency(Model(spark, d).bc), "bundle_ratio", "item_ratio")


PAIRS = {
    "f": "SELECT category, count(*)::DOUBLE AS f FROM bc GROUP BY 1",
    "nb": "SELECT count(DISTINCT bundle_id)::DOUBLE AS n FROM bc",
    "pr": "SELECT x.category AS a, y.category AS b, count(*) AS c FROM bc x JOIN bc y ON x.bundle_id = y.bundle_id AND x.category < y.category GROUP BY ALL",
}


@query("a06_category_pairs", sql("SELECT a, b, c AS count, round(c / n, 9) AS support, round(c / fa.f, 9) AS p_b_given_a, round(c / fb.f, 9) AS p_a_given_b, round(c * n / (fa.f * fb.f), 9) AS lift, round(log2(c * n / (fa.f * fb.f)), 9) AS pmi FROM pr JOIN f fa ON fa.category = a JOIN f fb ON fb.category = b, nb", **PAIRS))
def a06(spark, d):
    return rounded(B.category_pairs(Model(spark, d).bc), "support", "p_b_given_a", "p_a_given_b", "lift", "pmi")


@query("a07_set_patterns", sql("SELECT s AS category_set, z AS size, count(*) AS count, round(count(*) / (SELECT count(DISTINCT bundle_id) FROM bc)::DOUBLE, 9) AS ratio FROM (SELECT bundle_id, string_agg(category, '|' ORDER BY category) AS s, count(*) AS z FROM bc GROUP BY 1) GROUP BY ALL"))
def a07(spark, d):
    return rounded(B.set_patterns(Model(spark, d).bc), "ratio")


ITEMSETS = {
    "sets": "SELECT 1 AS size, category AS key, count(*) AS count FROM bc GROUP BY ALL UNION ALL SELECT 2, x.category || '|' || y.category, count(*) FROM bc x JOIN bc y ON x.bundle_id = y.bundle_id AND x.category < y.category GROUP BY ALL UNION ALL SELECT 3, x.category || '|' || y.category || '|' || z.category, count(*) FROM bc x JOIN bc y ON x.bundle_id = y.bundle_id AND x.category < y.category JOIN bc z ON z.bundle_id = y.bundle_id AND y.category < z.category GROUP BY ALL",
}


@query("a08_itemset_patterns", sql("SELECT size, key, count FROM sets WHERE size IN (2, 3)", **ITEMSETS))
def a08(spark, d):
    return B.itemsets(Model(spark, d).bc, 3).where("size in (2, 3)")


RULES = {
    "nb": PAIRS["nb"],
    "one": "SELECT category AS key, count(*) AS count FROM bc GROUP BY 1",
    "two": "SELECT x.category AS a, y.category AS b, count(*) AS count FROM bc x JOIN bc y ON x.bundle_id = y.bundle_id AND x.category < y.category GROUP BY ALL",
    "three": "SELECT x.category AS a, y.category AS b, z.category AS c, count(*) AS count FROM bc x JOIN bc y ON x.bundle_id = y.bundle_id AND x.category < y.category JOIN bc z ON z.bundle_id = y.bundle_id AND y.category < z.category GROUP BY ALL",
    "rules": """SELECT a AS antecedent, b AS consequent, count AS joint FROM two WHERE count >= 2 UNION ALL SELECT b, a, count FROM two WHERE count >= 2
        UNION ALL SELECT a || '|' || b, c, count FROM three WHERE count >= 2 UNION ALL SELECT a || '|' || c, b, count FROM three WHERE count >= 2 UNION ALL SELECT b || '|' || c, a, count FROM three WHERE count >= 2""",
    "base": "SELECT key, count FROM one UNION ALL SELECT a || '|' || b, count FROM two",
}


@query("a09_association_rules", sql("SELECT antecedent, consequent, joint, round(joint / n, 9) AS support, round(joint / p.count::DOUBLE, 9) AS confidence, round(joint / p.count::DOUBLE * n / q.count, 9) AS lift, round(log2(joint / p.count::DOUBLE * n / q.count), 9) AS pmi FROM rules JOIN base p ON p.key = antecedent JOIN one q ON q.key = consequent, nb", **RULES))
def a09(spark, d):
    return rounded(B.association_rules(Model(spark, d).bc), "support", "confidence", "lift", "pmi")


@query(
    "a10_dataset_summary",
    sql(
        """SELECT count(*) AS bundles, round(avg(items), 9) AS items_avg, median(items)::DOUBLE AS items_median, round(avg(cats), 9) AS categories_avg, median(cats)::DOUBLE AS categories_median, round(avg((big > 1)::INT), 9) AS repeated_rate, round(count(DISTINCT s) / count(*)::DOUBLE, 9) AS unique_set_ratio,
        (SELECT count(DISTINCT category) FROM bc) AS categories, (SELECT round(sum(-p * log2(p)), 9) FROM (SELECT sum(n) / (SELECT sum(n) FROM bc)::DOUBLE AS p FROM bc GROUP BY category)) AS category_entropy,
        (SELECT s FROM det GROUP BY s ORDER BY count(*) DESC, s DESC LIMIT 1) AS top_set, (SELECT max(c) FROM (SELECT count(*) AS c FROM det GROUP BY s)) AS top_set_count FROM det""",
        det="SELECT bundle_id, sum(n)::BIGINT AS items, count(*) AS cats, max(n) AS big, string_agg(category, '|' ORDER BY category) AS s FROM bc GROUP BY 1",
    ),
)
def a10(spark, d):
    m = Model(spark, d)
    return rounded(B.dataset_summary(m.bi, m.items), "items_avg", "categories_avg", "repeated_rate", "unique_set_ratio", "category_entropy")


@query("a11_itemset_counters", sql("SELECT size, key, count(*) AS count FROM (SELECT bundle_id, category AS key, 1 AS size FROM tbc UNION ALL SELECT x.bundle_id, x.category || '|' || y.category, 2 FROM tbc x JOIN tbc y ON x.bundle_id = y.bundle_id AND x.category < y.category) GROUP BY ALL"))
def a11(spark, d):
    return B.itemsets(Model(spark, d).train_bc, 2)


@query("a42_train_graph_stats", sql("SELECT (SELECT count(DISTINCT bundle_id) FROM train) AS bundles, count(*) AS items, round(count(*) / (SELECT count(*) FROM it)::DOUBLE, 9) AS coverage, round(avg(f), 9) AS freq_avg, median(f)::DOUBLE AS freq_median, max(f) AS freq_max FROM (SELECT item_id, count(*) AS f FROM train GROUP BY 1)"))
def a42(spark, d):
    m = Model(spark, d)
    freq = B.popularity(m.train).agg(F.count("*").alias("items"), F.avg("freq").alias("freq_avg"), F.median("freq").alias("freq_median"), F.max("freq").alias("freq_max"))
    every = m.items.agg(F.count("*").alias("all"))
    return rounded(m.train.agg(F.count_distinct("bundle_id").alias("bundles")).join(freq).join(every).select("bundles", "items", (F.col("items") / F.col("all")).alias("coverage"), "freq_avg", "freq_median", "freq_max"), "coverage", "freq_avg")


@query("a49_input_lengths", sql("SELECT size, count(*) AS bundles FROM (SELECT bundle_id, count(*) AS size FROM bi GROUP BY 1) GROUP BY 1"))
def a49(spark, d):
    return B.input_lengths(Model(spark, d).bi)


@query("a54_matrix_summary", sql("SELECT count(*) AS nnz, sum(n)::BIGINT AS total, round(avg(n), 9) AS mean_count, round(avg((n > 1)::INT), 9) AS repeated_rate, (SELECT count(*) FROM cc WHERE a <> b) AS cc_offdiagonal FROM tbc"))
def a54(spark, d):
    m = Model(spark, d)
    head = m.train_bc.agg(F.count("*").alias("nnz"), F.sum("n").alias("total"), F.avg("n").alias("mean_count"), F.avg((F.col("n") > 1).cast("int")).alias("repeated_rate"))
    return rounded(head.join(m.cc.where("a <> b").agg(F.count("*").alias("cc_offdiagonal"))), "mean_count", "repeated_rate")


@query("f04_category_field", sql("SELECT 0 AS place, 'category' AS field, count(*) FILTER (WHERE trim(category) <> '') AS filled FROM it UNION ALL SELECT 1, 'kind', count(*) FILTER (WHERE trim(kind) <> '') FROM it UNION ALL SELECT 2, 'title', count(*) FILTER (WHERE trim(title) <> '') FROM it"))
def f04(spark, d):
    return B.category_field(Model(spark, d).items, ["category", "kind", "title"])


@query("x05_distinct_ids", sql("SELECT DISTINCT item_id FROM (SELECT item_id FROM samples UNION ALL SELECT item_id FROM inputs)"))
def x05(spark, d):
    m = Model(spark, d)
    arrays = m.samples.groupBy("bundle_id").agg(F.collect_list("item_id").alias("options")).join(m.inputs.groupBy("bundle_id").agg(F.collect_list("item_id").alias("inputs")), "bundle_id")
    return B.distinct_ids(arrays, "options", "inputs")


@query("j01_item_affiliation", sql("SELECT x.item_id AS a, y.item_id AS b, sum(x.value * y.value)::BIGINT AS n FROM inc x JOIN inc y ON x.bundle_id = y.bundle_id AND x.item_id <> y.item_id GROUP BY ALL", inc="SELECT bundle_id, item_id, count(*) AS value FROM raw GROUP BY ALL"))
def j01(spark, d):
    counted = Model(spark, d).raw.groupBy("bundle_id", "item_id").agg(F.count("*").alias("value"))
    return G.cooccurrence(counted, "bundle_id", "item_id", F.col("value"))


@query("j02_copurchase", sql("SELECT x.item_id AS a, count(DISTINCT y.item_id) AS partners, count(*) AS n FROM ui x JOIN ui y ON x.user_id = y.user_id AND x.item_id <> y.item_id GROUP BY 1"))
def j02(spark, d):
    per = lambda met: met.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.count("*").alias("partners"), F.sum("n").alias("n"))
    return G.pairs_in_turn(Model(spark, d).ui, "user_id", "item_id", per)


@query("j04_bundle_category", sql("SELECT bundle_id, category, n FROM bc"))
def j04_bc(spark, d):
    return Model(spark, d).bc


@query("j04_category_graph", sql("SELECT a, b, count_w, binary_w FROM cc"))
def j04_cc(spark, d):
    return Model(spark, d).cc


@query("j05_inverted_index", sql("SELECT item_id, count(*) AS bundles, min(bundle_id) AS first_bundle FROM train WHERE item_id IN (SELECT item_id FROM samples) GROUP BY 1"))
def j05(spark, d):
    m = Model(spark, d)
    return m.train.join(m.samples.select("item_id").distinct(), "item_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("bundles"), F.min("bundle_id").alias("first_bundle"))


@query(
    "a22_graph_stats",
    sql(
        """SELECT count(*) AS nodes, (sum(deg) / 2)::BIGINT AS edges, round(avg(deg), 9) AS degree_avg, median(deg)::DOUBLE AS degree_median, max(deg) AS degree_max, round(avg(w), 9) AS weighted_avg, max(w) AS weighted_max, sum(w) / 2 AS total_weight,
        (SELECT count(*) FROM cc WHERE a = b AND binary_w > 0) AS diagonal, (SELECT count(DISTINCT l) FROM lab) AS components, (SELECT max(c) FROM (SELECT count(*) AS c FROM lab GROUP BY l)) AS largest_component, (SELECT count(*) FROM (SELECT l FROM lab GROUP BY l HAVING count(*) = 1)) AS isolated,
        round(sum(deg) / 2 / (count(*) * (count(*) - 1) / 2.0), 9) AS density FROM dg""",
        off="SELECT a, b, binary_w FROM cc WHERE a <> b AND binary_w > (SELECT max(binary_w) FROM cc WHERE a <> b) * 0.6",
        nod="SELECT DISTINCT category AS node FROM it",
        dg="SELECT node, coalesce(d, 0)::BIGINT AS deg, coalesce(w, 0)::BIGINT AS w FROM nod LEFT JOIN (SELECT a, count(*) AS d, sum(binary_w) AS w FROM off GROUP BY 1) ON a = node",
        reach="SELECT node AS s, node AS t FROM nod UNION SELECT s, b FROM reach JOIN off ON a = t",
        lab="SELECT s, min(t) AS l FROM reach GROUP BY 1",
    ),
)
def a22(spark, d):
    m = Model(spark, d)
    most = m.cc.where("a <> b").agg((F.max("binary_w") * 0.6).alias("least"))
    strong = m.cc.join(F.broadcast(most)).where("a = b or binary_w > least").drop("least")
    return rounded(G.graph_stats(m.items, strong, "binary_w"), "degree_avg", "weighted_avg", "density")


TRANSFORMS = {
    "off": "SELECT a, b, count_w::DOUBLE AS w FROM cc WHERE a <> b AND count_w > 0",
    "dia": "SELECT a, count_w::DOUBLE AS d FROM cc WHERE a = b",
    "rs": "SELECT a, sum(w) AS s FROM off GROUP BY 1",
    "tr": "SELECT off.a, off.b, w AS raw_w, CASE WHEN d > 0 THEN w / d ELSE 0 END AS conditional, greatest(ln(w * (SELECT sum(w) FROM off) / (x.s * y.s)), 0) AS ppmi FROM off LEFT JOIN dia USING (a) JOIN rs x ON x.a = off.a JOIN rs y ON y.a = off.b",
}


@query("a23_transforms", sql("SELECT a, b, raw_w AS raw, round(conditional, 9) AS conditional, round(ppmi, 9) AS ppmi FROM tr", **TRANSFORMS))
def a23(spark, d):
    return rounded(G.transforms(Model(spark, d).cc, "count_w"), "conditional", "ppmi")


@query("w06_top_neighbours", sql("SELECT a, b, raw_w AS raw, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY raw_w DESC, b) AS place FROM tr) WHERE place <= 5", **TRANSFORMS))
def w06(spark, d):
    return G.neighbours(G.transforms(Model(spark, d).cc, "count_w"), "raw", 5).select("a", "b", "raw", "place")


PAIR_TABLE = {
    "fr": "SELECT a AS c, binary_w::DOUBLE AS f FROM cc WHERE a = b",
    "pt": "SELECT a, b, count_w, binary_w, binary_w / x.f AS p_b_given_a, binary_w / y.f AS p_a_given_b, binary_w * (SELECT max(f) FROM fr) / (x.f * y.f) AS lift FROM cc JOIN fr x ON x.c = a JOIN fr y ON y.c = b WHERE a < b",
}


@query("t03_pair_table", sql("SELECT a, b, count_w, binary_w, round(p_b_given_a, 9) AS p_b_given_a, round(p_a_given_b, 9) AS p_a_given_b, round(lift, 9) AS lift, round(ln(lift), 9) AS pmi, round(greatest(ln(lift), 0), 9) AS ppmi FROM pt", **PAIR_TABLE))
def t03(spark, d):
    return rounded(G.pair_table(Model(spark, d).cc), "p_b_given_a", "p_a_given_b", "lift", "pmi", "ppmi")


@query("w18_top_pairs", sql("SELECT a, b, count_w, binary_w FROM pt ORDER BY binary_w DESC, count_w DESC, a, b LIMIT 200", **PAIR_TABLE))
def w18(spark, d):
    return G.top_pairs(G.pair_table(Model(spark, d).cc), 200).select("a", "b", "count_w", "binary_w")


SOFT = {"soft": "SELECT item_id, bundle_id FROM (SELECT i.item_id, t.bundle_id, row_number() OVER (PARTITION BY i.item_id ORDER BY t.bundle_id) AS r FROM (SELECT DISTINCT item_id, category, kind FROM it) i JOIN (SELECT item_id, min(bundle_id) AS bundle_id FROM train GROUP BY 1) t ON t.item_id = i.item_id) WHERE r = 1"}


@query("j03_soft_expansion", sql("SELECT a, b, round(sum(w), 9) AS w FROM (SELECT x.item_id AS a, y.item_id AS b, count(*)::DOUBLE AS w FROM train x JOIN train y ON x.bundle_id = y.bundle_id AND x.item_id <> y.item_id GROUP BY ALL UNION ALL SELECT s.item_id, y.item_id, count(*) * 0.5 FROM soft s JOIN train y ON y.bundle_id = s.bundle_id AND y.item_id <> s.item_id GROUP BY ALL) GROUP BY ALL", **SOFT))
def j03(spark, d):
    m = Model(spark, d)
    links = m.train.groupBy("item_id").agg(F.min("bundle_id").alias("bundle_id"))
    return rounded(G.soft_expansion(G.cooccurrence(m.train, "bundle_id", "item_id"), links, m.train, 0.5), "w")


@query("f05_canonical_keys", sql("SELECT bundle_id, string_agg(category, '|' ORDER BY category) AS key FROM bc GROUP BY 1"))
def f05(spark, d):
    return Model(spark, d).bc.groupBy("bundle_id").agg(X.canonical(F.collect_list("category")).alias("key"))
