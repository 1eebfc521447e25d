"""Queries in SQL alone, over the functions that :mod:`setloom.functions.sql` registers."""

from __future__ import annotations

from setloom.functions import sql as S
from setloom.plans.base import Model, sql
from setloom.plans.completion_queries import COUNTS, JUDGED, SUMMARY
from setloom.plans.vector_queries import UNIT
from setloom.registry import query

COMPLETION = """
WITH sets AS (SELECT bundle_id, array_sort(collect_set(category)) AS names FROM {train_bc} GROUP BY bundle_id),
counts AS (SELECT canonical_key(part) AS key, any_value(part) AS part, any_value(p.size) AS size, count(*) AS n FROM sets, LATERAL subsets(names, 5) p GROUP BY 1),
asked AS (SELECT bundle_id, array_sort(collect_set(category)) AS names FROM {observed} GROUP BY bundle_id HAVING count(DISTINCT category) <= 4),
known AS (SELECT bundle_id, names, canonical_key(names) AS key, n AS support FROM asked JOIN counts ON key = canonical_key(names) WHERE n >= 3),
domain AS (SELECT DISTINCT category FROM {train_bc}),
scored AS (
  SELECT k.bundle_id, d.category, round(coalesce(j.n, 0) / k.support, 9) AS score
  FROM known k JOIN domain d ON NOT array_contains(k.names, d.category) LEFT JOIN counts j ON j.key = canonical_key(array_append(k.names, d.category))),
placed AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, category) AS place FROM scored),
judged AS (
  SELECT h.bundle_id, CAST(c.bundle_id IS NOT NULL AS INT) AS covered, p.place, reciprocal_rank(p.place) AS mrr, hit_at(p.place, 1) AS h1, hit_at(p.place, 3) AS h3, hit_at(p.place, 5) AS h5
  FROM {heldout} h LEFT JOIN (SELECT DISTINCT bundle_id FROM scored) c USING (bundle_id) LEFT JOIN placed p ON p.bundle_id = h.bundle_id AND p.category = h.category)
SELECT 'direct_confidence' AS method, count(*) AS n, round(avg(covered), 9) AS coverage, sum(covered) AS n_covered, round(avg(place) FILTER (WHERE covered = 1), 9) AS mean_rank,
       round(avg(mrr) FILTER (WHERE covered = 1), 9) AS mrr, round(avg(h1) FILTER (WHERE covered = 1), 9) AS hit_at_1, round(avg(h3) FILTER (WHERE covered = 1), 9) AS hit_at_3, round(avg(h5) FILTER (WHERE covered = 1), 9) AS hit_at_5
FROM judged
"""


@query("sql_completion", sql(f"SELECT 'direct_confidence' AS method, {SUMMARY} FROM j_direct", **COUNTS, **JUDGED))
def completion(spark, d):
    """The completion query over ``subsets``, ``canonical_key`` and the metrics; the table of categories, which it fills zeros from, is bounded by the data model."""
    S.register(spark)
    m = Model(spark, d)
    return spark.sql(COMPLETION, train_bc=m.train_bc, observed=m.observed, heldout=m.heldout)


@query("sql_mean_vectors", sql("SELECT category, n, round(sqrt(list_sum(list_transform(m, lambda y: y * y))), 8) AS norm FROM proto", **UNIT))
def means(spark, d):
    """Mean vectors of categories, coordinate by coordinate, and their lengths."""
    S.register(spark)
    m = Model(spark, d)
    body = """WITH c AS (SELECT category, i, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM {vectors} JOIN {items} USING (item_id), LATERAL posexplode(embedding) AS e(i, x) GROUP BY category, i),
      p AS (SELECT category, max(n) AS n, transform(array_sort(collect_list(struct(i, x))), s -> s.x) AS v FROM c GROUP BY category)
      SELECT category, n, round(sqrt(dot_product(v, v)), 8) AS norm FROM p"""
    return spark.sql(body, vectors=m.vectors, items=m.items)


@query("sql_rank_metrics", "SELECT p_partkey AS item_id, round(1.0 / (p_partkey % 12 + 1), 9) AS mrr, (p_partkey % 12 + 1 <= 3)::INT AS hit, round(CASE WHEN p_partkey % 12 + 1 <= 10 THEN 1.0 / log2(p_partkey % 12 + 2) ELSE 0 END, 9) AS ndcg, chr((65 + p_partkey % 5)::INT) AS letter, CASE WHEN p_type = p_brand THEN 1.0 WHEN p_partkey % 2 = 0 THEN 1.0 / 3 ELSE 0.5 END::DOUBLE AS alike FROM part")
def metrics(spark, d):
    S.register(spark)
    body = """SELECT item_id, round(reciprocal_rank(item_id % 12 + 1), 9) AS mrr, hit_at(item_id % 12 + 1, 3) AS hit, round(ndcg_at(item_id % 12 + 1, 10), 9) AS ndcg, option_letter(item_id % 5) AS letter,
      set_jaccard(array(kind, category), CASE WHEN item_id % 2 = 0 THEN array('none', kind) ELSE array(kind) END) AS alike FROM {items}"""
    return spark.sql(body, items=Model(spark, d).items)
