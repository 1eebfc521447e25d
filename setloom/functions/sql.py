"""What SQL can call: metrics and set functions as SQL functions, subsets as a table function.

:func:`register` makes them temporary functions of a session. The SQL functions are expressions, which Spark inlines and
compiles with the query; only ``subsets`` runs Python. There is no aggregate for mean vectors: one in Python would hold a
whole group in one task, so a mean goes by coordinates (``posexplode`` and ``avg``), which is added up before the shuffle.
"""

from __future__ import annotations

import sys
from itertools import combinations

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: name, arguments, result, body
FUNCTIONS = [
    ("hit_at", "place BIGINT, k INT", "INT", "coalesce(CAST(place <= k AS INT), 0)"),
    ("reciprocal_rank", "place BIGINT", "DOUBLE", "CASE WHEN place > 0 THEN 1.0D / place ELSE 0.0D END"),
    ("ndcg_at", "place BIGINT, k INT", "DOUBLE", "CASE WHEN place <= k THEN 1.0D / log2(place + 1.0D) ELSE 0.0D END"),
    ("set_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1.0D ELSE size(array_intersect(a, b)) / CAST(size(array_union(a, b)) AS DOUBLE) END"),
    ("canonical_key", "names ARRAY<STRING>", "STRING", "array_join(array_sort(names), '|')"),
    ("option_letter", "place BIGINT", "STRING", "chr(place + 65)"),
    ("lift_of", "confidence DOUBLE, share DOUBLE", "DOUBLE", "CASE WHEN share > 0 THEN confidence / share ELSE 0.0D END"),
    ("dot_product", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x)"),
]


class Subsets:
    """Rows (part, size) for the subsets of 1 to ``largest`` members, in the order of the members."""

    def eval(self, names: list, largest: int):
        for size in range(1, min(largest, len(names or [])) + 1):
            for part in combinations(names, size):
                yield list(part), size


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to a session; their names."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("subsets", F.udtf(Subsets, returnType="part array<string>, size int"))
    return [f[0] for f in FUNCTIONS] + ["subsets"]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
