"""Ids of any type as numbers in the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import IntegralType

from setloom.llm._store import stash


def numbered(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (doc_id, text) with whole numbers as ids, and what they stand for (number, id) if the ids are no whole numbers; null stays null.

    Such ids are sorted across partitions; a row's partition and place make its number, so the order is kept.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if isinstance(docs.schema["id"].dataType, IntegralType):
        return docs.select(F.col("id").cast("long").alias("doc_id"), "text"), None
    names = stash(docs.where("id is not null").select("id").distinct().orderBy("id").withColumn("number", F.monotonically_increasing_id()), "ids")
    return docs.join(names, "id", "left").select(F.col("number").alias("doc_id"), "text"), names


def named(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``df`` with the ids that the numbers in ``columns`` stand for."""
    if names is None:
        return df
    for c in columns:
        found = names.select(F.col("number").alias(c), F.col("id").alias("_named"))
        df = df.join(found, c, "left").select(*[F.col("_named").alias(c) if x == c else F.col(x) for x in df.columns])
    return df


def counted_up(df: DataFrame, name: str) -> DataFrame:
    """A stored table of ``df`` with ``id``, numbers from 0 without gaps: a row's place in its partition and the rows of the partitions before."""
    kept = stash(df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    parts = kept.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    shifts = parts.select("_part", (before - F.col("first")).alias("_shift"))
    return kept.join(F.broadcast(shifts), "_part").select(*df.columns, (F.col("_at") + F.col("_shift")).alias("id"))
