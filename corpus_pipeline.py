"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all their columns; the last one
returns the shards, with each document's source and its slot in the mix (``mix_slot``). ``run`` writes each stage's result
in the shared folder and reads it back for the next one.

Defined cases: rows without an id are judged by their text, those of one text are one document, and where one is a near
duplicate of a row with an id, the latter stays; rows that share an id and a text are one document after the
near-duplicate stage, rows that share an id only stay apart; empty tables pass through; extra columns come through to the
last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm._store import stash
from setloom.llm.decontamination import decontamination
from setloom.llm.mixing import mixed, slotted
from setloom.llm.ngram_jaccard import ngram_jaccard
from setloom.llm.quality_rules import passing
from setloom.llm.sharding import measured, sharded


#: Target weights of the sources, by name; None: the power of each source's rows, so that large sources give up part of their share.
WEIGHTS: dict[str, float] | None = None
POWER = 0.5
#: A document goes if so many of its words stand in passages of the benchmark, or half of them: an item of one word is no passage.
HIT_WORDS = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail."""
    return passing(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``whole``, with ``key``, the id or a large number that follows from the text, and a hash of the text (``same``)."""
    same = F.xxhash64("text")
    of_text = F.lit(1 << 62) + same.bitwiseAND(F.lit((1 << 62) - 1))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), of_text).alias("key"), same.alias("same"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the least id."""
    rows = _keyed(docs)
    gone = ngram_jaccard(rows, id_col="key").where("component_id <> doc_id").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(gone, "key", "left_anti").dropDuplicates(["key", "same"]).select("whole.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, of five words or of half of their own."""
    rows = _keyed(docs)
    found = decontamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").where("contaminated")
    bad = found.where((F.col("n_hit") >= HIT_WORDS) | (2 * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc_id").alias("key"), F.col("text_hash").alias("same")).distinct()
    return rows.join(bad, ["key", "same"], "left_anti").select("whole.*")


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, which ends where the first source runs out, in the order of their slots."""
    return mixed(docs, WEIGHTS, power=POWER)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, its source and its slot in the mix. The texts themselves are read once, for sizes and digests."""
    return sharded(stash(slotted(measured(docs, keep=["source"])), "measured"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", to_weights),
    ("sharding", into_shards),
]

#: The groups of near duplicates are a fixed point and the shards a heap; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
    return docs
