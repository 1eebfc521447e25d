"""Shards of nearly equal size from groups that must stay together: longest processing time first.

Groups (equal texts) are sorted by size and each goes to the least-loaded shard, through a heap. Groups of one size are
interchangeable, so the heap works on sizes and how many groups have them: all groups of a size are dealt at once, as
one after the other would be. A corpus of ``b`` bytes has at most ``sqrt(2 b)`` different group sizes, which bounds what
reaches the driver; the groups themselves are numbered within their size, in 4096 parts, and look up their shard.

Slots count through a shard by the md5 of id and text in 4096 parts, so no task numbers a third of the rows.

Defined cases: null texts have no bytes and form one group of their own, apart from empty texts; repeated rows stay
together with their text and get slots of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_DIGITS = 3
BROADCAST_ROWS = 100_000


def dealt(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets if each goes to the least-loaded shard, ties by number. Changes ``loads``."""
    got = [0] * len(loads)
    if size and count > 4 * len(loads):  # fill all shards below the highest level that count allows
        low, high = min(loads), max(loads) + size * count
        while low < high:
            level = (low + high + 1) // 2
            low, high = (level, high) if sum(max(0, -(-(level - x) // size)) for x in loads) <= count else (low, level - 1)
        got = [max(0, -(-(low - x) // size)) for x in loads]
    heap = [(x + n * size, s) for s, (x, n) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, s = heap[0]
        got[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    for s, n in enumerate(got):
        loads[s] += n * size
    return got


def least_loaded(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each (size, count), largest first, how many groups of that size are in the shards up to each."""
    loads, out = [0] * shards, []
    for size, count in sorted(sizes, reverse=True):
        total, upto = 0, []
        for n in dealt(loads, size, count):
            total += n
            upto.append(total)
        out.append((size, upto))
    return out


def _places(df: DataFrame, within: str, bucket: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row among those that share ``within``, by ``bucket`` and then ``order``."""
    counts = df.groupBy(within, bucket).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(within, bucket, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(within, bucket).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(offsets, [within, bucket]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """What sharding needs of a document: doc_id, size, text_crc32 and text_md5, then the columns in ``keep``."""
    named = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)])
    text = F.col("text").cast("binary")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size")
    return named.select("doc_id", size, F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), F.coalesce(F.md5(text), F.lit("null")).alias("text_md5"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The shards of measured documents, with the columns that these have beside."""
    spark, kept = docs.sparkSession, docs.columns[4:]
    docs = docs.toDF(*docs.columns[:4], *[f"_keep{i}" for i in range(len(kept))])
    groups = docs.groupBy("text_md5").agg(F.sum("size").alias("bytes")).withColumn("bucket", F.substring(F.md5("text_md5"), 1, BUCKET_DIGITS))
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    table = least_loaded(list(zip(sizes["bytes"].to_pylist(), sizes["n"].to_pylist(), strict=True)), shards)
    upto = spark.createDataFrame(pa.table({"bytes": pa.array([s for s, _ in table], pa.int64()), "upto": pa.array([u for _, u in table], pa.list_(pa.int64()))}))
    upto = F.broadcast(upto) if len(table) <= BROADCAST_ROWS else upto
    placed = _places(groups, "bytes", "bucket", ["text_md5"], "place").join(upto, "bytes")
    shard_of = placed.select("text_md5", F.size(F.filter("upto", lambda u: u <= F.col("place"))).cast("int").alias("shard"))
    bucket = F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text_md5")), 1, BUCKET_DIGITS)
    sharded = docs.join(shard_of, "text_md5").withColumn("bucket", bucket)
    return _places(sharded, "shard", "bucket", ["doc_id", "text_md5"], "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(kept)])


def sharding(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null under this law)."""
    return sharded(measured(df, id_col, text_col, overhead), shards)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` into 40 shards."""
    return sharding(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, coalesce(md5(text), 'null') AS m, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT m, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM (SELECT m, any_value(text) AS text, hex(any_value(text)) AS h FROM d GROUP BY m), tab),
g AS (SELECT m, sum(size)::BIGINT AS bytes FROM d GROUP BY m),
o AS (SELECT m, bytes, row_number() OVER (ORDER BY bytes DESC, m) AS r, row_number() OVER (PARTITION BY bytes ORDER BY substr(md5(m), 1, 3), m) AS k FROM g),
lpt(r, loads, shard) AS (
  SELECT 0::BIGINT, list_transform(range(40), lambda x: 0::BIGINT), NULL::BIGINT
  UNION ALL
  SELECT o.r, list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + o.bytes ELSE x END), list_position(loads, list_min(loads)) - 1
  FROM lpt JOIN o ON o.r = lpt.r + 1),
s AS (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS k FROM lpt JOIN o USING (r)),
p AS (SELECT o.m, s.shard FROM o JOIN s ON s.bytes = o.bytes AND s.k = o.k)
SELECT d.doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, p.shard::INT AS shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY substr(md5(CASE WHEN doc_id IS NULL THEN d.m ELSE doc_id::VARCHAR || '|' || d.m END), 1, 3), doc_id NULLS FIRST, d.m) - 1 AS slot,
       NULL::INT AS grown_shard
FROM d JOIN p ON p.m = d.m JOIN u ON u.m = d.m
"""
