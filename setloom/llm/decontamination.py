"""Benchmark passages in documents, found by winnowed fingerprints. Column expressions and joins only.

Texts become hashes of ``gram`` consecutive words; of each ``width - gram + 1`` consecutive hashes the least is kept
(all of them on ties). Two equal runs of ``width`` words keep the same hashes, so a join of document and item
fingerprints finds every shared run of that length; each hit is then extended over the item's windows that hold it and
compared word by word. Items shorter than a window are matched whole, wherever their first word stands (while there are
at most ``first_words`` such words they are looked up in the row, beyond that all positions are joined).

The fingerprints of the benchmark are broadcast only if there are at most ``broadcast_rows`` of them (24 bytes each);
beyond that both sides are shuffled by fingerprint and the hit documents' words joined to the hits.

Defined cases: a null or empty text has no words; an item without words or without an id matches nothing; items that
share words all count; rows that share a doc_id are kept apart by their text, rows without one are judged by it; an empty
benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.quality_rules import let

#: Fixed value: what separates words. Upper case is kept here and lowered word by word.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words with A to Z lowered; other letters stay as they are."""
    lowered = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != ""), lowered)


def _hashes(words: Column, k: int) -> Column:
    """The hash of each ``k`` consecutive words."""
    every = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return let(words, lambda w: F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(every(w)))


def _least(hashes: Column, span: int) -> Column:
    """The least of each ``span`` consecutive hashes."""
    every = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - span), lambda i: F.least(*[F.get(h, i + j) for j in range(span)]))
    return let(hashes, lambda h: F.when(F.size(h) < span, F.array().cast("array<bigint>")).otherwise(every(h)))


def _fingerprints(df: DataFrame, keys: list[str], gram: int, span: int) -> DataFrame:
    """Rows (keys, words, at, print): the winnowed positions of each text."""
    hashed = df.withColumn("hashes", _hashes(F.col("words"), gram))
    winnowed = hashed.withColumn("least", _least(F.col("hashes"), span))
    rows = winnowed.select(*keys, "words", "least", F.posexplode_outer("hashes").alias("at", "print"))  # outer: else Spark infers a filter that hashes again
    around = [F.when(F.col("at") >= j, F.get(F.col("least"), F.col("at") - j)) for j in range(span)]
    return rows.where(F.col("print") == F.greatest(*around)).select(*keys, "words", "at", "print")


def _join(prints: DataFrame, items: DataFrame, docs: DataFrame, broadcast: bool) -> DataFrame:
    """Pairs of equal fingerprints with the document's words."""
    if broadcast:
        return prints.join(F.broadcast(items), "print")
    narrow = prints.drop("words").join(items, "print")
    return _with(narrow, docs.select("doc_id", "same", "words").distinct(), "inner")


def _with(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """``rows`` with what ``more`` has for the same id, which may be null, and text."""
    right = more.withColumnsRenamed({"doc_id": "_id", "same": "_same"})
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")), how).drop("_id", "_same")


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, gram: int = 5, broadcast_rows: int = 1_000_000, first_words: int = 10_000) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, hit_items (sorted strings), and text_hash (xxhash64 of the text)."""
    span = width - gram + 1
    same = F.xxhash64("text")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    worded = docs.select("doc_id", same.alias("same"), words_of(F.col("text")).alias("words"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("item_words")).distinct()

    long_items = _fingerprints(items.where(F.size("item_words") >= width).withColumnRenamed("item_words", "words"), ["item_id"], gram, span)
    marks = long_items.select("item_id", F.col("at").alias("item_at"), "print")
    small = marks.count() <= broadcast_rows
    found = _join(_fingerprints(worded, ["doc_id", "same"], gram, span), marks, worded, small)
    begin = F.greatest(F.col("at") - (span - 1), F.lit(0))
    near = found.select("doc_id", "same", "item_id", "at", "item_at", begin.alias("from"), F.slice("words", begin + 1, F.lit(width + span - 1)).alias("near"))
    # a window that holds the item's gram begins at most span - 1 words before it
    def window(back: Column) -> Column:
        doc_part = F.slice("near", F.col("at") - back - F.col("from") + 1, F.lit(width))
        item_part = F.slice("item_words", F.col("item_at") - back + 1, F.lit(width))
        return (F.col("at") >= back) & (F.col("item_at") >= back) & (F.size(doc_part) == width) & (doc_part == item_part)

    spans = near.join(items, "item_id").select("doc_id", "same", "item_id", F.explode(F.array(*[F.when(F.col("at") >= b, F.when(F.col("item_at") >= b, F.when(window(F.lit(b)), F.struct((F.col("at") - b).alias("at"), F.lit(width).alias("n"))))) for b in range(span)])).alias("hit")).where("hit is not null")

    brief = (F.size("item_words") < width) & (F.size("item_words") > 0)
    short = items.where(brief).select("item_id", "item_words", F.xxhash64(F.get("item_words", F.lit(0))).alias("first"))
    firsts = [r[0] for r in short.select("first").distinct().limit(first_words + 1).collect()]
    if firsts:
        few = len(firsts) <= first_words
        begins = lambda w: F.filter(F.transform(w, lambda x, i: F.when(F.xxhash64(x).isin(firsts), i) if few else i), lambda i: i.isNotNull())
        begun = worded.select("doc_id", "same", "words", F.explode_outer(let(F.col("words"), begins)).alias("at")).where("at is not null").withColumn("first", F.xxhash64(F.get("words", F.col("at"))))
        met = begun.join(F.broadcast(short) if few and short.count() <= broadcast_rows else short, "first")
        whole = met.where(F.slice("words", F.col("at") + 1, F.size("item_words")) == F.col("item_words"))
        spans = spans.unionByName(whole.select("doc_id", "same", "item_id", F.struct("at", F.size("item_words").alias("n")).alias("hit")))

    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1)))))
    hits = spans.groupBy("doc_id", "same").agg(F.collect_set("hit").alias("hits"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("hit_items")).select("doc_id", "same", covered.cast("long").alias("n_hit"), "hit_items")
    counted = docs.select("doc_id", same.alias("same"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), BREAK), lambda w: w != "")).cast("long").alias("n_words"))
    ids = F.coalesce("hit_items", F.array().cast("array<string>"))
    return _with(counted, hits, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), ids.alias("hit_items"), F.col("same").alias("text_hash")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all of ``benchmark`` in all of ``documents``."""
    return decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hit_items", "text_hash")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""
