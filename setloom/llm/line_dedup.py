"""Repeated lines, found as overlapping windows of three consecutive lines. Column expressions and joins only.

Lines are compared without surrounding white space; blank lines are skipped over and always stay. Every window of
``size`` consecutive lines is hashed (128 bits), the first place of each hash over all documents (least id, then least
position) owns it, and the windows at later places are removed: a document's covered lines are the union of its
removed windows.

Window counts are pre-aggregated before the shuffle; a passage that is everywhere meets in one row a partition. The
places of repeated windows come back to the text by document, so no task gathers a passage's copies.

Defined cases: a null or empty text has no lines; a document with fewer than ``size`` lines loses none; rows without an
id own nothing and stay whole; rows that share an id are kept apart by their text; extra columns are not read; an empty
table gives an empty result; a text of any number of lines is sorted and merged in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm._store import stash
from setloom.llm.quality_rules import let


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda x: x != "")


def _without(s: Column) -> Column:
    """The lines ``s.raw`` without those that aren't blank and whose number is among ``s.gone``.

    Numbered lines and gone numbers are sorted together, so a line that goes follows its number: no line is searched for.
    """
    filled = F.filter(F.transform(s["raw"], lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    empty = F.filter(F.transform(s["raw"], lambda x, i: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    entry = lambda k, line: F.struct(k.cast("int").alias("k"), line.cast("int").alias("line"))
    merged = lambda places: F.sort_array(F.concat(F.transform(places, lambda p, k: entry(k, p)), F.transform(s["gone"], lambda k: entry(k, F.lit(-1)))))
    stays = lambda m: F.transform(F.filter(F.transform(m, lambda e, i: F.struct(e["line"].alias("line"), F.coalesce((F.get(m, i - 1)["line"] < 0) & (F.get(m, i - 1)["k"] == e["k"]), F.lit(False)).alias("goes"))), lambda e: (e["line"] >= 0) & ~e["goes"]), lambda e: e["line"])
    kept = lambda places: F.array_join(F.transform(F.sort_array(F.concat(let(merged(places), stays), empty)), lambda p: F.get(s["raw"], p)), "\n")
    return let(filled, lambda places: F.struct(F.size(places).cast("long").alias("n_lines"), F.coalesce(F.size(s["gone"]), F.lit(0)).cast("long").alias("n_removed"), F.when(s["gone"].isNull(), s["text"]).otherwise(kept(places)).alias("kept_text")))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Per document: n_lines, n_removed, kept_sha256 and kept_text, in which removed lines are missing."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same"))
    lined = docs.where("doc_id is not null").select("doc_id", "same", _lines(F.col("text")).alias("lines"))
    hashed = let(F.col("lines"), lambda x: F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), F.size(x) - size), lambda i: F.unhex(F.md5(F.array_join(F.slice(x, i + 1, F.lit(size)), "\n"))))))
    # outer: else Spark infers a filter that hashes again
    windows = lined.select("doc_id", "same", F.posexplode_outer(hashed).alias("at", "print")).where("print is not null")
    place = F.struct("doc_id", "same", "at")
    # stored, so that a window that many documents hold is split where it is joined
    owners = stash(windows.groupBy("print").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("print", "first"), "owners")
    later = windows.join(owners, "print").where(place > F.col("first")).groupBy("doc_id", "same").agg(F.collect_set("at").alias("at"))
    gone = later.select("doc_id", "same", F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + size - 1)))).alias("gone"))
    raw = F.split(F.coalesce("text", F.lit("")), "\n")
    joined = docs.join(gone, ["doc_id", "same"], "left")
    measured = joined.select("doc_id", let(F.struct(raw.alias("raw"), "gone", F.coalesce("text", F.lit("")).alias("text")), _without).alias("left"))
    out = measured.select("doc_id", "left.n_lines", "left.n_removed", "left.kept_text")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "kept_text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of three lines over all of ``documents``."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, raw, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
w AS (
  SELECT doc_id, k, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS g FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM w WHERE g IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM f WHERE r > 1),
cut AS (SELECT l.doc_id, l.i FROM l JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k),
allr AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
kept AS (
  SELECT allr.doc_id, string_agg(raw, chr(10) ORDER BY allr.i) AS t FROM allr LEFT JOIN cut ON cut.doc_id = allr.doc_id AND cut.i = allr.i WHERE cut.i IS NULL GROUP BY allr.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id) c USING (doc_id)
"""
