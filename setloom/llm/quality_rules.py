"""Line-first quality rules, built from column expressions alone.

Each line is judged by rules of punctuation (symbols, shouting, a long line without any end mark), navigation (menus in
one line, bread crumbs, and menus of one short line each, ``MENU`` or more of them in a row) and boilerplate (fixed
phrases, at least one for ``PHRASE_WORDS`` words, so a long paragraph about cookies stays). Failed lines go, all others
stay as they are, and a document that loses too much of its text is rejected. Everything about a document is computed in
its own row, so there is no shuffle and no skew.

Defined cases: a null or empty text has no words and fails; blank lines are neither judged nor counted and stay; repeated
rows are judged alike; an empty table gives an empty result; a text of any length is judged whole, linear in its lines and
with one sort of its windows; :func:`quality_rules` reads no columns but the id and the text, :func:`passing` keeps all
others as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, symbol characters, phrases of boilerplate lines.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = "cookie|javascript|all rights reserved|terms of use|terms of service|privacy policy|lorem ipsum|click here|sign up now|subscribe to our|share this|skip to content"
END_MARKS = "[.!?:;…。！？]"
MENU, MENU_WORDS, PHRASE_WORDS = 4, 4, 25


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def line_fails(line: Column, symbol_percent: int = 5, long_line: int = 12) -> Column:
    """True for a line that breaks a punctuation, navigation or boilerplate rule by itself."""
    count = lambda what: F.length(line) - F.length(F.replace(line, F.lit(what), F.lit("")))
    gaps = F.length(F.regexp_replace(line, r"[^ \t]", ""))
    symbols = 100 * F.regexp_count(line, F.lit(SYMBOLS)) > symbol_percent * F.length(line)
    shouting = (count("!!") >= 6) | (count("??") >= 6)
    unended = (gaps >= long_line - 1) & ~line.rlike(END_MARKS)
    navigation = (count("|") >= 3) | (count(" > ") >= 6) | (count(" » ") >= 6)
    boilerplate = F.lower(line).rlike(BOILERPLATE) & (PHRASE_WORDS * F.regexp_count(F.lower(line), F.lit(BOILERPLATE)) > gaps)
    return symbols | shouting | unended | navigation | boilerplate


def menu_like(line: Column) -> Column:
    """True for a short line without any end mark or comma, which is a menu's if enough of them follow each other."""
    return (F.length(F.regexp_replace(line, r"[^ \t]", "")) < MENU_WORDS) & ~line.rlike(END_MARKS) & ~line.contains(",")


def _judged_lines(raw: Column) -> Column:
    """Lines with ``fails`` (null for blank ones) from the lines of a text."""
    marked = F.transform(raw, lambda x: F.struct(x.alias("line"), F.when(x.rlike(r"[^\x20\x09-\x0D]"), line_fails(x)).alias("fails"), (x.rlike(r"[^\x20\x09-\x0D]") & menu_like(x)).alias("menu")))
    near = lambda m, i, k: F.coalesce(F.get(m, i + k)["menu"], F.lit(False))

    def in_run(m: Column, i: Column) -> Column:
        runs = []
        for begin in range(1 - MENU, 1):
            run = near(m, i, begin)
            for k in range(begin + 1, begin + MENU):
                run = run & near(m, i, k)
            runs.append(run)
        out = runs[0]
        for run in runs[1:]:
            out = out | run
        return out

    return let(marked, lambda m: F.transform(m, lambda x, i: F.struct(x["line"].alias("line"), F.when(x["fails"].isNotNull(), x["fails"] | (x["menu"] & in_run(m, i))).alias("fails"))))


def _repeated(windows: Column, width: int) -> Column:
    """Words covered by the windows that occur twice or more: sort the windows with their places, keep those beside an equal one, and measure the union of what they cover."""
    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["w"] == F.get(s, j)["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(i, i - 1) | same(i, i + 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))

    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(ordered, places), covered))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars", "cleaned_chars", "cleaned_sha256"]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_percent: int = 30, cleaned: bool = True) -> DataFrame:
    """Measures and verdict of each document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, lost_chars, and length and digest of the text without the failed lines, with ``cleaned`` also that text, cleaned_text."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("int").alias("whole"))
    return _judged(docs, max_lost_percent, RESULT + ["cleaned_text"] * cleaned)


def passing(df: DataFrame, text_col: str = "text", chars_col: str | None = None, max_lost_percent: int = 30) -> DataFrame:
    """The rows of ``df``, with all their columns, that the rules keep, their texts without the failed lines; ``chars_col`` gets the length of these."""
    docs = df.select(F.lit(None).cast("int").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"))
    new = {text_col: F.col("cleaned_text")} | ({chars_col: F.length("cleaned_text").cast(df.schema[chars_col].dataType)} if chars_col else {})
    kept = _judged(docs, max_lost_percent, ["kept", "whole", "cleaned_text"]).where("kept")
    return kept.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in df.columns])


def _judged(docs: DataFrame, max_lost_percent: int, columns: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "whole", text.alias("text"), words_of(F.col("text")).alias("words"), F.split(text, "\n").alias("raw"))
    n = F.size("words")
    windows = F.when(n < 3, F.array().cast("array<string>")).otherwise(F.transform(F.slice(F.col("words"), F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2))))
    repeats = lambda x: F.size(x) - F.size(F.array_distinct(x))
    judged = split.select(
        "doc_id",
        "whole",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(F.filter("raw", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), repeats).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        _judged_lines(F.col("raw")).alias("lines"),
    )
    total = lambda which: F.aggregate("lines", F.lit(0), lambda a, x: a + F.when(which(x), F.length(x["line"])).otherwise(0)).cast("long")
    fails = lambda x: F.coalesce(x["fails"], F.lit(False))
    measured = judged.select(
        "doc_id",
        "whole",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeated(F.col("windows"), 3).cast("long").alias("n_repeat_words"),
        F.size(F.filter("lines", lambda x: x["fails"].isNotNull())).cast("long").alias("n_lines"),
        F.size(F.filter("lines", fails)).cast("long").alias("n_failed_lines"),
        total(fails).alias("lost_chars"),
        total(lambda x: x["fails"].isNotNull()).alias("line_chars"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~fails(x)), lambda x: x["line"]), "\n").alias("cleaned_text"),
    )
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = 100 * F.col("lost_chars") <= max_lost_percent * F.col("line_chars")
    judged = measured.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & verdict)
    if "cleaned_chars" in columns:
        judged = judged.withColumn("cleaned_chars", F.length("cleaned_text").cast("long")).withColumn("cleaned_sha256", F.sha2(F.col("cleaned_text").cast("binary"), 256))
    # the array is a wall: a filter on the result would else be pushed below the steps, with all of them copied into it
    return judged.select(F.explode_outer(F.array(F.struct(*columns))).alias("x")).select("x.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all of ``documents``."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), cleaned=False)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id),
l0 AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
l1 AS (
  SELECT doc_id, i, l, regexp_matches(l, '[^\x20\x09-\x0D]') AS filled,
         length(regexp_replace(l, '[^ \t]', '', 'g')) AS gaps, regexp_matches(l, '[.!?:;…。！？]') AS ended,
         len(regexp_extract_all(lower(l), 'cookie|javascript|all rights reserved|terms of use|terms of service|privacy policy|lorem ipsum|click here|sign up now|subscribe to our|share this|skip to content')) AS phrases
  FROM l0),
l2 AS (SELECT *, filled AND gaps < 4 AND NOT ended AND NOT contains(l, ',') AS menu FROM l1),
l3 AS (
  SELECT *, menu AND count(*) OVER (PARTITION BY doc_id, menu, block) >= 4 AS in_menu
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, menu ORDER BY i) AS block FROM l2)),
li AS (
  SELECT doc_id, i, l, length(l) AS n, filled,
         filled AND (100 * len(regexp_extract_all(l, '[#*$%&|<>]')) > 5 * length(l)
         OR length(l) - length(replace(l, '!!', '')) >= 6 OR length(l) - length(replace(l, '??', '')) >= 6
         OR (gaps >= 11 AND NOT ended)
         OR length(l) - length(replace(l, '|', '')) >= 3
         OR length(l) - length(replace(l, ' > ', '')) >= 6 OR length(l) - length(replace(l, ' » ', '')) >= 6
         OR in_menu OR (phrases > 0 AND 25 * phrases > gaps)) AS bad
  FROM l3),
ln AS (
  SELECT doc_id, count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE bad) AS n_failed, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost, coalesce(sum(n) FILTER (WHERE filled), 0) AS chars,
         coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS cleaned
  FROM li GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(chars, 0)::BIGINT AS chars, coalesce(cleaned, '') AS cleaned
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 30 * chars) AS kept,
       n_lines, n_failed_lines, lost_chars, length(cleaned)::BIGINT AS cleaned_chars, sha256(cleaned) AS cleaned_sha256
FROM m
"""
