"""Scans of the raw files and result files, as DataFrames with fixed schemas.

Paths go to Spark's readers, and those of large JSON objects to :mod:`setloom.sources.members`, which cuts one file for many tasks.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions import exprs as X
from setloom.sources.members import members

#: Fixed value: encodings that result files come in, in the order of trial.
ENCODINGS = ("utf-8", "cp949")


def bundles(spark: SparkSession, path: str, min_items: int = 1, dedupe: bool = True, group: str = "bundle_id") -> DataFrame:
    """Lines ``bundle, item, item, ...`` as rows (bundle_id, pos, item_id).

    Blank lines, trailing commas and lines with fewer than ``min_items`` items (after ``dedupe``) are skipped; a bundle
    that comes again replaces its earlier line. ``dedupe`` keeps an item's first place.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_line"))
    parts = lines.select("_line", F.filter(F.split(F.trim("value"), r"\s*,\s*"), lambda x: x != "").alias("_p")).where(F.size("_p") > 0)
    rows = parts.select("_line", F.get("_p", F.lit(0)).cast("long").alias(group), F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))).alias("_p"))
    last = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_line")))
    rows = rows.withColumn("_n", last).where("_n = 1")
    items = F.array_distinct("_p") if dedupe else F.col("_p")
    return rows.select(group, items.alias("_p")).where(F.size("_p") >= min_items).select(group, F.posexplode("_p").alias("pos", "item_id")).select(group, "pos", F.col("item_id").cast("long").alias("item_id"))


def users(spark: SparkSession, path: str, min_items: int = 1) -> DataFrame:
    """User histories: rows (user_id, pos, item_id)."""
    return bundles(spark, path, min_items, True, "user_id")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """One row (num_users, num_bundles, num_items) of a count file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(*[F.element_at("m", k).cast("double").cast("long").alias(n) for k, n in (("#U", "num_users"), ("#B", "num_bundles"), ("#I", "num_items"))])


def items(spark: SparkSession, path: str) -> DataFrame:
    """Item attributes from an object keyed by id; missing attributes are NULL."""
    fields = ("title", "cate", "cate_id", "category", "pic", "pic_url", "track_name", "artist_name", "album_name")
    raw = members(spark, path).select(F.col("key").alias("id"), F.from_json("value", "map<string,string>").alias("a"))
    every = raw.select(F.col("id").cast("long").alias("item_id"), *[X.blank_to_null(F.try_element_at("a", F.lit(f))).alias(f) for f in fields])
    return every.withColumn("pic_url", F.coalesce("pic_url", "pic")).drop("pic")


def results(spark: SparkSession, path: str) -> DataFrame:
    """A result CSV with quoted line ends, in the first encoding that decodes it; a byte-order mark goes."""
    if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
        df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=ENCODINGS[0])
        return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])
    return _decoded(spark, path, ENCODINGS[1])


def _decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The same for an encoding that Spark's own reader doesn't take: files are decoded as bytes on the executors."""
    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.select(F.substring("content", 1, 1 << 16)).first()[0]
    names = next(csv.reader(io.StringIO(bytes(head).decode(encoding, "ignore"))))

    def rows(parts):
        import pandas as pd

        for part in parts:
            for content in part["content"]:
                yield pd.DataFrame(list(csv.reader(io.StringIO(content.decode(encoding))))[1:], columns=names)

    return files.mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Batch responses: rows (sample_id, text, error) from JSON lines."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    text = F.get_json_object("value", "$.response.candidates[0].content.parts[0].text")
    return raw.select(F.coalesce(F.get_json_object("value", "$.id"), F.get_json_object("value", "$.key")).alias("sample_id"), text.alias("text"), F.get_json_object("value", "$.error").alias("error"))


def answered(samples: DataFrame, found: DataFrame) -> DataFrame:
    """Each sample with its response, ``ERR_MISSING`` if there is none."""
    return samples.join(found.select("sample_id", "text"), "sample_id", "left").withColumn("text", F.coalesce("text", F.lit("ERR_MISSING")))


def signal_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score cache keyed ``bundle_item`` -> rows (bundle_id, true_item, signal, pos, score)."""
    raw = members(spark, path).select(F.col("key").alias("k"), F.from_json("value", "map<string,array<double>>").alias("signals"))
    each = raw.select(F.split("k", "_").alias("k"), F.explode("signals").alias("signal", "scores"))
    return each.select(F.get("k", F.lit(0)).cast("long").alias("bundle_id"), F.get("k", F.lit(1)).cast("long").alias("true_item"), "signal", F.posexplode("scores").alias("pos", "score"))


def soft_links(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Item -> bundles object as rows (item_id, bundle_id, source)."""
    raw = members(spark, path).select(F.col("key").alias("i"), F.from_json("value", "array<long>").alias("b"))
    return raw.select(F.col("i").cast("long").alias("item_id"), F.explode("b").alias("bundle_id"), F.lit(source).alias("source"))


def category_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of categories from a list, or an object with one: English, then Korean name, then the id; see :func:`name_records`."""
    return name_records(members(spark, path, under="categories").select("value"))


def name_records(raw: DataFrame) -> DataFrame:
    """Rows (category_id, name, short_description_en, keywords, confidence) from records as JSON text (``value``).

    Keywords are a list, or a text that commas, semicolons or slashes part; a confidence that is no number is 0, and any
    other is kept between 0 and 1.
    """
    field = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
    record = raw.select(F.try_parse_json("value").alias("v")).where("v is not null")
    text = lambda name: X.blank_to_null(X.inline(field(name)))
    listed = field("keywords_en", "array<string>")
    split = F.filter(F.transform(F.split(field("keywords_en"), KEYWORD_BREAK), X.inline), lambda w: w != "")
    keywords = F.coalesce(F.transform(listed, X.inline), split, F.array().cast("array<string>"))
    confidence = F.coalesce(field("confidence", "double"), field("confidence").try_cast("double"), F.lit(0.0))
    name = F.coalesce(text("category_name_en"), text("category_name_ko"), field("category_id"))
    return record.select(field("category_id").alias("category_id"), name.alias("name"), X.inline(field("short_description_en")).alias("short_description_en"), keywords.alias("keywords"), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def fenced_records(raw: DataFrame) -> DataFrame:
    """Records (``value``, JSON text) in model answers (``text``): fences and words around the list are left out, an answer without a list has none."""
    body = F.regexp_extract("text", r"(?s)\[.*\]", 0)
    return raw.select(F.explode(F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")).alias("v")).select(F.to_json("v").alias("value"))


def settings(results: DataFrame, prefix: str = "cfg_") -> DataFrame:
    """``results`` with all columns whose names begin with ``prefix`` in one VARIANT column ``settings``, so that runs with different ones can be put together."""
    drift = [c for c in results.columns if c.startswith(prefix)]
    rest = [F.col(f"`{c}`") for c in results.columns if c not in drift]
    packed = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c.removeprefix(prefix)) for c in drift])) if drift else F.lit("{}")
    return results.select(*rest, F.parse_json(packed).alias("settings"))


def unpacked(results: DataFrame, prefix: str = "cfg_") -> DataFrame:
    """The settings that any row has as columns again, as text, by name (a merged schema of all rows gives the names)."""
    merged = results.agg(F.schema_of_variant_agg("settings").alias("s")).first()["s"] or ""
    names = sorted(n.strip("`") for n in re.findall(r"(`[^`]+`|[\w.]+): ", merged.partition("<")[2])) if merged.startswith("OBJECT<") else []
    return results.select(*[c for c in results.columns if c != "settings"], *[F.try_variant_get("settings", f"$['{n}']", "string").alias(prefix + n) for n in names])


#: Fixed value: what parts keywords in a text.
KEYWORD_BREAK = "[,;/]"


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Texts of items, from ``{items: {id: {description | summary}}}`` or the inner object."""
    each = members(spark, path, under="items").select(F.col("key").alias("id"), F.from_json("value", "map<string,string>").alias("r"))
    found = F.coalesce(X.blank_to_null(F.try_element_at("r", F.lit("description"))), X.blank_to_null(F.try_element_at("r", F.lit("summary"))))
    return each.select(F.col("id").cast("long").alias("item_id"), found.alias("text")).where("text is not null")


def catalog(spark: SparkSession, pattern: str, name: str = r"results_([a-z_]+?)_[A-Z]") -> DataFrame:
    """Result files by pattern: path, dataset from the name, time of change, and whether it is the dataset's latest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(pattern).select("path", "modificationTime", "length")
    known = files.withColumn("dataset", X.blank_to_null(F.regexp_extract("path", name, 1)))
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("modificationTime"), F.desc("path")))
    return known.withColumn("latest", place == 1)


def remaining(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Work that has no result yet."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
