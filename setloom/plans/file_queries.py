"""Round trips through files: tables written as the reference's formats and read back by the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.plans.base import Model, sql
from setloom.registry import query
from setloom.shared import new_path
from setloom.sources import readers, writers
from setloom.sources.runs import Runs

#: Members to an object; a file holds some objects.
MEMBERS = 512


def objects(df: DataFrame, key: Column, value: Column, name: str, rows: int) -> str:
    """A folder of JSON objects keyed by ``key``."""
    path, bucket = new_path(df.sparkSession, name), F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows // MEMBERS))))
    per = df.select(bucket.alias("b"), F.struct(key.cast("string").alias("k"), value.alias("v")).alias("e")).groupBy("b").agg(F.collect_list("e").alias("e"))
    per.select(F.to_json(F.map_from_entries("e")).alias("value")).write.text(path)
    return path


@query("s07_item_attributes", "SELECT p_partkey AS item_id, p_name AS title, p_brand AS cate, p_type AS category FROM part")
def s07(spark, d):
    items = Model(spark, d).items
    path = objects(items, F.col("item_id"), F.struct("title", F.col("category").alias("cate"), F.col("kind").alias("category"), F.lit(" ").alias("pic")), "items", items.count())
    return readers.items(spark, path).where("pic_url is null").select("item_id", "title", "cate", "category")


@query("s13_soft_link_files", sql("SELECT item_id, bundle_id, 'train' AS source FROM train"))
def s13(spark, d):
    per = Model(spark, d).train.groupBy("item_id").agg(F.collect_list("bundle_id").alias("b"))
    return readers.soft_links(spark, objects(per, F.col("item_id"), F.col("b"), "soft", per.count()), "train")


@query("s14_name_records", "SELECT p_partkey::VARCHAR AS category_id, CASE p_partkey % 3 WHEN 0 THEN p_partkey::VARCHAR ELSE p_name END AS name, [p_brand, p_type] AS keywords, CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence FROM part")
def s14(spark, d):
    """Names in English or Korean or none, keywords as a list or a text, confidence as a number, a text, or out of range."""
    m = Model(spark, d)
    n = F.col("item_id") % 3
    text = F.when(n == 1, F.to_json(F.struct(F.col("item_id").alias("category_id"), F.col("title").alias("category_name_en"), F.array("category", "kind").alias("keywords_en"), (F.col("item_id") % 4).alias("c"))))
    korean = F.to_json(F.struct(F.col("item_id").cast("string").alias("category_id"), F.lit(" ").alias("category_name_en"), F.col("title").alias("category_name_ko"), F.concat_ws(" ;/", "category", "kind").alias("keywords_en"), (F.col("item_id") % 4).alias("c")))
    none = F.to_json(F.struct(F.col("item_id").alias("category_id"), F.concat_ws(",", "category", "kind").alias("keywords_en"), (F.col("item_id") % 4).alias("c")))
    record = F.coalesce(text, F.when(n == 2, korean), none)
    confidence = F.element_at(F.array(F.lit('"high"'), F.lit("3"), F.lit('"0.25"'), F.lit("0.25")), (F.col("item_id") % 4 + 1).cast("int"))
    lines = m.items.select(F.concat(F.lit("["), F.regexp_replace(record, '"c":[0-9]+', "@"), F.lit("]")).alias("r"), confidence.alias("c"))
    path = new_path(spark, "names")
    lines.select(F.replace("r", F.lit("@"), F.concat(F.lit('"confidence":'), "c")).alias("value")).write.text(path)
    return readers.category_names(spark, path).select("category_id", "name", "keywords", "confidence")


@query("s15_description_files", "SELECT p_partkey AS item_id, p_name || ' ' || p_type AS text FROM part WHERE p_partkey % 3 <> 2")
def s15(spark, d):
    items = Model(spark, d).items
    text = F.concat_ws(" ", "title", "kind")
    value = F.struct(F.when(F.col("item_id") % 3 == 0, text).when(F.col("item_id") % 3 == 2, " ").alias("description"), F.when(F.col("item_id") % 3 == 1, text).alias("summary"))
    return readers.descriptions(spark, objects(items, F.col("item_id"), value, "descriptions", items.count()))


@query("s16_signal_score_files", sql("SELECT bundle_id, max(item_id) FILTER (WHERE is_gt) OVER (PARTITION BY method, bundle_id) AS true_item, method AS signal, pos::INT AS pos, score FROM scores"))
def s16(spark, d):
    m = Model(spark, d)
    per = m.scores.groupBy("bundle_id", "method").agg(F.max(F.when(F.col("is_gt"), F.col("item_id"))).alias("t"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "score"))), lambda s: s["score"]).alias("s"))
    each = per.groupBy("bundle_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("method", "s"))).alias("signals"))
    return readers.signal_scores(spark, objects(each, F.concat_ws("_", "bundle_id", "t"), F.col("signals"), "signals", each.count()))


@query("s20_response_lines", sql("SELECT bundle_id::VARCHAR AS sample_id, CASE WHEN bundle_id % 4 = 0 THEN 'ERR_MISSING' ELSE 'Choice: ' || chr((65 + bundle_id % 10)::INT) END AS text FROM ev"))
def s20(spark, d):
    """Batch responses of three samples in four, the others are missing."""
    m, path = Model(spark, d), new_path(spark, "responses")
    text = F.concat(F.lit("Choice: "), F.chr(65 + F.col("bundle_id") % 10))
    part = F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    m.evaluated.where("bundle_id % 4 <> 0").select(F.to_json(F.struct(F.col("bundle_id").cast("string").alias("key"), part.alias("response"))).alias("value")).write.text(path)
    return readers.answered(m.evaluated.select(F.col("bundle_id").cast("string").alias("sample_id")), readers.responses(spark, path)).select("sample_id", "text")


@query("k01_results_once", sql("SELECT bundle_id, method, hit FROM runs"))
def k01(spark, d):
    """A run that is broken off after half of its samples and started again over all of them."""
    m = Model(spark, d)
    store, rows = Runs(spark, new_path(spark, "runs"), ("bundle_id", "method")), m.runs.select("bundle_id", "method", "hit")
    store.write(rows.where("bundle_id % 2 = 0"), "r")
    store.write(rows, "r")
    return store.read("r").select("bundle_id", "method", "hit")


@query("k06_stored_vectors", "SELECT vec_id AS item_id FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part) AND vec_id % 3 = 0")
def k06(spark, d):
    """Ids whose vectors are missing after two thirds were stored, chunk by chunk."""
    m, path = Model(spark, d), new_path(spark, "chunks")
    for rest in (1, 2):
        writers.append_vectors(m.vectors.where(F.col("item_id") % 3 == rest), path)
    return writers.missing_vectors(m.vectors, path)
