"""Calls of an external text model, a partition at a time, with retries, and resumption from stored results.

The client is any callable from a prompt to a text; it is shipped to the executors. A partition is a key: repartition
to as many partitions as keys may be used at once.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.sources.readers import remaining

#: Fixed value: what an overloaded or exhausted service says.
RETRIED = ("429", "503", "quota", "demand", "overloaded")


def ask(client: Callable[[str], str], prompt: str, attempts: int = 5, wait_s: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """Response and error; only errors of load are tried again, each time after a longer wait."""
    error = None
    for attempt in range(1, attempts + 1):
        try:
            return client(prompt), None
        except Exception as e:  # noqa: BLE001  whatever a client raises is data
            error = str(e) or type(e).__name__
            if not any(x in error.lower() for x in RETRIED) or attempt == attempts:
                break
            sleep(wait_s * attempt)
    return None, error


def with_fallback(clients: list[Callable[[str], str]]) -> Callable[[str], str]:
    """A client that goes to the next key when one is used up."""

    def call(prompt: str) -> str:
        for i, client in enumerate(clients):
            try:
                return client(prompt)
            except Exception as e:
                if "quota" not in str(e).lower() or i == len(clients) - 1:
                    raise
        raise RuntimeError("no client")

    return call


def answers(prompts: DataFrame, client: Callable[[str], str], keys: int = 1, attempts: int = 5, wait_s: float = 1.0) -> DataFrame:
    """Rows (sample_id, response, error) for rows (sample_id, prompt)."""
    kind = prompts.schema["sample_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [ask(client, p, attempts, wait_s) for p in part["prompt"]]
            yield pd.DataFrame({"sample_id": part["sample_id"], "response": [g[0] for g in got], "error": [g[1] for g in got]})

    return prompts.select("sample_id", "prompt").repartition(keys, "sample_id").mapInPandas(run, f"sample_id {kind}, response string, error string")


def resumed(prompts: DataFrame, client: Callable[[str], str], path: str, keys: int = 1) -> DataFrame:
    """Answer what ``path`` has no response for, append it there, and return all that is stored."""
    spark = prompts.sparkSession
    schema = f"sample_id {prompts.schema['sample_id'].dataType.simpleString()}, response string, error string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    done = spark.read.schema(schema).parquet(path).where("error is null") if there else spark.createDataFrame([], schema)
    answers(remaining(prompts, done, "sample_id"), client, keys).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def batched(texts: DataFrame, instruction: str, size: int) -> DataFrame:
    """Prompts over ``size`` numbered texts each, the last one over fewer: rows (sample_id, prompt).

    Texts are numbered in the order of a hash of their ids, in parts that are counted first, so no task sees them all.
    """
    placed = texts.withColumn("_part", F.substring(F.md5(F.col("sample_id").cast("string").cast("binary")), 1, 3))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part, 4096 at most
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("sample_id")) - 1
    rows = placed.withColumn("_n", inside).join(offsets, "_part").withColumn("_n", F.col("_n") + F.col("_before")).withColumn("_batch", F.floor(F.col("_n") / size))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "sample_id", "text"))), lambda s: F.concat(s["sample_id"].cast("string"), F.lit(": "), s["text"])), "\n")
    return rows.groupBy("_batch").agg(F.concat(F.lit(instruction + "\n"), lines).alias("prompt")).select(F.col("_batch").cast("string").alias("sample_id"), "prompt")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
