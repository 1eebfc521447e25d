"""Experiment plans: configurations and secrets from files, overrides for each experiment, a bounded number of runs at a time."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.sources.members import _place


def configuration(spark: SparkSession, path: str) -> dict:
    """The object of a JSON file, or of a YAML one where its library is there; an empty file is an empty object."""
    text = spark.read.text(path, wholetext=True).first()
    text = text["value"] if text else ""
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError(f"{path}: YAML files need the yaml library") from missing
        return yaml.safe_load(text) or {}
    return json.loads(text) if text.strip() else {}


def plan(spark: SparkSession, path: str) -> tuple[dict, list[dict]]:
    """A suite's base configuration and its experiments, from ``{base: {..} or the path of a file, experiments: [{name, overrides}]}``."""
    found = configuration(spark, path)
    base = found.get("base", {})
    if isinstance(base, str):
        base = configuration(spark, base if "/" in base else f"{path.rpartition('/')[0]}/{base}")
    names = [e["name"] for e in found.get("experiments", [])]
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: experiments share a name")
    return base, found.get("experiments", [])


def environment(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, value) of lines ``NAME=value``, with or without ``export`` and quotes; comments and anything else are left out, of equal names the last line counts."""
    store, at = _place(path)
    with store.open_input_stream(at) as f:  # Spark's readers skip files whose names begin with a dot
        text = f.read().decode("utf-8-sig")
    lines = spark.createDataFrame(list(enumerate(text.splitlines())), "n int, line string")
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    found = lines.where(F.col("line").rlike(pattern)).select("n", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("raw"))
    quoted = F.col("raw").rlike("""^(".*"|'.*')$""")
    bare = F.trim(F.regexp_replace("raw", r"(^|\s)#.*$", ""))
    value = F.when(quoted, F.expr("substring(raw, 2, length(raw) - 2)")).otherwise(bare)
    return found.groupBy("name").agg(F.max_by(value, "n").alias("value"))


def union_of_runs(runs: dict[str, DataFrame], label: str = "experiment") -> DataFrame:
    """The rows of several runs with the run's name; a column that a run hasn't got is null there."""
    named = [df.withColumn(label, F.lit(name)) for name, df in runs.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named)


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; nested objects are merged, anything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def run_suite(spark: SparkSession, base: dict, experiments: list[dict], run: Callable[[SparkSession, str, dict], object], max_parallel: int = 1, dry: bool = False) -> dict[str, object]:
    """Result of each experiment by name, or its configuration if ``dry``. An experiment's failure is its result.

    Every experiment schedules its jobs in a pool of its name, so that one can't starve the others.
    """

    def one(experiment: dict) -> object:
        conf = merged(base, experiment.get("overrides", {}))
        if dry:
            return conf
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", experiment["name"])
        try:
            return run(spark, experiment["name"], conf)
        except Exception as e:  # noqa: BLE001  the others go on
            return e

    with ThreadPoolExecutor(max_parallel) as pool:
        done = pool.map(inheritable_thread_target(one), experiments)
        return dict(zip((e["name"] for e in experiments), done, strict=True))
