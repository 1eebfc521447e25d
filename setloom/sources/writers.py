"""Sinks: results, matrices, mappings, request files and report tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.sources.runs import Runs


def append_results(df: DataFrame, path: str, run_id: str, keys: tuple[str, ...] = ("sample_id",)) -> int:
    """Results of a run, each once: a run that is taken up again adds what was missing (:class:`setloom.sources.runs.Runs`)."""
    return Runs(df.sparkSession, path, keys).write(df, run_id)


def results_csv(df: DataFrame, path: str) -> None:
    """CSV files with headers, a file for each task; lists and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def run_name(dataset: str, features: dict[str, object], candidates: int, inputs: int, stamp: str) -> str:
    """Name of a run from its enabled features, in the order given."""
    parts = [re.sub(r"[^A-Za-z0-9.-]+", "-", f"{k}{'' if v is True else v}").upper() for k, v in features.items() if v not in (None, False, "")]
    return "_".join(["results", dataset, *parts, f"C{candidates}", f"T{inputs}", stamp])


def matrix(cc: DataFrame, path: str) -> None:
    """A coordinate table, clustered by row."""
    cc.repartitionByRange("a").sortWithinPartitions("a", "b").write.mode("overwrite").parquet(path)


def mapping(links: DataFrame, path: str, kind: str = "json") -> None:
    """Item -> sorted bundles, one JSON object or one comma-separated line an item."""
    per = links.groupBy("item_id").agg(F.array_sort(F.collect_set("bundle_id")).alias("bundles"))
    if kind == "json":
        lines = per.select(F.to_json(F.struct("item_id", "bundles")).alias("value"))
    else:
        lines = per.select(F.concat_ws(", ", F.col("item_id").cast("string"), F.transform("bundles", lambda b: b.cast("string"))).alias("value"))
    lines.write.mode("overwrite").text(path)


def requests(prompts: DataFrame, path: str, temperature: float = 0.0) -> None:
    """Batch requests, one JSON line a sample (sample_id, prompt)."""
    request_lines(prompts, temperature).write.mode("overwrite").text(path)


def request_lines(prompts: DataFrame, temperature: float = 0.0) -> DataFrame:
    contents = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.col("prompt").alias("text"))).alias("parts")))
    request = F.struct(contents.alias("contents"), F.struct(F.lit(temperature).alias("temperature")).alias("generationConfig"))
    return prompts.select(F.to_json(F.struct(F.col("sample_id").cast("string").alias("id"), request.alias("request"))).alias("value"))


def append_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def missing_vectors(wanted: DataFrame, path: str) -> DataFrame:
    """Ids without a stored vector; must be empty before vectors are used."""
    return wanted.select("item_id").distinct().join(wanted.sparkSession.read.parquet(path).select("item_id"), "item_id", "left_anti")


def deduplicated(pairs: DataFrame, path: str) -> None:
    """A bundle relation without repeats as lines ``bundle, item, ...`` in the order of first places."""
    first = pairs.groupBy("bundle_id", "item_id").agg(F.min("pos").alias("pos"))
    per = first.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda s: s["item_id"].cast("string")).alias("items"))
    per.select(F.concat_ws(", ", F.col("bundle_id").cast("string"), "items").alias("value")).write.mode("overwrite").text(path)


def metadata(df: DataFrame) -> str:
    """A one-row summary as JSON."""
    return json.dumps(json.loads(df.toJSON().first()), sort_keys=True)


def _cells(df: DataFrame, limit: int) -> tuple[list[str], list[list[str]], str]:
    """Column names, at most ``limit`` rows, and a remark on those left out."""
    shown = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    rows = [[shown(v) for v in r] for r in df.limit(limit + 1).collect()]
    left = df.count() - limit if len(rows) > limit else 0
    return df.columns, rows[:limit], f"{left} more rows" if left else ""


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table for a report; beyond ``limit`` rows it says how many more there are."""
    names, rows, more = _cells(df, limit)
    line = lambda xs: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, rows), *(["", more] if more else [])])


def latex(df: DataFrame, caption: str, limit: int = 200) -> str:
    """The same as a LaTeX table."""
    names, rows, more = _cells(df, limit)
    safe = lambda x: re.sub(r"([&%$#_{}])", r"\\\1", x)
    line = lambda xs: " & ".join(map(safe, xs)) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{safe(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(names)}}}", r"\toprule", line(names), r"\midrule", *map(line, rows), *([rf"\multicolumn{{{len(names)}}}{{l}}{{{more}}} \\"] if more else []), r"\bottomrule", r"\end{tabular}", r"\end{table}"])


