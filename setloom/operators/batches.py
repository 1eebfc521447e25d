"""Batch requests and their responses as a stream with a state for each request.

``submit`` writes requests as JSON lines, the service puts responses into a folder in whatever order and as often as it
likes, and :func:`collect` takes up both where it left off. A request's state is whether it is asked, answered, or told;
its answer goes out once, when request and first response are there, whichever comes first. A request that is still
waiting ``wait`` after it was asked is told as ``ERR_MISSING`` when any later file shows that so much time has passed
(times are those of the files). Results go to a table of runs, where a batch that is tried again adds nothing, so no driver
looks through rows and nothing is told twice, whenever a job is broken off.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from setloom.sources.runs import Runs
from setloom.sources.writers import request_lines

#: Fixed value: what stands for a response that never came.
MISSING = "ERR_MISSING"
LINES = "value string"


def submit(prompts: DataFrame, path: str) -> None:
    """Add requests (sample_id, prompt) to a folder."""
    request_lines(prompts).write.mode("append").text(path)


def _told(key: tuple, frames, state: GroupState, wait_ms: int):
    """One sample: its answer when it is asked and answered, or missing when it has waited too long. State: asked at (ms, -1: not yet), text, told, last seen at."""
    asked, text, told, seen = state.get if state.exists else (-1, None, False, 0)
    if state.hasTimedOut:
        if asked >= 0 and not told:
            yield pd.DataFrame([(key[0], MISSING)], columns=["sample_id", "text"])
        state.remove()
        return
    for frame in frames:
        for row in frame.sort_values(["ms", "text"]).itertuples():
            seen = max(seen, row.ms)
            if row.asks:
                asked = row.ms if asked < 0 else min(asked, row.ms)
            elif text is None:
                text = row.text
    out = [(key[0], text)] if asked >= 0 and text is not None and not told else []
    told = told or bool(out)
    state.update((asked, text, told, seen))
    # an answer without a request waits as long for it, one that is told is remembered as long for repeated responses
    state.setTimeoutTimestamp(max((asked if asked >= 0 else seen) + wait_ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["sample_id", "text"])


def answers(requests: DataFrame, responses: DataFrame, wait: str) -> DataFrame:
    """A stream (sample_id, text) of streams (sample_id, ts) of requests and (sample_id, text, ts) of responses: each request once."""
    row = lambda df, asks, text: df.select("sample_id", F.lit(asks).alias("asks"), text.alias("text"), "ts")
    both = row(requests, True, F.lit(None).cast("string")).unionByName(row(responses, False, F.coalesce("text", F.lit("")))).withWatermark("ts", "0 seconds")
    timed = both.select("sample_id", "asks", "text", "ts", F.unix_millis("ts").alias("ms"))
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    return timed.groupBy("sample_id").applyInPandasWithState(lambda k, frames, state: _told(k, frames, state, wait_ms), "sample_id string, text string", "asked long, text string, told boolean, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder as a stream, with the time of their file."""
    return spark.readStream.schema(LINES).text(path).select("value", F.col("_metadata.file_modification_time").alias("ts"))


def collect(spark: SparkSession, requests: str, responses: str, results: Runs, run: str, checkpoint: str, wait: str = "1 day") -> None:
    """Take up all requests and responses that are new since the checkpoint."""
    sample = F.coalesce(F.get_json_object("value", "$.id"), F.get_json_object("value", "$.key")).alias("sample_id")
    text = F.get_json_object("value", "$.response.candidates[0].content.parts[0].text").alias("text")
    asked = lines(spark, requests).select(sample, "ts").where("sample_id is not null")
    answered = lines(spark, responses).select(sample, text, "ts").where("sample_id is not null")

    def one(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()  # a batch is read for its rows and for their keys
        if not rows.isEmpty():
            results.write(rows, run)
        rows.unpersist()

    answers(asked, answered, wait).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
