"""The batch round trip: any order, repeated responses, requests that nobody answers, restarts."""

import json
import os

from setloom.operators import batches as B
from setloom.sources.runs import Runs


def put(folder, name, ids, at, text=None):
    folder.mkdir(exist_ok=True)
    body = lambda i: {"id": i} if text is None else {"key": i, "response": {"candidates": [{"content": {"parts": [{"text": f"{text}{i}"}]}}]}}
    hidden = folder / f".{name}"
    hidden.write_text("".join(json.dumps(body(i)) + "\n" for i in ids))
    os.utime(hidden, (at, at))
    hidden.rename(folder / name)


def test_round_trip(spark, tmp_path):
    asked, answered, results = tmp_path / "asked", tmp_path / "answered", Runs(spark, f"{tmp_path}/results")
    go = lambda: B.collect(spark, str(asked), str(answered), results, "r", str(tmp_path / "checkpoint"), wait="1 hour")
    start = 1_700_000_000
    told = lambda: {r["sample_id"]: r["text"] for r in results.read().collect()}
    put(asked, "a", ["1", "2", "3", "4"], start)
    put(answered, "x", ["2", "9"], start + 5, "one ")  # 9 is answered before it is asked
    go()
    assert told() == {"2": "one 2"}
    put(answered, "y", ["2", "1", "1"], start + 60, "two ")  # 2 comes again
    put(asked, "b", ["9"], start + 70)
    go()
    assert told() == {"1": "two 1", "2": "one 2", "9": "one 9"}
    put(answered, "late", ["2"], start + 9000, "late ")  # so much later nobody waits any more
    go()
    go()
    assert told() == {"1": "two 1", "2": "one 2", "9": "one 9", "3": B.MISSING, "4": B.MISSING}
    put(answered, "too late", ["3"], start + 9100, "late ")
    go()
    assert told()["3"] == B.MISSING and results.read().count() == 5


def test_requests_are_lines(spark, tmp_path):
    B.submit(spark.createDataFrame([(1, "p"), (2, "q")], "sample_id long, prompt string"), f"{tmp_path}/asked")
    rows = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/asked").collect()]
    assert sorted(r["id"] for r in rows) == ["1", "2"]
