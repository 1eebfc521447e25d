"""Members of one large JSON object (or elements of one large array), read by many tasks.

A file is cut into byte ranges. Whether a range begins inside a string, after a backslash, and how deep, follows from all
bytes before it; so each range is first summed up for every state that it could begin in (a job of its own: a few numbers
for each range go to the driver), and the sums of the ranges before give the state in which each does begin. Then each
range's task finds the separators between members in its range and reads on past its end to finish the last one. A member
belongs to the range that holds the comma or bracket before it, so each is read once, wherever the cuts fall.

``spark.read.format("json_members").option("states", ...)`` is that second step; :func:`members` does both. With ``under``
the members are those of the object or array that this key of the top object has (the whole file where it has none).

Rows are (key, value): the key unescaped (null in arrays), the value as JSON text. Equal keys give a row each. A file may
have several objects or arrays one after the other, in lines or not; their members all count (``under`` looks at the first).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK, STEP = 32 << 20, 1 << 20
#: (inside a string, after a backslash): the states that a range can begin in.
BEGINS = ((False, False), (True, False), (True, True))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a file, or of the files of a folder."""
    store, at = _place(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) and "://" in path else "file://" if path.startswith("file:") else ""
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _bytes(path: str, start: int, end: int) -> np.ndarray:
    store, at = _place(path)
    with store.open_input_file(at) as f:
        f.seek(start)
        return np.frombuffer(f.read(end - start), np.uint8)


def walk(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """For bytes in a given state: which are outside of strings, how each changes the depth, and the state after them."""
    slash = data == 0x5C
    if escaped and len(data):
        slash[0] = False
    place = np.arange(len(data))
    last = np.maximum.accumulate(np.where(slash, -1, place)) if len(data) else place
    before = np.concatenate([[-1], last[:-1]]) if len(data) else last
    odd = (place - 1 - before) % 2 == 1  # so many backslashes stand right before
    if escaped and len(data):
        odd[0] = True
    quote = (data == 0x22) & ~odd
    state = (np.cumsum(quote) + inside) % 2 == 1
    outside = ~state & ~quote
    change = np.zeros(len(data), np.int32)
    change[outside & ((data == 0x7B) | (data == 0x5B))] = 1
    change[outside & ((data == 0x7D) | (data == 0x5D))] = -1
    ends_escaped = bool(len(data)) and bool(slash[-1]) and not odd[-1] and bool(state[-1])
    return outside, change, bool(state[-1]) if len(data) else inside, ends_escaped


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and each state that it may begin in: the state after it and the change of depth."""
    for batch in batches:
        for path, start, end in zip(*(batch[c].to_pylist() for c in ("path", "start", "end")), strict=True):
            out = []
            for inside, escaped in BEGINS:
                depth = 0
                for a in range(start, end, STEP):
                    _, change, inside, escaped = walk(_bytes(path, a, min(end, a + STEP)), inside, escaped)
                    depth += int(change.sum())
                out.append([inside, escaped, depth])
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([json.dumps(out)])], names=["path", "start", "sums"])


def states(spark: SparkSession, ranges: list[tuple[str, int, int]], chunk: int) -> list[tuple]:
    """(path, start, end, end of the file's range, inside, escaped, depth) for every chunk of the given ranges of files."""
    chunks = [(p, s, min(e, s + chunk)) for p, a, e in ranges for s in range(a, e, chunk)]
    last = {p: e for p, _, e in ranges}
    sums = {}
    if any(s != a for p, a, _ in ranges for q, s, _ in chunks if p == q):
        asked = spark.createDataFrame(chunks, "path string, start long, end long").repartition(len(chunks), "path", "start")
        sums = {(r["path"], r["start"]): json.loads(r["sums"]) for r in asked.mapInArrow(_summed, "path string, start long, sums string").collect()}
    out, state, before = [], (False, False, 0), None
    for path, start, end in chunks:
        state = state if path == before else (False, False, 0)
        out.append((path, start, end, last[path], *state))
        if sums:
            inside, escaped, depth = sums[path, start][BEGINS.index(state[:2])]
            state = (inside, escaped, state[2] + depth)
        before = path
    return out


def found(path: str, start: int, end: int, last: int, inside: bool, escaped: bool, depth: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the members that begin in a range, whatever is before and after it."""
    at, held, open_ = start, b"", -1
    while at < last:
        data = _bytes(path, at, min(last, at + STEP))
        outside, change, inside, escaped = walk(data, inside, escaped)
        level = depth + np.cumsum(change)
        opens = (change == 1) & (level == 1)
        cuts = np.flatnonzero(opens | (outside & (data == 0x2C) & (level == 1)) | ((change == -1) & (level == 0)))
        raw, begin = data.tobytes(), 0
        for i in cuts.tolist():
            if open_ >= 0:
                text = held + raw[begin:i]
                if text.strip():
                    yield open_, text
                held = b""
            if at + i >= end:
                return
            open_, begin = (-1, 0) if change[i] == -1 else (at + i + 1, i + 1)
        if open_ >= 0:
            held += raw[begin:]
        elif at + len(data) >= end:
            return
        depth = int(level[-1])
        at += len(data)


def split(text: bytes) -> tuple[str | None, str]:
    """Key and value of a member; an element has no key."""
    whole = text.decode().strip()
    if not whole.startswith('"'):
        return None, whole
    key, end = json.JSONDecoder().raw_decode(whole)
    rest = whole[end:].lstrip()
    return (key, rest[1:].strip()) if rest.startswith(":") else (None, whole)


class JsonMembers(DataSource):
    """Format ``json_members``; ``states`` is the JSON of :func:`states`, without it a file is one range."""

    @classmethod
    def name(cls) -> str:
        return "json_members"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        given = options.get("states")
        self.ranges = json.loads(given) if given else [(p, 0, n, n, False, False, 0) for p, n in files(options["path"])]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(tuple(r)) for r in self.ranges] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        keys, values = [], []
        for _, text in found(*partition.value) if partition.value else ():
            key, value = split(text)
            keys.append(key)
            values.append(value)
            if len(keys) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])
                keys, values = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])


def _placed(batches: Iterator[pa.RecordBatch], under: str) -> Iterator[pa.RecordBatch]:
    """Where the value of a key of the top object begins and ends."""
    for batch in batches:
        for row in batch["state"].to_pylist():
            state = json.loads(row)
            for at, text in found(*state):
                key, value = split(text)
                if key == under and value[:1] in ("{", "["):
                    first = at + text.index(value[:1].encode(), len(json.dumps(key)) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([state[0]]), pa.array([first]), pa.array([at + len(text)])], names=["path", "start", "end"])


def members(spark: SparkSession, path: str, under: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows (key, value) of the object or array in a file, or in each file of a folder."""
    spark.dataSource.register(JsonMembers)
    ranges = [(p, 0, n) for p, n in files(path) if n]
    at = states(spark, ranges, chunk)
    if under is not None:
        rows = spark.createDataFrame([(json.dumps(s),) for s in at], "state string").repartition(max(1, len(at)), "state")
        inner = {r["path"]: (r["path"], r["start"], r["end"]) for r in rows.mapInArrow(lambda it: _placed(it, under), "path string, start long, end long").collect()}
        ranges = [inner.get(r[0], r) for r in ranges]
        at = states(spark, ranges, chunk)
    return spark.read.format("json_members").option("states", json.dumps(at)).load()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
