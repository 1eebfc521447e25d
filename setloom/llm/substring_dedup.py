"""Repeated passages: count-min prefilter, then exact grouping of the windows that it leaves.

A window is ``width`` consecutive words of one document. Every window is represented in the sketch by its anchor, the
least hash of the ``gram``-word runs inside it: equal windows have equal anchors, so an anchor's count is at least the
window's, and a sketch over anchors (about one for twenty windows) overestimates window counts as one over windows
would. Each partition fills its own sketch; the sums of the partitions' counters are the merged sketch. The second pass
hashes (96 bits) only the windows whose anchor is estimated in two documents or more and groups them exactly, so none
is lost and a collision in the sketch costs time only. Neighbouring windows with one anchor form a segment: where all
segments of an anchor are equal, they are compared as wholes; only those of the other anchors are taken apart.

The merged sketch reaches the executors as one bit a counter (estimate of two or more), at most
``2 * 2**max_log2_width / 8`` bytes whatever the corpus. Its width follows the corpus up to that bound. Of the texts
with many exact copies, the ``hot_copies`` most frequent (md5 and first id: a bounded list) are known beforehand:
their later copies are wholly repeated and need no windows, so a text that makes up a third of the rows costs nothing.

Defined cases: a null text has no words; documents with fewer words than a window lose none; a row without an id owns
nothing and loses nothing; rows that share an id don't remove each other's words; ids may be of any type that has an
order; an empty table gives an empty result; a text of any length is one slice of work; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm._ids import named, numbered
from setloom.llm._store import stash
from setloom.llm._words import mix, runs, slices, sliding_min, spans, starts_inside, texts

ROWS = 1 << 16


def _window_anchors(s, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of a slice, and their anchors."""
    n = len(s.hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(starts_inside(s.first, width))
    return starts, sliding_min(runs(s.hashes, gram), width - gram + 1)[starts]


def _counters(anchors: np.ndarray, log2_width: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - log2_width)
    return (anchors * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64), (mix(anchors) >> shift).astype(np.int64)


def _skipped(column: pa.Array, ids: np.ndarray, hot: dict[bytes, int]) -> np.ndarray:
    """Rows that are later copies of a text with many copies."""
    if not hot:
        return np.zeros(len(ids), bool)
    offsets, data = texts(column)
    view = memoryview(data)
    out = np.zeros(len(ids), bool)
    for i in range(len(ids)):
        first = hot.get(hashlib.md5(view[offsets[i] : offsets[i + 1]]).digest())
        out[i] = first is not None and ids[i] > first
    return out


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which rows have none."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _fill(batches: Iterator[pa.RecordBatch], width: int, gram: int, log2_width: int, hot: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros((2, 1 << log2_width), dtype=np.uint8)
    for batch in batches:
        ids, none = _ids(batch["doc_id"])
        off = none | _skipped(batch["text"], ids, hot)
        for s in slices(batch["text"], lower=False):
            starts, anchors = _window_anchors(s, width, gram)
            if not len(starts):
                continue
            rows = s.owner[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
            new &= ~off[s.row + rows]
            order = np.lexsort((anchors[new], rows[new]))
            a, r = anchors[new][order], rows[new][order]
            keep = np.ones(len(a), bool)
            keep[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
            for k, at in enumerate(_counters(a[keep], log2_width)):
                found, n = np.unique(at, return_counts=True)
                sketch[k][found] = np.minimum(sketch[k][found] + n, 2).astype(np.uint8)
    for k in range(2):
        found = np.flatnonzero(sketch[k])
        for i in range(0, len(found), ROWS):
            at = found[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(at + (k << log2_width)), pa.array(sketch[k][at].astype(np.int32))], names=["at", "n"])


def _pack(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Counters as bits, one row for each chunk of counters."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch["at"].to_numpy()
        for c in np.unique(at // chunk):
            bits.setdefault(int(c), np.zeros(chunk, bool))[at[at // chunk == c] % chunk] = True
    for c, x in bits.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])


def _estimated(sketch: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (sketch[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _windows(batches: Iterator[pa.RecordBatch], width: int, gram: int, log2_width: int, sketch, hot) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(sketch.value, np.uint8).reshape(2, -1)
    for batch in batches:
        ids, none = _ids(batch["doc_id"])
        same = batch["same"].to_numpy()
        off = none | _skipped(batch["text"], ids, hot.value)
        for s in slices(batch["text"], lower=False):
            starts, anchors = _window_anchors(s, width, gram)
            if not len(starts):
                continue
            one, two = _counters(anchors, log2_width)
            rows = s.owner
            keep = _estimated(bits[0], one) & _estimated(bits[1], two) & ~off[s.row + rows[starts]]
            starts, anchors = starts[keep], anchors[keep]
            if not len(starts):
                continue
            of = rows[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)
            cuts = np.append(np.flatnonzero(new), len(starts))
            begin, last = starts[cuts[:-1]], starts[cuts[1:] - 1]
            other = mix(s.hashes + np.uint64(0x632BE59BD9B4E019))
            whole = spans(s.hashes, begin, last + width) ^ spans(other, begin, last + width)
            high = runs(s.hashes, width)[starts].view(np.int64)
            low = (runs(other, width)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            row = s.row + rows[begin]
            at = (begin - s.first[rows[begin]]).astype(np.int32)
            for i in range(0, len(begin), ROWS):
                j, k = slice(i, i + ROWS), cuts[i : i + ROWS + 1]
                lists = [pa.ListArray.from_arrays(pa.array((k - k[0]).astype(np.int32)), pa.array(x[k[0] : k[-1]])) for x in (high, low)]
                yield pa.RecordBatch.from_arrays([pa.array(anchors[cuts[:-1]][j].view(np.int64)), pa.array(whole[j].view(np.int64)), pa.array(ids[row[j]]), pa.array(same[row[j]]), pa.array(at[j]), pa.array(np.diff(k).astype(np.int32)), *lists], names=["anchor", "whole", "doc_id", "same", "at", "n", "high", "low"])


def _rebuild(batches: Iterator[pa.RecordBatch], width: int, hot) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, none = _ids(batch["doc_id"])
        copies = ~none & _skipped(batch["text"], ids, hot.value)
        offsets, data = texts(batch["text"])
        view, removed = memoryview(data), batch["removed"]
        lists = removed.fill_null([]) if removed.null_count else removed
        cut, cut_at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        begin, last = (np.asarray(cut.field(k)).astype(np.int64) for k in ("at", "n"))
        last = begin + last - 1
        n_words, n_removed, digests, kept = [], [], [], []
        for i in range(len(batch)):
            words = bytes(view[offsets[i] : offsets[i + 1]]).split()
            n = len(words)
            at = slice(cut_at[i], cut_at[i + 1])
            if copies[i] and n >= width:
                left = []
            elif at.stop > at.start:
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, begin[at], 1)
                np.add.at(step, last[at] + width, -1)
                left = [w for w, c in zip(words, np.cumsum(step)[:n].tolist(), strict=True) if not c]
            else:
                left = words
            text = b" ".join(left)
            n_words.append(n)
            n_removed.append(n - len(left))
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 16, max_log2_width: int = 26, hot_copies: int = 4096) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space), a row for a row.
    """
    spark = df.sparkSession
    docs, names = numbered(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2_width = min(max_log2_width, max(16, int(np.ceil(np.log2(max(1, size) / 24)))))
    copies = docs.where("doc_id is not null and text is not null").groupBy(F.unhex(F.md5("text")).alias("md5")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = {bytes(r["md5"]): r["first"] for r in copies.orderBy(F.desc("n"), "md5").limit(hot_copies).collect()}
    hot_there = spark.sparkContext.broadcast(hot)

    filled = docs.mapInArrow(lambda it: _fill(it, width, gram, log2_width, hot_there.value), "at long, n int")
    chunk = 1 << 16
    merged = filled.groupBy("at").agg(F.sum("n").alias("n")).where("n > 1").select("at", F.floor(F.col("at") / chunk).alias("chunk"))
    packed = merged.repartition("chunk").mapInArrow(lambda it: _pack(it, chunk), "chunk long, bits binary")
    sketch = np.zeros((2 << log2_width) // 8, np.uint8)
    for r in packed.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        sketch[r["chunk"] * chunk // 8 : r["chunk"] * chunk // 8 + len(part)] = part
    sketch_there = spark.sparkContext.broadcast(sketch.tobytes())

    same = F.xxhash64("text")
    segments = stash(docs.withColumn("same", same).mapInArrow(lambda it: _windows(it, width, gram, log2_width, sketch_there, hot_there), "anchor long, whole long, doc_id long, same long, at int, n int, high array<long>, low array<int>"), "segments")
    anchors = stash(segments.groupBy("anchor").agg(F.min("whole").alias("one"), F.max("whole").alias("other"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("anchor", "owner", (F.col("one") != F.col("other")).alias("open")), "anchors")
    # one and the same segment everywhere: its windows are repeated as a whole
    closed = segments.select("anchor", "doc_id", "same", "at", "n").join(anchors.where("not open"), "anchor").where("doc_id > owner").select("doc_id", "same", "at", "n")
    # segments that differ: window by window
    windows = segments.join(anchors.where("open").select("anchor"), "anchor").select("doc_id", "same", "at", F.posexplode(F.arrays_zip("high", "low")).alias("i", "hash")).select("doc_id", "same", (F.col("at") + F.col("i")).alias("at"), "hash.high", "hash.low")
    windows = stash(windows, "windows")
    # stored, so that the join shuffles both sides and Spark can split a frequent window's rows
    owners = stash(windows.groupBy("high", "low").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("high", "low", "owner"), "owners")
    loose = windows.join(owners, ["high", "low"]).where("doc_id > owner").select("doc_id", "same", "at", F.lit(1).alias("n"))
    later = closed.unionByName(loose).groupBy("doc_id", "same").agg(F.collect_set(F.struct("at", "n")).alias("removed"))
    both = docs.withColumn("same", same).join(later, ["doc_id", "same"], "left").select("doc_id", "text", "removed")
    return named(both.mapInArrow(lambda it: _rebuild(it, width, hot_there), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"), names, "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that repeat across all of ``documents``."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
