"""Running sums of a stream as a table in the shared folder, exact after any restart.

Every micro-batch adds a folder of deltas that is named by its batch id and overwritten if the batch is run again, so a
batch counts once however often it is tried. A reader adds up the base and the deltas after it; now and then they are
folded into a new base (``compact``), which becomes the base when its folder is complete. Both are bucketed by a hash of
the keys, so folding and reading shuffle nothing but what a batch has added, and nothing is held by the driver.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Sums:
    """Sums of ``values`` by ``keys`` in a folder."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.values, self.buckets = spark, path.rstrip("/"), keys, values, buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path, self._store = jvm.Path, jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind, in order."""
        at = self._path(f"{self.path}/{kind}")
        names = [f.getPath().getName() for f in self._store.listStatus(at)] if self._store.exists(at) else []
        return sorted(int(n) for n in names if self._store.exists(self._path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(v).alias(v) for v in self.values])

    def _write(self, rows: DataFrame, folder: str) -> None:
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        bucketed.repartition(self.buckets, "bucket").write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """The deltas of a batch; again for the same batch, they take the place of the first."""
        self._write(self._summed(rows), f"deltas/{batch:012d}")

    def read(self) -> DataFrame | None:
        """The sums; None before the first batch."""
        bases = self._complete("base")
        base = bases[-1] if bases else -1
        parts = [f"{self.path}/base/{base:012d}"] if bases else []
        parts += [f"{self.path}/deltas/{b:012d}" for b in self._complete("deltas") if b > base]
        return self._summed(self.spark.read.parquet(*parts)) if parts else None

    def compact(self) -> None:
        """Fold base and deltas into a base that is named by the last batch in it, and delete what is in it."""
        batches = self._complete("deltas")
        if batches and batches[-1] not in self._complete("base"):
            self._write(self.read(), f"base/{batches[-1]:012d}")
            for kind, numbers in (("deltas", batches), ("base", [b for b in self._complete("base") if b < batches[-1]])):
                for n in numbers:
                    self._store.delete(self._path(f"{self.path}/{kind}/{n:012d}"), True)

    def follow(self, stream: DataFrame, checkpoint: str, every: int = 16) -> None:
        """Add all that a stream has, batch by batch, from where the checkpoint stands; ``every`` so many batches are folded."""

        def one(rows: DataFrame, batch: int) -> None:
            self.add(rows, batch)
            if batch % every == every - 1:
                self.compact()

        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _new_pairs(key: tuple, frames, state: GroupState, keep_ms: int):
    """Pairs of a group's nodes that were not there before; the state is the nodes it has."""
    if state.hasTimedOut:
        state.remove()
        return
    had = list(state.get[0]) if state.exists else []
    seen, out = set(had), []
    for frame in frames:
        for node in frame["node"].tolist():
            if node not in seen:
                out += [(min(node, x), max(node, x), 1) for x in had]
                seen.add(node)
                had.append(node)
    state.update((had,))
    if keep_ms:
        end = pd.Timestamp(key[-1]).value // 1_000_000 + keep_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["a", "b", "n"])


def pair_deltas(rows: DataFrame, group: str, node: str, time: str = "ts", length: str = "1 day", late: str | None = None) -> DataFrame:
    """A stream of new pairs (a, b, n), a < b, of nodes that one group has in one window: each pair once for each group and window.

    A group's pairs follow from the set of its nodes, so files may come in any order and cut a window anywhere. With
    ``late``, rows that are later than that are dropped and a window's state goes when no more can come; without it the state
    of all windows is kept.
    """
    marked = rows.withWatermark(time, late) if late else rows
    each = marked.where(F.col(node).isNotNull()).select(F.col(group).alias("g"), F.window(time, length)["start"].alias("w"), F.col(node).alias("node"), *([F.col(time)] if late else []))
    keep = int((pd.Timedelta(length) + pd.Timedelta(late)).total_seconds() * 1000) if late else 0
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    kind = rows.schema[node].dataType.simpleString()
    return each.groupBy("g", "w").applyInPandasWithState(lambda k, frames, state: _new_pairs(k, frames, state, keep), f"a {kind}, b {kind}, n long", f"nodes array<{kind}>", "append", timeout)


def members(rows: DataFrame, group: str, node: str, time: str = "ts", length: str = "1 day") -> DataFrame:
    """A stream as rows (g, w, node, n) for :class:`Sums`: what :func:`member_pairs` makes pairs of."""
    return rows.where(F.col(node).isNotNull()).select(F.col(group).alias("g"), F.window(time, length)["start"].alias("w"), F.col(node).alias("node"), F.lit(1).alias("n"))


def member_pairs(sums: DataFrame) -> DataFrame:
    """Rows (a, b, n), a < b: in how many groups and windows two nodes of the running table (g, w, node, n) stand."""
    sets = sums.groupBy("g", "w").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    each = sets.select(F.explode("nodes").alias("a"), "nodes").select("a", F.explode(F.filter("nodes", lambda x: x > F.col("a"))).alias("b"))
    return each.groupBy("a", "b").agg(F.count("*").alias("n"))


def pairs(rows: DataFrame, group: str, node: str, time: str = "ts", length: str = "1 day") -> DataFrame:
    """The same of a table: rows (a, b, n)."""
    return member_pairs(members(rows, group, node, time, length))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
