"""Results of runs that are each in the table once, whatever fails or runs again.

A write goes to a folder of its own (``data/<id>``) and counts only once a file in ``manifest`` names it, with the run, how
many rows it has and between which keys they lie. The commit creates that file under the next number of its run and never
overwrites one, so of two writers one fails and tries again after what the other has committed. Rows whose keys the run
has already are left out before they are written. Readers follow the manifest; folders that nothing names are what broken
writes left, and :meth:`Runs.clean` deletes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Runs:
    """A table of results in a folder. ``keys``: what tells the rows of a run apart."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("sample_id",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._store = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._store.listStatus(at)) if self._store.exists(at) else []

    def manifest(self) -> list[dict]:
        """The commits, in order."""
        names = [n for n in self._listed("manifest") if n.endswith(".json")]
        if not names:
            return []
        lines = self.spark.read.text([f"{self.path}/manifest/{n}" for n in names]).collect()
        return sorted((json.loads(r["value"]) for r in lines), key=lambda c: (c["run"], c["number"]))

    def read(self, run: str | None = None) -> DataFrame | None:
        """All committed rows, with their run; None if there are none."""
        commits = [c for c in self.manifest() if run in (None, c["run"]) and c["rows"]]
        if not commits:
            return None
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/data/{c['id']}" for c in commits])

    def missing(self, work: DataFrame, run: str) -> DataFrame:
        """The rows of ``work`` that the run has no result for."""
        done = self.read(run)
        return work if done is None else work.join(done.select(*self.keys).distinct(), self.keys, "left_anti")

    def write(self, df: DataFrame, run: str, attempts: int = 5) -> int:
        """Add the rows of a run that it has not got; how many these are. Rows that share their keys count once."""
        for _ in range(attempts):
            number = sum(c["run"] == run for c in self.manifest())
            name = uuid.uuid4().hex
            fresh = self.missing(df.dropDuplicates(self.keys), run).withColumn("run", F.lit(run))
            fresh.write.parquet(f"{self.path}/data/{name}")
            key = F.struct(*self.keys)
            counted = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/data/{name}").agg(F.count("*").alias("rows"), F.to_json(F.min(key)).alias("first"), F.to_json(F.max(key)).alias("last")).first()
            commit = {"run": run, "number": number, "id": name, "rows": counted["rows"], "first": counted["first"], "last": counted["last"]}
            if self._commit(commit):
                return counted["rows"]
        raise RuntimeError(f"other writers of run {run} were first {attempts} times")

    def _commit(self, commit: dict) -> bool:
        """Name a write in the manifest, unless its number is taken."""
        at = self._path(f"{self.path}/manifest/{uuid.uuid5(uuid.NAMESPACE_URL, commit['run']).hex}-{commit['number']:09d}.json")
        try:
            out = self._store.create(at, False)
        except Exception as e:  # noqa: BLE001  the store says in its own way that there is such a file
            if "exists" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        return True

    def clean(self) -> list[str]:
        """Delete the folders that no commit names, when no writer is at work."""
        named = {c["id"] for c in self.manifest()}
        left = [n for n in self._listed("data") if n not in named]
        for n in left:
            self._store.delete(self._path(f"{self.path}/data/{n}"), True)
        return left
