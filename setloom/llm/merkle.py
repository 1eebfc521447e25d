"""A Merkle manifest of a table: a root over all rows and a proof for each, by superblocks.

Rows are leaves, in the order of their ids within their group (source); every ``fanout`` consecutive nodes become one,
until a group is one node, and the groups' nodes, in the order of the groups, become the root in the same way. A
superblock is a bucket of ``fanout ** k`` neighbouring nodes of a group: one task of ``applyInPandas`` turns it into the
node ``k`` levels above. The superblocks' nodes are reduced in the same way, so a table of any size takes
``log(rows) / (k log(fanout))`` rounds; then proofs come down: what a superblock's node is proved by follows what its
leaves are proved by inside of it. Hashes inside a superblock are made again on the way down instead of being stored.

Leaves are numbered by a sort across partitions and counts of each partition and group, so a group that holds most rows
is dealt over all tasks. Groups with fewer rows than a superblock share tasks, so a table with a group for each row isn't a
task for each row.

The digest of a row is that of its columns, ``-`` for a null, else the length in bytes, a colon and the value; that of a
node is that of its children's hexadecimal digests one after the other.

Defined cases: rows that share an id follow each other by their digests, repeated rows are leaves of their own; rows
without an id come first in their group, rows without a group form the first group; columns that aren't named aren't
read; an empty table has no rows and no root; a text of any length is hashed where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.llm._store import stash

FANOUT, DEPTH = 3, 7
STEP = "array<struct<before:string,after:string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(columns: list[Column]) -> Column:
    """The digest of a row of these columns."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def depth_of(n: int, fanout: int) -> int:
    """Levels from ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def climb(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, those given first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def steps(tree: list[list[str]], place: int, fanout: int) -> list[tuple[str, str]]:
    """The siblings before and after the node at ``place`` and each of its ancestors below the top."""
    out = []
    for below in tree[:-1]:
        first = place - place % fanout
        out.append(("".join(below[first:place]), "".join(below[place + 1 : first + fanout])))
        place //= fanout
    return out


def fold(node: str, proof: list[tuple[str, str]]) -> str:
    """The root that a node and its proof lead to."""
    for before, after in proof:
        node = sha(before + node + after)
    return node


def _superblocks(rows: pd.DataFrame, fanout: int, depth: int) -> Iterator[tuple[pd.DataFrame, list[list[str]]]]:
    """The superblocks of some rows, in order, each with its tree."""
    rows = rows.sort_values(["grp_no", "place"], kind="stable")
    keys = np.stack([rows["grp_no"].to_numpy(), rows["place"].to_numpy() // fanout**depth])
    cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(rows)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = rows.iloc[a:b]
        yield part, climb(part["node"].tolist(), min(depth, depth_of(int(part["n"].iloc[0]), fanout)), fanout)


def _up(rows: pd.DataFrame, fanout: int, depth: int) -> pd.DataFrame:
    """The node above each superblock, with the task that made it (``of``)."""
    out = [(p["task"].iloc[0], p["grp_no"].iloc[0], p["place"].iloc[0] // fanout**depth, -(-p["n"].iloc[0] // fanout**depth), tree[-1][0]) for p, tree in _superblocks(rows, fanout, depth)]
    return pd.DataFrame(out, columns=["of", "grp_no", "place", "n", "node"])


def _above(tops: pd.DataFrame) -> dict[tuple[int, int], list[tuple[str, str]]]:
    """The steps from each superblock's node."""
    return {(g, p): [(x["before"], x["after"]) for x in above] for g, p, above in zip(tops["grp_no"], tops["place"], tops["above"], strict=True)}


def _down(rows: pd.DataFrame, tops: pd.DataFrame, fanout: int, depth: int) -> pd.DataFrame:
    """Every node's steps inside of its superblock, then those of the superblock."""
    above, out = _above(tops), []
    for part, tree in _superblocks(rows, fanout, depth):
        upper = above[part["grp_no"].iloc[0], part["place"].iloc[0] // fanout**depth]
        out += [(of, g, p, [{"before": x, "after": y} for x, y in steps(tree, i, fanout) + upper]) for i, (of, g, p) in enumerate(zip(part["of"], part["grp_no"], part["place"], strict=True))]
    return pd.DataFrame(out, columns=["of", "grp_no", "place", "above"])


def _proved(rows: pd.DataFrame, tops: pd.DataFrame, fanout: int, depth: int) -> pd.DataFrame:
    """For leaves: the digest of the proof and the root that the other leaf leads to."""
    above, out = _above(tops), []
    for part, tree in _superblocks(rows, fanout, depth):
        upper = above[part["grp_no"].iloc[0], part["place"].iloc[0] // fanout**depth]
        text = "".join(x + y for x, y in upper)
        for i, (g, p, node, other) in enumerate(zip(part["grp_no"], part["place"], part["node"], part["other"], strict=True)):
            own = steps(tree, i, fanout)
            out.append((g, p, node, sha("".join(x + y for x, y in own) + text), fold(other, own + upper)))
    return pd.DataFrame(out, columns=["grp_no", "place", "leaf", "proof_sha256", "folded_root"])


class _Tree:
    """The nodes (of, grp_no, place, n, node) of each round, from leaves to one node for each group."""

    def __init__(self, leaves: DataFrame, fanout: int, depth: int):
        self.fanout, self.depth, self.size = fanout, depth, fanout**depth
        self.rounds, self.shared = [leaves.withColumn("of", F.lit(0).cast("long"))], []
        most = 2
        while most > 1:
            small = self.rounds[-1].where(F.col("n") < self.size).count()
            self.shared.append(max(1, -(-small // self.size)))
            up = self.tasks(len(self.rounds) - 1).applyInPandas(lambda rows: _up(rows, fanout, depth), "of long, grp_no long, place long, n long, node string")
            self.rounds.append(stash(up, "merkle-up"))
            most = self.rounds[-1].agg(F.max("n")).first()[0] or 0

    def tasks(self, i: int):
        """The superblocks of a round, each a task, and those of small groups together in as many as they would fill."""
        shared = F.pmod(F.xxhash64("grp_no"), F.lit(self.shared[i]))
        task = F.when(F.col("n") < self.size, shared).otherwise(F.xxhash64("grp_no", F.expr(f"place div {self.size}")))
        return self.rounds[i].withColumn("task", task).groupBy("task")

    def proofs(self, top: DataFrame) -> DataFrame:
        """Rows (of, grp_no, place, above) for the superblocks of the leaves; ``top`` has the steps (grp_no, above) from each group's node."""
        above = self.rounds[-1].select("of", "grp_no", "place").join(top, "grp_no")
        for i in range(len(self.rounds) - 2, 0, -1):
            above = stash(self.down(i, above), "merkle-down")
        return above

    def down(self, i: int, above: DataFrame) -> DataFrame:
        f, d = self.fanout, self.depth
        return self.tasks(i).cogroup(above.groupBy("of")).applyInPandas(lambda rows, tops: _down(rows, tops, f, d), f"of long, grp_no long, place long, above {STEP}")

    def proved(self, above: DataFrame) -> DataFrame:
        f, d = self.fanout, self.depth
        return self.tasks(0).cogroup(above.groupBy("of")).applyInPandas(lambda rows, tops: _proved(rows, tops, f, d), "grp_no long, place long, leaf string, proof_sha256 string, folded_root string")


def _sorted(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A stored table of ``df`` sorted across partitions, with the partition (``part``) and the place in it (``at``, from any start)."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)


def _shifts(at: DataFrame, key: str) -> DataFrame:
    """What is to be added to ``at`` for the place among the rows of the same key, for each key and partition; and ``n``, the rows of the key."""
    counts = at.groupBy(key, "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    w = Window.partitionBy(key)
    before = F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(key, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(w).alias("n"))


def merkle(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", other: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Per row: id, grp, leaf, subroot, root, proof_sha256, and the root that ``other`` (a digest of a changed row, the leaf's own if None) leads to with the leaf's proof."""
    leaf = row_digest([F.col(f"`{c}`") for c in columns])
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("grp"), leaf.alias("node"), (leaf if other is None else other).alias("other"))
    at = _sorted(rows, ["grp", "id", "node"], "merkle-rows")
    shifts = stash(_shifts(at, "grp"), "merkle-shifts")
    # groups in their order; there are few for each partition, and their partitions and places number them as they do rows
    groups = _sorted(shifts.select("grp").distinct().withColumn("all", F.lit(0)), ["all", "grp"], "merkle-groups")
    numbered = groups.join(F.broadcast(_shifts(groups, "all").drop("all")), "part").select(F.col("grp").alias("_grp"), (F.col("at") + F.col("shift")).cast("long").alias("grp_no"), F.col("n").alias("groups"))
    shifts = stash(shifts.join(numbered, F.col("grp").eqNullSafe(F.col("_grp"))).drop("grp"), "merkle-shifts")
    mine = (F.col("part") == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_grp"))
    placed = at.join(shifts.withColumnRenamed("part", "_part"), mine)
    leaves = stash(placed.select("id", "grp", "grp_no", (F.col("at") + F.col("shift")).cast("long").alias("place"), F.col("n").cast("long").alias("n"), "node", "other"), "merkle-leaves")
    trees = _Tree(leaves.select("grp_no", "place", "n", "node", "other"), fanout, depth)
    subroots = trees.rounds[-1].select("grp_no", F.col("node").alias("subroot"))
    # the groups' nodes are the leaves of one more tree
    sizes = shifts.select("grp_no", "groups").distinct()
    tops = subroots.join(sizes, "grp_no").select(F.lit(0).cast("long").alias("grp_no"), F.col("grp_no").alias("place"), F.col("groups").cast("long").alias("n"), F.col("subroot").alias("node"))
    top = _Tree(stash(tops, "merkle-tops"), fanout, depth)
    root = top.rounds[-1].select("node").first()
    none = top.rounds[-1].select("grp_no", F.array().cast(STEP).alias("above"))
    group_proofs = stash(top.down(0, top.proofs(none)).select(F.col("place").alias("grp_no"), "above"), "merkle-group-proofs")
    judged = trees.proved(trees.proofs(group_proofs))
    named = judged.join(leaves.select("grp_no", "place", "id", "grp"), ["grp_no", "place"]).join(subroots, "grp_no")
    return named.select("id", "grp", "leaf", "subroot", F.lit(root and root[0]).cast("string").alias("root"), "proof_sha256", "folded_root")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; where 2 divides the crc32 of the id, the line breaks of the text are taken out on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = [F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if c == "text" else F.col(c) for c in columns]
    out = merkle(docs, columns, other=row_digest(changed))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The tree level by level for each source and for the sources' nodes; a proof is the list of the siblings on the way.
OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
         text, replace(text, chr(10), '') AS cut, hex(doc_id::VARCHAR) AS h FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 2 = 0
              THEN sha256(head || coalesce(strlen(cut)::VARCHAR || ':' || cut, '-')) ELSE sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) END AS other
  FROM d, tab),
o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
up(k, s, i, n, h) AS (
  SELECT 0, s, i, n, leaf FROM o
  UNION ALL
  SELECT k + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY k, s, i // 3, n),
sub AS (SELECT s, k, h FROM up WHERE n = 1),
top(k, i, n, h) AS (
  SELECT 0, s, (SELECT count(*) FROM sub), h FROM sub
  UNION ALL
  SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 3, n),
sib AS (
  SELECT x.s, x.k, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS b
  FROM up x JOIN up y ON y.s = x.s AND y.k = x.k AND y.i // 3 = x.i // 3 WHERE x.n > 1 GROUP BY x.s, x.k, x.i),
tsib AS (
  SELECT x.k, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS b
  FROM top x JOIN top y ON y.k = x.k AND y.i // 3 = x.i // 3 WHERE x.n > 1 GROUP BY x.k, x.i),
walk(doc_id, leaf, s, i, n, k, proof, node) AS (
  SELECT doc_id, leaf, s, i, n, 0, '', other FROM o
  UNION ALL
  SELECT doc_id, leaf, w.s, w.i // 3, (w.n + 2) // 3, w.k + 1, proof || a || b, sha256(a || node || b) FROM walk w JOIN sib ON sib.s = w.s AND sib.k = w.k AND sib.i = w.i WHERE w.n > 1),
twalk(doc_id, leaf, s, i, n, k, proof, node) AS (
  SELECT doc_id, leaf, s, s, (SELECT count(*) FROM sub), 0, proof, node FROM walk WHERE n = 1
  UNION ALL
  SELECT doc_id, leaf, w.s, w.i // 3, (w.n + 2) // 3, w.k + 1, proof || a || b, sha256(a || node || b) FROM twalk w JOIN tsib ON tsib.k = w.k AND tsib.i = w.i WHERE w.n > 1)
SELECT doc_id, leaf, sub.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified
FROM twalk w JOIN sub ON sub.s = w.s JOIN (SELECT h FROM top WHERE n = 1) r ON true WHERE w.n = 1
"""
