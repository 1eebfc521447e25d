"""Documents whose sets of word shingles are alike (Jaccard), through trees of count vectors.

A document's set is that of its distinct ``gram``-word shingles, as 64-bit hashes. Hashing shingles into ``GROUPS``
groups gives a vector of counts (one byte each, the highest value standing for any count from there on); the sum of
coordinate minima of two vectors bounds the overlap of their sets from above, and the maxima over the vectors under a
tree node bound it for all of them. Pairs that survive the bound are verified on the sets themselves, so links are exact.

One tree over a corpus prunes little in so many dimensions, so the points are first dealt to leaves that lose no pair:
two sets that are alike share one of the rarest-first ``n - ceil(0.85 n) + 1`` shingles of each (any order common to all
documents works; here shingles that a merged sketch of the whole corpus shows in many documents come last).
A group of points that share such a shingle is joined in three steps, so that thousands of near copies don't make all
their pairs: each point with the group's least document, then, after contracting the links found, only pairs of
points that are not connected yet, through a bulk-loaded tree of the group's count vectors. Large groups are split by
size band and then into blocks that are joined block by block, each with its tree. The links found connect what all
links would.

Exact copies (equal sets) are one point, their least doc_id stands for them.

Defined cases: texts that are null or without words have an empty set and are linked with nothing; fewer words than a
shingle make one shingle; rows that share a doc_id count as one document in links; a null doc_id is linked with
nothing and has no component; ids may be of any type that has an order; an empty table gives an empty result; a text of
any length is one set. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm._graph import components
from setloom.llm._ids import named, numbered
from setloom.llm._store import stash
from setloom.llm._words import mix, runs, slices

GROUPS, FOLDED, FULL = 256, 64, 255
SKETCH_BITS, CHUNK_BITS = 22, 16
BLOCK, NODE = 512, 16
BROADCAST_ROWS = 1_000_000


def _sets(column: pa.Array, gram: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes, for each text."""
    for s in slices(column, lower=True):
        shingles = runs(s.hashes, gram)
        for i in range(len(s.first) - 1):
            a, b = int(s.first[i]), int(s.first[i + 1])
            if b - a >= gram:
                yield s.row + i, np.unique(shingles[a : b - gram + 1])
            elif b > a:
                yield s.row + i, runs(s.hashes[a:b], b - a)
            else:
                yield s.row + i, shingles[:0]


def _sketch(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """This partition's counters of shingles, a row a chunk, in bytes if they fit."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        for _, shingles in _sets(batch["text"], gram):
            np.add.at(counts, (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
    for k, part in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(part.astype(np.uint8) if part.max() < 256 else part).tobytes()], pa.binary())], names=["chunk", "counts"])


def _loud(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of the whole corpus that stand out of the noise of their chunk."""
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            part = np.frombuffer(data, np.uint8 if len(data) == 1 << CHUNK_BITS else np.uint32)
            merged[k] = merged.get(k, np.zeros(1 << CHUNK_BITS, np.int64)) + part
    for k, counts in merged.items():
        mean = float(counts.mean())
        at = np.flatnonzero(counts >= max(64, mean + 8 * np.sqrt(mean) + 8))
        yield pa.RecordBatch.from_arrays([pa.array(at + (k << CHUNK_BITS)), pa.array(counts[at])], names=["at", "n"])


def _points(batches: Iterator[pa.RecordBatch], gram: int, percent: int, frequent) -> Iterator[pa.RecordBatch]:
    """Per document: set size, 128-bit digest of the set, count vector, and the shingles that it is filed under."""
    last = frequent.value
    shift = np.uint64(64 - SKETCH_BITS)
    for batch in batches:
        size, one, two, vectors, filed = [], [], [], [], []
        for _, u in _sets(batch["text"], gram):
            n = len(u)
            size.append(n)
            one.append(int(mix(u).sum(dtype=np.uint64).view(np.int64)) if n else 0)
            two.append(int(mix(u ^ np.uint64(0xA5A5F00DDEADBEEF)).sum(dtype=np.uint64).view(np.int64)) if n else 0)
            vectors.append(np.minimum(np.bincount((u & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint8).tobytes())
            keep = n + (percent * n) // -100 + 1 if n else 0  # n - ceil(percent n / 100) + 1
            late = last[(u >> shift).astype(np.int64)]
            first = u[~late][:keep]
            filed.append(np.concatenate([first, u[late][: keep - len(first)]]).view(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in filed])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(filed) if filed else np.zeros(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(vectors, pa.binary()), lists], names=["doc_id", "n", "d1", "d2", "vector", "filed"])


def _vectors(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), -1)


def _bounds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the overlap of two sets can't exceed by their counts, for each pair of rows; no bound where both counts of a group are full."""
    least = np.minimum(x, y)
    out = least.sum(axis=1, dtype=np.int64)
    out[(least == FULL).any(axis=1)] = np.iinfo(np.int64).max
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of ``FOLDED`` counts, each the sum of those of some groups."""
    for batch in batches:
        v = _vectors(batch["vector"])
        sums = np.minimum(v.reshape(len(v), FOLDED, -1).sum(axis=2, dtype=np.int32), FULL).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([x.tobytes() for x in sums], pa.binary())], names=["id", "folded"])


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of linked sets with n and m members."""
    return -(-percent * (n + m) // (100 + percent))


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose summed minima reach the overlap that a link needs."""
    for batch in batches:
        for i in range(0, len(batch), 20_000):
            part = batch.slice(i, 20_000)
            n, m = part["na"].to_numpy(), part["nb"].to_numpy()
            keep = _bounds(_vectors(part["va"]), _vectors(part["vb"])) >= _needed(n, m, percent)
            yield part.select(["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are linked."""
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for i, (x, y) in enumerate(zip(batch["sa"], batch["sb"], strict=True)):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


class CountTree:
    """Points of count vectors in a bulk-loaded tree, ``NODE`` to a node: sorted by set size into slabs, and in each slab by the sums of the half of its coordinates that vary most."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        if len(order) > NODE:
            slab = NODE * max(1, int(np.ceil(np.sqrt(len(order) / NODE))))
            parts = []
            for i in range(0, len(order), slab):
                part = order[i : i + slab]
                widest = np.argsort(vectors[part].var(axis=0), kind="stable")[vectors.shape[1] // 2 :]
                parts.append(part[np.argsort(vectors[part][:, widest].sum(axis=1, dtype=np.int64), kind="stable")])
            order = np.concatenate(parts)
        self.order = order
        self.levels = [(sizes[order], sizes[order], vectors[order])]
        while len(self.levels[-1][0]) > NODE:
            low, high, top = self.levels[-1]
            cuts = np.arange(0, len(low), NODE)
            self.levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(top, cuts, axis=0)))

    def join(self, other: CountTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs of points that the bounds can't rule out."""
        depth = max(len(self.levels), len(other.levels)) - 1
        at = lambda tree, d: tree.levels[min(d, len(tree.levels) - 1)]
        x, y = (g.ravel() for g in np.meshgrid(np.arange(len(at(self, depth)[0])), np.arange(len(at(other, depth)[0])), indexing="ij"))
        while True:
            keep = np.zeros(len(x), bool)
            (low, high, top), (low2, high2, top2) = at(self, depth), at(other, depth)
            for i in range(0, len(x), 1 << 15):
                p, q = x[i : i + (1 << 15)], y[i : i + (1 << 15)]
                sized = np.flatnonzero((100 * high[p] >= percent * low2[q]) & (100 * high2[q] >= percent * low[p]))
                p, q = p[sized], q[sized]
                keep[i + sized] = _bounds(top[p], top2[q]) >= _needed(low[p], low2[q], percent)
            x, y = x[keep], y[keep]
            if not depth:
                return self.order[x], other.order[y]
            depth -= 1
            x, y = self._down(x, y, depth, other)

    def _down(self, x: np.ndarray, y: np.ndarray, depth: int, other: CountTree) -> tuple[np.ndarray, np.ndarray]:
        for tree in (self, other):
            if depth < len(tree.levels) - 1:
                x = (x[:, None] * NODE + np.arange(NODE)).ravel()
                y = np.repeat(y, NODE)
                inside = x < len(tree.levels[depth][0])
                x, y = x[inside], y[inside]
            x, y = y, x
        return x, y


def _group_pairs(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group that are not connected and may be linked. Guests (side 1) are not paired with each other."""
    ids, n, label, side = (rows[c].to_numpy() for c in ("id", "n", "label", "side"))
    vectors = _vectors(rows["folded"])
    own, guest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    tree = CountTree(n[own], vectors[own])
    i, j = CountTree(n[guest], vectors[guest]).join(tree, percent) if len(guest) else tree.join(tree, percent)
    i, j = (guest if len(guest) else own)[i], own[j]
    keep = label[i] != label[j]
    a, b = np.minimum(ids[i[keep]], ids[j[keep]]), np.maximum(ids[i[keep]], ids[j[keep]])
    return tuple(np.unique(np.stack([a, b]), axis=1)) if len(a) else (a, b)


def _open_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of every group; a group's rows follow each other."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        key = table["task"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        yield from _of_groups(table, cuts[:-1], percent)
        rest = table.slice(int(cuts[-2])) if len(key) else rest
    if rest is not None:
        yield from _of_groups(rest, np.array([0, len(rest)]), percent)


def _leaf_pairs(rows: pa.Table, cuts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_group_pairs`, for many groups that are a single leaf each, all at once. Group ``g`` has the rows from ``cuts[g]`` to ``cuts[g + 1]``."""
    size = np.diff(cuts)
    after = np.repeat(cuts[1:], size) - np.arange(cuts[0], cuts[-1]) - 1  # rows of the same group behind each row
    left = np.repeat(np.arange(cuts[0], cuts[-1]), after)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
    ids, n, label = (rows[c].to_numpy() for c in ("id", "n", "label"))
    open_ = (label[left] != label[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
    left, right = left[open_], right[open_]
    if not len(left):
        return ids[:0], ids[:0]
    vectors = _vectors(rows["folded"])
    keep = np.zeros(len(left), bool)
    for i in range(0, len(left), 1 << 15):
        p, q = left[i : i + (1 << 15)], right[i : i + (1 << 15)]
        keep[i : i + (1 << 15)] = _bounds(vectors[p], vectors[q]) >= _needed(n[p], n[q], percent)
    a, b = ids[left[keep]], ids[right[keep]]
    return tuple(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)) if len(a) else (a, b)


def _of_groups(table: pa.Table, cuts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the groups between ``cuts``: runs of groups that fit one node of a tree together, others each with its tree."""
    size = np.diff(cuts)
    guests = np.add.reduceat(table["side"].to_numpy(), cuts[:-1]) if len(size) else size
    alone = (size > NODE) | (guests > 0)
    ends = np.unique(np.concatenate([[0], np.flatnonzero(alone), np.flatnonzero(alone) + 1, [len(size)]]))
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        part = table.slice(int(cuts[i]), int(cuts[j] - cuts[i])).combine_chunks()
        a, b = _group_pairs(part, percent) if alone[i] else _leaf_pairs(part, cuts[i : j + 1] - cuts[i], percent)
        for k in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 16)]), pa.array(b[k : k + (1 << 16)])], names=["a", "b"])


def _set_rows(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [u.view(np.int64) for _, u in _sets(batch["text"], gram)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.list_(pa.int64()))], names=["id", "members"])


class _Join:
    """One join over one table of documents."""

    def __init__(self, docs: DataFrame, gram: int, percent: int):
        self.docs, self.gram, self.percent = docs, gram, percent
        spark = docs.sparkSession
        loud = docs.mapInArrow(lambda it: _sketch(it, gram), "chunk int, counts binary").repartition("chunk").mapInArrow(_loud, "at long, n long")
        frequent = np.zeros(1 << SKETCH_BITS, bool)
        frequent[[r[0] for r in loud.orderBy(F.desc("n"), "at").limit(1 << 16).select("at").collect()]] = True
        frequent_there = spark.sparkContext.broadcast(frequent)
        points = docs.mapInArrow(lambda it: _points(it, gram, percent, frequent_there), "doc_id long, n long, d1 long, d2 long, vector binary, filed array<long>")
        self.points = stash(points, "points")
        filled = self.points.where("n > 0 and doc_id is not null")
        self.classes = stash(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
        first = filled.join(self.classes.select(F.col("id").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
        self.first = first.withColumnRenamed("doc_id", "id")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass the size and the count-vector bounds."""
        side = lambda x: self.vectors.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("vector").alias(f"v{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        return sized.select("a", "b", "na", "nb", "va", "vb").mapInArrow(lambda it, p=self.percent: _bounded(it, p), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs that are links, by their sets."""
        asked = stash(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked")
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
        members = stash(self.docs.join(asked, "doc_id", "left_semi").mapInArrow(lambda it, g=self.gram: _set_rows(it, g), "id long, members array<long>"), "members")
        side = lambda x: members.select(F.col("id").alias(x), F.col("members").alias(f"s{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lambda it, p=self.percent: _verified(it, p), "a long, b long").distinct()

    def links(self) -> DataFrame:
        filed = self.first.select("id", "n", F.explode("filed").alias("shingle"))
        # stored, as the open groups below, so that a frequent shingle is split where it is joined
        met = stash(filed.groupBy("shingle").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("shingle", "least"), "met")
        live = stash(filed.join(met, "shingle"), "live")
        self.vectors = stash(self.first.select("id", "n", "vector").join(live.select("id").distinct(), "id", "left_semi"), "vectors")

        stars = stash(live.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "stars")
        found = stash(self.verified(stash(self.bounded(stars), "bounded")), "links")

        labels = components(found)
        named = live.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("shingle", "id", "n", F.coalesce("label", "id").alias("label"))
        named = stash(named, "named")
        open_groups = stash(named.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("shingle", "rows"), "open-groups")
        tested = stash(named.join(open_groups, "shingle"), "open")
        more = self.open_pairs(tested).distinct().join(stars, ["a", "b"], "left_anti")
        late = stash(self.verified(stash(self.bounded(more), "bounded")), "links")
        return found.unionByName(late)

    def open_pairs(self, rows: DataFrame) -> DataFrame:
        folded = self.vectors.join(rows.select("id").distinct(), "id", "left_semi").select("id", "vector").mapInArrow(_folded, "id long, folded binary")
        rows = rows.join(folded, "id")
        columns = lambda task, side: [task.alias("task"), "id", "n", "label", side.alias("side"), "folded"]
        small = rows.where(F.col("rows") <= BLOCK).select(*columns(F.xxhash64("shingle", F.lit(0)), F.lit(0)))
        band = F.floor(F.log(F.col("n")) / float(np.log(100 / self.percent))).cast("int")
        large = rows.where(F.col("rows") > BLOCK).withColumn("band", band)
        blocks = large.groupBy("shingle", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        # a block meets the blocks of its own band (x <= y) and, as guest, those of the band above
        mine = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
        own = large.join(blocks, ["shingle", "band"]).withColumn("mine", mine).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        alike = own.select(*columns(F.xxhash64("shingle", "band", F.lit(1), F.least("mine", "x"), F.greatest("mine", "x")), F.when(F.col("mine") <= F.col("x"), 0).otherwise(1)))
        below = blocks.select("shingle", (F.col("band") + 1).alias("band"), F.col("blocks").alias("guests"))
        host = own.drop("x").dropDuplicates(["shingle", "id"]).join(below, ["shingle", "band"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("guests") - 1)))
        hosts = host.select(*columns(F.xxhash64("shingle", "band", F.lit(2), "x", "mine"), F.lit(0)))
        guest = large.join(blocks, ["shingle", "band"]).withColumn("mine", mine).drop("blocks").withColumn("band", F.col("band") + 1).join(blocks, ["shingle", "band"]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        guests = guest.select(*columns(F.xxhash64("shingle", "band", F.lit(2), "mine", "x"), F.lit(1)))
        every = small.unionByName(alike).unionByName(hosts).unionByName(guests)
        parts = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return every.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(lambda it, p=self.percent: _open_pairs(it, p), "a long, b long")

    def result(self) -> DataFrame:
        labels = components(self.links())
        salts = 16
        copies = self.classes.where("copies > 1").select("d1", "d2", "id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        rows = self.points.select("doc_id", "n", "d1", "d2", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
        stood = rows.join(copies, ["d1", "d2", "salt"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id"))
        return stood.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id reachable by links of ``percent`` or more."""
    docs, names = numbered(df, id_col, text_col)
    return named(_Join(docs, gram, percent).result(), names, "doc_id", "component_id")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: 4-word shingles, links at 0.85."""
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), gram=4, percent=85)
