"""Interleaving sources to target weights by Pfair scheduling. Column expressions and joins only.

Target weights are whole units, ``q`` of them in all. Block ``k`` of a source with ``a`` of ``q`` units is released at
slot ``floor(k q / a)`` and due at ``ceil((k + 1) q / a)``; each slot goes to the released block with the earliest
deadline (ties: first source by name). The units add up to ``q``, so every block meets its deadline and at every slot
each source is less than one block from its share. After ``q`` slots the schedule repeats, so it is worked out once for
one period of at most ``max_period`` slots, and every block finds its slot by arithmetic.

Given weights are taken exactly, as fractions (0.3 is three tenths); a source with weight zero or without one is not in
the mix. Without weights a source's weight is its row count to the power ``power`` (1: its own share, 0: equal shares),
rounded to units, ``resolution`` of them or about; sources with less than half a unit are scheduled together as one, so
any number of sources makes a bounded period.

The mix ends (``in_mix`` false from there on) before the first slot that a source that has run out leaves empty, so the
shares hold, to less than a block, over the whole mix; with ``until="last"`` it goes on until all sources have run out,
and leaves nothing out but sources without weight.

Blocks are ``block_size`` documents of one source in the order of the md5 of their ids. Positions come from counts of
hash buckets and a numbering inside each bucket, so a source with a third of all rows is numbered in 4096 parts.

Defined cases: null sources count as the empty name; null ids are ordered as the empty id; repeated rows are documents
of their own; an empty table gives an empty result; weights for sources without rows are ignored; rows out of the mix for
want of a weight have no block and no slot. :func:`mixed` keeps all columns of its rows, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_DIGITS = 3
BROADCAST_ROWS = 100_000


def exact_units(weights: dict[str, float], max_period: int) -> dict[str, int]:
    """Whole units in the proportion of the weights, those of weight zero left out."""
    shares = {k: Fraction(str(v)) for k, v in weights.items()}
    if any(v < 0 for v in shares.values()):
        raise ValueError("weights can't be negative")
    scale = lcm(*(v.denominator for v in shares.values())) if shares else 1
    units = {k: int(v * scale) for k, v in shares.items() if v}
    common = gcd(*units.values()) if units else 1
    units = {k: v // common for k, v in units.items()}
    if sum(units.values()) > max_period:
        raise ValueError(f"these weights need a period of {sum(units.values())} slots, more than {max_period}: round them")
    return units


def _lanes(counts: DataFrame, weights: dict[str, float] | None, power: float, resolution: int, max_period: int) -> DataFrame:
    """Rows (source, lane, n, units) from rows (source, n); lane and units are null for a source without weight, n is the lane's."""
    every = Window.partitionBy()
    if weights is not None:
        given = exact_units(weights, max_period)
        table = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(v))]) if given else F.lit(None).cast("map<string,int>")
        units = F.try_element_at(table, F.col("source"))
        return counts.select("source", F.when(units.isNotNull(), F.concat(F.lit("s"), "source")).alias("lane"), "n", units.alias("units"))
    shared = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(power))) if power != 0.5 else F.sqrt(F.col("n").cast("double"))).withColumn("w", F.col("w") / F.sum("w").over(every))
    laned = shared.withColumn("lane", F.when(F.col("w") * (2 * resolution) >= 1, F.concat(F.lit("s"), "source")).otherwise(F.lit("rest")))
    lanes = laned.groupBy("lane").agg(F.sum("n").alias("n"), F.greatest(F.lit(1), F.round(F.sum("w") * resolution)).cast("int").alias("units"))
    return laned.select("source", "lane").join(lanes, "lane").select("source", "lane", "n", "units")


def _period(lanes: DataFrame) -> DataFrame:
    """Rows (lane, k, at): the slot of each block of one period. One row is folded, as long as the period."""
    state = "struct<done:array<int>,picks:array<int>>"
    one = lanes.agg(F.sort_array(F.collect_list(F.struct("lane", "units"))).alias("s"), F.sum("units").cast("int").alias("q"))
    due = lambda k, a, q: F.ceil((k + 1) * q / a).cast("int")

    def step(x: Column, t: Column) -> Column:
        ready = F.transform(x["done"], lambda k, i: F.when(F.floor(k * F.col("q") / F.col("s")[i]["units"]) <= t, F.struct(due(k, F.col("s")[i]["units"], F.col("q")).alias("due"), i.alias("i"))))
        chosen = F.array_min(F.filter(ready, lambda r: r.isNotNull()))["i"]
        return F.struct(F.transform(x["done"], lambda k, i: F.when(i == chosen, k + 1).otherwise(k)).alias("done"), F.array_append(x["picks"], chosen).alias("picks"))

    start = F.struct(F.transform("s", lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("picks")).cast(state)
    picks = one.where("q > 0").select("s", F.posexplode_outer(F.aggregate(F.sequence(F.lit(0), F.col("q") - 1), start, step, lambda x: x["picks"])).alias("at", "i")).select(F.col("s")[F.col("i")]["lane"].alias("lane"), "at")
    return picks.select("lane", "at", (F.row_number().over(Window.partitionBy("lane").orderBy("at")) - 1).alias("k"))


def _slots(docs: DataFrame, weights: dict[str, float] | None, power: float, until: str, block_size: int, resolution: int, max_period: int) -> DataFrame:
    """``docs`` (doc_id, source and others) with units, period, block, slot and in_mix."""
    if until not in ("first", "last"):
        raise ValueError("until is first or last")
    hashed = docs.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    buckets = hashed.groupBy("source", "bucket").agg(F.count("*").alias("rows"))
    sources = _lanes(buckets.groupBy("source").agg(F.sum("rows").alias("n")), weights, power, resolution, max_period)
    # a source is a row: broadcast only if there are few
    named = sources.select("source", "lane", "units")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    counts = buckets.join(named, "source").where("lane is not null").groupBy("lane", "bucket").agg(F.sum("rows").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("lane").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("lane", "bucket", before.alias("before"))
    # from here on lanes are as many as a period has slots at most
    lanes = sources.where("lane is not null").select("lane", "n", "units").distinct()
    lanes = lanes.withColumn("period", F.sum("units").over(Window.partitionBy()).cast("int"))
    period = _period(lanes)
    # the slot of the first block that a lane hasn't got
    place = F.floor(F.col("k") / F.col("units")) * F.col("period") + F.col("at")
    missing = lanes.withColumn("k", F.ceil(F.col("n") / block_size)).withColumn("turn", F.pmod("k", "units").cast("int"))
    ends = missing.join(F.broadcast(period.withColumnRenamed("k", "turn")), ["lane", "turn"]).agg(F.min(place).alias("end"))
    end = F.lit(None).cast("long") if until == "last" else F.lit(ends.first()["end"]).cast("long")

    inside = F.row_number().over(Window.partitionBy("lane", "bucket").orderBy("h", "doc_id")) - 1
    laned = hashed.join(named, "source")
    numbered = laned.where("lane is not null").withColumn("inside", inside).join(offsets, ["lane", "bucket"]).withColumn("block", F.floor((F.col("before") + F.col("inside")) / block_size).cast("long")).withColumn("turn", F.pmod("block", "units").cast("int"))
    timed = numbered.join(F.broadcast(period.withColumnRenamed("k", "turn")), ["lane", "turn"]).join(F.broadcast(lanes.select("lane", "period")), "lane")
    slot = (F.floor(F.col("block") / F.col("units")) * F.col("period") + F.col("at")).cast("long")
    columns = docs.columns
    within = timed.select(*columns, "units", "period", "block", slot.alias("slot"), F.coalesce(slot < end, F.lit(True)).alias("in_mix"))
    out = laned.where("lane is null").select(*columns, F.lit(0).alias("units"), F.lit(None).cast("int").alias("period"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("slot"), F.lit(False).alias("in_mix"))
    return within.unionByName(out) if weights is not None else within


def mixing(df: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", power: float = 1.0, until: str = "first", block_size: int = 16, resolution: int = 1000, max_period: int = 10_000) -> DataFrame:
    """Per document: doc_id, source, units, period, block, release, deadline, slot and in_mix."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    slots = _slots(docs, weights, power, until, block_size, resolution, max_period)
    return slots.select("doc_id", "source", "units", "period", "block", F.floor(F.col("block") * F.col("period") / F.col("units")).cast("long").alias("release"), F.ceil((F.col("block") + 1) * F.col("period") / F.col("units")).cast("long").alias("deadline"), "slot", "in_mix")


def _whole(df: DataFrame, weights: dict[str, float] | None, id_col: str, source_col: str, power: float, until: str, block_size: int, resolution: int, max_period: int) -> DataFrame:
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"))
    return _slots(docs, weights, power, until, block_size, resolution, max_period).where("in_mix")


def mixed(df: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", power: float = 1.0, until: str = "first", block_size: int = 16, resolution: int = 1000, max_period: int = 10_000) -> DataFrame:
    """The rows of ``df`` that are in the mix, with all their columns, in the order of their slots."""
    return _whole(df, weights, id_col, source_col, power, until, block_size, resolution, max_period).orderBy("slot", "doc_id").select("whole.*")


def slotted(df: DataFrame, name: str = "mix_slot", id_col: str = "doc_id", source_col: str = "source", block_size: int = 16, resolution: int = 1000, max_period: int = 10_000) -> DataFrame:
    """All rows of ``df`` with a column more, the slot of each in an even interleaving of the sources by their own shares."""
    slots = _whole(df, None, id_col, source_col, 1.0, "last", block_size, resolution, max_period)
    return slots.select(*[F.col("whole")[c].alias(c) for c in df.columns if c != name], F.col("slot").alias(name))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all of ``documents``, each source weighted by the root of its row count."""
    return mixing(spark.read.parquet(f"{sf_dir}/documents.parquet"), power=0.5)


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
sh AS (SELECT source, n, sqrt(n::DOUBLE) / sum(sqrt(n::DOUBLE)) OVER () AS w FROM c),
la AS (SELECT source, n, w, CASE WHEN w * 2000 >= 1 THEN 's' || source ELSE 'rest' END AS lane FROM sh),
u AS (SELECT lane, sum(n)::BIGINT AS n, greatest(1, round(sum(w) * 1000))::INT AS units FROM la GROUP BY lane),
p AS (SELECT list(units ORDER BY lane) AS us, list(lane ORDER BY lane) AS ss, sum(units)::BIGINT AS q FROM u),
e(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(us, lambda x: 0::BIGINT), NULL::BIGINT FROM p
  UNION ALL
  SELECT t + 1, list_transform(done, lambda k, i: CASE WHEN i = c THEN k + 1 ELSE k END), c
  FROM (
    SELECT t, done, list_min(list_filter(list_transform(done, lambda k, i: CASE WHEN k * q // us[i] <= t + 1 THEN (((k + 1) * q + us[i] - 1) // us[i]) * 100000 + i END), lambda v: v IS NOT NULL)) % 100000 AS c
    FROM e, p WHERE t + 1 < q)),
per AS (SELECT ss[pick] AS lane, t AS at, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM e, p WHERE pick IS NOT NULL),
b AS (SELECT d.*, la.lane, (row_number() OVER (PARTITION BY la.lane ORDER BY h, doc_id) - 1) // 16 AS block FROM d JOIN la USING (source)),
s AS (
  SELECT b.doc_id, b.source, u.units, p.q, b.block, (b.block // u.units) * p.q + per.at AS slot
  FROM b JOIN u USING (lane) JOIN per ON per.lane = b.lane AND per.k = b.block % u.units, p),
en AS (
  SELECT min((((n + 15) // 16) // units) * q + per.at) AS stop
  FROM u JOIN per ON per.lane = u.lane AND per.k = ((n + 15) // 16) % units, p)
SELECT doc_id, source, units, q::INT AS period, block::BIGINT AS block, (block * q // units)::BIGINT AS release, (((block + 1) * q + units - 1) // units)::BIGINT AS deadline, slot::BIGINT AS slot, slot < stop AS in_mix
FROM s, en
"""
