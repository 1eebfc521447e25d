"""Phrases that occur together, by naming pairs of names.

Frequent words of each language get ids. Level by level, two neighbouring ids of a text (the names of the frequent
phrases of ``k - 1`` words that begin at one word and at the next) are counted as a pair; pairs that are frequent over
the whole corpus get ids of their own, which take the place of the words that begin them. A phrase is thus a pair (left,
right) of overlapping shorter ones: following left gives its beginnings, following right its endings, which is all that
the scores of its cuts and the test for longer phrases need. Whatever is part of a frequent phrase is frequent itself,
so no count is missing.

Texts are read once, into blocks of about ``BLOCK_BYTES`` and a language each: distinct words with their counts, and the
words as numbers of the block. Counts are summed over blocks before and after the shuffle; the global ids come back to a
block by a join on what the block holds, so no task or driver ever needs the vocabulary (frequent words or pairs are
broadcast while there are at most ``BROADCAST_ROWS``, counted). Blocks are stored tables, so that hot words meet in joins
that can be split.

The score of a cut is ``floor(1000000 a a / (l r))`` in decimals of 38 digits, exact for counts below 10^16.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count each time; ids aren't
read, nor are extra columns; an empty table gives an empty result; a text of any length is one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.llm._ids import counted_up
from setloom.llm._store import stash
from setloom.llm._words import texts

BLOCK_BYTES = 1 << 22
SALTS = 64
#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BROADCAST_ROWS = 1 << 21
#: A block is its distinct words or pairs, numbered by ``at``, with counts, and one row with its texts as such numbers (``codes``).
BLOCKS = "block long, lang string, at int, word string, n long, codes binary"
PAIRS = "block long, lang string, at int, left long, right long, n long, codes binary"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, and where a piece begins with one."""
    kind = KIND[data]
    word = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = word & edge[:-1]
    begins[1:] |= word[1:] & ~word[:-1]
    breaks = np.cumsum((kind == 2) | edge[:-1])[begins]
    starts = np.flatnonzero(begins[word])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, int(word.sum())).astype(np.int64)), pa.py_buffer(LOWER[data[word]]))
    return found, np.diff(breaks, prepend=-1) > 0


def _rows(block: int, lang: str, keys: dict[str, pa.Array], counts: np.ndarray, codes: np.ndarray | None) -> pa.Table:
    """A block: a row for each key, and one for the codes."""
    n = len(counts)
    rows = {"block": pa.repeat(pa.scalar(block), n), "lang": pa.repeat(pa.scalar(lang), n), "at": pa.array(np.arange(n, dtype=np.int32)), **keys, "n": pa.array(counts.astype(np.int64)), "codes": pa.nulls(n, pa.binary())}
    out = pa.table(rows)
    if codes is None:
        return out
    last = {k: pa.nulls(1, c.type) for k, c in rows.items()} | {"block": pa.array([block]), "lang": pa.array([lang]), "codes": pa.array([codes.tobytes()], pa.binary())}
    return pa.concat_tables([out, pa.table(last)])


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: distinct words, counts, and the texts as numbers of these words, -1 between pieces."""
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            offsets, data = texts(batch["text"].filter(pa.array(langs.indices.to_numpy() == k)))
            a = 0
            while a < len(offsets) - 1:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block_bytes, side="right")) - 1)
                found, first = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                a = b
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                codes = coded.indices.to_numpy()
                counts = np.bincount(codes, minlength=len(coded.dictionary))
                broken = np.insert(codes, np.flatnonzero(first), -1).astype("<i4")
                yield from _rows(block, lang, {"word": coded.dictionary.cast(pa.string())}, counts, broken).to_batches()
                block += 1


def _pairs(block: pa.Table, names: pa.Table, last: bool) -> pa.Table:
    """The distinct pairs of neighbouring frequent ids of one block with their counts; ``codes`` then are numbers of these pairs."""
    none = _rows(0, "", {"left": pa.array([], pa.int64()), "right": pa.array([], pa.int64())}, np.zeros(0, np.int64), None)
    if not len(block) or not len(names):
        return none
    codes = np.frombuffer(block["codes"][0].as_py(), "<i4")
    ids = names["id"].to_numpy()
    at = np.full(max(int(names["at"].to_numpy().max()), int(codes.max(initial=-1))) + 2, -1, np.int64)
    at[names["at"].to_numpy()] = np.arange(len(ids))
    held = at[codes]  # -1 takes the last place, which stays -1
    left, right = held[:-1], held[1:]
    places = np.flatnonzero((left >= 0) & (right >= 0))
    distinct, pair, counts = np.unique(left[places] * len(ids) + right[places], return_inverse=True, return_counts=True)
    if not len(distinct):
        return none
    after = None
    if not last:
        after = np.full(len(codes), -1, "<i4")
        after[places] = pair
    keys = {"left": pa.array(ids[distinct // len(ids)]), "right": pa.array(ids[distinct % len(ids)])}
    return _rows(block["block"][0].as_py(), block["lang"][0].as_py(), keys, counts, after)


def _named(blocks: DataFrame, names: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """The pairs of every block, by the global ids of what it holds."""
    ids = names.select(*keys, "id")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    back = blocks.where("codes is null").join(ids, keys).select(F.col("block").alias("of"), F.col("lang").alias("tongue"), "at", "id")
    codes = blocks.where("codes is not null").select("block", "lang", "codes")
    return codes.groupBy("block", "lang").cogroup(back.groupBy("of", "tongue")).applyInArrow(lambda b, n: _pairs(b, n, last), PAIRS)


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    top = wide(a, 19) * wide(a, 16)
    return F.call_function("div", wide(wide(top, 32) * wide(F.lit(1_000_000), 7), 38), wide(wide(left, 19) * wide(right, 19), 38))


def phrases(df: DataFrame, longest: int = 3, least: int = 10, share: int = 50, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Candidates (lang, size, phrase, a, l, r, score, dropped) of 2 to ``longest`` words that occur ``least`` times, and (lang, n), the words of each language.

    ``dropped``: the words lie in a longer candidate that occurs at least ``share`` percent as often.
    """
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    blocks = stash(docs.mapInArrow(lambda it: _blocks(it, block_bytes), BLOCKS), "blocks", "zstd")
    entries = blocks.where("codes is null")
    totals = entries.groupBy("lang").agg(F.sum("n").alias("n"))
    counted = entries.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    none = F.array().cast("array<long>")
    names = counted_up(counted.select("lang", "word", "n", F.col("word").alias("phrase"), none.alias("heads"), none.alias("tails")), "words")
    keys, levels = ["lang", "word"], []
    for size in range(2, longest + 1):
        pairs = _named(blocks, names, keys, size == longest)
        blocks = pairs if size == longest else stash(pairs, f"pairs-{size}", "zstd")
        entries = blocks.where("codes is null")
        counted = entries.groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        # what a phrase begins and ends with, from its parents: how often their beginnings and endings occur, shortest first
        begin = names.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), F.concat("heads", F.array("n")).alias("heads"))
        finish = names.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("finish"), F.concat("tails", F.array("n")).alias("tails"))
        joined = counted.join(begin, "left").join(finish, "right")
        names = counted_up(joined.select("lang", "left", "right", "n", F.concat_ws(" ", "begin", "finish").alias("phrase"), "heads", "tails"), f"names-{size}")
        keys = ["left", "right"]
        levels.append((size, names))
    out = None
    for i, (size, found) in enumerate(levels):
        cuts = [F.struct(exact_score(F.col("n"), F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(size - k - 1))).alias("score"), F.lit(k).alias("k"), F.get("heads", F.lit(k - 1)).alias("l"), F.get("tails", F.lit(size - k - 1)).alias("r")) for k in range(1, size)]
        found = found.withColumn("cut", F.array_min(F.array(*cuts)))
        if i + 1 < len(levels):
            # a longer phrase that holds this one holds it in one that is a word longer and occurs as often or more
            longer = levels[i + 1][1].select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            found = found.join(longer, "id", "left")
        else:
            found = found.withColumn("longer", F.lit(None).cast("long"))
        dropped = F.coalesce(100 * F.col("longer") >= share * F.col("n"), F.lit(False))
        rows = found.select("lang", F.lit(size).alias("size"), "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), dropped.alias("dropped"))
        out = rows if out is None else out.unionByName(rows)
    return out, totals


def ranked(candidates: DataFrame, totals: DataFrame, first: int = 2000) -> DataFrame:
    """The first phrases of each language that weren't dropped, with rank; the best of 64 parts of a language are ranked before all of it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = candidates.where("not dropped").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= first)
    best = part.drop("place", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language of ``documents``."""
    return ranked(*phrases(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS p, lang, w FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents)),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, n, string_split(g, ' ') AS w FROM g WHERE k > 1 AND n >= 10),
cut AS (
  SELECT lang, k, g, n, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cut.*, gl.n AS l, gr.n AS r, (1000000::HUGEINT * cut.n * cut.n) // (gl.n::HUGEINT * gr.n) AS score
  FROM cut JOIN g gl ON gl.lang = cut.lang AND gl.k = cut.j AND gl.g = cut.x JOIN g gr ON gr.lang = cut.lang AND gr.k = cut.k - cut.j AND gr.g = cut.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, g ORDER BY score, j) = 1),
o AS (
  SELECT DISTINCT lang, sub FROM (SELECT lang, n, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub FROM c WHERE k = 3) u
  WHERE EXISTS (SELECT 1 FROM c x WHERE x.k = 2 AND x.lang = u.lang AND x.g = u.sub AND 100 * u.n >= 50 * x.n)),
f AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, n DESC, g) AS rank, g AS phrase, n AS a, l, r, score
  FROM b WHERE NOT (k = 2 AND EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.sub = b.g)))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n, score::BIGINT AS score FROM f JOIN t USING (lang) WHERE rank <= 2000
"""
