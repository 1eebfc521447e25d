"""A hidden Markov language model: Baum-Welch on all training documents, exact likelihoods by scaled forward recursion.

The hidden chain emits symbols: the ``symbols`` most frequent training words, the end of a text, and two classes for all
other words, the next ``lookup - symbols`` and the rest. Baum-Welch trains start, steps and emissions on whole texts: the
forward messages are carried over a text's whole length and kept every ``STRETCH`` tokens, the backward messages carried
back, with the stretches between made again. Each partition emits its expected counts; their sums make the next model.
After the last iteration one more expectation step gathers the states of every other training word, however rare, so
each word of the training documents has an emission of its own and what is gathered grows with the corpus; words that
were never seen share the mass that the smoothed unigram leaves them. The model is a distribution over all texts, and a
text's score is the exact log10 of its probability, end included.

The ``lookup`` most frequent words (a bounded table) go to the executors; counts and emissions of all other words stay
distributed and are joined to the documents' own rare words. Emissions start from the co-occurrence in documents of the
``SEEDS`` most frequent words, summed over all training documents: words that are least alike found the states, and
each other word begins with the state of the one that it goes along with most.

Defined cases: a null or empty text is its end alone; repeated rows are documents of their own; without training
documents all counts are zero; a null doc_id is taken as the empty text when dealing out folds; extra columns are not
read; a text of any length is scored and trained on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom import shared
from setloom.llm._store import stash
from setloom.llm._words import slices

STRETCH, LANES, ROWS = 128, 1024, 4096
SEEDS, BOOST = 256, 8.0
SCALE = float(1 << 24)
#: Units of the expected counts of single words, and of a word's states among its own occurrences: few bytes, since these are what is shuffled.
WORD_SCALE, PARTS = float(1 << 14), (1 << 15) - 1
_BITS = 20


def held_out(doc_id: Column) -> Column:
    """True for the fold that the model does not learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


class Lookup:
    """Positions of known 64-bit hashes, found through the hash's leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(2**64 - 1))
        self.begin = np.searchsorted(self.hashes[:-1], np.arange((1 << _BITS) + 1, dtype=np.uint64) << np.uint64(64 - _BITS)) if len(hashes) else np.zeros((1 << _BITS) + 1, np.int64)
        self.begin[-1] = len(hashes)
        self.deepest = int(np.diff(self.begin).max()) if len(hashes) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where it is unknown."""
        lead = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        at, end = self.begin[lead], self.begin[lead + 1]
        out = np.full(len(hashes), -1, np.int64)
        todo = np.flatnonzero(at < end)
        for _ in range(self.deepest):
            hit = self.hashes[at[todo]] == hashes[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        found = out >= 0
        out[found] = self.order[out[found]]
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    size = 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        words, back = np.unique(np.concatenate(held), return_inverse=True)
        return words, np.bincount(back, weights=np.concatenate(sums)).astype(np.int64)

    def emit(words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["word", "n"])

    for batch in batches:
        for s in slices(batch["text"], lower=True):
            words, n = np.unique(s.hashes, return_counts=True)
            held.append(words)
            sums.append(n)
            size += len(words)
            if size > 1 << 21:
                words, n = fold()
                if len(words) > 1 << 20:
                    yield from emit(words, n)
                    words, n = words[:0], n[:0]
                held, sums, size = [words], [n], len(words)
    if held:
        yield from emit(*fold())


def _numbered(owner: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of each row, where each row's begin, and the number within its row of each hash."""
    order = np.lexsort((hashes, owner))
    by, h = owner[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (by[1:] != by[:-1]) | (h[1:] != h[:-1])
    begin = np.searchsorted(by[new], np.arange(rows + 1))
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1 - begin[by]
    return begin, h[new], which


def _encode(batches: Iterator[pa.RecordBatch], lookup, symbols: int) -> Iterator[pa.RecordBatch]:
    """Symbols of each document (without the end), places in the lookup of the words of the middle class, the different hashes of those beyond it and which of them each is, and sums over the words of the lookup."""
    hashes, n = lookup.value
    table = Lookup(hashes)
    logs = np.append(np.log10(n + 0.5), 0.0)
    for batch in batches:
        for s in slices(batch["text"], lower=True):
            at = table.find(s.hashes)
            known = at >= 0
            middle, rare = known & (at >= symbols), ~known
            codes = np.where(rare, symbols + 1, np.minimum(at, symbols)).astype(np.uint16)
            cut = lambda x: np.concatenate([[0], np.cumsum(x)])[s.first]  # noqa: B023, E731
            ends = s.first.tolist()
            value = logs[at]
            base = [float(value[a:b].sum()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            rows = batch.slice(s.row, len(s.first) - 1)
            data = codes.tobytes()
            lists = pa.array([data[2 * a : 2 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            mid = pa.ListArray.from_arrays(pa.array(cut(middle).astype(np.int32)), pa.array(at[middle].astype(np.int32)))
            begin, different, which = _numbered(s.owner[rare], s.hashes[rare], len(s.first) - 1)
            tail = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(different.view(np.int64)))
            tail_at = pa.ListArray.from_arrays(pa.array(cut(rare).astype(np.int32)), pa.array(which.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["held_out"], pa.array(np.diff(s.first)), pa.array(np.diff(cut(known)).astype(np.int64)), pa.array(base, pa.float64()), lists, mid, tail, tail_at], names=["doc_id", "held_out", "n_words", "known", "base", "codes", "mid", "tail", "tail_at"])


class Model:
    """Start, step and emission probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @property
    def padded(self) -> np.ndarray:
        """Emissions by symbol; the last row, of ones, stands for what follows the end."""
        return np.vstack([self.emit.T, np.ones(len(self.start))])


def _seen(codes: list[np.ndarray], begin: int, length: int, end: int, pad: int) -> np.ndarray:
    """``length`` symbols from ``begin`` on, a column for each sequence, with the end and then padding after it."""
    out = np.full((length, len(codes)), pad, np.int64)
    for j, c in enumerate(codes):
        part = c[begin : begin + length]
        out[: len(part), j] = part
        if len(part) < length and begin + len(part) == len(c):
            out[len(part), j] = end
    return out


def _forward(model: Model, table: np.ndarray, seen: np.ndarray, x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward messages and scales of a stretch; ``x`` is the message before it, None at the start."""
    alpha = np.empty((len(seen), seen.shape[1], len(model.start)), table.dtype)
    scale = np.empty((len(seen), seen.shape[1], 1), table.dtype)
    step = model.step.astype(table.dtype)
    for t, symbols in enumerate(seen):
        x = (model.start.astype(table.dtype) if x is None else x @ step) * table[symbols]
        x.sum(axis=1, keepdims=True, out=scale[t])
        x = np.divide(x, scale[t], out=alpha[t])
    return alpha, scale


def expectations(model: Model, codes: list[np.ndarray], end: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, steps and emissions of whole sequences and their ends, and the log10 likelihood of all. Rows of ``table`` beyond the model's are symbols too; its last row is the padding."""
    table = (model.padded if table is None else table).astype(np.float32)
    pad, states = len(table) - 1, len(model.start)
    step = model.step.astype(np.float32)
    first, steps, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, pad + 1))
    like = 0.0
    order = sorted(range(len(codes)), key=lambda r: -len(codes[r]))
    for i in range(0, len(order), LANES):
        some = [codes[r] for r in order[i : i + LANES]]
        lengths = np.array([len(c) + 1 for c in some])
        begins = range(0, int(lengths[0]), STRETCH)
        live = [int(np.searchsorted(-lengths, -b, side="left")) for b in begins]  # sequences longer than b
        shape = lambda k: (some[: live[k]], begins[k], min(STRETCH, int(lengths[0]) - begins[k]), end, pad)  # noqa: B023, E731
        marks: list[np.ndarray | None] = [None]
        for k in range(len(begins) - 1):
            before = marks[-1]
            alpha, _ = _forward(model, table, _seen(*shape(k)), None if before is None else before[: live[k]])
            marks.append(alpha[-1][: live[k + 1]].copy())
        back = np.ones((0, states), np.float32)
        for k in range(len(begins) - 1, -1, -1):
            seen, before = _seen(*shape(k)), marks[k]
            alpha, scale = _forward(model, table, seen, before)
            like += float(np.log10(scale).sum(dtype=np.float64))
            beta = np.ones((live[k], states), np.float32)
            beta[: len(back)] = back
            real = seen != pad
            for t in range(len(seen) - 1, -1, -1):
                previous = alpha[t - 1] if t else before
                ahead = table[seen[t]] * beta / scale[t]
                alpha[t] *= beta  # the posterior of the state at t
                if previous is not None:
                    steps += (previous * real[t][:, None]).T @ ahead
                    beta = ahead @ step.T
            back = beta
            if k == 0:
                first += alpha[0].sum(axis=0, dtype=np.float64)
            flat = seen.ravel()
            for j in range(states):
                emitted[j] += np.bincount(flat, weights=alpha[:, :, j].ravel(), minlength=pad + 1)
    return first, steps * model.step, emitted[:, :pad], like


def log_likelihoods(model: Model, codes: list[np.ndarray], end: int, table: np.ndarray | None = None) -> np.ndarray:
    """log10 P of each sequence and its end, by the scaled forward recursion over its whole length."""
    table = model.padded if table is None else table
    order = sorted(range(len(codes)), key=lambda r: -len(codes[r]))
    out = np.zeros(len(codes))
    for i in range(0, len(order), 512):
        rows = order[i : i + 512]
        some = [codes[r] for r in rows]
        lengths = np.array([len(c) + 1 for c in some])
        x, total = None, np.zeros(len(rows))
        for begin in range(0, int(lengths[0]), STRETCH):
            live = int(np.searchsorted(-lengths, -begin, side="left"))
            alpha, scale = _forward(model, table, _seen(some[:live], begin, min(STRETCH, int(lengths[0]) - begin), end, len(table) - 1), None if x is None else x[:live])
            x = alpha[-1]
            total[:live] += np.log10(scale[:, :, 0]).sum(axis=0)
        out[rows] = total
    return out


def _symbols_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint16) for c in column.to_pylist()]


def _own_words(part: pa.RecordBatch, symbols: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sequences in which the words of the two classes have numbers of their own from ``symbols + 3`` on, the places in the lookup of those of the middle class, and where the rare words of each row begin."""
    codes = _symbols_of(part["codes"])
    every = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)
    mid, mid_at = np.unique(part["mid"].flatten().to_numpy(), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(part["n_tail"].to_numpy())])
    lists = part["tail_at"]
    owner = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
    is_mid, is_tail = every == symbols, every == symbols + 1
    every[is_mid] = symbols + 3 + mid_at
    every[is_tail] = symbols + 3 + len(mid) + begin[owner] + lists.flatten().to_numpy()
    return np.split(every, np.cumsum([len(c) for c in codes])[:-1]) if codes else [], mid, begin


def _with_words(model: Model, mid: int, tail: int, of_mid: np.ndarray | float = 1.0, of_tail: np.ndarray | float = 1.0) -> np.ndarray:
    """The emissions with rows for some words of the two classes, given what share of their class they have in each state."""
    n = model.emit.shape[1]
    rows = model.emit.T
    return np.vstack([rows, np.broadcast_to(rows[n - 3], (mid, rows.shape[1])) * of_mid, np.broadcast_to(rows[n - 2], (tail, rows.shape[1])) * of_tail, np.ones((1, rows.shape[1]))])


def _rows(kind: int, keys: np.ndarray, n: np.ndarray, unit: float = SCALE) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), *(pa.array(np.round(x * unit).astype(np.int64)) for x in n)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "key", *(f"n{k}" for k in range(len(n)))])


def _e_step(batches: Iterator[pa.RecordBatch], there, symbols: int) -> Iterator[pa.RecordBatch]:
    """Expected counts of the model: rows of kind 0 by symbol, 1 by state (steps from it), 2 (starts), and 3 (log10 likelihood, in units of 2**14)."""
    model: Model = there.value
    states = len(model.start)
    total = [np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols + 3)), 0.0]
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            total = [a + b for a, b in zip(total, expectations(model, _symbols_of(batch["codes"].slice(i, ROWS)), symbols + 2), strict=True)]
    some = np.flatnonzero(total[2].any(axis=0))
    yield _rows(0, some, total[2][:, some])
    yield _rows(1, np.arange(states), total[1].T)
    yield _rows(2, np.zeros(1), total[0][:, None])
    yield _rows(3, np.zeros(1), np.full((states, 1), total[3] / (1 << 14)))


def _word_step(batches: Iterator[pa.RecordBatch], there, symbols: int) -> Iterator[pa.RecordBatch]:
    """Expected counts of the words of the two classes, and how often they occur: rows of kind 0 by place in the lookup, 1 by hash."""
    model: Model = there.value
    states = len(model.start)
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros((states + 1, 0)))] * 2

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 1 << 16):
            batch = _rows(kind, keys[k : k + (1 << 16)], n[:states, k : k + (1 << 16)], WORD_SCALE)
            yield batch.append_column("n", pa.array(n[states, k : k + (1 << 16)].astype(np.int64)))

    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.slice(i, ROWS)
            codes, mid, begin = _own_words(part, symbols)
            first = symbols + 3
            emitted = expectations(model, codes, symbols + 2, _with_words(model, len(mid), int(begin[-1])))[2][:, first:]
            often = np.bincount(np.concatenate([c[c >= first] - first for c in codes]) if codes else np.zeros(0, np.int64), minlength=emitted.shape[1])
            found = np.vstack([emitted, often])
            tail = part["tail"].flatten().to_numpy()
            for kind, (keys, n) in enumerate(((mid, found[:, : len(mid)]), (tail, found[:, len(mid) :]))):
                keys, back = np.unique(np.concatenate([held[kind][0], keys]), return_inverse=True)
                n = np.stack([np.bincount(back, weights=x, minlength=len(keys)) for x in np.hstack([held[kind][1], n])]) if len(keys) else held[kind][1]
                if len(keys) > 1 << 18:
                    yield from rows(kind, keys, n)
                    keys, n = keys[:0], n[:, :0]
                held[kind] = keys, n
    for kind, (keys, n) in enumerate(held):
        yield from rows(kind, keys, n)


def _score(batches: Iterator[pa.RecordBatch], there, symbols: int) -> Iterator[pa.RecordBatch]:
    """Sums over the known rare words and the chain's log10 probability of each document."""
    model, of_mid, unknown, own_mass, held, rest = there.value
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.slice(i, ROWS)
            codes, mid, begin = _own_words(part, symbols)
            lists, tail = part["found"], int(begin[-1])
            found = lists.flatten()
            of_tail, logs, known = np.full((tail, len(model.start)), unknown), np.full(tail, np.log10(0.5)), np.zeros(tail, bool)
            if len(found):
                at = np.repeat(begin[:-1], np.diff(lists.offsets.to_numpy())) + found.field("at").to_numpy()
                n = found.field("n").to_numpy().astype(float)
                expected = found.field("parts").flatten().to_numpy().reshape(len(found), -1) * (n / PARTS)[:, None]
                of_tail[at] = (expected + own_mass * ((n + 0.5) / rest)[:, None]) / (own_mass + held)
                logs[at] = np.log10(n + 0.5)
                known[at] = True
            chain = log_likelihoods(model, codes, symbols + 2, _with_words(model, len(mid), tail, of_mid[mid - symbols], of_tail))
            first = symbols + 3 + len(mid)
            base, seen = np.zeros(len(part)), np.zeros(len(part), np.int64)
            for row, c in enumerate(codes):
                own = c[c >= first] - first
                base[row], seen[row] = logs[own].sum(), known[own].sum()
            yield part.drop_columns(["codes", "mid", "tail_at", "n_tail", "found"]).append_column("tail_base", pa.array(base)).append_column("tail_known", pa.array(seen)).append_column("chain", pa.array(chain))


def _together(batches: Iterator[pa.RecordBatch], seeds: int) -> Iterator[pa.RecordBatch]:
    """In how many documents two of the most frequent words stand."""
    total = np.zeros((seeds, seeds))
    for batch in batches:
        for i in range(0, len(batch), 2048):
            codes = _symbols_of(batch["codes"].slice(i, 2048))
            there = np.zeros((len(codes), seeds), np.float32)
            every = np.concatenate(codes).astype(np.int64)
            doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            there[doc[every < seeds], every[every < seeds]] = 1
            total += there.T @ there
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at].astype(np.int64))], names=["cell", "n"])


def first_model(together: np.ndarray, background: np.ndarray, states: int) -> Model:
    """States founded on the frequent words that are least alike in the documents that they stand in; they are left seldom."""
    seeds = len(together)
    rng = np.random.default_rng(7)
    emit = background * rng.uniform(0.9, 1.1, (states, len(background)))
    if seeds:
        often = np.maximum(np.diag(together), 1)
        alike = together / np.sqrt(np.outer(often, often))
        founders = [int(np.argmax(often))]
        while len(founders) < min(states, seeds):
            founders.append(int(np.argmax(np.sqrt(often) * (1 - alike[founders].max(axis=0)))))
        emit[np.argmax(alike[founders], axis=0), np.arange(seeds)] *= BOOST
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=1, keepdims=True))


def _shares(n: np.ndarray, total: np.ndarray, unigram: np.ndarray, smoothing: float) -> np.ndarray:
    """What share of a class a word has in each state (words by states), from its expected counts and its share at large."""
    own = smoothing * total + 1
    return (n + own * unigram[:, None]) / (total + own)


def hmm_scoring(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, symbols: int = 4096, iterations: int = 3, lookup: int = 1 << 18, smoothing: float = 0.5, word_smoothing: float = 1.0, trace: list[float] | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. ``trace`` gets the training documents' log10 likelihood (words of the two classes as one symbol each) before each iteration."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    train = docs.where("not held_out")
    counts = stash(train.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    words_at = shared.written[-1:]
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    tokens, types = words + ends, distinct + (ends > 0)
    frequent, least = counts, 0
    if distinct > lookup:  # by count alone: the vocabulary needs no sort
        by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(1 << 16).collect()
        held = 0
        for r in by_count:
            held += r["words"]
            if held > lookup:
                break
            least = r["n"]
        frequent = counts.where(F.col("n") >= least) if least else counts.limit(0)
    top = frequent.toArrow()
    hashes, n = top["word"].to_numpy().astype(np.int64), top["n"].to_numpy().astype(np.int64)
    shared.release(spark, words_at)  # all counts that are still needed come with the expected ones
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order].view(np.uint64), n[order]
    symbols = min(symbols, len(n), (1 << 16) - 4)
    table = spark.sparkContext.broadcast((hashes, n))

    schema = "doc_id {}, held_out boolean, n_words long, known long, base double, codes binary, mid array<int>, tail array<long>, tail_at array<int>".format(docs.schema["doc_id"].dataType.simpleString())
    coded = stash(docs.select("doc_id", "held_out", "text").mapInArrow(lambda it: _encode(it, table, symbols), schema).withColumn("row", F.monotonically_increasing_id()), "codes", "zstd").withColumn("n_tail", F.size("tail"))
    learned = coded.where("not held_out")

    total = tokens + 0.5 * (types + 1)
    middle = n[symbols:] + 0.5
    rest = max(total - float((n + 0.5).sum()) - (ends + 0.5 if ends else 0.0), 0.5)  # the rare words' mass, and the unseen ones'
    mass = np.concatenate([n[:symbols] + 0.5, [max(float(middle.sum()), 1e-9), rest, ends + 0.5]])
    background = mass / mass.sum()
    seeds = min(SEEDS, symbols)
    cells = learned.select("codes").mapInArrow(lambda it: _together(it, seeds), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    together = np.zeros(seeds * seeds)
    together[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    model = first_model(together.reshape(seeds, seeds), background, states)

    gathered = "kind int, key long, " + ", ".join(f"n{k} long" for k in range(states))
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(states)]
    matrix = lambda t: np.stack([t[f"n{k}"].to_numpy() for k in range(states)], axis=1) / WORD_SCALE if len(t) else np.zeros((0, states))
    for _ in range(iterations):
        there = spark.sparkContext.broadcast(model)
        found = learned.select("codes").mapInArrow(lambda it, m=there: _e_step(it, m, symbols), gathered).groupBy("kind", "key").agg(*sums).toArrow().to_pandas()
        of = {k: found[found["kind"] == k].sort_values("key") for k in range(4)}
        if trace is not None:
            trace.append(float(of[3]["n0"].sum()) / SCALE * (1 << 14))
        emit = np.zeros((states, symbols + 3))
        emit[:, of[0]["key"].to_numpy()] = of[0][[f"n{k}" for k in range(states)]].to_numpy().T / SCALE
        start, step = (of[j][[f"n{k}" for k in range(states)]].to_numpy() / SCALE for j in (2, 1))
        start, step = start[0] + 0.1, step + 0.1
        model = Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), _shares(emit.T, emit.sum(axis=1), background, smoothing).T)

    there = spark.sparkContext.broadcast(model)
    of_words = stash(learned.select("codes", "mid", "tail", "tail_at", "n_tail").mapInArrow(lambda it: _word_step(it, there, symbols), gathered + ", n long").groupBy("kind", "key").agg(*sums, F.sum("n").alias("n")), "emissions", "zstd")
    middles = of_words.where("kind = 0").toArrow()
    expected = np.zeros((len(middle), states))
    expected[middles["key"].to_numpy() - symbols] = matrix(middles)
    of_mid = _shares(expected, expected.sum(axis=0), middle / max(float(middle.sum()), 1e-9), word_smoothing).astype(np.float32)
    # a word's expected counts are its occurrences, dealt to the states in PARTS; the states' sums are of these, so shares add up to one
    of_state = lambda k: F.least(F.round(F.col(f"n{k}") * (PARTS / WORD_SCALE) / F.col("n")), F.lit(PARTS)).cast("smallint")
    emissions = of_words.where("kind = 1").select(F.col("key").alias("word"), "n", F.array(*[of_state(k) for k in range(states)]).alias("parts"))
    held = np.array([x / PARTS if x else 0.0 for x in emissions.agg(*[F.sum(F.col("n") * F.get("parts", F.lit(k))) for k in range(states)]).first()])
    own = word_smoothing * held + 1
    unknown = own / (own + held) * 0.5 / rest
    pairs = coded.select("row", F.posexplode("tail").alias("at", "word"))
    # dealt before they are put together: a word is dealt as it is, under its number in the row
    dealt = pairs.join(emissions, "word").select("row", "at", "n", "parts").repartition("row")
    lists = dealt.groupBy("row").agg(F.collect_list(F.struct("at", "n", "parts")).alias("found"))
    there = spark.sparkContext.broadcast((model, of_mid, unknown, own, held, rest))
    empty = F.array().cast("array<struct<at:int,n:bigint,parts:array<smallint>>>")
    kept = "row long, doc_id {}, held_out boolean, n_words long, known long, base double, tail_base double, tail_known long, chain double".format(docs.schema["doc_id"].dataType.simpleString())
    listed = coded.join(lists, "row", "left").select("row", "doc_id", "held_out", "n_words", "known", "base", "codes", "mid", "tail_at", "n_tail", F.coalesce("found", empty).alias("found"))
    scored = listed.mapInArrow(lambda it: _score(it, there, symbols), kept)
    log_total = float(np.log10(total)) if total else 0.0
    end_base = float(np.log10(ends + 0.5))
    return scored.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.col("tail_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_base") + end_base - (F.col("n_words") + 1) * log_total).alias("base_score"),
        F.col("chain").alias("score"),
    )


def op5_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return hmm_scoring(spark.read.parquet(f"{sf_dir}/documents.parquet"))
