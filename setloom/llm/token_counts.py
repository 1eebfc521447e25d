"""Exact token counts of every prefix, by dynamic programming over prefixes.

A byte-level BPE splits a text into pre-tokens and merges inside each alone, so the count of a prefix that ends with a
pre-token is the count of the prefix before it plus that pre-token's own; distinct pre-tokens are counted once (kept in
a bounded memory of each worker). Inside a pre-token the encoding of a prefix ends with exactly one token that the merges
would also leave behind the last token of what comes before it: one pass of an automaton over the vocabulary finds the
tokens that end at each byte, the merges that made two neighbours tell whether they could have been merged across
(:class:`LastTokens`), and the count is that of the shorter prefix plus one. So the counts of all prefixes of a piece of
any length take one pass and a number for each byte. The sums and these tables answer what any prefix counts and how much
of a text fits a budget without encoding the text again.

Texts with characters on which pattern engines may differ are split by the library itself; a special string is a
pre-token of its own, as the library has it by default, and only the few prefixes that end inside one are encoded.

Defined cases: a null text counts as empty, with no tokens; repeated rows count alike; ids of any type stay as they are;
extra columns are not read; an empty table gives an empty result; a text or a pre-token of any length is one pass.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY = 400_000
#: Fixed value: characters that every pattern engine classes alike.
PLAIN = regex.compile("[\t\n\r -~ -ɏ‐-‧‰-⁞€]*")
#: Contractions that are a pre-token as a whole only, and what begins one.
CONTRACTIONS = ("'re", "'ve", "'ll")
SHORT = 64


class LastTokens:
    """The last token of every prefix of a piece, for a byte-level BPE whose ids are in the order of its merges."""

    def __init__(self, library):
        model = json.loads(library.to_str())["model"]
        # the vocabulary writes bytes as characters: the printable ones as themselves, the others from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ids = {t: i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pair = {(ids[x], ids[y]): k for k, (x, y) in enumerate(pairs)}
        self.parts = {ids[x + y]: (ids[x], ids[y], k) for k, (x, y) in reversed(list(enumerate(pairs)))}
        self.length: dict[int, int] = {}
        self.ends = ahocorasick.Automaton()
        for t, i in ids.items():
            if len(t) == 1 or i in self.parts:
                self.length[i] = len(t)
                self.ends.add_word("".join(chr(byte_of[c]) for c in t), i)
        self.ends.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens next to each other as they are."""
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > MEMORY:
                self.apart.clear()
            known = self.apart[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        # go back in time: undo the later of the two tokens' last merges, again and again; at each time before, a merge
        # across that comes earlier than the one undone (or as early, but further left) would have been made
        limit = len(self.pair)
        while True:
            if self.pair.get((left, right), limit) < limit:
                return False
            x, y = self.parts.get(left), self.parts.get(right)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[2] > y[2]):
                left, limit = x[1], x[2]
            else:
                right, limit = y[0], y[2] + 1

    def counts(self, piece: str) -> np.ndarray:
        """Tokens of the first 0, 1, ... characters of a pre-token."""
        data = piece.encode()
        last, count, length, apart = [0] * (len(data) + 1), np.zeros(len(data) + 1, np.int64), self.length, self.stay_apart
        done = 0
        for end, token in self.ends.iter(data.decode("latin-1")):
            if end < done:
                continue  # this byte has its token
            begin = end + 1 - length[token]
            if begin == 0 or apart(last[begin], token):
                last[end + 1] = token
                count[end + 1] = count[begin] + 1
                done = end + 1
        if len(data) == len(piece):
            return count
        chars = np.frombuffer(data, np.uint8)
        return count[np.append(np.flatnonzero(chars & 0xC0 != 0x80), len(data))]


class Counter:
    """Token counts of one tokenizer file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.within: dict[str, np.ndarray] = {}

    @cached_property
    def last(self) -> LastTokens:
        return LastTokens(self.library)

    def prefixes(self, piece: str) -> np.ndarray:
        """Token counts of the first 0, 1, ... characters of a piece: white space, if any, and a pre-token."""
        if piece in self.within:
            return self.within[piece]
        table = self._prefixes(piece)
        if len(piece) <= SHORT:
            if len(self.within) > MEMORY // 8:
                self.within.clear()
            self.within[piece] = table
        return table

    def _prefixes(self, piece: str) -> np.ndarray:
        blank = len(piece) - len(piece.lstrip())
        out = np.zeros(len(piece) + 1, np.int64)
        out[: blank + 1] = self.last.counts(piece[:blank])  # at the end of a text white space is one pre-token
        at = before = 0
        for part in self.split(piece) if blank < len(piece) else []:
            own = self.last.counts(part)
            if part in CONTRACTIONS:
                own[2] = 2
            new = max(blank + 1, at)  # what ends after the white space
            if at + len(part) >= new:
                out[new : at + len(part) + 1] = before + own[new - at :]
            at, before = at + len(part), before + int(own[-1])
        return out

    def learn(self, lists: list[list[str]]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list({p for pieces in lists for p in pieces if p not in self.known})
        self.known.update(zip(new, (len(x.ids) for x in self.library.encode_batch(new, add_special_tokens=False)), strict=True))

    def split(self, text: str) -> list[str]:
        """Pre-tokens and special strings, which follow each other without a gap."""
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.pieces(text)
        parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text) if self.special else [text]
        return [p for part in parts if part for p in ([part] if part in self.special else [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)])]

    def tables(self, texts: list[str]) -> list[PrefixCounts]:
        lists = [self.split(t) for t in texts]
        self.learn(lists)
        return [PrefixCounts(self, t, pieces) for t, pieces in zip(texts, lists, strict=True)]


class PrefixCounts:
    """Token counts of the prefixes of one text: a sum at the end of every pre-token.

    White space before a word is split differently from the same white space at the end of a text, so the sum after a
    pre-token of white space is not the count of the prefix that ends there; it counts on towards the next ones only.
    """

    def __init__(self, counter: Counter, text: str, pieces: list[str]):
        self.counter, self.text, self.pieces = counter, text, pieces
        self.sums = np.cumsum(np.fromiter(map(counter.known.__getitem__, pieces), np.int64, len(pieces)))

    @cached_property
    def _ends(self) -> np.ndarray:
        return np.cumsum(np.fromiter(map(len, self.pieces), np.int64, len(self.pieces)))

    @property
    def total(self) -> int:
        return int(self.sums[-1]) if len(self.sums) else 0

    def _piece(self, j: int) -> tuple[int, int, str]:
        """Where the piece that holds the j-th pre-token begins, the tokens before it, and its text: it begins at the last safe boundary and ends with the pre-token, or with the next one that isn't white space."""
        first = j
        while first and self.pieces[first - 1].isspace():
            first -= 1
        while j + 1 < len(self.pieces) and self.pieces[j].isspace() and self.pieces[j + 1] not in self.counter.special:
            j += 1
        start, before = (int(self._ends[first - 1]), int(self.sums[first - 1])) if first else (0, 0)
        return start, before, self.text[start : int(self._ends[j])]

    def at(self, n: int) -> int:
        """Tokens of the first ``n`` characters."""
        if n <= 0:
            return 0
        if n >= len(self.text):
            return self.total
        j = int(np.searchsorted(self._ends, n, side="left"))
        if self.pieces[j] in self.counter.special:
            return self._inside(j, n) if n < self._ends[j] else int(self.sums[j])
        start, before, piece = self._piece(j)
        return before + int(self.counter.prefixes(piece)[n - start])

    def _inside(self, j: int, n: int) -> int:
        """Tokens of the first ``n`` characters, which end inside of the special string ``j``: its beginning is plain text that goes on from the pre-token before."""
        first = j
        while first and self.pieces[first - 1].isspace():
            first -= 1
        first -= bool(first) and self.pieces[first - 1] not in self.counter.special
        start, before = (int(self._ends[first - 1]), int(self.sums[first - 1])) if first else (0, 0)
        return before + len(self.counter.library.encode(self.text[start:n], add_special_tokens=False).ids)

    def every(self) -> np.ndarray:
        """Tokens of the first 0, 1, ... characters."""
        out = np.zeros(len(self.text) + 1, np.int64)
        j = 0
        while j < len(self.pieces):
            if self.pieces[j] in self.counter.special:
                begin = int(self._ends[j]) - len(self.pieces[j])
                for n in range(begin + 1, int(self._ends[j])):
                    out[n] = self._inside(j, n)
                out[self._ends[j]] = self.sums[j]
                j += 1
                continue
            start, before, piece = self._piece(j)
            out[start : start + len(piece) + 1] = before + self.counter.prefixes(piece)
            j = int(np.searchsorted(self._ends, start + len(piece), side="left")) + 1
        out[-1] = self.total
        return out

    def fits(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        j = int(np.searchsorted(self.sums, budget, side="right"))
        if self.pieces[j] in self.counter.special:
            begin = int(self._ends[j]) - len(self.pieces[j])
            return max((n for n in range(begin + 1, int(self._ends[j])) if self._inside(j, n) <= budget), default=begin)
        start, before, piece = self._piece(j)
        inside = before + self.counter.prefixes(piece)
        return start + int(np.flatnonzero(inside <= budget)[-1])


def counter(path: str, pattern: str) -> Counter:
    """This worker's counter. Functions of this package travel by value, so what outlives a task is kept with the interpreter."""
    kept = sys.__dict__.setdefault("_setloom_counters", {})
    if path not in kept:
        kept[path] = Counter(path, pattern)
    return kept[path]


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str, budgets: tuple[int, ...], prefixes: bool) -> Iterator[pa.RecordBatch]:
    tool = counter(path, pattern)
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            texts = [t or "" for t in part["text"].to_pylist()]
            tables = tool.tables(texts)
            out = [part["doc_id"], part["n_bytes"], pa.array([t.total for t in tables], pa.int64()), *(pa.array([t.fits(b) for t in tables], pa.int64()) for b in budgets)]
            names = ["doc_id", "n_bytes", "n_tokens", *(f"fits_{b}" for b in budgets)]
            if prefixes:
                out.append(pa.array([t.every() for t in tables], pa.list_(pa.int64())))
                names.append("counts")
            yield pa.RecordBatch.from_arrays(out, names=names)


def token_counts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = (128, 1024), prefixes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and for each budget the characters that fit it (see :meth:`PrefixCounts.fits`); with ``prefixes`` also the table itself, counts."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long" + "".join(f", fits_{b} long" for b in budgets) + ", counts array<long>" * prefixes
    return docs.mapInArrow(lambda it: _count(it, path, pattern, budgets, prefixes), schema)


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Counts of all of ``documents``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path(tokenizer), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fits_128", "fits_1024")
