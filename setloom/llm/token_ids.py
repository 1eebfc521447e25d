"""Token ids in binary files: ranks by frequency, byte-aligned lengths, control bytes apart from data bytes.

In each file ids are replaced by their rank in it, the most frequent first, so that most of them fit one byte; the file
begins with its ids by rank, so one pass over the texts is enough. A rank takes one to four bytes, little end first; the
lengths less one stand two bits each, four to a control byte. Then follow blocks, each with its documents' ids and
lengths (an Arrow stream), all control bytes and all data bytes; a document's codes begin with a control byte of their
own. A reader looks a whole block's control bytes up in a table of four lengths for each value of a byte, sums the
lengths to places, gathers the bytes of all ranks at once and looks the ids up by rank.

Files are written and read by a data source of Spark (:class:`RankedIds`, format ``ranked_ids``): each task writes files
of its own under new names, the commit lists those of the tasks that succeeded in the manifest, in the order of the
partitions, with the ids before each; a reader follows the manifest, so that what lost or repeated tasks left is never
read. Documents are sorted by id across partitions (texts are dealt by ranges of id and hash, so rows that share an id
don't make a task of their own). Nothing but the list of files passes through the driver; a writer holds the ids of one
file, a reader one block.

Texts are cut into pieces that the library's own rules would part, and each distinct piece of a slice is encoded by the
library once (see :func:`pieces`): this equals encoding whole texts for tokenizers that drop white space, ignore the case
of A to Z and part runs of letters, single digits and runs of signs, as this one does.

Defined cases: a null text counts as empty, which is the end id alone; documents without an id come first; rows that
share an id follow each other by the hash of their texts and repeated rows are written as often as they stand; ids may be
of any type with an order; extra columns are not read; an empty table writes a manifest without files; a text of any
length is one document of one block.
"""

from __future__ import annotations

import io
import os
import struct
import sys
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from setloom.llm._store import shared_dir
from setloom.llm._words import texts

END = 2
BLOCK_IDS, FILE_IDS = 1 << 20, 1 << 23
MEMORY, LONG_PIECE, SLICE_BYTES, LEARNT = 1 << 20, 128, 1 << 22, 1 << 14
HEAD = "<III"
MAGIC = b"RID1"
#: The four lengths that each value of a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: What a byte is: 0 white space, then letter (or part of one), digit, sign.
LETTER, DIGIT, SIGN = 1, 2, 3
KIND = np.full(256, SIGN, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
KIND[range(0x30, 0x3A)] = DIGIT
#: Signs that begin contractions or special strings, and control characters: a run that has one stays whole.
WHOLE = np.zeros(256, bool)
WHOLE[[*b"'<", *range(0x20), 0x7F]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
MANIFEST = pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("start", pa.int64())])


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Slice by slice of some texts: where each text begins and ends among the pieces, and the pieces, whose tokens don't depend on each other.

    A piece is a run of bytes without white space. Where such a run has only the letters ``A-Z``, ``a-z`` and those of Latin-1, digits and
    ASCII signs other than those in ``WHOLE``, it is cut further into runs of letters, single digits and runs of signs, as the library does.
    """
    offsets, data = texts(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        yield _pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    kind = KIND[data]
    inside = kind > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside & edge[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    strange = WHOLE[data] | ((data >= 0x80) & ~lead & (~after | (data == 0x97) | (data == 0xB7)))
    # from here on without white space
    data, kind, begins, strange = data[inside], kind[inside], begins[inside], strange[inside]
    runs = np.flatnonzero(begins)
    odd = np.logical_or.reduceat(strange, runs) if len(runs) else np.zeros(0, bool)
    cut = kind == DIGIT
    cut[1:] |= kind[1:] != kind[:-1]
    odd = np.repeat(odd, np.diff(np.append(runs, len(data))))
    cut &= ~odd
    cut |= begins
    starts = np.flatnonzero(cut)
    rows = np.searchsorted(starts, np.concatenate([[0], np.cumsum(inside)])[offsets])
    data = np.where(odd, data, LOWER[data])  # a special string in upper case is none
    return rows, pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data))


class PieceEncoder:
    """Ids of pieces by the library, remembered for pieces of usual length."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: pa.Array) -> None:
        counts, flat = [self.count[:0]], [self.flat]
        for i in range(0, len(new), LEARNT):  # the library's results are large
            got = [x.ids for x in self.library.encode_batch_fast(new.slice(i, LEARNT).to_pylist(), add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), np.uint32, int(counts[-1].sum())))
        count = np.concatenate(counts)
        first = len(self.flat) + np.cumsum(count) - count
        self.known, self.flat = pa.concat_arrays([self.known, new]), np.concatenate(flat)
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slice by slice: the ids of some texts, one after the other, and where each begins and ends."""
        for rows, found in pieces(column):
            coded = found.dictionary_encode()
            if len(self.known) > MEMORY or len(self.flat) > 8 * MEMORY:
                self.forget()
            at = pc.index_in(coded.dictionary, value_set=self.known)
            new = coded.dictionary.filter(at.is_null())
            at = np.array(at.fill_null(-1), np.int64)
            at[at < 0] = len(self.known) + np.arange(len(new))
            self.learn(new)
            known = at[coded.indices.to_numpy()]
            count = self.count[known]
            ends = np.concatenate([[0], np.cumsum(count)])
            yield self.flat[np.repeat(self.first[known] - ends[:-1], count) + np.arange(ends[-1])], ends[rows]
            if (pc.max(pc.binary_length(new)).as_py() or 0) > LONG_PIECE:
                self.forget()


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder. Functions of this package travel by value, so what outlives a task is kept with the interpreter."""
    kept = sys.__dict__.setdefault("_setloom_encoders", {})
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Each document's ids with the end, as little-endian unsigned 32-bit integers."""
    tool = encoder(path)
    for batch in batches:
        row = 0
        for ids, cuts in tool.encode(batch["text"]):
            n = len(cuts) - 1
            whole = np.insert(ids, cuts[1:], np.uint32(end)).astype("<u4")
            offsets = 4 * (cuts + np.arange(n + 1))
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, n), lists.cast(pa.binary())], names=["doc_id", "ids"])
            row += n


def pack(ranks: np.ndarray, cuts: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of documents whose ranks lie between ``cuts``."""
    sizes = np.diff(cuts)
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    quads = -(-sizes // 4)
    slots = np.zeros(4 * int(quads.sum()), np.uint8)
    slots[_slots(sizes, quads)] = size - 1
    control = slots.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        data[start[has] + k] = ranks[has] >> np.uint32(8 * k) & np.uint32(255)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def _slots(sizes: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """Where each rank's length stands among all lengths: documents begin at multiples of four."""
    before = 4 * (np.cumsum(quads) - quads) - (np.cumsum(sizes) - sizes)
    return np.arange(int(sizes.sum())) + np.repeat(before, sizes)


def unpack(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The ranks of documents of the given sizes, one after the other."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[_slots(sizes, -(-sizes // 4))].astype(np.int64)
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = raw[start].astype(np.uint32)
    for k in range(1, int(size.max()) if len(size) else 0):
        has = np.flatnonzero(size > k)
        ranks[has] |= raw[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _flat(column: pa.Array) -> np.ndarray:
    """The ids of all rows of a binary column."""
    offsets, data = texts(column)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u4")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a plain path is local."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _whole(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


class _Files(WriterCommitMessage):
    """What one task wrote: files in order, as (name, documents, ids)."""

    def __init__(self, part: int, files: list[tuple[str, int, int]]):
        self.part, self.files = part, files


class RankedIds(DataSource):
    """Format ``ranked_ids`` of columns (doc_id, start, ids); :func:`save` makes the folder. Written are rows (doc_id, ids), or with the option ``tokenizer`` rows (doc_id, text)."""

    @classmethod
    def name(cls) -> str:
        return "ranked_ids"

    def schema(self) -> str:
        store, path = _place(self.options["path"])
        return _whole(store, f"{path}/schema.ddl").decode()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("file_ids", FILE_IDS)), self.options.get("tokenizer"), int(self.options.get("end", END)))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_ids: int, tokenizer: str | None, end: int):
        self.path, self.file_ids, self.tokenizer, self.end = path, file_ids, tokenizer, end

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, held, size = [], [], 0
        for batch in _encoded(iterator, self.tokenizer, self.end) if self.tokenizer else iterator:
            lengths = np.cumsum(pc.binary_length(batch["ids"]).to_numpy(zero_copy_only=False).astype(np.int64)) // 4
            begin = 0
            while begin < len(batch):
                end = min(len(batch), int(np.searchsorted(lengths, self.file_ids - size + (lengths[begin - 1] if begin else 0))) + 1)
                held.append(batch.slice(begin, end - begin))
                size += int(lengths[end - 1] - (lengths[begin - 1] if begin else 0))
                if size >= self.file_ids:
                    files.append(self.file(held))
                    held, size = [], 0
                begin = end
        if held:
            files.append(self.file(held))
        return _Files(TaskContext.get().partitionId(), files)

    def file(self, held: list[pa.RecordBatch]) -> tuple[str, int, int]:
        """Write one file of these documents."""
        name = f"part-{uuid.uuid4().hex}.rid"
        names = pa.concat_arrays([b["doc_id"] for b in held])
        sizes = np.concatenate([pc.binary_length(b["ids"]).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) // 4
        ids = np.concatenate([_flat(b["ids"]) for b in held])
        held.clear()
        counts = np.bincount(ids, minlength=1)  # as long as the vocabulary
        by_rank = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        rank = np.zeros(len(counts), np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        ends = np.cumsum(sizes)
        store, path = _place(self.path)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(MAGIC + struct.pack("<I", len(by_rank)) + by_rank.astype("<u4").tobytes())
            begin = 0
            while begin < len(sizes):
                before = int(ends[begin] - sizes[begin])
                end = min(len(sizes), int(np.searchsorted(ends, before + BLOCK_IDS)) + 1)
                cuts = np.concatenate([[0], ends[begin:end] - before])
                control, data = pack(rank[ids[before : ends[end - 1]]], cuts)
                index = io.BytesIO()
                table = pa.record_batch([names.slice(begin, end - begin), pa.array(sizes[begin:end])], names=["doc_id", "n_tokens"])
                with pa.ipc.new_stream(index, table.schema) as f:
                    f.write_batch(table)
                out.write(struct.pack(HEAD, len(index.getvalue()), len(control), len(data)) + index.getvalue() + control + data)
                begin = end
        return name, len(sizes), len(ids)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _place(self.path)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        ids = np.array([f[2] for f in files], np.int64)
        table = pa.table([[f[0] for f in files], [f[1] for f in files], ids, np.cumsum(ids) - ids], schema=MANIFEST)
        with store.open_output_stream(f"{path}/manifest.tmp") as f:
            pq.write_table(table, f)
        store.move(f"{path}/manifest.tmp", f"{path}/manifest.parquet")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _place(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{path}/{f[0]}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, path = _place(self.path)
        table = pq.read_table(pa.BufferReader(_whole(store, f"{path}/manifest.parquet")))
        return [InputPartition(x) for x in zip(table["file"].to_pylist(), table["start"].to_pylist(), strict=True)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, start = partition.value
        store, path = _place(self.path)
        with store.open_input_stream(f"{path}/{name}") as f:
            magic, n = struct.unpack("<4sI", f.read(8))
            if magic != MAGIC:
                raise ValueError(f"{name} is no file of ranked ids")
            by_rank = np.frombuffer(f.read(4 * n), "<u4")
            while head := f.read(struct.calcsize(HEAD)):
                index, control, data = struct.unpack(HEAD, head)
                table = pa.ipc.open_stream(f.read(index)).read_all()
                sizes = table["n_tokens"].to_numpy()
                ids = by_rank[unpack(f.read(control), f.read(data), sizes)].astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                lists = [ids[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(start + ends - sizes), pa.array(lists, pa.binary())], names=["doc_id", "start", "ids"])
                start += int(ends[-1])


def save(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, file_ids: int = FILE_IDS) -> None:
    """Write the token ids of ``df`` in a new folder ``path``, in the order of the ids."""
    spark = df.sparkSession
    spark.dataSource.register(RankedIds)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    store, place = _place(path)
    store.create_dir(place)
    with store.open_output_stream(f"{place}/schema.ddl") as f:
        f.write(f"doc_id {id_type}, start long, ids binary".encode())
    same = F.xxhash64("text")
    ranged = docs.withColumn("same", same).repartitionByRange("doc_id", "same").sortWithinPartitions("doc_id", "same", "text").select("doc_id", "text")
    ranged.write.format("ranked_ids").options(file_ids=file_ids, tokenizer=tokenizer, end=end).mode("append").save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, ids) of a folder: start counts the ids of all documents before, ids are little-endian unsigned 32-bit integers."""
    spark.dataSource.register(RankedIds)
    return spark.read.format("ranked_ids").load(path)


def op11_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """All of ``documents`` through files and back."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/setloom/token-ids-{uuid.uuid4().hex}"
    save(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path(tokenizer))
    n = F.octet_length("ids") / 4
    return load(spark, path).select("doc_id", "start", n.cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
