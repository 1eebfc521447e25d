"""Files of token ids: exact round trip, order, awkward rows, lost tasks."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from setloom.llm import token_ids as T

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    """By whole texts, one after the other."""
    out, start = [], 0
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r)[:4] for r in T.op11_token_ids(spark, SF).collect()]
    assert sorted(got) == expected(library, sorted(map(tuple, rows)))


STRANGE = [
    None, "", "  \t\n", "x", "It's WE'LL don't O'Neill !'s ''s", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b <|", "ÀÉî × ÷ İstanbul œuvre ﬁ", "é É  　x y \x85 \x1c\x1f", "12345 a1b2 --- ...!!",
    "漢字かな한국어 русский Ω", "a" * 5000, "\U0001f600\U0001f600 ok", "word " * 3000, "\x00\x07 \x7f", "ŉ ß ẞ ſ Straße", "a\x0bb\x0cc\rd", "café,café;CAFÉ", "“quotes”—dash", "x̀́ q̇", "Ǆ ǅ ς Σ ΑΣ",
]


def test_pieces_equal_whole_texts(library):
    tool = T.PieceEncoder(PATH)
    column = pa.array(STRANGE)
    for _ in range(2):
        got = [ids[a:b].tolist() for ids, cuts in tool.encode(column) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in STRANGE]


def test_codes_are_undone():
    rng = np.random.default_rng(3)
    for sizes in ([], [0], [1], [4, 0, 5, 3], rng.integers(0, 50, 300).tolist()):
        sizes = np.array(sizes, np.int64)
        ranks = (rng.integers(0, 2**32, int(sizes.sum()), dtype=np.uint64) >> rng.integers(0, 32, int(sizes.sum())).astype(np.uint64)).astype(np.uint32)
        control, data = T.pack(ranks, np.concatenate([[0], np.cumsum(sizes)]))
        assert len(control) == sum(-(-n // 4) for n in sizes) and len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
        assert T.unpack(control, data, sizes).tolist() == ranks.tolist()


def test_awkward_rows_and_small_files(spark, library, tmp_path):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(STRANGE, 1)] + [(7, "again"), (7, "again"), (7, "other")]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, start int, ids binary").repartition(3)
    T.save(df, f"file://{tmp_path}/a", PATH, file_ids=40)
    got = T.load(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    ids = {r["start"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got}
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [r["doc_id"] for r in got] == [i for i, _ in sorted(rows, key=key)]
    assert sorted((r["doc_id"] or 0, ids[r["start"]]) for r in got) == sorted((i or 0, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    total = 0
    for r in got:
        assert r["start"] == total
        total += len(ids[r["start"]])
    assert len(list((tmp_path / "a").glob("*.rid"))) > 5
    # what a lost task left is not listed and not read
    (tmp_path / "a" / "part-lost.rid").write_bytes(b"rubbish")
    assert T.load(spark, f"file://{tmp_path}/a").count() == len(rows)


def test_text_ids_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "none")], "name string, body string")
    T.save(df, f"{tmp_path}/b", PATH, id_col="name", text_col="body")
    assert [tuple(r)[:2] for r in T.load(spark, f"{tmp_path}/b").orderBy("start").collect()] == [(None, 0), ("a", 2), ("b", 4)]
    T.save(df.where("false"), f"{tmp_path}/c", PATH, id_col="name", text_col="body")
    assert T.load(spark, f"{tmp_path}/c").count() == 0
