"""Sources and sinks on small files, the model client, and streams against their batch form."""

import io
import json
import pickle
import zipfile

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from setloom.operators import remote
from setloom.sources import arrays, readers, writers
from setloom.sources.runs import Runs
from setloom.streaming import counters, sums
from setloom.streaming.sums import Sums


def test_bundle_lines(spark, tmp_path):
    (tmp_path / "b.txt").write_text("1, 5, 6, 5\n\n2, 7,\n3\n4, 8, 9\n1, 6, 7\n")
    rows = lambda **k: sorted(tuple(r) for r in readers.bundles(spark, str(tmp_path / "b.txt"), **k).collect())
    assert rows() == [(1, 0, 6), (1, 1, 7), (2, 0, 7), (4, 0, 8), (4, 1, 9)]
    assert rows(min_items=2) == [(1, 0, 6), (1, 1, 7), (4, 0, 8), (4, 1, 9)]


def test_item_attributes_and_counts(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"3": {"title": "x", "cate": " ", "pic": "//u"}}))
    row = readers.items(spark, str(tmp_path / "i.json")).first()
    assert (row["item_id"], row["title"], row["cate"], row["pic_url"], row["track_name"]) == (3, "x", None, "//u", None)
    (tmp_path / "c.json").write_text(json.dumps({"#U": 5, "#B": 6, "#I": 7}))
    assert tuple(readers.counts(spark, str(tmp_path / "c.json")).first()) == (5, 6, 7)


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp949"])
def test_result_files(spark, tmp_path, encoding):
    (tmp_path / "r.csv").write_bytes('bundle_id,input_str\n1,"한 ""줄""\n둘"\n'.encode(encoding))
    df = readers.results(spark, str(tmp_path / "r.csv"))
    assert df.columns == ["bundle_id", "input_str"] and df.first()["input_str"] == '한 "줄"\n둘'


def test_responses_and_missing_answers(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text(json.dumps({"id": "1", "response": {"candidates": [{"content": {"parts": [{"text": "B"}]}}]}}) + "\n")
    samples = spark.createDataFrame([("1",), ("2",)], "sample_id string")
    found = readers.answered(samples, readers.responses(spark, str(tmp_path / "o.jsonl"))).collect()
    assert {r["sample_id"]: r["text"] for r in found} == {"1": "B", "2": "ERR_MISSING"}


def test_score_cache(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"4_9": {"a": [0.5, 1.0]}}))
    assert [tuple(r) for r in readers.signal_scores(spark, str(tmp_path / "s.json")).orderBy("pos").collect()] == [(4, 9, "a", 0, 0.5), (4, 9, "a", 1, 1.0)]


def test_names_and_descriptions(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"categories": [{"category_id": "1", "category_name_en": " ", "category_name_ko": "옷", "confidence": 3}]}))
    row = readers.category_names(spark, str(tmp_path / "n.json")).first()
    assert (row["name"], row["confidence"]) == ("옷", 1.0)
    (tmp_path / "d.json").write_text(json.dumps({"items": {"7": {"summary": "s"}, "8": {"description": " "}}}))
    assert [tuple(r) for r in readers.descriptions(spark, str(tmp_path / "d.json")).collect()] == [(7, "s")]


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "v.npz", ids=np.array([4, 2]), embeddings=np.array([[1, 2], [3, 4]], np.float16))
    assert {r["item_id"]: list(r["embedding"]) for r in arrays.npz_vectors(spark, str(tmp_path / "v.npz")).collect()} == {4: [1, 2], 2: [3, 4]}
    np.savez(tmp_path / "m.npz", format=np.array(b"csr"), shape=np.array([2, 3]), indptr=np.array([0, 1, 2]), indices=np.array([2, 0]), data=np.array([5.0, 6.0]))
    assert sorted(tuple(r) for r in arrays.sparse_matrix(spark, str(tmp_path / "m.npz")).collect()) == [(0, 2, 5.0), (1, 0, 6.0)]


class _Fake:
    """Pickles as a call that rebuilds a tensor over a stored block."""

    def __init__(self, call):
        self.call = call

    def __reduce__(self):
        return self.call


class _Stored(pickle.Pickler):
    """Writes a tensor as its library does: storages by persistent ids, a call that rebuilds it."""

    def persistent_id(self, x):
        return ("storage", x[0], x[1], "cpu", 0) if isinstance(x, tuple) and len(x) == 2 and x[1] == "0" else None


def tensor_file(path, matrix, order, offset, compression=zipfile.ZIP_STORED):
    """A tensor of any strides over a block that begins with ``offset`` other elements."""
    from setloom.sources import arrays as module

    flat = np.concatenate([np.zeros(offset, "<f4"), matrix.ravel(order=order).astype("<f4")])
    strides = (matrix.shape[1], 1) if order == "C" else (1, matrix.shape[0])
    body = io.BytesIO()
    stub = type("FloatStorage", (), {"__module__": "torch", "__qualname__": "FloatStorage"})
    rebuild = type("_rebuild_tensor_v2", (), {"__module__": "torch._utils", "__qualname__": "_rebuild_tensor_v2"})
    modules = {"torch": type("M", (), {"FloatStorage": stub})(), "torch._utils": type("M", (), {"_rebuild_tensor_v2": rebuild})()}
    import sys

    sys.modules.update(modules)
    try:
        _Stored(body, protocol=2).dump(_Fake((rebuild, ((stub, "0"), offset, matrix.shape, strides, False, {}))))
    finally:
        for name in modules:
            del sys.modules[name]
    with zipfile.ZipFile(path, "w", compression) as z:
        z.writestr("x/data.pkl", body.getvalue())
        z.writestr("x/data/0", flat.tobytes())
    return module


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_ranges_of_tensor_rows(spark, tmp_path, order, compression):
    matrix = np.arange(700, dtype="<f4").reshape(100, 7)
    tensor_file(tmp_path / "t.pt", matrix, order, 5, compression)
    df = arrays.tensor_vectors(spark, str(tmp_path / "t.pt"), range_rows=9)
    assert df.rdd.getNumPartitions() == (12 if compression == zipfile.ZIP_STORED else 1)
    assert {r["item_id"]: list(r["embedding"]) for r in df.collect()} == {i: matrix[i].tolist() for i in range(100)}
    assert arrays.tensor((tmp_path / "t.pt").read_bytes()).tolist() == matrix.tolist()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_ranges_of_archives_and_matrices(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    ids, matrix = rng.permutation(50), rng.normal(size=(50, 3)).astype(np.float16)
    for order in ("C", "F"):
        save(tmp_path / "v.npz", ids=ids, embeddings=np.asarray(matrix, order=order))
        got = {r["item_id"]: list(r["embedding"]) for r in arrays.npz_vectors(spark, str(tmp_path / "v.npz"), range_rows=7).collect()}
        assert got == {int(i): matrix[k].astype(np.float32).tolist() for k, i in enumerate(ids)}
    dense = np.where(rng.random((20, 11)) < 0.3, rng.integers(1, 9, (20, 11)), 0)
    want = sorted((int(r), int(c), float(dense[r, c])) for r, c in zip(*np.nonzero(dense), strict=True))
    for kind in ("csr", "csc", "coo"):
        r, c = np.nonzero(dense if kind != "csc" else dense.T)
        major = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(dense) if kind == "csr" else dense.shape[1]))])
        parts = {"row": r, "col": c} if kind == "coo" else {"indptr": major, "indices": c}
        save(tmp_path / f"{kind}.npz", format=np.array(kind.encode()), shape=np.array(dense.shape), data=(dense if kind != "csc" else dense.T)[r, c], **parts)
        assert sorted(map(tuple, arrays.sparse_matrix(spark, str(tmp_path / f"{kind}.npz"), range_rows=3).collect())) == want


def test_tensor_files_refuse_other_classes():
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("a/data.pkl", pickle.dumps(_Fake((print, ("no",)))))
    with pytest.raises(pickle.UnpicklingError):
        arrays.tensor(blob.getvalue())


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5), ("c_d", None)], "name string, x double")
    assert writers.markdown(df).splitlines()[2] == r"| a\|b | 0.5 |"
    assert r"c\_d" in writers.latex(df, "t")
    assert writers.run_name("outfits", {"cooc": True, "alpha": 0.5, "off": False}, 10, 5, "x") == "results_outfits_COOC_ALPHA0.5_C10_T5_x"
    assert [writers.append_results(df, str(tmp_path / "r"), run, ("name",)) for run in ("one", "two", "one")] == [2, 2, 0]
    assert Runs(spark, str(tmp_path / "r")).read().count() == 4


def test_broken_and_repeated_runs_count_once(spark, tmp_path):
    store = Runs(spark, f"file://{tmp_path}/runs")
    work = spark.range(100).select(F.col("id").alias("sample_id"), (F.col("id") * 2).alias("answer"))
    with pytest.raises(Exception, match="broken"):  # half of the tasks write their files, then the job fails
        store.write(work.repartition(8).withColumn("answer", F.when(F.col("sample_id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("answer"))), "a")
    assert store.read() is None and store.missing(work, "a").count() == 100
    assert store.write(work.where("sample_id < 60"), "a") == 60
    assert store.write(work.unionByName(work.where("sample_id > 50")), "a") == 40  # taken up again, some rows twice
    assert store.write(work, "a") == 0 and store.write(work.where("sample_id = 5"), "b") == 1
    rows = store.read("a").collect()
    assert sorted(r["sample_id"] for r in rows) == list(range(100)) and all(r["answer"] == 2 * r["sample_id"] for r in rows)
    assert [(c["run"], c["number"], c["rows"]) for c in store.manifest()] == [("a", 0, 60), ("a", 1, 40), ("a", 2, 0), ("b", 0, 1)]
    assert json.loads(store.manifest()[1]["first"]) == {"sample_id": 60}
    # a writer that comes second to a number is told so
    assert not store._commit({"run": "a", "number": 1})
    work.limit(3).write.parquet(f"{tmp_path}/runs/data/lost")  # what a driver that died before its commit left
    assert store.read().count() == 101 and "lost" in store.clean() and store.read().count() == 101


def test_name_records_and_settings(spark, tmp_path):
    answer = """Here: ```json [{"category_id": 1, "category_name_en": " a  b ", "keywords_en": "x; y/ z,", "confidence": "0.5"},
      {"category_id": "2", "category_name_ko": "옷", "keywords_en": ["k ", "l"], "confidence": -3, "more": {"deep": [1]}}, {"category_id": "3", "confidence": "high"}]``` done"""
    raw = spark.createDataFrame([(answer,), ("no list",), ("[broken",), (None,)], "text string")
    rows = {r["category_id"]: (r["name"], r["keywords"], r["confidence"]) for r in readers.name_records(readers.fenced_records(raw)).collect()}
    assert rows == {"1": ("a b", ["x", "y", "z"], 0.5), "2": ("옷", ["k", "l"], 0.0), "3": ("3", [], 0.0)}
    one = spark.createDataFrame([(1, "5", "x")], "id int, cfg_top_k string, cfg_mode string")
    two = spark.createDataFrame([(2, 0.5, None)], "id int, `cfg_a.b` double, cfg_mode string")
    both = readers.settings(one).unionByName(readers.settings(two))
    assert sorted(map(tuple, readers.unpacked(both).collect()), key=str) == [(1, None, "x", "5"), (2, "0.5", None, None)]
    assert readers.unpacked(both).columns == ["id", "cfg_a.b", "cfg_mode", "cfg_top_k"]


def test_client_retries_load_only():
    calls = []

    def client(prompt):
        calls.append(prompt)
        raise RuntimeError("503 overloaded" if len(calls) < 3 else "bad request")

    assert remote.ask(client, "p", attempts=5, sleep=lambda s: None) == (None, "bad request") and len(calls) == 3

    def used_up(prompt):
        raise RuntimeError("quota")

    assert remote.with_fallback([used_up, str.upper])("a") == "A"


def test_resumption_is_idempotent(spark, tmp_path):
    prompts = spark.createDataFrame([(i, "x") for i in range(6)], "sample_id long, prompt string")
    for _ in range(2):
        assert remote.resumed(prompts, lambda p: "B", str(tmp_path / "a")).count() == 6


def rows_in(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("late", [None, "400 days"])
def test_streamed_sums_equal_batch_for_any_split(spark, tmp_path, late):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = sums.pairs(events, "user_id", "event_type")
    table, checkpoint, source = Sums(spark, f"{tmp_path}/sums", ["a", "b"], ["n"], 4), f"{tmp_path}/checkpoint", tmp_path / "events"
    for turn, order in enumerate((F.xxhash64("event_id"), F.desc("ts"))):  # files come in two goes, rows in no order of time
        part = events.where(F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(2)) == turn).orderBy(order).coalesce(1)
        part.withColumn("file", F.pmod(F.monotonically_increasing_id(), F.lit(3))).repartition(3, "file").drop("file").write.mode("append").parquet(str(source))
        stream = sums.pair_deltas(counters.events(spark, str(source)), "user_id", "event_type", late=late)
        table.follow(stream, checkpoint, every=3)  # the second go starts from the checkpoint
    assert rows_in(table.read()) == rows_in(batch)
    assert len(table._complete("base")) <= 1


def test_a_batch_counts_once(spark, tmp_path):
    table = Sums(spark, f"{tmp_path}/sums", ["k"], ["n"], 2)
    assert table.read() is None
    rows = spark.createDataFrame([("x", 1), ("x", 2), (None, 4)], "k string, n long")
    for batch in (0, 0, 1):  # batch 0 is run again
        table.add(rows, batch)
    assert sorted(map(tuple, table.read().collect()), key=str) == [("x", 6), (None, 8)]
    table.compact()
    table.compact()
    table.add(rows.where("k = 'x'"), 2)
    (tmp_path / "sums" / "base" / "000000000009").mkdir()  # a base that was never finished
    assert sorted(map(tuple, table.read().collect()), key=str) == [("x", 9), (None, 8)]


def test_sessions(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert counters.sessions(rows).agg(F.sum("n")).first()[0] == rows.count()


def test_suites(spark):
    from setloom.plans.suite import run_suite

    def run(session, name, conf):
        return session.range(conf["n"]["rows"]).count() if name != "bad" else 1 / 0

    plan = [{"name": "a"}, {"name": "b", "overrides": {"n": {"rows": 7}}}, {"name": "bad"}]
    got = run_suite(spark, {"n": {"rows": 3, "x": 1}}, plan, run, max_parallel=2)
    assert (got["a"], got["b"]) == (3, 7) and isinstance(got["bad"], ZeroDivisionError)
    assert run_suite(spark, {"n": {"rows": 3, "x": 1}}, plan, run, dry=True)["b"] == {"n": {"rows": 7, "x": 1}}


def test_batches_are_full(spark):
    texts = spark.range(200).selectExpr("id as sample_id", "concat('text ', id) as text")
    got = remote.batched(texts, "Do this.", 10).collect()
    assert len(got) == 20 and all(len(r["prompt"].splitlines()) == 11 for r in got)
    assert sorted(int(x.split(":")[0]) for r in got for x in r["prompt"].splitlines()[1:]) == list(range(200))


def test_demand_is_tried_again():
    calls = []

    def client(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("high demand")
        return "A"

    assert remote.ask(client, "p", sleep=lambda s: None) == ("A", None) and len(calls) == 3


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(205).toDF("n")
    assert writers.markdown(df).splitlines()[-1] == "5 more rows" and "5 more rows" in writers.latex(df, "t")
    assert len(writers.markdown(df, limit=300).splitlines()) == 207


def test_plans_from_files(spark, tmp_path):
    from setloom.plans import suite

    pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text("n: {rows: 3, x: 1}\nmode: choice\n")
    (tmp_path / "suite.yml").write_text("base: base.yaml\nexperiments:\n- name: a\n- {name: b, overrides: {n: {rows: 7}}}\n")
    base, experiments = suite.plan(spark, str(tmp_path / "suite.yml"))
    assert base == {"n": {"rows": 3, "x": 1}, "mode": "choice"}
    got = suite.run_suite(spark, base, experiments, lambda session, name, conf: session.range(conf["n"]["rows"]).withColumn(f"only_{name}", F.lit(1)))
    both = suite.union_of_runs(got)
    assert both.groupBy("experiment").count().orderBy("experiment").collect() == [("a", 3), ("b", 7)] and set(both.columns) == {"id", "only_a", "only_b", "experiment"}
    (tmp_path / "twice.json").write_text(json.dumps({"experiments": [{"name": "a"}, {"name": "a"}]}))
    with pytest.raises(ValueError, match="share a name"):
        suite.plan(spark, str(tmp_path / "twice.json"))
    (tmp_path / ".env").write_text("\ufeffKEY_1=abc # note\n# KEY_1=no\nexport B = 'x # y'\nKEY_1=\"last\"\nnothing here\nEMPTY=\n")
    assert {r["name"]: r["value"] for r in suite.environment(spark, str(tmp_path / ".env")).collect()} == {"KEY_1": "last", "B": "x # y", "EMPTY": ""}
