"""Members of large JSON objects, cut at every place, against the library's parser."""

import json
import random

import pytest

from setloom.sources import members as M

DRAW = random.Random(4)
TRICKY = ['"', "\\", '\\"', "{", "}", "[", "]", ",", ":", "é", "\U0001f600", "\n", 'a"b\\', "\\\\", "'", ""]


def thing(depth=0):
    kind = DRAW.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return "".join(DRAW.choice(TRICKY) for _ in range(DRAW.randrange(6)))
    if kind < 3:
        return DRAW.choice([1, -2.5, True, None, "x"])
    return [thing(depth + 1) for _ in range(DRAW.randrange(4))] if kind == 3 else {f"k{i}" + DRAW.choice(TRICKY): thing(depth + 1) for i in range(DRAW.randrange(4))}


@pytest.mark.parametrize("ascii_only", [True, False])
@pytest.mark.parametrize("chunk", [1, 3, 7, 64, 10_000])
def test_every_cut(spark, tmp_path, monkeypatch, ascii_only, chunk):
    """In one process: the sums of all ranges and the members found from their states."""
    monkeypatch.setattr(M, "STEP", 16)
    whole = {f"m{i}" + DRAW.choice(TRICKY): thing() for i in range(40)}
    path = str(tmp_path / "o.json")
    (tmp_path / "o.json").write_text(json.dumps(whole, ensure_ascii=ascii_only, indent=DRAW.choice([None, 1])), encoding="utf-8")
    size = (tmp_path / "o.json").stat().st_size
    state, got = (False, False, 0), []
    for start in range(0, size, chunk):
        end = min(size, start + chunk)
        got += [M.split(t) for _, t in M.found(path, start, end, size, *state)]
        sums = None
        for inside, escaped in M.BEGINS:
            if (inside, escaped) == state[:2]:
                _, change, inside, escaped = M.walk(M._bytes(path, start, end), inside, escaped)
                sums = (inside, escaped, state[2] + int(change.sum()))
        state = sums
    assert [(k, json.loads(v)) for k, v in got] == list(whole.items())


def test_read_by_many_tasks(spark, tmp_path):
    whole = {str(i): {"title": f'song "{i}" \\', "tags": list(range(i % 5))} for i in range(3000)}
    outer = {"meta": {"items": {"no": 1}, "n": [1, {"items": []}]}, "items": whole, "after": "}{"}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    (tmp_path / "b.json").write_text(json.dumps(outer))
    (tmp_path / "c.json").write_text(json.dumps([{"id": i} for i in range(500)]))
    df = M.members(spark, str(tmp_path / "a.json"), chunk=8000)
    assert df.rdd.getNumPartitions() > 10
    assert {r["key"]: json.loads(r["value"]) for r in df.collect()} == whole
    for chunk in (5000, 1 << 20):
        inner = M.members(spark, f"file://{tmp_path}/b.json", under="items", chunk=chunk).collect()
        assert {r["key"]: json.loads(r["value"]) for r in inner} == whole and len(inner) == len(whole)
    assert len(M.members(spark, str(tmp_path / "a.json"), under="items", chunk=9000).collect()) == 3000
    assert sorted(json.loads(r["value"])["id"] for r in M.members(spark, str(tmp_path / "c.json"), chunk=1000).collect()) == list(range(500))
    (tmp_path / "f.json").write_text("\n".join(json.dumps({str(i): {"x": "}{"}, f"{i}b": []}) for i in range(300)) + "\n[7, 8]\n")
    lines = M.members(spark, str(tmp_path / "f.json"), chunk=700).collect()
    assert sorted(r["key"] or r["value"] for r in lines) == sorted([f"{i}{x}" for i in range(300) for x in ("", "b")] + ["7", "8"])
    (tmp_path / "d.json").write_text("{}")
    (tmp_path / "e.json").write_text("")
    assert M.members(spark, str(tmp_path / "d.json")).count() == 0 and M.members(spark, str(tmp_path / "e.json")).count() == 0
