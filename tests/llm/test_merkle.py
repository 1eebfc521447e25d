"""The manifest against a plain recursion, over several rounds of superblocks and awkward rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from setloom.llm import merkle as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(leaves, fanout):
    """The root, and for each leaf its siblings on the way up as (before, after)."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for leaf, p in enumerate(at):
            run = nodes[p // fanout * fanout : p // fanout * fanout + fanout]
            proofs[leaf].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        at = [p // fanout for p in at]
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows, fanout):
    """rows (id, group, text, other text) to sorted results, from the definition."""
    groups = {}
    for i, g, text, other in rows:
        groups.setdefault(g, []).append((i, digest((i, g, text)), digest((i, g, other))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = {g: tree([x[1] for x in groups[g]], fanout) for g in order}
    root, tops = tree([subs[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops, strict=True):
        for (i, leaf, other), own in zip(groups[g], subs[g][1], strict=True):
            node = other
            for a, b in own + top:
                node = h(a + node + b)
            out.append((i, g, leaf, subs[g][0], root, h("".join(a + b for a, b in own + top)), node))
    return out


def rows_of(n_groups, n):
    rows = [(i * 7 % 100_003, f"g{i * i % n_groups}", f"text {i}\nof rows" * (i % 3), None) for i in range(n)]
    rows += [(None, "g1", "no id", None), (5, None, "no group", None), (6, None, None, None), (9, "", "", None), (9, "é", "x", None), (9, "é", "x", None), (9, "é", "y", None), (1, "Z", "long " * 9000, None)]
    return [(i, g, t, t if t is None or (i or 1) % 2 else t.replace("\n", "")) for i, g, t, _ in rows]


@pytest.mark.parametrize("n_groups,n,fanout,depth", [(1, 60, 3, 2), (40, 90, 2, 1), (3, 200, 3, 7)])
def test_brute_force(spark, n_groups, n, fanout, depth):
    rows = rows_of(n_groups, n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, changed string, n int, node string").repartition(5)
    other = M.row_digest([F.col("doc_id"), F.col("source"), F.col("changed")])
    got = M.merkle(df, ["doc_id", "source", "text"], other=other, fanout=fanout, depth=depth).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, fanout), key=key)


def test_any_ids_and_empty_table(spark):
    df = spark.createDataFrame([("b", "s"), ("a", "s"), (None, None)], "name string, kind string")
    got = M.merkle(df, ["name"], id_col="name", group_col="kind").collect()
    assert len(got) == 3 and all(r["folded_root"] == r["root"] for r in got)
    assert len({r["root"] for r in got}) == 1
    assert M.merkle(df.where("false"), ["name"], id_col="name", group_col="kind").count() == 0
