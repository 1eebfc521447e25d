"""Row comparison for oracle tests."""

import math


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value:.7g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(x) for x in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(spark_df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(spark_df.columns)
    expected, got = rows_of(names, found.fetchall()), rows_of(spark_df.columns, spark_df.collect())
    assert len(expected) == len(got)
    assert expected == got
