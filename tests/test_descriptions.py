"""Signals of texts on small samples: options without a vector, inputs without or with a zero one, ties."""

from setloom.operators import descriptions as D


def test_what_has_no_vector(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "item_id long, embedding array<double>")
    sample = lambda b, items, gt: [(b, p, i, i == gt) for p, i in enumerate(items)]
    samples = spark.createDataFrame(sample(10, [2, 1, 3], 1) + sample(11, [1, 6], 1) + sample(12, [1, 2], 1) + sample(13, [3, 3, 2], 2), "bundle_id long, pos long, item_id long, is_gt boolean")
    inputs = spark.createDataFrame([(10, 1), (10, 4), (10, 9), (11, 1), (12, 4), (12, 5), (13, 3)], "bundle_id long, item_id long")
    runs = spark.createDataFrame([(10, 1, 1), (13, 1, 0)], "bundle_id long, pred_pos long, hit int")
    rows = {r["bundle_id"]: r for r in D.description_signal(samples, inputs, vectors, runs).collect()}
    assert sorted(rows) == [10, 13]  # 11 has an option without a vector, 12 no input with one
    one, two = rows[10], rows[13]
    assert (one["n_valid_inputs"], one["gt_rank"], one["top_pos"], one["pred_is_top"], round(one["gt_sim"], 9), round(one["neg_max"], 6)) == (1, 1, 1, 1, 1.0, 0.707107)
    assert (two["gt_rank"], two["top_pos"], two["pred_is_top"]) == (3, 0, 0)  # of equal ones the first stands first
    summary = {r["split"]: (r["n"], r["top1_rate"]) for r in D.description_summary(D.description_signal(samples, inputs, vectors, runs)).collect()}
    assert summary == {"all": (2, 0.5), "llm_hit": (1, 1.0), "llm_miss": (1, 0.0)}
