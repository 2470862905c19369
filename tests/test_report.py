"""The printed evaluation."""

from verdigris.operators import evaluate as E


def test_report_lists_every_label(spark):
    q = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.5)], "n_queries long, map double, p_at_1 double, p_at_k double, recall_at_k double")
    b = spark.createDataFrame([(0.0, 0.0, 1.0)], "low double, middle double, high double")
    d = E.separation(spark.createDataFrame([(True, 1.0), (False, 2.0)], "same boolean, distance double"))
    labels = spark.createDataFrame([(f"label {i:04d}", 0.5, "#" * 10) for i in range(1200)], "shown string, ap double, bar string")
    text = E.report(q, labels, b, d)
    assert [x for x in text.split("\n") if x.startswith("label")] == [f"{f'label {i:04d}':45s} 0.5000 {'#' * 10}" for i in range(1200)]
