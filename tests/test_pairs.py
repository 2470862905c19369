"""The pair analysis over all records."""

import numpy as np

from verdigris import catalog
from verdigris.operators import evaluate as E
from verdigris.operators import knn

SF = "/root/testdata/sf0.01"


def test_registered_queries_take_all_pairs(spark):
    """The known values of all 500 records."""
    got = {r["same"]: (r["n"], r["mean"], r["std"], r["low"], r["high"]) for r in catalog.Q["intra_inter_stats"](spark, SF).collect()}
    assert got == {True: (12344, 1.410255, 0.089257, 1.024795, 1.711252), False: (112406, 1.411209, 0.089214, 0.98708, 1.759898)}
    rows = catalog.Q["pairwise_distances_upper"](spark, SF).toPandas()
    assert len(rows) == 124750 == len(rows[["i", "j"]].drop_duplicates()) and (rows.i < rows.j).all() and rows.j.max() == 499
    intra, inter = rows.distance[rows.same], rows.distance[~rows.same]
    fisher = catalog.Q["fisher_separation"](spark, SF).first()["fisher"]
    assert abs(fisher - (inter.mean() - intra.mean()) / (inter.std(ddof=0) + intra.std(ddof=0) + 1e-8)) < 2e-5
    over = catalog.Q["overlap_pct"](spark, SF).first()["overlap_pct"]
    assert abs(over - 100 * (intra > inter.mean()).mean()) < 0.01
    assert catalog.Q["diagnosis_rules"](spark, SF).first()["notes"] == "classes overlap; many pairs inside a class are far apart"


def test_pairs_in_blocks(spark):
    """Blocks of 16 against single pairs: copies, a repeated id and null labels among them."""
    x = np.random.default_rng(5).normal(size=(70, 6))
    x[9] = x[40]
    rows = [(i, None if i % 11 == 0 else str(i % 3), [float(v) for v in x[i]]) for i in range(70)] + [(3, "1", [0.0] * 6)]
    df = spark.createDataFrame(rows, "record_idx long, label string, vector array<double>")
    plain = knn.pairwise(df, keep=["label"]).selectExpr("i", "j", "label_i = label_j as same", "distance")
    key = lambda r: (r["i"], r["j"], round(r["distance"], 9), r["same"])
    want = sorted(map(key, plain.collect()), key=repr)
    got = knn.pair_rows(df, size=16)
    assert sorted(map(key, got.collect()), key=repr) == want and 0.0 in {r["distance"] for r in got.filter("i = 9 and j = 40").collect()}
    sums = {r["same"]: r for r in knn.pair_sums(df, size=16).collect()}
    for side in (True, False, None):
        d = np.array([r[2] for r in want if r[3] is side])
        s = sums[side]
        assert s["n"] == len(d) and np.allclose((s["mean"], s["std"], s["low"], s["high"]), (d.mean(), d.std(), d.min(), d.max()))
    a, b = E.separation(plain).first(), E.separation_of(df).first()
    assert sorted(a.asDict()) == sorted(b.asDict()) and all(np.isclose(a[c], b[c]) for c in a.asDict())
    assert knn.pair_rows(df.limit(0)).count() == 0 and E.separation_of(df.limit(0)).first()["n_intra"] == 0


def test_pair_rows_write_each_record_a_few_times(spark):
    """48 blocks of 64 records: what is shuffled is a few times the records, not once for every other block."""
    n = 3000
    df = spark.range(n).selectExpr("id as record_idx", "cast(id % 7 as int) as label", "transform(sequence(1, 64), k -> cast(hash(id, k) as float)) as vector")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(60_000)
        return sc.statusStore().executorList(True).head().totalShuffleWrite()

    before = shuffled()
    knn.pair_rows(df, size=64).write.format("noop").mode("overwrite").save()
    assert shuffled() - before < 6 * n * (64 * 4 + 32)
    assert knn.pair_rows(df, size=64).agg({"*": "count"}).first()[0] == n * (n - 1) // 2


def test_pair_rows_odd_tables(spark):
    """Even and odd numbers of blocks, slices of a block, labels that all are null, numbers that round at a half, large ones."""
    x = np.random.default_rng(6).normal(size=(300, 4))
    df = spark.createDataFrame([(i, None, [float(v) for v in x[i]]) for i in range(300)], "record_idx long, label string, vector array<double>")
    for size in (300, 160, 100, 75, 60):
        got = knn.pair_rows(df, size=size).toPandas()
        i, j = np.triu_indices(300, 1)
        got = got.sort_values(["i", "j"])
        assert (got.i.to_numpy() == i).all() and (got.j.to_numpy() == j).all() and got.same.isna().all()
        assert np.allclose(got.distance, np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)), rtol=1e-12)
    line = spark.createDataFrame([(0, 1, [0.0]), (1, 1, [0.5]), (3, 1, [0.125])], "record_idx long, label int, vector array<double>")
    rounded = {(r["i"], r["j"]): r["distance"] for r in knn.pair_rows(line, decimals=2).collect()}
    assert rounded == {(0, 1): 0.5, (0, 3): 0.13, (1, 3): 0.38}
    assert knn._rounded(np.array([1e307, 0.0, 2.5]), 2).tolist() == [1e307, 0.0, 2.5] and knn._rounded(np.array([0.49999999999999994, 2.5]), 0).tolist() == [0.0, 3.0]
    for bad in ([(0, 1, [1.0]), (1, 1, [1.0, 2.0])], [(0, 1, [1.0]), (1, 1, None)]):
        try:
            knn.pair_rows(spark.createDataFrame(bad, "record_idx long, label int, vector array<double>")).collect()
        except Exception as e:
            assert "one length" in str(e)
        else:
            raise AssertionError("accepted")
