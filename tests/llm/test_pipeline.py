"""Each stage of the pipeline against brute force or SQL on its own input, and run() against the stages in a row."""

import duckdb
from test_llm import brute_components, brute_tokens, text

import corpus_pipeline
from verdigris.llm import decontam, mixing
from verdigris.llm._work import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard", "decontamination", "mix_sources", "token_ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = written(stages["language_id"](spark, docs, SF), "t1")
    assert kept.columns == COLUMNS and kept.count() >= 0.97 * docs.count()

    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    one = written(stages["ngram_jaccard"](spark, kept, SF), "t2")
    assert one.columns == COLUMNS
    assert sorted(r["doc_id"] for r in one.collect()) == [d for d, _, c in brute_components(rows, 5, 80) if d == c]

    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    con.register("documents", one.toPandas())
    clean = written(stages["decontamination"](spark, one, SF), "t3")
    want = [r[0] for r in con.execute(f"select doc_id from ({decontam.ORACLE}) where not contaminated order by 1").fetchall()]
    assert clean.columns == COLUMNS and sorted(r["doc_id"] for r in clean.collect()) == want

    con.register("clean", clean.toPandas())
    mixed = written(stages["mix_sources"](spark, clean, SF), "t4")
    copies = con.execute(f"with documents as (select * from clean) select doc_id, copies from ({mixing.ORACLE.replace('with s as', 'with s as', 1)}) where copies > 0 order by 1").fetchall()
    assert mixed.columns == COLUMNS
    assert sorted(r["doc_id"] for r in mixed.collect()) == [d for d, k in copies for _ in range(k)]

    texts = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    numbered = brute_tokens([((d, i), t) for i, (d, t) in enumerate(texts)])
    expected = sorted((key[0], *v) for key, v in numbered.items())
    out = stages["token_ids"](spark, mixed, SF)
    assert sorted(tuple(r) for r in out.collect()) == expected
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == expected


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated ids and rows, a very long text, clashing extra columns, and no rows at all."""
    learned = [(i, text(i, 40) if i % 2 else text(i, 40).replace("w", "öß"), "en" if i % 2 else "de", f"s{i % 2}", 1) for i in range(100, 160)]
    long_ = text(7, 30_000, 20_000)
    odd = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "12 34", "de", "a", 5), (None, text(900, 50), None, None, None), (None, text(901, 50), "en", "a", None),
        (5, text(902, 50), "en", None, 9), (5, text(903, 50), "en", "a", 9), (5, text(903, 50), "en", "a", 9), (6, long_, "en", "s1", len(long_)), (7, long_ + " end", "en", "s1", 0),
        (8, text(904, 30) + " " + text(905, 12), "en", "a", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(learned + odd, schema).selectExpr("*", "'x' as node", "1 as row", "2 as rk", "3 as size", "'y' as lang_pred", "4 as k_id")
    path = str(tmp_path)
    spark.createDataFrame([(1, text(905, 12))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda t: sorted((r["doc_id"] for r in t.collect()), key=lambda x: (x is None, x or 0))
    a = written(one(spark, df, path), "a")
    assert a.columns == df.columns and [x for x in ids(a) if x is None or x < 100] == [5, 5, 5, 6, 7, 8, None, None]
    b = written(two(spark, a, path), "b")
    assert b.columns == df.columns and [x for x in ids(b) if x is None or x < 100] == [5, 5, 6, 8, None, None]
    c = written(three(spark, b, path), "c")
    assert c.columns == df.columns and [x for x in ids(c) if x is None or x < 100] == [5, 5, 6, None, None]
    d = written(four(spark, c, path), "d")
    assert d.columns == df.columns and set(ids(d)) <= set(ids(c))
    e = five(spark, d, path).collect()
    assert len(e) == d.count() and sum(r["n_tokens"] for r in e) == max(r["start"] + r["n_tokens"] for r in e)
    empty = df.limit(0)
    for stage in (one, two, three, four):
        empty = stage(spark, empty, path)
        assert empty.columns == df.columns and empty.count() == 0
    assert five(spark, empty, path).count() == 0
