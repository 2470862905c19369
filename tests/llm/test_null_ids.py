"""Rows without an id, or with a repeated one, among near copies."""

from test_llm import docs_df, text

from verdigris.llm import ngram_join


def changed(base, *places):
    w = base.split()
    for p in places:
        w[p] = f"z{p}"
    return " ".join(w)


def test_null_ids_link(spark):
    a, b = text(501, 100), text(502, 100)
    chain = [(1, b), (None, changed(b, 0, 1, 2, 3, 4)), (2, changed(b, 0, 1, 2, 3, 4, 95, 96, 97, 98, 99))]
    rows = [(5, a), (None, changed(a, 50)), (None, changed(a, 50))] + chain
    # the ends of the chain are below the threshold, so only the row without an id holds it together
    sets = [{tuple(w[i : i + 4]) for i in range(97)} for w in (chain[0][1].split(), chain[2][1].split())]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.members(docs_df(spark, rows), 4, 85).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (None, 5), (None, 5), (1, 1), (None, 1), (2, 1)], key=str)
    # copies that all lack an id
    pair = docs_df(spark, [(None, a), (None, changed(a, 50)), (9, b)])
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.members(pair, 4, 85).collect()} == {(None, None), (9, 9)}


def test_one_of_each_tells_rows_apart(spark):
    a, b, c, d = (text(s, 100) for s in (601, 602, 603, 604))
    # (5, a) is a copy of 3 and goes; (5, b) stays; both texts of 7 stay, one of the copies without an id, both empty rows
    rows = [(3, a), (5, a), (5, b), (7, c), (7, d), (None, changed(c, 50)), (None, text(605, 100)), (None, text(605, 100)), (None, ""), (8, None)]
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs_df(spark, rows)).collect()]
    want = [(3, a), (5, b), (7, c), (7, d), (None, text(605, 100)), (None, ""), (8, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
