"""The operators against brute force, round trips and held-out accuracy, and on nulls, ties, repeats, long and empty texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from verdigris.llm import chat, decontam, langid, line_rules, mixing, ngram_join, queries, simple8b, substring, token_counts, token_files, weak_quality

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_df(spark, rows):
    """rows: (doc_id, text[, lang[, source]])"""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC)


def text(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and blank texts, repeats, ties, a long text, other alphabets, control characters."""
    shared = text(1, 60)
    return [
        (0, shared, "en", "a"), (1, shared, "en", "a"), (2, None, None, None), (3, "", "en", None), (4, " \n\t ", "de", "b"),
        (5, text(2, 30) + " " + shared, "en", "b"), (6, text(3, 5000, 300), "en", "c"), (7, "Straße ÀÉ 中文  x\x1cy <|endoftext|> it's", "fr", "c"),
        (8, "a", "en", "a"), (9, "A b C", "en", "a"), (10, "a B c", "en", "a"), (11, shared.upper(), "en", "b"),
        (12, "one two\n\n\nthree, four.\n| x | y | z |", "es", "a"), (None, "no id here at all", "en", "a"), (13, "same same same same same same same same", "en", "z"),
    ]


def compare(df, sql, spark, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toPandas() if not isinstance(t, str) else None) if not isinstance(t, str) else con.execute(f"create view {name} as select * from '{t}'")
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: repr(r)
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((tuple(fix(x) for x in r) for r in got.fetchall()), key=key)
    have = sorted((tuple(fix(r[c]) for c in cols) for r in df.collect()), key=key)
    assert have == want


# --- mixing


def test_mix_matches_sql(spark):
    path = f"{SF}/documents.parquet"
    compare(mixing.counts(spark.read.parquet(path)), mixing.ORACLE, spark, documents=path)


def test_mix_nears_targets_and_caps(spark):
    rows = [(i, text(i, 20 + i % 50), None, f"s{i % 4}") for i in range(800)]
    got = mixing.counts(docs_df(spark, rows)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["target"]] += r["taken"]
        target[r["target"]] = r["source_size"]
        assert r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    for goal, words in taken.items():
        assert abs(words - goal) < 40
    assert abs(sum(target) - 1.5 * sum(target.values())) < 1e-6 or len(target) < 4


def test_mix_odd_rows_and_repeats(spark, odd_rows):
    df = docs_df(spark, odd_rows + odd_rows[:1])
    got = mixing.counts(df).collect()
    assert len(got) == len(odd_rows) + 1
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    out = mixing.mix(df.withColumn("size", df.doc_id).withColumn("q", df.doc_id))
    assert set(df.columns) <= set(out.columns) and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_inclusion_follows_weights(spark):
    rows = [(i, "a b c d e f g h i j", None, "s") for i in range(2000)]
    got = mixing.counts(docs_df(spark, rows), share=0.3).collect()
    assert sum(r["copies"] for r in got) == 600
    rows = [(i, text(i, 3 if i % 2 else 40), None, "s") for i in range(3000)]  # classes 1 and 5: 2 to 6
    got = mixing.counts(docs_df(spark, rows), share=0.5).collect()
    mean = [np.mean([r["copies"] for r in got if r["size"] == n]) for n in (3, 40)]
    assert abs(sum(r["taken"] for r in got) - 0.5 * 1500 * 43) <= 3 and 0.27 < mean[0] / mean[1] < 0.4
    same = [(None, text(i, 20), None, "s") for i in range(400)]  # rows without an id are drawn one by one
    assert abs(sum(r["taken"] for r in mixing.counts(docs_df(spark, same), share=0.5).collect()) - 4000) <= 20


# --- Simple-8b and token files


@pytest.mark.parametrize("ids", [[], [0], [1] * 10000, list(range(9000)), [2**60, 0, 2**64 - 1, 2**60 - 1, 7] * 50])
def test_simple8b_round_trip(ids):
    a = np.array(ids, dtype=np.uint64)
    assert (simple8b.decode(simple8b.encode(a)) == a).all()


def test_simple8b_random_widths():
    rng = np.random.default_rng(3)
    for n in (1, 239, 4095, 4096, 4097, 20000):
        a = rng.integers(0, 2 ** rng.integers(1, 62, n, dtype=np.uint64), dtype=np.uint64)
        assert (simple8b.decode(simple8b.encode(a)) == a).all()


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tok, out, at = Tokenizer.from_file(queries.tokenizer_file()), {}, 0
    for doc, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_token_files_equal_whole_encoding(spark, odd_rows):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for rows in ([(r["doc_id"], r["text"]) for r in table], [r[:2] for r in odd_rows]):
        df = docs_df(spark, rows).repartition(3)
        got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.encode_and_read(df, queries.tokenizer_file()).collect()}
        assert got == brute_tokens(sorted(rows, key=lambda r: (r[0] is not None, r[0])))


def test_token_files_ids_and_empty(spark, tmp_path):
    df = docs_df(spark, [(1, "Hello, World"), (1, "Hello, World"), (0, None)])
    token_files.write_ids(df, str(tmp_path / "t"), queries.tokenizer_file())
    got = sorted((r["start"], r["doc_id"], r["ids"][-1]) for r in token_files.read_ids(spark, str(tmp_path / "t")).collect())
    assert [g[1:] for g in got] == [(0, 1), (1, 1), (1, 1)] and got[0][0] == 0
    assert token_files.encode_and_read(df.limit(0), queries.tokenizer_file()).count() == 0


def test_words_that_are_not_one_piece(spark):
    """Letters that normalise to a letter and a mark, and every letter of Unicode, inside and at the end of words."""
    rows = [(1, "सड़क \ufb2a\u05d5 सड़क, Straße İstanbul")]
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha()]
    rows += [(2 + i, " ".join(f"{c} a{c} {c}b. {c}{c}," for c in letters[i * 5000 : (i + 1) * 5000])) for i in range(-(-len(letters) // 5000))]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.encode_and_read(docs_df(spark, rows), queries.tokenizer_file()).collect()}
    assert got == brute_tokens(rows)


@pytest.mark.parametrize("by_word", [True, False])
def test_tokenizers_that_keep_white_space(spark, odd_rows, tmp_path, by_word):
    """A tokenizer whose pre-tokens hold the space before a word is used on whole texts, by ids and by offsets."""
    import json

    from tokenizers import Tokenizer

    made = json.load(open(queries.tokenizer_file()))
    if not by_word:
        made["pre_tokenizer"] = {"type": "Split", "pattern": {"Regex": " ?[^ ]+"}, "behavior": "Isolated", "invert": False}
    path = str(tmp_path / "t.json")
    json.dump(made, open(path, "w"))
    tok = Tokenizer.from_file(path)
    assert token_files.Rules(tok).by_word == by_word
    rows = [r[:2] for r in odd_rows if r[0] is not None]
    df = docs_df(spark, rows)
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in rows}
    assert {r["doc_id"]: r["n_tokens"] - 1 for r in token_files.encode_and_read(df, path).collect()} == want
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.by_field(df, path, 7).collect()} == want


# --- substring dedup


def test_substring_brute_force(spark, odd_rows):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for data in (rows, [r[:2] for r in odd_rows if r[0] is not None]):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring.digest(docs_df(spark, data)).collect()}
        assert got == substring.brute_force(data)


def test_substring_repeats_nulls_empty(spark, odd_rows):
    df = docs_df(spark, odd_rows + [odd_rows[0]]).withColumn("s", chat.F.lit(1)).withColumn("spans", chat.F.lit(2))
    got = [r for r in substring.remove_repeats(df).collect()]
    assert len(got) == len(odd_rows) + 1
    assert [r["n_removed"] for r in got if r["doc_id"] == 0] == [0, 0]
    assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [60]
    assert substring.digest(df.limit(0)).count() == 0


# --- language ID


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark, odd_rows):
    got = {r["doc_id"]: r for r in langid.digest(docs_df(spark, odd_rows + [(90, "12 34 !!", None, None)])).collect()}
    for i in (2, 3, 4, 90):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert got[0]["lang_pred"] != "und"
    none = docs_df(spark, [(i, "words here", None) for i in range(3)])
    assert {r["lang_pred"] for r in langid.digest(none).collect()} == {"und"}
    assert langid.digest(none.limit(0)).count() == 0
    clash = docs_df(spark, odd_rows).withColumn("lang_pred", chat.F.lit("x")).withColumn("score", chat.F.lit(9))
    kept = langid.recognised(clash)
    assert kept.columns == clash.columns and {r["score"] for r in kept.collect()} == {9}


def test_code_switched_words():
    en = [(text(i, 60).replace("w", "the"), "en") for i in range(60)]
    de = [(text(i + 500, 60).replace("w", "öß"), "de") for i in range(60)]
    model = langid.train(en + de)
    import pyarrow as pa

    from verdigris.llm import _text as tx

    data, off = tx.column_bytes(pa.array([en[0][0] + " " + de[0][0]]))
    ws, we, first = tx.word_spans(data, off, ~tx.SPACE)
    post = langid._forward_backward(langid._scores(model, data, ws, we, tx.word_hashes(data, ws, we, True)).astype(float), np.diff(first), model.move)
    assert [model.langs[i] for i in post.argmax(axis=1)] == ["en"] * 60 + ["de"] * 60


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    score, move = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    post, expected = langid._forward_backward(score, np.array([4]), move, pairs=True)
    import itertools

    p, e, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(score[t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        z += w
        for t, y in enumerate(path):
            p[t, y] += w
        for a, b in zip(path, path[1:], strict=False):
            e[a, b] += w
    assert np.allclose(post, p / z) and np.allclose(expected, e / z)


def test_language_prediction_equals_enumeration(spark):
    """The query's rows against sums over all labellings of short texts, with the model that the query learns."""
    import itertools

    rows = [(i, text(i, 30) if i % 2 else text(i, 30).replace("w", "öß"), "en" if i % 2 else "de") for i in range(90)]
    rows += [(1000 + i, t, None) for i, t in enumerate(["w1 w22 öß3", "öß12", "w5 12 öß9 öß8 w7", "zz"])]
    df = docs_df(spark, rows)
    model, got = langid.fit(df), {r["doc_id"]: r for r in langid.digest(df).collect()}
    import pyarrow as pa

    from verdigris.llm import _text as tx

    for doc, t, _ in rows[90:]:
        data, off = tx.column_bytes(pa.array([t]))
        ws, we, _ = tx.word_spans(data, off, ~tx.SPACE)
        score = langid._scores(model, data, ws, we, tx.word_hashes(data, ws, we, True)).astype(float)
        weight = {y: np.exp(sum(score[k, v] for k, v in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product(range(2), repeat=len(ws))}
        lettered = [k for k, word in enumerate(t.split()) if any(c.isalpha() for c in word)]
        mean = [sum(p for y, p in weight.items() for k in lettered if y[k] == v) / sum(weight.values()) / len(lettered) for v in range(2)]
        assert got[doc]["lang_pred"] == model.langs[int(np.argmax(mean))] and abs(got[doc]["score"] - max(mean)) < 1e-6


def test_recognised_keeps_switched_texts(spark):
    """A text in three languages stays although no language has half of it; letterless and empty ones go."""
    marks = {"en": "w", "de": "öß", "fr": "çé"}
    rows = [(i, text(i, 40).replace("w", marks[lang]), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    mixed = " ".join(text(1000 + i, 20).replace("w", m) for i, m in enumerate(marks.values()))
    kept = {r["doc_id"] for r in langid.recognised(docs_df(spark, rows + [(5000, mixed, None), (5001, "12 !!", "en"), (5002, None, "de")])).collect()}
    assert kept == {*range(180), 5000}


def test_clashing_names_and_repeated_rows(spark, odd_rows):
    """Every operator with input columns named like its own, and with each row twice."""
    df = docs_df(spark, odd_rows + odd_rows)
    for name in ("dk", "rk", "row", "k", "words", "lines", "n", "h", "start", "cands", "size", "m_key", "q", "odds", "tie", "shard", "ids", "node", "th", "bucket", "kind", "score", "votes", "spans_", "l_text", "held_out", "text_", "held", "wins"):
        df = df.withColumn(name, chat.F.lit(1))
    items = spark.createDataFrame([(1, odd_rows[0][1], 1)], "item_id long, text string, ww int")
    file, n = queries.tokenizer_file(), 2 * len(odd_rows)
    found = {
        "op1": mixing.counts(df), "op2": token_files.encode_and_read(df, file), "op3": substring.digest(df), "op4": langid.digest(df), "op5": weak_quality.classify(df),
        "op6": ngram_join.members(df), "op7": token_counts.by_field(df, file), "op9": decontam.digest(df, items), "op10": line_rules.digest(df),
    }
    for op, out in found.items():
        rows = out.collect()
        assert len(rows) == n, op
        if op != "op2":  # each copy of a row has a place of its own there
            by = defaultdict(list)
            for r in rows:
                by[r["doc_id"]].append(repr(tuple(r)))
            assert all(len(set(v)) == 1 for d, v in by.items()), op
    assert decontam.clean(df, items).columns == df.columns and line_rules.clean(df).columns == df.columns and mixing.mix(df).columns == df.columns


# --- weak labels


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    accuracy = [0.95, 0.8, 0.7, 0.9]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) for a in accuracy], axis=1).astype(int)
    patterns, counts = np.unique(["".join(map(str, v)) for v in votes], return_counts=True)
    model = weak_quality.em(dict(zip(patterns.tolist(), counts.tolist(), strict=True)))
    assert abs(model.prior - 0.8) < 0.05
    for j, a in enumerate(accuracy):
        assert abs(model.given[j, 1, 1] - a) < 0.05


def test_quality_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = weak_quality.classify(docs).join(labels, "doc_id").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) > 0.93 * len(good) and sum(bad) < 0.2 * len(bad)


def test_quality_against_brute_force(spark):
    """Votes by plain Python, expectation-maximisation over documents instead of counted patterns, and the scorer's gradient
    steps over dictionaries instead of arrays."""
    r = random.Random(12)
    rows = []
    for i in range(60):
        words = [f"Word{r.randrange(900)}" if r.random() < 0.1 else f"w{r.randrange(900)}ab" for _ in range(r.randrange(3, 60))]
        if i % 5 == 0:
            words = [r.choice(["$$", "##", "x"]) for _ in words]
        if i % 7 == 0:
            words = words[:3] * (len(words) // 3)
        rows.append((i, "\n".join(" ".join(words[j : j + 12]) + ("." if i % 3 else "") for j in range(0, len(words), 12))))
    got = {x["doc_id"]: x for x in weak_quality.classify(docs_df(spark, rows)).collect()}
    for i, t in rows:
        words, lines = t.split(), [x for x in t.split("\n") if x.split()]
        n = len(words)
        chars, upper, marks = sum(map(len, words)), len(re.findall("[A-Z]", t)), len(re.findall("[.!?]", t))
        vote = lambda bad, good: "0" if bad else "1" if good else "2"
        windows = defaultdict(list)
        for j in range(n - 4):
            windows[tuple(words[j : j + 5])].append(j)
        repeated = len({p + k for at in windows.values() if len(at) > 1 for p in at for k in range(5)})
        symbols, stutter, distinct = len(re.findall(r"[#*$%&|<>]", t)), sum(a == b for a, b in zip(words, words[1:], strict=False)), len(set(words))
        lost = 0
        for line in lines:
            k = len(line.split())
            if len(re.findall(r"[#*$%&|<>]", line)) >= 0.3 * k and re.search(r"[#*$%&|<>]", line) or k < 4 and not re.search(r"[.!?]$", line):
                lost += k
        want = [vote(n < 8, n >= 25), vote(symbols > 0.2 * n, symbols == 0), vote(repeated > 0.2 * n, repeated < 0.05 * n), vote(n >= 25 and 6 * distinct < n, 4 * distinct >= n),
                vote(stutter > 0.1 * n, stutter < 0.02 * n), vote(lost > 0.5 * n, lost < 0.2 * n), vote(upper > 0.3 * chars, upper < 0.1 * chars),
                vote(n >= 25 and 60 * marks < n, n >= 25 and 30 * marks >= n), vote(chars < 2.5 * n or chars > 12 * n, 3.5 * n <= chars <= 9 * n)]
        assert got[i]["votes"] == "".join(want), i
    votes = [got[i]["votes"] for i, _ in rows]
    good = [(v.count("1") + 0.5) / (v.count("1") + 2.0 * v.count("0") + 1.0) for v in votes]
    for _ in range(100):
        prior = min(max(sum(good) / len(good), 1e-3), 1 - 1e-3)
        given = [[{s: 1.0 + sum(g if c else 1 - g for g, v in zip(good, votes, strict=True) if v[j] == s) for s in "012"} for c in (0, 1)] for j in range(9)]
        given = [[{s: x / sum(d.values()) for s, x in d.items()} for d in pair] for pair in given]
        now = []
        for v in votes:
            p = [1 - prior, prior]
            for j, s in enumerate(v):
                p = [p[c] * given[j][c][s] for c in (0, 1)]
            now.append(p[1] / sum(p))
        moved, good = max(abs(a - b) for a, b in zip(now, good, strict=True)), now
        if moved < 1e-6:
            break
    assert all(abs(got[i]["posterior"] - g) < 1e-6 for (i, _), g in zip(rows, good, strict=True))

    def kinds(t):
        return [97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in t.encode()]

    feats = []
    for _, t in rows:
        f, k, words = defaultdict(float), kinds(t), t.lower().split()
        for n in (1, 2, 3):
            for j in range(len(k) - n + 1):
                rolled = 0
                for b in k[j : j + n]:
                    rolled = rolled * 257 + b
                f[(((rolled + (n << 40)) * 0x9E3779B97F4A7C15) % (1 << 64)) >> 48] += 10.0 / len(k)
        if len(words) < 10:
            f[77] += 1
        for lag in range(1, 6):
            same = sum(a == b for a, b in zip(words, words[lag:], strict=False))
            if same:
                f[100 + lag] += 10.0 * same / len(words)
        feats.append(f)
    w, seen = defaultdict(float), defaultdict(lambda: 1e-8)
    for _ in range(60):
        g = defaultdict(float)
        for f, y in zip(feats, good, strict=True):
            d = y - 1 / (1 + np.exp(-sum(w[b] * v for b, v in f.items()) - w[-1]))
            for b, v in f.items():
                g[b] += d * v
            g[-1] += d
        for b in {*g, *w}:
            step = g[b] / len(rows) - 1e-4 * w[b]
            seen[b] += step * step
            w[b] += 0.5 * step / np.sqrt(seen[b])
    for (i, _), f in zip(rows, feats, strict=True):
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-sum(w[b] * v for b, v in f.items()) - w[-1]))) < 1e-6, i


def test_quality_edge_cases(spark, odd_rows):
    got = weak_quality.classify(docs_df(spark, odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(r["score"] == 0 and not r["kept"] for r in got if r["doc_id"] in (2, 3, 4))
    assert weak_quality.classify(docs_df(spark, odd_rows).limit(0)).count() == 0


# --- n-gram Jaccard join


def brute_components(rows, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def test_jaccard_brute_force(spark, odd_rows):
    r = random.Random(4)
    near = []
    for g in range(6):
        base = text(100 + g, 80).split()
        for k in range(12):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(80)] = f"x{r.randrange(10**6)}"
            near.append((1000 + 20 * g + k, " ".join(w)))
    rows = near + [x[:2] for x in odd_rows if x[0] is not None]
    got = sorted(tuple(x) for x in ngram_join.members(docs_df(spark, rows), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_jaccard_large_group_with_hosts(spark):
    """More members than a host needs, with stragglers that only some members link to."""
    r, base, rows = random.Random(8), text(77, 120).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
            w[r.randrange(120)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(x) for x in ngram_join.members(docs_df(spark, rows), 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_jaccard_edges(spark, odd_rows):
    df = docs_df(spark, odd_rows + [odd_rows[0]])
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.members(df).collect()}
    assert (None, None) in got and (2, 2) in got and (1, 0) in got and (11, 0) in got
    kept = ngram_join.one_of_each(df)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13]
    assert ngram_join.members(df.limit(0)).count() == 0


def test_jaccard_template_texts_make_few_pairs(spark, monkeypatch):
    """Texts of 91 equal and 9 own words share frequent shingles and don't link: no pair of them may be tried."""
    r, base = random.Random(3), text(55, 91).split()
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(9)] + base)) for i in range(2000)]
    tried = []
    monkeypatch.setattr(ngram_join.NgramJoin, "_proven", lambda self, pairs, rows, old=ngram_join.NgramJoin._proven: (tried.append(rows), old(self, pairs, rows))[1])
    matched = []
    monkeypatch.setattr(ngram_join.NgramJoin, "_all_pairs", lambda self, p, old=ngram_join.NgramJoin._all_pairs: (matched.append(p.filter("cap >= n").count()), old(self, p))[1])
    r.shuffle(rows)
    got = ngram_join.members(docs_df(spark, rows), 4, 85).collect()
    assert all(x["doc_id"] == x["component_id"] for x in got) and sum(tried) <= 2000 and sum(matched) <= 2000


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["comp"]) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# --- token counts


def test_allocation_rules():
    s, e = np.array([0, 4, 4, 10]), np.array([4, 4, 10, 12])
    a, b = np.array([0, 3, 2, 9, 11, 12]), np.array([3, 6, 6, 12, 12, 14])
    assert token_counts.allocate(a, b, s, e, "first").tolist() == [0, 0, 0, 2, 3, -1]
    assert token_counts.allocate(a, b, s, e, "last").tolist() == [0, 2, 2, 3, 3, -1]
    assert token_counts.allocate(a, b, s, e, "majority").tolist() == [0, 2, 0, 3, 3, -1]
    with pytest.raises(ValueError):
        token_counts.allocate(a, b, s, e, "half")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_brute_force(spark, odd_rows, rule):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_file())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [(r[0] + 10**6, r[1]) for r in odd_rows if r[0] is not None]
    df, file = docs_df(spark, rows), queries.tokenizer_file()
    lines = {r["doc_id"]: r for r in token_counts.by_line(df, file, rule).collect()}
    fields = {r["doc_id"]: r for r in token_counts.by_field(df, file, 37, rule).collect()}
    for doc, t, got in [(d, t, g) for d, t in rows for g in (lines, fields)]:
        t = t or ""
        spans, at = [], 0
        for line in t.split("\n") if got is lines else ():
            spans.append((at, at + len(line)))
            at += len(line) + 1
        spans = spans or [(i, min(i + 37, len(t))) for i in range(0, max(1, len(t)), 37)]
        count = [0] * len(spans)
        offsets = tok.encode(t, add_special_tokens=False).offsets
        for a, b in offsets:
            held = [max(0, min(b, y) - max(a, x)) for x, y in spans]
            order = [i for i, h in enumerate(held) if h]
            if order:
                count[order[0] if rule == "first" else order[-1] if rule == "last" else max(order, key=lambda i: (held[i], -i))] += 1
        assert (got[doc]["n_tokens"], got[doc]["section_tokens"]) == (len(offsets), count), doc


def test_spans_cut_words(spark):
    df = spark.createDataFrame([(1, "tokenization matters", [(0, 7), (7, 12), (13, 99)]), (2, "none", None), (3, None, [(0, 5)])], "doc_id long, text string, spans array<struct<s: long, e: long>>")
    got = {r["doc_id"]: r for r in token_counts.by_span(df, queries.tokenizer_file()).collect()}
    assert sum(got[1]["section_tokens"]) == got[1]["n_tokens"] and got[2]["unassigned"] == got[2]["n_tokens"] > 0 and got[3]["section_tokens"] == [0]


# --- chat


def test_escape_is_reversible():
    r = random.Random(2)
    for _ in range(2000):
        s = "".join(r.choice("<|\\>an\n") for _ in range(r.randrange(12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_chat_matches_sql(spark):
    path = f"{SF}/conversations.parquet"
    compare(chat.digest(spark.read.parquet(path)), chat.ORACLE, spark, conversations=path)


def test_chat_machine_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "system", None), (2, 1, "user", "x"), (2, 2, "assistant", "<|im_end|>"), (None, 0, None, "t"), (3, None, "user", ""), (3, 1, "assistant", "é<\\|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", chat.F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    parts = [r["segments"] for r in chat.segments(df.filter("conv_id = 2")).collect()]
    assert [[(p["text"], p["loss"]) for p in x] for x in parts][2] == [("<|im_start|>assistant\n", False), ("<\\|im_end|>", True), ("<|im_end|>\n", False)]
    assert not got[1]["valid"] and got[2]["valid"] and got[3]["valid"] and not got[None]["valid"]
    assert got[2]["loss_sha256"] == hashlib.sha256(b"<|im_end|>").hexdigest() and got[3]["loss_chars"] == 4
    assert got[-1]["n_turns"] == 2 and set(got) == {-1, 1, 2, 3, None}
    assert {r["conv_id"] for r in chat.digest(df.limit(0)).collect()} == {-1}


# --- decontamination


def test_decontamination_matches_sql(spark):
    d, b = f"{SF}/documents.parquet", f"{SF}/benchmark.parquet"
    compare(decontam.digest(spark.read.parquet(d), spark.read.parquet(b)), decontam.ORACLE, spark, documents=d, benchmark=b)


def test_decontamination_odd(spark, odd_rows):
    items = spark.createDataFrame([(1, "A"), (2, None), (3, "..."), (4, odd_rows[0][1]), (40, odd_rows[0][1]), (5, "same same same"), (6, "Straße"), (None, "one two three four")], "item_id long, text string")
    rows = [r for r in odd_rows if r[0] is not None]
    df = docs_df(spark, rows)
    compare(decontam.digest(df, items.filter("item_id is not null")), decontam.ORACLE, spark, documents=df, benchmark=items.filter("item_id is not null"))
    assert decontam.digest(docs_df(spark, odd_rows + [odd_rows[0]]), items).count() == len(odd_rows) + 1
    kept = decontam.clean(docs_df(spark, odd_rows), items)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 2, 3, 4, 6]
    assert not any(r["contaminated"] for r in decontam.digest(df, items.limit(0)).collect()) and decontam.digest(df.limit(0), items).count() == 0


# --- line rules


def test_line_rules_match_sql(spark, odd_rows):
    path = f"{SF}/documents.parquet"
    compare(line_rules.digest(spark.read.parquet(path)), line_rules.ORACLE, spark, documents=path)
    df = docs_df(spark, [r for r in odd_rows if r[0] is not None])
    compare(line_rules.digest(df), line_rules.ORACLE, spark, documents=df)


def test_line_rules_clean(spark):
    body = "This line has quite enough words to be kept by all rules.\n" + text(9, 20) + "."
    df = docs_df(spark, [(1, body + "\nHome | News | Contact | About"), (2, "a | b | c | d | e | f | g | h | i | j | k"), (3, None)]).withColumn("words", chat.F.lit("x"))
    got = line_rules.clean(df).collect()
    assert [(r["doc_id"], r["text"], r["words"]) for r in got] == [(1, body, "x")]
    assert line_rules.clean(df.limit(0)).count() == 0


# --- very long texts


def test_very_long_texts(spark):
    """One text of 150,000 words (and a word of 200,000 letters) beside short ones, through every operator over documents."""
    long_ = text(5, 150_000, 40_000) + "\n" + "x" * 200_000
    rows = [(0, long_, "en", "a"), (1, text(6, 50), "en", "b"), (2, text(5, 150_000, 40_000)[:3000].rsplit(" ", 1)[0], "de", "a")]
    df, items = docs_df(spark, rows), spark.createDataFrame([(1, rows[1][1])], "item_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in substring.digest(df).collect()} == substring.brute_force([r[:2] for r in rows])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.encode_and_read(df, queries.tokenizer_file()).collect()} == brute_tokens([r[:2] for r in rows])
    assert sorted(tuple(r) for r in ngram_join.members(df, 4, 85).collect()) == brute_components([r[:2] for r in rows], 4, 85)
    assert langid.digest(df).count() == weak_quality.classify(df).count() == mixing.counts(df).count() == 3
    assert {r["doc_id"]: r["n_words"] for r in line_rules.digest(df).collect()} == {r[0]: len(r[1].split()) for r in rows}
    assert {r["doc_id"]: r["contaminated"] for r in decontam.digest(df, items).collect()} == {0: False, 1: True, 2: False}
    got = {r["doc_id"]: r for r in token_counts.by_line(df, queries.tokenizer_file()).collect()}
    assert got[0]["n_sections"] == 2 and sum(got[0]["section_tokens"]) == got[0]["n_tokens"]
    assert token_counts.by_line(df.limit(0), queries.tokenizer_file()).count() == 0


def test_crowded_shingles_make_no_row_for_each_pair(spark, monkeypatch):
    """Texts of 5 of 10 passages share many shingles and don't link; those that end in "copy" link with the text before."""
    r, sets = random.Random(6), list(itertools.combinations(range(10), 5))
    rows = []
    for picked in r.sample(sets, 150):
        rows.append((len(rows), " ".join(f"p{b}x{j}" for b in picked for j in range(40))))
        if len(rows) % 8 == 0:
            rows.append((len(rows), rows[-1][1] + " copy"))
    pairs, want = [], brute_components(rows, 4, 85)
    monkeypatch.setattr(ngram_join.NgramJoin, "_all_pairs", lambda self, p, old=ngram_join.NgramJoin._all_pairs: (pairs.append((out := old(self, p)).count()), out)[1])
    for rounds, block in ((0, 1000), (4, 1000), (0, 30)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "SIDE", min(block, 128), raising=False)
        got = ngram_join.NgramJoin(docs_df(spark, rows), 4, 85, rounds).members()
        assert sorted(tuple(r) for r in got.collect()) == want
    assert 150 <= len({r[2] for r in want}) < len(rows) and max(pairs) <= 32 * len(rows), pairs


def test_words_in_use_stay_when_the_word_table_is_full(monkeypatch):
    """A full table forgets only what the present texts don't use; words are asked about together, with equal answers."""
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50)
    encoder = token_files.WordEncoder(queries.tokenizer_file())
    learned = []
    monkeypatch.setattr(token_files.WordEncoder, "_learn", lambda self, keys, *a, old=token_files.WordEncoder._learn: (learned.append(len(keys)), old(self, keys, *a))[1])
    for k in range(3):
        texts = [" ".join([f"common{i} Grün{'ab'[i % 2]}, été." for i in range(60)] + [f"new{k}x{i}" for i in range(10)])]
        raw = [t.encode() for t in texts]
        ids, n = encoder(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert ids.tolist() == [i for t in texts for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids] and n.sum() == len(ids)
    assert learned[1:] == [10, 10]
    words = ["abc", "été", "éa", "ﷺ", "ǅ", "naïve", "İx", "٣x", "中文", "𝔘", "ªb"]
    assert encoder.rules.one_piece_each(words).tolist() == [encoder.rules.one_piece(w) for w in words]
