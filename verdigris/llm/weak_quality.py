"""Quality classifier from weak labels: overlapping heuristic labellers vote, expectation-maximisation estimates each
labeller's accuracy without gold labels, and the posterior labels train a hashed linear scorer.

Votes are DataFrame expressions (0 bad, 1 good, 2 no vote). All documents are counted by vote pattern; there are at most
3 ** labellers patterns, so EM runs on the driver over exact counts of the whole corpus. The scorer learns from a bounded
sample (MAX_TRAIN texts chosen by a hash of the id, each of at most MAX_CHARS characters) and scores every whole text.

Defined results: null or wordless text scores 0 and is not kept; repeated rows get equal results; an empty table
gives no rows; very long texts are scored whole but not learned from; when all posteriors are alike the scorer has no weights and returns them; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import _text as tx
from verdigris.llm import line_rules
from verdigris.llm._work import written

BUCKETS, GRAMS, LAGS, SCALE = 1 << 16, 3, 5, 10.0
MAX_TRAIN, MAX_CHARS, STEPS, RATE, DECAY = 3000, 30_000, 60, 0.5, 1e-4
BAD, GOOD, NONE = 0, 1, 2
U64 = np.uint64

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def labellers() -> dict[str, Column]:
    """Votes over the columns of line_rules.measure and upper, marks (characters), n_distinct, n_stutter (words)."""
    n = F.col("n_words")
    return {
        "length": _vote(n < 8, n >= 25),
        "symbols": _vote(F.col("n_symbols") > 0.2 * n, F.col("n_symbols") == 0),
        "repeats": _vote(F.col("n_repeat_words") > 0.2 * n, F.col("n_repeat_words") < 0.05 * n),
        "variety": _vote((n >= 25) & (6 * F.col("n_distinct") < n), 4 * F.col("n_distinct") >= n),
        "stutter": _vote(F.col("n_stutter") > 0.1 * n, F.col("n_stutter") < 0.02 * n),
        "lines": _vote(F.col("n_lost_words") > 0.5 * n, F.col("n_lost_words") < 0.2 * n),
        "case": _vote(F.col("upper") > 0.3 * F.col("word_chars"), F.col("upper") < 0.1 * F.col("word_chars")),
        "stops": _vote((n >= 25) & (60 * F.col("marks") < n), (n >= 25) & (30 * F.col("marks") >= n)),
        "word_size": _vote((F.col("word_chars") < 2.5 * n) | (F.col("word_chars") > 12 * n), F.col("word_chars").between(3.5 * n, 9 * n)),
    }


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, dk, rk (the row's key), pattern (one digit per labeller)."""
    rows = docs.select(F.struct("doc_id", F.coalesce("doc_id", F.lit(0)).alias("dk"), F.xxhash64("doc_id", "text").alias("rk"), F.regexp_count("text", F.lit("[A-Z]")).alias("upper"), F.regexp_count("text", F.lit("[.!?]")).alias("marks")).alias("k"), "text")
    w = F.col("words")
    stutter = F.size(F.filter(F.transform(w, lambda x, i: F.get(w, i - 1) == x), lambda same: same))
    rows = line_rules.measure(rows, "k", n_distinct=F.size(F.array_distinct(w)), n_stutter=stutter).select("k.*", "*")
    rows = rows.withColumn("upper", F.coalesce("upper", F.lit(0))).withColumn("marks", F.coalesce("marks", F.lit(0)))
    return rows.select("doc_id", "dk", "rk", F.concat(*[v.cast("string") for v in labellers().values()]).alias("pattern"))


@dataclass
class Accuracies:
    prior: float  # share of good documents
    given: np.ndarray  # (labeller, class, vote): probability of a vote

    def posterior(self, pattern: str) -> float:
        """Probability that a document with these votes is good."""
        logs = np.log([1 - self.prior, self.prior])
        for j, v in enumerate(pattern):
            logs = logs + np.log(self.given[j, :, int(v)])
        logs -= logs.max()
        p = np.exp(logs)
        return float(p[1] / p.sum())


def em(counts: dict[str, int], steps: int = 100) -> Accuracies:
    """Dawid and Skene's estimate from counts of vote patterns; starts at the majority vote."""
    patterns = sorted(counts)
    m = len(patterns[0]) if patterns else 0
    votes_ = np.array([[int(c) for c in p] for p in patterns]).reshape(len(patterns), m)
    n = np.array([counts[p] for p in patterns], dtype=float)
    bad, good = (votes_ == BAD).sum(axis=1), (votes_ == GOOD).sum(axis=1)
    q = (good + 0.5) / (good + 2.0 * bad + 1.0)  # a bad vote is rarer and weighs more at the start
    model = Accuracies(0.5, np.full((m, 2, 3), 1 / 3))
    for _ in range(steps if len(patterns) else 0):
        share = np.stack([n * (1 - q), n * q], axis=1)
        prior = float(np.clip(share[:, 1].sum() / n.sum(), 1e-3, 1 - 1e-3))
        given = np.full((m, 2, 3), 1.0)
        for j in range(m):
            for v in range(3):
                given[j, :, v] += share[votes_[:, j] == v].sum(axis=0)
        given /= given.sum(axis=2, keepdims=True)
        model = Accuracies(prior, given)
        now = np.array([model.posterior(p) for p in patterns])
        moved = float(np.abs(now - q).max())
        q = now
        if moved < 1e-6:
            break
    return model


def features(data: np.ndarray, off: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Dense part: for each n, (document, bucket) of every n-gram of byte classes, each worth SCALE over the text's bytes.
    Sparse part: (document, bucket, value) of words equal to one of the LAGS before, and of short texts."""
    docs = len(off) - 1
    kind, size = _CLASS[data], np.diff(off)
    doc = np.repeat(np.arange(docs, dtype=np.int32), size)
    rolled, dense = np.zeros(len(data), dtype=np.uint64), []
    for n in range(1, GRAMS + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        rolled[:m] = rolled[:m] * U64(257) + kind[n - 1 :]
        ok = doc[:m] == doc[n - 1 :]
        dense.append((doc[:m][ok], ((rolled[:m][ok] + U64(n << 40)) * U64(0x9E3779B97F4A7C15) >> U64(48)).astype(np.uint16)))
    ws, we, first = tx.word_spans(data, off, ~tx.SPACE)
    words = np.diff(first)
    h, own = tx.word_hashes(data, ws, we, True), np.repeat(np.arange(docs), words)
    d, b, v = [np.flatnonzero(words < 10)], [np.full((words < 10).sum(), 77)], [np.ones((words < 10).sum())]
    for lag in range(1, LAGS + 1):
        same = np.bincount(own[lag:][(h[lag:] == h[:-lag]) & (own[lag:] == own[:-lag])], minlength=docs) if len(h) > lag else np.zeros(docs)
        has = np.flatnonzero(same)
        d.append(has)
        b.append(np.full(len(has), 100 + lag))
        v.append(SCALE * same[has] / words[has])
    return dense, np.concatenate(d), np.concatenate(b), np.concatenate(v)


def raw_scores(w: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    dense, d, b, v = features(data, off)
    docs = len(off) - 1
    z = np.zeros(docs)
    for doc, bucket in dense:
        z += np.bincount(doc, w[bucket], docs)
    return z * SCALE / np.maximum(np.diff(off), 1) + np.bincount(d, w[b] * v, docs) + w[-1]


def fit_scorer(texts: list[str], good: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on soft labels."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    if not texts:
        return w
    data, off = tx.column_bytes(pa.array(texts, pa.string()))
    dense, d, b, v = features(data, off)
    size = np.maximum(np.diff(off), 1)
    for doc, bucket in dense:
        pair, count = np.unique(doc.astype(np.int64) << 16 | bucket, return_counts=True)
        d, b, v = np.concatenate([d, pair >> 16]), np.concatenate([b, pair & 0xFFFF]), np.concatenate([v, SCALE * count / size[pair >> 16]])
    for _ in range(STEPS):
        z = np.bincount(d, w[b] * v, len(texts)) + w[-1]
        diff = good - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.append(np.bincount(b, diff[d] * v, BUCKETS), diff.sum()) / len(texts) - DECAY * w
        seen += g * g
        w += RATE * g / np.sqrt(seen)
    return w


def _fit_task(batches):
    """Fits in one executor task: the driver only holds the weights."""
    rows = sorted((t, p) for b in batches for t, p in zip(b.column("text").to_pylist(), b.column("posterior").to_pylist(), strict=True))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([fit_scorer([t for t, _ in rows], np.array([p for _, p in rows])).tobytes()], pa.binary())], ["w"])


def _score(shared):
    def run(batches):
        w = shared.value
        for table in tx.blocks(batches, limit=2 << 20):
            data, off = tx.column_bytes(table.column("text"))
            z = raw_scores(w, data, off)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            _, _, first = tx.word_spans(data, off, ~tx.SPACE)
            score[np.diff(first) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("doc_id", "dk", "rk")), pa.array(score)], ["doc_id", "dk", "rk", "score"])

    return run


def classify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, votes (pattern), posterior (of the label model), score (of the scorer), kept (score of 0.5 or more)."""
    spark = docs.sparkSession
    cast = written(votes(docs), "votes")
    counts = {r["pattern"]: r["count"] for r in cast.groupBy("pattern").count().collect()}  # 3 ** labellers rows at most
    model = em(counts)
    known = spark.createDataFrame([(p, model.posterior(p)) for p in sorted(counts)], "pattern string, posterior double")
    label = cast.dropDuplicates(["dk", "rk"]).join(F.broadcast(known), "pattern").select("dk", "rk", "pattern", "posterior")
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("dk"), F.xxhash64("doc_id", "text").alias("rk"), "text")
    share = min(1.0, (3.0 * max_train + 100) / max(1, sum(counts.values())))  # the others' texts are never shuffled
    some = keyed.filter((F.length("text") <= MAX_CHARS) & (F.col("rk").cast("double") / float(1 << 64) + 0.5 <= share))
    chosen = some.orderBy("rk", "dk").limit(max_train).join(label, ["dk", "rk"]).select("text", "posterior").repartition(1)
    got = chosen.mapInArrow(_fit_task, "w binary").first()
    w = np.frombuffer(bytes(got["w"])) if got else fit_scorer([], np.empty(0))
    scored = keyed.mapInArrow(_score(spark.sparkContext.broadcast(w)), "doc_id long, dk long, rk long, score double")
    out = scored.join(label, ["dk", "rk"])
    return out.select("doc_id", F.col("pattern").alias("votes"), "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
