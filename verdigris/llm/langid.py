"""Language ID by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features (hashed over its UTF-8 bytes, A-Z folded) with one weight per
language; transitions between the languages of neighbouring words are learned with them. Forward-backward gives every word of
a text the probability of each language, so code-switched text keeps its parts; a document's language is the one with the
highest mean probability over words that have a letter, and that mean is its score.

Training sees labelled rows only, and a bounded sample of them: MAX_DOCS per language, chosen by a hash of the id, each
of at most MAX_CHARS characters. Their texts are cut into pieces of PIECE words, and pieces of all languages are
shuffled into sequences, so that switches occur in training. Prediction reads every word of every text.

Defined results: null text and text without a letter give und and score 0; unlabelled rows teach nothing; without any
labelled row every text is und; repeated rows get equal results; ties go to the smaller language name; an empty table
gives no rows; very long texts are predicted whole, and texts above MAX_CHARS aren't learned from; other columns, whatever
their names, are kept by classify() and recognised() and ignored by digest().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm import _text as tx
from verdigris.llm._work import pick

U64 = np.uint64
BUCKETS = 1 << 18
MAX_DOCS, MAX_CHARS, PIECE, LENGTH = 600, 30_000, 24, 192
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.2, 1e-5
UND = "und"
_WORDS_AT_ONCE = 10_000


@dataclass
class Model:
    langs: list[str]
    emit: np.ndarray  # (BUCKETS, languages)
    move: np.ndarray  # (languages, languages), log
    lexicon: np.ndarray  # sorted hashes of known words


def _features(data: np.ndarray, ws: np.ndarray, we: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value) of every feature, word by word, and each word's first feature."""
    size = we - ws
    first = np.cumsum(size + 2) - (size + 2)
    total = int((size + 2).sum())
    padded = np.full(total, 32, dtype=np.uint64)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    raw = data[np.repeat(ws, size) + place].astype(np.uint64)
    raw = np.where((raw >= 65) & (raw <= 90), raw + U64(32), raw)
    padded[np.repeat(first + 1, size) + place] = raw
    end = first + size + 2
    word = np.repeat(np.arange(len(ws)), size + 2)
    left = end[word] - np.arange(total)
    cols_w, cols_b, cols_v = [], [], []
    rolled = np.zeros(total, dtype=np.uint64)
    weight = (1.0 / np.maximum(size, 1)).astype(np.float32)
    for n in (1, 2, 3, 4):
        m = total - n + 1
        if m <= 0:
            break
        rolled[:m] = rolled[:m] * U64(257) + padded[n - 1 :]
        ok = np.flatnonzero(left[:m] >= n)
        key = tx.mix(rolled[ok] + U64(n << 56))
        cols_w.append(word[ok])
        cols_b.append(key)
        cols_v.append(weight[word[ok]])
        if n > 1:  # affixes: the n-grams that hold a word's boundary
            for at, salt in ((first, 11), (end - n, 13)):
                has = np.flatnonzero(size + 2 >= n)
                cols_w.append(has)
                cols_b.append(tx.mix(rolled[at[has]] + U64((n + salt) << 56)))
                cols_v.append(np.full(len(has), 0.5, np.float32))
    if len(lexicon):
        spot = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        has = np.flatnonzero(lexicon[spot] == hashes)
        cols_w.append(has)
        cols_b.append(tx.mix(hashes[has] + U64(29)))
        cols_v.append(np.ones(len(has), np.float32))
    w = np.concatenate(cols_w)
    by = np.argsort(w, kind="stable")
    return (np.concatenate(cols_b)[by] % U64(BUCKETS)).astype(np.int64), np.concatenate(cols_v)[by], np.searchsorted(w[by], np.arange(len(ws)))


def _forward_backward(score: np.ndarray, size: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Posteriors of words laid out sequence by sequence (sizes descending not needed); score: (words, L) logs.
    pairs: also the expected number of each transition."""
    langs = score.shape[1]
    order = np.argsort(-size, kind="stable")
    first = (np.cumsum(size) - size)[order]
    size = size[order]
    trans = np.exp(move - move.max()).astype(np.float64)
    local = np.exp(score - score.max(axis=1, keepdims=True))
    fwd, back = np.empty_like(local), np.empty_like(local)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
    at = first.copy()
    now = np.full((len(size), langs), 1.0 / langs)
    for t in range(longest):
        k = active[t]
        p = at[:k] + t
        now = (now[:k] @ trans if t else now[:k]) * local[p]
        now /= now.sum(axis=1, keepdims=True)
        fwd[p] = now
    last = first + size - 1
    expected = np.zeros((langs, langs))
    nxt = np.ones((0, langs))
    for t in range(longest - 1, -1, -1):
        k, had = active[t], len(nxt)
        here = np.ones((k, langs))
        p = first[:k] + t
        if had:
            carried = nxt * local[p[:had] + 1]
            if pairs:
                joint = fwd[p[:had]][:, :, None] * trans * carried[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            here[:had] = carried @ trans.T
            here[:had] /= here[:had].sum(axis=1, keepdims=True)
        back[p] = here
        nxt = here
    del last
    post = fwd * back
    post /= post.sum(axis=1, keepdims=True)
    return (post, expected) if pairs else post


def _scores(model: Model, data: np.ndarray, ws: np.ndarray, we: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Emission logs of each distinct word, spread to all words."""
    _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    out = np.empty((len(one), len(model.langs)), dtype=np.float32)
    for i in range(0, len(one), _WORDS_AT_ONCE):
        pick = one[i : i + _WORDS_AT_ONCE]
        bucket, value, first = _features(data, ws[pick], we[pick], hashes[pick], model.lexicon)
        out[i : i + len(pick)] = np.add.reduceat(model.emit[bucket] * value[:, None], first, axis=0)
    return out[back]


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, language) rows by stochastic gradient ascent on the conditional likelihood."""
    langs = sorted({lang for _, lang in rows})
    index = {lang: i for i, lang in enumerate(langs)}
    count = len(langs)
    col = pa.array([t for t, _ in rows], pa.string())
    data, off = tx.column_bytes(col)
    ws, we, first = tx.word_spans(data, off, ~tx.SPACE)
    hashes = tx.word_hashes(data, ws, we, True)
    label = np.repeat(np.array([index[lang] for _, lang in rows], dtype=np.int64), np.diff(first))
    uniq, one, word, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    lexicon = uniq[times >= 3]
    emit, move = np.zeros((BUCKETS, count), np.float32), np.zeros((count, count))
    model = Model(langs, emit, move, lexicon)
    if not len(ws) or count < 2:
        return model
    parts = []
    for i in range(0, len(one), _WORDS_AT_ONCE):
        own = one[i : i + _WORDS_AT_ONCE]
        b, v, f = _features(data, ws[own], we[own], hashes[own], lexicon)
        parts.append((b.astype(np.int32), v, np.diff(np.append(f, len(b)))))
    bucket, value, spread = (np.concatenate(x) for x in zip(*parts, strict=True))
    start = np.cumsum(spread) - spread
    del parts, hashes
    rng = np.random.default_rng(seed)
    cuts = np.concatenate([np.arange(i, j, PIECE) for i, j in zip(first[:-1], first[1:], strict=True) if j > i])
    ends = np.minimum(cuts + PIECE, first[np.searchsorted(first, cuts, side="right")])
    grad_e, grad_m = np.full(emit.shape, 1e-6, np.float32), np.full(move.shape, 1e-6)
    per = BATCH * LENGTH // PIECE
    for _ in range(EPOCHS):
        by = rng.permutation(len(cuts))
        for i in range(0, len(by), per):
            own = by[i : i + per]
            n = (ends - cuts)[own]
            at = np.repeat(cuts[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            total = len(at)
            size = np.full(-(-total // LENGTH), LENGTH)
            size[-1] = total - LENGTH * (len(size) - 1)
            used, inner = np.unique(word[at], return_inverse=True)
            f = np.repeat(start[used] - (np.cumsum(spread[used]) - spread[used]), spread[used]) + np.arange(int(spread[used].sum()))
            b, v = bucket[f], value[f]
            score = np.add.reduceat(emit[b] * v[:, None], np.cumsum(spread[used]) - spread[used], axis=0)[inner]
            post, expected = _forward_backward(score, size, move, pairs=True)
            truth = label[at]
            diff = -post
            diff[np.arange(total), truth] += 1
            seen = np.zeros_like(move)
            inside = np.ones(total - 1, dtype=bool)
            inside[np.cumsum(size)[:-1] - 1] = False
            np.add.at(seen, (truth[:-1][inside], truth[1:][inside]), 1)
            by_word = [np.bincount(inner, diff[:, k], len(used)) for k in range(count)]
            g = np.stack([np.bincount(b, np.repeat(x, spread[used]) * v, BUCKETS).astype(np.float32) for x in by_word], axis=1) / total - DECAY * emit
            grad_e += g * g
            emit += RATE * g / np.sqrt(grad_e)
            g = (seen - expected) / total - DECAY * move
            grad_m += g * g
            move += RATE * g / np.sqrt(grad_m)
    return model


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def _chosen(rows: DataFrame, max_docs: int) -> DataFrame:
    """At most max_docs rows (lang, text) of each language, by a hash of the row. Rows whose hash is above twice the share
    that is wanted go before anything is shuffled, so a language's ranking sees about 2 * max_docs rows at any size."""
    count = rows.groupBy("lang").count()  # one row per language that is learned
    share = F.least(F.lit(1.0), (2.0 * max_docs + 100) / F.col("count"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(count.select("lang", share.alias("share"))), "lang")
    rows = rows.filter(F.col("h").cast("double") / float(1 << 64) + 0.5 <= F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= max_docs).select("text", "lang")


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Learns from docs (doc_id, text, lang): at most max_docs texts of each language, of at most max_chars each."""
    rows = pick(docs, "doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    got = _chosen(rows, max_docs).repartition(1).mapInArrow(_train_task, "langs array<string>, emit binary, move binary, lexicon binary").first()
    if got is None:
        return train([])
    n = len(got["langs"])
    return Model(list(got["langs"]), np.frombuffer(bytes(got["emit"]), np.float32).reshape(BUCKETS, n), np.frombuffer(bytes(got["move"]), np.float64).reshape(n, n), np.frombuffer(bytes(got["lexicon"]), np.uint64))


def _train_task(batches):
    """Trains in one executor task, so that the driver only ever holds the model, whose size is fixed."""
    rows = sorted((t, lang) for b in batches for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True))
    if rows:
        m = train(rows)
        tx.trim()
        yield pa.RecordBatch.from_arrays([pa.array([m.langs]), pa.array([m.emit.tobytes()], pa.binary()), pa.array([m.move.tobytes()], pa.binary()), pa.array([m.lexicon.tobytes()], pa.binary())], ["langs", "emit", "move", "lexicon"])


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of words that can be letters: ASCII letters and parts of longer characters."""
    return ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128) | (data >= 128)


@dataclass
class Answer:
    """For each text: place of its language in langs (len(langs): und), its mean probability, and the mean over words of the
    probability of each word's own best language."""

    pick: np.ndarray
    score: np.ndarray
    sure: np.ndarray


def _answer(model: Model, data: np.ndarray, off: np.ndarray) -> Answer:
    count = len(model.langs)
    ws, we, first = tx.word_spans(data, off, ~tx.SPACE)
    size = np.diff(first)
    out = Answer(np.full(len(size), count), np.zeros(len(size)), np.zeros(len(size)))
    if not len(ws) or not count:
        return out
    post = _forward_backward(_scores(model, data, ws, we, tx.word_hashes(data, ws, we, True)).astype(np.float64), size[size > 0], model.move)
    lettered = np.add.reduceat(_letters(data).astype(np.int64), ws) > 0
    doc = np.repeat(np.arange(len(size)), size)
    n = np.bincount(doc, lettered, len(size))
    sums = np.stack([np.bincount(doc, post[:, k] * lettered, len(size)) for k in range(count)], axis=1)
    best = np.bincount(doc, post.max(axis=1) * lettered, len(size))
    for i in np.flatnonzero(n):
        raw = data[off[i] : off[i + 1]]
        ascii_ = raw[raw < 128] | 32
        if ((ascii_ >= 97) & (ascii_ <= 122)).any() or any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore")):
            out.pick[i] = int(sums[i].argmax())
            out.score[i] = min(1.0, sums[i].max() / n[i])
            out.sure[i] = min(1.0, best[i] / n[i])
    return out


def predictor(docs: DataFrame, model: Model):
    """A column function text -> struct (lang_pred, score, sure). Only the text goes to Python, in blocks of bytes; the rest
    of a row stays in the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array([*shared.value.langs, UND])
        for column in columns:
            parts = []
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            for table in tx.blocks(iter([batch]), limit=4 << 20):
                x = _answer(shared.value, *tx.column_bytes(table.column("text")))
                parts.append((x.pick, x.score, x.sure))
            pick_, score, sure = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0), np.empty(0))
            yield pa.StructArray.from_arrays([names.take(pa.array(pick_)), pa.array(score), pa.array(sure)], ["lang_pred", "score", "sure"])

    return F.arrow_udf(run, "struct<lang_pred: string, score: double, sure: double>").asNondeterministic()  # evaluated once


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs as a struct, so no name can clash), lang_pred, score and sure."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), predictor(docs, model)("text").alias("p")).select("row", "p.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), predictor(docs, fit(docs))("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def recognised(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs with a letter whose words are told to be of some learned language with that mean probability at least, all
    columns kept. The words of a code-switched text may be of several languages."""
    return classify(docs, fit(docs)).filter((F.col("lang_pred") != UND) & (F.col("sure") >= least)).select("row.*")
