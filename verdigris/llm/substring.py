"""Substring dedup by seed and extend: winnowed anchors join documents, matches are extended over whole windows,
and every word under a window that starts earlier elsewhere is removed.

Seeds: each window of `length` words is keyed by the smallest hash of its `anchor`-word n-grams (winnowing: two equal
windows always share it). Neighbouring windows with one anchor travel as one run: the anchor deals the run to a bucket, and
the run's window hashes let the match be extended to the left and right, word by word, without the text. Equal windows
meet in one bucket; all but the first by (doc_id, start) are repeats, and adjoining ones merge into maximal repeats.

Blocks of documents keep one copy of each window before anything is shuffled, so a passage that a third of all documents
holds arrives once per block, not once per document. A bucket's size is set by the input's size.

Defined results: null text has no words; a null doc_id sorts first; rows that repeat a doc_id are one document (the same
start is not earlier than itself) and each such row is returned; texts shorter than a window lose nothing; very long texts
are whole; an empty table gives no rows; other columns, whatever their names, are ignored. A window hash has 64 bits and meets only hashes of its own bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import _text as tx
from verdigris.llm._work import partition_count, pick

LENGTH, ANCHOR = 20, 10
_NULL = np.iinfo(np.int64).min
_BLOB = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
_SPAN = pa.schema([("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(int(_NULL)).to_numpy(zero_copy_only=False).astype(np.int64)


def _merge(doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal word spans [s, e) under windows that start at `at`; sorted by document and start."""
    if not len(doc):
        return doc, at, at
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], at[first], at[last] + length


def _seeds(table: pa.Table, buckets: int, length: int, anchor: int) -> pa.RecordBatch:
    ids = _ids(table.column("doc_id"))
    order = np.argsort(ids, kind="stable")
    ids, data, off = ids[order], *tx.column_bytes(table.column("text").take(pa.array(order)))
    ws, we, first = tx.word_spans(data, off, tx.SPACE == False)  # noqa: E712
    count = np.diff(first)
    h = tx.word_hashes(data, ws, we, False)
    if len(h) < length:
        return pa.RecordBatch.from_pylist([], schema=_BLOB)
    doc_of = np.repeat(np.arange(len(ids)), count)
    at = np.arange(len(h)) - first[doc_of]
    here = np.flatnonzero((at + length <= count[doc_of])[: len(h) - length + 1])
    key = tx.ngrams(h, length)[here]
    seed = tx.sliding_min(tx.ngrams(h, anchor), length - anchor + 1)[here]
    doc, at = ids[doc_of[here]], at[here]
    # one copy of a window for each block: the first by (doc_id, start)
    by = np.argsort(key, kind="stable")
    k, new = key[by], np.ones(len(by), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    group = np.flatnonzero(new)[np.cumsum(new) - 1] if len(by) else by
    head = by[group] if len(by) else by
    keep = np.zeros(len(here), dtype=bool)
    keep[by[new]] = True
    gone = np.zeros(len(here), dtype=bool)
    gone[by] = ~new & ((doc[head] != doc[by]) | (at[head] != at[by]))
    out: dict[str, list] = {"bucket": [], "kind": [], "n": [], "payload": []}

    def add(bucket: np.ndarray, kind: int, parts: list[np.ndarray], tail=None) -> None:
        by = np.argsort(bucket, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[by])) + 1, [len(by)]]) if len(by) else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            sel = by[i:j]
            out["bucket"].append(int(bucket[sel[0]]))
            out["kind"].append(kind)
            out["n"].append(len(sel))
            out["payload"].append(b"".join(tx.planes(p[sel]) for p in parts) + (tail(sel) if tail else b""))

    d, s, e = _merge(doc[gone], at[gone], length)
    if len(d):
        add((tx.mix(d.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), 1, [d, s.astype(np.int32), e.astype(np.int32)])
    sel = np.flatnonzero(keep)
    if len(sel):
        a, p = seed[sel], here[sel]
        new = np.ones(len(sel), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1) | (doc[sel][1:] != doc[sel][:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(sel)]]))
        while size.max() > 255:
            cut = np.concatenate([start, start[size > 255] + 255])
            start = np.sort(cut)
            size = np.diff(np.concatenate([start, [len(sel)]]))
        keys = key[sel]

        def hashes(runs: np.ndarray) -> bytes:
            n = size[runs]
            return keys[np.repeat(start[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()

        head = sel[start]
        add((tx.mix(a[start]) % np.uint64(buckets)).astype(np.int64), 0, [doc[head], at[head].astype(np.int32), size.astype(np.uint8)], hashes)
    return pa.RecordBatch.from_pydict(out, schema=_BLOB)


def _extend(table: pa.Table, length: int) -> pa.Table:
    docs, starts, sizes, keys, spans = [], [], [], [], [[], [], []]
    for kind, n, raw in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "payload")), strict=True):
        d, s = tx.unplanes(raw, "<i8", n), tx.unplanes(raw[8 * n :], "<i4", n)
        if kind:
            for x, y in zip(spans, (d, s, tx.unplanes(raw[12 * n :], "<i4", n)), strict=True):
                x.append(y)
        else:
            docs.append(d)
            starts.append(s)
            sizes.append(np.frombuffer(raw, np.uint8, n, 12 * n))
            keys.append(np.frombuffer(raw, "<u8", offset=13 * n))
    if docs:
        d, s, n, k = (np.concatenate(x) for x in (docs, starts, sizes, keys))
        n = n.astype(np.int64)
        own = np.cumsum(n) - n
        by = np.lexsort((s, d))
        n2 = n[by]
        base = np.cumsum(n2) - n2
        step = np.arange(n2.sum()) - np.repeat(base, n2)
        k = k[np.repeat(own[by], n2) + step]
        d, s = np.repeat(d[by], n2), np.repeat(s[by], n2) + step
        by = np.argsort(k, kind="stable")  # runs came in order of (doc_id, start): the first of equal keys is the earliest
        kk, new = k[by], np.ones(len(by), dtype=bool)
        new[1:] = kk[1:] != kk[:-1]
        head = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
        gone = np.zeros(len(by), dtype=bool)
        gone[by] = ~new & ((d[head] != d[by]) | (s[head] != s[by]))
        for x, y in zip(spans, _merge(d[gone], s[gone].astype(np.int64), length), strict=True):
            x.append(y)
    cols = [np.concatenate([np.asarray(y, np.int64) for y in x]) if x else np.empty(0, np.int64) for x in spans]
    return pa.Table.from_arrays([pa.array(c) for c in cols], schema=_SPAN)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Word spans [s, e) of each document under windows that also start earlier: doc_id, s, e. Spans may overlap.
    A null doc_id is the smallest long."""
    parts = partition_count(pick(docs, "doc_id", "text"))
    buckets = 4 * parts

    def seeds(batches):
        for table in tx.blocks(batches):
            yield _seeds(table, buckets, length, anchor)

    blobs = pick(docs, "doc_id", "text").mapInArrow(seeds, "bucket long, kind int, n long, payload binary")
    # as many partitions as the bytes need, whatever the session's shuffle partitions are
    return blobs.repartition(parts, "bucket").groupBy("bucket").applyInArrow(lambda t: _extend(t, length), "doc_id long, s long, e long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed, spans (array of {s, e}, what was removed) of each row."""
    spans = repeated_spans(docs, length, anchor).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("k"), F.transform("spans", lambda x: x["s"]).alias("ss"), F.transform("spans", lambda x: x["e"]).alias("ee"))
    left = pick(docs, "doc_id", "text").withColumn("k", F.coalesce(F.col("doc_id"), F.lit(int(_NULL))))
    both = left.join(spans, "k", "left").select("doc_id", "text", "ss", "ee")
    schema = "doc_id long, kept_text string, n_words long, n_removed long, spans array<struct<s: long, e: long>>"
    return both.mapInArrow(_cut, schema)


def _cut(batches):
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for table in tx.blocks(batches):
        kept, count, removed, spans = [], [], [], []
        for text, ss, ee in zip(*(table.column(c) for c in ("text", "ss", "ee")), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n, at, out, cut = len(words), 0, [], []
            for s, e in zip(ss.as_py() or (), ee.as_py() or (), strict=True):
                s, e = min(s, n), min(e, n)
                if e <= at:
                    continue
                s = max(s, at)
                if s > at:
                    out += words[at:s]
                if cut and cut[-1]["e"] == s:
                    cut[-1]["e"] = e
                elif e > s:
                    cut.append({"s": s, "e": e})
                at = e
            out += words[at:]
            kept.append(b" ".join(out).decode("utf-8", "surrogatepass"))
            count.append(n)
            removed.append(n - len(out))
            spans.append(cut)
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)], ["doc_id", "kept_text", "n_words", "n_removed", "spans"])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of remove_repeats: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: For tables without repeated doc_ids.
ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
i as (select doc_id, p0, array_to_string(list_slice(ws, p0, p0 + 19), ' ') as win from (select doc_id, ws, unnest(generate_series(1, len(ws) - 19)) as p0 from w)),
d as (select doc_id, p0 from (select doc_id, p0, row_number() over (partition by win order by doc_id, p0) as k from i) where k > 1),
c as (select distinct doc_id, p from (select doc_id, unnest(generate_series(p0, p0 + 19)) as p from d)),
u as (select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as p from w),
k as (select u.doc_id, string_agg(word, ' ' order by u.p) filter (c.p is null) as kept, count(c.p) as n_removed from u left join c on u.doc_id = c.doc_id and u.p = c.p group by u.doc_id)
select w.doc_id, len(ws)::BIGINT as n_words, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, str]]:
    """The contract by plain loops over distinct ids, for tests."""
    seen: set = set()
    out = {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
