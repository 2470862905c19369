"""Token-id files: documents in doc_id order, encoded by a public tokenizer, ids packed with Simple-8b.

A file set is a Parquet table (any store that Spark writes, committed by Spark's committer) with one row per pack of about
PACK_IDS ids: shard (range of doc_id), pack, first_id (ids of the shard before this pack), n_ids, doc_ids and doc_sizes
(packed little-endian longs), and ids (see simple8b). Packs hold whole documents. Shards are ranges of (doc_id, text), so
ids before a document are the sums of earlier shards, of its shard's earlier packs and of its pack.

Words between ASCII white space are encoded once in each worker and remembered where the tokenizer's own pre-tokenizer drops
white space and never joins across it (Rules asks it), so the ids are those of the whole text; with any other tokenizer each
text is encoded as a whole.

Defined results: null text is empty (only the end id); a null doc_id comes first; rows that repeat a doc_id are each
written, in order of their texts' hashes (ties are equal texts); very long texts are encoded whole and may fill a pack alone;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import _text as tx
from verdigris.llm import simple8b
from verdigris.llm._work import input_bytes, owned_path, pick

PACK_IDS = 1 << 18
CACHE_WORDS = 400_000
#: Bytes of text in one shard.
SHARD_BYTES = 16 << 20
END_ID = 1
_PACKS = pa.schema([("shard", pa.int64()), ("pack", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("doc_sizes", pa.binary()), ("ids", pa.binary())])
_SCHEMA = "shard long, pack long, first_id long, n_ids long, doc_ids binary, null_ids binary, doc_sizes binary, ids binary"


class IdTable:
    """64-bit keys -> ids, in sorted levels over one pool of ids; with more than CACHE_WORDS keys, those not asked for are forgotten."""

    def __init__(self, dtype: str = "<u4"):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pool, self.used, self.size = np.empty(1 << 16, dtype=self.dtype), 0, 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in the pool (-1: unknown) and number of ids of each key."""
        start, count = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for own, at, n in self.levels:
            spot = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            hit = own[spot] == keys
            start[hit], count[hit] = at[spot[hit]], n[spot[hit]]
        return start, count

    def keep(self, keys: np.ndarray) -> None:
        """Forgets all but these distinct keys."""
        at, n = self.find(keys)
        held = at >= 0
        ids, keys, n = spread(self.pool, at[held], n[held]), keys[held], n[held]
        self.clear()
        self.add(keys, ids, n)

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New distinct keys with count ids each, one after the other in ids."""
        if not len(keys):
            return
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used // 2 + len(ids), dtype=self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.size += len(keys)
        by = np.argsort(keys)
        level = keys[by], start[by], count[by]
        while self.levels and len(self.levels[-1][0]) < 3 * len(level[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True)]
            by = np.argsort(both[0])
            level = tuple(x[by] for x in both)
        self.levels.append(level)


def spread(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[start : start + count] of each, one after the other."""
    return pool[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, a place of each, and each place's value's number."""
    by = np.argsort(h)
    own = h[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    back = np.empty(len(h), dtype=np.int64)
    back[by] = np.cumsum(new) - 1
    return own[new], by[new], back


_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b".,!?;:")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Rules:
    """What a tokenizer's normalizer and pre-tokenizer let an encoder assume; pieces are encoded independently of each other."""

    def __init__(self, tokenizer):
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        kinds = ["ab", "Q", "7", ".", "'s", "é", "中", "<|", "\u0301a"]
        apart = [(a, gap, b) for a in kinds for b in kinds for gap in (" ", "\n", "\t", "\r\n", "  \x0b\x0c ")]
        #: words between ASCII white space can be encoded by themselves
        self.by_word = self.splitter is not None and all(self.pieces(a + gap + b) == self.pieces(a) + self.pieces(b) for a, gap, b in apart)
        letters = "".join(map(chr, range(97, 123)))
        #: words of letters can be known by their folded stem and closing punctuation
        self.by_stem = self.by_word and self.pieces(letters.upper()) == self.pieces(letters) and self.one_piece(letters) and all(self.pieces("ab" + t) == self.pieces("ab") + self.pieces(t) for t in (".", ",", "!", "?", ";", ":", "?!", "..."))

    def pieces(self, text: str) -> list[str]:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [p for p, _ in self.splitter.pre_tokenize_str(text)] if self.splitter else [text]

    def one_piece(self, text: str) -> bool:
        return len(self.pieces(text)) == 1

    def one_piece_each(self, texts: list[str]) -> np.ndarray:
        """one_piece of each text; where words can be encoded by themselves, 4000 texts are asked about at once."""
        out = np.zeros(len(texts), dtype=bool)
        for k in range(0, len(texts), 4000):
            part = texts[k : k + 4000]
            joined = " ".join(part)
            normal = self.normalizer.normalize_str(joined) if self.normalizer else joined
            size = np.array([len(x) for x in normal.split(" ")], dtype=np.int64) + 1
            if not self.by_word or len(size) != len(part):  # not told apart: each by itself
                out[k : k + 4000] = [self.one_piece(x) for x in part]
                continue
            last = np.array([span[1] - 1 for _, span in self.splitter.pre_tokenize_str(normal)], dtype=np.int64)
            owner = np.searchsorted(np.cumsum(size), last, side="right")
            out[k : k + 4000] = np.bincount(owner, minlength=len(part)) == 1
        return out


class WordEncoder:
    """Whole texts -> ids. Where the tokenizer's rules allow, a word is known by the 64-bit hash of its bytes and encoded once.

    Words of letters, with closing punctuation or not, go through their stem: letters and punctuation are different
    pre-tokens, folding ASCII letters leaves the ids as they are, and stems that are one pre-token each are encoded as one
    text and told apart again. All other words are encoded by themselves.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.rules = Rules(self.tokenizer)
        self.words, self.stems, self.tails = IdTable(), IdTable(), {b"": np.empty(0, "<u4")}

    def _alone(self, pieces: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False) if pieces else []
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _learn_stems(self, keys: np.ndarray, raw: bytes, s: np.ndarray, e: np.ndarray) -> None:
        for k in range(0, len(keys), 4000):
            part = raw_join(raw, s[k : k + 4000], e[k : k + 4000])
            got = self.tokenizer.encode(part, add_special_tokens=False)
            n = min(4000, len(keys) - k)
            word = np.array(got.word_ids, dtype=np.int64)
            count = np.bincount(word, minlength=n)
            if len(count) != n or not count.all():  # not told apart: each by itself
                each = self._alone([raw[i:j] for i, j in zip(s[k : k + n].tolist(), e[k : k + n].tolist(), strict=True)])
                self.stems.add(keys[k : k + n], np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64))
                continue
            self.stems.add(keys[k : k + n], np.array(got.ids, dtype="<u4"), count)

    def _learn(self, keys: np.ndarray, data: np.ndarray, raw: bytes, s: np.ndarray, e: np.ndarray) -> None:
        stop = e.copy()
        while True:
            more = (stop > s) & _PUNCT[data[stop - 1]]
            if not more.any():
                break
            stop -= more
        plain, soft = np.zeros(len(s), dtype=bool), np.zeros(len(s), dtype=bool)
        some = np.flatnonzero(stop > s)
        if len(some):
            size = stop[some] - s[some]
            first, byte = np.cumsum(size) - size, spread(data, s[some], size)
            plain[some] = np.logical_and.reduceat(_LETTER[byte], first)
            soft[some] = np.logical_and.reduceat(_LETTER[byte] | (byte >= 128), first)
        if self.rules.by_stem:
            maybe = np.flatnonzero(soft & ~plain)
            known = self.stems.find(tx.word_hashes(data, s[maybe], stop[maybe], True))[0] >= 0
            plain[maybe[known]] = True
            maybe = maybe[~known]
            texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(s[maybe].tolist(), stop[maybe].tolist(), strict=True)]
            letters = np.array([x.isalpha() for x in texts], dtype=bool)
            plain[maybe[letters]] = self.rules.one_piece_each([x for x in texts if x.isalpha()])
        else:
            plain[:] = False
        own = np.flatnonzero(plain)
        if len(own):
            stem = tx.word_hashes(data, s[own], stop[own], True)
            uniq, one = np.unique(stem, return_index=True)
            if self.stems.size > CACHE_WORDS:
                self.stems.keep(uniq)
            new = self.stems.find(uniq)[0] < 0
            self._learn_stems(uniq[new], raw, s[own[one[new]]], stop[own[one[new]]])
            at, n = self.stems.find(stem)
            closed = np.flatnonzero(e[own] > stop[own])
            tails = [raw[i:j] for i, j in zip(stop[own[closed]].tolist(), e[own[closed]].tolist(), strict=True)]
            missing = sorted(set(tails).difference(self.tails))
            self.tails.update(zip(missing, self._alone(missing), strict=True))
            size = np.zeros(len(own), dtype=np.int64)
            size[closed] = [len(self.tails[t]) for t in tails]
            out = np.empty(int((n + size).sum()), dtype="<u4")
            base = np.cumsum(n + size) - (n + size)
            out[np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = spread(self.stems.pool, at, n)
            if size.any():
                out[np.repeat(base + n - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = np.concatenate([self.tails[t] for t in tails])
            self.words.add(keys[own], out, n + size)
        rest = np.flatnonzero(~plain)
        words = [raw[i:j].decode("utf-8", "replace") for i, j in zip(s[rest].tolist(), e[rest].tolist(), strict=True)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []
        count = np.array([len(x) for x in found], dtype=np.int64)
        self.words.add(keys[rest], np.fromiter(itertools.chain.from_iterable(found), "<u4", int(count.sum())), count)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes data, offsets off) and the number of ids of each text."""
        if not self.rules.by_word:
            raw = data.tobytes()
            each = self._alone([raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            return np.concatenate([np.empty(0, "<u4"), *each]), np.array([len(x) for x in each], dtype=np.int64)
        ws, we, first = tx.word_spans(data, off, ~tx.SPACE)
        keys, one, back = _distinct(tx.word_hashes(data, ws, we, False))
        if self.words.size > CACHE_WORDS:
            self.words.keep(keys)
        new = self.words.find(keys)[0] < 0
        if new.any():
            self._learn(keys[new], data, data.tobytes(), ws[one[new]], we[one[new]])
        at, n = self.words.find(keys)
        each = n[back]
        total = np.concatenate([[0], np.cumsum(each)])
        return spread(self.words.pool, at[back], each), np.diff(total[first])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(tokenizer_file: str) -> WordEncoder:
    """This process's encoder: what one task has learned serves the worker's next one."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = WordEncoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def raw_join(raw: bytes, s: np.ndarray, e: np.ndarray) -> str:
    return b" ".join([raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]).decode("utf-8", "replace")


def _write(tokenizer_file: str, end_id: int) -> Callable:
    def run(batches):
        encoder, shard = encoder_of(tokenizer_file), TaskContext.get().partitionId()
        held, pack, first, size = [], 0, 0, 0

        def emit():
            nonlocal held, pack, first, size
            docs = [d for d, _ in held]
            row = {
                "shard": shard, "pack": pack, "first_id": first, "n_ids": size,
                "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(), "null_ids": np.array([d is None for d in docs], np.uint8).tobytes(),
                "doc_sizes": np.array([len(x) // 4 for _, x in held], "<i8").tobytes(), "ids": simple8b.encode(np.frombuffer(b"".join(x for _, x in held), "<u4")),
            }
            pack, first, held, size = pack + 1, first + size, [], 0
            return pa.RecordBatch.from_pylist([row], schema=_PACKS)

        end = np.array([end_id], "<u4").tobytes()
        for table in tx.blocks(batches, limit=4 << 20):
            ids, n = encoder(*tx.column_bytes(table.column("text")))
            raw, stop = ids.tobytes(), np.cumsum(n).tolist()
            for doc, i, j in zip(table.column("doc_id").to_pylist(), [0, *stop[:-1]], stop, strict=True):
                held.append((doc, raw[4 * i : 4 * j] + end))
                size += j - i + 1
                if size >= PACK_IDS:
                    yield emit()
        if held:
            yield emit()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, shards: int | None = None, mode: str = "errorifexists") -> None:
    """Writes the file set of docs (doc_id, text) to path."""
    n = shards or input_bytes(docs) // SHARD_BYTES + 1
    keyed = pick(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(_write(tokenizer_file, end_id), _SCHEMA).write.mode(mode).option("compression", "none").parquet(path)


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = simple8b.decode(row["ids"]).astype("<u4")
            size = np.frombuffer(row["doc_sizes"], "<i8")
            end = np.cumsum(size)
            null = np.frombuffer(row["null_ids"], np.uint8).astype(bool)
            doc = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null)
            each = [ids[i:j] for i, j in zip((end - size).tolist(), end.tolist(), strict=True)]
            yield doc, row, end - size, size, each


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<long>) from a file set."""

    def run(batches):
        for doc, row, before, _, each in _read(batches):
            yield pa.RecordBatch.from_arrays([doc, pa.array([row["shard"]] * len(doc), pa.int64()), pa.array(before + row["first_id"]), pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))], ["doc_id", "shard", "before", "ids"])

    return _placed(spark, path, run, "doc_id long, shard long, before long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from a file set."""

    def run(batches):
        for doc, row, before, size, each in _read(batches):
            crc = [zlib.crc32(np.ascontiguousarray(x).data) for x in each]
            yield pa.RecordBatch.from_arrays([doc, pa.array([row["shard"]] * len(doc), pa.int64()), pa.array(before + row["first_id"]), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "shard", "before", "n_tokens", "ids_crc32"])

    return _placed(spark, path, run, "doc_id long, shard long, before long, n_tokens long, ids_crc32 long")


def _placed(spark: SparkSession, path: str, run: Callable, schema: str) -> DataFrame:
    packs = spark.read.schema(_SCHEMA).parquet(path)
    # one row for each shard: as many as range partitions were asked for
    sums = packs.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.expr("coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0L)").alias("base"))
    out = packs.mapInArrow(run, schema).join(F.broadcast(sums), "shard")
    rest = [c for c in out.columns if c not in ("doc_id", "shard", "before", "base")]
    return out.select("doc_id", (F.col("before") + F.col("base")).alias("start"), *rest)


def encode_and_read(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to a new file set in the shared folder and returns the digests read back from it."""
    spark = docs.sparkSession
    path = owned_path(spark, "ids")
    write_ids(docs, path, tokenizer_file, end_id, mode="append")  # the path is new and empty
    return read_digests(spark, path)
