"""Offset-mapped token attribution: a text is encoded once as a whole, and the tokens' character spans are joined to its
sections by interval; what crosses a boundary is allocated by an explicit rule.

Rules: "majority" gives a token to the section that holds most of its characters (the earlier one on a tie), "first" to the
section of its first character, "last" to that of its last. A token outside all sections is counted as unassigned. The
interval join is a binary search of sorted, disjoint section ends, not a comparison of all pairs.

Where the tokenizer's pre-tokenizer drops white space and never joins across it (token_files.Rules asks it), the words between
ASCII white space of a block of texts are encoded once in each worker and their token offsets moved to each place: these are
the offsets of the whole text. With any other tokenizer each text is encoded as a whole.

Defined results: null text has no tokens and one empty section; empty lines are sections of 0 tokens; a token that crosses
a boundary goes by the rule, ties of the majority to the earlier section; repeated rows get equal results; very long texts
are whole; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigris.llm import _text as tx
from verdigris.llm._work import pick
from verdigris.llm.token_files import CACHE_WORDS, IdTable, Rules, spread

RULES = ("majority", "first", "last")
#: Code points of a field.
FIELD = 1000


def allocate(start: np.ndarray, end: np.ndarray, s: np.ndarray, e: np.ndarray, rule: str = "majority") -> np.ndarray:
    """Section of each token (start, end), -1 for none. Sections [s, e) are sorted and disjoint; they may be empty."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    out = np.full(len(start), -1, dtype=np.int64)
    full = np.flatnonzero(e > s)
    if not len(full) or not len(start):
        return out
    fs, fe = s[full], e[full]
    end = np.maximum(end, start + 1)
    one = np.searchsorted(fe, start, side="right")  # first section that ends after the token starts
    two = np.searchsorted(fs, end, side="left") - 1  # last section that starts before the token ends
    hit = np.flatnonzero(one <= two)
    best = (two if rule == "last" else one)[hit]
    if rule == "majority":
        a, b = start[hit], end[hit]
        most = np.minimum(b, fe[best]) - np.maximum(a, fs[best])
        top = two[hit]
        step = best + 1
        while (step <= top).any():
            k = np.flatnonzero(step <= top)
            held = np.minimum(b[k], fe[step[k]]) - np.maximum(a[k], fs[step[k]])
            more = held > most[k]
            best[k[more]], most[k[more]] = step[k[more]], held[more]
            step = step + 1
    out[hit] = full[best]
    return out


class Offsets:
    """Token offsets (code points within the word) of words, known by the 64-bit hash of their bytes and encoded once."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(tokenizer_file), IdTable("<u8")
        self.by_word = Rules(self.tokenizer).by_word

    def whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (code points within the text) of the tokens of all texts, each encoded as a whole, and their number."""
        raw, each = data.tobytes(), []
        for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            each.append(np.array(self.tokenizer.encode(raw[i:j].decode("utf-8", "replace"), add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2))
        flat = np.concatenate([np.empty((0, 2), np.int64), *each])
        return flat[:, 0], flat[:, 1], np.array([len(x) for x in each], dtype=np.int64)

    def __call__(self, data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the tokens of all words, and the number of tokens of each word."""
        keys, one, back = np.unique(tx.word_hashes(data, ws, we, False), return_index=True, return_inverse=True)
        if self.words.size > CACHE_WORDS:
            self.words.clear()
        new = np.flatnonzero(self.words.find(keys)[0] < 0)
        if len(new):
            raw = data.tobytes()
            for k in range(0, len(new), 20_000):
                part = one[new[k : k + 20_000]]
                found = self.tokenizer.encode_batch([raw[i:j].decode("utf-8", "replace") for i, j in zip(ws[part].tolist(), we[part].tolist(), strict=True)], add_special_tokens=False)
                each = [e.offsets for e in found]
                flat = np.array([p for x in each for p in x], dtype=np.uint64).reshape(-1, 2)
                self.words.add(keys[new[k : k + 20_000]], flat[:, 0] << np.uint64(32) | flat[:, 1], np.array([len(x) for x in each], dtype=np.int64))
        at, n = self.words.find(keys)
        pairs = spread(self.words.pool, at[back], n[back])
        return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), n[back]


_KNOWN: dict[str, Offsets] = {}


def offsets_of(tokenizer_file: str) -> Offsets:
    """This process's offsets: what one task has learned serves the worker's next one."""
    if tokenizer_file not in _KNOWN:
        _KNOWN[tokenizer_file] = Offsets(tokenizer_file)
    return _KNOWN[tokenizer_file]


def _spans(data: np.ndarray, off: np.ndarray, offsets: Offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token starts and ends (code points of the block), each token's document, and code points before each byte."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    if not offsets.by_word:
        a, b, k = offsets.whole(data, off)
        place = np.repeat(chars[off[:-1]], k)
        return a + place, b + place, np.repeat(np.arange(len(off) - 1), k), chars
    ws, we, first = tx.word_spans(data, off, ~tx.SPACE)
    a, b, k = offsets(data, ws, we)
    place = np.repeat(chars[ws], k)
    doc = np.repeat(np.repeat(np.arange(len(off) - 1), np.diff(first)), k)
    return a + place, b + place, doc, chars


_COUNTS = "doc_id long, n_tokens long, n_sections long, section_tokens array<long>, unassigned long"


def _lines(data: np.ndarray, off: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (code points of the block) of all lines, and the lines of each text."""
    line, docs = np.flatnonzero(data == 10), len(off) - 1
    # a section starts at each document and after each line end; ends likewise
    s, e = np.concatenate([off[:-1], line + 1]), np.concatenate([line, off[1:]])
    inside = np.searchsorted(off, line, side="right") - 1
    owner, ender = np.concatenate([np.arange(docs), inside]), np.concatenate([inside, np.arange(docs)])
    return chars[s[np.lexsort((s, owner))]], chars[e[np.lexsort((e, ender))]], np.bincount(owner, minlength=docs)


def _fields(data: np.ndarray, off: np.ndarray, chars: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _lines, for fields of size code points; an empty text is one empty field."""
    held = np.diff(chars[off])
    count = np.maximum(1, -(-held // size))
    base = np.repeat(chars[off[:-1]], count)
    s = base + size * (np.arange(len(base)) - np.repeat(np.cumsum(count) - count, count))
    return s, np.minimum(s + size, np.repeat(chars[off[1:]], count)), count


def _attributed(docs: DataFrame, tokenizer_file: str, rule: str, sections) -> DataFrame:
    def run(batches):
        offsets = offsets_of(tokenizer_file)
        for table in tx.blocks(batches, limit=2 << 20):
            data, off = tx.column_bytes(table.column("text"))
            a, b, doc, chars = _spans(data, off, offsets)
            s, e, count = sections(data, off, chars)
            section = allocate(a, b, s, e, rule)
            yield _rows(table, doc, section, np.bincount(section[section >= 0], minlength=len(s)), count, table.num_rows)

    return pick(docs, "doc_id", "text").mapInArrow(run, _COUNTS)


def by_line(docs: DataFrame, tokenizer_file: str, rule: str = "majority") -> DataFrame:
    """doc_id, n_tokens, n_sections, section_tokens (array<long>), unassigned: tokens of each line of each text."""
    return _attributed(docs, tokenizer_file, rule, _lines)


def by_field(docs: DataFrame, tokenizer_file: str, size: int = FIELD, rule: str = "majority") -> DataFrame:
    """As by_line, for fields of size code points, whose boundaries cut tokens."""
    return _attributed(docs, tokenizer_file, rule, lambda data, off, chars: _fields(data, off, chars, size))


def by_span(docs: DataFrame, tokenizer_file: str, rule: str = "majority") -> DataFrame:
    """As by_line, for the sections of column spans (array<struct<s, e>>, code points, sorted and disjoint; null: none)."""

    def run(batches):
        offsets = offsets_of(tokenizer_file)
        for table in tx.blocks(batches, limit=2 << 20):
            data, off = tx.column_bytes(table.column("text"))
            a, b, doc, chars = _spans(data, off, offsets)
            spans = [x or [] for x in table.column("spans").to_pylist()]
            lines = np.array([len(x) for x in spans], dtype=np.int64)
            size = np.diff(chars[off])
            base = np.repeat(chars[off[:-1]], lines)
            most = np.repeat(size, lines)
            s = base + np.minimum(np.array([y["s"] for x in spans for y in x], dtype=np.int64), most)
            e = base + np.minimum(np.array([y["e"] for x in spans for y in x], dtype=np.int64), most)
            section = allocate(a, b, s, e, rule)
            yield _rows(table, doc, section, np.bincount(section[section >= 0], minlength=len(s)), lines, table.num_rows)

    return pick(docs, "doc_id", "text", "spans").mapInArrow(run, _COUNTS)


def _rows(table: pa.Table, doc: np.ndarray, section: np.ndarray, count: np.ndarray, lines: np.ndarray, docs: int) -> pa.RecordBatch:
    total = np.bincount(doc, minlength=docs)
    lost = np.bincount(doc[section < 0], minlength=docs)
    ends = np.concatenate([[0], np.cumsum(lines)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int64)))
    return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(total.astype(np.int64)), pa.array(lines.astype(np.int64)), lists, pa.array(lost.astype(np.int64))], ["doc_id", "n_tokens", "n_sections", "section_tokens", "unassigned"])
