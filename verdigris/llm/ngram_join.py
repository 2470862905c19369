"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

1. Every text becomes the set of its distinct n-word shingles (64-bit hashes). Documents with one set are one node,
   named by a fingerprint of the set; only nodes are joined.
2. Shingles are ordered by rarity: 2**FREQ_BITS counters hold how often each hash class occurs in the whole corpus, as one of
   16 levels relative to the mean class (their size is fixed, so they may be broadcast). Any fixed order gives exact results;
   this one keeps frequent shingles out of the prefixes.
3. Two sets of sizes x and y can only reach the threshold if they share one of the first x - ceil(t x) + 1 shingles.
   Prefix postings are dealt by shingle (those of a frequent hash class by shingle and node), and a shingle with one node
   is dropped where it arrives. A posting at place p of a set of n can only be the first shared one with sets of at most
   cap = (n - p) (1 + t) / t - n items (length and positional filter in one number); postings whose shingle has no
   set that small, or none large enough, go too.
4. Links are looked for in rounds. In each, a node is tried against a leader or two of its postings that are in other
   components (the first time the leader that most of them name, then leaders drawn by a hash), so that a group of thousands
   of near copies needs a few pairs per node, not all pairs. What verifies joins components. Rounds end when few trials
   succeed. What is left is complete: where one component holds many postings of a shingle, the other nodes there are
   verified against blocks of that component's sets by counting shared items, without a row for each pair; nodes of many
   components that crowd at one shingle are verified against one another in blocks in the same way; all other pairs of
   nodes in different components are joined on (shingle, size class), the smaller set asking only the classes up to its
   cap. A pair that was tried before isn't tried again. No link between different components is lost, and pairs inside one
   component need no proof.
5. Pairs are verified star by star (a leader and the nodes that name it), from the texts, each of which is shipped once
   for a star: the suffix filter bounds the overlap behind the first shared shingle by splitting both suffixes at a probe,
   and what passes is verified by counting shared items of the whole sets.

Defined results: null or wordless text has an empty set and links with nothing; fewer words than n form one shingle;
rows that repeat a doc_id are separate rows with one id; a null doc_id is kept and sorts after all others when the
component's smallest id is taken; very long texts are whole sets like others; ties of rarity go by hash; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm import _text as tx
from verdigris.llm._work import discard, maybe_broadcast, narrow, partition_count, pick, written

FREQ_BITS, SLICES, FAN = 26, 256, 64
#: Counts from which a class has level 0, 1, ..., for a mean of up to 2; they grow with the mean.
LEVELS = (0, 1, 2, 3, 4, 6, 9, 15, 30, 100, 300, 1_000, 10_000, 100_000, 1_000_000, 100_000_000)
#: Rounds of trials at most, and the share of trials that must succeed for another one.
ROUNDS, WORTH = 4, 0.2
#: Postings of one component from which it is a shingle's host, sets of each side in one block, shingles in one task's group.
HOST, BLOCK, GROUP = 16, 1000, 400_000
#: Postings outside the host from which a shingle is crowded, and sets of each side in its blocks while there are few of them.
CROWD, SIDE = 32, 128
#: Postings of a frequent hash class in one part, times the mean class from which a class is frequent, depth of the suffix filter.
PART, FREQUENT, DEPTH = 100_000, 8, 2
BYTES = 4 << 20
U64 = np.uint64
_DOCS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("raw", pa.binary())])
_DOCS_SQL = "kind int, doc_id long, th long, node long, check long, n long, part int, raw binary"
_SLOTS = 1 << FREQ_BITS


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles of each text, sorted."""
    ws, we, first = tx.word_spans(data, off, tx.SPACE == False)  # noqa: E712
    h, count = tx.word_hashes(data, ws, we, True), np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    g = tx.ngrams(h, n)
    at = np.arange(len(g))
    own = doc[: len(g)]
    ok = at + n <= first[1:][own] if len(g) else np.empty(0, bool)
    doc, g = own[ok], g[ok]
    for k in range(1, n):  # fewer words than n: the whole sequence
        few = np.flatnonzero(count == k)
        if len(few):
            rolled = tx.ngrams(h, k)
            doc, g = np.concatenate([doc, few]), np.concatenate([g, tx.mix(rolled[first[few]] ^ U64(k))])
    by = _grouped(doc, np.argsort(g), len(count))
    doc, g = doc[by], g[by]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def _grouped(doc: np.ndarray, by: np.ndarray, docs: int) -> np.ndarray:
    """The order by, document by document (16-bit keys are sorted in linear time)."""
    own = doc[by]
    return by[np.argsort(own.astype(np.uint16) if docs < 1 << 16 else own, kind="stable")]


def _nodes(doc: np.ndarray, g: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, first items, and two 64-bit fingerprints of each set."""
    size = np.bincount(doc, minlength=docs).astype(np.int64)
    first = np.cumsum(size) - size
    prints = []
    for salt in (0x1234567, 0x89ABCDEF12345):
        total = np.concatenate([[U64(0)], np.cumsum(tx.mix(g + U64(salt)), dtype=np.uint64)])
        prints.append(tx.mix((total[first + size] - total[first]) + size.astype(np.uint64)).view(np.int64))
    return size, first, prints[0], prints[1]


def _slot(g: np.ndarray) -> np.ndarray:
    return (g >> U64(20)).astype(np.int64) & (_SLOTS - 1)


def _level(counters: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Levels of shingles; two classes share a byte of the counters."""
    slot = _slot(g)
    return (counters[slot >> 1] >> ((slot & 1) << 2).astype(np.uint8)) & 15


def _levels(mean: float) -> np.ndarray:
    return np.array(LEVELS) * max(1.0, mean / 2)


def _scan(n: int):
    def run(batches):
        counters = np.zeros(_SLOTS, dtype=np.uint8)
        for table in tx.blocks(batches, limit=BYTES):
            docs = table.num_rows
            doc, g = shingle_sets(*tx.column_bytes(table.column("text")), n)
            size, _, node, check = _nodes(doc, g, docs)
            slot = np.sort(_slot(g))
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else slot
            slot, times = slot[first], np.diff(np.append(first, len(slot)))
            counters[slot] = np.minimum(counters[slot] + times, 255)  # of one task; a class this frequent is so in most
            ids, th = (table.column(c).combine_chunks().cast(pa.int64()) for c in ("doc_id", "th"))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(docs, np.int32)), ids, th, pa.array(node), pa.array(check), pa.array(size), pa.nulls(docs, pa.int32()), pa.nulls(docs, pa.binary())], schema=_DOCS)
        if counters.any():
            task = TaskContext.get().partitionId()
            raw = [_packed(x) for x in counters.reshape(SLICES, -1)]
            k = len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), *[pa.nulls(k, pa.int64())] * 4, pa.array(np.full(k, task)), pa.array(np.arange(k, dtype=np.int32)), pa.array(raw)], schema=_DOCS)

    return run


def _packed(x: np.ndarray) -> bytes:
    most = int(x.max())
    return zlib.compress(x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    x = zlib.decompress(raw)
    return np.frombuffer(x, f"<u{len(x) * SLICES // _SLOTS}")


def _add_slices(table: pa.Table) -> pa.Table:
    """The sum of at most FAN tasks' counters of one slice."""
    total = np.zeros(_SLOTS // SLICES, dtype=np.uint64)
    for x in table.column("raw"):
        total += _unpacked(x.as_py())
    raw = _packed(np.minimum(total, 0xFFFFFFFF))
    return pa.table({"part": table.column("part")[:1], "n": pa.array([table.column("n")[0].as_py() // FAN], pa.int64()), "raw": pa.array([raw], pa.binary())})


def _scaled(mean: float):
    def run(table: pa.Table) -> pa.Table:
        """A slice's counters as levels, two to a byte."""
        level = (np.searchsorted(_levels(mean), _unpacked(table.column("raw")[0].as_py()), side="right") - 1).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "raw": pa.array([zlib.compress((level[::2] | level[1::2] << 4).tobytes(), 1)], pa.binary())})

    return run


def _needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set must share with any set it links to."""
    return -(-size * percent // 100)


def _parts(mean: float) -> np.ndarray:
    """Parts into which the postings of a class are dealt, by its level."""
    times = _levels(mean)
    return np.where((times > FREQUENT * mean) & (times > PART), np.ceil(times / PART), 1).astype(np.uint64)


def _prefixes(n: int, percent: int, buckets: int, frequency, parts: np.ndarray):
    out_schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        counters = frequency.value
        for table in tx.blocks(batches, limit=BYTES):
            docs = table.num_rows
            doc, g = shingle_sets(*tx.column_bytes(table.column("text")), n)
            if not len(g):
                continue
            size, first, node, _ = _nodes(doc, g, docs)
            _, one = np.unique(node, return_index=True)  # one document of each set in this block
            chosen = np.zeros(docs, dtype=bool)
            chosen[one] = True
            rare = _level(counters, g)
            by = _grouped(doc, np.argsort(rare, kind="stable"), docs)  # items came in order of their hashes
            g, rare = g[by], rare[by]
            place = np.arange(len(g)) - first[doc]
            sel = np.flatnonzero(chosen[doc] & (place < (size - _needed(size, percent) + 1)[doc]))
            token, place, d, split = g[sel], place[sel].astype(np.int32), doc[sel], parts[rare[sel]]
            bucket = (tx.mix(token + node[d].view(np.uint64) % split) % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[by])) + 1, [len(by)]])
            rows: dict[str, list] = {"bucket": [], "n": [], "payload": []}
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                s = by[i:j]
                rows["bucket"].append(int(bucket[s[0]]))
                rows["n"].append(len(s))
                many = np.where(split[s] > 1, -1, 1).astype(np.int32)  # a negative size marks a class that is dealt in parts
                rows["payload"].append(token[s].tobytes() + node[d[s]].tobytes() + tx.planes(size[d[s]].astype(np.int32) * many) + tx.planes(place[s]))
            yield pa.RecordBatch.from_pydict(rows, schema=out_schema)

    return run


def _postings(table: pa.Table) -> pa.Table:
    """Postings of the shingles that two nodes or more hold, or may hold because their class is dealt in parts."""
    cols: list[list] = [[], [], [], []]
    for n, raw in zip(table.column("n").to_pylist(), table.column("payload").to_pylist(), strict=True):
        for c, x in zip(cols, (np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), tx.unplanes(raw[16 * n :], "<i4", n), tx.unplanes(raw[20 * n :], "<i4", n)), strict=True):
            c.append(x)
    token, node, size, place = (np.concatenate(c) for c in cols)
    by = np.lexsort((node, token))
    token, node, size, place = token[by], node[by], size[by], place[by]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, size, place = token[new], node[new], size[new], place[new]
    head = np.ones(len(token), dtype=bool)
    head[1:] = token[1:] != token[:-1]
    many = (np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] > 1) | (size < 0)
    return pa.table({"token": token[many], "node": node[many], "n": np.abs(size[many]).astype(np.int64), "place": place[many].astype(np.int64)})


def _most(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Upper bound of the number of equal items of two sorted arrays: both are split at the middle item of the longer one."""
    if not depth or len(x) < 4 or len(y) < 4:
        return min(len(x), len(y))
    if len(x) < len(y):
        x, y = y, x
    probe = x[len(x) // 2]
    (a, b), (c, d) = ((int(np.searchsorted(z, probe, side)) for side in ("left", "right")) for z in (x, y))
    return _most(x[:a], y[:c], depth - 1) + min(b - a, d - c) + _most(x[b:], y[d:], depth - 1)


def _sets_of(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of the rows' texts, and each row's first item and number of items; null and empty texts have none."""
    doc, g = shingle_sets(*tx.column_bytes(table.column("text")), n)
    size = np.bincount(doc, minlength=table.num_rows).astype(np.int64)
    return g, np.cumsum(size) - size, size


def _stars(n: int, percent: int, frequency):
    def run(table: pa.Table) -> pa.Table:
        """The links of a group of stars: rows are leaders (lead) and the nodes to be tried against them, part by part."""
        counters = frequency.value
        g, first, size = _sets_of(table, n)
        row = np.repeat(np.arange(table.num_rows), size)
        rank = (_level(counters, g).astype(np.uint64) << U64(60)) | (g >> U64(4))  # the global order
        rank = rank[np.lexsort((rank, row))]
        star, part, node = (table.column(c).to_numpy() for c in ("star", "part", "node"))
        lead = table.column("lead").to_numpy(zero_copy_only=False).astype(bool)
        leader = {(s, p): i for s, p, i in zip(star[lead].tolist(), part[lead].tolist(), np.flatnonzero(lead).tolist(), strict=True)}
        a, b = [], []
        for i in np.flatnonzero(~lead).tolist():
            j = leader[star[i], part[i]]
            x, y = rank[first[i] : first[i] + size[i]], rank[first[j] : first[j] + size[j]]
            need = -(-percent * (len(x) + len(y)) // (100 + percent))
            px, py = x[: len(x) - need + 1], y[: len(y) - need + 1]
            if not len(px) or not len(py):
                continue
            at = np.minimum(np.searchsorted(py, px), len(py) - 1)
            shared = np.flatnonzero(py[at] == px)
            if not len(shared):
                continue
            p, q = int(shared[0]) + 1, int(at[shared[0]]) + 1  # behind the first shared item
            if 1 + _most(x[p:], y[q:], DEPTH) < need:
                continue
            x, y = g[first[i] : first[i] + size[i]], g[first[j] : first[j] + size[j]]
            same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * same >= percent * (len(x) + len(y) - same):
                a.append(int(node[i]))
                b.append(int(node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _matches(table: pa.Table, n: int, percent: int, members: np.ndarray, guests: np.ndarray):
    """Each guest row and the member rows whose sets link with its own, found by counting shared items."""
    g, first, size = _sets_of(table, n)
    held = size[members]
    owner = np.repeat(np.arange(len(members)), held)
    flat = g[np.repeat(first[members] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))]
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    for i in guests.tolist() if len(members) else []:
        own = g[first[i] : first[i] + size[i]]
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        k = hi - lo
        hits = owner[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        shared = np.bincount(hits, minlength=len(members))
        yield i, members[100 * shared >= percent * (held + len(own) - shared)]


def _found(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _linked(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """One link, if there is one, of each guest set (side 1) to the member sets (side 0) of a block."""
        side = table.column("side").to_numpy()
        node = table.column("node").to_numpy()
        each = _matches(table, n, percent, np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        return _found([(int(node[i]), int(node[ok[0]])) for i, ok in each if len(ok)])

    return run


def _joined(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """The links of a block (side 0 with side 1; alone, side 0 with itself) that join what is not yet connected."""
        side = table.column("side").to_numpy()
        node = table.column("node").to_numpy()
        label = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        members, guests = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        for i, ok in _matches(table, n, percent, members, guests if len(guests) else members):
            for comp, at in zip(*np.unique(label[ok], return_index=True), strict=True):
                if comp != label[i]:
                    out.append((int(node[i]), int(node[ok[at]])))
                    label[label == comp] = label[i]
        return _found(out)

    return run


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """node, comp (smallest node reachable) of all nodes of edges (a, b), rows at most: minimum labels with pointer jumping.

    Each step is a written table. A step joins every node's label to its neighbours and then takes the label's label, so
    the steps grow with the logarithm of a component's diameter.
    """
    rows = rows or edges.count()
    both = narrow(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), name, 2 * rows)
    label = narrow(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), name, 2 * rows)
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        hop = label.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        moved = narrow(step.join(hop, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("new"), "comp"), name, 2 * rows)
        changed = moved.filter("new <> comp").limit(1).count()
        discard(label)
        label = moved.select("node", F.col("new").alias("comp"))
        label._verdigris_path = moved._verdigris_path
        if not changed:
            discard(both)
            return label


class NgramJoin:
    """Links between distinct n-shingle sets of docs (doc_id, text) at a Jaccard similarity of percent / 100 or more."""

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80, rounds: int = ROUNDS):
        self.n, self.percent, self.rounds = n, percent, rounds
        self.docs = pick(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
        self.spark = docs.sparkSession
        self.tried: list[DataFrame] = []
        self.spent: list[DataFrame] = []

    def _kept(self, table: DataFrame) -> DataFrame:
        """A table that goes when all links are found."""
        self.spent.append(table)
        return table

    def _prepare(self) -> None:
        scanned = written(self.docs.mapInArrow(_scan(self.n), _DOCS_SQL), "sets")
        self.rows = scanned.filter("kind = 0").select("doc_id", "th", "node", "check", "n")
        slices = scanned.filter("kind = 1").select("part", "n", "raw")
        tasks = (slices.agg(F.max("n")).first()[0] or 0) + 1
        while True:  # a tree of sums, FAN tasks at a time
            slices = slices.groupBy("part", F.expr(f"n div {FAN}")).applyInArrow(_add_slices, "part int, n long, raw binary")
            tasks = -(-tasks // FAN)
            if tasks == 1:
                break
        mean = float(self.rows.agg(F.sum("n")).first()[0] or 0) / _SLOTS
        # SLICES rows: the counters' size is fixed by FREQ_BITS
        counters = np.zeros((SLICES, _SLOTS // SLICES // 2), dtype=np.uint8)
        for s in slices.groupBy("part").applyInArrow(_scaled(mean), "part int, raw binary").toLocalIterator():
            counters[s["part"]] = np.frombuffer(zlib.decompress(bytes(s["raw"])), np.uint8)
        self.frequency, self.split = self.spark.sparkContext.broadcast(counters.reshape(-1)), _parts(mean)
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("rep")
        classes = self.rows.filter("n > 0").groupBy("node", "n").agg(rep, F.min("check").alias("lo"), F.max("check").alias("hi"))
        self.classes = narrow(classes.select("node", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "lo", "hi"), "classes", self.rows.count())
        if self.classes.filter("lo <> hi").limit(1).count():
            raise RuntimeError("two different shingle sets have one 64-bit fingerprint")

    def _find_postings(self) -> None:
        """Postings that can be a pair's first shared one, with their cap, and the texts of their nodes."""
        t, parts = self.percent, partition_count(self.docs, 1.0)
        buckets = 4 * parts
        blobs = self.docs.mapInArrow(_prefixes(self.n, t, buckets, self.frequency, self.split), "bucket long, n long, payload binary")
        raw = written(blobs.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_postings, "token long, node long, n long, place long"), "postings")
        capped = raw.select("token", "node", "n", F.expr(f"(n - place) * {100 + t} div {t} - n").alias("cap"))
        token = capped.groupBy("token").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("held"))
        alive = capped.join(token.filter("held > 1"), "token").filter(f"cap >= lo and 100 * hi >= {t} * n")
        self.postings = self._kept(written(alive.select("token", "node", "n", "cap"), "alive"))
        discard(raw)
        self.held = self.postings.count()  # no later table of nodes or tried pairs has more rows
        wanted = maybe_broadcast(narrow(self.postings.select("node").distinct().join(self.classes, "node").select("node", F.col("rep").alias("w_id"), F.col("th").alias("w_th")), "wanted", self.held))
        texts = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("node", "text")
        self.texts = self._kept(written(texts, "texts"))
        if self.texts.count() != wanted.count():  # rows that repeat an id and a text
            self.texts = self._kept(written(self.texts.dropDuplicates(["node"]), "texts"))

    def _proven(self, pairs: DataFrame, rows: int) -> DataFrame:
        """Those pairs (a, na, b, nb; rows of them) that link, as (a, b)."""
        star = pairs.groupBy("b").agg((F.expr(f"sum(na) div {GROUP // 2}") + F.expr(f"count(*) div {BLOCK}") + 1).alias("parts"))
        dealt = pairs.join(star, "b").withColumn("part", F.expr("pmod(xxhash64(a), parts)"))
        total = pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0
        own = dealt.select(F.col("a").alias("node"), F.col("b").alias("star"), "part", F.lit(False).alias("lead"))
        leaders = dealt.select(F.col("b").alias("node"), F.col("b").alias("star"), "part", F.lit(True).alias("lead")).distinct()
        placed = narrow(own.union(leaders).withColumn("bucket", F.expr(f"pmod(xxhash64(star, part), {total // GROUP + 1})")), "stars", 2 * rows)
        stars = self.texts.join(maybe_broadcast(placed), "node").groupBy("bucket")
        found = narrow(stars.applyInArrow(_stars(self.n, self.percent, self.frequency), "a long, b long"), "links", rows)
        discard(placed)
        return self._kept(found)

    def _hosted(self, p: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """p with flag hosted (the posting belongs to its shingle's host component), and the links of all other nodes at
        such shingles to any member of the host."""
        own = p.groupBy("token", "comp").agg(F.count("node").alias("held"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("cap").alias("room"))
        host = own.groupBy("token").agg(F.max(F.struct("held", "comp", "lo", "hi", "room")).alias("h")).filter(F.col("h.held") >= HOST)
        flagged = self._kept(written(p.join(host, "token", "left").withColumn("hosted", F.coalesce(F.col("comp") == F.col("h.comp"), F.lit(False))), "flagged"))
        t = self.percent
        near = f"h is not null and not hosted and 100 * h.hi >= {t} * n and 100 * n >= {t} * h.lo and cap >= h.lo and h.room >= n"
        guests = self._kept(narrow(flagged.filter(near).select(F.col("h.comp").alias("host"), "node", "n").distinct(), "guests", self.held))
        members = label.join(guests.select(F.col("host").alias("comp")).distinct(), "comp").join(self.classes, "node").select(F.col("comp").alias("host"), "node", "n")
        blocks = F.greatest(F.ceil(F.count("node") / BLOCK), F.ceil(F.sum("n") / GROUP))
        size = guests.groupBy("host").agg(blocks.alias("gs")).join(members.groupBy("host").agg(blocks.alias("ms")), "host")
        sides = []
        for side, rows, mine, other in ((0, members, "ms", "gs"), (1, guests, "gs", "ms")):
            dealt = rows.join(size, "host").withColumn("i", F.pmod(F.xxhash64("node"), F.col(mine))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
            m, g = ("i", "j") if side == 0 else ("j", "i")
            sides.append(dealt.select("host", F.col(m).alias("m"), F.col(g).alias("g"), F.lit(side).alias("side"), "node"))
        placed = self._kept(narrow(sides[0].union(sides[1]), "blocks"))
        found = self.texts.join(maybe_broadcast(placed), "node").groupBy("host", "m", "g").applyInArrow(_linked(self.n, t), "a long, b long")
        return flagged, self._kept(narrow(found, "links"))

    def _crowded(self, p: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings of shingles that are not crowded, and links that join all linking nodes at each crowded shingle."""
        size = p.groupBy("token").agg(F.count("node").alias("held"), F.sum("n").alias("items")).filter(F.col("held") >= CROWD)
        blocks = F.expr(f"greatest(ceil(held / {BLOCK}), ceil(items / {GROUP}), least(ceil(held / {SIDE}), {BLOCK // SIDE + 1}))")
        crowds = maybe_broadcast(self._kept(narrow(size.select("token", blocks.alias("k")), "crowds", self.held // CROWD)))
        dealt = p.join(crowds, "token").withColumn("own", F.expr("pmod(xxhash64(node), k)")).withColumn("other", F.explode(F.expr("sequence(0L, k - 1)")))
        placed = self._kept(narrow(dealt.select("token", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "comp"), "blocks"))
        found = self.texts.join(maybe_broadcast(placed), "node").groupBy("token", "one", "two").applyInArrow(_joined(self.n, self.percent), "a long, b long")
        return p.join(crowds, "token", "left_anti"), self._kept(narrow(found, "links"))

    def _labelled(self, label: DataFrame | None) -> DataFrame:
        """Postings with their node's component, without shingles held by one component only."""
        if label is None:
            return self.postings.withColumn("comp", F.col("node"))
        p = self.postings.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = p.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
        return p.join(mixed, "token", "left_semi")

    def _fresh(self, pairs: DataFrame) -> DataFrame:
        """Pairs that no round has tried."""
        if not self.tried:
            return pairs
        before = reduce(DataFrame.union, [t.select("a", "b") for t in self.tried]).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        keyed = pairs.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
        return keyed.join(before, ["x", "y"], "left_anti").drop("x", "y")

    def _trials(self, p: DataFrame, k: int) -> DataFrame:
        """Pairs of a round: each node and one leader of its postings (two after the first round)."""
        own = F.struct("comp", "node", "n", "cap")
        best = F.min_by(own, F.xxhash64("node", "token", F.lit(k))) if k else F.min(own)
        lead = p.groupBy("token").agg(best.alias("l")).select("token", F.col("l.comp").alias("cb"), F.col("l.node").alias("b"), F.col("l.n").alias("nb"), F.col("l.cap").alias("capb"))
        tried = p.select("token", F.col("comp").alias("ca"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("cap").alias("capa")).join(lead, "token")
        tried = tried.filter(f"ca <> cb and nb <= capa and na <= capb and 100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        votes = self._fresh(tried.groupBy("a", "na", "b", "nb").count()).withColumn("draw", F.xxhash64("a", "b", F.lit(k)))
        first = F.max(F.struct("draw" if k else "count", "b", "nb"))
        each = votes.groupBy("a", "na").agg(first.alias("v"), F.min(F.struct("draw", "b", "nb")).alias("w"))
        one = each.select("a", "na", F.col("v.b").alias("b"), F.col("v.nb").alias("nb"))
        return one.union(each.select("a", "na", F.col("w.b"), F.col("w.nb"))).distinct() if k else one

    def _all_pairs(self, p: DataFrame) -> DataFrame:
        """All pairs of nodes in different components that can still link, a the smaller set: a asks for the size classes
        from its own to its cap's, and only sets whose cap lets them be the smaller one ask at all."""
        t, scale = self.percent, 1 / float(np.log(100 / self.percent))
        kind = "cast(floor(ln({}) * " + repr(scale) + ") as int)"
        x = p.filter("cap >= n").select("token", F.explode(F.expr(f"sequence({kind.format('n')}, {kind.format('cap')})")).alias("kind"), F.col("comp").alias("ca"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("cap").alias("capa"))
        y = p.select("token", F.expr(kind.format("n")).alias("kind"), F.col("comp").alias("cb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cap").alias("capb"))
        fits = f"na <= nb and nb <= capa and na <= capb and 100 * na >= {t} * nb and (na < nb or a < b) and ca <> cb"
        return self._fresh(x.join(y, ["token", "kind"]).filter(fits).select("a", "na", "b", "nb").distinct())

    def _merge(self, label: DataFrame | None, found: DataFrame, rows: int) -> DataFrame:
        """node, comp after the components at the ends of found links (rows of them) are joined."""
        if label is None:
            return components(found, "labels", rows)
        ends = found.join(label.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), rows=rows)
        joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
        old = label.join(joined, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp"))
        fresh = joined.select(F.col("comp").alias("node"), F.col("now").alias("comp")).join(label, "node", "left_anti")
        return narrow(old.union(fresh), "labels", self.held)

    def links(self) -> None:
        """Finds label (node, comp): nodes that links connect, directly or through others, have one comp."""
        self._prepare()
        self._find_postings()
        label = None
        for k in range(self.rounds):
            p = self._labelled(label) if label is None else self._kept(written(self._labelled(label), "labelled"))
            pairs = self._kept(narrow(self._trials(p, k), "pairs", 2 * self.held))
            tried = pairs.count()
            if not tried:
                break
            found = self._proven(pairs, tried)
            self.tried.append(pairs)
            linked = found.count()
            if linked:
                label = self._merge(label, found, linked)
            if linked < WORTH * tried:
                break
        if label is None:
            label = self.spark.createDataFrame([], "node long, comp long")
        p = self._kept(written(self._labelled(label), "labelled"))
        flagged, found = self._hosted(p, label)
        few, joined = self._crowded(flagged.filter("not hosted"))
        found = found.union(joined)
        rest = self._kept(narrow(self._all_pairs(few), "pairs"))
        if left := rest.count():
            found = found.union(self._proven(rest, left))
        if linked := found.count():
            label = self._merge(label, found, linked)
        self.label = label
        discard(*self.spent)
        self.frequency.destroy()  # what is left is written

    def members(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        self.links()
        comp = self.classes.join(self.label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        low = comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = comp.join(low, "comp").select("node", "component_id")
        out = self.rows.join(named, "node", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def members(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    return NgramJoin(docs, n, percent).members()


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, one of each group of linked rows: the one with the smallest doc_id (null last), then the smallest
    hash of its text. All columns are kept. Rows are told apart by id and text; of rows that repeat both one stays. Rows
    without words link with nothing and stay."""
    join = NgramJoin(docs, n, percent)
    join.links()
    comp = join.classes.join(join.label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = comp.groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull().alias("nameless"), "rep", "th")).alias("b"))
    named = comp.select("node", "comp").join(best, "comp").select("node", F.col("b.rep").alias("b_id"), F.col("b.th").alias("b_th"))
    worded = join.rows.filter("n > 0").select("node", F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"))
    gone = worded.join(named, "node").filter(~(F.col("k_id").eqNullSafe(F.col("b_id")) & (F.col("k_th") == F.col("b_th"))))
    total = join.rows.count()
    gone = narrow(gone.select("k_id", "k_th").distinct(), "gone", total)
    twice = narrow(worded.groupBy("k_id", "k_th").count().filter("count > 1").select("k_id", "k_th"), "twice", total)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("r_id"), F.xxhash64("text").alias("r_th"))
    same = F.col("r_id").eqNullSafe(F.col("k_id")) & (F.col("r_th") == F.col("k_th"))
    kept = keyed.join(maybe_broadcast(gone), same, "left_anti")
    if not twice.limit(1).count():
        return kept.select("row.*")
    one = kept.join(maybe_broadcast(twice), same, "left_semi").groupBy("r_id", "r_th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.join(maybe_broadcast(twice), same, "left_anti").select("row").union(one.select("row")).select("row.*")


#: members(n=4, percent=85), for tables without null doc_ids.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) >= 4 then list_transform(generate_series(1, len(ws) - 3), lambda p: array_to_string(list_slice(ws, p, p + 3), ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
o as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from o where 100 * c >= 85 * (na + nb - c)),
r as (select doc_id, doc_id as root from s union select l.b, r.root from r join l on r.doc_id = l.a)
select s.doc_id, len(any_value(sh))::BIGINT as n_shingles, min(root) as component_id from s join r on s.doc_id = r.doc_id group by s.doc_id
"""
