"""Exact k nearest neighbours: one query as a top-k scan, many as pairs of blocks with exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import vector as V

#: Queries and records of one block, and of the smallest.
QUERY_BLOCK, SMALL_BLOCK = 4096, 512


def scan_top_k(records: DataFrame, query: Sequence[float], k: int, id_col: str = "record_idx", vector: str = "vector") -> DataFrame:
    """The k records nearest to one query: rank, distance and all columns. Plans as a partial top-k and one small merge."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    q = F.array(*[F.lit(float(x)) for x in query])
    near = records.withColumn("distance", V.l2_distance(vector, q)).orderBy("distance", id_col).limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


def _best(d: np.ndarray, q: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (d, r) of each q."""
    by = np.lexsort((r, d, q))
    qs = q[by]
    first = np.searchsorted(qs, qs, side="left")
    return by[np.arange(len(by)) - first < k]


def _nearest(k: int):
    def run(table: pa.Table) -> pa.Table:
        """The k nearest records (side 1) of each query (side 0) of a block: candidates by a matrix product, ranked by the
        direct distance; what rounding may have moved stays a candidate."""
        v = table.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        asked, held = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        norm = (x * x).sum(axis=1)
        for i in range(0, len(asked) if len(held) else 0, 512):
            q = asked[i : i + 512]
            near = norm[q][:, None] + norm[held][None, :] - 2.0 * (x[q] @ x[held].T)
            last = min(k, len(held)) - 1
            kth = np.partition(near, last, axis=1)[:, last]
            a, b = np.nonzero(near <= (kth + 1e-9 * (norm[q] + norm[held].max()) + 1e-12)[:, None])
            d = np.concatenate([np.sqrt(((x[q[a[j : j + 65536]]] - x[held[b[j : j + 65536]]]) ** 2).sum(axis=1)) for j in range(0, len(a), 65536)])
            qid, rid = ids[q[a]], ids[held[b]]
            keep = _best(d, qid, rid, k)
            for c, y in zip(out, (qid[keep], rid[keep], d[keep]), strict=True):
                c.append(y)
        return pa.table({n: np.concatenate(c) for n, c in zip(("qid", "rid", "distance"), out, strict=True)})

    return run


def batch_top_k(records: DataFrame, queries: DataFrame, k: int, id_col: str = "record_idx", vector: str = "vector", query_id: str = "record_idx") -> DataFrame:
    """qid, rid, distance, rank (1..k) of the k records nearest to each query; ties by record id.

    Queries and records are dealt to blocks of QUERY_BLOCK rows by a hash of their ids, and every pair of blocks is one
    group on an executor that keeps k candidates per query; these meet in one window per query. Nothing is collected, and
    the plan is the same for any number of queries.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    left = records.select(F.col(id_col).cast("long").alias("id"), V.floats(vector).alias("v"))
    asked = queries.select(F.col(query_id).cast("long").alias("id"), V.floats(vector).alias("v"))
    # small tables get smaller blocks, so that there is a group for every core
    rows, cols = (-(-n // min(QUERY_BLOCK, max(SMALL_BLOCK, -(-n // 8)))) for n in (max(1, t.count()) for t in (asked, left)))

    def dealt(t: DataFrame, side: int, own: str, mine: int, other: str, others: int) -> DataFrame:
        t = t.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(mine))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
        return t.select("row", "col", F.lit(side).alias("side"), "id", "v")

    both = dealt(asked, 0, "row", rows, "col", cols).union(dealt(left, 1, "col", cols, "row", rows))
    out = both.groupBy("row", "col").applyInArrow(_nearest(k), "qid long, rid long, distance double")
    w = Window.partitionBy("qid").orderBy("distance", "rid")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pairwise(records: DataFrame, id_col: str = "record_idx", vector: str = "vector", keep: Sequence[str] = ()) -> DataFrame:
    """i, j, distance of all pairs i < j (and columns keep of both, as keep_i, keep_j). The result itself is quadratic:
    meant for a sample of records; pair_rows and pair_sums take all of them."""
    a = records.select(F.col(id_col).alias("i"), F.col(vector).alias("vi"), *[F.col(c).alias(f"{c}_i") for c in keep])
    b = records.select(F.col(id_col).alias("j"), F.col(vector).alias("vj"), *[F.col(c).alias(f"{c}_j") for c in keep])
    return a.join(b, F.col("i") < F.col("j")).withColumn("distance", V.l2_distance("vi", "vj")).drop("vi", "vj")


#: Records of one side of a block of pairs: where pairs are summed up, and where each is a row.
PAIR_BLOCK, ROW_BLOCK = 2048, 1024
#: Where each pair is a row: records of block one whose pairs are a batch, and partitions of blocks, unless these are few.
ROW_SLICE, ROW_PARTS = 64, 32
_MEASURES = pa.schema([("same", pa.bool_()), ("n", pa.int64()), ("mean", pa.float64()), ("spread", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("n_over", pa.int64())])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y; where the matrix product would cancel, by the direct form."""
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    whole = nx[:, None] + ny[None, :]
    d = whole - 2.0 * (x @ y.T)
    a, b = np.nonzero(d < 1e-4 * whole)
    for k in range(0, len(a), 65536):
        i, j = a[k : k + 65536], b[k : k + 65536]
        d[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0.0))


def _records(ids: pa.Array, label: pa.Array, v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, names of labels (equal numbers for equal labels, -1 for null) and vectors as a matrix."""
    width = np.diff(v.offsets.to_numpy())
    if v.null_count or v.flatten().null_count or (width != width[0]).any():
        raise ValueError("pairs need vectors of one length, without nulls")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    return ids.to_numpy(), label.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), x


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's pairs of unequal ids, once each: smaller id, greater id, distance, equal labels, a label is null."""
    ids, names, x = _records(*(table.column(c).combine_chunks() for c in ("id", "label", "v")))
    side = table.column("side").to_numpy()
    if side.any():
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        wanted = ids[left][:, None] != ids[right][None, :]
    else:
        left = right = np.argsort(ids, kind="stable")
        wanted = ids[left][:, None] < ids[right][None, :]
    d = _distances(x[left], x[right])[wanted]
    a, b = np.nonzero(wanted)
    a, b = left[a], right[b]
    return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), d, names[a] == names[b], (names[a] < 0) | (names[b] < 0)


def _rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """Halves away from zero, as SQL's round does with numbers of this kind (none is below 0)."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * 10.0**decimals
        low = np.floor(scaled)
        out = (low + (scaled - low >= 0.5)) / 10.0**decimals
    return np.where(np.isfinite(out), out, x)


def _pair_rows(decimals: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of unequal ids of two blocks (each a list of records), once each, ROW_SLICE records of
        block one at a time."""
        for batch in batches:
            for k in range(len(batch)):
                one, two = (batch.column(c)[k].values for c in ("rows_one", "rows_two"))
                m, own = len(one), batch.column("one")[k].as_py() == batch.column("two")[k].as_py()
                both = one if own else pa.concat_arrays([one, two])
                ids, names, x = _records(*(both.flatten()[both.type.get_field_index(c)] for c in ("id", "label", "v")))
                right = slice(0, None) if own else slice(m, None)
                for at in range(0, m, ROW_SLICE):
                    left = slice(at, min(m, at + ROW_SLICE))
                    p, q = ids[left][:, None], ids[right][None, :]
                    wanted = p < q if own else p != q
                    d = _distances(x[left], x[right])
                    low, high = np.minimum(p, q)[wanted], np.maximum(p, q)[wanted]
                    same = (names[left][:, None] == names[right][None, :])[wanted]
                    unknown = ((names[left] < 0)[:, None] | (names[right] < 0)[None, :])[wanted]
                    d = d[wanted] if decimals is None else _rounded(d[wanted], decimals)
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(same, pa.bool_(), mask=unknown), pa.array(d)], names=["i", "j", "same", "distance"])

    return run


def _pair_sums(table: pa.Table) -> pa.Table:
    _, _, d, same, unknown = _block(table)
    limit = table.column("limit")[0].as_py()
    rows = []
    for name, held in ((True, same & ~unknown), (False, ~same & ~unknown), (None, unknown)):
        part = d[held]
        if len(part):
            mean = part.mean()
            over = 0 if limit is None else int((part > limit).sum())
            rows.append({"same": name, "n": len(part), "mean": mean, "spread": ((part - mean) ** 2).sum(), "low": part.min(), "high": part.max(), "n_over": over})
    return pa.Table.from_pylist(rows, schema=_MEASURES)


def _pair_blocks(records: DataFrame, id_col: str, vector: str, label: str, size: int) -> DataFrame:
    """Each record once in every block of pairs (one, two) that it belongs to; side 0 is block one."""
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter("id is not null")
    blocks = max(1, -(-rows.count() // size))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt.select(F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "label", "v")


def pair_rows(records: DataFrame, id_col: str = "record_idx", vector: str = "vector", label: str = "label", size: int = ROW_BLOCK, decimals: int | None = None) -> DataFrame:
    """i, j, same (null where a label is), distance (rounded, if decimals are given) of all pairs i < j.

    Each record is shipped to its block of about size records, which becomes one row, and once more with it; then pairs of
    blocks meet in a Cartesian product. That reads blocks as often as they are needed and writes none again, so that what is
    written grows as the records do, and only the result is quadratic.
    """
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter("id is not null")
    blocks = max(1, -(-rows.count() // size))
    parts = max(min(blocks, ROW_PARTS), -(-blocks // 8))  # a task has 8 by 8 blocks at most, and half of these pairs
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    packed = rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "label", "v")).alias("rows")).repartitionById(parts, F.pmod("block", F.lit(parts)))
    one, two = (packed.select(F.col("block").alias(c), F.col("rows").alias(f"rows_{c}")) for c in ("one", "two"))
    turn = F.pmod(F.col("two") - F.col("one"), F.lit(blocks))  # half a turn ahead: each block has as many partners
    met = one.join(two, (2 * turn < blocks) | ((2 * turn == blocks) & (F.col("one") < F.col("two"))))
    return met.mapInArrow(_pair_rows(decimals), "i long, j long, same boolean, distance double")


def pair_sums(records: DataFrame, id_col: str = "record_idx", vector: str = "vector", label: str = "label", limit: DataFrame | None = None, size: int = PAIR_BLOCK) -> DataFrame:
    """same, n, mean, std (population), low, high, n_over of all pairs i < j: a block of pairs gives a row for each side,
    never a row for each pair. n_over counts distances above the one value of the one-row table limit."""
    dealt = _pair_blocks(records, id_col, vector, label, size)
    above = dealt.withColumn("limit", F.lit(None).cast("double")) if limit is None else dealt.crossJoin(F.broadcast(limit.toDF("limit")))
    sums = above.groupBy("one", "two").applyInArrow(_pair_sums, "same boolean, n long, mean double, spread double, low double, high double, n_over long")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) / n - mean * mean
    return sums.groupBy("same").agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.sum("spread") / n + F.greatest(between, F.lit(0.0))).alias("std"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_over").alias("n_over"))
