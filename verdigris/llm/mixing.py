"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is a number of words. Within a source, documents are wanted in proportion to 1 + floor(log2 words), their
class: a longer document is taken more often, up to cap times, and the source's level makes all wanted words its target. The
whole part of what a document is wanted gives certain copies, the rest f is its inclusion probability. Documents are ranked
by random odds over inclusion odds, q = (u / (1 - u)) / (f / (1 - f)), and taken from the smallest q while the words fit what
the certain copies leave of the target (Rosen's order sampling with a size fixed in words). Up to CLOSERS more documents, each
the one whose size is nearest to what is still missing, close the gap while that brings the source nearer to its target. u
comes from a hash of doc_id and text, so reruns agree.

No source is ever sorted as a whole: sizes are summed into CELLS cells of the rank, the cell where the target falls is
split into CELLS again, and only rows of one cell in CELLS**2 are ordered. What is joined back is one row per source and class
(at most 64 classes).

Defined results: null text has no words; null is a source of its own, the last; sources without words and documents
without words are taken 0 times; rows that repeat a doc_id (or lack one) are drawn one by one unless their texts are equal
too, then together; very long texts are counted whole; an empty table gives no rows; other columns, whatever their names, are
kept by mix() and ignored by plan().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._work import maybe_broadcast, narrow, pick, written

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1024
CLOSERS = 3
WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("m_key", F.coalesce("source", F.lit(""))).withColumn("m_null", F.col("source").isNull())


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source_size, target. weights repeat over the sources by code point, null last; together the
    targets are share of all sizes, none above cap times its source's size."""
    by = sizes.groupBy("m_key", "m_null").agg(F.sum("size").alias("source_size"))
    name, whole = Window.orderBy("m_null", "m_key"), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("total", F.lit(share) * F.sum("source_size").over(whole))
    fill = Window.orderBy(F.col("most") / F.col("w"), "m_null", "m_key")
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    by = by.withColumn("place", F.row_number().over(fill)).withColumn("level", (F.col("total") - before) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("open", F.col("w") * F.col("level") < F.col("most"))
    level = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(whole)["level"]
    return by.withColumn("at", level).select("m_key", "m_null", "source_size", F.when(F.col("open"), F.col("w") * F.col("at")).otherwise(F.col("most")).alias("target"))


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, more, size, its class (-1 for no words) and a hash of the text."""
    rows = docs.select("doc_id", "source", *more, words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("th"))
    return _keyed(rows.withColumn("m_class", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(-1)))


def classes(sizes: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """For each source and class: copies that are certain, odds of one more (null: none), rest (words of the source's target
    that certain copies leave)."""
    key = ["m_key", "m_null"]
    by = sizes.groupBy(*key, "m_class").agg(F.sum("size").alias("held")).join(goal.select(*key, "target"), key)
    fill, whole = Window.partitionBy(*key).orderBy(F.desc("m_class")), Window.partitionBy(*key)
    by = by.withColumn("w", F.col("m_class") + 1).withColumn("most", F.lit(cap) * F.col("held")).withColumn("share", F.col("w") * F.col("held"))
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.nullif(F.sum("share").over(fill.rowsBetween(0, Window.unboundedFollowing)), F.lit(0))
    by = by.withColumn("level", (F.col("target") - before) / left).withColumn("open", F.coalesce(F.col("w") * F.col("level") < F.lit(cap), F.lit(False)))
    level = F.min(F.when(F.col("open"), F.struct(-F.col("m_class"), "level"))).over(whole)["level"]
    by = by.withColumn("at", level).withColumn("rate", F.when(F.col("open"), F.col("w") * F.col("at")).otherwise(F.lit(cap)))
    by = by.withColumn("copies", F.floor("rate")).withColumn("f", F.col("rate") - F.col("copies"))
    rest = F.col("target") - F.sum(F.col("copies") * F.col("held")).over(whole)
    return by.select(*key, "m_class", "copies", F.when(F.col("f") > 0, F.col("f") / (1 - F.col("f"))).alias("odds"), rest.alias("rest"))


def _ranked(df: DataFrame, seed: str) -> DataFrame:
    """q and its two cells; odds is f / (1 - f), null where nothing is drawn."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), "th"))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
    df = df.withColumn("u", u).withColumn("q", F.when((F.col("odds") > 0) & (F.col("size") > 0), F.col("u") / (1 - F.col("u")) / F.col("odds")))
    spot = F.col("q") / (1 + F.col("q")) * CELLS
    df = df.withColumn("c1", F.least(F.floor(spot), F.lit(CELLS - 1)).cast("int"))
    return df.withColumn("c2", F.greatest(F.lit(0), F.least(F.floor((spot - F.col("c1")) * CELLS), F.lit(CELLS - 1))).cast("int")).drop("u")


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str] = ("m_key", "m_null")) -> DataFrame:
    return left.join(maybe_broadcast(right), list(on))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The sizes (doc_id, source, size) and, for each source and class, target, odds and where the source's ranking is cut."""
    key = ["m_key", "m_null"]
    sizes = written(_measured(pick(docs, "doc_id", "source", "text")), "sizes")
    goal = narrow(targets(sizes, weights, share, cap), "targets")
    sources = goal.count()
    odds = narrow(classes(sizes, goal, cap), "classes", 65 * sources)
    drawn = _ranked(_joined(sizes, odds, [*key, "m_class"]), seed).filter("q is not null").select(*key, "doc_id", "size", "rest", "q", "c1", "c2")

    def cut(rows: DataFrame, cell: str, *more: str) -> DataFrame:
        """The cell in which the running sum passes the rest, and the sum before it."""
        w = Window.partitionBy(*key).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
        sums = rows.groupBy(*key, "rest", *more, cell).agg(F.sum("size").alias("cell_sum"))
        base = F.col("before") if "before" in more else F.lit(0)
        run = sums.withColumn("run", F.sum("cell_sum").over(w) + base).filter(F.col("run") > F.col("rest"))
        first = run.groupBy(*key).agg(F.min(F.struct(cell, F.col("run") - F.col("cell_sum"))).alias("x"))
        return narrow(first.select(*key, F.col("x")[cell].alias(cell), F.col("x")["col2"].alias("before")), "cells", sources)

    one = cut(drawn, "c1")
    inside = _joined(drawn, one, [*key, "c1"])
    two = cut(inside, "c2", "before")
    inside = _joined(inside.drop("before"), two, [*key, "c2"])
    order = Window.partitionBy(*key).orderBy("q", "doc_id")  # equal ranks stand or fall together
    fits = inside.withColumn("run", F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before"))
    last = fits.filter("run <= rest").groupBy(*key).agg(F.max(F.struct("q", "doc_id")).alias("l"), F.max("run").alias("run"))
    goal = goal.join(odds.select(*key, "rest").distinct(), key)
    cuts = goal.join(one.select(*key, F.col("c1").alias("b1")), key, "left").join(two.select(*key, F.col("c2").alias("b2"), "before"), key, "left").join(last, key, "left")
    cuts = cuts.select(*key, "source_size", "target", "rest", "b1", "b2", F.col("l.q").alias("last_q"), F.col("l.doc_id").alias("last_id"), F.coalesce("run", "before", F.lit(0)).alias("run"))
    cuts = narrow(cuts.withColumn("gap", F.when(F.col("b1").isNotNull(), F.col("rest") - F.col("run"))).drop("rest", "run"), "cuts", sources)
    cuts = cuts.withColumn("closers", F.array().cast("array<struct<q: double, id: bigint>>"))
    for _ in range(CLOSERS):
        open_ = _joined(drawn.drop("rest"), cuts).filter(~_taken() & ~_closes()).withColumn("miss", F.abs(F.col("gap") - F.col("size"))).filter("miss < gap")
        best = open_.groupBy(*key).agg(F.min(F.struct("miss", "q", "doc_id", "size")).alias("x"))
        found = F.col("x").isNotNull()
        nearer = F.when(found, F.concat("closers", F.array(F.struct(F.col("x.q").alias("q"), F.col("x.doc_id").alias("id"))))).otherwise(F.col("closers"))
        cuts = narrow(cuts.join(best, key, "left").withColumn("closers", nearer).withColumn("gap", F.col("gap") - F.coalesce("x.size", F.lit(0))).drop("x"), "plan", sources)
    return sizes, narrow(odds.drop("rest").join(cuts, key), "plan", 65 * sources)


def _taken() -> Column:
    c1, c2, b1, b2 = (F.col(c) for c in ("c1", "c2", "b1", "b2"))
    last = (F.col("q") < F.col("last_q")) | ((F.col("q") == F.col("last_q")) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("last_id"))))
    return F.coalesce(b1.isNull() | (c1 < b1) | ((c1 == b1) & ((c2 < b2) | ((c2 == b2) & last))), F.lit(False))


def _closes() -> Column:
    return F.coalesce(F.exists("closers", lambda c: (c["q"] == F.col("q")) & c["id"].eqNullSafe(F.col("doc_id"))), F.lit(False))


def _copies(rows: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    """rows (as _measured gives them) and how often each is taken: certain, drawn and closing copies."""
    near = _ranked(_joined(rows, cuts, ("m_key", "m_null", "m_class")), seed)
    drawn = F.when(F.col("q").isNotNull() & (_taken() | _closes()), 1).otherwise(0)
    return near.withColumn("m_copies", F.when(F.col("size") > 0, F.col("copies") + drawn).otherwise(0).cast("long"))


def counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies of each row."""
    sizes, cuts = plan(docs, **options)
    out = _copies(sizes, cuts, options.get("seed", SEED))
    return out.select("doc_id", "size", "source_size", "target", (F.col("m_copies") * F.col("size")).alias("taken"), F.col("m_copies").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix holds them: each row as often as it is taken, all columns kept."""
    _, cuts = plan(docs, **options)
    row = _measured(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row"))
    out = _copies(row, cuts, options.get("seed", SEED)).filter("m_copies > 0")
    return out.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select("m_row.*")


ORACLE = r"""
with s as (select doc_id, source, md5(coalesce(text, '')) as th, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size from documents),
b as (select source, sum(size)::BIGINT as source_size from s group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::INT] as w, 2.0::DOUBLE * source_size as most,
      1.5::DOUBLE * (sum(source_size) over ())::BIGINT as total from b),
f as (select *, row_number() over z as place,
      (total - coalesce(sum(most) over (z rows between unbounded preceding and 1 preceding), 0::DOUBLE)) / (sum(w) over (z rows between current row and unbounded following))::BIGINT as level
      from w window z as (order by most / w, source nulls last)),
o as (select *, w * level < most as open from f),
t as (select source, source_size, case when open then w * (select arg_min(level, place) from o where open) else most end as target from o),
h as (select source, case when size > 0 then length(bin(size)) - 1 else -1 end as class, sum(size)::BIGINT as held from s group by all),
j as (select h.*, t.target, (class + 1)::BIGINT as w, 2.0::DOUBLE * held as most from h join t on h.source is not distinct from t.source),
k as (select *, (target - coalesce(sum(most) over (y rows between unbounded preceding and 1 preceding), 0::DOUBLE)) / nullif((sum(w * held) over (y rows between current row and unbounded following))::BIGINT, 0) as level
      from j window y as (partition by source order by class desc)),
m as (select *, coalesce(w * level < 2.0::DOUBLE, false) as open from k),
v as (select *, case when open then w * (max_by(level, class) filter (open) over (partition by source)) else 2.0::DOUBLE end as rate from m),
i as (select source, class, floor(rate)::BIGINT as copies, rate - floor(rate) as f, target - (sum(floor(rate)::BIGINT * held) over (partition by source))::BIGINT as rest from v),
d as (select s.doc_id, s.size, s.source, t.source_size, t.target, i.copies, i.rest, case when f > 0 and size > 0 then u / (1 - u) / (f / (1 - f)) end as q
      from (select *, case when size > 0 then length(bin(size)) - 1 else -1 end as class, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1:' || th), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE as u from s) s
      join t on s.source is not distinct from t.source join i on s.source is not distinct from i.source and s.class = i.class),
c as (select *, case when q is not null then sum(case when q is not null then size end) over (partition by source order by q nulls last, doc_id nulls first range between unbounded preceding and current row) end as run from d),
n as (select source, max(run) as run from c where run <= rest group by source),
e0 as (select c.*, rest - coalesce(n.run, 0) as gap, coalesce(c.run <= c.rest, false) as sel from c left join n on c.source is not distinct from n.source),
{rounds}
select doc_id, size, source_size, target::DOUBLE as target,
  (case when size > 0 then copies + sel::INT else 0 end * size)::BIGINT as taken, (case when size > 0 then copies + sel::INT else 0 end)::BIGINT as copies
from e{closers}
"""
_ROUND = """
p{k} as (select *, q is not null and not sel and abs(gap - size) < gap as may from e{j}),
r{k} as (select *, row_number() over (partition by source order by may desc, abs(gap - size), q nulls last, doc_id nulls first) = 1 and may as now from p{k}),
e{k} as (select * exclude (sel, gap, may, now), sel or now as sel, gap - coalesce(sum(case when now then size end) over (partition by source), 0) as gap from r{k})"""
ORACLE = ORACLE.replace("{rounds}", ",".join(_ROUND.format(k=k, j=k - 1) for k in range(1, CLOSERS + 1))).replace("{closers}", str(CLOSERS))
