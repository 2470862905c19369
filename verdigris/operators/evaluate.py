"""Retrieval quality from ranked neighbours, and separation of classes from pair distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators import knn

SELF = 1e-9


def sample_ids(n: int, size: int | None, seed: int) -> list[int] | None:
    """Drawn ordinals (numpy's default generator), or None for all."""
    if not size or size >= n:
        return None
    import numpy as np

    return sorted(int(i) for i in np.random.default_rng(seed).choice(n, size, replace=False))


def hits(records: DataFrame, k: int = 5, queries: DataFrame | None = None, id_col: str = "record_idx", vector: str = "vector", label: str = "label") -> DataFrame:
    """qid, q_label, rid, r_label, distance, rank: k + 1 neighbours of each query, those at SELF or less dropped, the first k."""
    asked = records if queries is None else queries
    near = knn.batch_top_k(records, asked, k + 1, id_col, vector, id_col).filter(F.col("distance") > SELF)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "rid"))).filter(F.col("rank") <= k)
    names = records.select(F.col(id_col).cast("long").alias("rid"), F.col(label).alias("r_label"))
    own = asked.select(F.col(id_col).cast("long").alias("qid"), F.col(label).alias("q_label"))
    return near.join(names, "rid").join(own, "qid").select("qid", "q_label", "rid", "r_label", "distance", "rank")


def hit_distances(found: DataFrame) -> DataFrame:
    """same (the hit has its query's label), n, mean, std (population), low, high of the distances of all hits."""
    same = F.col("r_label").eqNullSafe(F.col("q_label")).alias("same")
    d = F.col("distance")
    return found.groupBy(same).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("low"), F.max(d).alias("high"))


def per_query(found: DataFrame, records: DataFrame, k: int = 5, label: str = "label") -> DataFrame:
    """qid, q_label, ap, correct, p_at_1, p_at_k, recall_at_k of each query with a hit.

    Average precision divides by the hits found; recall by the class's other records, at most k.
    """
    hit = F.col("r_label").eqNullSafe(F.col("q_label")).cast("int")
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scored = found.withColumn("hit", hit).withColumn("run", F.sum("hit").over(run))
    by = scored.groupBy("qid", "q_label").agg(F.sum(F.col("hit") * F.col("run") / F.col("rank")).alias("gain"), F.sum("hit").alias("correct"), F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("p_at_1"))
    sizes = records.groupBy(F.col(label).alias("c_label")).count()
    by = by.join(sizes, F.col("q_label").eqNullSafe(F.col("c_label")), "left")
    most = F.greatest(F.lit(1), F.least(F.col("count") - 1, F.lit(k)))
    return by.select("qid", "q_label", F.when(F.col("correct") > 0, F.col("gain") / F.col("correct")).otherwise(0.0).alias("ap"), "correct", "p_at_1", (F.col("correct") / k).alias("p_at_k"), (F.col("correct") / most).alias("recall_at_k"))


def summary(queries: DataFrame, n_queries: int | Column) -> DataFrame:
    """n_queries, map, p_at_1 (over all queries), p_at_k, recall_at_k."""
    n = F.lit(n_queries) if isinstance(n_queries, int) else n_queries
    return queries.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"), (F.coalesce(F.sum("p_at_1"), F.lit(0)) / F.greatest(n, F.lit(1))).alias("p_at_1"), F.coalesce(F.avg("p_at_k"), F.lit(0.0)).alias("p_at_k"), F.coalesce(F.avg("recall_at_k"), F.lit(0.0)).alias("recall_at_k")).withColumn("n_queries", n.cast("long"))


def per_label(queries: DataFrame) -> DataFrame:
    """q_label, ap, n, worst first, with a bar of 20 marks at most."""
    by = queries.groupBy("q_label").agg(F.avg("ap").alias("ap"), F.count("*").alias("n"))
    return by.withColumn("bar", F.expr("repeat('#', cast(floor(20 * ap) as int))")).withColumn("shown", F.substring(F.col("q_label").cast("string"), 1, 45)).orderBy("ap", "q_label")


def grouped(queries: DataFrame) -> DataFrame:
    """map and n per label and over all (all_labels) in one pass of grouping sets."""
    return queries.sparkSession.sql("select q_label, grouping(q_label) = 1 as all_labels, avg(ap) as map, count(*) as n from {q} group by grouping sets ((q_label), ())", q=queries)


def ap_buckets(queries: DataFrame) -> DataFrame:
    """Share of queries with ap below .2, from .2 below .5, and .5 or more; nulls without queries."""
    n = F.nullif(F.count("*"), F.lit(0))
    return queries.agg((F.count_if(F.col("ap") < 0.2) / n).alias("low"), (F.count_if((F.col("ap") >= 0.2) & (F.col("ap") < 0.5)) / n).alias("middle"), (F.count_if(F.col("ap") >= 0.5) / n).alias("high"))


def separation(pairs: DataFrame) -> DataFrame:
    """From pairs (same boolean, distance): count, mean, population deviation, min and max of each side; fisher; overlap_pct."""
    stats = []
    for name, cond in (("intra", F.col("same")), ("inter", ~F.col("same"))):
        d = F.when(cond, F.col("distance"))
        stats += [F.count(d).alias(f"n_{name}"), F.avg(d).alias(f"mean_{name}"), F.stddev_pop(d).alias(f"std_{name}"), F.min(d).alias(f"min_{name}"), F.max(d).alias(f"max_{name}")]
    one = pairs.agg(*stats)
    over = pairs.crossJoin(F.broadcast(one.select("mean_inter"))).agg(F.count_if(F.col("same") & (F.col("distance") > F.col("mean_inter"))).alias("n_over"))  # one row
    return _separated(one.crossJoin(F.broadcast(over)))


def _separated(both: DataFrame) -> DataFrame:
    return both.withColumn("fisher", (F.col("mean_inter") - F.col("mean_intra")) / (F.col("std_inter") + F.col("std_intra") + 1e-8)).withColumn("overlap_pct", 100.0 * F.col("n_over") / F.greatest(F.col("n_intra"), F.lit(1)))


def separation_of(records: DataFrame, id_col: str = "record_idx", vector: str = "vector", label: str = "label") -> DataFrame:
    """As separation, over all pairs of records, summed up by blocks."""

    def wide(sums: DataFrame) -> DataFrame:
        sides = (("intra", F.col("same")), ("inter", ~F.col("same")))
        return sums.agg(*[F.coalesce(F.max(F.when(cond, F.col("n"))), F.lit(0)).alias(f"n_{side}") for side, cond in sides], *[F.max(F.when(cond, F.col(c))).alias(f"{new}_{side}") for side, cond in sides for c, new in (("mean", "mean"), ("std", "std"), ("low", "min"), ("high", "max"))])

    one = wide(knn.pair_sums(records, id_col, vector, label))
    over = knn.pair_sums(records, id_col, vector, label, one.select("mean_inter")).agg(F.coalesce(F.max(F.when(F.col("same"), F.col("n_over"))), F.lit(0)).alias("n_over"))  # one row
    return _separated(one.crossJoin(F.broadcast(over)))


def diagnosis(quality: DataFrame, distances: DataFrame, good: float = 0.7, medium: float = 0.4, fisher: float = 1.0, intra: float = 1.5, overlap: float = 30.0) -> DataFrame:
    """verdict, stars and notes (array) from one-row summaries."""
    one = quality.crossJoin(F.broadcast(distances))
    verdict = F.when(F.col("map") >= good, "good").when(F.col("map") >= medium, "medium").otherwise("poor")
    stars = F.when(F.col("map") > good, 3).when(F.col("map") > medium, 2).otherwise(1)
    notes = F.array_compact(F.array(F.when(F.col("fisher") < fisher, "classes overlap"), F.when(F.col("mean_intra") > intra, "classes are spread out"), F.when(F.col("overlap_pct") > overlap, "many pairs inside a class are far apart")))
    return one.select(F.round("map", 6).alias("map"), verdict.alias("verdict"), stars.alias("stars"), notes.alias("notes"))


def report(quality: DataFrame, labels: DataFrame, buckets: DataFrame, distances: DataFrame, k: int = 5) -> str:
    """The evaluation as text."""
    q, b, d = quality.first(), buckets.first(), distances.first()
    g = diagnosis(quality, distances).first()
    show = lambda x, f="{:.4f}": "-" if x is None else f.format(x)
    lines = [f"queries {q['n_queries']}", f"mAP@{k} {show(q['map'])} {'*' * g['stars']}", f"P@1 {show(q['p_at_1'])}", f"P@{k} {show(q['p_at_k'])}", f"Recall@{k} {show(q['recall_at_k'])}", ""]
    for side in ("intra", "inter"):
        lines.append(f"{side}: n {d[f'n_{side}']}, mean {show(d[f'mean_{side}'])}, std {show(d[f'std_{side}'])}, min {show(d[f'min_{side}'])}, max {show(d[f'max_{side}'])}")
    lines += [f"Fisher {show(d['fisher'])}, overlap {show(d['overlap_pct'], '{:.1f}')} %", ""]
    lines += [f"{str(r['shown']):45s} {r['ap']:.4f} {r['bar']}" for r in labels.toLocalIterator()]
    lines += ["", f"AP below .2: {show(b['low'], '{:.1%}')}, below .5: {show(b['middle'], '{:.1%}')}, from .5: {show(b['high'], '{:.1%}')}", f"verdict: {g['verdict']}", *g["notes"]]
    return "\n".join(lines)
