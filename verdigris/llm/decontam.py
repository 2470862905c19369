"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `size` consecutive words of an item (an item of fewer words is one window). A window's set of `shingle`-word
shingles must lie whole in a document that holds the window, so one shingle is a necessary prefix: the rarest, by
its count in the documents. One pass finds where the documents hold any item shingle; those counts order the shingles, the
rarest of each window joins back, its position gives the window's start, windows that would begin before or end
after the document are out (length and positional bounds), and the rest are compared word by word.

Only the item side is ever broadcast, and only below a checked number of rows; beyond it the joins shuffle by shingle.

Defined results: null text has no words; null or wordless items have no window; items with equal windows all count;
repeated documents or items give repeated or equal results; very long texts are whole; windows whose shingles are equally
rare take the one with the smallest hash; an empty side gives rows without hits; other columns, whatever their names, are
ignored, and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm._work import discard, maybe_broadcast, narrow, pick, written

SIZE, SHINGLE = 10, 5
#: what stands between words, once A-Z are a-z
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """Words of a text in order; empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _shingle(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from 0-based place at."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows: win (hash), ww (words), ids (item ids)."""
    w = pick(items, "item_id", "text").select("item_id", item_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size))).alias("at")
    each = w.select("item_id", "words", at).select("item_id", F.slice("words", F.col("at") + 1, F.lit(size)).alias("ww"))
    return each.groupBy("ww").agg(F.collect_set("item_id").alias("ids"), F.bool_or(F.col("item_id").isNull()).alias("has_null")).withColumn("win", F.xxhash64("ww"))


def _shingles(words: Column, k: int) -> Column:
    """(pos, h) of all k-word shingles."""
    n = F.size(words) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: _shingle(words, i, k)))


class Decontaminator:
    def __init__(self, docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE):
        self.size, self.shingle = size, min(size, shingle)
        self.docs, self.items = docs, items

    def _candidates(self, base: DataFrame) -> DataFrame:
        """dk, rk, cands (array of {start, ww, win})."""
        parts, found = [], []
        lengths = [r["k"] for r in self.wins.select(F.least(F.size("ww"), F.lit(self.shingle)).alias("k")).distinct().collect()]  # `shingle` values at most
        for k in lengths or [self.shingle]:
            own = self.wins.filter(F.least(F.size("ww"), F.lit(self.shingle)) == k)
            parts.append(own.select("win", "ww", F.lit(k).alias("k"), F.posexplode(_shingles(F.col("ww"), k)).alias("off", "h")))
        shingles = narrow(_union(parts), "shingles", self.size * self.wins.count())
        most = shingles.count()
        for k in lengths or [self.shingle]:
            wanted = narrow(shingles.filter(F.col("k") == k).select("h").distinct(), "wanted", most)
            rows = base.select("dk", "rk", F.posexplode(_shingles(F.col("words"), k)).alias("pos", "h"))
            found.append(rows.join(maybe_broadcast(wanted), "h").select("dk", "rk", "pos", F.lit(k).alias("k"), "h"))
        self.found = found = written(_union(found), "found")
        rarity = found.groupBy("k", "h").count()
        rarest = shingles.join(rarity, ["k", "h"], "left").groupBy("win", "ww", "k").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "h", "off")).alias("x"))
        prefix = narrow(rarest.filter("x.c > 0").select("win", "ww", "k", F.col("x.h").alias("h"), F.col("x.off").alias("off")), "prefix", most)
        at = found.join(maybe_broadcast(prefix), ["k", "h"]).withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0")
        return at.groupBy("dk", "rk").agg(F.collect_set(F.struct("start", "ww", "win")).alias("cands"))

    def checked(self) -> DataFrame:
        """doc_id, dk, rk (the row's key), n_words, n_hit, starts (of hits), wins (their hashes) of every row."""
        self.wins = narrow(windows(self.items, self.size), "windows")
        base = pick(self.docs, "doc_id", "text").select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("dk"), F.xxhash64("doc_id", "text").alias("rk"), "text")
        cands = self._candidates(base.select("dk", "rk", item_words(F.col("text")).alias("words")))
        both = base.join(cands, ["dk", "rk"], "left").withColumn("words", item_words(F.col("text"))).drop("text")
        hit = F.filter("cands", lambda c: F.slice(F.col("words"), c["start"] + 1, F.size(c["ww"])) == c["ww"])
        both = both.select("doc_id", "dk", "rk", F.size("words").cast("long").alias("n_words"), F.when(F.col("cands").isNotNull(), hit).alias("hits"))
        places = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["ww"]) - 1))))
        return both.select("doc_id", "dk", "rk", "n_words", F.when(F.col("hits").isNotNull(), F.size(places)).otherwise(0).cast("long").alias("n_hit"), F.transform("hits", lambda c: c["start"]).alias("starts"), F.array_distinct(F.transform("hits", lambda c: c["win"])).alias("wins"))

    def report(self) -> DataFrame:
        """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids of every row. The items of a set of windows
        are looked up once, however many documents hold that set."""
        rows = written(self.checked().withColumn("held", F.when(F.col("n_hit") > 0, F.xxhash64(F.array_sort("wins")))), "checked")
        discard(self.found)
        pairs = rows.filter("n_hit > 0").groupBy("held").agg(F.first("wins").alias("wins")).select("held", F.explode("wins").alias("win"))
        named = pairs.join(maybe_broadcast(self.wins.select("win", "ids")), "win")
        items = named.select("held", F.explode("ids").alias("item")).groupBy("held").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
        items = written(items, "items")
        out = rows.join(maybe_broadcast(items), "held", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
        return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def report(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    return Decontaminator(docs, items, size, shingle).report()


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return report(docs, items).drop("item_ids")


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of docs without a hit, all columns kept."""
    join = Decontaminator(docs, items, size)
    bad = narrow(join.checked().filter("n_hit > 0").select("dk", "rk").distinct(), "hit")
    discard(join.found)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.coalesce("doc_id", F.lit(0)).alias("dk"), F.xxhash64("doc_id", "text").alias("rk"))
    return keyed.join(maybe_broadcast(bad), ["dk", "rk"], "left_anti").select("row.*")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark where text is not null),
w as (select distinct item_id, array_to_string(list_slice(words, p0 + 1, p0 + 10), ' ') as win, least(len(words), 10) as size
      from (select *, unnest(generate_series(0, greatest(0, len(words) - 10))) as p0 from i where len(words) > 0)),
k as (select distinct size from w),
p as (select doc_id, size, p0, array_to_string(list_slice(words, p0 + 1, p0 + size), ' ') as win
      from (select doc_id, words, size, unnest(generate_series(0, len(words) - size)) as p0 from d, k where len(words) >= size)),
h as (select doc_id, p0, w.size, item_id from p join w using (size, win)),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(generate_series(p0, p0 + size - 1)) as pos from h) group by doc_id),
s as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::VARCHAR as item from h) group by doc_id)
select d.doc_id, len(words)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit, coalesce(n_items, 0)::BIGINT as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join s using (doc_id)
"""
