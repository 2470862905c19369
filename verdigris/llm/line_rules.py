"""Line-first cleaning in DataFrame operations only: rules judge each line, failing lines go, and a document that loses
too much of its text goes too.

Line rules (a line without words is neutral):
  punctuation  symbols stand at MARKS or more per word, or runs of exclamation marks do
  navigation   SEPARATORS or more of | » › and at least one per four words; or fewer than SHORT words and no closing mark
  boilerplate  a phrase of PHRASES
Documents fail first on their base figures (too short, or too many words in repeated five-word windows).

Defined results: null or empty text has no words and fails; repeated rows get equal results; an empty table gives no rows;
other columns are kept by clean() and ignored by measure().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SHOUT = r"!!+"
SEPARATOR = r"[|»›]"
CLOSED = r"""[.!?…:;,"'”’)\]][\x20\x09-\x0D]*$"""
PHRASES = "(?i)cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|click here|sign up|log in|subscribe to|lorem ipsum|licensed under|copyright (©|\\(c\\)|[0-9]{4})"
MARKS, SEPARATORS, SHORT, MAX_LOST = 0.3, 2, 4, 0.5
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def word_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


#: what a line needs before its marks are worth counting, and what a line of SHORT words or more holds
ANY_MARK = r"[#*$%&|<>»›]|!!"
ENOUGH = rf"{WORD}(?:{BETWEEN}{WORD}){{{SHORT - 1}}}"


def bad_line(line: Column) -> Column:
    """Whether a line fails a rule. Most lines have no mark at all, so marks and words are only counted where one is found."""
    n = word_count(line)
    punctuation = (F.regexp_count(line, F.lit(SYMBOL)) >= MARKS * n) | (F.regexp_count(line, F.lit(SHOUT)) >= MARKS * n)
    marks = F.regexp_count(line, F.lit(SEPARATOR))
    counted = F.when(line.rlike(ANY_MARK), punctuation | ((marks >= SEPARATORS) & (4 * marks >= n))).otherwise(False)
    few = ~line.rlike(ENOUGH) & ~line.rlike(CLOSED)
    return counted | few | line.rlike(PHRASES)


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def _repeated(rows: DataFrame) -> DataFrame:
    """n_repeat_words: words in WINDOW-word windows found twice or more in the text. Windows are compared by 64-bit hash;
    only texts with a repeated window are sorted."""
    n = F.size("words") - WINDOW
    rows = rows.withColumn("wh", F.when(n > 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)]))))
    rows = rows.withColumn("again", F.coalesce(F.size(F.array_distinct("wh")) < F.size("wh"), F.lit(False)))
    rows = rows.withColumn("st", F.when(F.col("again"), F.array_sort(F.transform("wh", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("wh")
    twice = F.filter(F.transform("st", lambda x, j: F.when((F.get("st", j - 1)["h"] == x["h"]) | (F.get("st", j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.array_sort(twice)).drop("st")
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at", "again")


def measure(docs: DataFrame, *keep: str, **more: Column) -> DataFrame:
    """keep columns, more (expressions over column words, the text's words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words (in failing lines), base_failed, kept."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text_"))
    rows = rows.withColumn("words", split_words(F.col("text_"))).withColumn("lines", lines_of(F.col("text_")))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    for name, expression in more.items():
        rows = rows.withColumn(name, expression)
    rows = rows.withColumn("n_symbols", F.coalesce(F.regexp_count("text_", F.lit(SYMBOL)), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    rows = rows.withColumn("n_lost_words", F.aggregate(F.transform("lines", lambda x: F.when(bad_line(x), word_count(x)).otherwise(0)), F.lit(0), lambda a, x: a + x).cast("long"))
    rows = _repeated(rows.drop("lines", "text_")).drop("words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= MAX_LOST * F.col("n_words")))


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents without their failing lines, all columns."""
    names = docs.columns
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(WORD) | ~bad_line(x)), "\n")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), "text")
    kept = measure(rows, "row_").filter("kept").select("row_.*")
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names])


def digest(docs: DataFrame) -> DataFrame:
    return measure(docs, "doc_id")


ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
l as (select doc_id, text, words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from d),
b as (select *, list_transform(lines, lambda x: {{'n': len(regexp_extract_all(x, '{WORD}')), 's': len(regexp_extract_all(x, '{SYMBOL}')), 'x': len(regexp_extract_all(x, '{SHOUT}')),
        'm': len(regexp_extract_all(x, '{SEPARATOR}')), 'c': regexp_matches(x, '{CLOSED.replace("'", "''")}'), 'p': regexp_matches(x, '{PHRASES}')}}) as f from l),
m as (select *, coalesce(list_sum(list_transform(f, lambda y: case when y.s >= {MARKS} * y.n or y.x >= {MARKS} * y.n or (y.m >= {SEPARATORS} and 4 * y.m >= y.n) or (y.n < {SHORT} and not y.c) or y.p then y.n else 0 end)), 0)::BIGINT as n_lost_words from b),
w as (select doc_id, p0, array_to_string(list_slice(words, p0, p0 + {WINDOW - 1}), ' ') as win from (select doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) as p0 from d)),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(p0, p0 + {WINDOW - 1})) as p from (select *, count(*) over (partition by doc_id, win) as k from w) where k > 1) group by doc_id),
a as (select m.doc_id, len(words)::BIGINT as n_words, length(array_to_string(words, ''))::BIGINT as word_chars, len(regexp_extract_all(text, '{SYMBOL}'))::BIGINT as n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT as n_dup_lines, coalesce(r.n, 0)::BIGINT as n_repeat_words, n_lost_words from m left join r using (doc_id))
select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words) and n_lost_words <= {MAX_LOST} * n_words as kept from a
"""
