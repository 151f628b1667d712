"""Operator 11, benchmark decontamination with built-in functions only.

A-Z is lowered and words are runs of letters, digits and characters beyond ASCII. A window of a benchmark item is ``WINDOW``
consecutive words; an item with fewer words, but some, is one window. A document word inside any occurrence of a window
is hit.

1. The distinct windows' 64-bit hashes are broadcast as a hash set, a join side of one long key; their number is checked
   against ``SET_WINDOWS``.
2. Every window of every document is hashed (a hash over the hashes of its words) and looked up in the set where the
   text is read; only the places whose hash is in the set go on, with their words.
3. These are verified by joining the words themselves, and gathered again by the row's number. No document is joined
   with another, and what is shuffled is one narrow row a document and one a verified place.

A larger benchmark, beyond the bound, skips the set: then every window of every document is joined by a shuffle.

The word hashes use ``lower`` (all of Unicode), coarser than the A-Z rule, so they miss nothing; the words that are
compared in the end have only A-Z lowered.

Defined results: a null or empty text has no words and no hits; repeated rows and null ids give a row each; a null
``item_id`` reads as an empty string, items of one id count once; null items have no windows; an empty benchmark
leaves all clean; an empty table gives an empty result; other columns are ignored by :func:`report` and kept by
:func:`without_documents` and :func:`without_spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlab.functions.exprs import bounded_broadcast

WINDOW = 10
BLANK = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most windows in the hash set, about 40 bytes each.
SET_WINDOWS = 1 << 20
#: Most rows of (window, items) that are broadcast for the verification.
BROADCAST_WINDOWS = 1 << 18


def words_of(text: Column) -> Column:
    """Words as they stand; :func:`lowered` is applied to what is compared."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def window_hashes(hashes: Column, length: int) -> Column:
    """One hash for every window of ``length`` words, in order."""
    n = F.size(hashes)
    return F.when(n >= length, F.transform(F.sequence(F.lit(1), n - (length - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(length))))
                  ).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window, n_window, items, print): distinct windows, their items in order and their hash."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                             words_of(lowered(F.col(text_col))).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n_window", F.least(F.size("words"), F.lit(window)))
    every = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n_window") + 1),
                        lambda i: F.array_join(F.slice(F.col("words"), i, F.col("n_window")), " "))
    found = items.select("item", "n_window", F.explode(every).alias("window"))
    found = found.groupBy("window", "n_window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.withColumn("print", F.xxhash64(word_hashes(F.split("window", " "))))


def located(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int,
            set_windows: int, carry: dict[str, Column]) -> DataFrame:
    """One row per document: the columns of ``carry``, n_words, hits (place and length of each window that occurs) and items."""
    found = windows(benchmark, item_col, item_text_col, window)
    lengths = sorted(r["n_window"] for r in found.select("n_window").distinct().collect())  # at most ``window`` rows
    n_windows = found.limit(set_windows + 1).count()
    own = ["n_words", *(f"carry_{name}" for name in carry)]
    rows = docs.select(*(c.alias(f"carry_{name}") for name, c in carry.items()), F.monotonically_increasing_id().alias("uid"),
                       words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint")).withColumn("hashes", word_hashes(F.col("words")))
    no_window = F.lit(None).cast("bigint")  # a row for the document itself, behind its windows
    rows = rows.withColumn("prints", F.concat(*(window_hashes(F.col("hashes"), n) for n in lengths), F.array(no_window)))
    rows = rows.select("uid", *own, "words", F.posexplode_outer("prints").alias("k", "print"))  # outer: no filter repeats the hashes
    if n_windows <= set_windows:
        prints = F.broadcast(found.select(F.col("print").alias("in_set")).distinct())
        rows = rows.join(prints, F.col("print") == F.col("in_set"), "left").filter("print IS NULL OR in_set IS NOT NULL")
    # windows of each length follow one another
    length, at, before = F.lit(None).cast("int"), F.col("k"), F.lit(0)
    for n in lengths:
        here = F.col("k") >= before
        length, at = F.when(here, F.lit(n)).otherwise(length), F.when(here, F.col("k") - before).otherwise(at)
        before = before + F.greatest(F.col("n_words").cast("int") - (n - 1), F.lit(0))
    is_own = F.col("print").isNull()
    words = F.when(~is_own, lowered(F.array_join(F.slice(F.col("words"), at + 1, length), " ")))
    rows = rows.select("uid", at.alias("at"), length.alias("length"), words.alias("window"), is_own.alias("is_own"),
                       *(F.when(is_own, F.col(c)).alias(c) for c in own))
    known = found.select(F.col("window").alias("known"), "items")
    rows = rows.join(bounded_broadcast(known, BROADCAST_WINDOWS), F.col("window") == F.col("known"), "left")
    hit = F.col("items").isNotNull()
    rows = rows.filter(F.col("is_own") | hit)
    out = rows.groupBy("uid").agg(*(F.max_by(c, "is_own").alias(c) for c in own),
                                  F.collect_list(F.when(hit, F.struct("at", "length"))).alias("hits"), F.collect_set("items").alias("items"))
    return out.select(*(F.col(f"carry_{name}").alias(name) for name in carry), "n_words", "hits",
                      F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def covered(hits: Column) -> Column:
    """Places of the words inside any hit, from 0."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", window: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, items."""
    out = located(docs, benchmark, text_col, item_col, item_text_col, window, set_windows, {"row_id": F.col(id_col)})
    out = out.withColumn("n_hit", F.size(covered(F.col("hits"))).cast("bigint"))
    return out.select(F.col("row_id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def without_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      most_hit: float = 0.0, window: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """The rows of ``docs`` of whose words at most the share ``most_hit`` is hit, all columns unchanged."""
    out = located(docs, benchmark, text_col, item_col, item_text_col, window, set_windows, {"row_all": F.struct("*")})
    return out.filter(F.size(covered(F.col("hits"))) <= F.col("n_words") * most_hit).select("row_all.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, set_windows: int = SET_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without the words that are hit and the blanks and marks in front of them; texts without a
    hit stay as they are, other columns too."""
    out = located(docs, benchmark, text_col, item_col, item_text_col, window, set_windows, {"row_all": F.struct("*")})
    text = F.col("row_all")[text_col]
    out = out.withColumn("parts", F.regexp_extract_all(text, F.lit(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+$"), F.lit(0)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), covered(F.col("hits")))
    cleaned = F.when(F.size("hits") == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), ""))
    return out.withColumn("cleaned", cleaned).select(*(F.col("cleaned").alias(c) if c == text_col else F.col("row_all")[c].alias(c) for c in docs.columns))


REPORT_SQL = rf"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, i, dw.n, item FROM dw JOIN bw USING (win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
