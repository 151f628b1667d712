"""Operator 2, quality rules: a threshold table compiled into one Spark projection.

Every figure is a built-in expression over the text (split, slice, hash, sort of arrays), so a document
is judged where it is read: no user function, no shuffle. Ratios compare integers
(``1000 * numerator`` against ``threshold * denominator``), so no rounding decides a verdict.

The stop words are of four languages in Latin script, and word lengths are known for such scripts, so these two
rules judge only a text without more letters of other scripts than Latin ones. The SQL twin has no such condition.

Defined results: a null text counts as empty; an empty text has zero words and fails; repeated rows are
judged one by one; an empty table gives an empty result; other columns, whatever their names, are ignored
by :func:`quality` and passed through untouched by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are separated by space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = "\\x20\\x09-\\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for on with as by this at from or an be are was "
    "le la les de des du et un une en que qui est dans pour par sur au avec ce "
    "der die das und ein eine ist nicht von zu mit auf für im den dem sich auch es "
    "el los las del y que en por con para una su al lo como más"
).split()

#: (name, numerator, comparison that must hold, threshold in thousandths, denominator)
RULES = [
    ("enough_words", "n_words", ">=", 20_000, "one"),
    ("word_length_low", "word_chars", ">=", 2_000, "n_words"),
    ("word_length_high", "word_chars", "<=", 14_000, "n_words"),
    ("symbol_share", "n_symbols", "<=", 100, "n_words"),
    ("stop_word_share", "n_stop_words", ">=", 45, "n_words"),
    ("duplicate_line_share", "n_dup_lines", "<=", 500, "n_lines"),
    ("ellipsis_line_share", "n_ellipsis_lines", "<=", 300, "n_lines"),
    ("repeated_word_share", "n_repeat_words", "<=", 300, "n_words"),
]
#: Rules that say nothing about a text mostly in other scripts.
LATIN_RULES = ("word_length_high", "stop_word_share")
BASE_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))


def _window_hashes(words: Column) -> Column:
    """A hash of each run of WINDOW words, by start."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _equal_neighbours(keyed: Column) -> Column:
    """Positions ``i`` of sorted (k, i) pairs whose key also stands before or after."""
    def same(e, j, step):
        return (j + step >= 0) & F.coalesce(F.get(keyed, j + step)["k"] == e["k"], F.lit(False))

    marked = F.transform(keyed, lambda e, j: F.when(same(e, j, -1) | same(e, j, 1), e["i"]))
    return F.filter(marked, lambda i: i.isNotNull())


def _covered(starts: Column) -> Column:
    """Words covered by the windows at the (sorted) starts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        starts, zero,
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"),
                                (i + WINDOW).alias("end")),
        lambda acc: acc["n"])


def figures(df: DataFrame, text: str) -> DataFrame:
    """Add the figures of the rule table to ``df``, which holds the text and no name used here.

    Repeated windows: equal windows have equal hashes, so sorting (hash, start) brings every candidate
    next to its like; the few candidates are then sorted by their actual words, which decides.
    """
    none = F.array().cast("array<int>")
    df = df.withColumn("txt", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("words", _words(F.col("txt")))
    lines = F.filter(F.split("txt", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    df = df.withColumns({"lines": lines, "hashes": _window_hashes(F.col("words"))})
    df = df.withColumn("has_repeat", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    df = df.withColumn("by_hash", F.when(F.col("has_repeat"), F.array_sort(F.transform(
        "hashes", lambda h, i: F.struct(h.alias("k"), i.alias("i"))))))
    df = df.withColumn("by_words", F.when(F.col("has_repeat"), F.array_sort(F.transform(
        _equal_neighbours(F.col("by_hash")),
        lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("k"), i.alias("i"))))))
    df = df.withColumn("repeats", F.when(F.col("has_repeat"), F.sort_array(
        _equal_neighbours(F.col("by_words")))).otherwise(none))
    return df.withColumns({
        "one": F.lit(1).cast("bigint"),
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace("txt", f"[^{SYMBOLS}]+", "")).cast("bigint"),
        "n_stop_words": F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        "n_lines": F.size("lines").cast("bigint"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("bigint"),
        "n_repeat_words": _covered(F.col("repeats")).cast("bigint"),
        "other_script": F.length(F.regexp_replace("txt", r"\P{L}+|\p{IsLatin}+", "")) > F.length(F.regexp_replace("txt", r"\P{IsLatin}+", "")),
    })


def _verdict(rules) -> Column:
    out = F.lit(True)
    for name, num, op, thousandths, den in rules:
        left, right = F.col(num) * 1000, F.col(den) * thousandths
        holds = left >= right if op == ">=" else left <= right
        out = out & (F.col("other_script") | holds if name in LATIN_RULES else holds)
    return out


def _failed(rules) -> Column:
    """Comma-joined names of the rules that do not hold."""
    return F.concat_ws(",", *[F.when(~_verdict([r]), F.lit(r[0])) for r in rules])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: figures, ``base_failed``, ``kept`` and the names of the failed rules."""
    df = figures(docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text")), "row_text")
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return df.select(F.col("row_id").alias(id_col), *BASE_FIGURES, base.alias("base_failed"),
                     (~base & _verdict(rules)).alias("kept"), "n_stop_words", "n_lines", _failed(rules).alias("failed_rules"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that every rule accepts, all columns unchanged.

    A filter would be pushed below the figures and repeat them for each rule that uses them; unpacking an array that
    holds the row or nothing keeps every figure computed once."""
    df = figures(docs.select(F.struct("*").alias("row_all"), F.col(text_col).alias("row_text")), "row_text")
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return df.select(F.inline(F.when(~base & _verdict(rules), F.array("row_all"))))


def figures_sql(source: str) -> str:
    """DuckDB twin of :func:`figures` over a relation with doc_id and text (one row per doc_id)."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    blank = "[^\\x20\\x09-\\x0D]"
    return f"""
q0 AS (SELECT doc_id, coalesce(text, '') AS txt, regexp_extract_all(coalesce(text, ''), '{blank}+') AS words
       FROM {source}),
q1 AS (SELECT *, list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS lines FROM q0),
wins AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + {WINDOW}], ' ') AS win
         FROM (SELECT doc_id, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM q1 WHERE len(words) >= {WINDOW})),
reps AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM reps, range({WINDOW}) AS r(k) GROUP BY doc_id),
q2 AS (SELECT doc_id, CAST(1 AS BIGINT) AS one, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(coalesce(array_to_string(words, ''), '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(txt, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(words, lambda w: lower(w) IN ({stops}))) AS BIGINT) AS n_stop_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…')) AS BIGINT) AS n_ellipsis_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(txt, '\\P{{L}}+|\\p{{Latin}}+', '', 'g')) > length(regexp_replace(txt, '\\P{{Latin}}+', '', 'g')) AS other_script
       FROM q1 LEFT JOIN cov USING (doc_id))"""


def _holds_sql(rule) -> str:
    name, num, op, thousandths, den = rule
    holds = f"{num} * 1000 {op} {den} * {thousandths}"
    return f"(other_script OR {holds})" if name in LATIN_RULES else f"({holds})"


def verdict_sql(rules=RULES) -> str:
    holds = " AND ".join(_holds_sql(rule) for rule in rules)
    return f"(NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND {holds})"


def quality_sql(rules=RULES) -> str:
    failed = ", ".join(f"CASE WHEN NOT {_holds_sql(rule)} THEN '{rule[0]}' END" for rule in rules)
    return f"""WITH {figures_sql('documents')}
SELECT doc_id, {', '.join(BASE_FIGURES)}, (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AS base_failed,
       {verdict_sql(rules)} AS kept, n_stop_words, n_lines, concat_ws(',', {failed}) AS failed_rules
FROM q2"""
