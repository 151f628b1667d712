"""Operator 10, mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, sorted by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share ``share`` of all words by
weight; a target stops at ``MAX_EPOCHS`` times its source's size and the excess is shared again. A source is
taken in complete epochs first; the rest of its target is drawn without replacement: each document gets
the key ``-ln(u) / quality weight``, the documents are sorted by key, and sizes are summed along this order up to
the budget, so better documents come first more often. A document is taken whole or not at all, so a source's
words come within half a document of the target: the last one is taken if that comes nearer.

At scale: sizes are summed per source, then per (source, key bucket), both with map-side sums. The budget falls
into one bucket of each source; only the documents of these buckets are sorted, by ranges of (source, key) dealt over
all tasks, and summed along them with the ranges' totals added. So neither a large source nor rows that share a key
meet in one task. ``u`` is a hash of id, text and source: a rerun takes the same documents, however they are dealt.

Defined results: a null text has size 0 and is taken zero words; a null source is a source; rows that are equal in id,
text and source share their key, and it makes no difference which of them are taken (:func:`mixed_rows` orders them by
a hash of all columns first); rows that share only an id have keys of their own; a table without words has targets 0;
an empty table gives an empty result; other columns are ignored by :func:`mix` and kept by :func:`mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlab.llm.common import written
from postlab.operators.star import dense_index
from postlab.operators.stats import running_totals

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Key buckets of a source; only the one that holds the end of the budget is sorted.
BUCKETS = 4096
SEED = "mix-1"
#: Hexadecimal digits of the hash that make u; 2**52 keeps u exact in a double.
DIGITS = 13


def _size(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.25 and 2: documents with natural word lengths and some length weigh most."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(mean.between(3, 12), F.lit(1.0)).otherwise(F.lit(0.5)) * F.when(size >= 50, F.lit(2.0)).otherwise(F.lit(0.5))


def sampling_key(id_col: Column, text: Column, source: Column, weight: Column) -> Column:
    """``u ** (1 / weight)`` counted from above: 1 - u ** (1 / w) grows with the exponential key -ln(u) / w and lies in
    [0, 1], so equal steps of it make even buckets."""
    row = F.concat_ws("|", F.concat(F.lit(SEED), F.coalesce(id_col.cast("string"), F.lit(""))), F.md5(F.coalesce(text, F.lit("")).cast("binary")),
                      F.coalesce(source, F.lit("")))
    number = F.conv(F.substring(F.md5(row.cast("binary")), 1, DIGITS), 16, 10)
    u = (number.cast("bigint").cast("double") + 0.5) / float(16 ** DIGITS)
    return 1.0 - F.exp(F.ln(u) / weight)


def source_targets(sizes: DataFrame, share: float = 1.0, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, rest) from (source, source_size), one row per source.

    The level L with sum(min(max_epochs * size, L * weight)) = budget is raised until no source stops anew; each
    round is one aggregate over the sources, of which only two sums reach the driver."""
    # ranks by a range-partitioned sort, as sources too may be many
    ranked = dense_index(sizes.withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], "rank").drop("no_source")
    ranked = written(ranked.withColumn("weight", F.element_at(F.lit(list(weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
                                       .cast("double")).drop("rank"), "mix-sources")
    total, n = ranked.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    budget, level, stopped = float(total or 0) * share, 0.0, -1
    top = F.col("source_size").cast("double") * max_epochs
    for _ in range(n + 1):
        is_full = F.col("weight") * level > top
        full, open_weight, count = ranked.agg(F.sum(F.when(is_full, top).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))),
                                              F.sum(is_full.cast("int"))).first()
        if count == stopped or not open_weight:
            break
        level, stopped = (budget - full) / open_weight, count
    target = F.least(F.col("weight") * level, top)
    epochs = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("bigint")
    return ranked.select("source", "source_size", target.alias("target"), epochs.alias("epochs"),
                         (target - epochs * F.col("source_size")).alias("rest"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def chosen(docs: DataFrame, share: float = 1.0, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """Add size, source_size, target and copies to ``docs`` (row_id, row_text, source, and what else it holds)."""
    spark = docs.sparkSession
    docs = docs.withColumn("size", _size(F.col("row_text")))
    docs = docs.withColumn("key", sampling_key(F.col("row_id"), F.col("row_text"), F.col("source"), quality_weight(F.coalesce(F.col("row_text"), F.lit("")), F.col("size"))))
    docs = docs.drop("row_text").withColumn("bucket", F.least(F.floor(F.col("key") * buckets), F.lit(buckets - 1)).cast("int"))
    whole = F.xxhash64("row_all") if "row_all" in docs.columns else F.lit(0).cast("bigint")
    docs = written(docs.withColumns({"row_print": whole, "uid": F.monotonically_increasing_id()}), "mix-docs")

    by_bucket = written(docs.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), share, weights, max_epochs)
    targets = written(targets, "mix-targets")
    upto = Window.partitionBy("b.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (by_bucket.alias("b").join(targets.alias("t"), _same(F.col("b.source"), F.col("t.source")))
             .select("b.source", "bucket", "words", "rest", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"))
             .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))))
    edges = edges.groupBy("source").agg(F.min_by("bucket", "before").alias("edge"), F.min("before").alias("before"))
    plan = written(targets.alias("t").join(edges.alias("e"), _same(F.col("t.source"), F.col("e.source")), "left")
                   .select(F.col("t.source").alias("plan_source"), "source_size", "target", "epochs", "rest", "before", "edge"), "mix-plan")

    docs = docs.join(plan, _same(F.col("source"), F.col("plan_source"))).drop("plan_source")
    inside = docs.filter("bucket = edge")
    inside = written(running_totals(inside.withColumn("no_source", F.col("source").isNull()),
                                    ["no_source", "source", "key", "row_print", "uid"], ["size"]), "mix-inside")
    begins = inside.groupBy(F.col("source").alias("begin_source")).agg(F.min(F.col("cum_size") - F.col("size")).alias("begin"))
    inside = inside.join(begins, _same(F.col("source"), F.col("begin_source")))
    end = F.col("before") + F.col("cum_size") - F.col("begin")
    nearer = end - F.col("rest") <= F.col("rest") - (end - F.col("size"))
    inside = inside.withColumn("extra", nearer.cast("int")).drop("no_source", "cum_size", "begin_source", "begin")
    below = docs.filter("edge IS NULL OR bucket <> edge").withColumn(
        "extra", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    out = below.unionByName(inside)
    return out.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(0).cast("bigint")).drop(
        "key", "bucket", "epochs", "rest", "before", "edge", "extra", "row_print", "uid")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: size, its source's size and target, and the words the mix takes of it."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"), F.col(source_col).alias("source"))
    return chosen(rows, **options).select(F.col("row_id").alias(id_col), "size", "source_size", "target",
                                          (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("row_text"), F.col(source_col).alias("source"), F.struct("*").alias("row_all"))
    return (chosen(rows, **options).filter("copies > 0")
            .select("row_all", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row_all.*"))


def mix_ctes(source: str, share: float = 1.0, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> str:
    """DuckDB twin: CTEs ending in ``mixed`` (doc_id, source, size, source_size, target, copies) over the relation."""
    n, w = len(weights), ", ".join(map(str, weights))
    return f"""
m0 AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {source}),
m1 AS (SELECT *, length(coalesce(text, '')) / CAST(greatest(size, 1) AS DOUBLE) AS mean,
         (CAST('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|' || coalesce(source, '')), 1, {DIGITS}) AS BIGINT) + 0.5e0) / {float(16 ** DIGITS)!r}::DOUBLE AS u
       FROM m0),
m2 AS (SELECT *, 1.0e0 - exp(ln(u) / ((CASE WHEN mean BETWEEN 3 AND 12 THEN 1.0e0 ELSE 0.5e0 END) * (CASE WHEN size >= 50 THEN 2.0e0 ELSE 0.5e0 END))) AS key FROM m1),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m2 GROUP BY source),
s1 AS (SELECT *, CAST([{w}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n}] AS DOUBLE) AS weight,
         CAST(source_size AS DOUBLE) * {max_epochs} AS top FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () * {share!r}::DOUBLE AS budget,
         coalesce(sum(top) OVER o, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight
       FROM s1 WINDOW o AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT coalesce(max((budget - full_before) / open_weight) FILTER (WHERE (budget - full_before) / open_weight * weight <= top), 0) AS level FROM s2),
s3 AS (SELECT source, source_size, least(weight * level, top) AS target FROM s1, lv),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s3),
m3 AS (SELECT m2.*, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY m2.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
       FROM m2 JOIN s4 ON m2.source IS NOT DISTINCT FROM s4.source),
mixed AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN rest > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END END AS copies FROM m3)"""


MIX_SQL = f"""WITH {mix_ctes('documents')}
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, source FROM mixed
"""
