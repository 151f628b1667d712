"""Exact order statistics and modes without gathering a column into one task.

``exact_quantiles`` reproduces linear-interpolated quantiles (the median of pandas / numpy, DuckDB ``quantile_cont``,
Spark ``percentile``) exactly, but never builds a value->count map of a whole column in one task as the
``percentile`` aggregate does. Each wanted pair of neighbouring ranks has one bracket of values. A round asks a
KLL sketch (mergeable, over every row; brackets of the same values share one) for two values just below and
above the ranks and counts exactly what lies below and inside them, so the bracket shrinks by a fixed factor
of its rows whatever the values' magnitudes. A bracket with few distinct values, which is looked for where it
hardly shrinks, is fetched as (value, count) rows and read off; a value that holds a third of all rows is one
such row. If the rounds run out the call fails; it never fetches more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.functions.exprs import finite


#: A bracket that keeps more than this part of its rows in a round may hold few distinct values.
SHRINK = 16


def _value(c: str) -> F.Column:
    return finite(F.col(c).cast("double"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 1000,
                    max_collect: int = 2_000, max_rounds: int = 40) -> dict:
    """{(column, p): value or None}; nulls, NaN and inf are skipped.

    At most ``max_collect`` distinct values of each bracket reach the driver."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        v = _value(c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()

    # one bracket per (column, lower rank): values lo..hi, rows below it, rows inside, whether few values are inside
    plan: dict[tuple[str, float], tuple] = {}
    state: dict[tuple[int, int], dict] = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        for p in probs:
            if not n:
                plan[(c, p)] = None
                continue
            h = (n - 1) * p
            r0 = int(math.floor(h))
            plan[(c, p)] = (i, r0, min(r0 + 1, n - 1), h - r0)
            state[(i, r0)] = {"lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "below": 0, "rows": n, "last": min(r0 + 1, n - 1)}

    def inside(key):
        v = F.col(columns[key[0]]).cast("double")
        return F.when(v.between(state[key]["lo"], state[key]["hi"]), v)  # finite bounds leave out null, NaN and inf

    def small(s):
        return s["lo"] == s["hi"] or s["rows"] <= max_collect or s.get("few", False)

    for _ in range(max_rounds):
        pending = [key for key, s in state.items() if not small(s)]
        if not pending:
            break
        sketches, asked = {}, []
        for j, key in enumerate(pending):
            s = state[key]
            at = [(key[1] - s["below"]) / s["rows"] - 0.5 / accuracy, (s["last"] - s["below"] + 1) / s["rows"] + 0.5 / accuracy]
            _, name = sketches.setdefault((key[0], s["lo"], s["hi"]), (key, f"s{j}"))
            asked.append(F.kll_sketch_get_quantile_double(name, F.array(*[F.lit(min(max(x, 0.0), 1.0)) for x in at])).alias(f"b{j}"))
        found = df.agg(*[F.kll_sketch_agg_double(inside(key), 16 * accuracy).alias(name) for key, name in sketches.values()]).select(*asked).first()
        counted = []
        for j, key in enumerate(pending):
            lo, hi = found[f"b{j}"]
            v = F.col(columns[key[0]]).cast("double")
            counted += [F.count_if((v >= row[f"lo{key[0]}"]) & (v < lo)).alias(f"u{j}"), F.count_if(v.between(lo, hi)).alias(f"r{j}")]
        exact = df.agg(*counted).first()
        slow = []
        for j, key in enumerate(pending):
            s, (lo, hi) = state[key], found[f"b{j}"]
            below, rows = exact[f"u{j}"], exact[f"r{j}"]
            if below <= key[1] and s["last"] < below + rows:  # else the sketch missed: ask again, with a finer one
                if rows > s["rows"] // SHRINK:
                    slow.append(key)
                s.update(lo=lo, hi=hi, below=below, rows=rows)
        slow = [key for key in slow if not small(state[key])]
        if slow:
            distinct = df.agg(*[F.approx_count_distinct(inside(key)).alias(f"d{j}") for j, key in enumerate(slow)]).first()
            for j, key in enumerate(slow):
                state[key]["few"] = distinct[f"d{j}"] <= max_collect // 2
        accuracy = min(accuracy * 2, 4_000)
    if any(not small(s) for s in state.values()):
        raise RuntimeError("quantile brackets did not become small")

    resolved: dict[tuple[int, int], float] = {(key[0], r): s["lo"] for key, s in state.items() if s["lo"] == s["hi"] for r in (key[1], s["last"])}
    fetch = [key for key, s in state.items() if s["lo"] != s["hi"]]
    if fetch:
        entries = F.array(*[F.struct(F.lit(j).alias("t"), inside(key).alias("v")) for j, key in enumerate(fetch)])
        long = df.select(F.explode(F.filter(entries, lambda x: x["v"].isNotNull())).alias("p")).select("p.t", "p.v")
        by_bracket: dict[int, list] = {}
        for r in long.groupBy("t", "v").count().collect():  # distinct values of small brackets
            by_bracket.setdefault(r["t"], []).append((r["v"], r["count"]))
        for j, key in enumerate(fetch):
            for rank in (key[1], state[key]["last"]):
                at = state[key]["below"]
                for value, n in sorted(by_bracket[j]):
                    at += n
                    if rank < at:
                        resolved[(key[0], rank)] = value
                        break

    out = {}
    for (c, p), spec in plan.items():
        if spec is None:
            out[(c, p)] = None
            continue
        i, r0, r1, frac = spec
        a, b = resolved[(i, r0)], resolved[(i, r1)]
        out[(c, p)] = a + frac * (b - a) if frac else a
    return out


def exact_medians(df: DataFrame, columns: list[str], **kw) -> dict:
    q = exact_quantiles(df, columns, [0.5], **kw)
    return {c: q[(c, 0.5)] for c in columns}


def modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent non-null value per column; ties -> smallest value. One stacked aggregate."""
    if not columns:
        return {}
    arr = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = (df.select(F.explode(F.filter(arr, lambda x: x["v"].isNotNull())).alias("p"))
              .select("p.c", "p.v").groupBy("c", "v").count())
    best = counts.groupBy("c").agg(F.min_by("v", F.struct((-F.col("count")).alias("k"), F.col("v"))).alias("m"))
    got = {r["c"]: r["m"] for r in best.collect()}
    return {c: got.get(c) for c in columns}


def null_counts(df: DataFrame, columns: list[str]) -> dict:
    if not columns:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def running_totals(df: DataFrame, order_cols: list, value_cols: list[str], prefix: str = "cum_",
                   num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_cols`` order, without a single-task window.

    Range-partition on the order, sum inside each partition with a partition-local window, and add
    the totals of all earlier partitions (one row per partition, broadcast). The range-partitioned
    frame is checkpointed first so both passes see identical partition boundaries.
    """
    from pyspark.sql import Window

    from postlab.session import cut_lineage

    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order_cols).withColumn("__pid", F.spark_partition_id()))
    w = Window.partitionBy("__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"{prefix}{c}": F.sum(c).over(w) for c in value_cols})
    tot = ranged.groupBy("__pid").agg(*[F.sum(c).alias(f"__t_{c}") for c in value_cols])
    wo = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("__pid", *[F.coalesce(F.sum(f"__t_{c}").over(wo), F.lit(0)).alias(f"__o_{c}")
                                 for c in value_cols])
    out = local.join(F.broadcast(offs), "__pid")
    return (out.withColumns({f"{prefix}{c}": F.col(f"{prefix}{c}") + F.col(f"__o_{c}") for c in value_cols})
            .drop("__pid", *[f"__o_{c}" for c in value_cols]))
