import numpy as np
import pytest

from postlab.operators.stats import exact_quantiles, modes, null_counts, running_totals


def _np_quantile(vals, p):
    v = np.array([x for x in vals if x is not None and np.isfinite(x)], dtype=float)
    return float(np.quantile(v, p)) if len(v) else None


@pytest.mark.parametrize("max_collect", [2_000, 40, 10])
def test_exact_quantiles_match_numpy(spark, max_collect):
    rng = np.random.default_rng(0)
    a = [float(v) for v in rng.normal(size=400)] + [None, float("nan"), float("inf")]
    b = [float(x) for x in rng.integers(0, 5, size=403)]  # heavy ties
    hot = [7.0] * 150 + [float(v) for v in rng.uniform(size=253)]  # one value holds a third of the rows
    df = spark.createDataFrame(list(zip(a, b, hot)), "a double, b double, hot double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    q = exact_quantiles(df, ["a", "b", "hot"], probs, max_collect=max_collect)
    for c, vals in (("a", a), ("b", b), ("hot", hot)):
        for p in probs:
            assert q[(c, p)] == pytest.approx(_np_quantile(vals, p), rel=1e-12, abs=1e-12)


def test_stats_edge_median_is_interpolated(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (5.0,), (7.0,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5])[("v", 0.5)] == 4.5


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5])[("v", 0.5)] is None


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert modes(df, ["c"]) == {"c": "a"}
    assert null_counts(df, ["c"]) == {"c": 1}


def test_running_totals_match_cumsum(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), int(p)) for s, p in zip(rng.permutation(300), rng.integers(0, 3, 300))]
    df = spark.createDataFrame(rows, "s double, p long")
    from pyspark.sql import functions as F
    out = running_totals(df, [F.desc("s")], ["p"]).orderBy(F.desc("s")).toPandas()
    exp = np.cumsum([p for s, p in sorted(rows, key=lambda r: -r[0])])
    assert out["cum_p"].tolist() == exp.tolist()


def test_wide_range_and_narrowing(spark):
    """Values over 600 orders of magnitude: brackets shrink by rows, not by width."""
    rng = np.random.default_rng(1)
    v = np.concatenate([10.0 ** rng.uniform(-300, 300, 14_000), np.full(1_000, 3.5)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    q = exact_quantiles(df, ["v"], [0.25, 0.5, 0.95])  # 15,000 rows: at least one round
    for p in (0.25, 0.5, 0.95):
        assert q[("v", p)] == pytest.approx(float(np.quantile(v, p)), rel=1e-12)


def test_no_unbounded_fetch(spark):
    df = spark.range(15_000).selectExpr("cast(id as double) v")
    with pytest.raises(RuntimeError):
        exact_quantiles(df, ["v"], [0.5], max_collect=10, max_rounds=0)
