"""Unit-root, stationarity and Johansen tests as columns, against regressions on numpy."""

import numpy as np
import pytest
from pyspark.sql import Window

from spreadworks.functions import stats
from spreadworks.operators import intervals, screens, tradability, unitroot


def walks():
    """(name, y, x): random walks, cointegrated pairs with moving-average and autoregressive errors, several lengths."""
    g = np.random.default_rng(11)
    out = []
    for k, n in enumerate((5, 8, 24, 60, 120, 121, 252, 400, 504)):
        x = np.cumsum(g.normal(size=n))
        e = g.normal(size=n)
        ar = np.zeros(n)
        for i in range(1, n):
            ar[i] = 0.8 * ar[i - 1] + e[i] + (0.6 * e[i - 1] if k % 2 else 0)
        out += [(f"walk{n}", np.cumsum(g.normal(size=n)), x), (f"pair{n}", 3 + 1.5 * x + ar, x), (f"wave{n}", x + np.sin(np.arange(n) / 3) + 0.1 * e, x)]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame([(name, i, float(a), float(b)) for name, y, x in walks() for i, (a, b) in enumerate(zip(y, x, strict=True))], "k string, t int, y double, x double")
    return frame.repartition(3)


def brute_tau(s, constant, rule, max_lag=None):
    """The definition: one regression for each lag over common rows, the best once more over its own rows."""
    n, d = len(s), np.diff(s)
    room = max(0, n // 2 - 1 - constant)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), room) if max_lag is None else min(max_lag, room)

    def fit(lag, skip):
        parts = [*[d[skip - k : len(d) - k] for k in range(1, lag + 1)], s[skip:-1], *([np.ones(len(d) - skip)] if constant else [])]
        x, y = np.column_stack(parts), d[skip:]
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss = ((y - x @ b) ** 2).sum()
        return x, b, rss, len(y)

    def score(lag):
        x, _, rss, m = fit(lag, most)
        return m * np.log(rss / m) + (2 if rule == "aic" else np.log(m)) * x.shape[1]

    lag = most if rule is None else min(range(most + 1), key=score)
    x, b, rss, m = fit(lag, lag)
    if m <= x.shape[1]:
        return None, None
    return b[lag] / np.sqrt(rss / (m - x.shape[1]) * np.linalg.inv(x.T @ x)[lag, lag]), lag


@pytest.mark.parametrize("constant", [False, True])
@pytest.mark.parametrize(("rule", "max_lag"), [("aic", None), ("bic", None), (None, None), (None, 1), ("aic", 3), (None, 0)])
def test_lags_and_statistics(rows, constant, rule, max_lag):
    one = rows.groupBy("k").agg(unitroot.series_of("t", "y").alias("s"))
    found = {r["k"]: r for r in unitroot.dickey_fuller(one, "s", "tau", constant, rule, max_lag).collect()}
    for name, y, _ in walks():
        if len(y) < 10:
            continue
        tau, lag = brute_tau(y, constant, rule, max_lag)
        assert found[name]["tau_lag"] == lag, name
        assert found[name]["tau"] == pytest.approx(tau, rel=1e-6, abs=1e-8), name


def test_series_without_a_statistic(spark):
    frame = spark.createDataFrame([("empty", []), ("short", [1.0, 2.0]), ("constant", [2.0] * 40), ("missing", [1.0, None] * 20), ("nan", [1.0, float("nan")] * 20), (None, None)], "k string, s array<double>")
    for r in unitroot.kpss(unitroot.dickey_fuller(frame, "s", "tau", True), "s", "kpss").collect():
        assert r["tau"] is None and r["tau_lag"] is None
        assert r["kpss"] is None or r["k"] == "short"


def test_kpss(rows):
    one = rows.groupBy("k").agg(unitroot.series_of("t", "y").alias("s"))
    found = {r["k"]: r for r in unitroot.kpss(one, "s", "kpss").collect()}
    for name, y, _ in walks():
        stat, p = stats.kpss(y)
        assert (found[name]["kpss"], found[name]["kpss_p"]) == pytest.approx((stat, p), rel=1e-9), name


def test_johansen(rows):
    by = Window.partitionBy("k").orderBy("t")
    found = {r["k"]: r for r in unitroot.johansen(unitroot.johansen_series(rows, by, "y", "x").groupBy("k").agg(*unitroot.johansen_moments())).collect()}
    for name, y, x in walks():
        if len(y) < 24:
            continue
        trace, eigen, hedge, ok = stats.johansen(y, x)
        r = found[name]
        assert (r["johansen_trace"], r["johansen_eigen"], r["johansen_hedge"], r["johansen_trace_ratio"]) == pytest.approx((trace, eigen, hedge, trace / stats.JOHANSEN_TRACE), rel=1e-6), name
        assert r["johansen_ok"] == ok


def test_p_values(spark):
    taus = [-20.0, -5.0, -3.0, -1.61, -1.0, 0.0, 1.0, 3.0]
    frame = spark.createDataFrame([(t,) for t in taus] + [(None,)], "tau double").select("tau", unitroot.adf_p(unitroot.F.col("tau")).alias("p"))
    for r in frame.collect():
        assert r["p"] is None if r["tau"] is None else r["p"] == pytest.approx(stats.unit_root_p(r["tau"], 1), abs=1e-6)


def test_intervals_by_buckets(spark):
    """Every row meets exactly the intervals that cover it, and no plan compares all rows with all intervals."""
    g = np.random.default_rng(5)
    lo = [*g.integers(-300, 900, 30).tolist(), 0, 127, 128, 5]
    hi = [*(a + int(k) for a, k in zip(lo, g.integers(0, 500, 30), strict=False)), 128, 128, 129, 5]
    windows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(lo, hi, strict=True))], "w int, lo int, hi int")
    rows = spark.range(-50, 1000).select(unitroot.F.col("id").cast("int").alias("t"))
    for width in (1, 128, 10_000):
        met = intervals.within(rows, windows, width=width)
        assert met.columns == ["t", "w"]
        assert sorted(map(tuple, met.collect())) == sorted((t, i) for t in range(-50, 1000) for i, (a, b) in enumerate(zip(lo, hi, strict=True)) if a <= t < b)
        assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()


def pair_rows(spark, n=420):
    """Two pairs of one group: the first is cointegrated all along, the second in its first third only; raw prices."""
    g = np.random.default_rng(3)
    x = 50 + np.cumsum(g.normal(size=n))
    tied = 5 + 1.2 * x + np.convolve(g.normal(size=n), [1, 0.5, 0.2])[:n]
    loose = np.where(np.arange(n) < n // 3, 3 + 0.8 * x + 0.3 * g.normal(size=n), 3 + 0.8 * x + np.cumsum(0.8 * g.normal(size=n)))
    rows = [(k, i, float(y), float(b)) for k, s in (("a", tied), ("b", loose)) for i, (y, b) in enumerate(zip(s, x, strict=True))]
    return spark.createDataFrame(rows, "y string, t int, py double, px double").select("y", unitroot.F.lit("z").alias("x"), unitroot.F.lit(1).alias("fold"), "t", "py", "px"), {"a": (tied, x), "b": (loose, x)}


def brute_rate(y, x, count, least, alpha):
    n = len(y)
    width = max(least, n // count)
    if width >= n:
        return None
    p = [stats.engle_granger(y[i : i + width], x[i : i + width])[1] for i in np.unique(np.linspace(0, n - width, count, dtype=int))]
    return float(np.mean(np.array(p) <= alpha)), float(np.mean(p)), len(p)


@pytest.mark.parametrize(("count", "least"), [(3, 50), (5, 100), (1, 100), (4, 419), (4, 420)])
def test_pass_rates(spark, count, least):
    rows, series = pair_rows(spark)
    found = {r["y"]: r for r in screens.pass_rates(rows, ["fold", "y", "x"], count, 0.05, least, "py", "px").collect()}
    for k, (y, x) in series.items():
        want = brute_rate(y, x, count, least, 0.05)
        assert (found[k]["pass_rate"], found[k]["mean_p"], found[k]["n_windows"]) == pytest.approx(want, abs=1e-6) if want else k not in found


def test_second_stage_gates_candidates(spark):
    """The stability of windows decides which pairs of stage one stay; the spread's unit-root test stands beside it."""
    rows, series = pair_rows(spark)
    rates = {k: brute_rate(y, x, 3, 50, 0.9)[0] for k, (y, x) in series.items()}
    loose = dict(significance=0.9, least=100, min_half_life=0.0, max_half_life=1e9, max_cost_to_move=1e9)
    every = {r["y"]: r for r in tradability.candidates(rows, ["fold"], **loose).collect()}
    assert set(every) == {"a", "b"} and all(r["stability"] is None for r in every.values())
    for k, (y, x) in series.items():
        b, a = np.polyfit(x, y, 1)
        assert every[k]["spread_adf_p"] == pytest.approx(stats.adf(y - a - b * x)[1], abs=1e-6)
        assert every[k]["p"] == pytest.approx(stats.engle_granger(y, x)[1], abs=1e-6)
    for least in (0.0, 0.5, 1.0):
        kept = {r["y"]: r["stability"] for r in tradability.candidates(rows, ["fold"], **loose, stability_windows=3, min_stability=least).collect()}
        assert kept == {k: v for k, v in rates.items() if v >= least}


def test_diagnostics_of_given_pairs(spark):
    rows, series = pair_rows(spark)
    for r in tradability.diagnostics(rows, ["fold"]).collect():
        y, x = series[r["y"]]
        b, a = np.polyfit(x, y, 1)
        s = y - a - b * x
        assert r["train_obs"] == len(y) and r["train_beta"] == pytest.approx(b) and r["train_spread_sd"] == pytest.approx(s.std(ddof=1))
        assert r["train_coint_p"] == pytest.approx(stats.engle_granger(y, x)[1], abs=1e-6) and r["train_adf_p"] == pytest.approx(stats.adf(s)[1], abs=1e-6)
        assert r["train_stability"] == pytest.approx(brute_rate(y, x, 4, max(50, len(y) // 5), 0.05)[0])
        slope = np.polyfit(s[:-1], np.diff(s), 1)[0]
        assert r["train_half_life"] == pytest.approx(-np.log(2) / slope)
