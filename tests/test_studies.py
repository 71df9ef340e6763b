import math

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F
from test_queries import SF

from spreadworks import queries as q
from spreadworks import studies
from spreadworks.functions import native, stats
from spreadworks.operators import performance, ranking, research, rolling, screens, selection
from spreadworks.plans import folded, folds, predictive, rescreen
from spreadworks.sinks import tables
from spreadworks.sources import lists

OWN = sorted(n for n, f in q.QUERIES.items() if f.__module__ == studies.__name__ and n in q.ORACLES)


@pytest.mark.parametrize("name", OWN)
def test_same_as_sql(spark, name):
    assert_same(spark, q.QUERIES[name], q.ORACLES[name], SF)


def test_native_distributions_equal_the_numpy_ones(spark):
    rows = [(float(t), int(df)) for t in np.linspace(-6, 6, 25) for df in (1, 2, 3, 4, 9, 18)]
    out = spark.createDataFrame(rows, "t double, df int").select("t", "df", native.t_two_sided(F.col("t"), F.col("df")).alias("p"), native.normal_two_sided(F.col("t")).alias("z"), native.eg_p(F.col("t")).alias("e")).collect()
    for r in out:
        assert r["p"] == pytest.approx(stats.t_two_sided(r["t"], r["df"]), abs=1e-9)
        assert r["z"] == pytest.approx(math.erfc(abs(r["t"]) / math.sqrt(2)), rel=2e-7)
        assert r["e"] == pytest.approx(stats.unit_root_p(r["t"], 2), abs=1e-6)


def test_nulls_take_no_rank_and_no_part_in_regressions(spark):
    rows = spark.createDataFrame([(0, v) for v in (None, None, 1.0, 2.0, 3.0)], "g int, v double")
    got = rows.select("v", ranking.percent_rank_of("v", ["g"]).alias("p"), ranking.quintile("v", ["g"]).alias("q")).collect()
    assert sorted((r["v"], round(r["p"], 6), r["q"]) for r in got if r["v"]) == [(1.0, 0.333333, 1), (2.0, 0.666667, 2), (3.0, 1.0, 4)]
    assert all(r["p"] is None and r["q"] is None for r in got if r["v"] is None)
    g = np.random.default_rng(2)
    full = [(int(i % 6), f"y{i % 9}", "x", float(a), float(0.5 * a + b)) for i, (a, b) in enumerate(g.normal(size=(90, 2)))]
    holes = [(0, "y0", "x", 50.0, None), (1, "y1", "x", None, -70.0)]
    schema = "period int, y string, x string, v double, r double"
    one, two = (research.clustered_slope(spark.createDataFrame(d, schema), "v", "r", ["period"], ["y", "x"]).first() for d in (full, full + holes))
    assert one == two and one["p"] == pytest.approx(math.erfc(abs(one["t"]) / math.sqrt(2)), rel=1e-6)
    assert research.slope(spark.createDataFrame(full + holes, schema), "v", "r").first()["n"] == 90


def test_clustered_errors_equal_a_direct_sum(spark):
    g = np.random.default_rng(5)
    rows = [(int(i % 7), f"y{i % 11}", "x", float(a), float(b)) for i, (a, b) in enumerate(g.normal(size=(120, 2)))]
    got = research.clustered_slope(spark.createDataFrame(rows, "period int, y string, x string, v double, r double"), "v", "r", ["period"], ["y", "x"]).first()
    v, r = np.array([t[3] for t in rows]), np.array([t[4] for t in rows])
    u = v * (r - (v @ r) / (v @ v) * v)

    def meat(keys):
        sums = {}
        for k, s in zip(keys, u, strict=True):
            sums[k] = sums.get(k, 0) + s
        return sum(s * s for s in sums.values()) * len(sums) / (len(sums) - 1)

    total = meat([t[0] for t in rows]) + meat([t[1] for t in rows]) - meat([t[:2] for t in rows])
    assert got["coef"] == pytest.approx((v @ r) / (v @ v)) and (got["se"] == pytest.approx(math.sqrt(total) / (v @ v)) if total > 0 else got["se"] is None)


def filled(base, cap):
    """Water filling, one round after the other."""
    base = [max(b, 0.0) for b in base]
    base = base if sum(base) > 0 else [1.0] * len(base)
    out, free, left = [0.0] * len(base), set(range(len(base))), 1.0
    while free:
        mass = sum(base[i] for i in free)
        part = {i: left * (base[i] / mass if mass > 0 else 1 / len(free)) for i in free}
        over = [i for i in free if part[i] >= cap - 1e-15]
        if not over:
            return [part.get(i, w) for i, w in enumerate(out)]
        for i in over:
            out[i], left = min(cap, max(left, 0)), left - cap
        free -= set(over)
    return out


def test_capped_weights_equal_rounds_of_filling(spark):
    g = np.random.default_rng(3)
    groups = [[0.6, 0.3, 0.1], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 1.0], [-1.0, 2.0, 2.0, 0.0], *[list(np.round(g.random(int(n)) ** 3, 3)) for n in g.integers(1, 9, 20)]]
    rows = spark.createDataFrame([(k, i, float(b)) for k, bs in enumerate(groups) for i, b in enumerate(bs)], "g int, i int, base double")
    for cap in (0.25, 0.5):
        got = {(r["g"], r["i"]): r["weight"] for r in folded.capped(rows, ["g"], "base", cap).collect()}
        for k, bs in enumerate(groups):
            assert [got[k, i] for i in range(len(bs))] == pytest.approx(filled(bs, cap), abs=1e-9)
            assert stats.capped_weights(bs, cap) == pytest.approx(filled(bs, cap), abs=1e-9)


def test_folds_follow_the_panels_length(spark):
    assert folds.gapped(2942) == [(1, 0, 1471, 1471, 1618, 1618, 1765), (2, 0, 1765, 1765, 1912, 1912, 2059), (3, 0, 2059, 2059, 2206, 2206, 2353), (4, 0, 2353, 2353, 2500, 2500, 2647), (5, 0, 2647, 2647, 2794, 2794, 2942)]
    panel = spark.range(357).select(F.col("id").cast("int").alias("t"))
    rows = folds.of_panel(panel).collect()
    assert len(rows) == 5 and rows[-1]["test_hi"] == 357 and all(r["train_hi"] == r["val_lo"] and r["val_hi"] == r["test_lo"] for r in rows)
    tiles = folds.of_panel(panel, "continuous").collect()
    assert tiles[0]["test_lo"] == 178 and all(a["test_hi"] == b["test_lo"] for a, b in zip(tiles, tiles[1:], strict=False))
    with pytest.raises(ValueError, match="too few"):
        folds.gapped(200)
    assert folds.of_panel(panel.limit(0)).count() == 0


def series(spark, n=260, seed=7):
    g = np.random.default_rng(seed)
    x = np.cumsum(g.normal(size=n)) + 200
    y = 1.4 * x + g.normal(size=n) + 5
    return spark.createDataFrame([("a", "b", 1, i, float(u), float(v), float(np.log(u)), float(np.log(v))) for i, (u, v) in enumerate(zip(y, x, strict=True))], "y string, x string, grp int, t int, py double, px double, ly double, lx double"), y, x


def test_rolling_sums_equal_windows_row_by_row(spark):
    rows, y, x = series(spark)
    got = {r["t"]: r for r in rolling.lagged_z(rolling.rolling_ols(rows, 50, True).withColumn("spread", F.col("py") - F.col("beta") * F.col("px")), 40).collect()}
    for t in (0, 49, 50, 120, 259):
        if t < 50:
            assert got[t]["beta"] is None
            continue
        b, a = np.polyfit(x[t - 50 : t], y[t - 50 : t], 1)
        assert got[t]["beta"] == pytest.approx(b) and got[t]["alpha"] == pytest.approx(a)
        resid = y[t - 50 : t] - a - b * x[t - 50 : t]
        assert got[t]["resid_sd"] == pytest.approx(math.sqrt((resid**2).sum() / 49))
    past = [got[t]["spread"] for t in range(80, 120)]
    assert got[120]["z"] == pytest.approx((got[120]["spread"] - np.mean(past)) / np.std(past, ddof=1))


def test_hurst_lags_depend_on_the_length(spark):
    for n in (24, 120, 260):
        rows, y, x = series(spark, n)
        s = np.log(y) - np.polyval(np.polyfit(np.log(x), np.log(y), 1), np.log(x))
        lags = range(2, max(3, min(50, n // 4)))
        want = np.polyfit(np.log(lags), np.log([np.std(s[k:] - s[:-k]) for k in lags]), 1)[0] if len(lags) > 1 else None
        got = rolling.hurst(rolling.static_spread(rows)).first()["hurst"]
        assert got == pytest.approx(want) if want is not None else got is None


def test_pass_rate_windows_cover_the_history(spark):
    rows, _, _ = series(spark, 600)
    got = screens.pass_rate(rows, 4, least=100).first()
    assert got["n_windows"] == 4 and 0 <= got["pass_rate"] <= 1
    assert screens.pass_rate(rows.filter("t < 90"), 4, least=100).count() == 0


def test_capped_walk_equals_a_loop(spark):
    g = np.random.default_rng(8)
    rows = [(p, f"t{a}", f"u{b}", float(np.round(s, 1))) for p in range(3) for a in range(5) for b in range(5) for s in g.random(1)]
    got = ranking.capped_top_k(spark.createDataFrame(rows, "p int, y string, x string, s double"), ["p"], "s", 6, 2).collect()
    for p in range(3):
        used, want = {}, []
        for _, y, x, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[3], r[1], r[2])):
            if len(want) < 6 and used.get(y, 0) < 2 and used.get(x, 0) < 2:
                want.append((y, x))
                used[y], used[x] = used.get(y, 0) + 1, used.get(x, 0) + 1
        assert [(r["y"], r["x"]) for r in sorted((r for r in got if r["p"] == p), key=lambda r: r["place"])] == want


@pytest.mark.parametrize(("k", "cap"), [(1, 1), (5, 1), (7, 2), (40, 3), (400, 2), (0, 2), (3, 0)])
def test_capped_walk_of_pools_larger_than_its_bound(spark, k, cap):
    """One hot ticker has most of the best pairs; scores tie, some are missing or NaN; all columns stay, in order."""
    g = np.random.default_rng(k + cap)
    names = [f"t{i:02d}" for i in range(30)]
    score = lambda y: None if g.random() < 0.05 else math.nan if g.random() < 0.05 else float(np.round(g.random() + (y < "t03"), 1))
    rows = [(p, y, x, score(y), y + x) for p in (1, None) for y in names for x in names if y < x]
    out = ranking.capped_top_k(spark.createDataFrame(rows, "p int, y string, x string, s double, _extra string"), ["p"], "s", k, cap)
    assert out.columns == ["p", "y", "x", "s", "_extra", "place"]
    got = {(r["p"], r["place"]): (r["y"], r["x"], r["_extra"]) for r in out.collect()}
    want = {}
    for p in (1, None):
        used, n = {}, 0
        for _, y, x, s, extra in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3] is None, r[3] != r[3], -r[3] if r[3] is not None and r[3] == r[3] else 0, r[1], r[2])):
            if n < k and used.get(y, 0) < cap and used.get(x, 0) < cap:
                n += 1
                want[p, n] = (y, x, extra)
                used[y], used[x] = used.get(y, 0) + 1, used.get(x, 0) + 1
    assert got == want


def test_capped_walk_passes_a_bounded_number_of_rows(spark):
    plan = ranking.capped_top_k(spark.createDataFrame([(1, "a", "b", 1.0)], "p int, y string, x string, s double"), ["p"], "s", 50, 5)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and plan.count("WindowGroupLimit") >= 3


def test_keyed_places_are_even(spark):
    """k distinct places of each pool and draw; single places and pairs of places come as often as they should (5 deviations)."""
    n = 4000
    sizes = [(1, 3), (2, 1), (3, 2), (7, 3), (10, 4), (26, 5), (100, 5), (1000, 8)]
    groups = spark.createDataFrame([(m, m, k) for m, k in sizes], "g int, m long, k long")
    found = {}
    for r in ranking.keyed_places(groups, ["g"], n, 3).collect():
        found.setdefault(r["g"], {})[r["draw"]] = r["places"]
    for m, k in sizes:
        k, drawn = min(m, k), found[m]
        assert len(drawn) == n and all(len(set(p)) == len(p) == k and min(p) >= 0 and max(p) < m for p in drawn.values())
        counts = np.bincount([p for ps in drawn.values() for p in ps], minlength=m)
        share = k / m
        assert np.abs(counts - n * share).max() <= 5 * math.sqrt(n * share * (1 - share)) + 1e-9
        if 2 <= k and m <= 26:
            both = np.zeros((m, m))
            for ps in drawn.values():
                for a in ps:
                    both[a, [b for b in ps if b != a]] += 1
            share = k * (k - 1) / (m * (m - 1))
            off = ~np.eye(m, dtype=bool)
            assert np.abs(both[off] - n * share).max() <= 5 * math.sqrt(n * share * (1 - share)) + 1e-9
    again = {(r["g"], r["draw"]): r["places"] for r in ranking.keyed_places(groups.repartition(3), ["g"], 20, 3).collect()}
    assert all(again[g, d] == found[g][d] for g, d in again)


def test_keyed_places_of_nothing(spark):
    groups = spark.createDataFrame([(1, 0, 3), (2, 5, 0), (None, 4, 2)], "g int, m long, k long")
    got = {(r["g"], r["draw"]): r["places"] for r in ranking.keyed_places(groups, ["g"], 2).collect()}
    assert got[2, 1] == got[2, 2] == [] and (1, 1) not in got and len(got[None, 1]) == 2


@pytest.mark.parametrize(("block", "together", "spread"), [(1024, 64, 16), (3, 2, 2), (1, 1, 1)])
def test_masked_sums_equal_a_loop(spark, block, together, spread):
    """Blocks of any size; missing values and days, days of two periods, repeated rows of a day, draws that pick nothing."""
    g = np.random.default_rng(4)
    daily = [(p, f"k{i}", t, None if g.random() < 0.2 else float(g.integers(-9, 9))) for p in (1, 2) for i in range(8) for t in range(p * 5, p * 5 + 8) if g.random() < 0.8 for _ in range(1 + (i == 0))]
    places = [(p, f"k{i}", i) for p in (1, 2) for i in range(8)]
    picks = [(p, d, [int(v) for v in g.permutation(8)[: int(g.integers(0, 5))]]) for p in (1, 2) for d in range(1, 12)]
    got = research.masked_sums(spark.createDataFrame(picks, "p int, draw int, places array<long>"), spark.createDataFrame(places, "p int, k string, pos long"),
                               spark.createDataFrame(daily, "p int, k string, t int, v double"), ["p"], ["k"], "v", block, together, spread)
    want = {}
    for p, d, ps in picks:
        for q, k, t, v in daily:
            if p == q and int(k[1:]) in ps and v is not None:
                want[d, t] = want.get((d, t), 0) + v
    assert {(r["draw"], r["t"]): r["v"] for r in got.collect()} == want


def test_bootstrap_is_near_a_resampling(spark):
    """The interval of Poisson weights against rows drawn with replacement; a series with a large mean, missing values, constant and short series."""
    g = np.random.default_rng(11)
    series_ = {"a": g.normal(0.05, 1, 500), "b": g.standard_t(4, 300) + 0.2, "far": g.normal(1e6, 1.0, 200)}
    rows = [(k, t, float(v)) for k, vs in series_.items() for t, v in enumerate(vs)] + [("flat", t, 2.0) for t in range(40)] + [("holes", t, None if t % 2 else math.nan) for t in range(50)]
    got = {r["k"]: r for r in research.bootstrap_sharpe(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "v", 2000).collect()}
    assert set(got) == {"a", "b", "far"}
    for k, v in series_.items():
        spot = v[g.integers(0, len(v), (4000, len(v)))]
        low, high = np.percentile(spot.mean(axis=1) / spot.std(axis=1, ddof=1) * math.sqrt(252), [2.5, 97.5])
        assert abs(got[k]["low"] - low) < 0.12 * (high - low) and abs(got[k]["high"] - high) < 0.12 * (high - low)


def test_formation_keeps_ineligible_pairs_out(spark):
    rows = spark.createDataFrame([(0, "a", "b", 3.0, 0), (0, "a", "c", 2.0, 2), (0, "b", "c", 1.0, 2), (0, "c", "d", None, 2), (0, "d", "e", -1.0, 3)], "period int, y string, x string, f_pnl double, f_trades int")
    for cap in (0, 9):
        got = {r["y"] + r["x"]: (r["eligible"], r["selected"]) for r in selection.formation_top_k(rows, ["period"], "f_pnl", 2, cap).collect()}
        assert got["ab"] == (False, False) and [k for k, v in sorted(got.items()) if v[1]] == ["ac", "bc"]
    assert selection.formation_top_k(rows, ["period"], "f_pnl", 9, positive=True).filter("selected").count() == 2


def test_an_empty_pool_stays_in_cash(spark):
    panel = spark.range(300).select(F.col("id").cast("int").alias("t"))
    periods, screens_ = rescreen.windows(panel, 100, 50, 2, 80)
    assert [(r["period"], r["lo"], r["hi"], r["screen"]) for r in periods.orderBy("period").collect()] == [(0, 100, 150, 0), (1, 150, 200, 0), (2, 200, 250, 1), (3, 250, 300, 1)]
    assert sorted((r["screen"], r["lo"], r["hi"]) for r in screens_.collect()) == [(0, 20, 100), (1, 120, 200)]
    daily = spark.createDataFrame([("a", "b", t, 1.0, 1, 1) for t in range(100, 200)], "y string, x string, t int, pnl double, run int, held int")
    pools = spark.createDataFrame([(0, "a", "b", 1)], "screen int, y string, x string, screen_rank int")
    log = rescreen.selection_log(daily, pools, periods, 50, 1)
    got = {r["period"]: r for r in rescreen.period_table(log, periods, 1).collect()}
    assert got[1]["sel_net"] == 50.0 and got[1]["names"] == "a/b" and got[3]["pool_size"] == 0 and got[3]["sel_net"] == 0.0
    assert rescreen.daily_portfolio(daily, log, periods).count() == 200


def test_measures_of_draws(spark):
    daily = [(d, t, float(v)) for d, vs in enumerate(([1, -2, 3, 4], [0, 0, 0, 0])) for t, v in enumerate(vs)]
    got = {(r["d"], r["measure"]): r["v"] for r in research.measures(spark.createDataFrame(daily, "d int, t int, v double"), ["d"], "v", 10.0).collect()}
    v = np.array([1.0, -2, 3, 4])
    eq = 10 + v.cumsum()
    assert got[0, "net"] == 6 and got[0, "sharpe"] == pytest.approx(v.mean() / v.std(ddof=1) * math.sqrt(252)) and got[1, "sharpe"] is None
    assert got[0, "max_drawdown_pct"] == pytest.approx(100 * (eq / np.maximum.accumulate(eq) - 1).min())


def test_bootstrap_covers_the_sharpe(spark):
    g = np.random.default_rng(1)
    rows = [(k, t, float(v)) for k in ("a", "b") for t, v in enumerate(g.normal(0.1, 1, 400))] + [("short", t, 1.0) for t in range(10)]
    got = {r["k"]: r for r in research.bootstrap_sharpe(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "v").collect()}
    assert set(got) == {"a", "b"}
    for k in got:
        v = np.array([r[2] for r in rows if r[0] == k])
        assert got[k]["low"] < v.mean() / v.std(ddof=1) * math.sqrt(252) < got[k]["high"]


def test_sizes_from_train_rows(spark):
    """Risk of the spread sets the units, leverage bounds them; no variation: one unit, bounded too; prices are those of the last train row."""
    table = folds.table(spark, [(1, 0, 3, 3, 5, 5, 8)])
    rows = spark.createDataFrame([(y, "x", t, 10.0 * (t + 1), 5.0) for y in ("a", "b", "c") for t in range(8)], "y string, x string, t int, py double, px double")
    chosen = spark.createDataFrame([(1, "a", "x", -2.0, 100.0), (1, "b", "x", 1.0, 1e-3), (1, "c", "x", 1.0, 0.0)], "fold int, y string, x string, beta double, sd_change double")
    got = {(r["y"], r["risk_target"]): r["units"] for r in folded.sized(rows, table, chosen, [0.1, 0.2], 1000.0).collect()}
    assert got["a", 0.1] == pytest.approx(1000 * 0.1 / (100 * math.sqrt(252))) and got["a", 0.2] == pytest.approx(2 * got["a", 0.1])
    assert got["b", 0.1] == got["b", 0.2] == pytest.approx(2000 / 35) and got["c", 0.1] == 1.0


def test_report_of_cells_and_its_coverage(spark):
    """Two cells over two folds against a loop; a missing day fails the job, or is reported where gaps are allowed."""
    import datetime

    table = folds.table(spark, [(1, 0, 2, 2, 4, 4, 7), (2, 0, 4, 4, 7, 7, 10)])
    r = {1: [0.01, -0.02, 0.005, 0.0, -0.01, 0.02], 2: [0.02, 0.01, 0.0, 0.0, 0.03, 0.01]}
    daily = [(c, 1 if i < 3 else 2, 4 + i, v, 0.5, 1, 0.8) for c, vs in r.items() for i, v in enumerate(vs)] + [(c, 2, 6, 9.0, 0.5, 1, 0.8) for c in r]  # day 6 counts in fold 1
    daily = spark.createDataFrame(daily, "cell int, fold int, t int, r double, active_weight double, active_pairs int, base_weight double")
    dates = spark.createDataFrame([(t, datetime.date(2020, 1, 1) + datetime.timedelta(2 * t)) for t in range(12)], "t int, date date")
    members = spark.createDataFrame([(1, 3), (1, 4)], "cell int, test_trades int")
    got = {x["cell"]: x for x in folded.portfolio_report(daily, members, table, dates, ["cell"]).collect()}
    for c, vs in r.items():
        v = np.array(vs)
        eq = np.cumprod(1 + v)
        down, top = v[v < 0], np.maximum.accumulate(eq)
        longest = run = 0
        for under in eq < top - 1e-12:
            run = run + 1 if under else 0
            longest = max(longest, run)
        x = got[c]
        assert (x["oos_rows"], x["oos_calendar_days"], x["oos_complete"], x["max_drawdown_days"], x["completed_trades"]) == (6, 10, True, longest, 7 if c == 1 else 0)
        assert x["total_return"] == pytest.approx(eq[-1] - 1) and x["max_drawdown"] == pytest.approx((eq / top - 1).min()) and x["annualized_vol"] == pytest.approx(v.std(ddof=1) * math.sqrt(252))
        assert x["cagr"] == pytest.approx(eq[-1] ** (365.25 / 10) - 1) and x["sharpe"] == pytest.approx(v.mean() / v.std(ddof=1) * math.sqrt(252))
        assert x["sortino"] == (pytest.approx(v.mean() / math.sqrt((down**2).mean()) * math.sqrt(252)) if len(down) else math.inf)
    gap = daily.filter("t <> 5")
    with pytest.raises(Exception, match="not covered: 5 of 6"):
        folded.portfolio_report(gap, members, table, dates, ["cell"]).collect()
    assert {x["oos_complete"] for x in folded.portfolio_report(gap, members, table, dates, ["cell"], complete=False).collect()} == {False}


def test_cells_of_a_sweep_scale_the_same_money(spark):
    """Twice the risk is twice the return of a day, more pairs are more members; reallocation keeps within its caps."""
    table = folds.table(spark, [(1, 0, 2, 2, 4, 4, 6)])
    results = spark.createDataFrame([(1, y, "x", s, 4, 0.1, 3) for y, s in (("a", 2.0), ("b", 1.5), ("c", 1.0))], "fold int, y string, x string, val_sharpe double, val_trades int, val_cost_share double, test_trades int")
    chosen = spark.createDataFrame([(1, y, "x", 1.0) for y in "abc"], "fold int, y string, x string, sd_change double")
    test = spark.createDataFrame([(1, y, "x", t, 0.01 * (i + 1), int(t == 4 or i == 0)) for i, y in enumerate("abc") for t in (4, 5)], "fold int, y string, x string, t int, r double, executed int")
    sizes = spark.createDataFrame([(1, y, "x", risk, 10.0 * k) for y in "abc" for risk, k in ((0.1, 1), (0.2, 2))], "fold int, y string, x string, risk_target double, units double")
    daily, members = folded.swept(results, test, chosen, sizes, table, [1, 3], "equal", 0.4, filters=(0.0, 1, 0.3, 5), reallocate=False)
    got = {(x["risk_target"], x["top_k"], x["t"]): x["r"] for x in daily.collect()}
    assert len(got) == 8 and members.count() == 8
    assert got[0.1, 1, 4] == pytest.approx(0.01 * 0.4) and got[0.1, 3, 4] == pytest.approx(0.02) and got[0.2, 3, 5] == pytest.approx(0.04)
    daily, _ = folded.swept(results, test, chosen, sizes, table, [1, 3], "equal", 0.4, filters=(0.0, 1, 0.3, 5))
    weights = {(x["risk_target"], x["top_k"], x["t"]): x["active_weight"] for x in daily.collect()}
    # one pair is active on day 5: it takes its cap, and what is left goes to the idle ones in equal parts (see capped)
    assert weights[0.1, 3, 5] == pytest.approx(1.0) and weights[0.1, 3, 4] == pytest.approx(1.0)
    assert {(x["risk_target"], x["top_k"], x["t"]): x["r"] for x in daily.collect()}[0.1, 3, 5] == pytest.approx(0.5 * 0.01 + 0.25 * 0.02 + 0.25 * 0.03)


def test_reallocated_portfolio(spark):
    test = spark.createDataFrame([(1, "a", "b", 5, 0.02, 1), (1, "c", "d", 5, 0.01, 0), (1, "a", "b", 6, 0.02, 1), (1, "c", "d", 6, -0.01, 1)], "fold int, y string, x string, t int, r double, executed int")
    weights = spark.createDataFrame([(1, "a", "b", 0.25), (1, "c", "d", 0.25)], "fold int, y string, x string, weight double")
    table = folds.table(spark, [(1, 0, 2, 2, 5, 5, 8)])
    plain = {r["t"]: r for r in folded.portfolio_daily(test, weights, table).collect()}
    assert plain[5]["r"] == pytest.approx(0.0075) and plain[5]["active_weight"] == 0.25 and plain[7]["r"] == 0
    moved = {r["t"]: r for r in folded.portfolio_daily(test, weights, table, True, 0.5).collect()}
    assert moved[5]["r"] == pytest.approx(0.5 * 0.02 + 0.5 * 0.01) and moved[6]["r"] == pytest.approx(0.5 * 0.02 - 0.5 * 0.01)
    assert folded.covered(folded.portfolio_daily(test, weights, table), table)


def test_output_tables_round_trip(spark, tmp_path):
    log = spark.createDataFrame([(0, "a", "b", True), (1, "a", "c", False)], "period int, y string, x string, eligible boolean")
    daily = spark.createDataFrame([(0, "a", "b", 1, 2.0), (0, "a", "b", 2, 3.0)], "period int, y string, x string, t int, net double")
    tables.write_study("rolling", str(tmp_path / "r"), {"selection_log": log, "daily_pair_net": daily})
    back, money = tables.read_rolling(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, back.select(log.columns).collect())) == sorted(map(tuple, log.collect())) and money.agg(F.sum("net")).first()[0] == 5.0
    assert (tmp_path / "r" / "selection_log" / "period=0").is_dir()
    with pytest.raises(ValueError, match="no table"):
        tables.write_study("rolling", str(tmp_path / "s"), {"other": log})
    with pytest.raises(ValueError, match="lacks"):
        tables.write_study("rolling", str(tmp_path / "s"), {"screen_log": log})
    tables.write_study("explore", str(tmp_path / "c"), {"ranked_pairs": log.withColumn("place", F.lit(1))}, form="csv")
    assert spark.read.csv(str(tmp_path / "c" / "ranked_pairs"), header=True).count() == 2
    wide = tables.wide(daily.withColumn("pair", F.concat("y", "x")), "t", "pair", "net", ["ab", "zz"]).orderBy("t").collect()
    assert [(r["t"], r["ab"], r["zz"]) for r in wide] == [(1, 2.0, None), (2, 3.0, None)]


def test_lists(spark, tmp_path):
    assert lists.parse_pairs("a/b, C/d") == [("A", "B"), ("C", "D")] and lists.parse_grid("2,1.5,2") == [1.5, 2.0]
    for bad in ("A", "A/A", "", "A/B/C"):
        with pytest.raises(ValueError):
            lists.parse_pairs(bad)
    groups = lists.groups_table(spark, {"g": ["A", "B", "C"], "h": ["D"]})
    assert {r["grp"]: r["n_pairs"] for r in lists.group_sizes(groups).collect()} == {"g": 3, "h": 0}
    with pytest.raises(ValueError):
        lists.groups_table(spark, {"g": ["A"], "h": ["A"]})
    assert [r[0] for r in lists.ungrouped(spark.createDataFrame([("A",), ("Z",)], "ticker string"), groups).collect()] == ["Z"]
    (tmp_path / "c.csv").write_text("y,x,hedge_ratio\nA,B,1.5\nA,Z,1.0\n")
    pool = lists.read_candidates(spark, str(tmp_path / "c.csv"), groups)
    assert [(r["y"], r["x"], r["hedge_ratio"]) for r in pool.collect()] == [("A", "B", 1.5)]


def test_exit_tables_of_a_panel_without_trades(spark):
    panel = spark.createDataFrame([(0, "a", "b", 1.0, None)], "period int, y string, x string, v double, r double").withColumn("grp", F.lit("g"))
    assert predictive.ic_table(predictive.long(panel, ["v"], ["r"])).count() == 0 and performance.DAYS == 252
