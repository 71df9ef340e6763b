"""Queries over the sales tables, each with the SQL that states the same result.

The panel is brand x week (prices per unit); groups are brand number modulo 5.  Results
are rounded to six digits: sums in other orders differ in the last bits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clean, pairs, performance, portfolio, ranking, research, rolling, screens, simulate
from .plans import folded, folds, walkforward
from .plans.lineage import cut
from .sources import panel as sources
from .streaming.bars import bars

PAIR = ["y", "x"]
START, STEP, LOOKBACK = 120, 40, 100


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def R(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0)"


# ---------------------------------------------------------------- shared plans

# Nothing is kept in a session: a query gets its panel once, as a written table of a row per brand and week, and hands it on.
# Only that one step sees the line items; branches that start from the panel again read the written rows.

def _panel(spark, d):
    return sources.sales_panel(spark, d)


def _clean(spark, d):
    """The cleaned panel as a cut table.  Each call reads the line items, so a query calls it once."""
    return cut(clean.clean(cut(_panel(spark, d))))


def _pairs(panel):
    return pairs.pair_panel(panel)


def _spread(panel):
    return rolling.static_spread(_pairs(panel))


def _z(panel):
    """Raw-price rolling hedge of 60 weeks, spread, z of the 40 weeks before."""
    rows = rolling.rolling_ols(_pairs(panel), 60, lagged=True)
    rows = rows.withColumn("spread", F.col("py") - F.col("beta") * F.col("px") - F.col("alpha"))
    return rolling.lagged_z(rows, 40).filter("z IS NOT NULL").select(*PAIR, "grp", "t", "date", "py", "px", "alpha", "beta", F.round("z", 6).alias("z"))


def _block(panel):
    rows = rolling.block_z(_pairs(panel), START, STEP, LOOKBACK)
    return rows.withColumn("z", F.round("z", 6)).select(*PAIR, "grp", "t", "date", "block", "beta", "z", "ds")


def _screened(panel):
    return simulate.screener_pnl(simulate.screener_positions(_block(panel), PAIR, 1.5, 0.5, 4.0), PAIR)


def _engine(panel):
    rows = simulate.engine_positions(_z(panel), PAIR, 1.5, 0.5, 3.0, 3, 1.0)
    return simulate.engine_pnl(rows.withColumn("units", F.lit(10.0)), PAIR, borrow_bps=50.0)


def _blocks_pnl(panel):
    """Profit per pair and block: the panel of the studies."""
    s = _screened(panel)
    return s.groupBy(*PAIR, "grp", "block").agg(F.round(F.sum("pnl"), 6).alias("pnl"), F.round(F.avg(F.abs("z")), 6).alias("mean_z"), F.round(F.stddev_samp("z"), 6).alias("sd_z"))


# ---------------------------------------------------------------- shared SQL

PX = """px AS (SELECT p_brand AS ticker, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 5 AS grp, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
 (sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT / 100.0::DOUBLE / sum(CAST(l_quantity AS BIGINT))::BIGINT) AS close, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS volume
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
grid AS (SELECT tk.ticker, tk.grp, cal.date, px.close, px.volume FROM (SELECT DISTINCT ticker, grp FROM px) tk CROSS JOIN (SELECT DISTINCT date FROM px) cal
 LEFT JOIN px ON px.ticker = tk.ticker AND px.date = cal.date),
keep AS (SELECT ticker FROM grid GROUP BY ticker HAVING count(close) >= 0.95 * count(*)),
ff AS (SELECT ticker, grp, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close,
 coalesce(volume, 0) AS volume FROM grid SEMI JOIN keep USING (ticker)),
full_dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM ff GROUP BY date HAVING count(close) = count(*)),
panel AS (SELECT ticker, grp, date, CAST(t AS INT) AS t, close, volume FROM ff JOIN full_dates USING (date))"""
PP = PX + """,
pp AS (SELECT a.ticker AS y, b.ticker AS x, a.grp, a.t, a.date, a.close AS py, b.close AS px, ln(a.close) AS ly, ln(b.close) AS lx
 FROM panel a JOIN panel b ON a.grp = b.grp AND a.t = b.t AND a.ticker < b.ticker)"""
SP = PP + """,
hedge AS (SELECT y, x, regr_slope(ly, lx) AS beta, regr_intercept(ly, lx) AS alpha FROM pp GROUP BY y, x),
sp AS (SELECT pp.*, alpha, beta, ly - beta * lx - alpha AS spread FROM pp JOIN hedge USING (y, x))"""
W60 = "OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
ZZ = PP + f""",
ro AS (SELECT *, count(*) {W60} AS n, covar_samp(py, px) {W60} / nullif(var_samp(px) {W60}, 0) AS b, avg(py) {W60} AS ay, avg(px) {W60} AS ax FROM pp),
rs AS (SELECT *, CASE WHEN n = 60 THEN b END AS beta, CASE WHEN n = 60 THEN ay - b * ax END AS alpha FROM ro),
rz AS (SELECT *, py - beta * px - alpha AS spread FROM rs),
z0 AS (SELECT *, CASE WHEN count(spread) w >= 20 THEN (spread - avg(spread) w) / nullif(stddev_samp(spread) w, 0) END AS zz FROM rz
 WINDOW w AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
zt AS (SELECT y, x, grp, t, date, py, px, alpha, beta, {R('zz')} AS z FROM z0 WHERE zz IS NOT NULL)"""
ZZ = ZZ.replace("count(spread) w", "count(spread) OVER w").replace("avg(spread) w", "avg(spread) OVER w").replace("stddev_samp(spread) w", "stddev_samp(spread) OVER w")
BZ = PP + f""",
fits AS (SELECT p.y, p.x, b.block, regr_slope(ly, lx) AS beta, regr_intercept(ly, lx) AS alpha, sqrt(greatest(var_samp(ly) - regr_slope(ly, lx) * covar_samp(ly, lx), 0)) AS sd
 FROM pp p JOIN range(0, 100) b(block) ON p.t < {START} + b.block * {STEP} AND p.t >= {START} + b.block * {STEP} - {LOOKBACK} GROUP BY ALL HAVING count(*) > 2),
lv AS (SELECT *, ly - lag(ly) OVER w AS dly, lx - lag(lx) OVER w AS dlx FROM pp WINDOW w AS (PARTITION BY y, x ORDER BY t)),
bz AS (SELECT l.y, l.x, l.grp, l.t, l.date, f.block, f.beta, {R('(ly - f.alpha - f.beta * lx) / nullif(f.sd, 0)')} AS z, dly - f.beta * dlx AS ds
 FROM lv l JOIN fits f ON f.y = l.y AND f.x = l.x AND f.block = (l.t - {START}) // {STEP} WHERE l.t >= {START}),
bn AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY t) AS i FROM bz),
pos AS (WITH RECURSIVE go(y, x, i, p) AS (
  SELECT y, x, i, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 ELSE 0 END FROM bn WHERE i = 1
  UNION ALL SELECT b.y, b.x, b.i, CASE WHEN b.z IS NULL THEN g.p WHEN g.p = 0 THEN CASE WHEN b.z > 1.5 THEN -1 WHEN b.z < -1.5 THEN 1 ELSE 0 END
    WHEN abs(b.z) < 0.5 OR abs(b.z) > 4.0 THEN 0 ELSE g.p END FROM go g JOIN bn b ON b.y = g.y AND b.x = g.x AND b.i = g.i + 1) SELECT * FROM go),
sc0 AS (SELECT bn.*, pos.p AS position, coalesce(lag(pos.p) OVER (PARTITION BY bn.y, bn.x ORDER BY t), 0) AS held FROM bn JOIN pos USING (y, x, i)),
sc1 AS (SELECT *, held * coalesce(ds, 0) / (1 + abs(beta)) AS pnl,
 CASE WHEN held <> 0 AND coalesce(lag(held) OVER (PARTITION BY y, x ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS st FROM sc0),
sc AS (SELECT *, sum(st) OVER (PARTITION BY y, x ORDER BY t) AS run FROM sc1)"""
EN = ZZ + """,
en AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY t) AS i FROM zt),
eg AS (WITH RECURSIVE go(y, x, i, p, blocked, wait, hit) AS (
  SELECT y, x, i, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 ELSE 0 END, false, 0, false FROM en WHERE i = 1
  UNION ALL SELECT e.y, e.x, e.i,
    CASE WHEN g.blocked THEN 0 WHEN g.p = 0 THEN CASE WHEN e.z > 1.5 THEN -1 WHEN e.z < -1.5 THEN 1 ELSE 0 END WHEN abs(e.z) < 0.5 OR abs(e.z) > 3 THEN 0 ELSE g.p END,
    CASE WHEN g.blocked THEN NOT (greatest(g.wait - 1, 0) = 0 AND abs(e.z) <= 1) ELSE g.p <> 0 AND abs(e.z) > 3 END,
    CASE WHEN g.blocked THEN greatest(g.wait - 1, 0) WHEN g.p <> 0 AND abs(e.z) > 3 THEN 3 ELSE 0 END,
    NOT g.blocked AND g.p <> 0 AND abs(e.z) > 3
  FROM go g JOIN en e ON e.y = g.y AND e.x = g.x AND e.i = g.i + 1) SELECT * FROM go),
e0 AS (SELECT en.*, eg.p AS target, eg.hit AS stop_event, coalesce(lag(eg.p) OVER w, 0) AS executed, coalesce(lag(beta) OVER w, beta, 0) AS hedge
 FROM en JOIN eg USING (y, x, i) WINDOW w AS (PARTITION BY en.y, en.x ORDER BY t)),
e1 AS (SELECT *, executed * 10.0::DOUBLE AS la, -executed * hedge * 10.0::DOUBLE AS lb FROM e0),
e2 AS (SELECT *, coalesce(la * (lead(py) OVER w - py) + lb * (lead(px) OVER w - px), 0) AS gross,
 (abs(la - coalesce(lag(la) OVER w, 0)) * py + abs(lb - coalesce(lag(lb) OVER w, 0)) * px) * (6.0::DOUBLE / 1e4) AS cost,
 (greatest(-la, 0) * py + greatest(-lb, 0) * px) * (50.0::DOUBLE / 1e4 / 252) AS carry FROM e1 WINDOW w AS (PARTITION BY y, x ORDER BY t)),
ep AS (SELECT *, gross - cost - carry AS net FROM e2)"""
BP = BZ + f""",
bp AS (SELECT y, x, grp, block, {R('sum(pnl)')} AS pnl, {R('avg(abs(z))')} AS mean_z, {R('stddev_samp(z)')} AS sd_z FROM sc GROUP BY ALL)"""

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources and cleaning

@query(f"WITH {PX} SELECT ticker, grp, CAST(date AS VARCHAR) AS date, {R('close')} AS close, volume FROM px")
def panel_prices(spark, d):
    return r6(_panel(spark, d), "close").select("ticker", "grp", F.col("date").cast("string").alias("date"), "close", "volume")


@query(f"WITH {PX} SELECT ticker, grp, CAST(date AS VARCHAR) AS date, t, {R('close')} AS close, volume FROM panel")
def panel_clean_ffill(spark, d):
    return r6(_clean(spark, d), "close").withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {PX} SELECT ticker, count(close) AS n_present, {R('1 - count(close)::DOUBLE / (SELECT count(DISTINCT date) FROM px)')} AS missing, CAST(min(date) AS VARCHAR) AS first_date,
 CASE WHEN 1 - count(close)::DOUBLE / (SELECT count(DISTINCT date) FROM px) > 0.2 THEN 'too many missing' WHEN count(close) < 52 THEN 'short history' ELSE 'ok' END AS reason FROM px GROUP BY ticker""")
def completeness_report(spark, d):
    return r6(sources.completeness(cut(_panel(spark, d))), "missing").select("ticker", "n_present", "missing", F.col("first_date").cast("string").alias("first_date"), "reason")


@query(f"""WITH {PX}, r AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY t)) AS r FROM panel),
s AS (SELECT *, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS sig, CASE WHEN count(volume) OVER w = 20 THEN avg(volume) OVER w END AS adv
 FROM r WINDOW w AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT ticker, t, {R('coalesce(sig, median(sig) OVER (PARTITION BY ticker))')} AS sig, {R('adv')} AS adv FROM s""")
def panel_sig_adv(spark, d):
    return r6(clean.sig_adv(_clean(spark, d)), "sig", "adv").select("ticker", "t", "sig", "adv")


@query(f"""WITH {PX}, t AS (SELECT DISTINCT ticker, grp FROM panel) SELECT a.ticker AS y, b.ticker AS x, a.grp FROM t a JOIN t b ON a.grp = b.grp AND a.ticker < b.ticker""")
def pair_universe_grouped(spark, d):
    return pairs.universe(_clean(spark, d))


@query(f"""WITH {PX}, t AS (SELECT DISTINCT ticker, grp FROM panel), u AS (SELECT a.ticker AS y, b.ticker AS x, a.grp FROM t a JOIN t b ON a.ticker < b.ticker)
SELECT y, x, grp FROM u WHERE (y, x) IN (('Brand#11', 'Brand#12'), ('Brand#13', 'Brand#21'), ('Brand#22', 'Brand#31'))""")
def pair_whitelist_semi(spark, d):
    listed = spark.createDataFrame([("Brand#12", "Brand#11"), ("Brand#13", "Brand#21"), ("Brand#31", "Brand#22"), ("Brand#11", "none")], "a string, b string")
    return pairs.whitelist(pairs.universe(_clean(spark, d), within_groups=False), listed)


@query("""WITH d AS (SELECT CAST(DATE '2020-01-01' + CAST(i AS INT) AS DATE) AS date FROM range(0, 400) t(i))
SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS t, CAST(date AS VARCHAR) AS date FROM d WHERE isodow(date) <= 5 QUALIFY row_number() OVER (ORDER BY date) <= 250""")
def business_day_calendar(spark, d):
    return sources.business_days(spark, "2020-01-01", 250).withColumn("date", F.col("date").cast("string"))


@query("""SELECT event_type AS ticker, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS volume, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL""")
def event_bars(spark, d):
    out = bars(spark.read.parquet(f"{d}/events.parquet")).withColumn("volume", F.round("volume", 4))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---------------------------------------------------------------- pairs, regressions, windows

@query(f"""WITH {PP}, r AS (SELECT y, x, ly - lag(ly) OVER w AS ry, lx - lag(lx) OVER w AS rx, py - lag(py) OVER w AS dy, px - lag(px) OVER w AS dx FROM pp WINDOW w AS (PARTITION BY y, x ORDER BY t))
SELECT y, x, count(ry) AS n, {R('corr(ry, rx)')} AS ret_corr, {R('corr(dy, dx)')} AS change_corr FROM r GROUP BY y, x""")
def return_correlation(spark, d):
    out = rolling.returns(_pairs(_clean(spark, d))).groupBy(*PAIR).agg(F.count("ry").alias("n"), F.corr("ry", "rx").alias("ret_corr"), F.corr("dy", "dx").alias("change_corr"))
    return r6(out, "ret_corr", "change_corr")


@query(f"WITH {PP} SELECT y, x, {R('regr_intercept(ly, lx)')} AS alpha, {R('regr_slope(ly, lx)')} AS beta, count(*) AS n FROM pp GROUP BY y, x")
def hedge_log(spark, d):
    return r6(rolling.static_hedge(_pairs(_clean(spark, d))), "alpha", "beta")


@query(f"WITH {PP} SELECT y, x, {R('regr_intercept(py, px)')} AS alpha, {R('regr_slope(py, px)')} AS beta, count(*) AS n FROM pp GROUP BY y, x")
def hedge_raw(spark, d):
    return r6(rolling.static_hedge(_pairs(_clean(spark, d)), "py", "px"), "alpha", "beta")


@query(f"WITH {SP} SELECT y, x, t, {R('spread')} AS spread FROM sp")
def spread_log(spark, d):
    return r6(_spread(_clean(spark, d)), "spread").select(*PAIR, "t", "spread")


@query(f"""WITH {SP}, l AS (SELECT y, x, spread, lag(spread) OVER (PARTITION BY y, x ORDER BY t) AS s0 FROM sp), p AS (SELECT y, x, 1 + regr_slope(spread - s0, s0) AS phi FROM l GROUP BY y, x)
SELECT y, x, CASE WHEN phi > 0 AND phi < 1 THEN {R('-ln(2.0::DOUBLE) / ln(phi)')} END AS half_life FROM p""")
def half_life_v1(spark, d):
    return r6(rolling.half_life_ar1(_spread(_clean(spark, d))), "half_life")


@query(f"""WITH {SP}, l AS (SELECT y, x, spread, lag(spread) OVER (PARTITION BY y, x ORDER BY t) AS s0 FROM sp), p AS (SELECT y, x, regr_slope(spread - s0, s0) AS b, count(*) AS n FROM l GROUP BY y, x)
SELECT y, x, CASE WHEN n >= 30 THEN CASE WHEN b >= 0 THEN 'inf'::DOUBLE ELSE {R('-ln(2.0::DOUBLE) / b')} END END AS half_life FROM p""")
def half_life_v2(spark, d):
    out = rolling.half_life_slope(_spread(_clean(spark, d)))
    return out.withColumn("half_life", F.when(F.col("half_life") == float("inf"), F.col("half_life")).otherwise(F.round("half_life", 6)))


@query(f"""WITH {SP}, m AS (SELECT y, x, count(*) AS n FROM sp GROUP BY y, x), g AS (SELECT a.y, a.x, k.lag, stddev_pop(b.spread - a.spread) AS tau FROM sp a JOIN m ON m.y = a.y AND m.x = a.x
 JOIN range(2, 50) k(lag) ON k.lag < greatest(3, least(50, m.n // 4)) JOIN sp b ON b.y = a.y AND b.x = a.x AND b.t = a.t + k.lag GROUP BY ALL)
SELECT y, x, {R('regr_slope(ln(tau), ln(lag::DOUBLE))')} AS hurst FROM g WHERE tau > 0 GROUP BY y, x""")
def hurst(spark, d):
    return r6(rolling.hurst(_spread(_clean(spark, d))), "hurst")


_W = "OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {PP}, o AS (SELECT *, count(*) {_W} AS n, covar_samp(py, px) {_W} / nullif(var_samp(px) {_W}, 0) AS b, avg(py) {_W} AS ay, avg(px) {_W} AS ax FROM pp)
SELECT y, x, t, {R('CASE WHEN n = 60 THEN b END')} AS beta, {R('CASE WHEN n = 60 THEN ay - b * ax END')} AS alpha FROM o""")
def rolling_ols_today(spark, d):
    return r6(rolling.rolling_ols(_pairs(_clean(spark, d)), 60, lagged=False), "beta", "alpha").select(*PAIR, "t", "beta", "alpha")


@query(f"""WITH {PP}, o AS (SELECT *, count(*) {W60} AS n, covar_samp(py, px) {W60} / nullif(var_samp(px) {W60}, 0) AS b, covar_samp(py, px) {W60} AS c, var_samp(py) {W60} AS vy, avg(py) {W60} AS ay, avg(px) {W60} AS ax FROM pp)
SELECT y, x, t, {R('CASE WHEN n = 60 THEN b END')} AS beta, {R('CASE WHEN n = 60 THEN ay - b * ax END')} AS alpha, {R('CASE WHEN n = 60 THEN sqrt(greatest(vy - b * c, 0)) END')} AS resid_sd FROM o""")
def rolling_ols_causal(spark, d):
    return r6(rolling.rolling_ols(_pairs(_clean(spark, d)), 60, lagged=True), "beta", "alpha", "resid_sd").select(*PAIR, "t", "beta", "alpha", "resid_sd")


@query(f"WITH {ZZ} SELECT y, x, t, z FROM zt")
def rolling_z(spark, d):
    return _z(_clean(spark, d)).select(*PAIR, "t", "z")


@query(f"""WITH {SP}, o AS (SELECT y, x, t, spread, count(*) {_W} AS n, avg(spread) {_W} AS m, stddev_samp(spread) {_W} AS s FROM sp)
SELECT y, x, t, {R('CASE WHEN n = 60 THEN m END')} AS mean, {R('CASE WHEN n = 60 THEN s END')} AS sd, {R('CASE WHEN n = 60 THEN (spread - m) / nullif(s, 0) END')} AS z FROM o""")
def plot_z(spark, d):
    return r6(rolling.display_z(_spread(_clean(spark, d))), "mean", "sd", "z").select(*PAIR, "t", "mean", "sd", "z")


@query(f"WITH {BZ} SELECT y, x, CAST(block AS INT) AS block, t, {R('beta')} AS beta, z, {R('ds')} AS ds FROM bz")
def block_walk_forward(spark, d):
    return r6(_block(_clean(spark, d)), "beta", "ds").select(*PAIR, F.col("block").cast("int").alias("block"), "t", "beta", "z", "ds")


@query(f"""WITH {BZ}, c AS (SELECT y, x, z < 0 AS neg, abs(z) > 1.5 AS o, lag(z < 0) OVER w AS neg0, lag(abs(z) > 1.5) OVER w AS o0 FROM bz WHERE z IS NOT NULL WINDOW w AS (PARTITION BY y, x ORDER BY t))
SELECT y, x, count(*) AS n, count(*) FILTER (WHERE neg <> neg0) AS n_cross, count(*) FILTER (WHERE o AND NOT o0) AS n_entry FROM c GROUP BY y, x""")
def crossings_and_entries(spark, d):
    return rolling.crossings(_block(_clean(spark, d)), 1.5)


@query(f"""WITH {BZ}, s AS (SELECT y, x, avg(abs(beta)) AS b, stddev_pop(beta) / nullif(abs(avg(beta)), 0) AS cv, avg(abs(ds)) * 1e4 AS move FROM bz GROUP BY y, x)
SELECT y, x, {R('1 / (1 + b)')} AS weight_y, {R('b / (1 + b)')} AS weight_x, {R('cv')} AS beta_cv, {R('move / (1 + b)')} AS gross_bps, {R('move / (1 + b) - 20.0')} AS net_bps, {R('move / (1 + b) / 20.0')} AS edge_ratio FROM s""")
def screen_costs_edge(spark, d):
    s = _block(_clean(spark, d)).groupBy(*PAIR).agg(F.avg(F.abs("beta")).alias("b"), (F.stddev_pop("beta") / F.nullif(F.abs(F.avg("beta")), F.lit(0.0))).alias("beta_cv"), (F.avg(F.abs("ds")) * 1e4).alias("move"))
    gross = F.col("move") / (1 + F.col("b"))
    out = s.select(*PAIR, (1 / (1 + F.col("b"))).alias("weight_y"), (F.col("b") / (1 + F.col("b"))).alias("weight_x"), "beta_cv", gross.alias("gross_bps"), (gross - 20.0).alias("net_bps"), (gross / 20.0).alias("edge_ratio"))
    return r6(out, "weight_y", "weight_x", "beta_cv", "gross_bps", "net_bps", "edge_ratio")


# ---------------------------------------------------------------- ranks, corrections, studies

@query(f"""WITH {SP}, p AS (SELECT grp, y, x, CASE WHEN y = 'Brand#11' THEN NULL ELSE {R('least(1, abs(regr_slope(ly, lx)))')} END AS p FROM sp GROUP BY grp, y, x),
k AS (SELECT *, count(p) OVER (PARTITION BY grp) AS m, row_number() OVER (PARTITION BY grp ORDER BY p NULLS LAST, y, x) AS k FROM p)
SELECT grp, y, x, p, CASE WHEN p IS NOT NULL THEN {R('least(1, p * m)')} END AS p_bonferroni,
 CASE WHEN p IS NOT NULL THEN {R('least(1, min(p * m / k) OVER (PARTITION BY grp ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} END AS p_bh,
 CASE WHEN p IS NOT NULL THEN {R('least(1, max(p * (m - k + 1)) OVER (PARTITION BY grp ORDER BY k))')} END AS p_holm FROM k""")
def multiple_testing(spark, d):
    p = _pairs(_clean(spark, d)).groupBy("grp", *PAIR).agg(F.least(F.lit(1.0), F.abs(F.regr_slope("ly", "lx"))).alias("p"))
    p = r6(p, "p").withColumn("p", F.when(F.col("y") != "Brand#11", F.col("p")))
    return r6(ranking.corrected(p, ["grp"], "p", PAIR), "p_bonferroni", "p_bh", "p_holm").select("grp", *PAIR, "p", "p_bonferroni", "p_bh", "p_holm")


_RANKS = BP + """,
rk AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY mean_z) + (count(*) OVER (PARTITION BY block, mean_z) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY block ORDER BY pnl) + (count(*) OVER (PARTITION BY block, pnl) - 1) / 2.0::DOUBLE AS b, count(*) OVER (PARTITION BY block) AS n FROM bp)"""


@query(f"WITH {_RANKS} SELECT CAST(block AS INT) AS block, count(*) AS n, CASE WHEN count(*) >= 8 AND stddev_samp(a) > 0 AND stddev_samp(b) > 0 THEN {R('covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b))')} END AS ic FROM rk GROUP BY block")
def rank_ic(spark, d):
    return r6(ranking.rank_ic(_blocks_pnl(_clean(spark, d)), ["block"], "mean_z", "pnl"), "ic").withColumn("block", F.col("block").cast("int"))


@query(f"""WITH {_RANKS}, i AS (SELECT block, CASE WHEN count(*) >= 8 AND stddev_samp(a) > 0 AND stddev_samp(b) > 0 THEN covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) END AS ic FROM rk GROUP BY block)
SELECT count(ic) AS n, {R('avg(ic)')} AS mean, {R('avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))')} AS t FROM i""")
def ic_t_summary(spark, d):
    return r6(research.t_summary(ranking.rank_ic(_blocks_pnl(_clean(spark, d)), ["block"], "mean_z", "pnl"), [], "ic").drop("p"), "mean", "t")


@query(f"""WITH {_RANKS}, q AS (SELECT *, CAST(least(floor((a - 1) * 5 / n), 4) AS INT) + 1 AS q FROM rk)
SELECT q, count(*) AS n, {R('avg(pnl)')} AS mean_pnl, {R('median(pnl)')} AS median_pnl, {R('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM q GROUP BY q""")
def quintile_sort(spark, d):
    q = _blocks_pnl(_clean(spark, d)).withColumn("q", ranking.quintile("mean_z", ["block"]))
    out = q.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("mean_pnl"), F.percentile("pnl", 0.5).alias("median_pnl"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("hit_rate"))
    return r6(out, "mean_pnl", "median_pnl", "hit_rate")


@query(f"""WITH {BP}, k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY pnl, y, x) AS r, count(*) OVER (PARTITION BY block) AS n FROM bp)
SELECT y, x, CAST(block AS INT) AS block, CAST(greatest(1, ceil((r - 1) * 5 / (n - 1)::DOUBLE)) AS INT) AS bucket FROM k""")
def formation_qcut(spark, d):
    b = _blocks_pnl(_clean(spark, d)).withColumn("bucket", ranking.quantile_cut("pnl", ["block"], PAIR))
    return b.select(*PAIR, F.col("block").cast("int").alias("block"), "bucket")


@query(f"WITH {BP} SELECT y, x, CAST(block AS INT) AS block, {R('(pnl - avg(pnl) OVER w) / nullif(stddev_pop(pnl) OVER w, 0)')} AS z FROM bp WINDOW w AS (PARTITION BY block)")
def zscore_within(spark, d):
    out = _blocks_pnl(_clean(spark, d)).withColumn("z", ranking.zscore_within("pnl", ["block"]))
    return r6(out, "z").select(*PAIR, F.col("block").cast("int").alias("block"), "z")


@query(f"""WITH {BP}, m AS (SELECT mean_z - avg(mean_z) OVER (PARTITION BY block) AS a, pnl - avg(pnl) OVER (PARTITION BY block) AS b FROM bp)
SELECT count(*) AS n, {R('sum(a * b) / sum(a * a)')} AS coef FROM m""")
def ols_no_intercept(spark, d):
    return r6(research.slope(research.demeaned(_blocks_pnl(_clean(spark, d)), ["block"], "mean_z", "pnl"), "mean_z", "pnl"), "coef")


@query(f"""WITH {BP}, f AS (SELECT *, CASE WHEN sd_z > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gate FROM bp),
m AS (SELECT grp, gate - avg(gate) OVER w AS a, pnl - avg(pnl) OVER w AS b, gate, pnl FROM f WINDOW w AS (PARTITION BY block, grp))
SELECT grp, count(*) AS n, {R('sum(a * b) / nullif(sum(a * a), 0)')} AS coef FROM m GROUP BY grp""")
def gate_demeaned_slope(spark, d):
    g = _blocks_pnl(_clean(spark, d)).withColumn("gate", F.when(F.col("sd_z") > 1, 1.0).otherwise(0.0))
    return r6(research.slope(research.demeaned(g, ["block", "grp"], "gate", "pnl"), "gate", "pnl", ["grp"]), "coef")


@query(f"""WITH {BP}, m AS (SELECT *, mean_z - avg(mean_z) OVER (PARTITION BY block) AS a, pnl - avg(pnl) OVER (PARTITION BY block) AS b FROM bp),
c AS (SELECT sum(a * b) / sum(a * a) AS coef, sum(a * a) AS xx, count(*) AS n FROM m), u AS (SELECT m.*, a * (b - coef * a) AS u FROM m, c),
m1 AS (SELECT sum(s * s) * count(*) / (count(*) - 1) AS v FROM (SELECT sum(u) AS s FROM u GROUP BY block)), m2 AS (SELECT sum(s * s) * count(*) / (count(*) - 1) AS v FROM (SELECT sum(u) AS s FROM u GROUP BY y, x)),
m3 AS (SELECT sum(s * s) * count(*) / (count(*) - 1) AS v FROM (SELECT sum(u) AS s FROM u GROUP BY block, y, x))
SELECT n, {R('coef')} AS coef, CASE WHEN m1.v + m2.v - m3.v > 0 THEN {R('sqrt(greatest((m1.v + m2.v - m3.v) / (xx * xx), 0))')} END AS se FROM c, m1, m2, m3""")
def clustered_se(spark, d):
    rows = research.demeaned(_blocks_pnl(_clean(spark, d)), ["block"], "mean_z", "pnl")
    return r6(research.clustered_slope(rows, "mean_z", "pnl", ["block"], PAIR), "coef", "se").select("n", "coef", "se")


# ---------------------------------------------------------------- machines and money

@query(f"WITH {BZ} SELECT y, x, t, position, held, {R('pnl')} AS pnl FROM sc")
def screener_positions(spark, d):
    return r6(_screened(_clean(spark, d)), "pnl").select(*PAIR, "t", "position", "held", "pnl")


@query(f"""WITH {BZ}, tr AS (SELECT y, x, run, sum(pnl) AS net, count(*) AS days_held FROM sc WHERE held <> 0 GROUP BY ALL)
SELECT y, x, count(*) AS n_trades, {R('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {R('avg(net)')} AS expectancy, {R('avg(days_held)')} AS avg_days, {R('least(coalesce(min(net), 0), 0)')} AS worst FROM tr GROUP BY y, x""")
def screener_trades(spark, d):
    tr = _screened(_clean(spark, d)).filter("held <> 0").groupBy(*PAIR, "run").agg(F.sum("pnl").alias("net"), F.count(F.lit(1)).alias("days_held"))
    return r6(performance.trade_stats(tr, PAIR), "win_rate", "expectancy", "avg_days", "worst").select(*PAIR, "n_trades", "win_rate", "expectancy", "avg_days", "worst")


@query(f"WITH {EN} SELECT y, x, t, target, stop_event FROM e0")
def engine_positions(spark, d):
    return simulate.engine_positions(_z(_clean(spark, d)), PAIR, 1.5, 0.5, 3.0, 3, 1.0).select(*PAIR, "t", "target", "stop_event")


@query(f"WITH {EN} SELECT y, x, t, executed, {R('gross')} AS gross, {R('cost')} AS cost, {R('carry')} AS carry, {R('net')} AS net FROM ep")
def engine_pnl(spark, d):
    return r6(_engine(_clean(spark, d)), "gross", "cost", "carry", "net").select(*PAIR, "t", "executed", "gross", "cost", "carry", "net")


@query(f"""WITH {EN}, s AS (SELECT *, CASE WHEN executed <> 0 AND coalesce(lag(executed) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st FROM ep WINDOW w AS (PARTITION BY y, x ORDER BY t)),
u AS (SELECT *, sum(st) OVER (PARTITION BY y, x ORDER BY t)::BIGINT AS run FROM s)
SELECT y, x, run, min(t) AS entry_t, max(t) AS last_t, count(*) AS days_held, {R('sum(gross)')} AS gross, {R('sum(cost)')} AS cost, {R('sum(net)')} AS net FROM u WHERE executed <> 0 GROUP BY ALL""")
def trade_log(spark, d):
    return r6(simulate.trade_log(_engine(_clean(spark, d)), PAIR), "gross", "cost", "net").select(*PAIR, "run", "entry_t", "last_t", "days_held", "gross", "cost", "net")


@query(f"""WITH {EN}, q AS (SELECT *, 10000.0 + sum(net) OVER w AS eq FROM ep WINDOW w AS (PARTITION BY y, x ORDER BY t)), dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY y, x ORDER BY t) - 1 AS dd FROM q)
SELECT y, x, count(*) AS n_days, {R('sum(net)')} AS net, {R('sum(net) / 10000.0 * 100')} AS return_pct, {R('avg(net) / 10000.0 * 252 * 100')} AS ann_return_pct,
 {R('stddev_samp(net) / 10000.0 * sqrt(252.0::DOUBLE) * 100')} AS ann_vol_pct, CASE WHEN stddev_samp(net) > 0 THEN {R('avg(net) / stddev_samp(net) * sqrt(252.0::DOUBLE)')} END AS sharpe, {R('min(dd) * 100')} AS max_drawdown_pct FROM dd GROUP BY y, x""")
def perf_stats(spark, d):
    return r6(performance.perf_stats(_engine(_clean(spark, d)), PAIR, 10_000.0), "net", "return_pct", "ann_return_pct", "ann_vol_pct", "sharpe", "max_drawdown_pct")


@query(f"""WITH {BZ} SELECT y, x, count(pnl) AS n, CASE WHEN stddev_samp(pnl) > 1e-12 THEN {R('avg(pnl) / stddev_samp(pnl) * sqrt(252.0::DOUBLE)')} END AS sharpe, {R('stddev_samp(pnl) * sqrt(252.0::DOUBLE)')} AS vol,
 CASE WHEN avg(pnl * pnl) FILTER (WHERE pnl < 0) > 0 THEN {R('avg(pnl) / sqrt(avg(pnl * pnl) FILTER (WHERE pnl < 0)) * sqrt(252.0::DOUBLE)')} WHEN avg(pnl) > 0 THEN 'inf'::DOUBLE END AS sortino FROM sc GROUP BY y, x""")
def sharpe_sortino(spark, d):
    out = performance.sharpe_sortino(_screened(_clean(spark, d)), PAIR, "pnl")
    return r6(out, "sharpe", "vol").withColumn("sortino", F.when(F.col("sortino") == float("inf"), F.col("sortino")).otherwise(F.round("sortino", 6)))


@query(f"""WITH {PX}, q AS (SELECT ticker, t, close / max(close) OVER (PARTITION BY ticker ORDER BY t) - 1 AS dd FROM panel),
u AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY t) AS run FROM q), r AS (SELECT ticker, run, min(dd) AS low, count(*) FILTER (WHERE dd < 0) AS under FROM u GROUP BY ALL)
SELECT ticker, {R('greatest(min(low), -1)')} AS max_drawdown, max(under) AS longest_under FROM r GROUP BY ticker""")
def drawdown_duration(spark, d):
    return r6(performance.drawdowns(_clean(spark, d), ["ticker"], "close"), "max_drawdown")


@query(f"""WITH {PX} SELECT ticker, CAST(max(date) - min(date) AS INT) AS days, {R('pow(arg_max(close, date) / arg_min(close, date), 365.25 / (max(date) - min(date))) - 1')} AS cagr FROM panel GROUP BY ticker""")
def cagr(spark, d):
    return r6(performance.cagr(_clean(spark, d), ["ticker"], "close"), "cagr")


def _period_sql(fmt: str) -> str:
    return f"""WITH {PX}, r AS (SELECT ticker, strftime(date, '{fmt}') AS period, coalesce(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 0) AS r FROM panel)
SELECT ticker, period, {R('product(1 + r) - 1')} AS ret, count(*) AS n_days FROM r GROUP BY ALL"""


@query(_period_sql("%Y-%m"))
def monthly_returns(spark, d):
    return r6(performance.period_returns(_clean(spark, d), ["ticker"], "close", "yyyy-MM"), "ret")


@query(_period_sql("%Y"))
def annual_returns(spark, d):
    return r6(performance.period_returns(_clean(spark, d), ["ticker"], "close", "yyyy"), "ret")


# ---------------------------------------------------------------- studies as one job

@query(f"""WITH {BZ}, s AS (SELECT (t - {START}) // {STEP} AS period, y, x, sum(pnl) AS pnl, count(*) FILTER (WHERE held <> 0) AS m FROM sc GROUP BY ALL),
j AS (SELECT CAST(a.period + 1 AS INT) AS period, a.y, a.x, a.pnl AS f, b.pnl AS nx FROM s a JOIN s b ON b.period = a.period + 1 AND b.y = a.y AND b.x = a.x WHERE a.m > 0)
SELECT period, y, x, {R('f')} AS f_pnl, {R('nx')} AS next_pnl, CAST(row_number() OVER w AS INT) AS place, row_number() OVER w <= 10 AS selected FROM j WINDOW w AS (PARTITION BY period ORDER BY f DESC, y, x)""")
def rolling_selection(spark, d):
    out = walkforward.rolling_selection(_screened(_clean(spark, d)), START, STEP, 10)
    return r6(out, "f_pnl", "next_pnl").select("period", *PAIR, "f_pnl", "next_pnl", "place", "selected")


@query(f"""WITH {BZ}, s AS (SELECT (t - {START}) // {STEP} AS period, y, x, sum(pnl) AS pnl, count(*) FILTER (WHERE held <> 0) AS m FROM sc GROUP BY ALL),
j AS (SELECT CAST(a.period + 1 AS INT) AS period, a.y, a.x, a.pnl AS f, b.pnl AS nx FROM s a JOIN s b ON b.period = a.period + 1 AND b.y = a.y AND b.x = a.x WHERE a.m > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY f DESC, y, x) AS p FROM j)
SELECT period, count(*) AS n_pool, count(*) FILTER (WHERE p <= 10) AS n_selected, {R('sum(nx) FILTER (WHERE p <= 10)')} AS sel_pnl, {R('sum(nx)')} AS all_pnl,
 {R('avg(CASE WHEN nx > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE p <= 10)')} AS sel_hit_rate, string_agg(y || '/' || x, ', ' ORDER BY p) FILTER (WHERE p <= 10) AS names FROM k GROUP BY period""")
def period_summary(spark, d):
    out = walkforward.period_summary(walkforward.rolling_selection(_screened(_clean(spark, d)), START, STEP, 10))
    return r6(out, "sel_pnl", "all_pnl", "sel_hit_rate").select("period", "n_pool", "n_selected", "sel_pnl", "all_pnl", "sel_hit_rate", "names")


@query()
def topk_with_ticker_cap(spark, d):
    out = walkforward.rolling_selection(_screened(_clean(spark, d)), START, STEP, 8, per_ticker=2)
    return r6(out, "f_pnl", "next_pnl").select("period", *PAIR, "f_pnl", "next_pnl", F.col("place").cast("int").alias("place"))


_DRAWS = BP + """,
dr AS (SELECT d.draw, b.* FROM bp b, range(1, 201) d(draw)),
pk AS (SELECT *, row_number() OVER (PARTITION BY block, draw ORDER BY md5('0|' || draw || '|' || block || '|' || y || '|' || x), y, x) AS p FROM dr),
sm AS (SELECT draw, sum(pnl) AS v FROM pk WHERE p <= 5 GROUP BY draw),
ac AS (SELECT sum(pnl) AS actual FROM (SELECT pnl, row_number() OVER (PARTITION BY block ORDER BY mean_z DESC, y, x) AS p FROM bp) WHERE p <= 5)"""


@query(f"""WITH {_DRAWS} SELECT count(*) AS draws, {R('any_value(actual)')} AS actual, {R('avg(v)')} AS random_mean, {R('stddev_pop(v)')} AS random_std, {R('quantile_cont(v, 0.05)')} AS p5, {R('quantile_cont(v, 0.5)')} AS p50,
 {R('quantile_cont(v, 0.95)')} AS p95, {R('avg(CASE WHEN v < actual THEN 1.0 ELSE 0.0 END) * 100')} AS percentile, {R('(count(*) FILTER (WHERE v >= actual) + 1) / (count(*) + 1)::DOUBLE')} AS p_value FROM sm, ac""")
def random_baseline(spark, d):
    b = _blocks_pnl(_clean(spark, d))
    actual = ranking.top_k(b, ["block"], [F.col("mean_z").desc(), "y", "x"], 5).agg(F.sum("pnl").alias("actual"))
    out = research.permutation(b.select("block", *PAIR, "pnl"), actual, ["block"], PAIR, "pnl", 200, 5)
    return r6(out, "actual", "random_mean", "random_std", "p5", "p50", "p95", "percentile", "p_value")


def machine_sql(p: str, source: str, key: list[str]) -> str:
    """Positions and money of the re-arming machine as CTEs over source (key, entry, leave, t, z, beta, py, px); {p}2 has the daily rows, {p}c the totals of each key."""
    k, w = ", ".join(key), f"PARTITION BY {', '.join(key)} ORDER BY t"
    return f"""{p}n AS (SELECT *, row_number() OVER ({w}) AS i FROM {source}),
{p}g AS (WITH RECURSIVE go({k}, i, p, blocked, wait) AS (
  SELECT {k}, i, CASE WHEN z > entry THEN -1 WHEN z < -entry THEN 1 ELSE 0 END, false, 0 FROM {p}n WHERE i = 1
  UNION ALL SELECT {', '.join('e.' + c for c in key)}, e.i,
    CASE WHEN g.blocked THEN 0 WHEN g.p = 0 THEN CASE WHEN e.z > e.entry THEN -1 WHEN e.z < -e.entry THEN 1 ELSE 0 END WHEN abs(e.z) < e.leave OR abs(e.z) > 4 THEN 0 ELSE g.p END,
    CASE WHEN g.blocked THEN NOT (greatest(g.wait - 1, 0) = 0 AND abs(e.z) <= 1) ELSE g.p <> 0 AND abs(e.z) > 4 END,
    CASE WHEN g.blocked THEN greatest(g.wait - 1, 0) WHEN g.p <> 0 AND abs(e.z) > 4 THEN 5 ELSE 0 END
  FROM go g JOIN {p}n e ON {' AND '.join(f'e.{c} = g.{c}' for c in key)} AND e.i = g.i + 1) SELECT * FROM go),
{p}0 AS (SELECT n.*, coalesce(lag(g.p) OVER w, 0) AS executed, coalesce(lag(beta) OVER w, beta, 0) AS hedge FROM {p}n n JOIN {p}g g USING ({k}, i) WINDOW w AS (PARTITION BY {', '.join('n.' + c for c in key)} ORDER BY t)),
{p}1 AS (SELECT *, executed * 10.0::DOUBLE AS la, -executed * hedge * 10.0::DOUBLE AS lb FROM {p}0),
{p}2 AS (SELECT *, coalesce(la * (lead(py) OVER w - py) + lb * (lead(px) OVER w - px), 0) AS gross, (abs(la - coalesce(lag(la) OVER w, 0)) * py + abs(lb - coalesce(lag(lb) OVER w, 0)) * px) * (6.0::DOUBLE / 1e4) AS cost,
 CASE WHEN executed <> 0 AND coalesce(lag(executed) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st, max(t) OVER (PARTITION BY {k}) AS t_last FROM {p}1 WINDOW w AS ({w})),
{p}c AS (SELECT {k}, CASE WHEN stddev_samp(gross - cost) > 1e-12 AND count(*) >= 2 THEN avg(gross - cost) / stddev_samp(gross - cost) * sqrt(252.0::DOUBLE) END AS sharpe,
 (sum(st) - max(CASE WHEN t = t_last AND executed <> 0 THEN 1 ELSE 0 END))::BIGINT AS n_trades, sum(gross - cost) AS net, CASE WHEN abs(sum(gross)) > 1e-12 THEN sum(cost) / abs(sum(gross)) END AS cost_share FROM {p}2 GROUP BY {k})"""


CELLS = "(VALUES (1.25::DOUBLE, 0.25::DOUBLE), (1.25, 0.5), (1.5, 0.25), (1.5, 0.5), (2.0, 0.25), (2.0, 0.5)) c(entry, leave)"
_GRID = ZZ + f""",
src AS (SELECT zt.*, entry, leave FROM zt, {CELLS}),
{machine_sql('m', 'src', ['y', 'x', 'entry', 'leave'])},
be AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY round(sharpe, 9) DESC, round(cost_share, 9) ASC NULLS LAST, n_trades DESC, entry, leave) AS place FROM mc WHERE n_trades >= 1 AND sharpe IS NOT NULL)"""


@query(f"WITH {_GRID} SELECT y, x, entry, leave AS exit, {R('sharpe')} AS sharpe, n_trades, {R('net')} AS net, {R('cost_share')} AS cost_share FROM be WHERE place = 1")
def grid_tuning(spark, d):
    cells = pairs.grid(spark, (1.25, 1.5, 2.0), (0.25, 0.5))
    rows = simulate.grid_positions(_z(_clean(spark, d)).crossJoin(F.broadcast(cells)), PAIR)
    pnl = simulate.engine_pnl(rows.withColumn("units", F.lit(10.0)), [*PAIR, "entry", "exit"])
    pnl = simulate.with_runs(pnl, [*PAIR, "entry", "exit"], "executed")
    return r6(walkforward.tuned(pnl), "sharpe", "net", "cost_share").select(*PAIR, "entry", "exit", "sharpe", "n_trades", "net", "cost_share")


@query(f"""WITH {EN}, c AS (SELECT * FROM (VALUES (2.0::DOUBLE), (5.0), (10.0), (20.0)) v(bps))
SELECT y, x, bps, {R('sum(gross - cost * bps / 6.0 - carry)')} AS net FROM ep, c GROUP BY ALL""")
def cost_sensitivity(spark, d):
    costs = spark.createDataFrame([(2.0,), (5.0,), (10.0,), (20.0,)], "bps double")
    out = _engine(_clean(spark, d)).crossJoin(F.broadcast(costs)).groupBy(*PAIR, "bps").agg(F.sum(F.col("gross") - F.col("cost") * F.col("bps") / 6.0 - F.col("carry")).alias("net"))
    return r6(out, "net")


@query()
def frozen_trades(spark, d):
    panel = _clean(spark, d)
    rows = simulate.frozen_positions(_block(panel), PAIR, 1.5, 3.5, 30)
    prices = _pairs(panel).select(*PAIR, "t", "py", "px")
    return simulate.trade_log(simulate.sleeve_pnl(rows.join(prices, [*PAIR, "t"]), PAIR, 25_000.0), PAIR, "held")


@query()
def oos_trades(spark, d):
    rows = simulate.oos_positions(_z(_clean(spark, d)), PAIR, 1.5, 3.5)
    return simulate.trade_log(simulate.sleeve_pnl(rows, PAIR, 25_000.0, log_beta=False), PAIR, "held")


def _full_cost(panel):
    legs = clean.sig_adv(panel).select("ticker", "t", "sig", "adv")
    rows = _block(panel).join(_pairs(panel).select(*PAIR, "t", "py", "px"), [*PAIR, "t"])
    for c in ("y", "x"):
        rows = rows.join(legs.select(F.col("ticker").alias(c), "t", F.col("sig").alias(f"sig_{c}"), F.col("adv").alias(f"adv_{c}")), [c, "t"])
    return simulate.full_cost_trades(rows, PAIR, entry=1.5)


@query()
def full_cost_simulation(spark, d):
    return _full_cost(_clean(spark, d)).groupBy(*PAIR).agg(F.max("run").alias("n_trades"), F.sum("gross").alias("gross"), F.sum("fills_cost").alias("fills_cost"), F.sum("carry").alias("carry"), F.sum("net").alias("net"))


@query()
def exit_reasons(spark, d):
    out = _full_cost(_clean(spark, d)).filter("held <> 0 OR why <> ''")
    trades = out.groupBy(*PAIR, "run").agg(F.max("why").alias("why"), F.count(F.lit(1)).alias("days_held"), F.sum("net").alias("net"))
    return research.exit_table(trades)


@query(f"""WITH {PP}, n AS (SELECT y, x, py, px, row_number() OVER (PARTITION BY y, x ORDER BY t) AS i FROM pp),
k AS (WITH RECURSIVE go(y, x, i, a, b, paa, pab, pbb) AS (
  SELECT DISTINCT y, x, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 1e5::DOUBLE, 0.0::DOUBLE, 1e5::DOUBLE FROM n
  UNION ALL SELECT y, x, i, a + ka * m, b + kb * m, paa - ka * ha, pab - ka * hb, pbb - kb * hb FROM (
   SELECT *, ha / s AS ka, hb / s AS kb, v - a - b * u AS m FROM (SELECT *, ha + u * hb + 1.0 AS s FROM (
    SELECT n.y, n.x, n.i, g.a, g.b, g.paa + 1e-5::DOUBLE AS paa, g.pab, g.pbb + 1e-5::DOUBLE AS pbb, n.py AS v, n.px AS u, g.paa + 1e-5::DOUBLE + n.px * g.pab AS ha, g.pab + n.px * (g.pbb + 1e-5::DOUBLE) AS hb
    FROM go g JOIN n ON n.y = g.y AND n.x = g.x AND n.i = g.i + 1)))) SELECT * FROM go)
SELECT y, x, i - 1 AS t, round(a, 4) + 0.0 AS alpha, round(b, 4) + 0.0 AS beta FROM k WHERE i > 0""")
def kalman_hedge(spark, d):
    out = screens.kalman_hedge(_pairs(_clean(spark, d)).select(*PAIR, "t", "py", "px"), PAIR, 1e-5, 1.0)
    return out.select(*PAIR, F.col("t").cast("long").alias("t"), F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"))


def poisson_sql(u: str) -> str:
    """The weight of a uniform number below 2^31 - 1: how many of the cumulative probabilities it reaches."""
    return " + ".join(f"({u} >= {math.ceil(p * ranking.PRIME)})::INT" for p in research.POISSON)


_NUMBER = f"(('0x' || substr({{}}, {{}}, 8))::BIGINT % {ranking.PRIME})"


@query(f"""WITH {BZ}, ok AS (SELECT y, x, avg(pnl) AS m, count(*) AS n FROM sc WHERE pnl IS NOT NULL GROUP BY y, x HAVING n >= 20),
hs AS (SELECT sc.y, sc.x, m, pnl - m AS v, {_NUMBER.format("md5('42|' || sc.y || '|' || sc.x || '|' || t)", 1)} AS h FROM sc JOIN ok ON ok.y = sc.y AND ok.x = sc.x WHERE pnl IS NOT NULL),
dr AS (SELECT draw, {_NUMBER.format('k', 1)} AS a, {_NUMBER.format('k', 9)} AS b FROM (SELECT draw, md5('42|' || draw) AS k FROM range(1, 1001) g(draw))),
us AS (SELECT y, x, m, v, draw, (h * a + b) % {ranking.PRIME} AS u FROM hs, dr), ws AS (SELECT y, x, m, v, draw, ({poisson_sql('u')})::DOUBLE AS w FROM us),
sm AS (SELECT y, x, draw, any_value(m) AS m, sum(w) AS n, sum(w * v) AS s, sum(w * v * v) AS q FROM ws GROUP BY ALL),
sd AS (SELECT y, x, m + s / nullif(n, 0) AS mean, CASE WHEN n > 1 THEN sqrt(greatest((q - s * s / n) / (n - 1), 0)) END AS sd FROM sm)
SELECT y, x, {R('quantile_cont(mean / sd * sqrt(252.0::DOUBLE), 0.025)')} AS low, {R('quantile_cont(mean / sd * sqrt(252.0::DOUBLE), 0.975)')} AS high FROM sd WHERE sd > 1e-12 GROUP BY y, x""")
def bootstrap_sharpe(spark, d):
    return r6(research.bootstrap_sharpe(_screened(_clean(spark, d)).select(*PAIR, "t", "pnl"), PAIR, "pnl"), "low", "high")


@query()
def capped_weights(spark, d):
    base = _screened(_clean(spark, d)).groupBy("grp", *PAIR).agg(F.sum("pnl").alias("base"))
    return r6(folded.capped(base, ["grp"], "base", 0.3), "base", "weight").select("grp", *PAIR, "base", "weight")


@query("""WITH e AS (SELECT i AS fold, 1471 + 1471 * (i - 1) // 5 AS a, 1471 + 1471 * i // 5 AS b FROM range(1, 6) t(i))
SELECT fold::INT AS fold, 0 AS train_lo, a::INT AS train_hi, a::INT AS val_lo, (a + (b - a) // 2)::INT AS val_hi, (a + (b - a) // 2)::INT AS test_lo, b::INT AS test_hi FROM e""")
def folds_gapped(spark, d):
    return folds.table(spark, folds.gapped(2942))


@query("""WITH e AS (SELECT i AS fold, 1471 + floor(1471 * (i - 1) / 5.0)::INT AS a, CASE WHEN i = 5 THEN 2942 ELSE 1471 + floor(1471 * i / 5.0)::INT END AS b FROM range(1, 6) t(i))
SELECT fold::INT AS fold, 0 AS train_lo, CASE WHEN fold = 1 THEN 1177 ELSE lag(a) OVER (ORDER BY fold) END::INT AS train_hi, CASE WHEN fold = 1 THEN 1177 ELSE lag(a) OVER (ORDER BY fold) END::INT AS val_lo,
 a::INT AS val_hi, a::INT AS test_lo, b::INT AS test_hi FROM e""")
def folds_continuous(spark, d):
    return folds.table(spark, folds.continuous(2942))


# ---------------------------------------------------------------- portfolios and pools

TL = EN + """, s AS (SELECT *, CASE WHEN executed <> 0 AND coalesce(lag(executed) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st FROM ep WINDOW w AS (PARTITION BY y, x ORDER BY t)),
u AS (SELECT *, sum(st) OVER (PARTITION BY y, x ORDER BY t)::BIGINT AS run FROM s),
tl AS (SELECT y, x, run, min(t) AS entry_t, count(*) AS days_held, sum(net) AS net FROM u WHERE executed <> 0 GROUP BY ALL)"""


@query(f"""WITH {TL} SELECT y, x, count(*) AS n_trades, {R('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {R('avg(net) FILTER (WHERE net > 0)')} AS avg_win, {R('avg(net) FILTER (WHERE net < 0)')} AS avg_loss,
 {R('avg(net)')} AS expectancy, {R('avg(days_held)')} AS avg_days, {R('least(min(net), 0)')} AS worst, CASE WHEN sum(net) FILTER (WHERE net < 0) < 0
 THEN {R('coalesce(sum(net) FILTER (WHERE net > 0), 0) / -sum(net) FILTER (WHERE net < 0)')} WHEN sum(net) > 0 THEN 'inf'::DOUBLE END AS profit_factor FROM tl GROUP BY y, x""")
def trade_stats(spark, d):
    out = performance.trade_stats(simulate.trade_log(_engine(_clean(spark, d)), PAIR), PAIR)
    return r6(out, "win_rate", "avg_win", "avg_loss", "expectancy", "avg_days", "worst", "profit_factor")


@query(f"""WITH {EN}, cal AS (SELECT DISTINCT date FROM panel), s AS (SELECT date, sum(net) AS net, count(*) FILTER (WHERE executed <> 0) AS n FROM ep GROUP BY date)
SELECT CAST(date AS VARCHAR) AS date, {R('coalesce(net, 0)')} AS net, coalesce(n, 0) AS n_active, {R('100000 + sum(coalesce(net, 0)) OVER (ORDER BY date)')} AS equity FROM cal LEFT JOIN s USING (date)""")
def portfolio_daily(spark, d):
    panel = _clean(spark, d)
    out = portfolio.daily_total(_engine(panel), panel, 100_000.0)
    return r6(out.withColumn("date", F.col("date").cast("string")), "net", "equity")


@query(f"""WITH {BZ}, v AS (SELECT y, x, block, stddev_samp(pnl) AS vol FROM sc GROUP BY ALL), i AS (SELECT *, CASE WHEN vol > 1e-12 THEN 1 / vol ELSE 0 END AS inv FROM v)
SELECT y, x, CAST(block AS INT) AS block, {R('CASE WHEN sum(inv) OVER b > 0 THEN inv / sum(inv) OVER b ELSE 1.0 / count(*) OVER b END')} AS weight FROM i WINDOW b AS (PARTITION BY block)""")
def inverse_vol_weights(spark, d):
    vol = _screened(_clean(spark, d)).groupBy(*PAIR, F.col("block").cast("int").alias("block")).agg(F.stddev_samp("pnl").alias("vol"))
    return r6(portfolio.inverse_vol_weights(vol, ["block"]), "weight").select(*PAIR, "block", "weight")


@query(f"""WITH {EN} SELECT y, x, t, CASE WHEN executed <> 0 THEN {R('least(1.0::DOUBLE / count(*) FILTER (WHERE executed <> 0) OVER (PARTITION BY date), 0.25)')} ELSE 0 END AS weight FROM ep""")
def active_weights(spark, d):
    return r6(portfolio.active_weights(_engine(_clean(spark, d)), ["date"]), "weight").select(*PAIR, "t", "weight")


_SELECTED = f"""s AS (SELECT (t - {START}) // {STEP} AS period, y, x, sum(pnl) AS pnl, count(*) FILTER (WHERE held <> 0) AS m FROM sc GROUP BY ALL),
j AS (SELECT CAST(a.period + 1 AS INT) AS period, a.y, a.x, a.pnl AS f, b.pnl AS nx FROM s a JOIN s b ON b.period = a.period + 1 AND b.y = a.y AND b.x = a.x WHERE a.m > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY f DESC, y, x) AS p, row_number() OVER (PARTITION BY period ORDER BY f, y, x) AS low FROM j)"""


@query(f"""WITH {BZ}, {_SELECTED}, pool AS (SELECT period, y, x FROM k WHERE p <= 10)
SELECT a.period, count(*) AS n, count(b.y) AS n_kept FROM pool a LEFT JOIN pool b ON b.period = a.period - 1 AND b.y = a.y AND b.x = a.x GROUP BY a.period""")
def pool_overlap(spark, d):
    selected = walkforward.rolling_selection(_screened(_clean(spark, d)), START, STEP, 10).filter("selected")
    return portfolio.overlap(selected, "period", PAIR)


@query(f"WITH {BZ}, {_SELECTED} SELECT period, y, x, {R('f')} AS f_pnl, {R('nx')} AS next_pnl, CAST(low AS INT) AS place FROM k WHERE low <= 10")
def bottom_k(spark, d):
    pool = walkforward.rolling_selection(_screened(_clean(spark, d)), START, STEP, 10).drop("place", "selected")
    out = ranking.top_k(pool, ["period"], [F.col("f_pnl").asc_nulls_first(), *PAIR], 10)
    return r6(out, "f_pnl", "next_pnl").select("period", *PAIR, "f_pnl", "next_pnl", "place")


@query(f"""WITH {SP}, l AS (SELECT y, x, grp, spread, ly - lag(ly) OVER w AS ry, lx - lag(lx) OVER w AS rx, lag(spread) OVER w AS s0 FROM sp WINDOW w AS (PARTITION BY y, x ORDER BY t)),
p AS (SELECT y, x, grp, 1 + regr_slope(spread - s0, s0) AS phi, {R('corr(ry, rx)')} AS c, {R('stddev_samp(spread)')} AS sd FROM l GROUP BY y, x, grp),
h AS (SELECT y, x, grp, c, sd, {R('-ln(2.0::DOUBLE) / ln(phi)')} AS half_life FROM p WHERE phi > 0 AND phi < 1),
k AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, rank() OVER (PARTITION BY grp ORDER BY half_life) + (count(*) OVER (PARTITION BY grp, half_life) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY grp ORDER BY c) + (count(*) OVER (PARTITION BY grp, c) - 1) / 2.0 AS b, rank() OVER (PARTITION BY grp ORDER BY sd) + (count(*) OVER (PARTITION BY grp, sd) - 1) / 2.0 AS e FROM h)
SELECT y, x, grp, half_life, {R('((n + 1 - a) / n + b / n + e / n) / 3')} AS score FROM k""")
def pool_scores(spark, d):
    panel = _clean(spark, d)
    spread = _spread(panel)
    life = rolling.half_life_ar1(spread).filter(F.col("half_life").isNotNull())
    moves = rolling.returns(_pairs(panel)).groupBy(*PAIR, "grp").agg(F.corr("ry", "rx").alias("c"))
    size = spread.groupBy(*PAIR).agg(F.stddev_samp("spread").alias("sd"))
    rows = r6(life.join(moves, PAIR).join(size, PAIR), "half_life", "c", "sd")
    parts = [ranking.percent_rank_of("half_life", ["grp"], descending=True), ranking.percent_rank_of("c", ["grp"]), ranking.percent_rank_of("sd", ["grp"])]
    return r6(rows.withColumn("score", (parts[0] + parts[1] + parts[2]) / 3), "score").select(*PAIR, "grp", "half_life", "score")


@query(f"""WITH {EN} SELECT y, x, count(*) FILTER (WHERE t < 250) AS n_in, count(*) FILTER (WHERE t >= 250) AS n_out, {R('sum(net) FILTER (WHERE t < 250)')} AS in_sum, {R('sum(net) FILTER (WHERE t >= 250)')} AS out_sum,
 {R('avg(net) FILTER (WHERE t < 250)')} AS in_mean, {R('avg(net) FILTER (WHERE t >= 250)')} AS out_mean FROM ep GROUP BY y, x""")
def holdout_split(spark, d):
    return r6(portfolio.split_at(_engine(_clean(spark, d)), PAIR, "t", 250, "net"), "in_sum", "out_sum", "in_mean", "out_mean")


@query(f"""WITH {PX}, un AS (SELECT * FROM panel WHERE t >= 300), h AS (SELECT * FROM panel WHERE t < 310 AND date < (SELECT min(date) FROM un))
SELECT ticker, count(*) AS n, max(t) AS last_t, count(*) FILTER (WHERE ticker NOT IN (SELECT ticker FROM un)) AS n_unmatched FROM h GROUP BY ticker""")
def contamination_guard(spark, d):
    panel = _clean(spark, d)
    unseen = panel.filter("t >= 300")
    kept = portfolio.before_unseen(panel.filter("t < 310"), unseen)
    known = unseen.select("ticker").distinct().withColumn("known", F.lit(1))
    return kept.join(known, "ticker", "left").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"), F.count_if(F.col("known").isNull()).alias("n_unmatched"))


@query(f"""WITH {BZ}, tr AS (SELECT y, x, grp, run, count(*) AS days_held, sum(pnl) AS net, {R('avg(abs(z))')} AS m FROM sc WHERE held <> 0 GROUP BY ALL),
k AS (SELECT *, CAST(least(floor((rank() OVER (PARTITION BY grp ORDER BY m) + (count(*) OVER (PARTITION BY grp, m) - 1) / 2.0 - 1) * 5 / count(*) OVER (PARTITION BY grp)), 4) AS INT) + 1 AS q FROM tr)
SELECT grp, q, count(*) AS n, {R('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {R('avg(days_held)')} AS avg_days, {R('sum(net)')} AS net FROM k GROUP BY grp, q""")
def exits_by_quintile(spark, d):
    trades = _screened(_clean(spark, d)).filter("held <> 0").groupBy(*PAIR, "grp", "run").agg(F.count(F.lit(1)).alias("days_held"), F.sum("pnl").alias("net"), F.round(F.avg(F.abs("z")), 6).alias("m"))
    out = trades.withColumn("q", ranking.quintile("m", ["grp"])).groupBy("grp", "q").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("days_held").alias("avg_days"), F.sum("net").alias("net"))
    return r6(out, "win_rate", "avg_days", "net")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ten best pairs of a monthly panel by Sharpe of the screener's rules (dense enough at any scale)."""
    rows = clean.clean(sources.sales_panel(spark, d, "month"), most_missing=0.25, limit=3)
    daily = simulate.screener_pnl(simulate.screener_positions(rolling.block_z(pairs.pair_panel(rows), 24, 12, 24), PAIR, 1.0, 0.25, 4.0), PAIR)
    out = performance.sharpe_sortino(daily, PAIR, "pnl")
    return out.orderBy(F.col("sharpe").desc_nulls_last(), *PAIR).limit(10)
