"""Queries of whole studies, each with the SQL that states the same result: screens, pools, re-screening, prediction, folds.

Names of SQL pieces are those of queries.py.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions.native import DF_HIGH, DF_LARGE, DF_LOW, DF_SMALL, DF_STAR, EG_HIGH, EG_LARGE, EG_LOW, EG_SMALL, EG_STAR, ERFC
from .operators import pairs, ranking, research, rolling, screens, selection, simulate, tradability
from .plans import folded, folds, oneshot, predictive, rescreen, walkforward
from .plans.lineage import cut
from .queries import BP, BZ, CELLS, LOOKBACK, ORACLES, PAIR, PP, SP, START, STEP, ZZ, R, _block, _blocks_pnl, _clean, _pairs, _screened, _spread, _z, machine_sql, query, r6
from .sources import lists

#: A new pool every second period, from the LOOKBACK rows before it.
EVERY, MIN_LIFE, MAX_LIFE = 2, 0.15, 60.0


# ---------------------------------------------------------------- SQL pieces

def poly(x: str, c) -> str:
    out = f"{c[-1]}::DOUBLE"
    for v in reversed(c[:-1]):
        out = f"({out} * {x} + {v}::DOUBLE)"
    return out


def erfc_sql(source: str, z: str, out: str) -> str:
    """source with column out: the complementary error function of the column z (0 or more)."""
    return f"(SELECT * EXCLUDE (u_), u_ * exp(-{z} * {z} + {poly('u_', ERFC)}) AS {out} FROM (SELECT *, 1 / (1 + {z} * 0.5::DOUBLE) AS u_ FROM {source}))"


def eg_p_sql(source: str, tau: str, out: str, surface=(EG_STAR, EG_LOW, EG_HIGH, EG_SMALL, EG_LARGE)) -> str:
    """source with column out: the p value of the Engle-Granger statistic tau."""
    star, low, high, small, large = surface
    x = f"(SELECT *, CASE WHEN {tau} <= {star} THEN {poly(tau, small)} ELSE {poly(tau, large)} END AS x_ FROM {source})"
    e = erfc_sql(f"(SELECT *, abs(x_) / sqrt(2.0::DOUBLE) AS z_ FROM {x})", "z_", "e_")
    return f"(SELECT * EXCLUDE (x_, z_, e_), CASE WHEN {tau} IS NULL THEN NULL WHEN {tau} > {high} THEN 1.0::DOUBLE WHEN {tau} < {low} THEN 0.0::DOUBLE WHEN x_ < 0 THEN e_ / 2 ELSE 1 - e_ / 2 END AS {out} FROM {e})"


def normal_p_sql(source: str, t: str, out: str) -> str:
    return f"(SELECT * EXCLUDE (z_, e_), CASE WHEN {t} IS NOT NULL THEN e_ END AS {out} FROM {erfc_sql(f'(SELECT *, abs({t}) / sqrt(2.0::DOUBLE) AS z_ FROM {source})', 'z_', 'e_')})"


def t_p(t: str, n: str) -> str:
    """Two-sided p of Student's t with n - 1 degrees of freedom."""
    th, df = f"atan(abs({t}) / sqrt(({n} - 1)::DOUBLE))", f"({n} - 1)"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda k: pow(cos({th}), 2 * k) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2 * j - 1) / (2.0::DOUBLE * j))), 1)))"
    odd = f"list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: pow(cos({th}), 2 * k + 1) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2.0::DOUBLE * j) / (2 * j + 1))), 1)))"
    return f"CASE WHEN {t} IS NOT NULL AND {df} >= 1 THEN greatest(1 - CASE WHEN {df} % 2 = 0 THEN sin({th}) * {even} ELSE 2 / pi() * ({th} + coalesce(sin({th}) * {odd}, 0)) END, 0) END"


def residual_sql(p: str, source: str, by: str, y: str = "ly", x: str = "lx") -> str:
    """CTEs {p}s (residuals, their lags and changes by group) and {p}d (their Dickey-Fuller statistic and slope)."""
    w = f"PARTITION BY {by} ORDER BY t"
    return f"""{p}r AS (SELECT *, covar_pop({y}, {x}) OVER (PARTITION BY {by}) / nullif(var_pop({x}) OVER (PARTITION BY {by}), 0) AS b FROM {source}),
{p}a AS (SELECT *, avg({y}) OVER (PARTITION BY {by}) - b * avg({x}) OVER (PARTITION BY {by}) AS a FROM {p}r),
{p}e AS (SELECT *, {y} - b * {x} - a AS s FROM {p}a),
{p}s AS (SELECT *, lag(s) OVER w AS s0, s - lag(s) OVER w AS ds FROM {p}e WINDOW w AS ({w}))"""


def unit_root_sql(p: str, source: str, by: str, constant: bool = False, s: str = "s") -> str:
    """CTE {p}tau (by, n, lag, tau): Dickey-Fuller of the groups' values s, lags by AIC over common rows, the statistic over all rows of that lag.

    Every lagged vector is a slice of the group's list, their products a matrix; a recursion eliminates its first row and column
    again and again, so that the last two rows hold level and change given 0, 1, ... lags.
    """
    c = int(constant)
    vectors = "list_concat(list_transform(range(1, most + 1), lambda i: d[most - i + 1:n - 1 - i]), [s[most + 1:n - 1], d[most + 1:n - 1]])"
    if constant:
        vectors = f"list_transform({vectors}, lambda v: list_transform(v, lambda e: e - list_avg(v)))"

    def corners(name: str, table: str) -> str:
        return f"""{name} AS MATERIALIZED (WITH RECURSIVE go AS (SELECT {by}, n, most, 0 AS k, m FROM (SELECT *, list_transform(v, lambda a: list_transform(v, lambda b: list_dot_product(a, b))) AS m FROM (SELECT *, {vectors} AS v FROM {table}))
 UNION ALL SELECT {by}, n, most, k + 1, list_transform(m[2:], lambda row: list_transform(range(2, len(row) + 1), lambda j: row[j] - row[1] * m[1][j] / nullif(m[1][1], 0))) FROM go WHERE k < most)
 SELECT {by}, n, most, k, n - 1 - most AS rows_, m[-2][-2] AS v, m[-2][-1] AS c, greatest(m[-1][-1] - m[-2][-1] * m[-2][-1] / nullif(m[-2][-2], 0), 1e-300) AS rss FROM go)"""

    return f"""{p}u0 AS MATERIALIZED (SELECT *, list_transform(range(2, n + 1), lambda i: s[i] - s[i - 1]) AS d, CAST(greatest(least(ceil(12 * pow(n / 100.0::DOUBLE, 0.25::DOUBLE)), n // 2 - 1 - {c}), 0) AS INT) AS most
 FROM (SELECT {by}, list({s} ORDER BY t) AS s, count(*) AS n FROM {source} GROUP BY {by} HAVING count({s}) = count(*)) WHERE n > 3 + {c}),
{corners(f'{p}u1', f'{p}u0')},
{p}u2 AS (SELECT {by}, k AS lag FROM {p}u1 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY coalesce(rows_ * ln(rss / rows_) + 2.0::DOUBLE * (k + 1 + {c}), 'inf'::DOUBLE), k) = 1),
{corners(f'{p}u3', f'(SELECT u.* EXCLUDE (most), lag AS most FROM {p}u0 u JOIN {p}u2 USING ({by}))')},
{p}tau AS (SELECT {by}, n, k AS lag, c / sqrt(greatest(rss / (rows_ - k - 1 - {c}), 1e-300) * v) AS tau FROM {p}u3 WHERE k = most AND rows_ - k - 1 - {c} > 0 AND v <> 0)"""


def df_p_sql(source: str, tau: str, out: str) -> str:
    """source with column out: the p value of the Dickey-Fuller statistic tau of one series with a constant."""
    return eg_p_sql(source, tau, out, (DF_STAR, DF_LOW, DF_HIGH, DF_SMALL, DF_LARGE))


def kpss_sql(p: str, source: str, by: str, s: str = "s") -> str:
    """CTE {p}kpss (by, kpss, kpss_p) of the groups' values s."""
    bw = "least(floor(1.1447::DOUBLE * pow(pow(s1 / s0, 2.0::DOUBLE), 1 / 3.0::DOUBLE) * pow(n::DOUBLE, 1 / 3.0::DOUBLE)), n - 1)"
    cov = "list_dot_product(e[k + 1:n], e[1:n - k]) / n"
    table = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
    steps = " ".join(f"WHEN kpss < {x1} THEN {p0} + (kpss - {x0}) * ({p1} - {p0}) / ({x1} - {x0})::DOUBLE" for (x0, p0), (x1, p1) in zip(table, table[1:], strict=False))
    return f"""{p}k0 AS (SELECT {by}, n, list_transform(l, lambda v: v - list_avg(l)) AS e FROM (SELECT {by}, list({s} ORDER BY t) AS l, count(*) AS n FROM {source} GROUP BY {by} HAVING count({s}) = count(*))),
{p}k1 AS (SELECT *, list_dot_product(e, e) / n + 2 * coalesce(list_sum(list_transform(range(1, CAST(floor(pow(n::DOUBLE, 2 / 9.0::DOUBLE)) AS INT) + 1), lambda k: {cov})), 0) AS s0,
 2 * coalesce(list_sum(list_transform(range(1, CAST(floor(pow(n::DOUBLE, 2 / 9.0::DOUBLE)) AS INT) + 1), lambda k: k * {cov})), 0) AS s1 FROM {p}k0),
{p}k2 AS (SELECT *, CAST({bw} AS INT) AS lags FROM {p}k1),
{p}k3 AS (SELECT {by}, list_dot_product(e, e) / n + coalesce(list_sum(list_transform(range(1, lags + 1), lambda k: 2 * (1 - k / (lags + 1.0::DOUBLE)) * {cov})), 0) AS lr, n FROM {p}k2),
{p}k4 AS (SELECT {by}, sum(w * w) AS walk FROM (SELECT {by}, sum(e_) OVER (PARTITION BY {by} ORDER BY i) AS w FROM (SELECT {by}, unnest(e) AS e_, unnest(range(1, n + 1)) AS i FROM {p}k0)) GROUP BY {by}),
{p}kpss AS (SELECT *, CASE WHEN kpss <= 0.347 THEN 0.10::DOUBLE {steps} WHEN kpss IS NOT NULL THEN 0.01::DOUBLE END AS kpss_p FROM (SELECT {by}, walk / (n::DOUBLE * n * nullif(lr, 0)) AS kpss FROM {p}k3 JOIN {p}k4 USING ({by})))"""


def johansen_sql(p: str, source: str, by: str) -> str:
    """CTE {p}jo (by, trace, eigen, hedge): 2 x 2 eigenvalues of the levels' and changes' covariances given the changes before, by regressions."""
    names = ["dy", "dx", "py1", "px1", "y1", "x1"]
    moments = ", ".join(f"covar_pop({a}, {b}) AS {a}_{b}" for i, a in enumerate(names) for b in names[i:])
    cov = lambda a, b: f"{a}_{b}" if names.index(a) <= names.index(b) else f"{b}_{a}"
    # coefficients of each series on the earlier changes, then covariances of what is left
    coef = ", ".join(f"({cov(a, 'py1')} * {cov('px1', 'px1')} - {cov(a, 'px1')} * {cov('py1', 'px1')}) / nullif(det, 0) AS {a}_a, ({cov(a, 'px1')} * {cov('py1', 'py1')} - {cov(a, 'py1')} * {cov('py1', 'px1')}) / nullif(det, 0) AS {a}_b" for a in ("dy", "dx", "y1", "x1"))
    rest = ", ".join(f"{cov(a, b)} - {a}_a * {cov(b, 'py1')} - {a}_b * {cov(b, 'px1')} AS r_{a}_{b}" for i, a in enumerate(["dy", "dx", "y1", "x1"]) for b in ["dy", "dx", "y1", "x1"][i:])
    return f"""{p}j0 AS (SELECT *, ly - lag(ly) OVER w AS dy, lx - lag(lx) OVER w AS dx, lag(ly) OVER w - lag(ly, 2) OVER w AS py1, lag(lx) OVER w - lag(lx, 2) OVER w AS px1, lag(ly) OVER w AS y1, lag(lx) OVER w AS x1, lag(ly, 2) OVER w AS whole FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY t)),
{p}j1 AS (SELECT {by}, count(*) AS n, {moments} FROM {p}j0 WHERE whole IS NOT NULL GROUP BY {by}),
{p}j2 AS (SELECT *, {cov('py1', 'py1')} * {cov('px1', 'px1')} - {cov('py1', 'px1')} * {cov('py1', 'px1')} AS det FROM {p}j1), {p}j3 AS (SELECT *, {coef} FROM {p}j2), {p}j4 AS (SELECT {by}, n, {rest} FROM {p}j3),
{p}j5 AS (SELECT *, r_dy_dy * r_dx_dx - r_dy_dx * r_dy_dx AS d0, r_y1_y1 * r_x1_x1 - r_y1_x1 * r_y1_x1 AS dk FROM {p}j4),
{p}j6 AS (SELECT *, (r_dx_dx * r_dy_y1 * r_dy_y1 - 2 * r_dy_dx * r_dy_y1 * r_dx_y1 + r_dy_dy * r_dx_y1 * r_dx_y1) / nullif(d0, 0) AS q11, (r_dx_dx * r_dy_x1 * r_dy_x1 - 2 * r_dy_dx * r_dy_x1 * r_dx_x1 + r_dy_dy * r_dx_x1 * r_dx_x1) / nullif(d0, 0) AS q22,
 (r_dx_dx * r_dy_y1 * r_dy_x1 - r_dy_dx * (r_dy_y1 * r_dx_x1 + r_dx_y1 * r_dy_x1) + r_dy_dy * r_dx_y1 * r_dx_x1) / nullif(d0, 0) AS q12 FROM {p}j5),
{p}j7 AS (SELECT *, (r_x1_x1 * q11 - r_y1_x1 * q12) / nullif(dk, 0) AS a11, (r_x1_x1 * q12 - r_y1_x1 * q22) / nullif(dk, 0) AS a12, (r_y1_y1 * q12 - r_y1_x1 * q11) / nullif(dk, 0) AS a21, (r_y1_y1 * q22 - r_y1_x1 * q12) / nullif(dk, 0) AS a22 FROM {p}j6),
{p}j8 AS (SELECT *, (a11 + a22) / 2 + sqrt(greatest((a11 - a22) * (a11 - a22) / 4 + a12 * a21, 0)) AS v1, (a11 + a22) / 2 - sqrt(greatest((a11 - a22) * (a11 - a22) / 4 + a12 * a21, 0)) AS v2 FROM {p}j7),
{p}jo AS (SELECT {by}, -n * ln(1 - least(greatest(v1, 0), 1 - 1e-12)) AS eigen, -n * (ln(1 - least(greatest(v1, 0), 1 - 1e-12)) + ln(1 - least(greatest(v2, 0), 1 - 1e-12))) AS trace,
 CASE WHEN abs(a12) >= abs(a21) THEN -(v1 - a11) / nullif(a12, 0) ELSE -a21 / nullif(v1 - a22, 0) END AS hedge FROM {p}j8)"""


def life(k: str) -> str:
    return f"CASE WHEN {k} > -1 AND {k} < 0 THEN -ln(2.0::DOUBLE) / ln(1 + {k}) END"


def bh(p: str, by: str, order: str) -> str:
    """Benjamini-Hochberg of a family whose missing p count as 1, over columns m_ (family) and k_ (place)."""
    return f"least(1, min({p} * m_ / k_) OVER (PARTITION BY {by} ORDER BY k_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def share(column: str, by: str, down: bool = False) -> str:
    """Percentile rank: average rank over count."""
    r = f"(rank() OVER (PARTITION BY {by} ORDER BY {column}) + (count(*) OVER (PARTITION BY {by}, {column}) - 1) / 2.0::DOUBLE)"
    n = f"count({column}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {column} IS NOT NULL THEN ({n} + 1 - {r}) / {n} END" if down else f"CASE WHEN {column} IS NOT NULL THEN {r} / {n} END"


def capped_sql(p: str, source: str, by: str, score: str, k: int, cap: int) -> str:
    """CTE {p}k: rows of source walked from the highest score on, at most cap pairs of a ticker and k in all; place counts them."""
    return f"""{p}o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC NULLS LAST, y, x) AS r_ FROM {source}),
{p}w AS (WITH RECURSIVE go(g, r, used, taken, ok) AS (
  SELECT {by}, 1::BIGINT, [y, x], 1, true FROM {p}o WHERE r_ = 1
  UNION ALL SELECT g, r, CASE WHEN ok THEN list_concat(used, [y, x]) ELSE used END, taken + CASE WHEN ok THEN 1 ELSE 0 END, ok FROM (
    SELECT go.g, o.r_ AS r, go.used, go.taken, o.y, o.x, go.taken < {k} AND len(list_filter(go.used, lambda u: u = o.y)) < {cap} AND len(list_filter(go.used, lambda u: u = o.x)) < {cap} AS ok
    FROM go JOIN {p}o o ON o.{by} = go.g AND o.r_ = go.r + 1)) SELECT * FROM go),
{p}k AS (SELECT o.* EXCLUDE (r_), w.taken AS place FROM {p}o o JOIN {p}w w ON w.g = o.{by} AND w.r = o.r_ WHERE w.ok)"""


ORACLES["topk_with_ticker_cap"] = f"""WITH {BZ}, s AS (SELECT (t - {START}) // {STEP} AS period, y, x, sum(pnl) AS pnl, count(*) FILTER (WHERE held <> 0) AS m FROM sc GROUP BY ALL),
j AS (SELECT CAST(a.period + 1 AS INT) AS period, a.y, a.x, a.pnl AS f, b.pnl AS nx FROM s a JOIN s b ON b.period = a.period + 1 AND b.y = a.y AND b.x = a.x WHERE a.m > 0),
{capped_sql('p', 'j', 'period', 'f', 8, 2)} SELECT period, y, x, {R('f')} AS f_pnl, {R('nx')} AS next_pnl, CAST(place AS INT) AS place FROM pk"""


def tradability_sql(screens: str, entry: float, leave: float) -> str:
    """CTE tm: the metrics of every screen (CTE screens: screen, lo, hi) and pair."""
    part = " + ".join(f"CASE WHEN i >= floor(n * {c} / 3.0::DOUBLE) THEN 1 ELSE 0 END" for c in (1, 2))
    ks = ", ".join(f"regr_slope(ds, s0) FILTER (WHERE part = {c} AND same) AS k{c}, regr_slope(ly, lx) FILTER (WHERE part = {c}) AS b{c}" for c in range(3))
    good = " + ".join(f"CASE WHEN {life(f'k{c}')} BETWEEN {MIN_LIFE} AND {MAX_LIFE} THEN 1.0::DOUBLE ELSE 0 END" for c in range(3))
    inner = f"""(SELECT screen, y, x, grp, any_value(n) AS n, any_value(b) AS hedge_ratio, any_value(sd) AS sd, corr(dy, dx) AS ret_corr, any_value(tau) AS eg_tstat, regr_slope(ds, s0) AS k,
 count(*) FILTER (WHERE abs(z) > {entry} AND abs(z0) <= {entry}) AS entries, count(*) FILTER (WHERE z0 IS NOT NULL AND (z < 0) <> (z0 < 0)) AS crossings, arg_max(py, t) AS py, arg_max(px, t) AS px, {ks} FROM t5 LEFT JOIN (SELECT screen, y, x, tau FROM ttau) USING (screen, y, x) GROUP BY screen, y, x, grp)"""
    return f"""sw AS (SELECT p.*, w.screen FROM pp p JOIN {screens} w ON p.t >= w.lo AND p.t < w.hi),
{residual_sql('t', 'sw', 'screen, y, x')},
{unit_root_sql('t', 'ts', 'screen, y, x')},
t3 AS (SELECT *, count(*) OVER (PARTITION BY screen, y, x) AS n, row_number() OVER w - 1 AS i, ly - lag(ly) OVER w AS dy, lx - lag(lx) OVER w AS dx, stddev_samp(s) OVER (PARTITION BY screen, y, x) AS sd, avg(s) OVER (PARTITION BY screen, y, x) AS m
 FROM ts WINDOW w AS (PARTITION BY screen, y, x ORDER BY t)),
t4 AS (SELECT *, {part} AS part, (s - m) / nullif(sd, 0) AS z FROM t3),
t5 AS (SELECT *, lag(z) OVER w AS z0, lag(part) OVER w = part AS same FROM t4 WINDOW w AS (PARTITION BY screen, y, x ORDER BY t)),
t6 AS (SELECT * FROM {eg_p_sql(inner, 'eg_tstat', 'eg_pvalue')} WHERE sd > 0 AND ret_corr IS NOT NULL AND ret_corr >= -1),
t7 AS (SELECT *, {life('k')} AS half_life, entries * 252.0::DOUBLE / n AS entries_per_year, crossings * 252.0::DOUBLE / n AS crossings_per_year, 1e4 * {entry - leave}::DOUBLE * sd / (1 + abs(hedge_ratio)) AS gross_bps,
 ({good}) / 3 AS stability, sqrt(((b0 - (b0 + b1 + b2) / 3) ^ 2 + (b1 - (b0 + b1 + b2) / 3) ^ 2 + (b2 - (b0 + b1 + b2) / 3) ^ 2) / 3) / nullif(abs(hedge_ratio), 0) AS beta_cv FROM t6),
t8 AS (SELECT *, 4.3::DOUBLE + 2e4 * 0.0035::DOUBLE * (1 / (1 + abs(hedge_ratio)) / py + abs(hedge_ratio) / (1 + abs(hedge_ratio)) / px) + 50.0::DOUBLE * half_life / 252 AS cost_bps FROM t7),
t9 AS (SELECT *, gross_bps - cost_bps AS net_bps, CASE WHEN cost_bps > 0 THEN gross_bps / cost_bps END AS edge_ratio, entries_per_year * (gross_bps - cost_bps) AS net_edge_bps_per_year,
 coalesce(eg_pvalue, 1) AS p1_, count(*) OVER (PARTITION BY screen) AS m_, row_number() OVER (PARTITION BY screen ORDER BY coalesce(eg_pvalue, 1), y, x) AS k_ FROM t8),
tm AS (SELECT *, {bh('p1_', 'screen', '')} AS eg_pvalue_fdr FROM t9)"""


METRICS = "hedge_ratio ret_corr eg_tstat eg_pvalue half_life entries_per_year crossings_per_year gross_bps cost_bps net_bps edge_ratio net_edge_bps_per_year stability beta_cv eg_pvalue_fdr".split()
#: Periods of STEP rows from START on, and the screens before every second one.
WIN = f"""nn AS (SELECT max(t) + 1 AS n FROM panel), per AS (SELECT CAST(i AS INT) AS period, {START} + i * {STEP} AS lo, least({START} + (i + 1) * {STEP}, n) AS hi, CAST(i // {EVERY} AS INT) AS screen FROM nn, range(0, 1000) t(i) WHERE {START} + i * {STEP} < n),
pe AS (SELECT * FROM per WHERE hi - lo > 20), scr AS (SELECT screen, min(lo) - {LOOKBACK} AS lo, min(lo) AS hi FROM pe GROUP BY screen)"""
SCREENS = f"{PP}, {WIN}, {tradability_sql('scr', 1.5, 0.5)}"
FILTERED = f"""pf AS (SELECT * FROM tm WHERE half_life BETWEEN {MIN_LIFE} AND {MAX_LIFE} AND eg_pvalue <= 0.6 AND stability >= 0.3),
ps AS (SELECT *, round(({share('net_edge_bps_per_year', 'screen')} + {share('stability', 'screen')} + {share('crossings_per_year', 'screen')} + {share('half_life', 'screen', True)}) / 4, 9) AS pool_score FROM pf),
{capped_sql('p', 'ps', 'screen', 'pool_score', 12, 4)}"""


def _windows(panel):
    return rescreen.windows(panel, START, STEP, EVERY, LOOKBACK)


def _metrics(panel, windows):
    return tradability.tradability(_pairs(panel), windows, 1.5, 0.5, 3, MIN_LIFE, MAX_LIFE)


def _pools(panel):
    m = _metrics(panel, _windows(panel)[1])
    return cut(selection.pool(m, ["screen"], 12, 4, MIN_LIFE, MAX_LIFE, max_p=0.6, min_stability=0.3))


def rounded(columns) -> str:
    return ", ".join(f"{R(c)} AS {c}" for c in columns)


# ---------------------------------------------------------------- screens and pools

@query(f"WITH {SCREENS} SELECT screen, y, x, grp, n, {rounded(METRICS)} FROM tm")
def tradability_screens(spark, d):
    panel = _clean(spark, d)
    return r6(_metrics(panel, _windows(panel)[1]), *METRICS).select("screen", *PAIR, "grp", "n", *METRICS)


@query(f"WITH {SCREENS}, {FILTERED} SELECT screen, y, x, pool_score, CAST(place AS INT) AS screen_rank FROM pk")
def pool_of_screens(spark, d):
    return _pools(_clean(spark, d)).select("screen", *PAIR, "pool_score", F.col("screen_rank").cast("int").alias("screen_rank"))


LOG = BZ.replace(PP, f"{SCREENS}, {FILTERED}") + """,
mem AS (SELECT pe.period, pe.screen, pe.lo, pe.hi, pk.y, pk.x, pk.place AS screen_rank, pool_score FROM pe JOIN pk USING (screen)),
fo AS (SELECT m.period, m.y, m.x, sum(s.pnl) FILTER (WHERE s.t < m.lo) AS f_pnl, count(DISTINCT s.run) FILTER (WHERE s.t < m.lo AND s.held <> 0) AS f_trades,
 sum(s.pnl) FILTER (WHERE s.t >= m.lo) AS next_pnl, count(DISTINCT s.run) FILTER (WHERE s.t >= m.lo AND s.held <> 0) AS next_trades
 FROM mem m JOIN sc s ON s.y = m.y AND s.x = m.x AND s.t >= m.lo - """ + f"{STEP}" + """ AND s.t < m.hi GROUP BY ALL),
lg AS (SELECT m.* EXCLUDE (lo, hi), round(f_pnl, 9) AS f_pnl, f_trades, round(next_pnl, 9) AS next_pnl, next_trades, f_trades >= 1 AS eligible FROM mem m JOIN fo USING (period, y, x)),
ll AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY f_pnl DESC NULLS LAST, y, x) AS formation_rank, row_number() OVER (PARTITION BY period, eligible ORDER BY f_pnl DESC NULLS LAST, y, x) AS e_ FROM lg),
sl AS (SELECT *, eligible AND e_ <= 5 AS selected FROM ll)"""


def _log(panel):
    """(log, periods, the daily rows that the log comes from)."""
    periods, daily = cut(_windows(panel)[0]), cut(_screened(panel))
    return rescreen.selection_log(daily, _pools(panel).select("screen", *PAIR, "screen_rank", "pool_score"), periods, STEP, 5), periods, daily


@query(f"WITH {LOG} SELECT period, screen, y, x, CAST(screen_rank AS INT) AS screen_rank, {R('f_pnl')} AS f_pnl, f_trades, {R('next_pnl')} AS next_pnl, next_trades, eligible, CAST(formation_rank AS INT) AS formation_rank, selected FROM sl")
def rescreen_selection_log(spark, d):
    out = r6(_log(_clean(spark, d))[0], "f_pnl", "next_pnl").withColumn("screen_rank", F.col("screen_rank").cast("int"))
    return out.select("period", "screen", *PAIR, "screen_rank", "f_pnl", "f_trades", "next_pnl", "next_trades", "eligible", "formation_rank", "selected")


@query(f"""WITH {LOG}, su AS (SELECT period, count(*) AS pool_size, count(*) FILTER (WHERE selected) AS n_selected, sum(next_pnl) FILTER (WHERE selected) AS sel_net, sum(next_pnl) AS all_net,
 avg(CASE WHEN next_pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE selected) AS hit, string_agg(y || '/' || x, ', ' ORDER BY screen_rank) FILTER (WHERE selected) AS names FROM sl GROUP BY period)
SELECT period, screen, lo::BIGINT AS lo, hi::BIGINT AS hi, coalesce(pool_size, 0) AS pool_size, coalesce(n_selected, 0) AS n_selected, {R('coalesce(sel_net, 0)')} AS sel_net, {R('coalesce(all_net, 0)')} AS all_net, {R('hit')} AS sel_hit_rate, coalesce(names, '') AS names FROM pe LEFT JOIN su USING (period)""")
def rescreen_periods(spark, d):
    log, periods, _ = _log(_clean(spark, d))
    out = r6(rescreen.period_table(log, periods, 5), "sel_net", "all_net", "sel_hit_rate")
    return out.select("period", "screen", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "pool_size", "n_selected", "sel_net", "all_net", "sel_hit_rate", "names")


@query(f"WITH {LOG} SELECT y, x, count(*) AS periods_selected, {R('sum(next_pnl)')} AS net_pnl, count(*) FILTER (WHERE next_pnl > 0) AS periods_profitable FROM sl WHERE selected GROUP BY y, x")
def pair_summary_selected(spark, d):
    return r6(selection.pair_summary(_log(_clean(spark, d))[0]), "net_pnl")


@query(f"""WITH {LOG}, dd AS (SELECT s.t, sum(s.pnl) FILTER (WHERE l.selected) AS a, sum(s.pnl) AS b FROM sl l JOIN pe USING (period) JOIN sc s ON s.y = l.y AND s.x = l.x AND s.t >= pe.lo AND s.t < pe.hi GROUP BY s.t),
dy AS (SELECT unnest(range(lo, hi)) AS t FROM pe) SELECT t::BIGINT AS t, {R('coalesce(a, 0)')} AS selected_net, {R('coalesce(b, 0)')} AS pool_net, {R('sum(coalesce(a, 0)) OVER (ORDER BY t)')} AS selected_cum, {R('sum(coalesce(b, 0)) OVER (ORDER BY t)')} AS pool_cum FROM dy LEFT JOIN dd USING (t)""")
def rescreen_daily(spark, d):
    log, periods, daily = _log(_clean(spark, d))
    return r6(rescreen.daily_portfolio(daily, log, periods).withColumn("t", F.col("t").cast("long")), "selected_net", "pool_net", "selected_cum", "pool_cum")


@query(f"WITH {SCREENS}, {FILTERED} SELECT a.screen, count(*) AS n, count(b.y) AS n_kept FROM pk a LEFT JOIN pk b ON b.screen = a.screen - 1 AND b.y = a.y AND b.x = a.x GROUP BY a.screen")
def pool_overlap_of_screens(spark, d):
    return rescreen.pool_overlaps(_pools(_clean(spark, d)))


_EX = eg_p_sql("(SELECT y, x, count(*) AS n_obs, any_value(tau) AS tau FROM es LEFT JOIN (SELECT y, x, tau FROM etau) USING (y, x) GROUP BY y, x HAVING count(*) >= 100)", "tau", "p")


@query(f"""WITH {PP}, {residual_sql('e', 'pp', 'y, x', 'py', 'px')}, {unit_root_sql('e', 'es', 'y, x')}, ex AS (SELECT * FROM {_EX}), ek AS (SELECT *, count(p) OVER () AS m_, row_number() OVER (ORDER BY p NULLS LAST, y, x) AS k_, 1 AS f FROM ex)
SELECT y, x, n_obs, {R('tau')} AS tau, {R('p')} AS p, {R('least(1, p * m_)')} AS p_bonferroni, {R(bh('p', 'f', ''))} AS p_bh, p < 0.05 AS significant, least(1, p * m_) <= 0.05 AS significant_bonferroni, {bh('p', 'f', '')} <= 0.05 AS significant_bh,
 CAST(row_number() OVER (ORDER BY round(p, 12) NULLS LAST, y, x) AS INT) AS place FROM ek""")
def explore_pairs(spark, d):
    return r6(tradability.explored(_pairs(_clean(spark, d)), least=100), "tau", "p", "p_bonferroni", "p_bh").select(*PAIR, "n_obs", "tau", "p", "p_bonferroni", "p_bh", "significant", "significant_bonferroni", "significant_bh", "place")


_RO = eg_p_sql("(SELECT y, x, screen, any_value(tau) AS tau FROM qs LEFT JOIN (SELECT y, x, screen, tau FROM qtau) USING (y, x, screen) GROUP BY y, x, screen)", "tau", "p")


@query(f"""WITH {PP}, {residual_sql('e', 'pp', 'y, x', 'py', 'px')}, {unit_root_sql('e', 'es', 'y, x')}, ex AS (SELECT * FROM {_EX}), kp AS (SELECT y, x FROM ex WHERE p <= 0.5),
ro AS (SELECT pp.*, k AS screen FROM pp JOIN kp USING (y, x), range(0, 100) t(k) WHERE t >= k * 21 AND t < k * 21 + 126 AND k * 21 + 126 <= (SELECT max(t) + 1 FROM panel)),
{residual_sql('q', 'ro', 'y, x, screen')}, {unit_root_sql('q', 'qs', 'y, x, screen')}, rp AS (SELECT * FROM {_RO}) SELECT y, x, count(p) AS n_windows, {R('avg(CASE WHEN p < 0.05 THEN 1.0::DOUBLE ELSE 0 END)')} AS share_cointegrated, {R('avg(p)')} AS mean_p FROM rp GROUP BY y, x""")
def rolling_persistence(spark, d):
    panel = _clean(spark, d)
    tested = tradability.explored(_pairs(panel), least=100).select(*PAIR, "p")
    return r6(tradability.persistence(_pairs(panel), tested, 126, 21, 0.05, 0.5), "share_cointegrated", "mean_p")


_FW = "OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {BZ}, bb AS (SELECT bz.y, bz.x, bz.t, f.beta, p.ly, p.lx FROM bz JOIN fits f ON f.y = bz.y AND f.x = bz.x AND f.block = bz.block JOIN pp p ON p.y = bz.y AND p.x = bz.x AND p.t = bz.t),
hh AS (SELECT a.y, a.x, a.t, a.ly - a.beta * a.lx AS now, count(*) AS n, avg(b.ly - a.beta * b.lx) AS m, stddev_samp(b.ly - a.beta * b.lx) AS sd FROM bb a JOIN bb b ON b.y = a.y AND b.x = a.x AND b.t >= a.t - 40 AND b.t < a.t GROUP BY ALL)
SELECT bb.y, bb.x, bb.t, {R('CASE WHEN n = 40 AND sd >= 1e-12 THEN (now - m) / sd END')} AS z FROM bb LEFT JOIN hh USING (y, x, t)""")
def z_at_todays_beta(spark, d):
    panel = _clean(spark, d)
    rows = _block(panel).select(*PAIR, "t", "beta").join(_pairs(panel).select(*PAIR, "t", "ly", "lx"), [*PAIR, "t"])
    return r6(rolling.frozen_z(rows, 40), "z").select(*PAIR, "t", "z")


@query(f"""WITH {PP}, st AS (SELECT y, x, t, covar_pop(py, px) OVER p / var_pop(px) OVER p AS b FROM pp WINDOW p AS (PARTITION BY y, x)),
ro AS (SELECT y, x, t, CASE WHEN count(*) OVER w = 120 THEN covar_samp(py, px) OVER w / nullif(var_samp(px) OVER w, 0) END AS b FROM pp WINDOW w AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))
SELECT y, x, t, 'static' AS mode, {R('b')} AS beta FROM st UNION ALL SELECT y, x, t, 'rolling', {R('b')} FROM ro""")
def hedge_modes(spark, d):
    panel = _clean(spark, d)
    parts = [r6(rolling.hedge(_pairs(panel), m), "beta").select(*PAIR, "t", F.lit(m).alias("mode"), "beta") for m in ("static", "rolling")]
    return parts[0].unionByName(parts[1])


@query("""SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 5 AS grp, count(DISTINCT p_brand) AS n_tickers, (count(DISTINCT p_brand) * (count(DISTINCT p_brand) - 1) / 2)::BIGINT AS n_pairs FROM part GROUP BY ALL""")
def group_sizes(spark, d):
    return lists.group_sizes(lists.brand_groups(spark, d))


@query(f"""WITH {PP}, u AS (SELECT DISTINCT y, x, grp FROM pp) SELECT y, x, grp FROM u WHERE y IN ('Brand#11', 'Brand#16', 'Brand#21', 'Brand#31', 'Brand#41') AND x IN ('Brand#11', 'Brand#16', 'Brand#21', 'Brand#31', 'Brand#41')""")
def pair_members(spark, d):
    wanted = spark.createDataFrame([(f"Brand#{i}",) for i in (11, 16, 21, 31, 41, 99)], "ticker string")
    return pairs.members(pairs.universe(_clean(spark, d)), wanted)


# SQL of two queries whose walk or filling is a recursion
ORACLES["topk_with_ticker_cap"] = f"""WITH {BZ}, s AS (SELECT (t - {START}) // {STEP} AS period, y, x, sum(pnl) AS pnl, count(*) FILTER (WHERE held <> 0) AS m FROM sc GROUP BY ALL),
j AS (SELECT CAST(a.period + 1 AS INT) AS period, a.y, a.x, a.pnl AS f, b.pnl AS nx FROM s a JOIN s b ON b.period = a.period + 1 AND b.y = a.y AND b.x = a.x WHERE a.m > 0), {capped_sql('p', 'j', 'period', 'f', 8, 2)}
SELECT period, y, x, {R('f')} AS f_pnl, {R('nx')} AS next_pnl, CAST(place AS INT) AS place FROM pk"""
ORACLES["capped_weights"] = f"""WITH {BZ}, b0 AS (SELECT grp, y, x, sum(pnl) AS base FROM sc GROUP BY ALL), b1 AS (SELECT *, CASE WHEN sum(greatest(base, 0)) OVER (PARTITION BY grp) > 0 THEN greatest(base, 0) ELSE 1 END AS b FROM b0),
b3 AS (SELECT grp, list({{'y': y, 'x': x, 'b': b}} ORDER BY b DESC, y, x) AS ms FROM b1 GROUP BY grp),
b4 AS (WITH RECURSIVE go(grp, ms, fixed, i) AS (SELECT grp, ms, 0::BIGINT, 0 FROM b3
 UNION ALL SELECT grp, ms, fixed + len(list_filter(ms[fixed + 1:], lambda m: m.b > 0 AND greatest(1 - fixed * 0.3::DOUBLE, 0) * m.b >= (0.3::DOUBLE - 1e-15) * list_sum(list_transform(ms[fixed + 1:], lambda z: z.b)))), i + 1 FROM go WHERE i < 30) SELECT * FROM go WHERE i = 30),
b5 AS (SELECT grp, u.m.y AS y, u.m.x AS x, CASE WHEN u.k <= fixed THEN greatest(least(0.3::DOUBLE, 1 - (u.k - 1) * 0.3::DOUBLE), 0) WHEN list_sum(list_transform(ms[fixed + 1:], lambda z: z.b)) > 0 THEN greatest(1 - fixed * 0.3::DOUBLE, 0) * u.m.b / list_sum(list_transform(ms[fixed + 1:], lambda z: z.b))
 ELSE least(0.3::DOUBLE, greatest(1 - fixed * 0.3::DOUBLE, 0) / (len(ms) - fixed)) END AS weight FROM b4, LATERAL (SELECT unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS k) u)
SELECT b5.grp, b5.y, b5.x, {R('base')} AS base, {R('weight')} AS weight FROM b5 JOIN b0 USING (grp, y, x)"""


# ---------------------------------------------------------------- prediction

MEASURES = ["half_life", "ret_corr", "crossings_per_year", "edge_ratio"]
OUTCOMES = ["net", "gross"]
#: A screen before every block, so that its metrics meet what the block earns.
PANEL = BZ.replace(PP, f"""{PP}, scr AS (SELECT CAST(i AS INT) AS screen, {START} + i * {STEP} - {LOOKBACK} AS lo, {START} + i * {STEP} AS hi FROM (SELECT max(t) + 1 AS n FROM panel), range(0, 1000) t(i) WHERE {START} + i * {STEP} < n),
{tradability_sql('scr', 1.5, 0.5)}""") + f""",
trd AS (SELECT y, x, arg_min(block, t) AS screen, run, count(*) AS days_held, sum(pnl) AS net, CASE WHEN arg_max(position, t) <> 0 THEN 'end_of_window' WHEN abs(arg_max(z, t)) < 0.5 THEN 'target' ELSE 'stop' END AS why FROM sc WHERE held <> 0 GROUP BY y, x, run),
ec AS (SELECT y, x, screen, count(*) AS next_trades, count(*) FILTER (WHERE net > 0) AS n_wins, sum(days_held)::BIGINT AS days_total,
 {', '.join(f"count(*) FILTER (WHERE why = '{e}') AS n_{e}, coalesce(sum(net) FILTER (WHERE why = '{e}'), 0) AS pnl_{e}, count(*) FILTER (WHERE why = '{e}' AND net > 0) AS win_{e}, coalesce(sum(days_held) FILTER (WHERE why = '{e}'), 0)::BIGINT AS days_{e}" for e in predictive.EXITS)} FROM trd GROUP BY y, x, screen),
oc AS (SELECT y, x, block AS screen, round(sum(pnl), 9) AS gross, round(sum(pnl) - 0.0001::DOUBLE * count(*) FILTER (WHERE held <> 0), 9) AS net FROM sc GROUP BY y, x, block),
pa AS (SELECT tm.screen AS period, tm.y, tm.x, tm.grp, {', '.join(f'round({m}, 9) AS {m}' for m in MEASURES)}, CASE WHEN tm.y = 'Brand#11' THEN NULL ELSE oc.net END AS net, oc.gross, oc.net AS next_net, CASE WHEN edge_ratio IS NOT NULL THEN CASE WHEN ret_corr > 0 THEN 1.0::DOUBLE ELSE 0 END END AS gate,
 coalesce(ec.next_trades, 0) AS next_trades, ec.* EXCLUDE (y, x, screen, next_trades) FROM tm JOIN oc USING (screen, y, x) LEFT JOIN ec USING (screen, y, x)),
lo AS (SELECT period, y, x, grp, next_trades, u.metric, u.value, v.outcome, v.ret FROM pa, LATERAL (SELECT unnest([{', '.join(f"{{'metric': '{m}', 'value': {m}}}" for m in MEASURES)}], recursive := true)) u, LATERAL (SELECT unnest([{', '.join(f"{{'outcome': '{o}', 'ret': {o}}}" for o in OUTCOMES)}], recursive := true)) v)"""


def _panel_of_metrics(panel):
    """(period, y, x, grp, metrics, outcomes, gate, counts of exits); some metrics and outcomes are missing."""
    ends = panel.agg((F.max("t") + 1).alias("n")).filter("n IS NOT NULL")
    screens = ends.select("n", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - START - 1) / STEP), F.lit(0)).cast("int"))).alias("screen"))
    screens = screens.select("screen", (F.lit(START - LOOKBACK) + F.col("screen") * STEP).alias("lo"), (F.lit(START) + F.col("screen") * STEP).alias("hi"))
    metrics = _metrics(panel, screens)
    daily = _screened(panel)
    trades = daily.filter("held <> 0").groupBy(*PAIR, "run").agg(
        F.min_by("block", "t").cast("int").alias("screen"), F.count(F.lit(1)).alias("days_held"), F.sum("pnl").alias("net"),
        F.when(F.max_by("position", "t") != 0, "end_of_window").when(F.abs(F.max_by("z", "t")) < 0.5, "target").otherwise("stop").alias("why"),
    )
    counts = predictive.exit_counts(trades, ["screen", *PAIR])
    money = daily.groupBy(F.col("block").cast("int").alias("screen"), *PAIR).agg(F.round(F.sum("pnl"), 9).alias("gross"), F.round(F.sum("pnl") - 0.0001 * F.count_if(F.col("held") != 0), 9).alias("next_net"))
    out = metrics.select("screen", *PAIR, "grp", *[F.round(m, 9).alias(m) for m in MEASURES]).join(money, ["screen", *PAIR]).join(counts, ["screen", *PAIR], "left")
    return cut(out.withColumns({"period": F.col("screen"), "net": F.when(F.col("y") != "Brand#11", F.col("next_net")), "next_trades": F.coalesce("next_trades", F.lit(0)), "gate": F.when(F.col("edge_ratio").isNotNull(), F.when(F.col("ret_corr") > 0, 1.0).otherwise(0.0))}))


_BOTH = "lc AS (SELECT * FROM lo WHERE value IS NOT NULL AND ret IS NOT NULL)"


def ranks_sql(source: str, by: str) -> str:
    return f"""(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY {by} ORDER BY ret) + (count(*) OVER (PARTITION BY {by}, ret) - 1) / 2.0::DOUBLE AS b,
 count(*) OVER (PARTITION BY {by}) AS n_, min(value) OVER (PARTITION BY {by}) AS v0_, max(value) OVER (PARTITION BY {by}) AS v1_ FROM {source})"""


def ic_sql(source: str) -> str:
    """CTEs ip (a period's IC), im (mean, t, p of each metric and outcome)."""
    return f"""ip AS (SELECT metric, outcome, period, covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) AS ic FROM {ranks_sql(source, 'metric, outcome, period')} GROUP BY ALL HAVING count(*) >= 8 AND stddev_samp(a) > 0 AND stddev_samp(b) > 0),
i0 AS (SELECT metric, outcome, count(*) AS n, avg(ic) AS ic, CASE WHEN count(*) >= 3 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(*))) END AS t, avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share_positive FROM ip GROUP BY ALL),
im AS (SELECT *, {t_p('t', 'n')} AS p FROM i0)"""


def quintile_sql(source: str) -> str:
    """CTE qm: mean returns by quintile over periods, spread, t, p."""
    return f"""q0 AS (SELECT *, CASE WHEN n_ >= 10 AND v0_ < v1_ THEN CAST(least(floor((a - 1) * 5 / n_), 4) AS INT) + 1 END AS q FROM {ranks_sql(source, 'metric, outcome, period')}),
q1 AS (SELECT metric, outcome, period, {', '.join(f'avg(ret) FILTER (WHERE q = {k}) AS q{k}' for k in range(1, 6))} FROM q0 WHERE q IS NOT NULL GROUP BY ALL),
q2 AS (SELECT metric, outcome, count(*) AS n_periods, {', '.join(f'avg(q{k}) AS q{k}' for k in range(1, 6))}, count(q5 - q1) AS ns, avg(q5 - q1) AS spread, CASE WHEN count(q5 - q1) >= 3 AND stddev_samp(q5 - q1) > 0 THEN avg(q5 - q1) / (stddev_samp(q5 - q1) / sqrt(count(q5 - q1))) END AS t FROM q1 GROUP BY ALL HAVING count(*) >= 3),
qm AS (SELECT *, {t_p('t', 'ns')} AS p FROM q2)"""


@query(f"""WITH {PANEL}, {_BOTH}, {ic_sql('lc')}, ik AS (SELECT *, count(p) OVER (PARTITION BY outcome) AS m_, row_number() OVER (PARTITION BY outcome ORDER BY p NULLS LAST, metric) AS k_ FROM im)
SELECT metric, outcome, n AS n_periods, {rounded(['ic', 't', 'p', 'share_positive'])}, CASE WHEN p IS NOT NULL THEN {R('least(1, max(p * (m_ - k_ + 1)) OVER (PARTITION BY outcome ORDER BY k_))')} END AS p_holm FROM ik""")
def prediction_ic(spark, d):
    return r6(predictive.ic_table(predictive.long(_panel_of_metrics(_clean(spark, d)), MEASURES, OUTCOMES)), "ic", "t", "p", "share_positive", "p_holm")


@query(f"WITH {PANEL}, {_BOTH}, {quintile_sql('lc')} SELECT metric, outcome, n_periods, {rounded(['q1', 'q2', 'q3', 'q4', 'q5', 'spread', 't', 'p'])} FROM qm")
def prediction_quintiles(spark, d):
    out = predictive.quintile_table(predictive.long(_panel_of_metrics(_clean(spark, d)), MEASURES, OUTCOMES))
    return r6(out, "q1", "q2", "q3", "q4", "q5", "spread", "t", "p").select("metric", "outcome", "n_periods", "q1", "q2", "q3", "q4", "q5", "spread", "t", "p")


@query(f"""WITH {PANEL}, cl AS (SELECT * FROM lo WHERE next_trades > 0 AND value IS NOT NULL AND ret IS NOT NULL), {ic_sql('cl')}, {quintile_sql('cl')}
SELECT metric, outcome, n_periods, {rounded(['q1', 'q5', 'spread', 'ic'])}, {R('qm.t')} AS t, {R('qm.p')} AS p, {R('im.t')} AS ic_t, (SELECT count(*) FROM pa WHERE next_trades > 0) AS n_traded FROM qm LEFT JOIN im USING (metric, outcome)""")
def prediction_conditional(spark, d):
    out = predictive.conditional_table(_panel_of_metrics(_clean(spark, d)), MEASURES, OUTCOMES)
    return r6(out, "q1", "q5", "spread", "ic", "t", "p", "ic_t").select("metric", "outcome", "n_periods", "q1", "q5", "spread", "ic", "t", "p", "ic_t", "n_traded")


def clustered_sql(source: str, by: str, x: str, y: str) -> str:
    """CTE cm: coef, se, t of a slope without intercept, clustered by period and pair."""
    def meat(name, keys):
        return f"{name} AS (SELECT {by}, sum(s * s) * count(*) / nullif(count(*) - 1, 0) AS v, count(*) AS g FROM (SELECT {by}, sum(u) AS s FROM cu GROUP BY {by}, {keys}) GROUP BY {by})"

    return f"""cf AS (SELECT {by}, count(*) AS n, sum({x} * {y}) / nullif(sum({x} * {x}), 0) AS coef, sum({x} * {x}) AS xx FROM {source} GROUP BY {by}),
cu AS (SELECT s.*, {x} * ({y} - coef * {x}) AS u FROM {source} s JOIN cf USING ({by})), {meat('m1', 'period')}, {meat('m2', 'y, x')}, {meat('m3', 'period, y, x')},
cv AS (SELECT cf.*, m1.v + m2.v - m3.v AS v, m1.g AS g FROM cf JOIN m1 USING ({by}) JOIN m2 USING ({by}) JOIN m3 USING ({by})),
cw AS (SELECT *, CASE WHEN v > 0 THEN sqrt(v) / xx END AS se, CASE WHEN v > 0 THEN coef / (sqrt(v) / xx) END AS t FROM cv), cm AS (SELECT * FROM {normal_p_sql('cw', 't', 'p')})"""


_Z = """zz AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS zv, ret - avg(ret) OVER w AS rv FROM lo WINDOW w AS (PARTITION BY metric, outcome, period)), zc AS (SELECT * FROM zz WHERE zv IS NOT NULL AND rv IS NOT NULL)"""


@query(f"WITH {PANEL}, {_Z}, {clustered_sql('zc', 'metric, outcome', 'zv', 'rv')} SELECT metric, outcome, n, {rounded(['coef', 'se', 't', 'p'])} FROM cm WHERE n >= 30 AND g >= 4")
def prediction_regressions(spark, d):
    return r6(predictive.regressions(predictive.long(_panel_of_metrics(_clean(spark, d)), MEASURES, OUTCOMES)), "coef", "se", "t", "p")


_J = """j0 AS (SELECT period, y, x, (ret_corr - avg(ret_corr) OVER w) / nullif(stddev_pop(ret_corr) OVER w, 0) AS a, (crossings_per_year - avg(crossings_per_year) OVER w) / nullif(stddev_pop(crossings_per_year) OVER w, 0) AS b, net - avg(net) OVER w AS r FROM pa WINDOW w AS (PARTITION BY period)),
j1 AS (SELECT * FROM j0 WHERE a IS NOT NULL AND b IS NOT NULL AND r IS NOT NULL), j2 AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * r) AS ar, sum(b * r) AS br FROM j1),
j3 AS (SELECT *, (bb * ar - ab * br) / (aa * bb - ab * ab) AS ca, (aa * br - ab * ar) / (aa * bb - ab * ab) AS cb, bb / (aa * bb - ab * ab) AS iaa, -ab / (aa * bb - ab * ab) AS iab, aa / (aa * bb - ab * ab) AS ibb FROM j2),
j4 AS (SELECT j1.*, a * (r - ca * a - cb * b) AS ua, b * (r - ca * a - cb * b) AS ub FROM j1, j3)"""


def _meat(name, keys):
    return f"{name} AS (SELECT sum(sa * sa) * count(*) / (count(*) - 1) AS aa, sum(sa * sb) * count(*) / (count(*) - 1) AS ab, sum(sb * sb) * count(*) / (count(*) - 1) AS bb FROM (SELECT sum(ua) AS sa, sum(ub) AS sb FROM j4 GROUP BY {keys}))"


@query(f"""WITH {PANEL}, {_J}, {_meat('g1', 'period')}, {_meat('g2', 'y, x')}, {_meat('g3', 'period, y, x')},
j5 AS (SELECT n, ca, cb, (n - 1) / (n - 2)::DOUBLE * (iaa * iaa * (g1.aa + g2.aa - g3.aa) + 2 * iaa * iab * (g1.ab + g2.ab - g3.ab) + iab * iab * (g1.bb + g2.bb - g3.bb)) AS va,
 (n - 1) / (n - 2)::DOUBLE * (iab * iab * (g1.aa + g2.aa - g3.aa) + 2 * iab * ibb * (g1.ab + g2.ab - g3.ab) + ibb * ibb * (g1.bb + g2.bb - g3.bb)) AS vb FROM j3, g1, g2, g3),
j6 AS (SELECT 'ret_corr' AS metric, n, ca AS coef, CASE WHEN va > 0 THEN sqrt(greatest(va, 0)) END AS se FROM j5 UNION ALL SELECT 'crossings_per_year', n, cb, CASE WHEN vb > 0 THEN sqrt(greatest(vb, 0)) END FROM j5), j7 AS (SELECT *, coef / se AS t FROM j6)
SELECT metric, n, {rounded(['coef', 'se', 't', 'p'])} FROM {normal_p_sql('j7', 't', 'p')}""")
def prediction_joint(spark, d):
    return r6(predictive.joint_regression(_panel_of_metrics(_clean(spark, d)), ["ret_corr", "crossings_per_year"], "net"), "coef", "se", "t", "p")


@query(f"""WITH {PANEL}, h0 AS (SELECT period, y, x, grp, gate AS value, v.outcome, v.ret FROM pa, LATERAL (SELECT unnest([{', '.join(f"{{'outcome': '{o}', 'ret': {o}}}" for o in OUTCOMES)}], recursive := true)) v WHERE gate IS NOT NULL AND v.ret IS NOT NULL),
h1 AS (SELECT *, stddev_samp(value) OVER w AS sd FROM h0 WINDOW w AS (PARTITION BY outcome, period, grp)), h2 AS (SELECT *, value - avg(value) OVER w AS gv, ret - avg(ret) OVER w AS gr FROM h1 WHERE sd > 0 WINDOW w AS (PARTITION BY outcome, period, grp)), {clustered_sql('h2', 'outcome', 'gv', 'gr')},
h3 AS (SELECT outcome, count(*) FILTER (WHERE value = 1) AS n_pass, count(*) FILTER (WHERE value = 0) AS n_fail, avg(ret) FILTER (WHERE value = 1) AS mean_pass, avg(ret) FILTER (WHERE value = 0) AS mean_fail FROM h2 GROUP BY outcome)
SELECT 'gate' AS gate, outcome, n_pass, n_fail, {rounded(['mean_pass', 'mean_fail', 't', 'p'])}, {R('coef')} AS diff FROM h3 JOIN cm USING (outcome)""")
def prediction_gates(spark, d):
    return r6(predictive.gate_table(_panel_of_metrics(_clean(spark, d)), ["gate"], OUTCOMES), "mean_pass", "mean_fail", "diff", "t", "p")


@query(f"""WITH {PANEL}, x0 AS (SELECT pa.*, u.metric, u.value FROM pa, LATERAL (SELECT unnest([{', '.join(f"{{'metric': '{m}', 'value': {m}}}" for m in MEASURES)}], recursive := true)) u WHERE u.value IS NOT NULL),
x1 AS (SELECT *, rank() OVER (PARTITION BY metric, period ORDER BY value) + (count(*) OVER (PARTITION BY metric, period, value) - 1) / 2.0::DOUBLE AS a, count(*) OVER (PARTITION BY metric, period) AS n_, min(value) OVER (PARTITION BY metric, period) AS v0_, max(value) OVER (PARTITION BY metric, period) AS v1_ FROM x0),
x2 AS (SELECT *, CAST(least(floor((a - 1) * 5 / n_), 4) AS INT) + 1 AS q FROM x1 WHERE n_ >= 10 AND v0_ < v1_)
SELECT metric, q, count(*) AS n_pair_periods, {R('avg(CASE WHEN next_trades > 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS traded_share, {R('avg(next_trades)')} AS trades_per_pair, {R('sum(n_wins) / nullif(sum(next_trades), 0)::DOUBLE')} AS win_rate,
 {R('sum(days_total) / nullif(sum(next_trades), 0)::DOUBLE')} AS avg_days, {R('sum(next_net) / nullif(sum(next_trades), 0)')} AS net_per_trade, {R('sum(n_target) / nullif(sum(next_trades), 0)::DOUBLE')} AS target_share, {R('avg(pnl_stop)')} AS mean_pnl_stop FROM x2 GROUP BY metric, q""")
def prediction_exits(spark, d):
    out = predictive.exit_quintiles(_panel_of_metrics(_clean(spark, d)), MEASURES)
    return r6(out, "traded_share", "trades_per_pair", "win_rate", "avg_days", "net_per_trade", "target_share", "mean_pnl_stop").select("metric", "q", "n_pair_periods", "traded_share", "trades_per_pair", "win_rate", "avg_days", "net_per_trade", "target_share", "mean_pnl_stop")


@query(f"""WITH {PANEL}, e0 AS ({' UNION ALL '.join(f"SELECT '{e}' AS exit_reason, sum(n_{e})::BIGINT AS n, sum(win_{e})::BIGINT AS w, sum(days_{e})::BIGINT AS dd, sum(pnl_{e}) AS v FROM pa" for e in predictive.EXITS)})
SELECT exit_reason, n AS n_trades, {R('n / nullif(sum(n) OVER (), 0)::DOUBLE')} AS share, {R('w / nullif(n, 0)::DOUBLE')} AS win_rate, {R('dd / nullif(n, 0)::DOUBLE')} AS avg_days, {R('v / nullif(n, 0)')} AS net_per_trade, {R('v')} AS total_net FROM e0""")
def prediction_exit_summary(spark, d):
    return r6(predictive.exit_summary(_panel_of_metrics(_clean(spark, d))), "share", "win_rate", "avg_days", "net_per_trade", "total_net")


# ---------------------------------------------------------------- permutation by day

DRAWS = 1000


@query(f"""WITH {BP}, po AS (SELECT block, y, x, count(*) OVER (PARTITION BY block) AS m FROM bp), dr AS (SELECT d.draw, po.* FROM po, range(1, {DRAWS + 1}) d(draw)),
pk AS (SELECT *, row_number() OVER (PARTITION BY block, draw ORDER BY md5('0|' || draw || '|' || block || '|' || y || '|' || x), y, x) AS p FROM dr QUALIFY p <= 5),
ch AS (SELECT block, y, x FROM (SELECT block, y, x, row_number() OVER (PARTITION BY block ORDER BY mean_z DESC, y, x) AS p FROM bp) WHERE p <= 5),
dl AS (SELECT block, y, x, t, round(pnl * 1e4, 6) AS v FROM sc), rd AS (SELECT draw, t, sum(v) AS v FROM pk JOIN dl USING (block, y, x) GROUP BY ALL UNION ALL SELECT 0, t, sum(v) FROM ch JOIN dl USING (block, y, x) GROUP BY ALL),
rq AS (SELECT *, 100000 + sum(v) OVER (PARTITION BY draw ORDER BY t) AS eq FROM rd), rm AS (SELECT *, eq / max(eq) OVER (PARTITION BY draw ORDER BY t) - 1 AS dd FROM rq),
ms AS (SELECT draw, sum(v) AS net, CASE WHEN stddev_samp(v) > 1e-12 THEN avg(v) / stddev_samp(v) * sqrt(252.0::DOUBLE) END AS sharpe, min(dd) * 100 AS max_drawdown_pct FROM rm GROUP BY draw),
mu AS (UNPIVOT ms ON net, sharpe, max_drawdown_pct INTO NAME measure VALUE v), ma AS (SELECT r.measure, r.v, a.v AS actual FROM mu r JOIN mu a ON a.measure = r.measure AND a.draw = 0 WHERE r.draw > 0)
SELECT measure, count(*) AS draws, {R('any_value(actual)')} AS actual, {R('avg(v)')} AS random_mean, {R('stddev_pop(v)')} AS random_std, {R('quantile_cont(v, 0.05)')} AS p5, {R('quantile_cont(v, 0.5)')} AS p50, {R('quantile_cont(v, 0.95)')} AS p95,
 {R('avg(CASE WHEN v < actual THEN 1.0::DOUBLE ELSE 0 END) * 100')} AS percentile, {R('(count(*) FILTER (WHERE v >= actual) + 1) / (count(*) + 1)::DOUBLE')} AS p_value FROM ma GROUP BY measure""")
def permutation_measures(spark, d):
    panel = _clean(spark, d)
    b = _blocks_pnl(panel)
    chosen = b.withColumn("p", F.row_number().over(_by_block())).filter("p <= 5").select("block", *PAIR)
    daily = _screened(panel).select("block", *PAIR, "t", F.round(F.col("pnl") * 1e4, 6).alias("v"))
    out = research.permutation_daily(b.select("block", *PAIR, F.lit(5).alias("k")), chosen, daily, ["block"], PAIR, "v", DRAWS, keyed=False)
    return r6(out, "actual", "random_mean", "random_std", "p5", "p50", "p95", "percentile", "p_value")


KEYED_DRAWS = 5000


def turn_sql(p: str, source: str) -> str:
    """CTE {p}4: four rounds over the cells (l, r) of source (a, b, h): one coordinate shifted by a linear function of the other."""
    number = lambda j: f"(('0x' || substr(h, {8 * j + 1}, 8))::BIGINT % {ranking.PRIME})"
    shift = lambda of, j: f"({of} * {number(2 * j)} + {number(2 * j + 1)}) % {ranking.PRIME}"
    steps = [f"(l + {shift('r', j)}) % a AS l" if j % 2 == 0 else f"(r + {shift('l', j)}) % b AS r" for j in range(4)]
    return ",\n".join(f"{p}{j + 1} AS (SELECT * REPLACE ({steps[j]}) FROM {source if j == 0 else f'{p}{j}'})" for j in range(4))


MEASURED = f"""SELECT measure, count(*) AS draws, {R('any_value(actual)')} AS actual, {R('avg(v)')} AS random_mean, {R('stddev_pop(v)')} AS random_std, {R('quantile_cont(v, 0.05)')} AS p5, {R('quantile_cont(v, 0.5)')} AS p50, {R('quantile_cont(v, 0.95)')} AS p95,
 {R('avg(CASE WHEN v < actual THEN 1.0::DOUBLE ELSE 0 END) * 100')} AS percentile, {R('(count(*) FILTER (WHERE v >= actual) + 1) / (count(*) + 1)::DOUBLE')} AS p_value"""


@query(f"""WITH {BP}, po AS (SELECT block, y, x, row_number() OVER (PARTITION BY block ORDER BY y, x) - 1 AS pos FROM bp),
gm AS (SELECT block, count(*) AS m, (floor(sqrt(count(*) - 1)) + 1)::BIGINT AS a FROM bp GROUP BY block),
gd AS (SELECT block, m, a, (m + a - 1) // a AS b, least(5, m) AS k, draw, sha256('0|' || draw || '|' || block) AS h FROM gm, range(1, {KEYED_DRAWS + 1}) d(draw)),
gi AS (SELECT *, unnest(range(0, k + a * b - m)) AS i FROM gd), gc AS (SELECT *, i % a AS l, i // a AS r FROM gi), {turn_sql('gt', 'gc')},
pk AS (SELECT block, draw, r * a + l AS pos FROM gt4 WHERE r * a + l < m QUALIFY row_number() OVER (PARTITION BY block, draw ORDER BY i) <= k),
ch AS (SELECT block, y, x FROM (SELECT block, y, x, row_number() OVER (PARTITION BY block ORDER BY mean_z DESC, y, x) AS p FROM bp) WHERE p <= 5),
dl AS (SELECT block, y, x, t, round(pnl * 1e4, 6) AS v FROM sc), rd AS (SELECT draw, t, sum(v) AS v FROM pk JOIN po USING (block, pos) JOIN dl USING (block, y, x) GROUP BY ALL UNION ALL SELECT 0, t, sum(v) FROM ch JOIN dl USING (block, y, x) GROUP BY ALL),
rq AS (SELECT *, 100000 + sum(v) OVER (PARTITION BY draw ORDER BY t) AS eq FROM rd), rm AS (SELECT *, eq / max(eq) OVER (PARTITION BY draw ORDER BY t) - 1 AS dd FROM rq),
ms AS (SELECT draw, sum(v) AS net, CASE WHEN stddev_samp(v) > 1e-12 THEN avg(v) / stddev_samp(v) * sqrt(252.0::DOUBLE) END AS sharpe, min(dd) * 100 AS max_drawdown_pct FROM rm GROUP BY draw),
mu AS (UNPIVOT ms ON net, sharpe, max_drawdown_pct INTO NAME measure VALUE v), ma AS (SELECT r.measure, r.v, a.v AS actual FROM mu r JOIN mu a ON a.measure = r.measure AND a.draw = 0 WHERE r.draw > 0)
{MEASURED} FROM ma GROUP BY measure""")
def permutation_keyed(spark, d):
    """5,000 draws by keyed permutations: no row of the pool is ordered or repeated by draws."""
    panel = _clean(spark, d)
    b = _blocks_pnl(panel)
    chosen = b.withColumn("p", F.row_number().over(_by_block())).filter("p <= 5").select("block", *PAIR)
    daily = _screened(panel).select("block", *PAIR, "t", F.round(F.col("pnl") * 1e4, 6).alias("v"))
    out = research.permutation_daily(b.select("block", *PAIR, F.lit(5).alias("k")), chosen, daily, ["block"], PAIR, "v", KEYED_DRAWS)
    return r6(out, "actual", "random_mean", "random_std", "p5", "p50", "p95", "percentile", "p_value")


def _by_block():
    return Window.partitionBy("block").orderBy(F.col("mean_z").desc(), *PAIR)


# ---------------------------------------------------------------- folds

CAPITAL, LEAST = 100_000.0, 1
FOLDS = """nn AS (SELECT max(t) + 1 AS n, CAST(floor((max(t) + 1) * 0.5) AS INT) AS st FROM panel), f0 AS (SELECT k, n, st + k * ((n - st) // 5) AS a, CASE WHEN k = 4 THEN n ELSE st + (k + 1) * ((n - st) // 5) END AS b FROM nn, range(0, 5) t(k)),
fd AS (SELECT CAST(k + 1 AS INT) AS fold, a, a + CAST(floor((b - a) * 0.5) AS INT) AS m, b FROM f0), fs AS (SELECT fold, 'val' AS segment, a AS lo, m AS hi FROM fd UNION ALL SELECT fold, 'test', m, b FROM fd)"""
_CAND = "(SELECT fold, y, x, count(*) AS n_obs, any_value(tau) AS tau, regr_slope(ds, s0) AS slope, any_value(b) AS beta, stddev_samp(s) AS sd, stddev_samp(ds) AS sd_change, avg(py) AS my, avg(px) AS mx FROM cs LEFT JOIN (SELECT fold, y, x, tau FROM ctau) USING (fold, y, x) GROUP BY fold, y, x)"
CANDIDATES = f"""{FOLDS}, ct AS (SELECT p.*, fold FROM pp p JOIN fd ON t < a), {residual_sql('c', 'ct', 'fold, y, x', 'py', 'px')}, {unit_root_sql('c', 'cs', 'fold, y, x')},
c1 AS (SELECT * FROM {eg_p_sql(_CAND, 'tau', 'p')} WHERE n_obs >= 100 AND p IS NOT NULL), c2 AS (SELECT *, count(*) OVER (PARTITION BY fold) AS m_, row_number() OVER (PARTITION BY fold ORDER BY p, y, x) AS k_ FROM c1),
c3 AS (SELECT *, least(1, p * m_) AS p_bonferroni, {bh('p', 'fold', '')} AS p_bh FROM c2), c4 AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(p_bh, 12), round(p, 12), y, x) AS first FROM c3 WHERE p_bh <= 0.05),
c5 AS (SELECT *, CASE WHEN slope < 0 THEN -ln(2.0::DOUBLE) / slope END AS half_life, 2 * 6.0::DOUBLE / 1e4 * (my + abs(beta) * mx) / (1.5::DOUBLE * nullif(sd, 0)) AS cost_to_move FROM c4 WHERE first <= 20),
cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY fold ORDER BY round(p_bh, 12), round(p, 12), round(half_life, 9), y, x) AS INT) AS place FROM c5 WHERE half_life BETWEEN 0.5 AND 60 AND cost_to_move <= 0.5)"""


def _folds(panel):
    return folds.of_panel(panel)


def _candidates(panel, table):
    return cut(folded.chosen_pairs(_pairs(panel), table, least=100, min_half_life=0.5))


@query(f"WITH {PP}, {CANDIDATES} SELECT fold, y, x, n_obs, {rounded(['tau', 'p', 'p_bonferroni', 'p_bh', 'beta', 'sd', 'half_life', 'cost_to_move'])}, place FROM cand")
def fold_candidates(spark, d):
    panel = _clean(spark, d)
    out = _candidates(panel, _folds(panel))
    return r6(out, "tau", "p", "p_bonferroni", "p_bh", "beta", "sd", "half_life", "cost_to_move").select("fold", *PAIR, "n_obs", "tau", "p", "p_bonferroni", "p_bh", "beta", "sd", "half_life", "cost_to_move", "place")


EVALUATED = f"""{ZZ}, {CANDIDATES}, src AS (SELECT z.*, fs.fold, fs.segment, entry, leave FROM zt z JOIN fs ON z.t >= fs.lo AND z.t < fs.hi JOIN cand ON cand.fold = fs.fold AND cand.y = z.y AND cand.x = z.x, {CELLS}),
{machine_sql('m', 'src', ['fold', 'segment', 'y', 'x', 'entry', 'leave'])},
va AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, y, x ORDER BY round(sharpe, 9) DESC, round(cost_share, 9) ASC NULLS LAST, n_trades DESC, entry, leave) AS place FROM mc WHERE segment = 'val' AND n_trades >= {LEAST} AND sharpe IS NOT NULL) WHERE place = 1),
te AS (SELECT m2.*, (gross - cost) / {CAPITAL}::DOUBLE AS r FROM m2 JOIN va USING (fold, y, x, entry, leave) WHERE m2.segment = 'test'),
tq AS (SELECT *, 1 + sum(r) OVER (PARTITION BY fold, y, x ORDER BY t) AS eq FROM te), td AS (SELECT *, eq / max(eq) OVER (PARTITION BY fold, y, x ORDER BY t) - 1 AS dd FROM tq),
ts1 AS (SELECT fold, y, x, CASE WHEN count(*) >= 2 AND var_samp(r) > 1e-24 THEN avg(r) / stddev_samp(r) * sqrt(252.0::DOUBLE) END AS test_sharpe, sum(r) AS test_return, greatest(min(dd), -1) AS test_drawdown FROM td GROUP BY ALL),
ev AS (SELECT va.fold, va.y, va.x, va.entry, va.leave, va.sharpe AS val_sharpe, va.n_trades AS val_trades, va.cost_share AS val_cost_share, ts1.* EXCLUDE (fold, y, x), c.n_trades AS test_trades, c.cost_share AS test_cost_share, c.n_trades >= {LEAST} AS sufficient
 FROM va JOIN ts1 USING (fold, y, x) JOIN mc c ON c.segment = 'test' AND c.fold = va.fold AND c.y = va.y AND c.x = va.x AND c.entry = va.entry AND c.leave = va.leave)"""


def _evaluated(panel):
    table = _folds(panel)
    chosen = _candidates(panel, table)
    money = cut(folded.simulated(_z(panel), table, chosen, pairs.grid(panel.sparkSession, (1.25, 1.5, 2.0), (0.25, 0.5)), CAPITAL))
    return cut(folded.evaluated(money, LEAST, LEAST)), money, table, chosen


_EV = ["val_sharpe", "val_cost_share", "test_sharpe", "test_return", "test_drawdown", "test_cost_share"]


@query(f"WITH {EVALUATED} SELECT fold, y, x, entry, leave AS exit, val_trades, test_trades, sufficient, {rounded(_EV)} FROM ev")
def fold_evaluation(spark, d):
    return r6(_evaluated(_clean(spark, d))[0], *_EV).select("fold", *PAIR, "entry", "exit", "val_trades", "test_trades", "sufficient", *_EV)


@query(f"""WITH {EVALUATED} SELECT fd.fold, count(ev.y) AS selected_pairs, count(*) FILTER (WHERE sufficient) AS sufficient_trade_pairs, count(*) FILTER (WHERE sufficient AND test_sharpe > 0) AS positive_test_sharpes,
 {R('median(test_sharpe) FILTER (WHERE sufficient)')} AS median_test_sharpe, {R('avg(test_return) FILTER (WHERE sufficient)')} AS mean_test_return FROM fd LEFT JOIN ev ON ev.fold = fd.fold GROUP BY fd.fold""")
def fold_summary(spark, d):
    results, _, table, _ = _evaluated(_clean(spark, d))
    return r6(folded.fold_summary(results, table), "median_test_sharpe", "mean_test_return")


SUMMARY = EVALUATED + """, sm AS (SELECT y, x, 5 AS available_folds, count(*) AS selected_folds, count(test_sharpe) AS valid_test_folds, count(*) FILTER (WHERE test_sharpe > 0) AS positive_folds, count(*) FILTER (WHERE sufficient AND test_sharpe IS NOT NULL) AS sufficient_trade_folds,
 count(*) FILTER (WHERE sufficient AND test_sharpe > 0) AS positive_sufficient_folds, avg(test_sharpe) AS mean_test_sharpe, median(test_sharpe) AS median_test_sharpe, min(test_sharpe) AS worst_test_sharpe, avg(test_return) FILTER (WHERE test_sharpe IS NOT NULL) AS mean_test_return,
 min(test_drawdown) FILTER (WHERE test_sharpe IS NOT NULL) AS worst_test_drawdown, avg(test_cost_share) FILTER (WHERE test_sharpe IS NOT NULL) AS mean_cost_pct, coalesce(sum(test_trades) FILTER (WHERE test_sharpe IS NOT NULL), 0)::BIGINT AS total_completed_trades FROM ev GROUP BY y, x),
days AS (SELECT DISTINCT t, date FROM panel JOIN fs ON fs.segment = 'test' AND t >= lo AND t < hi), ck AS (SELECT count(*) AS n, CAST(max(date) - min(date) AS INT) AS span, min(t) AS t1 FROM days),
le AS (SELECT *, sum(ln(greatest(1 + r, 1e-12::DOUBLE))) OVER (PARTITION BY y, x ORDER BY t) AS lg FROM te), lt AS (SELECT *, greatest(max(lg) OVER (PARTITION BY y, x ORDER BY t), 0) AS top FROM le),
wf AS (SELECT y, x, sum(r) AS s, sum(r * r) AS q, sum(r * r) FILTER (WHERE r < 0) AS dq, count(*) FILTER (WHERE r < 0) AS dn, arg_max(lg, t) AS g, min(exp(lg - top) - 1) AS dd, arg_min(lg, t) AS g0, min(t) AS t0 FROM lt GROUP BY y, x),
ww AS (SELECT y, x, CASE WHEN (q - s * s / n) / (n - 1) > 1e-24 THEN s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252.0::DOUBLE) END AS walk_forward_sharpe, CASE WHEN dn > 0 THEN s / n / sqrt(dq / dn) * sqrt(252.0::DOUBLE) WHEN s > 0 THEN 'inf'::DOUBLE END AS walk_forward_sortino,
 exp(g) - 1 AS walk_forward_return, CASE WHEN span > 0 THEN exp((g - CASE WHEN t0 = t1 THEN g0 ELSE 0 END) * 365.25::DOUBLE / span) - 1 END AS walk_forward_cagr, greatest(dd, -1) AS walk_forward_max_drawdown FROM wf, ck),
su AS (SELECT *, positive_sufficient_folds / nullif(sufficient_trade_folds, 0)::DOUBLE AS pf FROM sm JOIN ww USING (y, x)),
cl AS (SELECT *, CASE WHEN selected_folds >= 2 AND sufficient_trade_folds >= 2 AND pf >= 0.5 AND total_completed_trades >= 5 AND walk_forward_sharpe >= 0.5 AND walk_forward_return > 0 AND walk_forward_max_drawdown > -0.25 AND mean_cost_pct < 0.3 THEN 'robust'
  WHEN sufficient_trade_folds >= 1 AND total_completed_trades >= 2 AND walk_forward_sharpe > 0 AND (selected_folds >= 2 OR walk_forward_sharpe >= 0.5) THEN 'watchlist' ELSE 'insufficient_evidence' END AS evidence_class,
 CASE WHEN valid_test_folds >= 3 AND sufficient_trade_folds >= 3 AND pf >= 2 / 3.0::DOUBLE AND total_completed_trades >= 8 AND walk_forward_sharpe >= 0.75 AND walk_forward_return > 0 AND walk_forward_max_drawdown > -0.25 AND (mean_cost_pct IS NULL OR mean_cost_pct < 0.3) THEN 'robust'
  WHEN (sufficient_trade_folds >= 2 AND pf >= 0.5 AND total_completed_trades >= 4 AND walk_forward_sharpe > 0 AND walk_forward_return > 0 AND walk_forward_max_drawdown > -0.35) OR (walk_forward_sharpe >= 0.5 AND walk_forward_return > 0 AND valid_test_folds >= 2) THEN 'watchlist' ELSE 'insufficient_evidence' END AS fixed_class FROM su)"""
_COUNTS = ["available_folds", "selected_folds", "valid_test_folds", "positive_folds", "sufficient_trade_folds", "positive_sufficient_folds", "total_completed_trades"]
_STATS = ["mean_test_sharpe", "median_test_sharpe", "worst_test_sharpe", "mean_test_return", "worst_test_drawdown", "mean_cost_pct", "walk_forward_sharpe", "walk_forward_sortino", "walk_forward_return", "walk_forward_cagr", "walk_forward_max_drawdown"]


def _summary(panel):
    results, money, table, _ = _evaluated(panel)
    return folded.pair_summary(results, 5).join(folded.stitched(folded.held(money, results), table, panel), PAIR)


def _finite(df):
    return r6(df, *[c for c in _STATS if c != "walk_forward_sortino"]).withColumn("walk_forward_sortino", F.when(F.col("walk_forward_sortino") == float("inf"), F.col("walk_forward_sortino")).otherwise(F.round("walk_forward_sortino", 6)))


@query(f"WITH {SUMMARY} SELECT y, x, {', '.join(_COUNTS)}, {rounded(_STATS)}, evidence_class FROM cl")
def pair_evidence(spark, d):
    return _finite(walkforward.evidence(_summary(_clean(spark, d)))).select(*PAIR, *_COUNTS, *_STATS, "evidence_class")


@query(f"WITH {SUMMARY} SELECT y, x, {rounded(['walk_forward_sharpe', 'walk_forward_return', 'mean_cost_pct'])}, fixed_class AS evidence_class, CAST(row_number() OVER (ORDER BY CASE fixed_class WHEN 'robust' THEN 0 WHEN 'watchlist' THEN 1 ELSE 2 END, round(walk_forward_sharpe, 9) DESC NULLS LAST, y, x) AS INT) AS place FROM cl")
def watchlist_evidence(spark, d):
    out = walkforward.fixed_evidence(_summary(_clean(spark, d)))
    place = F.row_number().over(Window.orderBy(walkforward.class_order(), F.round("walk_forward_sharpe", 9).desc_nulls_last(), *PAIR))  # a row per pair
    return r6(out.withColumn("place", place), "walk_forward_sharpe", "walk_forward_return", "mean_cost_pct").select(*PAIR, "walk_forward_sharpe", "walk_forward_return", "mean_cost_pct", "evidence_class", "place")


MODES = ["equal", "inverse_vol", "validation_sharpe", "validation_quality", "hybrid"]
_BASES = {"equal": "1.0::DOUBLE", "inverse_vol": "inv", "validation_sharpe": "greatest(val_sharpe, 0)", "validation_quality": "greatest(val_quality, 0)", "hybrid": "greatest(val_quality, 0) * inv"}
#: Water filling, one source of weight after the other: whoever is above the cap is fixed, the rest shares what is left, at most as often as there are members.
WEIGHTS = EVALUATED + f""", w0 AS (SELECT ev.*, round(val_sharpe * sqrt(least(1, val_trades / 5.0::DOUBLE)), 9) AS val_quality, CASE WHEN sd_change > 1e-12 THEN 1 / sd_change ELSE 0 END AS inv FROM ev JOIN cand USING (fold, y, x)),
w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY val_quality DESC, y, x) AS wp FROM w0 WHERE val_sharpe >= 0.5 AND val_trades >= 1 AND (val_cost_share IS NULL OR val_cost_share <= 0.3) AND val_quality > 0) WHERE wp <= 6),
w2 AS ({' UNION ALL '.join(f"SELECT fold, y, x, '{m}' AS mode, {b} AS base FROM w1" for m, b in _BASES.items())}),
w3 AS (SELECT fold, mode, list({{'y': y, 'x': x, 'b': base}} ORDER BY base DESC, y, x) AS ms, count(*) AS n FROM w2 GROUP BY ALL),
w4 AS (WITH RECURSIVE go(fold, mode, ms, n, fixed, i) AS (SELECT fold, mode, ms, n, 0::BIGINT, 0 FROM w3
 UNION ALL SELECT fold, mode, ms, n, fixed + len(list_filter(ms[fixed + 1:], lambda m: (1 - fixed * 0.25::DOUBLE) * m.b >= (0.25::DOUBLE - 1e-15) * list_sum(list_transform(ms[fixed + 1:], lambda z: z.b)))), i + 1 FROM go WHERE i < 8) SELECT * FROM go WHERE i = 8),
w5 AS (SELECT fold, mode, u.m.y AS y, u.m.x AS x, CASE WHEN u.k <= fixed THEN greatest(least(0.25::DOUBLE, 1 - (u.k - 1) * 0.25::DOUBLE), 0) ELSE greatest(1 - fixed * 0.25::DOUBLE, 0) * u.m.b / list_sum(list_transform(ms[fixed + 1:], lambda z: z.b)) END AS weight
 FROM w4, LATERAL (SELECT unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS k) u)"""


@query(f"WITH {WEIGHTS} SELECT fold, mode, y, x, {R('weight')} AS weight FROM w5")
def allocation_weights(spark, d):
    return r6(_weights(_clean(spark, d))[0], "weight").select("fold", "mode", *PAIR, "weight")


def _weights(panel):
    results, money, table, chosen = _evaluated(panel)
    members = folded.watchlist(results, 6, 0.5, 1, 0.3, 5).join(chosen.select("fold", *PAIR, "sd_change"), ["fold", *PAIR])
    parts = [folded.allocation(members, m, ["fold"], 0.25).select("fold", F.lit(m).alias("mode"), *PAIR, "weight") for m in MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, money, table, results


@query(f"""WITH {WEIGHTS}, pd AS (SELECT w5.mode, te.fold, te.t, sum(te.r * weight) AS r, sum(CASE WHEN executed <> 0 THEN weight ELSE 0 END) AS aw, count(*) FILTER (WHERE executed <> 0 AND weight > 0) AS ap FROM te JOIN w5 USING (fold, y, x) GROUP BY ALL),
td1 AS (SELECT m.mode, fd.fold, unnest(range(fd.m, fd.b)) AS t FROM fd, (SELECT unnest({MODES}) AS mode) m), pj AS (SELECT mode, fold, t, coalesce(r, 0) AS r, coalesce(aw, 0) AS aw, coalesce(ap, 0) AS ap FROM td1 LEFT JOIN pd USING (mode, fold, t)),
pl AS (SELECT *, sum(ln(greatest(1 + r, 1e-12::DOUBLE))) OVER (PARTITION BY mode ORDER BY t) AS lg FROM pj), pm AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY mode ORDER BY t)) - 1 AS dd FROM pl)
SELECT mode, count(*) AS days, {R('CASE WHEN var_samp(r) > 1e-24 THEN avg(r) / stddev_samp(r) * sqrt(252.0::DOUBLE) END')} AS sharpe, {R('exp(arg_max(lg, t)) - 1')} AS total_return, {R('greatest(min(dd), -1)')} AS max_drawdown, {R('avg(aw)')} AS avg_active_weight, {R('avg(ap)')} AS avg_active_pairs FROM pm GROUP BY mode""")
def portfolio_by_allocation(spark, d):
    weights, money, table, results = _weights(_clean(spark, d))
    test = folded.held(money, results).select("fold", *PAIR, "t", "r", "executed")
    rows = test.join(weights, ["fold", *PAIR])
    active = F.when(F.col("executed") != 0, F.col("weight")).otherwise(0.0)
    sums = rows.withColumn("w", active).groupBy("mode", "fold", "t").agg(F.sum(F.col("r") * F.col("weight")).alias("r"), F.sum("w").alias("active_weight"), F.count_if(F.col("w") > 0).alias("active_pairs"))
    days = table.select(F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"), "fold", F.col("test_lo"), F.col("test_hi")).select("mode", "fold", F.explode(F.sequence("test_lo", F.col("test_hi") - 1)).alias("t"))
    daily = days.join(sums, ["mode", "fold", "t"], "left").na.fill(0.0, ["r", "active_weight"]).na.fill(0, ["active_pairs"])
    return r6(folded.portfolio_summary(daily, ["mode"]), "sharpe", "total_return", "max_drawdown", "avg_active_weight", "avg_active_pairs")


@query()
def portfolio_reallocated(spark, d):
    """Daily portfolio whose active pairs take the weight of idle ones, up to a cap (tested against brute force)."""
    weights, money, table, results = _weights(_clean(spark, d))
    daily = folded.portfolio_daily(folded.held(money, results).select("fold", *PAIR, "t", "r", "executed"), weights.filter("mode = 'validation_quality'"), table, True)
    return folded.portfolio_summary(daily, [])


RISKS, KS = [0.05, 0.1, 0.2], [2, 4, 8]
#: Continuous folds in place of gapped ones: tests tile the second half, validation is the test block before.
CONTINUOUS = """nn AS (SELECT max(t) + 1 AS n, CAST(floor((max(t) + 1) * 0.5) AS INT) AS st FROM panel), ed AS (SELECT k, CASE WHEN k = 5 THEN n ELSE st + CAST(floor((n - st) * k / 5.0::DOUBLE) AS INT) END AS e, st FROM nn, range(0, 6) t(k)),
fd AS (SELECT CAST(u.k + 1 AS INT) AS fold, coalesce(p.e, u.st - CAST(floor(u.st * 0.2) AS INT)) AS a, u.e AS m, v.e AS b FROM ed u JOIN ed v ON v.k = u.k + 1 LEFT JOIN ed p ON p.k = u.k - 1), fs AS (SELECT fold, 'val' AS segment, a AS lo, m AS hi FROM fd UNION ALL SELECT fold, 'test', m, b FROM fd)"""
SWEPT = EVALUATED.replace(FOLDS, CONTINUOUS) + f""",
sz AS (SELECT c.fold, c.y, c.x, risk_target, greatest(least(CASE WHEN sd_change > 1e-12 THEN {CAPITAL}::DOUBLE * risk_target / (sd_change * sqrt(252.0::DOUBLE)) ELSE 1 END, {CAPITAL}::DOUBLE * 2 / greatest(p.py + abs(c.beta) * p.px, 1e-12)), 0) / 10.0::DOUBLE AS scale
 FROM cand c JOIN fd USING (fold) JOIN pp p ON p.y = c.y AND p.x = c.x AND p.t = fd.a - 1, (SELECT unnest({RISKS}::DOUBLE[]) AS risk_target)),
w0 AS (SELECT ev.*, round(val_sharpe * sqrt(least(1, val_trades / 5.0::DOUBLE)), 9) AS val_quality FROM ev),
w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY val_quality DESC, y, x) AS wp FROM w0 WHERE val_sharpe >= 0 AND val_trades >= 1 AND (val_cost_share IS NULL OR val_cost_share <= 0.3) AND val_quality > 0), (SELECT unnest({KS}) AS top_k) WHERE wp <= top_k),
w3 AS (SELECT fold, top_k, list({{'y': y, 'x': x, 'b': val_quality, 'n': test_trades}} ORDER BY val_quality DESC, y, x) AS ms FROM w1 GROUP BY ALL),
w4 AS (WITH RECURSIVE go(fold, top_k, ms, fixed, i) AS (SELECT fold, top_k, ms, 0::BIGINT, 0 FROM w3
 UNION ALL SELECT fold, top_k, ms, fixed + len(list_filter(ms[fixed + 1:], lambda m: (1 - fixed * 0.25::DOUBLE) * m.b >= (0.25::DOUBLE - 1e-15) * list_sum(list_transform(ms[fixed + 1:], lambda z: z.b)))), i + 1 FROM go WHERE i < 9) SELECT * FROM go WHERE i = 9),
w5 AS (SELECT fold, top_k, u.m.y AS y, u.m.x AS x, u.m.n AS n, CASE WHEN u.k <= fixed THEN greatest(least(0.25::DOUBLE, 1 - (u.k - 1) * 0.25::DOUBLE), 0) ELSE greatest(1 - fixed * 0.25::DOUBLE, 0) * u.m.b / list_sum(list_transform(ms[fixed + 1:], lambda z: z.b)) END AS weight
 FROM w4, LATERAL (SELECT unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS k) u),
me AS (SELECT w5.*, risk_target, scale FROM w5 JOIN sz USING (fold, y, x)),
pd AS (SELECT risk_target, top_k, te.fold, te.t, sum(te.r * scale * weight) AS r, sum(CASE WHEN executed <> 0 THEN weight ELSE 0 END) AS aw, count(*) FILTER (WHERE executed <> 0 AND weight > 0) AS ap FROM te JOIN me USING (fold, y, x) GROUP BY ALL),
swc AS (SELECT * FROM (SELECT DISTINCT risk_target FROM sz), (SELECT unnest({KS}) AS top_k)), td1 AS (SELECT swc.*, fold, unnest(range(m, b)) AS t FROM fd, swc), bw AS (SELECT risk_target, top_k, fold, sum(weight) AS bw FROM me GROUP BY ALL),
pj AS (SELECT risk_target, top_k, fold, t, date, coalesce(r, 0) AS r, coalesce(aw, 0) AS aw, coalesce(ap, 0) AS ap, coalesce(bw, 0) AS bw FROM td1 LEFT JOIN pd USING (risk_target, top_k, fold, t) LEFT JOIN bw USING (risk_target, top_k, fold) JOIN (SELECT DISTINCT t, date FROM panel) USING (t)),
pl AS (SELECT *, sum(ln(greatest(1 + r, 1e-12::DOUBLE))) OVER w AS lg, row_number() OVER w AS pos FROM pj WINDOW w AS (PARTITION BY risk_target, top_k ORDER BY t)), pt AS (SELECT *, max(lg) OVER (PARTITION BY risk_target, top_k ORDER BY t) AS top FROM pl),
pu AS (SELECT *, exp(lg) < exp(top) - 1e-12 AS under FROM pt), pm AS (SELECT *, CASE WHEN under THEN pos - coalesce(max(CASE WHEN NOT under THEN pos END) OVER (PARTITION BY risk_target, top_k ORDER BY t), 0) ELSE 0 END AS streak FROM pu),
sf AS (SELECT risk_target, top_k, count(*) AS folds, avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0 END) AS good FROM (SELECT risk_target, top_k, fold, CASE WHEN var_samp(r) > 1e-24 THEN avg(r) / stddev_samp(r) END AS s FROM pj GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {SWEPT} SELECT risk_target, top_k, any_value(sf.folds) AS folds, strftime(min(date), '%Y-%m-%d') AS oos_start, strftime(max(date), '%Y-%m-%d') AS oos_end, datediff('day', min(date), max(date))::INT AS oos_calendar_days, count(*) AS oos_rows, count(*) = (SELECT max(b) - min(m) FROM fd) AS oos_complete,
 {R('CASE WHEN var_samp(r) > 1e-24 THEN avg(r) / stddev_samp(r) * sqrt(252.0::DOUBLE) END')} AS sharpe, {R('CASE WHEN count(*) FILTER (WHERE r < 0) > 0 THEN avg(r) / sqrt(avg(r * r) FILTER (WHERE r < 0)) * sqrt(252.0::DOUBLE) END')} AS sortino, {R('exp(arg_max(lg, t)) - 1')} AS total_return,
 {R("exp(arg_max(lg, t) * 365.25::DOUBLE / datediff('day', min(date), max(date))) - 1")} AS cagr, {R('greatest(min(exp(lg - top) - 1), -1)')} AS max_drawdown, max(streak) AS max_drawdown_days, {R('stddev_samp(r) * sqrt(252.0::DOUBLE)')} AS annualized_vol, {R('avg(bw)')} AS avg_allocated_weight, {R('avg(aw)')} AS avg_active_weight,
 {R('avg(ap)')} AS avg_active_pairs, {R('any_value(sf.good)')} AS positive_fold_fraction, coalesce((SELECT sum(n) FROM me WHERE me.risk_target = pm.risk_target AND me.top_k = pm.top_k), 0)::BIGINT AS completed_trades FROM pm JOIN sf USING (risk_target, top_k) GROUP BY risk_target, top_k""")
def portfolio_sweep(spark, d):
    """Continuous folds, every risk target and number of pairs: one simulation, a report a cell."""
    panel = _clean(spark, d)
    table = folds.of_panel(panel, "continuous")
    chosen = _candidates(panel, table)
    money = cut(folded.simulated(_z(panel), table, chosen, pairs.grid(spark, (1.25, 1.5, 2.0), (0.25, 0.5)), CAPITAL))
    results = cut(folded.evaluated(money, LEAST, LEAST))
    sizes = folded.sized(_pairs(panel), table, chosen, RISKS, CAPITAL)
    daily, members = folded.swept(results, folded.held(money, results), chosen, sizes, table, KS, filters=(0.0, 1, 0.3, 5), reallocate=False)
    out = folded.portfolio_report(daily, members, table, panel, ["risk_target", "top_k"])
    out = out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("oos_start", "oos_end")})
    return r6(out, "sharpe", "sortino", "total_return", "cagr", "max_drawdown", "annualized_vol", "avg_allocated_weight", "avg_active_weight", "avg_active_pairs", "positive_fold_fraction")


# ---------------------------------------------------------------- tests of whole series

def pass_rates_sql(p: str, source: str, by: str, count: int, least: str, alpha: float, y: str = "ly", x: str = "lx") -> str:
    """CTE {p}rate (by, n_windows, pass_rate, mean_p): Engle-Granger over evenly placed windows of source's groups (n: rows of a group)."""
    p_of = eg_p_sql(f"(SELECT w.{by.replace(', ', ', w.')}, w.start, tau FROM (SELECT DISTINCT {by}, start FROM {p}w2) w LEFT JOIN {p}rtau USING ({by}, start))", "tau", "p")
    return f"""{p}w0 AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY t) - 1 AS i FROM {source}), {p}w1 AS (SELECT *, CAST(greatest({least}, n // {count}) AS INT) AS width FROM {p}w0),
{p}w2 AS (SELECT {p}w1.*, s.start FROM {p}w1 JOIN (SELECT DISTINCT {by}, CAST(floor(k * (n - width) / {count - 1}::DOUBLE) AS INT) AS start FROM {p}w1, range(0, {count}) r(k) WHERE width < n) s USING ({by}) WHERE i >= start AND i < start + width),
{residual_sql(f'{p}x', f'{p}w2', f'{by}, start', y, x)}, {unit_root_sql(f'{p}r', f'{p}xs', f'{by}, start')},
{p}rate AS (SELECT {by}, count(p) AS n_windows, avg(CASE WHEN p <= {alpha} THEN 1.0::DOUBLE WHEN p IS NOT NULL THEN 0 END) AS pass_rate, avg(p) AS mean_p FROM {p_of} GROUP BY {by})"""


_CS = ["eg_tau", "eg_p", "adf_tau", "adf_p", "kpss_stat", "kpss_p", "johansen_trace", "johansen_eigen", "johansen_trace_ratio", "johansen_hedge", "alpha", "beta"]
_CP = df_p_sql(f"(SELECT * FROM {eg_p_sql('c0', 'eg_tau', 'eg_p')})", "adf_tau", "adf_p")


@query(f"""WITH {PP}, {residual_sql('e', 'pp', 'y, x')}, {unit_root_sql('e', 'es', 'y, x')}, {unit_root_sql('d', 'es', 'y, x', True)}, {kpss_sql('e', 'es', 'y, x')}, {johansen_sql('e', 'pp', 'y, x')},
c0 AS (SELECT g.*, etau.tau AS eg_tau, etau.lag AS eg_lag, dtau.tau AS adf_tau, kpss AS kpss_stat, kpss_p, trace AS johansen_trace, eigen AS johansen_eigen, trace / 15.4943 AS johansen_trace_ratio, hedge AS johansen_hedge, trace > 15.4943 AND eigen > 14.2639 AS johansen_ok
 FROM (SELECT y, x, count(*)::INT AS n, any_value(a) AS alpha, any_value(b) AS beta FROM es GROUP BY y, x) g LEFT JOIN etau USING (y, x) LEFT JOIN dtau USING (y, x) LEFT JOIN ekpss USING (y, x) LEFT JOIN ejo USING (y, x))
SELECT y, x, n, eg_lag, johansen_ok, {rounded(_CS)} FROM {_CP}""")
def cointegration_screen(spark, d):
    """Every test of a pair's whole history."""
    return r6(screens.screen(_pairs(_clean(spark, d)), PAIR), *_CS).select(*PAIR, "n", "eg_lag", "johansen_ok", *_CS)


@query(f"WITH {PP}, {pass_rates_sql('p', 'pp', 'y, x', 4, '100', 0.05)} SELECT y, x, n_windows, {R('pass_rate')} AS pass_rate, {R('mean_p')} AS mean_p FROM prate")
def rolling_pass_rate(spark, d):
    return r6(screens.pass_rate(_pairs(_clean(spark, d)), 4), "pass_rate", "mean_p")


_SC = f"""WITH {PP}, {WIN}, {tradability_sql('scr', 1.5, 0.5)}, {johansen_sql('h', 'sw', 'screen, y, x')}, {kpss_sql('h', 'ts', 'screen, y, x')},
gm AS (SELECT tm.*, trace > 15.4943 AND eigen > 14.2639 AS johansen_ok, trace / 15.4943 AS johansen_trace_ratio, kpss_p AS kpss_pvalue FROM tm LEFT JOIN hjo USING (screen, y, x) LEFT JOIN hkpss USING (screen, y, x))"""


def _tested(panel):
    return tradability.tradability(_pairs(panel), _windows(panel)[1], 1.5, 0.5, 3, MIN_LIFE, MAX_LIFE, johansen=True, kpss=True)


@query(f"{_SC} SELECT screen, y, x, johansen_ok, {rounded(['eg_pvalue', 'johansen_trace_ratio', 'kpss_pvalue'])} FROM gm")
def screen_second_tests(spark, d):
    """Johansen and KPSS beside Engle-Granger for each screen."""
    return r6(_tested(_clean(spark, d)), "eg_pvalue", "johansen_trace_ratio", "kpss_pvalue").select("screen", *PAIR, "johansen_ok", "eg_pvalue", "johansen_trace_ratio", "kpss_pvalue")


@query(f"""{_SC}, pf AS (SELECT * FROM gm WHERE half_life BETWEEN {MIN_LIFE} AND {MAX_LIFE} AND eg_pvalue <= 0.6 AND johansen_ok AND kpss_pvalue > 0.05),
ps AS (SELECT *, round(-eg_tstat, 9) AS pool_score FROM pf), {capped_sql('p', 'ps', 'screen', 'pool_score', 12, 4)} SELECT screen, y, x, {R('pool_score')} AS pool_score, CAST(place AS INT) AS screen_rank FROM pk""")
def pool_gated(spark, d):
    """Pools whose pairs also pass the Johansen test and are not rejected as stationary."""
    out = selection.pool(_tested(_clean(spark, d)), ["screen"], 12, 4, MIN_LIFE, MAX_LIFE, max_p=0.6, gate_johansen=True, gate_kpss=True, score="tstat")
    return r6(out, "pool_score").select("screen", *PAIR, "pool_score", F.col("screen_rank").cast("int").alias("screen_rank"))


_GATE_P = df_p_sql("(SELECT c.*, a.tau AS adf_tau, pass_rate AS stability FROM gc c JOIN gtau a USING (fold, y, x) JOIN grate USING (fold, y, x))", "adf_tau", "spread_adf_p")
_WIDE = CANDIDATES.replace("p_bh <= 0.05", "p_bh <= 0.5").replace("first <= 20", "first <= 40")


@query(f"""WITH {PP}, {_WIDE}, gc AS (SELECT * EXCLUDE (place) FROM cand), gt AS (SELECT ct.* FROM ct SEMI JOIN gc ON gc.fold = ct.fold AND gc.y = ct.y AND gc.x = ct.x), gr AS (SELECT cs.* FROM cs SEMI JOIN gc ON gc.fold = cs.fold AND gc.y = cs.y AND gc.x = cs.x),
{unit_root_sql('g', 'gr', 'fold, y, x', True)}, {pass_rates_sql('g', 'gt', 'fold, y, x', 3, "50", 0.5, "py", "px")},
gg AS (SELECT * FROM {_GATE_P} WHERE stability >= 0.5)
SELECT fold, y, x, {rounded(['p', 'p_bh', 'half_life', 'stability', 'spread_adf_p'])}, CAST(row_number() OVER (PARTITION BY fold ORDER BY round(p_bh, 12), round(p, 12), round(half_life, 9), y, x) AS INT) AS place FROM gg""")
def fold_candidates_gated(spark, d):
    """Candidates of each fold that also pass in half of three windows: stage two tests the pairs of stage one alone."""
    panel = _clean(spark, d)
    out = tradability.candidates(folded.train_rows(_pairs(panel).select(*PAIR, "t", "py", "px"), _folds(panel)), ["fold"], significance=0.5, top_n=40, least=100, min_half_life=0.5, stability_windows=3, min_stability=0.5)
    return r6(out, "p", "p_bh", "half_life", "stability", "spread_adf_p").select("fold", *PAIR, "p", "p_bh", "half_life", "stability", "spread_adf_p", "place")


_DG = ["train_coint_p", "train_beta", "train_half_life", "train_stability", "train_spread_sd", "train_adf_p"]
_DP = df_p_sql(f"(SELECT * FROM {eg_p_sql('dg', 'eg_tau', 'train_coint_p')})", "adf_tau", "train_adf_p")


@query(f"""WITH {PP}, {FOLDS}, gv AS (SELECT DISTINCT y, x FROM pp WHERE y = 'Brand#11' OR x = 'Brand#55' OR y = 'Brand#22'), dsrc AS (SELECT p.*, fold FROM pp p JOIN fd ON t < a SEMI JOIN gv ON gv.y = p.y AND gv.x = p.x),
{residual_sql('d', 'dsrc', 'fold, y, x', 'py', 'px')}, {unit_root_sql('d', 'ds', 'fold, y, x')}, {unit_root_sql('f', 'ds', 'fold, y, x', True)}, {pass_rates_sql('d', 'dsrc', 'fold, y, x', 4, 'greatest(50, n // 5)', 0.05, 'py', 'px')},
dg AS (SELECT g.*, dtau.tau AS eg_tau, ftau.tau AS adf_tau, pass_rate AS train_stability FROM (SELECT fold, y, x, count(s) AS train_obs, any_value(b) AS train_beta, stddev_samp(s) AS train_spread_sd, CASE WHEN regr_slope(ds, s0) < 0 THEN -ln(2.0::DOUBLE) / regr_slope(ds, s0) END AS train_half_life FROM ds GROUP BY ALL) g
 LEFT JOIN dtau USING (fold, y, x) LEFT JOIN ftau USING (fold, y, x) LEFT JOIN drate USING (fold, y, x))
SELECT fold, y, x, train_obs, {rounded(_DG)} FROM {_DP}""")
def fold_diagnostics(spark, d):
    """What each fold's training rows say of a given watchlist, whether its pairs pass or not."""
    panel = _clean(spark, d)
    p = _pairs(panel)
    given = p.select(*PAIR).distinct().filter("y = 'Brand#11' OR x = 'Brand#55' OR y = 'Brand#22'")
    return r6(folded.diagnosed(p, _folds(panel), given), *_DG).select("fold", *PAIR, "train_obs", *_DG)


# ---------------------------------------------------------------- one-shot screen

_OS = [
    "train_return_corr", "hedge_ratio", "intercept", "train_eg_p", "train_eg_p_fdr", "train_adf_p", "train_half_life", "train_hurst", "train_spread_sd", "train_johansen_trace", "train_johansen_eigen", "johansen_hedge_ratio",
    "test_johansen_trace_ratio", "test_adf_p", "test_half_life", "test_hurst", "test_mean_shift_in_train_sd", "test_sd_ratio", "test_max_abs_z", "test_share_within_2sd", "test_crossings_per_year",
    "wf_adf_p", "wf_half_life", "wf_share_within_2sd", "wf_max_abs_z", "wf_crossings_per_year", "wf_beta_mean", "wf_beta_sd", "wf_beta_drift", "roll_share_cointegrated", "roll_mean_p", "rank_score",
]
_OF = ["train_johansen_ok", "test_johansen_ok", "cointegrated_train", "cointegrated_train_fdr", "stationary_test", "stationary_wf", "persisted", "persisted_fdr", "persisted_wf_fdr", "eg_and_johansen_train", "persisted_strict"]


def hurst_sql(p: str, source: str, s: str = "s") -> str:
    """CTE {p}hu (y, x, hurst) of the pairs' values s."""
    return f"""{p}h0 AS (SELECT y, x, {s} AS v, row_number() OVER (PARTITION BY y, x ORDER BY t) AS i, count(*) OVER (PARTITION BY y, x) AS n FROM {source}),
{p}h1 AS (SELECT a.y, a.x, k, stddev_pop(b.v - a.v) AS tau FROM {p}h0 a, range(2, 50) r(k) JOIN {p}h0 b ON b.y = a.y AND b.x = a.x AND b.i = a.i + k WHERE k < greatest(3, least(50, a.n // 4)) GROUP BY ALL),
{p}hu AS (SELECT y, x, regr_slope(ln(tau), ln(k::DOUBLE)) AS hurst FROM {p}h1 WHERE tau > 0 GROUP BY y, x)"""


def _crossings(now: str, before: str) -> str:
    return f"count(*) FILTER (WHERE {before} IS NOT NULL AND ({now} < 0) <> ({before} < 0)) * 252.0::DOUBLE / count(*)"


_O1 = df_p_sql(f"(SELECT * FROM {eg_p_sql('o0', 'eg_tau', 'train_eg_p')})", "adf_tau", "train_adf_p")
_O2 = df_p_sql(f"(SELECT * FROM {df_p_sql(f'(SELECT * FROM {_O1})', 'tau', 'test_adf_p')})", "wf_tau", "wf_adf_p")
_ORP = eg_p_sql("(SELECT y, x, screen, any_value(tau) AS tau FROM qs LEFT JOIN (SELECT y, x, screen, tau FROM qtau) USING (y, x, screen) GROUP BY y, x, screen)", "tau", "p")
ONESHOT = f"""{PP}, sz AS (SELECT (max(t) + 1)::INT AS n, floor((max(t) + 1) * 0.6::DOUBLE)::INT AS n_train FROM panel), otr AS (SELECT pp.* FROM pp, sz WHERE t < n_train), ote AS (SELECT pp.*, n_train FROM pp, sz WHERE t >= n_train),
{residual_sql('op', 'otr', 'y, x')}, {unit_root_sql('op', 'ops', 'y, x')}, {unit_root_sql('oa', 'ops', 'y, x', True)}, {johansen_sql('op', 'otr', 'y, x')}, {hurst_sql('op', 'ops')},
od AS (SELECT *, ly - lag(ly) OVER w AS dy, lx - lag(lx) OVER w AS dx FROM ops WINDOW w AS (PARTITION BY y, x ORDER BY t)),
ofi AS (SELECT y, x, corr(dy, dx) AS train_return_corr, any_value(b) AS hedge_ratio, any_value(a) AS intercept, stddev_samp(s) AS train_spread_sd, {life('regr_slope(ds, s0)')} AS train_half_life FROM od GROUP BY y, x HAVING corr(dy, dx) >= -1),
ob AS (SELECT k AS block, greatest(n_train + k * 63 - n_train, 0) AS lo, n_train + k * 63 AS hi FROM sz, range(0, 1000) r(k) WHERE n_train + k * 63 < n),
obf AS (SELECT y, x, block, regr_slope(ly, lx) AS wb, regr_intercept(ly, lx) AS wa, sqrt((regr_syy(ly, lx) - regr_sxy(ly, lx) ^ 2 / regr_sxx(ly, lx)) / (count(*) - 1)) AS wsd FROM pp JOIN ob ON t >= lo AND t < hi GROUP BY ALL),
ot0 AS (SELECT te.*, f.hedge_ratio, train_spread_sd AS sd, obf.block, wb, ly - intercept - hedge_ratio * lx AS s, (ly - wa - wb * lx) / wsd AS v FROM ote te JOIN ofi f USING (y, x) JOIN obf ON obf.y = te.y AND obf.x = te.x AND obf.block = (te.t - n_train) // 63),
ot AS (SELECT *, s / sd AS z, lag(s) OVER w AS s0, lag(v) OVER w AS v0, lag(s) OVER w / sd AS z0 FROM ot0 WINDOW w AS (PARTITION BY y, x ORDER BY t)),
obb AS (SELECT y, x, avg(wb) AS wf_beta_mean, stddev_pop(wb) AS wf_beta_sd, avg(wb) - any_value(hedge_ratio) AS wf_beta_drift, count(*) FILTER (WHERE sign(wb) <> sign(hedge_ratio)) AS wf_beta_sign_flips FROM obf JOIN ofi USING (y, x) GROUP BY y, x),
{unit_root_sql('ot', 'ot', 'y, x', True)}, {unit_root_sql('ow', 'ot', 'y, x', True, 'v')}, {johansen_sql('ot', 'ote', 'y, x')}, {hurst_sql('ot', 'ot')},
ott AS (SELECT y, x, count(*) AS test_rows, avg(s) / any_value(sd) AS test_mean_shift_in_train_sd, stddev_samp(s) / any_value(sd) AS test_sd_ratio, max(abs(z)) AS test_max_abs_z, avg(CASE WHEN abs(z) < 2 THEN 1.0::DOUBLE ELSE 0 END) AS test_share_within_2sd, {_crossings('z', 'z0')} AS test_crossings_per_year,
 max(abs(v)) AS wf_max_abs_z, avg(CASE WHEN abs(v) < 2 THEN 1.0::DOUBLE ELSE 0 END) AS wf_share_within_2sd, {_crossings('v', 'v0')} AS wf_crossings_per_year, {life('regr_slope(s - s0, s0)')} AS test_half_life, {life('regr_slope(v - v0, v0)')} AS wf_half_life FROM ot GROUP BY y, x),
o0 AS (SELECT ofi.*, ott.* EXCLUDE (y, x), obb.* EXCLUDE (y, x), optau.tau AS eg_tau, oatau.tau AS adf_tau, ottau.tau AS tau, owtau.tau AS wf_tau, ophu.hurst AS train_hurst, othu.hurst AS test_hurst, opjo.trace AS train_johansen_trace, opjo.eigen AS train_johansen_eigen, opjo.hedge AS johansen_hedge_ratio,
 coalesce(opjo.trace > 15.4943 AND opjo.eigen > 14.2639, false) AS train_johansen_ok, otjo.trace / 15.4943 AS test_johansen_trace_ratio, coalesce(otjo.trace > 15.4943 AND otjo.eigen > 14.2639, false) AS test_johansen_ok
 FROM ofi JOIN ott USING (y, x) JOIN obb USING (y, x) LEFT JOIN optau USING (y, x) LEFT JOIN oatau USING (y, x) LEFT JOIN ottau USING (y, x) LEFT JOIN owtau USING (y, x) LEFT JOIN ophu USING (y, x) LEFT JOIN othu USING (y, x) LEFT JOIN opjo USING (y, x) LEFT JOIN otjo USING (y, x)),
o2 AS (SELECT * FROM {_O2}),
ro AS (SELECT te.y, te.x, te.t, te.ly, te.lx, k AS screen FROM ote te JOIN o2 ON o2.y = te.y AND o2.x = te.x AND train_eg_p <= 0.5, range(0, 200) r(k), sz WHERE t - sz.n_train >= k * 21 AND t - sz.n_train < k * 21 + 126 AND k * 21 + 126 <= n - sz.n_train AND n - sz.n_train >= 147),
{residual_sql('q', 'ro', 'y, x, screen')}, {unit_root_sql('q', 'qs', 'y, x, screen')},
orl AS (SELECT y, x, count(p) AS roll_n_windows, avg(CASE WHEN p < 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS roll_share_cointegrated, avg(p) AS roll_mean_p FROM {_ORP} GROUP BY y, x),
o3 AS (SELECT *, coalesce(train_eg_p, 1) AS p1_, count(*) OVER () AS m_, row_number() OVER (ORDER BY coalesce(train_eg_p, 1), y, x) AS k_, 1 AS f FROM o2 LEFT JOIN orl USING (y, x)),
o4 AS (SELECT *, {bh('p1_', 'f', '')} AS train_eg_p_fdr FROM o3),
o5 AS (SELECT *, coalesce(train_eg_p < 0.05, false) AS cointegrated_train, coalesce(train_eg_p_fdr < 0.05, false) AS cointegrated_train_fdr, coalesce(test_adf_p < 0.05, false) AS stationary_test, coalesce(wf_adf_p < 0.05, false) AS stationary_wf,
 round(train_eg_p, 9) AS r1, round(test_adf_p, 9) AS r2, round(wf_adf_p, 9) AS r3, round(coalesce(roll_share_cointegrated, 0), 9) AS r4 FROM o4),
o6 AS (SELECT *, cointegrated_train AND stationary_test AS persisted, cointegrated_train_fdr AND stationary_test AS persisted_fdr, cointegrated_train_fdr AND stationary_wf AS persisted_wf_fdr, cointegrated_train_fdr AND train_johansen_ok AS eg_and_johansen_train,
 round({share('r1', 'f')} + {share('r2', 'f')} + {share('r3', 'f')} + 1 - {share('r4', 'f')}, 9) AS rank_score FROM o5),
o7 AS (SELECT *, persisted_fdr AND persisted_wf_fdr AND eg_and_johansen_train AS persisted_strict FROM o6)"""


@query(f"""WITH {ONESHOT} SELECT y, x, test_rows, wf_beta_sign_flips, roll_n_windows, {', '.join(_OF)}, {rounded(_OS)},
 CAST(row_number() OVER (ORDER BY persisted_strict DESC, persisted_fdr DESC, persisted DESC, rank_score ASC NULLS LAST, y, x) AS INT) AS place FROM o7""")
def oneshot_screen(spark, d):
    """Every pair's training statistics, whether they hold frozen, refitted and anew on the test rows, and its rank."""
    panel = _clean(spark, d)
    out = oneshot.screened(_pairs(panel), oneshot.split_at(panel), screen_p=0.5)
    return r6(out, *_OS).select(*PAIR, "test_rows", "wf_beta_sign_flips", "roll_n_windows", *_OF, *_OS, "place")


@query(f"""WITH {ONESHOT}, oc0 AS (SELECT y, x, 1 AS f, train_eg_p AS p, train_half_life, hedge_ratio, train_johansen_trace / 15.4943 AS ratio, round(train_eg_p, 9) AS p9, round(train_johansen_trace / 15.4943, 9) AS r9 FROM o7 WHERE train_half_life BETWEEN 0.15 AND 60),
oc AS (SELECT *, round({share('p9', 'f')} + {share('r9', 'f', True)}, 9) AS sel_score FROM oc0), od9 AS (SELECT *, -sel_score AS up FROM oc), {capped_sql('p', 'od9', 'f', 'up', 15, 4)}
SELECT y, x, {R('p')} AS p, {R('ratio')} AS johansen_ratio, {R('hedge_ratio')} AS hedge_ratio, {R('sel_score')} AS sel_score, CAST(place AS INT) AS place FROM pk""")
def oneshot_candidates(spark, d):
    """The best pairs of the one-shot screen by training p and trace ratio, at most four of a ticker."""
    return r6(_picked(_clean(spark, d)), "p", "johansen_ratio", "hedge_ratio", "sel_score").select(*PAIR, "p", "johansen_ratio", "hedge_ratio", "sel_score", F.col("place").cast("int").alias("place"))


def _picked(panel):
    rows = _pairs(panel).select(*PAIR, "t", "ly", "lx").crossJoin(F.broadcast(oneshot.split_at(panel).select("n_train"))).filter("t < n_train")  # one row
    fits = oneshot.trained(rows.drop("n_train"), with_hurst=False).select(*PAIR, F.lit(1).alias("f"), "hedge_ratio", F.col("train_half_life").alias("half_life"), F.round("train_eg_p", 9).alias("p"), F.round("train_johansen_trace_ratio", 9).alias("johansen_ratio"))
    return selection.picked_candidates(fits, ["f"], 15, 4, 0.15, 60.0)


@query(f"""WITH {PP}, sz AS (SELECT floor((max(t) + 1) * 0.6::DOUBLE)::INT AS n_train FROM panel), a AS (SELECT y, x, regr_slope(ly, lx) AS hedge_ratio FROM pp, sz WHERE t < n_train GROUP BY y, x), b AS (SELECT y, x, regr_slope(ly, lx) AS fitted FROM pp GROUP BY y, x)
SELECT y, x, {R('hedge_ratio')} AS hedge_ratio, {R('fitted')} AS fitted FROM a JOIN b USING (y, x) WHERE abs(hedge_ratio - fitted) > 0.05""")
def hedge_drift(spark, d):
    """Pairs whose training hedge ratio is not the one of the whole history: a pool made on another split shows here."""
    panel = _clean(spark, d)
    rows = _pairs(panel).select(*PAIR, "t", "ly", "lx")
    train = rows.crossJoin(F.broadcast(oneshot.split_at(panel).select("n_train"))).filter("t < n_train")  # one row
    fits = train.groupBy(*PAIR).agg(F.regr_slope("ly", "lx").alias("hedge_ratio"))
    return r6(selection.drifted(fits, rows, 0.05), "hedge_ratio", "fitted")
