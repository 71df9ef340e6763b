"""Unit-root and stationarity tests of many series at once, as column expressions over one array per series.

A series is the array of one group's values (a pair's residuals in a window), so its size
is the window's.  The lagged regressions of all orders come from one set of cross
products: the products of the leading row are summed over the rows that all orders have
in common, every further row of the matrix follows from the one above it by adding the
element that enters and taking off the one that leaves.  Eliminating the lagged changes one
by one leaves, after each, the level's and the target's products given the lags so far:
the sum of squares (and so the criterion) and the t value of every order.

Nothing leaves the JVM, and the tests join the aggregation that made the array.  The formulas are SQL
text, which Spark parses at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.native import unit_root_p

# KPSS level critical values (Kwiatkowski et al. 1992).
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
# Johansen 95 % values for two series with a constant (MacKinnon, Haug and Michelis 1999): trace and largest eigenvalue.
JOHANSEN_TRACE, JOHANSEN_EIGEN = 15.4943, 14.2639


def span(first: str, last: str) -> str:
    """Whole numbers from first to last; empty if last is smaller."""
    return f"if(({last}) >= ({first}), sequence(cast({first} as int), cast({last} as int)), cast(array() as array<int>))"


def dot(a: str, b: str, first: str, last: str, back: str) -> str:
    """Sum of a[t] * b[t - back] for t from first to last."""
    return f"aggregate({span(first, last)}, 0D, (s, t) -> s + {a}[t] * {b}[t - ({back})])"


def most_lags(n: str, constant: bool) -> str:
    """Schwert's bound on the lags of n values, as far as the rows suffice."""
    return f"cast(greatest(least(ceil(12 * pow({n} / 100D, 0.25D)), {n} div 2 - 1 - {int(constant)}), 0) as int)"


def with_expressions(df: DataFrame, **columns: str) -> DataFrame:
    """df with columns given as SQL text: parsed in one go, where column objects would take a call for each node."""
    return df.withColumns({k: F.expr(v) for k, v in columns.items()})


_CORNER = "named_struct('v', {x}[size({x}) - 2][size({x}) - 2], 'c', {x}[size({x}) - 2][size({x}) - 1], 'r', {x}[size({x}) - 1][size({x}) - 1])"


def _corners(df: DataFrame, s: str, lags: str, constant: bool, out: str) -> DataFrame:
    """df with column out: for 0, 1, ... lags the products (v, c, r) of level, level and change, and change, given the lagged changes.

    s: array of values; lags: the largest order, whose rows all orders use.  Adds and drops working columns named _u_*.
    """
    df = with_expressions(df, _u_d=f"transform({span('1', f'size({s}) - 1')}, i -> {s}[i] - {s}[i - 1])")
    last = "size(_u_d) - 1"
    df = with_expressions(
        df,
        _u_top=f"transform({span('0', lags)}, k -> {dot('_u_d', '_u_d', lags, last, 'k')})",
        _u_mixed=f"transform({span('0', lags)}, k -> {dot(s, '_u_d', lags, last, 'k')})",
        _u_square=dot(s, s, lags, last, "0"),
    )
    # a row follows from the one above it: one element enters, one leaves
    moved = f"element_at(rows, -1)[j - 1] + _u_d[{lags} - i] * _u_d[{lags} - j] - _u_d[size(_u_d) - i] * _u_d[size(_u_d) - j]"
    df = with_expressions(df, _u_gram=f"aggregate({span('1', lags)}, array(_u_top), (rows, i) -> concat(rows, array(concat(array(_u_top[i]), transform({span('1', lags)}, j -> {moved})))))")
    df = with_expressions(
        df,
        _u_matrix=f"concat(transform({span('1', lags)}, i -> concat(slice(_u_gram[i], 2, {lags}), array(_u_mixed[i], _u_top[i]))), "
        f"array(concat(slice(_u_mixed, 2, {lags}), array(_u_square, _u_mixed[0])), concat(slice(_u_top, 2, {lags}), array(_u_mixed[0], _u_top[0]))))",
    )
    if constant:  # products around means: the regression has a constant
        df = with_expressions(
            df, _u_sums=f"concat(transform({span('1', lags)}, i -> {s}[size(_u_d) - i] - {s}[{lags} - i]), array(aggregate({span(lags, last)}, 0D, (a, t) -> a + {s}[t]), {s}[size(_u_d)] - {s}[{lags}]))"
        )
        df = with_expressions(df, _u_matrix=f"transform(_u_matrix, (row, i) -> transform(row, (v, j) -> v - _u_sums[i] * _u_sums[j] / (size(_u_d) - {lags})))")
    left = "transform(slice(a.m, 2, size(a.m) - 1), row -> transform(slice(row, 2, size(row) - 1), (v, j) -> v - row[0] * a.m[0][j + 1] / nullif(a.m[0][0], 0D)))"
    corner = _CORNER.format(x="a.m")
    found = (
        f"aggregate({span('1', lags)}, named_struct('m', _u_matrix, 'out', slice(array({_CORNER.format(x='_u_matrix')}), 1, 0)), "
        f"(a, i) -> named_struct('m', {left}, 'out', concat(a.out, array({corner}))), a -> concat(a.out, array({corner})))"
    )
    return with_expressions(df, **{out: found}).drop("_u_d", "_u_top", "_u_mixed", "_u_square", "_u_gram", "_u_matrix", "_u_sums")


def _residual(x: str) -> str:
    return f"greatest({x}.r - {x}.c * {x}.c / nullif({x}.v, 0D), 1e-300D)"


def dickey_fuller(df: DataFrame, s: str, tau: str, constant: bool = False, rule: str | None = "aic", max_lag: int | None = None) -> DataFrame:
    """df with columns tau (t value of the level) and tau_lag, for the array column s.

    The lag is the one with the least AIC or BIC (rule) over the rows that all lags have, the smaller one of equals; the
    statistic then uses all rows that lag leaves.  Without a rule it is max_lag, or else the bound.  Null where a value is
    missing, a regression has no rest of rows or the series does not vary.
    """
    c, lag = int(constant), f"{tau}_lag"
    room = f"greatest(size({s}) div 2 - 1 - {c}, 0)"
    most = most_lags(f"size({s})", constant) if max_lag is None else f"cast(least({max_lag}, {room}) as int)"
    df = with_expressions(df, _u_ok=f"size({s}) > {3 + c} AND NOT exists({s}, v -> v IS NULL OR isnan(v))")
    df = with_expressions(df, _u_s=f"if(_u_ok, {s}, array(0D, 0D, 0D, 0D, 0D))", _u_most=f"if(_u_ok, {most}, 0)").withColumn("_u_n", F.size("_u_s") - 1)
    if rule is None:
        df = df.withColumn("_u_used", F.col("_u_most"))
    else:
        df = _corners(df, "_u_s", "_u_most", constant, "_u_all")
        rows = "(_u_n - _u_most)"
        price = "2D" if rule == "aic" else f"ln({rows})"
        score = f"coalesce({rows} * ln({_residual('x')} / {rows}) + {price} * (k + {1 + c}), double('inf'))"
        df = with_expressions(df, _u_used=f"array_min(transform(_u_all, (x, k) -> named_struct('score', {score}, 'k', k))).k").drop("_u_all")
    df = _corners(df, "_u_s", "_u_used", constant, "_u_one")
    df = with_expressions(df, _u_x="element_at(_u_one, -1)", _u_free=f"_u_n - 2 * _u_used - {1 + c}")
    df = with_expressions(df, _u_tau=f"CASE WHEN _u_ok AND _u_free > 0 THEN _u_x.c / sqrt(greatest({_residual('_u_x')} / _u_free, 1e-300D) * nullif(_u_x.v, 0D)) END")
    return _settled(df, {tau: F.col("_u_tau"), lag: F.when(F.col("_u_tau").isNotNull(), F.col("_u_used"))}).drop("_u_ok", "_u_s", "_u_most", "_u_n", "_u_used", "_u_one", "_u_x", "_u_free", "_u_tau")


def _settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns as the one row of a generator: a later filter on them stays above it, instead of repeating all they are computed from."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def kpss(df: DataFrame, s: str, out: str) -> DataFrame:
    """df with columns out (level stationarity), out_lags (bandwidth by Hobijn et al. 1998) and out_p (clipped to the table)."""
    df = with_expressions(df, _k_ok=f"size({s}) > 1 AND NOT exists({s}, v -> v IS NULL OR isnan(v))")
    df = with_expressions(df, _k_s=f"if(_k_ok, {s}, array(0D, 0D))")
    df = with_expressions(df, _k_mean="aggregate(_k_s, 0D, (a, v) -> a + v) / size(_k_s)", _k_n="size(_k_s)")
    df = with_expressions(df, _k_e="transform(_k_s, v -> v - _k_mean)")
    cov = lambda k: f"{dot('_k_e', '_k_e', k, '_k_n - 1', k)} / _k_n"
    df = with_expressions(df, _k_c=f"transform({span('0', 'floor(pow(_k_n, 2D / 9))')}, k -> {cov('k')})")
    df = with_expressions(df, _k_0="2 * aggregate(_k_c, 0D, (a, v) -> a + v) - _k_c[0]", _k_1="2 * aggregate(transform(_k_c, (v, k) -> v * k), 0D, (a, v) -> a + v)")
    df = with_expressions(df, _k_lags="cast(least(floor(1.1447D * pow(pow(_k_1 / nullif(_k_0, 0D), 2D), 1D / 3) * pow(_k_n, 1D / 3)), _k_n - 1) as int)")
    df = with_expressions(df, _k_v=f"_k_c[0] + aggregate({span('1', '_k_lags')}, 0D, (a, k) -> a + 2 * (1 - k / (_k_lags + 1D)) * {cov('k')})")
    walk = "aggregate(_k_e, named_struct('sum', 0D, 'squares', 0D), (a, v) -> named_struct('sum', a.sum + v, 'squares', a.squares + (a.sum + v) * (a.sum + v)), a -> a.squares)"
    df = with_expressions(df, _k_stat=f"CASE WHEN _k_ok THEN {walk} / (cast(_k_n as double) * _k_n * nullif(_k_v, 0D)) END")
    steps = " ".join(f"WHEN _k_stat < {x1}D THEN {p0}D + (_k_stat - {x0}D) * {(p1 - p0) / (x1 - x0)!r}D" for (x0, p0), (x1, p1) in zip(KPSS_TABLE, KPSS_TABLE[1:], strict=False))
    df = with_expressions(df, _k_p=f"CASE WHEN _k_stat <= {KPSS_TABLE[0][0]}D THEN {KPSS_TABLE[0][1]}D {steps} WHEN _k_stat IS NOT NULL THEN {KPSS_TABLE[-1][1]}D END")
    found = {out: F.col("_k_stat"), out + "_lags": F.when(F.col("_k_stat").isNotNull(), F.col("_k_lags")), out + "_p": F.col("_k_p")}
    return _settled(df, found).drop("_k_ok", "_k_s", "_k_mean", "_k_n", "_k_e", "_k_c", "_k_0", "_k_1", "_k_lags", "_k_v", "_k_stat", "_k_p")


#: The six series whose covariances the Johansen test needs: changes, earlier changes, levels before them.
JOHANSEN_SERIES = ("_j_dy", "_j_dx", "_j_py", "_j_px", "_j_ly", "_j_lx")


def johansen_series(rows: DataFrame, by, y: str, x: str) -> DataFrame:
    """rows with the six series of JOHANSEN_SERIES, null in the first two rows of a group; by: the window of a group in its order."""
    rows = rows.withColumns({"_j_y1": F.lag(y).over(by), "_j_y2": F.lag(y, 2).over(by), "_j_x1": F.lag(x).over(by), "_j_x2": F.lag(x, 2).over(by)})
    whole = F.col("_j_y2").isNotNull() & F.col("_j_x2").isNotNull()
    series = (F.col(y) - F.col("_j_y1"), F.col(x) - F.col("_j_x1"), F.col("_j_y1") - F.col("_j_y2"), F.col("_j_x1") - F.col("_j_x2"), F.col("_j_y1"), F.col("_j_x1"))
    return rows.withColumns({c: F.when(whole, v) for c, v in zip(JOHANSEN_SERIES, series, strict=True)}).drop("_j_y1", "_j_y2", "_j_x1", "_j_x2")


def johansen_moments() -> list[Column]:
    """Aggregates of a group: the covariances of the six series (columns _j_ij) and the number of rows (_j_n)."""
    names = JOHANSEN_SERIES
    return [*(F.expr(f"covar_pop({names[i]}, {names[j]}) AS _j_{i}{j}") for i in range(6) for j in range(i, 6)), F.count(names[0]).alias("_j_n")]


def johansen(df: DataFrame, out: str = "johansen") -> DataFrame:
    """df with out_trace, out_eigen (statistics), out_trace_ratio (to the 95 % value), out_hedge and out_ok (both above 95 %).

    Constant and one lagged difference.  The 2 x 2 eigenvalues are in closed form; null where a covariance has no inverse.
    """
    c = lambda i, j: f"_j_{min(i, j)}{max(i, j)}"
    df = with_expressions(df, _j_det=f"nullif({c(2, 2)} * {c(3, 3)} - {c(2, 3)} * {c(2, 3)}, 0D)")
    p = lambda i, j: f"_j_p{min(i, j)}{max(i, j)}"  # noqa: E731  covariance of i and j given the earlier changes
    some = (0, 1, 4, 5)
    first = lambda i: f"({c(i, 2)} * {c(3, 3)} - {c(i, 3)} * {c(2, 3)}) / _j_det"
    second = lambda i: f"({c(i, 3)} * {c(2, 2)} - {c(i, 2)} * {c(2, 3)}) / _j_det"
    df = with_expressions(df, **{p(i, j): f"{c(i, j)} - {first(i)} * {c(j, 2)} - {second(i)} * {c(j, 3)}" for i in some for j in some if i <= j})
    df = with_expressions(df, _j_d0=f"nullif({p(0, 0)} * {p(1, 1)} - {p(0, 1)} * {p(0, 1)}, 0D)", _j_dk=f"nullif({p(4, 4)} * {p(5, 5)} - {p(4, 5)} * {p(4, 5)}, 0D)")
    # b: the levels' covariances with the changes times the inverse of the changes' (rows: levels); q: b times the changes' with the levels
    df = with_expressions(df, **{f"_j_b{k}{i}": f"({p(k, i)} * {p(1 - i, 1 - i)} - {p(k, 1 - i)} * {p(0, 1)}) / _j_d0" for k in (4, 5) for i in (0, 1)})
    df = with_expressions(df, **{f"_j_q{k}{m}": f"_j_b{k}0 * {p(0, m)} + _j_b{k}1 * {p(1, m)}" for k in (4, 5) for m in (4, 5)})
    df = with_expressions(df, **{f"_j_a{k}{m}": f"({p(9 - k, 9 - k)} * _j_q{k}{m} - {p(4, 5)} * _j_q{9 - k}{m}) / _j_dk" for k in (4, 5) for m in (4, 5)})
    root = "sqrt(greatest(pow((_j_a44 + _j_a55) / 2, 2D) - (_j_a44 * _j_a55 - _j_a45 * _j_a54), 0D))"
    df = with_expressions(df, _j_v=f"(_j_a44 + _j_a55) / 2 + {root}", _j_u=f"(_j_a44 + _j_a55) / 2 - {root}")
    held = lambda v: f"log1p(-least(greatest({v}, 0D), 1 - 1e-12D))"
    # the eigenvector from the row of A - v I with the larger off-diagonal element
    hedge = "CASE WHEN abs(_j_a45) >= abs(_j_a54) THEN -(_j_v - _j_a44) / nullif(_j_a45, 0D) ELSE -_j_a54 / nullif(_j_v - _j_a55, 0D) END"
    df = with_expressions(df, _j_eigen=f"-_j_n * {held('_j_v')}", _j_trace=f"-_j_n * ({held('_j_v')} + {held('_j_u')})", _j_hedge=hedge)
    trace, eigen = F.col("_j_trace"), F.col("_j_eigen")
    df = _settled(df, {out + "_trace": trace, out + "_eigen": eigen, out + "_hedge": F.col("_j_hedge"), out + "_trace_ratio": trace / JOHANSEN_TRACE, out + "_ok": (trace > JOHANSEN_TRACE) & (eigen > JOHANSEN_EIGEN)})
    return df.drop(*[x for x in df.columns if x.startswith("_j_")])


def residuals(rows: DataFrame, by: list[str], y: str = "ly", x: str = "lx") -> DataFrame:
    """alpha, beta and residual s of y on x and a constant within each group, as windows."""
    every = Window.partitionBy(*by)
    rows = rows.withColumn("beta", F.covar_pop(y, x).over(every) / F.nullif(F.var_pop(x).over(every), F.lit(0.0)))
    rows = rows.withColumn("alpha", F.avg(y).over(every) - F.col("beta") * F.avg(x).over(every))
    return rows.withColumn("s", F.col(y) - F.col("beta") * F.col(x) - F.col("alpha"))


def series_of(order: str, value: str) -> Column:
    """Aggregate: a group's values in order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def adf_p(tau: Column) -> Column:
    """p of a Dickey-Fuller statistic with a constant (one series)."""
    return unit_root_p(tau, 1)

