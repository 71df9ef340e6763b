"""Trading machines.

Only what is truly sequential, the position, runs row by row: a fold over one pair's
rows in a grouped map.  Money (profit, costs, trades) then follows from lags and runs,
as window functions over all pairs at once, so parameter grids and periods are further
grouping keys of the same job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tasks import spread


def fold(rows: DataFrame, by: list[str], machine, columns: list[str], out: dict[str, str], order: tuple[str, ...] = ("t",)) -> DataFrame:
    """rows plus the columns that machine(arrays of columns) returns for each group in order of t (or other columns)."""
    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    extra = ", ".join(f"{c} {t}" for c, t in out.items())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + extra

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        found = machine(*[table[c].to_numpy() for c in columns])
        for (name, kind), values in zip(out.items(), found, strict=True):
            table = table.append_column(name, pa.array(values, kinds[kind], from_pandas=True))
        return table

    return spread(rows, by).groupBy(*by).applyInArrow(run, schema)


def latch(z: np.ndarray, entry: float, leave: float, stop: float) -> list[int]:
    """Enter beyond +-entry against the deviation; leave inside `leave` or beyond `stop`.  A missing z keeps the position."""
    out, held = [], 0
    for v in z.tolist():
        if v == v:
            if held == 0:
                held = -1 if v > entry else 1 if v < -entry else 0
            elif abs(v) < leave or abs(v) > stop:
                held = 0
        out.append(held)
    return out


def rearmed(z: np.ndarray, entry: float, leave: float, stop: float, cooldown: int, reentry: float) -> tuple[list[int], list[bool]]:
    """As latch, but a stop disarms until `cooldown` rows have passed and |z| is back within `reentry`."""
    held, wait, out, stopped = 0, None, [], []
    for v in z.tolist():
        hit = False
        if wait is not None:
            wait = max(wait - 1, 0)
            if v == v and wait == 0 and abs(v) <= reentry:
                wait = None  # armed again from the next row on
        elif v == v:
            if held == 0:
                held = -1 if v > entry else 1 if v < -entry else 0
            elif abs(v) < leave:
                held = 0
            elif abs(v) > stop:
                held, wait, hit = 0, max(int(cooldown), 0), True
        out.append(held)
        stopped.append(hit)
    return out, stopped


def to_zero(z: np.ndarray, entry: float, stop: float, lock: bool, max_hold: int = 0) -> tuple[list[int], list[str]]:
    """Target positions that leave when z crosses zero, on a stop, or after max_hold rows from execution.

    lock: a z beyond `stop` bars entries until |z| is under `entry`.  Orders fill a row later, so decisions
    look at what is held after the previous row's order; reasons name the exits.
    """
    target, held, since, locked, out, why = 0, 0, 0, False, [], []
    n = len(z)
    for i, v in enumerate(z.tolist()):
        if held != target:
            held, since = target, i
        reason = ""
        if v == v:
            if locked and abs(v) < entry:
                locked = False
            if held == 0:
                if lock and abs(v) > stop:
                    locked = True
                elif not locked and abs(v) > entry:
                    target = -1 if v > 0 else 1
            elif held * v >= 0:
                target, reason = 0, "zero-cross"
            elif abs(v) > stop:
                target, reason, locked = 0, "stop", lock
            elif max_hold and i - since >= max_hold:
                target, reason = 0, "time-stop"
        if i == n - 1:
            target = held if target != held else target
            reason = "" if target == held and held != 0 else reason
        out.append(target)
        why.append(reason)
    return out, why


def screener_positions(rows: DataFrame, by: list[str], entry: float = 2.0, leave: float = 0.5, stop: float = 4.0) -> DataFrame:
    return fold(rows, by, lambda z: (latch(z, entry, leave, stop),), ["z"], {"position": "int"})


def engine_positions(rows: DataFrame, by: list[str], entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, cooldown: int = 5, reentry: float = 1.0) -> DataFrame:
    if leave >= entry:
        raise ValueError("leave must be below entry")
    return fold(rows, by, lambda z: rearmed(z, entry, leave, stop, cooldown, reentry), ["z"], {"target": "int", "stop_event": "boolean"})


def grid_positions(rows: DataFrame, by: list[str]) -> DataFrame:
    """engine positions for cells of a grid (columns entry and exit): a group has all its cells, one after the other, as a call for each costs more than its rows."""
    def machine(z, entry, leave):
        edges = [0, *(np.flatnonzero((np.diff(entry) != 0) | (np.diff(leave) != 0)) + 1).tolist(), len(z)]
        return ([v for a, b in zip(edges, edges[1:], strict=False) for v in rearmed(z[a:b], entry[a], leave[a], 4.0, 5, 1.0)[0]],)

    return fold(rows, by, machine, ["z", "entry", "exit"], {"target": "int"}, ("entry", "exit", "t"))


def frozen_positions(rows: DataFrame, by: list[str], entry: float = 2.0, stop: float = 4.0, max_hold: int = 60) -> DataFrame:
    return fold(rows, by, lambda z: to_zero(z, entry, stop, True, max_hold), ["z"], {"target": "int", "why": "string"})


def oos_positions(rows: DataFrame, by: list[str], entry: float = 3.0, stop: float = 4.0) -> DataFrame:
    return fold(rows, by, lambda z: to_zero(z, entry, stop, False), ["z"], {"target": "int", "why": "string"})


def screener_pnl(rows: DataFrame, by: list[str]) -> DataFrame:
    """pnl of a row: yesterday's position on today's spread change over gross exposure; run numbers its trades."""
    w = Window.partitionBy(*by).orderBy("t")
    rows = rows.withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0)))
    rows = rows.withColumn("pnl", F.col("held") * F.coalesce("ds", F.lit(0.0)) / (1 + F.abs("beta")))
    return with_runs(rows, by, "held")


def with_runs(rows: DataFrame, by: list[str], held: str) -> DataFrame:
    """run: a number per stretch of rows with a position."""
    w = Window.partitionBy(*by).orderBy("t")
    start = F.when((F.col(held) != 0) & (F.coalesce(F.lag(held).over(w), F.lit(0)) == 0), 1).otherwise(0)
    return rows.withColumn("run", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def engine_pnl(rows: DataFrame, by: list[str], units: str = "units", cost_bps: float = 6.0, borrow_bps: float = 0.0, financing_bps: float = 0.0) -> DataFrame:
    """Daily money of fixed spread units with a daily hedge: executed a row after the signal, profit to the next row, costs on turnover."""
    w = Window.partitionBy(*by).orderBy("t")
    rows = rows.withColumn("executed", F.coalesce(F.lag("target").over(w), F.lit(0)))
    rows = rows.withColumn("hedge", F.coalesce(F.lag("beta").over(w), F.col("beta"), F.lit(0.0)))
    rows = rows.withColumn("leg_a", F.col("executed") * F.col(units)).withColumn("leg_b", -F.col("executed") * F.col("hedge") * F.col(units))
    gain = F.col("leg_a") * (F.lead("py").over(w) - F.col("py")) + F.col("leg_b") * (F.lead("px").over(w) - F.col("px"))
    moved = F.abs(F.col("leg_a") - F.coalesce(F.lag("leg_a").over(w), F.lit(0.0))) * F.col("py") + F.abs(F.col("leg_b") - F.coalesce(F.lag("leg_b").over(w), F.lit(0.0))) * F.col("px")
    gross = F.abs("leg_a") * F.col("py") + F.abs("leg_b") * F.col("px")
    short = F.greatest(-F.col("leg_a"), F.lit(0.0)) * F.col("py") + F.greatest(-F.col("leg_b"), F.lit(0.0)) * F.col("px")
    rows = rows.withColumn("gross", F.coalesce(gain, F.lit(0.0))).withColumn("cost", moved * (cost_bps / 1e4))
    rows = rows.withColumn("carry", gross * (financing_bps / 1e4 / 252) + short * (borrow_bps / 1e4 / 252))
    return rows.withColumn("net", F.col("gross") - F.col("cost") - F.col("carry"))


def trade_log(rows: DataFrame, by: list[str], held: str = "executed") -> DataFrame:
    """One row per stretch of rows with a position (money of the rows in it; the closing row's cost is not in it)."""
    rows = with_runs(rows, by, held).filter(F.col(held) != 0)
    w = Window.partitionBy(*by)
    rows = rows.withColumn("_last", F.max("t").over(w))
    return rows.groupBy(*by, "run").agg(
        F.min("t").alias("entry_t"), F.max("t").alias("last_t"), F.first(F.signum(held)).cast("int").alias("side"), F.count(F.lit(1)).alias("days_held"),
        F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("net").alias("net"), (F.max("t") == F.max("_last")).alias("open_at_end"),
    )


def sleeve_pnl(rows: DataFrame, by: list[str], sleeve: float, cost_bps: float = 5.0, log_beta: bool = True, borrow_bps: float = 0.0) -> DataFrame:
    """Money of orders filled a row after their signal, sized once at the fill: columns held, run, leg_a, leg_b, gross, cost, net.

    log_beta: dollars split 1 : |beta| (hedge in logs); else units 1 : beta (hedge in prices).
    """
    w = Window.partitionBy(*by).orderBy("t")
    rows = rows.withColumn("held", F.coalesce(F.lag("target").over(w), F.lit(0))).withColumn("_b", F.lag("beta").over(w))
    rows = rows.withColumn("_was", F.coalesce(F.lag("held").over(w), F.lit(0)))
    fills = (F.col("held") != 0) & (F.col("held") != F.col("_was"))
    if log_beta:
        dollars = F.lit(sleeve) / (1 + F.abs("_b"))
        units_a, units_b = F.col("held") * dollars / F.col("py"), -F.col("held") * F.col("_b") * dollars / F.col("px")
    else:
        one = F.lit(sleeve) / (F.col("py") + F.abs("_b") * F.col("px"))
        units_a, units_b = F.col("held") * one, -F.col("held") * F.col("_b") * one
    rows = rows.withColumn("run", F.sum(F.when(fills, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at_fill = Window.partitionBy(*by, "run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    for name, value in (("leg_a", units_a), ("leg_b", units_b)):
        rows = rows.withColumn(name, F.when(F.col("held") != 0, F.first(F.when(fills, value), ignorenulls=True).over(at_fill)).otherwise(0.0))
    la, lb = F.coalesce(F.lag("leg_a").over(w), F.lit(0.0)), F.coalesce(F.lag("leg_b").over(w), F.lit(0.0))
    ya, xa = F.lag("py").over(w), F.lag("px").over(w)
    rows = rows.withColumn("gross", F.coalesce(la * (F.col("py") - ya) + lb * (F.col("px") - xa), F.lit(0.0)))
    turn = F.abs(F.col("leg_a") - la) * F.col("py") + F.abs(F.col("leg_b") - lb) * F.col("px")
    rows = rows.withColumn("cost", F.when(F.col("held") != F.col("_was"), turn * (cost_bps / 1e4)).otherwise(0.0))
    short = F.greatest(-la, F.lit(0.0)) * ya + F.greatest(-lb, F.lit(0.0)) * xa
    rows = rows.withColumn("borrow", F.coalesce(short * (borrow_bps / 1e4 / 252), F.lit(0.0)))
    return rows.withColumn("net", F.col("gross") - F.col("cost") - F.col("borrow")).drop("_b", "_was")


def bounded_orders(z: np.ndarray, entry: float, leave: float, stop: float, max_hold: int) -> tuple[list[int], list[str]]:
    """Orders of the full-cost machine, filled on the next row: entries only while entry < |z| < stop and more than
    three rows remain; exits by stop, target or holding time; the last row closes at once."""
    n, held, order, since = len(z), 0, None, 0
    side, why = [], []
    for i, v in enumerate(z.tolist()):
        if order is not None:
            held, since, order = order, 0, None
        if held:
            since += 1
        reason = ""
        if i == n - 1:
            reason = "end_of_window" if held else ""
        elif v == v:
            a = abs(v)
            if held == 0:
                if i < n - 3 and entry < a < stop:
                    order = -1 if v > 0 else 1
            elif a > stop or a < leave or since >= max_hold:
                order, reason = 0, "stop" if a > stop else "target" if a < leave else "time"
        side.append(held)
        why.append(reason)
    return side, why


def full_cost_trades(rows: DataFrame, by: list[str], capital: float = 100_000.0, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, max_hold: int = 60,
                     comm_share: float = 0.0035, min_comm: float = 0.35, half_spread_bps: float = 2.0, impact: float = 1.0, sell_fee_bps: float = 0.3,
                     borrow_bps: float = 50.0, financing_bps: float = 0.0) -> DataFrame:
    """Daily money with whole shares filled at the next row's price: commission, spread, impact by volume share, sell fees, carry by calendar days.

    rows carry py, px, z, beta and per leg adv_y, sig_y, adv_x, sig_x.  Position before the row's fill, shares and costs
    come from lags; a held run's shares are fixed at its fill (half-even rounding).
    """
    out = fold(rows, by, lambda z: bounded_orders(z, entry, leave, stop, max_hold), ["z"], {"held": "int", "why": "string"})
    w = Window.partitionBy(*by).orderBy("t")
    out = out.withColumn("was", F.coalesce(F.lag("held").over(w), F.lit(0))).withColumn("_b", F.lag("beta").over(w))
    out = out.withColumn("ends", F.col("why") == "end_of_window")
    fills = (F.col("held") != 0) & (F.col("was") == 0)
    out = out.withColumn("run", F.sum(F.when(fills, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dollars = F.lit(capital) / (1 + F.abs("_b"))
    at_fill = Window.partitionBy(*by, "run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    for name, value in (("shares_y", F.bround(F.col("held") * dollars / F.col("py"))), ("shares_x", F.bround(-F.col("held") * F.col("_b") * dollars / F.col("px")))):
        out = out.withColumn(name, F.first(F.when(fills, value), ignorenulls=True).over(at_fill))
    live = (F.col("shares_y") != 0) & (F.col("shares_x") != 0)
    for c in ("shares_y", "shares_x"):
        out = out.withColumn(c, F.when((F.col("held") != 0) & live, F.col(c)).otherwise(0.0))
    for c in ("y", "x"):
        out = out.withColumn(f"_s{c}", F.coalesce(F.lag(f"shares_{c}").over(w), F.lit(0.0))).withColumn(f"_p{c}", F.lag(f"p{c}").over(w))
    out = out.withColumn("gross", F.coalesce(F.col("_sy") * (F.col("py") - F.col("_py")) + F.col("_sx") * (F.col("px") - F.col("_px")), F.lit(0.0)))

    def leg(c):
        """Costs of one leg's fills in a row: an entry or exit at the fill, and the exit that ends the window."""
        def cost(shares, sells):
            q = F.abs(shares)
            money = q * F.col(f"p{c}")
            part = F.when(F.col(f"adv_{c}") > 0, F.least(F.lit(1.0), q / F.col(f"adv_{c}"))).otherwise(1.0)
            fee = F.when(sells, money * sell_fee_bps / 1e4).otherwise(0.0)
            return F.when(q > 0, F.greatest(F.lit(min_comm), q * comm_share) + money * half_spread_bps / 1e4 + money * impact * F.coalesce(F.col(f"sig_{c}"), F.lit(0.0)) * F.sqrt(part) + fee).otherwise(0.0)

        moved = F.col(f"shares_{c}") - F.col(f"_s{c}")
        filled = F.when(F.col("held") != F.col("was"), cost(moved, moved < 0)).otherwise(0.0)
        return filled + F.when(F.col("ends"), cost(F.col(f"shares_{c}"), F.col(f"shares_{c}") > 0)).otherwise(0.0)

    days = F.datediff("date", F.lag("date").over(w))
    kept = F.when((F.col("held") != 0) & (F.col("was") != 0), 1.0).otherwise(0.0)
    short = F.when(F.col("_sy") < 0, -F.col("_sy") * F.col("_py")).otherwise(0.0) + F.when(F.col("_sx") < 0, -F.col("_sx") * F.col("_px")).otherwise(0.0)
    long = F.when(F.col("_sy") > 0, F.col("_sy") * F.col("_py")).otherwise(0.0) + F.when(F.col("_sx") > 0, F.col("_sx") * F.col("_px")).otherwise(0.0)
    out = out.withColumn("fills_cost", leg("y") + leg("x"))
    out = out.withColumn("carry", F.coalesce(kept * (short * borrow_bps + long * financing_bps) / 1e4 * days / 365, F.lit(0.0)))
    out = out.withColumn("net", F.col("gross") - F.col("fills_cost") - F.col("carry"))
    return out.drop("_b", "_sy", "_sx", "_py", "_px")
