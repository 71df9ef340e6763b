"""Results of a study as tables of a folder: Parquet, partitioned where readers filter, or CSV for exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Output:
    """A table of a study: its columns to partition by, and those that rows are sorted by within a file."""

    name: str
    partition: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


#: The tables of each study.
STUDIES = {
    "screener": (Output("pairs", order=("place",)),),
    "rolling": (
        Output("selection_log", ("period",)), Output("period_summary"), Output("pair_summary_selected"), Output("screen_log", ("screen",), ("screen_rank",)),
        Output("daily_pair_net", ("period",), ("y", "x", "t")), Output("daily_portfolio", order=("t",)), Output("trades_selected", ("period",)),
    ),
    "baseline": (Output("summary"), Output("by_period"), Output("quintile_table"), Output("random_distribution")),
    "predictive": tuple(Output(n, ("sample",)) for n in ("panel", "ic", "quintiles", "regressions", "gates", "conditional", "exits_by_quintile", "exits")),
    "engine": (
        Output("summary"), Output("detail", ("fold",), ("y", "x", "t")), Output("trades", ("fold",)), Output("validation_sweep", ("fold",)), Output("folds"), Output("pair_detail", ("fold",)),
        Output("pair_summary"), Output("selected_candidates", ("fold",)), Output("portfolio_selected_pairs", ("fold",)), Output("portfolio_folds"), Output("portfolio_equity", order=("t",)),
    ),
    "watchlist": (Output("pair_summary"), Output("fold_results", ("fold",)), Output("threshold_selection", ("fold",)), Output("train_diagnostics", ("fold",)), Output("cost_sensitivity"), Output("portfolio_folds"), Output("portfolio_daily", order=("t",)), Output("portfolio_summary"), Output("sweep_summary")),
    "frozen": (Output("pair_summary"), Output("trades"), Output("daily", order=("t",)), Output("pair_pnl", order=("y", "x", "t")), Output("detail", ("pair",), ("t",))),
    "locked": tuple(Output(n) for n in ("summary", "pair_summary", "trades", "daily", "monthly", "annual", "equity", "drawdown", "open_positions", "boundary_positions", "exposure")),
    "explore": (Output("ranked_pairs", order=("place",)), Output("spread", ("pair",), ("t",))),
}


def write_study(study: str, path: str, tables: dict[str, DataFrame], mode: str = "errorifexists", form: str = "parquet") -> list[str]:
    """Write the given tables of a study as path/name, and return their paths; a table the study does not know is an error.

    A partitioned table is dealt by its partition columns first, so that a partition is few files; sorting stays within tasks.
    """
    known = {o.name: o for o in STUDIES[study]}
    if unknown := set(tables) - set(known):
        raise ValueError(f"{study} has no table {sorted(unknown)}")
    done = []
    for name, df in tables.items():
        out = known[name]
        if missing := [c for c in (*out.partition, *out.order) if c not in df.columns]:
            raise ValueError(f"{study}.{name} lacks {missing}")
        if out.partition:
            df = df.repartition(*[F.col(c) for c in out.partition])
        if out.partition or out.order:
            df = df.sortWithinPartitions(*out.partition, *out.order)
        writer = df.write.mode(mode)
        if out.partition:
            writer = writer.partitionBy(*out.partition)
        if form == "csv":
            writer = writer.option("header", True)
        writer.format(form).save(f"{path}/{name}")
        done.append(f"{path}/{name}")
    return done


def wide(rows: DataFrame, index: str, name: str, value: str, names: list[str]) -> DataFrame:
    """A matrix for export: one column per name.  The names are given, so that no pass over the data looks for them."""
    return rows.groupBy(index).pivot(name, names).agg(F.first(value))


def read_rolling(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(selection_log, daily_pair_net) of an earlier rolling study; a log without the column eligible is refused."""
    log = spark.read.parquet(f"{path}/selection_log")
    if "eligible" not in log.columns:
        raise ValueError("the selection log has no column eligible: write it again")
    return log, spark.read.parquet(f"{path}/daily_pair_net")
