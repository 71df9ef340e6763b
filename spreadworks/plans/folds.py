"""Walk-forward folds, as small tables of row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "fold int, train_lo int, train_hi int, val_lo int, val_hi int, test_lo int, test_hi int"


def gapped(n: int, folds: int = 5, initial: float = 0.5, val_share: float = 0.5) -> list[tuple]:
    """Anchored training; each further block of equal size (the last one to the end) is split into validation and test."""
    start = int(n * initial)
    size = (n - start) // folds
    if n - start < folds * 30:
        raise ValueError("too few rows for so many folds")
    out = []
    for k in range(folds):
        a, b = start + k * size, n if k == folds - 1 else start + (k + 1) * size
        mid = a + int((b - a) * val_share)
        if a >= 30 and a < mid < b:
            out.append((k + 1, 0, a, a, mid, mid, b))
    return out


def continuous(n: int, folds: int = 5, initial: float = 0.5, val_share: float = 0.2) -> list[tuple]:
    """Tests tile the end of the history without gaps; a fold's validation is the previous test block (the first one a share of the history)."""
    start = int(n * initial)
    edge = [start + int((n - start) * i / folds) for i in range(folds)] + [n]
    val = start - int(start * val_share)
    out = []
    for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
        lo = val if i == 0 else edge[i - 1]
        out.append((i + 1, 0, lo, lo, a, a, b))
    return out


def of_panel(panel: DataFrame, kind: str = "gapped", **parameters) -> DataFrame:
    """The folds of a panel's own length: one aggregate tells it, the folds are a table of a few rows."""
    n = panel.agg(F.max("t")).first()[0]
    rows = {"gapped": gapped, "continuous": continuous}[kind]((n or 0) + 1, **parameters) if n is not None else []
    return table(panel.sparkSession, rows)


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)
