import pytest
from test_queries import SF

from spreadworks import queries as q
from spreadworks import studies  # noqa: F401  registers its queries
from spreadworks.operators import clean
from spreadworks.sources import panel as sources


@pytest.mark.parametrize("name", ["rescreen_daily", "portfolio_sweep", "pair_evidence"])
def test_line_items_are_read_once(spark, name, monkeypatch):
    """A query takes its panel from the line items one time, as a written table: what it returns does not go back to them."""
    calls, of_sales = [], sources.sales_panel

    def counted(*arguments):
        calls.append(arguments)
        return of_sales(*arguments)

    monkeypatch.setattr(sources, "sales_panel", counted)
    out = q.QUERIES[name](spark, SF)
    assert len(calls) == 1 and not [f for f in out.inputFiles() if "lineitem" in f]


def test_the_cut_panel_is_the_cleaned_one(spark):
    want = clean.clean(sources.sales_panel(spark, SF))
    got = q._clean(spark, SF)
    assert got.inputFiles() == [] and got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


class _First(Exception):
    """The first frame that a query cuts."""


@pytest.mark.parametrize("name", ["portfolio_sweep", "pair_evidence"])
def test_line_items_cost_plain_arithmetic(spark, name, monkeypatch):
    """For each line item no decimal is made and no time zone asked: both cost more than the rest of the step."""

    def first(df):
        raise _First(df)

    monkeypatch.setattr(q, "cut", first)
    with pytest.raises(_First) as found:
        q.QUERIES[name](spark, SF)
    plan = found.value.args[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" in plan and not [f for f in ("round(", "date_trunc(", "as timestamp") if f in plan]


def test_line_items_are_not_sorted_to_meet_many_parts(spark, monkeypatch):
    """Parts too many for a broadcast are hashed task by task; more than a task may hold are merged."""

    def plan():
        return sources.sales_panel(spark, SF)._jdf.queryExecution().executedPlan().toString()

    want = sorted(sources.sales_panel(spark, SF).collect())
    monkeypatch.setattr(sources, "MANY_PARTS", 0)
    assert "ShuffledHashJoin" in plan() and sorted(sources.sales_panel(spark, SF).collect()) == want
    monkeypatch.setattr(sources, "PARTS_A_TASK", 1)
    assert "ShuffledHashJoin" not in plan()
