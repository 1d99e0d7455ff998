"""What is computed once and what crosses a shuffle, by the plans."""

import pytest

from tickloom.operators import stats
from tickloom.plans import queries, validation  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("made", [lambda s: stats.simulated_paths(s, 3, 1000.0, block=5), lambda s: stats.draws(s, 3), lambda s: stats.bootstrap_test(s, 3), lambda s: stats.reality_check(s, 3)])
def test_bootstraps_do_not_join_trades_again(spark, made):
    assert "l_orderkey" not in plan(made(queries.return_series(spark, SF)))


def test_line_items_are_narrow_before_the_join(spark):
    df = queries.trades(spark, SF).where("exit_ts IS NOT NULL").groupBy("strategy_id", "exit_ts").agg({"profit": "sum"})
    left = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # the scans; what is above them crosses the shuffle
    assert left.size() == 2
    join = plan(df).split("Join Inner")[1]
    kept = next(line for line in join.splitlines() if "Project [l_orderkey" in line)
    assert "profit" in kept and kept.count(" AS ") <= 3


def test_the_validation_joins_trades_once(spark):
    found = queries.QUERIES["a32_e5_validation"](spark, SF)
    assert "l_orderkey" not in plan(found) and found.count() == 40
