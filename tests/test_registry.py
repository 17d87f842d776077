"""The contract, and a spread of registered queries against their SQL twins on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tests.compare import duck, run

D = "/root/testdata/sf0.001"
NAMES = ["scored_latest", "performance_windows", "calibration_fit", "slice_metrics", "prior_ewm", "asof_roster", "quantile_report", "lorenz", "asof_snapshot", "match_events",
         "consensus_line", "decide", "replay", "continuity", "promotion_gates", "q_next_n_events", "flatten_prices", "stream_scores", "correlation_pairs"]


@pytest.fixture(scope="module")
def con():
    return duck(D)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    msg, ok = run(name, spark, con, D, entry.queries(), entry.oracle_sql())
    assert ok, msg
