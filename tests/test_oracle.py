"""Every registered query against its SQL in DuckDB, on whole tables at the smallest scale."""

import check
import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.queries())
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    count, problem = check.compare(spark, con, sf, entry.queries()[name], ORACLES.get(name))
    assert problem is None, problem
    assert count > 0 or name in ("contains_join",)


THRESHOLDS = ["score_percentiles", "threshold_metrics", "best_f1_threshold", "extreme_case_summary", "best_percentile_by_mean_f1",
              "percentile_curve"]


@pytest.mark.parametrize("name", THRESHOLDS)
def test_thresholds_at_a_larger_scale(spark, name):
    """One unit in the last place of a threshold moves a row across it; more rows, more chances."""
    larger = "/root/testdata/sf0.01"
    _, problem = check.compare(spark, check.connect(larger), larger, entry.queries()[name], ORACLES[name])
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(NAMES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["row_key", "score", "label"]
    assert out.count() == 100
