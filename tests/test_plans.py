"""Plan checks: tested operators keep Python off the hot path and never run a
window over a whole data table in one partition."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

QUERIES = E.queries()
# queries whose Python is by design (per-rule state machine, per-feature p-values, keyed state)
PYTHON_OK = {"alert_evaluations", "alert_routing", "alert_hourly_trend", "alert_lifecycle",
             "feature_drift_report", "stream_rate_admission"}
NAMES = ["book_by_purpose", "credit_features", "pd_auc", "roc_curve", "calibration_table",
         "feature_drift_statistics", "api_summary_by_endpoint", "api_latency_last_100",
         "latest_application_per_customer", "request_log_levels", "client_sliding_requests",
         "api_timeseries_5min", "drift_history", "out_of_time_features", "customer_prediction_history",
         "scaler_fit", "optimal_threshold_confusion", "health_by_hour"]


@pytest.mark.parametrize("name", NAMES)
def test_no_python_udf_and_no_global_window(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # every Window operator is partitioned: the partition list (2nd bracket) is never empty,
    # except the bounded bucket-offset / top-N second stage which partitions by a literal
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\]", plan):
        assert m.group(1).strip() != ""
