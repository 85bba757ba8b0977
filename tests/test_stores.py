"""Batch store (append, quarantine, log) and drift store: killed, repeated and rival attempts, pruned reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendscope.operators import quality as vq
from lendscope.sources.stores import BatchStore, DriftStore, with_periods

SCHEMA = "id long, amount double"


@pytest.fixture(scope="module")
def rules(spark):
    return [vq.Rule("amount_range", "amount", (F.col("amount") >= 1.0) & (F.col("amount") <= 100.0))]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, amount double, b string, extra string")


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_killed_attempt_is_not_seen_and_can_be_repeated(spark, tmp_path, rules):
    store = BatchStore(spark, str(tmp_path), SCHEMA)
    df = _frame(spark, [(1, 5.0, "001", "x"), (2, 500.0, "001", "x"), (3, None, "001", "x"), (4, 7.0, "2e1", "x")])
    store.stage(df, F.col("b"), rules)                                     # dies before the commit
    assert store.rows().count() == store.quarantine().count() == store.log().count() == 0
    store.append(df, F.col("b"), rules=rules)
    store.append(df, F.col("b"), rules=rules)                              # the whole job again
    assert _ids(store.rows()) == [1, 4] and _ids(store.quarantine()) == [2, 3]
    assert {r["batch"] for r in store.rows().collect()} == {"001", "2e1"}  # names that read as numbers stay text
    assert all(r["errors"] == ["amount_range"] for r in store.quarantine().collect())
    log = {r["batch"]: (r["status"], r["record_count"], r["rejected_count"]) for r in store.log().collect()}
    assert log == {"001": ("partial", 1, 2), "2e1": ("success", 1, 0)}


def test_two_attempts_that_both_commit_count_once(spark, tmp_path, rules):
    one, two = BatchStore(spark, str(tmp_path), SCHEMA), BatchStore(spark, str(tmp_path), SCHEMA)
    df = _frame(spark, [(i, float(i), "b", "x") for i in range(1, 6)])
    a, b = one.stage(df, F.lit("b"), rules), two.stage(df, F.lit("b"), rules)
    two.commit(b, "credit", "file")
    one.commit(a, "credit", "file")
    assert _ids(one.rows()) == [1, 2, 3, 4, 5] and one.log().count() == 2
    assert one.summary().collect()[0]["records"] == 5


def test_later_batches_and_rejected_ones(spark, tmp_path, rules):
    store = BatchStore(spark, str(tmp_path), SCHEMA)
    store.append(_frame(spark, [(1, 2.0, "a", "x")]), F.col("b"), "credit", "file", rules)
    store.append(_frame(spark, [(1, 2.0, "a", "x"), (2, -1.0, "c", "x")]), F.col("b"), "credit", "file", rules)
    assert _ids(store.rows()) == [1] and _ids(store.quarantine()) == [2]
    row = store.summary().collect()[0]
    assert (row["latest_status"], row["records"], row["rejected"], row["batches"], row["failures"]) == ("error", 1, 1, 2, 0)
    assert [r["batch"] for r in store.log(1).collect()] == ["c"]


def test_a_failing_batch_is_logged_and_raised(spark, tmp_path, rules):
    store = BatchStore(spark, str(tmp_path), SCHEMA)
    broken = _frame(spark, [(1, 2.0, "a", "x")]).withColumn("amount", F.raise_error(F.lit("no such feed")).cast("double"))
    with pytest.raises(Exception, match="no such feed"):
        store.append(broken, F.col("b"), rules=rules)
    row = store.log().collect()[0]
    assert row["status"] == "failed" and "no such feed" in row["error_message"] and store.rows().count() == 0
    store.append(_frame(spark, [(1, 2.0, "a", "x")]), F.col("b"), rules=rules)
    assert _ids(store.rows()) == [1]
    assert store.summary().collect()[0]["failures"] == 1


def _drift(spark, day, score, name="feature_drift_income", model="m"):
    return spark.createDataFrame([(dt.datetime(2024, 1, day, 12), model, "v1", name, score > 0.2, score)],
                                 "timestamp timestamp_ntz, model_name string, model_version string, drift_type string, "
                                 "drift_detected boolean, drift_score double")


def test_drift_store_replaces_a_repeated_check_and_prunes(spark, tmp_path):
    store = DriftStore(spark, str(tmp_path))
    for day in range(1, 6):
        store.write(_drift(spark, day, 0.1 * day), "feature")
    store.write(_drift(spark, 3, 0.9), "feature")                          # the check of day 3 again
    store.write(_drift(spark, 3, 0.5, "prediction_drift"), "prediction")   # another check of that day stays beside it
    store.write(_drift(spark, 3, 0.7, model="other"), "feature")
    rows = store.history("2024-01-02 13:00:00", until="2024-01-05 00:00:00", model_name="m").collect()
    assert sorted((r["timestamp"].day, r["drift_type"], r["drift_score"]) for r in rows) == [
        (3, "feature_drift_income", 0.9), (3, "prediction_drift", 0.5), (4, "feature_drift_income", 0.4)]
    only = store.history("2024-01-01", drift_type="prediction")
    assert only.count() == 1 and only.collect()[0]["reference_start"] is None
    plan = store.history("2024-01-03", model_name="m")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "day" in filters and "model_name" in filters


def test_periods_of_both_samples(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 7)]
    samples = spark.createDataFrame([(t[0], "reference", "x"), (t[1], "reference", "x"), (t[2], "current", "x"), (t[3], "current", "x"),
                                     (t[5], "current", "y")], "ts timestamp_ntz, sample string, k string")
    results = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, score double")
    got = {r["k"]: (r["reference_start"], r["reference_end"], r["detection_start"], r["detection_end"])
           for r in with_periods(results, samples, "ts", "sample", ["k"]).collect()}
    assert got == {"x": (t[0], t[1], t[2], t[3]), "y": (t[0], t[1], t[5], t[5]), "z": (t[0], t[1], None, None)}
    one = with_periods(results.limit(1), samples, "ts", "sample").collect()[0]
    assert (one["detection_start"], one["detection_end"]) == (t[2], t[5])
