"""Queries without a SQL twin, checked against plain-Python replays on the small tables."""

import datetime as dt

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from lendscope.operators import alerts as al
from lendscope.sources import adapters as ad

QUERIES = E.queries()


def _replay_rules(spark):
    h = ad.hourly_metrics(spark, SF_SMALL).collect()
    fired = []
    for name, metric, op, thr, sev, typ, enabled, need, cooldown, _ in al.DEFAULT_RULES:
        if not enabled:
            continue
        cmp = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b,
               "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}[op]
        count, last = 0, None
        for r in sorted(h, key=lambda r: r["ts"]):
            v = r[metric]
            if v is None:
                continue
            if cmp(float(v), thr):
                count += 1
                if count >= need and (last is None or (r["ts"] - last).total_seconds() > cooldown):
                    fired.append((name, r["ts"], sev))
                    last, count = r["ts"], 0
            else:
                count = 0
    return fired


def test_alert_evaluations_match_replay(spark):
    got = sorted((r["name"], r["ts"], r["severity"]) for r in QUERIES["alert_evaluations"](spark, SF_SMALL).collect())
    assert got == sorted(_replay_rules(spark))


def test_alert_hourly_trend_totals(spark):
    fired = _replay_rules(spark)
    rows = QUERIES["alert_hourly_trend"](spark, SF_SMALL).collect()
    assert sum(r["alerts"] for r in rows) == len(fired)
    assert sum(r["critical"] for r in rows) == sum(1 for f in fired if f[2] == "critical")


def test_drift_alert_top3_matches_statistics(spark):
    stats = QUERIES["feature_drift_statistics"](spark, SF_SMALL).collect()
    ranked = sorted([r for r in stats if r["psi"] is not None], key=lambda r: (-r["psi"], r["feature"]))
    top = QUERIES["drift_alert_top3"](spark, SF_SMALL).collect()[0]
    assert top["top_features"] == [r["feature"] for r in ranked[:3]]
    assert top["status"] == ("ALERT" if ranked[0]["psi"] > 0.2 else "OK")


def test_model_validation_verdict_consistent(spark):
    v = QUERIES["model_validation_verdict"](spark, SF_SMALL).collect()[0]
    auc = QUERIES["pd_auc"](spark, SF_SMALL).collect()[0]["auc"]
    cal = QUERIES["calibration_error"](spark, SF_SMALL).collect()[0]["calibration_error"]
    assert v["auc"] == pytest.approx(auc, abs=1e-8)
    assert v["calibration_error"] == pytest.approx(cal, abs=1e-8)
    assert v["overall_pass"] == (v["pd_pass"] and v["lgd_pass"] and v["calibration_pass"] and v["business_rules_pass"])


def test_pd_lgd_training_ranges(spark):
    r = QUERIES["pd_lgd_training"](spark, SF_SMALL).collect()[0]
    assert 0.5 < r["auc"] <= 1.0
    assert 0.0 <= r["expected_loss_mean"] <= 1.0 and r["rmse"] >= 0.0
