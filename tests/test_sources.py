"""Landed-file readers on small fixture files written to a scratch folder."""

import json
import os
import tempfile

from lendscope.sources import files as sf


def test_economic_series_and_latest(spark):
    d = tempfile.mkdtemp(prefix="lendscope-src-", dir="/tmp")
    with open(os.path.join(d, "fed.json"), "w") as f:
        f.write(json.dumps({"series_id": "UNRATE", "observations": [
            {"date": "2024-01-01", "value": "3.7"}, {"date": "2024-02-01", "value": "."},
            {"date": "2024-03-01", "value": "3.9"}]}) + "\n")
    s = sf.economic_series(spark, d)
    rows = {str(r["date"]): r["value"] for r in s.collect()}
    assert rows["2024-02-01"] is None and rows["2024-03-01"] == 3.9
    assert sf.latest_value(s, "UNRATE").collect()[0]["value"] == 3.9


def test_german_mapping(spark):
    d = tempfile.mkdtemp(prefix="lendscope-src-", dir="/tmp")
    line = "A11 6 A34 A43 1169 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201 1"
    bad = "A11 six A34"
    third = line.replace("A43", "A410").replace("A152", "A153").replace("A201 1", "A201 2")
    with open(os.path.join(d, "german.data"), "w") as f:
        f.write("\n".join([line, bad, third]) + "\n")
    r, t = sf.german_credit(spark, os.path.join(d, "german.data")).orderBy("customer_id").collect()
    assert r["credit_score"] == 750 and r["employment_length"] == 10 and r["home_ownership"] == "OWN"
    assert r["income"] == 1169 / 6 * 36 and r["debt_to_income"] == 0.4 and not r["is_default"]
    assert r["customer_id"] == "GER_1000" and r["loan_purpose"] == "radio_tv" and r["loss_given_default"] == 0.0
    assert t["customer_id"] == "GER_1002" and t["loan_purpose"] == "other" and t["home_ownership"] == "MORTGAGE"
    assert t["is_default"] and t["loss_given_default"] == 0.45


def test_german_ids_are_unique(spark):
    d = tempfile.mkdtemp(prefix="lendscope-src-", dir="/tmp")
    line = "A11 6 A34 A43 1169 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201 1"
    with open(os.path.join(d, "german.data"), "w") as f:
        f.write((line + "\n") * 3000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        ids = [x["customer_id"] for x in sf.german_credit(spark, os.path.join(d, "german.data")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(i[4:]) for i in ids) == list(range(1000, 4000))


def test_credit_card_mapping(spark):
    d = tempfile.mkdtemp(prefix="lendscope-src-", dir="/tmp")
    with open(os.path.join(d, "cards.csv"), "w") as f:
        f.write("ID,LIMIT_BAL,EDUCATION,PAY_0,PAY_2,PAY_3,PAY_4,PAY_5,PAY_6,BILL_AMT1,default payment next month\n"
                "1,20000,2,2,2,-1,-1,-2,2,3913,1\n2,0,9,0,0,0,0,0,2,100,0\n")
    a, b = sf.credit_card_defaults(spark, d).orderBy("customer_id").collect()
    assert a["customer_id"] == "CC_1" and a["loan_amount"] == 3913.0 and a["income"] == 40000.0
    assert a["credit_score"] == 650 and a["debt_to_income"] == 0.5 and a["employment_length"] == 7
    assert a["delinquencies_past_2_years"] == 2 and a["revolving_utilization"] == 3913 / 20000
    assert a["months_since_last_delinquency"] == 1.0 and a["home_ownership"] == "RENT" and a["loan_purpose"] == "credit_card"
    assert a["is_default"] and a["loss_given_default"] == 0.65 and a["interest_rate"] == 0.15 + 2 * 0.02
    assert b["delinquencies_past_2_years"] == 0 and b["revolving_utilization"] == 0.5 and b["employment_length"] == 5


def test_assemble_economic_factors(spark):
    import datetime as dt
    rows = [("FEDFUNDS", dt.date(2024, 5, 1), 5.33), ("FEDFUNDS", dt.date(2024, 6, 1), 5.25),
            ("UNRATE", dt.date(2024, 6, 1), 4.0)]
    s = spark.createDataFrame(rows, "series_id string, date date, value double")
    r = sf.assemble_economic_factors(s).collect()
    assert len(r) == 1 and r[0]["fed_funds_rate"] == 5.25 and r[0]["unemployment_rate"] == 4.0
    assert r[0]["avg_interest_rate"] is None


def test_model_register_and_reload(spark, tmp_path):
    from pyspark.sql import functions as F
    from lendscope.ml import training as tr
    rows = [(i, float(i % 7), float(i % 5), i % 2, 0.3 + (i % 3) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "app_id long, a double, b double, y_default int, y_lgd double")
    pd_m, lgd_m = tr.train(df, ["a", "b"], "logistic", "random_forest")
    reg = tr.register_model(spark, pd_m, lgd_m, str(tmp_path), "m", "v1", ["a", "b"], {"pd_auc": 0.5})
    assert reg.collect()[0]["status"] == "active"
    p2, l2 = tr.load_model(reg.collect()[0]["model_path"])
    out = tr.predict(p2, l2, df).agg(F.min("pd_score"), F.max("pd_score")).collect()[0]
    assert 0.0 <= out[0] <= out[1] <= 1.0
