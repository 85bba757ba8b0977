"""DuckDB twins of the adapter views (``lendscope.sources.adapters``).

Each constant is a CTE body; ``with_views`` prepends the ones a query needs.
All literals are written as doubles (``0.05E0``) so both engines compute in
binary floating point.
"""

from __future__ import annotations

CREDIT_APPLICATIONS_BASE = """
SELECT o_orderkey AS app_id,
       CAST(o_custkey AS VARCHAR) AS customer_id,
       o_totalprice / 10.0E0 AS loan_amount,
       CAST(CASE o_orderkey % 10 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 36 WHEN 3 THEN 48
            WHEN 4 THEN 60 WHEN 5 THEN 84 WHEN 6 THEN 120 WHEN 7 THEN 180 WHEN 8 THEN 240
            WHEN 9 THEN 360 END AS INTEGER) AS loan_term,
       0.05E0 + (o_orderkey % 31) / 100.0E0 AS interest_rate,
       30000.0E0 + (c_acctbal + 1000.0E0) * 12.0E0 AS income,
       ((o_orderkey * 7) % 97) / 100.0E0 AS debt_to_income,
       CAST(300 + (o_custkey * 37 + o_orderkey * 11) % 551 AS INTEGER) AS credit_score,
       CAST(o_custkey % 40 AS INTEGER) AS employment_length,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'OWN' WHEN 'HOUSEHOLD' THEN 'MORTGAGE'
            WHEN 'AUTOMOBILE' THEN 'RENT' WHEN 'MACHINERY' THEN 'OTHER' ELSE 'RENT' END AS home_ownership,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MEDICAL' WHEN '2' THEN 'DEBT_CONSOLIDATION'
            WHEN '3' THEN 'CAR' WHEN '4' THEN 'OTHER' WHEN '5' THEN 'VACATION' ELSE 'OTHER' END AS loan_purpose,
       o_orderdate AS application_ts
FROM orders JOIN customer ON o_custkey = c_custkey
"""

STRESS_SQL = ("(debt_to_income * 0.4E0 + (1.0E0 - (credit_score - 300) / 550.0E0) * 0.3E0 "
              "+ least(greatest(loan_amount / (income + 1e-6), 0.0E0), 2.0E0) * 0.3E0)")

CREDIT_APPLICATIONS = f"""
SELECT *, CASE WHEN is_default THEN 0.2E0 + ((app_id * 31) % 60) / 100.0E0 ELSE 0.0E0 END AS loss_given_default
FROM (SELECT *, ({STRESS_SQL} + ((app_id * 7919) % 1000) / 1000.0E0 * 0.4E0) > 0.80E0 AS is_default
      FROM ({CREDIT_APPLICATIONS_BASE}) b) d
"""

API_METRICS = """
SELECT event_id AS request_id, event_type AS endpoint, ts, user_id AS client_id,
       value / 100.0E0 AS response_time,
       CAST(CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 404 END
            ELSE 200 END AS INTEGER) AS status_code,
       props AS metadata
FROM events
"""

SYSTEM_METRICS = """
SELECT timestamp,
       20.0E0 + total_requests * 3.0E0 AS cpu_percent,
       40.0E0 + avg_response_time * 20.0E0 AS memory_percent,
       50.0E0 + hour(timestamp) * 1.5E0 AS disk_percent,
       CAST(total_requests AS BIGINT) AS total_requests, error_rate, avg_response_time
FROM (SELECT date_trunc('hour', ts) AS timestamp, count(*) AS total_requests,
             avg(CASE WHEN status_code >= 400 THEN 1.0E0 ELSE 0.0E0 END) AS error_rate,
             avg(response_time) AS avg_response_time
      FROM api_metrics GROUP BY 1) h
"""

# Scorecard scoring of the whole book (PD from FE-14, LGD = 0.4).
RATING_SQL = """least(greatest(
   CAST(risk_score >= 0.0E0 AS INTEGER) + CAST(risk_score >= 0.02E0 AS INTEGER)
 + CAST(risk_score >= 0.05E0 AS INTEGER) + CAST(risk_score >= 0.1E0 AS INTEGER)
 + CAST(risk_score >= 0.15E0 AS INTEGER) + CAST(risk_score >= 0.25E0 AS INTEGER)
 + CAST(risk_score >= 0.35E0 AS INTEGER) + CAST(risk_score >= 0.5E0 AS INTEGER)
 + CAST(risk_score >= 0.7E0 AS INTEGER) + CAST(risk_score >= 0.85E0 AS INTEGER)
 + CAST(risk_score >= 1.0E0 AS INTEGER), 1), 10)"""

SCORED_BOOK = f"""
SELECT *, {RATING_SQL} AS risk_rating
FROM (SELECT *, pd_score * lgd_score * 1.0E0 AS expected_loss,
             pd_score * 0.7E0 + lgd_score * 0.3E0 AS risk_score
      FROM (SELECT *, 1.0E0 / (1.0E0 + exp(-8.0E0 * ({STRESS_SQL} - 0.65E0))) AS pd_score,
                   0.4E0 AS lgd_score
            FROM credit_applications) s) r
"""

DECISION_SQL = """CASE WHEN pd_score < 0.05E0 AND risk_rating <= 3 THEN 'APPROVE'
     WHEN pd_score < 0.15E0 AND risk_rating <= 5 THEN 'APPROVE_WITH_CONDITIONS'
     WHEN pd_score < 0.30E0 AND risk_rating <= 7 THEN 'MANUAL_REVIEW'
     ELSE 'DECLINE' END"""

VALID_APP_SQL = """(customer_id IS NOT NULL
 AND loan_amount BETWEEN 1000.0E0 AND 10000000.0E0
 AND loan_term IN (12, 24, 36, 48, 60, 84, 120, 180, 240, 360)
 AND interest_rate BETWEEN 0.01E0 AND 0.50E0
 AND income BETWEEN 10000.0E0 AND 10000000.0E0
 AND debt_to_income BETWEEN 0.0E0 AND 2.0E0
 AND credit_score BETWEEN 300 AND 850
 AND employment_length BETWEEN 0 AND 50
 AND upper(home_ownership) IN ('RENT', 'OWN', 'MORTGAGE', 'OTHER')
 AND upper(loan_purpose) IN ('DEBT_CONSOLIDATION', 'CREDIT_CARD', 'HOME_IMPROVEMENT', 'MAJOR_PURCHASE',
     'MEDICAL', 'VACATION', 'WEDDING', 'MOVING', 'HOUSE', 'CAR', 'OTHER'))"""

VIEWS = {
    "credit_applications": CREDIT_APPLICATIONS,
    "api_metrics": API_METRICS,
    "system_metrics": SYSTEM_METRICS,
    "scored_book": SCORED_BOOK,
}
DEPENDS = {"system_metrics": ["api_metrics"], "scored_book": ["credit_applications"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{sql}"

# FE-01 .. FE-16 over the whole book (row level).
FEATURES = """
SELECT a.*,
       income / (loan_amount + 1e-6) AS income_to_loan_ratio,
       loan_amount / (income + 1e-6) AS loan_to_income_ratio,
       CASE WHEN income IS NULL THEN NULL
            WHEN len(list_distinct(e.income_edges)) = 5 THEN
              CASE WHEN income <= e.income_edges[2] THEN 'Q1' WHEN income <= e.income_edges[3] THEN 'Q2'
                   WHEN income <= e.income_edges[4] THEN 'Q3' ELSE 'Q4' END
            ELSE CASE WHEN income < 40000.0E0 THEN 'Q1' WHEN income < 60000.0E0 THEN 'Q2'
                      WHEN income < 90000.0E0 THEN 'Q3' ELSE 'Q4' END END AS income_quartile,
       CASE WHEN credit_score > 0 AND credit_score <= 580 THEN 'Poor'
            WHEN credit_score > 580 AND credit_score <= 670 THEN 'Fair'
            WHEN credit_score > 670 AND credit_score <= 740 THEN 'Good'
            WHEN credit_score > 740 AND credit_score <= 800 THEN 'Very Good'
            WHEN credit_score > 800 AND credit_score <= 850 THEN 'Excellent' END AS credit_score_band,
       (credit_score - 300) / 550.0E0 AS credit_score_normalized,
       CASE WHEN debt_to_income > 0.0E0 AND debt_to_income <= 0.2E0 THEN 'Low'
            WHEN debt_to_income > 0.2E0 AND debt_to_income <= 0.36E0 THEN 'Moderate'
            WHEN debt_to_income > 0.36E0 AND debt_to_income <= 0.5E0 THEN 'High'
            WHEN debt_to_income > 0.5E0 AND debt_to_income <= 1.0E0 THEN 'Very High'
            WHEN debt_to_income > 1.0E0 THEN 'Extreme' END AS dti_risk_category,
       CAST(debt_to_income > 0.43E0 AS INTEGER) AS high_dti_flag,
       loan_term / 360.0E0 AS loan_term_risk,
       CAST(loan_term <= 36 AS INTEGER) AS short_term_loan,
       CAST(interest_rate > 0.15E0 AS INTEGER) AS high_interest_rate,
       (rank() OVER (ORDER BY interest_rate) + (count(*) OVER (PARTITION BY interest_rate) - 1) / 2.0E0)
         / count(interest_rate) OVER () AS interest_rate_percentile,
       CASE WHEN employment_length >= 2 THEN 'Stable' WHEN employment_length >= 1 THEN 'Moderate'
            ELSE 'New' END AS employment_stability,
       CAST(employment_length >= 5 AS INTEGER) AS long_employment,
       CASE home_ownership WHEN 'OWN' THEN 2.0E0 WHEN 'MORTGAGE' THEN 1.0E0 WHEN 'RENT' THEN 0.0E0
            WHEN 'OTHER' THEN 0.0E0 ELSE 0.0E0 END AS ownership_stability,
       CASE upper(loan_purpose) WHEN 'DEBT_CONSOLIDATION' THEN 0.12E0 WHEN 'HOME_IMPROVEMENT' THEN 0.08E0
            WHEN 'MAJOR_PURCHASE' THEN 0.10E0 WHEN 'CAR' THEN 0.09E0 WHEN 'WEDDING' THEN 0.15E0
            WHEN 'VACATION' THEN 0.18E0 WHEN 'MEDICAL' THEN 0.11E0 WHEN 'CREDIT_CARD' THEN 0.16E0
            WHEN 'OTHER' THEN 0.14E0 ELSE 0.14E0 END AS purpose_risk_score,
       {stress} AS financial_stress_score,
       CASE WHEN pow(1.0E0 + interest_rate / 12.0E0, loan_term) - 1.0E0 = 0 THEN NULL
            ELSE loan_amount * ((interest_rate / 12.0E0) * pow(1.0E0 + interest_rate / 12.0E0, loan_term))
                 / (pow(1.0E0 + interest_rate / 12.0E0, loan_term) - 1.0E0) END AS monthly_payment
FROM credit_applications a,
     (SELECT quantile_cont(income, [0.0, 0.25, 0.5, 0.75, 1.0]) AS income_edges FROM credit_applications) e
""".replace("{stress}", STRESS_SQL)

VIEWS["features"] = FEATURES
DEPENDS["features"] = ["credit_applications"]

PREDICTION_LOG = """
SELECT app_id AS request_id, customer_id, 'credit_risk_model' AS model_name,
       'v' || CAST(app_id % 3 AS VARCHAR) AS model_version,
       pd_score, lgd_score, expected_loss, risk_rating, is_default, loan_amount,
       json_object('loan_amount', loan_amount, 'income', income, 'credit_score', credit_score,
                   'debt_to_income', debt_to_income, 'loan_purpose', loan_purpose,
                   'customer_id', customer_id) AS input_features,
       json_object('probability_of_default', pd_score, 'loss_given_default', lgd_score,
                   'expected_loss', expected_loss, 'risk_rating', risk_rating) AS prediction_result,
       5.0E0 + CAST((app_id * 13) % 200 AS DOUBLE) AS response_time_ms,
       application_ts AS timestamp
FROM scored_book
"""
VIEWS["prediction_log"] = PREDICTION_LOG
DEPENDS["prediction_log"] = ["scored_book"]

MODEL_METRICS = """
SELECT model_name, model_version, date_trunc('day', timestamp) AS timestamp,
       count(*) AS prediction_count,
       avg(CAST((pd_score > 0.5E0) = is_default AS DOUBLE)) AS accuracy,
       avg(response_time_ms) AS avg_prediction_time, avg(pd_score) AS avg_pd_score,
       avg(lgd_score) AS avg_lgd_score,
       CAST(sum(CAST(pd_score > 0.1E0 AS BIGINT)) AS BIGINT) AS high_risk_predictions
FROM prediction_log GROUP BY 1, 2, 3
"""
VIEWS["model_metrics"] = MODEL_METRICS
DEPENDS["model_metrics"] = ["prediction_log"]

_CONT = ["loan_amount", "interest_rate", "income", "debt_to_income", "credit_score", "employment_length", "loan_term"]
_CAT = ["home_ownership", "loan_purpose"]
DRIFT_SAMPLES = "\nUNION ALL\n".join(
    [f"SELECT '{f}' AS feature, CASE WHEN application_ts < TIMESTAMP '1998-04-15 00:00:00' THEN 'reference' "
     f"ELSE 'current' END AS sample, CAST({f} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS category "
     f"FROM credit_applications" for f in _CONT]
    + [f"SELECT '{f}' AS feature, CASE WHEN application_ts < TIMESTAMP '1998-04-15 00:00:00' THEN 'reference' "
       f"ELSE 'current' END AS sample, CAST(NULL AS DOUBLE) AS value, {f} AS category "
       f"FROM credit_applications" for f in _CAT])
VIEWS["drift_samples"] = DRIFT_SAMPLES
DEPENDS["drift_samples"] = ["credit_applications"]

# numeric keys are turned into text the same way in both engines ('12.0')
CAT_KEY = "coalesce(category, CAST(value AS VARCHAR))"

HOURLY_METRICS = """
SELECT a.timestamp AS ts, a.requests, a.error_rate, a.avg_response_time, a.p95_response_time,
       s.cpu_percent, s.memory_percent
FROM (SELECT date_trunc('hour', ts) AS timestamp, count(*) AS requests,
             avg(CASE WHEN status_code >= 400 THEN 1.0E0 ELSE 0.0E0 END) AS error_rate,
             avg(response_time) AS avg_response_time, quantile_cont(response_time, 0.95) AS p95_response_time
      FROM api_metrics GROUP BY 1) a JOIN system_metrics s ON a.timestamp = s.timestamp
"""
VIEWS["hourly_metrics"] = HOURLY_METRICS
DEPENDS["hourly_metrics"] = ["system_metrics"]

ALERT_RULES = """
SELECT * FROM (VALUES
  ('high_error_rate', 'error_rate', '>', 0.05E0, 'high', 'system', true, 3, 3600),
  ('slow_responses', 'avg_response_time', '>', 1.2E0, 'medium', 'performance', true, 2, 1800),
  ('p95_latency', 'p95_response_time', '>=', 3.0E0, 'high', 'performance', true, 2, 1800),
  ('high_cpu', 'cpu_percent', '>', 80.0E0, 'critical', 'system', true, 1, 7200),
  ('high_memory', 'memory_percent', '>', 90.0E0, 'critical', 'system', true, 1, 7200),
  ('low_traffic', 'requests', '<', 1.0E0, 'low', 'availability', false, 5, 600))
  AS r(name, metric_name, operator, threshold, severity, alert_type, enabled, consecutive_failures, cooldown_period)
"""
VIEWS["alert_rules"] = ALERT_RULES

METRICS_LONG = """
SELECT ts, metric_name, value FROM (
  SELECT ts, 'requests' AS metric_name, CAST(requests AS DOUBLE) AS value FROM hourly_metrics
  UNION ALL SELECT ts, 'error_rate', error_rate FROM hourly_metrics
  UNION ALL SELECT ts, 'avg_response_time', avg_response_time FROM hourly_metrics
  UNION ALL SELECT ts, 'p95_response_time', p95_response_time FROM hourly_metrics
  UNION ALL SELECT ts, 'cpu_percent', cpu_percent FROM hourly_metrics
  UNION ALL SELECT ts, 'memory_percent', memory_percent FROM hourly_metrics) m WHERE value IS NOT NULL
"""
VIEWS["metrics_long"] = METRICS_LONG
DEPENDS["metrics_long"] = ["hourly_metrics"]

RULE_MATCHES = """
SELECT m.ts, m.metric_name, m.value, r.name, r.operator, r.threshold, r.severity, r.alert_type,
       coalesce(CASE r.operator WHEN '>' THEN m.value > r.threshold WHEN '<' THEN m.value < r.threshold
            WHEN '>=' THEN m.value >= r.threshold WHEN '<=' THEN m.value <= r.threshold
            WHEN '==' THEN m.value = r.threshold WHEN '!=' THEN m.value <> r.threshold ELSE false END, false) AS violated
FROM metrics_long m JOIN alert_rules r ON m.metric_name = r.metric_name AND r.enabled
"""
VIEWS["rule_matches"] = RULE_MATCHES
DEPENDS["rule_matches"] = ["metrics_long", "alert_rules"]

# Fold over each rule's ticks in order: count up on a violation, fire when the count reaches the rule's
# number and the last firing is older than the cooldown, start again on firing and on a pass.
FIRED = """
SELECT f.name, f.ts, m.metric_name, m.value, m.threshold, m.severity, m.alert_type,
       md5(f.name || ',' || m.metric_name || ',' || strftime(f.ts, '%Y-%m-%d %H:%M:%S')) AS alert_id
FROM (SELECT name, unnest(s.fired) AS ts FROM (
        SELECT name, list_reduce(list_prepend({'n': 0, 'last': CAST(NULL AS TIMESTAMP), 'fired': CAST([] AS TIMESTAMP[]), 'v': false}, ticks),
          lambda acc, x: CASE
            WHEN NOT x.v THEN {'n': 0, 'last': acc.last, 'fired': acc.fired, 'v': false}
            WHEN acc.n + 1 >= need AND (acc.last IS NULL OR x.fired[1] - acc.last > to_seconds(cooldown))
              THEN {'n': 0, 'last': x.fired[1], 'fired': list_concat(acc.fired, x.fired), 'v': true}
            ELSE {'n': acc.n + 1, 'last': acc.last, 'fired': acc.fired, 'v': true} END) AS s
        FROM (SELECT m.name, any_value(r.consecutive_failures) AS need, any_value(r.cooldown_period) AS cooldown,
                     list({'n': 0, 'last': CAST(NULL AS TIMESTAMP), 'fired': [CAST(m.ts AS TIMESTAMP)], 'v': m.violated} ORDER BY m.ts) AS ticks
              FROM rule_matches m JOIN alert_rules r ON m.name = r.name GROUP BY m.name) t) u) f
JOIN rule_matches m ON m.name = f.name AND m.ts = f.ts
"""
VIEWS["fired"] = FIRED
DEPENDS["fired"] = ["rule_matches"]
