"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from check_oracle import canon

from conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    dcols = rel.columns
    from check_types import spark_type
    st = {f.name: spark_type(f.dataType) for f in df.schema.fields}
    assert st == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    c1, r1 = canon(df.columns, rows)
    c2, r2 = canon(dcols, rel.fetchall())
    assert c1 == c2
    assert r1 == r2


def _between(lo, hi):
    return lambda v: v is not None and lo <= v <= hi


# what holds for every row of the queries that SQL cannot express
PROPERTIES = {
    "pd_lgd_training": {"auc": _between(0.6, 1.0), "rmse": _between(0.0, 0.5), "default_rate": _between(0.01, 0.99),
                        "expected_loss_mean": _between(0.0, 1.0)},
    "pd_cross_validation": {"cv_auc_mean": _between(0.6, 1.0), "cv_auc_std": _between(0.0, 0.2), "cv_rmse": _between(0.0, 0.5)},
    "pd_ensemble_importance": {"importance": _between(0.0, 1.0), "validation_auc": _between(0.6, 1.0)},
    "model_grid_experiment": {"status": lambda v: v == "ok", "val_auc": _between(0.6, 1.0), "lgd_rmse": _between(0.0, 0.5),
                              "error": lambda v: v is None},
    "perturbation_sensitivity": {"mean_absolute_change": _between(1e-6, 0.05), "max_absolute_change": _between(1e-6, 0.5)},
    "feature_drift_report": {"p_value": lambda v: v is None or 0.0 <= v <= 1.0},
}
ROWS = {"model_grid_experiment": 6, "pd_lgd_training": 1, "pd_cross_validation": 1, "perturbation_sensitivity": 1}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows and len(rows) == ROWS.get(name, len(rows))
    for column, holds in PROPERTIES.get(name, {}).items():
        assert all(holds(r[column]) for r in rows), column
    if name == "model_grid_experiment":
        assert sum(r["is_best"] for r in rows) == 1


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
