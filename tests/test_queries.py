"""Every registered query against its SQL, and what their plans must not hold."""

import oracle_check
import pytest

import __spark_entry__ as entry_file

# The operators of the training-data pipeline have tests of their own.
QUERIES = {k: q for k, q in entry_file.queries().items() if k != "pipeline" and not k.startswith("op")}
SQL = {k: q for k, q in entry_file.oracle_sql().items() if k in QUERIES}
WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_check.connect(sf_dir)


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, sf_dir, name):
    rows, faults = oracle_check.compare(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert not faults, "\n".join(faults)


def test_ml_scores_beat_guessing(spark, sf_dir):
    rows = QUERIES["ml_scores"](spark, sf_dir).collect()
    assert sum(r.n_correct for r in rows) > 0.8 * sum(r.n for r in rows)


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.columns == ["category", "n", "share_pct", "bar"]
    assert df.count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["unread_report", "candidate_accuracy", "candidate_accuracy_by_settings", "label_actions",
     "label_names_joined", "few_shot_sets", "stratified_sample", "category_report"],
)
def test_no_product_of_rows(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
