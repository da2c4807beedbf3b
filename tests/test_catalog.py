"""Every query with SQL against that SQL, and the shape of selected plans."""

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF_DIR

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, SF_DIR)
    result = sql.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.collect(), df.columns) == normal(result.fetchall(), columns)


def test_entry(spark):
    assert contract.entry(spark).count() == 5


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clean_ml", "sentiment_lexicon", "aspect_distribution", "gold_features", "review_analysis", "text_features"])
def test_text_stays_in_the_jvm(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["reviews_by_stars", "rating_summary", "sales_by_month", "product_features", "price_by_score", "user_sentiment_stats"])
def test_no_cross_products(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned(spark):
    plan = plan_of(contract.queries()["revenue_by_category"](spark, SF_DIR))
    assert "l_tax" not in plan and "l_suppkey" not in plan
