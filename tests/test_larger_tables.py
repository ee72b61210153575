"""Queries on tables with longer keys, and rows that cost more on them, as copies of the test tables have."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeworks.plans import registry
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def same_as_sql(spark, folder, name, *tables):
    """The query and its SQL on the tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df, want = registry.queries()[name](spark, str(folder)), con.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    got, sql = [tuple(r[c] for c in cols) for r in df.collect()], [tuple(r[i] for i in at) for r in want.fetchall()]
    assert len(got) > 0
    assert rows(got, cols) == rows(sql, cols)


def test_same_event_of_keys_over_five_digits(spark, tmp_path):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    o.withColumn("o_custkey", F.col("o_custkey") + 899_900).write.parquet(f"{tmp_path}/orders.parquet")
    same_as_sql(spark, tmp_path, "v16_same_event", "orders")


def test_same_event_reads_texts_once_a_record(spark):
    """No text is read above the join, where a record stands once for each of its pairs."""
    df = registry.queries()["v16_same_event"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "regexp" not in above.lower() and "rlike" not in above.lower()


@pytest.mark.parametrize("name", ["c10_illness_status", "c10_case_status"])
def test_illness_is_read_inside_of_its_row(spark, name):
    """Sentences are no rows that are shuffled and joined back, and a small file is read by all cores."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert "Repartition " in plan


def plan_of(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("name", ["x27_prose", "x26_lists"])
def test_identifiers_are_read_inside_of_their_row(spark, name):
    """Values meet in their notice without windows, and a label is looked for by one pattern and cut by one."""
    plan = plan_of(spark, name)
    assert "window [" not in plan


def test_gtins_compute_no_part_twice(spark):
    plan = plan_of(spark, "i2_gtins")
    assert plan.count("aggregate(") < 30 and "repartition " in plan


def test_code_dates_scan_a_cell_once_a_form(spark):
    plan = plan_of(spark, "i5_code_dates")
    assert plan.count("regexp_extract_all(") == 2 and "repartition " in plan


def test_tables_are_read_once(spark):
    """The facts of upright and turned tables, and what defers to images, come from one reading of the pages."""
    plan = plan_of(spark, "x25_table_facts")
    assert plan.count("relation ") == 1 and "\nunion" not in plan and "join left" not in plan


@pytest.mark.parametrize("name", ["c12_prose", "c12_geography"])
def test_tokens_of_a_sentence_are_made_once(spark, name):
    plan = plan_of(spark, name)
    assert plan.count("regexp_extract_all(") < 10 and "join left" not in plan and "repartition " in plan
