"""Feed reads on part rows that the smallest tables do not have."""

import itertools

import duckdb

from noticeworks.functions import signals
from noticeworks.plans import reading


def test_titles_of_parts_whose_type_begins_their_name(spark, tmp_path):
    """x12 and x14 keep to their SQL where the type is the name's first word, or is blank."""
    pairs = list(itertools.product(("large anvil", "small rod", "hot bolt"), ("LARGE", "SMALL", "ECONOMY", "")))
    rows = [(i, *pairs[i // 35], 1) for i in range(35 * len(pairs))]  # each pair with all remainders of 7 and of 5
    path = f"{tmp_path}/part.parquet"
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view part as select * from read_parquet('{path}/*.parquet')")
    for name in ("x12_titles", "x14_expansion"):
        got = reading.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(reading.ORACLES[name]).fetchall()), name


def test_short_title_that_begins_the_other_one(spark):
    a = "Acme Recalls Large Anvil Because Of Possible Health Risk"
    b = ["Updated — Acme Recalls Large", "Acme Recalls", "Updated — Acme Recalled Large", "Revised: Acme Recalls Large", "Updated — ", None]
    df = spark.createDataFrame([(a, x) for x in b], "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(signals.titles_relate(df.a, df.b)).collect()] == [True, True, False, False, False, False]
