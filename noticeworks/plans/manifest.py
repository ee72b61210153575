"""Row-version manifest: parents with their ordered children, hashed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.session import table


def row_versions(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: list, child_order: list[str], child_text) -> DataFrame:
    """(key, version): md5 over the parent's fields and its children's text in `child_order`.

    Children are pre-aggregated per key, so that each side is shuffled once on the key; a parent without
    children hashes an empty list.
    """
    lists = children.groupBy(F.col(child_key).alias("_ck")).agg(
        F.sort_array(F.collect_list(F.struct(*child_order, child_text.alias("_text")))).alias("_kids")
    )
    joined = parents.join(lists, F.col(key) == F.col("_ck"), "left")
    kids = F.coalesce(F.array_join(F.transform("_kids", lambda k: k["_text"]), "|"), F.lit(""))
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return joined.select(key, F.md5(F.concat_ws("~", *parts, kids)).alias("version"))


def v4_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return row_versions(
        orders,
        lines,
        "o_orderkey",
        "l_orderkey",
        [F.col("o_custkey"), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")],
        ["l_linenumber", "l_partkey", "l_suppkey"],
        F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")),
    )


QUERIES = {"v4_manifest": v4_manifest}

ORACLES = {
    "v4_manifest": """
WITH kids AS (
  SELECT l_orderkey, string_agg(l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS k
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, md5(concat_ws('~', o_custkey::VARCHAR, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'),
  o_orderpriority, coalesce(k, ''))) AS version
FROM orders LEFT JOIN kids ON l_orderkey = o_orderkey""",
}
