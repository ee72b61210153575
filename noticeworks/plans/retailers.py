"""Retailers of stated names."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.operators import retailers as R
from noticeworks.plans.decided import pick
from noticeworks.session import table


def x19_retailers(spark, sf):
    """Suppliers as a catalog, and names of them that customers state in several ways."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    shop = lambda i: F.concat(F.lit("Shop "), (i % 50).cast("string"), F.when(i % 50 % 5 == 0, " and Co").otherwise(""))
    names = s.where("s_suppkey < 50").select("s_suppkey", shop(k).alias("name"), F.when(k % 2 == 0, F.array(F.concat(F.lit("S-"), k.cast("string"), F.lit(" Mart")))).alias("aliases"))
    c = table(spark, sf, "customer")
    a, b = F.col("c_custkey"), F.col("c_custkey") * 3 + 1
    said = pick(a, F.concat(F.upper(shop(a)), F.lit(" Retail Stores")), F.concat(shop(a), F.lit("'s, Nobody, "), shop(b), F.lit(" locations, "), shop(a)), F.concat(shop(a), F.lit(" & "), shop(b)), F.concat(F.lit("S-"), (a % 50).cast("string"), F.lit(" Mart.")), F.concat(shop(a), F.lit(" and Nobody")), "stores", None)
    found = R.retailers_of(c.select("c_custkey", said.alias("said")), "c_custkey", "said", R.catalog(names, "s_suppkey", "name", "aliases"))
    return found.select(F.col("key").alias("c_custkey"), F.array_join(F.transform("retailers", lambda x: x.cast("string")), "|").alias("retailers"))


QUERIES = {"x19_retailers": x19_retailers}

ORACLES = {
    "x19_retailers": """
WITH k AS (SELECT max(s_suppkey) AS most FROM supplier WHERE s_suppkey < 50),
c AS (SELECT c_custkey, c_custkey % 50 AS a, (c_custkey * 3 + 1) % 50 AS b, c_custkey % 7 AS w FROM customer),
e AS (SELECT c.*, a <= most AS ka, b <= most AS kb, most FROM c, k)
SELECT c_custkey, array_to_string([]::BIGINT[] || CASE w
  WHEN 0 THEN CASE WHEN ka THEN [a] ELSE [] END
  WHEN 1 THEN CASE WHEN ka THEN [a] ELSE [] END || CASE WHEN kb AND (b <> a OR NOT ka) THEN [b] ELSE [] END
  WHEN 2 THEN CASE WHEN ka AND kb THEN CASE WHEN a = b THEN [a] ELSE [a, b] END ELSE [] END
  WHEN 3 THEN CASE WHEN a % 2 = 0 AND ka THEN [a] ELSE [] END
  ELSE [] END, '|') AS retailers FROM e""",
}
