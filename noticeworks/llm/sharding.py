"""Sharding by proportional stratified interleaving (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import ranked, seeded, stage


def shards(docs: DataFrame, n_shards: int = 16, seed: str = "shard") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): shards whose counts are at most one apart.

    The rows of each source are ranked in a seeded order; the row of rank r among n stands at (2r-1)/2n; all rows
    are sorted by that fraction and the sequence is cut into equal counts, so that every shard holds each source
    in its share of the whole, to about one row. Sources tie by code point, null last, then by the seeded hash.

    Null text: no bytes, size 1, checksum 0. Null ids and repeated rows are rows like any other. An empty table
    gives no rows. Only the named columns of `docs` are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        seeded(F.col("doc_id"), seed=seed).alias("_h"),
    )
    within = ranked(base, ["source"], [F.col("_h"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32")])
    counts = stage(within.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))).withColumnRenamed("source", "_s")
    placed = within.join(counts, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_f", (F.col("_rank") * 2 - 1).cast("double") / (F.col("_n") * 2).cast("double")
    )
    placed = placed.select("doc_id", "source", "size", "text_crc32", "_h", "_f")
    order = [F.col("_f"), F.col("source").asc_nulls_last(), F.col("_h"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32")]
    line = ranked(placed, [], order, rank="_g")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # exact integers: the shard of place p is floor(p*k/n); its first place is ceil(shard*n/k)
    shard = F.expr(f"cast(((_g - 1) * {int(n_shards)}L) div {max(int(total), 1)}L as int)")
    first = F.expr(f"(shard * {int(total)}L + {int(n_shards) - 1}L) div {int(n_shards)}L")
    return line.withColumn("shard", shard).withColumn("slot", F.col("_g") - 1 - first).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


def op6_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 under the law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return shards(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP6_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
hexes AS (SELECT DISTINCT coalesce(text, '') AS x, hex(encode(coalesce(text, ''))) AS hx FROM documents),
crc AS (
  SELECT x, xor(list_reduce(
    [4294967295::BIGINT] || [('0x' || substr(hx, (2 * j + 1)::INT, 2))::BIGINT FOR j IN range(length(hx) // 2)],
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM hexes, tab),
d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, crc, md5('shard|' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents JOIN crc ON coalesce(text, '') = x),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST, crc) AS rk, count(*) OVER (PARTITION BY source) AS n FROM d),
g AS (SELECT *, row_number() OVER (ORDER BY (rk * 2 - 1)::DOUBLE / (n * 2)::DOUBLE, source NULLS LAST, h, doc_id NULLS LAST, crc) - 1 AS p, count(*) OVER () AS total FROM r),
s AS (SELECT *, (p * 16) // total AS shard FROM g)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard::INT AS shard, (p - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM s"""
