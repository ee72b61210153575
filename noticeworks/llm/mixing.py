"""Mixing sources to target weights by systematic sampling (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import ranked, seeded, stage, word_count


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, take `weights` in turn and share the total size; no target is above
    `max_repeat` times its source's size, and the excess is shared again by weight among the others. The fixed
    point is closed: order by cap/weight; the sources before the first whose share fits are capped.
    One row a source: the two windows hold the table of sources, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("_i", F.row_number().over(order) - 1)
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", F.col("source_size") * max_repeat)
    w = w.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    before = Window.orderBy("_ratio", "_i").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_ratio", "_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn(
        "_level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double")
        / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))).cast("double"),
    )
    w = w.withColumn("_fits", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    w = w.withColumn("_share", F.first("_fits", ignorenulls=True).over(every))
    return w.select(
        "source",
        "source_size",
        F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_share") * F.col("_w"), F.lit(0.0))).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix", narrow: bool = False) -> DataFrame:
    """`docs` with size, source_size, target, copies and taken (= copies * size).

    Every document of a source expects target/source_size copies. In each source the documents are ordered by
    size, then by a seeded hash; a document is emitted once for each integer that the running sum of expected
    copies, plus one random offset for the source, crosses. With that order a source's taken words miss the
    target by at most twice its largest document. Copies are at most `max_repeat`.

    `narrow` keeps doc_id and source alone of the columns. Null source: a source of its own, last. Null or empty
    text: size 0; a source of only such documents has target 0 and takes none. Repeated rows are rows like any
    other. Columns of `docs` named like an output are replaced.
    """
    outputs = ("size", "source_size", "target", "copies", "taken")
    keep = ["doc_id", "source"] if narrow else [c for c in docs.columns if c.lower() not in outputs]
    base = docs.select(*keep, word_count(F.col("text")).alias("size"), seeded(F.col("doc_id"), seed=seed).alias("_nw_h"))
    laid = ranked(base, ["source"], [F.col("size"), F.col("_nw_h"), F.col("doc_id")])
    shares = targets(stage(laid.groupBy("source").agg(F.sum("size").alias("source_size"))), weights, max_repeat)
    shares = shares.withColumn("_nw_rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    start = F.conv(F.substring(seeded(F.col("source"), seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    shares = shares.select(F.col("source").alias("_nw_s"), "source_size", "target", "_nw_rate", start.alias("_nw_u"))
    out = laid.join(shares, F.col("source").eqNullSafe(F.col("_nw_s")))
    upto = lambda r: F.floor(r.cast("double") * F.col("_nw_rate") + F.col("_nw_u"))
    out = out.withColumn("copies", (upto(F.col("_rank")) - upto(F.col("_rank") - 1)).cast("long"))
    return out.select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that the mix takes."""
    return mixed.where("copies > 0").withColumn("_nw_c", F.explode(F.expr("sequence(1L, copies)"))).select(*columns)


def op5_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, narrow=True).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][i % 3 + 1] AS w, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, struct_pack(ratio := ratio, i := i)) AS share FROM l WHERE level <= ratio),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(share * w, 0.0)) AS target,
         ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM l LEFT JOIN f ON true),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS rk FROM d),
j AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.u, k.rk,
         CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size::DOUBLE END AS rate
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rk::DOUBLE * rate + u) - floor((rk - 1)::DOUBLE * rate + u)) * size)::BIGINT AS taken
FROM j"""
