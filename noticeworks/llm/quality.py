"""Quality rules with host-level verdicts (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import WORD, stage

#: Positions take the low bits of a sort key; a longer text takes the plain path.
POS_BITS = 22


def _adjacent(keys: Column, i: Column, n: Column, key) -> Column:
    """Whether element i of a sorted array has the key of the one before or after it."""
    here = key(F.get(keys, i))
    return F.coalesce(here == key(F.get(keys, i - 1)), F.lit(False)) | F.coalesce(here == key(F.get(keys, i + 1)), F.lit(False))


def _covered(flagged: Column) -> Column:
    """Words in the 3-word windows that start at the ascending positions `flagged`."""
    steps = F.transform(flagged, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(flagged, i + 1) - p, F.lit(3)).cast("int")))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def text_measures(docs: DataFrame, key: list[str]) -> DataFrame:
    """`key` columns with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text.

    n_repeat_words sorts the hashes of a text's 3-word windows, one row at a time: hash bits and position share a
    long, so the sort is over primitives; neighbours are confirmed on the full 64-bit hashes. Texts in which two
    different windows share the hash bits, or that are too long for them, sort (hash, position) pairs instead.
    Null and empty texts measure 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = F.lit((1 << POS_BITS) - 1).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*key, text.alias("_t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    df = df.select(
        *key,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_t"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_x"),
        F.split("_t", "\n", -1).alias("_l"),
    )
    lines = F.filter(F.col("_l"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *key,
        "n_words",
        "word_chars",
        "n_symbols",
        F.when(F.size("_l") < 2, F.lit(0)).otherwise(F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(
            F.col("n_words") > 3,
            F.transform(F.slice("_x", F.lit(1), F.size("_x") - 2), lambda a, i: F.xxhash64(a, F.get("_x", i + 1), F.get("_x", i + 2))),
        ).alias("_g"),
    )
    short = F.size("_g") <= (1 << POS_BITS)
    packed = F.sort_array(F.transform("_g", lambda h, i: h.bitwiseAND(F.lit(-(1 << POS_BITS)).cast("long")).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.when(short, packed)))
    high = lambda c: F.shiftright(c, POS_BITS)
    pos = lambda c: c.bitwiseAND(mask).cast("int")
    full = lambda c: F.get("_g", pos(c))
    near = F.filter("_p", lambda x, i: _adjacent(F.col("_p"), i, None, high))
    df = df.withColumn("_q", near)
    clash = F.exists(
        F.transform("_q", lambda x, i: (high(x) == high(F.get("_q", i + 1))) & (full(x) != full(F.get("_q", i + 1)))),
        lambda b: F.coalesce(b, F.lit(False)),
    )
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(some & (~short | F.coalesce(clash, F.lit(False))), pairs))
    plain = F.transform(F.filter("_s", lambda x, i: _adjacent(F.col("_s"), i, None, lambda c: c["h"])), lambda x: x["i"])
    flagged = F.when(F.col("_s").isNotNull(), plain).otherwise(F.transform("_q", pos))
    df = df.withColumn("_f", F.sort_array(F.coalesce(flagged, F.array().cast("array<int>"))))
    return df.select(*key, "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("_f")).alias("n_repeat_words"))


def base_failed() -> Column:
    """The document's own rules: under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def host_verdicts(measured: DataFrame, host: str, max_rate: float = 0.5) -> DataFrame:
    """(host, n, failed, rate, host_failed) for every host that is not null.

    A host's failure rate is shrunk towards all hosts' by a beta prior fitted to their rates by moments (mean m
    and variance v over hosts weighted by documents; strength m(1-m)/v - 1, held between 1 and 1,000), so that a
    host of few documents is judged mostly by the prior. A host fails when its shrunk rate is above `max_rate`.
    Aggregated before it is shuffled; the prior is four numbers.
    """
    hosts = stage(
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    )
    m = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff")).first()
    mean = (m["f"] or 0) / m["n"] if m["n"] else 0.0
    var = max((m["ff"] or 0.0) / m["n"] - mean * mean, 0.0) if m["n"] else 0.0
    strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1000.0) if var > 0 else 1000.0
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > F.lit(float(max_rate)))


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, host, the measures, base_failed, host_rate and kept, one row for each row of `docs`.

    kept: the document passes its own rules and its host's shrunk failure rate is at most `max_rate`. A document
    with a null host is judged by its own rules alone. Null ids and repeated rows are rows like any other.
    """
    measured = text_measures(docs.select("doc_id", F.col(host).alias("_host"), "text"), ["doc_id", "_host"])
    measured = stage(measured.withColumn("base_failed", base_failed()))
    hosts = host_verdicts(measured, "_host", max_rate)
    out = measured.join(hosts.select("host", "rate", "host_failed"), F.col("_host") == F.col("host"), "left")
    return out.select(
        "doc_id",
        F.col("_host").alias("host"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("rate").alias("host_rate"),
        (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
    )


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, its source as host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT rid, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
h AS (SELECT rid, n, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
p AS (SELECT rid, count(DISTINCT j) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (rid) LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT sum(f) / sum(n) AS mean, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2, 0) AS var FROM s),
k AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1), 1000) ELSE 1000 END AS strength FROM q),
v AS (SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS host_failed FROM s, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM b LEFT JOIN v USING (source)"""
