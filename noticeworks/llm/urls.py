"""URL rules by a sort-merge range join over reversed hosts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule is (verdict, host, path prefix); a rule's name is its host and path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends each label of a reversed host, so that a host's subdomains are one interval of keys.
END = "\x01"
#: Above END: the end of a host's interval.
AFTER = "\x02"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end; then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by END: the key of a host is a prefix of the keys of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), END), F.lit(END))


def _buckets(bounds: list[str]):
    """Rows of (key, hi) to buckets: a page (hi null) to one, a rule to each that its interval meets."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = [bisect_right(bounds, k) for k in pdf["key"]]
            last = [a if h is None else max(a, bisect_left(bounds, h)) for a, h in zip(first, pdf["hi"], strict=True)]
            pdf["bucket"] = [list(range(a, b + 1)) for a, b in zip(first, last, strict=True)]
            yield pdf

    return place


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition in the order (bucket, key, rules first) to verdicts of pages.

    The stack holds the rules of the hosts that enclose the current key, one frame for each host: its key, and
    its rules by path. Memory is the nested rules of one host.
    """
    stack: list[tuple[str, dict[str, tuple[str, str]]]] = []
    bucket = -1
    for pdf in batches:
        out = []
        for b, key, page, host, path, rule, verdict in zip(
            pdf["bucket"], pdf["key"], pdf["page_id"], pdf["host"], pdf["path"], pdf["rule"], pdf["verdict"], strict=True
        ):
            if b != bucket:
                stack, bucket = [], b
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                best = stack[-1][1].get(path)
                if best is None or best[1] > verdict:  # the same rule twice: allow before block
                    stack[-1][1][path] = (rule, verdict)
                continue
            found = None
            for _, rules in stack:
                for n in {len(p) for p in rules}:
                    hit = rules.get(path[:n]) if n <= len(path) else None
                    if hit and (found is None or len(hit[0]) >= len(found[0])):
                        found = hit
            out.append((None if pd.isna(page) else int(page), host, path, found and found[0], found and found[1]))
        yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": "Int64"})


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", sample_rows: int = 20_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages` (page_id, url).

    `rules` has verdict, host and path; a rule fits its host and all subdomains when the page's path starts with
    its path. The longest rule (host and path) wins, the deeper host on a tie; no rule: null and `default`.

    Keys are reversed hosts, so a rule is an interval of keys. Splitters from a sample of at most about
    `sample_rows` distinct-host keys and page hashes cut the key line into buckets; a page goes to one bucket, a
    rule to each that its interval meets. Each bucket is sorted and swept once with a stack. A host with a large
    part of all pages is cut by a hash behind its key, so no bucket depends on one host.

    Null url or one without `://`: empty host and path, no rule. Repeated pages and null ids stay as they are.
    """
    host, path = url_parts(F.col("url"))
    spark = pages.sparkSession
    at = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    spread = F.lpad(F.hex(F.xxhash64("page_id", "path")), 16, "0")
    at = at.withColumn("key", F.concat(host_key(F.col("host")), F.lit(END), spread))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = at.count()
    share = min(1.0, sample_rows / max(total, 1))
    low = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    sample = sorted(r[0] for r in at.where(low).select("key").collect())
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    named = rules.select(
        F.lit(None).cast("long").alias("page_id"),
        F.translate("host", UPPER, LOWER).alias("host"),
        "path",
        host_key(F.translate("host", UPPER, LOWER)).alias("key"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    named = named.withColumn("hi", F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit(AFTER)))
    named = named.select("page_id", "host", "path", "key", "hi", "rule", "verdict")
    none = F.lit(None).cast("string")
    both = at.select("page_id", "host", "path", "key", none.alias("hi"), none.alias("rule"), none.alias("verdict")).unionByName(named)
    schema = "page_id long, host string, path string, key string, hi string, rule string, verdict string, bucket array<int>"
    laid = both.mapInPandas(_buckets(bounds), schema).withColumn("bucket", F.explode("bucket"))
    laid = laid.repartition(n, "bucket").sortWithinPartitions("bucket", "key", F.col("rule").isNull())
    out = laid.mapInPandas(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op9_urls(spark, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page."""
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
j AS (
  SELECT p.*, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM (SELECT DISTINCT * FROM p) p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p JOIN j ON p.page_id IS NOT DISTINCT FROM j.page_id AND p.host = j.host AND p.path = j.path AND k = 1"""
