"""Readers of landed source files; each gives a DataFrame and reads nothing on the driver."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of the binary kinds that are let in.
MAGIC = {"pdf": "25504446", "jpeg": "FFD8FF", "png": "89504E47", "zip": "504B0304"}


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON array each, under a declared schema: no inference pass; a broken file gives one null row in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def contract(rows: DataFrame, required: list[str]) -> DataFrame:
    """`rows` with `violations`: the required columns that are null or blank, in order; an empty list keeps the contract."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(blank(c), c) for c in required])))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published) of each item of RSS files; a date that does not parse is null (S3)."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    day = F.regexp_extract("pubDate", r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?)", 1)
    at = F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm")))
    return raw.select(F.trim("title").alias("title"), F.trim("link").alias("link"), at.alias("published"))


def main_region(html: Column) -> Column:
    """The inside of the first <main> element; null without one."""
    found = F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1)
    return F.when(html.rlike(r"(?is)<main\b[^>]*>.*?</main\s*>"), found)


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, main) of a file a page."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), main_region(F.col("value")).alias("main"))


def _members(field: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith(".json"):
                            continue
                        rows = [json.dumps(r) for r in json.loads(z.read(name))[field]]
                        for i in range(0, len(rows), 10_000):
                            yield pd.DataFrame({"path": path, "member": name, "record": rows[i : i + 10_000]})

    return run


def zipped_json(spark: SparkSession, path: str, schema: str, field: str = "results") -> DataFrame:
    """Rows of the array `field` of each JSON member of zip exports, one task a zip; (path, member, columns)."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members(field), "path string, member string, record string")
    return raw.select("path", "member", F.from_json("record", schema).alias("r")).select("path", "member", "r.*")


def paged_json(spark: SparkSession, path: str, schema: str, key: str, field: str = "results") -> DataFrame:
    """One row a key of landed pages {field: [...], skip: n}: pages overlap while a source grows, and the later page holds."""
    raw = spark.read.schema(f"skip long, {field} array<struct<{schema}>>").option("multiLine", True).json(path)
    rows = raw.select("skip", F.posexplode(field).alias("at", "r")).select("skip", "at", "r.*")
    top = rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("skip", "at")]), F.struct("skip", "at")).alias("r"))
    return top.select("r.*")


def safe_binaries(spark: SparkSession, path: str, kinds: list[str], most: int) -> DataFrame:
    """(path, length, kind, verdict) of landed files: too_large, not_allowed by their first bytes, or accepted. Spark lists no empty files."""
    files = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.coalesce(*[F.when(F.startswith(head, F.lit(MAGIC[k])), k) for k in kinds])
    verdict = F.when(F.col("length") > most, "too_large").when(kind.isNull(), "not_allowed").otherwise("accepted")
    return files.select("path", "length", kind.alias("kind"), verdict.alias("verdict"))


def scan(spark: SparkSession, path: str, columns: list[str], where: str) -> DataFrame:
    """A projection and a predicate that reach the Parquet scan."""
    return spark.read.parquet(path).where(where).select(*columns)


def offline_corpus(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The items of a bundled document {schemaVersion, items: [...]}, with its version."""
    doc = spark.read.schema(f"schemaVersion int, items array<struct<{item}>>").option("multiLine", True).json(path)
    return doc.select("schemaVersion", F.explode("items").alias("i")).select("schemaVersion", "i.*")


def write_plan(plan: DataFrame, path: str) -> None:
    """A plan as JSON lines; the committer makes it visible as a whole, under _SUCCESS."""
    plan.write.mode("overwrite").json(path)
