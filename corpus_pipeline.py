"""A training corpus from `documents`: language, near duplicates, repeated passages, mixture, sequences.

Each stage takes (spark, docs, sf_dir), works on every row it is given and is written as Parquet before the next.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import langid, minhash, mixing, packing, recompress
from noticeworks.llm.common import drop_stage, stage, staging

#: Tables that the last stage staged for its result.
_LEFT: list[DataFrame] = []


def _tidy(f):
    """A stage that begins by deleting what the one before it staged: its result has been written by then, as `docs` is read from there."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stage(*_LEFT)
        with staging() as made:
            out = f(spark, docs, sf_dir)
        _LEFT[:] = made
        return out

    return run_stage


@_tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified: those without a letter (null and empty texts too), or farther from every language than texts of their length are, go.

    Repeated rows are judged alike; other columns pass unchanged.
    """
    return langid.select_known(docs, langid.fit(docs.select("doc_id", "text", "lang")))


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more).

    Null ids and repeated ids are documents of their own; null, empty and blank texts stay. See `one_of_each`.
    """
    return minhash.one_of_each(docs, percent=80).select(*docs.columns)


@_tidy
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of repeated 35-word windows; n_chars follows the text.

    Null, empty and short texts stay as they are (n_chars of a null text is null), very long ones are read whole;
    repeated rows are occurrences like others, so they lose their windows; other columns pass unchanged.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = recompress.remove_repeats(docs, with_text=True, carry=others)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_tidy
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them.

    A null source is a source of its own; texts without words have size 0 and are taken like others of their source;
    ties in size are broken by a seeded hash; a column named like an output of the mixture (size, source_size,
    target, copies, taken) holds that output.
    """
    return mixing.emit(mixing.mix(docs), docs.columns)


@_tidy
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1,024 tokens.

    Null and empty texts are the one end token; very long texts are cut into pieces; repeated rows are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds each of them and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES[:-1]:
        read, docs = docs, stage(f(spark, docs, sf_dir))
        drop_stage(read)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
