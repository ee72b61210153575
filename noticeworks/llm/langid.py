"""Language identification by the nearest of several centroids a language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from noticeworks.llm.common import small_batches, stage

UND = "und"
#: Two-byte grams take the first buckets, three-byte grams the others.
PAIRS, SIZE = 2048, 8192
#: Rows learned from for each language, at most about; the sample is drawn by hash.
PER_LANG = 400
CENTROIDS = 4
#: Bytes of the spans cut from sampled rows, by which the distance of short texts is learned, and the share of rows.
CUTS = tuple(1 << k for k in range(2, 12))
CUT_SHARE = 4
LETTER = re.compile(r"[A-Za-z]")

#: ASCII that is not a letter reads as a space; other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 0x20
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def has_letter(text) -> bool:
    """Whether a text holds any Unicode letter."""
    return isinstance(text, str) and (LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(texts: list[str], size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Counts (texts, SIZE) of hashed byte n-grams of the lower-cased whole texts, some texts at a time."""
    held: list[bytes] = []
    total = 0
    for t in texts:
        held.append(t.lower().encode("utf-8", "surrogatepass"))
        total += len(held[-1])
        if total > size or len(held) == 200:
            yield _counts(held)
            held, total = [], 0
    if held:
        yield _counts(held)


def _counts(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    data = FOLD[np.frombuffer(b"  ".join([b"", *texts, b"", b""]), dtype=np.uint8)]
    doc = np.repeat(np.arange(n), [len(t) + 2 for t in texts])
    b = data.astype(np.uint32)
    gap = data == 0x20
    m = len(doc)
    one, two, three = b[1 : m + 1], b[2 : m + 2], b[3 : m + 3]
    ok = ~(gap[1 : m + 1] & gap[2 : m + 2])
    pair = ((one << np.uint32(8) | two) * np.uint32(2654435761)) >> np.uint32(21)
    key = (doc * SIZE + pair)[ok]
    ok &= ~(gap[2 : m + 2] & gap[3 : m + 3])
    tri = ((one << np.uint32(16) | two << np.uint32(8) | three) * np.uint32(2654435761)) >> np.uint32(10)
    key = np.concatenate([key, (doc * SIZE + PAIRS + tri % np.uint32(SIZE - PAIRS))[ok]])
    return np.bincount(key, minlength=n * SIZE).reshape(n, SIZE)


@dataclass
class Model:
    """Unit centroids (rows), the language of each, inverse document frequencies, and the rejection distance by length.

    A text of 2**sizes[i] n-grams with a cosine below least[i] is too far; between sizes the bound is interpolated.
    """

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    sizes: np.ndarray
    least: np.ndarray

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the nearest centroid, cosine, too far) for each row of counts."""
        x = counts.astype(np.float32) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, dtype=np.float64))
        cos = (x @ self.centroids.T) / np.maximum(norm, 1e-12)[:, None]
        at = cos.argmax(axis=1)
        best = np.clip(cos[np.arange(len(at)), at], 0.0, 1.0)
        bound = np.interp(np.log2(np.maximum(counts.sum(axis=1), 1)), self.sizes, self.least)
        return at, best, best < bound


def bounds(n: np.ndarray, cos: np.ndarray, share: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, least): for texts of known language with `n` n-grams and cosine `cos`, what all but a `share` of each
    size class (a doubling of n) reach, times `margin`; longer texts never get a lower bound than shorter ones.

    Classes too small to show that share have no bound of their own; if all are, one bound holds for all sizes."""
    kind = np.log2(np.maximum(n, 1)).round().astype(np.int64)
    sizes, rows = np.unique(kind, return_counts=True)
    sizes = sizes[rows * share >= 0.5]
    if not len(sizes):
        return np.zeros(1), np.array([margin * cos.min()]) if len(cos) else np.zeros(1)
    least = np.array([np.quantile(cos[kind == k], share, method="lower") for k in sizes])
    return sizes.astype(np.float64), np.minimum.accumulate(least[::-1])[::-1] * margin


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _cuts(text: str) -> list[str]:
    """Spans of a text of about each of CUTS bytes that are shorter than it, from word starts all over it."""
    found = []
    for k, size in enumerate(CUTS):
        if size >= len(text):
            break
        at = text.rfind(" ", 0, (len(text) - size) * (2 * k + 1) // (2 * len(CUTS)) + 1) + 1
        found.append(text[at : at + size])
    return found


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sampled rows, and spans of some of them, as sparse counts; at the end in how many of the task's rows each bucket occurs."""

    def sparse(lang: list[str], counts: list[np.ndarray], whole: bool) -> pd.DataFrame:
        none = [None] * len(lang)
        return pd.DataFrame(
            {
                "lang": lang,
                "whole": [whole] * len(lang),
                "at": [np.flatnonzero(c).astype(np.int32).tobytes() for c in counts],
                "n": [c[c > 0].astype(np.int32).tobytes() for c in counts],
                "bucket": pd.array(none, dtype="Int32"),
                "df": pd.array(none, dtype="Int64"),
            }
        )

    df, n = np.zeros(SIZE, dtype=np.int64), 0
    for pdf in batches:
        at = 0
        for counts in grams(list(pdf["text"])):
            df += (counts > 0).sum(axis=0)
            n += len(counts)
            part = pdf.iloc[at : at + len(counts)]
            at += len(counts)
            rows = [(lang, c) for lang, pick, c in zip(part["lang"], part["pick"], counts, strict=True) if pick]
            if rows:
                yield sparse([lang for lang, _ in rows], [c for _, c in rows], True)
        for lang, text in zip(pdf["lang"][pdf["cut"]], pdf["text"][pdf["cut"]], strict=True):
            spans = [x for x in _cuts(text) if has_letter(x)]
            if spans:
                yield sparse([lang] * len(spans), [c for part in grams(spans) for c in part], False)
    seen = np.append(np.flatnonzero(df), SIZE)
    none = [None] * len(seen)
    yield pd.DataFrame({"lang": none, "whole": none, "at": none, "n": none, "bucket": seen.astype(np.int32), "df": np.append(df[seen[:-1]], n)})


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means, started from rows far from each other."""
    first = x.sum(axis=0)
    picks = [int((x @ first).argmax())]
    while len(picks) < min(k, len(x)):
        picks.append(int((x @ x[picks].T).max(axis=1).argmin()))
    c = x[picks]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return np.vstack([c, first / max(float(np.linalg.norm(first)), 1e-12)]).astype(np.float32)


def fit(docs: DataFrame, per_lang: int = PER_LANG, k: int = CENTROIDS, share: float = 0.01, margin: float = 0.8) -> Model | None:
    """A model from the text and lang of the rows of `docs` that are not held out; None without any such row.

    The document frequencies are of all those rows. The centroids are of a sample by hash of about `per_lang` rows
    for each language (the documented bound: so many sparse count vectors of at most 8,192 entries reach the
    driver): `k` clusters and the mean. The rejection distance depends on a text's number of n-grams, since short
    texts are far from everything: it is learned from the sampled rows and from spans of a quarter of them (see
    `bounds`).
    """
    small_batches(docs.sparkSession)
    train = docs.where("lang is not null and text is not null").where(~held_out())
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return None
    h = F.xxhash64("doc_id", "text")
    u = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    spark = docs.sparkSession
    rates = spark.createDataFrame([(g, min(1.0, per_lang / n)) for g, n in counts.items()], "lang string, rate double")
    pick = u < F.col("rate")
    picked = train.join(F.broadcast(rates), "lang").select("text", "lang", pick.alias("pick"), (pick & (F.pmod(F.shiftright(h, 32), F.lit(CUT_SHARE)) == 0)).alias("cut"))
    learned = stage(picked.mapInPandas(_learn, "lang string, whole boolean, at binary, n binary, bucket int, df long"))
    df = np.zeros(SIZE + 1)
    for r in learned.where("bucket is not null").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"]] = r["df"]
    idf = (np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1).astype(np.float32)
    rows: dict[str, list[np.ndarray]] = {}
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for r in learned.where("lang is not null").collect():
        at, n = np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["n"], dtype=np.int32)
        if len(at):
            seen.append((at, n))
            if r["whole"]:
                x = np.zeros(SIZE, dtype=np.float32)
                x[at] = n * idf[at]
                rows.setdefault(r["lang"], []).append(x / np.linalg.norm(x))
    langs: list[str] = []
    parts = []
    for lang in sorted(rows):
        parts.append(_cluster(np.stack(rows[lang]), k))
        langs += [lang] * len(parts[-1])
    if not parts:
        return None
    centroids = np.vstack(parts)
    cos = [float((centroids[:, at] @ (n * idf[at])).max() / np.linalg.norm(n * idf[at])) for at, n in seen]
    return Model(langs, centroids, idf, *bounds(np.array([n.sum() for _, n in seen]), np.array(cos), share, margin))


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """`keep` columns of `docs` with lang_pred, score (cosine to the nearest centroid) and rejected.

    Whole texts are compared. Null text or text without a letter: `und`, score 0, rejected. A text that is farther
    from every centroid than the model's rejection distance for its length is rejected too, and keeps its nearest
    language. Without a model (nothing to learn from) all is `und`. Only text is an input of a prediction; kept
    columns pass unchanged, whatever their names, types and nulls. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    parts = None if model is None else (model.langs, model.centroids, model.idf, model.sizes, model.least)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    own = [f"_own_{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            ok = np.array([m is not None and has_letter(t) for t in texts], dtype=bool)
            at, cos, far = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            if ok.any():
                scored = [m.score(c) for c in grams([t for t, o in zip(texts, ok, strict=True) if o])]
                at[ok], cos[ok], far[ok] = (np.concatenate(c) for c in zip(*scored, strict=True))
            lang = pa.array([m.langs[a] if o else UND for a, o in zip(at, ok, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), lang, pa.array(cos), pa.array(far)], names=[*own, "lang_pred", "score", "rejected"])

    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)], F.col("text").cast("string").alias("_text"))
    fields = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return rows.mapInArrow(run, fields).select(*[F.col(o).alias(c) for c, o in zip(keep, own, strict=True)], "lang_pred", "score", "rejected")


def select_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs` whose language is identified, all their columns as they are."""
    found = identify(docs, model, docs.columns)
    at = range(len(docs.columns))  # by place: a column of docs may be named like an output
    return found.toDF(*[f"_c{k}" for k in at], "_lang", "_score", "_rejected").where("not _rejected").select(*[F.col(f"_c{k}").alias(c) for k, c in zip(at, docs.columns, strict=True)])


def op4_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document; null ids are learned from and judged like others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out())
    model = fit(docs)
    return identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")
