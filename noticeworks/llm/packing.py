"""Packing tokenised documents into fixed-length sequences by length patterns."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import ranked, stage

LENGTH = 1024
#: Ends every document.
END_ID = 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks; gives the same ids for ordinary text, about five times as fast.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = "<|endoftext|>"


def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS):
    """A function from text to its ids (uint32), without special tokens added.

    Text that spells the special token goes to the tokenizer of `vocabulary` itself, as does all text when `ranks`
    is empty.
    """
    import tiktoken
    from tokenizers import Tokenizer

    full = None
    fast = None
    if ranks:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        nonlocal full
        if fast is not None and SPECIAL not in text:
            return fast.encode_to_numpy(text, disallowed_special=())
        full = full or Tokenizer.from_file(vocabulary)
        return np.array(full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def _pieces(length: int, vocabulary: str, ranks: str, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, ranks)
        for pdf in batches:
            out: list[tuple] = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(encode(text if isinstance(text, str) else ""), np.uint32(END_ID)).astype("<u4")
                at, stop = 0, (len(ids) - 1) % length + 1
                for piece in range((len(ids) - 1) // length + 1):
                    raw = ids[at:stop].tobytes()
                    out.append((doc, piece, at, stop - at, zlib.crc32(raw), raw if with_ids else None))
                    at, stop = stop, stop + length
                if len(out) > 5000:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})


def patterns(present: np.ndarray, length: int) -> np.ndarray:
    """All a >= b >= c >= 0 of `present` lengths (0: none) with a + b + c = `length`."""
    ok = np.zeros(length + 1, dtype=bool)
    ok[0] = True
    ok[present] = True
    a, b = np.meshgrid(np.flatnonzero(ok), np.flatnonzero(ok), indexing="ij")
    c = length - a - b
    keep = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[keep], b[keep], c[keep]
    keep = ok[c]
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def fit(hist: np.ndarray, pats: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeats x >= 0 of the patterns whose lengths come nearest to the histogram in least squares.

    Accelerated projected gradient. A miss of a length weighs by that length over the root of its count: rare
    lengths are met as well as common ones, and long pieces, which need partners, before short ones.
    """
    n = len(hist)
    weight = np.zeros(n)
    weight[1:] = np.arange(1, n) / np.sqrt(np.maximum(hist[1:], 1)) / n
    target = hist * weight
    flat = pats.ravel()
    w = weight[pats]

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=(x[:, None] * w).ravel(), minlength=n)

    def back(y: np.ndarray) -> np.ndarray:
        return (y[pats] * w).sum(axis=1)

    v = np.ones(len(pats))
    norm = 1.0
    for _ in range(20):
        v = back(forward(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(forward(y) - target) / norm, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def best_fit(hist: np.ndarray, length: int) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) by best-fit decreasing, all pieces of one length at a time."""
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for size in range(length, 0, -1):
        left = int(hist[size])
        while left:
            r = next((r for r in range(size, length) if room.get(r)), None)
            if r is None:
                each = length // size
                for n, k in ((left // each, each), (1, left % each)):
                    if n and k:
                        room.setdefault(length - k * size, []).append((n, [size] * k))
                break
            n, held = room[r].pop()
            k = min(n, left)
            if n > k:
                room[r].append((n - k, held))
            room.setdefault(r - size, []).append((k, [*held, size]))
            left -= k
    return [g for groups in room.values() for g in groups]


def plan(hist: np.ndarray, length: int = LENGTH, shares: tuple[float, ...] = (1.0, 0.5)) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) of sequences that hold exactly the pieces of `hist` (count by length, 0 unused).

    Patterns of up to three pieces that fill a sequence are fitted to the histogram. Their repeats are rounded
    down, whole or after scaling by each of `shares`, and taken as far as pieces are left; the residual pieces go
    by best fit, longest first. The rounding that gives the fewest sequences stays. Works on counts: time and
    memory depend on `length` alone.
    """
    rest = hist.astype(np.int64).copy()
    whole: list[tuple[int, list[int]]] = []
    if rest[length]:
        whole.append((int(rest[length]), [length]))
        rest[length] = 0
    pats = patterns(np.flatnonzero(rest), length)
    fitted = fit(rest, pats) if len(pats) else np.zeros(0)
    best: list[tuple[int, list[int]]] | None = None
    for share in shares:
        left, out = rest.copy(), []
        repeats = np.floor(fitted * share + 1e-9).astype(np.int64)
        for p in np.argsort(-repeats, kind="stable")[: int((repeats > 0).sum())]:
            need = [int(v) for v in pats[p] if v]
            k = min(int(repeats[p]), *(int(left[v]) // need.count(v) for v in need))
            if k > 0:
                out.append((k, need))
                for v in need:
                    left[v] -= k
        out += best_fit(left, length)
        if best is None or sum(k for k, _ in out) < sum(k for k, _ in best):
            best = out
    return whole + (best or [])


def _slots(packed: list[tuple[int, list[int]]], length: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(length + 1, dtype=np.int64)
    base = 0
    for repeats, lengths in packed:
        at = 0
        for v in lengths:
            runs.setdefault(v, []).append((int(used[v]), base, at))
            used[v] += repeats
            at += v
        base += repeats
    return {v: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for v, r in runs.items()}


def _place(slots: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["_rank"].to_numpy() - 1
            for v in np.unique(lengths):
                at = np.flatnonzero(lengths == v)
                first, base, off = slots[int(v)]
                k = np.searchsorted(first, ranks[at], side="right") - 1
                sequence[at], offset[at] = base[k] + ranks[at] - first[k], off[k]
            yield pdf.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of `docs` (doc_id, text).

    A document is its ids and the end id. A document longer than `length` is cut from its end into pieces of
    `length`, so that its first piece may be shorter. Pieces are tokenised once and staged; their histogram, at
    most `length` numbers, is all that the driver sees. It plans patterns of lengths; pieces of a length take the
    places of that length by their rank in (doc_id, piece), found without a single task.

    Null text is empty: one piece of the end id. Null ids and repeated rows are documents like any other. An empty
    table gives no rows. `with_ids` adds the ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_pieces(length, vocabulary, ranks, with_ids), schema)
    pieces = stage(pieces if with_ids else pieces.drop("ids"))
    hist = np.zeros(length + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        hist[r["length"]] = r["count"]
    order = [F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("ids_crc32")]
    laid = ranked(pieces, ["length"], order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return laid.mapInPandas(_place(_slots(plan(hist, length), length)), schema)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
