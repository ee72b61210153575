"""Removing repeated word sequences, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from noticeworks.llm.common import few, small_batches, stage
from noticeworks.llm.hashing import Powers, U, Words, as_bytes, chunks, mix, salts
from noticeworks.llm.repeats import PACKED, Sender, among, gathered, key_set, repeated

WINDOW = 35
C = salts(4, 101)


@dataclass
class Parsed:
    """The windows of some texts as recompression sees them.

    starts: their first words; which: the anchor of each; text, key: text and name of each anchor; names: the names
    of the windows (empty unless asked for).
    """

    starts: np.ndarray
    which: np.ndarray
    text: np.ndarray
    key: np.ndarray
    names: np.ndarray

    def named(self, starts: np.ndarray) -> np.ndarray:
        """The names of the windows that begin at `starts`."""
        return self.names[np.searchsorted(self.starts, starts)]


def parse(w: Words, width: int, named: bool = False) -> Parsed:
    """Recompression of some texts, with what each window of `width` words of one text keeps of it.

    Symbols are words at first. A round names maximal runs of one word; the rounds after it name pairs: every
    symbol's own name makes it a left or a right one, and a left symbol followed by a right one becomes a pair. A
    name is a hash of what it stands for, so equal content has one name in all tasks, everywhere, without a
    dictionary. For each window the rounds keep the symbols that its own words decide: a run, a right symbol at its
    left end and a left symbol at its right end might join with what lies outside, and are popped. Equal windows
    keep equal symbols and pop equal ones. What a window holds before the round that leaves nothing, one or two
    symbols of a high level, is its anchor; the popped symbols, in order, and the anchor spell its words, and their
    names make the name of the window.
    """
    n, docs = len(w.hashes), len(w.first) - 1
    doc = np.repeat(np.arange(docs), np.diff(w.first))
    starts = np.arange(n)
    starts = starts[starts + width <= w.first[doc + 1]] if n else starts
    code = np.zeros(len(starts), dtype=np.int64)
    key = np.zeros(len(starts), dtype=U)
    if not len(starts):
        return Parsed(starts, code, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U), key)
    symbols = w.hashes
    new = np.ones(n, dtype=bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    symbol = np.cumsum(new) - 1
    length = np.diff(np.append(at, n)).astype(U)
    left, right = symbol[starts] + 1, symbol[starts + width - 1]
    spelt = np.zeros(len(starts), dtype=U)
    if named:
        begins = np.append(at, n)
        inside = np.minimum(begins[left], starts + width) - starts  # of the first run
        last = starts + width - np.maximum(begins[right], starts)
        spelt = mix(mix(w.hashes[starts] * C[0] + inside.astype(U)) * C[1] + w.hashes[starts + width - 1] * C[2] + last.astype(U))
    dead = left >= right
    code[dead] = starts[dead]
    key[dead] = mix(w.hashes[starts[dead]] * C[0] + w.hashes[starts[dead] + width - 1] * C[1])
    alive = np.flatnonzero(~dead)
    left, right = left[alive], right[alive]
    symbols, doc_of = np.where(length > 1, mix(symbols[at] * C[0] + length), symbols[at]), doc[at]
    level = 0
    while len(alive):
        level += 1
        side = (mix(symbols + U(level)) & U(1)).astype(bool)
        l2, r2 = left + side[left], right - ~side[right - 1]
        dead = l2 >= r2
        a, b = left[dead], right[dead]
        where = alive[dead]
        code[where] = (level << 48) | (a << 1) | (b - a - 1)
        key[where] = mix(symbols[a] * C[2] + symbols[b - 1] * C[3] * (b - a > 1).astype(U) + U(level))
        if named:
            spelt[where] = mix(spelt[where] * C[3] + key[where])
            for popped, name, c in ((~dead & (l2 > left), symbols[left], C[1]), (~dead & (r2 < right), symbols[right - 1], C[2])):
                to = alive[popped]
                spelt[to] = mix(spelt[to] * C[0] + name[popped] * c + U(level))
        pair = np.zeros(len(symbols), dtype=bool)
        pair[:-1] = ~side[:-1] & side[1:] & (doc_of[1:] == doc_of[:-1])
        new = np.ones(len(symbols), dtype=bool)
        new[1:] = ~pair[:-1]
        at = np.flatnonzero(new)
        symbol = np.cumsum(new) - 1
        joined = pair[at]
        following = symbols[np.minimum(at + 1, len(symbols) - 1)]
        symbols, doc_of = np.where(joined, mix(symbols[at] * C[0] + following * C[1] + U(level)), symbols[at]), doc_of[at]
        alive = alive[~dead]
        left, right = symbol[l2[~dead]], symbol[r2[~dead] - 1] + 1
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return Parsed(starts, which, doc[starts[first]], key[first], spelt)


def window_checks(w: Words, starts: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hashes of the words of the windows of `width` words that begin at `starts`, apart from their names."""
    powers.upto(len(w.hashes))
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(w.hashes * powers.up[: len(w.hashes)], dtype=U)])
    return mix((sums[starts + width] - sums[starts]) * powers.down[starts])


def _send_anchors(width: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, out = Powers(), Sender(buckets)
        for pdf in batches:
            texts, ids = [as_bytes(t) for t in pdf["text"]], pdf["id"].to_numpy()
            for i, j in chunks(texts):
                p = parse(Words(texts[i:j], powers), width)
                yield from out.add(ids[i:j][p.text], p.key)
        yield from out.flush()

    return run


def _digest(t: bytes) -> str:
    return hashlib.sha256(b" ".join(t.split())).hexdigest()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    """The UTF-8 of each text; null has none."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _candidates(width: int, with_text: bool, carry: list[str]):
    """Texts that have a repeated anchor, with the starts of the windows that hold one, as ranges; the others are finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts, wanted = _texts(batch), batch.column("keys").to_pylist()
            for i, j in chunks(texts):
                some = [k for k in range(i, j) if wanted[k]]
                ranges: list = [None] * (j - i)
                if some:
                    w = Words([texts[k] for k in some], powers)
                    p = parse(w, width)
                    hit = np.zeros(len(p.key), dtype=bool)
                    for t, k in enumerate(some):
                        own = p.text == t
                        hit[own] = among(p.key[own], key_set(wanted[k]))
                    starts = p.starts[hit[p.which]]
                    for t, (k, s) in enumerate(zip(some, np.split(starts, np.searchsorted(starts, w.first[1:-1])), strict=True)):
                        if len(s):
                            s = s - w.first[t]
                            cut = np.flatnonzero(np.diff(s) > 1)
                            ranges[k - i] = np.stack([s[np.append(0, cut + 1)], s[np.append(cut, len(s) - 1)]], axis=1).tobytes()
                done = np.array([x is None for x in ranges])
                part = batch.slice(i, j - i)
                kind = part.column("text").type
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ["id", "doc_id", *carry]),
                        part.column("text") if with_text else pa.array([None if d else t for d, t in zip(done, texts[i:j], strict=True)], pa.binary()).cast(kind),
                        pa.array(ranges, pa.binary()),
                        pa.array([len(t.split()) for t in texts[i:j]], pa.int64()),
                        pa.array([_digest(t) if d else None for d, t in zip(done, texts[i:j], strict=True)], pa.string()),
                    ],
                    names=["id", "doc_id", *carry, "text", "ranges", "n_words", "kept_sha256"],
                )

    return run


def _named(texts: list[bytes], ranges: list[bytes], width: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(text, start, name, check) of the candidate windows of some texts, given as ranges of starts in each."""
    w = Words(texts, powers)
    at = [np.frombuffer(r, dtype=np.int64).reshape(-1, 2) for r in ranges]
    text = np.repeat(np.arange(len(at)), [int((a[:, 1] - a[:, 0] + 1).sum()) for a in at])
    starts = np.concatenate([np.empty(0, dtype=np.int64), *(np.arange(a, b + 1) for x in at for a, b in x.tolist())])
    base = starts + w.first[text]
    return text, starts, parse(w, width, named=True).named(base), window_checks(w, base, width, powers)


def _send_windows(width: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, out = Powers(), Sender(buckets)
        for pdf in batches:
            texts, ids, ranges = [as_bytes(t) for t in pdf["text"]], pdf["id"].to_numpy(), list(pdf["ranges"])
            for i, j in chunks(texts):
                text, _, names, checks = _named(texts[i:j], ranges[i:j], width, powers)
                yield from out.add(ids[i:j][text], names, checks)
        yield from out.flush()

    return run


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for some start."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def _remove(width: int, with_text: bool, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out = []
            texts, ranges, keys = _texts(batch), batch.column("ranges").to_pylist(), batch.column("keys").to_pylist()
            for i, j in chunks(texts):
                text, starts, names, _ = _named(texts[i:j], ranges[i:j], width, powers)
                cut = np.searchsorted(text, np.arange(j - i + 1))
                for k, t in enumerate(texts[i:j]):
                    words, part = t.split(), slice(cut[k], cut[k + 1])
                    gone = covered(starts[part][among(names[part], key_set(keys[i + k]))], width, len(words))
                    if gone.any():
                        kept = b" ".join(x for x, g in zip(words, gone, strict=True) if not g)
                        out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
                    else:
                        out.append((len(words), 0, _digest(t), None))
            n, removed, digest, kept = zip(*out, strict=True) if out else ((), (), (), ())
            kind = batch.column("text").type
            text = pa.array([t if k is None else k for k, t in zip(kept, texts, strict=True)], pa.binary()).cast(kind) if with_text else pa.nulls(len(out), kind)
            found = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *carry]), *found], names=["doc_id", *carry, "n_words", "n_removed", "kept_sha256", "text"])

    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, n_words, n_removed, kept_sha256[, text]) for each row of `docs` (doc_id, text).

    A word goes if a window of `width` consecutive words that covers it starts anywhere else too, in the same
    document included; windows are those of the input. With `with_text` the text is what stays: the text itself
    if nothing went, else the kept words joined by one space. `carry` names further columns to keep.

    1. Every window has an anchor of high-level symbols from recompression (see `parse`), about one for eight words.
       A Spark round tells which anchors occur twice anywhere.
    2. A second round does so for the windows that hold such an anchor, each by its name, which spells the window in
       symbols, and a check of its words, 128 bits in all.
    3. Words covered by repeated windows go. Texts without a repeated anchor are finished after step 1; if the others are few
       (see `few`), their keys are broadcast and only their texts are shuffled.

    Rows are known by a 64-bit hash of id and text, so that null ids, repeated rows (each an occurrence of its
    windows) and one id on several texts are kept apart. Null, empty or short texts have no window and stay as they
    are (null text: no words, text null). Carried columns may have any name and nulls. An empty table gives no rows.
    A text is parsed whole: about 100 bytes a word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = [f"_own_{k}" for k in range(len(carry))]
    docs = docs.select(F.xxhash64("doc_id", "text").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, own, strict=True)], F.col("text").cast("string").alias("text"))
    base = [StructField(f.name, f.dataType) for f in docs.schema]
    more = lambda **kinds: [StructField(k, t()) for k, t in kinds.items()]
    names = stage(gathered(repeated(docs.select("id", "text").mapInPandas(_send_anchors(width, 4 * n), PACKED), n), n))
    fields = StructType([*base, *more(ranges=BinaryType, n_words=LongType, kept_sha256=StringType)])
    find = lambda rows: rows.mapInArrow(_candidates(width, with_text, own), fields)
    if few(names):  # only texts with a repeated anchor are shuffled and staged
        ids = F.broadcast(names.select("id"))
        seen = stage(find(docs.join(ids, "id", "left_semi").join(names, "id")))
        plain = find(docs.join(ids, "id", "left_anti").withColumn("keys", F.lit(None).cast("binary")))
    else:
        seen = stage(find(docs.join(names, "id", "left")))
        plain = seen.where("false")
    open_ = seen.where("ranges is not null")
    # staged, so that the shuffle of the windows is gone before the texts are shuffled again
    again = stage(gathered(repeated(open_.select("id", "text", "ranges").mapInPandas(_send_windows(width, 4 * n), PACKED), n), n))
    fields = StructType([*base[1:-1], *more(n_words=LongType, n_removed=LongType, kept_sha256=StringType, text=StringType)])
    cut = open_.select("id", "doc_id", *own, "text", "ranges").join(again, "id", "left").mapInArrow(_remove(width, with_text, own), fields)
    rest = seen.where("ranges is null").union(plain).select("doc_id", *own, "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "text")
    out = cut.union(rest)
    out = out.select("doc_id", *[F.col(k).alias(c) for c, k in zip(carry, own, strict=True)], "n_words", "n_removed", "kept_sha256", "text")
    return out if with_text else out.drop("text")


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    """Words removed from every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
