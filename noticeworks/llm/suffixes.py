"""Removing repeated byte strings with a sampled, range-partitioned suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import small_batches, stage
from noticeworks.llm.hashing import CHUNK, Powers, U, as_bytes, chunks, mix, prefix_hash, salts, span_hash
from noticeworks.llm.repeats import FOUND, Slots, among, by_key, gathered, key_set

WIDTH = 400
#: Leading bytes by which suffixes are compared; whole 8-byte words.
LEAD = 72
GRAM = 16
#: The splitters come from at most about so many documents and so many suffixes of each.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 2000, 8
SENT = "bucket int, known boolean, ids binary, data binary, extra binary"
FLUSH_BYTES = 1 << 24
#: Fewer rows than this are sorted by comparing all their words at once.
SMALL = 64
C = salts(3, 59)


class Points:
    """The sampled suffixes of some texts and the strings they stand for.

    Of the first `span` positions of every `width`-byte string the one with the least gram hash, the leftmost of
    equals, is its point. It depends on the string alone, so equal strings have equal points; `lead` bytes from the
    point lie inside the string. Strings with one point are a range of starts. Positions (`at`, `lo`, `hi`) count
    from the start of the text `doc`.

    A text is taken in blocks that overlap by a string less one byte, so a very long one needs no more memory; a
    point at a border may stand in two blocks, each with its own strings.
    """

    def __init__(self, texts: list[bytes], width: int, powers: Powers) -> None:
        blocks: list[tuple[int, int, bytes]] = []
        parts = []
        size = 0
        for d, t in enumerate(texts):
            for a in range(0, max(len(t) - width + 1, 0), CHUNK):
                blocks.append((d, a, t[a : a + CHUNK + width - 1]))
                size += len(blocks[-1][2])
                if size > 2 * CHUNK:
                    parts.append(self._block(blocks, width, powers))
                    blocks, size = [], 0
        parts.append(self._block(blocks, width, powers))
        self.doc, self.at, self.lo, self.hi, self.leads = (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _block(blocks: list[tuple[int, int, bytes]], width: int, powers: Powers) -> tuple[np.ndarray, ...]:
        span = width - LEAD
        none = np.empty(0, dtype=np.int64)
        if not blocks:
            return none, none, none, none, np.empty((0, LEAD // 8), dtype=U)
        data = np.frombuffer(b"".join(t for _, _, t in blocks), dtype=np.uint8)
        lens = np.array([len(t) for _, _, t in blocks])
        begin = np.cumsum(lens) - lens
        many = lens - width + 1
        which = np.repeat(np.arange(len(blocks)), many)
        starts = np.arange(len(which)) - (np.cumsum(many) - many)[which] + begin[which]
        h = prefix_hash(data, powers)
        n = len(data) - GRAM + 1
        gram = (h[GRAM:] - h[:n]) * powers.down[:n]
        gram ^= gram >> U(29)
        gram *= U(0xBF58476D1CE4E5B9)
        gram = (gram >> U(32) << U(32)) | np.arange(n, dtype=U)
        pad = -n % span
        rows = np.concatenate([gram, np.full(pad, ~U(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        point = (np.minimum(behind[starts], ahead[starts + span - 1]) & U(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(point), dtype=bool)
        new[1:] = (point[1:] != point[:-1]) | (which[1:] != which[:-1])
        cut = np.flatnonzero(new)
        at, which = point[cut], which[cut]
        doc, base = np.array([d for d, _, _ in blocks]), np.array([a for _, a, _ in blocks]) - begin
        view = np.lib.stride_tricks.sliding_window_view(data, LEAD)
        leads = np.ascontiguousarray(view[at]).view(">u8").astype(U)
        return doc[which], at + base[which], starts[cut] + base[which], starts[np.append(cut[1:], len(starts)) - 1] + base[which], leads


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, tie): the rows of `words` in order, and which of them in that order equals the one before.

    Multikey quicksort over 8-byte words: a range of rows that agree in their first words is parted in three by the
    next word of a pivot; the middle part goes on with the word after it, the others with the same one. Small
    ranges are sorted by all their remaining words at once.
    """
    m, last = words.shape
    order = np.arange(m)
    tie = np.zeros(m, dtype=bool)
    todo = [(0, m, 0)]
    while todo:
        a, b, c = todo.pop()
        if b - a < 2:
            continue
        if c == last:
            tie[a + 1 : b] = True
            continue
        rows = order[a:b]
        if b - a <= SMALL:
            by = np.lexsort(tuple(words[rows, k] for k in range(last - 1, c - 1, -1)))
            order[a:b] = rows = rows[by]
            tie[a + 1 : b] = (words[rows[1:], c:] == words[rows[:-1], c:]).all(axis=1)
            continue
        key = words[rows, c]
        some = np.sort(key[:: max(1, len(key) // 255)])
        pivot = some[len(some) // 2]
        less, more = key < pivot, key > pivot
        mid = ~(less | more)
        order[a:b] = np.concatenate([rows[less], rows[mid], rows[more]])
        x, y = a + int(less.sum()), b - int(more.sum())
        todo += [(a, x, c), (x, y, c + 1), (y, b, c)]
    return order, tie


def cuts(words: np.ndarray, splitters: np.ndarray, upto: bool = True) -> np.ndarray:
    """For each splitter the number of rows of the sorted `words` below it, or `upto` it; all words are compared."""
    out = np.empty(len(splitters), dtype=np.int64)
    for n, s in enumerate(splitters):
        a, b = 0, len(words)
        for c in range(words.shape[1]):
            col = words[a:b, c]
            a, b = a + int(np.searchsorted(col, s[c], side="left")), a + int(np.searchsorted(col, s[c], side="right"))
            if a == b:
                break
        out[n] = b if upto else a
    return out


def lead_names(words: np.ndarray) -> np.ndarray:
    """A 64-bit name of each lead."""
    out = np.zeros(len(words), dtype=U)
    for c in range(words.shape[1]):
        out = mix(out ^ words[:, c]) * U(0x9FB21C651E98DF25)
    return out


def _squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _spread(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _sampled(width: int):
    """Some leads of each text, evenly spread over its suffixes, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for pdf in batches:
            for t in pdf["text"]:
                lead = Points([as_bytes(t)], width, powers).leads
                lead = lead[:: max(1, -(-len(lead) // SAMPLE_SUFFIXES))]
                yield pd.DataFrame({"lead": [x.tobytes() for x in lead.astype(">u8")]})

    return run


def _splitters(docs: DataFrame, width: int, buckets: int) -> np.ndarray:
    """At most `buckets` - 1 leads, in order, that part the suffixes of `docs` (id, text) into ranges of about equal size.

    From a sample by hash of about SAMPLE_DOCS documents, SAMPLE_SUFFIXES leads of each (the documented bound: so
    many leads of 72 bytes reach the driver). A lead that fills several ranges is one splitter, and
    its own suffixes are dealt to both sides.
    """
    total = docs.count()
    share = int(min(1.0, SAMPLE_DOCS / max(total, 1)) * (1 << 20)) + 1
    sample = docs.where(F.pmod("id", F.lit(1 << 20)) < share).select("text").mapInPandas(_sampled(width), "lead binary")
    lead = sorted(bytes(r[0]) for r in sample.collect())
    picked = sorted({lead[k * len(lead) // buckets] for k in range(1, buckets)}) if lead else []
    return np.frombuffer(b"".join(picked), dtype=">u8").astype(U).reshape(-1, LEAD // 8)


def _send_suffixes(width: int, splitters: np.ndarray):
    """Suffixes to the buckets of their leads; those that one task has twice are known to be repeated."""
    buckets = len(splitters) + 1

    def send(held: list[tuple[np.ndarray, np.ndarray]], turn: int) -> pd.DataFrame:
        ids, words = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order, tie = multikey_quicksort(words)
        ids, words = ids[order], words[order]
        equal = tie.copy()
        equal[:-1] |= tie[1:]
        rows = []
        if equal.any():
            rows.append((turn % buckets, True, ids[equal].tobytes(), _squeeze(lead_names(words[equal]).tobytes()), b""))
        for kind, pick in ((False, ~equal), (True, equal & ~tie)):  # of a repeated lead one goes, as a mark without id
            w, i = words[pick], ids[pick]
            cut = cuts(w, splitters, turn % 2 == 0)  # one that equals a splitter goes to either side
            for b, (ww, ii) in enumerate(zip(np.split(w, cut), np.split(i, cut), strict=True)):
                if len(ww):
                    rows.append((b, False, b"" if kind else ii.tobytes(), _squeeze(ww.tobytes()), b""))
        return pd.DataFrame(rows, columns=["bucket", "known", "ids", "data", "extra"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held, size, turn = Powers(), [], 0, 0
        for pdf in batches:
            texts, ids = [as_bytes(t) for t in pdf["text"]], pdf["id"].to_numpy()
            turn = turn or int(ids[0] % 1009)
            for i, j in chunks(texts):
                p = Points(texts[i:j], width, powers)
                if len(p.at):
                    held.append((ids[i:j][p.doc], p.leads))
                    size += p.leads.nbytes
                if size > FLUSH_BYTES:
                    yield send(held, turn)
                    held, size, turn = [], 0, turn + 1
        if held:
            yield send(held, turn)

    return run


def _by_bucket(batches: Iterator[pd.DataFrame], done, known) -> Iterator[pd.DataFrame]:
    """Rows of SENT in order of bucket: known ones at once, the others of a bucket together."""
    now, rows = None, []
    for pdf in batches:
        for bucket, is_known, ids, data, extra in zip(pdf["bucket"], pdf["known"], pdf["ids"], pdf["data"], pdf["extra"], strict=True):
            if is_known:
                yield from known(ids, data)
                continue
            if bucket != now and rows:
                yield from done(rows, now)
                rows = []
            now = bucket
            rows.append((ids, data, extra))
    if rows:
        yield from done(rows, now)


EDGES = "slot int, ids binary, items binary, bucket int, place int"


def _sorted_buckets(slots: int):
    """The names of leads that occur twice, by id; and for each bucket its first and last lead (place 0 and 1), with
    the id of a suffix that is alone with it (slot 0; -1 if there are more, which are found already)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Slots(slots)

        def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(bucket=-1, place=-1)

        def done(rows: list, bucket: int) -> Iterator[pd.DataFrame]:
            words, ids, mark = [], [], []
            for i, d, _ in rows:
                w = np.frombuffer(_spread(d), dtype=U).reshape(-1, LEAD // 8)
                words.append(w)
                mark.append(np.full(len(w), not len(i)))
                ids.append(np.frombuffer(i, dtype=np.int64) if len(i) else np.zeros(len(w), dtype=np.int64))
            w, i, m = np.concatenate(words), np.concatenate(ids), np.concatenate(mark)
            order, tie = multikey_quicksort(w)
            equal = tie.copy()
            equal[:-1] |= tie[1:]
            keep = order[equal]
            keep = keep[~m[keep]]
            yield from found(out.add(i[keep], lead_names(w[keep])))
            ends = [(order[k], k) for k in (0, -1)]
            single = [not equal[k] and not m[r] for r, k in ends]
            yield pd.DataFrame(
                {
                    "slot": [0 if s else -1 for s in single],
                    "ids": [i[r].tobytes() for r, _ in ends],
                    "items": [w[r].astype(">u8").tobytes() for r, _ in ends],
                    "bucket": [bucket] * 2,
                    "place": [0, 1],
                }
            )

        def known(ids: bytes, data: bytes) -> Iterator[pd.DataFrame]:
            yield from found(out.add(np.frombuffer(ids, dtype=np.int64), np.frombuffer(_spread(data), dtype=U)))

        yield from _by_bucket(batches, done, known)
        yield from found(out.flush())

    return run


def _across(slots: int):
    """Boundary suffixes that equal their neighbour in the next bucket, as rows of `FOUND`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Slots(slots)
        for pdf in batches:
            for ids, lead in zip(pdf["ids"], pdf["items"], strict=True):
                yield from out.add(np.frombuffer(ids, dtype=np.int64), lead_names(np.frombuffer(lead, dtype=">u8").astype(U).reshape(1, -1)))
        yield from out.flush()

    return run


def _digest(t: bytes) -> str:
    return hashlib.sha256(t).hexdigest()


def _find(width: int):
    """Texts with the points whose leads are repeated; texts without any are finished."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for pdf in batches:
            texts = [as_bytes(t) for t in pdf["text"]]
            for i, j in chunks(texts):
                part = pdf.iloc[i:j]
                some = [k for k, b in enumerate(part["keys"]) if b is not None and len(b)]
                found: list = [None] * (j - i)
                if some:
                    p = Points([texts[i + k] for k in some], width, powers)
                    names = lead_names(p.leads)
                    for t, k in enumerate(some):
                        own = np.flatnonzero(p.doc == t)
                        own = own[among(names[own], key_set(part["keys"].iloc[k]))]
                        if len(own):
                            row = np.stack([names[own].view(np.int64), p.lo[own], p.hi[own]])
                            found[k] = row.tobytes()
                done = [x is None for x in found]
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "doc_id": part["doc_id"].astype("Int64"),
                        "text": [None if d else t for d, t in zip(done, part["text"], strict=True)],
                        "points": found,
                        "n_bytes": [len(t) for t in texts[i:j]],
                        "kept_sha256": [_digest(t) if d else None for d, t in zip(done, texts[i:j], strict=True)],
                    }
                )

    return run


def _send_strings(width: int, buckets: int):
    """The bytes around repeated points, to the bucket of the lead; equal ones of a task are known and sent once."""

    def send(held: list, turn: int) -> pd.DataFrame:
        groups: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for name, text, i, lo in held:
            groups.setdefault((name, text), []).append((i, lo))
        rows: dict[tuple[int, bool], list] = {}
        known = []
        for (name, text), places in groups.items():
            bucket = ((name % (1 << 64)) * buckets) >> 64
            many = len(places) > 1
            rows.setdefault((bucket, many), []).append((places[0][0], places[0][1], text))
            if many:
                known += [(i, lo, lo + len(text) - width) for i, lo in places]
        out = []
        for (bucket, many), xs in rows.items():
            place = np.array([(i, lo, len(t)) for i, lo, t in xs], dtype=np.int64)
            out.append((bucket, False, b"" if many else b"1", _squeeze(b"".join(t for _, _, t in xs)), place.tobytes()))
        if known:
            out.append((turn % buckets, True, b"", np.array(known, dtype=np.int64).tobytes(), b""))
        return pd.DataFrame(out, columns=["bucket", "known", "ids", "data", "extra"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, turn = [], 0, 0
        for pdf in batches:
            for i, text, points in zip(pdf["id"], pdf["text"], pdf["points"], strict=True):
                t = as_bytes(text)
                turn = turn or int(i % 1009)
                for name, lo, hi in np.frombuffer(points, dtype=np.int64).reshape(3, -1).T.tolist():
                    held.append((name, t[lo : hi + width], i, lo))
                    size += hi - lo + width + 200
                if size > FLUSH_BYTES:
                    yield send(held, turn)
                    held, size, turn = [], 0, turn + 1
        if held:
            yield send(held, turn)

    return run


def _check(data: np.ndarray, at: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """A second hash of the strings at `at`, apart from `span_hash`: over their bytes spread by another bijection."""
    other = np.zeros(len(data) + 1, dtype=U)
    powers.upto(len(data))
    terms = mix(data.astype(U) * C[0] + C[1])
    terms *= powers.up[: len(data)]
    np.cumsum(terms, out=other[1:])
    return mix((other[at + width] - other[at]) * powers.down[at] + C[2])


def _compare(width: int, slots: int):
    """Ranges (first, last) of starts whose strings occur twice, by id; strings are equal if 128 bits of hashes are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, out = Powers(), Slots(slots)

        def done(rows: list, _: int) -> Iterator[pd.DataFrame]:
            names, checks, owner, places, marks = [], [], [], [], []
            n = 0
            for own, data, extra in rows:
                place = np.frombuffer(extra, dtype=np.int64).reshape(-1, 3)
                raw = np.frombuffer(_spread(data), dtype=np.uint8)
                end = np.cumsum(place[:, 2])
                part = 0
                while part < len(place):  # some MB of strings at a time
                    stop = max(part + 1, int(np.searchsorted(end, end[part] + (1 << 21))))
                    base = int(end[part] - place[part, 2])
                    piece = raw[base : int(end[stop - 1])]
                    lens = place[part:stop, 2] - width + 1
                    which = np.repeat(np.arange(stop - part), lens)
                    first = end[part:stop] - place[part:stop, 2] - base
                    at = np.arange(len(which)) - np.repeat(np.cumsum(lens) - lens, lens) + first[which]
                    names.append(span_hash(prefix_hash(piece, powers), at, at + width, powers))
                    checks.append(_check(piece, at, width, powers))
                    owner.append(which + n + part)
                    part = stop
                places.append(place)
                marks.append(np.full(len(place), not len(own)))
                n += len(place)
            name, own, place, mark = np.concatenate(names), np.concatenate(owner), np.concatenate(places), np.concatenate(marks)
            order, same = by_key(name, np.concatenate(checks))
            hit = np.zeros(len(name), dtype=bool)
            hit[order] = same
            hit[order[:-1]] |= same[1:]
            hit &= ~mark[own]
            edge = np.zeros(len(name) + 1, dtype=bool)  # runs of hits within one string
            edge[1:-1] = own[1:] != own[:-1]
            edge[0] = edge[-1] = True
            start = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
            stop = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False)))
            offset = np.zeros(len(place), dtype=np.int64)
            offset[1:] = np.cumsum(place[:-1, 2] - width + 1)
            o = own[start]
            yield from out.add(place[o, 0], np.stack([place[o, 1] + start - offset[o], place[o, 1] + stop - offset[o]], axis=1))

        def known(_: bytes, data: bytes) -> Iterator[pd.DataFrame]:
            place = np.frombuffer(data, dtype=np.int64).reshape(-1, 3)
            yield from out.add(np.ascontiguousarray(place[:, 0]), place[:, 1:])

        yield from _by_bucket(batches, done, known)
        yield from out.flush()

    return run


def _remove(width: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, keys in zip(pdf["doc_id"], pdf["text"], pdf["keys"], strict=True):
                t = as_bytes(text)
                ranges = np.frombuffer(keys or b"", dtype=np.int64).reshape(-1, 2)
                step = np.zeros(len(t) + 1, dtype=np.int64)
                np.add.at(step, ranges[:, 0], 1)
                np.add.at(step, ranges[:, 1] + width, -1)
                gone = np.cumsum(step[:-1]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
                out.append((doc, len(t), int(gone.sum()), spans, _digest(kept), kept if with_text else None))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield frame.astype({"doc_id": "Int64"})

    return run


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of `docs` (doc_id, text).

    A byte of the UTF-8 text goes if a `width`-byte string that covers it starts anywhere else too, in the same
    document included; strings are those of the input. `kept` holds the remaining bytes of the texts that lose
    any, null for the others.

    1. Suffixes are sampled so that each `width`-byte string has one (see `Points`), about one for 160 bytes.
       Splitters (see `_splitters`) deal them into ranges of their leads, 72 bytes; a bucket is sorted by multikey
       quicksort; neighbours with equal leads are candidates, also the last one of a bucket and the first one of the
       next. Each task sorts what it sends first: leads it has twice are known, and one of them is sent.
    2. The bytes around candidate suffixes go to the bucket of the lead's name, equal ones of a task once; there
       all strings of `width` bytes are compared by 128 bits of hashes.
    3. Bytes covered by repeated strings go.

    Rows are known by a 64-bit hash of id and text: null ids, repeated rows (each an occurrence) and one id on
    several texts are kept apart. Null text is empty; shorter texts stay as they are. Very long texts are sampled in
    blocks. An empty table gives no rows.
    """
    if width < 2 * LEAD:
        raise ValueError(f"width must be at least {2 * LEAD}")
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    laid = docs.select("id", "text").mapInPandas(_send_suffixes(width, _splitters(docs, width, 4 * n)), SENT)
    ordered = stage(laid.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_sorted_buckets(n), EDGES))
    ends = ordered.where("bucket >= 0").select("slot", "ids", "items", "bucket", "place")
    # two rows a bucket, of which there are 4 for each shuffle partition: one window holds them
    order = Window.orderBy("bucket", "place")
    beside = ends.withColumn("before", F.lag("items").over(order)).withColumn("after", F.lead("items").over(order))
    beside = beside.withColumn("other", F.lag("bucket").over(order) != F.col("bucket")).withColumn("next", F.lead("bucket").over(order) != F.col("bucket"))
    crossed = beside.where("slot >= 0 and (other and before = items or next and after = items)").select("ids", "items").distinct()
    found = ordered.where("bucket < 0").select("slot", "ids", "items").union(crossed.mapInPandas(_across(n), FOUND))
    names = gathered(found, n)
    schema = "id long, doc_id long, text string, points binary, n_bytes long, kept_sha256 string"
    seen = stage(docs.join(names, "id", "left").mapInPandas(_find(width), schema))
    open_ = seen.where("points is not null")
    laid = open_.select("id", "text", "points").mapInPandas(_send_strings(width, 4 * n), SENT)
    again = laid.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_compare(width, n), FOUND)
    again = gathered(again, n, 2)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = open_.select("id", "doc_id", "text").join(again, "id", "left").mapInPandas(_remove(width, with_text), fields)
    none = F.lit(0).cast("long")
    rest = seen.where("points is null").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    out = cut.union(rest)
    return out if with_text else out.drop("kept")


def op8_suffixes(spark, sf_dir: str) -> DataFrame:
    """Bytes removed from every document."""
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
