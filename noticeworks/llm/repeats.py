"""Which keys occur twice or more, for keys held in binary lists by document.

A key is 64 bits, by which it is dealt and sorted, and a 64-bit check of what it stands for (0 where none is needed):
two occurrences are equal if both are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from noticeworks.llm.hashing import U

PACKED = "bucket int, keys binary, checks binary, ids binary, known boolean"
#: Occurrences that a task holds before it sends them.
FLUSH = 1 << 20


def by_key(keys: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the keys in order, and which of them equals the one before it in that order, checks included."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = k[1:] == k[:-1]
    if checks is not None:
        c = checks[order]
        alike = same.copy()
        alike[1:] &= c[1:] == c[:-1]
        if (alike != same).any():  # one key for different things: those with equal checks must stand together
            order = np.lexsort((checks, keys))
            k, c = keys[order], checks[order]
            alike[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        same = alike
    return order, same


def packed(ids: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, buckets: int, turn: int) -> pd.DataFrame:
    """Rows of `PACKED` for occurrences (ids, keys, checks).

    Keys that this task has seen twice are known to be repeated: their occurrences go to any bucket, to be passed
    on, and one mark without ids goes to the key's bucket. So a key of very many documents does not meet in one
    task: each task sends one mark for it.
    """
    order, same = by_key(keys, checks)
    keys, ids = keys[order], ids[order]
    checks = None if checks is None else checks[order]
    twice = same.copy()
    twice[:-1] |= same[1:]
    head = twice & ~same  # one of each repeated key
    rows = []
    # keys are sorted, so a bucket is a slice
    edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(U)
    part = lambda x, at: [b"" if x is None else p.tobytes() for p in np.split(x, at)] if x is not None else [b""] * buckets
    for pick, with_ids in ((~twice, True), (head, False)):
        at = np.searchsorted(keys[pick], edges)
        for n, (k, c, i) in enumerate(zip(part(keys[pick], at), part(None if checks is None else checks[pick], at), part(ids[pick], at), strict=True)):
            if len(k):
                rows.append((n, k, c, i if with_ids else b"", False))
    for n, (k, i) in enumerate(zip(np.array_split(keys[twice], 8), np.array_split(ids[twice], 8), strict=True)):
        if len(k):
            rows.append(((turn * 8 + n) % buckets, k.tobytes(), b"", i.tobytes(), True))
    return pd.DataFrame(rows, columns=["bucket", "keys", "checks", "ids", "known"])


class Sender:
    """Collects occurrences and gives frames of `PACKED`."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.turn, self.n = buckets, 0, 0
        self.ids: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.checks: list[np.ndarray] = []

    def add(self, ids: np.ndarray, keys: np.ndarray, checks: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        self.ids.append(ids)
        self.keys.append(keys)
        if checks is not None:
            self.checks.append(checks)
        self.n += len(keys)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pd.DataFrame]:
        if self.n:
            if not self.turn:
                self.turn = int(self.keys[0][0] % U(1 << 20)) if len(self.keys[0]) else 0
            self.turn += 1
            checks = np.concatenate(self.checks) if self.checks else None
            yield packed(np.concatenate(self.ids), np.concatenate(self.keys), checks, self.buckets, self.turn)
        self.ids, self.keys, self.checks, self.n = [], [], [], 0


FOUND = "slot int, ids binary, items binary"


class Slots:
    """Collects items of ids (one or more 8-byte values each) and gives frames of `FOUND`, an id always in one slot.

    A task sends a row for each slot and flush, not for each id, so rows do not grow with ids times tasks.
    """

    def __init__(self, slots: int) -> None:
        self.slots, self.n = slots, 0
        self.ids: list[np.ndarray] = []
        self.items: list[np.ndarray] = []

    def add(self, ids: np.ndarray, items: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(ids):
            self.ids.append(ids)
            self.items.append(items)
            self.n += len(ids)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pd.DataFrame]:
        if self.n:
            ids, items = np.concatenate(self.ids), np.concatenate(self.items)
            slot = ((ids.view(U) >> U(32)) * U(self.slots) >> U(32)).astype(np.int32)
            order = np.lexsort((ids, slot))
            ids, items, slot = ids[order], items[order], slot[order]
            cut = np.flatnonzero(slot[1:] != slot[:-1]) + 1
            yield pd.DataFrame(
                {
                    "slot": slot[np.append(0, cut)],
                    "ids": [x.tobytes() for x in np.split(ids, cut)],
                    "items": [x.tobytes() for x in np.split(items, cut)],
                }
            )
        self.ids, self.items, self.n = [], [], 0


def _gather(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def done() -> Iterator[pd.DataFrame]:
            ids = np.concatenate([np.frombuffer(i, dtype=np.int64) for i, _ in held])
            items = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, width) for _, x in held])
            order = np.argsort(ids, kind="stable")
            ids, items = ids[order], items[order]
            cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            yield pd.DataFrame({"id": ids[np.append(0, cut)], "keys": [x.tobytes() for x in np.split(items, cut)]})

        for pdf in batches:
            for slot, ids, items in zip(pdf["slot"], pdf["ids"], pdf["items"], strict=True):
                if slot != now and held:
                    yield from done()
                    held = []
                now = slot
                held.append((ids, items))
        if held:
            yield from done()

    return run


def gathered(found: DataFrame, partitions: int, width: int = 1) -> DataFrame:
    """(id, keys): all items of an id from rows of `FOUND`, in one row; an id has at most its own occurrences."""
    laid = found.repartition(partitions, "slot").sortWithinPartitions("slot")
    return laid.mapInPandas(_gather(width), "id long, keys binary")


def _repeated(slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Slots(slots)
        yield from _hits(batches, out)
        yield from out.flush()

    return run


def _hits(batches: Iterator[pd.DataFrame], out: Slots) -> Iterator[pd.DataFrame]:
    now, held = -1, []

    def done() -> Iterator[pd.DataFrame]:
        if held:
            keys = np.concatenate([np.frombuffer(k, dtype=U) for k, _, _ in held])
            checks = np.concatenate([np.frombuffer(c, dtype=U) for _, c, _ in held])
            real = np.concatenate([np.full(len(k) // 8, len(i) > 0) for k, _, i in held])  # a mark has no id
            ids = np.concatenate([np.frombuffer(i, dtype=np.int64) if len(i) else np.zeros(len(k) // 8, dtype=np.int64) for k, _, i in held])
            order, same = by_key(keys, checks if len(checks) else None)
            hit = same.copy()
            hit[:-1] |= same[1:]
            hit &= real[order]
            yield from out.add(ids[order][hit], keys[order][hit])

    for pdf in batches:
        for bucket, known, k, c, i in zip(pdf["bucket"], pdf["known"], pdf["keys"], pdf["checks"], pdf["ids"], strict=True):
            if bucket != now:
                yield from done()
                now, held = bucket, []
            if known:
                yield from out.add(np.frombuffer(i, dtype=np.int64), np.frombuffer(k, dtype=U))
            else:
                held.append((k, c, i))
    yield from done()


def repeated(sent: DataFrame, partitions: int) -> DataFrame:
    """Rows of `FOUND` for the occurrences in `sent` (rows of `PACKED`) whose key occurs twice or more.

    One shuffle by ranges of keys; a bucket is a slice of the key space, so its size follows from the number of
    partitions, and a task holds one bucket at a time.
    """
    laid = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return laid.mapInPandas(_repeated(partitions), FOUND)


def key_set(blob: bytes | None) -> np.ndarray:
    """The sorted distinct keys of a binary list; None gives none."""
    return np.unique(np.frombuffer(blob or b"", dtype=U))


def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array `wanted`."""
    if not len(wanted):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[at] == keys
