"""Ranked lexical search over dual-sorted wavelet trees, one for each shard of documents.

A shard lays the postings of its terms one list after the other, each list by falling impact, and keeps the document
numbers of this sequence in a wavelet tree. Numbers follow doc_id, so a node is a range of doc_ids; the order of a
list survives in every node, so the first posting that a list has there bounds the whole list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import drop_stage, shared_dir, small_batches, stage
from noticeworks.llm.hashing import as_bytes, pieces

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Term bytes as they are, A-Z lower-cased, all others a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms (with repeats) of a shard, at most about; one longer document is a shard of its own.
SHARD_TERMS = 2_000_000
#: Queries that are held at a time, at most about: a block meets every shard.
BLOCK = 4_096
#: Nodes that a search opens at a time, the best first.
WIDE = 192
INDEX = "shard string, docs binary, terms binary, starts binary, impacts binary, bits binary, depth int"
DEAD = np.iinfo(np.int64).min


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The part of a score that a document gives: (1000000000*tf) div (1000*tf + 20*m)."""
    m = 100 - 50 + (50 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _tree(doc: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level, the bits of the sequence, and the order that puts its zeros before its ones."""
    for level in range(depth):
        bit = (doc >> (depth - 1 - level)) & 1
        order = np.concatenate([np.flatnonzero(bit == 0), np.flatnonzero(bit)])
        yield bit.astype(np.uint8), order
        doc = doc[order]


def _shard(ids: list, counts: list[np.ndarray], words: _Numbers, docs: int, terms: int) -> dict:
    """A row of INDEX from the terms of its documents: counts[i] has the term numbers of the document ids[i]."""
    by = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    names = sorted(words)
    rank = np.empty(len(names), dtype=np.int64)
    rank[[words[t] for t in names]] = np.arange(len(names))
    term, doc, q = [], [], []
    for at, i in enumerate(by):
        t, tf = np.unique(rank[counts[i]], return_counts=True)
        term.append(t.astype(np.int32))
        doc.append(np.full(len(t), at, dtype=np.int32))
        q.append(impact(tf, np.int64(len(counts[i])), docs, terms).astype(np.int32))
    term, doc, q = np.concatenate(term), np.concatenate(doc), np.concatenate(q)
    order = np.lexsort((doc, -q, term))
    starts = np.searchsorted(term[order], np.arange(len(names) + 1)).astype(np.int32)
    doc, q = doc[order], q[order]
    depth = max(1, (len(ids) - 1).bit_length())
    known = [ids[i] for i in by]
    held = pd.array(known, dtype="Int64")
    return {
        "shard": "",
        "docs": held.to_numpy(np.int64, na_value=DEAD).tobytes(),
        "terms": b" ".join(names),
        "starts": starts.tobytes(),
        "impacts": q.tobytes(),
        "bits": b"".join(np.packbits(b).tobytes() for b, _ in _tree(doc, depth)),
        "depth": depth,
    }


def _build(docs: int, terms: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        counts: list[np.ndarray] = []
        words, total = _Numbers(), 0

        def row() -> pd.DataFrame:
            return pd.DataFrame([_shard(ids, counts, words, docs, terms) | {"shard": f"{part}-{made}"}])

        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                body = as_bytes(text).translate(TABLE)
                found = [np.fromiter(map(words.__getitem__, p.split()), dtype=np.int32) for p in pieces(body)]
                t = np.concatenate(found) if found else np.empty(0, dtype=np.int32)
                if not len(t):
                    continue
                ids.append(None if pd.isna(i) else int(i))
                counts.append(t)
                total += len(t)
                if total >= most or len(ids) >= 1 << 20:
                    yield row()
                    made += 1
                    ids, counts, words, total = [], [], _Numbers(), 0
        if ids:
            yield row()

    return run


class Shard:
    """A shard of the index in memory: for each level the zeros before each place, and the impacts in the level's order."""

    def __init__(self, r) -> None:
        self.docs = np.frombuffer(r.docs, dtype=np.int64)
        self.starts = np.frombuffer(r.starts, dtype=np.int32)
        self.terms = {t: n for n, t in enumerate(r.terms.split(b" "))}
        self.depth = int(r.depth)
        q = np.frombuffer(r.impacts, dtype=np.int32)
        size = len(q)
        step = (size + 7) // 8
        packed = np.frombuffer(r.bits, dtype=np.uint8).reshape(self.depth, step)
        self.zeros = np.zeros((self.depth, size + 1), dtype=np.int32)
        self.impacts = np.empty((self.depth + 1, size), dtype=np.int32)
        self.impacts[0] = q
        for level in range(self.depth):
            zero = np.unpackbits(packed[level], count=size) == 0
            np.cumsum(zero, out=self.zeros[level, 1:])
            n = int(self.zeros[level, -1])
            self.impacts[level + 1, :n] = self.impacts[level][zero]
            self.impacts[level + 1, n:] = self.impacts[level][~zero]

    def lists(self, terms: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, weight) of the lists of those terms that the shard has."""
        at = [(self.terms[t], w) for t, w in zip(terms, weights, strict=True) if t in self.terms]
        n = np.array([x[0] for x in at], dtype=np.int64)
        return self.starts[n], self.starts[n + 1], np.array([x[1] for x in at], dtype=np.int64)

    def best(self, terms: list[bytes], weights: np.ndarray, k: int, least: int, report: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(document number, score) of the `k` best documents with a score of `least` or above, exactly; ties by number.

        A node is bounded by the sum of the first impacts of its lists, times their weights; at a leaf, a single
        document, that sum is the score. The best bounds are opened first, until none can enter the best k: a node
        with the bound of the k-th score counts only if it has smaller numbers than the k-th document.
        """
        s0, e0, w = self.lists(terms, weights)
        none = np.empty(0, dtype=np.int64)
        if not len(w):
            return none, none
        level, first = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        s, e = s0[None, :], e0[None, :]
        bound = np.array([np.iinfo(np.int64).max])
        found_d, found_s = none, none
        worst, tail = least, len(self.docs)  # what a node must reach, and the number it must stay below on a tie
        zeros, impacts, wide = self.zeros.ravel(), self.impacts.ravel(), self.impacts.shape[1]
        # whole numbers below 2^53 are exact in doubles
        w = w.astype(np.float64) if int(w.sum()) * 1_000_000 < 1 << 53 else w
        while len(bound):
            if len(bound) > WIDE:
                # best first; smaller numbers first on equal bounds
                pick = np.lexsort((first, -bound))[:WIDE] if len(bound) <= 4 * WIDE else np.argpartition(-bound, WIDE - 1)[:WIDE]
                rest = np.ones(len(bound), dtype=bool)
                rest[pick] = False
            else:
                pick, rest = np.arange(len(bound)), np.zeros(len(bound), dtype=bool)
            lv, fs = level[pick], first[pick]
            ps, pe = s[pick], e[pick]
            report[0] += len(pick)
            base = (lv * (wide + 1))[:, None]
            zs, ze = zeros.take(base + ps), zeros.take(base + pe)
            n = self.zeros[lv, -1][:, None]
            cs = np.concatenate([zs, n + ps - zs])
            ce = np.concatenate([ze, n + pe - ze])
            cl = np.concatenate([lv, lv]) + 1
            cf = np.concatenate([fs, fs + (1 << (self.depth - 1 - lv))])
            has = ce > cs
            top = impacts.take(np.minimum((cl * wide)[:, None] + cs, len(impacts) - 1)) * has
            cb = (top @ w).astype(np.int64)
            leaf = cl == self.depth
            ok = cb >= max(worst, 1)
            hit = ok & leaf
            if hit.any():
                d, v = np.concatenate([found_d, cf[hit]]), np.concatenate([found_s, cb[hit]])
                order = np.lexsort((d, -v))[:k]
                found_d, found_s = d[order], v[order]
                if len(found_s) == k and found_s[-1] >= worst:
                    worst, tail = int(found_s[-1]), int(found_d[-1])
            level = np.concatenate([level[rest], cl[ok & ~leaf]])
            first = np.concatenate([first[rest], cf[ok & ~leaf]])
            s, e = np.concatenate([s[rest], cs[ok & ~leaf]]), np.concatenate([e[rest], ce[ok & ~leaf]])
            bound = np.concatenate([bound[rest], cb[ok & ~leaf]])
            keep = (bound > worst) | ((bound == worst) & (first < tail))
            if not keep.all():
                level, first, s, e, bound = level[keep], first[keep], s[keep], e[keep], bound[keep]
        return found_d, found_s


def build_index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of `docs` (doc_id, text), a staged table of INDEX with N and L beside every shard.

    A shard is made of the documents that a task reads, so texts are not shuffled; a task holds the term numbers of
    one shard. N and L, the documents with a term and all their terms, are counted first.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    at = texts.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    small_batches(docs.sparkSession)
    shards = texts.mapInPandas(_build(at.docs, max(at.terms, 1), shard_terms), INDEX)
    return stage(shards.withColumn("n_docs", F.lit(at.docs)))


def _frequencies(wanted: dict[bytes, int]):
    """Documents of each wanted term, by its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for pdf in batches:
            for terms, starts in zip(pdf["terms"], pdf["starts"], strict=True):
                size = np.diff(np.frombuffer(starts, dtype=np.int32))
                for n, t in enumerate(terms.split(b" ")):
                    if t in wanted:
                        total[wanted[t]] += size[n]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "df": total[some]})

    return run


def _ask(items: list[tuple[int, list[bytes], np.ndarray, int]], k: int):
    """The k best documents of each item in the shards of a task, (item, doc_id, score), and the nodes opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        opened = [0]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                shard = Shard(r)
                for item, terms, weights, least in items:
                    d0, s0 = held.get(item, (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
                    worst = max(least, int(s0[-1])) if len(s0) == k else least
                    d, s = shard.best(terms, weights, k, worst, opened)
                    d, s = np.concatenate([d0, shard.docs[d]]), np.concatenate([s0, s])
                    # an id of none comes last
                    order = np.lexsort((np.where(d == DEAD, np.iinfo(np.int64).max, d), -s))[:k]
                    held[item] = d[order], s[order]
                del shard  # before the next one is read
        for item, (d, s) in held.items():
            ids = pd.array(d, dtype="Int64")
            ids[d == DEAD] = pd.NA
            yield pd.DataFrame({"item": item, "doc_id": ids, "score": s, "opened": 0})
        yield pd.DataFrame({"item": [-1], "doc_id": pd.array([pd.NA], dtype="Int64"), "score": [0], "opened": [opened[0]]})

    return run


def _block(index: DataFrame, n_docs: int, block: list, k: int, first_share: int) -> DataFrame:
    """(item, doc_id, score) candidates of the items in `block`, rows of (item, text)."""
    asked = [(r.item, sorted(set(as_bytes(r.text).translate(TABLE).split()))) for r in block]
    wanted = {t: n for n, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    counts = index.select("terms", "starts").mapInPandas(_frequencies(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {r.term: r.df for r in counts.collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[n] + 1))) for t, n in wanted.items() if n in df}
    items = []
    for item, terms in asked:
        some = [t for t in terms if weight.get(t, 0) > 0]
        items.append((item, some, np.array([weight[t] for t in some], dtype=np.int64), 1))
    found_as = "item long, doc_id long, score long, opened long"
    # some shards are asked first: what the k-th document has there, the others must reach
    early = F.pmod(F.xxhash64("shard"), F.lit(first_share)) == 0
    ahead = stage(index.where(early).mapInPandas(_ask(items, k), found_as))
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    kth = ahead.where("item >= 0").select("item", "score", at.alias("at")).where(F.col("at") <= k).where(F.col("at") == k)
    least = {r.item: r.score for r in kth.collect()}
    rest = stage(index.where(~early).mapInPandas(_ask([(i, t, w, least.get(i, 1)) for i, t, w, _ in items], k), found_as))
    return ahead.unionByName(rest)


def search(index: DataFrame, queries: DataFrame, k: int = 50, block: int = BLOCK, first_share: int = 8) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of `index` for each row of `queries` (item_id, text).

    Queries go in blocks of about `block`, whose terms and weights travel to the shards; each task keeps the k best
    of its shards for an item, and a window ranks what the tasks found. About one of `first_share` shards is asked
    first, so that the score of its k-th document holds for the others from the start; that loses nothing.

    Scores are those of `impact` times floor(1000*ln((2*N+2)/(2*df+1))), summed over an item's terms, once each; equal
    scores go by ascending doc_id, null ids last. Fewer than `k` documents above 0: all of them. Null and empty texts, of
    either side, have no terms and no rows. Repeated documents are documents of their own, repeated items get
    their rows each. Ids are read as longs; other columns are ignored. Empty tables give no rows.
    A very long text is read whole, its term numbers held at once (4 bytes a term).
    """
    head = index.select("n_docs").first()
    n_docs = head.n_docs if head else 0
    rows = stage(queries.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"))
    blocks = max(1, -(-rows.count() // block))
    found = None
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()
        if some and n_docs:
            part = _block(index, n_docs, some, k, first_share)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.where("item >= 0").select("item", "doc_id", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
    return top.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    top = stage(search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")))
    drop_stage(index)
    return top


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS r FROM documents),
d AS (SELECT r, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
c AS (SELECT i, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""
