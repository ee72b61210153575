"""Near-duplicate documents by one-permutation MinHash with optimal densification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.llm.common import drop_stage, few, small_batches, stage, staging
from noticeworks.llm.components import components
from noticeworks.llm.hashing import Powers, U, Words, as_bytes, chunks, mix, salts

SHINGLE = 5
BANDS = 32
ROWS = 6
#: Bands and bins of a band of the signatures of step 3, and how many of them at most before the audit.
DEEP = (64, 8)
DEEP_ROUNDS = 1
#: Random bins that an empty bin tries in turn; after them it takes the next filled one.
TRIES = 512


def shingle_sets(texts: list[bytes], width: int, powers: Powers) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: `width` words, A-Z lower-cased, or all when there are fewer."""
    c = salts(width, 11)
    for i, j in chunks(texts):
        w = Words(texts[i:j], powers, lower=True)
        n = len(w.hashes)
        sums = np.zeros(n, dtype=U)
        for k in range(width):
            sums[: n - k] += w.hashes[k:] * c[k] if k < n else U(0)
        hashes = mix(sums)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b - a >= width:
                yield np.unique(hashes[a : b - width + 1])
            elif b > a:
                yield mix((w.hashes[a:b] * c[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield np.empty(0, dtype=U)


def signatures(sets: list[np.ndarray], bins: int, tries: np.ndarray) -> np.ndarray:
    """(len(sets), bins): the least hash of each bin; an empty bin copies the first filled bin of its own random sequence."""
    sig = np.zeros((len(sets), bins), dtype=U)
    full = np.zeros((len(sets), bins), dtype=bool)
    for r, s in enumerate(sets):
        at = ((s >> U(32)) * U(bins)) >> U(32)
        head = np.ones(len(s), dtype=bool)
        head[1:] = at[1:] != at[:-1]
        sig[r, at[head].astype(np.int64)] = s[head]
        full[r, at[head].astype(np.int64)] = True
    row, col = np.nonzero(~full)
    for t in range(len(tries)):
        if not len(row):
            break
        src = tries[t, col]
        ok = full[row, src]
        sig[row[ok], col[ok]] = sig[row[ok], src[ok]]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row, col, strict=True):
        filled = np.flatnonzero(full[r])
        sig[r, c] = sig[r, filled[np.searchsorted(filled, c) % len(filled)]]
    return sig


def band_keys(sets: list[np.ndarray], bands: int, rows: int, tries: np.ndarray) -> np.ndarray:
    """(len(sets), bands): the key of each band of `rows` bins of the signatures."""
    sig = signatures(sets, bands * rows, tries).reshape(len(sets), bands, rows)
    return mix((sig * salts(rows, 23)).sum(axis=2, dtype=U) + salts(bands, 37)).view(np.int64)


def _tries(bins: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, bins, size=(TRIES, bins))


def _sketch(width: int, bands: int, rows: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, tries = Powers(), _tries(bands * rows)
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                sets = list(shingle_sets([as_bytes(t) for t in part["text"]], width, powers))
                wide = [k for k, s in enumerate(sets) if len(s) >= least]
                keys: list = [None] * len(sets)
                if wide:
                    for k, b in zip(wide, band_keys([sets[k] for k in wide], bands, rows, tries), strict=True):
                        keys[k] = b
                yield pd.DataFrame(
                    {
                        "row": part["row"],
                        "doc_id": part["doc_id"].astype("Int64"),
                        "n": np.fromiter((len(s) for s in sets), np.int64, len(sets)),
                        "fp1": np.fromiter((mix(s ^ U(1)).sum(dtype=U).view(np.int64) for s in sets), np.int64, len(sets)),
                        "fp2": np.fromiter((mix(s + U(2)).sum(dtype=U).view(np.int64) for s in sets), np.int64, len(sets)),
                        "bands": keys,
                    }
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for pdf in batches:
            texts = [as_bytes(t) for t in pdf["text"]]
            for i, j in chunks(texts):
                yield pd.DataFrame({"id": pdf["row"].iloc[i:j].to_numpy(), "shingles": [s.tobytes() for s in shingle_sets(texts[i:j], width, powers)]})

    return run


def _again(bands: int, rows: int, seed: int):
    """Band keys of sets under another permutation: their hashes are mixed anew with `seed`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = _tries(bands * rows)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                sets = [np.sort(mix(np.frombuffer(x, dtype=U) ^ U(seed))) for x in part["shingles"]]
                yield pd.DataFrame({"id": part["id"], "n": [len(x) for x in sets], "bands": list(band_keys(sets, bands, rows, tries))})

    return run


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each shingle of a set, with the set's size."""
    for pdf in batches:
        for i, j in chunks(list(pdf["shingles"])):
            sets = [np.frombuffer(x, dtype=np.int64) for x in pdf["shingles"].iloc[i:j]]
            n = [len(x) for x in sets]
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy()[i:j], n), "n": np.repeat(n, n), "bk": np.concatenate(sets)})


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(bk, id, n, at, lead): the rarest shingles of each set of `sets` (id, shingles) that another set has too.

    All sets order their shingles alike, rarest first; `at` is a shingle's place, from 0, in a set of `n`. Two sets
    of the similarity share `percent` per cent of the larger one, so each has their first common shingle among its
    first n - ceil(percent * n / 100) + 1: a pair that shares no bucket here is no link. In the smaller of the two
    it stands among the first n - ceil(2 * percent * n / (100 + percent)) + 1, which `lead` marks. A set with
    enough shingles of its own has no row.
    """
    all_ = stage(sets.mapInPandas(_spread, "id long, n long, bk long"))
    often = all_.groupBy("bk").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = all_.join(often, "bk").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "bk"))).alias("s"))
    first = F.expr(f"cast(size(s) - ({percent} * n + 99) div 100 + 1 as int)")
    rows = shared.withColumn("first", first).where("first > 0").select("id", "n", F.expr("n - size(s)").alias("own"), F.posexplode(F.expr("slice(s.bk, 1, first)")).alias("k", "bk"))
    lead = F.expr(f"own + k + ({2 * percent} * n + {99 + percent}) div {100 + percent} <= n")
    return rows.select("bk", "id", "n", (F.col("own") + F.col("k")).alias("at"), lead.alias("lead"))


def _links(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                a, b = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return run


class _Finder:
    """The sets of the candidates, and the components that their links have made so far."""

    def __init__(self, sets: DataFrame, percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.comps: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> bool:
        """Hold candidate pairs (a, b) against their sets and add the links to the components; whether there are any."""
        sa = self.sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        sb = self.sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        links = stage(pairs.distinct().join(sb, "b").join(sa, "a").mapInPandas(_links(self.percent), "a long, b long"))
        if not links.limit(1).count():
            return False
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if self.comps is not None:
            edges = edges.union(self.comps.select("node", "component"))
        self.comps = stage(components(edges))
        return True

    def placed(self, members: DataFrame) -> DataFrame:
        """`members` (id, ...) with the component `c` of each."""
        if self.comps is None:
            return members.withColumn("c", F.col("id"))
        return members.join(self.comps.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    def star(self, members: DataFrame, drawn: DataFrame) -> bool:
        """Compare each of `members` (bk, id, n, c) with its bucket's pivot (bk, pid, pn, pc) of another component where the sizes allow a link."""
        near = (F.col("c") != F.col("pc")) & (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * self.percent)
        return self.confirm(members.join(drawn, "bk").where(near).select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")))

    def open(self, members: DataFrame) -> DataFrame:
        """(id, c) of the members (bk, id) of buckets that hold two components at least."""
        placed = self.placed(members.select("bk", "id"))
        wide = placed.groupBy("bk").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bk")
        return stage(placed.join(wide, "bk").select("id", "c").distinct())

    def audit(self, keys: DataFrame) -> None:
        """Compare all members of the buckets of `keys` (bk, id, n, at, lead) that may be links and are in two components.

        If a bucket is a pair's first common shingle, they share at most what each has from there on. Eight pivots a
        bucket, then 64 and so on, until no bucket has a pivot and two components left.
        """

        def left(rows: DataFrame) -> DataFrame:
            wide = rows.groupBy("bk").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("lead").alias("some")).where("lo <> hi and some").select("bk")
            return stage(rows.join(wide, "bk"))

        active, pivots = left(self.placed(keys)), 8
        while active.limit(1).count():
            order = F.row_number().over(Window.partitionBy("bk").orderBy("at", F.xxhash64("id", "bk"), "id"))
            heads = active.where("lead").withColumn("k", order).where(F.col("k") <= pivots)
            h = heads.select(F.col("bk").alias("hk"), F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("at").alias("pat"), F.col("c").alias("pc"))
            most = F.least(F.col("n") - F.col("at"), F.col("pn") - F.col("pat"))
            near = (F.col("bk") == F.col("hk")) & (F.col("c") != F.col("pc")) & (most * (100 + self.percent) >= (F.col("n") + F.col("pn")) * self.percent)
            grown = self.confirm(active.join(h, near).select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")))
            rest = active.join(heads.select("bk", "id"), ["bk", "id"], "left_anti")
            active, pivots = left(self.placed(rest.drop("c")) if grown else rest), 8 * pivots


def _drawn(members: DataFrame) -> DataFrame:
    """(bk, pid, pn, pc) of the buckets of `members` (bk, id, n, c) that hold two components: a pivot chosen by hash."""
    pivot = F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("c").alias("pc")))
    return members.groupBy("bk").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), pivot.alias("p")).where("lo <> hi").select("bk", "p.pid", "p.pn", "p.pc")


def row_key(*columns: str) -> Column:
    """What tells rows of documents apart: a 64-bit hash of id and text."""
    return F.xxhash64(*columns)


def _placed(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of `docs` (row, doc_id, text), and (row, doc_id, c) of those with words, both staged."""
    # below this size two different sets cannot reach the similarity
    least = next(k for k in range(1, 1000) if 100 * k >= percent * (k + 1))
    sk = stage(docs.mapInPandas(_sketch(width, bands, rows, least), "row long, doc_id long, n long, fp1 long, fp2 long, bands array<long>"))
    known = sk.where("n > 0").select("row", "doc_id", "n", "fp1", "fp2")
    reps = known.groupBy("n", "fp1", "fp2").agg(F.min("row").alias("rep"))
    member = stage(known.join(reps, ["n", "fp1", "fp2"]).select("row", "doc_id", "rep").distinct())
    alone = member.where("row = rep").select("row").distinct()
    in_band = sk.where("bands is not null").join(alone, "row", "left_semi").select(F.col("row").alias("id"), "n", F.explode("bands").alias("bk"), F.col("row").alias("c"))
    drawn = stage(_drawn(in_band))
    active = stage(in_band.join(drawn.select("bk"), "bk").select("bk", "id", "n", "c").distinct())
    needed = stage(active.select(F.col("id").alias("row")).distinct())
    sets = stage(docs.select("row", "text").join(needed, "row", "left_semi").mapInPandas(_sets(width), "id long, shingles binary").dropDuplicates(["id"]))
    finder = _Finder(sets, percent)
    finder.star(active, drawn)
    left = finder.open(active)
    for k in range(DEEP_ROUNDS):
        if not left.limit(1).count():
            break
        deep = sets.join(left.select("id"), "id", "left_semi").mapInPandas(_again(*DEEP, 71 + k), "id long, n long, bands array<long>")
        deep = stage(finder.placed(deep.select("id", "n", F.explode("bands").alias("bk"))))
        drawn = stage(_drawn(deep))
        active = stage(deep.join(drawn.select("bk"), "bk"))
        grown = finder.star(active, drawn)
        left = finder.open(active)
        if not grown:
            break
    if left.limit(1).count():
        finder.audit(rare_shingles(sets.join(left.select("id"), "id", "left_semi"), percent))
    placed = stage(finder.placed(member.withColumnRenamed("rep", "id")).select("row", "doc_id", "c"))
    return sk, placed


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept, first) for each row of `docs` (doc_id, text).

    Rows are linked when their sets of `width`-word shingles have a Jaccard similarity of at least `percent`
    per cent; component_id is the smallest doc_id that links reach, and kept marks its owner. `row` is the
    `row_key` of (doc_id, text), and `first` is true for one of them in each component.

    1. One pass makes a sketch a row: set size, a 128-bit fingerprint of the set, and band keys of its
       one-permutation signature. Equal sets meet by fingerprint and go on as one representative.
    2. In every bucket of two representatives or more one pivot, chosen by hash, is paired with each other member:
       a star, never all pairs. Pairs whose set sizes rule the link out are left out, the others are confirmed on
       their full sets, which only the members of such buckets have. Links become components.
    3. Members of buckets that still hold two components get a longer signature under another permutation, in
       `DEEP` bands, and stars again; up to `DEEP_ROUNDS` times, as long as links are found.
    4. What is open then (texts that share passages and are no links, mostly) is audited exactly, so that no link
       is lost: their rarest shingles become buckets, which every pair at the threshold shares (see
       `rare_shingles` and `_Finder.audit`).

    A pair at the threshold shares no bucket of step 2 with a chance of 3e-7 at 0.85 (6e-5 at 0.8), if its sets
    are large against the signature, and none of step 3 with one of 2e-9 (8e-6).
    Null, empty or blank text: no shingles, linked with nothing, kept and first. Fewer words than `width`: one
    shingle. Each row is a document of its own: one id on several texts is compared text by text, null ids are
    compared like others and count for no component_id (null if a component has no other); only rows equal in id
    and text share a `row`. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with staging() as made:
        sk, placed = _placed(docs, width, percent, bands, rows)
    drop_stage(*[t for t in made if t is not sk and t is not placed])
    heads = placed.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("h"))
    own = placed.join(heads.select("c", "component_id", F.col("h.row").alias("_first")), "c").groupBy(F.col("row").alias("_row")).agg(F.min("component_id").alias("_c"), F.min("_first").alias("_first"))
    out = sk.select("row", "doc_id", F.col("n").alias("n_shingles")).join(own, F.col("row") == F.col("_row"), "left")
    out = out.select("row", "doc_id", "n_shingles", F.when(F.col("_row").isNull(), F.col("doc_id")).otherwise(F.col("_c")).alias("component_id"), F.coalesce(F.col("_first") == F.col("row"), F.lit(True)).alias("first"))
    return out.select("row", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first")


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of near duplicates, all columns kept.

    The row stays whose doc_id is the smallest of its group (then the smallest row key); rows without a word are in
    no group and stay. Of rows equal in id and text one stays, the least by a hash of all columns that are no maps.
    Only keys of rows that go, or that are repeated, are joined to the documents: by a broadcast if they are few
    (see `few`), so that no text is shuffled then.
    """
    with staging() as made:
        found = near_duplicates(docs.select("doc_id", "text"), percent=percent)
        verdict = found.groupBy(F.col("row").alias("_nw_row")).agg(F.bool_or("first").alias("_nw_first"), ((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("_nw_many"))
        verdict = stage(verdict.where("_nw_many or not _nw_first"))
    drop_stage(*[t for t in made if t is not verdict])
    joined = docs.withColumn("_nw_key", row_key("doc_id", "text")).join(F.broadcast(verdict) if few(verdict) else verdict, F.col("_nw_key") == F.col("_nw_row"), "left")
    plain = joined.where("_nw_row is null").select(*docs.columns)
    flat = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    twice = joined.where("_nw_first and _nw_many").groupBy("_nw_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*flat)).alias("_nw_one"))
    return plain.union(twice.select("_nw_one.*"))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")
