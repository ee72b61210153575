"""Guarded writes and decisions, planned as data: every function returns the rows to write and what became of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.operators.versioning import differs


def case_transition(cases: DataFrame, proposals: DataFrame, key: str, token: str, fields: list[str]) -> DataFrame:
    """(key, outcome, fields): compare-and-set of `fields` where the proposal's `token` is the stored one (K2, K8).

    missing: no such case; conflict: another token (null equals null); unchanged: nothing to write; else applied.
    Only applied rows carry the proposed values, the others what is stored.
    """
    j = proposals.alias("n").join(cases.withColumn("_known", F.lit(True)).alias("s"), F.col(f"n.{key}") == F.col(f"s.{key}"), "left")
    outcome = (
        F.when(F.col("s._known").isNull(), "missing")
        .when(~F.col(f"n.{token}").eqNullSafe(F.col(f"s.{token}")), "conflict")
        .when(~differs(fields, "n", "s"), "unchanged")
        .otherwise("applied")
    )
    value = [F.when(outcome == "applied", F.col(f"n.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in fields]
    return j.select(F.col(f"n.{key}"), outcome.alias("outcome"), *value)


def case_writes(cases: DataFrame, products: DataFrame, events: DataFrame, records: DataFrame, proposals: DataFrame) -> dict[str, DataFrame]:
    """What an atomic transition writes: `cases`, `products`, `events` and `records` after it, and the `outcomes` (K2).

    proposals: case_id, expected, projection, last_changed_at, and arrays `products` (native_id, name), `events` (dedup_key, kind),
    `markers` (record_id, state, content_hash, seq). It applies where the case's last_changed_at is `expected` (null never is), else it is
    a conflict and writes nothing. The case's products are replaced, numbered from 0. Events whose key the ledger has, or an
    earlier event has, are not inserted; outcomes list those that are. A marker updates its record if that is the case's and has
    no later sequence applied; of several the latest. One proposal a case; a null array is empty.
    """
    stored = cases.select("case_id", F.col("last_changed_at").alias("_at"))
    j = proposals.join(stored, "case_id", "left").withColumn("_ok", F.coalesce(F.col("_at") == F.col("expected"), F.lit(False)))
    done = j.where("_ok")
    new = done.select("case_id", F.col("projection").alias("_p"), F.col("last_changed_at").alias("_l"))
    after = cases.join(new, "case_id", "left").select("case_id", F.when(F.col("_l").isNotNull(), F.col("_p")).otherwise(F.col("projection")).alias("projection"), F.coalesce("_l", "last_changed_at").alias("last_changed_at"))
    fresh = done.select("case_id", F.posexplode("products").alias("ordinal", "x")).select("case_id", "ordinal", "x.native_id", "x.name")
    kept = products.join(done.select("case_id"), "case_id", "left_anti").select("case_id", "ordinal", "native_id", "name")
    told = done.select("case_id", F.posexplode("events").alias("pos", "x")).select("case_id", "pos", "x.dedup_key", "x.kind")
    first = told.groupBy("dedup_key").agg(F.min(F.struct("case_id", "pos", "kind")).alias("f")).select("dedup_key", "f.case_id", "f.kind")
    added = first.join(events.select("dedup_key"), "dedup_key", "left_anti").select("case_id", "dedup_key", "kind")
    marks = done.select("case_id", F.posexplode("markers").alias("pos", "x")).select("case_id", "pos", "x.*")
    own = marks.withColumnRenamed("record_id", "id").join(records.select("id", "case_id", F.col("applied_seq").alias("_seq")), ["id", "case_id"])
    last = own.where(F.col("_seq").isNull() | (F.col("_seq") <= F.col("seq"))).groupBy("id").agg(F.max(F.struct("seq", "pos", "state", "content_hash")).alias("m"))
    marked = records.join(last, "id", "left").select("id", "case_id", *[F.coalesce(f"m.{n}", c).alias(c) for n, c in (("state", "apply_state"), ("content_hash", "applied_hash"), ("seq", "applied_seq"))])
    keys = added.groupBy("case_id").agg(F.array_sort(F.collect_set("dedup_key")).alias("inserted"))
    outcomes = j.select("case_id", F.when(F.col("_ok"), "applied").otherwise("conflict").alias("status")).join(keys, "case_id", "left")
    return {
        "cases": after,
        "products": kept.unionByName(fresh),
        "events": events.select("case_id", "dedup_key", "kind").unionByName(added),
        "records": marked,
        "outcomes": outcomes.select("case_id", "status", F.coalesce("inserted", F.array().cast("array<string>")).alias("inserted")),
    }


def founding_rows(records: DataFrame, incoming: DataFrame, natural: list[str], order: str) -> dict[str, DataFrame]:
    """The rows that founding writes, all of them for a founded key and none for another: `cases`, `records`, `snapshots`, `products`, `events` (K3).

    `incoming` has the natural key, `order`, projection, content_hash and an array `products` (native_id, name). A case's id is the hash of its
    natural key, so that a repeated run founds the same one; its first event is `initial`, with a key of its own.
    """
    new = found(records, incoming, natural, order).where("outcome = 'founded'").select(*natural, order)
    rows = incoming.join(new, [*natural, order]).withColumn("case_id", F.md5(F.to_json(F.struct(*natural), {"ignoreNullFields": "false"})))
    return {
        "cases": rows.select("case_id", "projection"),
        "records": rows.select(*natural, "case_id", "content_hash", F.lit("applied").alias("apply_state")),
        "snapshots": rows.select("case_id", F.lit(1).alias("seq"), "content_hash"),
        "products": rows.select("case_id", F.posexplode("products").alias("ordinal", "x")).select("case_id", "ordinal", "x.native_id", "x.name"),
        "events": rows.select("case_id", F.lit("initial").alias("kind"), F.concat(F.lit("initial:"), "case_id").alias("dedup_key")),
    }


def found(records: DataFrame, incoming: DataFrame, natural: list[str], order: str) -> DataFrame:
    """`natural` keys and `order` of incoming rows with outcome: founded, or record_exists where the ledger or an earlier incoming row has the key (K3)."""
    first = incoming.groupBy(*natural).agg(F.min(order).alias("_first"))
    known = records.select(*natural).distinct().withColumn("_known", F.lit(True))
    j = incoming.select(*natural, order).join(first, natural).join(known, natural, "left")
    fresh = F.col("_known").isNull() & (F.col(order) == F.col("_first"))
    return j.select(*natural, order, F.when(fresh, "founded").otherwise("record_exists").alias("outcome"))


def upsert(target: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`target` after insert-or-update: the row of `source` holds wherever it has one, its nulls included (K5)."""
    j = target.alias("t").join(source.withColumn("_new", F.lit(True)).alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    return j.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), *[F.when(F.col("s._new"), F.col(f"s.{f}")).otherwise(F.col(f"t.{f}")).alias(f) for f in fields])


def acquire_leases(leases: DataFrame, requests: DataFrame, job: str, holder: str, at: str, expires: str) -> DataFrame:
    """(job, holder, granted): the first request of a job by time, then holder, gets it if the lease is free, expired or its own (K6)."""
    first = requests.groupBy(job).agg(F.min(F.struct(at, holder)).alias("_r")).select(job, "_r.*")
    j = first.alias("n").join(leases.alias("s"), F.col(f"n.{job}") == F.col(f"s.{job}"), "left")
    free = F.col(f"s.{holder}").isNull() | (F.col(f"s.{expires}") < F.col(f"n.{at}")) | (F.col(f"s.{holder}") == F.col(f"n.{holder}"))
    return j.select(F.col(f"n.{job}"), F.col(f"n.{holder}"), free.alias("granted"))


def advance(stored: DataFrame, incoming: DataFrame, key: str, sequence: str, fields: list[str]) -> DataFrame:
    """`stored` with `fields` of the incoming row where its sequence is not older; a null stored sequence gives way (K7)."""
    j = stored.alias("s").join(incoming.alias("n"), F.col(f"s.{key}") == F.col(f"n.{key}"), "left")
    go = F.coalesce(F.col(f"s.{sequence}").isNull() | (F.col(f"s.{sequence}") <= F.col(f"n.{sequence}")), F.lit(False)) & F.col(f"n.{sequence}").isNotNull()
    return j.select(F.col(f"s.{key}"), *[F.when(go, F.col(f"n.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in [sequence, *fields]])


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table of name -> (rows, its column) without the rows of the ids in `gone`; rows of no id stay (K9)."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(ids, F.col(c) == F.col("_gone"), "left_anti") for name, (df, c) in tables.items()}


def unexpired(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """What an expiry sweep leaves: rows that expire after `now`, or never."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > now))


def cache_verdict(rows: DataFrame, key: str, required: list[str], version: str, want: int) -> DataFrame:
    """One row: rows, duplicates, missing, other_version and `accepted`, true if a cached document may be used.

    Keys are counted a key first, so that no task holds all of them.
    """
    bad = F.lit(0)
    for c in [key, *required]:
        bad = bad + F.col(c).isNull().cast("int")
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum((bad > 0).cast("long")).alias("m"), F.sum((~F.col(version).eqNullSafe(F.lit(want))).cast("long")).alias("v"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = g.agg(total(F.col("n")).alias("rows"), total(F.col("n") - 1).alias("duplicates"), total(F.col("m")).alias("missing"), total(F.col("v")).alias("other_version"))
    return out.withColumn("accepted", F.expr("duplicates + missing + other_version = 0"))


def material_changes(before: str, after: str) -> Column:
    """The material rules that two projections meet, in fixed order (V2).

    Both are structs of retracted boolean, products and places arrays, rank int (1 the gravest), illnesses long and
    instructions string. Sets count by what they gain, ranks and counts by getting worse; no earlier projection, no
    change.
    """
    b, a = lambda f: F.col(f"{before}.{f}"), lambda f: F.col(f"{after}.{f}")
    gains = lambda f: F.size(F.array_except(F.coalesce(a(f), F.array()), F.coalesce(b(f), F.array()))) > 0
    rules = [
        ("retraction", a("retracted") & ~F.coalesce(b("retracted"), F.lit(False))),
        ("products_added", gains("products")),
        ("geography_expanded", gains("places")),
        ("class_raised", a("rank") < F.coalesce(b("rank"), F.lit(99))),
        ("illness_increased", a("illnesses") > F.coalesce(b("illnesses"), F.lit(0))),
        ("instructions_changed", ~a("instructions").eqNullSafe(b("instructions"))),
    ]
    met = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules]))
    return F.when(F.col(before).isNull(), F.array().cast("array<string>")).otherwise(met)


def evidence_action(stored: Column, desired: Column, skip: Column) -> Column:
    """skipped, unchanged, gained, lost, advanced or moved_back for a dated piece of evidence."""
    return (
        F.when(F.coalesce(skip, F.lit(False)), "skipped")
        .when(stored.eqNullSafe(desired), "unchanged")
        .when(stored.isNull(), "gained")
        .when(desired.isNull(), "lost")
        .when(desired > stored, "advanced")
        .otherwise("moved_back")
    )


def match_verdict(pairs: DataFrame, case: str, other: str, exact: str, score: str, accept: float = 0.6, rival: float = 0.4) -> DataFrame:
    """(case, verdict, match) of scored candidates.

    accepted: an exact identifier in one candidate alone, or without any exact one a score of at least `accept` and
    no other of at least `rival`. ambiguous: several exact ones, or several of at least `rival`. candidate: one of at
    least `rival` alone. unmatched: none. Aggregates only: a case's candidates are never listed.
    """
    e, s = F.coalesce(F.col(exact), F.lit(False)), F.coalesce(F.col(score), F.lit(0.0))
    g = pairs.groupBy(case).agg(
        F.count_if(e).alias("ne"),
        F.min(F.when(e, F.col(other))).alias("eo"),
        F.count_if(s >= rival).alias("nr"),
        F.max(F.when(s >= rival, F.struct(s.alias("s"), F.col(other).alias("o")))).alias("top"),
    )
    verdict = (
        F.when(F.col("ne") == 1, "accepted")
        .when((F.col("ne") > 1) | (F.col("nr") > 1), "ambiguous")
        .when((F.col("nr") == 1) & (F.col("top.s") >= accept), "accepted")
        .when(F.col("nr") == 1, "candidate")
        .otherwise("unmatched")
    )
    match = F.when(verdict == "accepted", F.coalesce("eo", "top.o"))
    return g.select(case, verdict.alias("verdict"), match.alias("match"))


def link_records(records: DataFrame, known: DataFrame, native: str, parent: str, firm: str, at: str, case: str, days: int = 120) -> DataFrame:
    """(native, case, method) of incoming records: the case of the declared parent, else the one case of the firm within `days` before, else a new one."""
    p = known.select(F.col(native).alias("_p"), F.col(case).alias("_pc")).groupBy("_p").agg(F.min("_pc").alias("_pc"))
    near = records.select(native, firm, at).alias("n").join(known.alias("k"), (F.col(f"n.{firm}") == F.col(f"k.{firm}")) & F.datediff(f"n.{at}", f"k.{at}").between(0, days))
    # two cases at least show in the least and the greatest: no distinct count is needed
    one = near.groupBy(F.col(f"n.{native}").alias("_n")).agg(F.min(f"k.{case}").alias("lo"), F.max(f"k.{case}").alias("hi"))
    j = records.join(p, F.col(parent) == F.col("_p"), "left").join(one, F.col(native) == F.col("_n"), "left")
    sole = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    method = F.when(F.col("_pc").isNotNull(), "declared").when(sole.isNotNull(), "window").otherwise("new")
    return j.select(native, F.coalesce("_pc", sole).alias(case), method.alias("method"))


def keep_reviewed(stored: DataFrame, derived: DataFrame, key: str, reviewed: str, basis: str, decision: str) -> DataFrame:
    """(key, decision, kept) of a machine run: a reviewed decision stays while its `basis` is the same and the machine links nothing."""
    j = derived.alias("d").join(stored.alias("s"), F.col(f"d.{key}") == F.col(f"s.{key}"), "left")
    kept = F.coalesce(F.col(f"s.{reviewed}"), F.lit(False)) & F.col(f"s.{basis}").eqNullSafe(F.col(f"d.{basis}")) & ~F.col(f"d.{decision}").eqNullSafe(F.lit("linked"))
    return j.select(F.col(f"d.{key}"), F.when(kept, F.col(f"s.{decision}")).otherwise(F.col(f"d.{decision}")).alias(decision), kept.alias("kept"))


def latest_decisions(decisions: DataFrame, key: str, at: str, withdrawal: str, value: str) -> DataFrame:
    """(key, value, withdrawn): the decision of the latest time; among those of one time a withdrawal wins, then the least value."""
    rank = F.struct(F.col(at).alias("t"), F.col(withdrawal).cast("int").alias("w"))
    top = decisions.groupBy(key).agg(F.max(rank).alias("r"))
    j = decisions.alias("a").join(top.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{at}") == F.col("b.r.t")) & (F.col(f"a.{withdrawal}").cast("int") == F.col("b.r.w")))
    return j.groupBy(F.col(f"a.{key}")).agg(F.min(F.when(~F.col(f"a.{withdrawal}"), F.col(f"a.{value}"))).alias(value), F.bool_or(f"a.{withdrawal}").alias("withdrawn"))


def impact_axes(before: str, after: str, sets: list[str], values: list[str]) -> Column:
    """Names of the axes on which two structs differ; arrays compare as sets, values null-safe."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array())))
    out = [F.when(as_set(F.col(f"{before}.{f}")) != as_set(F.col(f"{after}.{f}")), f) for f in sets]
    out += [F.when(~F.col(f"{before}.{f}").eqNullSafe(F.col(f"{after}.{f}")), f) for f in values]
    return F.array_compact(F.array(*out))


def enrich(records: DataFrame, extra: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields, filled): `extra` speaks only where a record's value is null or blank; `filled` names those fields, so it can be taken back."""
    j = records.alias("r").join(extra.alias("x"), F.col(f"r.{key}") == F.col(f"x.{key}"), "left")
    silent = {f: F.coalesce(F.trim(F.col(f"r.{f}").cast("string")), F.lit("")) == "" for f in fields}
    filled = F.array_compact(F.array(*[F.when(silent[f] & F.col(f"x.{f}").isNotNull(), f) for f in fields]))
    return j.select(F.col(f"r.{key}"), *[F.when(silent[f], F.coalesce(f"x.{f}", f"r.{f}")).otherwise(F.col(f"r.{f}")).alias(f) for f in fields], filled.alias("filled"))
