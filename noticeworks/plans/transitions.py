"""Guarded writes and decisions over versions of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import relevance as R
from noticeworks.operators import transitions as T
from noticeworks.session import table


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")


def _changed(spark, sf):
    """A second version: other segments, and custkeys moved up by ten so that some are new."""
    c = _customers(spark, sf)
    return c.select((F.col("c_custkey") + 10).alias("c_custkey"), "c_nationkey", "c_mktsegment")


def k2_transition(spark, sf):
    return T.case_transition(_customers(spark, sf), _changed(spark, sf), "c_custkey", "c_nationkey", ["c_mktsegment"])


def k3_found(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    records = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("click").alias("event_type")).where("c_custkey > 20")
    return T.found(records, e, ["user_id", "event_type"], "event_id")


def _writes(spark, sf):
    """Customers as cases with an order's items as products; every third order proposes a change, some with a stale token."""
    c, o, k = table(spark, sf, "customer"), table(spark, sf, "orders"), F.col("o_orderkey")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("projection"), F.col("c_nationkey").cast("long").alias("last_changed_at"))
    one = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    had = one.select(F.col("o_custkey").alias("case_id"), F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))).alias("ordinal"), k.cast("string").alias("native_id"), F.lit("old").alias("name"))
    ledger = one.where(k % 5 == 0).select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("e"), (k % 40).cast("string")).alias("dedup_key"), F.lit("initial").alias("kind")).groupBy("dedup_key").agg(F.min("case_id").alias("case_id"), F.first("kind").alias("kind"))
    records = one.select(k.alias("id"), F.col("o_custkey").alias("case_id"), F.lit("pending").alias("apply_state"), F.lit("h0").alias("applied_hash"), F.when(k % 4 > 0, k % 7).alias("applied_seq"))
    x = one.join(c, F.col("o_custkey") == F.col("c_custkey")).where(k % 3 < 2)
    item = lambda n, name: F.struct(n.cast("string").alias("native_id"), F.lit(name).alias("name"))
    mark = lambda record, seq: F.struct(record.alias("record_id"), F.lit("applied").alias("state"), F.concat(F.lit("h"), seq.cast("string")).alias("content_hash"), seq.alias("seq"))
    proposals = x.select(
        F.col("o_custkey").alias("case_id"),
        F.when(k % 3 == 0, F.col("c_nationkey").cast("long")).otherwise(F.lit(-1).cast("long")).alias("expected"),
        F.concat("c_mktsegment", F.lit("!")).alias("projection"),
        (F.col("c_nationkey") + 100).cast("long").alias("last_changed_at"),
        F.when(k % 2 == 0, F.array(item(k, "a"), item(k + 1, "b"))).alias("products"),
        F.array(F.struct(F.concat(F.lit("e"), (k % 40).cast("string")).alias("dedup_key"), F.lit("update").alias("kind")), F.struct(F.concat(F.lit("u"), k.cast("string")).alias("dedup_key"), F.lit("update").alias("kind"))).alias("events"),
        F.array(mark(k, F.lit(3).cast("long")), mark(k, F.lit(2).cast("long")), mark(k + 1, F.lit(9).cast("long"))).alias("markers"),
    )
    return T.case_writes(cases, had, ledger, records, proposals)


def k2_products(spark, sf):
    return _writes(spark, sf)["products"]


def k2_records(spark, sf):
    return _writes(spark, sf)["records"]


def k2_outcomes(spark, sf):
    w = _writes(spark, sf)
    return w["outcomes"].join(w["cases"], "case_id").select("case_id", "status", "projection", F.array_join("inserted", "|").alias("inserted"))


def k3_founding(spark, sf):
    """Founded cases of suppliers, one row for each product with its case's event."""
    s = table(spark, sf, "supplier")
    incoming = s.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("at"), F.col("s_name").alias("projection"), F.md5("s_name").alias("content_hash"), F.array(F.struct(F.col("s_suppkey").cast("string").alias("native_id"), F.lit("x").alias("name")), F.struct(F.lit("0").alias("native_id"), F.col("s_name").alias("name"))).alias("products"))
    w = T.founding_rows(table(spark, sf, "nation").where("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("nation")), incoming, ["nation"], "at")
    rows = w["products"].join(w["cases"], "case_id").join(w["events"].select("case_id", F.col("kind")), "case_id").join(w["records"].select("case_id", "nation"), "case_id").join(w["snapshots"].select("case_id", "content_hash"), "case_id")
    return rows.select("nation", "ordinal", "native_id", "name", "projection", "kind", "content_hash")


def k5_upsert(spark, sf):
    return T.upsert(_customers(spark, sf), _changed(spark, sf), "c_custkey", ["c_nationkey", "c_mktsegment"])


def k6_leases(spark, sf):
    e = table(spark, sf, "events")
    leases = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("job")).agg(F.max("value").alias("holder"), (F.min("ts") + F.expr("INTERVAL 2 DAYS")).alias("until"))
    asked = e.where("event_type = 'click'").select(F.col("user_id").alias("job"), F.col("value").alias("holder"), "ts")
    return T.acquire_leases(leases, asked, "job", "holder", "ts", "until").select("job", "granted")


def k7_advance(spark, sf):
    c = table(spark, sf, "customer")
    stored = c.select("c_custkey", F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("seq"), "c_mktsegment")
    incoming = c.select("c_custkey", (F.length("c_mktsegment")).alias("seq"), F.lit("new").alias("c_mktsegment"))
    return T.advance(stored, incoming, "c_custkey", "seq", ["c_mktsegment"])


def k9_cascade(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0")
    left = T.cascade_delete({"orders": (table(spark, sf, "orders"), "o_custkey"), "events": (table(spark, sf, "events"), "user_id"), "customer": (table(spark, sf, "customer"), "c_custkey")}, gone, "c_custkey")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


def k10_unexpired(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires"))
    return T.unexpired(e, "expires", F.lit("2024-01-30 00:00:00").cast("timestamp")).select("event_id")


def k12_cache(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", F.lit(3).alias("v"))
    again = table(spark, sf, "labels").select("doc_id", F.lit("").alias("text"), F.lit("en").alias("lang"), F.lit(2).alias("v"))
    return T.cache_verdict(d.union(again), "doc_id", ["text", "lang"], "v", 3)


def _projections(spark, sf):
    """Two projections an order: of its finished lines, and of all."""
    li = table(spark, sf, "lineitem")
    done = F.col("l_linestatus") == "F"

    def of(keep):
        return F.struct(
            F.bool_or(F.when(keep, F.col("l_returnflag") == "R")).alias("retracted"),
            F.collect_set(F.when(keep, F.col("l_partkey"))).alias("products"),
            F.collect_set(F.when(keep, F.col("l_suppkey"))).alias("places"),
            F.min(F.when(keep, F.col("l_linenumber"))).alias("rank"),
            F.count_if(keep & (F.col("l_tax") > 0.04)).alias("illnesses"),
            F.max(F.when(keep, F.col("l_returnflag"))).alias("instructions"),
        )

    return li.groupBy("l_orderkey").agg(F.when(F.bool_or(done), of(done)).alias("b"), of(F.lit(True)).alias("a"))


def v2_material_changes(spark, sf):
    return _projections(spark, sf).select("l_orderkey", F.array_join(T.material_changes("b", "a"), "|").alias("changes"))


def v23_impact_axes(spark, sf):
    p = _projections(spark, sf).where("b is not null")
    return p.select("l_orderkey", F.array_join(T.impact_axes("b", "a", ["products", "places"], ["rank", "instructions"]), "|").alias("axes"))


def v10_open_evidence(spark, sf):
    o = table(spark, sf, "orders")
    day = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.to_date("o_orderdate")))
    g = o.groupBy("o_custkey").agg(day("F").alias("stored"), day("O").alias("desired"), F.bool_or(F.col("o_orderstatus") == "P").alias("skip"))
    return g.select("o_custkey", T.evidence_action(F.col("stored"), F.col("desired"), F.col("skip")).alias("action"))


def v15_match_verdict(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.round(F.col("l_tax") * 100) == 8).alias("exact"), (F.round(F.col("l_discount") * 1000) / 160).alias("score"))
    return T.match_verdict(li, "l_orderkey", "l_linenumber", "exact", "score")


def v17_link_records(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("native"), F.col("o_custkey").alias("firm"), F.to_date("o_orderdate").alias("at"), "o_orderstatus")
    known = o.where("o_orderstatus = 'F'").select("native", "firm", "at", (F.col("native") * 10).alias("case_id"))
    new = o.where("o_orderstatus <> 'F'").select("native", "firm", "at", (F.col("native") - 1).alias("parent"))
    return T.link_records(new, known, "native", "parent", "firm", "at", "case_id")


def v19_keep_reviewed(spark, sf):
    c = table(spark, sf, "customer")
    stored = c.select("c_custkey", (F.col("c_acctbal") > 0).alias("reviewed"), (F.col("c_nationkey") % 2).alias("basis"), F.lit("approved").alias("decision"))
    derived = c.select((F.col("c_custkey") + 3).alias("c_custkey"), (F.col("c_nationkey") % 2).alias("basis"), F.when(F.col("c_mktsegment") == "BUILDING", "linked").otherwise("no_match").alias("decision"))
    return T.keep_reviewed(stored, derived, "c_custkey", "reviewed", "basis", "decision")


def v21_decisions(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("withdrawal"), "event_id")
    return T.latest_decisions(e, "user_id", "day", "withdrawal", "event_id")


def v24_enrich(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_nationkey") % 2 > 0, F.col("c_name")).otherwise(" ").alias("c_name"))
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("c_custkey"), F.col("p_brand").alias("c_mktsegment"), F.col("p_name").alias("c_name"))
    out = T.enrich(c, s, "c_custkey", ["c_mktsegment", "c_name"])
    return out.withColumn("filled", F.array_join("filled", "|"))


def a5_distinct_list(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


def a12_gates(spark, sf):
    lab, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    hit = (F.col("n_chars") > 500).cast("int")
    g = lab.join(d, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit == F.col("quality")).alias("right"), F.count_if((hit == 1) & (F.col("quality") == 0)).alias("wrong_hits"))
    fails = F.array_compact(F.array(F.when(F.col("n") < 20, "support"), F.when(F.col("right") * 10 < F.col("n") * 9, "accuracy"), F.when(F.col("wrong_hits") * 20 > F.col("n"), "precision")))
    verdict = F.when(F.size(fails) == 0, "GREEN").when(F.size(fails) == 1, "YELLOW").otherwise("NOT_PASSING")
    return g.select("source", F.array_join(fails, "|").alias("failures"), verdict.alias("verdict"))


def a14_applied_health(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("applied"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"), F.date_format(F.min(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))), "yyyy-MM-dd").alias("oldest_open"))


def r4_horizon(spark, sf):
    e = table(spark, sf, "events")
    at = lambda t: F.min(F.when(F.col("event_type") == t, F.col("ts")))
    h = e.groupBy(F.col("user_id").alias("u")).agg(F.greatest(at("login"), at("view"), at("error")).alias("horizon"))
    due = (F.col("ts") >= F.col("horizon")) & (F.col("ts") >= F.lit("2024-01-30").cast("timestamp") - F.expr("INTERVAL 20 DAYS"))
    return e.join(h, F.col("user_id") == F.col("u")).where(due).select("event_id", "user_id")


def c17_relevance(spark, sf):
    """Every order as a case, judged for its customer."""
    o, c, li = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "lineitem")
    kids = li.groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 25).alias("states"), F.bool_or(F.col("l_returnflag") == "R").alias("signal"), F.bool_and(F.col("l_linestatus") == "F").alias("mismatch"))
    first = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    scope = F.when(first == "1", "nationwide").when(first == "5", "unknown").otherwise("states")
    chosen = F.when(F.col("c_acctbal") > 0, F.array(F.col("c_nationkey").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    j = o.join(kids, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", R.geographic(scope, F.col("states"), chosen).alias("geographic"), R.affects(scope, F.col("states"), chosen, F.col("signal"), F.col("mismatch")).alias("affects"))


def c11_illness(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "explicit_none").when(F.col("event_type") == "purchase", "reported_count").otherwise("unknown")
    newest, reports = R.newest_illness(kind, F.struct("ts", "event_id"))
    said = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(newest.alias("newest"), reports.alias("reports"))
    return said.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), R.settled_illness(F.col("newest"), F.col("reports")).alias("status"))


QUERIES = {f.__name__: f for f in (k2_transition, k2_products, k2_records, k2_outcomes, k3_found, k3_founding, k5_upsert, k6_leases, k7_advance, k9_cascade, k10_unexpired, k12_cache, v2_material_changes, v23_impact_axes, v10_open_evidence, v15_match_verdict, v17_link_records, v19_keep_reviewed, v21_decisions, v24_enrich, a5_distinct_list, a12_gates, a14_applied_health, r4_horizon, c17_relevance, c11_illness)}

CHANGED = "WITH n AS (SELECT c_custkey + 10 AS c_custkey, c_nationkey, c_mktsegment FROM customer) "
SIDES = """
WITH g AS (SELECT l_orderkey, bool_or(l_linestatus = 'F') AS known,
  coalesce(bool_or(l_returnflag = 'R') FILTER (l_linestatus = 'F'), false) AS br, bool_or(l_returnflag = 'R') AS ar,
  coalesce(list(DISTINCT l_partkey) FILTER (l_linestatus = 'F'), []) AS bp, list(DISTINCT l_partkey) AS ap,
  coalesce(list(DISTINCT l_suppkey) FILTER (l_linestatus = 'F'), []) AS bs, list(DISTINCT l_suppkey) AS asu,
  min(l_linenumber) FILTER (l_linestatus = 'F') AS bk, min(l_linenumber) AS ak,
  count(*) FILTER (l_linestatus = 'F' AND l_tax > 0.04) AS bi, count(*) FILTER (l_tax > 0.04) AS ai,
  max(l_returnflag) FILTER (l_linestatus = 'F') AS bn, max(l_returnflag) AS an FROM lineitem GROUP BY l_orderkey)
"""

WRITES = """
WITH o AS (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY 1), x AS (SELECT o.*, c_nationkey AS nat, c_mktsegment AS seg FROM o JOIN customer ON c = c_custkey WHERE k % 3 < 2), d AS (SELECT * FROM x WHERE k % 3 = 0),
l AS (SELECT DISTINCT 'e' || k % 40 AS key FROM o WHERE k % 5 = 0),
e AS (SELECT c, 'e' || k % 40 AS key FROM d UNION ALL SELECT c, 'u' || k FROM d), f AS (SELECT key, min(c) AS c FROM e WHERE key NOT IN (SELECT key FROM l) GROUP BY key)"""

ORACLES = {
    "k2_products": WRITES + """ SELECT o.c AS case_id, unnest(range(0, k % 3 + 1))::INTEGER AS ordinal, k::VARCHAR AS native_id, 'old' AS name FROM o WHERE c NOT IN (SELECT c FROM d)
UNION ALL SELECT c, unnest([0, 1])::INTEGER, unnest([k::VARCHAR, (k + 1)::VARCHAR]), unnest(['a', 'b']) FROM d WHERE k % 2 = 0""",
    "k2_records": WRITES + """, m AS (SELECT o.*, CASE WHEN k % 4 > 0 THEN k % 7 END AS seq, CASE WHEN o.c IN (SELECT c FROM d) THEN CASE WHEN k % 4 = 0 OR k % 7 <= 3 THEN 3 END END AS new FROM o)
SELECT k AS id, c AS case_id, CASE WHEN new IS NULL THEN 'pending' ELSE 'applied' END AS apply_state, CASE WHEN new IS NULL THEN 'h0' ELSE 'h' || new END AS applied_hash, coalesce(new, seq)::BIGINT AS applied_seq FROM m""",
    "k2_outcomes": WRITES + """ SELECT x.c AS case_id, CASE WHEN k % 3 = 0 THEN 'applied' ELSE 'conflict' END AS status, seg || CASE WHEN k % 3 = 0 THEN '!' ELSE '' END AS projection,
  coalesce((SELECT string_agg(key, '|' ORDER BY key) FROM f WHERE f.c = x.c), '') AS inserted FROM x""",
    "k3_founding": """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier), f AS (SELECT * FROM s WHERE r = 1 AND s_nationkey % 4 <> 1)
SELECT s_nationkey AS nation, unnest([0, 1])::INTEGER AS ordinal, unnest([s_suppkey::VARCHAR, '0']) AS native_id, unnest(['x', s_name]) AS name, s_name AS projection, 'initial' AS kind, md5(s_name) AS content_hash FROM f""",
    "k2_transition": CHANGED
    + """SELECT n.c_custkey, CASE WHEN s.c_custkey IS NULL THEN 'missing' WHEN n.c_nationkey IS DISTINCT FROM s.c_nationkey THEN 'conflict'
  WHEN n.c_mktsegment IS NOT DISTINCT FROM s.c_mktsegment THEN 'unchanged' ELSE 'applied' END AS outcome,
  CASE WHEN n.c_nationkey = s.c_nationkey THEN n.c_mktsegment ELSE s.c_mktsegment END AS c_mktsegment
FROM n LEFT JOIN customer s ON n.c_custkey = s.c_custkey""",
    "k3_found": """
SELECT user_id, event_type, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1
  AND NOT (event_type = 'click' AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey > 20)) THEN 'founded' ELSE 'record_exists' END AS outcome FROM events""",
    "k5_upsert": CHANGED + "SELECT * FROM n UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)",
    "k6_leases": """
WITH l AS (SELECT user_id AS job, max(value) AS holder, min(ts) + INTERVAL 2 DAY AS until FROM events WHERE event_type = 'purchase' GROUP BY 1),
r AS (SELECT user_id AS job, value AS holder, ts FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, value) = 1)
SELECT r.job, coalesce(l.holder IS NULL OR l.until < r.ts OR l.holder = r.holder, false) AS granted FROM r LEFT JOIN l ON l.job = r.job""",
    "k7_advance": """
WITH s AS (SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS seq, length(c_mktsegment)::INT AS n, c_mktsegment AS m FROM customer)
SELECT c_custkey, CASE WHEN seq IS NULL OR seq <= n THEN n ELSE seq END AS seq, CASE WHEN seq IS NULL OR seq <= n THEN 'new' ELSE m END AS c_mktsegment FROM s""",
    "k9_cascade": """
WITH g AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0)
SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT k FROM g)
UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT k FROM g)
UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM g)""",
    "k10_unexpired": "SELECT event_id FROM events WHERE event_type = 'error' OR ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-30'",
    "k12_cache": """
WITH a AS (SELECT doc_id, text, lang, 3 AS v FROM documents UNION ALL SELECT doc_id, '', 'en', 2 FROM labels),
s AS (SELECT count(*) AS rows, (count(*) - count(DISTINCT doc_id) - max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END))::BIGINT AS duplicates,
  count_if(doc_id IS NULL OR text IS NULL OR lang IS NULL)::BIGINT AS missing, count_if(v <> 3)::BIGINT AS other_version FROM a)
SELECT *, duplicates + missing + other_version = 0 AS accepted FROM s""",
    "v2_material_changes": SIDES
    + """SELECT l_orderkey, CASE WHEN known THEN array_to_string(list_filter([CASE WHEN ar AND NOT br THEN 'retraction' END,
  CASE WHEN len(list_filter(ap, lambda x: NOT list_contains(bp, x))) > 0 THEN 'products_added' END,
  CASE WHEN len(list_filter(asu, lambda x: NOT list_contains(bs, x))) > 0 THEN 'geography_expanded' END,
  CASE WHEN ak < bk THEN 'class_raised' END, CASE WHEN ai > bi THEN 'illness_increased' END,
  CASE WHEN an IS DISTINCT FROM bn THEN 'instructions_changed' END], lambda x: x IS NOT NULL), '|') ELSE '' END AS changes FROM g""",
    "v23_impact_axes": SIDES
    + """SELECT l_orderkey, array_to_string(list_filter([CASE WHEN list_sort(ap) <> list_sort(bp) THEN 'products' END,
  CASE WHEN list_sort(asu) <> list_sort(bs) THEN 'places' END, CASE WHEN ak IS DISTINCT FROM bk THEN 'rank' END,
  CASE WHEN an IS DISTINCT FROM bn THEN 'instructions' END], lambda x: x IS NOT NULL), '|') AS axes FROM g WHERE known""",
    "v10_open_evidence": """
WITH g AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END) AS s, max(CASE WHEN o_orderstatus = 'O' THEN o_orderdate::DATE END) AS d, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN p THEN 'skipped' WHEN s IS NOT DISTINCT FROM d THEN 'unchanged' WHEN s IS NULL THEN 'gained' WHEN d IS NULL THEN 'lost' WHEN d > s THEN 'advanced' ELSE 'moved_back' END AS action FROM g""",
    "v15_match_verdict": """
WITH l AS (SELECT l_orderkey, l_linenumber, round(l_tax * 100) = 8 AS e, round(l_discount * 1000) / 160 AS s FROM lineitem),
g AS (SELECT l_orderkey, count_if(e) AS ne, min(CASE WHEN e THEN l_linenumber END) AS eo, count_if(s >= 0.4) AS nr, max(CASE WHEN s >= 0.4 THEN s END) AS ts,
  max(CASE WHEN s >= 0.4 THEN l_linenumber END) AS t FROM l GROUP BY 1),
v AS (SELECT *, CASE WHEN ne = 1 THEN 'accepted' WHEN ne > 1 OR nr > 1 THEN 'ambiguous' WHEN nr = 1 AND ts >= 0.6 THEN 'accepted' WHEN nr = 1 THEN 'candidate' ELSE 'unmatched' END AS verdict FROM g)
SELECT l_orderkey, verdict, CASE WHEN verdict = 'accepted' THEN coalesce(eo, t) END AS "match" FROM v""",
    "v17_link_records": """
WITH k AS (SELECT o_orderkey AS native, o_custkey AS firm, o_orderdate::DATE AS d, o_orderkey * 10 AS c FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT o_orderkey AS native, o_custkey AS firm, o_orderdate::DATE AS d, o_orderkey - 1 AS parent FROM orders WHERE o_orderstatus <> 'F'),
w AS (SELECT n.native, min(k.c) AS c FROM n JOIN k ON n.firm = k.firm AND date_diff('day', k.d, n.d) BETWEEN 0 AND 120 GROUP BY 1 HAVING count(DISTINCT k.c) = 1)
SELECT n.native, coalesce(p.c, w.c) AS case_id, CASE WHEN p.c IS NOT NULL THEN 'declared' WHEN w.c IS NOT NULL THEN 'window' ELSE 'new' END AS method
FROM n LEFT JOIN k p ON p.native = n.parent LEFT JOIN w ON w.native = n.native""",
    "v19_keep_reviewed": """
WITH d AS (SELECT c_custkey + 3 AS k, c_nationkey % 2 AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN 'linked' ELSE 'no_match' END AS m FROM customer),
j AS (SELECT d.*, coalesce(c_acctbal > 0, false) AND c_nationkey % 2 IS NOT DISTINCT FROM b AND m <> 'linked' AS kept FROM d LEFT JOIN customer ON c_custkey = k)
SELECT k AS c_custkey, CASE WHEN kept THEN 'approved' ELSE m END AS decision, kept FROM j""",
    "v21_decisions": """
WITH r AS (SELECT *, event_type = 'error' AS w, rank() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS k FROM events)
SELECT user_id, min(CASE WHEN NOT w THEN event_id END) AS event_id, bool_or(w) AS withdrawn FROM r WHERE k = 1 GROUP BY user_id""",
    "v24_enrich": """
WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN c_mktsegment END AS s, CASE WHEN c_nationkey % 2 > 0 THEN c_name ELSE ' ' END AS n FROM customer)
SELECT c_custkey, coalesce(s, p_brand) AS c_mktsegment, CASE WHEN n = ' ' THEN coalesce(p_name, n) ELSE n END AS c_name,
  array_to_string(list_filter([CASE WHEN s IS NULL AND p_brand IS NOT NULL THEN 'c_mktsegment' END, CASE WHEN n = ' ' AND p_name IS NOT NULL THEN 'c_name' END], lambda x: x IS NOT NULL), '|') AS filled
FROM r LEFT JOIN part ON p_partkey = c_custkey""",
    "a5_distinct_list": "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey",
    "a12_gates": """
WITH g AS (SELECT source, count(*) AS n, count_if((n_chars > 500)::INT = quality) AS r, count_if(n_chars > 500 AND quality = 0) AS w FROM labels JOIN documents USING (doc_id) GROUP BY source),
f AS (SELECT source, list_filter([CASE WHEN n < 20 THEN 'support' END, CASE WHEN r * 10 < n * 9 THEN 'accuracy' END, CASE WHEN w * 20 > n THEN 'precision' END], lambda x: x IS NOT NULL) AS x FROM g)
SELECT source, array_to_string(x, '|') AS failures, CASE len(x) WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'NOT_PASSING' END AS verdict FROM f""",
    "a14_applied_health": """
SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS applied, count_if(o_orderstatus = 'O')::BIGINT AS pending, count_if(o_orderstatus = 'P')::BIGINT AS failed,
  strftime(min(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END), '%Y-%m-%d') AS oldest_open FROM orders GROUP BY 1""",
    "r4_horizon": """
WITH h AS (SELECT user_id, greatest(min(CASE WHEN event_type = 'login' THEN ts END), min(CASE WHEN event_type = 'view' THEN ts END), min(CASE WHEN event_type = 'error' THEN ts END)) AS t FROM events GROUP BY 1)
SELECT event_id, e.user_id FROM events e JOIN h USING (user_id) WHERE ts >= t AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAY""",
    "c17_relevance": """
WITH k AS (SELECT l_orderkey, list(DISTINCT l_suppkey % 25) AS st, bool_or(l_returnflag = 'R') AS sig, bool_and(l_linestatus = 'F') AS mis FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS p, list_contains(st, c_nationkey) AS hit, c_acctbal > 0 AS chose, sig, mis
  FROM orders JOIN k ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
g AS (SELECT *, CASE WHEN p = '1' THEN 'matches' WHEN p = '5' OR NOT chose THEN 'unknown' WHEN hit THEN 'matches' ELSE 'does_not_match' END AS geographic FROM j)
SELECT o_orderkey, geographic, geographic <> 'does_not_match' AND NOT mis AND ((geographic = 'matches' AND chose) OR sig) AS affects FROM g""",
    "c11_illness": """
WITH e AS (SELECT user_id, ts::DATE AS d, ts, event_id, CASE event_type WHEN 'error' THEN 'none' WHEN 'purchase' THEN 'count' END AS k FROM events),
g AS (SELECT user_id, d, arg_max(k, (ts, event_id)) FILTER (k IS NOT NULL) AS newest, count_if(k = 'count') AS reports FROM e GROUP BY 1, 2)
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, CASE WHEN newest IS NULL THEN 'unknown' WHEN newest = 'count' THEN 'reported_count' WHEN reports > 0 THEN 'reported_unspecified' ELSE 'explicit_none' END AS status FROM g""",
}
