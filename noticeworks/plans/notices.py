"""Approved notices, facts, expansions, states and barcodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import geography, identifiers
from noticeworks.operators import decisions as D
from noticeworks.operators import notices as N
from noticeworks.plans.decided import NOW, _turn, pick
from noticeworks.session import spread, table

PRIORITY = ("upc", "lot", "best_by")


def a18_facts(spark, sf):
    x = table(spark, sf, "lineitem")
    k = F.col("l_partkey")
    facts = x.select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("pos"),
        pick(k, "lot", "best_by", "upc", "note", "layout").alias("concept"),
        F.concat(F.lit("v"), (F.col("l_suppkey") % 4).cast("string")).alias("display"),
        F.col("l_suppkey").cast("string").alias("raw"),
        F.when(F.col("l_suppkey") % 4 == 3, "").otherwise((F.col("l_suppkey") % 4).cast("string")).alias("canonical"),
        F.when(F.col("l_suppkey") % 4 > 0, (9 - F.col("l_suppkey") % 4).cast("string")).alias("sort_key"),
        pick(F.col("l_suppkey"), "Batch no.", "Lot", None).alias("source_label"),
        (k % 7 > 0).alias("valid"),
    )
    out = N.aggregate_facts(facts, PRIORITY, ("best_by",), ("layout",))
    return out.select("case_id", "concept", "place", *[F.array_join(c, "|").alias(c) for c in ("shown", "raw", "keys")], "is_batch")


def c22_next(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    expires = F.when(k % 4 != 0, F.col("ts") + F.expr("INTERVAL 20 DAYS"))
    since = F.when(k % 19 != 0, F.lit("2024-01-10").cast("timestamp"))
    seen = F.when(k % 7 != 0, k % 2 != 0)
    n = D.next_entitlement(pick(k, "active", "inactive", None), expires, since, seen, F.when(k % 5 != 0, F.col("ts")), F.lit(NOW).cast("timestamp"))
    return e.select("event_id", n.alias("n")).select("event_id", "n.*")


def p16_approved(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    notices = o.select(
        k.alias("id"),
        F.col("o_orderpriority").alias("publisher"),
        F.md5(k.cast("string")).alias("document_content_hash"),
        F.when(k % 5 > 0, "new_candidate").otherwise("linked").alias("decision"),
        F.when(k % 7 > 0, "recall").otherwise("update").alias("notice_kind"),
        F.when(k % 11 > 0, "food").alias("food_status"),
        F.when(k % 13 > 0, "text").otherwise("image").alias("document_extraction"),
        F.when(k % 17 > 0, F.to_date("o_orderdate")).alias("stated_notice_date"),
    )
    x = table(spark, sf, "lineitem")
    approvals = x.select(
        F.col("l_orderkey").alias("notice_id"),
        F.md5(F.when(F.col("l_partkey") % 3 > 0, F.col("l_orderkey")).otherwise(-1).cast("string")).alias("document_content_hash"),
        F.when(F.col("l_partkey") % 10 > 0, 1).otherwise(2).alias("fields_version"),
        F.to_date("l_shipdate").alias("approved_at"),
        F.when(F.col("l_suppkey") % 4 == 0, F.to_date("l_shipdate")).alias("withdrawn_at"),
        F.when(F.col("l_suppkey") % 9 == 0, F.col("l_orderkey")).alias("agency_case_id"),
    )
    return N.approved_notices(approvals, notices)


def v3_expansions(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    case = F.col("o_custkey").alias("case_id")
    records = o.select(case, k.alias("native_id"), F.when(k % 3 > 0, F.concat(F.lit("F-"), k.cast("string"))).alias("expansion_of"))
    known = o.where(k % 5 == 0).select(case, k.alias("native_id"))
    events = o.select(case, k.alias("native_id"), pick(k, "expansion_geography", "class", None, "expansion_products").alias("rule_id"))
    return N.expansion_events(records, known, events)


CODES_BY_NAME = sorted(geography.STATES, key=geography.STATES.get)


def _nth(values, i):
    return F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))


def _places(spark, sf):
    """Parts with three states, and a text that names them in one of several ways, or misleads."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    code = [_nth(CODES_BY_NAME, k * m + d) for m, d in ((1, 0), (7, 3), (11, 5))]
    name = [_nth([geography.STATES[c] for c in CODES_BY_NAME], k * m + d) for m, d in ((1, 0), (7, 3), (11, 5))]
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    texts = (
        say(F.initcap("p_name"), " sold in ", name[0], " and ", name[1], "."),
        say("Shipped to stores in ", code[0], ", ", code[1], " and ", code[2]),
        say("Made in Portland, ", code[0], " 97201; not in QX ", F.col("p_name")),
        say(F.col("p_name"), " sold in ", code[0]),
        say("Sold near QX, ", code[0], " and lots ", code[1], "9"),
        say("North and South Dakota, Washington, D.C.; ", name[0]),
        say("within ", code[0], " Foods or ", F.lower(name[1]), "town"),
    )
    return p.select("p_partkey", *[c.alias(f"c{i}") for i, c in enumerate(code)], pick(k, *texts, "").alias("t"))


def x20_states(spark, sf):
    return _places(spark, sf).select("p_partkey", F.array_join(geography.states_in(F.col("t")), "|").alias("states"))


def x21_state(spark, sf):
    p = _places(spark, sf)
    t = pick(F.col("p_partkey"), F.col("c0"), F.lower("c0"), F.concat(F.lit(" "), _nth(sorted(geography.STATES.values()), F.col("p_partkey")), F.lit(".\n")), F.col("t"))
    return p.select("p_partkey", geography.state_of(t).alias("state"))


def i11_order(spark, sf):
    p = _places(spark, sf)
    return p.select("p_partkey", F.array_join(geography.state_names(F.array("c1", "c0", F.lit("ZZ"), "c2", "c0", F.lit(None))), "|").alias("names"))


def _codes(spark, sf):
    """Parts with three codes of 12, 13 and 8 digits, and a cell that prints them in one of several ways."""
    p, k = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    a, b, c = F.lpad(k, 12, "4"), F.lpad(k, 13, "9"), F.lpad(k, 8, "5")
    spaced = F.concat_ws(" ", F.substring(a, 1, 1), F.substring(a, 2, 5), F.substring(a, 7, 5), F.substring(a, 12, 1))
    cells = (
        F.concat(F.lit("UPC: "), spaced),
        F.concat(F.lit("UPC "), a, F.lit(" / "), b, F.lit(" (case)")),
        F.concat(F.lit("2 "), a),
        F.concat(F.regexp_replace(c, "^(.{4})", "$1 "), F.lit(" AND "), a, F.lit("; "), a),
        F.concat(F.lit("lot "), F.substring(a, 8, 5)),
        F.concat(c, F.lit(" & "), F.regexp_replace(b, "^(.)(.{6})", "$1-$2-"), F.lit(" + "), a, F.lit("\n"), b, F.lit("  "), c),
    )
    return p.select("p_partkey", pick(F.col("p_partkey"), *cells, "").alias("t"))


def i3_barcodes(spark, sf):
    return _codes(spark, sf).select("p_partkey", F.array_join(identifiers.barcodes(F.col("t")), "|").alias("codes"))


def i2_gtins(spark, sf):
    """The lookup keys of a part's printed identifiers, and why the first is none."""
    p, k = spread(table(spark, sf, "part").select("p_partkey")), F.col("p_partkey")
    whole = lambda n: F.concat(body := F.lpad(k.cast("string"), n - 1, "7"), identifiers.gtin_check_digit(body).cast("string"))
    first = pick(k, whole(12), whole(8), F.concat(F.lit("L"), whole(12)), F.lpad(k.cast("string"), 10, "1"), F.concat(F.substring(whole(13), 1, 12), F.lit("x")), F.regexp_replace(whole(14), "^(.)(.{6})", " $1-$2 "))
    codes = F.array(first, whole(13), F.concat(F.lit("0"), whole(13)), whole(8), F.lit(None).cast("string"), whole(14))
    return p.select("p_partkey", F.array_join(identifiers.exact_gtins(codes), "|").alias("keys"), identifiers.gtin(first).alias("g")).select("p_partkey", "keys", "g.ambiguous", "g.reason")


def i5_code_dates(spark, sf):
    """Codes with their dates in one cell of a line item, and in two cells that list them."""
    x = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    code, other = F.concat(F.lit("L"), F.lpad(F.col("l_partkey").cast("string"), 5, "0")), F.concat(F.col("l_suppkey").cast("string"), F.lit("-A1"))
    day, k = F.to_date("l_shipdate"), F.col("l_partkey")
    iso, us, named = (F.date_format(day, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "MMM d, yyyy"))
    cell = pick(k, F.concat(code, F.lit(" - "), iso, F.lit("; "), code, F.lit(" – "), us), F.concat(F.lit("Lot "), code, F.lit(" ("), named, F.lit(") "), F.lit("B99"), F.lit(" — 13/45/2020")), F.concat(us, F.lit(" - "), iso, F.lit(" "), code, F.lit("-"), iso), None)
    codes, dates = F.concat(code, F.lit("; "), other), F.when(k % 3 > 0, F.concat(us, F.lit(" and "), iso)).otherwise(us)
    show = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat(p["code"], F.lit("="), F.date_format(identifiers.printed_date(p["date"]), "yyyyMMdd"))), "|")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", show(identifiers.code_date_pairs(cell)).alias("pairs"), show(identifiers.aligned_pairs(codes, dates)).alias("aligned"))


def v16_same_event(spark, sf):
    """Records of one firm, with texts of their own, judged pair by pair."""
    o, k = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")), F.col("o_orderkey")
    product = F.concat(pick(F.col("o_custkey"), "ring", "bolt", "widget"), F.lit(" number "), (F.col("o_custkey") % 9).cast("string"), F.lit(" soup"))
    plain = F.concat(F.lit("Acme Recalls "), product)
    title = F.when(k % 5 == 0, F.concat(F.lit("Acme Expands Recall of "), product, F.lit(" Due to Milk"))).when(k % 5 == 1, F.concat(F.lit("Updated – "), plain)).otherwise(plain)
    extra = F.when(k % 3 == 0, "alpha beta gamma delta epsilon zeta theta kappa lambda sigma").when(k % 3 == 1, "alpha beta gamma").otherwise("")
    # five places hold no longer key whole, so the last digit tells the two codes of a firm apart
    upc = F.concat(F.lit("UPC 0 "), F.lpad((F.col("o_custkey") + k % 2).cast("string"), 5, "1"), F.lit(" 22222 "), (k % 2 + 3).cast("string"))
    body = F.concat_ws(" ", F.when(k % 7 == 0, "This updated press release includes news."), F.lit("one two three four five six seven eight nine ten firm said it was told of milk in its soup"), extra, upc)
    ids = F.array(F.when(k % 11 == 0, F.concat(F.lit("acme-company-recalls-its-soup-"), F.col("o_custkey").cast("string"), F.lit("-0"))).otherwise(F.concat(F.lit("acme-company-recalls-its-soup-"), F.col("o_custkey").cast("string"))))
    hazard = F.when(k % 13 > 1, "allergen").otherwise("unknown")
    agency = F.when(F.col("o_custkey") % 4 == 0, "FSIS").otherwise("FDA")
    r = o.select(F.col("o_custkey").alias("firm"), F.col("o_orderpriority").alias("prio"), k.alias("id"), F.struct(title.alias("title"), body.alias("body"), hazard.alias("hazard"), F.to_date("o_orderdate").alias("published"), ids.alias("source_ids"), agency.alias("agency")).alias("r"))
    # both sides of the join read this one shuffle
    r = r.select("firm", "prio", "id", D.event_features("r").alias("r")).repartition("firm", "prio")
    later = r.select("firm", "prio", F.col("id").alias("other"), F.col("r").alias("s"))
    pairs = r.join(later, ["firm", "prio"]).where("id < other").withColumn("signals", D.event_signals("r", "s"))
    return pairs.select("id", "other", D.duplicate_verdict("signals").alias("verdict"))


QUERIES = {f.__name__: f for f in (a18_facts, c22_next, p16_approved, v3_expansions, x20_states, x21_state, i11_order, i3_barcodes, i2_gtins, i5_code_dates, v16_same_event)}

PLACES_SQL = "WITH n AS (SELECT [" + ", ".join(f"'{geography.STATES[c]}'" for c in CODES_BY_NAME) + "] AS n), s AS (SELECT p_partkey, n[(p_partkey % 52) + 1] AS n0, n[((p_partkey * 7 + 3) % 52) + 1] AS n1, n[((p_partkey * 11 + 5) % 52) + 1] AS n2 FROM part, n)"

ORACLES = {
    "a18_facts": f"""
        WITH f AS (
          SELECT l_orderkey AS case_id, l_linenumber AS pos, l_suppkey % 4 AS m, CAST(l_suppkey AS VARCHAR) AS raw, l_partkey % 7 > 0 AS valid,
            {_turn("l_partkey", "lot", "best_by", "upc", "note", "layout")} AS concept, l_suppkey % 3 = 0 AS says_batch
          FROM lineitem),
        g AS (SELECT *, row_number() OVER (PARTITION BY case_id, concept, m ORDER BY pos, raw) AS k FROM f WHERE valid AND m < 3 AND concept <> 'layout'),
        v AS (SELECT *, CASE WHEN concept <> 'best_by' THEN '' WHEN m > 0 THEN CAST(9 - m AS VARCHAR) ELSE 'z' END AS late FROM g WHERE k = 1)
        SELECT case_id, concept, CASE concept WHEN 'upc' THEN 1 WHEN 'lot' THEN 2 WHEN 'best_by' THEN 3 ELSE 4 END AS place,
          string_agg('v' || m, '|' ORDER BY late, pos, m) AS shown, string_agg(raw, '|' ORDER BY late, pos, m) AS raw,
          string_agg(CAST(m AS VARCHAR), '|' ORDER BY late, pos, m) AS keys,
          concept = 'lot' AND EXISTS (SELECT 1 FROM f WHERE f.case_id = v.case_id AND f.concept = 'lot' AND f.says_batch) AS is_batch
        FROM v GROUP BY case_id, concept""",
    "c22_next": f"""
        WITH e AS (
          SELECT event_id AS k, ts, event_id % 2 <> 0 AND event_id % 7 <> 0 AS act, TIMESTAMP '{NOW}' AS now,
            event_id % 3 = 0 AND event_id % 19 <> 0 AND (event_id % 4 = 0 OR ts + INTERVAL 20 DAY > TIMESTAMP '{NOW}') AS running
          FROM events)
        SELECT k AS event_id, CASE WHEN act THEN 'active' ELSE 'inactive' END AS status, CASE WHEN act AND k % 5 <> 0 THEN ts END AS expires_at,
          now AS checked_at, CASE WHEN act THEN CASE WHEN running THEN TIMESTAMP '2024-01-10' ELSE now END END AS entitled_since
        FROM e""",
    "p16_approved": """
        SELECT o_orderkey AS id, o_orderpriority AS publisher, CAST(o_orderdate AS DATE) AS notice_date, CAST(l_shipdate AS DATE) AS approved_at
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 17 > 0
          AND l_partkey % 3 > 0 AND l_partkey % 10 > 0 AND l_suppkey % 4 > 0 AND l_suppkey % 9 > 0""",
    "v3_expansions": """
        WITH n AS (
          SELECT o_custkey AS case_id, o_orderkey AS native_id, 'expansion-record:' || o_orderkey AS mark FROM orders
          WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 4 IN (1, 2))
        SELECT case_id, native_id, 'expansion_products' AS rule_id, 'The agency expanded this recall (notice ' || native_id || ').' AS summary,
          printf('%08x', list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, len(mark) + 1), lambda i: ord(substr(mark, i::INT, 1))::HUGEINT)),
            lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS fingerprint
        FROM n""",
    "x20_states": f"""{PLACES_SQL} SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN join_set([n0, n1]) WHEN 1 THEN join_set([n0, n1, n2]) WHEN 2 THEN n0 WHEN 3 THEN n0 WHEN 4 THEN n0
  WHEN 5 THEN join_set(['North Dakota', 'South Dakota', 'District of Columbia', n0]) ELSE '' END AS states FROM s""".replace("join_set(", "array_to_string(list_sort(list_distinct(").replace("])", "])), '|')"),
    "x21_state": f"{PLACES_SQL} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN n0 WHEN 2 THEN n0 END AS state FROM s",
    "i11_order": f"{PLACES_SQL} SELECT p_partkey, array_to_string(list_sort(list_distinct([n0, n1, n2])), '|') AS names FROM s",
    "i3_barcodes": """WITH c AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 12, '4') AS a, lpad(p_partkey::VARCHAR, 13, '9') AS b, lpad(p_partkey::VARCHAR, 8, '5') AS c FROM part)
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN a WHEN 1 THEN a || '|' || b WHEN 2 THEN a WHEN 3 THEN c || '|' || a WHEN 5 THEN c || '|' || b || '|' || a ELSE '' END AS codes FROM c""",
    "v16_same_event": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderdate::DATE AS d,
    ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'firm', 'said', 'was', 'told', 'milk', 'its', 'soup', 'upc', '22222']
    || [lpad((o_custkey + o_orderkey % 2)::VARCHAR, 5, '1')] || CASE WHEN o_orderkey % 7 = 0 THEN ['this', 'updated', 'press', 'release', 'includes', 'news'] ELSE [] END
    || CASE o_orderkey % 3 WHEN 0 THEN ['alpha', 'beta', 'gamma', 'delta', 'epsilon', 'zeta', 'theta', 'kappa', 'lambda', 'sigma'] WHEN 1 THEN ['alpha', 'beta', 'gamma'] ELSE [] END AS w FROM orders),
b AS (SELECT x.k AS id, y.k AS other, (x.k % 13 > 1) = (y.k % 13 > 1) AS hazard, abs(x.d - y.d) AS days, (x.k % 11 = 0) <> (y.k % 11 = 0) AS slug, x.c % 4 <> 0 AS fda,
    len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) AS j, x.k % 5 > 0 AND y.k % 5 > 0 OR x.k % 5 = 0 AND y.k % 5 = 0 AS title,
    x.k % 5 = 0 OR y.k % 5 = 0 AS grown, x.k % 2 = y.k % 2 AS upc, x.k % 7 = 0 OR y.k % 7 = 0 AS revised
  FROM o x JOIN o y ON x.c = y.c AND x.p = y.p AND x.k < y.k)
SELECT id, other, CASE
  WHEN hazard AND (slug AND days <= 180 AND j >= 0.6 OR fda AND grown AND days <= 120 AND j >= 0.45 OR fda AND revised AND days <= 120 AND upc AND j >= 0.8) THEN 'deterministic'
  WHEN hazard AND days <= 180 AND (slug OR fda AND grown OR fda AND revised AND upc OR title AND j >= 0.6) THEN 'review' ELSE 'distinct' END AS verdict FROM b""",
    "i2_gtins": """
WITH d AS (SELECT p_partkey AS k, unnest([8, 12, 13, 14]) AS n FROM part), b AS (SELECT k, n, lpad(k::VARCHAR, n - 1, '7') AS b FROM d),
w AS (SELECT k, n, b || ((10 - list_sum(list_transform(range(1, n), lambda i: substr(b, i::INT, 1)::INT * CASE WHEN (n - 1 - i) % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::INT AS w FROM b),
p AS (SELECT k, max(w) FILTER (n = 8) AS w8, max(w) FILTER (n = 12) AS w12, max(w) FILTER (n = 13) AS w13, max(w) FILTER (n = 14) AS w14 FROM w GROUP BY k)
SELECT k AS p_partkey, array_to_string(CASE k % 7 WHEN 0 THEN ['00' || w12] WHEN 5 THEN [w14] ELSE [] END || ['0' || w13] || CASE WHEN k % 7 = 5 THEN [] ELSE [w14] END, '|') AS keys, k % 7 = 1 AS ambiguous,
  CASE k % 7 WHEN 2 THEN 'not-a-digit-run' WHEN 3 THEN 'unsupported-length' WHEN 4 THEN 'not-a-digit-run' END AS reason FROM p""".replace("k % 7", "k % 6"),
    "i5_code_dates": """
WITH x AS (SELECT *, 'L' || lpad(l_partkey::VARCHAR, 5, '0') AS code, strftime(l_shipdate, '%Y%m%d') AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN code || '=' || d WHEN 1 THEN code || '=' || d WHEN 2 THEN strftime(l_shipdate, '%Y') || '=' || d ELSE '' END AS pairs,
  CASE WHEN l_partkey % 3 > 0 THEN code || '=' || d || '|' || l_suppkey || '-A1=' || d ELSE '' END AS aligned FROM x""",
}
