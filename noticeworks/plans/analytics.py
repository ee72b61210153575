"""Operations, privacy, evaluation and text queries (A*, R8, R9, U1, X*, I*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noticeworks.functions import identifiers, text
from noticeworks.operators import evaluation as E
from noticeworks.operators.decisions import by_table
from noticeworks.session import table

NOW = "2024-01-30 00:00:00"


def a1_k_anonymity(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return g.select("o_custkey", F.when(F.col("n") < 3, "below_threshold").otherwise("shown").alias("state"), F.when(F.col("n") >= 3, F.col("n")).alias("shown"))


def a3_run_health(spark, sf):
    e = table(spark, sf, "events")
    ok = F.col("event_type") == "purchase"
    w = Window.partitionBy("user_id")
    last = e.withColumn("ok_at", F.max(F.when(ok, F.col("ts"))).over(w))
    after = F.col("ok_at").isNull() | (F.col("ts") > F.col("ok_at"))
    return last.groupBy("user_id").agg(F.count_if(after).alias("attempts_since"), F.count_if(after & (F.col("event_type") == "error")).alias("errors_since"), F.count_if(ok).alias("successes"))


def a6_export(spark, sf):
    o, li = table(spark, sf, "orders").where("o_custkey = 7"), table(spark, sf, "lineitem")
    kids = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey")
    kids = kids.agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("k"))
    s = F.array_join(F.transform("k", lambda x: F.concat_ws("/", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), ",")
    return o.join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce(s, F.lit("")).alias("lines"))


def a7_row_counts(spark, sf):
    names = ("customer", "orders", "lineitem", "events", "documents", "pages", "conversations")
    parts = [table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def a9_histograms(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority")
    return g.agg(F.count(F.lit(1)).alias("n"))


def _predicted(spark, sf):
    """Labels of documents as sets, and sets guessed from length and id."""
    lab, d = table(spark, sf, "labels"), table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "source")
    j = lab.join(d, F.col("doc_id") == F.col("id"))
    k, n = F.col("doc_id"), F.col("n_chars")
    expected = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    predicted = F.array_compact(F.array(F.when(n > 500, "good"), F.when(k % 7 == 0, "toxic"), F.when(k % 13 == 0, "other")))
    return E.scored(j.select("doc_id", expected.alias("expected"), predicted.alias("predicted")), "expected", "predicted")


def a10_evaluation(spark, sf):
    return E.summary(_predicted(spark, sf))


def a10_per_class(spark, sf):
    vocabulary = spark.createDataFrame([("good",), ("toxic",), ("other",), ("unused",)], "category string")
    return E.per_class(_predicted(spark, sf), vocabulary, "category")


def _first(c: str):
    return F.coalesce(F.get(c, 0), F.lit("none"))


def a11_folds(spark, sf):
    return E.dealt(_predicted(spark, sf), _first("expected"), "doc_id", width=4096).select("doc_id", "fold")


def a11_cross_validation(spark, sf):
    return E.cross_validated(E.summary(E.dealt(_predicted(spark, sf), _first("expected"), "doc_id"), "fold"))


def a19_unfindable(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("correct"))
    return E.unfindable(asked, table(spark, sf, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("id")), "id", "correct")


def a13_evidence_age(spark, sf):
    age = F.datediff(F.lit(NOW).cast("timestamp"), F.col("ts"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(age).alias("oldest"), F.count_if(age > 14).alias("over_14"), F.count_if(age > 21).alias("over_21"))


def a16_review_buckets(spark, sf):
    """Orders as notices, their first lines as approvals of one version, some withdrawn."""
    approvals = table(spark, sf, "lineitem").where("l_linenumber = 1 and l_partkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.when(F.col("l_returnflag") != "R", F.col("l_linestatus"))).alias("live"))
    o = table(spark, sf, "orders").join(approvals.withColumn("ever", F.lit(True)), F.col("o_orderkey") == F.col("id"), "left")
    bucket = (
        F.when(F.col("live") == F.col("o_orderstatus"), "published")
        .when(F.col("live").isNotNull(), "revised_letter")
        .when(F.col("ever").isNull() & (F.col("o_orderstatus") == "F"), "needs_approval")
        .when(F.col("o_orderstatus") == "O", "agency_match_to_confirm")
        .otherwise("needs_decision")
    )
    n = o.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("newest"))
    names = spark.createDataFrame([(b,) for b in ("published", "needs_approval", "revised_letter", "agency_match_to_confirm", "needs_decision", "withdrawn")], "bucket string")
    return names.join(n, F.col("bucket") == F.col("b"), "left").select("bucket", F.coalesce("c", F.lit(0)).alias("n"), "newest").orderBy(F.desc_nulls_last("newest"), "bucket")


def _rules():
    return {"large": ("error", F.col("o_totalprice") > 300000), "open": ("warning", F.col("o_orderstatus") == "P"), "round": ("info", F.col("o_custkey") % 10 == 0), "never": ("error", F.col("o_custkey") < 0)}


def a17_violations(spark, sf):
    return E.violations(table(spark, sf, "orders"), "o_orderkey", _rules())


def a17_severities(spark, sf):
    """Violations by severity, none left out, beside wide counts of signals."""
    o = table(spark, sf, "orders")
    totals = {s: sum((F.coalesce(F.count_if(c), F.lit(0)) for k, c in _rules().values() if k == s), F.lit(0)) for s in ("error", "warning", "info")}
    return o.agg(F.count(F.lit(1)).alias("records"), *[n.cast("long").alias(s) for s, n in totals.items()], F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_totalprice") < 50000).alias("small"), F.sum(F.length("o_orderpriority")).alias("chars"))


def r8_watchdog(spark, sf):
    """fresh, ingest_running, dispatch_cooldown, configuration_error or dispatch_claimed, the first that holds."""
    at = F.lit(NOW).cast("timestamp")
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    g = table(spark, sf, "events").groupBy("user_id").agg(last("purchase").alias("ok"), last("signup").alias("started"), last("view").alias("dispatched"))
    within = lambda c, t: F.coalesce(F.col(c) >= at - F.expr(f"INTERVAL {t}"), F.lit(False))
    facts = {"fresh": within("ok", "1 DAYS"), "ingest_running": within("started", "10 HOURS"), "dispatch_cooldown": within("dispatched", "12 HOURS"), "configuration_error": F.col("user_id") % 13 == 0}
    return g.select("user_id", by_table(tuple(facts), facts, F.lit("dispatch_claimed")).alias("state"))


def r9_inactive(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    last = o.union(e).groupBy("id").agg(F.max("at").alias("last"))
    return last.where(F.col("last") < F.add_months(F.lit("2024-01-30").cast("date"), -12).cast("timestamp")).select("id")


def u1_union_ids(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, sf, "events").select("user_id")).union(table(spark, sf, "customer").select("c_custkey")).distinct()


def i1_gtin(spark, sf):
    body = F.lpad(F.col("p_partkey").cast("string"), 11, "0")
    code = F.concat(body, identifiers.gtin_check_digit(body).cast("string"))
    off = F.when(F.col("p_partkey") % 4 == 0, F.concat(body, F.lit("7"))).otherwise(code)
    return table(spark, sf, "part").select("p_partkey", identifiers.gtin_key(off).alias("gtin"))


def x2_strip_html(spark, sf):
    t = table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("digest"), F.size(text.sentences(F.col("t"))).alias("n_sentences"))


def x9_firms(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", text.firm_name(F.concat("s_name", F.lit(" Foods, Inc."))).alias("firm"))


def x15_fnv(spark, sf):
    return table(spark, sf, "nation").select("n_name", text.fnv1a(F.col("n_name")).alias("fnv"))


def x16_content_hash(spark, sf):
    """The hash of a customer as a nested document whose keys stand in no order."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    firm = F.struct(F.col("c_name").alias("name"), F.when(k % 3 > 0, F.col("c_nationkey")).alias("Home"))
    tags = F.when(k % 4 > 0, F.array(F.struct(F.lit("x").alias("z"), k.alias("a")), F.struct(F.lit(None).cast("string").alias("z"), F.lit(1).cast("long").alias("a"))))
    doc = c.select("c_custkey", F.struct(F.when(k % 5 > 0, firm).alias("firm"), tags.alias("Tags"), F.create_map(F.lit("q"), k, F.lit("b"), F.lit(2).cast("long")).alias("map")).alias("d"))
    return doc.select("c_custkey", text.content_hash(doc, "d").alias("hash"))


QUERIES = {f.__name__: f for f in (a1_k_anonymity, a3_run_health, a6_export, a7_row_counts, a9_histograms, a10_evaluation, a10_per_class, a11_folds, a11_cross_validation, a19_unfindable, a13_evidence_age, a16_review_buckets, a17_violations, a17_severities, r8_watchdog, r9_inactive, u1_union_ids, i1_gtin, x2_strip_html, x9_firms, x15_fnv, x16_content_hash)}

_SETS = """
WITH j AS (SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
s AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS e,
  list_filter([CASE WHEN n_chars > 500 THEN 'good' END, CASE WHEN doc_id % 7 = 0 THEN 'toxic' END, CASE WHEN doc_id % 13 = 0 THEN 'other' END], lambda x: x IS NOT NULL) AS p FROM j)"""

ORACLES = {
    "x15_fnv": """
SELECT n_name, printf('%08x', list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, len(n_name) + 1), lambda i: ord(substr(n_name, i::INT, 1))::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS fnv FROM nation""",
    "a1_k_anonymity": """
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT o_custkey, CASE WHEN n < 3 THEN 'below_threshold' ELSE 'shown' END AS state, CASE WHEN n >= 3 THEN n END AS shown FROM g""",
    "a3_run_health": """
WITH l AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS ok FROM events)
SELECT user_id, count(*) FILTER (ok IS NULL OR ts > ok) AS attempts_since, count(*) FILTER ((ok IS NULL OR ts > ok) AND event_type = 'error') AS errors_since, count(*) FILTER (event_type = 'purchase') AS successes FROM l GROUP BY user_id""",
    "a6_export": """
SELECT o_orderkey, coalesce(string_agg(l_linenumber || '/' || l_partkey || '/' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7 GROUP BY o_orderkey""",
    "a7_row_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "orders", "lineitem", "events", "documents", "pages", "conversations")),
    "a9_histograms": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "a10_evaluation": _SETS
    + """, x AS (SELECT *, len(list_intersect(e, p)) AS hit FROM s)
SELECT count(*) AS rows, count(*) FILTER (hit = len(e) AND hit = len(p))::DOUBLE / count(*) AS exact_set, sum(hit)::DOUBLE / sum(len(p)) AS micro_precision, sum(hit)::DOUBLE / sum(len(e)) AS micro_recall,
  count(*) FILTER (len(p) > 0) AS categorized, count(*) FILTER (len(e) = 0) AS expected_none, count(*) FILTER (len(e) > 1) AS expected_many, count(*) FILTER (len(p) > 1) AS predicted_many,
  max(len(p))::INTEGER AS most, sum(len(p) - hit)::BIGINT AS over, sum(len(e) - hit)::BIGINT AS missed FROM x""",
    "a10_per_class": _SETS
    + """, v AS (SELECT unnest(['good', 'toxic', 'other', 'unused']) AS category),
c AS (SELECT category, count(*) FILTER (list_contains(e, category) AND list_contains(p, category)) AS tp, count(*) FILTER (NOT list_contains(e, category) AND list_contains(p, category)) AS fp,
  count(*) FILTER (list_contains(e, category) AND NOT list_contains(p, category)) AS fn FROM v, s GROUP BY category)
SELECT category, tp, fp, fn, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall FROM c""",
    "a11_folds": _SETS + " SELECT doc_id, ((row_number() OVER (ORDER BY coalesce(e[1], 'none'), doc_id) - 1) % 5)::INT AS fold FROM s",
    "a11_cross_validation": _SETS
    + """, f AS (SELECT *, (row_number() OVER (ORDER BY coalesce(e[1], 'none'), doc_id) - 1) % 5 AS fold, len(list_intersect(e, p)) AS hit FROM s),
g AS (SELECT fold, count(*) FILTER (hit = len(e) AND hit = len(p))::DOUBLE / count(*) AS x, sum(hit)::DOUBLE / sum(len(p)) AS mp, sum(hit)::DOUBLE / sum(len(e)) AS mr FROM f GROUP BY fold)
SELECT round(avg(x), 9) AS mean_exact, round(min(x), 9) AS min_exact, round(max(x), 9) AS max_exact, round(stddev_pop(x), 9) AS stdev_exact, round(avg(mp), 9) AS mean_precision, round(avg(mr), 9) AS mean_recall FROM g""",
    "a19_unfindable": """
WITH a AS (SELECT o_custkey AS id, bool_or(o_orderpriority = '1-URGENT') AS ok FROM orders GROUP BY 1), j AS (SELECT a.*, c_custkey IS NOT NULL AS known FROM a LEFT JOIN customer ON id = c_custkey AND c_custkey % 9 <> 0)
SELECT count(*) AS asked, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (known AND ok) AS any_correct, round(count(*) FILTER (known AND ok)::DOUBLE / count(*) FILTER (known), 9) AS rate FROM j""",
    "a13_evidence_age": """
WITH a AS (SELECT event_type, date_diff('day', ts::DATE, DATE '2024-01-30') AS age FROM events)
SELECT event_type, count(*) AS n, max(age)::INT AS oldest, count(*) FILTER (age > 14) AS over_14, count(*) FILTER (age > 21) AS over_21 FROM a GROUP BY 1""",
    "a16_review_buckets": """
WITH a AS (SELECT l_orderkey, max(CASE WHEN l_returnflag <> 'R' THEN l_linestatus END) AS live FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 <> 0 GROUP BY 1),
o AS (SELECT o_orderdate, CASE WHEN live = o_orderstatus THEN 'published' WHEN live IS NOT NULL THEN 'revised_letter' WHEN l_orderkey IS NULL AND o_orderstatus = 'F' THEN 'needs_approval'
  WHEN o_orderstatus = 'O' THEN 'agency_match_to_confirm' ELSE 'needs_decision' END AS b FROM orders LEFT JOIN a ON o_orderkey = l_orderkey)
SELECT v.b AS bucket, count(o_orderdate) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS newest
FROM (VALUES ('published'), ('needs_approval'), ('revised_letter'), ('agency_match_to_confirm'), ('needs_decision'), ('withdrawn')) v(b) LEFT JOIN o ON o.b = v.b GROUP BY v.b""",
    "a17_violations": """
WITH v AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END, CASE WHEN o_custkey % 10 = 0 THEN 'round' END], lambda x: x IS NOT NULL)) AS rule FROM orders)
SELECT rule, CASE rule WHEN 'large' THEN 'error' WHEN 'open' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:3], ',') AS examples FROM v GROUP BY rule""",
    "a17_severities": """
SELECT count(*) AS records, count(*) FILTER (o_totalprice > 300000) AS error, count(*) FILTER (o_orderstatus = 'P') AS warning, count(*) FILTER (o_custkey % 10 = 0) AS info,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice < 50000) AS small, sum(len(o_orderpriority))::BIGINT AS chars FROM orders""",
    "r8_watchdog": """
WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS ok, max(ts) FILTER (event_type = 'signup') AS st, max(ts) FILTER (event_type = 'view') AS d FROM events GROUP BY 1)
SELECT user_id, CASE WHEN ok >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY THEN 'fresh' WHEN st >= TIMESTAMP '2024-01-30' - INTERVAL 10 HOUR THEN 'ingest_running'
  WHEN d >= TIMESTAMP '2024-01-30' - INTERVAL 12 HOUR THEN 'dispatch_cooldown' WHEN user_id % 13 = 0 THEN 'configuration_error' ELSE 'dispatch_claimed' END AS state FROM l""",
    "r9_inactive": """
SELECT id FROM (SELECT o_custkey AS id, o_orderdate::TIMESTAMP AS seen FROM orders UNION ALL SELECT user_id, ts::TIMESTAMP FROM events)
GROUP BY id HAVING max(seen) < TIMESTAMP '2023-01-30'""",
    "u1_union_ids": "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events UNION SELECT c_custkey FROM customer",
    "i1_gtin": """
WITH b AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 11, '0') AS b FROM part),
d AS (SELECT *, (10 - list_sum([substr(b, i::INT, 1)::INT * CASE WHEN (11 - i) % 2 = 0 THEN 3 ELSE 1 END FOR i IN range(1, 12)]) % 10) % 10 AS c FROM b)
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 OR c = 7 THEN lpad(b || c::INT::VARCHAR, 14, '0') END AS gtin FROM d""",
    "x9_firms": "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || ' foods' AS firm FROM supplier",
    "x16_content_hash": """
SELECT c_custkey, sha256('{"firm":' || CASE WHEN c_custkey % 5 > 0 THEN '{"Home":' || CASE WHEN c_custkey % 3 > 0 THEN c_nationkey::VARCHAR ELSE 'null' END || ',"name":"' || c_name || '"}' ELSE 'null' END
  || ',"map":{"b":2,"q":' || c_custkey || '},"Tags":' || CASE WHEN c_custkey % 4 > 0 THEN '[{"a":' || c_custkey || ',"z":"x"},{"a":1,"z":null}]' ELSE 'null' END || '}') AS hash FROM customer""",
}
