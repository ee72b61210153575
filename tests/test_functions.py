import hashlib
import re

from pyspark.sql import functions as F

from noticeworks.functions import classify, identifiers, text
from noticeworks.operators import entity, events
from noticeworks.plans import analytics


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


def test_text(spark):
    assert one(spark, "<p>A &amp; B</p><b>c</b>", text.strip_html) == "A & B\nc"
    assert one(spark, "One. Two!  Three", text.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, "Crème, BRÛLÉE-2", text.search_text) == "creme brulee 2"
    assert one(spark, "retraction", text.fnv1a) == "db770978"
    assert one(spark, "Acme Foods, Inc.", text.firm_name) == "acme foods"
    assert one(spark, "HTTPS://www.Ex.com/A/?q=1", text.canonical_url) == "ex.com/A"
    assert one(spark, "1.10.0", lambda c: text.version_at_least(c, "1.9.3")) is True
    assert one(spark, None, text.search_text) is None


def test_identifiers(spark):
    assert one(spark, "036000291452", identifiers.gtin_key) == "00036000291452"
    assert one(spark, "036000291453", identifiers.gtin_key) is None
    assert one(spark, "12345678", identifiers.gtin_key) is None
    assert str(one(spark, "02/28/2024", identifiers.notice_date)) == "2024-02-28"
    assert one(spark, "02/31/2024", identifiers.notice_date) is None


def test_tiers(spark):
    df = spark.createDataFrame([(["I"], False), (["I", "II"], False), (["II", "III"], False), ([], True), ([], False)], "c array<string>, p boolean")
    got = [r[0] for r in df.select(classify.risk_tier(F.col("c"), F.col("p"))).collect()]
    assert got == ["critical", "very_high", "moderate", "pending", "unknown"]


def test_merge_cycle_and_chain(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "k long, m long")
    assert dict(map(tuple, entity.follow_merges(df, "k", "m").collect())) == {1: 1, 2: 1, 3: 1, 4: None, 5: None}


def test_coalescing_counts_from_the_delivered_one(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 20), (1, 3, 30), (1, 4, 54), (1, 5, 79)], "c long, o long, h long")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    got = dict(map(tuple, events.coalesce_updates(df, "c", "ts", "o").select("o", "suppressed").collect()))
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_coalescing_with_retractions_and_backfills(spark):
    rows = [(c, o, (o * 7 + c * 5) % 300, (o * c) % 6 == 1, [None, 10, 719, 720, 721, 5000][(o + c) % 6]) for c in (1, 2, 3, 4) for o in range(40)]
    rows += [(None, 1, 0, False, None), (None, 2, 1, False, None), (None, 3, 2, True, None), (5, 1, 0, True, 721), (5, 2, 1, False, None)]
    want, last = {}, {}
    for c, o, h, retracted, age in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        if age is not None and age > 720:
            want[c, o] = "backfill"
        elif not retracted and c in last and h - last[c] <= 24:
            want[c, o] = "coalesced"
        else:
            want[c, o], last[c] = None, h
    df = spark.createDataFrame(rows, "c long, o long, h long, r boolean, age long").withColumn("ts", F.timestamp_seconds((F.col("h") + 10000) * 3600))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = events.coalesce_updates(df, "c", "ts", "o", retraction=F.col("r"), activity=F.timestamp_seconds((F.col("h") + 10000 - F.col("age")) * 3600)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and {(x["c"], x["o"]): x["reason"] for x in got} == want
    assert all(x["suppressed"] == (x["reason"] is not None) for x in got) and set(want.values()) == {None, "backfill", "coalesced"}


def test_sentences_keep_digits_at_their_ends(spark):
    df = spark.createDataFrame([("9 units. 1 of 21. 2 left in 32",)], "x string")
    assert df.select(text.sentences(F.col("x"))).first()[0] == ["9 units.", "1 of 21.", "2 left in 32"]


BLANK = "\t\n\v\f\r                  　﻿"
NAMES = dict(amp="&", lt="<", gt=">", quot='"', apos="'", nbsp=" ", rsquo="’", lsquo="‘", rdquo="”", ldquo="“", ndash="–", mdash="—", hellip="…", deg="°")
SHORT = "Inc|Corp|Co|Ltd|LLC|L.L.C|LLP|No|Nos|vs|etc|Mr|Mrs|Ms|Dr|St|Mt|Ave|Blvd|U.S|U.S.A|D.C|Ala|Ariz|Ark|Calif|Colo|Conn|Del|Fla|Ga|Ill|Ind|Kan|Ky|La|Mass|Md|Mich|Minn|Miss|Mo|Mont|Neb|Nev|Okla|Ore|Pa|Tenn|Tex|Va|Vt|Wash|Wis|Wyo"
HTML = [
    "<p>It&#8217;s 40&DEG;F &mdash; &ldquo;hot&rdquo; &ndash; &lsquo;x&RSQUO;&hellip;</p>",
    "&#x2014;&#X41;&#65;&#0066;&#x1F600;&#128512;&#1114112;&#99999999999999999999;&#xD800;&#65279;y&#38;lt;&amp;lt;&amp;amp;&bogus;&#;&#x;&#xffffffffff;",
    'One<br class="a">two</p >three</li id=x>four</h3 >five</div>six<BR/>seven<>eight</pre>nine',
    "Sold by Nueva Inc. in Ore. and U.S. stores. Next! Then? L.L.C. stays. Zinc. goes No. 5 etc. Too St. Mt. Capra. End",
    "during surveillance activities There have been no reports Anyone concerned about it. There has beenx; a There has been",
    "a   b. c.\r\nd\v\n\f e &nbsp; \n f!　g h. i﻿",
    "cafÉInc. b _Inc. c -Inc. d Inc.\nE. 5.5 f...  g",
    "", " \n ", "plain", None,
]


def plain_strip(h):
    t = re.sub("(?i)<(br|/p|/li|/h[1-6])[^>]*>", "\n", h)
    t = re.sub("<[^>]+>", " ", t)
    char = lambda m, base: chr(n) if (n := int(m[1], base)) <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]
    t = re.sub("&#([0-9]+);", lambda m: char(m, 10), t)
    t = re.sub("(?i)&#x([0-9a-f]+);", lambda m: char(m, 16), t)
    t = re.sub("&([a-zA-Z]+);", lambda m: NAMES.get(m[1].lower(), m[0]), t)
    return re.sub(f"[{BLANK}]*\n[{BLANK}]*", "\n", re.sub("[ \t]+", " ", t)).strip(BLANK)


def plain_sentences(t):
    out, at = [], 0
    for m in re.finditer(f"[{BLANK}]+", t):
        before, after = t[: m.start()], t[m.end() :]
        ends = before[-1:] in set(".!?") - {""} and not any(before.endswith(a + ".") and not re.search("[A-Za-z0-9_]$", before[: -len(a) - 1]) for a in SHORT.split("|"))
        glued = re.search("[a-z]$", before) and re.match(r"(There (have|has) been|Anyone concerned about)(?![A-Za-z0-9_])", after)
        if ends or glued or "\n" in m[0]:
            out, at = [*out, t[at : m.start()]], m.end()
    return [s.strip(BLANK) for s in [*out, t[at:]] if s.strip(BLANK)]


def test_html_and_sentences_as_by_hand(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(HTML)), "page_id long, html string")
    got = df.select("page_id", text.strip_html(F.col("html")).alias("t")).withColumn("s", text.sentences(F.col("t"))).collect()
    for r in got:
        want = None if HTML[r["page_id"]] is None else plain_strip(HTML[r["page_id"]])
        assert (r["t"], r["s"]) == (want, want if want is None else plain_sentences(want))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    for r in analytics.x2_strip_html(spark, str(tmp_path)).where("digest is not null").collect():
        t = plain_strip(HTML[r["page_id"]])
        assert (r["digest"], r["n_sentences"]) == (hashlib.md5(t.encode()).hexdigest(), len(plain_sentences(t)))
    assert text.ABBREVIATIONS == SHORT.split("|") and text.ENTITIES == NAMES


def test_recall_numbers_and_sizes(spark):
    assert tuple(one(spark, " 017-2026-exp1 ", identifiers.recall_number)) == ("017-2026-EXP1", "017-2026")
    assert tuple(one(spark, "017-2026", identifiers.recall_number)) == ("017-2026", None)
    assert tuple(one(spark, "PHA-01022024-01 (Original)", identifiers.recall_number)) == ("PHA-01022024-01 (ORIGINAL)", "PHA-01022024-01")
    assert one(spark, "a-company-recalls-its-soup-0", identifiers.collision_base) == "a-company-recalls-its-soup"
    assert one(spark, "omega-3", identifiers.collision_base) is None
    assert one(spark, "12 oz. bag, 1.5-lb tray; 12oz cup of 4 grams", identifiers.size_tokens) == ["12oz", "1.5lb"]
    assert one(spark, "12 oz and 2 lb", lambda c: identifiers.unverified_sizes(c, F.lit("a 12-oz bag"))) == ["2lb"]
    assert one(spark, None, lambda c: identifiers.unverified_sizes(c, F.lit(None).cast("string"))) == []


def test_images_go_to_one_row_each(spark):
    rows = [(1, "a", "x", 1, 0.1), (1, "b", "x", 2, 0.9), (1, "b", "y", 2, 0.5), (1, "c", "y", 2, 0.4), (2, "a", "x", 2, 0.5), (2, None, "x", 1, 1.0)]
    df = spark.createDataFrame(rows, "c long, r string, i string, k int, s double")
    assert sorted(map(tuple, entity.allocate_images(df, "c", "r", "i", "k", "s").collect())) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x")]
