"""Readers over files made here, and the streams."""

import json
import zipfile

import pandas as pd

from noticeworks.sources import readers
from noticeworks.streaming import ingest


def test_json_array_and_contract(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "title": "x"}, {"id": 2, "title": " "}, {"id": None}]))
    df = readers.contract(readers.json_array(spark, str(tmp_path / "a.json"), "id long, title string"), ["id", "title"])
    assert [r.violations for r in df.orderBy("id").collect()] == [["id", "title"], [], ["title"]]


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://h/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 EST</pubDate></item><item><title>B</title><link>http://h/2</link><pubDate>soon</pubDate></item></channel></rss>")
    got = readers.rss_items(spark, str(tmp_path / "f.xml")).orderBy("title").collect()
    assert [(r.title, str(r.published)) for r in got] == [("A", "2024-01-02 03:04:05"), ("B", "None")]


def test_html(spark, tmp_path):
    (tmp_path / "p.html").write_text("<body><MAIN id='m'>\n<p>in</p>\n</main>out</body>")
    (tmp_path / "q.html").write_text("<body>none</body>")
    got = [r.main for r in readers.html_pages(spark, str(tmp_path)).orderBy("path").collect()]
    assert got == ["\n<p>in</p>\n", None]


def test_zipped_and_paged(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.json", json.dumps({"results": [{"id": 1, "s": "a"}, {"id": 2}]}))
        z.writestr("note.txt", "no")
    got = readers.zipped_json(spark, str(tmp_path / "x.zip"), "id long, s string").orderBy("id").collect()
    assert [(r.member, r.id, r.s) for r in got] == [("a.json", 1, "a"), ("a.json", 2, None)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/0.json").write_text(json.dumps({"skip": 0, "results": [{"id": 1, "s": "old"}, {"id": 2, "s": "b"}]}))
    (tmp_path / "pages/1.json").write_text(json.dumps({"skip": 2, "results": [{"id": 1, "s": "new"}]}))
    got = readers.paged_json(spark, str(tmp_path / "pages"), "id long, s string", "id").orderBy("id").collect()
    assert [(r.id, r.s) for r in got] == [(1, "new"), (2, "b")]


def test_binaries(spark, tmp_path):
    for name, data in {"a": b"%PDF-1.7", "b": b"<html>", "c": b"\xff\xd8\xff\xe0" + b"x" * 100, "d": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = readers.safe_binaries(spark, str(tmp_path), ["pdf", "jpeg"], 50).orderBy("path").collect()
    assert [(r.kind, r.verdict) for r in got] == [("pdf", "accepted"), (None, "not_allowed"), ("jpeg", "too_large")]


def test_scan_pushes_down_and_plan_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    df.write.parquet(str(tmp_path / "t"))
    got = readers.scan(spark, str(tmp_path / "t"), ["s"], "id > 1")
    assert "GreaterThan(id,1)" in got._jdf.queryExecution().executedPlan().toString() and got.first().s == "b"
    readers.write_plan(df, str(tmp_path / "plan"))
    assert spark.read.json(str(tmp_path / "plan")).count() == 2 and (tmp_path / "plan/_SUCCESS").exists()


def test_offline_corpus(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"schemaVersion": 2, "items": [{"id": "x"}, {"id": "y"}]}, indent=1))
    assert [(r.schemaVersion, r.id) for r in readers.offline_corpus(spark, str(tmp_path / "d.json"), "id string").orderBy("id").collect()] == [(2, "x"), (2, "y")]


def test_poll_takes_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), "id long, seq long", "id", "seq", str(tmp_path / "out"), str(tmp_path / "cp"))
    (tmp_path / "in/1.json").write_text('{"id": 1, "seq": 1}\n{"id": 1, "seq": 2}\n{"id": 2, "seq": 1}\n')
    ingest.poll(*args).awaitTermination()
    (tmp_path / "in/2.json").write_text('{"id": 1, "seq": 3}\n')
    ingest.poll(*args).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id", "seq").collect()
    assert [(r.id, r.seq) for r in got] == [(1, 2), (1, 3), (2, 1)]


def test_delivery_states(spark, tmp_path):
    (tmp_path / "in").mkdir()
    read = lambda: spark.readStream.schema("delivery string, at timestamp, outcome string").json(str(tmp_path / "in"))
    seen = []

    def run():
        q = ingest.deliveries(read()).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    row = lambda d, t, o: json.dumps({"delivery": d, "at": str(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=t)), "outcome": o})
    (tmp_path / "in/1.json").write_text("\n".join([row("a", 2, "retry"), row("a", 1, "claim"), row("b", 1, "claim"), row("b", 2, "reject"), row("b", 3, "claim")]))
    run()
    assert sorted(seen) == [("a", "retryable", 1), ("b", "permanent", 1)]
    seen.clear()
    (tmp_path / "in/2.json").write_text("\n".join([row("a", 3, "claim"), row("a", 4, "accepted"), row("a", 5, "receipt_ok"), row("a", 6, "reject")]))
    run()
    assert seen == [("a", "receipt_ok", 2)]
