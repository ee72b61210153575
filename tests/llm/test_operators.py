"""Small cases of every corpus operator against brute force; nulls, empty and repeated rows, clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from noticeworks.llm import hnsw, langid, minhash, mixing, packing, quality, queries, recompress, sharding, suffixes, urls
from noticeworks.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, size long"


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(5)
    vocab = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab, n))
    passage = say(80)
    base = say(120)
    rows = [(1, None, "en", "a", 7), (2, "", None, None, 7), (3, "   \n ", "en", "a", 7), (4, "solo", "de", "b", 7)]
    rows += [(10 + i, say(60) + " " + passage + "\n" + say(int(r.integers(1, 90))), "en", "a", 7) for i in range(6)]
    rows += [(30 + i, base + " " + say(i), "de", "b", 7) for i in range(6)]
    rows += [(50, "x " * 200, "fr", "c", 7), (51, say(3000), "fr", None, 7), (None, say(40), "en", "c", 7)]
    return rows + [rows[5], rows[5]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated(seqs, width):
    seen = {}
    for s in seqs:
        for i in range(len(s) - width + 1):
            seen[tuple(s[i : i + width])] = seen.get(tuple(s[i : i + width]), 0) + 1
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        yield gone


def key(rows):
    return sorted(rows, key=str)


def test_substrings(docs, corpus):
    seqs = [WORD.findall(r[1] or "") for r in corpus]
    want = []
    for r, s, g in zip(corpus, seqs, repeated(seqs, 35)):
        kept = " ".join(w for w, x in zip(s, g) if not x)
        want.append((r[0], len(s), sum(g), hashlib.sha256(kept.encode()).hexdigest()))
    assert key(map(tuple, recompress.remove_repeats(docs).collect())) == key(want)


def test_suffixes(docs, corpus):
    seqs = [(r[1] or "").encode() for r in corpus]
    want = []
    for r, s, g in zip(corpus, seqs, repeated(seqs, 400)):
        kept = bytes(b for b, x in zip(s, g) if not x)
        spans = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        want.append((r[0], len(s), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    assert key(map(tuple, suffixes.remove_repeated_bytes(docs).collect())) == key(want)


def test_minhash(docs, corpus):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for r in corpus:
        w = WORD.findall(low(r[1]))
        if r[0] is not None:
            sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash.near_duplicates(docs, percent=85).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_shingles_lose_no_pair(spark, percent):
    r = np.random.default_rng(percent)
    base = r.choice(400, 60, replace=False)
    sets = {}
    for i in range(60):  # near copies of one base, some with shared edits, and a few small sets
        s = set(base.tolist()) - set(r.choice(base, int(r.integers(0, 9)), replace=False).tolist())
        sets[i] = s | set((400 + r.choice(30, int(r.integers(0, 6)), replace=False)).tolist())
    sets |= {100 + i: set(base[:8].tolist()) | {1000 + i % 2} for i in range(4)}
    rows = [(i, np.array(sorted(s), dtype=np.int64).tobytes()) for i, s in sets.items()]
    place = {}
    for x in minhash.rare_shingles(spark.createDataFrame(rows, "id long, shingles binary"), percent).collect():
        assert x["n"] == len(sets[x["id"]]) and x["bk"] in sets[x["id"]]
        place.setdefault(x["bk"], []).append(x)
    found = set()
    for members in place.values():
        for a in members:
            for b in members:
                most = min(a["n"] - a["at"], b["n"] - b["at"])
                if a["id"] < b["id"] and (a["lead"] or b["lead"]) and most * (100 + percent) >= (a["n"] + b["n"]) * percent:
                    found.add((a["id"], b["id"]))
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert links and links <= found


def test_minhash_open_buckets(spark):
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(80):  # one to six edits each: many share buckets, only some are links
        w = list(base)
        for at in r.choice(150, int(r.integers(1, 7)), replace=False):
            w[at] = f"e{r.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert len(set(comp.values())) > 1
    assert {x["doc_id"]: x["component_id"] for x in got} == comp


def test_registered():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and all(isinstance(s, str) for s in queries.ORACLES.values())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_packing(docs, corpus):
    encode = packing.encoder()
    exact = packing.encoder(ranks="")
    rows = packing.pack(docs, with_ids=True).collect()
    for r in corpus:
        assert list(encode(r[1] or "")) == list(exact(r[1] or ""))
    total = sum(len(encode(r[1] or "")) + 1 for r in corpus)
    assert sum(r["length"] for r in rows) == total
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024 and len(at) <= -(-total // 1024) + 1
    assert {r["length"] for r in rows if r["piece"] > 0} <= {1024}
    want = []
    for d, t, *_ in corpus:
        ids = [*encode(t or ""), 2]
        ends = list(range(len(ids), 0, -1024))[::-1]
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            want.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert key(tuple(r)[:5] for r in packing.pack(docs).collect()) == key(want)


def test_plan_keeps_every_piece():
    lens = np.random.default_rng(1).integers(1, 1025, 5000)
    hist = np.bincount(lens, minlength=1025)
    got = np.zeros(1025, dtype=int)
    for n, lengths in packing.plan(hist):
        assert sum(lengths) <= 1024
        for v in lengths:
            got[v] += n
    assert (got == hist).all()


def test_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    v = np.vstack([base, base[:10] + r.normal(size=(10, 16)) * 0.05, base[:1]])
    rows = [(i, [float(x) for x in e], i % 2) for i, e in enumerate(v)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, rows[0][1], None), (104, rows[0][1] + [1.0], 0)]
    got = {x["vec_id"]: x["n_links"] for x in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(len(v)):
        assert got[i] == sum(1 for j in range(len(v)) if j != i and i % 2 == j % 2 and u[i] @ u[j] >= 0.93)
    assert all(got[i] == 0 for i in range(100, 105))


def unit(r, n, dim=16):
    v = r.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def near(r, v, by=0.01):
    v = v + r.normal(size=v.shape).astype(np.float32) * np.float32(by)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def found_and_true(x, layers, q, own):
    """What a graph without plants of its own, but for those of rows that it has, gives, and the truth; and how."""
    rows = np.arange(0, len(x), max(1, len(x) // 60))
    extra = near(np.random.default_rng(1), x[rows])
    edges = [np.vstack([g, np.full((len(extra), g.shape[1]), -1, dtype=np.int32)]) for g in layers]
    report = hnsw.Report()
    g = hnsw.Graph(np.vstack([x, extra]), edges, rows)
    pairs = {(i, j) for a, b in hnsw.link_blocks(g, q, own, 0.93, report) for i, j in zip(a.tolist(), b.tolist())}
    return pairs, set(zip(*(i.tolist() for i in np.nonzero(q @ x.T >= np.float32(0.93)))))


@pytest.mark.parametrize("copies", [0.0, 0.02, 0.1])
def test_the_graph_answers(spark, copies):
    """Rare links are the usual case: the graph must answer, with few comparisons and all links."""
    r = np.random.default_rng(31)
    n = 6000
    x = unit(r, n, 64)
    some = r.choice(n, int(n * copies), replace=False)
    x[some] = near(r, x[(some + 1) % n])
    df = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows = hnsw.near_vectors(df).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    got = np.array([g["n_links"] for g in sorted(rows, key=lambda g: g["vec_id"])])
    first = rows[0]
    print(copies, want.sum(), got.sum(), first)
    assert np.minimum(got, want).sum() >= 0.9 * want.sum() and (got <= want).all() and (copies == 0 or want.sum() > 0)
    assert first["graph_queries"] >= 0.99 * n and first["audited_recall"] >= 0.9 and first["compared"] < 0.2 * n * n
    if copies < 0.1:
        assert (got == want).all()


def test_search_through_a_built_graph():
    r = np.random.default_rng(5)
    x = unit(r, 3000, 32)
    layers = hnsw.build(x, np.arange(3000))
    q = near(r, x[:200], 0.02)
    count = [0]
    ids, sims = hnsw.search(x, layers, hnsw.Graph(x, layers, np.arange(0)).top(), q, np.full(200, -1), 64, count)
    best = (q @ x.T).argmax(axis=1)
    assert (ids[:, 0] == best).mean() >= 0.97 and (np.diff(sims, axis=1) <= 0).all() and count[0] < 0.5 * 200 * 3000


def test_links_of_rows_that_no_edge_reaches():
    r = np.random.default_rng(4)
    x = unit(r, 1500)
    x = np.vstack([x, near(r, x)])
    none = [np.full((len(x), 32), -1, dtype=np.int32)]
    got, want = found_and_true(x, none, x, np.arange(len(x)))
    assert len(want) >= 6000 and want <= got


def test_links_where_they_are_rare():
    r = np.random.default_rng(6)
    x, q = unit(r, 3000), unit(r, 1000)
    q[[7, 501, 777]] = near(r, x[[2000, 2500, 2999]])
    none = [np.full((len(x), 32), -1, dtype=np.int32)]
    got, want = found_and_true(x, none, q, np.full(len(q), -1))
    assert {(7, 2000), (501, 2500), (777, 2999)} <= want <= got


def test_links_outside_a_hot_group():
    r = np.random.default_rng(8)
    hot = near(r, np.repeat(unit(r, 1), 400, axis=0))
    cold = unit(r, 800)
    x = np.vstack([hot, cold, near(r, cold)])
    edges = np.full((len(x), 32), -1, dtype=np.int32)
    edges[:400] = (np.arange(400)[:, None] + 1 + np.arange(32)) % 400  # the hot rows are linked, the others are not
    got, want = found_and_true(x, [edges], x, np.arange(len(x)))
    assert want <= got


def test_vectors_over_many_shards(spark):
    r = np.random.default_rng(10)
    base = unit(r, 500)
    x = np.vstack([near(r, np.repeat(base[:1], 60, axis=0)), base, near(r, base[:120]), near(r, base[:60])])
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {g["vec_id"]: g["n_links"] for g in hnsw.near_vectors(df, shard_rows=60).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert want.sum() > 0 and all(got[i] == want[i] for i in range(len(x)))
    rows = hnsw.near_vectors(df, shard_rows=60).collect()
    least = {i: i for i in range(len(x))}
    for _ in range(len(x)):
        new = {i: min(least[int(j)] for j in np.flatnonzero(u[i] @ u.T >= 0.93)) for i in least}
        if new == least:
            break
        least = new
    assert {r["vec_id"]: (r["component_id"], r["kept"]) for r in rows} == {i: (c, i == c) for i, c in least.items()}
    assert all(r["audited_recall"] is None or r["audited_recall"] >= 0.9 for r in rows)


def test_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [-1.0, 0.0], 0), (4, [-1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    got = key(tuple(r)[:4] for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == key([(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 0, 4, True), (None, 0, None, True)])


def test_vectors_empty(spark):
    assert hnsw.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_language(spark, docs):
    words = {"en": "the and with for thing house", "de": "der und mit für ding haus straße", "fr": "le et avec pour chose maison été"}
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(words[g].split(), 30)), g) for i in range(150) for g in [["en", "de", "fr"][i % 3]]]
    rows += [(900, None, "en"), (901, "123 456", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(df, langid.fit(df), ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == g and 0 <= got[i]["score"] <= 1 for i, _, g in rows if i < 900)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["rejected"]


def test_language_rejects_by_length(spark):
    words = {g: [w + x for w in t.split() for x in ("", "s", "er", "ing", "al")] for g, t in {"en": "the and with for thing house", "de": "der und mit für ding haus", "fr": "le et avec pour chose maison"}.items()}
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(words[g], int(r.integers(20, 200)))), g) for i in range(600) for g in [["en", "de", "fr"][i % 3]]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = [(k * 100 + i, " ".join(r.choice(words["de"], k))) for k in (2, 5, 20, 100, 1000) for i in range(40)]
    noise = [(k * 100 + i, " ".join("".join(r.choice(list("qxzjkwvyb"), 6)) for _ in range(k))) for k in (5, 20, 100, 1000) for i in range(40)]
    rejected = lambda x: [g["rejected"] for g in langid.identify(spark.createDataFrame(x, "doc_id long, text string"), model, ["doc_id"]).collect()]
    assert sum(rejected(clean)) <= 0.03 * len(clean)
    assert sum(rejected(noise)) >= 0.95 * len(noise)


def test_minhash_rows_of_one_id(spark):
    r = np.random.default_rng(21)
    say = lambda: [f"w{k}" for k in r.integers(0, 10**6, 60)]
    a, b, c = (" ".join(say()) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, c), (None, c + " z"), (None, a), (5, None), (6, " ")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert key((x["doc_id"], x["component_id"], x["kept"]) for x in got) == key(
        [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (None, 4, False), (None, 1, False), (5, 5, True), (6, 6, True)]
    )
    kept = minhash.one_of_each(spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, first int"), percent=85).collect()
    assert key(tuple(x)[:2] for x in kept) == key([(1, a), (1, b), (4, c), (5, None), (6, " ")])


def test_suffixes_across_buckets_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(17)
    say = lambda n: bytes(r.integers(97, 105, n).astype(np.uint8)).decode()
    indent = " " * 90  # many suffixes begin alike
    passage, hot = say(1200), indent + say(500)
    texts = [say(300) + passage + say(200), passage[300:] + say(900), "é" * 700, *(say(int(r.integers(0, 300))) + hot for _ in range(40)), *(indent + say(600) for _ in range(40)), say(9000)]
    texts.append(texts[-1][1000:2500] + say(50) + texts[-1][1200:1900])
    rows = list(enumerate(texts))
    seqs = [t.encode() for t in texts]
    want = key((i, len(s), sum(g), hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()) for (i, _), s, g in zip(rows, seqs, repeated(seqs, 400)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert key((x["doc_id"], x["n_bytes"], x["n_removed"], x["kept_sha256"]) for x in suffixes.remove_repeated_bytes(df).collect()) == want
    # small blocks, small sorts, one splitter for each lead
    p = [suffixes.Points([t], 400, suffixes.Powers()) for t in seqs]
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    for t, whole in zip(seqs, p):
        parts = suffixes.Points([t], 400, suffixes.Powers())
        starts = lambda x: sorted((int(at), int(k)) for at, lo, hi in zip(x.at, x.lo, x.hi) for k in range(lo, hi + 1))
        assert starts(parts) == starts(whole)
        assert all(bytes(lead.astype(">u8").tobytes()) == t[at : at + suffixes.LEAD] for lead, at in zip(parts.leads, parts.at))


def test_multikey_quicksort():
    r = np.random.default_rng(0)
    for m, k in ((0, 3), (1, 3), (200, 2), (3000, 3), (3000, 1 << 40)):
        w = r.integers(0, k, size=(m, 9), dtype=np.uint64)
        w[m // 2 :] = w[r.integers(0, max(m // 2, 1), m - m // 2)] if m > 1 else w[m // 2 :]
        order, tie = suffixes.multikey_quicksort(w)
        rows = [tuple(x) for x in w[order].tolist()]
        assert rows == sorted(rows) and tie.tolist() == [i > 0 and rows[i] == rows[i - 1] for i in range(m)]
        if m > 1:
            at = w[order][[m // 3, m - 1]]
            assert suffixes.cuts(w[order], at).tolist() == [sum(x <= tuple(q) for x in rows) for q in at.tolist()]
            assert suffixes.cuts(w[order], at, False).tolist() == [sum(x < tuple(q) for x in rows) for q in at.tolist()]


def test_mixing_and_shards(docs, corpus):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source"]: r["target"] for r in got}["a"] > 0
    rows = sharding.shards(docs, 4).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_quality(docs, corpus):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for d, t, *_ in corpus:
        w = WORD.findall(t or "")
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, x in enumerate(g) if g.count(x) > 1 for j in (i, i + 1, i + 2)} if len(w) < 1000 else None
        assert got[d]["n_words"] == len(w) and got[d]["word_chars"] == sum(map(len, w))
        assert hit is None or got[d]["n_repeat_words"] == len(hit)


def test_urls(spark):
    pages = [(1, "http://A.Example.com/en/7x?q"), (2, "https://b.com/en/1"), (3, None), (4, "no scheme"), (5, "x://example.net/de/88#a"), (6, "x://t.net/de/8"), (7, "x://com.au/en/")]
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got[1] == ("a.example.com", "example.com/en/7", "allow")
    assert got[2] == ("b.com", "com/en/", "block") and got[3] == got[4] == ("", None, "allow")
    assert got[5][1:] == ("example.net/de/8", "block") and got[6][1:] == ("net/de/", "allow") and got[7][1] is None


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7)], "u long, v long")
    got = dict(map(tuple, components(e).collect()))
    assert {got[i] for i in range(21)} == {0} and got[50] == got[45] == 40


def test_empty(empty):
    assert recompress.remove_repeats(empty).count() == suffixes.remove_repeated_bytes(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == packing.pack(empty).count() == mixing.mix(empty).count() == 0
    assert sharding.shards(empty).count() == quality.judge(empty).count() == 0
    assert langid.fit(empty) is None and langid.identify(empty, None, ["doc_id"]).count() == 0
