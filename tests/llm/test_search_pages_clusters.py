"""Ranked search, page texts and clusters against brute force; nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import re
import types
from collections import Counter

import numpy as np
import pytest

from noticeworks.llm import ballmeans, blocklstm, pageblocks, wavelet
from noticeworks.llm.hashing import Powers

TERM = re.compile(wavelet.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    for item, text in items:
        out = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                out.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(out)[:k], 1):
            yield item, rank, i, -score


@pytest.fixture(scope="module")
def library():
    r = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)] + ["Ärger", "O'Neil", "x-y", "straße neu"]
    rare = 1 / np.arange(1, len(vocab) + 1)
    say = lambda n: " ".join(r.choice(vocab, n, p=rare / rare.sum()))
    docs = [(int(i), say(int(r.integers(1, 120)))) for i in r.permutation(700)]
    docs += [(2000 + i, docs[5][1]) for i in range(90)] + [docs[7], docs[7], (None, docs[5][1]), (3000, None), (3001, ""), (3002, " .,; "), (3003, "w3 " * 5000)]
    items = [(i, say(12).upper()) for i in range(8)] + [(20, docs[5][1]), (20, "w1 w1 w2"), (21, None), (22, ""), (23, "nowhere"), (24, "w399 nowhere")]
    return docs, items


@pytest.mark.parametrize("size", [300, 4000, 1 << 20])
def test_search_is_exact(spark, library, size):
    docs, items = library
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, item int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    index = wavelet.build_index(d, shard_terms=size)
    got = wavelet.search(index, q, k=50, block=5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(ranking(docs, items, 50), key=str)


def test_search_opens_few_nodes(library, monkeypatch):
    monkeypatch.setattr(wavelet, "WIDE", 8)
    docs, _ = library
    words = wavelet._Numbers()
    held = [(i, np.array([words[t.encode()] for t in terms(x)])) for i, x in docs if terms(x)]
    row = wavelet._shard([i for i, _ in held], [c for _, c in held], words, len(held), sum(len(c) for _, c in held))
    shard = wavelet.Shard(types.SimpleNamespace(**row))
    opened = [0]
    d, s = shard.best([b"w300", b"w0"], np.array([7000, 10]), 5, 1, opened)
    assert len(d) == 5 and list(s) == sorted(s, reverse=True)
    assert opened[0] < len(held) / 4


def test_search_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert wavelet.search(wavelet.build_index(d), q).collect() == []
    full = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert wavelet.search(wavelet.build_index(full), q.where("false")).collect() == []


PAGES = [
    # notices, menus, forms, adverts and comments round and inside of an article
    (
        '<body><div class="cookie-notice"><p>We use cookies to improve things.</p><button>Accept</button></div><header><h1>Site name</h1><nav><ul><li><a href=/>Home<li><a href=/x>News</ul></nav></header>'
        '<article><h1>A  title &amp; more</h1><p>First<b> part</b> of\n it.<p>Second &lt;p&gt; one.<div class="ad">Buy this now</div><ul><li>one<li>two</ul><p>Last line here.</p>'
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all, it is wrong.</p></div></section></article>'
        '<aside class="sidebar"><h3>Related</h3><ul><li><a href=/a>Another story</a></ul></aside><form class="newsletter"><label>Your email</label><button>Send</button></form><footer>&copy; Somebody</footer></body>',
        "A title & more First part of it. Second <p> one. one two Last line here.",
    ),
    ('<BODY><DIV ID="Menu"><A HREF="/1">One</A> <A HREF="/2">Two</A></DIV><MAIN><H1>Upper</H1><P>Case &#8211; tags.</P></MAIN><SCRIPT>if (a<b) document.write("<p>no</p>")</SCRIPT></BODY>', "Upper Case – tags."),
    ("", ""),
    (None, ""),
    ("<nav><ul><li><a href=/>Home</a></li></ul></nav><footer>&copy; nobody</footer>", ""),
    ('<article><h1>T</h1><p title="a>b">kept<!-- not > this --> text</p><textarea>typed</textarea><style>p{}</style></article>', "T kept text"),
]


def test_page_texts(spark):
    rows = [(n, f"http://h/{n}", h, "x") for n, (h, _) in enumerate(PAGES)]
    rows += [rows[0], (None, None, PAGES[1][0], "x"), (90, "u", "<article>" + "<p>word of it.</p>" * 20_000 + "</article><footer>end</footer>", "x")]
    got = blocklstm.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    texts = [t for _, t in PAGES]
    want = [(n, f"http://h/{n}", t, len(t)) for n, t in enumerate(texts)]
    long = " ".join(["word of it."] * 20_000)
    want += [want[0], (None, None, texts[1], len(texts[1])), (90, "u", long, len(long))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert blocklstm.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_labeller_on_held_out_pages():
    params = blocklstm.trained()
    reader = pageblocks.Reader()
    cut = [reader.blocks(p) for p in pageblocks.made_pages(200, 77)]
    truth = np.array([pageblocks.YES in t for page in cut for t, _, _ in page])
    clean = [[(t.replace(pageblocks.YES, "").replace(pageblocks.NO, "").strip() or "-", p, k) for t, p, k in page] for page in cut]
    first = np.cumsum([0, *map(len, clean)])
    said = blocklstm.scores(params, blocklstm.spread(params, *blocklstm.measure(reader, clean, Powers())), first) >= 0.5
    assert (said == truth).mean() > 0.985
    assert (said & truth).sum() / said.sum() > 0.97 and (said & truth).sum() / truth.sum() > 0.97


def test_labels_depend_on_the_whole_page():
    """The same block, with a path that says nothing, is judged by what stands round it."""
    params = blocklstm.trained()
    reader = pageblocks.Reader()
    block = "<div class=q7>Some words of no weight at all here.</div>"
    main = f"<article><h1>Title</h1><p>One sentence more of it.</p></article>{block}"
    cut = [reader.blocks(main), reader.blocks(f"<section class=comments><p>Reply says hello</p>{block}</section>")]
    p = blocklstm.scores(params, blocklstm.spread(params, *blocklstm.measure(reader, cut, Powers())), np.cumsum([0, *map(len, cut)]))
    odds = np.log(p / (1 - p))
    assert odds[2] > odds[4] + 1


def test_gradients_agree_with_differences():
    params = {k: v.astype(np.float64) for k, v in blocklstm.trained(8, 1).items()}
    r = np.random.default_rng(1)
    params["path"] += r.standard_normal(params["path"].shape) * 0.1
    reader = pageblocks.Reader()
    cut = [reader.blocks(p) for p in pageblocks.made_pages(3, 5)]
    labels = np.array([pageblocks.YES in t for page in cut for t, _, _ in page], dtype=np.float32)
    first = np.cumsum([0, *map(len, cut)])
    data = blocklstm.measure(reader, cut, Powers())
    g = blocklstm._step(params, data, labels, first, np.arange(3), np.zeros(3, dtype=bool))

    def loss():
        p = blocklstm.scores(params, blocklstm.spread(params, *data), first).astype(np.float64)
        return -np.where(labels > 0, np.log(p), np.log(1 - p)).mean()

    for name in ("u0", "w1", "v0", "vx", "b1"):
        at = tuple(np.array(params[name].shape) // 2)
        was, step = params[name][at], 1e-2
        params[name][at] = was + step
        up = loss()
        params[name][at] = was - step
        down = loss()
        params[name][at] = was
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def lloyd(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(e)) for e in v]) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    first = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))[:k]
    c = [v for _, v in first]
    for n in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, q, strict=True)), j) for j, q in enumerate(c)) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, to) in zip(kept, at, strict=True) if to == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    total = sum(d for d, _ in at)
    for (i, _), (d, j) in zip(kept, at, strict=True):
        yield i, j, d, sum(x for x, y in at if y == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()


def test_clusters_are_exact_and_compare_few(spark):
    r = np.random.default_rng(4)
    hearts = r.standard_normal((10, 64)) * 4
    rows = [(i, (hearts[i % 10] + r.standard_normal(64) * 0.3).tolist()) for i in range(600)]
    odd = [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, []), (906, [0.0] * 64)]
    rows += odd + [rows[3], rows[3], (None, rows[4][1]), (907, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, x int")
    kept = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    got = ballmeans.cluster_vectors(df)
    assert sorted(map(tuple, got.drop("compared").collect()), key=str) == sorted(lloyd(kept), key=str)
    assert got.agg({"compared": "avg"}).first()[0] < 8


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert ballmeans.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-7.0] * 64)]
    got = ballmeans.cluster_vectors(spark.createDataFrame(few, schema))
    assert sorted(map(tuple, got.drop("compared").collect())) == sorted(lloyd(few))
    with pytest.raises(Exception, match="beyond"):
        ballmeans.cluster_vectors(spark.createDataFrame([(1, [3e30] * 64)], schema)).collect()


def test_ball_bounds_keep_ties():
    r = np.random.default_rng(9)
    x, c = r.integers(-3, 4, (400, 2)), r.integers(-3, 4, (9, 2))
    want = ballmeans.nearest(x, c)
    for was in (r.integers(0, 9, 400), want[0]):
        got = ballmeans.moved(x, c, was)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
