"""Every stage of the corpus pipeline, and all of them, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from noticeworks.llm import packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, _c0 string"
WORDS = {"en": "the and with for thing house garden", "de": "der und mit für ding haus straße garten", "fr": "le et avec pour chose maison été jardin"}


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(12)
    say = lambda g, n: " ".join(r.choice([f"{w}{x}" for w in WORDS[g].split() for x in ("", "s", "er", "ing")], n))
    out = [(i, say(g, int(r.integers(40, 120))), g, "abc"[i % 3]) for i in range(90) for g in [["en", "de", "fr"][i % 3]]]
    passage = say("en", 60)
    out += [(100 + i, f"{say('en', 30)} {passage} {say('en', 30)}", "en", "a") for i in range(4)]
    base = say("de", 100)
    out += [(120 + i, base + " " + say("de", i), "de", None) for i in range(5)]
    out += [(119, base, "de", "b"), (119, say("de", 80), "de", "b"), (None, say("fr", 70), "fr", "c"), (None, out[2][1], "fr", "c")]
    out += [(200, None, "en", "a"), (201, "", "en", None), (202, "12 34 !", None, "a"), (203, " ".join("".join(r.choice(list("qxzjkwvy"), 6)) for _ in range(80)), None, "a")]
    out += [(204, say("en", 6000), "en", "b"), out[5], out[5]]
    return [(*x, len(x[1]) if x[1] else None, None, 0.5, "extra") for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_language(spark, docs, rows):
    got = P.language(spark, docs, "")
    assert got.columns == docs.columns
    assert key(got.collect()) == key(r for r in rows if r[0] not in (200, 201, 202, 203))


def test_near_duplicates(spark, docs, rows):
    one = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [shingles(r[1]) for r in one]
    comp = list(range(len(one)))
    link = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    pairs = [(i, j) for i in range(len(one)) for j in range(i) if link(sets[i], sets[j])]
    while any(comp[i] != comp[j] for i, j in pairs):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    got = P.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert key(got.collect()) == key(r for i, r in enumerate(one) if comp[i] == i)


def test_substrings(spark, docs, rows):
    seqs = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(s[i : i + 35]) for s in seqs for i in range(len(s) - 34))
    want = []
    for r, s in zip(rows, seqs):
        gone = set()
        for i in range(len(s) - 34):
            if seen[tuple(s[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        text = " ".join(w for i, w in enumerate(s) if i not in gone) if gone else r[1]
        want.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    got = P.substrings(spark, docs, "")
    assert got.columns == docs.columns and key(got.collect()) == key(want)


def test_mixture(spark, docs, rows):
    got = P.mixture(spark, docs, "")
    assert got.columns == docs.columns
    taken, given = Counter(map(tuple, got.collect())), Counter(rows)
    assert all(given[r] and taken[r] <= 3 * given[r] for r in taken)
    size = lambda r: len(WORD.findall(r[1] or ""))
    have, words, large = Counter(), Counter(), Counter()
    for r, n in given.items():
        have[r[3]] += n * size(r)
        large[r[3]] = max(large[r[3]], size(r))
    for r, n in taken.items():
        words[r[3]] += n * size(r)
    weights = dict(zip(["a", "b", "c", None], (1, 2, 3, 1)))
    left, target = sum(have.values()), {}
    while len(target) < 4:
        share = {s: left * weights[s] / sum(w for t, w in weights.items() if t not in target) for s in weights if s not in target}
        full = [s for s in share if share[s] > 3 * have[s]]
        for s in full or list(share):
            target[s] = 3 * have[s] if full else share[s]
        left -= sum(target[s] for s in full)
    assert all(abs(words[s] - target[s]) <= 2 * large[s] for s in weights)


def test_sequences(spark, docs, rows):
    encode = packing.encoder()
    want = Counter((r[0], len(encode(r[1] or "")) + 1) for r in rows)
    got = P.sequences(spark, docs, "").collect()
    end = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(end.values()) <= 1024
    assert sum(r["length"] for r in got) == sum(n * c for (_, n), c in want.items())
    for d in {r[0] for r in rows}:
        assert sum(r["length"] for r in got if r["doc_id"] == d) == sum(n * c for (i, n), c in want.items() if i == d)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in P.STAGES[:-1]:
        left = spark.createDataFrame(f(spark, left, "").collect(), left.schema)
    want = Counter()
    encode = packing.encoder()
    for r in left.collect():
        want[r["doc_id"]] += len(encode(r["text"] or "")) + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want and sum(have.values()) > 0


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for _, f in P.STAGES[:-1]:
        assert f(spark, none, "").columns == none.columns and f(spark, none, "").count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
