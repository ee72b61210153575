"""The language model recomputed by plain Python: counts, document frequencies, mean centroids, cosines and the distance bound."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from noticeworks.llm import langid

FACTOR = 2654435761


def buckets(text):
    """Hashed pairs and triples of the bytes of a text, blanks in front of and behind it, runs of blanks left out."""
    fold = [ch if ch >= 128 else ord(chr(ch).lower()) if chr(ch).isalpha() else 32 for ch in b"  " + text.lower().encode() + b"    "]
    out = Counter()
    for a, b, c in zip(fold[1:], fold[2:], fold[3:]):
        if a == 32 and b == 32:
            continue
        out[((a << 8 | b) * FACTOR % 2**32) >> 21] += 1
        if not (b == 32 and c == 32):
            out[2048 + (((a << 16 | b << 8 | c) * FACTOR % 2**32) >> 10) % (8192 - 2048)] += 1
    return out


def unit(x):
    n = math.sqrt(sum(v * v for v in x.values()))
    return {k: v / n for k, v in x.items()}


@pytest.fixture(scope="module")
def fitted(spark):
    r = np.random.default_rng(17)
    words = {"en": "the and with for thing house water Tree", "de": "der und mit für Ding haus straße wasser", "fr": "le et avec pour chose maison été l'eau"}
    rows = [(i, " ".join(r.choice(words[g].split(), int(r.integers(1, 60)))) + ("" if i % 5 else ", 12!  x"), g) for i in range(240) for g in [["en", "de", "fr"][i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return rows, df, langid.fit(df, per_lang=10_000)


def test_model_is_what_it_says(fitted):
    rows, _, model = fitted
    train = [(buckets(t), g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    df = Counter(b for x, _ in train for b in x)
    idf = {b: math.log((1 + len(train)) / (1 + df[b])) + 1 for b in range(8192)}
    assert np.allclose(model.idf, [idf[b] for b in range(8192)], rtol=1e-5)
    for g in ("de", "en", "fr"):
        mine = [unit({b: n * idf[b] for b, n in x.items()}) for x, lang in train if lang == g]
        mean = Counter()
        for x in mine:
            mean.update(x)
        want = np.zeros(8192)
        for b, v in unit(mean).items():
            want[b] = v
        own = [c for c, lang in zip(model.centroids, model.langs, strict=True) if lang == g]
        assert len(own) == langid.CENTROIDS + 1 and np.abs(own[-1] - want).max() < 1e-4
        assert all(abs(np.linalg.norm(c) - 1) < 1e-4 for c in own)
        # the clusters part the rows of the language: each is the mean direction of those nearest to it
        dense = np.zeros((len(mine), 8192))
        for k, x in enumerate(mine):
            dense[k, list(x)] = list(x.values())
        near = (dense @ np.stack(own[:-1]).T).argmax(axis=1)
        for k in set(near.tolist()):
            c = dense[near == k].sum(axis=0)
            assert c @ own[k] / np.linalg.norm(c) > 0.95


def test_predictions_are_the_nearest_centroids(fitted):
    rows, df, model = fitted
    got = {x["doc_id"]: x for x in langid.identify(df, model, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        x = buckets(text)
        vector = {b: n * float(model.idf[b]) for b, n in x.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cos = [sum(v * float(c[b]) for b, v in vector.items()) / norm for c in model.centroids]
        best = max(cos)
        assert got[i]["score"] == pytest.approx(min(best, 1.0), abs=1e-4)
        assert got[i]["lang_pred"] in {lang for c, lang in zip(cos, model.langs, strict=True) if c > best - 1e-4}
        bound = np.interp(math.log2(sum(x.values())), model.sizes, model.least)
        assert got[i]["rejected"] == (best < bound) or abs(best - bound) < 1e-4
    right = sum(got[i]["lang_pred"] == g for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2)
    assert right >= 0.95 * sum(zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows)
