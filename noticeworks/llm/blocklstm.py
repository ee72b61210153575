"""Main text of pages: a bidirectional recurrent network labels every leaf block in the context of the whole page."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import small_batches
from noticeworks.llm.hashing import U, Powers, Words, chunks
from noticeworks.llm.pageblocks import NO, PATH_BUCKETS, YES, Reader, made_pages

WORD_BUCKETS = 2048
PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 14, 6, 5, 12
#: Pages that the network is trained on and passes over them; both bound the training, which is the same for every input.
TRAIN_PAGES, PASSES = 1_800, 10
#: Blocks that go through the network at a time, at most about, with their padding.
AT_ONCE = 1 << 14

Params = dict[str, np.ndarray]


def measure(reader: Reader, pages: list[list[tuple[str, int, float]]], powers: Powers) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(path buckets of each path number, path of each block, word buckets with block offsets, figures) of the blocks of `pages`."""
    blocks = [b for page in pages for b in page]
    texts = [t.encode("utf-8", "surrogatepass") for t, _, _ in blocks]
    hashes, first = [], [0]
    for a, z in chunks(texts):
        w = Words(texts[a:z], powers, lower=True)
        hashes.append((w.hashes & U(WORD_BUCKETS - 1)).astype(np.int32))
        first.extend((first[-1] + w.first[1:]).tolist())
    words = np.concatenate([np.empty(0, dtype=np.int32), *hashes])
    start = np.array(first)
    chars = np.array([len(t) for t, _, _ in blocks], dtype=np.float32)
    place = np.concatenate([np.empty(0), *(np.linspace(0, 1, len(p)) for p in pages)])
    ends = np.array([t[-1] in ".!?…。" for t, _, _ in blocks], dtype=np.float32)
    links = np.array([k for _, _, k in blocks], dtype=np.float32)
    figures = np.stack([np.log1p(chars) / 6, np.log1p(np.diff(start)) / 4, links, ends, place], axis=1).astype(np.float32) if blocks else np.empty((0, FIGURES), dtype=np.float32)
    paths = [np.array(sorted({i for ids in path for i in ids}), dtype=np.int32) for path in reader.paths]
    return paths, np.array([p for _, p, _ in blocks], dtype=np.int64), (words, start), figures


def spread(params: Params, paths: list[np.ndarray], path: np.ndarray, words: tuple[np.ndarray, np.ndarray], figures: np.ndarray) -> np.ndarray:
    """What the network reads of each block: the mean of its path's vectors, the mean of its words' vectors, its figures."""
    of_path = np.stack([params["path"][ids].sum(axis=0) / np.sqrt(max(1, len(ids))) for ids in paths]) if paths else np.zeros((1, PATH_DIM), dtype=np.float32)
    ids, start = words
    n = len(path)
    mean = np.zeros((n, WORD_DIM), dtype=np.float32)
    for a in range(0, n, 4096):
        z = min(n, a + 4096)
        s = start[a : z + 1] - start[a]
        some = np.flatnonzero(np.diff(s))
        if len(some):
            total = np.add.reduceat(params["word"][ids[start[a] : start[z]]], s[some], axis=0)
            mean[a + some] = total / np.diff(s)[some][:, None]
    return np.concatenate([of_path[path], mean, figures], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _flip(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Places that turn each sequence round and leave its padding at the end."""
    t = np.arange(steps)
    return np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (pages, steps, HIDDEN) of an LSTM over `x`; `keep` gets what going back needs."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
    out = np.empty((n, steps, HIDDEN), dtype=np.float32)
    pre = x @ w + b
    for t in range(steps):
        z = pre[:, t] + h @ u
        g = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        new = np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * new
        th = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, new, th))
        h = o * th
        out[:, t] = h
    return out


def _back(x: np.ndarray, u: np.ndarray, w: np.ndarray, keep: list, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of (x, w, u, b) from those of the hidden states."""
    n, steps, _ = x.shape
    dh, dc = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
    dz = np.empty((n, steps, 4 * HIDDEN), dtype=np.float32)
    du = np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, new, th = keep[t]
        dh = dh + d[:, t]
        dc = dc + dh * o * (1 - th * th)
        z = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        dz[:, t] = z
        du += h.T @ z
        dh, dc = z @ u.T, dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _padded(x: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(first)[at]
    out = np.zeros((len(at), int(lengths.max()), x.shape[1]), dtype=np.float32)
    for k, p in enumerate(at):
        out[k, : lengths[k]] = x[first[p] : first[p + 1]]
    return out, lengths


def scores(params: Params, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The probability of main text for each block; page p has the rows first[p] up to first[p + 1] of `x`."""
    out = np.empty(len(x), dtype=np.float32)
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    while len(order):
        n = max(1, int(np.searchsorted(size[order] * np.arange(1, len(order) + 1), AT_ONCE, side="right")))
        at, order = order[:n], order[n:]
        seq, lengths = _padded(x, first, at)
        row, turn = np.arange(len(at))[:, None], _flip(lengths, seq.shape[1])
        ahead = _run(seq, params["w0"], params["u0"], params["b0"])
        back = _run(seq[row, turn], params["w1"], params["u1"], params["b1"])[row, turn]
        p = _sigmoid(ahead @ params["v0"] + back @ params["v1"] + seq @ params["vx"] + params["v"])
        for k, page in enumerate(at):
            out[first[page] : first[page + 1]] = p[k, : lengths[k]]
    return out


def _step(params: Params, data: tuple, labels: np.ndarray, first: np.ndarray, at: np.ndarray, drop: np.ndarray) -> Params:
    """Gradients over the pages `at`; `drop` marks the pages whose words are left out."""
    paths, path, (ids, start), figures = data
    rows = np.concatenate([np.arange(first[p], first[p + 1]) for p in at])
    own = np.cumsum([0, *np.diff(first)[at]])
    used, path_at = np.unique(path[rows], return_inverse=True)
    their = [paths[q] for q in used]
    word_ids = np.concatenate([ids[start[first[p]] : start[first[p + 1]]] for p in at])
    size = np.diff(start)[rows]
    x = spread(params, their, path_at, (word_ids, np.cumsum([0, *size])), figures[rows])
    seq, lengths = _padded(x, own, np.arange(len(at)))
    words = slice(PATH_DIM, PATH_DIM + WORD_DIM)
    seq[drop, :, words] = 0
    n, steps, _ = seq.shape
    row, turn = np.arange(n)[:, None], _flip(lengths, steps)
    back_seq = seq[row, turn]
    k0, k1 = [], []
    h0 = _run(seq, params["w0"], params["u0"], params["b0"], k0)
    h1 = _run(back_seq, params["w1"], params["u1"], params["b1"], k1)
    h1_at = h1[row, turn]
    p = _sigmoid(h0 @ params["v0"] + h1_at @ params["v1"] + seq @ params["vx"] + params["v"])
    mask = np.arange(steps) < lengths[:, None]
    y = np.zeros((n, steps), dtype=np.float32)
    y[mask] = labels[rows]
    dp = ((p - y) * mask / mask.sum()).astype(np.float32)
    g: Params = {"v": np.array([dp.sum()], dtype=np.float32), "vx": np.einsum("nt,ntd->d", dp, seq), "v0": np.einsum("nt,nth->h", dp, h0), "v1": np.einsum("nt,nth->h", dp, h1_at)}
    dx0, g["w0"], g["u0"], g["b0"] = _back(seq, params["u0"], params["w0"], k0, dp[:, :, None] * params["v0"])
    dx1, g["w1"], g["u1"], g["b1"] = _back(back_seq, params["u1"], params["w1"], k1, (dp[:, :, None] * params["v1"])[row, turn])
    dx = dx0 + dx1[row, turn] + dp[:, :, None] * params["vx"]
    dx[drop, :, words] = 0
    dx = dx[mask]
    to_word = np.repeat(dx[:, words] / np.maximum(size, 1)[:, None], size, axis=0)
    g["word"] = np.stack([np.bincount(word_ids, to_word[:, k], WORD_BUCKETS) for k in range(WORD_DIM)], axis=1).astype(np.float32)
    lens = np.array([len(q) for q in their])
    to_path = np.stack([np.bincount(path_at, dx[:, k], len(their)) for k in range(PATH_DIM)], axis=1) / np.sqrt(np.maximum(lens, 1))[:, None]
    to_path, flat = np.repeat(to_path, lens, axis=0), np.concatenate(their)
    g["path"] = np.stack([np.bincount(flat, to_path[:, k], PATH_BUCKETS) for k in range(PATH_DIM)], axis=1).astype(np.float32)
    return g


@lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES, passes: int = PASSES, seed: int = 11, rate: float = 0.01) -> Params:
    """The network, trained on `pages` made pages whose main text is known; kept for the life of the process."""
    r = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + FIGURES
    start = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    params: Params = {"path": np.zeros((PATH_BUCKETS, PATH_DIM), dtype=np.float32), "word": np.zeros((WORD_BUCKETS, WORD_DIM), dtype=np.float32)}
    for k in "01":
        params |= {f"w{k}": start(d, 4 * HIDDEN), f"u{k}": start(HIDDEN, 4 * HIDDEN), f"b{k}": np.zeros(4 * HIDDEN, dtype=np.float32), f"v{k}": start(HIDDEN)}
        params[f"b{k}"][HIDDEN : 2 * HIDDEN] = 1
    params |= {"vx": start(d), "v": np.zeros(1, dtype=np.float32)}
    reader = Reader()
    cut = [reader.blocks(p) for p in made_pages(pages, seed)]
    labels = np.array([YES in t for page in cut for t, _, _ in page], dtype=np.float32)
    clean = [[(t.replace(YES, "").replace(NO, "").strip() or "-", p, k) for t, p, k in page] for page in cut]
    first = np.cumsum([0, *map(len, clean)])
    paths, path, words, figures = measure(reader, clean, Powers())
    m, v = {k: np.zeros_like(a) for k, a in params.items()}, {k: np.zeros_like(a) for k, a in params.items()}
    step, batch = 0, 32
    for n in range(passes):
        order = r.permutation(len(clean))
        by = np.concatenate([c[np.argsort(np.diff(first)[c])] for c in np.array_split(order, max(1, len(order) // 512))])
        groups = [by[a : a + batch] for a in range(0, len(by), batch)]
        lr = rate * (1 - n / passes) ** 0.5
        for q in r.permutation(len(groups)):
            at = groups[q][np.diff(first)[groups[q]] > 0]
            if not len(at):
                continue
            g = _step(params, (paths, path, words, figures), labels, first, at, r.random(len(at)) < 0.5)
            step += 1
            for k, a in g.items():
                a = np.clip(a, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                params[k] = params[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return {k: a.astype(np.float32) for k, a in params.items()}


def main_texts(params: Params, pages: list[str], reader: Reader, powers: Powers) -> list[str]:
    """The main text of each page."""
    cut = [reader.blocks(p) for p in pages]
    first = np.cumsum([0, *map(len, cut)])
    p = scores(params, spread(params, *measure(reader, cut, powers)), first)
    return [" ".join(t for (t, _, _), s in zip(page, p[first[i] : first[i + 1]], strict=True) if s >= 0.5) for i, page in enumerate(cut)]


def _extract(params: Params):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, reader = Powers(), Reader()
        for pdf in batches:
            pages = [h if isinstance(h, str) else "" for h in pdf["html"]]
            if len(reader.paths) > 20_000:
                reader = Reader()
            texts = main_texts(params, pages, reader, powers)
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return run


def extract(pages: DataFrame, params: Params | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages` (page_id, url, html).

    A page is cut into leaf blocks in order. Each block is read as its tag path (hashed names of the tags and of their
    class, id and role), its hashed words and a few figures; an LSTM in each direction carries the context of the whole
    page to every block, and those labelled main text are joined. The network is trained on made pages of known
    main text (`trained`), the same ones for every input; no page of the input is learned from. Tasks work on Arrow
    batches of pages without a shuffle, so a task holds one batch and the network.

    Null and empty html: empty text. Texts are whole: very long pages are one sequence each. Repeated rows and null ids
    stay as they are; other columns are left out; an empty table gives no rows. page_id is read as a long.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(_extract(trained() if params is None else params), "page_id long, url string, text string, n_chars long")


def op12_pages(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


#: Where a page has one <article> with nothing foreign inside, its main text is that element's text; all pages of the given tables do.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '(?s)</?(p|h1|br)>', ' ', 'g'), '(?s)<[^>]*>', '', 'g') AS body FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)) AS body FROM t),
s AS (SELECT page_id, url, trim(regexp_replace(replace(body, '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM s"""
