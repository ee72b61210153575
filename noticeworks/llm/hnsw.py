"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import small_batches, stage
from noticeworks.llm.components import components
from noticeworks.llm.hashing import U, mix

#: Bytes of the vectors of a shard, at most about, and its vectors at most and, if there are as many, at least.
SHARD_BYTES = 8 << 20
SHARD_MOST, SHARD_LEAST = 16_000, 1_024
SLICE_ROWS = 2_000
#: Slices that ask one copy of a shard's graph, at most about.
SLICES = 32
DEGREE = 16
#: Beams of the build, and the first one of a search.
BEAM = 64
FIRST_BEAM = 24
#: The audit: rows of a shard that get a planted neighbour, its cosine, queries of a slice that are held against all
#: rows of a shard, and the recall that both must reach.
PLANTS = 64
PLANTED = 0.95
AUDIT = 24
RECALL = 0.99


def beam_search(x: np.ndarray, edges: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), (queries, beam), best first: a best-first search of every query at once.

    `edges` has the neighbours of each row of `x`, -1 for none; `entry` the rows to start from, -1 for none. In a
    step every open query expands its best few rows; it ends when all rows of its beam are expanded. `count` gets the
    similarities that were computed.
    """
    n, m = len(q), edges.shape[1]
    wide = max(4, beam // 16)
    ids = np.full((n, beam), -1, dtype=np.int32)
    sims = np.full((n, beam), -np.inf, dtype=np.float32)
    todo = np.zeros((n, beam), dtype=bool)
    seen = np.zeros((n, len(x)), dtype=bool)
    live = np.arange(n)
    fresh = entry
    while len(live):
        fresh = np.sort(fresh, axis=1)
        ok = fresh >= 0
        ok[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        safe = np.where(ok, fresh, 0)
        ok &= ~seen[live[:, None], safe]
        r, c = np.nonzero(ok)
        got = safe[r, c]
        seen[live[r], got] = True
        if count is not None:
            count[0] += len(r)
        new = np.full(fresh.shape, -np.inf, dtype=np.float32)
        for a in range(0, len(r), 1 << 16):
            s = slice(a, a + (1 << 16))
            new[r[s], c[s]] = np.einsum("ij,ij->i", x[got[s]], q[live[r[s]]])
        all_s = np.concatenate([sims[live], new], axis=1)
        all_i = np.concatenate([ids[live], np.where(ok, fresh, -1)], axis=1)
        all_t = np.concatenate([todo[live], ok], axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        row = np.arange(len(live))[:, None]
        sims[live], ids[live] = all_s[row, top], all_i[row, top]
        t = all_t[row, top]
        rank = np.where(t, sims[live], -np.inf)
        k = min(wide, beam)
        pick = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        use = t[row, pick]
        heads = np.where(use, ids[live][row, pick], -1)
        t[row, pick] = False
        todo[live] = t
        open_ = use.any(axis=1)
        fresh = np.where(heads[open_][:, :, None] >= 0, edges[heads[open_]], -1).reshape(int(open_.sum()), k * m)
        live = live[open_]
    order = np.argsort(-sims, axis=1, kind="stable")
    row = np.arange(n)[:, None]
    return ids[row, order], sims[row, order]


def _choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates, best first, up to `m`: those nearer to the row than to one chosen before; then the best of the rest."""
    n, k = ids.shape
    out = np.full((n, m), -1, dtype=np.int32)
    safe = np.maximum(ids, 0)
    for a in range(0, n, 256):
        i, s = safe[a : a + 256], sims[a : a + 256]
        ok = ids[a : a + 256] >= 0
        v = x[i]
        between = np.einsum("nid,njd->nij", v, v)
        chosen = np.zeros(ok.shape, dtype=bool)
        for j in range(k):
            near = (between[:, j, :] > s[:, j : j + 1]) & chosen
            chosen[:, j] = ok[:, j] & ~near.any(axis=1) & (chosen.sum(axis=1) < m)
        order = np.argsort(np.where(chosen, 0, np.where(ok, 1, 2)), axis=1, kind="stable")[:, :m]
        row = np.arange(len(i))[:, None]
        picked = ids[a : a + 256][row, order]
        out[a : a + 256, : picked.shape[1]] = np.where(ok[row, order], picked, -1)
    return out


def _link_back(x: np.ndarray, edges: np.ndarray, source: np.ndarray) -> None:
    """Add the edges target -> source for the new rows `source`; a full row keeps the choice among old and new."""
    m = edges.shape[1]
    to = edges[source].ravel()
    frm = np.repeat(source, m)[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    heads, start, count = np.unique(to, return_index=True, return_counts=True)
    most = int(min(count.max(initial=0), 4 * m))
    held = np.full((len(heads), m + most), -1, dtype=np.int32)
    held[:, :m] = edges[heads]
    rank = np.arange(len(to)) - np.repeat(start, count)
    keep = rank < most
    held[np.repeat(np.arange(len(heads)), count)[keep], m + rank[keep]] = frm[keep]
    held = np.sort(held, axis=1)
    held[:, 1:][held[:, 1:] == held[:, :-1]] = -1
    sims = np.where(held >= 0, np.einsum("nkd,nd->nk", x[np.maximum(held, 0)], x[heads]), -np.inf)
    by = np.argsort(-sims, axis=1, kind="stable")
    row = np.arange(len(heads))[:, None]
    edges[heads] = _choose(x, held[row, by], sims[row, by].astype(np.float32), m)


def build(x: np.ndarray, seed: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> list[np.ndarray]:
    """Neighbour tables of the layers, the bottom one first; rows of unit vectors are in order of insertion.

    A row's top layer is drawn from `seed`; rows are inserted a batch at a time (at most as many as are in), each
    searched from the top layer down, linked to a spread choice of its nearest rows and of its batch, and back.
    """
    n = len(x)
    u = (mix(seed.view(U)) >> U(11)).astype(np.float64) / float(1 << 53)
    level = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(degree)).astype(np.int64), 6)
    layers = [np.full((n, 2 * degree if k == 0 else degree), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
    done = 0
    top: np.ndarray = np.empty(0, dtype=np.int64)
    while done < n:
        batch = np.arange(done, min(n, done + max(64, min(done, 512))))
        inside = x[batch] @ x[batch].T
        np.fill_diagonal(inside, -np.inf)
        entry = np.broadcast_to(top[:8].astype(np.int32), (len(batch), len(top[:8])))
        for k in range(len(layers) - 1, -1, -1):
            mine = level[batch] >= k
            m = layers[k].shape[1]
            if done and entry.shape[1]:
                ids, sims = beam_search(x[:done], layers[k][:done], x[batch], entry, beam if mine.any() else 8)
                entry = ids[:, :8]
            else:
                ids, sims = np.empty((len(batch), 0), dtype=np.int32), np.empty((len(batch), 0), dtype=np.float32)
            if mine.any():
                peer = np.where(mine[None, :], inside, -np.inf)
                near = np.argsort(-peer, axis=1)[:, : 2 * degree]
                ps = np.take_along_axis(peer, near, axis=1)
                ci = np.concatenate([ids, np.where(np.isfinite(ps), batch[near], -1)], axis=1)[mine]
                cs = np.concatenate([sims, ps], axis=1)[mine]
                by = np.argsort(-cs, axis=1, kind="stable")[:, : 3 * degree]
                row = np.arange(len(ci))[:, None]
                layers[k][batch[mine]] = _choose(x, ci[row, by].astype(np.int32), cs[row, by].astype(np.float32), m)
                _link_back(x, layers[k], batch[mine])
        done = int(batch[-1]) + 1
        top = np.argsort(-level[:done], kind="stable")[:8]
    return layers


def search(x: np.ndarray, layers: list[np.ndarray], level_top: np.ndarray, q: np.ndarray, own: np.ndarray, beam: int, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bottom-layer beams of queries; `own` is the query's row in this shard or -1, an entry of its own."""
    entry = np.broadcast_to(level_top.astype(np.int32), (len(q), len(level_top)))
    for k in range(len(layers) - 1, 0, -1):
        ids, _ = beam_search(x, layers[k], q, entry, 8, count)
        entry = np.where(ids >= 0, ids, entry[:, :1])
    return beam_search(x, layers[0], q, np.concatenate([entry, own[:, None].astype(np.int32)], axis=1), min(beam, len(x)), count)


def _exact(x: np.ndarray, q: np.ndarray, at: np.ndarray, low: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of the queries `at` with a similarity of `low` or above: blocks of all against all."""
    qs, rows = [at[:0]], [at[:0]]
    for s in range(0, len(at), 256):
        r, c = np.nonzero(q[at[s : s + 256]] @ x.T >= low)
        qs.append(at[s : s + 256][r])
        rows.append(c)
    return np.concatenate(qs), np.concatenate(rows)


@dataclass
class Graph:
    """A shard: unit vectors, the planted ones last, the layers, the row that each plant stands beside, and the beams that passed."""

    x: np.ndarray
    layers: list[np.ndarray]
    planted: np.ndarray
    beams: dict[bool, int | None] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return len(self.x) - len(self.planted)

    def top(self) -> np.ndarray:
        some = np.flatnonzero((self.layers[-1] >= 0).any(axis=1))[:8]
        return some if len(some) else np.zeros(1, dtype=np.int64)


@dataclass
class Report:
    """What the audits saw of the graph alone, how queries were answered, and the similarities that were computed."""

    audited: int = 0
    found: int = 0
    by_graph: int = 0
    by_brute: int = 0
    compared: int = 0


def plant(x: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plants, rows): unit vectors with a cosine of PLANTED to rows of `x`, spread by `seed`; fixed for a shard."""
    rows = np.argsort(mix(seed.view(U) ^ U(0x5BD1E995)), kind="stable")[:PLANTS]
    if x.shape[1] < 2:
        return x[:0], rows[:0]
    noise = np.random.default_rng(7).standard_normal((len(rows), x.shape[1])).astype(np.float32)
    noise -= (noise * x[rows]).sum(axis=1, keepdims=True) * x[rows]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return np.float32(PLANTED) * x[rows] + np.float32(math.sqrt(1 - PLANTED**2)) * noise, rows


def _passing_beam(g: Graph, inside: bool, report: Report) -> int | None:
    """The least beam, doubled from FIRST_BEAM up to the shard, with which the planted pairs are found; None if none does.

    Queries from `inside` the shard start at their own row and must find its plant; others are the plants themselves, start
    from the top and must find their row. Judged once for a shard and side.
    """
    if inside not in g.beams:
        n = len(g.planted)
        q = g.x[g.planted] if inside else g.x[g.rows :]
        want = g.rows + np.arange(n) if inside else g.planted
        own = g.planted if inside else np.full(n, -1)
        beam, count, passed = FIRST_BEAM, [0], None
        while n and passed is None:
            ids, _ = search(g.x, g.layers, g.top(), q, own, beam, count)
            hits = int((ids == want[:, None]).any(axis=1).sum())
            if hits >= RECALL * n:
                report.audited, report.found, passed = report.audited + n, report.found + hits, beam
            elif beam >= len(g.x):
                break
            beam *= 2
        report.compared += count[0]
        g.beams[inside] = passed
    return g.beams[inside]


def link_blocks(g: Graph, q: np.ndarray, own: np.ndarray, least: float, report: Report) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs with a similarity near `least` or above, through the graph.

    The beam is the one that finds the shard's planted pairs (see `_passing_beam`). AUDIT queries, fixed by a hash of
    their place, are also held against all rows: the mean share of their true links that the search finds must reach
    RECALL, else all beams are doubled and all queries searched again, up to the shard's size. A beam that ends above
    the threshold is doubled for its query; one that holds a quarter of the shard gives way to a comparison with all
    rows. Only a slice whose audit passes at no beam is compared by brute force as a whole. `report` has the
    audited pairs and what the graph found of them, the queries answered either way, and all similarities computed.
    """
    low = np.float32(least - 1e-4)
    rows = g.x[: g.rows]

    def brute(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        report.by_brute += len(at)
        report.compared += len(at) * len(rows)
        for s in range(0, len(at), 256):
            yield _exact(rows, q, at[s : s + 256], low)

    order = np.argsort(mix(np.arange(len(q), dtype=np.int64).view(U)), kind="stable")
    held = order[:AUDIT]
    ta, tb = _exact(rows, q, held, low)
    report.compared += len(held) * len(rows)
    ta = ta[own[ta] != tb]
    true = np.bincount(ta, minlength=len(q))
    counted = np.flatnonzero(true)
    sides = [_passing_beam(g, side, report) for side in np.unique(own >= 0).tolist()]
    first = None if None in sides else max(sides, default=FIRST_BEAM)
    wide = max(FIRST_BEAM, len(g.x) // 4)
    top, count = g.top(), [0]
    while first is not None:
        qs, found = [order[:0]], [order[:0]]
        todo, beam = np.arange(len(q)), first
        while len(todo) and (beam <= wide or beam == first):
            ids, sims = search(g.x, g.layers, top, q[todo], own[todo], beam, count)
            full = (sims[:, -1] >= low) & (ids.shape[1] < len(g.x))
            r, c = np.nonzero((sims >= low) & (ids < g.rows) & ~full[:, None])
            qs.append(todo[r])
            found.append(ids[r, c])
            todo, beam = todo[full], beam * 2
        qa, ra = np.concatenate(qs), np.concatenate(found)
        hits = np.bincount(qa[own[qa] != ra], minlength=len(q))
        asked = counted[~np.isin(counted, todo)]  # the others are compared with all rows below
        got = np.minimum(hits[asked], true[asked])
        if not len(asked) or (got / true[asked]).mean() >= RECALL:
            report.audited += int(true[asked].sum())
            report.found += int(got.sum())
            report.by_graph += len(q) - len(todo)
            report.compared += count[0]
            yield qa, ra
            yield from brute(todo)
            return
        first = None if first >= len(g.x) else first * 2
    report.compared += count[0]
    yield from brute(order)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, head): the least node of the component of each node in the pairs (a, b), heads themselves left out."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    head = np.arange(len(ids))
    while True:
        least = np.minimum(head[u], head[v])
        new = head.copy()
        for to in (u, v, head[u], head[v]):
            np.minimum.at(new, to, least)
        new = new[new]
        if (new == head).all():
            break
        head = new
    some = head != np.arange(len(ids))
    return ids[some], ids[head[some]]


def _unit(v: np.ndarray) -> np.ndarray:
    d = v.astype(np.float64)
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["id"].to_numpy()
    order = np.argsort(mix(ids.view(U)), kind="stable")
    ids, v = ids[order], np.stack(pdf["embedding"].to_numpy()[order]).astype(np.float64)
    x = _unit(v)
    extra, planted = plant(x, ids)
    layers = build(np.vstack([x, extra]), np.concatenate([ids, -1 - np.arange(len(extra))]))
    head = pdf.iloc[0]
    return pd.DataFrame(
        {
            "label": [head["label"]],
            "dim": [head["dim"]],
            "shard": [head["shard"]],
            "ids": [ids.tobytes()],
            "vectors": [v.tobytes()],
            "weights": [pdf["n"].to_numpy(np.int64)[order].tobytes()],
            "planted": [planted.astype(np.int64).tobytes()],
            "plants": [extra.tobytes()],
            "layers": [[g.tobytes() for g in layers]],
        }
    )


FOUND = "label long, a long, b long, links long, audited long, found long, by_graph long, by_brute long, compared long"
NONE = {"audited": 0, "found": 0, "by_graph": 0, "by_brute": 0, "compared": 0}


def _ask(least: float):
    """Rows of FOUND: for each query its links in a shard (by the vectors that a row stands for), edges that span what
    is linked, and what the audit saw. An index comes before the slices of queries that ask it."""

    def answer(label: int, index: tuple, qid: np.ndarray, qv: np.ndarray) -> Iterator[pd.DataFrame]:
        ids, v, weights, graph = index
        at = np.argsort(ids)
        pos = np.minimum(np.searchsorted(ids[at], qid), len(ids) - 1)
        own = np.where(ids[at][pos] == qid, at[pos], -1)
        links = np.zeros(len(qid), dtype=np.int64)
        tree: tuple[np.ndarray, np.ndarray] = (ids[:0], ids[:0])
        report = Report()
        for a, b in link_blocks(graph, _unit(qv), own, least, report):
            keep = own[a] != b
            a, b = a[keep], b[keep]
            for s in range(0, len(a), 1 << 15):
                i, j = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
                x, y = qv[i], v[j]
                ok = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= least
                np.add.at(links, i[ok], weights[j[ok]])
                tree = spanning(np.concatenate([tree[0], qid[i[ok]]]), np.concatenate([tree[1], ids[j[ok]]]))
        some = np.flatnonzero(links)
        none = pd.array([None], dtype="Int64")
        yield pd.DataFrame({"label": label, "a": qid[some], "b": none.repeat(len(some)), "links": links[some]} | NONE)
        yield pd.DataFrame({"label": label, "a": tree[0], "b": tree[1], "links": 0} | NONE)
        yield pd.DataFrame({"label": [label], "a": none, "b": none, "links": [0]} | {k: [n] for k, n in vars(report).items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: tuple = ()
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, dtype=np.int64)
                v = np.frombuffer(r.vectors).reshape(len(ids), -1)
                if r.kind:
                    yield from answer(r.label, index, ids, v)
                else:
                    planted = np.frombuffer(r.planted, dtype=np.int64)
                    x = np.vstack([_unit(v), np.frombuffer(r.plants, dtype=np.float32).reshape(len(planted), -1)]) if len(planted) else _unit(v)
                    layers = [np.frombuffer(g, dtype=np.int32).reshape(len(x), -1) for g in r.layers]
                    index = ids, v, np.frombuffer(r.weights, dtype=np.int64), Graph(x, layers, planted)

    return run


def _slices(rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, dtype=np.int64)
                v = np.frombuffer(r.vectors).reshape(len(ids), -1)
                for s in range(0, len(ids), rows):
                    yield pd.DataFrame(
                        {"label": [r.label], "dim": [r.dim], "salt": [int(r.shard) * len(ids) + s // rows], "ids": [ids[s : s + rows].tobytes()], "vectors": [v[s : s + rows].tobytes()]}
                    )

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, shard_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall, graph_queries, brute_queries, compared) for each row of `vectors` (vec_id, embedding, label).

    Vectors with equal labels, not null, and a cosine of at least `least` in double precision are linked.

    Equal vectors of a label go on as one, with their number. A label's vectors are dealt by hash into shards of
    about SHARD_BYTES, or `shard_rows`; a task builds the graph of one shard. Every slice of SLICE_ROWS queries goes to each shard
    of its label; a shard's slices are salted into groups of about SLICES, each with a copy of the graph and a task
    of its own, so a large label is many tasks and queries travel, not graphs. Found pairs are confirmed by their
    cosine in double precision. Pairs do not leave the task: it gives the number of links of each query, and edges
    that span what they link, at most one for each vector. Components are unions of these.

    The graph answers, with beams that are widened until audits pass (see `link_blocks`): each shard holds a few
    planted neighbours of its rows, which must be found, and a few queries of each slice are held against all rows.
    Brute force answers for a slice and shard that pass at no beam, and for a query whose links fill a quarter of the
    shard. For the label of a row: audited_recall is the share of the audited pairs, planted ones included, that the graph
    found by itself (null: no pair was audited), graph_queries and brute_queries count the questions (a query and a
    shard) answered either way, compared the similarities computed for them and their audits.
    Null labels, null or zero vectors, and vectors with a null or non-finite component link with nothing, not even
    with their copies. Vectors of other lengths are compared with their like only. Null ids link with nothing and
    have a null component. Rows with one id are one node, whose links are those of its different vectors together.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        & F.exists("embedding", lambda e: F.coalesce(e, F.lit(0.0)) != 0)
    )
    rows = v.where(F.coalesce(good, F.lit(False)))
    # a vector is told by 128 bits of hash, so that it is shuffled once
    at = ["label", "h1", "h2"]
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    alike = rows.groupBy(*at).agg(F.any_value("embedding").alias("embedding"), F.count_distinct("vec_id").alias("n"))
    alike = stage(alike.select(F.monotonically_increasing_id().alias("id"), *at, "embedding", "n", F.size("embedding").alias("dim")))
    member = stage(rows.select("vec_id", *at).join(alike.select(*at, "id", "n"), at).select("vec_id", "label", "id", "n").distinct())
    sizes = alike.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    most = F.lit(shard_rows) if shard_rows else F.least(F.lit(SHARD_MOST), F.greatest(F.lit(SHARD_LEAST), F.floor(SHARD_BYTES / 8 / F.col("dim"))))
    sizes = stage(sizes.select("label", "dim", F.ceil(F.col("rows") / most).alias("k"), F.ceil(F.col("rows") / (SLICE_ROWS * SLICES)).alias("groups")))
    dealt = alike.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("k")))
    schema = "label long, dim int, shard long, ids binary, vectors binary, weights binary, planted binary, plants binary, layers array<binary>"
    index = stage(dealt.select("label", "dim", "shard", "id", "embedding", "n").groupBy("label", "dim", "shard").applyInPandas(_index, schema), "snappy")
    slices = index.select("label", "dim", "shard", "ids", "vectors").mapInPandas(_slices(SLICE_ROWS), "label long, dim int, salt long, ids binary, vectors binary")
    asks = slices.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, ["label", "dim"]).withColumn("group", F.pmod("salt", F.col("groups")))
    asks = asks.withColumn("shard", F.explode(F.expr("sequence(0L, k - 1)")))
    graphs = index.join(sizes, ["label", "dim"]).withColumn("group", F.explode(F.expr("sequence(0L, groups - 1)")))
    at = ["label", "dim", "shard", "group"]
    none = lambda t: F.lit(None).cast(t)
    both = graphs.select(*at, F.lit(0).alias("kind"), "ids", "vectors", "weights", "planted", "plants", "layers").union(
        asks.select(*at, F.lit(1).alias("kind"), "ids", "vectors", none("binary"), none("binary"), none("binary"), none("array<binary>"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stage(both.repartition(n, *at).sortWithinPartitions(*at, "kind").mapInPandas(_ask(least), FOUND))
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    # rows of one id are one node: edges run between classes, and between the classes of an id
    ties = member.groupBy("vec_id").agg(F.min("id").alias("u"), F.max("id").alias("last"), F.count(F.lit(1)).alias("many")).where("many > 1").select("vec_id", "u")
    edges = found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")).union(member.join(ties, "vec_id").select("u", F.col("id").alias("v")))
    comps = components(edges)
    placed = member.join(comps, F.col("id") == F.col("node"), "left").join(links, F.col("id") == F.col("a"), "left")
    placed = stage(placed.select("vec_id", "label", F.coalesce("component", "id").alias("c"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least_id = placed.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    own = placed.join(least_id, "c").groupBy(F.col("vec_id").alias("o")).agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    seen = ("graph_queries", "brute_queries", "compared")
    sums = [F.sum(c).alias(n) for c, n in zip(("by_graph", "by_brute", "compared"), seen, strict=True)]
    recall = found.groupBy(F.col("label").alias("l")).agg(F.try_divide(F.sum("found").cast("double"), F.sum("audited")).alias("audited_recall"), *sums)
    out = v.select("vec_id", "label").join(own, F.col("vec_id") == F.col("o"), "left").join(recall, F.col("label") == F.col("l"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), "audited_recall", *seen)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "audited_recall", *seen)


def op2_vectors(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
