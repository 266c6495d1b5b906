"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt to shards of bounded size by a hash of vec_id. A shard's graph has a node for each
distinct vector, with the ids that share it, so copies can't wall off a part of the graph. The ground
layer is laid out in blocks: each vector is linked from one hub, the nearest, of about CELL vectors. Hubs are
trained on all vectors of the shard and get a top layer by a geometric draw. In every layer a hub links
to near hubs that aren't nearer to a link it already has, in both directions, and to a few of the next
layer chosen alike, which join regions that lie apart. The lists are stored flat: an array of neighbour
numbers and where each layer's begin. Inner products become distances by the usual extra coordinate. The
index is a table with a row per node. A search sends each block of queries to every shard, goes down the layers with a beam
whose finds all enter the next layer, and follows the links of the `ef` hubs found to the ground, where a hub's vectors are
scored for all queries of the block at once. Single precision only tells which can't be among the k best, with the bound of its
error; the rest is scored in double precision. `ef` is tuned in each shard: it grows until TRIALS of
the shard's own queries find RECALL of their nearest, by brute force over the shard, and nearly each of them half of its own; parts
of a layer that no link joins are linked by their nearest pair, so every hub can be reached. A shard returns its k best and
the merge keeps the k best of all.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or infinite component take no
part, nor do rows with a null vec_id; a vector is only compared with vectors of its own length; rows that
repeat a vec_id with the same vector count once; ties go to the smaller vec_id; fewer candidates than k
are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import common as C

#: Links of a hub in an upper layer; twice as many in layer 1, the lowest of hubs.
LINKS = 16
#: Near nodes from which the links are chosen.
BUILD = 64
#: Vectors of a hub, on average, and how often hubs move to the mean of their vectors.
CELL, MOVES = 128, 2
#: The search's beam over hubs where it isn't tuned, for a graph of up to BEAM_ROWS vectors, wider in larger ones; and the
#: beam in the upper layers, whose finds all enter the next one.
BEAM, BEAM_ROWS, ENTRIES = 160, 4_096, 32
#: Queries of a shard that its beam is tuned by, the share of their nearest that they must find together, and the share of
#: queries that may find less than half of theirs.
TRIALS, RECALL, POOR = 192, 0.95, 0.006
#: Shards at least, so that small tables are spread over tasks as well. There are as many shards as cores, but none
#: has fewer than about SHARD_ROWS vectors on average, nor more than SHARD_BYTES of components (or SHARD_ROWS vectors).
LEAST_SHARDS, SHARD_ROWS, SHARD_BYTES = 8, 8_192, 32 << 20
QUERY_BLOCK, WALKS = 2048, 256
#: Vectors that await their double-precision product at a time, and those whose products are taken at a time.
HELD, AT_ONCE = 2_000_000, 65_536

_NODE = "shard int, kind int, no int, ids array<long>, vec array<double>, links array<int>, begins array<int>"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0.0)).distinct()


def _diverse(x: np.ndarray, half: np.ndarray, cand: np.ndarray, own: np.ndarray, links: int) -> np.ndarray:
    """Which candidates (nearest first, own: their likeness to the row) are kept: those to which no kept one is nearer than the row is, up to so many."""
    kept, blocked = np.zeros(cand.shape, bool), ~np.isfinite(own)
    count = np.zeros(len(cand), np.int32)
    vec = x[cand]
    nearer = vec @ vec.transpose(0, 2, 1) - half[cand][:, :, None] - half[cand][:, None, :] > own[:, None, :]  # row, kept one, candidate
    for k in range(cand.shape[1]):
        take = ~blocked[:, k] & (count < links)
        kept[:, k] = take
        count += take
        blocked |= nearer[:, k] & take[:, None]
    return kept


def _nearest_of(x: np.ndarray, half: np.ndarray, rows: np.ndarray, pool: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of rows the nearest of pool but for itself, nearest first, and their likeness."""
    sim = x[rows] @ x[pool].T - half[pool][None, :] - half[rows][:, None]
    sim[pool[None, :] == rows[:, None]] = -np.inf
    cand = np.argpartition(-sim, min(near, len(pool)) - 1, axis=1)[:, :near]
    score = np.take_along_axis(sim, cand, 1)
    order = np.lexsort((cand, -score), axis=1)
    return pool[np.take_along_axis(cand, order, 1)], np.take_along_axis(score, order, 1)


def _layer(x: np.ndarray, links: int, hubs: np.ndarray) -> np.ndarray:
    """Neighbour numbers of every row of x in one layer, -1 where there are fewer; hubs: the rows that are in the next layer too."""
    n = len(x)
    out = np.full((n, links), -1, np.int32)
    if n < 2:
        return out
    half = (x * x).sum(1) / 2
    picked: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    every = np.arange(n)
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        cand, own = _nearest_of(x, half, rows, every, BUILD)
        kept = _diverse(x, half, cand, own, links // 2)
        left = links // 2 - kept.sum(1)  # the nearest of the rest fill half of the list
        kept |= ~kept & ((~kept).cumsum(1) <= left[:, None]) & np.isfinite(own)
        r, c = np.nonzero(kept)
        picked.append((rows[r], cand[r, c], own[r, c], np.zeros(len(r), np.int8)))
        if len(hubs) > 1:  # links to other regions, whatever the near ones are
            cand, own = _nearest_of(x, half, rows, hubs, BUILD // 2)
            r, c = np.nonzero(_diverse(x, half, cand, own, links // 8))
            picked.append((rows[r], cand[r, c], own[r, c], np.ones(len(r), np.int8)))
    a, b, s, far = (np.concatenate([p[i] for p in picked]) for i in range(4))
    # Both directions: the row's own choices first, then the nearest of those that chose it.
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.concatenate([far, far + 2])
    order = np.lexsort((dst, -np.concatenate([s, s]), rank, src))
    src, dst = src[order], dst[order]
    _, first = np.unique(src.astype(np.int64) * n + dst, return_index=True)
    first.sort()
    src, dst = src[first], dst[first]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    fit = place < links
    out[src[fit], place[fit]] = dst[fit]
    return out


def _bridges(x: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows of x that, linked, make one of a layer's parts that no link joins: each part but the largest by its nearest pair to the others."""
    part = np.arange(len(x))
    rows, at = np.nonzero(near >= 0)
    to = near[rows, at]
    while True:
        least = part.copy()
        np.minimum.at(least, rows, part[to])
        np.minimum.at(least, to, part[rows])
        least = least[least]
        if (least == part).all():
            break
        part = least
    names, sizes = np.unique(part, return_counts=True)
    half, out = (x * x).sum(1) / 2, []
    for name in names[np.argsort(sizes, kind="stable")][:-1]:
        own, rest = np.flatnonzero(part == name), np.flatnonzero(part != name)
        sim = x[own] @ x[rest].T - half[own][:, None] - half[rest][None, :]
        a, b = np.unravel_index(int(sim.argmax()), sim.shape)
        out.append((int(own[a]), int(rest[b])))
        part[own] = part[rest[b]]
    return out


def _nearest_hub(x: np.ndarray, hubs: np.ndarray) -> np.ndarray:
    half = (hubs * hubs).sum(1) / 2
    return np.concatenate([(x[at : at + 4096] @ hubs.T - half).argmax(1) for at in range(0, len(x), 4096)])


def _hubs(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Hubs of the rows of x, each with a row at least, and every row's hub."""
    hubs = x[np.sort(rng.choice(len(x), max(1, len(x) // CELL), replace=False))]
    for _ in range(MOVES):
        own = _nearest_hub(x, hubs)
        order = np.argsort(own, kind="stable")
        full, first = np.unique(own[order], return_index=True)
        hubs = (np.add.reduceat(x[order], first, axis=0, dtype=np.float64) / np.diff([*first, len(x)])[:, None]).astype(np.float32)
    full, own = np.unique(_nearest_hub(x, hubs), return_inverse=True)
    return hubs[full], own.ravel()


def _power_of_two(largest: np.ndarray) -> np.ndarray:
    """What brings the largest components to at most 1, without rounding."""
    return np.ldexp(1.0, -np.clip(np.frexp(largest)[1], -1000, 1000))


def build_shard(shard: int, ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
    """The rows of a shard's graph: its vectors, then its hubs, which have no ids."""
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    node = node.ravel()
    order = np.lexsort((ids, node))
    groups = np.split(ids[order], np.flatnonzero(np.diff(node[order])) + 1)
    n = len(distinct)
    scale = _power_of_two(np.abs(distinct).max())
    scaled = distinct * scale
    norms = (scaled**2).sum(1)
    x = np.concatenate([scaled, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)
    rng = np.random.default_rng(shard + 1)
    hubs, own = _hubs(x, rng)
    h = len(hubs)
    top = 1 + np.minimum((-np.log(1 - rng.random(h)) / np.log(LINKS)).astype(int), 6)
    top[rng.integers(h)] = max(top.max(), 2) if h > LINKS else 1
    lists: list[list[np.ndarray]] = [[m.astype(np.int32)] for m in np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))[:-1])]
    for level in range(1, int(top.max()) + 1):
        members = np.flatnonzero(top >= level)
        near = _layer(hubs[members], LINKS * (2 if level == 1 else 1), np.flatnonzero(top[members] > level))
        own_links = [row[row >= 0].tolist() for row in near]
        for a, b in _bridges(hubs[members], near):
            own_links[a].append(b)
            own_links[b].append(a)
        for i, m in enumerate(members):
            lists[m].append((n + members[own_links[i]]).astype(np.int32))
    none, bare = np.zeros(0, np.int32), np.zeros(2, np.int32)
    flat = [none] * n + [np.concatenate(x) for x in lists]
    begins = [bare] * n + [np.cumsum([0, *map(len, x)]).astype(np.int32) for x in lists]
    vec = [*distinct, *(hubs[:, :-1].astype(np.float64) / scale)]
    return pd.DataFrame({"shard": np.int32(shard), "kind": np.int32(0), "no": np.arange(n + h, dtype=np.int32), "ids": [*groups, *[np.zeros(0, np.int64)] * h], "vec": vec, "links": flat, "begins": begins})


def _rows(frame: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, preserve_index=False, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("kind", pa.int32()), ("no", pa.int32()), ("ids", pa.list_(pa.int64())), ("vec", pa.list_(pa.float64())), ("links", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32()))]
)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches cut where (shard, kind) changes: (kind, batches) whole for kinds up to keep, batch by batch for others."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("shard", "kind"))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = (int(shard[a]), int(kind[a]))
            if held and now != last:
                yield last[1], held
                held = []
            last = now
            if now[1] <= keep:
                held.append(batch.slice(a, b - a))
            else:
                yield now[1], [batch.slice(a, b - a)]
    if held:
        yield last[1], held


def shard_count(n: int, dim: int, cores: int) -> int:
    """Shards for n vectors: their number follows the cores while each is of a bounded size."""
    fewest, most = -(-n // max(SHARD_ROWS, SHARD_BYTES // (8 * dim))), -(-n // SHARD_ROWS)
    return max(LEAST_SHARDS, fewest, min(cores, most))


def index(vectors: DataFrame) -> DataFrame:
    """The graph's rows for usable vectors (vec_id, vec), settled."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    shards = shard_count(size.n, size.dim or 1, vectors.sparkSession.sparkContext.defaultParallelism)
    # Each vector length has shards of its own.
    dealt = vectors.select((F.size("vec") * shards + F.pmod(F.xxhash64("vec_id"), F.lit(shards))).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "vec")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _runs(batches, 0):
            ids = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
            made = build_shard(parts[0].column(0)[0].as_py(), ids, np.concatenate([_matrix(p.column(3)) for p in parts]))
            for at in range(0, len(made), 2000):
                yield _rows(made.iloc[at : at + 2000])

    spread = dealt.repartition(shards * 4, "shard").sortWithinPartitions("shard", "vec_id")
    return C.settle(spread.mapInArrow(build, _NODE), "ann-index")


class Graph:
    """One shard's graph, ready to search."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        column = lambda name: pa.concat_arrays([r.column(r.schema.get_field_index(name)) for r in rows])
        order = np.argsort(column("no").to_numpy(zero_copy_only=False))
        self.ids = column("ids").take(pa.array(order))
        self.n_ids = self.ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat_ids = self.ids.flatten().to_numpy(zero_copy_only=False)
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        n = self.n = int((self.n_ids > 0).sum())
        vec = _matrix(column("vec"))[order]
        self.vec = vec[:n]
        self.scale = _power_of_two(np.abs(self.vec).max())
        self.hubs = (vec[n:] * self.scale).astype(np.float32)
        hubs = pa.array(order[n:])
        links, begins = (column(c).take(hubs).to_pylist() for c in ("links", "begins"))
        # The ground layer: vectors in the order of their hubs.
        self.node = np.concatenate([np.array(x[: b[1]], np.int64) for x, b in zip(links, begins, strict=True)])
        self.start = np.cumsum([0, *(b[1] for b in begins)])
        self.low = (self.vec[self.node] * self.scale).astype(np.float32)
        norms = np.sqrt((self.low.astype(np.float64) ** 2).sum(1))
        self.longest = np.maximum.reduceat(norms, self.start[:-1])
        self.top = np.array([len(b) - 2 for b in begins])
        self.layers: list[np.ndarray] = []  # from layer 1 on, by number of the hub
        for level in range(1, int(self.top.max()) + 1):
            members = np.flatnonzero(self.top >= level)
            table = np.full((len(hubs), max(1, *(begins[i][level + 1] - begins[i][level] for i in members))), -1, np.int32)
            for i in members:
                near = links[i][begins[i][level] : begins[i][level + 1]]
                table[i, : len(near)] = np.array(near, np.int64) - n
            self.layers.append(table)

    def _beam(self, low: np.ndarray, layer: np.ndarray, seeds: np.ndarray, ef: int) -> np.ndarray:
        """The ef best hubs that a beam finds in a layer for each query, from its seeds (-1: none) on, best first; -1 where fewer."""
        n, every = len(self.hubs), np.arange(len(low))
        sims = np.full((len(low), n), -np.inf, np.float32)
        seen, done = np.zeros((len(low), n + 1), bool), np.zeros((len(low), n), bool)
        seen[:, n] = True
        new = np.zeros((len(low), n + 1), bool)
        new[every[:, None], np.where(seeds >= 0, seeds, n)] = True
        live = every
        while len(live):
            new &= ~seen[live]
            r, c = np.nonzero(new)
            seen[live] |= new
            for at in range(0, len(r), AT_ONCE):
                own, hub = live[r[at : at + AT_ONCE]], c[at : at + AT_ONCE]
                sims[own, hub] = np.einsum("rd,rd->r", self.hubs[hub], low[own])
            own = sims[live]
            least = np.maximum(np.partition(own, n - ef, axis=1)[:, n - ef], np.finfo(np.float32).min)
            todo = (own >= least[:, None]) & ~done[live]  # the open hubs of the beam are all followed
            done[live] |= todo
            go = todo.any(1)
            live, todo = live[go], todo[go]
            new = np.zeros((len(live), n + 1), bool)
            r, c = np.nonzero(todo)
            for at in range(0, len(r), AT_ONCE):
                new[r[at : at + AT_ONCE, None], layer[c[at : at + AT_ONCE]]] = True
        found = np.argpartition(-sims, ef - 1, axis=1)[:, :ef]
        own = np.take_along_axis(sims, found, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        return np.take_along_axis(np.where(own > -np.inf, found, -1), order, 1)

    def beam(self, ef: int) -> int:
        """The beam for this graph's size where it isn't tuned; ef is that for BEAM_ROWS vectors."""
        return int(ef * max(1.0, self.n / BEAM_ROWS) ** 0.75)

    def tuned(self, q: np.ndarray, share: float = RECALL, k: int = 20, of: int = 20) -> int:
        """The least beam with which the queries find that share of their `of` nearest, which brute force tells, and nearly all of them half of theirs."""
        hubs = len(self.hubs)
        if not len(q) or hubs <= 8:
            return hubs
        products = (q * _power_of_two(np.abs(q).max(1))[:, None]).astype(np.float32) @ self.low.T
        least = np.partition(products, max(0, self.n - of), axis=1)[:, max(0, self.n - of)]
        r, c = np.nonzero(products >= least[:, None])
        wanted, ef = r * self.n + self.node[c], 8
        while ef < hubs:
            found, _ = self.search(q, ef, k)
            hit = np.bincount(r, np.isin(wanted, np.where(found < 0, -1, np.arange(len(q))[:, None] * self.n + found)), len(q))
            if hit.sum() >= share * len(q) * min(of, self.n) and (2 * hit < np.bincount(r, minlength=len(q))).mean() <= POOR:
                break
            ef = int(ef * 1.25)
        return min(ef, hubs)

    def search(self, q: np.ndarray, ef: int, k: int = 20) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the k + 1 best nodes found for each query, best first, -1 where fewer, and their double-precision products; ties to the smaller first id."""
        unit = _power_of_two(np.abs(q).max(1))
        low = (q * unit[:, None]).astype(np.float32)
        parts = []
        for at in range(0, len(q), WALKS):
            own = np.full((len(low[at : at + WALKS]), 1), int(np.argmax(self.top)), np.int64)
            for level in range(int(self.top.max()), 0, -1):
                own = self._beam(low[at : at + WALKS], self.layers[level - 1], own, min(len(self.hubs), ef if level == 1 else ENTRIES))
            parts.append(own)
        hubs = np.concatenate(parts)
        best = _Best(self, q, low, unit, k + 1)
        at, width = 0, 2
        while at < hubs.shape[1]:  # the nearest hubs first: they tell what farther ones must surpass
            self._ground(best, low, hubs[:, at : at + width])
            at, width = at + width, width * 4
        return best.node, best.exact

    def _ground(self, best: _Best, low: np.ndarray, hubs: np.ndarray) -> None:
        """Offer to best the vectors of each query's hubs that may be among its best."""
        rows, cols = np.nonzero(hubs >= 0)
        of = hubs[rows, cols]
        order = np.argsort(of, kind="stable")
        rows, of = rows[order], of[order]
        cuts = np.flatnonzero(np.diff(of)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
            if a == b:
                continue
            own, hub = rows[a:b], of[a]
            first, last = self.start[hub], self.start[hub + 1]
            sim = low[own] @ self.low[first:last].T
            r, c = np.nonzero(sim >= best.floor(own, self.longest[hub])[:, None])
            best.offer(own[r], first + c, sim[r, c], self.longest[hub])
        best.settle()


class _Best:
    """The best nodes of each query of a block so far, in double precision."""

    def __init__(self, graph: Graph, q: np.ndarray, low: np.ndarray, unit: np.ndarray, size: int) -> None:
        self.graph, self.q, self.unit, self.size = graph, q, unit, size
        self.node = np.full((len(q), size), -1, np.int64)
        self.exact = np.full((len(q), size), -np.inf)
        self.least = np.full(len(q), -np.inf)  # the last of the best, scaled as the single-precision products are
        #: Bound of a single-precision product's error, for a vector of length 1; those of tiny numbers are added.
        self.error = (q.shape[1] + 3) * 2.0**-22 * np.sqrt((low.astype(np.float64) ** 2).sum(1))
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def floor(self, rows: np.ndarray, longest: float) -> np.ndarray:
        """The single-precision product below which a vector of at most this length can't be among the best."""
        return np.nextafter((self.least[rows] - self.error[rows] * longest - 1e-30).astype(np.float32), np.float32(-np.inf))

    def offer(self, rows: np.ndarray, places: np.ndarray, sim: np.ndarray, longest: float) -> None:
        self.held.append((rows, places, sim, self.error[rows] * longest + 1e-30))
        self.n_held += len(rows)
        if self.n_held > HELD:
            self.settle()

    def settle(self) -> None:
        """Take up what was offered."""
        if not self.n_held:
            return
        rows, places, sim, error = (np.concatenate([x[i] for x in self.held]) for i in range(4))
        self.held, self.n_held = [], 0
        # What can't be among the best even of those offered goes first.
        order = np.lexsort((error - sim, rows))
        place = _place(rows[order])
        least = self.least.copy()
        sure = order[place == self.size - 1]
        least[rows[sure]] = np.maximum(least[rows[sure]], sim[sure].astype(np.float64) - error[sure])
        stay = sim + error >= least[rows]
        rows, node = rows[stay], self.graph.node[places[stay]]
        exact = np.concatenate([np.zeros(0), *(np.einsum("rd,rd->r", self.graph.vec[node[at : at + AT_ONCE]], self.q[rows[at : at + AT_ONCE]]) for at in range(0, len(rows), AT_ONCE))])
        had, col = np.nonzero(self.node >= 0)
        rows, node, exact = np.concatenate([had, rows]), np.concatenate([self.node[had, col], node]), np.concatenate([self.exact[had, col], exact])
        order = np.lexsort((self.graph.flat_ids[self.graph.first_id[node]], -exact, rows))
        place = _place(rows[order])
        order, place = order[place < self.size], place[place < self.size]
        self.node[rows[order], place], self.exact[rows[order], place] = node[order], exact[order]
        full = self.node[:, -1] >= 0
        self.least[full] = self.exact[full, -1] * self.graph.scale * self.unit[full]


def _place(rows: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row, where entries of a row stand together."""
    begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(begins, np.diff([*begins, len(rows)]))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ef: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors (vec_id, embedding) with the largest inner products found for each query, its own id left out; ef: the beam, tuned where it is not given."""
    pool = C.settle(usable(vectors), "ann-vectors")
    asked = usable(queries)
    graph = index(pool)
    shards = graph.select("shard", F.size("vec").alias("dim")).distinct()
    shards = C.settle(shards, "ann-shards")
    blank = {"ids": F.array(F.col("vec_id")), "links": F.lit(None).cast("array<int>"), "begins": F.lit(None).cast("array<int>")}
    sent = asked.withColumn("dim", F.size("vec")).join(C.maybe_broadcast(shards), "dim").select("shard", F.lit(1).alias("kind"), F.pmod(F.xxhash64("vec_id"), F.lit(2**31 - 1)).cast("int").alias("no"), blank["ids"].alias("ids"), "vec", blank["links"].alias("links"), blank["begins"].alias("begins"))
    # A shard's nodes come first in its partition, then the queries in random order, which are searched block by block.
    of_dims = shards.groupBy("dim").count().agg(F.sum("count"), F.min("count")).first()
    many, fewest = of_dims[0] or 1, of_dims[1] or 1
    # Tasks follow the shards, many more than these where these are many, so that few tasks hold several.
    rows = graph.unionByName(sent).repartition(LEAST_SHARDS * 4 if many <= LEAST_SHARDS * 2 else many * 16, "shard").sortWithinPartitions("shard", "kind", "no", "ids")
    # Of a query's k nearest so many stand in a shard, but for few.
    of = min(k + 1, int(np.ceil(k / fewest + 2 * np.sqrt(k / fewest))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Graph | None = None
        beam = 0
        for kind, parts in _runs(batches, 0):
            if kind == 0:
                own, beam = Graph(parts), ef or 0
                continue
            ids = parts[0].column(3).flatten().to_numpy(zero_copy_only=False)
            vec = _matrix(parts[0].column(4))
            beam = beam or own.tuned(vec[:TRIALS], k=k, of=of)
            for at in range(0, len(ids), QUERY_BLOCK):
                asked = ids[at : at + QUERY_BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best_ids(own, asked, *own.search(vec[at : at + QUERY_BLOCK], beam, k), k)], schema=_FOUND)

    found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best_ids(graph: Graph, asked: np.ndarray, found: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and score of the k best ids of the nodes found, but for the query's own; of a node's ids the smallest ones."""
    rows, cols = np.nonzero(found >= 0)
    node, score = found[rows, cols], exact[rows, cols]
    many = np.minimum(graph.n_ids[node], k + 1)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    ids, rows, score = graph.flat_ids[np.repeat(graph.first_id[node], many) + offset], np.repeat(rows, many), np.repeat(score, many)
    other = ids != asked[rows]
    ids, rows, score = ids[other], rows[other], score[other]
    order = np.lexsort((ids, -score, rows))
    order = order[_place(rows[order]) < k]
    return asked[rows[order]], ids[order], score[order]
