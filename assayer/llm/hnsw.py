"""Nearest neighbours by one hierarchical navigable small-world graph per shard, kept as flat neighbour arrays.

Rows are dealt to shards by a hash of their id; a shard's rows grow as the root of the table.  A task builds a shard's graph in numpy, a batch of
nodes at a time, and hands it on as one row: vectors, ids and one flat int32 array per layer.  Queries, in blocks, meet
every shard by an equi-join on the shard number; the shards' results are merged per query.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm.forest import usable
from assayer.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a shard: at least the first number; they grow as the root of the table, so that more rows mean larger graphs
#: rather than as many more shards for each query to visit, up to the second, which a task can hold.
SHARD_ROWS, SHARD_ROWS_AT_MOST = 3000, 200_000
QUERY_ROWS = 4096
M, M0, EF_BUILD, EF = 16, 32, 80, 160
BATCH = 256


def _distances(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q (rows) to x[nodes] (rows of nodes), from differences, so that clusters far from the origin
    keep their digits in single precision."""
    gap = x[nodes]
    gap -= q[:, None]
    return np.einsum("ijk,ijk->ij", gap, gap)


def _diverse(x, own: np.ndarray, nodes: np.ndarray, dist: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates (nearest first, -1: none) those nearer to the row's own node than to any chosen one;
    then the nearest of the rest, up to `keep`, and their distances.  Rows are padded with -1."""
    rows, width = nodes.shape
    got = x[nodes] - x[own][:, None]
    norms = np.einsum("ijk,ijk->ij", got, got)
    among = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(got, got.transpose(0, 2, 1))
    barred = nodes < 0
    chosen, count = np.zeros((rows, width), bool), np.zeros(rows, int)
    for c in range(width):
        take = ~barred[:, c] & (count < keep)
        chosen[:, c] = take
        count += take
        barred |= take[:, None] & (among[:, c] < dist)
    rank = np.where(chosen, 0, np.where(nodes < 0, 2, 1)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :keep]
    out, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
    more = ((0, 0), (0, max(0, keep - width)))
    return np.pad(out, more, constant_values=-1), np.pad(far, more, constant_values=np.inf)


class Seen:
    """Which nodes each of a batch's queries has met: marked with the number of the search, so nothing is cleared between two."""

    def __init__(self, nodes: int):
        self.marks, self.search = np.zeros((BATCH, nodes), np.uint16), 0

    def begin(self) -> None:
        self.search += 1
        if self.search > np.iinfo(np.uint16).max:
            self.marks[:], self.search = 0, 1

    def add(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        self.marks[rows, nodes] = self.search

    def fresh(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return self.marks[rows, nodes] != self.search


def _walk(x, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search in one layer for all queries in step; entry: starting nodes (rows x some).
    Returns nodes and squared distances, nearest first."""
    rows = len(q)
    seen.begin()
    nodes, dist = np.full((rows, ef), -1), np.full((rows, ef), np.inf)
    first = min(ef, entry.shape[1])
    nodes[:, :first] = entry[:, :first]
    dist[:, :first] = _distances(x, entry[:, :first], q)
    seen.add(np.arange(rows)[:, None], entry[:, :first])
    order = np.argsort(dist, axis=1)
    nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
    opened = np.zeros((rows, ef), bool)
    while True:
        waiting = ~opened & (nodes >= 0)
        at = np.flatnonzero(waiting.any(1))
        if not len(at):
            return nodes, dist
        slot = waiting[at].argmax(1)
        opened[at, slot] = True
        near = links[nodes[at, slot]]
        valid = near >= 0
        valid &= seen.fresh(at[:, None], near)
        r, c = np.nonzero(valid)
        seen.add(at[r], near[r, c])
        d = np.where(valid, _distances(x, near, q[at]), np.inf)
        all_nodes = np.concatenate([nodes[at], np.where(valid, near, -1)], 1)
        all_dist = np.concatenate([dist[at], d], 1)
        all_open = np.concatenate([opened[at], np.zeros_like(valid)], 1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :ef]
        nodes[at], dist[at] = np.take_along_axis(all_nodes, order, 1), np.take_along_axis(all_dist, order, 1)
        opened[at] = np.take_along_axis(all_open, order, 1)


def _link_back(x, links: np.ndarray, far: np.ndarray, new: np.ndarray, keep: int) -> None:
    """Enter the links of the nodes `new` at their other ends too; far holds each link's squared distance.

    A node whose places are all taken keeps a diverse choice of `keep` of its links so far and its nearest new ones, so a
    batch of near copies can't push out what leads elsewhere, and half as many places again are free before the next choice.
    """
    width = links.shape[1]
    src, dst, dist = np.repeat(new, width), links[new].ravel(), far[new].ravel()
    src, dst, dist = src[dst >= 0], dst[dst >= 0], dist[dst >= 0]
    both = np.flatnonzero(dst >= new[0])  # two new nodes may have chosen each other
    once = np.ones(len(dst), bool)
    once[both] = ~(links[dst[both]] == src[both][:, None]).any(1)
    src, dst, dist = src[once], dst[once], dist[once]
    order = np.lexsort((dist, dst))
    src, dst, dist = src[order], dst[order], dist[order]
    ends, start, count = np.unique(dst, return_index=True, return_counts=True)
    nth = np.arange(len(dst)) - np.repeat(start, count)
    have = (links[ends] >= 0).sum(1)
    over = have + count > width
    place = np.repeat(have, count) + nth
    fits = ~np.repeat(over, count)
    links[dst[fits], place[fits]], far[dst[fits], place[fits]] = src[fits], dist[fits]
    row = np.repeat(np.cumsum(over) - 1, count)
    for lo in range(0, int(over.sum()), 512):
        part = ends[np.flatnonzero(over)[lo:lo + 512]]
        nodes, away = np.full((len(part), width + keep), -1), np.full((len(part), width + keep), np.inf, np.float32)
        nodes[:, :width], away[:, :width] = links[part], np.where(links[part] >= 0, far[part], np.inf)
        mine = ~fits & (nth < keep) & (row >= lo) & (row < lo + 512)
        nodes[row[mine] - lo, width + nth[mine]], away[row[mine] - lo, width + nth[mine]] = src[mine], dist[mine]
        near = np.argsort(away, axis=1, kind="stable")
        nodes, away = np.take_along_axis(nodes, near, 1), np.take_along_axis(away, near, 1)
        links[part], far[part] = -1, np.inf
        links[part, :keep], far[part, :keep] = _diverse(x, part, nodes, away, keep)


def build(x: np.ndarray, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the nodes (by falling level, so layer l holds the first of them) and each layer's neighbours,
    lowest layer first."""
    n = len(x)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(M)).astype(int)
    order = np.argsort(-level, kind="stable")
    x = (x[order] - x.mean(0)).astype(np.float32)
    sizes = [int((level >= l).sum()) for l in range(level.max() + 1)]
    layers: list[np.ndarray] = [None] * len(sizes)
    seen = Seen(n)
    for l in reversed(range(len(sizes))):
        size, width = sizes[l], M if l else M0
        links = np.full((size, width + width // 2), -1)
        away = np.full(links.shape, np.inf, np.float32)
        at = 0
        while at < size:
            to = min(size, at + min(BATCH, max(32, at)))
            new = np.arange(at, to)
            q = x[new]
            exact = q.astype(np.float64)
            norms = (exact * exact).sum(1)
            inner = norms[:, None] + norms[None, :] - 2 * exact @ exact.T
            np.fill_diagonal(inner, np.inf)
            near = np.argsort(inner, axis=1)[:, :min(width, to - at)]
            cand, dist = near + at, np.take_along_axis(inner, near, 1)
            if at:
                entry = np.zeros((to - at, 1), int)
                for up in reversed(range(l + 1, len(sizes))):
                    if sizes[up] <= at:
                        entry = _walk(x, layers[up], q, entry, 2, seen)[0][:, :1]
                found, far = _walk(x, links, q, entry, EF_BUILD, seen)
                cand, dist = np.concatenate([found, cand], 1), np.concatenate([far, dist], 1)
            dist = np.where((cand < 0) | (cand == new[:, None]), np.inf, dist)
            cand = np.where(np.isinf(dist), -1, cand)
            best = np.argsort(dist, axis=1, kind="stable")[:, :2 * width]
            links[new, :width], away[new, :width] = _diverse(x, new, np.take_along_axis(cand, best, 1), np.take_along_axis(dist, best, 1), width)
            _link_back(x, links, away, new, width)
            at = to
        layers[l] = links
    return order, [a.astype(np.int32) for a in layers]


def search(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, ef: int) -> np.ndarray:
    """Nodes near each query (rows of at most ef, -1 where fewer), nearest first.  x in the order of build()."""
    center = x.mean(0)
    x32, q32 = (x - center).astype(np.float32), (q - center).astype(np.float32)
    out, seen = [], Seen(len(x))
    for lo in range(0, len(q), BATCH):
        part = q32[lo:lo + BATCH]
        entry = np.zeros((len(part), 1), int)
        for links in reversed(layers[1:]):
            entry = _walk(x32, links, part, entry, 4, seen)[0][:, :4]
            entry = np.where(entry < 0, entry[:, :1], entry)[:, :1]
        out.append(_walk(x32, layers[0], part, entry, ef, seen)[0])
    return np.concatenate(out)


INDEX = "shard int, dim int, vectors binary, members array<array<long>>, sizes array<int>, links array<binary>"


def _builder(k: int, seed: int):
    def index(key, pdf):
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        flat, own = np.unique(x, axis=0, return_inverse=True)  # equal vectors are one node
        own, ids = own.ravel(), pdf["id"].to_numpy()
        rank = np.lexsort((ids, own))
        groups = np.split(ids[rank], np.flatnonzero(np.diff(own[rank])) + 1)
        order, layers = build(flat, seed + int(key[0]))
        return pd.DataFrame([{"shard": key[0], "dim": x.shape[1], "vectors": flat[order].tobytes(),
                              "members": [groups[i][:k + 1] for i in order], "sizes": [len(a) for a in layers], "links": [a.tobytes() for a in layers]}])

    return index


def _searcher(k: int, ef: int):
    def look(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
                layers = [np.frombuffer(b, np.int32).reshape(s, -1).astype(np.int64) for b, s in zip(row.links, row.sizes)]
                q = np.stack([np.asarray(v, np.float64) for v in row.query_vecs])
                near = search(x, layers, q, max(ef, k + 1))
                out = []
                for qid, vec, nodes in zip(row.query_ids, q, near):
                    nodes = nodes[nodes >= 0]
                    far = np.sqrt(((x[nodes] - vec) ** 2).sum(1))
                    ids = [np.asarray(row.members[i], np.int64) for i in nodes]
                    far, ids = np.repeat(far, [len(i) for i in ids]), np.concatenate(ids)
                    best = np.lexsort((ids, far))
                    best = best[ids[best] != qid][:k]
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[best], "score": far[best]}))
                yield pd.concat(out)

    return look


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int | None = None, query_rows: int = QUERY_ROWS, ef: int = EF, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of df nearest to each query by Euclidean distance, found by the graphs.

    Nearest first, ties to the smaller id; a candidate with the query's own id is left out.  Fewer candidates: all of
    them.  Rows of df and queries whose id is null or whose vector is null, empty, zero or holds null or non-finite
    components take no part; vectors of unlike length are never compared.  A repeated query id is one query (the one
    that comes first).  Equal vectors of a shard are one node that carries its k + 1 smallest ids.  Empty input: none.
    """
    def points(d):
        d = d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return d.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec"))

    rows, asked = points(df), points(queries).dropDuplicates(["id"])
    counts = {r["dim"]: (r["n"], r["q"]) for r in
              rows.groupBy("dim").agg(F.count("*").alias("n"), F.lit(0).alias("q")).collect()}
    n, n_asked = sum(c[0] for c in counts.values()), asked.count()
    shard_rows = shard_rows or min(SHARD_ROWS_AT_MOST, max(SHARD_ROWS, math.isqrt(SHARD_ROWS * n)))
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_asked / query_rows))
    key = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int")
    index = written(rows.withColumn("shard", key).groupBy("shard", "dim").applyInPandas(_builder(k, seed), INDEX), "hnsw-index")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    packed = asked.groupBy("dim", block).agg(F.collect_list(F.struct("id", "vec")).alias("q"))
    packed = packed.select("dim", F.col("q.id").alias("query_ids"), F.col("q.vec").alias("query_vecs"),
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = packed.join(index, ["dim", "shard"]).mapInPandas(_searcher(k, ef), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
