"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards.  A shard's graph is built in one task and kept as rows
of a written table: a node's vector and its flat neighbour arrays.  Nodes are numbered from
the highest level down, so layer l holds the first nodes and its neighbours are one matrix.
Building and searching work on batches: the beams of many queries advance together in numpy.
Every block of queries meets every shard's graph; the shards' results are merged by distance.

Of a vector that many rows share, a query can use only the k + 1 smallest ids, so a node
carries those; the limit is applied before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save_table
from .vectors import matrix, normalised, usable

#: Nodes of a shard (about), neighbours on upper layers (twice as many on layer 0), beam widths.
SHARD, M, EF_BUILD, EF_SEARCH = 6000, 14, 48, 96
#: Nodes that are inserted together at most; queries of a block.
BATCH, QUERIES = 256, 2048
#: Beam members that are expanded at once.
WIDTH = 4


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from each query (row of q) to its nodes (row of ids)."""
    d = x[ids] - q[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def search_layer(x: np.ndarray, links: np.ndarray, q: np.ndarray, starts: np.ndarray, ef: int,
                 size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes found for each query among the first ``size`` nodes of a layer
    (-1 and infinity where there are fewer), nearest first.  ``starts`` may hold -1."""
    n = len(q)
    r = np.arange(n)[:, None]
    seen = np.zeros((n, size + 1), bool)  # the last column takes the places of -1
    seen[:, -1] = True
    ids = np.where(starts < size, starts, -1)
    seen[r, ids] = True
    dist = np.where(ids >= 0, _distances(x, ids, q), np.inf)
    pad = max(0, ef - ids.shape[1])
    ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
    dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
    done = ids < 0
    while True:
        order = np.argsort(dist, axis=1, kind="stable")[:, :ef]
        ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))
        pick = np.argsort(done, axis=1, kind="stable")[:, :WIDTH]  # the nearest that aren't expanded
        fresh = ~np.take_along_axis(done, pick, 1)
        live = np.flatnonzero(fresh.any(axis=1))
        if not len(live):
            return ids, dist
        nodes = np.where(fresh, np.take_along_axis(ids, pick, 1), -1)[live]
        np.put_along_axis(done, pick, True, 1)
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
        near = np.where(near < size, near, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        width = (near >= 0).sum(axis=1).max(initial=0)
        if not width:
            continue
        near = -np.sort(-near, axis=1)[:, :width]
        new = np.full((n, width), -1, ids.dtype)
        far = np.full((n, width), np.inf)
        new[live] = near
        far[live] = np.where(near >= 0, _distances(x, near, q[live]), np.inf)
        ids, dist = np.concatenate([ids, new], 1), np.concatenate([dist, far], 1)
        done = np.concatenate([done, new < 0], 1)


def select(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` diverse neighbours of each row: a candidate that is nearer to a chosen one
    than to the row waits, and fills a place that stays free.  Candidates ascend by distance."""
    n, c = ids.shape
    vectors = x[ids]
    chosen = np.zeros((n, c), bool)
    waits = np.zeros((n, c), bool)
    for k in range(c):
        ok = (ids[:, k] >= 0) & ~waits[:, k] & (chosen.sum(axis=1) < most)
        if not ok.any():
            continue
        chosen[ok, k] = True
        d = vectors[ok] - vectors[ok, k][:, None, :]
        waits[ok] |= np.einsum("ijk,ijk->ij", d, d) < dist[ok]
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(ids >= 0, ids, -1), order, 1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def _by_distance(ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def build(x: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Layer sizes and neighbour matrices (layer 0 first) of the nodes x, whose rows are in
    random order; levels are dealt so that the first nodes are the highest."""
    n = len(x)
    x = x.astype(np.float32)
    sizes = [n]
    while sizes[-1] > M:
        sizes.append(-(-sizes[-1] // M))
    width = [2 * M if layer == 0 else M for layer in range(len(sizes))]
    links = [np.full((s, w), -1, np.int32) for s, w in zip(sizes, width)]
    at = 1
    while at < n:
        end = min(n, at + min(BATCH, at))
        q = x[at:end]
        starts = np.zeros((len(q), 1), np.int64)
        within = np.einsum("ijk,ijk->ij", d := q[:, None, :] - q[None, :, :], d)
        np.fill_diagonal(within, np.inf)
        for layer in range(len(sizes) - 1, -1, -1):
            inserted = max(0, min(end, sizes[layer]) - at)
            ids, dist = search_layer(x, links[layer], q, starts, EF_BUILD if inserted else 8, min(at, sizes[layer]))
            starts = ids[:, :8].astype(np.int64)
            if not inserted:
                continue
            mates = np.argsort(within[:inserted, :inserted], axis=1)[:, :EF_BUILD]
            ids, dist = _by_distance(np.concatenate([ids[:inserted], mates + at], 1),
                                     np.concatenate([dist[:inserted], np.take_along_axis(within[:inserted, :inserted], mates, 1)], 1))
            ids = np.where(np.isfinite(dist), ids, -1)
            keep = select(x, ids[:, :EF_BUILD], dist[:, :EF_BUILD], M)
            links[layer][at:at + inserted, :M] = keep
            # the other direction: each neighbour chooses among what it has and who chose it
            node = np.repeat(np.arange(at, at + inserted), M)
            to = keep.ravel()
            node, to = node[to >= 0], to[to >= 0]
            order = np.argsort(to, kind="stable")
            node, to = node[order], to[order]
            heads, first, count = np.unique(to, return_index=True, return_counts=True)
            place = np.arange(len(to)) - np.repeat(first, count)
            fresh = np.full((len(heads), count.max()), -1, np.int64)
            fresh[np.repeat(np.arange(len(heads)), count), place] = node
            both = np.concatenate([links[layer][heads], fresh], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            dist = np.where(both >= 0, _distances(x, both, x[heads]), np.inf)
            both, dist = _by_distance(both, dist)
            full = (both >= 0).sum(axis=1) > width[layer]
            links[layer][heads] = np.pad(both, ((0, 0), (0, max(0, width[layer] - both.shape[1]))), constant_values=-1)[:, :width[layer]]
            if full.any():
                links[layer][heads[full]] = select(x, both[full][:, :2 * width[layer]], dist[full][:, :2 * width[layer]], width[layer])
        at = end
    return sizes, links


def nearest(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, ef: int) -> np.ndarray:
    """Node numbers near each query, -1 where there are fewer."""
    starts = np.zeros((len(q), 1), np.int64)
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    for layer in range(len(links) - 1, -1, -1):
        ids, _ = search_layer(x32, links[layer], q32, starts, ef if layer == 0 else 8, len(links[layer]))
        starts = ids[:, :8].astype(np.int64)
    return ids


INDEX = "dim int, shard int, node int, ids array<long>, vector array<double>, links array<array<int>>"


def _index(key: tuple, table: pa.Table) -> pa.Table:
    dim, shard = (k.as_py() for k in key)
    table = table.take(pa.array(np.argsort(table.column("draw").to_numpy(), kind="stable")))
    _, links = build(matrix(table.column("vector")))
    n = table.num_rows
    own = [[layer[i][layer[i] >= 0].tolist() for layer in links if i < len(layer)] for i in range(n)]
    return pa.table({"dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()),
                     "node": pa.array(range(n), pa.int32()), "ids": table.column("ids"),
                     "vector": table.column("vector"), "links": pa.array(own, pa.list_(pa.list_(pa.int32())))})


def _search(nodes: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if nodes.num_rows and queries.num_rows:
        nodes = nodes.sort_by("node")
        x, q = matrix(nodes.column("vector")), matrix(queries.column("vector"))
        own = nodes.column("links").to_pylist()
        links = []
        for layer in range(len(own[0])):
            rows = [o[layer] for o in own if layer < len(o)]
            m = np.full((len(rows), max(1, max(map(len, rows)))), -1, np.int32)
            for i, r in enumerate(rows):
                m[i, :len(r)] = r
            links.append(m)
        ids = nodes.column("ids").to_pylist()
        found = np.concatenate([nearest(x, links, q[i:i + BATCH], max(EF_SEARCH, 2 * k)) for i in range(0, len(q), BATCH)])
        for query_id, v, near in zip(queries.column("id").to_pylist(), q, found):
            near = near[near >= 0]
            score = np.sqrt(((x[near] - v) ** 2).sum(axis=1))
            pairs = sorted((s, i) for s, node in zip(score.tolist(), near.tolist()) for i in ids[node] if i != query_id)[:k]
            out["query_id"] += [query_id] * len(pairs)
            out["score"] += [p[0] for p in pairs]
            out["vec_id"] += [p[1] for p in pairs]
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                     "score": pa.array(out["score"], pa.float64())})


def index(vectors: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The written index of every usable row: one row for each distinct vector."""
    rows = normalised(vectors, id_column, vector_column)
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    first = Window.partitionBy("vector").orderBy("id")
    classes = save_table(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
                         .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "hnsw-classes")
    shards = -(-classes.count() // SHARD) or 1
    draw = F.xxhash64("vector")
    dealt = classes.select(F.size("vector").alias("dim"), F.pmod(draw, F.lit(shards)).cast("int").alias("shard"),
                           F.xxhash64(draw).alias("draw"), "ids", "vector")
    return save_table(dealt.groupBy("dim", "shard").applyInArrow(_index, INDEX), "hnsw-index")


def search(nodes: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query.

    The score is the Euclidean distance in double precision; ties go to the smaller id; a row
    with the query's id is no candidate.  Rows and queries that are null, empty or zero, hold a
    null or non-finite component or have no id take no part; vectors meet only vectors of their
    length.  Of queries that share an id, the smallest vector counts.  A query with fewer
    candidates has fewer rows, and empty tables give none.
    """
    asked = normalised(queries, id_column, vector_column)
    asked = save_table(asked.where(F.col("id").isNotNull() & usable(F.col("vector")))
                       .groupBy("id").agg(F.min("vector").alias("vector")), "hnsw-queries")
    blocks = -(-asked.count() // QUERIES) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    shards = nodes.select(F.col("dim").alias("s_dim"), F.col("shard").alias("s_shard")).distinct()
    asked = (asked.withColumn("dim", F.size("vector")).join(shards, F.col("dim") == F.col("s_dim"))
             .select(F.col("s_dim").alias("q_dim"), F.col("s_shard").alias("q_shard"), block.alias("q_block"), "id", "vector"))
    nodes = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (nodes.groupBy("dim", "shard", "block").cogroup(asked.groupBy("q_dim", "q_shard", "q_block"))
             .applyInArrow(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
