"""Connected components of links between integer ids, by alternating star contraction.

Each round links every id's neighbours to the smallest one (first the larger neighbours,
then the smaller ones), until every id points at its component's smallest id.  A round is
two grouped minima, combined on the map side, and two joins, so a centre that a third of
all ids link to is never one task's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save_table


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of the links and the smallest id each reaches through them."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[:len(a)], flat[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a batch as stars: at most one link for each id."""
    for pdf in frames:
        ids, root = roots(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
        yield pd.DataFrame({"a": ids, "b": root})[ids != root]


def _sum(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
    return r.n, r.s


def components(links: DataFrame, label: str) -> DataFrame:
    """``node, component`` for every id in ``links`` (columns a, b: long, not null)."""
    cur = links.mapInPandas(_local, "a long, b long").distinct()
    cur = save_table(cur, label)
    state = _sum(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = (both.join(low, F.col("a") == F.col("u")).where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (large.join(low, F.col("a") == F.col("u"))
                 .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where(F.col("a") != F.col("b")))
        cur = save_table(small.mapInPandas(_local, "a long, b long").distinct(), label)
        state, before = _sum(cur), state
        if state == before:
            break
    leaves = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
