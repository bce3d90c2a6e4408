"""Sharding by k-d tree partitioning: leaves of nearly equal bytes over metadata.

The tree's nodes are split at the distributed median, weighted by bytes, of the
metadata dimension that is widest in the node.  A median is found by descending
through the bits of a sort key: each pass sums bytes for at most 2**BITS bins of a
node (partial sums on the map side), so a pass collects a bounded number of rows,
whatever the table's size.  The key's low bits are a hash of the row, so that a value
that a third of all rows share is still split.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save_table

DIM_BITS, TIE_BITS, BITS = 20, 42, 11
#: A median may miss its share of the node's bytes by this much.
TOLERANCE = 0.0005
#: Rows whose slots one task numbers, about.
SLOT_ROWS = 50_000


def document_dimensions() -> dict[str, Column]:
    """The metadata dimensions of ``documents``, each in [0, 1]; nulls count as 0."""
    return {
        "d_size": F.log2(F.col("size")) / 40,
        "d_source": F.crc32("source") / F.lit(2.0 ** 32),
        "d_lang": F.crc32("lang") / F.lit(2.0 ** 32),
    }


def _key(dim: str) -> Column:
    """62 bits: the dimension's, then the row's hash."""
    d = F.least(F.greatest(F.floor(F.coalesce(F.col(dim), F.lit(0.0)) * (1 << DIM_BITS)), F.lit(0)),
                F.lit((1 << DIM_BITS) - 1)).cast("long")
    return F.shiftleft(d, TIE_BITS).bitwiseOR(F.col("tie"))


def _by_node(values: dict[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for n, c in values.items():
        out = F.when(F.col("node") == n, c).otherwise(out)
    return out


def _medians(keyed: DataFrame, targets: dict[int, tuple[float, float]]) -> dict[int, int]:
    """For each node (bytes wanted below, tolerance): the key to split at."""
    found: dict[int, int] = {}
    open_ = {n: (0, 0.0, DIM_BITS + TIE_BITS) for n in targets}  # prefix, bytes below it, bits left
    while open_:
        left = next(iter(open_.values()))[2]
        shift = max(0, left - BITS)
        inside = F.lit(False)
        for n, (prefix, _, _) in open_.items():
            inside = inside | ((F.col("node") == n) & (F.shiftright("key", left) == prefix))
        bins: dict[int, list] = {n: [] for n in open_}
        for r in (keyed.where(inside).groupBy("node", F.shiftright("key", shift).alias("bin"))
                  .agg(F.sum("size").alias("bytes")).collect()):
            bins[r.node].append((r.bin, r.bytes))
        following = {}
        for n, (_, below, _) in open_.items():
            want, tolerance = targets[n]
            for b, mass in sorted(bins[n]):
                if below + mass < want:
                    below += mass
                    continue
                if mass <= tolerance or shift == 0:  # the nearer edge of this bin
                    after = below + mass - want <= want - below
                    found[n] = (b + after) << shift
                else:
                    following[n] = (b, below, shift)
                break
            else:
                found[n] = (1 << (DIM_BITS + TIE_BITS)) - 1
        open_ = following
    return found


def kd_shards(docs: DataFrame, n_shards: int, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs`` (doc_id, text, ...).

    A null text counts as empty, a null dimension as 0; a null doc_id is kept.  Rows that
    are the same in id and text stay in one shard; equal texts under different ids may be
    split.  An empty table gives no rows.  Slots are gapless from 0 within a shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    dims = dimensions or document_dimensions()
    rows = (docs.withColumn("size", (F.octet_length(text) + 1).cast("long"))
            .select(F.col("doc_id").cast("long").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"),
                    *(c.cast("double").alias(n) for n, c in dims.items())))
    rows = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - TIE_BITS))
    rows = save_table(rows, "shard-meta")

    node, leaves, counted, level = F.lit(1), {1: n_shards}, 0, {1: n_shards}
    while any(k > 1 for k in level.values()):
        rows = rows.withColumn("node", node)
        wide = [F.struct((F.max(d) - F.min(d)).alias("w"), F.lit(-i).alias("i"), F.lit(d).alias("d"))
                for i, d in enumerate(dims)]
        stats = (rows.where(F.col("node").isin([n for n, k in level.items() if k > 1])).groupBy("node")
                 .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"),
                      (F.greatest(*wide) if len(wide) > 1 else wide[0]).alias("widest")).collect())
        counted = max(counted, sum(r.rows for r in stats))
        rows = save_table(rows.withColumn("key", _by_node({r.node: _key(r.widest.d) for r in stats},
                                                          F.lit(None).cast("long"))), "shard-level")
        at = _medians(rows, {r.node: (r.bytes * (level[r.node] // 2) / level[r.node], r.bytes * TOLERANCE)
                             for r in stats})
        level = {}
        for n in at:
            k = leaves.pop(n)
            level |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
        leaves |= level
        node = _by_node({n: 2 * n + (F.col("key") >= F.lit(v)).cast("int") for n, v in at.items()}, F.col("node"))
    ids = {n: i for i, n in enumerate(sorted(leaves, key=lambda n: bin(n)[3:]))}
    shard = F.lit(0)
    for n, i in ids.items():
        shard = F.when(F.col("node") == n, F.lit(i)).otherwise(shard)
    rows = rows.withColumn("node", node).withColumn("shard", shard.cast("int"))

    # slots: numbers within a part of a shard, after the rows of the shard's earlier parts
    parts = max(8, -(-counted // (SLOT_ROWS * n_shards)))
    rows = rows.withColumn("part", F.pmod(F.col("tie"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
               .select(F.col("shard").alias("o_shard"), F.col("part").alias("o_part"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "part").orderBy("tie", "doc_id", "text_crc32")
    return (rows.withColumn("number", F.row_number().over(inside) - 1)
            .join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("part") == F.col("o_part")))
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number")).alias("slot")))
