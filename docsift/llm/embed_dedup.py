"""Near-duplicate embeddings by quantised tile products.

Equal vectors form a class with a count, and classes are dealt to tiles.  A pair of tiles is
multiplied as 8-bit integers: each unit vector u is q / s + e, with its own scale s and the
exact length of its error e, so |u.w - (q_u.q_w) / (s_u s_w)| <= |e_u| + |e_w| + |e_u||e_w|.
Only pairs that the bound doesn't rule out are computed again in double precision.  A pair of
tiles returns, for each class, how many vectors it links to and the smallest id it reaches:
never the links themselves, which grow with the square of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save_table
from .components import components, roots
from .vectors import matrix, normalised, usable

#: Classes of a tile (about), rows of a tile that are multiplied at once, pairs computed again at once.
TILE, ROWS, PAIRS = 4096, 512, 1 << 16
#: Added to the error bounds for the rounding of doubles.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers, scales, and lengths of the errors of unit vectors (rows)."""
    scale = 127.0 / np.abs(unit).max(axis=1)
    q = np.rint(unit * scale[:, None])
    error = np.sqrt(((unit - q / scale[:, None]) ** 2).sum(axis=1)) + SLACK
    return q.astype(np.int8), scale, error


def _tile(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    ids = table.column("id").to_numpy()
    many = table.column("rows").to_numpy()
    side = table.column("tile").to_numpy()
    x = matrix(table.column("vector"))
    norm = np.sqrt((x * x).sum(axis=1))
    q, scale, error = quantise(x / norm[:, None])
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers add up without rounding
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    links = np.zeros(len(ids), np.int64)
    star_a, star_b = np.empty(0, np.int64), np.empty(0, np.int64)
    qr = q[right].astype(exact).T
    worst = error[right].max() if len(right) else 0.0
    for start in range(0, len(left), ROWS):
        rows = left[start:start + ROWS]
        product = q[rows].astype(exact) @ qr
        e = error[rows]
        least = ((threshold - e - worst - e * worst) * scale[rows]).astype(exact)
        a, b = np.nonzero(product >= least[:, None] * (scale[right] * (1 - 1e-6)).astype(exact) if len(right) else product > 0)
        a, b = rows[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), PAIRS):
            u, w = a[k:k + PAIRS], b[k:k + PAIRS]
            cosine = np.einsum("ij,ij->i", x[u], x[w]) / (norm[u] * norm[w])
            u, w = u[cosine >= threshold], w[cosine >= threshold]
            np.add.at(links, u, many[w])
            np.add.at(links, w, many[u])
            nodes, low = roots(np.concatenate([star_a, ids[u]]), np.concatenate([star_b, ids[w]]))
            star_a, star_b = nodes, low
    linked = np.flatnonzero(links)
    low = dict(zip(star_a.tolist(), star_b.tolist()))
    return pa.table({"id": pa.array(ids[linked], pa.int64()), "class": table.column("class").take(pa.array(linked)),
                     "links": pa.array(links[linked], pa.int64()),
                     "low": pa.array([low[v] for v in ids[linked].tolist()], pa.int64())})


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id",
                         vector_column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Rows are linked if their cosine in double precision is at least ``threshold``.  Vectors that
    are null, empty, zero or hold a null or non-finite component link with nothing, as do vectors
    of different lengths; such a row is its own component.  Equal rows link with each other.
    Rows without an id link with nothing, have no component and are kept; rows that share an id
    are one node.  An empty table gives no rows.
    """
    rows = normalised(vectors, id_column, vector_column)
    usable_rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    classes = save_table(usable_rows.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
                         .withColumn("class", F.sha2(F.to_json(F.struct("vector")), 256))
                         .withColumn("dim", F.size("vector")), "embed-classes")
    tiles = -(-classes.count() // TILE) or 1
    dealt = (classes.withColumn("tile", F.pmod(F.xxhash64("class"), F.lit(tiles)).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
             .select("dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                     "tile", "id", "class", "rows", "vector"))
    found = save_table(dealt.groupBy("dim", "i", "j").applyInArrow(
        lambda key, table: _tile(key, table, threshold), "id long, class string, links long, low long"), "embed-found")
    reach = components(found.where(F.col("id") != F.col("low")).select(F.col("id").alias("a"), F.col("low").alias("b"))
                       .distinct(), "embed-components")
    counts = found.groupBy(F.col("class").alias("f_class")).agg(F.sum("links").alias("links"))
    known = (classes.join(counts, F.col("class") == F.col("f_class"), "left")
             .join(reach, F.col("id") == F.col("node"), "left")
             .select(F.col("vector").alias("c_vector"),
                     (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "id").alias("c_component")))
    key = F.when(F.col("id").isNotNull() & usable(F.col("vector")), F.col("vector"))
    out = (rows.withColumn("key", key).join(known, F.col("key") == F.col("c_vector"), "left")
           .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                   F.coalesce("c_component", "id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
