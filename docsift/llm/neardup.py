"""Near-duplicate documents by SetSketch registers.

Every document's set of word shingles is hashed to 64 bits; a register holds the truncated
logarithm, base B, of the least of the set's exponential hash values, so registers of equal
sets are equal, a union's register is the larger one, and two sets' registers agree with a
probability that follows their similarity.

1. Documents with equal sets form a class; all further work is on classes.
2. Classes that agree in all registers of a band are candidates.  Of a band's bucket, first
   only the pairs with its smallest member are taken.
3. A pair's similarity is estimated from both sketches by maximum likelihood, given the sets'
   exact sizes; pairs far under the threshold go.
4. The others are confirmed on the full sets, which are made again from the texts: a pivot's
   set, then its partners' in a sorted stream, a bounded number of partners to a group.
5. In buckets whose members are not all connected by then, all other pairs are compared too, in
   blocks of members: first by sketches, which only mark the members that have a likely partner,
   then, for those, by the exact intersections of a block's sets.  A pair counts in the first
   bucket it shares.  So no pair of a bucket is left out, and what leaves a block is at most one
   link for each member, however many of its pairs are near the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, save_table, shingle_hashes, split_words, texts_of
from .components import components, roots

B = 1.1
BAND_ROWS, BANDS = 6, 32
REGISTERS = BAND_ROWS * BANDS
#: Estimates may miss the similarity by this much (over five standard errors at 0.8).
MARGIN = 0.15
#: Partners of a pivot in one sorted group; members of a block of a bucket; shingles of a block that
#: are counted at once.
GROUP, BLOCK, COLUMNS = 500, 500, 4096
#: Shingles of members whose intersections are counted together, about.
SHINGLES = 500_000

_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_RNG = np.random.default_rng(20)
_MULT = (_RNG.integers(0, 1 << 31, (REGISTERS, 1)) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, (REGISTERS, 1)).astype(np.uint32)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle."""
    w = WORDS.array(split_words(text.translate(_LOWER)))
    if not len(w):
        return w
    return np.unique(shingle_hashes(w, min(k, len(w))))


def sketch(s: np.ndarray) -> bytes:
    """Registers of a set that isn't empty."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), 4096):
        np.minimum(least, (low[i:i + 4096] * _MULT + _ADD).min(axis=1), out=least)
    e = -np.log1p(-(least + 0.5) / 2.0 ** 32)
    return np.clip(np.floor(-np.log(e) / np.log(B)) + 20, 0, 255).astype(np.uint8).tobytes()


def _features(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, high, low, sketches = [], [], [], []
        for text in texts_of(batch):
            s = shingle_set(text, k)
            n.append(len(s))
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            high.append((d >> 64) - (1 << 63))
            low.append((d & (1 << 64) - 1) - (1 << 63))
            sketches.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
             pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])


def _likelihood(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The log-likelihood of pairs of sketches (rows) with known set sizes, by similarity."""
    up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = x.shape[1] - up - down
    u, v = nx / (nx + ny), ny / (nx + ny)

    def of(j: np.ndarray) -> np.ndarray:
        p = -np.log1p(-np.maximum(u - v * j, 0) * (B - 1) / B) / np.log(B)
        q = -np.log1p(-np.maximum(v - u * j, 0) * (B - 1) / B) / np.log(B)
        tiny = 1e-12
        return up * np.log(p + tiny) + down * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, tiny))

    return of


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sketches (rows) with known set sizes."""
    loglikelihood = _likelihood(x, y, nx, ny)
    most = np.minimum(nx, ny) / np.maximum(nx, ny)
    low, high = np.zeros(len(nx)), most.astype(float)  # the likelihood has one maximum
    for _ in range(30):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        better = loglikelihood(a) < loglikelihood(b)
        low, high = np.where(better, a, low), np.where(better, high, b)
    return (low + high) / 2


def reaches(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate is at least ``least``, which no pair's size ratio may be under: the
    likelihood has one maximum, so up to the estimate it rises.  Holds for every such pair, and
    for some whose estimate is smaller by less than 0.001."""
    if least < 0.001:
        return np.ones(len(nx), bool)
    loglikelihood = _likelihood(x, y, nx, ny)
    return loglikelihood(np.full(len(nx), least)) >= loglikelihood(np.full(len(nx), least - 0.001))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), REGISTERS)


def _likely(frames: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        j = estimate(_matrix(pdf["sx"]), _matrix(pdf["sy"]), pdf["nx"].to_numpy(float), pdf["ny"].to_numpy(float))
        yield pdf.loc[j >= least, ["x", "y"]]


def _confirmed(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, the pivot's (part 0) before its partners'."""
    group, pivots = None, []
    for batch in batches:
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "text"}
        a, b = [], []
        for i, text in enumerate(texts_of(batch)):
            s = shingle_set(text, k)
            if (c["y"][i], c["salt"][i]) != group:
                group, pivots = (c["y"][i], c["salt"][i]), []
            if c["part"][i] == 0:
                pivots.append(s)
                continue
            for p in pivots:
                both = len(np.intersect1d(p, s, assume_unique=True))
                if both and 100 * both >= percent * (len(p) + len(s) - both):
                    a.append(c["x"][i])
                    b.append(c["y"][i])
                    break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough, as links a, b."""
    groups = pairs.groupBy(F.col("y").alias("g")).agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / GROUP)).cast("int")
    partners = pairs.join(groups, F.col("y") == F.col("g")).select("x", "y", salt.alias("salt"), F.lit(1).alias("part"))
    pivots = groups.select(F.col("g").alias("x"), F.col("g").alias("y"),
                           F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / GROUP).cast("int") - 1)).alias("salt"),
                           F.lit(0).alias("part"))
    # the texts are dealt by id at every size: what is wanted of them grows with them
    rows = (partners.unionByName(pivots).hint("merge").join(docs, F.col("x") == F.col("doc_id"))
            .select("y", "salt", "part", "x", "text")
            .repartition("y", "salt").sortWithinPartitions("y", "salt", "part"))
    return rows.mapInArrow(lambda b: _confirmed(b, k, percent), "a long, b long")


def _by_group(frames: Iterator[pd.DataFrame], keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``work`` on each group of rows that are sorted by ``keys``."""
    held: pd.DataFrame | None = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        tail = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1)
        held = pdf[tail]
        for _, group in pdf[~tail].groupby(keys, sort=False):
            yield work(group)
    if held is not None and len(held):
        yield work(held)


PLACE = ["key", "i", "j"]


def _marked(frames: Iterator[pd.DataFrame], least: float, percent: int) -> Iterator[pd.DataFrame]:
    """Members of a pair of blocks with a likely partner in another component."""
    def work(g: pd.DataFrame) -> pd.DataFrame:
        i, j, band = g["i"].iloc[0], g["j"].iloc[0], g["band"].iloc[0]
        left, right = g[g["block"] == i], g[g["block"] == j]
        marks = np.zeros(len(g), bool)
        at_left, at_right = np.flatnonzero(g["block"] == i), np.flatnonzero(g["block"] == j)
        if len(left) and len(right):
            n, comp, s, ids = right["n"].to_numpy(), right["component"].to_numpy(), _matrix(right["sketch"]), right["x"].to_numpy()
            for row, (x, c, nx, sk) in enumerate(zip(left["x"], left["component"], left["n"], left["sketch"])):
                ok = (comp != c) & (100 * np.minimum(n, nx) >= percent * np.maximum(n, nx))
                if i == j:
                    ok &= ids < x
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                mine = np.frombuffer(sk, np.uint8)
                same = s[at] == mine
                close = same.mean(axis=1) >= least - 0.1  # well under any estimate that counts
                at, same = at[close], same[close]
                first = same.reshape(-1, BANDS, BAND_ROWS).all(axis=2).argmax(axis=1) == band
                at = at[first]
                if len(at):
                    size = np.full(len(at), float(nx))
                    at = at[reaches(np.broadcast_to(mine, (len(at), REGISTERS)), s[at], size, n[at].astype(float), least)]
                if len(at):
                    marks[at_left[row]] = True
                    marks[at_right[at]] = True
        return g.loc[marks, [*PLACE, "block", "x", "component"]]

    yield from _by_group(frames, PLACE, work)


def _portions(members: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Members in runs of about SHINGLES shingles."""
    filled = np.cumsum([len(sets[n]) for n in members]) // SHINGLES
    return np.split(members, np.flatnonzero(np.diff(filled)) + 1) if len(members) else []


def _similar(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (place in x, place in y) that are similar enough, by the sizes of all intersections."""
    sets = [*x, *y]
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1  # a shingle of one member is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[rows[low:high], column[low:high] - start] = 1
        both += m[:len(x)] @ m[len(x):].T
    union = sizes[:len(x)][:, None] + sizes[len(x):][None] - both
    return np.nonzero((both > 0) & (100 * both >= percent * union))


def _linked(frames: Iterator[pd.DataFrame], k: int, percent: int) -> Iterator[pd.DataFrame]:
    """Links between components in a pair of blocks, by exact intersections; at most one a member."""
    def work(g: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set((t or "").encode(), k) for t in g["text"]]
        comp, ids = g["component"].to_numpy(), g["x"].to_numpy()
        left = np.flatnonzero(g["block"] == g["i"].iloc[0])
        right = np.flatnonzero(g["block"] == g["j"].iloc[0])
        a, b = [], []
        for x in _portions(left, sets):
            for y in _portions(right, sets):
                i, j = _similar([sets[n] for n in x], [sets[n] for n in y], percent)
                apart = comp[x[i]] != comp[y[j]]
                a.append(ids[x[i[apart]]])
                b.append(ids[y[j[apart]]])
        if not a:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        nodes, low = roots(np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": nodes, "b": low})[nodes != low]

    yield from _by_group(frames, PLACE, work)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text, ...).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Documents are linked if 100 x the
    intersection of their sets is at least ``percent`` x the union.  A text without words (or
    null) has an empty set and links with nothing; rows without a doc_id link with nothing,
    have no component and are kept; rows that share a doc_id are in one component.  An empty
    table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    features = save_table(source.mapInArrow(
        lambda b: _features(b, shingle), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"), "neardup-sets")
    classes = (features.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
               .groupBy("h1", "h2", "n_shingles")
               .agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch")))
    classes = save_table(classes, "neardup-classes")

    bands = save_table(classes.select("id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * BAND_ROWS + 1, F.lit(BAND_ROWS))))).alias("band", "key")),
        "neardup-bands")
    buckets = bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows"))
    shared = buckets.where(F.col("low") < F.col("high")).select(F.col("key").alias("k"), "low", "rows")
    members = save_table(bands.join(shared, F.col("key") == F.col("k")).select("key", "band", "id", "low", "rows"),
                         "neardup-members")

    least = percent / 100 - MARGIN
    x = classes.select(F.col("id").alias("x"), F.col("n_shingles").alias("nx"), F.col("sketch").alias("sx"))
    y = classes.select(F.col("id").alias("y"), F.col("n_shingles").alias("ny"), F.col("sketch").alias("sy"))
    star = members.where(F.col("id") != F.col("low")).select(F.col("id").alias("x"), F.col("low").alias("y")).distinct()
    sized = (star.join(x, "x").join(y, "y")
             .where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).select("x", "y", "nx", "ny", "sx", "sy"))
    likely = save_table(sized.mapInPandas(lambda it: _likely(it, least), "x long, y long").distinct(), "neardup-likely")
    links = save_table(confirm(likely, source, shingle, percent), "neardup-links")
    found = components(links, "neardup-components")

    # buckets that are not yet one component: the rest of their pairs
    placed = (members.join(found, F.col("id") == F.col("node"), "left")
              .select("key", "band", "id", "rows", F.coalesce("component", "id").alias("component")))
    mixed = (placed.groupBy(F.col("key").alias("k")).agg(F.min("component").alias("a"), F.max("component").alias("b"))
             .where(F.col("a") < F.col("b")).select("k"))
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    opened = (placed.join(mixed, F.col("key") == F.col("k")).select("key", "band", "id", "component", "rows", block.alias("block"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .join(classes.select(F.col("id").alias("x"), F.col("n_shingles").alias("n"), "sketch"), F.col("id") == F.col("x"))
              .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "band", "block", "x", "component", "n", "sketch")
              .repartition(*PLACE).sortWithinPartitions(*PLACE))
    marked = save_table(opened.mapInPandas(lambda it: _marked(it, least, percent),
                                           "key long, i int, j int, block int, x long, component long"), "neardup-marked")
    held = (source.join(marked.hint("merge"), F.col("doc_id") == F.col("x")).select(*PLACE, "block", "x", "component", "text")
            .repartition(*PLACE).sortWithinPartitions(*PLACE))
    second = held.mapInPandas(lambda it: _linked(it, shingle, percent), "a long, b long")
    found = components(save_table(links.unionByName(second), "neardup-links"), "neardup-components")

    named = (classes.join(found, F.col("id") == F.col("node"), "left")
             .select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "id").alias("component")))
    # an id with several sets: the smallest component of its rows
    out = (features.drop("sketch").join(named, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
