"""Substring dedup by level-wise doubling.

A window (consecutive words of one document) that starts in two documents holds shorter
windows that do, so lengths are doubled level by level: only windows whose part repeated at
one length are extended to twice that length, up to the wanted one.  On the levels before
the last, a window is stood for by its minimizer (the least hash of the shorter windows in
it), which equal windows share; that is a fraction of all positions.

Texts are held in chunks, compressed rows of a written table.  On each level a chunk sends
its distinct fingerprints, sorted and delta-coded, one block to each bucket of fingerprints;
the bucket answers with one bit for each.  The chunk makes the same list again and reads the
bits.  A fingerprint thus crosses the network once a chunk, however many copies there are,
and no task gathers the copies of a passage.

Fingerprints are 64 bits of strong word hashes; on the earlier levels a collision costs only
time, on the last one, two different windows agree with probability 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import WORDS, shingle_hashes, split_words, texts_of

#: Bytes of text in a chunk, about (a longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20
#: Words for each bucket of fingerprints, about.
BUCKET_WORDS = 1 << 20
#: Leading bits of a fingerprint that are sent on the levels before the last.
SHORT_BITS = 40

CHUNK = "chunk string, n_words long, blob binary"
BLOCK = "bucket long, chunk string, block binary"
_SPACE = re.compile(rb"([\x20\x09-\x0D]+)")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(part: pa.RecordBatch, words: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as w:
            w.write_batch(part)
        blob = zstandard.compress(sink.getvalue().to_pybytes(), 3)
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.UUID(bytes=os.urandom(16)).hex]), pa.array([words], pa.int64()), pa.array([blob], pa.binary())],
            names=["chunk", "n_words", "blob"])

    for batch in batches:
        start, held, words = 0, 0, 0
        for i, text in enumerate(texts_of(batch)):
            if held and held + len(text) > CHUNK_BYTES:
                yield row(batch.slice(start, i - start), words)
                start, held, words = i, 0, 0
            held += len(text)
            words += len(split_words(text))
        if batch.num_rows > start:
            yield row(batch.slice(start), words)


def _rows(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().stream_reader(blob).read()) as r:
        return r.read_next_batch()




class _Chunk:
    """The words of a chunk's documents in ascending order of doc_id, ids that are null last."""

    def __init__(self, blob: bytes):
        self.batch = _rows(blob)
        ids = self.batch.column(self.batch.schema.get_field_index("doc_id"))
        known = np.array(ids.is_valid())
        values = np.array(ids.fill_null(0), np.int64)
        self.order = np.lexsort((values, ~known))
        self.texts = list(texts_of(self.batch))
        words = [WORDS.array(split_words(self.texts[i])) for i in self.order]
        sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(words)), sizes)  # a word's document, in that order
        self.ids = values[self.order]
        self.known = known[self.order]

    def valid(self, length: int) -> np.ndarray:
        """Whether a window of this length starts at each word, within a document with an id."""
        n = len(self.words) - length + 1
        if n <= 0:
            return np.zeros(0, bool)
        return (self.doc[:n] == self.doc[length - 1:]) & self.known[self.doc[:n]]

    def minimizers(self, length: int, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of ``longer`` words, and the least hash of the windows of
        ``length`` words in each."""
        at = np.flatnonzero(self.valid(longer))
        if not len(at):  # too few words, maybe, for the minima below
            return at, np.empty(0, np.uint64)
        m = shingle_hashes(self.words, length)
        span, have = longer - length + 1, 1
        while have < span:
            step = min(have, span - have)
            m = np.minimum(m[:len(m) - step], m[step:])
            have += step
        return at, m[at] >> np.uint64(64 - SHORT_BITS) << np.uint64(64 - SHORT_BITS)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.valid(length))
        return at, shingle_hashes(self.words, length)[at]


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each key's place among them, and its first and last document."""
    order = np.argsort(keys, kind="stable")  # positions ascend, so documents do
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    ends = np.concatenate([starts[1:], [len(k)]]) - 1 if len(k) else starts
    return k[starts], place, docs[order[starts]], docs[order[ends]]


def _planes(a: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that leading zeros cost nothing."""
    return zstandard.compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unplanes(b: bytes) -> np.ndarray:
    a = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(a.reshape(8, -1).T).view("<u8").ravel()


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range starts in sorted keys (and the end)."""
    b = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(b, np.arange(buckets + 1))


def _blocks(chunk: str, keys: np.ndarray, ids: np.ndarray | None, buckets: int) -> pd.DataFrame:
    """One block for each bucket that has keys: the keys' differences, and ids if given."""
    at, rows = _bounds(keys, buckets), []
    low = np.uint64(0) if ids is None or not len(ids) else ids.view(np.uint64)[ids.argmin()]
    least = b"" if ids is None else int(low).to_bytes(8, "little")
    for b in np.flatnonzero(np.diff(at)):
        k = keys[at[b]:at[b + 1]]
        one = _planes(np.diff(k, prepend=np.uint64(0)))
        two = b"" if ids is None else _planes(ids[at[b]:at[b + 1]].view(np.uint64) - low)
        rows.append((int(b), chunk, len(one).to_bytes(4, "little") + one + least + two))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "block"])


def _answers(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    """For each block of a bucket, one bit a key: on the last level, whether a smaller
    document of another chunk has it; before, whether another chunk has it at all."""
    keys, ids = [], []
    for block in pdf["block"]:
        n = int.from_bytes(block[:4], "little")
        keys.append(np.cumsum(_unplanes(block[4:4 + n]), dtype=np.uint64))
        if last:
            low = np.uint64(int.from_bytes(block[4 + n:12 + n], "little"))
            ids.append((_unplanes(block[12 + n:]) + low).view(np.int64))
    sizes = np.array([len(k) for k in keys])
    key = np.concatenate(keys)
    value = np.concatenate(ids) if last else np.zeros(len(key), np.int64)
    order = np.lexsort((value, key)) if last else np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(new) - 1
    bit = np.empty(len(k), bool)
    bit[order] = value[order] > value[order][new][group] if last else np.bincount(group)[group] > 1
    out, at = [], 0
    for bucket, chunk, n in zip(pdf["bucket"], pdf["chunk"], sizes):
        if bit[at:at + n].any():
            out.append((bucket, chunk, np.packbits(bit[at:at + n]).tobytes()))
        at += n
    return pd.DataFrame(out, columns=["bucket", "chunk", "block"])


def _early_answers(pdf: pd.DataFrame) -> pd.DataFrame:
    return _answers(pdf, False)


def _last_answers(pdf: pd.DataFrame) -> pd.DataFrame:
    return _answers(pdf, True)


def _bits(answers: pd.DataFrame, keys: np.ndarray, buckets: int) -> np.ndarray:
    at, out = _bounds(keys, buckets), np.zeros(len(keys), bool)
    for b, block in zip(answers["bucket"], answers["block"]):
        n = at[b + 1] - at[b]
        out[at[b]:at[b + 1]] = np.unpackbits(np.frombuffer(block, np.uint8), count=n).astype(bool)
    return out


def levels_from(start: int, window: int) -> list[int]:
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class _Level:
    """What a chunk knows of its windows after the answers of the levels before ``k``."""

    def __init__(self, blob: bytes, levels: list[int], k: int, answers: pd.DataFrame | None, buckets: int):
        self.chunk = c = _Chunk(blob)
        asked = answers.groupby("level") if answers is not None and len(answers) else None
        none = pd.DataFrame({"bucket": [], "block": []})
        self.alive = np.ones(len(c.words), bool)  # by a window's start
        for j in range(k):
            at, m = c.minimizers(levels[j], levels[j + 1])
            at, m = at[self.alive[at]], m[self.alive[at]]
            keys, place, first, final = _distinct(m, c.doc[at])
            got = asked.get_group(j) if asked is not None and j in asked.groups else none
            repeated = (first != final) | _bits(got, keys, buckets)
            self.alive = np.zeros(len(c.words), bool)
            self.alive[at[repeated[place]]] = True
        last = k == len(levels) - 1
        at, m = c.windows(levels[k]) if last else c.minimizers(levels[k], levels[k + 1])
        self.at, m = at[self.alive[at]], m[self.alive[at]]
        self.keys, self.place, self.first, self.final = _distinct(m, c.doc[self.at])
        self.ids = c.ids[self.first] if last else None


def _removed(level: _Level, answers: pd.DataFrame, window: int, buckets: int) -> np.ndarray:
    """Whether each word of the chunk is covered by a window that a smaller document has."""
    c = level.chunk
    smaller = _bits(answers, level.keys, buckets)[level.place]
    smaller |= c.ids[c.doc[level.at]] > level.ids[level.place]
    at = level.at[smaller]
    edge = np.zeros(len(c.words) + 1, np.int64)
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept_text(text: bytes, gone: np.ndarray) -> bytes:
    """The text without its removed words and the white space after each."""
    if not gone.any():
        return text
    parts = _SPACE.split(text)
    lead = 0 if parts[0] else 2  # white space before the first word
    out, words = parts[:lead], parts[lead:]
    for i, g in enumerate(gone):
        if not g:
            out += words[2 * i:2 * i + 2]
    return b"".join(out)


def _finish(level: _Level, gone: np.ndarray, digest: bool) -> pa.Table:
    c, n = level.chunk, level.chunk.batch.num_rows
    total, removed, value = [0] * n, [0] * n, [b""] * n
    for j, i in enumerate(c.order.tolist()):
        mask = gone[c.first[j]:c.first[j + 1]]
        total[i], removed[i] = len(mask), int(mask.sum())
        if digest:
            words = split_words(c.texts[i])
            kept = [w for w, g in zip(words, mask.tolist()) if not g] if removed[i] else words
            value[i] = hashlib.sha256(b" ".join(kept)).hexdigest()
        else:
            value[i] = _kept_text(c.texts[i], mask)
    out = pa.Table.from_batches([c.batch])
    if digest:
        out = out.select(["doc_id"]).append_column("kept_sha256", pa.array(value, pa.string()))
    else:
        at = out.schema.get_field_index("text")
        text = pa.array([v.decode() for v in value], pa.string())
        nulls = c.batch.column(at).is_null()
        out = out.set_column(at, "text", pa.compute.if_else(nulls, pa.scalar(None, pa.string()), text))
    return out.append_column("n_words", pa.array(total, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))


def _work(levels: list[int], k: int, buckets: int) -> Callable:
    """For cogroup: a chunk and the answers of earlier levels -> blocks of level k."""
    last = k == len(levels) - 1

    def run(key: tuple, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, blob in zip(chunks["chunk"], chunks["blob"]):
            level = _Level(blob, levels, k, answers, buckets)
            out.append(_blocks(chunk, level.keys, level.ids if last else None, buckets))
        return pd.concat(out) if out else pd.DataFrame({"bucket": [], "chunk": [], "block": []})
    return run


def _end(levels: list[int], buckets: int, digest: bool, names: list[str]) -> Callable:
    k = len(levels) - 1

    def run(key: tuple, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out, answered = [], answers.to_pandas()
        for blob in chunks.column("blob").to_pylist():
            level = _Level(blob, levels, k, answered[answered["level"] < k], buckets)
            gone = _removed(level, answered[answered["level"] == k], levels[-1], buckets)
            out.append(_finish(level, gone, digest))
        return pa.concat_tables(out).select(names) if out else pa.table({n: [] for n in names})
    return run


def remove_repeats(docs: DataFrame, window: int = 13, start: int = 7, digest: bool = False) -> DataFrame:
    """Remove each word covered by a ``window`` that also starts in a document of smaller doc_id.

    Returns the columns of ``docs`` with ``text`` cut, plus ``n_words`` and ``n_removed``; with
    ``digest`` instead ``doc_id, n_words, n_removed, kept_sha256`` (the kept words joined by one
    space).  Windows are judged on the input.  A null text has no words and stays null; a
    document without an id neither loses words nor makes others lose any; rows that share an id
    don't make each other lose any.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text") if digest else docs.drop("n_words", "n_removed")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/docsift-repeats-{uuid.uuid4().hex}"
    (docs.mapInArrow(_chunks, CHUNK).write.option("compression", "none")
     .option("parquet.block.size", 16 << 20).parquet(path))
    table = spark.read.schema(CHUNK).parquet(path)
    words = table.agg(F.sum("n_words")).first()[0] or 0
    chunks = table.select("chunk", "blob")
    levels, buckets = levels_from(start, window), max(1, words // BUCKET_WORDS)

    answers = spark.createDataFrame([], "level int, " + BLOCK)
    for k in range(len(levels)):
        last = k == len(levels) - 1
        blocks = (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
                  .applyInPandas(_work(levels, k, buckets), BLOCK))
        found = blocks.groupBy("bucket").applyInPandas(_last_answers if last else _early_answers, BLOCK)
        answers = answers.unionByName(found.withColumn("level", F.lit(k)))
    if digest:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    else:
        names = [*docs.columns, "n_words", "n_removed"]
        schema = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).schema
    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(_end(levels, buckets, digest, names), schema))
