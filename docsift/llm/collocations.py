"""Phrase collocations by counting quotient filters.

Texts are cut into pieces and words, in shards of one language.  Phrases are counted order by
order, and only such as can be frequent: those whose first and last n-1 words both are.

* Order 1: a shard sends its distinct words with their counts, a block for each range of word
  hashes; the frequent ones get dense ids, and every shard gets back those of its own words.
* Order n: a phrase is packed as the id of its first n-1 words and the id of its last word, in
  as many bits as these ids need.  A shard counts its phrases in a counting quotient filter
  (``quotient``), sends one block for each range of permuted keys, and gets back the ids of the
  frequent ones.  A range's blocks, one a shard, are merged sorted; its frequent keys are
  numbered, after those of the ranges before.

No dictionary is sent to all tasks: a shard gets what it holds itself, and a phrase, however
frequent, is one key a shard.  Blocks of a shard are as many as ranges hold its keys, so shards
and ranges should grow together with a very large corpus (``SHARD_BYTES``, ``RANGE_WORDS``).

Scores are joins of the frequent phrases by ids: a phrase's tail is the phrase whose head is the
tail of its head.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, save_table, texts_of
from .quotient import merge, pack, permute, unpack, unpermute

#: Bytes of text in a shard, about, and words for each range of keys, about.
SHARD_BYTES, RANGE_WORDS = 16 << 20, 4 << 20

_BREAK = b".,;:!?\x0a\x0b\x0c\x0d"
#: Lower case; every end of a piece is a line end, every end of a word a space.
_TABLE = bytes(0x0A if b in _BREAK else 0x20 if b == 9 else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))

SHARD = "shard string, lang string, n_words long, vocabulary array<string>, counts array<long>, tokens binary"
STEP = "shard string, lang string, bucket int, block binary, state binary"
WORDS = "bucket int, shard string, lang string, words array<string>, counts array<long>, places array<int>"
FOUND = "bucket int, shard string, block binary, n long, words array<struct<lang: string, word: string, f: long>>"
MERGED = "bucket int, shard string, block binary, n long"


class _Words(dict):
    """Words to numbers in order of appearance; an empty word is -2, the end of a piece -1."""

    def __init__(self):
        super().__init__({b"": -2, b"\n": -1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 2
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        found = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return found[found > -2]


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of 32- or 64-bit integers of one length, byte plane by byte plane."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.compress(b"".join(planes), 1)


def _unblob(blob: bytes, *types: str) -> list[np.ndarray]:
    body = np.frombuffer(zstandard.decompress(blob), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, at, out = len(body) // sum(widths), 0, []
    for t, w in zip(types, widths):
        out.append(np.ascontiguousarray(body[at:at + w * n].reshape(w, n).T).view(t).ravel())
        at += w * n
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a partition's texts (lang, text), one language each."""
    held: dict[str, tuple[_Words, list[np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (words, parts) in held.items():
            tokens = np.concatenate(parts)
            counts = np.bincount(tokens[tokens >= 0], minlength=len(words) - 2)
            vocabulary = [w.decode() for w in words if words[w] >= 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.UUID(bytes=os.urandom(16)).hex]), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()),
                 pa.array([vocabulary], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())),
                 pa.array([_blob(tokens)], pa.binary())],
                names=["shard", "lang", "n_words", "vocabulary", "counts", "tokens"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
            words, parts = held.setdefault(lang, (_Words(), []))
            parts.append(words.numbers(text))
            size += len(text)
            if size >= SHARD_BYTES:
                yield from flush()
                size = 0
    yield from flush()


def _word_blocks(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """A shard's words by ranges of their hashes."""
    for batch in batches:
        for shard, lang, words, counts in zip(*(batch.column(c) for c in ("shard", "lang", "vocabulary", "counts"))):
            words, counts = words.values, counts.values
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in words), np.uint64, len(words))
            bucket = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(ranges + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                at = pa.array(order[cut[b]:cut[b + 1]], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([shard.as_py()]), pa.array([lang.as_py()])]
                    + [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), v) for v in (words.take(at), counts.take(at), at)],
                    names=["bucket", "shard", "lang", "words", "counts", "places"])


def _merged_words(least: int) -> Callable:
    """For a range: its frequent words, numbered (shard null), and for each shard the places of its
    frequent words with their numbers."""
    def run(blocks: pa.Table) -> pa.Table:
        rows = list(zip(*(blocks.column(c).to_pylist() for c in ("shard", "lang")),
                        *(blocks.column(c).combine_chunks() for c in ("words", "counts", "places"))))
        totals: dict[tuple[str, str], int] = {}
        for _, lang, words, counts, _ in rows:
            for key, n in zip(((lang, w) for w in words.values.to_pylist()), counts.values.to_pylist()):
                totals[key] = totals.get(key, 0) + n
        often = sorted(k for k, n in totals.items() if n >= least)
        number = {k: i for i, k in enumerate(often)}
        bucket = blocks.column("bucket")[0].as_py()
        out = [{"bucket": bucket, "n": len(often), "words": [{"lang": k[0], "word": k[1], "f": totals[k]} for k in often]}]
        for shard, lang, words, _, places in rows:
            found = np.array([number.get((lang, w), -1) for w in words.values.to_pylist()], np.int64)
            hit = found >= 0
            if hit.any():
                block = _blob(places.values.to_numpy()[hit].astype("<i4"), found[hit].astype("<i4"))
                out.append({"bucket": bucket, "shard": shard, "block": block, "n": len(often)})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("bucket", pa.int32()), ("shard", pa.string()), ("block", pa.binary()), ("n", pa.int64()),
            ("words", pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])))]))
    return run


def _candidates(grams: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n-word phrases whose first and last n-1 words are frequent.  ``grams``: the
    id of the phrase of n-1 words that starts at each place, or -1."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0))


def _keys(grams: np.ndarray, words: np.ndarray, at: np.ndarray, n: int, bits: tuple[int, int]) -> np.ndarray:
    keys = grams[at].astype(np.uint64) << np.uint64(bits[1]) | words[at + n - 1].astype(np.uint64)
    return permute(keys, sum(bits))


def _edges(ranges: int, bits: int) -> np.ndarray:
    """Where each range of permuted keys starts."""
    return np.array([(i << bits) // ranges for i in range(ranges)], np.uint64)


def _range_bits(ranges: int, bits: int) -> int:
    """Bits of a key less its range's start."""
    return max(1, (((1 << bits) + ranges - 1) // ranges).bit_length())


def _sent(grams: np.ndarray, words: np.ndarray, n: int, bits: tuple[int, int], ranges: int) -> list[tuple[int, bytes]]:
    """A shard's filter of order n: a block for each range that holds keys."""
    at = _candidates(grams, words, n)
    keys, counts = np.unique(_keys(grams, words, at, n, bits), return_counts=True)
    edges, each = _edges(ranges, sum(bits)), _range_bits(ranges, sum(bits))
    cut = [*np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(b, pack(keys[cut[b]:cut[b + 1]] - edges[b], counts[cut[b]:cut[b + 1]], each))
            for b in range(ranges) if cut[b] < cut[b + 1]]


def _merged(least: int, bits: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """A range's frequent keys as a filter (shard null), and for each of its shards one bit a key
    and the numbers of the frequent ones."""
    values, counts = merge(list(pdf["block"]))
    often = counts >= least
    bucket, n = int(pdf["bucket"].iloc[0]), int(often.sum())
    values = values[often]
    out = [(bucket, None, pack(values, counts[often], bits), n)]
    if n:
        for shard, block in zip(pdf["shard"], pdf["block"]):
            mine, _ = unpack(block)
            place = np.searchsorted(values, mine)
            place[place == n] = 0
            hit = values[place] == mine
            if hit.any():
                answer = len(mine).to_bytes(8, "little") + np.packbits(hit).tobytes() + place[hit].astype("<u4").tobytes()
                out.append((bucket, shard, zstandard.compress(answer, 1), n))
    return pd.DataFrame(out, columns=["bucket", "shard", "block", "n"])


def _answered(grams: np.ndarray, words: np.ndarray, n: int, bits: tuple[int, int], ranges: int, answers: pd.DataFrame) -> np.ndarray:
    """The id of the frequent phrase of n words that starts at each place, or -1."""
    at = _candidates(grams, words, n)
    keys, place = np.unique(_keys(grams, words, at, n, bits), return_inverse=True)
    cut = [*np.searchsorted(keys, _edges(ranges, sum(bits))).tolist(), len(keys)]
    ids = np.full(len(keys), -1, np.int64)
    for bucket, first, block in zip(answers["bucket"], answers["first"], answers["block"]):
        body = zstandard.decompress(block)
        m = int.from_bytes(body[:8], "little")
        hit = np.unpackbits(np.frombuffer(body, np.uint8, (m + 7) // 8, 8), count=m).astype(bool)
        assert m == cut[bucket + 1] - cut[bucket]
        part = ids[cut[bucket]:cut[bucket + 1]]
        part[hit] = np.frombuffer(body, "<u4", -1, 8 + (m + 7) // 8).astype(np.int64) + int(first)
    out = np.full(len(words), -1, np.int64)
    out[at] = ids[place]
    return out


def _trimmed(grams: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the places that phrases of n words can use, one -1 between their runs."""
    edge = np.zeros(len(words) + 1, np.int64)
    at = _candidates(grams, words, n)
    edge[at] += 1
    np.add.at(edge, at + n, -1)
    used = np.cumsum(edge[:-1]) > 0
    keep = used | np.concatenate([[False], used[:-1]])
    return np.where(used, grams, -1)[keep], np.where(used, words, -1)[keep]


def _step(n: int, bits: tuple[int, int], after: tuple[int, int] | None, ranges: int, last: bool) -> Callable:
    """For cogroup: a shard's state of order n - 1 and the answers of order n -> its state of
    order n and its blocks of order n + 1 (``bits``, ``after``: of the keys of these orders)."""
    def run(key: tuple, states: pa.Table, answers: pa.Table) -> pa.Table:
        out, answered = [], answers.to_pandas()
        for shard, lang, state in zip(*(states.column(c).to_pylist() for c in ("shard", "lang", "state"))):
            words, grams = _held(state, n)
            grams = _answered(grams, words, n, bits, ranges, answered)
            out += _following(shard, lang, grams, words, n + 1, after, ranges, last)
        return _step_table(out)
    return run


def _step_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.table({"shard": pa.array(columns[0], pa.string()), "lang": pa.array(columns[1], pa.string()),
                     "bucket": pa.array(columns[2], pa.int32()), "block": pa.array(columns[3], pa.binary()),
                     "state": pa.array(columns[4], pa.binary())})


def _following(shard: str, lang: str, grams: np.ndarray, words: np.ndarray, n: int, bits: tuple[int, int], ranges: int,
               last: bool) -> list[tuple]:
    grams, words = _trimmed(grams, words, n)
    out = [(shard, lang, b, block, None) for b, block in _sent(grams, words, n, bits, ranges)]
    if out and not last:
        state = (words.astype("<i4"),) if n == 2 else (words.astype("<i4"), grams.astype("<i8"))
        out.append((shard, lang, None, None, _blob(*state)))
    return out


def _held(state: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A state's words and the phrases of n - 1 words, which are the words themselves at order 2."""
    if n > 2:
        return tuple(_unblob(state, "<i4", "<i8"))
    words = _unblob(state, "<i4")[0]
    return words, words.astype(np.int64)


def _begin(bits: tuple[int, int], ranges: int, last: bool) -> Callable:
    """For cogroup: a shard and the ids of its frequent words -> its state and blocks of order 2."""
    def run(key: tuple, shards: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for shard, lang, blob in zip(*(shards.column(c).to_pylist() for c in ("shard", "lang", "tokens"))):
            tokens = _unblob(blob, "<i4")[0]
            numbers = np.full(int(tokens.max(initial=-1)) + 2, -1, np.int32)  # the last is that of -1
            for first, block in zip(answers.column("first").to_pylist(), answers.column("block").to_pylist()):
                places, found = _unblob(block, "<i4", "<i4")
                numbers[places] = found + first
            words = numbers[tokens]
            out += _following(shard, lang, words.astype(np.int64), words, 2, bits, ranges, last)
        return _step_table(out)
    return run


def _decoded(batches: Iterator[pa.RecordBatch], bits: tuple[int, int], ranges: int) -> Iterator[pa.RecordBatch]:
    """The phrases of the ranges' filters: id, id of the head, id of the last word, count."""
    edges = _edges(ranges, sum(bits))
    for batch in batches:
        for bucket, first, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "block"))):
            values, counts = unpack(block)
            keys = unpermute(values + edges[bucket], sum(bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + np.arange(len(keys)), pa.int64()), pa.array((keys >> np.uint64(bits[1])).astype(np.int64)),
                 pa.array((keys & np.uint64((1 << bits[1]) - 1)).astype(np.int64)), pa.array(counts, pa.int64())],
                names=["id", "head", "last", "f"])


def _bits(n: int) -> int:
    return max(1, (n - 1).bit_length())


def _placed(merged: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``merged`` with ``first``, the number of frequent keys in the ranges before."""
    sizes = merged.where(F.col("shard").isNull()).select("bucket", "n")  # a row for each range
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return merged.join(firsts, F.col("bucket") == F.col("b")).drop("b"), sizes.agg(F.sum("n")).first()[0] or 0


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``lang, n`` (all words); the frequent words ``id, lang, word, f``; and for each order from 2
    on the frequent phrases ``id, head, last, f``, by the ids of the order before and of words.

    ``docs``: lang, text.  Null texts are empty, a null lang is ``und``.
    """
    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text"))
    shards = save_table(source.mapInArrow(_shards, SHARD), "phrases-shards")
    totals = save_table(shards.groupBy("lang").agg(F.sum("n_words").alias("n")).coalesce(1), "phrases-totals")  # a row a language
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, all_words // RANGE_WORDS)
    blocks = shards.select("shard", "lang", "vocabulary", "counts").mapInArrow(partial(_word_blocks, ranges=ranges), WORDS)
    merged = save_table(blocks.groupBy("bucket").applyInArrow(_merged_words(least), FOUND), "phrases-words")
    placed, n_words = _placed(merged)
    words = (placed.where(F.col("shard").isNull()).select("first", F.posexplode("words").alias("at", "w"))
             .select((F.col("first") + F.col("at")).alias("id"), "w.lang", "w.word", "w.f"))
    orders: list[DataFrame] = []
    if not n_words or longest < 2:
        return totals, words, orders
    width = _bits(n_words)
    known = placed.where(F.col("shard").isNotNull()).select(F.col("shard").alias("of_shard"), "first", "block")
    bits = (width, width)
    steps = save_table(shards.select("shard", "lang", "tokens").groupBy("shard").cogroup(known.groupBy("of_shard"))
                       .applyInArrow(_begin(bits, ranges, longest == 2), STEP), "phrases-state")
    drop_saved(shards)
    for n in range(2, longest + 1):
        each = _range_bits(ranges, sum(bits))
        merged = save_table(steps.where(F.col("block").isNotNull()).select("bucket", "shard", "block").groupBy("bucket")
                            .applyInPandas(_merging(least, each), MERGED), "phrases-merged")
        placed, found = _placed(merged)
        orders.append(save_table(placed.where(F.col("shard").isNull()).select("bucket", "first", "block")
                                 .mapInArrow(partial(_decoded, bits=bits, ranges=ranges), "id long, head long, last long, f long"),
                                 "phrases-order"))
        if n == longest or not found:
            break
        after = (_bits(found), width)
        if sum(after) > 63:
            raise ValueError("ids of phrases need more than 63 bits")
        states = steps.where(F.col("state").isNotNull()).select("shard", "lang", "state")
        answers = placed.where(F.col("shard").isNotNull()).select("shard", "bucket", "first", "block")
        following = save_table(states.groupBy("shard").cogroup(answers.groupBy("shard"))
                               .applyInArrow(_step(n, bits, after, ranges, n + 1 == longest), STEP), "phrases-state")
        for old in (steps, merged):
            drop_saved(old)
        steps, bits = following, after
    return totals, words, orders


def _merging(least: int, bits: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _merged(least, bits, pdf)
    return run


def _named(words: DataFrame, orders: list[DataFrame]) -> list[DataFrame]:
    """For each order the phrases with their texts, the id of their tail, and the counts of
    their heads and tails, shortest first."""
    none = F.array().cast("array<long>")
    out = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last_word"), "f",
                        F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"),
                        F.col("id").alias("last"), none.alias("heads"), none.alias("tails"))]
    for n, grams in enumerate(orders, 2):
        shorter = out[-1]
        h = shorter.select(F.col("id").alias("h_id"), "lang", F.col("phrase").alias("h_phrase"), F.col("tail").alias("h_tail"),
                           F.concat("heads", F.array("f")).alias("heads"))
        t = shorter.select(F.col("id").alias("tail"), F.col("head").alias("t_head"), F.col("last").alias("t_last"), "last_word",
                           F.concat("tails", F.array("f")).alias("tails"))
        g = grams.join(h, F.col("head") == F.col("h_id"))
        same = F.col("last") == F.col("t_last")
        g = g.join(t, same if n == 2 else same & (F.col("h_tail") == F.col("t_head")))
        out.append(save_table(g.select("id", "lang", F.concat_ws(" ", "h_phrase", "last_word").alias("phrase"), "last_word", "f",
                                       "head", "tail", "last", "heads", "tails"), "phrases-named"))
    return out


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, top: int | None = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases (all, if None).

    Pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+`` after lower-casing A-Z; a null
    text is empty, a null lang is ``und``.  Phrases of 2 to ``longest`` words with a count of at
    least ``least`` are candidates; a candidate's score is the smallest floor(1000 a n / (l r))
    of its cuts, ties to the earliest.  One inside a longer candidate that has at least
    ``percent`` of its count goes: it is enough to look at those that are one word longer, as
    counts fall with length.  Order: score and count descending, phrase ascending.  An empty
    table gives no rows; rows count as often as they occur.
    """
    totals, words, orders = frequent_phrases(docs, longest, least)
    words = save_table(words, "phrases-named")
    named = _named(words, orders)
    exact = "decimal(19,0)"
    parts = []
    for n in range(2, len(named) + 1):
        rows = named[n - 1]
        if n < len(named):
            longer = named[n].select(F.explode(F.array(F.struct(F.col("head").alias("i"), "f"), F.struct(F.col("tail").alias("i"), "f"))).alias("e"))
            most = longer.groupBy(F.col("e.i").alias("i")).agg(F.max("e.f").alias("most"))
            rows = (rows.join(most, F.col("id") == F.col("i"), "left")
                    .where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("f"))))
        cuts = F.array(*(F.struct(F.lit(k).alias("k"), F.col("heads")[k - 1].alias("l"), F.col("tails")[n - k - 1].alias("r"))
                         for k in range(1, n)))
        parts.append(rows.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("cuts")))
    if not parts:
        return words.select("lang", F.lit(1).alias("rank"), F.col("word").alias("phrase"), *(F.col("f").alias(c) for c in
                                                                                        ("a", "l", "r", "n", "score"))).limit(0)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # one row a language
    rows = rows.join(totals.select(F.col("lang").alias("t_lang"), "n"), F.col("lang") == F.col("t_lang")).drop("t_lang")
    scored = rows.withColumn("best", F.array_min(F.transform("cuts", lambda c: F.struct(
        F.call_function("div", (F.lit(1000).cast(exact) * F.col("a").cast(exact) * F.col("n").cast(exact)),
                        c["l"].cast(exact) * c["r"].cast(exact)).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))))
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
                         F.col("best.score").alias("score"))
