"""Packing by minimum bin slack.

A document's ids are cut into whole windows and one remainder, so only remainders need
packing.  Their histogram (a count for each length under the window, the same size for
any corpus) holds all that the packing depends on.  ``plan`` repeatedly fixes the longest
remainder left, finds by a bitset subset-sum program over the remaining multiset the fill
that comes closest to the window, backtracks its counts, and uses that pattern as often
as the counts allow.  When the closest fill still leaves a gap, a remainder is cut at a
multiple of STEP to close it; STEP's marks carry the checksums of the heads, which give those
of the tails, so no id is read twice.

Every piece then finds its sequence from its number among the pieces of its length.
Numbers are given within (length, part), after the pieces of earlier parts, so that a
length that a third of all documents share is numbered by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save_table
from .tokens import piece_ids

#: Remainders may be cut at multiples of this many ids.
STEP = 64
#: Pieces that one task numbers, about.
PART_ROWS = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, heads array<long>"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document: whole windows, then the remainder with the checksums of
    its heads at every multiple of STEP."""
    encode, tail = piece_ids(path), int(end).to_bytes(4, "little")
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "crc", "total", "heads")}
        texts = (text.as_py() or "" for text in batch.column(1))
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode.each(texts)):
            ids = memoryview(ids + tail)
            total = len(ids) // 4
            for start in range(0, total, window):
                piece = ids[4 * start:4 * (start + window)]
                n, heads = len(piece) // 4, []
                if n < window:
                    crc = 0
                    for at in range(STEP, n, STEP):
                        crc = zlib.crc32(piece[4 * (at - STEP):4 * at], crc)
                        heads.append(crc)
                for k, v in zip(out, (doc_id, start, n, zlib.crc32(piece), total, heads)):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[n], pa.int64()) for n in ("doc_id", "start", "length", "crc", "total")]
            + [pa.array(out["heads"], pa.list_(pa.int64()))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "heads"])


def _rest(whole: int, head: int, size: int) -> int:
    """CRC-32 of the last ``size`` bytes of some, from those of all and of what is before them.  Going
    on from a checksum is linear in it, so zeros show what the head adds."""
    zeros = bytes(size)
    return whole ^ zlib.crc32(zeros, head) ^ zlib.crc32(zeros)


@dataclass
class Plan:
    """Ranges of numbers, by length: where the pieces (or heads, or tails) of a range go."""

    rows: dict[str, list[int]] = field(default_factory=lambda: {
        n: [] for n in ("length", "low", "high", "cut", "tail", "sequence", "per", "slot", "offset", "size")})

    def add(self, **values: int) -> None:
        for n in self.rows:
            self.rows[n].append(values[n])


def _closest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset with the largest sum of at most ``room``: (length, count) pairs.

    Bit s of a bitset says that s can be reached; the bitsets before each length are kept
    to backtrack.  Counts are split in powers of two, so a length adds few steps.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            total -= n * k
            used[n] = used.get(n, 0) + k
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], window: int) -> Plan:
    """Where every piece goes, from the counts by length alone.

    Items are whole pieces and tails of cut pieces.  An item is (length, source length,
    cut or 0), and holds ranges of its source's numbers.
    """
    out, sequence = Plan(), 0
    ranges: dict[tuple[int, int], list[list[int]]] = {(n, 0): [[0, c]] for n, c in histogram.items() if c}
    size = lambda key: key[0] - key[1]

    def left(key: tuple[int, int]) -> int:
        return sum(high - low for low, high in ranges.get(key, ()))

    def take(key: tuple[int, int], n: int) -> list[list[int]]:
        got = []
        while n:
            low, high = ranges[key][0]
            k = min(n, high - low)
            got.append([low, low + k])
            n -= k
            if low + k == high:
                ranges[key].pop(0)
            else:
                ranges[key][0][0] += k
        if not ranges[key]:
            del ranges[key]
        return got

    def put(key: tuple[int, int], got: list[list[int]], per: int, slot: int, offset: int, head: int = 0) -> None:
        """The items of ``got``, ``per`` to a sequence from ``slot`` on, at ``offset``."""
        n = head or size(key)
        for low, high in got:
            out.add(length=key[0], low=low, high=high, cut=head or key[1], tail=int(not head and key[1] > 0),
                    sequence=sequence, per=per, slot=slot, offset=offset, size=n)
            slot += high - low

    while ranges:
        sizes: dict[int, list[tuple[int, int]]] = {}
        for key in ranges:
            sizes.setdefault(size(key), []).append(key)
        counts = {n: sum(map(left, keys)) for n, keys in sizes.items()}
        top = max(counts)
        counts[top] -= 1
        fill = dict(_closest(sorted((n for n, c in counts.items() if c), reverse=True), counts, window - top))
        counts[top] += 1
        fill[top] = fill.get(top, 0) + 1
        gap = window - sum(n * k for n, k in fill.items())
        times = min(counts[n] // k for n, k in fill.items())
        # a gap of a mark or more is closed by the head of a remainder that isn't cut yet
        cut, room = None, gap // STEP * STEP
        if room:
            whole = [k for k in ranges if not k[1] and k[0] > room]
            spare = {k: left(k) - fill.get(k[0], 0) for k in whole}
            whole = [k for k in whole if spare[k] > 0]
            if whole:
                cut = max(whole, key=lambda k: (spare[k], k))
                need = fill.get(cut[0], 0) + 1
                times = min(times, max(1, left(cut) // need))
        got = []
        if cut:  # first, so that the fill doesn't use up what is to be cut
            got.append((cut, take(cut, times), 1, room))
        for n in sorted(fill, reverse=True):
            want = fill[n] * times
            for key in sorted(sizes[n], key=lambda k: -k[1]):
                k = min(want, left(key)) if key in ranges else 0
                if k:
                    got.append((key, take(key, k), fill[n], 0))
                    want -= k
            if want:
                raise AssertionError("the plan uses more pieces than there are")
        offset, slots = 0, {}
        for key, parts, per, head in sorted(got, key=lambda g: (g[3], -size(g[0]))):
            n = head or size(key)
            place = (n, head)
            if place not in slots:
                slots[place] = [0, offset]
                offset += n * per
            put(key, parts, per, slots[place][0], slots[place][1], head)
            slots[place][0] += sum(high - low for low, high in parts)
            if head:
                ranges.setdefault((key[0], head), []).extend([list(p) for p in parts])
        sequence += times
    return out


def _placed(frames: Iterator[pd.DataFrame], rows: dict[str, list[int]]) -> Iterator[pd.DataFrame]:
    """Sequence and offset of every piece, from its number; a cut piece gives two rows."""
    table = {n: np.asarray(v, np.int64) for n, v in rows.items()}
    heads = [np.flatnonzero(table["tail"] == 0), np.flatnonzero(table["tail"] == 1)]
    shift = np.int64(1) << np.int64(48)  # numbers stay far below
    for pdf in frames:
        out = []
        number = pdf["number"].to_numpy(np.int64)
        key = pdf["length"].to_numpy(np.int64) * shift + number
        for pick in heads:  # first whole pieces and heads, then tails
            if not len(pick):
                continue
            low = table["length"][pick] * shift + table["low"][pick]
            order = np.argsort(low)
            at = np.searchsorted(low[order], key, side="right") - 1
            row = pick[order[np.maximum(at, 0)]]
            hit = (at >= 0) & (table["length"][row] == pdf["length"].to_numpy()) & (number < table["high"][row])
            row, part = row[hit], pdf[hit]
            slot = table["slot"][row] + number[hit] - table["low"][row]
            cut, tail = table["cut"][row], table["tail"][row].astype(bool)
            crc = part["ids_crc32"].to_numpy(np.int64).copy()
            for i in np.flatnonzero(cut):
                head = int(part["heads"].iloc[i][cut[i] // STEP - 1])
                crc[i] = _rest(int(crc[i]), head, 4 * int(table["size"][row[i]])) if tail[i] else head
            out.append(pd.DataFrame({
                "doc_id": part["doc_id"], "start": part["start"] + np.where(tail, cut, 0),
                "length": table["size"][row], "ids_crc32": crc, "doc_tokens": part["doc_tokens"],
                "sequence_id": table["sequence"][row] + slot // table["per"][row],
                "offset": table["offset"][row] + slot % table["per"][row] * table["size"][row]}))
        yield pd.concat(out) if out else pd.DataFrame()


def pack(docs: DataFrame, path: str, window: int = 2048, end: int = 1) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone.  Null and repeated doc_ids are kept, each row
    as a document of its own.  An empty table gives no rows.  Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    pieces = save_table(source.mapInArrow(lambda b: _pieces(b, path, window, end), PIECES), "pack-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, window).rows

    parts = max(8, sum(histogram.values()) // PART_ROWS)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
               .select(F.col("length").alias("o_length"), F.col("part").alias("o_part"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = (dealt.withColumn("number", F.row_number().over(inside) - 1)
                .join(offsets, (F.col("length") == F.col("o_length")) & (F.col("part") == F.col("o_part")))
                .withColumn("number", F.col("first") + F.col("number")).drop("first", "o_length", "o_part", "part"))
    return numbered.mapInPandas(
        lambda it: _placed(it, rows),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
