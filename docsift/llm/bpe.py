"""Byte-level BPE encoding and decoding with numpy.

Distinct matches of the split pattern are laid out as padded matrices, one for each bucket
of lengths, a byte's id in each cell.  A round looks all neighbouring pairs up in a hash
table of pair -> rank, merges each row's leftmost pair of minimum rank, and closes the gap,
so that a matrix gets one column narrower; rows without a pair left leave it.  A match
longer than LONG is merged alone, with a heap, so that its rounds don't cost its length
each time.  The ids of a match are remembered (a bounded number of matches).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest match, in bytes, that goes into a matrix.
LONG = 512
#: Cells of a matrix at most.
CELLS = 1 << 20
NONE = np.int32(np.iinfo(np.int32).max)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    MULT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.vals = np.full(1 << bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, slot, self.probes = np.arange(len(key)), self._slot(key), 1
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = key[todo[free]]  # of several, the last one stays
            mine = self.keys[slot[todo]] == key[todo]
            self.vals[slot[todo[mine]]] = merged[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * self.MULT) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slot = self._slot(key)
        at = self.keys[slot]
        out = np.where(at == key, self.vals[slot], NONE)
        more = np.flatnonzero((at != key) & (at != -1))
        for _ in range(self.probes):
            if not len(more):
                break
            slot[more] = (slot[more] + 1) & self.mask
            at = self.keys[slot[more]]
            hit = at == key[more]
            out[more[hit]] = self.vals[slot[more[hit]]]
            more = more[~hit & (at != -1)]
        return out.reshape(shape)


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as fh:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in fh if line.strip())}
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        self.table = PairTable(*(np.array(c, np.int32) for c in zip(*pairs)))
        self.split = regex.compile(pattern).findall

    def _matrix(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of byte strings of similar lengths."""
        width = max(map(len, rows))
        m = np.full((len(rows), width), -1, np.int32)
        sizes = np.array([len(r) for r in rows])
        m[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        out: list[list[int]] = [[]] * len(rows)
        alive = np.arange(len(rows))
        ranks = self.table.find(m[:, :-1], m[:, 1:])
        while True:
            best = ranks.min(axis=1, initial=NONE)
            done = best == NONE
            if done.any():
                for i, row in zip(alive[done].tolist(), m[done].tolist()):
                    out[i] = [x for x in row if x >= 0]
                keep = ~done
                m, ranks, best, alive = m[keep], ranks[keep], best[keep], alive[keep]
                if not len(alive):
                    return out
            n, at = len(alive), ranks.argmin(axis=1)  # the first of equal ranks
            r = np.arange(n)
            m[r, at] = best
            gone = np.ones(m.shape, bool)
            gone[r, at + 1] = False
            m = m[gone].reshape(n, -1)
            gone = np.ones(ranks.shape, bool)
            gone[r, at] = False
            ranks = ranks[gone].reshape(n, -1)
            width = m.shape[1]
            if width == 1:
                continue
            # only the pairs beside the merged id are new: the one before it and the one after
            i = np.flatnonzero(at > 0)
            ranks[i, at[i] - 1] = self.table.find(m[i, at[i] - 1], m[i, at[i]])
            i = np.flatnonzero(at < width - 1)
            ranks[i, at[i]] = self.table.find(m[i, at[i]], m[i, at[i] + 1])

    def _long(self, piece: bytes) -> list[int]:
        """One long match: pairs in a heap by (rank, place), neighbours in linked lists."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        text = [piece[i:i + 1] for i in range(n)]
        rank = self.ranks.get
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j, size = heapq.heappop(heap)
            if not text[i] or j >= n or after[i] != j or not text[j] or len(text[i]) + len(text[j]) != size:
                continue  # an end of this pair was merged meanwhile
            text[i], ids[i], text[j] = text[i] + text[j], r, b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := rank(text[a] + text[b])) is not None:
                    heapq.heappush(heap, (x, a, b, len(text[a]) + len(text[b])))
        return [x for x, t in zip(ids, text) if t]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each byte string, merged for itself."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:  # as the library does
                out[i] = [whole]
            elif len(p) > LONG:
                out[i] = self._long(p)
            elif p:
                buckets.setdefault(len(p) if len(p) <= 16 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, at in sorted(buckets.items()):
            step = max(1, CELLS // width)
            for k in range(0, len(at), step):
                part = at[k:k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Known(dict):
    """A match to (number of ids, their decimals after a space each, decoded bytes)."""

    LIMIT = 500_000

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = list(pieces)
        for p, ids in zip(new, self.bpe.encode_pieces([p.encode() for p in new])):
            self[p] = (len(ids), "".join(f" {i}" for i in ids).encode(), self.bpe.decode(ids))


@lru_cache(maxsize=2)
def known(path: str, pattern: str) -> Known:
    return Known(ByteBpe(path, pattern))


#: Matches that are encoded together, about.
GROUP = 200_000


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    memory = known(path, pattern)
    for batch in batches:
        rows, waiting, held = [], [], 0

        def flush() -> None:
            memory.learn({p for w in waiting for p in w})
            for pieces in waiting:
                got = [memory[p] for p in pieces]
                rows.append((sum(g[0] for g in got), hashlib.sha256(b"".join([g[1] for g in got])[1:]).hexdigest(),
                             hashlib.sha256(b"".join([g[2] for g in got])).hexdigest()))

        for text in batch.column(1):
            waiting.append(memory.bpe.split(text.as_py() or ""))
            held += len(waiting[-1])
            if held >= GROUP:
                flush()
                waiting, held = [], 0
        flush()
        n, ids, decoded = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                          pa.array(decoded, pa.string())],
                                         names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = known(path, pattern).bpe
    for batch in batches:
        out = []
        for text in batch.column(1):
            pieces = bpe.split(text.as_py() or "")
            distinct = list(dict.fromkeys(pieces))
            ids = dict(zip(distinct, bpe.encode_pieces([p.encode() for p in distinct])))
            out.append([i for p in pieces for i in ids[p]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))],
                                         names=["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = known(path, pattern).bpe
    for batch in batches:
        out = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])


def _source(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("value"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text; a null or empty text has none."""
    return _source(docs, "text").mapInArrow(lambda b: _encoded(b, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes``: the bytes of each row's ``ids``; null ids have none."""
    return _source(encoded, "ids").mapInArrow(lambda b: _decoded(b, path, pattern), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text (null: empty).

    Null and repeated doc_ids are kept, one row for each input row; other columns are
    not read.  Ids are decoded from the ids themselves.
    """
    return _source(docs, "text").mapInArrow(
        lambda b: _digests(b, path, pattern),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
