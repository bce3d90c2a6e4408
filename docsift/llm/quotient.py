"""Counting quotient filters that lose nothing.

Keys of a fixed number of bits are permuted invertibly, so that they spread evenly, and cut into
a quotient (the high bits) and a remainder (all other bits, kept in full).  Sorted, they need no
pointers: for each quotient its number of keys in unary, then the remainders, byte plane by byte
plane, then the counters, a byte each with the larger ones listed.  Two filters of the same
range are merged by sorting them together and adding the counters; inverting the permutation
gives the keys back.
"""

from __future__ import annotations

import numpy as np
import zstandard

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(keys: np.ndarray, bits: int) -> np.ndarray:
    """A one-to-one map of the integers under 2**bits: multiplications by odd numbers and
    exclusive-ors with the high half."""
    x, half = keys.astype(np.uint64), np.uint64((bits + 1) // 2)
    for m in _ODD:
        x = x * np.uint64(m) & _mask(bits)
        x ^= x >> half
    return x


def unpermute(values: np.ndarray, bits: int) -> np.ndarray:
    x, half = values.astype(np.uint64), np.uint64((bits + 1) // 2)
    for m in reversed(_ODD):
        x = x ^ x >> half  # the shift is at least half of the bits, so this undoes itself
        x = x * np.uint64(pow(m, -1, 1 << 64)) & _mask(bits)
    return x


def pack(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter of distinct ascending permuted keys under 2**bits."""
    n = len(values)
    quotient_bits = min(bits, max(1, n.bit_length()))
    left = bits - quotient_bits
    quotients = (values >> np.uint64(left)).astype(np.int64) if left < 64 else np.zeros(n, np.int64)
    unary = np.zeros(n + (1 << quotient_bits), np.uint8)  # a one for each key, a zero after each quotient
    unary[quotients + np.arange(n)] = 1
    planes = (left + 7) // 8
    rest = (values & _mask(left)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :planes]
    big = np.flatnonzero(counts >= 255)
    head = np.array([n, bits, quotient_bits, len(big)], "<i8").tobytes()
    small = np.minimum(counts, 255).astype(np.uint8)
    return head + zstandard.compress(b"".join([np.packbits(unary).tobytes(), np.ascontiguousarray(rest.T).tobytes(), small.tobytes(),
                                               counts[big].astype("<i8").tobytes()]), 1)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ascending permuted keys and their counts."""
    n, bits, quotient_bits, big = np.frombuffer(block, "<i8", 4).tolist()
    body = np.frombuffer(zstandard.decompress(block[32:]), np.uint8)
    left = bits - quotient_bits
    length, planes = n + (1 << quotient_bits), (left + 7) // 8
    at = (length + 7) // 8
    ones = np.flatnonzero(np.unpackbits(body[:at], count=length))
    values = (ones - np.arange(n)).astype(np.uint64) << np.uint64(left)
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :planes] = body[at:at + planes * n].reshape(planes, n).T
    values |= rest.view("<u8").ravel()
    at += planes * n
    counts = body[at:at + n].astype(np.int64)
    counts[counts == 255] = np.frombuffer(body[at + n:].tobytes(), "<i8", big)
    return values, counts


def merge(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the filters, ascending, with the sums of their counters."""
    parts = [unpack(b) for b in blocks]
    values, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(values, kind="stable")  # merges the sorted runs
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts
