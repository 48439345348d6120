"""Counting quotient filters of packed keys, lossless: every key and its count can be read back.

A key of 2h bits (two halves of h bits) goes through an invertible permutation, so that keys spread evenly. The
permuted key's leading bits are the quotient, the rest is the whole remainder: nothing is hashed away. A packed filter
holds, in order of the permuted keys, one bit a quotient and one an entry (unary runs), the remainders in as few
bytes as they need, and counters of one byte with an escape for larger ones. Sorted filters merge like sorted runs.

``Entries`` is the open form: numpy columns in order of the permuted key. Filters are packed by prefix, the first
bits of the permuted key, which also deals them out over tasks: prefixes are even, however uneven the keys.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from logbasin.llm.common import ship

ship(__name__)

ROUNDS = 4
# Any odd numbers do; these mix well.
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ESCAPE = 255
HEADER = "<IBI"


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _round(x: np.ndarray, number: int, half: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(x + STEP * np.uint64(number + 1)) >> np.uint64(64 - half)


def permuted(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network: each round keeps one half, so it can be run backwards."""
    for i in range(ROUNDS):
        left, right = right, left ^ _round(right, i, half)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for i in reversed(range(ROUNDS)):
        left, right = right ^ _round(left, i, half), left
    return left, right


def packed_ids(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``width`` bits (an even number) each as the two halves of one key."""
    n, middle = len(ids), len(ids) // 2
    left, right = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
    w, part = np.uint64(width), np.uint64(width // 2)
    for i in range(middle):
        left = (left << w) | ids[i]
    if n % 2:
        left = (left << part) | (ids[middle] >> part)
        right = ids[middle] & ((np.uint64(1) << part) - np.uint64(1))
    for i in range(middle + n % 2, n):
        right = (right << w) | ids[i]
    return left, right


def unpacked_ids(left: np.ndarray, right: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    w, part, mask = np.uint64(width), np.uint64(width // 2), (np.uint64(1) << np.uint64(width)) - np.uint64(1)
    after, before = [], []
    for _ in range(n // 2):
        after.append(right & mask)
        right = right >> w
    if n % 2:
        low = (np.uint64(1) << part) - np.uint64(1)
        after.append(((left & low) << part) | right)
        left = left >> part
    for _ in range(n // 2):
        before.append(left & mask)
        left = left >> w
    return before[::-1] + after[::-1]


@dataclass
class Entries:
    """Permuted keys in order, each once, and their counts."""

    left: np.ndarray
    right: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.count)

    def slice(self, start: int, end: int) -> Entries:
        return Entries(self.left[start:end], self.right[start:end], self.count[start:end])


def _summed(left: np.ndarray, right: np.ndarray, count: np.ndarray | None, half: int) -> Entries:
    if not len(left):
        return Entries(left, right, np.zeros(0, np.int64))
    # Sorted runs put together: a stable sort finds and merges them.
    if 2 * half <= 64:
        order = np.argsort((left << np.uint64(half)) | right, kind="stable")
    else:
        order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    counts = np.diff(np.append(first, len(left))) if count is None else np.add.reduceat(count[order], first)
    return Entries(left[first], right[first], counts.astype(np.int64))


def counted(left: np.ndarray, right: np.ndarray, half: int) -> Entries:
    """Occurrences of keys as entries."""
    return _summed(*permuted(left, right, half), None, half)


def merged(parts: list[Entries], half: int) -> Entries:
    if len(parts) == 1:
        return parts[0]
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return _summed(join("left"), join("right"), join("count"), half)


def prefix_bits(wanted: int, half: int) -> int:
    return min(max(wanted, 1), half)


def by_prefix(entries: Entries, half: int, prefix: int):
    """(prefix, its entries), in order; only those that have entries."""
    found = entries.left >> np.uint64(half - prefix)
    firsts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else []
    for start, end in zip(firsts, [*firsts[1:], len(found)]):
        yield int(found[start]), entries.slice(start, end)


def _narrow(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(data: memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if size:
        out[:, :size] = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    return out.view("<u8").reshape(n).astype(np.uint64)


def pack(entries: Entries, half: int, prefix: int) -> bytes:
    """The filter of the entries of one prefix."""
    n = len(entries)
    quotient_bits = min(max(n - 1, 1).bit_length(), half - prefix)
    rest = half - prefix - quotient_bits
    tail = entries.left & ((np.uint64(1) << np.uint64(half - prefix)) - np.uint64(1))
    quotient = (tail >> np.uint64(rest)).astype(np.int64)
    runs = np.zeros(n + (1 << quotient_bits), np.uint8)
    runs[np.arange(n) + quotient] = 1
    small = np.minimum(entries.count, ESCAPE).astype(np.uint8)
    large = entries.count[entries.count >= ESCAPE]
    remainder = tail & ((np.uint64(1) << np.uint64(rest)) - np.uint64(1))
    return b"".join([
        struct.pack(HEADER, n, quotient_bits, len(large)), np.packbits(runs).tobytes(), _narrow(remainder, -(-rest // 8)), _narrow(entries.right, -(-half // 8)),
        small.tobytes(), large.astype("<i8").tobytes(),
    ])


def unpack(data: bytes, of_prefix: int, half: int, prefix: int) -> Entries:
    n, quotient_bits, n_large = struct.unpack_from(HEADER, data)
    view, at = memoryview(data), struct.calcsize(HEADER)

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return view[at - size : at]

    rest, length = half - prefix - quotient_bits, n + (1 << quotient_bits)
    runs = np.unpackbits(np.frombuffer(take(-(-length // 8)), np.uint8), count=length)
    quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
    remainder = _wide(take(n * -(-rest // 8)), n, -(-rest // 8))
    right = _wide(take(n * -(-half // 8)), n, -(-half // 8))
    count = np.frombuffer(take(n), np.uint8).astype(np.int64)
    count[count == ESCAPE] = np.frombuffer(take(n_large * 8), "<i8")
    left = (np.uint64(of_prefix) << np.uint64(half - prefix)) | (quotient << np.uint64(rest)) | remainder
    return Entries(left, right, count)


class Merger:
    """Entries added part by part: parts of like size are merged, so that each entry moves a logarithm of times."""

    def __init__(self, half: int):
        self.half, self.parts = half, []

    def add(self, part: Entries) -> None:
        self.parts.append(part)
        while len(self.parts) > 1 and len(self.parts[-2]) < 2 * len(self.parts[-1]):
            last = self.parts.pop()
            self.parts[-1] = merged([self.parts[-1], last], self.half)

    def __len__(self) -> int:
        return sum(map(len, self.parts))

    def take(self) -> Entries | None:
        parts, self.parts = self.parts, []
        return merged(parts, self.half) if parts else None
