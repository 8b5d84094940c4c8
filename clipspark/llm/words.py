"""Words of whole Arrow text batches as 64-bit numbers, by numpy over the UTF-8 bytes.

A word's number depends on its bytes alone, so equal words (and equal runs of words) get
equal numbers in every task. Every separator used here is ASCII, so cutting bytes cuts
code points in the right places. Null and empty texts have no words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000
_LONG = 1024  # bytes from which a word is hashed by itself
_PRIME = np.uint64(2**61 - 1)
_BASE = 0x9E3779B97F4A7C15 % (2**61 - 1)
_powers: dict[int, np.ndarray] = {}

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_alnum_any = np.zeros(256, bool)
_alnum_any[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_same, _lower = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
_gap = np.zeros(256, bool)
_gap[[0x20, 0x0A]] = True
#: Kind of word: (bytes that belong to a word, what each byte counts as).
KINDS = {"pieces": (~_gap, _same), "spaced": (~_space, _same), "spaced_lower": (~_space, _lower), "alnum_lower": (_alnum_any, _lower)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits; different numbers stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """One number for each run of bytes data[begin:end], eight bytes at a time: each eight are
    added to what came before and mixed, so spans of one length up to eight never share a
    number, and longer ones only by chance."""
    size = end - begin
    lanes = np.concatenate([data, np.zeros(16, np.uint8)])
    lanes = np.ndarray(len(data) + 8, "<u8", lanes, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    at, left = np.flatnonzero((size > 0) & (size <= _LONG)), None
    done = 0
    while len(at):
        left = np.minimum(size[at] - done, 8).astype(np.uint64)
        out[at] = mix(out[at] ^ (lanes[begin[at] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))))
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        raw = hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(raw, "little")
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1, from halves of 31 bits."""
    half, low = np.uint64(31), np.uint64(2**31 - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & np.uint64(2**30 - 1)) << half) + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 61 - 1, kept for the next call."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, _product(have, np.array(pow(base, len(have), 2**61 - 1), np.uint64))])
    _powers[base] = have
    return have[:n]


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for each run values[start:end]; equal runs have equal numbers. It is the
    value of a polynomial modulo a prime, so no pattern of values makes runs collide."""
    terms = _product(_reduced(values), powers(_BASE, len(values)))
    low, high = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms & np.uint64(2**32 - 1), out=low[1:])
    np.cumsum(terms >> np.uint64(32), out=high[1:])
    total = _reduced((high >> np.uint64(29)) + ((high & np.uint64(2**29 - 1)) << np.uint64(32)) + low)
    part = _reduced(total[ends] + _PRIME - total[starts])
    back = powers(pow(_BASE, -1, 2**61 - 1), len(values) + 1)[starts]
    return mix(_product(part, back) + ((ends - starts).astype(np.uint64) << np.uint64(61)))


@dataclass
class Words:
    """Words of some consecutive rows: row r has words first[r]:first[r + 1]."""

    rows: slice
    buffer: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    number: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number) of every window of k words inside one row."""
        starts = np.arange(len(self.number) - k + 1) if len(self.number) >= k else np.zeros(0, np.int64)
        last = np.repeat(self.first[1:], self.counts)[: len(starts)]
        starts = starts[starts + k <= last]
        return starts, runs(self.number, starts, starts + k)


def offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a text column; null rows are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Consecutive rows of about ``most`` bytes together; a longer text is alone."""
    row, n = 0, len(off) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield slice(row, min(stop, n))
        row = min(stop, n)


def words(texts: pa.Array, kind: str, most: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of a text column, a bounded number of bytes at a time."""
    inside, counted = KINDS[kind]
    data, off = offsets(texts)
    for rows in chunks(off, most):
        at = off[rows.start : rows.stop + 1]
        buf = data[at[0] : at[-1]]
        at = at - at[0]
        n = len(buf)
        mask = inside[buf]
        before = np.zeros(n, bool)
        before[1:] = mask[:-1]
        before[at[:-1][at[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = mask[1:]
        after[at[1:][at[1:] > 0] - 1] = False
        begin = np.flatnonzero(mask & ~before)
        end = np.flatnonzero(mask & ~after) + 1
        first = np.searchsorted(begin, at)
        yield Words(rows, buf, begin, end, first, spans(buf if counted is _same else counted[buf], begin, end))
