"""Vectorised text primitives over Arrow string columns (numpy, no per-word Python).

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. Hashes are polynomial over 64-bit integers with a
random table per byte, finished by an avalanche mix; they depend only on the content, never on
the process, so every executor and every retry computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = [_rng.integers(1, 2**64, 256, dtype=U) | U(1) for _ in range(2)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = U(0x9E3779B97F4A7C15) | U(1)
_Q = U(0xD1342543DE82EF95) | U(1)
_powers: dict[tuple[int, int], np.ndarray] = {}
#: Bytes of text handled at once; bounds the temporary arrays.
CHUNK = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    base = int(base)
    have = _powers.get((base, 0))
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.concatenate([np.ones(1, U), np.full(size, U(base))])
            np.multiply.accumulate(have, out=have)
        if n <= 1 << 22:
            _powers[base, 0] = have
    return have


def inverse(base: int) -> int:
    return pow(int(base), -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes each; a longer text stands alone."""
    limit = limit or CHUNK
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def parts(col: pa.Array, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each chunk of a column."""
    raw, offsets = string_bytes(col)
    for i, j in chunks(offsets, limit):
        off = offsets[i : j + 1]
        yield i, j, raw[off[0] : off[-1]], off - off[0]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[raw]


class Words:
    """Word bounds of a chunk: start/end byte of each, and ``off``: the words of text k are off[k]:off[k+1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        solid = ~_SPACE[raw]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
            cuts = offsets[(offsets > 0) & (offsets < n)]
            before[cuts] = False
            after[cuts - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.off = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, family: int = 0) -> np.ndarray:
        n = len(self.raw)
        base = _P if family == 0 else _Q
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U)
            np.cumsum(_BYTE[family][self.raw] * powers(base, n)[:n], out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * powers(inverse(base), n)[self.start])


def grams(items: np.ndarray, k: int, base: int = int(_Q)) -> np.ndarray:
    """Hash of items[i:i+k] for each i; the last k-1 are left out."""
    n = len(items)
    if n < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(items * powers(base, n)[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * powers(inverse(base), n)[: n - k + 1])


def byte_grams(raw: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of the k bytes that start at each position; the last k-1 are left out."""
    return grams(_BYTE[family][raw], k, int(_P if family == 0 else _Q))


def within(off: np.ndarray, k: int, n: int) -> np.ndarray:
    """For starts 0..n-k: does start..start+k stay inside one text? off: ends of texts in the same unit."""
    ok = np.ones(max(n - k + 1, 0), bool)
    for c in off[1:-1]:
        ok[max(c - k + 1, 0) : c] = False
    return ok


def owners(off: np.ndarray) -> np.ndarray:
    """The text of each item."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of values[i:i+width] for each i (first one on ties), by doubling."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        have += step
    return at


def long_array(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(values.view(np.int64))


def id_array(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).to_numpy(zero_copy_only=False)
