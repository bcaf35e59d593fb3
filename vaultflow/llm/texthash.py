"""Hashes of words and shingles over the bytes of many texts at once (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken together up to so many bytes; a longer one is taken alone.
CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240201))
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0..n-1."""
    if len(_powers[0]) < n:
        size = max(n + n // 8, CHUNK + 1)
        with np.errstate(over="ignore"):
            for i, b in enumerate((BASE, INVERSE)):
                f = np.full(size, b, U)
                f[0] = 1
                _powers[i] = np.multiply.accumulate(f)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of each text; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of about that many bytes of a column, so that copies of a part stay small."""
    _, offsets = text_bytes(batch.column(column))
    for i, j in chunks(offsets, size):
        yield batch.slice(i, j - i)


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] a polynomial of values[i:j] times BASE ** i, modulo 2 ** 64."""
    out = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, letters A-Z lower-cased, and for each text
    the number of words before it (one more at the end)."""
    n = len(data)
    word = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    c, inverse = prefix_hashes(BYTE_LOWER[data]), powers(n + 1)[1]
    with np.errstate(over="ignore"):
        h = mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(U))
    return h, np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of width words; of all its words where
    it has fewer; none without words."""
    m = len(hashes)
    with np.errstate(over="ignore"):
        if m >= width:
            s = np.zeros(m - width + 1, U)
            for j in range(width):
                s += hashes[j : m - width + 1 + j] * PLACE[j]
            s = mix(s)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(s[a : b - width + 1]))
            elif b > a:
                out.append(mix(np.array([(hashes[a:b] * PLACE[: b - a]).sum(dtype=U) + U(b - a)], U)))
            else:
                out.append(np.zeros(0, U))
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order."""
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        h, bounds = word_hashes(part, offsets[i : j + 1] - offsets[i])
        yield from shingle_hashes(h, bounds, width)
