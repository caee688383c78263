"""Vectorised helpers over Arrow string buffers: bytes, words and 64-bit hashes.

All hashes are fixed functions of the bytes, the same on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; a single longer text makes a step of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of each element."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_CODE = mix(np.arange(256, dtype=_U), 7)
_powers: dict[str, np.ndarray] = {}


def _power(n: int, kind: str = "up") -> np.ndarray:
    """radix**i (or its inverse mod 2**64) for i < n."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        base = _RADIX if kind == "up" else _U(pow(int(_RADIX), -1, 1 << 64))
        steps = np.full(size, base, _U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps, dtype=_U)
        if size <= 4 * BLOCK_BYTES:  # do not keep a very long text's powers
            _powers[kind] = have
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes mod 2**64: out[i] covers data[:i]."""
    out = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(_CODE[data] * _power(len(data)), out=out[1:], dtype=_U)
    return out


def spans(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Position-free 64-bit hashes of data[starts:ends] from prefix hashes."""
    with np.errstate(over="ignore"):
        raw = (pre[ends] - pre[starts]) * _power(len(pre), "down")[starts]
        return mix(raw + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F), seed)


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and int64 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, body = col.buffers()
    kind = np.int64 if wide else np.int32
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n, row + 50_000)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row offsets of the words ``[^\\x20\\x09-\\x0D]+`` of a block."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[data]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin[cut] = ink[cut]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    last = cut - 1
    end[last] = ink[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Places of a word whose codes are looked up; further ones are computed.
_PLACES = 48
_tables: dict[int, np.ndarray] = {}


def _place_codes(seed: int) -> np.ndarray:
    """A random code for each byte at each of the first places of a word."""
    if seed not in _tables:
        _tables[seed] = mix(np.arange(_PLACES * 256, dtype=_U), 1009 + seed)
    return _tables[seed]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words: a random code for each (place, byte), summed up and mixed.

    Unlike a polynomial modulo 2**64, no family of words collides by its structure.
    Different seeds give independent hashes.
    """
    if not len(starts):
        return np.zeros(0, _U)
    place = np.arange(len(data))
    opening = np.zeros(len(data), np.int64)
    opening[starts] = starts
    place -= np.maximum.accumulate(opening)
    code = _place_codes(seed)[np.minimum(place, _PLACES - 1) * 256 + data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        code[far] = mix(mix(place[far].astype(_U), 2017 + seed) + data[far], 3023 + seed)
    total = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(code, out=total[1:], dtype=_U)
        return mix(total[ends] - total[starts] + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F), seed)


def piece_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit digests of data[starts:ends] (eight bytes or more each): a mix of every (place, eight bytes), summed up."""
    wide = np.zeros(max(len(data) - 7, 0), _U)
    for k in range(8):
        wide |= data[k : len(wide) + k].astype(_U) << _U(8 * k)
    size = ends - starts
    count = (size + 7) // 8  # the last eight bytes overlap those before
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(len(starts), _U)
    row = 0
    while row < len(starts):  # in steps of bounded size
        stop = max(row + 1, int(np.searchsorted(at, at[row] + (1 << 20), "right")) - 1)
        owner = np.repeat(np.arange(row, stop), count[row:stop])
        place = np.arange(at[row], at[stop]) - at[owner]
        where = np.minimum(starts[owner] + 8 * place, ends[owner] - 8)
        with np.errstate(over="ignore"):
            parts = mix(wide[where] ^ mix(place.astype(_U), 4001 + seed), 5003 + seed)
            out[row:stop] = np.add.reduceat(parts, at[row:stop] - at[row])
        row = stop
    with np.errstate(over="ignore"):
        return mix(out + size.astype(_U) * _U(0xA0761D6478BD642F), seed)


def ngrams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive elements (len - n + 1 of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        # doubling: h[w] covers w elements; the bits of n give the pieces
        out, width, level, done = None, 1, hashes, 0
        scale = int(_RADIX)
        left = n
        while left:
            if left & 1:
                piece = level[done : done + m] * _U(pow(scale, done, 1 << 64))
                out = piece if out is None else out + piece
                done += width
            left >>= 1
            if left:
                level = level[: len(level) - width] + level[width:] * _U(pow(scale, width, 1 << 64))
                width *= 2
    return mix(out, seed)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row index of each element between per-row offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
