"""Content-defined chunk lengths from a polynomial rolling hash.

Bytes are a polynomial over GF(2), reduced modulo x^32 + P.  A chunk ends behind a byte where
the hash's low 12 bits are zero, 32 bytes after its start at the earliest; there is no upper
bound.  ``window=32`` hashes the last 32 bytes, so equal content is cut alike wherever it
stands.  ``window=0``, the compatible mode, hashes all bytes since the chunk's start and adds
each again, one place higher, when the 32nd after it comes.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
POLYNOMIAL = 0x45C2B6A1
MASK = 0xFFF
LEAST = 32


def _times_x8(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return ((values << np.uint64(8)) & np.uint64(0xFFFFFFFF)) ^ table[(values >> np.uint64(24)).astype(np.int64)]


def overflow_table() -> np.ndarray:
    """What each byte shifted beyond x^31 leaves: byte * x^32 modulo the polynomial."""
    out = np.zeros(256, dtype=np.uint64)
    for byte in range(256):
        value = byte << 32
        for bit in range(39, 31, -1):
            if value >> bit & 1:
                value ^= ((1 << 32) | POLYNOMIAL) << (bit - 32)
        out[byte] = value
    return out


OVERFLOW = overflow_table()
_PLAIN = [int(x) for x in OVERFLOW]


def _window_tables() -> np.ndarray:
    """Row k: each byte times x^(8k), what a byte k places before the last adds to the hash."""
    rows = [np.arange(256, dtype=np.uint64)]
    for _ in range(LEAST - 1):
        rows.append(_times_x8(rows[-1], OVERFLOW))
    return np.stack(rows).astype(np.uint32)


_TABLES = _window_tables()


def place_tables() -> np.ndarray:
    """Row k, column b: what byte b, k places before the last, adds to the windowed hash."""
    return _TABLES


def _windowed(data: bytes) -> list[int]:
    own = np.frombuffer(data, dtype=np.uint8)
    hashes = np.zeros(len(own) - LEAST + 1, dtype=np.uint32)
    for k in range(LEAST):
        hashes ^= _TABLES[k][own[LEAST - 1 - k : len(own) - k]]
    ends = np.flatnonzero(hashes & MASK == 0) + LEAST
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= LEAST:
            out.append(end - start)
            start = end
    return out + [len(data) - start] * (start < len(data))


def _since_start(data: bytes) -> list[int]:
    own = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    echo = own.copy()  # each byte with the one 32 places before it, a place higher
    echo[LEAST:] ^= own[:-LEAST] << 8
    echo, out, start, size, table = echo.tolist(), [], 0, len(data), _PLAIN
    while size - start >= LEAST:
        h, end = 0, start + LEAST
        for b in data[start:end]:
            h = (h << 8 & 0xFFFFFFFF | b) ^ table[h >> 24]
        while h & MASK and end < size:
            h = (h << 8 & 0xFFFFFFFF) ^ echo[end] ^ table[h >> 24]
            end += 1
        out.append(end - start)
        start = end
    return out + [size - start] * (start < size)


def chunk_lengths(data: bytes, window: int = 32) -> list[int]:
    if window not in (0, LEAST):
        raise ValueError("window is 0 or 32")
    if len(data) < LEAST:
        return [len(data)] * bool(data)
    return _windowed(data) if window else _since_start(data)
