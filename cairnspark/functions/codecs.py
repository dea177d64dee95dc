"""Chunk codecs by name, and their numbers in an archive's header."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Callable

# Fixed values of the formats.
NUMBERS = {"gzip": 0, "bzip2": 1, "none": 2, "lzss": 3}
WINDOW, LONGEST, SHORTEST = 4096, 18, 3


def lzss(data: bytes) -> bytes:
    """Dictionary of the last 4096 bytes, blanks at first; the longest, oldest match wins.

    Bits from the top: 1 and a byte, or 0, a place in the cyclic window (its low byte, then its
    four high bits) and the length less 3.  A match may run from the newest byte of the window on
    to its oldest, never into what is still to be coded."""
    bits, count, at, size = 0, 0, 0, len(data)
    out = bytearray()
    past = b" " * WINDOW + data  # the window is past[at : at + WINDOW], what is to be coded follows
    find = past.find
    while at < size:
        end = at + WINDOW
        limit = min(LONGEST, size - at)
        place = length = 0
        n, start = SHORTEST, at
        while n <= limit:
            found = find(past[end : end + n], start, end)
            if found < 0:
                # across the window's end: only the last n - 1 places are left to look at
                seam = max(start, end - n + 1)
                ring = past[seam:end] + past[at : at + n - 1]
                turn = ring.find(past[end : end + n])
                if turn < 0:
                    break
                found = seam + turn
                length = n
            else:
                # as far as it goes on there
                length = n
                while length < limit and found + length < end and past[found + length] == past[end + length]:
                    length += 1
            place, start, n = found - at, found, length + 1
        if length:
            offset = (at + place) % WINDOW
            bits = bits << 17 | (offset & 0xFF) << 8 | offset >> 8 << 4 | length - SHORTEST
            count += 17
            at += length
        else:
            bits = bits << 9 | 1 << 8 | data[at]
            count += 9
            at += 1
        if count >= 512:
            out += (bits >> count % 8).to_bytes(count // 8, "big")
            bits, count = bits & (1 << count % 8) - 1, count % 8
    if count:
        pad = -count % 8
        out += (bits << pad).to_bytes((count + pad) // 8, "big")
    return bytes(out)


def unlzss(data: bytes) -> bytes:
    """The inverse; a match is copied out of the window before the window moves."""
    past, at, size = bytearray(b" " * WINDOW), 0, len(data) * 8
    padded = data + bytes(3)
    while size - at >= 9:
        first = at >> 3
        code = (padded[first] << 16 | padded[first + 1] << 8 | padded[first + 2]) >> 7 - (at & 7)  # 17 bits, and older ones above
        if code & 0x10000:
            past.append(code >> 8 & 0xFF)
            at += 9
            continue
        if size - at < 17:
            break
        end = len(past)
        start = end - WINDOW + ((code >> 8 & 0xFF | (code & 0xF0) << 4) - end) % WINDOW
        length = (code & 0xF) + SHORTEST
        piece = past[start : start + length]
        if start + length > end:
            piece += past[end - WINDOW : end - WINDOW + start + length - end]
        past += piece
        at += 17
    return bytes(past[WINDOW:])


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "none": (bytes, bytes),
    "gzip": (zlib.compress, zlib.decompress),
    "bzip2": (lambda x: bz2.compress(x, 9), bz2.decompress),
    "lzss": (lzss, unlzss),
}


def codec(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    if name not in CODECS:
        raise ValueError(f"no codec {name}; there are {', '.join(CODECS)}")
    return CODECS[name]
