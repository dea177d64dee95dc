import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnspark.functions.chunking import OVERFLOW, chunk_lengths
from cairnspark.functions.codecs import CODECS, codec, lzss, unlzss

RANDOM = random.Random(42)
NOISE = bytes(RANDOM.getrandbits(8) for _ in range(1 << 18))


def test_tables():
    assert [int(OVERFLOW[i]) for i in (1, 2, 255)] == [0x45C2B6A1, 0x8B856D42, 0x66AE4CAF]


def test_chunk_vectors():
    assert chunk_lengths(bytes(100), 0) == chunk_lengths(bytes(100), 32) == [32, 32, 32, 4]
    assert chunk_lengths(bytes(range(256)) * 64, 0)[:10] == [2270, 4091, 458, 1996, 768, 768, 768, 768, 768, 768]
    old, new = chunk_lengths(NOISE, 0), chunk_lengths(NOISE, 32)
    assert (old[:8], len(old)) == ([6669, 2435, 9061, 12618, 4282, 505, 1356, 823], 48)
    assert (new[:8], len(new)) == ([3998, 4937, 156, 3470, 446, 1070, 8557, 1824], 62)
    assert chunk_lengths(b"") == [] and chunk_lengths(b"abc") == [3]
    with pytest.raises(ValueError):
        chunk_lengths(b"abc", 7)


def _pieces(data, window):
    out, at = [], 0
    for n in chunk_lengths(data, window):
        out.append(data[at : at + n])
        at += n
    return out


def test_shift():
    for window, kept in ((0, 0), (32, 61)):
        assert len(set(_pieces(NOISE, window)) & set(_pieces(b"X" + NOISE, window))) == kept


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([0, 32]))
def test_chunks_cover(data, window):
    lengths = chunk_lengths(data, window)
    assert sum(lengths) == len(data) and all(n >= 32 for n in lengths[:-1])


def test_lzss_vectors():
    for text, code in ((b"a", "b080"), (b"abcabcabcabc", "b0d8ac6000000018"), (b" " * 6, "000180"), (b"hello hello hello world", "b4596d96cb7bffd0000777b7dcad9640")):
        assert lzss(text).hex() == code and unlzss(lzss(text)) == text


@pytest.mark.parametrize("name", CODECS)
def test_round_trips(name):
    pack, unpack = codec(name)
    cases = [b"a", bytes(100), NOISE[:5000], b"abc" * 3000, b" " * 50] + [b"x" * n for n in (17, 18, 19, 4095, 4096, 4097)]
    for data in cases + [b""]:
        assert unpack(pack(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"ab", b"abc", b" ", b"\x00", b"xyzzy" * 5, b"q" * 30]), max_size=60))
def test_lzss_any(parts):
    data = b"".join(parts)
    assert unlzss(lzss(data)) == data


def test_no_codec():
    with pytest.raises(ValueError):
        codec("zip")
