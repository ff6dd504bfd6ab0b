from __future__ import annotations

import gzip
import os
import struct
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom import codecs

NAMES = (*("lz4", "lz4hc", "blosclz", "zlib", "zstd"), "gzip", "zlib-stream")


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("size", [1, 2, 4, 8])
def test_round_trip_of_random_and_even_bytes(name, size):
    for data in (b"", os.urandom(size), os.urandom(4096 * size), bytes(4096 * size), np.arange(5000, dtype=f"u{size}").tobytes()):
        packed = codecs.encode(data, name, 5, size)
        assert codecs.decode(packed, name, len(data)) == data
    assert len(codecs.encode(bytes(1 << 16), name, 5, size)) < 1 << 14


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(NAMES), st.sampled_from([1, 2, 4, 8]), st.integers(0, 9))
def test_round_trip_of_anything(data, name, size, level):
    assert codecs.decode(codecs.encode(data, name, level, size), name, len(data)) == data


def test_checksum_has_the_published_check_value():
    assert codecs.crc32c(b"123456789") == 0xE3069283


def test_streams_of_several_members_and_either_header():
    a, b = os.urandom(100), bytes(1000)
    assert codecs.inflate(gzip.compress(a) + gzip.compress(b)) == a + b
    assert codecs.inflate(zlib.compress(a) + gzip.compress(b)) == a + b
    with pytest.raises(codecs.CodecError):
        codecs.inflate(gzip.compress(a)[:-9])


def test_split_blocks_and_bit_shuffle():
    data, block, size = np.arange(3000, dtype="<u4").tobytes(), 4096, 4
    starts, body = [], b""
    n = -(-len(data) // block)
    for i in range(n):
        part = data[i * block : (i + 1) * block]
        shuffled = np.frombuffer(part, np.uint8).reshape(-1, size).T.tobytes()
        starts.append(16 + 4 * n + len(body))
        streams = size if len(part) == block else 1
        each = len(part) // streams
        for k in range(streams):
            packed = zstandard.compress(shuffled[k * each : (k + 1) * each])
            body += struct.pack("<i", len(packed)) + packed
    whole = struct.pack("<BBBBIII", 2, 1, 0x1 | 4 << 5, size, len(data), block, 16 + 4 * n + len(body)) + struct.pack(f"<{n}i", *starts) + body
    assert codecs.unframe(whole) == data
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").reshape(3000, 32)
    shuffled = np.packbits(bits[: 3000 // 8 * 8].T.reshape(-1), bitorder="little").tobytes()
    packed = zlib.compress(shuffled)
    whole = struct.pack("<BBBBIII", 2, 1, 0x4 | 0x10 | 3 << 5, size, len(data), len(data), 24 + len(packed)) + struct.pack("<ii", 20, len(packed)) + packed
    assert codecs.unframe(whole) == data


def test_literal_runs_and_matches():
    literal = bytes([4]) + b"abcde"
    near = bytes([(2 + 1) << 5, 4])  # five bytes from five back
    assert codecs._run_lengths(literal + near, 10) == b"abcdeabcde"
    overlapping = bytes([(6 + 1) << 5, 3, 0])  # twelve bytes from one back
    assert codecs._run_lengths(literal + overlapping, 17) == b"abcde" + b"e" * 12
    with pytest.raises(codecs.CodecError):
        codecs._run_lengths(literal + near, 11)


def test_matches_near_and_far_and_what_does_not_shrink():
    rng = np.random.default_rng(8)
    page = rng.bytes(9000)
    for data in (b"abcdefgh" * 3000, page + page, page + rng.bytes(60_000) + page, rng.integers(0, 3, 50_000).astype("u1").tobytes(), rng.normal(size=4000).round(2).tobytes(), bytes(20), rng.bytes(70_000)):
        packed = codecs._matched(data)
        assert packed[0] < 32 and codecs._run_lengths(packed, len(data)) == data
    assert len(codecs._matched(b"abcdefgh" * 3000)) < 200
    assert len(codecs._matched(page + page)) < 9500
    assert codecs.frame(rng.bytes(5000), "blosclz", 5, 1)[2] & codecs.COPIED
    assert not codecs.frame(b"abcdefgh" * 300, "blosclz", 5, 1)[2] & codecs.COPIED


@pytest.mark.parametrize("name", ["blosclz", "lz4", "snappy", "zlib", "zstd"])
def test_frames_of_several_blocks_streams_and_stored_parts(name):
    """Frames as another writer may lay them out: full blocks split by byte, the last one not, some streams stored."""
    import pyarrow as pa

    pack = {"blosclz": codecs._matched, "lz4": lambda x: pa.Codec("lz4_raw").compress(x, asbytes=True), "snappy": lambda x: pa.Codec("snappy").compress(x, asbytes=True), "zlib": zlib.compress, "zstd": zstandard.compress}[name]
    values = np.cumsum(np.random.default_rng(4).integers(0, 4, 5000)).astype("<u4")
    data, block, size = values.tobytes(), 8192, 4
    n, body, starts = -(-len(data) // block), b"", []
    for i in range(n):
        part = data[i * block : (i + 1) * block]
        shuffled = np.frombuffer(part, np.uint8).reshape(-1, size).T.tobytes()
        starts.append(16 + 4 * n + len(body))
        streams = size if len(part) == block else 1
        each = len(part) // streams
        for k in range(streams):
            plain = shuffled[k * each : (k + 1) * each]
            packed = plain if (i + k) % 3 == 0 else pack(plain)
            packed = plain if len(packed) >= each else packed
            body += struct.pack("<i", len(packed)) + packed
    whole = struct.pack("<BBBBIII", 2, 1, 0x1 | codecs.CODES[name] << 5, size, len(data), block, 16 + 4 * n + len(body)) + struct.pack(f"<{n}i", *starts) + body
    assert codecs.unframe(whole) == data
    stored = struct.pack("<BBBBIII", 2, 1, 0x2 | codecs.CODES[name] << 5, size, len(data), block, 16 + len(data)) + data
    assert codecs.unframe(stored) == data


@pytest.mark.parametrize("change", [lambda f: f[:10], lambda f: f[:-1], lambda f: f[:16] + b"\xff\xff\xff\x7f" + f[20:]])
def test_damaged_frames_raise(change):
    whole = codecs.frame(bytes(4096), "zstd", 5, 2)
    with pytest.raises(codecs.CodecError):
        codecs.unframe(change(whole))


def test_a_chunk_of_the_wrong_size_raises():
    with pytest.raises(codecs.CodecError):
        codecs.decode(codecs.encode(bytes(64), "lz4", 5, 2), "lz4", 128)


def test_shard_index_is_checked():
    chunks = [b"abc", None, b"", b"de"]
    shard = codecs.join_shard(chunks)
    index = codecs.shard_index(shard[-(16 * 4 + 4) :], 4)
    assert index == [(0, 3), None, (3, 0), (3, 2)]
    damaged = bytearray(shard[-(16 * 4 + 4) :])
    damaged[3] ^= 1
    with pytest.raises(codecs.CodecError):
        codecs.shard_index(bytes(damaged), 4)
