"""Compressed chunks: block frames with byte shuffling, gzip and zlib streams, and the checksum of shard indexes.

The frame layout follows the public format description; interoperation with frames of other writers could
not be tried offline, but the tests hold hand-made frames of several blocks and streams.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

#: Fixed values of the frame format: flags, and the codes of the compressors in the flags' top bits.
SHUFFLED, COPIED, BIT_SHUFFLED, UNSPLIT = 0x1, 0x2, 0x4, 0x10
CODES = {"blosclz": 0, "lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}
HEADER, VERSION, STREAM_VERSION = 16, 2, 1
#: A block is split into a stream for each byte of an element only up to this size of elements and from this many bytes on.
MOST_SPLIT, LEAST_SPLIT = 16, 128


class CodecError(ValueError):
    pass


def _shuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size * size
    return np.frombuffer(data, np.uint8, n).reshape(-1, size).T.tobytes() + data[n:]


def _unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size * size
    return np.frombuffer(data, np.uint8, n).reshape(size, -1).T.tobytes() + data[n:]


def _bit_unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size // 8 * 8
    if not n:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size), bitorder="little").reshape(size * 8, n)
    return np.packbits(bits.T.reshape(-1), bitorder="little").tobytes() + data[n * size :]


def _compress(data: bytes, cname: str, level: int) -> bytes | None:
    """One stream, or None where the codec is only ever stored."""
    if cname == "lz4":
        return pa.Codec("lz4_raw").compress(data, asbytes=True)
    if cname == "lz4hc":
        return pa.Codec("lz4_raw", compression_level=min(12, max(2, level + 3))).compress(data, asbytes=True)
    if cname == "zlib":
        return zlib.compress(data, level)
    if cname == "zstd":
        return zstandard.ZstdCompressor(level=max(1, 2 * level - 1) if level < 9 else 22, write_content_size=True).compress(data)
    if cname == "blosclz":
        return _matched(data)
    return None


#: Fixed values of the LZ77 streams of code 0: shortest match, longest near distance less one, longest literal run.
SHORTEST, NEAR, LITERALS = 3, 8191, 32


def _matched(data: bytes) -> bytes | None:
    """Encode as code 0: the last place with the same four bytes is each position's match.

    Positions in a row with the same distance are one match, so lengths need no comparison of bytes. A stream
    starts and ends with literals.
    """
    n = len(data)
    if n < 16:
        return None
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    four = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    order = np.argsort(four, kind="stable")
    same = four[order][1:] == four[order][:-1]
    distance = np.zeros(n - 3, np.int64)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    distance[distance > NEAR + (1 << 16)] = 0
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(distance)) + 1, [n - 3]])
    out, done = bytearray(), 0

    def literals(end: int) -> None:
        for a in range(done, end, LITERALS):
            piece = data[a : min(end, a + LITERALS)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for a, b, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), distance[cuts[:-1]].tolist(), strict=True):
        a, end = max(a, done, 1), min(b + 3, n - 2)
        far = d > NEAR
        if not d or end - a < (6 if far else SHORTEST + 1):
            continue
        literals(a)
        more = end - a - SHORTEST
        low = 31 << 8 | 255 if far else d - 1
        out.append((min(more, 6) + 1) << 5 | low >> 8)
        if more >= 6:
            out.extend(b"\xff" * ((more - 6) // 255) + bytes([(more - 6) % 255]))
        out.append(low & 255)
        if far:
            out.extend((d - 1 - NEAR).to_bytes(2, "big"))
        done = end
    literals(n)
    return bytes(out)


def _run_lengths(data: bytes, size: int) -> bytes:
    """Decode the LZ77 streams of code 0: literal runs, and matches of up to 16-bit distances."""
    out, i = bytearray(), 1
    token = data[0] & 31
    while True:
        if token < 32:
            out += data[i : i + token + 1]
            i += token + 1
        else:
            length, distance = (token >> 5) - 1, (token & 31) << 8
            if length == 6:
                while True:
                    length += data[i]
                    i += 1
                    if data[i - 1] != 255:
                        break
            low = data[i]
            i += 1
            if low == 255 and distance == 31 << 8:
                distance = (data[i] << 8) + data[i + 1] + 8191
                i += 2
            else:
                distance += low
            distance, length = distance + 1, length + 3
            if distance > len(out):
                raise CodecError("a match reaches before the start of its block")
            while length > 0:
                piece = out[len(out) - distance :][:length]
                out += piece
                length -= len(piece)
        if i >= len(data):
            break
        token = data[i]
        i += 1
    if len(out) != size:
        raise CodecError(f"a block has {len(out)} bytes instead of {size}")
    return bytes(out)


def _decompress(data: bytes, code: int, size: int) -> bytes:
    try:
        if code == 0:
            return _run_lengths(data, size)
        if code == 1:
            return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)
        if code == 2:
            return pa.Codec("snappy").decompress(data, size, asbytes=True)
        if code == 3:
            return zlib.decompress(data)
        if code == 4:
            return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    except (pa.ArrowException, zlib.error, zstandard.ZstdError, OSError, IndexError) as e:
        raise CodecError(f"a block cannot be decompressed: {e}") from e
    raise CodecError(f"unknown compressor code {code}")


def frame(data: bytes, cname: str, level: int, size: int) -> bytes:
    """One frame of one block, bytes of elements shuffled; stored as it is where that is not longer."""
    code = CODES[cname] << 5
    packed = _compress(_shuffle(data, size) if size > 1 else data, cname, level) if level > 0 and data else None
    if packed is not None and len(packed) + 8 < len(data):
        body = struct.pack("<ii", HEADER + 4, len(packed)) + packed
        flags = SHUFFLED | UNSPLIT | code
    else:
        body, flags = data, COPIED | UNSPLIT | code
    return struct.pack("<BBBBIII", VERSION, STREAM_VERSION, flags, size, len(data), len(data), HEADER + len(body)) + body


def unframe(data: bytes) -> bytes:
    if len(data) < HEADER:
        raise CodecError("a frame is shorter than its header")
    _, _, flags, size, n, block, whole = struct.unpack_from("<BBBBIII", data)
    if whole > len(data) or whole < HEADER:
        raise CodecError(f"a frame has {len(data)} bytes instead of {whole}")
    if flags & COPIED:
        if whole - HEADER < n:
            raise CodecError("a stored frame is too short")
        return data[HEADER : HEADER + n]
    if n and not block:
        raise CodecError("a frame has blocks of no bytes")
    out = []
    for i in range(-(-n // block) if n else 0):
        length = min(block, n - i * block)
        (at,) = struct.unpack_from("<i", data, HEADER + 4 * i)
        split = not flags & UNSPLIT and 1 < size <= MOST_SPLIT and length == block and block // size >= LEAST_SPLIT
        streams = size if split else 1
        each, parts = length // streams, []
        for _ in range(streams):
            if not 0 < at <= whole - 4:
                raise CodecError("a stream lies outside its frame")
            (packed,) = struct.unpack_from("<i", data, at)
            piece = data[at + 4 : at + 4 + packed]
            if packed < 0 or len(piece) != packed:
                raise CodecError("a stream is cut off")
            parts.append(piece if packed == each else _decompress(piece, flags >> 5, each))
            at += 4 + packed
        whole_block = b"".join(parts)
        if len(whole_block) != length:
            raise CodecError(f"a block has {len(whole_block)} bytes instead of {length}")
        if flags & SHUFFLED and size > 1:
            whole_block = _unshuffle(whole_block, size)
        elif flags & BIT_SHUFFLED:
            whole_block = _bit_unshuffle(whole_block, size)
        out.append(whole_block)
    return b"".join(out)


def inflate(data: bytes) -> bytes:
    """All members of a gzip or zlib stream, one after another."""
    out = []
    while data:
        stream = zlib.decompressobj(47)
        try:
            out.append(stream.decompress(data))
            out.append(stream.flush())
        except zlib.error as e:
            raise CodecError(str(e)) from e
        if not stream.eof:
            raise CodecError("a compressed stream is cut off")
        data = stream.unused_data
    return b"".join(out)


def encode(data: bytes, cname: str, level: int, size: int) -> bytes:
    if cname == "gzip":
        stream = zlib.compressobj(level, wbits=31)
        return stream.compress(data) + stream.flush()
    if cname == "zlib-stream":
        return zlib.compress(data, level)
    return frame(data, cname, level, size)


def decode(data: bytes, cname: str, size: int) -> bytes:
    """The cells of a chunk, which must have exactly size bytes."""
    out = inflate(data) if cname in ("gzip", "zlib-stream") else unframe(data)
    if len(out) != size:
        raise CodecError(f"a chunk has {len(out)} bytes instead of {size}")
    return out


def _crc_table(polynomial: int = 0x82F63B78) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (polynomial if i & 1 else 0)
        out.append(i)
    return out


_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


NO_CHUNK = (1 << 64) - 1


def join_shard(chunks: list[bytes | None]) -> bytes:
    """A shard file: the inner chunks in order, then their offsets and sizes and a checksum of these."""
    index, at = [], 0
    for c in chunks:
        index += [NO_CHUNK, NO_CHUNK] if c is None else [at, len(c)]
        at += len(c or b"")
    footer = struct.pack(f"<{len(index)}Q", *index)
    return b"".join(c for c in chunks if c is not None) + footer + struct.pack("<I", crc32c(footer))


def shard_index(footer: bytes, n: int) -> list[tuple[int, int] | None]:
    """Offsets and sizes of n inner chunks, None for those that are not there."""
    if len(footer) != 16 * n + 4 or crc32c(footer[:-4]) != struct.unpack("<I", footer[-4:])[0]:
        raise CodecError("the checksum of a shard's index is wrong")
    values = struct.unpack(f"<{2 * n}Q", footer[:-4])
    return [None if values[2 * i] == NO_CHUNK and values[2 * i + 1] == NO_CHUNK else (values[2 * i], values[2 * i + 1]) for i in range(n)]
