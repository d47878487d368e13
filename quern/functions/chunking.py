"""Content-defined chunking, float coding and key routing: what needs sequential state or raw bits."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The generator of the gear table, and the default chunk bounds and cut mask.
GEAR_SEED, GEAR_FACTOR, GEAR_STEP = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407
MIN_CHUNK, MAX_CHUNK, CUT_MASK = 32 * 1024, 512 * 1024, 0x1FFFF


def gear_table() -> np.ndarray:
    out, x = [], GEAR_SEED
    for _ in range(256):
        x = (x * GEAR_FACTOR + GEAR_STEP) % (1 << 64)
        out.append(x)
    return np.array(out, np.uint64)


GEAR = gear_table()


def cut_points(data: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask: int = CUT_MASK) -> list[int]:
    """Ends of the segments. A segment ends after the byte where the rolling hash, begun `least` bytes into it, has no
    bit of the mask; at `most` bytes; or with the data.

    Only as many last bytes as the mask has bits reach into masked bits, so all hashes are sums over shifted views.
    """
    n, reach = len(data), mask.bit_length()
    gear = GEAR[np.frombuffer(data, np.uint8)]

    def hashes(begin: int, end: int) -> np.ndarray:
        out = np.zeros(end - begin, np.uint64)
        for k in range(min(reach, end - begin)):
            out[k:] += gear[begin : end - k] << np.uint64(k)
        return out

    ends, start = [], 0
    while start < n:
        if n - start <= least:
            ends.append(n)
            break
        stop = start + min(n - start, most)
        cut = np.flatnonzero(hashes(start + least, stop) & np.uint64(mask) == 0)
        ends.append(start + least + int(cut[0]) + 1 if len(cut) else stop)
        start = ends[-1]
    return ends


def segments(rows: DataFrame, id_col: str, data_col: str, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask: int = CUT_MASK) -> DataFrame:
    """id, ord, begin, len, content_hash (xxh3-128, hexadecimal), payload of each segment; none for empty or null data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ends = cut_points(data or b"", least, most, mask)
                parts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
                yield pa.record_batch({
                    "id": pa.array([key] * len(parts), batch[0].type), "ord": pa.array(range(len(parts)), pa.int32()), "begin": pa.array([0, *ends[:-1]][: len(parts)], pa.int64()),
                    "len": pa.array(map(len, parts), pa.int32()), "content_hash": pa.array([xxhash.xxh3_128_hexdigest(p) for p in parts], pa.string()), "payload": pa.array(parts, pa.binary()),
                })

    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("data"))
    return out.mapInArrow(run, f"id {kind}, ord int, begin long, len int, content_hash string, payload binary").withColumnRenamed("id", id_col)


def shard_of(key: Column, shards: int) -> Column:
    """xxh64 with seed 0 of the key, unsigned, modulo the shards."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: xxhash.xxh64_intdigest((k or "").encode()) % shards if shards > 1 else 0)

    return run(key)


class _Bits:
    """Bits, most significant first."""

    def __init__(self, data: bytes = b""):
        self.value, self.size, self.data, self.at = 0, 0, data, 0

    def put(self, x: int, n: int) -> None:
        self.value, self.size = (self.value << n) | x, self.size + n

    def done(self) -> bytes:
        pad = -self.size % 8
        return (self.value << pad).to_bytes((self.size + pad) // 8, "big")

    def take(self, n: int) -> int:
        first, last = self.at // 8, (self.at + n + 7) // 8
        word = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)


RING = 128


def _flush(chunks: list[_Bits]) -> bytes:
    whole = _Bits()
    for c in chunks:
        whole.put(c.value, c.size)
    return whole.done()


def xor_encode(data: bytes, width: int) -> bytes:
    """Lossless coding of float bits by XOR with the previous value or, where that leaves more leading zeros, with one
    of the last 128. A count precedes the bits; bits are kept exactly, NaN payloads included."""
    values = np.frombuffer(data, f"<u{width}").tolist()
    full = 8 * width
    bits, blocks = _Bits(), []
    ring: list[int] = []
    window = (-1, -1)
    zeros = lambda x: full - x.bit_length()
    for i, v in enumerate(values):
        if not i:
            bits.put(v, full)
        else:
            before = ring[(i - 1) % RING]
            base, head = before, (1, 1)
            if v == before:
                bits.put(0, 2)
                base = None
            else:
                best = max(range(len(ring)), key=lambda k: zeros(v ^ ring[k]))
                if zeros(v ^ ring[best]) > zeros(v ^ before):
                    base, head = ring[best], ((1 << 7) | best, 9)
            if base is not None:
                bits.put(*head)
                x = v ^ base
                lead, trail = zeros(x), (x & -x).bit_length() - 1 if x else 0
                if (lead, trail) == window:
                    bits.put(0, 1)
                else:
                    bits.put((1 << 12) | (min(lead, 63) << 6) | trail, 13)
                    window = (lead, trail)
                keep = full - min(lead, 63) - trail
                bits.put(x >> trail, max(0, keep))
        if i < RING:
            ring.append(v)
        else:
            ring[i % RING] = v
        if bits.size > 1 << 14:
            blocks.append(bits)
            bits = _Bits()
    return struct.pack("<I", len(values)) + _flush([*blocks, bits])


def xor_decode(code: bytes, width: int) -> bytes:
    return xor_decoded_part(code, width)[0]


def xor_decoded_part(code: bytes, width: int) -> tuple[bytes, int]:
    """The values' bytes, and how many bytes of `code` they took."""
    n = struct.unpack_from("<I", code)[0]
    bits, full, ring, window, out = _Bits(code[4:]), 8 * width, [], (0, 0), []
    for i in range(n):
        if not i:
            v = bits.take(full)
        else:
            base = ring[(i - 1) % RING]
            if bits.take(1):
                same = False
            elif bits.take(1):
                base, same = ring[bits.take(7)], False
            else:
                same = True
            v = base
            if not same:
                if bits.take(1):
                    window = (bits.take(6), bits.take(6))
                lead, trail = window
                v = base ^ (bits.take(max(0, full - min(lead, 63) - trail)) << trail)
        if i < RING:
            ring.append(v)
        else:
            ring[i % RING] = v
        out.append(v)
    return np.array(out, f"<u{width}").tobytes(), 4 + (bits.at + 7) // 8


def _floats_udf(function, kind: str):
    @F.pandas_udf(kind)
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(function)

    return run


def float_bytes(values: Column) -> Column:
    """array<float> -> its little-endian bytes."""
    return _floats_udf(lambda x: np.asarray(x, "<f4").tobytes(), "binary")(values)


def bytes_floats(data: Column) -> Column:
    return _floats_udf(lambda x: np.frombuffer(x, "<f4").tolist(), "array<float>")(data)


def xor_encoded(data: Column, width: int = 4) -> Column:
    return _floats_udf(lambda x: xor_encode(x, width), "binary")(data)


def xor_decoded(code: Column, width: int = 4) -> Column:
    return _floats_udf(lambda x: xor_decode(x, width), "binary")(code)


def element_values(data: bytes, dtype: str) -> list:
    """The elements of little-endian bytes as Python values; bfloat16 widens to float32."""
    from ..schema import DTYPES, InvalidDType

    if dtype not in DTYPES:
        raise InvalidDType(dtype)
    raw = np.frombuffer(data, DTYPES[dtype].numpy)
    return ((raw.astype(np.uint32) << 16).view(np.float32) if dtype == "bfloat16" else raw).tolist()
