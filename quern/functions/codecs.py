"""Block codecs as column functions: LZ4, zstd with and without a trained dictionary, XOR float coding, and their choice
by name together with a filter; float narrowing.

LZ4 and zstd of whole tables are Parquet options (`lz4_raw`, `zstd`); these functions are for payloads as values.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesfn, chunking

#: Samples that a dictionary is trained on at most, and bytes of each; training happens on the driver.
MAX_SAMPLES, MAX_SAMPLE_BYTES = 2000, 64 * 1024


def _dictionary(data: bytes | None) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def zstd(data: Column, level: int = 3, dictionary: bytes | None = None) -> Column:
    """Levels are clamped to 1..22; null stays null."""

    @F.pandas_udf("binary")
    def run(parts: pd.Series) -> pd.Series:
        codec = zstandard.ZstdCompressor(level=min(22, max(1, level)), dict_data=_dictionary(dictionary))
        return parts.map(lambda x: None if x is None else codec.compress(x))

    return run(data)


def unzstd(code: Column, dictionary: bytes | None = None) -> Column:
    @F.pandas_udf("binary")
    def run(parts: pd.Series) -> pd.Series:
        codec = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        return parts.map(lambda x: None if x is None else codec.decompress(x))

    return run(code)


def lz4_of(data: bytes) -> bytes:
    """One LZ4 block after its plain size (4 bytes, little-endian)."""
    return struct.pack("<I", len(data)) + (pa.compress(data, codec="lz4_raw", asbytes=True) if data else b"")


def unlz4_of(code: bytes) -> bytes:
    size = struct.unpack_from("<I", code)[0]
    out = pa.decompress(code[4:], size, codec="lz4_raw", asbytes=True) if size else b""
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes where {size} were coded")
    return out


def _plain(data: bytes, width: int, level: int) -> bytes:
    return data


#: Filters and codecs by name: (there, back), over bytes and the width of their elements.
FILTERS = {
    "none": (lambda x, w: x, lambda x, w: x),
    "byte_shuffle": (bytesfn.byte_shuffle_of, bytesfn.byte_unshuffle_of),
    "bit_shuffle": (lambda x, w: bytesfn.bit_shuffle_of(x), lambda x, w: bytesfn.bit_unshuffle_of(x)),
    "delta_zigzag": (bytesfn.zigzag_bytes, bytesfn.unzigzag_bytes),
}
CODECS = {
    "raw": (_plain, _plain),
    "none": (_plain, _plain),
    "lz4": (lambda x, w, level: lz4_of(x), lambda x, w, level: unlz4_of(x)),
    "zstd": (lambda x, w, level: zstandard.ZstdCompressor(level=min(22, max(1, level))).compress(x), lambda x, w, level: zstandard.ZstdDecompressor().decompress(x)),
    "chimp": (lambda x, w, level: chunking.xor_encode(x[: len(x) // w * w], w) + x[len(x) // w * w :], lambda x, w, level: _unxor(x, w)),
}


def _unxor(code: bytes, width: int) -> bytes:
    """A tail shorter than an element follows the coded bits as it is, and so is told by its place at the end."""
    out, used = chunking.xor_decoded_part(code, width)
    return out + code[used:]


def encode_block(data: bytes, codec: str, filt: str = "none", width: int = 1, level: int = 3) -> bytes:
    """Filter, then codec; an unknown name is an error."""
    return CODECS[codec][0](FILTERS[filt][0](data, width), width, level)


def decode_block(code: bytes, codec: str, filt: str = "none", width: int = 1) -> bytes:
    return FILTERS[filt][1](CODECS[codec][1](code, width, 0), width)


def _blocks(function, data: Column, *names: Column) -> Column:
    @F.pandas_udf("binary")
    def run(parts: pd.Series, *how: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(x, *h) for x, *h in zip(parts, *how, strict=True)], dtype=object)

    return run(data, *names)


def encoded(data: Column, codec: Column, filt: Column, width: Column, level: Column) -> Column:
    """Each row by its own codec and filter; null stays null."""
    return _blocks(encode_block, data, codec, filt, width, level)


def decoded(code: Column, codec: Column, filt: Column, width: Column) -> Column:
    return _blocks(decode_block, code, codec, filt, width)


def filtered(data: Column, filt: Column, width: Column) -> Column:
    """The filters alone, by name."""
    return _blocks(lambda x, f, w: FILTERS[f][0](x, w), data, filt, width)


def monotonic_of(data: bytes, width: int) -> bool:
    """bytesfn.monotonic_trend over the first 64 integers."""
    x = [int(v) for v in np.frombuffer(data[: 64 * width // width * width], f"<i{width}", min(64, len(data) // width))]
    return len(x) >= 8 and sum(0 <= b - a < 1000 for a, b in zip(x, x[1:])) > len(x) * 3 // 4


def picked(data: Column, width: Column, is_float: Column) -> Column:
    """struct(codec, filter, level) of bytesfn.auto_select for a sample of each payload."""

    @F.pandas_udf("correlated boolean, monotonic boolean")
    def looked(parts: pd.Series, widths: pd.Series, floats: pd.Series) -> pd.DataFrame:
        rows = []
        for x, w, f in zip(parts, widths, floats, strict=True):
            x = x or b""
            bits = np.frombuffer(x, f"<u{w}", min(64, len(x) // w)).astype(np.uint64) if f and w in (4, 8) else np.zeros(0, np.uint64)
            rows.append((bytesfn.correlated_of(bits, w), not f and monotonic_of(x, w)))
        return pd.DataFrame(rows, columns=["correlated", "monotonic"])

    seen = looked(F.substring(data, 1, 4096), width, is_float)
    return bytesfn.auto_select(F.octet_length(data) == 0, F.lit(0.0), is_float, seen["correlated"], seen["monotonic"], bytesfn.entropy(data, 4096))


def train_dictionary(payloads: DataFrame, column: str, size: int) -> bytes:
    """A dictionary of at most `size` bytes from a bounded sample, evenly by content hash; no payload is an error."""
    data = F.col(column).cast("binary")
    rows = payloads.select(F.substring(data, 1, MAX_SAMPLE_BYTES).alias("x")).filter("x IS NOT NULL").orderBy(F.xxhash64("x")).limit(MAX_SAMPLES).collect()
    if not rows:
        raise ValueError("no samples")
    return zstandard.train_dictionary(size, [bytes(r["x"]) for r in rows]).as_bytes()


def signature(data: bytes) -> int:
    """xxh64 of a dictionary, or of a dtype with its shape written as bytes."""
    return xxhash.xxh64_intdigest(data)


def narrow_half(values: np.ndarray) -> np.ndarray:
    """float32 to float16 bits: mantissas are cut, subnormal results become zero, too large ones infinite."""
    bits = values.astype("<f4").view("<u4")
    sign, exponent, mantissa = (bits >> 16) & 0x8000, ((bits >> 23) & 0xFF).astype(np.int32) - 112, (bits >> 13) & 0x3FF
    normal = (exponent << 10).astype(np.uint32) | mantissa
    special = ((bits >> 23) & 0xFF) == 0xFF
    out = np.where(exponent <= 0, 0, np.where(exponent >= 31, 0x7C00, normal))
    return (sign | np.where(special & ((bits & 0x7FFFFF) != 0), 0x7E00, out)).astype("<u2")


def narrow_brain(values: np.ndarray) -> np.ndarray:
    """float32 to bfloat16 bits: the low half is cut."""
    return (values.astype("<f4").view("<u4") >> 16).astype("<u2")


def narrowed(values: Column, kind: str) -> Column:
    """An array of float32 -> the bits of float16 ("half") or bfloat16 ("brain"); a whole batch at a time."""
    narrow = {"half": narrow_half, "brain": narrow_brain}[kind]

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        sizes = rows.map(lambda x: 0 if x is None else len(x)).to_numpy()
        bits = narrow(np.concatenate([np.zeros(0, np.float32), *(x for x in rows if x is not None)])).astype(np.int32)
        parts = np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else []
        return pd.Series([None if x is None else part for x, part in zip(rows, parts, strict=True)], dtype=object)

    return run(values)
