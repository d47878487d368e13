"""Table schemas, element types and errors of the archive model.

An archive is an append-only log of keyed writes (`log`), whose payloads are cut into content-addressed chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "ints": T.ArrayType(T.IntegerType()), "time": T.TimestampNTZType()}


def struct(fields: str) -> T.StructType:
    """A struct from "name type, ..."; unlike a DDL string it needs no session."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


ATTR = struct("t string, s string, i bigint, f double, b boolean, y binary")
ATTRS = T.MapType(T.StringType(), ATTR)
#: One chunk of a payload: its place, its content address and its length.
REF = struct("ord int, content_hash string, len int")

LOG = struct("seq bigint, key string, op string, dtype string, shape ints").add("attrs", ATTRS).add("retain", "string").add("data", "binary")
TOC = T.StructType([f for f in LOG.fields if f.name != "data"]).add("refs", T.ArrayType(REF)).add("committed_at", T.TimestampNTZType())
#: `len` counts plain bytes; `crc32` is of the payload as stored, which codec, filter and the elements' width describe.
CHUNKS = struct("content_hash string, len int, crc32 bigint, payload binary, codec string, filter string, width int")

#: An attribute's largest value in bytes; a checkpoint's bytes and seconds; parts of a default archive.
MAX_ATTR_BYTES, CHECKPOINT_BYTES, CHECKPOINT_SECONDS, DEFAULT_SHARDS = 4096, 64 * 1024 * 1024, 60, 4


@dataclass(frozen=True)
class DType:
    """Id, width in bytes, the numpy type of the little-endian bytes, the Spark type of an element."""

    id: int
    width: int
    numpy: str
    spark: T.DataType


DTYPES = {
    "float64": DType(0, 8, "<f8", T.DoubleType()),
    "float32": DType(1, 4, "<f4", T.FloatType()),
    "float16": DType(2, 2, "<f2", T.FloatType()),
    "bfloat16": DType(3, 2, "<u2", T.FloatType()),
    "int64": DType(4, 8, "<i8", T.LongType()),
    "int32": DType(5, 4, "<i4", T.IntegerType()),
    "int16": DType(6, 2, "<i2", T.ShortType()),
    "int8": DType(7, 1, "i1", T.ByteType()),
    "uint64": DType(8, 8, "<u8", T.DecimalType(20, 0)),
    "uint32": DType(9, 4, "<u4", T.LongType()),
    "uint16": DType(10, 2, "<u2", T.IntegerType()),
    "uint8": DType(11, 1, "u1", T.ShortType()),
    "bool": DType(12, 1, "?", T.BooleanType()),
}


class ArchiveError(Exception):
    """Any error of an archive."""


class KeyNotFound(ArchiveError, KeyError):
    pass


class VersionNotFound(ArchiveError, KeyError):
    pass


class AlreadyLocked(ArchiveError):
    pass


class ReadOnly(ArchiveError):
    pass


class ChunkCorrupted(ArchiveError):
    pass


class AttrTooLarge(ArchiveError, ValueError):
    pass


class InvalidDType(ArchiveError, ValueError):
    pass
