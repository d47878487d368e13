"""Binary layouts of attributes and of a table of contents, for exchange with other writers of archives.

All numbers are little-endian. An attribute is its key's length (1 byte; longer keys are cut at 255 bytes), the key, a
type, the value's length (2 bytes) and the value; attributes go by key. A table of contents is a count (4 bytes) and, for
each entry: hash of the key (8), key with its length (2), dtype (1), dimensions with their number (1, then 4 each),
attributes with their length (4), chunk references with their number (2; each part 2, offset 8, length 4), and whether
the entry is deleted (1).
"""

from __future__ import annotations

import struct
from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DTYPES, MAX_ATTR_BYTES, ArchiveError, AttrTooLarge

Value = str | int | float | bool | bytes
#: Type numbers of attributes.
TYPES = {"string": 0, "int64": 1, "float64": 2, "bool": 3, "bytes": 4}
DTYPE_IDS = {kind.id: name for name, kind in DTYPES.items()}


def _coded(value: Value) -> tuple[int, bytes]:
    for kind, name, code in ((bool, "bool", lambda v: bytes([v])), (int, "int64", lambda v: struct.pack("<q", v)), (float, "float64", lambda v: struct.pack("<d", v)), (str, "string", str.encode)):
        if isinstance(value, kind):
            return TYPES[name], code(value)
    return TYPES["bytes"], bytes(value)


class Reader:
    """Takes fields from a buffer; a field that reaches over its end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ArchiveError(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int | float:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def text(self, n: int) -> str:
        try:
            return self.take(n).decode()
        except UnicodeDecodeError as e:
            raise ArchiveError(str(e)) from e


def attrs_to_bytes(attrs: Mapping[str, Value]) -> bytes:
    out = b""
    for key, value in sorted(attrs.items(), key=lambda x: x[0].encode()):
        name, (kind, body) = key.encode()[:255], _coded(value)
        if len(body) > MAX_ATTR_BYTES:
            raise AttrTooLarge(f"{len(body)} bytes")
        out += struct.pack("<B", len(name)) + name + struct.pack("<BH", kind, len(body)) + body
    return out


def attrs_from_bytes(data: bytes) -> dict[str, Value]:
    """Values of a wrong length or type, and data that end within an attribute, are errors."""
    read, out = Reader(data), {}
    while read.at < len(data):
        key = read.text(read.number("B"))
        kind, size = read.number("B"), read.number("H")
        if size > MAX_ATTR_BYTES:
            raise AttrTooLarge(f"{size} bytes")
        fixed = {TYPES["int64"]: ("q", 8), TYPES["float64"]: ("d", 8), TYPES["bool"]: ("?", 1)}.get(kind)
        if fixed and size != fixed[1] or kind not in TYPES.values():
            raise ArchiveError(f"attribute {key}: type {kind} of {size} bytes")
        out[key] = read.number(fixed[0]) if fixed else read.text(size) if kind == TYPES["string"] else read.take(size)
    return out


@dataclass
class Entry:
    key: str
    dtype: str
    shape: list[int]
    attrs: dict[str, Value] = field(default_factory=dict)
    chunks: list[tuple[int, int, int]] = field(default_factory=list)
    deleted: bool = False


def toc_to_bytes(entries: list[Entry]) -> bytes:
    out = [struct.pack("<I", len(entries))]
    for e in entries:
        key, attrs = e.key.encode(), attrs_to_bytes(e.attrs)
        out += [struct.pack("<QH", xxhash.xxh64_intdigest(key), len(key)), key, struct.pack(f"<BB{len(e.shape)}I", DTYPES[e.dtype].id, len(e.shape), *e.shape), struct.pack("<I", len(attrs)), attrs]
        out += [struct.pack("<H", len(e.chunks)), *(struct.pack("<HQI", *c) for c in e.chunks), bytes([e.deleted])]
    return b"".join(out)


def toc_from_bytes(data: bytes) -> list[Entry]:
    """The hash of a key must be the key's."""
    read = Reader(data)
    out = []
    for _ in range(read.number("I")):
        mark, key = read.number("Q"), read.text(read.number("H"))
        if mark != xxhash.xxh64_intdigest(key.encode()):
            raise ArchiveError(f"hash of {key!r} is another's")
        kind = read.number("B")
        if kind not in DTYPE_IDS:
            raise ArchiveError(f"{key!r} has dtype {kind}")
        shape = [read.number("I") for _ in range(read.number("B"))]
        attrs = attrs_from_bytes(read.take(read.number("I")))
        chunks = [(read.number("H"), read.number("Q"), read.number("I")) for _ in range(read.number("H"))]
        out.append(Entry(key, DTYPE_IDS[kind], shape, attrs, chunks, bool(read.number("B"))))
    return out


def attr_text(attrs: Column) -> Column:
    """A map of strings -> its layout (binary); null for null."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else attrs_to_bytes(dict(x)))

    return run(attrs)


def with_attr(attrs: Column, name: str, value: Column) -> Column:
    """A map of strings with one attribute set; a value that is too large fails the query."""
    fits = F.when(F.octet_length(value) <= MAX_ATTR_BYTES, value).otherwise(F.raise_error(F.concat(F.lit(f"attribute {name} is larger than {MAX_ATTR_BYTES} bytes"))).cast("string"))
    return F.map_concat(without_attr(attrs, name), F.create_map(F.lit(name), fits))


def without_attr(attrs: Column, name: str) -> Column:
    return F.map_filter(F.coalesce(attrs, F.create_map().cast("map<string,string>")), lambda k, _: k != name)


def attr_count(attrs: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(attrs)), F.lit(0))
