"""A dictionary of numpy arrays over an archive, and one-line helpers. Values come to the driver one call at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.models import BATCH_BYTES, BATCH_ITEMS
from ..schema import DTYPES, InvalidDType, KeyNotFound
from .archive import Archive


def array_of(row) -> np.ndarray:
    """bfloat16 widens to float32."""
    raw = np.frombuffer(bytes(row["data"]), DTYPES[row["dtype"]].numpy)
    if row["dtype"] == "bfloat16":
        raw = (raw.astype(np.uint32) << 16).view(np.float32)
    return raw.reshape(tuple(row["shape"])).copy()


def parts_of(value: object) -> tuple[bytes, str, list[int]]:
    if isinstance(value, (bytes, bytearray)):
        return bytes(value), "uint8", [len(value)]
    x = np.asarray(value)
    name = x.dtype.name
    if name not in DTYPES:
        raise InvalidDType(name)
    return np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes(), name, list(x.shape)


class Database:
    def __init__(self, spark: SparkSession, path: str, mode: str = "a", **ignored: object):
        """Tuning arguments of other engines are accepted and have no effect."""
        self.archive = Archive(spark, path, mode)

    def put(self, key: str, value: object, attrs: Mapping[str, object] | None = None, retain: str = "keep_latest") -> None:
        data, dtype, shape = parts_of(value)
        self.archive.put(key, data, dtype, shape, attrs, retain)

    def put_batch(self, items: Mapping[str, object] | Iterable[tuple[str, object]], auto_route: bool = True) -> None:
        """A dictionary, or pairs of key and value, of which the last of a key counts. One way serves batches of any size,
        so that there is nothing to route; `models.vectorised_batch` tells what a router would say."""
        for key, value in items.items() if isinstance(items, Mapping) else items:
            self.put(key, value)

    def get(self, key: str) -> np.ndarray | None:
        row = self.archive.get(key).first()
        return None if row is None else array_of(row)

    def get_batch(self, keys: list[str]) -> dict[str, np.ndarray]:
        return {r["key"]: array_of(r) for r in self.archive.get_batch(list(keys)).collect()}

    def get_prefix(self, start: str) -> dict[str, np.ndarray]:
        return {r["key"]: array_of(r) for r in self.archive.get_prefix(start).collect()}

    def get_version(self, key: str, version: int) -> np.ndarray:
        return array_of(self.archive.get_version(key, version).first())

    def delete(self, key: str) -> None:
        self.archive.delete(key)

    def keys(self) -> list[str]:
        return self.archive.keys()

    def __getattr__(self, name: str):
        return getattr(self.archive, name)

    def __setitem__(self, key: str, value: object) -> None:
        self.put(key, value)

    def __getitem__(self, key: str) -> np.ndarray:
        found = self.get(key)
        if found is None:
            raise KeyNotFound(key)
        return found

    def __delitem__(self, key: str) -> None:
        self[key]
        self.delete(key)

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __len__(self) -> int:
        return len(self.keys())

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def items(self) -> list[tuple[str, np.ndarray]]:
        return list(self.get_batch(self.keys()).items())

    def values(self) -> list[np.ndarray]:
        return [v for _, v in self.items()]

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.archive.close()

    write = save = serialize_tensor = put
    read = load = fetch_tensor = get
    read_prefix = get_prefix

    def sync(self) -> None:
        self.archive.flush()

    def shutdown(self) -> None:
        self.archive.close()

    terminate = shutdown


class BatchReader:
    """Batch reads that keep the last HISTORY requests, and what was learned from all: the last key after two others."""

    HISTORY = 32

    def __init__(self, db: Database):
        self.db, self.requests, self.learned = db, [], {}

    def get_batch(self, keys: list[str]) -> dict[str, np.ndarray]:
        self.requests = [*self.requests, list(keys)][-self.HISTORY :]
        self.learned.update(((a, b), c) for a, b, c in zip(keys, keys[1:], keys[2:]))
        return self.db.get_batch(keys)

    def access(self) -> DataFrame:
        rows = [(b, p, k) for b, request in enumerate(self.requests) for p, k in enumerate(request)]
        return self.db.archive.spark.createDataFrame(rows, "batch long, pos long, key string")

    def predict_next(self, first: str, second: str) -> str | None:
        return self.learned.get((first, second))


def open(spark: SparkSession, path: str, mode: str = "a", **ignored: object) -> Database:
    return Database(spark, path, mode, **ignored)


def save(spark: SparkSession, path: str, value: object, key: str | None = None) -> None:
    """A dictionary under its keys, anything else under `key` or "data"."""
    with Database(spark, path, "a") as db:
        db.put_batch(value if isinstance(value, Mapping) else {key or "data": value})


def load(spark: SparkSession, path: str, key: str | None = None):
    with Database(spark, path, "r") as db:
        return db[key] if key is not None else dict(db.items())


def keys(spark: SparkSession, path: str) -> list[str]:
    with Database(spark, path, "r") as db:
        return db.keys()


def info(spark: SparkSession, path: str) -> dict[str, object]:
    with Database(spark, path, "r") as db:
        names = db.keys()
        size = db.archive.chunks().selectExpr("coalesce(sum(len), 0)").first()[0]
    return {"path": path, "count": len(names), "keys": names, "size_bytes": size, "size_mb": round(size / 1024 / 1024, 2)}


save_file, load_file = save, load


def import_npz(spark: SparkSession, path: str, file: str) -> None:
    with np.load(file) as arrays:
        save(spark, path, dict(arrays))


def capabilities(spark: SparkSession) -> dict[str, object]:
    return {"engine": "spark", "version": spark.version, "parallelism": spark.sparkContext.defaultParallelism, "vectorised_from": {"bytes": BATCH_BYTES, "items": BATCH_ITEMS}}
