"""What the operators share: words, hashes, folds and bounded batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..scratch import Scratch as Scratch

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"
#: A maximal run of anything else.
WORD = rf"[^{SPACE}]+"


def ship(module: str) -> None:
    """Send what `module` defines to Python workers by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


#: Bytes of an Arrow batch that goes to a Python worker, about; one row at least.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of at most BATCH_BYTES to Python workers (Spark's own bound is 64 MB)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_by_user = spark.conf.get(name, str(1 << 26))
    if set_by_user.isdigit() and int(set_by_user) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Broadcasts whose copies executors may keep; older ones are sent again should they be needed after all.
BROADCASTS_KEPT = 4
_SENT: list[Broadcast] = []


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value; executors drop the copies of earlier calls, which Spark would keep until the driver collects."""
    context = spark.sparkContext
    _SENT.append(context.broadcast(value))
    while len(_SENT) > BROADCASTS_KEPT:
        old = _SENT.pop(0)
        if getattr(old, "_sc", None) is context:
            old.unpersist()
    return _SENT[-1]


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives freed memory back; Spark keeps idle workers, and these what they had freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def quoted(name: str) -> Column:
    """A column by its name as it is, with dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str | Column = "text") -> Column:
    """The text, or the empty string for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(column: str, modulus: int, value: int) -> Column:
    """Whether crc32 of the id as text leaves `value` by `modulus`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == value


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    sums, begin, base = np.cumsum(sizes), 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sums, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin, base = end, int(sums[end - 1])


def row_blocks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with about `limit` bytes in a string column each; one row at least."""
    return _parts(batch, pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64), limit)


def list_blocks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same by the elements of a list column."""
    return _parts(batch, pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64), limit)


#: Words whose hashes a task remembers.
WORDS_KEPT = 1 << 17


class WordHashes(dict):
    """Hashes of words; forgets all once it holds WORDS_KEPT."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close inputs give unrelated values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
