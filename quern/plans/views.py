"""Relational views of a write log: DataFrame in, DataFrame out.

A log has the columns seq (unique, ascending), key, op ('put' or 'delete') and whatever describes the write. The views
that need no order inside a key are aggregates with map-side combination (`latest`), so that a key with most of the
rows costs its partial results only. Version numbers are ranks inside a key and take a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DTYPES

#: Keys of a request that are sent to all executors; longer requests are joined by key.
MOST_BROADCAST = 100_000


def latest(log: DataFrame) -> DataFrame:
    """The last write of each live key: a key is live if its last row is a put."""
    rest = [c for c in log.columns if c != "key"]
    last = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("last"))
    return last.filter(F.col("last.op") == "put").select("key", *(F.col(f"last.{c}").alias(c) for c in rest))


def get(log: DataFrame, key: str) -> DataFrame:
    return latest(log.filter(F.col("key") == key))


def get_batch(log: DataFrame, keys: list[str]) -> DataFrame:
    """The keys' live values with `pos`, the place in the request; missing keys are left out, repeated ones repeat."""
    asked = log.sparkSession.createDataFrame(list(enumerate(keys)), "pos long, key string")
    small = F.broadcast if len(keys) <= MOST_BROADCAST else lambda df: df
    wanted = log.filter(F.col("key").isin(*set(keys))) if len(keys) <= 100 else log.join(small(asked.select("key").distinct()), "key", "left_semi")
    return small(asked).join(latest(wanted), "key")


def prefix(log: DataFrame, start: str) -> DataFrame:
    """Live values whose key begins with `start`; the filter is pushed down to the scan."""
    return latest(log.filter(F.col("key").startswith(start)) if start else log)


def live_keys(log: DataFrame) -> DataFrame:
    """key, seq of live keys; the empty key is not listed. Their order is that of seq."""
    return latest(log.select("key", "seq", "op")).filter("key <> ''").select("key", "seq")


def versions(log: DataFrame) -> DataFrame:
    """Puts with generation (deletes of the key before) and version (from 0 in each generation)."""
    order = Window.partitionBy("key").orderBy("seq")
    marked = log.withColumn("generation", F.sum((F.col("op") == "delete").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    puts = marked.filter("op = 'put'")
    return puts.withColumn("version", F.row_number().over(Window.partitionBy("key", "generation").orderBy("seq")) - 1)


def current_versions(log: DataFrame) -> DataFrame:
    """Versions of the last generation of keys that are live."""
    marked = versions(log)
    last = log.groupBy("key").agg(F.max_by("op", "seq").alias("last_op"), F.sum((F.col("op") == "delete").cast("long")).alias("generation")).filter("last_op = 'put'")
    return marked.join(last.select("key", "generation"), ["key", "generation"], "left_semi")


def kept_by(retain: Column) -> Column:
    """How many versions a policy keeps; null: all. Unknown policies keep the latest; a malformed number counts as 1."""
    n = F.regexp_extract(retain, r"^keep_last_n:(.*)$", 1).try_cast("int")
    return F.when(retain == "keep_forever", F.lit(None).cast("int")).when(retain.startswith("keep_last_n:"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))).otherwise(F.lit(1))


def with_survival(log: DataFrame) -> DataFrame:
    """Versions (needs column retain) with `survives`.

    Policies apply at each append, so a looser policy doesn't bring versions back: version v survives if and only if
    n - (j - v) >= 1 for every later append j with its policy's n.
    """
    later = Window.partitionBy("key", "generation").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    slack = F.min(F.coalesce(kept_by(F.col("retain")).cast("long"), F.lit(1 << 60)) - F.col("version")).over(later)
    return current_versions(log).withColumn("survives", slack + F.col("version") >= 1)


def retained(log: DataFrame) -> DataFrame:
    return with_survival(log).filter("survives").drop("survives")


def evicted(log: DataFrame) -> DataFrame:
    return with_survival(log).filter("NOT survives").drop("survives")


def compacted(log: DataFrame, keep: int = 1) -> DataFrame:
    """Live keys with their last `keep` versions."""
    if keep == 1:
        return latest(log)
    return last_versions(current_versions(log), keep)


def last_versions(rows: DataFrame, keep: int) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return rows.withColumn("back", back).filter(F.col("back") <= keep).drop("back")


def diff(left: DataFrame, right: DataFrame, on: str = "content_hash") -> DataFrame:
    """Distinct values only in `right` (added) or only in `left` (removed)."""
    added = right.select(on).distinct().join(left.select(on), on, "left_anti").withColumn("change", F.lit("added"))
    removed = left.select(on).distinct().join(right.select(on), on, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def refcounts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("content_hash").agg(F.count("*").alias("refs"))


def unreferenced(chunks: DataFrame, live_refs: DataFrame) -> DataFrame:
    return chunks.join(live_refs.select("content_hash"), "content_hash", "left_anti")


def new_chunks(batch: DataFrame, store: DataFrame) -> DataFrame:
    """One row for each content of the batch that the store lacks."""
    return batch.groupBy("content_hash").agg(F.min("len").alias("len")).join(store.select("content_hash"), "content_hash", "left_anti")


def dedup_stats(refs: DataFrame) -> DataFrame:
    """refs (seq, key, content_hash, len) -> one row of totals, shared bytes and hits.

    A reference other than a content's first is a hit: a version hit if the content has the same key as at first.
    """
    first = refs.groupBy("content_hash").agg(F.min_by("key", "seq").alias("first_key"), F.min("seq").alias("first_seq"), F.max("len").alias("unique_len"))
    hit = refs.join(first, "content_hash").select("len", (F.col("seq") > F.col("first_seq")).alias("hit"), (F.col("key") == F.col("first_key")).alias("same"))
    totals = hit.agg(
        F.count("*").alias("total_segments"), F.coalesce(F.sum("len"), F.lit(0)).alias("logical_bytes"), F.count_if(F.col("hit") & F.col("same")).alias("cross_version_hits"), F.count_if(F.col("hit") & ~F.col("same")).alias("cross_key_hits")
    )
    unique = first.agg(F.count("*").alias("unique_segments"), F.coalesce(F.sum("unique_len"), F.lit(0)).alias("physical_bytes"))
    return totals.join(F.broadcast(unique)).withColumn("ratio", F.round(F.when(F.col("physical_bytes") > 0, F.col("logical_bytes") / F.col("physical_bytes")).otherwise(F.lit(1.0)), 6))


def info(log: DataFrame) -> DataFrame:
    """Entries by state: an entry is tombstoned if its key was deleted after it."""
    fate = log.groupBy("key").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("deleted"))
    marked = log.filter("op = 'put'").join(fate, "key").select("key", (F.col("deleted").isNull() | (F.col("seq") > F.col("deleted"))).alias("live"))
    return marked.agg(F.count_if("live").alias("live_entries"), F.count_if(~F.col("live")).alias("tombstoned_entries"), F.countDistinct(F.when(F.col("live"), F.col("key"))).alias("live_keys"))


def tree(entries: DataFrame, size: str = "len") -> DataFrame:
    """Roll-up of keys by path prefix: path, depth, keys, bytes."""
    parts = F.split("key", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), k.alias("depth")))
    return entries.select(F.explode(levels).alias("at"), F.col(size).alias("size")).groupBy("at.path", "at.depth").agg(F.count("*").alias("keys"), F.sum("size").alias("bytes"))


def logical_bytes(entries: DataFrame) -> DataFrame:
    """entries (shape, dtype) -> how many, and the bytes that their elements take."""
    widths = F.create_map(*(F.lit(x) for name, kind in DTYPES.items() for x in (name, kind.width)))
    elements = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(elements * widths[F.col("dtype")]), F.lit(0)).alias("logical_bytes"))


def checked(chunks: DataFrame) -> DataFrame:
    """Chunks whose payload doesn't have the stored checksum."""
    return chunks.filter(F.crc32("payload") != F.col("crc32"))
