"""Access-pattern models and index look-ups as windows and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A batch is worth vectorising from so many bytes and items; window without a segment; latencies kept.
BATCH_BYTES, BATCH_ITEMS, NO_WINDOW, LATENCIES = 2 * 1024 * 1024, 16, (0, 1024), 100


def vectorised_batch(items: Column, size: Column) -> Column:
    return (size >= BATCH_BYTES) & (items >= BATCH_ITEMS)


def next_keys(access: DataFrame, batch: str = "batch", pos: str = "pos", key: str = "key") -> DataFrame:
    """key1, key2 -> the successor recorded last: triples inside a batch, batches in order."""
    order = Window.partitionBy(batch).orderBy(pos)
    triples = access.select(batch, pos, F.col(key).alias("key1"), F.lead(key, 1).over(order).alias("key2"), F.lead(key, 2).over(order).alias("key3")).filter("key3 IS NOT NULL")
    return triples.groupBy("key1", "key2").agg(F.max_by("key3", F.struct(batch, pos)).alias("next_key"))


#: Fixed value: requests that are remembered.
HISTORY = 32


def recent_sequences(access: DataFrame, stream: str, batch: str, pos: str, key: str) -> DataFrame:
    """stream, batch, keys (in order) of the last HISTORY batches of each stream."""
    sequences = access.groupBy(stream, batch).agg(F.array_sort(F.collect_list(F.struct(pos, key))).alias("keys")).withColumn("keys", F.col(f"keys.{key}"))
    back = F.row_number().over(Window.partitionBy(stream).orderBy(F.desc(batch)))
    return sequences.withColumn("back", back).filter(F.col("back") <= HISTORY).drop("back")


def prediction_hits(access: DataFrame, batch: str = "batch", pos: str = "pos", key: str = "key") -> DataFrame:
    """How often the recorded successor is what follows: predictions, hits, hit_rate."""
    order = Window.partitionBy(batch).orderBy(pos)
    triples = access.select(F.col(key).alias("key1"), F.lead(key, 1).over(order).alias("key2"), F.lead(key, 2).over(order).alias("key3")).filter("key3 IS NOT NULL")
    joined = triples.join(next_keys(access, batch, pos, key), ["key1", "key2"])
    return joined.agg(F.count("*").alias("predictions"), F.count_if(F.col("key3") == F.col("next_key")).alias("hits")).withColumn("hit_rate", F.round(F.try_divide("hits", "predictions"), 6))


def prefetch_depth(latencies: DataFrame, rate: float, least: int, most: int, seq: str = "seq", seconds: str = "seconds", stream: str | None = None) -> DataFrame:
    """seq, depth after each latency: rate * mean * (1 + variance / mean^2) over the last 100, rounded up and clamped.

    Streams are independent; without a stream column there is one, which a single task must go through in order.
    """
    order = (Window.partitionBy(stream) if stream else Window.partitionBy(F.lit(0))).orderBy(seq).rowsBetween(1 - LATENCIES, 0)
    mean, var = F.avg(seconds).over(order), F.var_pop(seconds).over(order)
    raw = F.lit(rate) * mean * (1 + F.coalesce(F.try_divide(var, mean * mean), F.lit(0.0)))
    return latencies.select(*([stream] if stream else []), seq, F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.round(raw, 6)))).cast("int").alias("depth"))


def range_exists(keys: DataFrame, ranges: DataFrame, bucket: int = 12) -> DataFrame:
    """ranges (range_id, lo, hi) -> with `hit`: some key lies in [lo, hi]; an exact hit on lo counts even if hi < lo.

    The first key at or after lo decides. It is searched among keys with the same first `bucket` characters, then taken
    from the next such group of keys, of which only the least keys are ordered together.
    """
    own = keys.select(F.col("key").alias("at")).distinct().withColumn("bucket", F.substring("at", 1, bucket))
    asked = ranges.select(F.col("lo").alias("at"), "range_id", "hi", F.substring("lo", 1, bucket).alias("bucket"))
    least = own.groupBy("bucket").agg(F.min("at").alias("least")).unionByName(asked.select("bucket").distinct(), allowMissingColumns=True).groupBy("bucket").agg(F.min("least").alias("least"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    following = least.select("bucket", F.last("least", ignorenulls=True).over(later).alias("following"))
    rows = own.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    after = Window.partitionBy("bucket").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("inside", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(after)).filter("kind = 1").join(following, "bucket", "left")
    first = F.coalesce("inside", "following")
    return found.select("range_id", F.coalesce((first == F.col("at")) | (first <= F.col("hi")), F.lit(False)).alias("hit"))


def bracket(sorted_keys: DataFrame, probes: DataFrame, group: str = "series") -> DataFrame:
    """Look-ups in each group's sorted keys (group, k): probes (group, probe) -> lo, hi positions around the probe.

    A hit gives the first and last position of equal keys; a miss the neighbours, kept inside the array.
    """
    order = Window.partitionBy(group).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sorted_keys.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("k")) - 1)
    distinct = placed.groupBy(group, "k").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    size = placed.groupBy(group).agg(F.max("pos").alias("end"))
    rows = distinct.select(group, "k", "first", "last", F.lit(0).alias("kind")).unionByName(probes.select(group, F.col("probe").alias("k"), F.lit(1).alias("kind")).distinct(), allowMissingColumns=True)
    seen = Window.partitionBy(group).orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("below", F.last(F.when(F.col("kind") == 0, F.struct("k", "first", "last")), ignorenulls=True).over(seen)).filter("kind = 1").join(size, group, "left")
    hit = F.col("below.k") == F.col("k")
    low = F.when(hit, F.col("below.first")).otherwise(F.coalesce("below.last", F.lit(0)))
    high = F.when(hit, F.col("below.last")).otherwise(F.least(F.coalesce(F.col("below.last") + 1, F.lit(0)), F.col("end")))
    return rows.select(group, F.col("k").alias("probe"), F.coalesce(low, F.lit(0)).alias("lo"), F.coalesce(high, F.lit(0)).alias("hi"))


def spline_windows(points: DataFrame, probes: DataFrame, eps: int, group: str = "series") -> DataFrame:
    """Piecewise linear prediction: points (group, x, y), probes (group, probe) -> lo, hi.

    The first segment with x0 <= probe <= x1 predicts; outside all segments the window is NO_WINDOW. The probe's
    segment is the one that ends at the first point at or after it, found in one ordered pass per group.
    """
    order = Window.partitionBy(group).orderBy("x", "y")
    ends = points.select(group, F.col("x").alias("at"), F.struct(F.lag("x").over(order).alias("x0"), F.lag("y").over(order).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.row_number().over(order).alias("k")).alias("seg"), F.lit(0).alias("kind"))
    ends = ends.filter("seg.x0 IS NOT NULL")
    rows = ends.unionByName(probes.select(group, F.col("probe").alias("at"), F.lit(1).alias("kind")).distinct(), allowMissingColumns=True)
    after = Window.partitionBy(group).orderBy(F.col("at").desc(), F.col("kind"), F.col("seg.k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("use", F.last("seg", ignorenulls=True).over(after)).filter("kind = 1")
    inside = F.col("use").isNotNull() & (F.col("at") >= F.col("use.x0"))
    slope = F.coalesce(F.try_divide(F.col("use.y1") - F.col("use.y0"), (F.col("use.x1") - F.col("use.x0")).cast("double")), F.lit(0.0))
    p = (F.col("use.y0") + slope * (F.col("at") - F.col("use.x0"))).cast("long")
    return rows.select(group, F.col("at").alias("probe"), F.when(inside, F.greatest(F.lit(0), p - eps)).otherwise(NO_WINDOW[0]).alias("lo"), F.when(inside, p + eps).otherwise(NO_WINDOW[1]).alias("hi"))


def nearest_rank(values: DataFrame, group: str, value: str, percents: list[float]) -> DataFrame:
    """group, percent, value at rank round((n - 1) * percent / 100), halves away from zero.

    Equal values are counted first; the window holds one row for each distinct value of a group. Nulls don't count.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("value")).agg(F.count("*").alias("times"))
    upto = Window.partitionBy(group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"end": F.sum("times").over(upto), "n": F.sum("times").over(Window.partitionBy(group))})
    rank = lambda p: F.round((F.col("n") - 1) * p / 100)
    wanted = F.filter(F.array(*map(F.lit, percents)), lambda p: (rank(p) < F.col("end")) & (rank(p) >= F.col("end") - F.col("times")))
    return ranked.select(group, F.explode(wanted).alias("percent"), "value")


def format_bytes(size: Column) -> Column:
    """A size as text, in the largest unit of 1024 that it fills."""
    unit = lambda power, name: F.format_string(f"%.2f {name}", size / float(1024**power))
    return F.when(size >= 1 << 30, unit(3, "GB")).when(size >= 1 << 20, unit(2, "MB")).when(size >= 1 << 10, unit(1, "KB")).otherwise(F.format_string("%d B", size.cast("long")))


def gaussian_weights(spark: SparkSession, rows: int, elements: int, deviation: float = 0.02, seed: int = 0) -> DataFrame:
    """id, data: `elements` normal float32 as bytes, by the polar form of two uniform draws; a row depends on seed and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch["id"].to_pylist():
                u = np.random.default_rng([seed, key]).random((2, -(-elements // 2)))
                radius, angle = deviation * np.sqrt(-2 * np.log1p(-u[0])), 2 * np.pi * u[1]
                x = np.concatenate([radius * np.cos(angle), radius * np.sin(angle)])[:elements].astype("<f4")
                yield pa.record_batch([pa.array([key]), pa.array([x.tobytes()], pa.binary())], ["id", "data"])

    return spark.range(rows).mapInArrow(run, "id long, data binary")


def mean_and_deviation(values: DataFrame, group: str, value: str) -> DataFrame:
    return values.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
