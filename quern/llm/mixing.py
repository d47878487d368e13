"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source has one token constraint: the words taken from it meet its target. Among all document rates between 0 and
`cap` that meet the constraints, entropy balancing takes those closest to the uniform mix in relative entropy (here of
the rate's share of its cap). They are an exponential tilt: rate / (cap - rate) = exp(lambda * size / mean size), with
one dual variable per source. The convex dual is solved by Newton steps, each one an aggregate over the (source, size)
histogram, with a bracket that turns to bisection where a step would leave it.

Rates become whole copies by systematic rounding along each source in order of size. Cumulated copies differ from
cumulated rates by less than one at every size, so a source's taken words differ from its target by less than its
largest document. Positions come from two small prefix sums (over sizes, then over buckets of equal documents) and a
row number within a bucket; no window ever spans a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, text_of

#: Rows that a bucket of equally large documents of one source aims at, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 256, 1 << 22
MOST_STEPS, TOLERANCE = 60, 1e-10


def source_targets(sources: DataFrame, share: float, cap: float, weights: Sequence[int]) -> DataFrame:
    """(source, source_size) -> with sid, weight, target: `share` of all words dealt by weight, at most `cap` times a source's size.

    With targets min(cap * size, c * weight), the level c follows from sorting the sources by cap * size / weight. The
    windows without a key hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumns({"most": F.lit(cap) * F.col("source_size"), "all": F.lit(share) * F.sum("source_size").over(Window.partitionBy())}).withColumn("ratio", F.col("most") / F.col("weight"))
    by = Window.orderBy("ratio", "sid")
    full = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("all") - full) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(Window.partitionBy())
    return rows.withColumn("c", level).select("sid", "source", "source_size", "n", F.when(F.col("ratio") <= F.col("level"), F.col("most")).otherwise(F.col("weight") * F.col("c")).alias("target"))


def _rate(cap: float) -> Column:
    z = F.try_divide("size", "mean")
    return F.when(F.col("fixed").isNotNull(), F.col("fixed")).otherwise(F.lit(cap) / (1 + F.exp(-F.col("lam") * z)))


def solve_duals(hist: DataFrame, sources: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """The dual variable of each source: (sid, lam, mean, fixed); `fixed` is the rate where a target is 0 or the cap."""
    full = F.lit(cap) * F.col("source_size")
    part = F.try_divide("target", full)
    state = sources.select(
        "sid", "target", (F.col("source_size") / F.col("n")).alias("mean"),
        F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= full, cap).when(F.col("target") <= 0, 0.0).alias("fixed"),
    ).join(sources.select("sid", F.log(F.try_divide(part, 1 - part)).alias("lam")), "sid").withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf"))})
    state = scratch.keep(state, "dual0")
    for step in range(1, MOST_STEPS + 1):
        rate = _rate(cap)
        words = F.col("count") * F.col("size")
        sums = hist.join(state.filter("fixed IS NULL"), "sid").groupBy("sid").agg(F.sum(words * rate).alias("got"), F.sum(words * rate * (1 - rate / cap) * F.col("size") / F.col("mean")).alias("slope"))
        moved = state.join(sums, "sid", "left").withColumns({"lo": F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))})
        off = F.col("target") - F.col("got")
        newton = F.col("lam") + F.try_divide(off, F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & F.col("slope").isNotNull() & (F.col("slope") > 0)
        wide = F.when(F.col("hi") == float("inf"), F.col("lam") + F.abs("lam") + 1).when(F.col("lo") == float("-inf"), F.col("lam") - F.abs("lam") - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.col("got").isNull() | (F.abs(off) <= TOLERANCE * F.col("target"))
        moved = moved.select("sid", "target", "mean", "fixed", F.when(near, F.col("lam")).when(inside, newton).otherwise(wide).alias("lam"), "lo", "hi", near.alias("near"))
        state = scratch.keep(moved, f"dual{step}").drop("near")
        open_left = scratch.spark.read.parquet(f"{scratch.root}/dual{step}").filter("NOT near").limit(1).count()
        if not open_left:
            break
    return state.select("sid", "lam", "mean", "fixed")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (5, 2, 1), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, copies, rate, and row_col if given, which orders rows of one id.

    size: words of the text; a null or blank text has none and is taken with 0 words. A null source is a source of its
    own, after all others. Rows that repeat an id, or have none (a null id stays null), are documents of their own, told
    apart and put in order by a hash of their text. A source without words has target 0.
    Reruns agree: nothing is drawn. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    row = [row_col] if row_col else []
    sized = scratch.keep(docs.select(*row, F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_of(text_col)).alias("tie")), "sized")
    by_size = scratch.keep(sized.groupBy("source", "size").count(), "by_size")
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum("count").alias("n"))
    sources = scratch.keep(source_targets(totals, share, cap, weights), "sources")
    same = by_size["source"].eqNullSafe(sources["source"])
    hist = scratch.keep(by_size.join(sources, same).select(by_size["source"], "sid", "size", "count"), "hist")
    duals = solve_duals(hist, sources, cap, scratch)

    classes = hist.join(duals, "sid").withColumn("rate", _rate(cap))
    before = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    n = hist.agg(F.sum("count")).first()[0] or 0
    rows = max(BUCKET_ROWS, n // MOST_BUCKETS)
    classes = classes.withColumns({"base": F.coalesce(F.sum(F.col("rate") * F.col("count")).over(before), F.lit(0.0)), "buckets": F.ceil(F.col("count") / rows)})
    classes = scratch.keep(classes.join(sources.select("sid", "source_size", "target"), "sid").select("source", "sid", "size", "rate", "base", "buckets", "source_size", "target"), "classes")

    placed = sized.join(classes, sized["source"].eqNullSafe(classes["source"]) & (sized["size"] == classes["size"])).select(
        *row, "id", "tie", sized["size"], "sid", "rate", "base", "source_size", "target", F.pmod(F.xxhash64("id", "tie", *row), F.col("buckets")).alias("bucket")
    )
    placed = scratch.keep(placed, "placed")
    counts = scratch.keep(placed.groupBy("sid", "size", "bucket").count(), "counts")
    earlier = Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "size", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("skipped"))
    at = F.col("skipped") + F.row_number().over(Window.partitionBy("sid", "size", "bucket").orderBy("id", "tie", *row))
    upto = lambda k: F.floor(F.col("base") + F.col("rate") * k + 0.5)
    return (
        placed.join(counts, ["sid", "size", "bucket"]).withColumn("at", at).withColumn("copies", upto(F.col("at")) - upto(F.col("at") - 1))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", *row)
    )
