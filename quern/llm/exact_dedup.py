"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text (after the byte length, which serves as the first
digit) until a group has one member or its text has ended. A digit is a run of bytes that gets longer from level to
level, so that a text of any length ends after a few levels while one key stays small. Texts meet only as raw bytes;
no digest decides equality.

A level pre-aggregates (group, digit) to one row each, which survives hot groups, and joins the new groups back; no
step gathers the rows of a group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, text_of

FIRST_DIGIT, GROWTH, LONGEST_DIGIT = 64, 8, 1 << 20


def normalised(text: Column) -> Column:
    """The text without ASCII white space, as UTF-8."""
    return F.regexp_replace(text, f"[{SPACE}]+", "").cast("binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty or blank texts form one group. Of equal texts the row with the most code
    points in its original text stays, then the smallest id (a null id comes last). Rows that repeat an id stay rows of
    their own; where such rows also tie, one of them is marked kept. Other columns are ignored. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("n_chars"), normalised(text).alias("norm")).withColumns({"len": F.octet_length("norm"), "d0": F.substring("norm", 1, FIRST_DIGIT)})

    shared = scratch.keep(base.groupBy("len", "d0").count().filter("count > 1").select("len", "d0", (-1 - F.monotonically_increasing_id()).alias("gid")), "level0")
    rows = scratch.keep(
        base.join(shared.hint("merge"), ["len", "d0"], "left").select(
            "id", "n_chars", "len", "gid", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("uid"),
            F.when(F.col("gid").isNotNull() & (F.col("len") > FIRST_DIGIT), F.expr(f"substring(norm, {FIRST_DIGIT + 1})")).alias("rest"),
        ),
        "rows",
    )

    ended = [rows.filter(F.col("gid").isNotNull() & (F.col("len") <= FIRST_DIGIT)).select("uid", "gid")]
    active, width, level = rows.filter("rest IS NOT NULL").select("uid", "gid", "rest"), FIRST_DIGIT * (GROWTH - 1), 1
    while True:
        cut = active.select("uid", "gid", F.substring("rest", 1, width).alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("tail"))
        groups = scratch.keep(cut.groupBy("gid", "digit").agg(F.min("uid").alias("next"), F.count("*").alias("n")).filter("n > 1").drop("n"), f"groups{level}")
        split = scratch.keep(cut.join(groups, ["gid", "digit"]).select("uid", F.col("next").alias("gid"), F.col("tail").alias("rest")), f"split{level}")
        ended.append(split.filter(F.octet_length("rest") == 0).select("uid", "gid"))
        active = split.filter(F.octet_length("rest") > 0)
        scratch.drop(f"groups{level}")
        if active.isEmpty():
            break
        level, width = level + 1, min(width * GROWTH, LONGEST_DIGIT)

    member = rows.drop("gid", "rest", "len").join(reduce(DataFrame.unionByName, ended), "uid", "left")
    member = scratch.keep(member, "members")
    scratch.drop("rows", "level0", *(f"split{k}" for k in range(1, level + 1)))
    best = F.max_by(F.struct("id", "uid"), F.struct("n_chars", F.col("id").isNotNull(), -F.col("id"), -F.col("uid")))
    stay = scratch.keep(member.filter("gid IS NOT NULL").groupBy("gid").agg(best.alias("best"), F.count("*").alias("group_size")), "stay")
    return member.join(stay, "gid", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("gid").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
