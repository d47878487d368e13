"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame operations only.

A text is cut at blank lines into sections, at line ends into paragraphs, and a paragraph into blocks of up to four
words that also end with a sentence. Cuts keep every character. A block is hashed by its text; a paragraph, a section
and the root hash the number of their children and the children's whole sha256, so that two texts have equal roots only
if they are equal or sha256 collides. The fingerprint writes the tree out, the root whole, the others cut to NODE_DIGITS
and BLOCK_DIGITS digits:

    root|section{paragraph(block block ...) ...} ...

`differences` walks two trees from their roots, only into children whose hashes differ, and tells which branches do.

Likeness of two fingerprints is the share of blocks that they have in common (Dice's coefficient of their sets of block
hashes, as written); it is 1 if and only if the roots are equal.
"""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: A block: at most four words, fewer where a sentence ends; the end of a paragraph is one too.
BLOCK = r"(?:[^ ]*[^ .!?] ){0,3}[^ ]* |[^ ]+"
BLOCK_DIGITS, NODE_DIGITS = 8, 16
#: Ranges of ids for the search of the next document: the most of them, rows that one aims at, rows that are looked at
#: to cut one. Cuts decide how rows are dealt out, not which row is the next.
MOST_RANGES, ROWS_A_RANGE, LOOKS_A_RANGE = 1 << 14, 200, 40


def _digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _node(children: Column) -> Column:
    """The hash of a node with these children's hashes."""
    return _digest(F.concat_ws(",", F.size(children).cast("string"), children))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tree(text: Column) -> Column:
    """array<struct(hash, paragraphs: array<struct(hash, blocks: array<string>)>)>, one entry for each section."""

    def paragraph(p: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(p, F.lit(BLOCK), F.lit(0)), _digest)
        return _let(blocks, lambda own: F.struct(_node(own).alias("hash"), own.alias("blocks")))

    def section(s: Column) -> Column:
        return _let(F.transform(F.split(s, "\n", -1), paragraph), lambda own: F.struct(_node(own["hash"]).alias("hash"), own.alias("paragraphs")))

    return F.transform(F.split(text, "\n\n", -1), section)


def root(sections: Column) -> Column:
    return _node(sections["hash"])


def written(sections: Column) -> Column:
    """The tree as text."""
    cut = lambda x, n: F.substring(x, 1, n)
    paragraph = lambda p: F.concat(cut(p["hash"], NODE_DIGITS), F.lit("("), F.array_join(F.transform(p["blocks"], lambda b: cut(b, BLOCK_DIGITS)), " "), F.lit(")"))
    section = lambda s: F.concat(cut(s["hash"], NODE_DIGITS), F.lit("{"), F.array_join(F.transform(s["paragraphs"], paragraph), " "), F.lit("}"))
    return _let(sections, lambda own: F.concat(root(own), F.lit("|"), F.array_join(F.transform(own, section), " ")))


def _unlike(xs: Column, ys: Column) -> Column:
    """array<struct(i, j)>: the places in xs whose hash differs from the one at the place j of ys that answers to it.

    Places answer to each other in order up to the first difference, and counted from the end after it; j is null where
    ys has none left."""
    at = F.array_position(F.zip_with(xs, ys, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    same = F.when(at == 0, F.size(xs)).otherwise(at - 1)
    j = lambda i: F.when(i < same, i).otherwise(i + F.size(ys) - F.size(xs))
    pairs = F.transform(xs, lambda _, i: F.struct(i.cast("int").alias("i"), F.when((i < same) | (j(i) >= same), j(i)).cast("int").alias("j")))
    return F.filter(pairs, lambda p: p["j"].isNull() | ~F.get(xs, p["i"]).eqNullSafe(F.get(ys, p["j"])))


def differences(left: Column, right: Column) -> Column:
    """array<struct(section, paragraph, block)> of two trees: the branches of the left that the right lacks at that place.

    A branch without a counterpart, and a node that differs only in what the right has more, is named itself, with nulls
    below. Places count from 0. Equal trees give an empty array; every edit that leaves the left's text unequal gives a
    branch, or an empty array where the right only adds sections."""
    place = lambda s, p=None, b=None: F.struct(s.alias("section"), (F.lit(None).cast("int") if p is None else p).alias("paragraph"), (F.lit(None).cast("int") if b is None else b).alias("block"))

    def or_self(children: Column, own: Column) -> Column:
        return _let(children, lambda found: F.when(F.size(found) == 0, F.array(own)).otherwise(found))

    def below_paragraph(s: Column, p: Column, x: Column, y: Column) -> Column:
        blocks = F.transform(_unlike(x["blocks"], y["blocks"]), lambda b: place(s, p, b["i"]))
        return F.when(y.isNull(), F.array(place(s, p))).otherwise(or_self(blocks, place(s, p)))

    def below_section(s: Column, x: Column, y: Column) -> Column:
        each = F.transform(_unlike(x["paragraphs"]["hash"], y["paragraphs"]["hash"]), lambda p: below_paragraph(s, p["i"], F.get(x["paragraphs"], p["i"]), F.get(y["paragraphs"], p["j"])))
        return F.when(y.isNull(), F.array(place(s))).otherwise(or_self(F.flatten(each), place(s)))

    return F.flatten(F.transform(_unlike(left["hash"], right["hash"]), lambda s: below_section(s["i"], F.get(left, s["i"]), F.get(right, s["j"]))))


def blocks_of(fingerprint: Column) -> Column:
    """The distinct block hashes in a fingerprint."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(fingerprint, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda x: F.filter(F.split(x, " "), lambda b: b != ""))))


def likeness(a: Column, b: Column, blocks_a: Column, blocks_b: Column) -> Column:
    """Of two fingerprints with their blocks; blocks that differ in order or white space only leave it below 1."""
    shared = F.size(F.array_intersect(blocks_a, blocks_b))
    every = F.size(blocks_a) + F.size(blocks_b)
    return F.when(F.substring_index(a, "|", 1) == F.substring_index(b, "|", 1), 1.0).otherwise(F.least(2.0 * shared / F.greatest(every, F.lit(1)), 1 - 1 / (every + 2)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint. A null text counts as empty. Other columns are ignored."""
    return docs.select(F.col(id_col), written(tree(text_of(text_col))).alias("fingerprint"))


def _place(cuts: list[list[int]], key: Column) -> Column:
    """How many of the sorted cuts are at or below the key, by a search in two levels."""
    width = isqrt(len(cuts)) + 1
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    pairs = lambda xs: [{"k": k, "t": t} for k, t in xs]
    heads = F.from_json(F.lit(json.dumps(pairs(g[0] for g in groups))), "array<struct<k:bigint,t:bigint>>")
    table = F.from_json(F.lit(json.dumps([pairs(g) for g in groups])), "array<array<struct<k:bigint,t:bigint>>>")
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    return _let(upto(heads), lambda k: F.when(k == 0, 0).otherwise((k - 1) * width + upto(F.get(table, k - 1))))


def with_next(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """rows (id, text, ...) -> with the `derived` columns, and next_<c> for the text and each of these: its value in the
    next row by descending id.

    The row after the last is the first. Rows are cut into ranges of about ROWS_A_RANGE by id and a hash of the text, so
    that rows without an id, or of one id, are split too; each range takes the first row of the following one with it,
    and one window by range finds all. Whole rows are shuffled once, before anything is derived. A null id comes after
    all others; equal ids go by the hash of their text.
    """
    rows = rows.withColumns({"_key": F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))), "_tie": F.xxhash64("text")})
    n = rows.select("_key").count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_A_RANGE))
    cuts = []
    if ranges > 1:
        looked = rows.select(F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t")).alias("x")).filter(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, LOOKS_A_RANGE * ranges / n)))
        # At most about LOOKS_A_RANGE * MOST_RANGES pairs of numbers are sorted here.
        every = F.row_number().over(Window.orderBy("x")) % LOOKS_A_RANGE
        cuts = sorted({(r.k, r.t) for r in looked.withColumn("at", every).filter("at = 0").select("x.k", "x.t").collect()})
    rows = rows.withColumn("_range", _place(cuts, F.struct(F.col("_key").alias("k"), F.col("_tie").alias("t"))) if cuts else F.lit(0))
    heads = sorted(rows.groupBy("_range").agg(F.max(F.struct("_key", "_tie")).alias("head")).collect())
    before = {x["_range"]: heads[k + 1 - len(heads)]["_range"] for k, x in enumerate(heads)}  # the range that continues with this one
    first_of = {x["_range"]: [*x["head"], before[x["_range"]]] for x in heads}
    head = F.get(F.from_json(F.lit(json.dumps([first_of.get(k) for k in range(max(before, default=0) + 1)])), "array<array<bigint>>"), F.col("_range"))
    own = F.struct(F.col("_range").cast("long").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.get(head, F.lit(2)).alias("range"), F.lit(True).alias("ghost"))
    first = (F.get(head, F.lit(0)) == F.col("_key")) & (F.get(head, F.lit(1)) == F.col("_tie"))
    dealt = rows.withColumn("_at", F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own)))).withColumns({"_in": F.col("_at.range"), "_ghost": F.col("_at.ghost")})
    dealt = dealt.drop("_at", "_range").repartition("_in").withColumns(derived)
    order = Window.partitionBy("_in").orderBy("_ghost", F.desc("_key"), F.desc("_tie"))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *derived)}).filter("NOT _ghost").drop("_key", "_tie", "_in", "_ghost")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    `edited` replaces the last half of the code points (rounded down) by the first as many, or all, of the next
    document's, by descending id. A null text counts as empty; two empty texts are alike (1). A single row is its own
    next. Repeated rows are documents of their own; a null id stays null. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = with_next(rows, {"fingerprint": written(tree(F.col("text")))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_fingerprint", written(tree(F.col("edited"))))
    rows = rows.withColumns({f"_{c}": blocks_of(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    near = lambda c: likeness(F.col("fingerprint"), F.col(c), F.col("_fingerprint"), F.col(f"_{c}"))
    return rows.select(F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
