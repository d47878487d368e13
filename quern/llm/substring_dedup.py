"""Substring dedup: words covered by a window of WINDOW words whose sequence also starts elsewhere.

Windows are found level by level: those repeated at one length alone are extended to about twice that length
(9, 18, 35 words for windows of 35; the last two halves overlap by a word), until no candidates survive.

Length 9 is looked at in anchors only: of the 9-word windows inside a 35-word window the one with the least hash, so that
equal windows have equal anchors at equal places. About one position in 14 is an anchor. An anchor owns the run of
window starts that chose it; windows of an anchor that is not repeated are not repeated.

Surviving anchors with equal surroundings (all words of all windows that they own) form a class. A class with two
members settles all its windows at once. Where an anchor has several classes, one member of each class spells out its
windows; their 18-word prefixes are counted, then the survivors' 35 words, as 128-bit hashes weighted by class size.
All counts are pre-aggregated, and all joins are between written tables, so that frequent passages are split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Scratch, WordHashes, bounded_batches, mixed, row_blocks, ship, text_of, tidied

ship(__name__)

WINDOW = 35
HALF, QUARTER = 18, 9
OWNED = WINDOW - QUARTER + 1
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() splits at the six ASCII white-space characters and no others."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def pairwise(left: np.ndarray, right: np.ndarray, seed: np.uint64) -> np.ndarray:
    return mixed(left * seed + (right ^ (right >> np.uint64(29))) + seed)


def window_hashes(h: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of 9, 18 and 35 words at each start, by doubling; none where the text is too short."""
    g = h
    for size in (1, 2, 4):
        g = pairwise(g[:-size], g[size:], seed) if len(g) > size else g[:0]
    quarter = pairwise(g[:-1], h[8:], seed) if len(g) > 1 else g[:0]
    half = pairwise(quarter[: -(HALF - QUARTER)], quarter[HALF - QUARTER :], seed) if len(quarter) > HALF - QUARTER else g[:0]
    gap = WINDOW - HALF
    whole = pairwise(half[:-gap], half[gap:], seed) if len(half) > gap else g[:0]
    return quarter, half, whole


def anchors(h: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(hash, hash of the surroundings, place, first start, last start) of each anchor."""
    if len(h) < WINDOW:
        return None
    quarter, _, whole = window_hashes(h, SEEDS[0])
    place = np.arange(len(whole)) + np.lib.stride_tricks.sliding_window_view(quarter, OWNED).argmin(1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    place = place[first]
    spans = ((place - first) * 64 + (last - first)).astype(np.uint64)
    return quarter[place], pairwise(pairwise(whole[first], whole[last], SEEDS[1]), spans, SEEDS[0]), place, first, last


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> (anchor, around, k1, k2, at): `at` packs the first start and the owned starts less one."""
    known = WordHashes()
    for batch in batches:
        for part in row_blocks(batch, "text"):
            a, b, at, sizes = [], [], [], np.zeros(part.num_rows, np.int64)
            for row, text in enumerate(part["text"].to_pylist()):
                words = words_of(text)
                found = anchors(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                if found:
                    hashes, around, _, first, last = found
                    a.append(hashes)
                    b.append(around)
                    at.append((first.astype(np.int64) << 5) | (last - first).astype(np.int64))
                    sizes[row] = len(first)
            if a:
                keys = [pa.array(np.repeat(part[k].to_numpy(), sizes)) for k in ("k1", "k2")]
                yield pa.record_batch([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64)), *keys, pa.array(np.concatenate(at))], ["anchor", "around", "k1", "k2", "at"])


def spelled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, spots: list of (at, class, n)) -> a row for each owned window: half, whole_a, whole_b, class, offset, n."""
    known = WordHashes()
    for batch in batches:
        for part in row_blocks(batch, "text"):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for text, spots in zip(part["text"].to_pylist(), part["spots"], strict=True):
                words, rows = words_of(text), spots.values
                at, cls, n = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                _, half, whole = window_hashes(h, SEEDS[0])
                other = window_hashes(h, SEEDS[1])[2]
                sizes = (at & 31) + 1
                offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                start = np.repeat(at >> 5, sizes) + offset
                for k, x in enumerate((half[start].view(np.int64), whole[start].view(np.int64), other[start].view(np.int64), np.repeat(cls, sizes), offset, np.repeat(n, sizes))):
                    out[k].append(x.astype(np.int64))
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], ["half", "whole_a", "whole_b", "class", "offset", "n"])


def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, cover: list of (at, mask)) -> id, n_words, n_removed, kept (text)."""
    for batch in batches:
        for part in row_blocks(batch, "text"):
            n, removed, kept = [], [], []
            for text, cover in zip(part["text"].to_pylist(), part["cover"], strict=True):
                words = words_of(text)
                n.append(len(words))
                if cover.is_valid:
                    at, mask = (cover.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                    hit = (mask[:, None] >> np.arange(OWNED)) & 1
                    row, offset = np.nonzero(hit)
                    start = (at[row] >> 5) + offset
                    change = np.bincount(start, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(start + WINDOW, minlength=len(words) + 1)[: len(words) + 1]
                    left = np.cumsum(change)[: len(words)] == 0
                    words = [w for w, ok in zip(words, left.tolist(), strict=True) if ok]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([part["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (binary: the words that stay, joined by one space).

    Windows are judged on the input. Null, empty and blank texts have no words; texts of fewer than 35 words lose
    nothing. Repeated rows are documents of their own, so that each makes the other's windows repeated. Rows are known by
    128 bits over id and text, so that rows that repeat an id, or have none, go by their own texts; null ids stay null.
    Other columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substring")
    text, key = text_of(text_col), ["k1", "k2"]
    keyed = docs.select(F.xxhash64(id_col, text).alias("k1"), F.xxhash64(text, F.lit(1), id_col).alias("k2"), text.alias("text"), F.col(id_col).alias("id"))
    texts = keyed.drop("id")
    found = scratch.keep(texts.mapInArrow(tidied(anchor_rows), "anchor long, around long, k1 long, k2 long, at long"), "anchors")

    again = scratch.keep(found.groupBy("anchor").count().filter("count > 1").select("anchor"), "again")
    left = scratch.keep(found.join(again.hint("merge"), "anchor", "left_semi"), "left")
    scratch.drop("anchors", "again")

    classes = scratch.keep(left.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one")), "classes")
    several = scratch.keep(classes.groupBy("anchor").count().filter("count > 1").select("anchor"), "several")
    open_ = scratch.keep(classes.join(several.hint("merge"), "anchor", "left_semi").withColumn("class", F.monotonically_increasing_id()), "open")
    spots = open_.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct(F.col("one.at").alias("at"), "class", "n")).alias("spots"))
    spelled = texts.join(scratch.keep(spots, "spots").hint("merge"), key).select("text", "spots")
    spelled = scratch.keep(spelled.mapInArrow(tidied(spelled_windows), "half long, whole_a long, whole_b long, class long, offset long, n long"), "spelled")

    halves = scratch.keep(spelled.groupBy("half").agg(F.sum("n").alias("n")).filter("n > 1").select("half"), "halves")
    extended = scratch.keep(spelled.join(halves.hint("merge"), "half", "left_semi").drop("half"), "extended")
    scratch.drop("spelled", "halves")
    wholes = scratch.keep(extended.groupBy("whole_a", "whole_b").agg(F.sum("n").alias("n")).filter("n > 1").select("whole_a", "whole_b"), "wholes")
    masks = extended.join(wholes.hint("merge"), ["whole_a", "whole_b"], "left_semi").groupBy("class").agg(F.bit_or(F.expr("shiftleft(1L, CAST(offset AS INT))")).alias("mask"))
    masks = scratch.keep(masks, "masks")
    scratch.drop("extended", "wholes")

    every = F.expr("shiftleft(1L, CAST(at & 31 AS INT) + 1) - 1")
    settled = scratch.keep(open_.join(masks, "class", "left").select("anchor", "around", "mask"), "settled")
    sure = classes.select("anchor", "around", "n")
    cover = left.join(scratch.keep(sure.join(settled, ["anchor", "around"], "left").filter("n > 1 OR mask IS NOT NULL"), "verdicts").hint("merge"), ["anchor", "around"])
    cover = scratch.keep(cover.select(*key, "at", F.when(F.col("n") > 1, every).otherwise(F.col("mask")).alias("mask")), "cover")
    scratch.drop("left", "classes", "several", "open", "settled", "verdicts", "masks", "spots")
    # Rows that repeat id and text have equal covers; a set keeps one, so that it never outgrows a text.
    by_doc = scratch.keep(cover.groupBy(*key).agg(F.collect_set(F.struct("at", "mask")).alias("cover")), "by_doc")
    out = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL("n_words long, n_removed long, kept binary")])
    return keyed.join(by_doc.hint("merge"), key, "left").mapInArrow(tidied(kept_words), out).withColumnRenamed("id", id_col)
