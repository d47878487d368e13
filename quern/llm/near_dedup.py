"""Near-duplicate detection with bottom-k sketches.

A document's set holds the 64-bit hashes of its distinct word shingles. One hash function serves: the k smallest values
are the sketch. Documents with equal sets form a class at once; from there on only one document of a class takes part.

Candidates come from inverted lists of retained values. Two sets with the wanted similarity share at least MIN_SHARED
of their k values (all but CHANCE of pairs at the threshold, fewer above; for sets of at most k the bound is exact), so they meet in a list even
if each posts only its k - MIN_SHARED + 1 rarest values. Values that one class alone retains fill places in that
order but need no list, which keeps the values of passages that many documents share out of the lists of all documents
that hold enough else.

Within a list not all pairs are compared. Each list's hub, its most typical member, is compared with all others, and
linked classes are contracted to components; lists that lie in one component are finished. Where components are left,
members meet on their difference from the hub instead: with D(x) the values that only one of x and its hub holds,
    |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|,
and a link needs |x ^ y| <= (n_x + n_y) (100 - threshold) / (100 + threshold). So linked members share a known number of
values of their differences, one at least unless both are linked to the hub. They meet in inverted lists of the rarest
of these (per hub), where what is left of both bounds the overlap. Edits that one class alone has are in no list, so
near copies below the threshold, however many, rarely meet at all.

A pair counts as a candidate after the sketch of its union estimates enough similarity; its full sets are then read
from the texts and decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, WordHashes, bounded_batches, mixed, row_blocks, ship, text_of, tidied
from .components import components

ship(__name__)

SKETCH, SHINGLE = 64, 5
#: The most chance that the sketches of a pair at the threshold share less than is asked of them.
CHANCE = 3e-7
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Spark orders longs as signed.
SIGN = np.uint64(1 << 63)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text: str | None, known: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of n words; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        out = mixed(out * MULT + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The smallest values of a sorted set as longs of the same order: the highest bit is flipped."""
    return (s[:SKETCH] ^ SIGN).view(np.int64)


def min_shared(k: int, threshold: int) -> int:
    """Values that the sketches of two sets at the threshold (in hundredths) share at least, but for rare chance."""
    j, t, below = threshold / 100, 0, 0.0
    # The tail of k draws with replacement; without, as sketches are drawn, less is in it.
    while t < k and (below := below + comb(k, t) * j**t * (1 - j) ** (k - t)) <= CHANCE:
        t += 1
    return max(1, t)


def sketch_rows(docs: DataFrame, n: int) -> DataFrame:
    """(id, text) -> id, n_shingles, set_a, set_b (128 bits over the whole set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in row_blocks(batch, "text"):
                sizes, a, b, sketches = [], [], [], []
                for text in part["text"].to_pylist():
                    s = shingle_set(text, known, n)
                    sizes.append(len(s))
                    a.append(xxh3_64_intdigest(s.tobytes(), 1) - (1 << 63))
                    b.append(xxh3_64_intdigest(s.tobytes(), 2) - (1 << 63))
                    sketches.append(sketch_of(s))
                ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
                yield pa.record_batch({"id": part["id"], "n_shingles": pa.array(sizes, pa.int64()), "set_a": pa.array(a, pa.int64()), "set_b": pa.array(b, pa.int64()), "sketch": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64), pa.int64()))})

    return docs.select("id", "text").mapInArrow(tidied(run), "id long, n_shingles long, set_a long, set_b long, sketch array<long>")


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """(id, text) -> id, set_a, set_b, members: the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in row_blocks(batch, "text"):
                sets = [shingle_set(t, known, n).view(np.int64) for t in part["text"].to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                a, b = ([xxh3_64_intdigest(x.tobytes(), seed) - (1 << 63) for x in sets] for seed in (1, 2))
                yield pa.record_batch({"id": part["id"], "set_a": pa.array(a, pa.int64()), "set_b": pa.array(b, pa.int64()), "members": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64()))})

    return docs.select("id", "text").mapInArrow(tidied(run), "id long, set_a long, set_b long, members array<long>")


def enough(shared: Column, left_n: Column, right_n: Column, threshold: int) -> Column:
    """Whether `shared` members are threshold hundredths of the union."""
    return F.lit(100) * shared >= F.lit(threshold) * (left_n + right_n - shared)


def _estimated(threshold: int):
    """Whether the union's sketch leaves the similarity possible: of its k smallest values enough are in both."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    size = F.size(union)
    shared = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    j = threshold / 100
    whole = F.greatest("n_a", "n_b") <= SKETCH
    least = F.when(whole & (size < SKETCH), size * j).otherwise(F.lit(min_shared(SKETCH, threshold)))
    lengths = F.lit(100) * F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")
    return lengths & (shared + 1e-9 >= least)


class NearDuplicates:
    """One run over one table; see the module's docstring."""

    def __init__(self, docs: DataFrame, threshold: int, shingle: int):
        """docs: id, text."""
        self.docs, self.threshold, self.shingle = docs, threshold, shingle
        #: Linked sets differ in at most `slack` times the sum of their sizes.
        self.slack = (100 - threshold) / (100 + threshold)
        bounded_batches(docs.sparkSession)
        self.scratch = Scratch(docs.sparkSession, "near")
        self.rows = self.scratch.keep(sketch_rows(docs, shingle), "rows")
        # A class is a distinct set; it has a number of its own (node) and its smallest id, which classes may share.
        pick = self.rows.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        self.classes = self.scratch.keep(pick.withColumn("node", F.monotonically_increasing_id()), "classes")

    def postings(self) -> DataFrame:
        """(value, node, n, typical): the rarest retained values of each class that other classes retain too."""
        each = self.classes.select("node", F.size("sketch").alias("kept"), "n", F.explode("sketch").alias("value"))
        shared = self.scratch.keep(each.groupBy("value").count().filter("count > 1"), "shared")
        common = self.scratch.keep(each.join(shared, "value"), "common")
        t = min_shared(SKETCH, self.threshold)
        exact = F.col("kept") - F.ceil(F.col("n") * F.lit(self.threshold) / 100) + 1
        places = F.when(F.col("n") <= SKETCH, F.greatest(exact, F.col("kept") - t + 1)).otherwise(F.lit(SKETCH - t + 1))
        # Values that many retain make a class typical; whole numbers, so that sums don't depend on the order.
        typical = F.sum((F.log2("count") * 1024).cast("long")).alias("typical")
        ranked = common.groupBy("node").agg(F.first("kept").alias("kept"), F.first("n").alias("n"), typical, F.array_sort(F.collect_list(F.struct("count", "value"))).alias("values"))
        posted = ranked.withColumn("places", F.greatest(F.lit(0), places - (F.col("kept") - F.size("values")))).filter("places > 0")
        out = self.scratch.keep(posted.select("node", "n", "typical", F.explode(F.slice("values", F.lit(1), F.col("places").cast("int"))).alias("v")).select(F.col("v.value").alias("value"), "node", "n", "typical"), "postings")
        self.scratch.drop("shared", "common")
        return out

    def read_sets(self, nodes: DataFrame) -> DataFrame:
        """(node) -> node, members: the full sets of these classes, from their texts."""
        wanted = self.scratch.keep(self.classes.join(nodes.distinct(), "node").select("node", "id", "set_a", "set_b"), "wanted")
        ids = wanted.select(F.col("id").alias("wanted")).distinct()
        texts = self.docs.select("id", "text").join(ids.hint("merge"), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
        sets = set_rows(texts, self.shingle).drop("id").join(wanted.drop("id"), ["set_a", "set_b"])
        return self.scratch.keep(sets.dropDuplicates(["node"]).select("node", "members"), "sets")

    def side(self, name: str) -> DataFrame:
        """The full sets, with columns named for one side of a pair."""
        return self.sets.select(F.col("node").alias(name), F.col("members").alias(f"set_{name}"))

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones of the pairs (a, b)."""
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(_estimated(self.threshold)).select("a", "b", "n_a", "n_b")
        likely = self.scratch.keep(likely, f"likely-{name}")
        both = likely.join(self.side("a"), "a").join(self.side("b"), "b").withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
        out = self.scratch.keep(both.filter(enough(F.col("shared"), F.col("n_a"), F.col("n_b"), self.threshold)).select("a", "b"), f"links-{name}")
        self.scratch.drop(f"likely-{name}")
        return out

    def alike(self, n: Column, m: Column) -> Column:
        """Whether sets of these sizes can be linked."""
        return F.lit(100) * F.least(n, m) >= F.lit(self.threshold) * F.greatest(n, m)

    def rooted(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def open_lists(self, members: DataFrame, *key: str) -> DataFrame:
        """(key, main): lists of members (key, root) that hold several roots, with the most frequent one."""
        by_root = members.groupBy(*key, "root").count()
        return by_root.groupBy(*key).agg(F.count("*").alias("roots"), F.max_by("root", F.struct("count", "root")).alias("main")).filter("roots > 1").drop("roots")

    def difference_postings(self, dealt: DataFrame) -> DataFrame:
        """(hub, node, n) -> hub, d, node, n, size, left: the rarest values d of the difference between a class and its
        hub that others differ in too, with the difference's size and how many such values are left from d on."""
        both = dealt.filter("node <> hub").join(self.side("node"), "node").join(self.side("hub"), "hub")
        differ = both.select("hub", "node", "n", F.concat(F.array_except("set_node", "set_hub"), F.array_except("set_hub", "set_node")).alias("differ"))
        differ = self.scratch.keep(differ.select("hub", "node", "n", F.size("differ").alias("size"), F.explode("differ").alias("d")), "differ")
        several = self.scratch.keep(differ.groupBy("hub", "d").count().filter("count > 1"), "several")
        own = differ.join(several, ["hub", "d"]).groupBy("hub", "node").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("count", "d"))).alias("values"))
        # No partner's size allows a larger difference than `most`; one further from the hub than that shares the rest.
        most = F.floor(F.col("n") * (1 + 100 / self.threshold) * self.slack + 1e-6)
        places = F.size("values") - F.greatest(F.lit(1), F.col("size") - most) + 1
        cut = F.slice(F.transform("values", lambda v, k: F.struct(v["d"].alias("d"), (F.size("values") - k).alias("left"))), F.lit(1), F.greatest(F.lit(0), places).cast("int"))
        out = self.scratch.keep(own.select("hub", "node", "n", "size", F.explode(cut).alias("v")).select("hub", "v.d", "node", "n", "size", "v.left"), "differences")
        self.scratch.drop("differ", "several")
        return out

    def roots(self) -> DataFrame:
        """(node, root) of classes that are linked to another."""
        scratch, postings = self.scratch, self.postings()
        hubs = postings.groupBy("value").agg(F.max(F.struct("typical", "node", "n")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
        hubs = scratch.keep(hubs.select("value", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
        members = scratch.keep(postings.join(hubs, "value").select("value", "hub", "hub_n", "node", "n"), "members")
        self.sets = self.read_sets(members.select("node"))
        pair = [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]
        near = members.filter((F.col("node") != F.col("hub")) & self.alike(F.col("n"), F.col("hub_n"))).select(*pair).distinct()
        found = self.links(near, "hubs")
        labels = components(found, scratch, "cc0")

        rooted = scratch.keep(self.rooted(members, labels), "rooted0")
        dealt = rooted.join(self.open_lists(rooted, "value"), "value", "left_semi").select("hub", "node", "n").distinct()
        dealt = scratch.keep(dealt, "dealt")
        scratch.drop("postings", "hubs", "members", "rooted0")
        if dealt.isEmpty():
            return labels
        met = scratch.keep(self.rooted(self.difference_postings(dealt), labels), "rooted1")
        lists = scratch.keep(self.open_lists(met, "hub", "d"), "lists")
        within = met.join(lists, ["hub", "d"])
        # Members outside a list's main component meet all others; a pair that is outside with both sides meets once.
        outer = scratch.keep(within.filter("root <> main").select("hub", "d", "main", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "size", "left", "root"))), "outer")
        slack = (F.col("n") + F.col("o_n")) * self.slack + 1e-6
        overlap = (F.col("size") + F.col("o_size") - slack) / 2
        possible = (F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("o_node"))) & (F.least("left", "o_left") >= overlap) & self.alike(F.col("n"), F.col("o_n"))
        pairs = met.join(outer, ["hub", "d"]).filter(possible).select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()
        more = self.links(pairs, "differences")
        scratch.drop("differences", "rooted1", "lists", "outer", "dealt")
        return components(found.unionByName(more), scratch, "cc1")

    def result(self) -> DataFrame:
        """id, n_shingles, component_id of every row."""
        roots = self.roots()
        rooted = self.classes.select("set_a", "set_b", "node", "id").join(roots, "node", "left").select("set_a", "set_b", "id", F.coalesce("root", "node").alias("root"))
        rooted = self.scratch.keep(rooted, "rooted")
        least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
        named = self.scratch.keep(rooted.join(least, "root").select("set_a", "set_b", "component_id"), "named")
        return self.rows.join(named, ["set_a", "set_b"], "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def near_dedup(docs: DataFrame, threshold: int = 80, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked when threshold hundredths of the union of their shingle sets are shared; component_id is the
    smallest id reachable. Null, empty and blank texts have no shingles and are linked with nothing. Repeated rows get
    equal results. Rows that repeat an id with other texts are linked by their own texts each. A row without an id links
    like any other; its id stays null and is no component's name, so component_id is null, and kept true, where no row
    of the component has an id. Other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    out = NearDuplicates(rows, threshold, shingle).result()
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
