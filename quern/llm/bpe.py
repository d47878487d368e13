"""Byte-level BPE encoding and decoding.

Encoding splits texts by the tokenizer's pattern and folds ranked merges over the byte arrays of distinct words in
Spark higher-order functions. Ranks come from a literal map of two levels (bucket of the piece's checksum, then the
piece), as Spark looks up a map by linear search; the plan holds it once.

Words that many documents use are folded once for the whole table: the most frequent words of a sample of documents, at
most COMMON_WORDS of them, are folded first, and their ids go to all tasks. What is in that store decides how often a
word is folded, never its ids. All other words are made distinct within a task, without a shuffle: one Arrow step splits
the texts, numbers the words of a block of documents and hands on those that its task meets for the first time, the fold
turns these into ids, and a second Arrow step, which reads the same blocks in the same order (they are numbered, and a
block that is not the next one fails the task), puts documents together. Decoding concatenates the byte pieces of ids.

The fold over a word of n bytes takes n steps on arrays of n entries. Words of more than LONG_WORD bytes, which are
junk, are merged by a heap in the first Arrow step instead, in n log n and with equal results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from xxhash import xxh3_64_intdigest

from .common import Scratch, bounded_batches, list_blocks, row_blocks, send, ship, text_of, tidied

ship(__name__)

RANK_BUCKETS, NO_RANK = 1 << 14, (1 << 31) - 1
#: Words that are folded for all tasks at most (about), and documents (in expectation) whose words are counted for that.
COMMON_WORDS, SAMPLE_DOCS = 1 << 19, 1 << 15
#: New distinct words after which a task forgets them; bytes of text and ids of one block; bytes of words that are folded.
MOST_WORDS, BLOCK_BYTES, BLOCK_IDS, LONG_WORD = 1 << 17, 3 << 20, 1 << 18, 256
#: Characters of a text from which on its words are not listed at once.
LONG_TEXT = 1 << 22
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_table(ranks: dict[bytes, int], words: Column) -> Column:
    """The literal map; keys are hexadecimal.

    It stays text in the plan, as its objects take long to send to each task: the condition on `words`, the list that it
    serves, always holds and keeps the optimiser from reading it on the driver."""
    table: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, k in ranks.items():
        table[zlib.crc32(piece) % RANK_BUCKETS][piece.hex().upper()] = k
    return F.from_json(F.when(F.size(words) >= -1, F.lit(json.dumps(table, separators=(",", ":")))), "array<map<string,int>>")


def fold_word(word: Column, table: Column) -> Column:
    """The ids of one word (binary): a word with a rank is that id; else its bytes, with the leftmost pair of least rank
    merged until no pair has a rank.

    The state holds where pieces begin (and, last, where the word ends) and each piece's rank joined with the next."""
    none, never = F.array().cast("array<int>"), F.lit(NO_RANK)
    found = lambda piece: F.try_element_at(F.get(table, F.crc32(piece).bitwiseAND(F.lit(RANK_BUCKETS - 1)).cast("int")), F.hex(piece))
    # No expression is shared between uses, so what takes long is bound by a lambda; pieces that aren't there are null.
    ranks_of = lambda pieces: F.transform(pieces, lambda piece: F.coalesce(found(piece), never))
    n = F.octet_length(word)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))
    start = F.struct(F.sequence(F.lit(1), n + 1).alias("at"), F.concat(ranks_of(pairs), F.array(never)).alias("ranks"))

    def merge(state: Column, _: Column) -> Column:
        at, ranks = state["at"], state["ranks"]

        def put(p: Column) -> Column:
            piece = lambda begin, end: F.substring(word, begin, end - begin)
            own = piece(F.get(at, p - 1), F.get(at, p + 2))
            pieces = F.when(p > 1, F.array(piece(F.get(at, p - 2), F.get(at, p + 1)), own)).otherwise(F.array(own))
            rest = F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), ranks_of(pieces), F.slice(ranks, p + 2, n))
            return F.struct(F.array_remove(at, F.get(at, p)).alias("at"), rest.alias("ranks"))

        return _let(F.array_min(ranks), lambda least: F.when(least == NO_RANK, state).otherwise(_let(F.array_position(ranks, least).cast("int"), put)))

    ids = lambda s: F.transform(F.transform(F.slice(s["at"], F.lit(1), F.size(s["at"]) - 1), lambda begin, i: F.substring(word, begin, F.get(s["at"], i + 1) - begin)), found)
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(none)
    return _let(found(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(F.aggregate(steps, start, merge, ids)))


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What fold_word gives: the leftmost pair of least rank is merged until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before, own = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
    todo: list[tuple[int, int]] = []

    def look(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j < n:
            own[i] = ranks.get(word[i : after[j]], -1)
            if own[i] >= 0:
                heapq.heappush(todo, (own[i], i))
        elif i >= 0:
            own[i] = -1

    for i in range(n):
        look(i)
    while todo:
        rank, i = heapq.heappop(todo)
        if own[i] != rank:
            continue
        j = after[i]
        own[j], after[i] = -2, after[j]
        if after[i] < n:
            before[after[i]] = i
        look(i)
        look(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def split_words(text: str, pattern: regex.Pattern) -> Iterable[str]:
    return pattern.findall(text) if len(text) < LONG_TEXT else (m.group() for m in pattern.finditer(text))


def counted_words(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text) -> (word, n): how often a task met words of at most LONG_WORD bytes; a word may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, counts = regex.compile(pattern), Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            short = [(b, n) for w, n in counts.items() if len(b := w.encode()) <= LONG_WORD]
            yield pa.record_batch([pa.array([b for b, _ in short], pa.binary()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for part in row_blocks(batch, "text", BLOCK_BYTES):
                for text in part["text"].to_pylist():
                    counts.update(split_words(text, match))
                if len(counts) > MOST_WORDS:
                    yield from rows()
        yield from rows()

    return run


class Numbers(dict):
    """Numbers of words in order of their first look-up."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Common:
    """Numbers of the common words: a search among sorted hashes, and the words themselves decide."""

    def __init__(self, words: pa.Array):
        self.words = words
        hashes = np.fromiter((xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The numbers of these words, -1 for others."""
        out = np.full(len(words), -1, np.int64)
        if not len(self) or not words:
            return out
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        number = self.order[at[hit]]
        same = pc.equal(self.words.take(pa.array(number)), pa.array([words[k] for k in hit.tolist()], pa.binary())).to_numpy(zero_copy_only=False)
        out[hit[same]] = number[same]
        return out


def number_words(pattern: str, common: Callable[[], Common], pieces: Callable[[], list[bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) -> blocks: number, id list, sizes (words of each document), codes, fresh (words not met before; null
    for long ones), long (the ids of these), anew (whether earlier fresh words are forgotten).

    Codes are numbers of common words, then of fresh ones in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, shared, ranks = regex.compile(pattern), common(), {}
        known, number = Numbers(), 0
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        for batch in batches:
            for part in row_blocks(batch, "text", BLOCK_BYTES):
                own = Numbers()
                local = [np.fromiter(map(own.__getitem__, split_words(t, match)), np.int32) for t in part["text"].to_pylist()]
                words = [w.encode() for w in own]
                anew = len(known) > MOST_WORDS
                if anew:
                    known = Numbers()
                code, before = shared.find(words), len(known)
                for k in np.flatnonzero(code < 0).tolist():
                    code[k] = len(shared) + known[words[k]]
                fresh = list(itertools.islice(known, before, None))
                long = [w for w in fresh if len(w) > LONG_WORD]
                if long and not ranks:
                    ranks = {piece: k for k, piece in enumerate(pieces()) if piece}
                yield pa.record_batch(
                    [
                        pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["id"]), one([len(c) for c in local], pa.int32()),
                        one(code.astype(np.int32)[np.concatenate(local)] if words else [], pa.int32()), one([w if len(w) <= LONG_WORD else None for w in fresh], pa.binary()),
                        one([heap_merge(w, ranks) for w in long], pa.list_(pa.int32())), pa.array([anew]),
                    ],
                    ["number", "id", "sizes", "codes", "fresh", "long", "anew"],
                )
                number += 1

    return run


class Ragged:
    """Lists of ids by number, which grow at their end."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.starts, self.sizes, self.used, self.n = values, np.cumsum(sizes) - sizes, sizes, len(values), len(sizes)
        self.first = self.used, self.n

    def forget(self) -> None:
        self.used, self.n = self.first

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        room = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) * 5 // 4) - len(x), x.dtype)])
        used, n = self.used + len(values), self.n + len(sizes)
        self.values, self.starts, self.sizes = room(self.values, used), room(self.starts, n), room(self.sizes, n)
        self.values[self.used : used], self.sizes[self.n : n], self.starts[self.n : n] = values, sizes, self.used + np.cumsum(sizes) - sizes
        self.used, self.n = used, n


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list array without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def join_words(common: Callable[[], pa.Array]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with `fresh` folded to ids -> (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Ragged(*flat_lists(common())), 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if row["number"][0].as_py() != number:
                    raise ValueError("blocks of words are out of order")
                number += 1
                if row["anew"][0].as_py():
                    known.forget()
                folded = row["fresh"].flatten()
                if folded.null_count:
                    long = iter(row["long"].flatten().to_pylist())
                    folded = pa.array([next(long) if x is None else x for x in folded.to_pylist()], pa.list_(pa.int32()))
                known.append(*flat_lists(folded))
                codes = row["codes"].flatten().to_numpy()
                sizes = known.sizes[codes]
                ids = _ragged(known.values, known.starts[codes], sizes)
                words = np.cumsum(np.append(0, row["sizes"].flatten().to_numpy()))
                tokens = np.append(0, np.cumsum(sizes))[words]
                yield pa.record_batch([row["id"].flatten(), pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(ids))], ["id", "ids"])

    return run


class ByteBPE:
    """A vocabulary's encoder and decoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ranks = pattern, ranks

    def fold(self, words: Column) -> Column:
        """The ids of each word of a list of binaries; null for null."""
        return _let(rank_table(self.ranks, words), lambda table: F.transform(words, lambda w: F.when(w.isNotNull(), fold_word(w, table))))

    def common_words(self, texts: DataFrame) -> pa.Table:
        """(text) -> (word, ids) of the most frequent words of a sample."""
        scratch = Scratch(texts.sparkSession, "bpe")
        n = texts.count()
        taken = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / max(1, n))))
        counted = taken.mapInArrow(tidied(counted_words(self.pattern)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
        counted = scratch.keep(counted, "counted")
        distinct = counted.count()
        if distinct > COMMON_WORDS:
            least = counted.agg(F.percentile_approx("n", 1 - COMMON_WORDS / distinct)).first()[0]
            counted = counted.filter(F.col("n") > least)
        lists = counted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(16))).groupBy("part").agg(F.collect_list("word").alias("words")).coalesce(12)
        out = lists.select(F.explode(F.arrays_zip("words", self.fold(F.col("words")).alias("ids"))).alias("w")).select("w.words", "w.ids").toArrow()
        scratch.drop("counted")
        return out

    def _folded(self, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
        """Blocks of numbered words with the ids of fresh ones, and the step that puts documents together."""
        bounded_batches(docs.sparkSession)
        rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        common = self.common_words(rows.select("text")).combine_chunks()
        column = lambda k, kind: common.column(k).chunk(0) if common.num_rows else pa.array([], kind)
        words, ids, pieces = (send(docs.sparkSession, x) for x in (Common(column(0, pa.binary())), column(1, pa.list_(pa.int32())), self.pieces()))
        ints = ArrayType(IntegerType())
        fields = [StructField("id", ArrayType(docs.schema[id_col].dataType)), StructField("sizes", ints), StructField("codes", ints)]
        blocks = rows.mapInArrow(tidied(number_words(self.pattern, lambda: words.value, lambda: pieces.value)), StructType([*StructType.fromDDL("number long"), *fields, *StructType.fromDDL("fresh array<binary>, long array<array<int>>, anew boolean")]))
        return blocks.withColumn("fresh", self.fold(F.col("fresh"))), join_words(lambda: ids.value)

    def _coded(self, docs: DataFrame, id_col: str, text_col: str, fields: str, *steps: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
        """id and `fields`, which `steps` make of (id, ids), in one Arrow step."""
        blocks, join = self._folded(docs, id_col, text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = join(batches)
            for step in steps:
                out = step(out)
            return out

        schema = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL(fields)])
        return blocks.mapInArrow(tidied(run), schema).withColumnRenamed("id", id_col)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: id, ids (array of int).

        A null text counts as empty and has no ids. Special tokens' strings are ordinary text. Rows that repeat an id or
        a text are encoded each; null ids stay null. Other columns are ignored. An empty table gives an empty result.
        """
        return self._coded(docs, id_col, text_col, "ids array<int>")

    def encode_decode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """encode and decode in one Arrow step: id, ids, decoded (binary)."""
        return self._coded(docs, id_col, text_col, "ids array<int>, decoded binary", self._decoder(docs))

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """encode, decode and digests in one Arrow step: id, n_tokens, ids_sha256, decoded_sha256."""
        return self._coded(docs, id_col, text_col, DIGESTS, self._decoder(docs), digest_lists)

    def pieces(self) -> list[bytes]:
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for piece, k in self.ranks.items():
            by_id[k] = piece
        return by_id

    def _decoder(self, df: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        pieces = send(df.sparkSession, self.pieces())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.array(pieces.value, pa.large_binary())
            for batch in batches:
                for part in list_blocks(batch, "ids", BLOCK_IDS):
                    taken, at = joined(table, part["ids"])
                    yield pa.record_batch([part["id"], part["ids"], pa.array([taken[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "ids", "decoded"])

        return run

    def decode(self, encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(id, ids) -> id, ids, decoded (binary). Null ids decode to no bytes; an id outside the vocabulary fails."""
        out = StructType([StructField("id", encoded.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType())), *StructType.fromDDL("decoded binary")])
        return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(tidied(self._decoder(encoded)), out).withColumnRenamed("id", id_col)


def joined(table: pa.Array, lists: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The table's entries at all ids of all lists in one buffer, and where each list's part begins."""
    ids = lists.flatten()
    taken = table.take(ids)
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8) if len(taken) else np.zeros(1, np.int64)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return memoryview(taken.buffers()[2] or b"").cast("B"), ends[np.append(0, np.cumsum(counts))]


_DECIMALS: dict[int, pa.Array] = {}


def decimals(n: int) -> pa.Array:
    """The numbers below n, each with a comma."""
    if n not in _DECIMALS:
        _DECIMALS[n] = pa.array([b"%d," % k for k in range(n)], pa.large_binary())
    return _DECIMALS[n]


def digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids, decoded) -> id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    for batch in batches:
        for part in list_blocks(batch, "ids", BLOCK_IDS):
            text, at = joined(decimals(1 << ((pc.max(part["ids"].flatten()).as_py() or 0) + 1).bit_length()), part["ids"])
            hashes = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            bodies = [hashlib.sha256(x.as_buffer()).hexdigest() for x in part["decoded"]]
            yield pa.record_batch([part["id"], pc.list_value_length(part["ids"]).cast(pa.int64()), pa.array(hashes, pa.string()), pa.array(bodies, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    kind = decoded.schema[id_col].dataType
    out = StructType([StructField("id", kind), *StructType.fromDDL(DIGESTS)])
    return decoded.select(F.col(id_col).alias("id"), "ids", "decoded").mapInArrow(tidied(digest_lists), out).withColumnRenamed("id", id_col)
