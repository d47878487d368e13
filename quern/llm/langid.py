"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled documents on the executors; the driver gets one row per language
and bucket that occur together. The matrix of log-probabilities is broadcast as its sparse part: for each bucket the
languages that have seen it, with what they have more than a bucket that they have not seen. Scoring counts the
distinct (document, bucket) pairs of a block of texts and adds count times entry, in numpy. Log-probabilities are whole
numbers of 1/1024, so that sums don't depend on how texts are batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded_batches, fold, quoted, row_blocks, send, ship, tidied

ship(__name__)

ORDERS, BUCKETS, SCALE = (1, 2, 3), 1 << 16, 1024
#: Positions that are hashed at once, and separators between texts: no n-gram reaches from one to the next.
CHUNK, GAP = 1 << 19, "\x00" * (max(ORDERS) - 1)
#: Documents that training takes at most (in expectation), by their id's hash.
MAX_TRAIN_DOCS = 20_000
#: Matrix entries that are added at once, and cells (document, language) of a block's sums.
MOST_ENTRIES, MOST_CELLS = 1 << 21, 1 << 20


@dataclass
class Model:
    """Entries first[b] : first[b + 1] of `lang` and `more` belong to bucket b; `base` is each language's log-probability
    of a bucket without an entry."""

    langs: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    base: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1, np.int64))
    lang: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    more: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def model_of(langs: list[str], docs: np.ndarray, lang: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> Model:
    """From documents by language and n occurrences of each (language, bucket), with half an occurrence added to all."""
    total = np.bincount(lang, n, minlength=len(langs)) + 0.5 * BUCKETS
    whole = lambda x: np.rint(np.log(x) * SCALE).astype(np.int64)
    base = whole(0.5 / total)
    order = np.lexsort((lang, bucket))
    lang, bucket, n = lang[order], bucket[order], n[order]
    first = np.append(0, np.cumsum(np.bincount(bucket, minlength=BUCKETS)))
    return Model(langs, whole(docs / docs.sum()), base, first, lang.astype(np.int32), whole((n + 0.5) / total[lang]) - base[lang])


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, 0 for anything else, and where each text begins."""
    parts = [t.lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + len(GAP) for t in parts)])[:-1]
    points = np.frombuffer((GAP.join(parts) + GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[points], points, 0).astype(np.uint32), starts


def ngrams(points: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each of these positions, and whether it has a letter at its ends."""
    pad = np.zeros(max(ORDERS), np.uint32)
    own = np.concatenate([points[begin : end + max(ORDERS) - 1], pad])
    n = end - begin
    h = np.zeros(n, np.uint32)
    for order in range(1, max(ORDERS) + 1):
        last = own[order - 1 : order - 1 + n]
        h = (h ^ last) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if order in ORDERS:
            some = (own[:n] != 0) | (last != 0)
            yield ((h + np.uint32(order)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 16), some


def pair_counts(points: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, n) of the distinct pairs among all n-grams, in parts; rows[k] is the row of the text at starts[k]."""
    s = 0
    while s < len(points):
        at = int(np.searchsorted(starts, s, "right")) - 1
        e = min(s + CHUNK, len(points), *(starts[at + (1 << 16) : at + (1 << 16) + 1]))
        texts = np.arange(at, np.searchsorted(starts, e, "left"))
        own = np.repeat((texts - at).astype(np.uint32) << 16, np.diff(np.append(np.maximum(starts[texts], s), e)))
        keys = np.sort(np.concatenate([(own | bucket)[some] for bucket, some in ngrams(points, s, e)]))
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        pairs = keys[begin]
        yield rows[at + (pairs >> 16).astype(np.int64)], (pairs & 0xFFFF).astype(np.int64), np.diff(np.append(begin, len(keys)))
        s = int(e)


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, bucket, n), a row for each block of texts; bucket -1 counts documents."""
    for batch in batches:
        for part in row_blocks(batch, "text"):
            coded = part["lang"].dictionary_encode()
            langs = coded.indices.to_numpy().astype(np.int64)
            points, starts = code_points([t or "" for t in part["text"].to_pylist()])
            docs = np.bincount(langs, minlength=len(coded.dictionary))
            found = [(np.arange(len(docs)), np.full(len(docs), -1), docs), *pair_counts(points, starts, langs)]
            for lang, bucket, n in found:
                yield pa.record_batch({"lang": coded.dictionary.take(pa.array(lang)), "bucket": pa.array(bucket, pa.int64()), "n": pa.array(n, pa.int64())})


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """A model from about `max_docs` rows, evenly by the id's hash, of those that meet `where` and have a language.

    Null texts count as empty, rows that repeat an id are learned each; without rows the model knows no language. There
    is no limit to the number of languages.
    """
    rows = docs.filter(where & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    bounded_batches(docs.sparkSession)
    n = rows.count()
    rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_docs / max(1, n)))).drop("h")
    got = rows.mapInArrow(tidied(count_ngrams), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, bucket, n = got["lang"].to_pylist(), got["bucket"].to_numpy(), got["n"].to_numpy()
    langs = sorted(set(names), key=lambda x: x.encode())
    if not langs:
        return Model()
    of = {x: k for k, x in enumerate(langs)}
    lang = np.fromiter((of[x] for x in names), np.int64, len(names))
    seen = bucket >= 0
    return model_of(langs, np.bincount(lang[~seen], n[~seen], minlength=len(langs)), lang[seen], bucket[seen], n[seen])


def score_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    width = max(1, MOST_CELLS // max(1, len(model.langs)))
    parts = [score_block(model, texts[k : k + width]) for k in range(0, len(texts), width)]
    return [x for langs, _ in parts for x in langs], np.concatenate([np.zeros(0), *(p for _, p in parts)])


def score_block(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    points, starts = code_points(texts)
    width = len(model.langs)
    total, grams = np.zeros(len(texts) * width), np.zeros(len(texts))
    for row, bucket, n in pair_counts(points, starts, np.arange(len(texts))):
        grams += np.bincount(row, n, minlength=len(texts))
        sizes = model.first[bucket + 1] - model.first[bucket]
        sums, k = np.cumsum(sizes), 0
        while k < len(row):
            end = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + MOST_ENTRIES, "right")))
            own = sizes[k:end]
            entry = np.arange(own.sum()) + np.repeat(model.first[bucket[k:end]] - (np.cumsum(own) - own), own)
            first, last = row[k], row[end - 1] + 1  # rows are in order
            cell = np.repeat((row[k:end] - first) * width, own) + model.lang[entry]
            total[first * width : last * width] += np.bincount(cell, np.repeat(n[k:end], own) * model.more[entry], minlength=(last - first) * width)
            k = end
    total = total.reshape(len(texts), width) + grams[:, None] * model.base + model.prior
    alpha = np.add.reduceat(points != 0, starts) if len(texts) else grams
    best = total.argmax(1)
    x = total / SCALE / np.maximum(1.0, grams / 64)[:, None]
    p = np.exp(x - x.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    known = alpha > 0
    return [model.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)], np.where(known, p[np.arange(len(texts)), best], 0.0)


def identify(docs: DataFrame, model: Model, text_col: str = "text", with_text: bool = False, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """One row per input row: the columns of `docs` (the text if asked for) but for those called pred_col or score_col,
    then these two.

    A null text, or one without a letter, is `und` with score 0, as is any text under a model without languages. The
    score is the posterior of the predicted language, tempered as if the text had 64 n-grams. Ties go to the first
    language by code point. Repeated rows get equal results; texts of any length are read whole, in parts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = send(spark, model)
    rest = [f for f in docs.schema.fields if (with_text or f.name != text_col) and f.name.lower() not in (pred_col.lower(), score_col.lower())]
    # Columns go by their place: mapInArrow looks names up as they are, which fails for some.
    fields = [StructField(f"c{k}", f.dataType) for k, f in enumerate(rest)] + [StructField("pred", StringType()), StructField("score", DoubleType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, "text"):
                langs, scores = score_texts(shared.value, [t or "" for t in part["text"].to_pylist()])
                yield pa.record_batch([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    taken = docs.select(*(quoted(f.name).alias(c) for f, c in zip(rest, names, strict=False)), quoted(text_col).alias("text"))
    return taken.mapInArrow(tidied(run), StructType(fields)).toDF(*(f.name for f in rest), pred_col, score_col)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those whose crc32(doc_id) mod 4 is not 2.

    A null id counts as the text '' for the fold and stays null. Rows are predicted each, also those that repeat an id or
    a text. Null and empty texts, and texts without a letter, are `und` with score 0. Only doc_id, text and lang are
    read. An empty table gives an empty result.
    """
    held = fold("doc_id", 4, 2)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), train(docs, ~held))
