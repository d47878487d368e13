"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, unordered pairs of adjacent words, and the character
n-grams inside and at the ends of words; a softmax over two classes follows. Both layers are trained on the driver by stochastic
gradient descent in numpy, over a bounded sample of labelled documents. As the output is linear in the average, scoring
needs one number for each hash bucket: the difference of the two outputs of its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WordHashes, bounded_batches, fold, row_blocks, send, ship, tidied

ship(__name__)

ORDERS, GRAM_BITS, WORD_BITS, DIM = (3, 4), 17, 17, 12
BUCKETS = (1 << GRAM_BITS) + (2 << WORD_BITS)
#: Labelled documents that training takes at most (in expectation), by their id's hash; passes; first step size.
MAX_TRAIN_DOCS, EPOCHS, RATE = 4000, 4, 0.6
CHUNK = 1 << 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the n-grams of code points at the first `starts` places that hold white space at their ends only."""
    space, out = (data == 32) | ((data >= 9) & (data <= 13)), []
    h = data
    inner = np.zeros(len(data), bool)
    for order in range(2, max(ORDERS) + 1):
        n = len(data) - order + 1
        if n <= 0:
            break
        h = (h[:n] * np.uint32(0x01000193)) ^ data[order - 1 :]
        inner = inner[:n] | (space[order - 2 : order - 2 + n] if order > 2 else False)
        if order in ORDERS:
            mixed = (h + np.uint32(order)) * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(32 - GRAM_BITS))[:starts][~inner[:starts]])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def features(text: str | None, known: WordHashes) -> Iterator[np.ndarray]:
    """The buckets of a text, with repetitions, in pieces of bounded size."""
    text = text or ""
    for begin in range(0, len(text) + 2, CHUNK):
        # One space before and after the text.
        part = text[max(0, begin - 1) : begin + CHUNK + max(ORDERS) - 2]
        part = (" " if not begin else "") + part + (" " if begin + CHUNK + max(ORDERS) - 2 > len(text) else "")
        yield grams(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), CHUNK)
    words = text.encode("utf-8", "surrogatepass").split()
    for begin in range(0, len(words), CHUNK):
        h = np.fromiter(map(known.__getitem__, words[max(0, begin - 1) : begin + CHUNK]), np.uint64)
        yield ((h[min(begin, 1) :] * _SPREAD) >> np.uint64(64 - WORD_BITS)).astype(np.int64) + (1 << GRAM_BITS)
        # A pair's hash is the XOR of its words', so that every word next to itself is the same pair.
        yield (((h[:-1] ^ h[1:]) * _SPREAD) >> np.uint64(64 - WORD_BITS)).astype(np.int64) + ((1 << GRAM_BITS) + (1 << WORD_BITS))


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias): the log-odds of label 1 is bias plus the mean of the numbers."""
    rng, known = np.random.default_rng(seed), WordHashes()
    docs = []
    for t in texts:
        every = np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x in features(t, known))])
        at, n = np.unique(every, return_counts=True)
        docs.append((at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    share = labels.mean() if len(labels) else 0.5
    bias[:] = np.log([max(1e-3, 1 - share), max(1e-3, share)])
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            at, w = docs[k]
            if not len(at):
                continue
            step = rate * (1 - done / steps)
            done += 1
            rows = vectors[at]
            hidden = w @ rows
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            off = p / p.sum()
            off[labels[k]] -= 1
            back = out @ off
            out -= step * np.outer(hidden, off)
            bias -= step * 0.1 * off
            vectors[at] = rows - step * len(at) ** 0.5 * np.outer(w, back)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_text(text: str | None, table: np.ndarray, bias: float, known: WordHashes) -> float:
    total, n = 0.0, 0
    for x in features(text, known):
        total += float(table[x].sum(dtype=np.float64))
        n += len(x)
    return float(1 / (1 + np.exp(-np.clip(bias + total / max(1, n), -40, 40))))


def train(docs: DataFrame, labels: DataFrame, where: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """A model from about `max_docs` labelled documents that meet `where`, evenly by the id's hash.

    Null labels are left out, null texts count as empty; without rows every score is a half.
    """
    marked = labels.filter(where & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = marked.count()
    marked = marked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_docs / max(1, n))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked, "id").orderBy("id", "label").toArrow()
    return fit(rows["text"].to_pylist(), rows["label"].to_numpy().astype(np.int64)) if rows.num_rows else (np.zeros(BUCKETS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """`docs` without the text, with score: the probability of label 1. Null and blank texts get what a space gets."""
    bounded_batches(docs.sparkSession)
    shared = send(docs.sparkSession, model)
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (table, bias) = WordHashes(), shared.value
        for batch in batches:
            for part in row_blocks(batch, text_col):
                scores = [score_text(t, table, bias, known) for t in part[text_col].to_pylist()]
                yield pa.record_batch([*(part[f.name] for f in rest), pa.array(scores, pa.float64())], [*(f.name for f in rest), "score"])

    return docs.select(*(f.name for f in rest), text_col).mapInArrow(tidied(run), StructType([*rest, StructField("score", DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from labels whose crc32(doc_id) mod 4 is not 2.

    Repeated rows are scored each and equal texts equally; texts of any length are read whole, in parts. Rows of
    `labels` without a document or a label teach nothing; a document with several label rows, or several rows of an id,
    teaches each combination. Null ids stay null and have no labels. Other columns are ignored; an empty table gives an
    empty result.
    """
    held = fold("doc_id", 4, 2)
    model = train(docs, labels, ~held)
    scored = score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
