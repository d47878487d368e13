"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two units (words, or single letters spelled out with spaces) counts common subsequences of P letters,
weighted by DECAY to the power of the letters' spans; other characters inside a unit are skipped, and spans reach at
most SPAN letters. So `idiot`, `i.d.i.o.t`, `i d i o t` and `idxiot` are close to each other.

Labels mark documents; a labelled sentence is positive where its document is toxic and one of its units has a telling
part: a letter sequence that toxic documents share and clean ones lack. Units of positive sentences with such a part
are the positive examples, with bent ones (a letter put in) of the frequent ones; units of clean sentences are the
negative ones, hard ones found in rounds. Landmarks are the frequent ones and a sample of both. The machine is linear in the landmarks' kernel values and these are linear in a unit's weighted
subsequences, so that it collapses to one weight for each hashed subsequence: a unit is scored by a few look-ups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_batches, fold, row_blocks, send, ship, tidied

ship(__name__)

P, SPAN, DECAY, BITS = 3, 6, 0.6, 15
#: Units longer than this are scored in overlapping windows of it.
WIDTH = 24
#: Labelled documents that training takes at most (in expectation), by their id's hash; landmarks; examples of a class.
MAX_TRAIN_DOCS, LANDMARKS, MAX_EXAMPLES = 4000, 384, 6000
#: Telling parts: lengths, least toxic documents, and how much oftener they occur in toxic documents.
PARTS, LEAST_DOCS, RATIO = (4, 5, 6), 3, 30.0
ROUNDS, STEPS, SLOPE = 4, 400, 6.0
UNITS_KEPT = 1 << 18
_SPELLED = re.compile(r"(?<!\S)(?:\S\s){3,}\S(?!\S)")
_OTHER = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
#: Places of P letters inside a span, the first at 0.
PLACES = [(0, i, j) for j in range(2, SPAN) for i in range(1, j)]


def units(text: str | None) -> set[str]:
    """The distinct units of a text: lower-case words and joined spelled-out letters, without other characters."""
    low = (text or "").lower()
    spelled = {_OTHER.sub("", m) for m in _SPELLED.findall(low)}
    return set(low.split()) | spelled


def letters_of(unit: str) -> str:
    return unit if unit.isalpha() else _OTHER.sub("", unit)


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes: letters of each window, 0 beyond its end; lengths; index of the word). Short words have no window."""
    parts, owner = [], []
    for k, w in enumerate(words):
        if len(w) >= P:
            for s in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2):
                parts.append(w[s : s + WIDTH])
                owner.append(k)
    if not parts:
        return np.zeros((0, WIDTH), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = "".join(p.ljust(WIDTH, "\0") for p in parts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, np.uint32).reshape(-1, WIDTH), np.array([len(p) for p in parts]), np.array(owner)


def _norms() -> np.ndarray:
    out = np.ones(WIDTH + 1)
    for n in range(P, WIDTH + 1):
        out[n] = np.sqrt(sum(DECAY ** (2 * (j + 1)) * max(0, n - j) for _, _, j in PLACES))
    return out


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of P places: buckets (windows by starts), whether they lie in the window, and the weight."""
    for a, b, c in PLACES:
        n = WIDTH - c
        x, y, z = codes[:, a : a + n], codes[:, b : b + n], codes[:, c : c + n]
        h = ((x * np.uint32(0x9E3779B1)) ^ y) * np.uint32(0x85EBCA6B) ^ z
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        yield h >> np.uint32(32 - BITS), z != 0, DECAY ** (c + 1)


def feature_rows(words: list[str]) -> np.ndarray:
    """Dense normalised subsequence weights of short lists of words (the first window of each)."""
    codes, lengths, owner = windows(words)
    out = np.zeros((len(words), 1 << BITS), np.float32)
    norms = _norms()
    for bucket, some, weight in subsequences(codes):
        row, col = np.nonzero(some)
        first = np.append(True, owner[1:] != owner[:-1])[row] if len(owner) else np.zeros(0, bool)
        np.add.at(out, (owner[row[first]], bucket[row[first], col[first]]), weight)
    size = np.array([norms[min(WIDTH, len(w))] if len(w) >= P else 1.0 for w in words], np.float32)
    return out / size[:, None]


def score_units(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's output for each word, over its windows the largest; -4 for words without a window."""
    out = np.full(len(words), -4.0)
    for begin in range(0, len(words), 20_000):
        codes, lengths, owner = windows(words[begin : begin + 20_000])
        if not len(codes):
            continue
        total = np.zeros(len(codes))
        for bucket, some, weight in subsequences(codes):
            total += weight * np.where(some, table[bucket], 0).sum(1)
        np.maximum.at(out, begin + owner, total / _norms()[lengths] + bias)
    return out


def telling_parts(toxic: list[set[str]], clean: list[set[str]]) -> set[str]:
    common = Counter(w for d in clean for w in d)
    parts = lambda w: {w[i : i + n] for n in PARTS for i in range(len(w) - n + 1)}
    found: Counter[str] = Counter()
    for d in toxic:
        found.update({p for w in d if not common[w] for p in parts(w)})
    found = Counter({p: n for p, n in found.items() if n >= LEAST_DOCS})
    other: Counter[str] = Counter()
    for w, n in common.items():
        for p in parts(w):
            if p in found:
                other[p] += n
    share = lambda n, d: n / max(1, len(d))
    return {p for p, n in found.items() if share(n, toxic) >= RATIO * share(other[p] + 0.5, clean)}


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss by averaged subgradient steps over balanced batches; positive examples are drawn by weight."""
    rng = np.random.default_rng(seed)
    w, b, mean_w, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
    lam = 1e-4
    for t in range(1, STEPS + 1):
        at = np.concatenate([rng.choice(pos, 128, p=weight / weight.sum()), rng.choice(neg, 256)])
        off = y[at] * (x[at] @ w + b) < 1
        step = 1 / (lam * (t + 1000))
        w *= 1 - step * lam
        w += step / len(at) * (y[at] * off) @ x[at]
        b += step / len(at) * 0.1 * (y[at] * off).sum()
        if t > STEPS // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    n = STEPS - STEPS // 2
    return mean_w / n, mean_b / n


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """(a weight for each subsequence bucket, bias). Equal units are held once."""
    rng = np.random.default_rng(seed)
    pool: dict[str, str] = {}
    plain = lambda t: {pool.setdefault(u, u) for u in map(letters_of, units(t)) if len(u) >= P}
    toxic = [plain(t) for t, y in zip(texts, labels, strict=True) if y]
    clean = [plain(t) for t, y in zip(texts, labels, strict=True) if not y]
    parts = telling_parts(toxic, clean)
    safe = sorted({w for d in clean for w in d})
    telling = set()
    for t, y in zip(texts, labels, strict=True):
        if y:
            for sentence in _SENTENCE.split(t or ""):
                telling |= {w for w in plain(sentence) if any(w[i : i + n] in parts for n in PARTS for i in range(len(w) - n + 1))}
    positive = sorted(telling - set(safe))
    if not positive or not safe:
        return np.zeros(1 << BITS, np.float32), -1.0
    pick = lambda xs, n: [xs[k] for k in sorted(rng.choice(len(xs), min(n, len(xs)), replace=False))]
    positive, negative = pick(positive, MAX_EXAMPLES), pick(safe, MAX_EXAMPLES // 2)
    table, bias = np.zeros(1 << BITS, np.float32), -1.0
    often = Counter(w for d in toxic for w in d)
    frequent = sorted(positive, key=lambda w: (-often[w], w))[: LANDMARKS // 4]
    landmarks = frequent + pick(sorted(set(positive) - set(frequent)), LANDMARKS // 4) + pick(negative, LANDMARKS // 2)
    bent = [w[:k] + chr(ord("a") + int(rng.integers(26))) + w[k:] for w in frequent for k in rng.integers(1, len(w), 3)]
    weight = np.array([often[w] + 1 for w in positive] + [often[w] / 6 for w in frequent for _ in range(3)], float)
    positive = positive + bent
    marks = feature_rows(landmarks)
    value, vector = np.linalg.eigh(marks @ marks.T)
    whiten = vector / np.sqrt(np.maximum(value, 1e-3))
    project = lambda ws: np.concatenate([feature_rows(ws[k : k + 200]) @ marks.T for k in range(0, len(ws), 200)]) @ whiten
    good, bad = project(positive), project(negative)
    for k in range(ROUNDS):
        w, bias = svm(np.concatenate([good, bad]), np.append(np.ones(len(good)), -np.ones(len(bad))), weight, seed + k)
        table = ((whiten @ w) @ marks).astype(np.float32)
        scored = score_units(safe, table, bias)
        hard = [safe[j] for j in np.argsort(-scored)[:1000] if scored[j] > -0.5]
        if not hard:
            break
        bad = np.concatenate([bad, project(hard)])
    return table, bias - threshold(toxic, clean, table, bias)


def threshold(toxic: list[set[str]], clean: list[set[str]], table: np.ndarray, bias: float) -> float:
    """Where the documents' worst units part with the fewest errors: the middle of the widest such place."""
    every = sorted(set().union(*toxic, *clean))
    of = dict(zip(every, score_units(every, table, bias).tolist(), strict=True))
    worst = lambda ds: np.sort([max((of[w] for w in d), default=-4.0) for d in ds])
    t, c = worst(toxic), worst(clean)
    cuts = np.unique(np.concatenate([t, c, [-4.0, 4.0]]))
    middle, gap = (cuts[1:] + cuts[:-1]) / 2, np.diff(cuts)
    errors = np.searchsorted(t, middle) + (len(c) - np.searchsorted(c, middle))
    best = np.flatnonzero(errors == errors.min())
    return float(middle[best[gap[best].argmax()]])


class UnitScores(dict):
    """Scores of units that a task has met; forgets all once it holds UNITS_KEPT."""

    def __init__(self, table: np.ndarray, bias: float):
        super().__init__()
        self.table, self.bias = table, bias

    def learn(self, found: set[str]) -> None:
        if len(self) > UNITS_KEPT:
            self.clear()
        new = sorted(found - self.keys())
        self.update(zip(new, score_units([letters_of(u) for u in new], self.table, self.bias).tolist(), strict=True))


def score_texts(texts: list[str | None], known: UnitScores) -> list[float]:
    each = [units(t) for t in texts]
    known.learn(set().union(*each))
    best = np.array([max(map(known.__getitem__, u), default=-4.0) for u in each])
    return (1 / (1 + np.exp(-SLOPE * np.clip(best, -4, 4)))).tolist()


def train(docs: DataFrame, labels: DataFrame, where: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """A model from about `max_docs` labelled documents that meet `where`, evenly by the id's hash.

    Null labels are left out, null texts count as empty; without telling parts every document is clean.
    """
    marked = labels.filter(where & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = marked.count()
    marked = marked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_docs / max(1, n))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked, "id").orderBy("id", "label").toArrow()
    return fit(rows["text"].to_pylist(), rows["label"].to_numpy()) if rows.num_rows else (np.zeros(1 << BITS, np.float32), -1.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """`docs` without the text, with score: how toxic the worst unit is. Null and blank texts score near 0."""
    bounded_batches(docs.sparkSession)
    shared = send(docs.sparkSession, model)
    rest = [f for f in docs.schema.fields if f.name not in (text_col, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = UnitScores(*shared.value)
        for batch in batches:
            for part in row_blocks(batch, text_col):
                scores = score_texts(part[text_col].to_pylist(), known)
                yield pa.record_batch([*(part[f.name] for f in rest), pa.array(scores, pa.float64())], [*(f.name for f in rest), "score"])

    return docs.select(*(f.name for f in rest), text_col).mapInArrow(tidied(run), StructType([*rest, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from labels whose crc32(doc_id) mod 5 is not 0.

    Repeated rows are scored each. Rows of `labels` without a document teach nothing. Other columns are ignored.
    """
    held = fold("doc_id", 5, 0)
    model = train(docs, labels, ~held)
    scored = score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
