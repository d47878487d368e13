"""Secret scans over an incremental blob ledger.

Every version of every document is addressed by the sha256 of its text. The ledger remembers which blobs were scanned
under which version of the rules and what was found; a scan reads only blobs that the ledger lacks for the present
rules, each once, and findings are joined back to all documents (paths, versions) that hold the blob. The version of
rules is a digest of the rules themselves, so that changed rules never meet old findings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, row_blocks, ship, text_of, tidied

ship(__name__)


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern, of which those with `group` shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


#: Kinds in order of listing, with their patterns and lengths.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
SPANS = "array<struct<kind: string, begin: int, end: int>>"
FOUND = f"blob string, rules string, spans {SPANS}"


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:32]


class Ledger:
    """An append-only table of findings in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], FOUND).write.mode("append").parquet(path)

    def rows(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, spans) of what was scanned under these rules."""
        return self.spark.read.schema(FOUND).parquet(self.path).filter(F.col("rules") == rules_version(rules)).select("blob", "spans")

    def append(self, found: DataFrame) -> None:
        found.write.mode("append").parquet(self.path)


def compiled(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern]]:
    """Patterns with ASCII letter cases. A run without a leading literal is matched at its least length only, which
    gives the same matches: what is dropped of a greedy run can't begin a longer one."""
    return [(r, re.compile(re.sub(r"\+$", f"{{{r.least},}}", r.pattern) if r.pattern.startswith("[") else r.pattern, re.ASCII)) for r in rules]


def spans_of(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    found = [(m.start(), k, r.kind, m.end()) for k, (r, p) in enumerate(rules) for m in p.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
    return [(kind, begin, end) for begin, _, kind, end in sorted(found)]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) -> blob, rules, spans: a ledger row for each blob, also for those without findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, version = compiled(rules), rules_version(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in row_blocks(batch, "text"):
                spans = [[dict(zip(("kind", "begin", "end"), x, strict=True)) for x in spans_of(t, patterns)] for t in part["text"].to_pylist()]
                yield pa.record_batch([part["blob"], pa.array([version] * part.num_rows, pa.string()), pa.array(spans, kind)], ["blob", "rules", "spans"])

    return blobs.select("blob", "text").mapInArrow(tidied(run), FOUND)


def unseen(paths: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text), once each, of the blobs that the ledger lacks under these rules."""
    return paths.select("blob", "text").dropDuplicates(["blob"]).join(ledger.rows(rules).select("blob"), "blob", "left_anti")


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, blob, spans; the ledger (a new one if none is given) learns the blobs it lacked.

    Spans are in code points, the end exclusive, by start and then by rule. A null text counts as empty, null ids stay
    null. Rows that repeat an id (versions) or a text are all listed; equal texts are scanned once. Texts of any length
    are read whole. Other columns are ignored. An empty table gives an empty result. A writer that fails half way leaves
    the ledger as it was, and one blob that two writers append at a time is listed once.
    """
    bounded_batches(docs.sparkSession)
    ledger = ledger or Ledger(docs.sparkSession, f"{Scratch(docs.sparkSession, 'secrets').root}/ledger")
    paths = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    ledger.append(scan_blobs(unseen(paths, ledger, rules), rules))
    known = ledger.rows(rules).groupBy("blob").agg(F.first("spans").alias("spans"))
    return paths.select("id", "blob").join(known.hint("merge"), "blob", "left").select(F.col("id").alias(id_col), "blob", "spans")


def counted(found: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, a count for each kind, base_sha256 and spans as text (kind:start:end, comma-joined)."""
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in rules]
    return found.select(id_col, *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"), listed.alias("spans"))
