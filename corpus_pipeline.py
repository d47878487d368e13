"""A corpus pipeline of the training-data operators, stage by stage.

Every stage takes the documents that its predecessor kept (columns doc_id, text, lang, source, n_chars; others pass
through the first four stages) and is judged by itself. Rows are told apart by a number of their own, not by doc_id:
each of the rows that repeat an id, or have none, is a document. A null id comes last where the smallest id decides, and
of rows with one id the first as read. A null text counts as empty, a null source is a source. Empty tables pass. Columns
that a stage needs for itself get names that its documents don't have.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import ByteBPE, read_ranks
from quern.llm.common import Scratch, fold, quoted, text_of, unused
from quern.llm.exact_dedup import exact_dedup
from quern.llm.langid import identify, train
from quern.llm.mixing import mix
from quern.llm.near_dedup import near_dedup
from quern.llm.queries import VOCABULARY

#: A document whose language is found with less certainty is rejected.
LEAST_SCORE = 0.5


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a unique number, written so that every reading has the same numbers, and that column's name.

    Whole texts are written, so tables of earlier stages go first, if nothing reads them any more."""
    Scratch.sweep(docs.sparkSession)
    row = unused(docs, "_row")
    return Scratch(docs.sparkSession, name).keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd"), row


def _one_each(rows: DataFrame, row: str, groups: DataFrame, *before_id: Column) -> DataFrame:
    """Of each group of rows (row, group) the first by `before_id`, then by doc_id."""
    order = rows.select(row, F.struct(*before_id, F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row")).alias("order"))
    first = groups.join(order.hint("merge"), row).groupBy("group").agg(F.min("order").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(first.hint("merge"), row, "left_semi").drop(row)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters or of uncertain language; a null lang takes the language found."""
    model = train(docs, ~fold("doc_id", 4, 2))
    pred, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = identify(docs, model, with_text=True, pred_col=pred, score_col=score)
    kept = found.filter((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*map(quoted, docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, keep the one with the longest text."""
    rows, row = _numbered(docs, "exact-stage")
    groups = exact_dedup(rows, id_col=row).select(row, F.col("keep_id").alias("group"))
    return _one_each(rows, row, groups, (-F.char_length(text_of())).alias("shorter"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8 or more) keep the document of least id."""
    rows, row = _numbered(docs, "near-stage")
    groups = near_dedup(rows, id_col=row).select(row, F.col("component_id").alias("group"))
    return _one_each(rows, row, groups)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix has copies of it."""
    rows, row = _numbered(docs, "mixing-stage")
    copies = mix(rows, row_col=row).filter("copies > 0").select(row, F.sequence(F.lit(1), F.col("copies").cast("int")).alias("copies"))
    taken = rows.select(row, F.struct(*map(quoted, docs.columns)).alias("doc")).join(copies.hint("merge"), row)
    return taken.select("doc", F.explode("copies")).select("doc.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the bytes that the ids decode to) for each row."""
    bpe = ByteBPE(read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    coded = bpe.encode_decode(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: SQL can't express the learned and iterative stages; tests/llm/test_pipeline.py holds each stage against a brute-force
#: version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
