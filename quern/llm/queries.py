"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBPE, read_ranks
from .common import read
from .exact_dedup import exact_dedup
from .langid import language_id
from .merkle import compare_edits
from .mixing import mix
from .near_dedup import near_dedup
from .quality import quality
from .secrets import counted, scan
from .substring_dedup import substring_dedup
from .toxicity import toxicity


#: The vocabulary file of op1 and of the pipeline.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = ByteBPE(read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), threshold=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_merkle": op7_merkle,
    "op8_secrets": op8_secrets,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
        g AS (SELECT t, count(*) AS group_size, arg_max(doc_id, struct_pack(a := cp, b := -doc_id)) AS keep_id FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op8_secrets": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        rule(kind, k, pattern, grp, least) AS (VALUES
            ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
            ('access', 1, 'AKIA([A-Z0-9]+)', 1, 14),
            ('hex', 2, '([0-9a-f]+)', 1, 16)),
        m AS (
            SELECT doc_id, 'assign' AS kind, regexp_extract_all(x, (SELECT pattern FROM rule WHERE k = 0), 0) AS hit, regexp_extract_all(x, (SELECT pattern FROM rule WHERE k = 0), 2) AS body, string_split_regex(x, (SELECT pattern FROM rule WHERE k = 0)) AS gap FROM d
            UNION ALL SELECT doc_id, 'access', regexp_extract_all(x, (SELECT pattern FROM rule WHERE k = 1), 0), regexp_extract_all(x, (SELECT pattern FROM rule WHERE k = 1), 1), string_split_regex(x, (SELECT pattern FROM rule WHERE k = 1)) FROM d
            UNION ALL SELECT doc_id, 'hex', regexp_extract_all(x, (SELECT pattern FROM rule WHERE k = 2), 0), regexp_extract_all(x, (SELECT pattern FROM rule WHERE k = 2), 1), string_split_regex(x, (SELECT pattern FROM rule WHERE k = 2)) FROM d),
        each AS (SELECT doc_id, kind, unnest(hit) AS hit, unnest(body) AS body, unnest(gap[1:len(hit)]) AS gap, unnest(range(1, len(hit) + 1)) AS i FROM m),
        placed AS (SELECT doc_id, e.kind, k, least, length(body) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, e.kind ORDER BY i) AS stop, length(hit) AS size FROM each e JOIN rule USING (kind)),
        span AS (SELECT doc_id, kind, k, stop - size AS start, stop FROM placed WHERE n >= least),
        listed AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM span GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)""",
    "op9_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM win JOIN again USING (s)),
        every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM every ANTI JOIN covered USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a AS doc_id, min(b) AS least_other FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_other, doc_id)) AS component_id, doc_id <= coalesce(least_other, doc_id) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
