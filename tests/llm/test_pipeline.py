"""The pipeline's stages, each on its own input, and the registered queries."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from quern.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "bpe":
            assert after.columns == columns
        if name not in ("bpe", "mixing"):
            assert after.exceptAll(docs.select(after.columns)).count() == 0
        seen.append(after.count())
        if name == "exact_dedup":
            texts = ["".join(r.text.split()) for r in docs.collect()]
            assert after.count() == len(set(texts))
        if name == "bpe":
            want = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect())
            assert sorted(r.decoded_sha256 for r in after.collect()) == want
        docs = after
    assert seen[0] == 200 and seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[4] > 0


def test_tables_go_when_no_plan_reads_them(spark, tmp_path):
    import glob
    import time

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    old = set(glob.glob(f"{root}/quern-*/*"))
    tables = lambda: set(glob.glob(f"{root}/quern-*/*")) - old
    first = corpus_pipeline.exact_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    first.write.parquet(str(tmp_path / "0"))
    whole, own = sorted(r.doc_id for r in first.collect()), tables()
    second = corpus_pipeline.near_stage(spark, spark.read.parquet(str(tmp_path / "0")), SF)
    second.write.parquet(str(tmp_path / "1"))
    held = sorted(r.doc_id for r in first.collect())
    del first
    for _ in range(20):
        time.sleep(0.5)
        third = corpus_pipeline.mixing_stage(spark, spark.read.parquet(str(tmp_path / "1")).limit(0), SF)
        if not own & tables():
            break
    assert held == whole and own and not own & tables()
    assert second.count() == spark.read.parquet(str(tmp_path / "1")).count() and third.count() == 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_ids(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, 0) for k, t, s in rows], SCHEMA)


def texts(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


def test_exact_stage_with_null_and_repeated_ids(spark):
    rows = [(None, "a  b c"), (5, "a b c"), (6, "abc"), (7, "x y"), (7, "x y"), (None, "x y"), (None, "one"), (None, "two"), (8, "p q"), (8, "p r"), (None, None), (9, " ")]
    got = corpus_pipeline.exact_stage(spark, odd_ids(spark, [(*r, "s") for r in rows]), SF)
    assert texts(got) == [(-1, "a  b c"), (-1, "one"), (-1, "two"), (7, "x y"), (8, "p q"), (8, "p r"), (9, " ")]


def test_near_stage_with_null_and_repeated_ids(spark):
    base = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(5)]
    near = [b + " end" for b in base]
    rows = [(None, base[0]), (3, near[0]), (None, base[1]), (None, near[1]), (4, base[2]), (4, near[2]), (4, base[3]), (None, base[4]), (9, near[3]), (None, None)]
    got = corpus_pipeline.near_stage(spark, odd_ids(spark, [(*r, "s") for r in rows]).coalesce(1), SF)
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, [(3, near[0]), (None, base[1]), (4, base[2]), (4, base[3]), (None, base[4]), (None, None)]))


def test_mixing_stage_with_null_and_repeated_ids(spark):
    rows = [((None, 1, 1, k)[k % 4], "w " * (k % 7 + 1) + str(k), ("a", "b", None)[k % 3]) for k in range(120)]
    docs = odd_ids(spark, rows)
    got = [(r.source, len(r.text.split())) for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()]
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", None)}
    target = {r.source_size: r.target for r in corpus_pipeline.mix(docs).collect()}
    assert len(set(sizes.values())) == 3
    for s, size in sizes.items():
        assert abs(sum(n for x, n in got if x == s) - target[size]) <= 8 + 1e-6


def test_row_stages_with_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = corpus_pipeline.language_stage(spark, docs.limit(0).unionByName(docs), SF).count()
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 4 != 2, F.col("doc_id") % 2))
    got = corpus_pipeline.language_stage(spark, odd, SF)
    assert got.filter("doc_id IS NULL").count() > 0 and abs(got.count() - want) <= 5
    assert corpus_pipeline.encoding_stage(spark, odd.limit(20), SF).count() == 20


CLASHING = ["score", "lang_pred", "_row", "_ROW_", "_copies", "_copy", "copies", "group", "order", "first", "node", "a.b", "tick`", "id", "size", "value"]


def test_columns_of_any_name_pass_through(spark):
    """Stages keep what they don't own, whatever its name, with nulls; each against a plain version of itself."""
    r = random.Random(1)
    voc = {"en": ["the", "with", "thing", "other"], "de": ["der", "nicht", "schön", "und"]}
    rows = [(k if k % 5 else None, " ".join(r.choice(voc[lang]) + r.choice("abcdef") * 2 for _ in range(40)), lang if k % 4 else None, ("s", None, "t")[k % 3]) for k, lang in enumerate(["en", "de"] * 30)]
    rows += [(70, rows[7][1] + " ", "de", "s"), (71, rows[9][1] + " end", "de", None), (72, None, None, None), (73, "12 34 !", "en", "s"), rows[11]]
    extra = [tuple(None if (k + j) % 6 == 0 else f"{name}-{k}" for j, name in enumerate(CLASHING)) for k in range(len(rows))]
    schema = StructType([StructField("doc_id", LongType()), *(StructField(c, StringType()) for c in ("text", "lang", "source")), StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in CLASHING)])
    docs = spark.createDataFrame([(*row, len(row[1] or ""), *more) for row, more in zip(rows, extra, strict=True)], schema).coalesce(2)
    whole = [tuple(x) for x in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    with_lang = lambda x: (*x[:2], *x[3:])

    kept = [tuple(x) for x in stages["language_id"](spark, docs, SF).collect()]
    assert Counter(map(with_lang, kept)) == Counter(with_lang(x) for x in whole if x[1] and any(c.isalpha() for c in x[1]))
    assert all(x[2] == ("en" if any(w[:3] in ("the", "wit", "thi", "oth") for w in x[1].split()[:3]) else "de") for x in kept)

    groups = defaultdict(list)
    for x in whole:
        groups["".join((x[1] or "").split())].append(x)
    best = lambda xs: min(xs, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
    kept = [tuple(x) for x in stages["exact_dedup"](spark, docs, SF).collect()]
    assert Counter((x[0], x[1]) for x in kept) == Counter((best(xs)[0], best(xs)[1]) for xs in groups.values()) and not Counter(kept) - Counter(whole)

    kept = [tuple(x) for x in stages["near_dedup"](spark, docs, SF).collect()]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    near = lambda x, y: (a := shingles(x[1])) and (b := shingles(y[1])) and len(a & b) >= 0.8 * len(a | b)
    first = lambda x: (x[0] is None, x[0] or 0)
    lost = [x for x in whole if any(near(x, y) and first(y) < first(x) for y in whole if y is not x)]
    assert not Counter(kept) - Counter(whole) and Counter(x[1] for x in kept) == Counter(x[1] for x in whole) - Counter(x[1] for x in lost) - Counter([rows[11][1]])

    taken = Counter(tuple(x) for x in stages["mixing"](spark, docs, SF).collect())
    assert set(taken) <= set(whole) and all(n <= 2 * whole.count(x) for x, n in taken.items())
    for target in {(x.source_size, x.target) for x in corpus_pipeline.mix(docs).collect()}:
        sources = [s for s in ("s", "t", None) if sum(len((x[1] or "").split()) for x in whole if x[3] == s) == target[0]]
        assert any(abs(sum(len((x[1] or "").split()) * n for x, n in taken.items() if x[3] == s) - target[1]) <= 41 for s in sources)

    ranks = corpus_pipeline.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = stages["bpe"](spark, docs, SF).collect()
    assert Counter((x.doc_id, tuple(x.ids), x.n_tokens, x.decoded_sha256) for x in coded) == Counter((x[0], tuple(i := enc.encode_ordinary(x[1] or "")), len(i), hashlib.sha256((x[1] or "").encode()).hexdigest()) for x in whole)
