"""Every operator as a query over the driver's tables, and its DuckDB counterpart.

Logs are made from the tables: L1 users' last events (errors delete), L2 events by type and user, L3 documents,
L4 embeddings, L5 orders by customer with mixed retention, L6 integers of each order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bytesfn, chunking, codecs, layouts
from .operators import models
from .plans import views
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The logs as SQL, for the counterparts.
LOGS = """
 l1 AS (SELECT event_id AS seq, 'user/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_type || ':' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS payload FROM events),
 l2 AS (SELECT event_id AS seq, 'events/' || event_type || '/user_' || CAST(user_id AS VARCHAR) AS key, props AS payload FROM events),
 l3 AS (SELECT doc_id AS seq, 'docs/' || lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS key, text AS payload, md5(text) AS content_hash, octet_length(encode(text)) AS len FROM documents),
 l5 AS (SELECT o_orderkey AS seq, 'cust/' || CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS payload, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 1000000000 END AS n FROM orders),
 l6 AS (SELECT l_orderkey AS series, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS idx, l_partkey AS value FROM lineitem)
"""


def query(name: str, sql: str | None = None, logs: bool = True) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {LOGS.strip()}{', ' + sql.strip()[5:] if sql.strip().startswith('WITH ') else ' ' + sql}" if logs else sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    payload = F.concat("event_type", F.lit(":"), F.floor(F.col("value") * 100).cast("long").cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), op.alias("op"), payload.alias("payload"))


def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("events/"), "event_type", F.lit("/user_"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("seq"), key.alias("key"), F.lit("put").alias("op"), F.col("props").alias("payload"))


def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("seq"), key.alias("key"), F.lit("put").alias("op"), F.col("text").alias("payload"))


def l3_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l3(spark, sf_dir).select("seq", "key", F.md5(F.col("payload").cast("binary")).alias("content_hash"), F.octet_length("payload").cast("long").alias("len"))


def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    retain = F.when(F.col("o_orderstatus") == "F", "keep_last_n:3").when(F.col("o_orderstatus") == "O", "keep_latest").otherwise("keep_forever")
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")).alias("key"), F.lit("put").alias("op"), F.col("o_orderpriority").alias("payload"), retain.alias("retain"))


def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.row_number().over(order).alias("idx"), F.col("l_partkey").alias("value"))


LATEST = "SELECT key, arg_max(payload, seq) AS payload, max(seq) AS seq FROM {log} {where} GROUP BY key"


@query("r5_prefix_latest", LATEST.format(log="l2", where="WHERE starts_with(key, 'events/purchase/')"))
def r5_prefix_latest(spark, sf_dir):
    return views.prefix(l2(spark, sf_dir), "events/purchase/").select("key", "payload", "seq")


@query("r1_get_point", LATEST.format(log="l2", where="WHERE key = 'events/click/user_7'"))
def r1_get_point(spark, sf_dir):
    return views.get(l2(spark, sf_dir), "events/click/user_7").select("key", "payload", "seq")


WANTED = ["events/view/user_3", "events/absent/user_0", "events/click/user_7", "events/view/user_3", "events/error/user_11"]


@query("r3_get_batch", f"WITH k AS (SELECT unnest({WANTED}) AS key, unnest(range({len(WANTED)})) AS pos), v AS ({LATEST.format(log='l2', where='')}) SELECT pos, key, payload FROM k JOIN v USING (key)")
def r3_get_batch(spark, sf_dir):
    return views.get_batch(l2(spark, sf_dir), WANTED).select("pos", "key", "payload")


@query("r4_get_batch_dict", f"WITH v AS ({LATEST.format(log='l2', where='')}) SELECT key, payload FROM v WHERE key IN {tuple(WANTED)}")
def r4_get_batch_dict(spark, sf_dir):
    return views.get_batch(l2(spark, sf_dir), WANTED).select("key", "payload").dropDuplicates(["key"])


@query("r6_keys_live", "SELECT key, max(seq) AS seq FROM l1 GROUP BY key HAVING arg_max(op, seq) = 'put'")
def r6_keys_live(spark, sf_dir):
    return views.live_keys(l1(spark, sf_dir))


VERSIONS1 = """WITH g AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS generation FROM l1),
 last AS (SELECT key, max(generation) AS generation FROM g GROUP BY key HAVING arg_max(op, seq) = 'put'),
 v AS (SELECT g.*, row_number() OVER (PARTITION BY key, generation ORDER BY seq) - 1 AS version FROM g WHERE op = 'put')"""


@query("m5_tombstone_generation", f"{VERSIONS1} SELECT key, generation, version, seq, payload FROM v JOIN last USING (key, generation)")
def m5_tombstone_generation(spark, sf_dir):
    return views.current_versions(l1(spark, sf_dir)).select("key", "generation", "version", "seq", "payload")


VERSIONS2 = "WITH v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS version FROM l2)"


@query("r8_list_versions", f"{VERSIONS2} SELECT key, count(*) AS n, min(version) AS first, max(version) AS last FROM v GROUP BY key")
def r8_list_versions(spark, sf_dir):
    return views.current_versions(l2(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"), F.min("version").alias("first"), F.max("version").alias("last"))


@query("r9_get_version", f"{VERSIONS2} SELECT key, version, payload FROM v WHERE version = 2")
def r9_get_version(spark, sf_dir):
    return views.current_versions(l2(spark, sf_dir)).filter("version = 2").select("key", "version", "payload")


VERSIONS5 = "WITH v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS version FROM l5), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM v), s AS (SELECT *, min(n - version) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + version >= 1 AS survives FROM v)"


def _retain(policy: str | None, sql: str):
    def run(spark, sf_dir):
        log = l5(spark, sf_dir)
        return views.retained(log.withColumn("retain", F.lit(policy)) if policy else log).select("key", "version", "seq", "payload")

    return query(f"v2_retain_{({'keep_latest': 'latest', 'keep_last_n:3': 'last3', 'keep_forever': 'forever'}).get(policy, 'mixed')}", f"{VERSIONS5} SELECT key, version, seq, payload FROM {sql}")(run)


_retain("keep_latest", "b WHERE back <= 1")
_retain("keep_last_n:3", "b WHERE back <= 3")
_retain("keep_forever", "v")
_retain(None, "s WHERE survives")


@query("v1_evicted_refs", f"{VERSIONS5} SELECT key, version, seq, md5(payload) AS content_hash FROM s WHERE NOT survives")
def v1_evicted_refs(spark, sf_dir):
    return views.evicted(l5(spark, sf_dir)).select("key", "version", "seq", F.md5(F.col("payload").cast("binary")).alias("content_hash"))


@query("m2_retention_parse", "WITH p AS (SELECT unnest(['keep_forever', 'keep_last_n:5', 'keep_last_n:x', 'keep_last_n:0', 'keep_latest', 'other']) AS retain, unnest([NULL, 5, 1, 1, 1, 1]) AS kept) SELECT retain, CAST(kept AS INTEGER) AS kept FROM p", logs=True)
def m2_retention_parse(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("keep_forever", "keep_last_n:5", "keep_last_n:x", "keep_last_n:0", "keep_latest", "other")], "retain string")
    return rows.select("retain", views.kept_by(F.col("retain")).alias("kept"))


@query("v4_diff", "WITH a AS (SELECT DISTINCT md5(payload) AS content_hash FROM l2 WHERE starts_with(key, 'events/click/user_7')), b AS (SELECT DISTINCT md5(payload) AS content_hash FROM l2 WHERE starts_with(key, 'events/error/user_7')) SELECT content_hash, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT content_hash, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def v4_diff(spark, sf_dir):
    hashed = l2(spark, sf_dir).select("key", F.md5(F.col("payload").cast("binary")).alias("content_hash"))
    return views.diff(hashed.filter(F.col("key").startswith("events/click/user_7")), hashed.filter(F.col("key").startswith("events/error/user_7")))


@query("r10_version_diff", f"{VERSIONS2}, a AS (SELECT DISTINCT key, md5(payload) AS content_hash FROM v WHERE version = 0), b AS (SELECT DISTINCT key, md5(payload) AS content_hash FROM v WHERE version = 1) SELECT b.key, b.content_hash AS added, a.content_hash AS removed FROM a JOIN b USING (key) WHERE a.content_hash <> b.content_hash")
def r10_version_diff(spark, sf_dir):
    v = views.current_versions(l2(spark, sf_dir)).filter("version < 2").select("key", "version", F.md5(F.col("payload").cast("binary")).alias("h"))
    both = v.groupBy("key").agg(F.max(F.when(F.col("version") == 1, F.col("h"))).alias("added"), F.max(F.when(F.col("version") == 0, F.col("h"))).alias("removed"))
    return both.filter("added <> removed")


@query("d9_dedup_stats", "WITH f AS (SELECT content_hash, arg_min(key, seq) AS k, min(seq) AS s, max(len) AS ul FROM l3 GROUP BY content_hash), t AS (SELECT count(*) AS total_segments, sum(len) AS logical_bytes, count_if(seq > s AND key = k) AS cross_version_hits, count_if(seq > s AND key <> k) AS cross_key_hits FROM l3 JOIN f USING (content_hash)), u AS (SELECT count(*) AS unique_segments, sum(ul) AS physical_bytes FROM f) SELECT CAST(total_segments AS BIGINT) AS total_segments, CAST(logical_bytes AS BIGINT) AS logical_bytes, CAST(cross_version_hits AS BIGINT) AS cross_version_hits, CAST(cross_key_hits AS BIGINT) AS cross_key_hits, unique_segments, CAST(physical_bytes AS BIGINT) AS physical_bytes, round(logical_bytes / physical_bytes, 6) AS ratio FROM t, u")
def d9_dedup_stats(spark, sf_dir):
    return views.dedup_stats(l3_refs(spark, sf_dir))


@query("d6_refcounts", "SELECT content_hash, count(*) AS refs FROM l3 GROUP BY content_hash")
def d6_refcounts(spark, sf_dir):
    return views.refcounts(l3_refs(spark, sf_dir))


@query("d7_gc_candidates", f"{VERSIONS5} SELECT DISTINCT md5(key || payload) AS content_hash FROM v WHERE md5(key || payload) NOT IN (SELECT md5(key || payload) FROM s WHERE survives)")
def d7_gc_candidates(spark, sf_dir):
    marked = views.with_survival(l5(spark, sf_dir)).select("survives", F.md5(F.concat("key", "payload").cast("binary")).alias("content_hash"))
    return views.unreferenced(marked.select("content_hash").distinct(), marked.filter("survives"))


@query("d8_put_batch_new_chunks", "SELECT content_hash, min(len) AS len FROM l3 WHERE seq % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM l3 WHERE seq % 2 = 0) GROUP BY content_hash")
def d8_put_batch_new_chunks(spark, sf_dir):
    refs = l3_refs(spark, sf_dir)
    return views.new_chunks(refs.filter("seq % 2 = 1"), refs.filter("seq % 2 = 0"))


@query("m7_compact", "SELECT key, arg_max(payload, seq) AS payload FROM l1 GROUP BY key HAVING arg_max(op, seq) = 'put'")
def m7_compact(spark, sf_dir):
    return views.compacted(l1(spark, sf_dir)).select("key", "payload")


@query("m8_compact_keep_n", "SELECT key, seq, payload FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM l2) WHERE back <= 3")
def m8_compact_keep_n(spark, sf_dir):
    return views.compacted(l2(spark, sf_dir), 3).select("key", "seq", "payload")


@query("m8_compact_dry_run", "SELECT count(*) AS entries, CAST(count_if(back <= 3) AS BIGINT) AS kept FROM (SELECT row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM l2)")
def m8_compact_dry_run(spark, sf_dir):
    counts = l2(spark, sf_dir).groupBy("key").count()
    return counts.agg(F.sum("count").alias("entries"), F.sum(F.least("count", F.lit(3))).alias("kept"))


@query("s22_info", "WITH d AS (SELECT key, max(CASE WHEN op = 'delete' THEN seq END) AS deleted FROM l1 GROUP BY key), m AS (SELECT key, deleted IS NULL OR seq > deleted AS live FROM l1 JOIN d USING (key) WHERE op = 'put') SELECT CAST(count_if(live) AS BIGINT) AS live_entries, CAST(count_if(NOT live) AS BIGINT) AS tombstoned_entries, count(DISTINCT CASE WHEN live THEN key END) AS live_keys FROM m")
def s22_info(spark, sf_dir):
    return views.info(l1(spark, sf_dir))


@query("s23_tree_rollup", "WITH p AS (SELECT string_split(key, '/') AS parts, len FROM l3), e AS (SELECT parts, len, unnest(range(1, length(parts) + 1)) AS depth FROM p) SELECT array_to_string(parts[1:depth], '/') AS path, CAST(depth AS INTEGER) AS depth, count(*) AS keys, CAST(sum(len) AS BIGINT) AS bytes FROM e GROUP BY 1, 2")
def s23_tree_rollup(spark, sf_dir):
    return views.tree(l3_refs(spark, sf_dir))


@query("s24_verify", "SELECT count(*) AS chunks, CAST(count_if(seq % 97 = 0) AS BIGINT) AS bad FROM l3")
def s24_verify(spark, sf_dir):
    """Chunks are stored with their checksums, then every 97th document's is damaged; the check must find just those."""
    chunks = l3(spark, sf_dir).select("seq", F.col("payload").cast("binary").alias("payload")).withColumn("crc32", F.crc32("payload"))
    stored = Scratch(spark, "verify").keep(chunks, "chunks")
    return verified(stored.withColumn("payload", F.when(F.col("seq") % 97 == 0, F.concat("payload", F.lit(b"\1"))).otherwise(F.col("payload"))))


def verified(stored: DataFrame) -> DataFrame:
    """Number of stored chunks (payload, crc32), and of those that the checksum finds damaged."""
    return stored.agg(F.count("*").alias("chunks")).join(views.checked(stored).agg(F.count("*").alias("bad")))


@query("s26_logical_bytes", "SELECT count(*) AS entries, CAST(sum((user_id % 7) * (event_id % 5) * 2 * CASE event_type WHEN 'click' THEN 8 WHEN 'view' THEN 4 ELSE 1 END) AS BIGINT) AS logical_bytes FROM events", logs=False)
def s26_logical_bytes(spark, sf_dir):
    """Events as tensors whose shapes and element types differ from row to row."""
    dtype = F.when(F.col("event_type") == "click", "float64").when(F.col("event_type") == "view", "float32").otherwise("uint8")
    return views.logical_bytes(table(spark, sf_dir, "events").select(F.array(F.col("user_id") % 7, F.col("event_id") % 5, F.lit(2)).alias("shape"), dtype.alias("dtype")))


def _entropy_sql(limit: int, last: str) -> str:
    return f"""WITH b AS (SELECT seq, unnest(range(least(len, {limit}))) AS i, payload FROM (SELECT seq, len, hex(encode(payload)) AS payload FROM l3)),
 c AS (SELECT seq, substr(payload, 2 * i + 1, 2) AS b, count(*) AS n FROM b GROUP BY 1, 2), h AS (SELECT seq, round(-sum(n / t * log2(n / t)) + 0.0, 6) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY seq) AS t FROM c) GROUP BY seq)
 SELECT seq, {last} FROM h"""


@query("e1_entropy", _entropy_sql(1024, "bits"))
def e1_entropy(spark, sf_dir):
    """Texts of a repeated id are counted together; an id with empty texts only has no row."""
    return bytesfn.key_entropy(l3(spark, sf_dir), "seq", "payload").select("seq", F.round("bits", 6).alias("bits"))


@query("a2_entropy4096", _entropy_sql(4096, "bits"))
def a2_entropy4096(spark, sf_dir):
    return l3(spark, sf_dir).select("seq", F.round(bytesfn.entropy(F.col("payload"), 4096), 6).alias("bits"))


@query("e2_codec_decision", _entropy_sql(1024, "CASE WHEN bits >= 7.75 THEN 'none' WHEN bits >= 5 THEN 'lz4' ELSE 'zstd' END AS codec"))
def e2_codec_decision(spark, sf_dir):
    return e1_entropy(spark, sf_dir).select("seq", bytesfn.codec_decision(F.col("bits")).alias("codec"))


MONOTONIC = "WITH v AS (SELECT user_id AS series, CAST(floor(CASE WHEN user_id % 4 = 0 THEN event_id ELSE value * 100 END) AS BIGINT) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events), s AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY idx) AS before FROM v), m AS (SELECT series, count(*) AS n, CAST(sum(CASE WHEN value >= before AND value - before < 100000 THEN 1 ELSE 0 END) AS BIGINT) AS steps FROM s WHERE idx <= 64 GROUP BY series) SELECT series, n, steps, n >= 8 AND steps > floor(n * 3 / 4) AS monotonic FROM m"


@query("a4_monotonic", MONOTONIC)
def a4_monotonic(spark, sf_dir):
    """Users' events, as orders have too few lines for a trend; a quarter of the users has ascending values."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), "event_id", F.floor(F.when(F.col("user_id") % 4 == 0, F.col("event_id")).otherwise(F.col("value") * 100)).cast("long").alias("value"))
    rows = e.withColumn("idx", F.row_number().over(Window.partitionBy("series").orderBy("event_id")))
    return bytesfn.monotonic_trend(rows, "series", "idx", "value", step=100_000)


NEAR = "SELECT vec_id, count_if(near) >= n * 3 // 4 AS correlated FROM (SELECT vec_id, n, k, xor(b, lag(b) OVER (PARTITION BY vec_id ORDER BY k)) < 1048576 AS near FROM bits) GROUP BY vec_id, n"
#: The bits of the first 64 floats: exponent and mantissa of normal numbers, zero otherwise.
FLOAT_BITS = "f AS (SELECT vec_id, least(len(embedding), 64) AS n, unnest(range(1, least(len(embedding), 64) + 1)) AS k, CAST(unnest(embedding[1:64]) AS DOUBLE) AS x FROM embeddings), e AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE CAST(floor(log2(abs(x))) AS BIGINT) END AS e0 FROM f), g AS (SELECT *, CASE WHEN x <> 0 AND abs(x) >= pow(2.0, e0 + 1) THEN e0 + 1 WHEN x <> 0 AND abs(x) < pow(2.0, e0) THEN e0 - 1 ELSE e0 END AS ex FROM e), bits AS (SELECT vec_id, n, k, CASE WHEN x = 0 THEN 0 ELSE CASE WHEN x < 0 THEN 2147483648 ELSE 0 END + (ex + 127) * 8388608 + CAST(round((abs(x) / pow(2.0, ex) - 1) * 8388608) AS BIGINT) END AS b FROM g)"


@query("a3_correlated", f"WITH {FLOAT_BITS} {NEAR}", logs=False)
def a3_correlated(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", bytesfn.correlated_floats(F.col("embedding")).alias("correlated"))


@query("a1_auto_select")
def a1_auto_select(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", bytesfn.correlated_floats(F.col("embedding")).alias("correlated"), chunking.float_bytes(F.col("embedding")).alias("data"))
    e = e.withColumn("bits", bytesfn.entropy(F.col("data"), 4096))
    picked = bytesfn.auto_select(F.octet_length("data") == 0, F.lit(0.0), F.lit(True), F.col("correlated"), F.lit(False), F.col("bits"))
    return e.withColumn("picked", picked).select("vec_id", "picked.*")


ZIGZAG = "WITH d AS (SELECT *, value - lag(value, 1, 0) OVER (PARTITION BY series ORDER BY idx) AS delta FROM l6) SELECT series, idx, {what} FROM d"


@query("f5_zigzag", ZIGZAG.format(what="CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS code"))
def f5_zigzag(spark, sf_dir):
    return bytesfn.delta_zigzag(l6(spark, sf_dir), "series", "idx", "value").select("series", "idx", "code")


@query("f6_unzigzag", "SELECT series, idx, value AS decoded FROM l6")
def f6_unzigzag(spark, sf_dir):
    return bytesfn.undelta_zigzag(bytesfn.delta_zigzag(l6(spark, sf_dir), "series", "idx", "value"), "series", "idx").select("series", "idx", "decoded")



def _prefix(spark, sf_dir):
    return l3(spark, sf_dir).select("seq", F.substring("payload", 1, 200).cast("binary").alias("data"))


@query("f1_byte_shuffle", "WITH h AS (SELECT seq, hex(encode(payload[1:200])) AS h FROM l3), n AS (SELECT seq, h, length(h) // 8 AS n FROM h) SELECT seq, array_to_string(list_transform(range(n * 4), lambda i: substr(h, 2 * ((i % n) * 4 + i // n) + 1, 2)), '') || substr(h, n * 8 + 1) AS shuffled FROM n")
def f1_byte_shuffle(spark, sf_dir):
    return _prefix(spark, sf_dir).select("seq", F.hex(bytesfn.byte_shuffle(F.col("data"), 4)).alias("shuffled"))


@query("f2_unshuffle", "SELECT seq, hex(encode(payload[1:200])) AS data FROM l3")
def f2_unshuffle(spark, sf_dir):
    shuffled = _prefix(spark, sf_dir).select("seq", bytesfn.byte_shuffle(F.col("data"), 4).alias("data"))
    return shuffled.select("seq", F.hex(bytesfn.byte_unshuffle(F.col("data"), 4)).alias("data"))


@query("f3_bit_shuffle", "SELECT seq, hex(encode(payload[1:200])) AS data FROM l3")
def f3_bit_shuffle(spark, sf_dir):
    return _prefix(spark, sf_dir).select("seq", F.hex(bytesfn.bit_unshuffle(bytesfn.bit_shuffle(F.col("data")))).alias("data"))


def _whole(spark, sf_dir):
    return l3(spark, sf_dir).select("seq", F.col("payload").cast("binary").alias("data"))


@query("f1_byte_shuffle_whole")
def f1_byte_shuffle_whole(spark, sf_dir):
    return _whole(spark, sf_dir).select("seq", F.hex(bytesfn.byte_shuffle(F.col("data"), 4)).alias("shuffled"))


@query("f2_unshuffle_whole", "SELECT seq, hex(encode(payload)) AS data FROM l3")
def f2_unshuffle_whole(spark, sf_dir):
    shuffled = _whole(spark, sf_dir).select("seq", bytesfn.byte_shuffle(F.col("data"), 4).alias("data"))
    return shuffled.select("seq", F.hex(bytesfn.byte_unshuffle(F.col("data"), 4)).alias("data"))


@query("f3_bit_shuffle_whole", "SELECT seq, hex(encode(payload)) AS data FROM l3")
def f3_bit_shuffle_whole(spark, sf_dir):
    return _whole(spark, sf_dir).select("seq", F.hex(bytesfn.bit_unshuffle(bytesfn.bit_shuffle(F.col("data")))).alias("data"))


@query("c5_xor_float_roundtrip", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, CAST(len(embedding) AS INTEGER) AS n FROM embeddings", logs=False)
def c5_xor_float_roundtrip(spark, sf_dir):
    code = table(spark, sf_dir, "embeddings").select("vec_id", chunking.xor_encoded(chunking.float_bytes(F.col("embedding"))).alias("code"))
    back = code.select("vec_id", chunking.bytes_floats(chunking.xor_decoded(F.col("code"))).alias("x"))
    return back.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"), F.size("x").alias("n"))


@query("d1_cdc_segments", "SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, true AS bounded FROM documents GROUP BY lang", logs=False)
def d1_cdc_segments(spark, sf_dir):
    """Documents cut on their own with smaller bounds than the defaults, as most are shorter than the least chunk."""
    d = table(spark, sf_dir, "documents")
    cut = chunking.segments(d, "doc_id", "text", least=512, most=8192, mask=0x7FF)
    return cut.join(d.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("len").cast("long").alias("bytes"), (F.max("len") <= 8192).alias("bounded"))


@query("d4_content_hash", "SELECT seq, content_hash, sha256(payload) AS sha FROM l3")
def d4_content_hash(spark, sf_dir):
    return l3(spark, sf_dir).select("seq", F.md5(F.col("payload").cast("binary")).alias("content_hash"), F.sha2(F.col("payload").cast("binary"), 256).alias("sha"))


RANGES = [(0, "docs/de/src1/", "docs/de/src10/9"), (1, "docs/xx", "docs/zz"), (2, "docs/en/src0/0", "docs/en/src0/zzz"), (3, "a", "b"), (4, "docs/es", "docs/fr"), (5, "docs/fr/src9/99999999", "docs/fr/src99")]


@query("i6_range_exists", f"WITH r AS (SELECT unnest({[r[0] for r in RANGES]}) AS range_id, unnest({[r[1] for r in RANGES]}) AS lo, unnest({[r[2] for r in RANGES]}) AS hi) SELECT range_id, EXISTS (SELECT 1 FROM l3 WHERE key = lo OR (key >= lo AND key <= hi)) AS hit FROM r")
def i6_range_exists(spark, sf_dir):
    return models.range_exists(l3(spark, sf_dir).select("key"), spark.createDataFrame(RANGES, "range_id int, lo string, hi string"))


@query("i7_spline_lookup", "WITH k AS (SELECT series % 50 AS series, value AS k FROM l6), p AS (SELECT series, k, row_number() OVER (PARTITION BY series ORDER BY k) - 1 AS pos FROM k), q AS (SELECT DISTINCT series % 50 AS series, series * 7 % 2000 AS probe FROM l6), e AS (SELECT series, max(pos) AS e FROM p GROUP BY series) SELECT q.series, probe, coalesce(min(CASE WHEN k = probe THEN pos END), max(CASE WHEN k < probe THEN pos END), 0) AS lo, coalesce(max(CASE WHEN k = probe THEN pos END), min(CASE WHEN k > probe THEN pos END), max(e)) AS hi FROM q JOIN p USING (series) JOIN e USING (series) GROUP BY q.series, probe")
def i7_spline_lookup(spark, sf_dir):
    rows = l6(spark, sf_dir)
    return models.bracket(rows.select((F.col("series") % 50).alias("series"), F.col("value").alias("k")), rows.select((F.col("series") % 50).alias("series"), (F.col("series") * 7 % 2000).alias("probe")).distinct())


@query("i8_spline_predict", "WITH o AS (SELECT series % 50 AS series, value AS x, row_number() OVER (PARTITION BY series % 50 ORDER BY value) AS y FROM (SELECT DISTINCT series % 50 AS series, value FROM l6)), s AS (SELECT series, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY series ORDER BY x, y)), q AS (SELECT DISTINCT series % 50 AS series, series * 7 % 2500 AS probe FROM l6), m AS (SELECT q.series, probe, min(k) AS k FROM q LEFT JOIN s ON q.series = s.series AND x0 <= probe AND probe <= x1 GROUP BY q.series, probe), f AS (SELECT m.series, probe, s.k, CAST(trunc(y0 + CASE WHEN x1 = x0 THEN 0 ELSE (y1 - y0) / CAST(x1 - x0 AS DOUBLE) END * (probe - x0)) AS BIGINT) AS p FROM m LEFT JOIN s ON m.series = s.series AND m.k = s.k) SELECT series, probe, CASE WHEN k IS NULL THEN 0 ELSE greatest(0, p - 8) END AS lo, CASE WHEN k IS NULL THEN 1024 ELSE p + 8 END AS hi FROM f")
def i8_spline_predict(spark, sf_dir):
    from pyspark.sql import Window

    rows = l6(spark, sf_dir).withColumn("series", F.col("series") % 50)
    points = rows.select("series", F.col("value").alias("x")).distinct().withColumn("y", F.row_number().over(Window.partitionBy("series").orderBy("x")))
    probes = l6(spark, sf_dir).select((F.col("series") % 50).alias("series"), (F.col("series") * 7 % 2500).alias("probe")).distinct()
    return models.spline_windows(points, probes, 8)


@query("i9_shard_route")
def i9_shard_route(spark, sf_dir):
    return l2(spark, sf_dir).groupBy("key").count().select("key", chunking.shard_of(F.col("key"), 4).alias("shard"))


@query("e3_crossover", "SELECT o_custkey, count(*) AS items, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, sum(CAST(floor(o_totalprice) AS BIGINT)) >= 2097152 AND count(*) >= 16 AS vectorised FROM orders GROUP BY o_custkey", logs=False)
def e3_crossover(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("items"), F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"))
    return sums.withColumn("vectorised", models.vectorised_batch(F.col("items"), F.col("bytes")))


PREFETCH = "WITH w AS (SELECT user_id, event_id, avg(value) OVER f AS mu, var_pop(value) OVER f AS v FROM events WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, CAST(greatest(2, least(64, ceil(round(0.5 * mu * (1 + CASE WHEN mu = 0 THEN 0 ELSE v / (mu * mu) END), 6)))) AS INTEGER) AS depth FROM w"


@query("e4_prefetch_depth", PREFETCH, logs=False)
def e4_prefetch_depth(spark, sf_dir):
    return models.prefetch_depth(table(spark, sf_dir, "events"), 0.5, 2, 64, "event_id", "value", stream="user_id")


NEXT = "WITH t AS (SELECT user_id, event_id, event_type AS key1, lead(event_type, 1) OVER w AS key2, lead(event_type, 2) OVER w AS key3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), n AS (SELECT key1, key2, arg_max(key3, user_id * 1000000000 + event_id) AS next_key FROM t WHERE key3 IS NOT NULL GROUP BY key1, key2)"


@query("e5_next_key", f"{NEXT} SELECT * FROM n", logs=False)
def e5_next_key(spark, sf_dir):
    return models.next_keys(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("e6_recent_sequences", "WITH q AS (SELECT user_id, event_id // 64 AS request, list(event_type ORDER BY event_id) AS keys FROM events GROUP BY 1, 2) SELECT user_id, request, len(keys) AS n, keys[1] AS first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY request DESC) AS back FROM q) WHERE back <= 32", logs=False)
def e6_recent_sequences(spark, sf_dir):
    """The last 32 requests of each user, a request being the events of one stretch of 64 event ids."""
    e = table(spark, sf_dir, "events").withColumn("request", F.floor(F.col("event_id") / 64).cast("long"))
    kept = models.recent_sequences(e, "user_id", "request", "event_id", "event_type")
    return kept.select("user_id", "request", F.size("keys").cast("long").alias("n"), F.col("keys")[0].alias("first"))


@query("e7_prefetch_stats", f"{NEXT} SELECT count(*) AS predictions, CAST(count_if(key3 = next_key) AS BIGINT) AS hits, round(count_if(key3 = next_key) / count(*), 6) AS hit_rate FROM t JOIN n USING (key1, key2) WHERE key3 IS NOT NULL", logs=False)
def e7_prefetch_stats(spark, sf_dir):
    return models.prediction_hits(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("b1_percentile_nearest", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT unnest([50.0, 90.0, 95.0, 99.0]) AS percent) SELECT event_type, CAST(percent AS DOUBLE) AS percent, value FROM r, p WHERE rank = round((n - 1) * percent / 100)", logs=False)
def b1_percentile_nearest(spark, sf_dir):
    return models.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", [50.0, 90.0, 95.0, 99.0])


@query("b2_mean_deviation", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type", logs=False)
def b2_mean_deviation(spark, sf_dir):
    return models.mean_and_deviation(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("b5_format_bytes", "WITH s AS (SELECT event_id, event_id * event_id * 9 AS size FROM events) SELECT event_id, CASE WHEN size >= 1073741824 THEN format('{:.2f} GB', size / 1073741824) WHEN size >= 1048576 THEN format('{:.2f} MB', size / 1048576) WHEN size >= 1024 THEN format('{:.2f} KB', size / 1024) ELSE format('{:d} B', size) END AS size FROM s", logs=False)
def b5_format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", models.format_bytes(F.col("event_id") * F.col("event_id") * 9).alias("size"))


@query("m9_attrs", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, octet_length(encode(props)) <= 4096 AS fits FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL", logs=False)
def m9_attrs(spark, sf_dir):
    attrs = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("attrs"), (F.octet_length("props") <= 4096).alias("fits"))
    return attrs.select("event_id", F.try_element_at("attrs", F.lit("k")).cast("long").alias("k"), "fits").filter("k IS NOT NULL")


@query("m9_attr_ops", "WITH p AS (SELECT event_id, coalesce(json_keys(props), []) AS k FROM events) SELECT event_id, len(k) AS n, len(list_distinct(list_append(k, 'user'))) AS with_user, len(list_filter(k, lambda x: x <> 'k')) AS without_k, len(k) = 0 AS empty FROM p", logs=False)
def m9_attr_ops(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "map<string,string>").alias("attrs"))
    m, count = F.col("attrs"), lambda x: layouts.attr_count(x).cast("long")
    return e.select("event_id", count(m).alias("n"), count(layouts.with_attr(m, "user", F.col("user_id").cast("string"))).alias("with_user"), count(layouts.without_attr(m, "k")).alias("without_k"), (count(m) == 0).alias("empty"))


@query("r12_elements", "SELECT vec_id, unnest(range(len(embedding))) AS idx, unnest(embedding) AS value FROM embeddings", logs=False)
def r12_elements(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "value")).select("vec_id", F.col("idx").cast("long").alias("idx"), "value")


@query("f7_filter_dispatch", "WITH h AS (SELECT seq, CASE seq % 3 WHEN 0 THEN 'none' ELSE 'byte_shuffle' END AS filter, CASE seq % 3 WHEN 2 THEN 2 ELSE 4 END AS w, hex(encode(payload)) AS h FROM l5), n AS (SELECT *, length(h) // (2 * w) AS n FROM h) SELECT seq, filter, CASE filter WHEN 'none' THEN h ELSE array_to_string(list_transform(range(n * w), lambda i: substr(h, 2 * ((i % n) * w + i // n) + 1, 2)), '') || substr(h, n * w * 2 + 1) END AS data FROM n")
def f7_filter_dispatch(spark, sf_dir):
    """Orders' priorities under a filter of their own: none, bytes of pairs, bytes of fours."""
    rows = l5(spark, sf_dir).select("seq", F.when(F.col("seq") % 3 == 0, "none").otherwise("byte_shuffle").alias("filter"), F.when(F.col("seq") % 3 == 2, 2).otherwise(4).alias("w"), F.col("payload").cast("binary").alias("data"))
    return rows.select("seq", "filter", F.hex(codecs.filtered(F.col("data"), F.col("filter"), F.col("w"))).alias("data"))


@query("c8_codec_dispatch")
def c8_codec_dispatch(spark, sf_dir):
    """Documents by a codec and filter of their own, coded and decoded; tests hold the codecs against their libraries."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("seq") % len(names) + 1).cast("int"))
    rows = l3(spark, sf_dir).select("seq", F.col("payload").cast("binary").alias("data"), pick("raw", "lz4", "zstd").alias("codec"), pick("none", "byte_shuffle", "bit_shuffle", "delta_zigzag").alias("filter"))
    coded = rows.withColumn("code", codecs.encoded(F.col("data"), F.col("codec"), F.col("filter"), F.lit(4), F.lit(3)))
    back = codecs.decoded(F.col("code"), F.col("codec"), F.col("filter"), F.lit(4))
    return coded.select("seq", "codec", "filter", F.octet_length("code").alias("size"), F.md5(back).alias("content_hash"))


@query("c2_zstd_roundtrip", "SELECT seq, content_hash FROM l3")
def c2_zstd_roundtrip(spark, sf_dir):
    back = l3(spark, sf_dir).select("seq", codecs.unzstd(codecs.zstd(F.col("payload").cast("binary"))).alias("data"))
    return back.select("seq", F.md5("data").alias("content_hash"))


@query("b4_float_narrowing", f"WITH {FLOAT_BITS} SELECT vec_id, list(CAST(CASE WHEN (b // 8388608) % 256 <= 112 THEN 0 WHEN (b // 8388608) % 256 >= 143 THEN 31744 ELSE ((b // 8388608) % 256 - 112) * 1024 + (b // 8192) % 1024 END + (b // 2147483648) * 32768 AS INTEGER) ORDER BY k) AS half, list(CAST(b // 65536 AS INTEGER) ORDER BY k) AS brain FROM bits GROUP BY vec_id", logs=False)
def b4_float_narrowing(spark, sf_dir):
    """The first 64 elements as float16 and as bfloat16 bits."""
    first = F.slice("embedding", 1, 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", codecs.narrowed(first, "half").alias("half"), codecs.narrowed(first, "brain").alias("brain"))


@query("f3_bit_planes", "WITH t AS (SELECT seq, payload, length(payload) AS n FROM l5) SELECT seq, array_to_string(list_transform(range(n), lambda j: printf('%02X', CAST(list_sum(list_transform(range(8), lambda b: ((ascii(substr(payload, ((8 * j + b) % n) + 1, 1)) >> CAST((8 * j + b) // n AS INTEGER)) & 1) << CAST(b AS INTEGER))) AS INTEGER))), '') AS planes FROM t")
def f3_bit_planes(spark, sf_dir):
    """Orders' priorities with their bits shuffled."""
    return l5(spark, sf_dir).select("seq", F.hex(bytesfn.bit_shuffle(F.col("payload").cast("binary"))).alias("planes"))
