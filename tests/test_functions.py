"""Round trips and literal vectors of byte functions, chunking and models."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import bytesfn, chunking
from quern.operators import models


@given(st.binary(max_size=300), st.sampled_from([1, 2, 4, 8]))
def test_zigzag_round_trip(data, width):
    assert bytesfn.unzigzag_bytes(bytesfn.zigzag_bytes(data, width), width) == data


def test_zigzag_extremes():
    x = np.array([0, 2**63 - 1, -(2**63), 1, -1, -(2**63) + 1], "<i8").tobytes()
    assert bytesfn.unzigzag_bytes(bytesfn.zigzag_bytes(x, 8), 8) == x
    assert np.frombuffer(bytesfn.zigzag_bytes(np.array([3, 1], "<i4").tobytes(), 4), "<u4").tolist() == [6, 3]


@given(st.binary(max_size=130))
def test_bit_shuffle_round_trip(data):
    assert bytesfn.bit_unshuffle_of(bytesfn.bit_shuffle_of(data)) == data


@settings(deadline=None)
@given(st.lists(st.floats(width=32), max_size=200))
def test_xor_codec_keeps_bits(values):
    for width in (4, 8):
        data = np.array(values, f"<f{width}").tobytes()
        assert chunking.xor_decode(chunking.xor_encode(data, width), width) == data


def test_xor_codec_special_values():
    data = np.array([0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, 1e30, -1e-30] * 30 + [-7.125] * 3000, "<f8").tobytes()
    code = chunking.xor_encode(data, 8)
    assert chunking.xor_decode(code, 8) == data and len(code) < len(data) / 3


def slow_cuts(data, least, most, mask):
    ends, start = [], 0
    while start < len(data):
        if len(data) - start <= least:
            ends.append(len(data))
            break
        h, end = 0, min(start + most, len(data))
        for i in range(start + least, end):
            h = ((h << 1) + int(chunking.GEAR[data[i]])) % (1 << 64)
            if h & mask == 0:
                end = i + 1
                break
        ends.append(end)
        start = end
    return ends


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000, 20_000])
def test_cut_points(size):
    data = random.Random(size).randbytes(size)
    assert chunking.cut_points(data, 64, 1024, 0xFF) == slow_cuts(data, 64, 1024, 0xFF)
    same = bytes(size)
    assert chunking.cut_points(same, 64, 1024, 0xFF) == slow_cuts(same, 64, 1024, 0xFF)


def test_default_chunks_are_bounded():
    data = np.random.default_rng(1).integers(0, 256, 3_000_000, np.uint8).tobytes()
    sizes = np.diff([0, *chunking.cut_points(data)])
    assert sizes.sum() == len(data) and sizes.max() <= chunking.MAX_CHUNK and (sizes[:-1] > chunking.MIN_CHUNK).all()


@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_byte_shuffle_odd_lengths(spark, width):
    rows = [(n, bytearray(random.Random(n).randbytes(n))) for n in range(0, 40)]
    df = spark.createDataFrame(rows, "n int, data binary").withColumn("s", bytesfn.byte_shuffle(F.col("data"), width)).withColumn("back", bytesfn.byte_unshuffle(F.col("s"), width))
    for r in df.collect():
        n = len(r.data) // width
        want = np.frombuffer(bytes(r.data[: n * width]), np.uint8).reshape(n, width).T.tobytes() + bytes(r.data[n * width :])
        assert bytes(r.s) == want and bytes(r.back) == bytes(r.data)


def test_entropy_and_decision(spark):
    rows = [(0, bytearray(random.Random(1).randbytes(4096))), (1, bytearray([42] * 2048 + [0] * 2048)), (2, bytearray()), (3, None)]
    got = {r.n: r for r in spark.createDataFrame(rows, "n int, data binary").withColumn("bits", bytesfn.entropy(F.col("data"))).withColumn("codec", bytesfn.codec_decision(F.col("bits"))).collect()}
    assert got[0].codec == "none" and got[1].codec == "zstd" and got[2].bits == 0 and got[3].bits == 0


def test_correlated_floats():
    ramp = np.linspace(1.0, 1.001, 64, dtype=np.float32).view(np.uint32).astype(np.uint64)
    noise = np.random.default_rng(0).normal(size=64).astype(np.float32).view(np.uint32).astype(np.uint64)
    assert bytesfn.correlated_of(ramp, 4) and not bytesfn.correlated_of(noise, 4) and not bytesfn.correlated_of(ramp[:3], 4)


def test_next_key(spark):
    access = spark.createDataFrame([(1, i, k) for i, k in enumerate(["a", "b", "c", "a", "b", "d"])], "batch long, pos long, key string")
    got = {(r.key1, r.key2): r.next_key for r in models.next_keys(access).collect()}
    assert got[("a", "b")] == "d" and got[("b", "c")] == "a"


def test_prefetch_depth(spark):
    rows = [(i, 2e-4) for i in range(40)] + [(40 + i, 9e-3) for i in range(12)]
    got = {r.seq: r.depth for r in models.prefetch_depth(spark.createDataFrame(rows, "seq long, seconds double"), 6_000, 2, 64).collect()}
    assert got[39] == 2 and 2 < got[51] <= 64
    zero = models.prefetch_depth(spark.createDataFrame([(1, 0.0)], "seq long, seconds double"), 10, 2, 64).first()
    assert zero.depth == 2


def test_spline_lookup_brackets(spark):
    keys = spark.createDataFrame([(1, k) for k in (10, 20, 30, 30, 50)], "series int, k long")
    probes = spark.createDataFrame([(1, p) for p in (5, 10, 25, 30, 60)] + [(2, 1)], "series int, probe long")
    got = {(r.series, r.probe): (r.lo, r.hi) for r in models.bracket(keys, probes).collect()}
    assert got == {(1, 5): (0, 0), (1, 10): (0, 0), (1, 25): (1, 2), (1, 30): (2, 3), (1, 60): (4, 4), (2, 1): (0, 0)}


def test_spline_windows(spark):
    points = spark.createDataFrame([(1, x, y) for x, y in ((10, 0), (20, 100), (20, 150), (30, 200))], "series int, x long, y long")
    probes = spark.createDataFrame([(1, p) for p in (9, 10, 15, 20, 25, 31)], "series int, probe long")
    got = {r.probe: (r.lo, r.hi) for r in models.spline_windows(points, probes, 8).collect()}
    assert got == {9: (0, 1024), 10: (0, 8), 15: (42, 58), 20: (92, 108), 25: (167, 183), 31: (0, 1024)}


def test_range_exists(spark):
    keys = spark.createDataFrame([(k,) for k in ("fir", "larch", "spruce")], "key string")
    asked = [(0, "fir", "fir"), (1, "l", "lz"), (2, "yew", "zz"), (3, "larch", "a"), (4, "lb", "so"), (5, "f", "fa")]
    for bucket in (1, 3, 12):
        got = {r.range_id: r.hit for r in models.range_exists(keys, spark.createDataFrame(asked, "range_id int, lo string, hi string"), bucket).collect()}
        assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: False}


def test_vectorised_batch(spark):
    rows = spark.createDataFrame([(15, 3 << 20), (16, 2 << 20)], "n int, b long").select(models.vectorised_batch(F.col("n"), F.col("b")).alias("v"))
    assert [r.v for r in rows.collect()] == [False, True]


def test_zstd_with_dictionary(spark):
    from quern.functions import codecs

    df = spark.createDataFrame([(bytearray(f"record {i} of the same shape; value={i * 7}".encode() * 3),) for i in range(400)] + [(None,)], "x binary")
    dictionary = codecs.train_dictionary(df, "x", 1024)
    back = df.withColumn("z", codecs.zstd(F.col("x"), 99, dictionary)).withColumn("y", codecs.unzstd(F.col("z"), dictionary))
    assert back.filter("NOT (x <=> y)").count() == 0 and back.filter("octet_length(z) < octet_length(x)").count() == 400
    with pytest.raises(ValueError):
        codecs.train_dictionary(df.limit(0), "x", 1024)


def test_float_narrowing():
    from quern.functions import codecs

    x = np.array([0.0, -0.0, 1.0, -2.5, 65504.0, 1e6, -np.inf, np.nan, 1e-7, 3.14159], np.float32)
    half = codecs.narrow_half(x).view(np.float16).astype(np.float32)
    assert half[:5].tolist() == [0, 0, 1, -2.5, 65504] and np.isinf(half[5]) and half[6] == -np.inf and np.isnan(half[7]) and half[8] == 0 and half[9] == 3.140625
    brain = (codecs.narrow_brain(x).astype(np.uint32) << 16).view(np.float32)
    assert brain[2] == 1 and abs(brain[9] - 3.14159) < 0.02


def test_shuffles_of_whole_texts(spark, tmp_path):
    """Every byte of a text is shuffled, by brute force."""
    from quern import queries as q

    texts = {1: "naïve " * 900 + "end", 2: "x" * 199 + "öé", 3: "", 4: None, 5: "abc", 6: "".join(chr(33 + k % 90) for k in range(30_001))}
    spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    data = {k: None if t is None else t.encode() for k, t in texts.items()}
    run = lambda name, column: {r.seq: None if r[column] is None else bytes.fromhex(r[column]) for r in q.QUERIES[name](spark, str(tmp_path)).collect()}
    tail = lambda x: x[len(x) // 4 * 4 :]
    assert run("f1_byte_shuffle_whole", "shuffled") == {k: None if x is None else b"".join(x[: len(x) // 4 * 4][b::4] for b in range(4)) + tail(x) for k, x in data.items()}
    assert run("f2_unshuffle_whole", "data") == run("f3_bit_shuffle_whole", "data") == data


def test_verify_finds_a_damaged_chunk(spark, tmp_path, monkeypatch):
    from quern import queries as q
    from quern.llm.common import Scratch

    spark.createDataFrame([(k, f"text {k}", "en", "s") for k in range(5)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert q.s24_verify(spark, str(tmp_path)).collect() == [(5, 0)]
    keep = Scratch.keep
    damaged = F.when(F.col("key").endswith("/3"), F.lit("other").cast("binary")).otherwise(F.col("payload"))
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: keep(self, df, name).withColumn("payload", damaged))
    assert q.s24_verify(spark, str(tmp_path)).collect() == [(5, 1)]


def test_lz4_is_the_library_block_after_its_size():
    import pyarrow as pa

    from quern.functions import codecs

    for data in (b"", b"x", random.Random(5).randbytes(3000), b"again and " * 500):
        code = codecs.lz4_of(data)
        assert int.from_bytes(code[:4], "little") == len(data) and codecs.unlz4_of(code) == data
        assert not data or pa.decompress(code[4:], len(data), codec="lz4_raw", asbytes=True) == data


def test_blocks_of_any_length_come_back(spark):
    from quern.functions import codecs

    r = random.Random(6)
    for n in (0, 1, 3, 7, 8, 63, 1000):
        data = r.randbytes(n)
        for codec in codecs.CODECS:
            for filt in codecs.FILTERS:
                for width in (4, 8):
                    assert codecs.decode_block(codecs.encode_block(data, codec, filt, width), codec, filt, width) == data
    with pytest.raises(KeyError):
        codecs.encode_block(b"x", "brotli")


def test_gaussian_weights(spark):
    rows = {r["id"]: np.frombuffer(r["data"], "<f4") for r in models.gaussian_weights(spark, 5, 9001, 0.5, seed=3).collect()}
    x = np.concatenate([rows[k] for k in range(5)])
    assert len(x) == 45005 and abs(x.mean()) < 0.02 and abs(x.std() - 0.5) < 0.02 and abs((np.abs(x) < 0.5).mean() - 0.6827) < 0.02
    again = models.gaussian_weights(spark, 2, 9001, 0.5, seed=3).filter("id = 1").first()
    assert bytes(again["data"]) == rows[1].tobytes()


def test_correlated_floats_against_plain_bits(spark):
    r = random.Random(7)
    rows = [[r.uniform(-1, 1) for _ in range(n)] for n in (0, 3, 4, 80)] + [[1 + k / 1e6 for k in range(n)] for n in (3, 4, 64, 100)] + [[1.0] * 70 + [r.random()] * 9]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x array<float>").select("k", bytesfn.correlated_floats(F.col("x")).alias("c")).collect()
    for g in got:
        bits = [int(np.float32(v).view(np.uint32)) for v in rows[g.k][:64]]
        near = sum((a ^ b) < (1 << 20) for a, b in zip(bits, bits[1:]))
        assert g.c == (len(bits) >= 4 and near >= len(bits) * 3 // 4)


def test_nearest_rank_with_ties_and_nulls(spark):
    r = random.Random(8)
    rows = [(k % 3, float(r.randrange(20)) if r.random() < 0.9 else None) for k in range(900)]
    got = {(x.g, x.percent): x.value for x in models.nearest_rank(spark.createDataFrame(rows, "g int, v double"), "g", "v", [0.0, 50.0, 99.0, 100.0]).collect()}
    for g in range(3):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert all(got[g, p] == own[int((len(own) - 1) * p / 100 + 0.5)] for p in (0.0, 50.0, 99.0, 100.0))


def test_recent_sequences(spark):
    rows = [("u", b, p, f"{b}.{p}") for b in range(40) for p in range(3)] + [("v", 1, 0, "only")]
    got = {(x.u, x.b): x["keys"] for x in models.recent_sequences(spark.createDataFrame(rows, "u string, b long, p long, key string"), "u", "b", "p", "key").collect()}
    assert got == {("u", b): [f"{b}.{p}" for p in range(3)] for b in range(8, 40)} | {("v", 1): ["only"]}


def test_attribute_layout():
    from quern.functions import layouts
    from quern.schema import ArchiveError, AttrTooLarge

    attrs = {"name": "schön", "n": -5, "x": 0.25, "ok": True, "raw": b"\0\1", "": ""}
    code = layouts.attrs_to_bytes(attrs)
    assert layouts.attrs_from_bytes(code) == attrs and layouts.attrs_to_bytes(dict(reversed(attrs.items()))) == code
    assert layouts.attrs_to_bytes({"ok": True}) == b"\x02ok\x03\x01\x00\x01" and layouts.attrs_from_bytes(b"") == {}
    assert list(layouts.attrs_from_bytes(layouts.attrs_to_bytes({"k" * 300: 1}))) == ["k" * 255]
    with pytest.raises(AttrTooLarge):
        layouts.attrs_to_bytes({"x": "y" * 4097})
    for cut in range(1, len(code)):
        try:
            assert set(layouts.attrs_from_bytes(code[:cut]).items()) < set(attrs.items())
        except ArchiveError:
            pass
    for bad in (b"\x01k\x01\x04\x00abcd", b"\x01k\x09\x00\x00", b"\x01\xff\x00\x00\x00"):
        with pytest.raises(ArchiveError):
            layouts.attrs_from_bytes(bad)


def test_toc_layout():
    from quern.functions import layouts
    from quern.schema import ArchiveError

    entries = [layouts.Entry("a/b", "float32", [2, 3], {"n": 1}, [(0, 4096, 77), (3, 1 << 40, 5)]), layouts.Entry("ключ", "bool", [], deleted=True)]
    code = layouts.toc_to_bytes(entries)
    assert layouts.toc_from_bytes(code) == entries and layouts.toc_from_bytes(layouts.toc_to_bytes([])) == []
    for bad in (code[:-1], code[:30], code[:4] + b"\0" + code[5:]):
        with pytest.raises(ArchiveError):
            layouts.toc_from_bytes(bad)


def test_attributes_as_columns(spark):
    from quern.functions import layouts

    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {}), (3, None)], "k int, m map<string,string>")
    m = F.col("m")
    got = df.select("k", layouts.with_attr(m, "a", F.lit("9")).alias("w"), layouts.without_attr(m, "a").alias("o"), layouts.attr_count(m).alias("n"), layouts.attr_text(m).alias("t")).orderBy("k").collect()
    assert [r.w for r in got] == [{"a": "9", "b": "2"}, {"a": "9"}, {"a": "9"}] and [r.o for r in got] == [{"b": "2"}, {}, {}] and [r.n for r in got] == [2, 0, 0]
    assert layouts.attrs_from_bytes(bytes(got[0].t)) == {"a": "1", "b": "2"} and got[2].t is None
    with pytest.raises(Exception, match="larger than"):
        df.select(layouts.with_attr(m, "a", F.lit("x" * 5000))).collect()


def test_shards_are_the_library_hash(spark):
    import xxhash

    rows = [(k,) for k in ("", "a", "models/x", "ключ", "k" * 500)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k string").select("k", chunking.shard_of(F.col("k"), 7).alias("s")).collect()}
    assert got == {k: xxhash.xxh64(k.encode(), seed=0).intdigest() % 7 for (k,) in rows}


def test_auto_select_follows_its_rule(spark):
    rows = [(e, f, c, m, b, t) for e in (0, 1) for f in (0, 1) for c in (0, 1) for m in (0, 1) for b in (7.5, 7.7) for t in (0.0, 200.0)]
    df = spark.createDataFrame([tuple(map(bool, r[:4])) + r[4:] for r in rows], "e boolean, f boolean, c boolean, m boolean, b double, t double")
    pick = bytesfn.auto_select(F.col("e"), F.col("t"), F.col("f"), F.col("c"), F.col("m"), F.col("b"))

    def want(e, f, c, m, b, t):
        if e:
            return "raw", "none", 0
        if t >= 200:
            return "lz4", "none", 1
        if f:
            return ("chimp", "none", 0) if c else ("lz4", "none", 1) if b > 7.6 else ("zstd", "byte_shuffle", 3)
        return ("zstd", "delta_zigzag", 3) if m else ("raw", "none", 0) if b > 7.6 else ("zstd", "byte_shuffle", 3)

    for r in df.withColumn("p", pick).collect():
        assert tuple(r.p) == want(r.e, r.f, r.c, r.m, r.b, r.t)
