"""Stored archives: commits, versions, deletion, recovery, compaction, the dictionary facade and streaming."""

from __future__ import annotations

import glob
import os

import numpy as np
import pytest

from quern.schema import AlreadyLocked, ArchiveError, AttrTooLarge, InvalidDType, KeyNotFound, ReadOnly, VersionNotFound
from quern.sources import compat
from quern.sources.archive import Archive
from quern.streaming.ingest import ingest


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def test_round_trip_and_modes(spark, path):
    values = {"test/tensor": np.array([1, 2, 3, 4], np.float32), "empty": np.zeros((0, 3), np.int64), "scalar": np.array(7, np.int64), "": np.array([1], np.uint8), "ключ/鍵": np.arange(6, dtype=np.int16).reshape(2, 3), "bits": np.array([True, False])}
    special = np.array([0.0, -0.0, np.inf, np.nan, 5e-324], np.float64)
    with compat.Database(spark, path, "w") as db:
        db.put_batch(values | {"special": special})
        with pytest.raises(AlreadyLocked):
            Archive(spark, path, "a")
    with compat.Database(spark, path, "r") as db:
        got = dict(db.get_batch([*values, "missing"]))
        assert set(got) == set(values)
        for k, v in values.items():
            assert got[k].dtype == v.dtype and got[k].shape == v.shape and (got[k] == v).all()
        assert db["special"].tobytes() == special.tobytes()
        assert "" not in db.keys() and "missing" not in db and len(db) == len(values)
        with pytest.raises(KeyNotFound):
            db["missing"]
        with pytest.raises(ReadOnly):
            db["x"] = values["bits"]
    with compat.Database(spark, path, "w") as db:
        assert db.keys() == []
    with pytest.raises(ArchiveError):
        Archive(spark, path + "-none", "r")


def test_versions_and_retention(spark, path):
    with compat.Database(spark, path, "w") as db:
        for k in range(6):
            db.put("kept", np.full(4, k, np.int32), retain="keep_last_n:3")
            db.put("all", np.full(4, k, np.int32), retain="keep_forever")
        db.put("gone", np.zeros(2, np.int32))
        db.delete("gone")
        db.delete("never there")
        db.flush()
        assert db.list_versions("kept") == [3, 4, 5] and db.list_versions("all") == list(range(6))
        assert db.get_version("kept", 4)[0] == 4
        with pytest.raises(VersionNotFound):
            db.get_version("kept", 2)
        with pytest.raises(KeyNotFound):
            db.list_versions("gone")
        changes = {(r.change) for r in db.diff("all", 1, 2).collect()}
        assert changes == {"added", "removed"}
        db.put("gone", np.ones(2, np.int32))
        db.flush()
        assert db.list_versions("gone") == [0] and db["gone"][0] == 1
        assert db.compact(dry_run=True)["kept"] == 3
        db.compact()
        assert db.list_versions("all") == [0] and db["all"][0] == 5
        assert {r.content_hash for r in db.archive.unreferenced().collect()} == set()


def test_dedup_and_stats(spark, path):
    same = np.random.default_rng(0).normal(size=50_000).astype(np.float32)
    with compat.Database(spark, path, "w") as db:
        db.put("v1", same)
        db.put("v2", same)
        db.flush()
        stats = db.dedup_stats().first()
        assert stats.ratio == 2.0 and stats.cross_key_hits == stats.unique_segments and stats.physical_bytes == same.nbytes
        assert db.archive.verify().count() == 0
        assert db.info().first().live_entries == 2
        assert {r.path: r.bytes for r in db.tree().collect()} == {"v1": same.nbytes, "v2": same.nbytes}


def test_torn_commit_and_uncommitted_files(spark, path):
    with compat.Database(spark, path, "w") as db:
        db["a"] = np.arange(3)
    newest = max(int(os.path.basename(p)[:-5]) for p in glob.glob(f"{path}/_commits/*.json"))
    with open(f"{path}/_commits/{newest + 1}.json", "w") as f:
        f.write('{"number": 99')
    os.makedirs(f"{path}/toc/commit=77")
    with compat.Database(spark, path, "a") as db:
        assert db.keys() == ["a"] and not os.path.exists(f"{path}/toc/commit=77")
        db["b"] = np.arange(4)
    assert set(compat.load(spark, path)) == {"a", "b"}


def test_corruption_is_found(spark, path):
    with compat.Database(spark, path, "w") as db:
        db["ledger"] = np.arange(6000, dtype=np.uint16)
    with Archive(spark, path, "a") as a:
        bad = a.chunks().selectExpr("content_hash", "len", "crc32 + 1 AS crc32", "payload")
        bad.write.parquet(f"{path}/chunks/commit=bad")
        a._publish(a.manifest | {"chunks": ["chunks/commit=bad"]})
        assert a.verify().count() == 1
        with pytest.raises(Exception, match="checksum mismatch"):
            a.get("ledger").collect()


def test_attributes(spark, path):
    with Archive(spark, path, "w") as a:
        a.put("k", b"1234", "uint8", [4], {"n": 3, "ok": True, "x": 0.5, "s": "t", "y": b"\0"})
        assert a.get_attrs("k") == {"n": 3, "ok": True, "x": 0.5, "s": "t", "y": bytearray(b"\0")}
        with pytest.raises(AttrTooLarge):
            a.put("k", b"", attrs={"big": "x" * 4097})
        with pytest.raises(InvalidDType):
            a.put("k", b"", "complex64")
        with pytest.raises(KeyNotFound):
            a.get_attrs("none")
        a.set_attr("k", "n", 4)
        assert a.get_attrs("k") == {"n": 4, "ok": True, "x": 0.5, "s": "t", "y": bytearray(b"\0")} and a.chunks().count() == 1
        a.set_global_attr("owner", "me")
        assert a.global_attrs() == {"owner": "me"}


def test_one_liners(spark, path, tmp_path):
    compat.save(spark, path, np.arange(5))
    assert (compat.load(spark, path, "data") == np.arange(5)).all()
    assert compat.info(spark, path)["count"] == 1
    np.savez(tmp_path / "x.npz", p=np.ones(2), q=np.zeros(3))
    compat.import_npz(spark, path, str(tmp_path / "x.npz"))
    assert set(compat.keys(spark, path)) == {"data", "p", "q"}


def test_streaming_is_exactly_once(spark, path, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 3}", bytearray([i])) for i in range(9)], "key string, data binary")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    with Archive(spark, path, "w") as a:
        ingest(stream, a, str(tmp_path / "cp"), once=True).awaitTermination()
        assert len(a.keys()) == 3
        before = a.toc().count()
        a.append(rows, batch=("ingest", 0))
        assert a.toc().count() == before == 9


def test_command_line(spark, path, capsys):
    from quern import cli

    with compat.Database(spark, path, "w") as db:
        db["a/b"] = np.arange(3)
        db["a/b"] = np.arange(4)
    assert cli.main(["info", path]) == 0 and "'live_entries': 2" in capsys.readouterr().out
    assert cli.main(["compact", path]) == 0 and cli.main(["verify", path]) == 0 and cli.main(["tree", path, "--prefix", "a/"]) == 0
    out = capsys.readouterr().out
    assert "'kept': 1" in out and "0 corrupted" in out and "'path': 'a/b'" in out


def test_batch_reader_predicts(spark, path):
    with compat.Database(spark, path, "w") as db:
        db.put_batch({k: np.arange(2) for k in "abc"})
        reader = compat.BatchReader(db)
        assert list(reader.get_batch(["c", "a", "missing", "b", "a"])) == ["c", "a", "b"]
        reader.get_batch(["a", "b", "c", "a", "b"])
        assert reader.predict_next("b", "c") == "a" and reader.predict_next("c", "c") is None


def test_prediction_outlives_the_kept_requests():
    from types import SimpleNamespace

    from quern.sources.compat import BatchReader

    reader = BatchReader(SimpleNamespace(get_batch=lambda keys: {}))
    for keys in (["a", "b", "c"], *([f"x{k}", "y", "z"] for k in range(40)), ["p", "q"]):
        reader.get_batch(keys)
    assert len(reader.requests) == 32 and reader.predict_next("a", "b") == "c" and reader.predict_next("p", "q") is None


def test_lock_of_a_dead_writer(spark, path):
    dead = Archive(spark, path, "w")
    dead.put("kept", b"one")
    dead.flush()
    dead.put("lost", b"two")
    os.makedirs(f"{path}/chunks/commit=99")  # what a commit that didn't finish leaves
    with pytest.raises(AlreadyLocked):
        Archive(spark, path, "a", lease=3600)
    with Archive(spark, path, "a", lease=0) as heir:
        assert heir.keys() == ["kept"] and not os.path.exists(f"{path}/chunks/commit=99")
        with pytest.raises(AlreadyLocked):
            dead.flush()
        heir.put("more", b"three")
    assert Archive(spark, path, "r").keys() == ["kept", "more"]
    Archive(spark, path, "a")
    Archive.break_lock(spark, path)
    with Archive(spark, path, "a") as a:
        assert a.keys() == ["kept", "more"]


def test_a_body_that_raises_leaves_what_it_had_not_flushed(spark, path):
    with pytest.raises(RuntimeError), Archive(spark, path, "w") as a:
        a.put("kept", b"one")
        a.flush()
        a.put("lost", b"two")
        raise RuntimeError
    with Archive(spark, path, "a") as a:
        assert a.keys() == ["kept"]


def test_compact_counts_surviving_versions_only(spark, path):
    with Archive(spark, path, "w") as a:
        for k in range(5):
            a.put("x", bytes([k]) * 3, retain="keep_last_n:2")
            a.put("y", bytes([k, k]), retain="keep_forever")
        assert a.compact(3) == {"entries": 10, "kept": 5}
        assert [bytes(r["data"]) for r in a.assembled(a.toc().filter("key = 'x'")).orderBy("seq").collect()] == [b"\3" * 3, b"\4" * 3]


@pytest.mark.parametrize(("codec", "filt"), [("lz4", "none"), ("zstd", "byte_shuffle"), ("zstd", "delta_zigzag"), ("lz4", "bit_shuffle"), ("chimp", "none"), ("auto", "none")])
def test_codecs_and_filters_of_chunks(spark, path, codec, filt):
    rng = np.random.default_rng(2)
    values = {
        "ramp": np.linspace(2, 2.001, 900, dtype=np.float32), "noise": rng.normal(size=700), "steps": np.cumsum(rng.integers(0, 9, 5000)).astype(np.int64),
        "bytes": np.frombuffer(rng.bytes(70_001), np.uint8), "text": np.frombuffer(b"the same words again " * 9000, np.uint8), "empty": np.zeros(0, np.float32), "half": rng.normal(size=33).astype(np.float16),
    }
    with Archive(spark, path, "w", codec=codec, filt=filt) as a:
        for k, v in values.items():
            data, dtype, shape = compat.parts_of(v)
            a.put(k, data, dtype, shape)
    with compat.Database(spark, path, "r") as db:
        got = db.get_batch(list(values))
        assert all(got[k].dtype == v.dtype and got[k].tobytes() == v.tobytes() for k, v in values.items())
        used = {(r["codec"], r["filter"]) for r in db.archive.chunks().select("codec", "filter").distinct().collect()}
        assert used == {(codec, filt)} if codec != "auto" else {"chimp", "zstd"} <= {c for c, _ in used} and ("zstd", "delta_zigzag") in used
        assert db.archive.verify().count() == 0
        if codec == "zstd":
            assert db.archive.chunks().selectExpr("sum(octet_length(payload)) < sum(len)").first()[0]
    with pytest.raises(ValueError):
        Archive(spark, path, "a", codec="none such")


def test_data_source(spark, path):
    from quern.plans import views
    from quern.sources.datasource import register

    with Archive(spark, path, "w") as a:
        a.put("a", b"one", attrs={"n": 3, "s": "t"})
        a.flush()
        a.put("b", b"two")
        a.put("a", b"three")
        a.delete("b")
        a.flush()
        register(spark)
        log = spark.read.format("quern").load(path)
        plain = lambda df: sorted((r["seq"], r["key"], r["op"], r["dtype"], r["shape"], r["attrs"], r["refs"]) for r in df.collect())
        assert plain(log) == plain(a.toc()) and [r["key"] for r in views.live_keys(log).collect()] == ["a"]
        chunks = spark.read.format("quern").option("table", "chunks").load(path)
        assert sorted(bytes(r["payload"]) for r in chunks.collect()) == [b"one", b"three", b"two"]


def test_batches_of_pairs(spark, path):
    with compat.open(spark, path, "w", shards=8) as db:
        db.put_batch([("x", np.arange(3)), ("y", np.zeros(2)), ("x", np.arange(5))])
        assert sorted(db.keys()) == ["x", "y"] and len(db["x"]) == 5


def test_torch_adapter(spark, path):
    torch = pytest.importorskip("torch")
    from quern.sources import torch as adapter

    adapter.save_file(spark, {"w": torch.arange(6.0).reshape(2, 3).requires_grad_()}, path)
    assert adapter.load_file(spark, path)["w"].tolist() == [[0, 1, 2], [3, 4, 5]]
