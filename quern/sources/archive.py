"""A stored archive: Parquet tables for the log and the chunks, and commit manifests that say which files count.

    <path>/toc/commit=N-*/     log rows with chunk references, without payloads
    <path>/chunks/commit=N-*/  content-addressed payloads; a content is stored once
    <path>/_commits/N.json     manifest: the directories that make up snapshot N, and a checksum over itself
    <path>/_lock               exists while a writer holds the archive: who, and when it last committed

A commit is the rename of its manifest. Readers take the newest valid manifest and never see directories of a commit
that didn't finish; the next writer removes those. All files go through Spark's file systems.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, codecs
from ..plans import views
from ..schema import (
    ATTRS,
    CHECKPOINT_BYTES,
    CHECKPOINT_SECONDS,
    CHUNKS,
    DEFAULT_SHARDS,
    DTYPES,
    LOG,
    MAX_ATTR_BYTES,
    TOC,
    AlreadyLocked,
    ArchiveError,
    AttrTooLarge,
    InvalidDType,
    KeyNotFound,
    ReadOnly,
    VersionNotFound,
)


class Files:
    """The few file operations that Spark's readers and writers don't offer."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))] if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str, over: bool = False) -> None:
        """Fails if the file exists, unless it may be written over."""
        stream = self.fs.create(self.path(name), over)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.path(old), self.path(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def typed_attr(value: object) -> dict:
    """A value as the typed union of schema.ATTR."""
    value = bytes(value) if isinstance(value, bytearray) else value
    size = len(value.encode() if isinstance(value, str) else value) if isinstance(value, (str, bytes)) else 8
    if size > MAX_ATTR_BYTES:
        raise AttrTooLarge(f"{size} bytes")
    kinds = (("bool", bool, "b"), ("int64", int, "i"), ("float64", float, "f"), ("string", str, "s"), ("bytes", bytes, "y"))
    name, _, slot = next(k for k in kinds if isinstance(value, k[1]))
    return {"t": name, "s": None, "i": None, "f": None, "b": None, "y": None} | {slot: value}


class Archive:
    """One archive; see the module's docstring. Modes: r reads; a and w+ append, w starts anew; all but r create.

    A writer that dies leaves its lock. `break_lock` removes it; with a `lease`, a writer takes over a lock whose owner
    has not committed for so many seconds. Whoever lost the lock can't commit any more.

    `codec` and `filt` (names of functions.codecs; "auto" picks both for each chunk) say how this writer stores chunks;
    readers take them from the chunks. Plain chunks are left to Parquet's LZ4.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "r", shards: int = DEFAULT_SHARDS, lease: float | None = None, codec: str = "raw", filt: str = "none"):
        if mode not in ("r", "a", "w", "w+"):
            raise ValueError(mode)
        if codec not in (*codecs.CODECS, "auto") or filt not in codecs.FILTERS:
            raise ValueError(f"{codec} {filt}")
        self.spark, self.files, self.mode, self.closed = spark, Files(spark, path), mode, False
        self.codec, self.filt = codec, filt
        self.pending: list[tuple] = []
        self.pending_bytes, self.since = 0, time.monotonic()
        self.manifest = self._newest()
        if mode == "r":
            if self.manifest is None:
                raise ArchiveError(f"no archive at {path}")
            return
        self.owner = uuid.uuid4().hex
        if lease is not None and (held := self._held()) and time.time() - held["at"] > lease:
            # The rename succeeds for one of those that try.
            self.files.rename("_lock", f"_lock.{held['owner']}")
            self.files.delete(f"_lock.{held['owner']}")
        try:
            self.files.write_new("_lock", self._mark())
        except Exception as e:
            raise AlreadyLocked(path) from e
        self.manifest = self._newest()
        self._clean()
        if self.manifest is None or mode == "w":
            self._publish({"toc": [], "chunks": [], "next_seq": 0, "shards": max(1, shards), "batches": {}, "global_attrs": {}})

    # Lock --------------------------------------------------------------------------------------------------------

    def _mark(self) -> str:
        return json.dumps({"owner": self.owner, "at": time.time()})

    def _held(self) -> dict | None:
        """Who holds the lock; a lock that can't be read is as old as can be."""
        if not self.files.exists("_lock"):
            return None
        try:
            found = json.loads(self.files.read("_lock"))
            return {"owner": str(found["owner"]), "at": float(found["at"])}
        except (ValueError, KeyError, TypeError):
            return {"owner": "unknown", "at": 0.0}

    def _owned(self) -> None:
        if (self._held() or {}).get("owner") != self.owner:
            raise AlreadyLocked(f"{self.files.root}: another writer took over")

    def _directory(self) -> str:
        """A name for the next commit's directories that no other writer uses."""
        return f"commit={self._last_number() + 1}-{self.owner[:12]}"

    @staticmethod
    def break_lock(spark: SparkSession, path: str) -> None:
        """Remove the lock of a writer that is known to be dead."""
        Files(spark, path).delete("_lock")

    # Snapshots ---------------------------------------------------------------------------------------------------

    def _newest(self) -> dict | None:
        """The newest manifest whose checksum holds; torn ones are passed over."""
        numbers = sorted((int(n[:-5]) for n in self.files.names("_commits") if n.endswith(".json") and n[:-5].isdigit()), reverse=True)
        for n in numbers:
            try:
                found = json.loads(self.files.read(f"_commits/{n}.json"))
                if found.pop("sha256") == hashlib.sha256(json.dumps(found, sort_keys=True).encode()).hexdigest():
                    return found
            except (ValueError, KeyError):
                continue
        return None

    def _last_number(self) -> int:
        return max((int(n[:-5]) for n in self.files.names("_commits") if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def _publish(self, manifest: dict, final: bool = False) -> None:
        self._owned()
        n = self._last_number() + 1
        body = manifest | {"number": n, "final": final}
        text = json.dumps(body | {"sha256": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()})
        self.files.write_new(f"_commits/.{n}.tmp", text)
        if not self.files.rename(f"_commits/.{n}.tmp", f"_commits/{n}.json"):
            raise ArchiveError(f"commit {n} exists")
        self.manifest = body
        self.files.write_new("_lock", self._mark(), over=True)

    def _clean(self) -> None:
        known = set(self.manifest["toc"] + self.manifest["chunks"]) if self.manifest else set()
        for kind in ("toc", "chunks", "_staging"):
            for name in self.files.names(kind):
                if f"{kind}/{name}" not in known:
                    self.files.delete(f"{kind}/{name}")

    def _read(self, kind: str) -> DataFrame:
        schema = TOC if kind == "toc" else CHUNKS
        dirs = [f"{self.files.root}/{d}" for d in self.manifest[kind]]
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def toc(self) -> DataFrame:
        """The log without payloads, as of the last commit and what this writer has flushed."""
        self._settle()
        return self._read("toc")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    # Writing -----------------------------------------------------------------------------------------------------

    def _writable(self) -> None:
        if self.mode == "r" or self.closed:
            raise ReadOnly(self.files.root)

    def put(self, key: str, data: bytes, dtype: str = "uint8", shape: Iterable[int] | None = None, attrs: Mapping[str, object] | None = None, retain: str = "keep_latest") -> None:
        self._writable()
        if dtype not in DTYPES:
            raise InvalidDType(dtype)
        shape = [len(data) // DTYPES[dtype].width] if shape is None else list(shape)
        self.pending.append((key, "put", dtype, shape, {k: typed_attr(v) for k, v in (attrs or {}).items()}, retain, bytearray(data)))
        self.pending_bytes += len(data)
        if self.pending_bytes >= CHECKPOINT_BYTES or self.pending_bytes and time.monotonic() - self.since >= CHECKPOINT_SECONDS:
            self.flush()

    def delete(self, key: str) -> None:
        """A missing key is no error."""
        self._writable()
        self.pending.append((key, "delete", None, None, None, None, None))

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, ordered_by: str | None = None) -> None:
        """Commit a table of writes (key, and any of op, dtype, shape, attrs, retain, data) as one snapshot.

        Payloads are chunked on the executors; a content that the archive or the batch has already is not stored again.
        A `batch` (stream, number) that was committed before is left out, which makes retries harmless. Writes to one
        key count in the order of `ordered_by`; without it a table must hold a key once, as which of two writes is the
        later one is then not defined.
        """
        self._writable()
        self._owned()
        self._settle()
        if batch and self.manifest["batches"].get(batch[0], -1) >= batch[1]:
            return
        n, base = self._directory(), self.manifest["next_seq"]
        given = set(rows.columns)
        fill = {"op": F.lit("put"), "dtype": F.lit("uint8"), "shape": F.array(F.octet_length("data") if "data" in given else F.lit(0)), "attrs": F.create_map().cast(ATTRS), "retain": F.lit("keep_latest"), "data": F.lit(None).cast("binary")}
        if ordered_by:
            rows = rows.orderBy(ordered_by)
        rows = rows.select("key", *(F.col(c) if c in given else x.alias(c) for c, x in fill.items())).withColumn("seq", F.monotonically_increasing_id() + base)
        rows.write.parquet(f"{self.files.root}/_staging/{n}/rows")
        staged = self.spark.read.schema(LOG).parquet(f"{self.files.root}/_staging/{n}/rows")
        chunking.segments(staged.filter("op = 'put'"), "seq", "data").write.parquet(f"{self.files.root}/_staging/{n}/segments")
        cut = self.spark.read.parquet(f"{self.files.root}/_staging/{n}/segments")
        # Hashes decide which payloads are stored; payloads are joined to the few that are, and move only if many are.
        known = self.chunks().select("content_hash")
        first = cut.select("content_hash", "seq", "ord").join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min(F.struct("seq", "ord")).alias("first"))
        fresh = cut.join(first.select("first.*"), ["seq", "ord"], "left_semi")
        self._stored(fresh, staged).write.option("compression", "lz4_raw").parquet(f"{self.files.root}/chunks/{n}")
        refs = cut.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("ord", "content_hash", "len"))).alias("refs"))
        toc = staged.drop("data").join(refs, "seq", "left").withColumns({"refs": F.coalesce("refs", F.array().cast(TOC["refs"].dataType)), "committed_at": F.localtimestamp()})
        toc.select(*TOC.names).sortWithinPartitions("key", "seq").write.parquet(f"{self.files.root}/toc/{n}")
        top = self.spark.read.schema(TOC).parquet(f"{self.files.root}/toc/{n}").agg(F.max("seq")).first()[0]
        batches = self.manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish(self.manifest | {"toc": [*self.manifest["toc"], f"toc/{n}"], "chunks": [*self.manifest["chunks"], f"chunks/{n}"], "next_seq": base if top is None else top + 1, "batches": batches, "coded": self.manifest.get("coded", False) or self._codes()})
        self.files.delete(f"_staging/{n}")

    def _codes(self) -> bool:
        return (self.codec, self.filt) != ("raw", "none")

    def _stored(self, fresh: DataFrame, staged: DataFrame) -> DataFrame:
        """CHUNKS of segments (seq, content_hash, len, payload), each by its codec and filter."""
        if not self._codes():
            rows = fresh.withColumns({"codec": F.lit("raw"), "filter": F.lit("none"), "width": F.lit(1)})
        else:
            widths = F.create_map(*(F.lit(x) for name, kind in DTYPES.items() for x in (name, kind.width)))
            rows = fresh.join(staged.select("seq", "dtype"), "seq").withColumn("width", widths[F.col("dtype")])
            if self.codec == "auto":
                rows = rows.withColumn("how", codecs.picked(F.col("payload"), F.col("width"), F.col("dtype").isin("float64", "float32", "float16", "bfloat16")))
            else:
                rows = rows.withColumn("how", F.struct(F.lit(self.codec).alias("codec"), F.lit(self.filt).alias("filter"), F.lit(3).alias("level")))
            rows = rows.withColumns({"codec": F.col("how.codec"), "filter": F.col("how.filter"), "payload": codecs.encoded(F.col("payload"), F.col("how.codec"), F.col("how.filter"), F.col("width"), F.col("how.level"))})
        return rows.withColumn("crc32", F.crc32("payload")).select(*CHUNKS.names)

    def _settle(self) -> None:
        if self.pending:
            rows, self.pending, self.pending_bytes, self.since = self.pending, [], 0, time.monotonic()
            schema = "at long, key string, op string, dtype string, shape array<int>, attrs " + ATTRS.simpleString() + ", retain string, data binary"
            self.append(self.spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schema), ordered_by="at")

    def flush(self) -> None:
        self._writable()
        self._settle()

    def close(self) -> None:
        if not self.closed and self.mode != "r":
            self._settle()
            self._publish(self.manifest, final=True)
            self.files.delete("_lock")
        self.closed = True

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        """A body that raised leaves what it had not flushed."""
        if kind is not None:
            self.pending, self.pending_bytes = [], 0
            if self.mode != "r" and not self.closed and (self._held() or {}).get("owner") == self.owner:
                self.files.delete("_lock")
            self.closed = True
        self.close()

    def set_attr(self, key: str, name: str, value: object) -> None:
        """Write the key's last value again with one attribute changed; its chunks are stored already."""
        row = self.get(key).first()
        if row is None:
            raise KeyNotFound(key)
        self.put(key, bytes(row["data"]), row["dtype"], row["shape"], self.get_attrs(key) | {name: value}, row["retain"])

    def set_global_attr(self, name: str, value: str) -> None:
        self._writable()
        typed_attr(value)
        self._publish(self.manifest | {"global_attrs": self.manifest["global_attrs"] | {name: value}})

    def global_attrs(self) -> dict[str, str]:
        return dict(self.manifest["global_attrs"])

    # Reading -----------------------------------------------------------------------------------------------------

    def assembled(self, entries: DataFrame) -> DataFrame:
        """Entries (seq, refs, ...) with their `data`; a chunk that fails its checksum or is missing stops the query."""
        part = entries.select("seq", F.explode("refs").alias("ref")).select("seq", "ref.ord", "ref.content_hash")
        intact = F.when(F.crc32("payload") == F.col("crc32"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("checksum mismatch in chunk "), "content_hash")).cast("binary"))
        joined = part.join(self.chunks(), "content_hash", "left").withColumn("payload", intact)
        if self.manifest.get("coded"):
            joined = joined.withColumn("payload", codecs.decoded(F.col("payload"), F.coalesce("codec", F.lit("raw")), F.coalesce("filter", F.lit("none")), F.coalesce("width", F.lit(1))))
        whole = joined.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("ord", "payload"))).alias("parts"))
        # Most payloads are one chunk; Spark joins arrays of strings only, hence the digits for the others.
        several = F.unhex(F.array_join(F.transform("parts.payload", F.hex), ""))
        whole = whole.select("seq", F.when(F.size("parts") == 1, F.col("parts")[0]["payload"]).otherwise(several).alias("data"))
        return entries.join(whole, "seq", "left").withColumn("data", F.coalesce("data", F.lit(b"")))

    def latest(self) -> DataFrame:
        return views.latest(self.toc())

    def get(self, key: str) -> DataFrame:
        return self.assembled(views.get(self.toc(), key))

    def get_batch(self, keys: list[str]) -> DataFrame:
        found = views.get_batch(self.toc(), keys)
        data = self.assembled(found.drop("pos").dropDuplicates(["seq"])).select("seq", "data")
        return found.join(data, "seq").orderBy("pos")

    def get_prefix(self, start: str) -> DataFrame:
        return self.assembled(views.prefix(self.toc(), start))

    def keys(self) -> list[str]:
        return [r["key"] for r in views.live_keys(self.toc()).orderBy("seq").collect()]

    def _kept(self, key: str) -> DataFrame:
        return views.retained(self.toc().filter(F.col("key") == key))

    def list_versions(self, key: str) -> list[int]:
        found = sorted(r["version"] for r in self._kept(key).select("version").collect())
        if not found:
            raise KeyNotFound(key)
        return found

    def get_version(self, key: str, version: int) -> DataFrame:
        if version not in self.list_versions(key):
            raise VersionNotFound(f"{key} {version}")
        return self.assembled(self._kept(key).filter(F.col("version") == version))

    def diff(self, key: str, old: int, new: int) -> DataFrame:
        """content_hash, change: chunks that version `new` added or removed."""
        known = self.list_versions(key)
        if old not in known or new not in known:
            raise VersionNotFound(f"{key} {old} {new}")
        refs = self._kept(key).select("version", F.explode("refs.content_hash").alias("content_hash"))
        return views.diff(refs.filter(F.col("version") == old), refs.filter(F.col("version") == new))

    def get_attrs(self, key: str) -> dict[str, object]:
        row = views.get(self.toc(), key).select("attrs").first()
        if row is None:
            raise KeyNotFound(key)
        return {k: next((x for x in (v["b"], v["i"], v["f"], v["s"], v["y"]) if x is not None), None) for k, v in (row["attrs"] or {}).items()}

    # Upkeep and reports ------------------------------------------------------------------------------------------

    def verify(self) -> DataFrame:
        """content_hash of chunks whose payload fails its checksum."""
        return views.checked(self.chunks()).select("content_hash")

    def _refs(self) -> DataFrame:
        return self.toc().filter("op = 'put'").select("seq", "key", F.explode("refs").alias("ref")).select("seq", "key", "ref.content_hash", F.col("ref.len").cast("long").alias("len"))

    def dedup_stats(self) -> DataFrame:
        return views.dedup_stats(self._refs())

    def unreferenced(self) -> DataFrame:
        live = views.retained(self.toc()).select(F.explode("refs.content_hash").alias("content_hash"))
        return views.unreferenced(self.chunks().select("content_hash"), live)

    def info(self) -> DataFrame:
        return views.info(self.toc()).withColumn("shards", F.lit(self.manifest["shards"]))

    def tree(self, start: str = "") -> DataFrame:
        sized = views.prefix(self.toc(), start).select("key", F.aggregate("refs", F.lit(0).cast("long"), lambda a, r: a + r["len"]).alias("len"))
        return views.tree(sized)

    def compact(self, keep: int = 1, dry_run: bool = False) -> dict[str, int]:
        """Rewrite the archive with each live key's last `keep` surviving versions and the chunks that these need."""
        toc = self.toc()
        kept = views.latest(toc) if keep == 1 else views.last_versions(views.retained(toc), keep)
        before, after = toc.count(), kept.count()
        if not dry_run:
            self._writable()
            self._owned()
            n, old = self._directory(), self.manifest
            kept.select(*TOC.names).write.parquet(f"{self.files.root}/toc/{n}")
            stored = self.spark.read.schema(TOC).parquet(f"{self.files.root}/toc/{n}")
            used = stored.select(F.explode("refs.content_hash").alias("content_hash")).distinct()
            self.chunks().join(used, "content_hash", "left_semi").write.option("compression", "lz4_raw").parquet(f"{self.files.root}/chunks/{n}")
            self._publish(old | {"toc": [f"toc/{n}"], "chunks": [f"chunks/{n}"]})
        return {"entries": before, "kept": after}

    def export(self, path: str) -> None:
        """Live keys with their payloads as one Parquet table."""
        self.assembled(self.latest()).write.parquet(path)
