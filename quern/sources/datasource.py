"""Archives by `spark.read.format("quern")`: the log (default) or the chunks of the newest snapshot.

    register(spark)
    spark.read.format("quern").option("table", "chunks").load(path)

The driver reads the manifest; a task reads one Parquet file. Views of plans.views apply to the log as it comes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class QuernSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern"

    def schema(self) -> StructType:
        from ..schema import CHUNKS, TOC

        return {"toc": TOC, "chunks": CHUNKS}[self.options.get("table", "toc")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return QuernReader(self.options["path"], self.options.get("table", "toc"), schema)


class QuernReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.columns = path, table, schema

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _manifest(self, files: fs.FileSystem, root: str) -> dict:
        found = [f for f in files.get_file_info(fs.FileSelector(f"{root}/_commits")) if f.base_name.removesuffix(".json").isdigit()]
        for info in sorted(found, key=lambda f: -int(f.base_name[:-5])):
            try:
                body = json.loads(files.open_input_file(info.path).read())
                if body.pop("sha256") == hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest():
                    return body
            except (ValueError, KeyError):
                continue
        raise ValueError(f"no archive at {self.path}")

    def partitions(self) -> list[InputPartition]:
        files, root = self._files()
        out = []
        for name in self._manifest(files, root)[self.table]:
            out += [InputPartition(f.path) for f in files.get_file_info(fs.FileSelector(f"{root}/{name}")) if f.base_name.endswith(".parquet") and f.size]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.value is None:
            return
        wanted = to_arrow_schema(self.columns)
        file = pq.ParquetFile(self._files()[0].open_input_file(partition.value))
        there = set(file.schema_arrow.names)
        for batch in file.iter_batches(batch_size=1024, columns=[n for n in wanted.names if n in there]):
            columns = [batch[f.name].cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in wanted]
            yield pa.record_batch(columns, wanted)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QuernSource)
