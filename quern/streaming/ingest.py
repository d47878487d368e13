"""Continuous ingestion: a stream of writes into an archive, each micro-batch one commit, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..schema import CHECKPOINT_SECONDS
from ..sources.archive import Archive


def ingest(stream: DataFrame, archive: Archive, checkpoint: str, name: str = "ingest", once: bool = False, ordered_by: str | None = None) -> StreamingQuery:
    """stream: key and any of op, dtype, shape, attrs, retain, data. A batch that was committed before a failure is
    recognised by its number in the manifest and left out on replay."""

    def commit(rows: DataFrame, number: int) -> None:
        archive.append(rows, batch=(name, number), ordered_by=ordered_by)

    writer = stream.writeStream.queryName(name).foreachBatch(commit).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{CHECKPOINT_SECONDS} seconds"}
    return writer.trigger(**trigger).start()
