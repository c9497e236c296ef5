"""A stream of records or documents into a database, one commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import RagPipeline
from ..sources.store import Database


def stream_records(rows: DataFrame, db: Database, checkpoint: str, order: list[str], once: bool = True) -> StreamingQuery:
    """Stream of (embedding, document, and the columns of ``order``). A batch that is replayed after a crash is recognised by its number, which is part of the commit of its rows."""
    return _start(rows, db, checkpoint, once, lambda batch, mark: db.insert_table(batch, [F.col(c) for c in order], stream=mark))


def stream_documents(rows: DataFrame, pipeline: RagPipeline, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream of (doc_id, metadata, text), chunked and embedded as in batches."""
    return _start(rows, pipeline.db, checkpoint, once, pipeline.ingest_table)


def distinct_within(rows: DataFrame, id: str, ts: str, delay: str) -> DataFrame:
    """The first row of each id among those that come within ``delay`` of each other; state older than the watermark is dropped."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id])


def _start(rows: DataFrame, db: Database, checkpoint: str, once: bool, insert) -> StreamingQuery:
    def commit(batch: DataFrame, number: int) -> None:
        insert(batch, (checkpoint, number))

    writer = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
