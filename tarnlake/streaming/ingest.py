"""Streams into lake tables: a micro-batch is one commit, and a batch that comes again is not added twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tarnlake.operators.table import LakeTable
from tarnlake.plans.metadata import CommitConflict
from tarnlake.sources.session import LakeSession

BATCH = "stream-batch"


def append_batch(t: LakeTable, batch: DataFrame, stream_id: str, number: int, retries: int = 10) -> bool:
    """Add one micro-batch unless the table has it; the table's mark and the rows are one commit on the state that was read."""
    mark = f"stream.{stream_id}.batch"
    for attempt in range(retries + 1):
        base = t.metadata
        if int(base.properties.get(mark, -1)) >= number:
            return False
        try:
            t.append(batch, summary={BATCH: f"{stream_id}:{number}"}, base=base, properties={mark: str(number)})
            return True
        except CommitConflict:
            if attempt == retries:
                raise
    raise AssertionError


def append_stream(session: LakeSession, stream: DataFrame, table: str, checkpoint: str, refresh: tuple[str, ...] = (), stream_id: str = "stream") -> DataStreamWriter:
    """A writer that appends each micro-batch and then refreshes dependent views; start it with any trigger.

    A property of the table holds the last batch of the stream, so a batch replayed
    after a failure is recognised, also once its snapshot is expired; plans stay lazy
    until the batch runs.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_batch(session.table(table), batch, stream_id, number)
        for v in refresh:
            session.refresh(v)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
