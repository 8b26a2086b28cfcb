"""Job events to their readers: ordered server-sent frames from an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundwell.functions.text import sse_frame


def frames(events: DataFrame) -> DataFrame:
    """(job_id, seq, frame) of events (job_id, seq, type, payload) up to and with each job's first summary or error."""
    ended = F.max(F.col("type").isin("summary", "error").cast("int")).over(Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    open_ = events.withColumn("__after", F.coalesce(ended, F.lit(0))).where("__after = 0")
    return open_.select("job_id", "seq", sse_frame(F.col("type"), F.col("payload")).alias("frame"))


def follow(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = 0.15) -> StreamingQuery:
    """Sends each batch's frames, ordered by job and event, to ``send(batch, id)``; without ``seconds`` what is there is sent and the query ends."""

    def each(batch: DataFrame, batch_id: int) -> None:
        send(frames(batch).orderBy("job_id", "seq"), batch_id)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")).start()
