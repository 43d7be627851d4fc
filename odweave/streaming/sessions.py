"""Sessions of a stream: state is kept for open ones only, and rows that come too late are left out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_sessions(events: DataFrame, by: Sequence[str], time: str, gap: str, late: str, aggregates: Mapping[str, Column]) -> DataFrame:
    """(by, start, end, aggregates) of each session, once no row can join it any more; end is its last row's time.

    A row at most a gap after a session's last joins it. Sessions are given out when the watermark, the latest time
    less ``late``, is past their end and the gap. Of a batch all sessions are given.
    """
    own = events.filter(F.col(time).isNotNull())
    for c in by:
        own = own.filter(F.col(c).isNotNull())
    if own.isStreaming:
        own = own.withWatermark(time, late)
    window = F.session_window(time, gap).alias("_w")
    out = own.groupBy(window, *by).agg(F.max(time).alias("end"), *[c.alias(n) for n, c in aggregates.items()])
    return out.select(*by, F.col("_w.start").alias("start"), "end", *aggregates)


def append_files(sessions: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write all sessions that what has come so far closes into Parquet files, and stop; a later call goes on from the checkpoint."""
    return sessions.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
