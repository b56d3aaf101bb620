"""Queries of the streaming extension: the events table, arriving in files of ranges of its ids, in any order of files (so that the watermark has to be wide)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.operators import sweep
from siltstone.plans.store import shared, stage
from siltstone.streaming import ingest


def arrivals(spark, sf_dir):
    """A stream of events from the files of a stage table; ts is an instant whose UTC wall clock is the event's, so that windows are whole days."""
    held = stage(spark, sf_dir, "event-files", lambda s, d: sweep.read(s, d, "events").select("event_id", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"), "user_id", "event_type", "value").repartitionByRange(4, "event_id"))
    folder = held.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).first()
    return ingest.arriving(spark, folder[0]) if folder else held


def fresh(spark, name):
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


QUERIES = {
    "s01_stream_upserts": lambda s, d: ingest.upserted(arrivals(s, d), fresh(s, "upserts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id"),
    "s02_stream_windows": lambda s, d: ingest.windowed(arrivals(s, d), fresh(s, "windows"), "ts", ["event_type"], late="400 days").select(F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd").alias("day"), "event_type", "n"),
}
SQL = {
    "s01_stream_upserts": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "s02_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
