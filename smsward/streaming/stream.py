"""Message streams: masking and normalising are map-only; dedupe and window counts are bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsward.operators import normalize
from smsward.operators.mask import mask
from smsward.scratch import shared_dir


def masked_stream(messages: DataFrame, text: str = "text") -> DataFrame:
    return mask(messages, text, entities=False)


def deduplicated(messages: DataFrame, ts: str = "ts", delay: str = "1 hour", keys: tuple[str, ...] = ("text",)) -> DataFrame:
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def window_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def normalized_stream(messages: DataFrame, text: str = "text") -> DataFrame:
    """Masked and normalised messages, with their tokens; map-only."""
    return normalize.normalize(mask(messages, text, entities=False))


def drained(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into a table of the shared folder, and reads it. The checkpoint lies beside it, so a
    run that is broken off goes on where it was."""
    base = f"{shared_dir(stream.sparkSession)}/smsward-stream-{what}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows").format("parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/rows")
