"""The row checks as a stream: all of them are stateless, so generations can be parsed and checked as
they arrive. Selection and terciles need whole groups and stay in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..operators.protocol import checked, parse


def generation_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """JSON lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def checked_stream(stream: DataFrame, raw: str = "raw_output", key: str | None = None, event_time: str | None = None, delay: str = "7 days", cfg: Settings = DEFAULTS) -> DataFrame:
    """Parsed and checked rows; with ``key`` and ``event_time``, redelivered rows within the delay are
    dropped under a watermark, so that the state stays bounded."""
    if key and event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return checked(parse(stream, raw), cfg.protocol, cfg.token_f1)


def start(out: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to parquet, exactly once under the checkpoint; ``once`` stops when the input is read."""
    writer = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
