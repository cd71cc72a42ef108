"""Row-wise operators on streams: they hold no state, so a stream takes them as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_texts(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def with_columns(stream: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return stream.withColumns(columns)


def count_by_window(stream: DataFrame, time_col: str, window: str, lateness: str, keys: list[str]) -> DataFrame:
    """Rows by tumbling window and keys; windows close when the watermark passes them."""
    return stream.withWatermark(time_col, lateness).groupBy(F.window(time_col, window), *keys).agg(F.count("*").alias("n"))


def drop_repeated(stream: DataFrame, time_col: str, lateness: str, keys: list[str]) -> DataFrame:
    """Rows with keys that weren't seen within the lateness."""
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that there is now, exactly once; then the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
