"""Package folders as a stream: rows that arrive are validated and de-duplicated by id within the watermark, then appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.model import KEYS, csv_schema, typed


def arriving(spark: SparkSession, table: str, folder: str, delay: str = "1 hour") -> DataFrame:
    """New rows of a table's CSV files below ``folder``, typed, the first of each id within ``delay`` of the file's time."""
    raw = spark.readStream.schema(csv_schema(table)).option("header", True).option("escape", '"').option("multiLine", True).option("recursiveFileLookup", True).csv(folder)
    seen = raw.select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    return typed(table, seen.na.fill("")).withWatermark("arrived", delay).dropDuplicatesWithinWatermark([KEYS[table]])


def append(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, once, exactly once over restarts."""
    return stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
