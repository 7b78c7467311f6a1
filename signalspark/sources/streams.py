"""Streaming sources: files, or any other format by options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_event_stream(spark: SparkSession, path: str, fmt: str = "parquet", *, schema: StructType | None = None, max_files: int | None = None, **options: str) -> DataFrame:
    """Stream of the files under `path`; a Kafka topic is the same call with fmt="kafka",
    no path and its options.  Positions are kept by the query's checkpoint.

    A single file is named by a pattern (event[s].parquet), as a plain path must be a
    folder.  Without a schema that of the files present is taken.  Times without a zone become
    timestamps, as watermarks need them.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.load()
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    schema = schema or spark.read.format(fmt).options(**options).load(path).schema
    stream = reader.schema(schema).load(path)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})
