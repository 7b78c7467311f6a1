"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import materialize, scratch_dir

__all__ = ["ARROW_BYTES", "arrow_batches", "materialize", "scratch_dir", "shuffle_partitions"]

#: Bytes of one Arrow batch: texts, sets and tiles may be long.
ARROW_BYTES = 4 << 20


def arrow_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound the bytes of one Arrow batch for this session.

    Plans read the setting when they run, after this library has returned them, so that it
    stays set; it cuts batches and changes no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

