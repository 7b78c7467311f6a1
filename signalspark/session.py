"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "signalspark", *, master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and the RocksDB state store.

    Without a master the one of the environment (spark-submit) or all local cores is used.
    """
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
