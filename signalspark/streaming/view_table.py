"""The online view as a table of small changes: a micro-batch writes what it changes.

Rows live in buckets of their key.  Each micro-batch writes its newest rows for the buckets
that it touches; a manifest, committed by rename, names the folders of every bucket, oldest
first.  A bucket of many folders is written anew as one.  Folders and manifests that the
last two manifests do not need go, so that a reader of the version before can finish.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.online import KEY
from ..sources.commits import commit_text, names_in, read_text, remove

#: Buckets of the table, and folders of a bucket above which it is compacted.
BUCKETS, FOLDERS = 32, 4
_COLUMNS = ["value", "feature_ts", "version", "write_seq"]


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", *KEY).agg(F.max_by(F.struct(*_COLUMNS), "write_seq").alias("last")).select("bucket", *KEY, "last.*")


def _write(rows: DataFrame, path: str) -> None:
    """One file for each bucket that has rows."""
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in names_in(spark, f"{path}/manifests"))


def _manifest(spark: SparkSession, path: str, version: int) -> dict[str, list[str]]:
    return json.loads(read_text(spark, f"{path}/manifests/{version:020d}"))


def _read(spark: SparkSession, path: str, folders: dict[str, list[str]]) -> DataFrame:
    paths = [f"{path}/data/{folder}/bucket={b}" for b, own in folders.items() for folder in own]
    # Each path names its bucket; folders are of one kind.
    rows = spark.read.parquet(*paths)
    key = F.xxhash64(*KEY)
    return rows.withColumn("bucket", F.pmod(key, F.lit(BUCKETS)).cast("int"))


def merge_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Put feature-log rows into the table; a batch that is repeated after its commit does nothing,
    and one repeated before it replaces its own folders."""
    spark = batch.sparkSession
    known = _versions(spark, path)
    if batch_id in known:
        return
    before = max((v for v in known if v < batch_id), default=None)
    folders = _manifest(spark, path, before) if before is not None else {}
    name = f"{batch_id:020d}"
    rows = batch.select(*KEY, *_COLUMNS).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int"))
    _write(_newest(rows), f"{path}/data/{name}")
    changed = [n.removeprefix("bucket=") for n in names_in(spark, f"{path}/data/{name}") if n.startswith("bucket=")]
    folders = {**folders, **{b: [*folders.get(b, []), name] for b in changed}}
    large = {b: own for b, own in folders.items() if len(own) > FOLDERS}
    if large:
        _write(_newest(_read(spark, path, large)), f"{path}/data/{name}c")
        folders |= {b: [f"{name}c"] for b in large}
    commit_text(spark, f"{path}/manifests/{name}", json.dumps(folders))
    _clean(spark, path)


def _clean(spark: SparkSession, path: str) -> None:
    """Remove what the last two manifests do not name."""
    known = _versions(spark, path)
    named: dict[str, set[str]] = {}
    for version in known[-2:]:
        for bucket, own in _manifest(spark, path, version).items():
            for folder in own:
                named.setdefault(folder, set()).add(bucket)
    for folder in names_in(spark, f"{path}/data"):
        if folder not in named:
            remove(spark, f"{path}/data/{folder}")
            continue
        for bucket in names_in(spark, f"{path}/data/{folder}"):
            if bucket.startswith("bucket=") and bucket.removeprefix("bucket=") not in named[folder]:
                remove(spark, f"{path}/data/{folder}/{bucket}")
    for version in known[:-2]:
        remove(spark, f"{path}/manifests/{version:020d}")


def read_view(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each key by the last manifest."""
    known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version of a view under {path}")
    folders = _manifest(spark, path, known[-1])
    if not folders:
        return spark.createDataFrame([], "entity_type string, entity_id string, feature_name string, value string, feature_ts timestamp, version long, write_seq long")
    return _newest(_read(spark, path, folders)).drop("bucket")
