"""Near-duplicate documents by SimHash fingerprints and exact tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_batches, materialize, shuffle_partitions
from .graph import connected_components

SEED = 42
#: Fingerprints in a tile: 16 KB, so that a strip of a tile pair stays in the cache.
TILE = 2048
_STRIP = 64
_SHINGLES = 65536


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the lower-cased word shingles; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    ones, n = np.zeros(64, np.int64), len(tokens) - words + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _SHINGLES):
        part = tokens[at : at + _SHINGLES + words - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*(part[k:] for k in range(words)))], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) for every row of `docs`; fp holds the 64 bits as a signed long."""
    arrow_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(scan, f"id {kind}, fp long")


TILE_NAMES = ["pc", "tid", *[f"lo{k}" for k in range(1, 5)], *[f"hi{k}" for k in range(1, 5)], "fps"]
_TILE_SCHEMA = "pc int, tid long, " + ", ".join(f"{n} int" for n in TILE_NAMES[2:10]) + ", fps binary"


def _cut_tiles(size: int):
    """Rows (pc, q1..q4, fp), sorted by these, into tiles of one population count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial, held = TaskContext.get().partitionId() << 32, 0, None

        def tile(block: np.ndarray) -> pa.RecordBatch:
            nonlocal serial
            low, high = block[:, 1:5].min(axis=0), block[:, 1:5].max(axis=0)
            columns = [[int(block[0, 0])], [base + serial], *[[int(x)] for x in low], *[[int(x)] for x in high], [block[:, 5].tobytes()]]
            serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), *[pa.int32()] * 8, pa.binary()])], TILE_NAMES)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            held = rows if held is None else np.concatenate([held, rows])
            while len(held):
                same = int(np.searchsorted(held[:, 0], held[0, 0], side="right"))
                if same < size and same == len(held):
                    break
                yield tile(held[: min(same, size)])
                held = held[min(same, size) :]
        if held is not None and len(held):
            yield tile(held)

    return run


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (u, v) as a spanning star for each component: (node, smallest node)."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(pa_, pb)[apart], np.minimum(pa_, pb)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _links(radius: int, flush: int = 500_000):
    """Compare tile pairs; a task sends a spanning forest of the links it has found."""

    def near(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(x), _STRIP):
            strip = x[at : at + _STRIP]
            i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ y[None, :]) <= radius)
            if len(i):
                yield strip[i], y[j]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, size = [], [], 0

        def out() -> tuple[np.ndarray, np.ndarray]:
            return _forest(np.concatenate(us), np.concatenate(vs))

        def batch_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = (np.frombuffer(b.as_buffer(), np.uint64) for b in (left, right))
                for u, v in near(x, y):
                    apart = u != v
                    if apart.any():
                        us.append(u[apart])
                        vs.append(v[apart])
                        size += len(us[-1])
                    if size > flush:
                        u, v = out()
                        if len(u) > flush // 2:
                            yield batch_of(u, v)
                            us, vs, size = [], [], 0
                        else:
                            us, vs, size = [u], [v], len(u)
        if us:
            yield batch_of(*out())

    return compare


def linked_fingerprints(distinct: DataFrame, *, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) within `radius` bits.

    Each population count is cut into tiles of `tile`; a tile meets only tiles whose
    count differs by the radius at most, and whose ranges of the counts of the four
    16-bit quarters are no farther apart in sum (a Hamming distance is never less).
    The links come as spanning forests of what each task saw: no connection is lost,
    and a group of n near copies yields about n links per task instead of n * n / 2.
    """
    spark = distinct.sparkSession
    arrow_batches(spark)
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    counted = distinct.select(F.bit_count("fp").alias("pc"), *[q.alias(f"q{k + 1}") for k, q in enumerate(quarter)], "fp")
    order = ["pc", "q1", "q2", "q3", "q4"]
    parts = max(2, shuffle_partitions(spark) // 4)
    tiles = materialize(counted.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_cut_tiles(tile), _TILE_SCHEMA), "tiles")
    # At most 65 rows: tiles for each population count.
    per_count = {r["pc"]: r["n"] for r in tiles.groupBy("pc").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_count:
        return spark.createDataFrame([], "u long, v long")
    lanes = F.create_map(*[F.lit(x) for pc in range(65) for x in (pc, max(1, -(-per_count.get(pc, 1) // 2)))])
    left = tiles.select("*", F.col("pc").alias("key")).withColumn("lane", F.pmod(F.xxhash64("tid"), F.element_at(lanes, F.col("key"))).cast("int"))
    right = tiles.select("*", F.explode(F.sequence(F.greatest(F.col("pc") - radius, F.lit(0)), F.col("pc"))).alias("key"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.element_at(lanes, F.col("key")) - 1)).alias("lane"))
    left, right = left.drop("fps").alias("l"), right.drop("fps").alias("r")
    apart = sum(
        (F.greatest(F.col(f"l.lo{k}") - F.col(f"r.hi{k}"), F.col(f"r.lo{k}") - F.col(f"l.hi{k}"), F.lit(0)) for k in range(1, 5)),
        F.lit(0),
    )
    once = (F.col("r.pc") > F.col("l.pc")) | (F.col("r.tid") >= F.col("l.tid"))
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.lane") == F.col("r.lane")) & once & (apart <= radius))
    pairs = met.select(F.col("l.tid").alias("a"), F.col("r.tid").alias("b"))
    return tile_pairs(tiles, pairs, "fps").mapInArrow(_links(radius), "u long, v long")


#: Tile pairs that a task compares at most on average.
TASK_PAIRS = 512


def tile_pairs(tiles: DataFrame, pairs: DataFrame, *payloads: str) -> DataFrame:
    """The payloads (each of the left and of the right) of the tiles of `pairs` (a, b), which were chosen without them.

    A left tile crosses the shuffle once, a right one once for each pair that was left.
    The comparison takes long for few bytes, so that its tasks are counted in pairs.
    """
    spark = tiles.sparkSession
    pairs = materialize(pairs, "tile-pairs")
    n = max(2 * shuffle_partitions(spark), spark.sparkContext.defaultParallelism * 3, -(-pairs.count() // TASK_PAIRS))
    side = lambda key: tiles.select(F.col("tid").alias(key), *[F.col(p).alias(f"{key}_{p}") for p in payloads])
    met = pairs.join(side("b"), "b").repartition(n, "a").join(side("a"), "a")
    return met.select(*[f"{key}_{p}" for p in payloads for key in "ab"])


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of `docs`: id, fp (signed long), component_id.

    component_id is the smallest id reachable by links of fingerprints that differ in
    `radius` bits or fewer, a row's own id included.  Defined cases: a null or blank
    text has fingerprint 0 and is linked like any other; a null id takes part in links
    and gets the smallest id of its component (null if there is none); repeated rows
    each get a row; an empty table gives an empty table.
    """
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    roots = connected_components(linked_fingerprints(distinct.select("fp"), radius=radius))
    member = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "members")
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = member.join(smallest, "root").select("fp", "component_id")
    return rows.join(label, "fp").select("id", "fp", "component_id")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """Keep one row of each component: the one with the smallest id, then text hash.

    Defined cases: rows with a null id take part in links and stay; rows that repeat an id
    with other texts are documents of their own, of rows equal in id and text one stays; a
    null or blank text has fingerprint 0; an empty table gives an empty table.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("__key"), F.col(f"`{text_col}`").alias("__text"))
    found = simhash_components(keyed, id_col="__key", text_col="__text", words=words, radius=radius)
    return keep_rows(docs, found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("key")), id_col, text_col)


def row_key(id_col: str, text_col: str) -> Column:
    """(id, hash of the text), null for a null id."""
    return F.when(F.col(f"`{id_col}`").isNotNull(), F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("tk")))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` whose row_key is among `kept` (key), one of each, and those without an id."""
    named = docs.where(F.col(f"`{id_col}`").isNotNull()).withColumn("__row_key", row_key(id_col, text_col))
    named = named.join(kept.select(F.col("key").alias("__row_key")).distinct(), "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
