"""Near copies by exact Jaccard similarity of word shingles, found through SimHash tiles.

A set carries a sketch: one bit for each hash class, turned once by every shingle of the
class.  Two sketches differ in no more bits than the sets differ in shingles, so that most
candidates that are not similar go at once, without a loss, before they leave their tile:
a large group of texts that are close in SimHash but not similar emits no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_batches, materialize, shuffle_partitions
from .graph import connected_components
from .simhash import _STRIP, SEED, TILE, keep_rows, tile_pairs

#: Words of a shingle; similarity 0.8 as 9 * common >= 4 * (sizes of both sets).
WORDS, RADIUS, KEYS = 5, 14, 16
#: Bits of a sketch: twice the size of the set, as a power of two within these.
LEAST_BITS, MOST_BITS = 256, 1 << 14
_ODD = np.random.default_rng(SEED).integers(0, 2**63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NODE = "sid long, fp long, size long, sketch binary, keys array<long>"


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles; a shorter text is one shingle."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    cuts = zip(*(tokens[k:] for k in range(words))) if len(tokens) >= words else [tokens]
    return np.array(sorted({digest(join(s), SEED) for s in cuts}), np.uint64)


def _set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _simhash(found: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        part = found[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def sketch(found: np.ndarray) -> np.ndarray:
    """Bytes of the sketch of a set."""
    bits = min(max(LEAST_BITS, 1 << int(2 * len(found)).bit_length()), MOST_BITS)
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) of `size` bytes, which larger ones become by turning halves together."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches, row by row: never more than the sets differ in shingles."""
    size = min(a.shape[1], b.shape[1])
    either = np.ascontiguousarray(_folded(a, size) ^ _folded(b, size)).view(np.uint64)
    return np.bitwise_count(either).sum(axis=1, dtype=np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, tk, text): id, tk, set id, fingerprint, size, sketch, and minima that similar sets share."""
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            found = shingles(text)
            keys = [int((found * a).min().view(np.int64)) ^ k for k, a in enumerate(_ODD)] if len(found) else []
            rows.append((_set_id(found), _simhash(found), len(found), sketch(found).tobytes(), keys))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)]], ["id", "tk", "sid", "fp", "size", "sketch", "keys"])


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, sid) in order: pairs of sets that follow each other under one key."""
    last = np.zeros((0, 2), np.int64)
    for batch in batches:
        rows = np.concatenate([last, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]], axis=1)])
        same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] != rows[:-1, 1])
        yield _pairs(rows[:-1, 1][same], rows[1:, 1][same])
        last = rows[-1:]


def _cut_tiles(size: int):
    """Rows (band, fp, sid, label, size, sketch), sorted by band and size, into tiles of one
    band with sketches of one length: `size` rows, fewer where sketches are long."""
    names = ["band", "tid", "lo", "hi", "sets", "sketches"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial, held, sketches = TaskContext.get().partitionId() << 32, 0, np.zeros((0, 5), np.int64), []

        def tile(n: int) -> pa.RecordBatch:
            nonlocal serial, held, sketches
            block, own = held[:n], b"".join(sketches[:n])
            held, sketches = held[n:], sketches[n:]
            serial += 1
            row = int(block[0, 0]), base + serial, int(block[:, 4].min()), int(block[:, 4].max()), np.ascontiguousarray(block[:, 1:].T).tobytes(), own
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            while len(held):
                alike = (held[:, 0] == held[0, 0]) & (np.fromiter(map(len, sketches), np.int64, len(sketches)) == len(sketches[0]))
                same = len(held) if alike.all() else int(alike.argmin())
                most = max(64, min(size, (size * LEAST_BITS // 2) // len(sketches[0])))
                if same < most and same == len(held) and not last:
                    return
                yield tile(min(same, most))

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:5]], axis=1)])
            sketches += batch.column(5).to_pylist()
            yield from ready(False)
        yield from ready(True)

    return run


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, left_sketches, right_sketches in zip(*batch.columns):
                x, y = (np.frombuffer(b.as_buffer(), np.int64).reshape(4, -1) for b in (left, right))
                s, t = (np.frombuffer(b.as_buffer(), np.uint8).reshape(n, -1) for b, n in ((left_sketches, x.shape[1]), (right_sketches, y.shape[1])))
                us, vs = [], []
                for at in range(0, x.shape[1], _STRIP):
                    strip = x[:, at : at + _STRIP]
                    i, j = np.nonzero(np.bitwise_count(strip[0].view(np.uint64)[:, None] ^ y[0].view(np.uint64)[None, :]) <= radius)
                    a, b = strip[3][i], y[3][j]
                    fit = (strip[2][i] != y[2][j]) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
                    i, j, both = i[fit], j[fit], (a + b)[fit]
                    for k in range(0, len(i), 4096):
                        some = slice(k, k + 4096)
                        near = 9 * _apart(s[at + i[some]], t[j[some]]) <= both[some]
                        us.append(strip[1][i[some][near]])
                        vs.append(y[1][j[some][near]])
                if us and len(u := np.concatenate(us)):
                    yield _pairs(u, np.concatenate(vs))

    return run


def _near_pairs(labelled: DataFrame, radius: int, tile: int) -> DataFrame:
    """Pairs of sets of different labels within `radius` bits whose sizes allow similarity 0.8.

    Sets are banded by size so that a ratio of 1.25 leads to the next band at most; a
    tile meets only tiles of its own and the next band whose range of sizes fits.
    """
    spark = labelled.sparkSession
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.log(F.lit(1.26))).cast("int")
    rows = labelled.select(band.alias("band"), "fp", "sid", "label", "size", "sketch")
    parts = max(2, shuffle_partitions(spark) // 4)
    cut = rows.repartitionByRange(parts, "band", "size", "sid").sortWithinPartitions("band", "size")
    tiles = materialize(cut.mapInArrow(_cut_tiles(tile), "band int, tid long, lo long, hi long, sets binary, sketches binary"), "size-tiles")
    # Bands grow with the logarithm of the longest text.
    per_band = {r["band"]: r["n"] for r in tiles.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_band:
        return spark.createDataFrame([], "u long, v long")
    lanes = F.create_map(*[F.lit(x) for b in range(-1, max(per_band) + 1) for x in (b, max(1, -(-per_band.get(b, 1) // 2)))])
    left = tiles.select("*", F.col("band").alias("key")).withColumn("lane", F.pmod(F.xxhash64("tid"), F.element_at(lanes, F.col("key"))).cast("int"))
    right = tiles.select("*", F.explode(F.sequence(F.col("band") - 1, F.col("band"))).alias("key"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.element_at(lanes, F.col("key")) - 1)).alias("lane"))
    left, right = left.drop("sets", "sketches").alias("l"), right.drop("sets", "sketches").alias("r")
    once = (F.col("r.band") > F.col("l.band")) | (F.col("r.tid") >= F.col("l.tid"))
    fits = (5 * F.col("l.hi") >= 4 * F.col("r.lo")) & (5 * F.col("r.hi") >= 4 * F.col("l.lo"))
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.lane") == F.col("r.lane")) & once & fits)
    pairs = met.select(F.col("l.tid").alias("a"), F.col("r.tid").alias("b"))
    return tile_pairs(tiles, pairs, "sets", "sketches").mapInArrow(_compare(radius), "u long, v long")


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that the sketches allow."""
    for batch in batches:
        sketches = zip(*(([np.frombuffer(b.as_buffer(), np.uint8)[None, :] for b in batch.column(k)]) for k in (2, 3)))
        fit = [9 * int(_apart(a, b)[0]) <= both for (a, b), both in zip(sketches, batch.column(4).to_pylist())]
        yield batch.filter(pa.array(fit, pa.bool_())).select(["u", "v"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fit = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            fit.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
        yield batch.filter(pa.array(fit, pa.bool_())).select(["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["sid", "set"])


def _allowed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of sets that sizes and sketches allow."""
    u, v = (nodes.select(F.col("sid").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
    sized = pairs.distinct().join(u, "u").join(v, "v").where(5 * F.least("size_u", "size_v") >= 4 * F.greatest("size_u", "size_v"))
    return sized.select("u", "v", "sketch_u", "sketch_v", (F.col("size_u") + F.col("size_v")).alias("both")).mapInArrow(_bounded, "u long, v long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of sets with Jaccard similarity 0.8 or more, by their whole sets, which are
    made again from their texts."""
    fit = materialize(pairs.distinct(), "allowed-pairs")
    wanted = fit.select(F.col("u").alias("sid")).unionByName(fit.select(F.col("v").alias("sid"))).distinct()
    chosen = texts.join(wanted.join(nodes.select("sid", "tk"), "sid"), "tk").dropDuplicates(["sid"]).select("sid", "text")
    sets = materialize(chosen.mapInArrow(_sets, "sid long, set binary"), "shingle-sets")
    a, b = (sets.select(F.col("sid").alias(c), F.col("set").alias(f"set_{c}")) for c in "uv")
    return fit.join(a, "u").join(b, "v").select("u", "v", "set_u", "set_v").mapInArrow(_exact, "u long, v long")


def near_copy_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per distinct shingle set: sid, first (smallest id and text hash that have it), root (of its component).

    Sets with a Jaccard similarity of 0.8 or more are linked.  Candidates are pairs of
    fingerprints within `radius` bits, all of which are compared, and neighbours under
    shared minima; the latter are linked first, so that large groups of near copies do
    not come back as pairs.  A candidate becomes a link only by its whole sets.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(_describe, f"id {kind}, tk long, {_NODE}")
    nodes = rows.groupBy("sid").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "tk"))).alias("first"), F.min("tk").alias("tk"), *[F.first(c).alias(c) for c in ("fp", "size", "sketch", "keys")])
    nodes = materialize(nodes, "shingle-nodes")
    texts = texts.drop("id")
    after = F.element_at("keys", ((F.col("at") + 1) % KEYS + 1).cast("int"))
    keyed = nodes.select("sid", "keys", F.posexplode("keys").alias("at", "key")).select("key", "sid", after.alias("after"))
    ranged = keyed.repartitionByRange(max(2, shuffle_partitions(spark)), "key", "after", "sid").sortWithinPartitions("key", "after", "sid")
    first = materialize(_verified(_allowed(ranged.mapInArrow(_neighbours, "u long, v long"), nodes), nodes, texts), "first-links")

    def rooted(links: DataFrame) -> DataFrame:
        return nodes.join(connected_components(links).withColumnRenamed("u", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    labelled = rooted(first).select("fp", "sid", F.col("root").alias("label"), "size", "sketch")
    more = _verified(_near_pairs(labelled, radius, tile), nodes, texts)
    return rooted(first.unionByName(more)).select("sid", "first", "root")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Keep one row of each component: the one with the smallest id, then text hash.

    Defined cases: rows with a null id take part in links and stay; rows that repeat an id
    with other texts are documents of their own, of rows equal in id and text one stays;
    null and blank texts have no shingles and form one group; a text of fewer words than a
    shingle is one shingle; an empty table gives an empty table; other columns are kept.
    """
    found = near_copy_components(docs, id_col=id_col, text_col=text_col, radius=radius, tile=tile)
    keep = found.groupBy("root").agg(F.min("first").alias("key")).where("key is not null")
    return keep_rows(docs, keep, id_col, text_col)
