"""Target-distribution importance resampling over hashed word features, head-tail vocabulary.

Features are words and pairs of neighbouring words; a feature's bucket is its CRC-32.  A
first pass finds the frequent words and pairs of all documents (mergeable summaries).  The
states of the CRC behind frequent words and the buckets of frequent pairs are computed
once and broadcast; features outside the head take their CRC directly, from the state
behind the first word where a pair's first word is in the head.  Both give the same exact
buckets, so that the head decides on time only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.training import number_rows
from ._shared import arrow_batches, materialize
from .byte_words import Lookup, Words, byte_words, mixed

#: A word or pair of this share of all is in the head for certain; the head holds at most
#: 2 / HEAD_SHARE words and as many pairs (40 bytes each).
HEAD_SHARE = 1e-4
#: Beyond so many bytes a word's CRC is taken by itself.
_LONG = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_START = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _advance(state: np.ndarray, body: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC states after the bytes body[start:stop] of each row, all rows byte by byte together."""
    size = stops - starts
    # Rows that still have bytes come first; so small a key is sorted by its digits.
    order = np.argsort(_LONG + 1 - np.minimum(size, _LONG + 1).astype(np.int16), kind="stable")
    n_long = int((size > _LONG).sum())
    for k in order[:n_long]:
        state[k] = np.uint32(zlib.crc32(body[starts[k] : stops[k]].tobytes(), int(state[k] ^ _START))) ^ _START
    order = order[n_long:]
    now, at, falling = state[order], starts[order], -size[order]
    for place in range(-int(falling[0]) if len(falling) else 0):
        live = int(np.searchsorted(falling, -place, side="left"))
        now[:live] = _step(now[:live], body[at[:live] + place])
    state[order] = now
    return state


class _Summary:
    """Frequent keys of a stream by Misra and Gries: at most twice `most` keys are held, and a
    count falls short by 1 / most of the stream at most, also when summaries are added up."""

    def __init__(self, lanes: int, most: int):
        self.keys, self.hashes, self.counts, self.most = np.zeros((0, lanes), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), most

    def add(self, hashes: np.ndarray, lanes: Callable[[np.ndarray], np.ndarray]) -> None:
        """Count the keys with these hashes; `lanes` gives the keys at some places."""
        seen, at, times = np.unique(hashes, return_index=True, return_counts=True)
        both = np.concatenate([self.hashes, seen])
        hashes, first, place = np.unique(both, return_index=True, return_inverse=True)
        counts = np.bincount(place, np.concatenate([self.counts, times]), len(hashes)).astype(np.int64)
        keep = np.ones(len(hashes), bool)
        if len(hashes) > 2 * self.most:
            counts -= np.partition(counts, len(counts) - self.most - 1)[len(counts) - self.most - 1]
            keep = counts > 0
        old, first = len(self.hashes), first[keep]
        keys = np.zeros((len(first), self.keys.shape[1]), np.uint64)
        keys[first < old] = self.keys[first[first < old]]
        keys[first >= old] = lanes(at[first[first >= old] - old])
        self.keys, self.hashes, self.counts = keys, hashes[keep], counts[keep]


_SUMMARY = "kind int, a long, b long, c long, d long, n long"


def _frequent(most: int):
    """Of (text): the words (kind 1) and pairs (kind 2) of a task's summaries, and its words (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, total = _Summary(2, most), _Summary(4, most), 0
        for batch in batches:
            found = byte_words(batch.column(0))
            first, second, short = found.lanes()
            hashes, lanes = mixed(first, second), np.stack([first, second], axis=1)
            total += len(hashes)
            own = np.flatnonzero(short)
            words.add(hashes[own], lambda at: lanes[own[at]])
            left = np.flatnonzero(short[:-1] & short[1:] & (found.rows[:-1] == found.rows[1:]))
            pairs.add(mixed(hashes[left], hashes[left + 1]), lambda at: np.concatenate([lanes[left[at]], lanes[left[at] + 1]], axis=1))
        for kind, held in ((1, words), (2, pairs)):
            keys = np.zeros((len(held.keys), 4), np.uint64)
            keys[:, : held.keys.shape[1]] = held.keys
            yield _batch(np.full(len(keys), kind), keys, held.counts)
        yield _batch(np.zeros(1, int), np.zeros((1, 4), np.uint64), np.array([total]))

    return run


def _batch(kind: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [kind.astype(np.int32), *np.ascontiguousarray(keys.T).view(np.int64), n.astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "a", "b", "c", "d", "n"])


@dataclass
class Head:
    """Frequent words with the CRC states behind them and behind a following space, and
    frequent pairs with their buckets."""

    words: Lookup
    states: np.ndarray
    spaced: np.ndarray
    pairs: Lookup
    pair_buckets: np.ndarray
    n_buckets: int

    @classmethod
    def of(cls, words: np.ndarray, pairs: np.ndarray, n_buckets: int) -> Head:
        """From the lanes of words (rows of 2) and pairs (rows of 4)."""
        words = np.unique(np.concatenate([words, pairs[:, :2], pairs[:, 2:]]), axis=0)
        known = Lookup(words[:, 0], words[:, 1])
        body = np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(-1, 16)
        stops = np.arange(len(words)) * 16 + (body != 0).sum(axis=1)
        starts = np.arange(len(words)) * 16
        states = _advance(np.full(len(words), _START), body.reshape(-1), starts, stops)
        spaced = _step(states, 32)
        left, right = known.find(pairs[:, 0], pairs[:, 1]), known.find(pairs[:, 2], pairs[:, 3])
        ends = _advance(spaced[left], body.reshape(-1), starts[right], stops[right])
        codes = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        return cls(known, states, spaced, Lookup(codes, np.zeros_like(codes)), _bucket(ends, n_buckets), n_buckets)

    def features(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of every word and every pair of neighbours in a row."""
        first, second, short = found.lanes()
        place = np.where(short, self.words.find(first, second), -1)
        states, spaced = np.full(len(place), _START), np.zeros(len(place), np.uint32)
        known = place >= 0
        states[known], spaced[known] = self.states[place[known]], self.spaced[place[known]]
        tail = np.flatnonzero(~known)
        states[tail] = _advance(states[tail], found.body, found.starts[tail], found.stops[tail])
        spaced[tail] = _step(states[tail], 32)
        left = np.flatnonzero(found.rows[:-1] == found.rows[1:])
        both = known[left] & known[left + 1]
        codes = place[left[both]].astype(np.uint64) << np.uint64(32) | place[left[both] + 1].astype(np.uint64)
        pair = np.full(len(left), -1, np.int64)
        pair[both] = self.pairs.find(codes, np.zeros_like(codes))
        buckets = np.zeros(len(left), np.int64)
        buckets[pair >= 0] = self.pair_buckets[pair[pair >= 0]]
        rest = np.flatnonzero(pair < 0)
        after = left[rest] + 1
        buckets[rest] = _bucket(_advance(spaced[left[rest]], found.body, found.starts[after], found.stops[after]), self.n_buckets)
        return np.concatenate([found.rows, found.rows[left]]), np.concatenate([_bucket(states, self.n_buckets), buckets])


def _bucket(states: np.ndarray, n_buckets: int) -> np.ndarray:
    return (states ^ _START).astype(np.int64) % n_buckets


def frequent_head(texts: DataFrame, n_buckets: int, share: float = HEAD_SHARE) -> Head:
    """The head of a table of one text column, whose size is bounded by `share` alone."""
    most = int(np.ceil(2 / share))
    sums = texts.mapInArrow(_frequent(most), _SUMMARY).groupBy("kind", "a", "b", "c", "d").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "frequent-features")
    total = sums.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    # No more than 2 / share words and pairs have so many occurrences.
    rows = sums.where((F.col("kind") > 0) & (F.col("n") >= max(1.0, share / 2 * total))).collect()
    lanes = lambda kind, n: np.array([[r[c] for c in "abcd"[:n]] for r in rows if r["kind"] == kind], np.int64).reshape(-1, n).view(np.uint64)
    return Head.of(lanes(1, 2), lanes(2, 4), n_buckets)


def bucket_totals(texts: DataFrame, head) -> DataFrame:
    """(bucket, n): exact number of features in each bucket that occurs; `head` is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(head.value.n_buckets, np.int64)
        for batch in batches:
            counts += np.bincount(head.value.features(byte_words(batch.column(0)))[1], minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(source: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """Gain of each bucket, a constant number of rows."""
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for totals, side in ((source, s), (target, t)):
        for row in totals.collect():
            side[row["bucket"]] = row["n"]
    ratios = ((t + 1) * (s.sum() + n_buckets)) / ((s + 1) * (t.sum() + n_buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios])


def _weigh(head, gains):
    """Of (doc_id, text): doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = byte_words(batch.column(1))
            rows, buckets = head.value.features(found)
            n = np.bincount(rows, minlength=found.n_rows)
            total = np.bincount(rows, gains.value[buckets], found.n_rows).astype(np.int64)
            columns = [np.bincount(found.rows, minlength=found.n_rows), n, total // np.maximum(n, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c.astype(np.int64)) for c in columns]], ["doc_id", "n_words", "n_features", "weight"])

    return run


def _uniform(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = 25,
    min_words: int = 20,
    n_buckets: int = 10_000,
    seed: int = 7,
    head_share: float = HEAD_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of `docs`.

    Documents are drawn without replacement, by importance weights towards the features of
    `target` (weights plus Gumbel noise, largest first): `percent` of those with `min_words`
    or more get a rank from 1.
    Defined cases: null and empty texts have no features, weight 0 and no rank; rows that
    repeat an id share its noise and are ranked each, in any order where all else is equal;
    null ids share the noise of an empty id and come last among equal scores; very long
    texts are taken whole; an empty `docs` gives an empty table, and with an empty `target`
    the gains follow the smoothed formula; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts, wanted = rows.select("text"), target.select(F.col(target_col).alias("text"))
    head = spark.sparkContext.broadcast(frequent_head(texts, n_buckets, head_share))
    gains = spark.sparkContext.broadcast(_gains(bucket_totals(texts, head), bucket_totals(wanted, head), n_buckets))
    kind = docs.schema[id_col].dataType.simpleString()
    weights = rows.mapInArrow(_weigh(head, gains), f"doc_id {kind}, n_words long, n_features long, weight long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(_uniform(F.col("doc_id"), seed))))
    scored = weights.withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()})
    scored = materialize(scored.withColumns({"falling": -F.col("score"), "no_id": F.col("doc_id").isNull()}), "importance-scores")
    long_enough = scored.where(F.col("n_words") >= min_words)
    drawn = long_enough.count() * percent // 100
    ranked = number_rows(long_enough, "falling", "no_id", "doc_id", "row", name="place")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*names, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).select(*names, F.lit(None).cast("long").alias("rank")))
