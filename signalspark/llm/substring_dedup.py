"""Removal of word passages that an earlier document holds, by difference-cover anchors.

A difference cover D modulo v has, for any two positions i and j, a shift below v that
brings both onto the cover.  With v = 7 and D = {0, 1, 3}, two equal windows of 13
words therefore share an anchor of 7 words that starts at a cover position of either
document.  So 3 of 7 positions are hashed and exchanged instead of all, and only
windows around an anchor that two documents share are compared as windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_batches, shuffle_partitions

#: Difference covers by period: every difference modulo the period occurs.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18)}
#: Hashes that a task holds before it sends them on.
HELD = 1_000_000
#: Anchors of a bucket: their number grows with the text, so that a bucket does not.
BUCKET_ANCHORS = 500_000
#: Buckets that one task resolves on average.
TASK_BUCKETS = 4
#: Bytes of text to a word, by which words are estimated.
WORD_BYTES = 6


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class _Text:
    """Words of a text, joined by one space, with the byte offsets of each."""

    def __init__(self, text: str | None):
        self.words = _words(text)
        self.body = b" ".join(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.stops = np.cumsum(sizes + 1) - 1
        self.starts = self.stops - sizes

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hash of the `length` words from each position of `at`."""
        body, digest = self.body, xxhash.xxh64_intdigest
        spans = zip(self.starts[at].tolist(), self.stops[at + length - 1].tolist())
        return np.fromiter((digest(body[a:b]) for a, b in spans), np.uint64, len(at))


def _cover_positions(n_words: int, period: int, anchor: int) -> np.ndarray:
    on = np.zeros(period, bool)
    on[list(COVERS[period])] = True
    n = max(0, n_words - anchor + 1)
    return np.flatnonzero(np.tile(on, n // period + 1)[:n])


class _Outbox:
    """Hashes of a task's documents on their way to the shuffle.

    Each hash goes to its bucket once per flush, with the smallest id among the task's
    documents that hold it; what the task can tell by itself (a smaller document of the
    task holds the hash) goes out under a negative bucket and needs no partner.  A hash
    that a third of all documents hold thus reaches its bucket once per flush at most.
    """

    def __init__(self, buckets: int, both: bool, held: int):
        self.buckets, self.both, self.held = buckets, both, held
        self.kept = _narrow if both else (lambda hashes: hashes)
        self.ids: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = self.serial = 0

    def add(self, doc_id: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.ids.append(doc_id)
        self.parts.append(np.unique(hashes))
        self.size += len(self.parts[-1])
        if self.size > self.held:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            hashes = np.concatenate(self.parts)
            docs = np.repeat(np.array(self.ids, np.int64), [len(p) for p in self.parts])
            order = np.lexsort((docs, hashes))
            hashes, docs = hashes[order], docs[order]
            first = np.r_[True, hashes[1:] != hashes[:-1]]
            least = docs[np.flatnonzero(first)][np.cumsum(first) - 1]
            known = docs > least
            if self.both:  # the holder of the smallest id is also told
                shared = np.zeros(first.sum(), bool)
                shared[(np.cumsum(first) - 1)[known]] = True
                told = known | (first & shared[np.cumsum(first) - 1])
            else:
                told = known
            yield from self._rows(self.kept(hashes[told]), docs[told], -1 - (docs[told] % self.buckets))
            # A shared hash still goes to its bucket, for the other tasks' sake.
            yield from self._rows(self.kept(hashes[first]), docs[first], (hashes[first] % np.uint64(self.buckets)).astype(np.int64))
        self.ids, self.parts, self.size = [], [], 0

    @staticmethod
    def _rows(hashes: np.ndarray, docs: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        for key, blob in _blobs(docs, hashes, bucket):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "entries"])


def _narrow(hashes: np.ndarray) -> np.ndarray:
    """The upper half of anchor hashes: among the anchors of one bucket, whose number does not
    grow with the data, one in some thousands looks shared by chance, and exact windows follow."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def pack_entries(ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> bytes:
    return np.int64(len(ids)).tobytes() + ids.astype(np.int64).tobytes() + counts.astype(np.int32).tobytes() + hashes.tobytes()


def unpack_entries(blob: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(doc ids, hashes), one of each per entry."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    ids = np.frombuffer(blob, np.int64, n, 8)
    counts = np.frombuffer(blob, np.int32, n, 8 + 8 * n)
    return np.repeat(ids, counts), np.frombuffer(blob, kind, -1, 8 + 12 * n)


def _blobs(docs: np.ndarray, hashes: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, packed entries) for each key."""
    order = np.lexsort((docs, keys))
    docs, hashes, keys = docs[order], hashes[order], keys[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        ids, counts = np.unique(docs[a:b], return_counts=True)
        yield int(keys[a]), pack_entries(ids, counts, hashes[a:b])


def _entries(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = zip(*(unpack_entries(b.as_buffer(), kind) for b in table.column("entries")))
    return np.concatenate(docs), np.concatenate(hashes)


def _resolve(both: bool, buckets: int):
    """Per bucket: which documents share their hashes with a (smaller) document, packed
    by the document's own bucket."""

    def run(table: pa.Table) -> pa.Table:
        docs, hashes = _entries(table, np.uint32 if both else np.uint64)
        if table.column("bucket")[0].as_py() >= 0:
            order = np.lexsort((docs, hashes))
            docs, hashes = docs[order], hashes[order]
            first = np.r_[True, hashes[1:] != hashes[:-1]]
            group = np.cumsum(first) - 1
            found = docs > docs[np.flatnonzero(first)][group]
            if both:
                shared = np.zeros(int(first.sum()), bool)
                shared[group[found]] = True
                found = shared[group]
            docs, hashes = docs[found], hashes[found]
        rows = list(_blobs(docs, hashes, docs % buckets))
        return pa.table({"home": pa.array([k for k, _ in rows], pa.int32()), "entries": pa.array([b for _, b in rows], pa.binary())})

    return run


def _gather(both: bool):
    """Per home bucket: one row for each document, with all of its hashes."""

    def run(table: pa.Table) -> pa.Table:
        docs, hashes = _entries(table, np.uint32 if both else np.uint64)
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
        cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        blobs = [hashes[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(docs)])]
        return pa.table({"doc_id": pa.array(docs[cuts], pa.int64()), "hashes": pa.array(blobs, pa.binary())})

    return run


def _shared(hashed: DataFrame, both: bool, buckets: int) -> DataFrame:
    """doc_id and its hashes that another (with both) or a smaller document holds."""
    # Tasks by the number of buckets, whatever the session's shuffle partitions are.
    n = max(shuffle_partitions(hashed.sparkSession), buckets // TASK_BUCKETS)
    found = hashed.repartition(n, "bucket").groupBy("bucket").applyInArrow(_resolve(both, buckets), "home int, entries binary")
    return found.repartition(n, "home").groupBy("home").applyInArrow(_gather(both), "doc_id long, hashes binary")


def _hash_set(blob: bytes | None, kind: type = np.uint64) -> np.ndarray:
    return np.unique(np.frombuffer(blob, kind)) if blob else np.zeros(0, kind)


def _isin(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes


def _candidate_windows(text: _Text, known: np.ndarray, window: int, period: int) -> np.ndarray:
    """Starts of the windows that hold an anchor known to be shared."""
    anchor, n = window - period + 1, len(text.words)
    at = _cover_positions(n, period, anchor)
    at = at[_isin(_narrow(text.hashes(at, anchor)), known)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(at - (period - 1), 0), 1)
    np.add.at(edge, np.minimum(at, n - window) + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, n - window + 1)] > 0)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, period: int = 7, held: int = HELD) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts in a
    document with a smaller id.  Returns doc_id, text (kept words joined by one space),
    n_words, n_removed for every row.

    Windows are compared by 64-bit hashes of their text.  Defined cases: a null or blank
    text has no words; texts shorter than the window lose nothing; rows with a null id
    neither lose words nor cause a loss; rows that repeat an id are no smaller than one
    another, so that they keep what only they share; an empty table gives an empty
    table; other columns are ignored.
    """
    if not (period in COVERS and period < window):
        raise ValueError(f"no difference cover of period {period} for windows of {window}")
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    anchor = window - period + 1
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, shuffle_partitions(spark), -(-size * len(COVERS[period]) // (period * WORD_BYTES * BUCKET_ANCHORS)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(buckets, both=True, held=held)
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = _Text(raw)
                if len(text.words) >= window:
                    yield from box.add(doc_id, text.hashes(_cover_positions(len(text.words), period, anchor), anchor))
        yield from box.flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(buckets, both=False, held=held)
        for batch in batches:
            for doc_id, raw, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if not blob:
                    continue
                text = _Text(raw)
                at = _candidate_windows(text, _hash_set(blob, np.uint32), window, period)
                if len(at):
                    yield from box.add(doc_id, text.hashes(at, window))
        yield from box.flush()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for raw, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known, words = _hash_set(blob), _words(raw)
                gone = np.zeros(len(words), bool)
                if len(known):
                    text = _Text(raw)
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.arange(len(words) - window + 1)
                    at = at[_isin(text.hashes(at, window), known)]
                    edge[at] += 1
                    edge[at + window] -= 1
                    gone = np.cumsum(edge)[: len(words)] > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept.append(b" ".join(words).decode())
                n_words.append(len(gone))
                n_removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    entries = "bucket int, entries binary"
    shared = _shared(texts.where("doc_id is not null").mapInArrow(anchors, entries), True, buckets)
    # Both joins have `texts` on the left, so that its exchange is made once and reused.
    holders = texts.join(shared.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "hashes")
    candidates = holders.mapInArrow(windows, entries)
    earlier = _shared(candidates, False, buckets)
    joined = texts.join(earlier.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "hashes")
    return joined.mapInArrow(strip, "doc_id long, text string, n_words long, n_removed long")
