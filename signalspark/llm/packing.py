"""Best-fit packing of tokenized documents into fixed-length training sequences."""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_batches, materialize

_CACHE: dict = {}
#: Words in a generation of a Python worker's cache, of which two are kept.
CACHE_WORDS = 250_000
#: Bytes of text that are tokenized at once.
CHUNK = 8 << 20
#: Texts that do not go word by word: characters beyond Latin-1, which the normalizer may
#: compose, white space that libraries see differently, and marks of special tokens.
_WHOLE = r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{9f}\x{a1}-\x{ff}]|<\|"


class _Encoder:
    """Ids of texts, by distinct words between white space where that is exact.

    A tokenizer that normalizes to lower case, cuts at white space and by one pattern, and
    merges the bytes of each cut by itself gives a text of Latin-1 characters the ids of
    its words, and a word those of its cuts.  Other texts and tokenizers go through whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.cuts = _cut_pattern(path)
        self.packed = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]
        # Words in use, and those of the generation before, which are still looked up.
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Put the ids of `words` into the cache."""
        known, older = self.words, self.older
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            self.older, self.words, new = known, {"": b""}, words
            known, older = self.words, self.older
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in known]
        cut = {w: self.cuts.findall(w) for w in new if not w.isalpha()}
        parts = {w for w in new if w.isalpha()}.union(*cut.values())
        fresh = [w for w in parts if w not in known]
        plain, other = [w for w in fresh if w.isascii() and w.isprintable()], [w for w in fresh if not (w.isascii() and w.isprintable())]
        # Letters that stand for bytes; only printable ASCII stands for itself, and not the space.
        spelled = plain + (self.spell(" ".join(other))[0][0].split(self.spell(" ")[0][0]) if other else [])
        merge, packed, join = self.tokenizer.model.tokenize, self.packed, b"".join
        known.update(zip(plain + other, [join([packed[t.id] for t in merge(s)]) for s in spelled], strict=True))
        known.update((w, join([known[c] for c in own])) for w, own in cut.items())

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by `end_id`; offsets of the texts in them)."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE) if self.cuts else pa.array(np.ones(len(texts), bool))
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", pc.utf8_lower(texts)))
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(words)
        found = [*map(self.words.__getitem__, words), np.array([end_id], "<u4").tobytes()]
        at = whole.to_numpy(zero_copy_only=False).nonzero()[0]
        found += self._whole(texts.take(pa.array(at)).to_pylist())
        # After the words of each text: its ids as a whole, if any, and the end.
        stops = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        extra = np.stack([np.full(len(texts), -1), np.full(len(texts), len(words))], axis=1)
        extra[at, 0] = len(words) + 1 + np.arange(len(at))
        given = extra >= 0
        order = np.insert(flat.indices.to_numpy(), np.repeat(stops, 2)[given.ravel()], extra[given])
        joined = pa.array(found, pa.large_binary()).take(pa.array(order))
        bounds = np.frombuffer(joined.buffers()[1], np.int64, len(order) + 1) // 4
        last = np.cumsum(np.diff(stops, prepend=0) + given.sum(axis=1))
        return np.frombuffer(joined.buffers()[2], "<u4", bounds[-1]), np.r_[0, bounds[last]]


def _cut_pattern(path: str) -> regex.Pattern | None:
    """The pattern that cuts words, if the tokenizer works word by word as _Encoder states."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [(n["type"], n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", ())]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
    same = normal == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
    if not same or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"] or spec["model"]["type"] != "BPE" or spec["model"]["dropout"]:
        return None
    return regex.compile(cuts[0]["pattern"]["Regex"])


def _encoder(path: str) -> _Encoder:
    if path not in _CACHE:
        _CACHE[path] = _Encoder(path)
    return _CACHE[path]


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches joined until they hold `size` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Tokenize every document, append `end_id`, and cut what exceeds `capacity`.

    `part` and `nth` number the pieces of each length within a task (with `keep_ids`
    the column ids holds the tokens as array<int>).
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), Counter(), _encoder(tokenizer_path)
        for chunk in _chunks(batches, CHUNK):
            ids, offsets = encoder.encode(chunk.column(1).combine_chunks(), end_id)
            rows, bounds = [], [0]
            for at, (first, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                for k in range(first, stop, capacity):
                    size = min(capacity, stop - k)
                    rows.append((at, (k - first) // capacity, k - first, size, zlib.crc32(ids[k : k + size]), part, seen[size]))
                    seen[size] += 1
                    bounds.append(k + size)
            at, *columns = zip(*rows) if rows else [()] * 7
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [chunk.column(0).combine_chunks().take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]]
            if keep_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * keep_ids])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(cut, f"doc_id {kind}, {PIECE_SCHEMA}" + ", ids array<int>" * keep_ids)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for `counts` items of each length: (number of bins, [(length, items in each)]).

    Lengths above a third of the capacity pair at most twice per bin: the longest takes
    the longest partner that fits.  Shorter ones, longest first, go to the smallest gap
    that holds them.  Bins with equal contents form one group; the groups are bounded
    by the number of lengths and not by the number of items.
    """
    left = {n: c for n, c in counts.items() if c}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    gaps: dict[int, list] = defaultdict(list)

    def close(bins: int, content: list[tuple[int, int]]) -> None:
        gaps[capacity - sum(n * m for n, m in content)].append((bins, content))

    for n in large:
        for partner in large:
            if not left[n]:
                break
            if n + partner > capacity or not left[partner]:
                continue
            bins = left[n] // 2 if partner == n else min(left[n], left[partner])
            if bins:
                close(bins, [(n, 2)] if partner == n else [(n, 1), (partner, 1)])
                left[n] -= bins * (2 if partner == n else 1)
                left[partner] -= bins if partner != n else 0
        if left[n]:
            close(left[n], [(n, 1)])
            left[n] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        items = left[n]
        while items:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                gaps[capacity].append((items, []))
                gap = capacity
            bins, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            each = min(gap // n, items)
            full = min(bins, items // each)
            rest = items - full * each if full < bins else 0
            if full:
                gaps[gap - each * n].append((full, [*content, (n, each)]))
            if rest:
                gaps[gap - rest * n].append((1, [*content, (n, rest)]))
            free = bins - full - (1 if rest else 0)
            if free and content:
                gaps[gap].append((free, content))
            items -= full * each + rest
    return [(bins, content) for groups in gaps.values() for bins, content in groups if content]


def _slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, items in each bin, first sequence, offset)."""
    used, out, sequence = Counter(), defaultdict(list), 0
    for bins, content in plan:
        offset = 0
        for n, m in content:
            out[n].append((used[n], m, sequence, offset))
            used[n] += bins * m
            offset += n * m
        sequence += bins
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the histogram of lengths (at most `capacity` rows) reaches the driver, which
    plans groups of equal bins from it; each piece then finds its place by its rank
    among the pieces of its length.  Ranks come from the numbering within each task and
    a running sum over (task, length), so that no length is gathered in one task.

    Defined cases: a null or empty text is one piece holding `end_id` alone; a null id
    stays null; repeated rows are packed as documents of their own; an empty table
    gives an empty table; other columns are ignored.
    """
    cut = materialize(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan_bins(histogram, capacity))
    names = [c for c in cut.columns if c not in ("part", "nth")]
    ranked = cut.join(offsets, ["part", "length"]).select(*names, (F.col("nth") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, rows = np.flatnonzero(length == n), slots[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + nth // row[:, 1]
                offset[own] = row[:, 3] + nth % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed token sequences of pack_documents(keep_ids=True): sequence_id, ids.

    A sequence is at most `capacity` tokens, so that its group is bounded; an empty table
    gives an empty table.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
