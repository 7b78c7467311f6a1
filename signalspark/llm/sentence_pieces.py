"""SentencePiece encoding and decoding by batched Viterbi search with numpy.

The words of a batch are grouped by length, and the words of a group advance together:
hashes of the substrings that end at a position probe the sorted hashes of the pieces,
vectorised maxima over the start positions choose, and back-pointers are stored.

For a unigram model the maximum is that of the summed scores.  A BPE model's scores are
merge ranks, whose sum has no meaning.  But its encoding of a text is the one path of
which all neighbouring pieces are compatible, that is, encode to themselves as a pair; and
every prefix has one last piece.  So a path that holds an incompatible pair counts as minus
infinity, and at each position one start is left.  Whether a pair is compatible is found by
merging its characters once, and kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_batches

SPACE = "▁"
#: Units in a generation of the cache, of which two are kept.
CACHE_WORDS = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MARK_BITS = np.uint64(44)
#: Slots of the memory of tested pairs, by hash of the pair; a slot holds the newest.
PAIR_SLOTS = 1 << 21
#: Groups of fewer words go character by character instead of array by array.
FEW = 4


class Pieces:
    """A vocabulary: piece strings and scores in order of their ids, and byte ids."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unknown: int, special: set[int], unigram: bool):
        self.pieces, self.unigram, self.unknown, self.byte_ids = pieces, unigram, unknown, byte_ids
        self.scores = np.array(scores, np.float64)
        self.special = special | set(byte_ids) | {unknown}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in self.special}
        self.units = self._unit_pattern()
        # Units in use, and those of the generation before, which are still looked up.
        self.older: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {"": b""}
        self.walked: dict[tuple[int, int], bool] = {}
        self.bytes = [p.replace(SPACE, " ").encode() for p in pieces]
        for i in self.special:
            self.bytes[i] = b""
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self._probe_pieces(list(self.ids.items()))
        if not unigram:
            self._probe_pairs()
            # Pieces that do not encode to themselves end no encoding.
            whole = self._whole_pieces()
            self._probe_pieces([(p, i) for p, i in self.ids.items() if i in whole])
            self.pair_slots, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def _unit_pattern(self) -> re.Pattern | None:
        """Pattern of the units that no piece crosses, None if a piece may cross any.

        Neighbouring characters that no piece holds side by side never come into one
        piece: a unit ends before a space, and where no piece joins letters to ASCII
        marks also between these.
        """
        pairs = {x for p in self.ids for x in zip(p, p[1:])}
        if any(b == SPACE and a != SPACE for a, b in pairs):
            return None
        joined = {c for x in pairs for c in x}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        tail = rf"|{SPACE}+" + (f"|[{alone}]" if alone else "")
        whole = rf"{SPACE}*[^{SPACE}{alone}]+"
        # ASCII marks and digits; letters but for those that a piece joins to such a mark.
        mark = r"[!-@\[-^`{-~]"
        bound = {x for a, b in pairs for x, y in ((a, b), (b, a)) if re.match(r"[^\W\d_]", x) and re.match(mark, y)}
        letter = rf"[^\W\d_{''.join(sorted(bound))}]"
        end = rf"{SPACE}{alone}"
        return re.compile(rf"{SPACE}*{letter}+(?={mark}|[{end}]|\Z)|{SPACE}*{mark}+(?={letter}|[{end}]|\Z)|{whole}" + tail)

    # -- tables ------------------------------------------------------------------------

    def _probe_pairs(self) -> None:
        """Sorted keys (left id, right id) of all splits of a piece into two pieces."""
        n, pairs = len(self.pieces), {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ids = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)

    def _probe_pieces(self, pieces: list[tuple[str, int]]) -> None:
        """Sorted hashes of the pieces, with their ids."""
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.usable = dict(pieces)
        rows: list[tuple[int, int]] = []
        for n, own in _by_length(pieces, key=lambda x: x[0]).items():
            rows += zip(_spans(_prefixes(_codes([p for p, _ in own])), n)[:, 0].tolist(), [i for _, i in own])
        rows.sort()
        self.piece_keys, self.piece_ids = np.array([h for h, _ in rows] or [0], np.uint64), np.array([i for _, i in rows] or [-1], np.int64)
        self.piece_marks = np.zeros(1 << (64 - int(_MARK_BITS)), bool)
        self.piece_marks[self.piece_keys >> _MARK_BITS] = True

    def _whole_pieces(self) -> set[int]:
        found: set[int] = set()
        for own in _by_length(self.ids).values():
            found |= {self.ids[p] for p, ids in zip(own, self._merge(own)) if ids == [self.ids[p]]}
        return found

    def _lookup(self, words: list[str]) -> list[np.ndarray]:
        """For each length up to the longest piece's: the piece (or -1) from each start, by word."""
        n, prefixes, out = len(words[0]), _prefixes(_codes(words)), []
        for size in range(1, min(n, self.longest) + 1):
            keys = _spans(prefixes, size)
            own = np.full(keys.shape, -1)
            # Most substrings are no piece, which a look at the upper bits tells.
            row, start = np.nonzero(self.piece_marks[keys >> _MARK_BITS])
            asked = keys[row, start]
            at = np.minimum(np.searchsorted(self.piece_keys, asked), len(self.piece_keys) - 1)
            own[row, start] = np.where(self.piece_keys[at] == asked, self.piece_ids[at], -1)
            out.append(own)
        return out

    # -- encoding ----------------------------------------------------------------------

    def encode(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(ids of all texts, offsets of the texts in them); a null text has none.

        Distinct words between single spaces are encoded once; texts with other spaces go
        through by their units.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, rf"^(?: |\z)|  | \z|{SPACE}") if self.units else pa.array(np.ones(len(texts), bool))
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = odd.to_numpy(zero_copy_only=False).nonzero()[0]
        marked = [SPACE + w if w else "" for w in words] + [SPACE + t.replace(" ", SPACE) if t else "" for t in texts.take(pa.array(at)).to_pylist()]
        found = self._encode(marked)
        order = flat.indices.to_numpy().copy()
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        order[starts[at]] = len(words) + np.arange(len(at))  # the empty word in its stead
        joined = pa.array(found, pa.large_binary()).take(pa.array(order))
        bounds = np.frombuffer(joined.buffers()[1], np.int64, len(order) + 1) // 4
        return np.frombuffer(joined.buffers()[2] or b"", "<u4", bounds[-1]), bounds[starts]

    def _encode(self, marked: list[str]) -> list[bytes]:
        """Packed ids of strings with marked spaces, by their units."""
        find = self.units.findall if self.units else (lambda w: [w])
        cut = {w: find(w) for w in marked if w and w not in self.known}
        fresh = {u for own in cut.values() for u in own if u not in self.known}
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.older, self.known = self.known, {"": b""}
            cut = {w: cut.get(w) or [w] for w in marked if w}
            fresh = {u for own in cut.values() for u in own}
        known, older = self.known, self.older
        known.update([(u, older[u]) for u in fresh if u in older])
        for n, words in _by_length(u for u in fresh if u not in known).items():
            step = max(1, 200_000 // n)
            for at in range(0, len(words), step):
                known.update(zip(words[at : at + step], self._advance(words[at : at + step])))
        return [known[w] if w in known else b"".join([known[u] for u in cut[w]]) for w in marked]

    def _advance(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of one length, which advance together."""
        if not self.unigram and len(words) < FEW:
            return [self._packed(w, *self._walk(w)) for w in words]
        n, found = len(words[0]), self._lookup(words)
        piece, size = np.full((len(words), n + 1), -1), np.zeros((len(words), n + 1), np.int64)
        (self._best_scores if self.unigram else self._fitting)(found, piece, size)
        # Back from the end, all words at once.
        at, steps, every = np.full(len(words), n), [], np.arange(len(words))
        while at.any():
            steps.append((np.where(at > 0, piece[every, at], -2), np.where(at > 0, size[every, at], 0)))
            at = at - steps[-1][1]
        pieces, sizes = (np.stack([s[k] for s in steps[::-1]], axis=1) for k in (0, 1))
        used = pieces != -2
        if (known := ~(pieces == -1).any(axis=1)).all():
            flat, stops = pieces[used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
            return [flat[a:b] for a, b in zip([0, *stops], stops)]
        return [np.array(p[u], "<u4").tobytes() if k else self._packed(w, p[u].tolist(), z[u].tolist()) for w, p, z, u, k in zip(words, pieces, sizes, used, known)]

    def _packed(self, word: str, pieces: list[int], sizes: list[int]) -> bytes:
        """Packed ids of a path; an unknown character becomes its bytes."""
        out, at = [], 0
        for i, n in zip(pieces, sizes):
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in word[at : at + n].encode()]
            else:
                out.append(self.unknown)
            at += n
        return np.array(out, "<u4").tobytes()

    def _best_scores(self, found: list[np.ndarray], piece: np.ndarray, size: np.ndarray) -> None:
        """Last piece and its size for each prefix, by the largest sum of scores."""
        floor = (self.scores.min() if len(self.scores) else 0.0) - 10.0
        best = np.full(piece.shape, -np.inf)
        best[:, 0] = 0.0
        for end in range(1, piece.shape[1]):
            for n in range(1, min(end, len(found)) + 1):
                own = found[n - 1][:, end - n]
                total = best[:, end - n] + np.where(own >= 0, self.scores[own], floor if n == 1 else -np.inf)
                better = total > best[:, end]
                best[better, end], piece[better, end], size[better, end] = total[better], own[better], n

    def _fitting(self, found: list[np.ndarray], piece: np.ndarray, size: np.ndarray) -> None:
        """The same by compatible pairs, of which one start is left."""
        for end in range(1, piece.shape[1]):
            n = min(end, len(found))
            own = np.stack([found[k - 1][:, end - k] for k in range(1, n + 1)], axis=1)
            before = piece[:, end - n : end][:, ::-1]
            row, k = np.nonzero(own >= 0)
            score = np.full(own.shape, -np.inf)
            score[:, 0] = -1.0  # an unknown character, if no piece fits
            fits = self._fit(before[row, k], own[row, k])
            score[row[fits], k[fits]] = 0.0
            best = score.argmax(axis=1)
            piece[:, end], size[:, end] = own[np.arange(len(own)), best], best + 1

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of pieces are compatible; unknown characters and the beginning (-1) always are."""
        out = np.ones(len(a), bool)
        asked = np.flatnonzero(a >= 0)
        keys = a[asked] * len(self.pieces) + b[asked]
        slot = (keys.astype(np.uint64) * _MULTIPLIER >> np.uint64(40)).astype(np.int64) % PAIR_SLOTS
        known, new = self.pair_fits[slot], np.flatnonzero(self.pair_slots[slot] != keys)
        if len(new):
            fresh, which = np.unique(keys[new], return_inverse=True)
            pairs = [divmod(k, len(self.pieces)) for k in fresh.tolist()]
            merged = self._merge([self.pieces[x] + self.pieces[y] for x, y in pairs])
            fits = np.array([ids == [x, y] for ids, (x, y) in zip(merged, pairs)])
            known[new] = fits[which]
            # Of new pairs with one slot one stays, and its own result with it.
            self.pair_slots[slot[new]] = keys[new]
            self.pair_fits[slot[new]] = fits[np.searchsorted(fresh, self.pair_slots[slot[new]])]
        out[asked] = known
        return out

    def _walk(self, word: str) -> tuple[list[int], list[int]]:
        """The path by compatible pairs of one word, character by character."""
        last, sizes, get = [-2] * (len(word) + 1), [0] * (len(word) + 1), self.usable.get
        for end in range(1, len(word) + 1):
            last[end], sizes[end] = get(word[end - 1], -1), 1
            for n in range(min(end, self.longest), 1, -1):
                own = get(word[end - n : end])
                if own is not None and (last[end - n] < 0 or self._pair(last[end - n], own)):
                    last[end], sizes[end] = own, n
                    break
        path, end = [], len(word)
        while end:
            path.append((last[end], sizes[end]))
            end -= sizes[end]
        return [p for p, _ in path[::-1]], [n for _, n in path[::-1]]

    def _pair(self, a: int, b: int) -> bool:
        if (a, b) not in self.walked:
            if len(self.walked) > PAIR_SLOTS // 8:
                self.walked.clear()
            self.walked[a, b] = bool(self._fit(np.array([a]), np.array([b]))[0])
        return self.walked[a, b]

    def _merge(self, words: list[str]) -> list[list[int]]:
        """Ids of words of known characters by the merges themselves, best first."""
        size, used = len(self.pieces), np.array([len(w) for w in words])
        ids = np.full((len(words), used.max()), size)
        ids[np.arange(ids.shape[1]) < used[:, None]] = [self.ids[c] for w in words for c in w]
        rows, out = np.arange(len(words)), [None] * len(words)
        while True:
            keys = ids[:, :-1] * (size + 1) + ids[:, 1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), max(0, len(self.pair_keys) - 1))
            valid = (self.pair_keys[at] == keys) if len(self.pair_keys) else np.zeros(keys.shape, bool)
            valid &= np.arange(1, ids.shape[1])[None, :] < used[:, None]
            going = valid.any(axis=1)
            for own in np.flatnonzero(~going).tolist():
                out[rows[own]] = ids[own, : used[own]].tolist()
            if not going.any():
                return out
            merged = self.pair_ids[at[going]]
            best = np.where(valid[going], self.scores[merged], -np.inf).argmax(axis=1)
            ids, rows, used = ids[going], rows[going], used[going] - 1
            ids[np.arange(len(rows)), best] = merged[np.arange(len(rows)), best]
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns[None, :] + (columns[None, :] > best[:, None]), 1)

    # -- decoding ----------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        body = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return body.decode("utf-8", "replace").removeprefix(" ")


def _by_length(items, key=lambda x: x) -> dict[int, list]:
    groups: dict[int, list] = {}
    for x in items:
        groups.setdefault(len(key(x)), []).append(x)
    return groups


def _codes(words: list[str]) -> np.ndarray:
    """Character codes of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomial 64-bit hashes of all prefixes of each row."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _MULTIPLIER + codes[:, k] + np.uint64(1)
    return out


def _spans(prefixes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the substrings of `size` characters from each start."""
    power = np.uint64(pow(int(_MULTIPLIER), size, 2**64))
    return prefixes[:, size:] - prefixes[:, :-size] * power


@lru_cache(maxsize=4)
def load_pieces(path: str, unigram: bool = False) -> Pieces:
    """The vocabulary of a SentencePiece model file without text normalization."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = [i for i in range(n) if model.is_byte(i)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    return Pieces([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], byte_ids, model.unk_id(), special, unigram)


def _encoded(base: list[str], model_path: str, text_col: str, ids_col: str, unigram: bool):
    at = base.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(model_path, unigram)
        for batch in batches:
            texts = batch.column(at)
            ids, offsets = model.encode(texts)
            given = pa.array(offsets.astype(np.int32), mask=np.r_[texts.is_null().to_numpy(zero_copy_only=False), False])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(given, pa.array(ids.view(np.int32)))], [*base, ids_col])

    return run


def _slices(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for a, b, valid in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist()):
        yield values[a:b] if valid else None


def _decoded(base: list[str], model_path: str, ids_col: str, text_col: str, unigram: bool):
    at = base.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(model_path, unigram)
        for batch in batches:
            texts = [model.decode(ids) if ids is not None else None for ids in _slices(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*base, text_col])

    return run


def _digested(base: list[str], ids_col: str, name: str):
    at = base.index(ids_col)
    rest = [c for c in base if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(_slices(batch.column(at)))
            crc = [zlib.crc32(ids.astype("<u4").tobytes()) if ids is not None else None for ids in own]
            count = [len(ids) if ids is not None else None for ids in own]
            others = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(count, pa.int64()), pa.array(crc, pa.int64())], [*rest, "n_ids", name])

    return run


def _fields(df: DataFrame, *without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name not in without)


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "ids", unigram: bool = False) -> DataFrame:
    """Add the array `ids_col` of piece ids of every whole text.

    Defined cases: a null text has null ids; an empty one an empty array; unknown
    characters become byte pieces; repeated rows are encoded alike; an input column named
    `ids_col` is replaced; an empty table gives an empty table.
    """
    arrow_batches(docs.sparkSession)
    base = docs.drop(ids_col)
    return base.mapInArrow(_encoded(base.columns, model_path, text_col, ids_col, unigram), f"{_fields(base)}`{ids_col}` array<int>")


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "decoded", unigram: bool = False) -> DataFrame:
    """Add `text_col`, the text of the piece ids; null ids give null, an input column
    named `text_col` is replaced, ids outside the vocabulary raise an error; an empty
    table gives an empty table."""
    arrow_batches(encoded.sparkSession)
    base = encoded.drop(text_col)
    return base.mapInArrow(_decoded(base.columns, model_path, ids_col, text_col, unigram), f"{_fields(base)}`{text_col}` string")


def ids_digest(encoded: DataFrame, *, ids_col: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """Replace the ids by their count `n_ids` and the CRC-32 of their little-endian 32-bit
    form, null for null ids; input columns of these names are replaced."""
    arrow_batches(encoded.sparkSession)
    base = encoded.drop("n_ids", name)
    return base.mapInArrow(_digested(base.columns, ids_col, name), f"{_fields(base, ids_col)}n_ids long, `{name}` long")


def round_trip(docs: DataFrame, model_path: str, *, text_col: str = "text", unigram: bool = False) -> DataFrame:
    """ids_digest(decode(encode(docs))) in one pass of one Python worker; cases as there."""
    arrow_batches(docs.sparkSession)
    base = docs.drop("ids", "decoded", "n_ids", "ids_crc32")
    first = _encoded(base.columns, model_path, text_col, "ids", unigram)
    then = _decoded([*base.columns, "ids"], model_path, "ids", "decoded", unigram)
    last = _digested([*base.columns, "ids", "decoded"], "ids", "ids_crc32")
    return base.mapInArrow(lambda batches: last(then(first(batches))), f"{_fields(base)}decoded string, n_ids long, ids_crc32 long")
