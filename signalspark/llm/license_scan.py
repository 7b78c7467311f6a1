"""License scans: a fingerprint index picks candidates, banded alignment confirms them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_batches
from .license_templates import TEMPLATES

_TOKEN = re.compile(r"\w+")
#: Words of a fingerprint, fingerprints of a winnowing window, half the alignment's band.
GRAM, WINDOW, BAND = 3, 3, 8
#: Templates of fewer words are not thinned: every gram is indexed, so that any text with
#: four fifths of their words shares one.
SHORT = 40
MATCH, MISMATCH, GAP = 2, -1, -1
SCHEMA = "license string, coverage double, matched int, span_start long, span_end long"


def align(template: list[int], words: list[int], start: int, band: int) -> tuple[int, int, int, int]:
    """Local alignment near the diagonal (template word i, word start + i).

    (score, matched words, first matched word, last matched word) of the best path, of
    equal ones that which ends nearest to the diagonal; gaps may lead off the diagonal by
    `band` words.
    """
    width, none = 2 * band + 1, (0, 0, -1, -1)
    above, best, aside = [none] * (width + 1), none, band
    for i, t in enumerate(template):
        row, left = [], none
        for off in range(width):
            j = start + i + off - band
            if 0 <= j < len(words):
                score, matched, first, last = above[off]
                if words[j] == t:
                    cell = (score + MATCH, matched + 1, first if matched else j, j)
                else:
                    cell = (score + MISMATCH, matched, first, last)
                for source in (above[off + 1], left):
                    if source[0] + GAP > cell[0]:
                        cell = (source[0] + GAP, *source[1:])
                if cell[0] <= 0:
                    cell = none
                elif cell[:2] > best[:2] or (cell[:2] == best[:2] and abs(off - band) < aside):
                    best, aside = cell, abs(off - band)
            else:
                cell = none
            row.append(cell)
            left = cell
        above = [*row, none]
    return best


class Index:
    """Winnowed word-gram fingerprints of the templates, as an inverted index."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names = list(templates)
        self.gram = gram
        words = [_TOKEN.findall(templates[n].lower()) for n in self.names]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in words for w in t}))}
        self.base = len(self.vocabulary) + 1
        self.templates = [[self.vocabulary[w] for w in t] for t in words]
        posted: dict[int, list[tuple[int, int]]] = defaultdict(list)
        # One word of five may change: then the first two or the last three are whole.
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.templates):
            if 2 <= len(ids) < 2 * gram:
                self.pairs[ids[0] * self.base + ids[1]].append((t, 0))
            keys = self.keys(np.array(ids, np.int64))
            own_window = 1 if len(ids) < SHORT else window
            mixed = (keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            # The smallest (mixed) key of each window, the last one on ties.
            windows = range(max(1, len(keys) - own_window + 1)) if len(keys) else ()
            picked = {max(p for p in range(a, min(a + own_window, len(keys))) if mixed[p] == mixed[a : a + own_window].min()) for a in windows}
            for p in sorted(picked):
                posted[int(keys[p])].append((t, p))
        self.posted = dict(posted)
        self.sorted_keys = np.array(sorted(posted), np.int64)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """Exact key of each gram of word ids."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        total = np.zeros(n, np.int64)
        for k in range(self.gram):
            total = total * self.base + ids[k : k + n]
        return total

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) pairs, one for each run of hits near one diagonal."""
        keys = self.keys(ids)
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), max(0, len(self.sorted_keys) - 1))
        hits: dict[int, list[int]] = defaultdict(list)
        for j in np.flatnonzero(self.sorted_keys[at] == keys) if len(keys) and len(self.sorted_keys) else ():
            for t, i in self.posted[int(keys[j])]:
                hits[t].append(int(j) - i)
        if self.pairs and len(ids) > 1:
            pairs = ids[:-1] * self.base + ids[1:]
            for j in np.flatnonzero(np.isin(pairs, list(self.pairs))):
                for t, i in self.pairs[int(pairs[j])]:
                    hits[t].append(int(j) - i)
        out = []
        for t, diagonals in hits.items():
            last = None
            for d in sorted(diagonals):
                if last is None or d - last > BAND // 2:
                    out.append((t, d))
                    last = d
        return out


def scan_text(text: str, index: Index, min_coverage: float, band: int) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, end) found in a text; the best of what overlaps."""
    get, low = index.vocabulary.get, text.lower()
    if len(low) != len(text):
        low = _same_length_lower(text)
    ids = [get(w, 0) for w in _TOKEN.findall(low)]
    found = []
    for t, d in index.candidates(np.array(ids, np.int64)):
        template = index.templates[t]
        _, matched, first, last = align(template, ids, d, band)
        if matched and matched / len(template) >= min_coverage:
            found.append((index.names[t], matched / len(template), matched, first, last))
    if not found:
        return []
    chosen: list = []
    for f in sorted(found, key=lambda f: (-f[2], -f[1], f[3], f[0])):
        if all(f[4] < c[3] or f[3] > c[4] for c in chosen):
            chosen.append(f)
    spans = [m.span() for m in _TOKEN.finditer(low)]
    return [(n, c, m, spans[a][0], spans[b][1]) for n, c, m, a, b in sorted(chosen, key=lambda f: f[3])]


def _same_length_lower(text: str) -> str:
    """Lower case but for the characters that would become two, so that spans hold."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_coverage: float = 0.8, band: int = BAND) -> DataFrame:
    """One row for each license notice found: id_col, license, coverage (matched share of
    the notice's words), matched, span_start, span_end (code points, end exclusive).

    Each task builds the index from the templates, whose size does not grow with the
    data.  Defined cases: null, empty or short texts have no rows; repeated rows and null
    ids give rows of their own; of overlapping notices the one with more matched words is
    kept; without templates or rows the result is empty; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates
    field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for found in scan_text(text or "", index, min_coverage, band):
                    at.append(k)
                    rows.append(found)
            columns = zip(*rows) if rows else [()] * 5
            types = [pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "license", "coverage", "matched", "span_start", "span_end"])

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {field.dataType.simpleString()}, {SCHEMA}")
