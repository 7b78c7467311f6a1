"""Secret scans over a ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_batches, materialize

#: Rules in listed order: name, version, pattern, group whose length counts, least length.
#: A changed pattern gets a new version, and then only that rule runs again on old blobs.
RULES = (
    ("assign", 1, re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # Equal to all runs of [0-9a-f]+ of which the short ones are dropped.
    ("hex", 1, re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = tuple(r[0] for r in RULES)
_SPANS = "array<struct<kind: string, start: long, stop: long>>"
LEDGER_SCHEMA = f"blob_id string, rule string, version int, spans {_SPANS}"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def find_spans(text: str, rule: tuple) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the leftmost non-overlapping matches that are long enough."""
    kind, _, pattern, group, least = rule
    return [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def _label(rule: tuple) -> str:
    return f"{rule[0]}@{rule[1]}"


def _scan(rules: tuple):
    by_label = {_label(r): r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for blob, text, todo in zip(*(c.to_pylist() for c in batch.columns)):
                for label in todo:
                    rule = by_label[label]
                    spans = [{"kind": k, "start": a, "stop": b} for k, a, b in find_spans(text, rule)]
                    for column, x in zip(out, (blob, rule[0], rule[1], spans)):
                        column.append(x)
            types = (pa.string(), pa.string(), pa.int32(), _ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["blob_id", "rule", "version", "spans"])

    return run


def blob_id(text_col: str):
    """Content address of a text; a null text is the empty blob."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """New ledger rows: the (blob, rule version) pairs of `versions` that `ledger` lacks.

    `versions` holds every historical version as a row.  Equal texts are merged in each
    task before the shuffle, so that a blob crosses it once per task at most and is
    scanned once.  A blob without findings also gets its rows, with empty spans.
    """
    spark = versions.sparkSession
    arrow_batches(spark)
    blobs = versions.groupBy(blob_id(text_col).alias("blob_id")).agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    every = F.array(*[F.lit(_label(r)) for r in rules])
    if ledger is None:
        unseen = blobs.select("blob_id", "text", every.alias("todo"))
    else:
        done = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("done"))
        missing = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
        unseen = blobs.join(done, "blob_id", "left").select("blob_id", "text", missing.alias("todo")).where(F.size("todo") > 0)
    return unseen.mapInArrow(_scan(rules), LEDGER_SCHEMA)


def findings(versions: DataFrame, ledger: DataFrame, *, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Rows of `versions` with `spans`, the current rules' findings of their blob, sorted
    by start and then by the order of the rules."""
    current = F.array(*[F.lit(_label(r)) for r in rules])
    order = F.array(*[F.lit(r[0]) for r in rules])
    rows = ledger.where(F.array_contains(current, F.concat_ws("@", "rule", F.col("version").cast("string"))) & (F.size("spans") > 0))
    keyed = rows.select("blob_id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind"))).alias("spans"))
    merged = keyed.groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("found"))
    spans = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    merged = merged.select(F.col("blob_id").alias("__found_blob"), spans.alias("__found"))
    names = [c for c in versions.columns if c.lower() not in ("blob_id", "spans")]
    paths = versions.select(*[F.col(f"`{c}`") for c in names], blob_id(text_col).alias("blob_id"))
    joined = paths.join(merged, paths["blob_id"] == F.col("__found_blob"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], "blob_id", F.coalesce("__found", F.array().cast(_SPANS)).alias("spans"))


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text", columns: list[str] | None = None, rules: tuple = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) for all `versions`; `columns` limits what is carried.

    Defined cases: a null text is the empty text, without findings; repeated rows share
    one blob and each get its findings; input columns named blob_id or spans are
    replaced; an empty table gives two empty tables.
    """
    new = materialize(update_ledger(versions, ledger, text_col=text_col, rules=rules), "ledger")
    known = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    found = findings(versions if columns is None else versions.select(*columns, text_col), known, text_col=text_col, rules=rules)
    return found, new


def redact(found: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Replace every found span in the text by `mask`; overlapping spans become one.

    A null or empty text and one without spans stay as they are; other columns are kept.
    """
    arrow_batches(found.sparkSession)

    def cover(text: str | None, spans: list[dict]) -> str | None:
        if not text or not spans:
            return text
        parts, at = [], 0
        for start, stop in sorted((s["start"], s["stop"]) for s in spans):
            if start >= at:
                parts += [text[at:start], mask]
            at = max(at, stop)
        return "".join(parts) + text[at:]

    at, where = found.columns.index(text_col), found.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [cover(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist())]
            yield batch.set_column(at, text_col, pa.array(clean, pa.string()))

    return found.mapInArrow(run, found.schema)
