"""Cross-site boilerplate removal by line, with DataFrame functions only.

Method: lines are keyed by hash, a HyperLogLog sketch of the sites of each key is
built by a merging aggregation, keys whose estimate lies near the threshold get an
exact distinct count, and lines that enough sites share are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: At most so many flagged line keys (24 bytes each) are broadcast as a whole.
BROADCAST_KEYS = 200_000
#: Beyond that, a key is broadcast only if it holds this share of all lines or more,
#: which 1 / HEAVY_SHARE keys do at most.
HEAVY_SHARE = 1e-5
#: The other lines are dealt into so many parts of each key, as a line that is common on
#: few sites is not flagged and still may be a third of all.
SALTS = 16


def _keys(line: Column) -> list[Column]:
    """Two independent 64-bit hashes of the trimmed line."""
    body = F.trim(line)
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("th"),
        F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"),
    )
    return rows.select("id", "th", "site", "pos", "line", *_keys(F.col("line")))


def boilerplate_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 8,
    lg_k: int = 12,
    band: float = 0.25,
) -> DataFrame:
    """Keys (k1, k2) of the lines on `min_sites` sites or more, with their count of
    occurrences `n` and `home`, the smallest document id that holds the line.

    Sketches of 2**lg_k registers have a relative standard error of 1.04 / 2**(lg_k/2)
    (1.6 % here); estimates within `band` of the threshold, over ten of these errors,
    are replaced by exact counts.
    """
    lines = _lines(docs, id_col, text_col, site_col).where(F.trim("line") != "")
    sketched = lines.groupBy("k1", "k2").agg(
        F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"),
        F.min("id").alias("home"),
        F.count(F.lit(1)).alias("n"),
    )
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    seen = materialize(
        sketched.select("k1", "k2", "home", "n", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low),
        "line-sites",
    )
    sure = seen.where(F.col("sites") > high).select("k1", "k2", "home", "n")
    near = seen.where(F.col("sites") <= high)
    pairs = _only(lines, near).where(F.col("site").isNotNull())
    exact = (
        pairs.groupBy("k1", "k2", "site").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("exact_sites"))
        .where(F.col("exact_sites") >= min_sites)
    )
    return sure.unionByName(near.join(exact, ["k1", "k2"]).select("k1", "k2", "home", "n"))


def _split(keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(keys to broadcast, all others): all of few keys, else those of a large share of their
    occurrences; the others are None where there are none."""
    if keys.count() <= BROADCAST_KEYS:
        return keys, None
    total = keys.agg(F.sum("n")).first()[0]
    return keys.where(F.col("n") >= total * HEAVY_SHARE), keys.where(F.col("n") < total * HEAVY_SHARE)


def _salted(lines: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt, which deals the lines of a key over SALTS tasks."""
    salt = F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int")
    return lines.withColumn("salt", salt), keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _only(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines of some keys (k1, k2, n)."""
    heavy, light = _split(keys)
    found = lines.join(F.broadcast(heavy.select("k1", "k2")), ["k1", "k2"], "left_semi")
    if light is None:
        return found
    left, right = _salted(lines.where(F.trim("line") != ""), light.select("k1", "k2"))
    return found.unionByName(left.join(right, ["k1", "k2", "salt"], "left_semi").drop("salt"))


def _flag(lines: DataFrame, flagged: DataFrame) -> DataFrame:
    """Left join of lines to flagged keys: `home` and `hit` are null for unflagged ones."""
    marked = flagged.select("k1", "k2", "home", "n", F.lit(True).alias("hit"))
    heavy, light = _split(marked)
    if light is None:
        return lines.join(F.broadcast(heavy.drop("n")), ["k1", "k2"], "left")
    heavy, light = (df.drop("n").withColumnsRenamed({"home": f"h{i}", "hit": f"hit{i}"}) for i, df in ((1, heavy), (2, light)))
    first = lines.join(F.broadcast(heavy), ["k1", "k2"], "left")
    # Lines settled by the broadcast and blank ones, which are never flagged, are not shuffled.
    settled = F.col("hit1").isNotNull() | (F.trim("line") == "")
    done = first.where(settled).withColumnsRenamed({"h1": "home", "hit1": "hit"})
    left, right = _salted(first.where(~settled).drop("h1", "hit1"), light)
    rest = left.join(right, ["k1", "k2", "salt"], "left").drop("salt")
    return done.unionByName(rest.withColumnsRenamed({"h2": "home", "hit2": "hit"}))


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 8,
    keep_home: bool = True,
    lg_k: int = 12,
    band: float = 0.25,
) -> DataFrame:
    """Remove from every text the lines that stand on `min_sites` or more distinct sites.

    Lines are split at LF and compared without outer spaces.  With `keep_home` a
    flagged line stays in the document with the smallest id that holds it, so that no
    content leaves the corpus altogether.  Returns the input's columns with the cleaned
    text, and n_lines, n_removed (long; an input column of such a name is replaced).

    Defined cases: a null text stays null with zero lines; an empty text is one blank
    line; blank lines are never removed; a null site counts as no site; rows with a
    null id have no home and lose every flagged line; repeated rows are each cleaned
    alike; an empty table gives an empty table.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    flagged = materialize(
        boilerplate_lines(docs, id_col=id_col, text_col=text_col, site_col=site_col, min_sites=min_sites, lg_k=lg_k, band=band),
        "boilerplate",
    )
    lines = _flag(_lines(docs, id_col, text_col, site_col), flagged)
    home = F.col("id").eqNullSafe(F.col("home")) & F.col("id").isNotNull() if keep_home else F.lit(False)
    gone = F.coalesce(F.col("hit"), F.lit(False)) & ~home
    # Repeated rows of one (id, text) give equal structs, which the set merges.
    kept = lines.groupBy("id", "th").agg(
        F.collect_set(F.when(~gone, F.struct("pos", "line"))).alias("kept"),
        F.max("pos").alias("last"),
    )
    clean = kept.select(
        F.col("id").alias("__id"),
        F.col("th").alias("__th"),
        F.array_join(F.transform(F.array_sort("kept"), lambda x: x["line"]), "\n").alias("__text"),
        (F.col("last") + 1).cast("long").alias("__lines"),
        (F.col("last") + 1 - F.size("kept")).cast("long").alias("__removed"),
    )
    others = F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("__row")
    base = docs.select(others, F.col(id_col).alias("__key"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).isNull().alias("__null"))
    both = base.join(clean, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    text = F.when(~F.col("__null"), F.coalesce("__text", F.lit("")))
    return both.select(
        *[(text if c == text_col else F.col("__row")[c]).alias(c) for c in names],
        F.when(F.col("__null"), 0).otherwise(F.coalesce("__lines", F.lit(0))).cast("long").alias("n_lines"),
        F.when(F.col("__null"), 0).otherwise(F.coalesce("__removed", F.lit(0))).cast("long").alias("n_removed"),
    )
