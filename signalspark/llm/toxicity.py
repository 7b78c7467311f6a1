"""Toxicity scores: gradient-boosted trees over dense text features, calibrated."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_batches, materialize

# Common insults and second-person words of four languages.
INSULTS = frozenset(
    "idiot idiots stupid dumb moron morons loser losers pathetic worthless trash garbage scum clown disgusting "
    "jerk fool imbecile dumbass bastard bitch shit fuck fucking asshole crap hate "
    "idiotin dumm blöd trottel abschaum versager arschloch scheiße widerlich "
    "idiote stupide imbécile crétin abruti connard salaud merde ordure minable "
    "estúpido estúpida imbécil tonto basura mierda cabrón asqueroso inútil".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!*", "oieastasi ")

_TOKEN = re.compile(r"\w+")
_ODD = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+|[0-9@$][^\W\d_]{3,}")
_RUN = re.compile(r"([^\W\d_])\1\1")
_LOUD = re.compile(r"\b[A-Z]{3,}\b")
_MARKS = re.compile(r"[!?]{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PUNCTUATION = re.compile(r"[^\w\s]")
#: Tokens between a lexicon hit and a second-person word that count as near.
NEAR = 6

FEATURES = (
    "insult_rate", "insult_log", "strong_rate", "strong_log", "weak_rate", "weak_log", "kinds_log", "weight_rate", "weight_log", "top_weight",
    "near_you", "you_rate", "capitals", "loud_rate", "exclaim", "question", "punctuation", "mark_runs",
    "odd_rate", "odd_hits", "stretched", "log_words", "word_length",
)
#: Lengths of the word beginnings that may enter the lexicon, and its levels of log-odds.
STEMS = range(4, 9)
WEAK, STRONG = 1.5, 3.0
#: Folds that teach: 2 is held out, 3 calibrates.
FOLDS = (0, 1, 3)
_CACHE_WORDS = 300_000


class TextFeatures:
    """Dense features of whole texts; `lexicon` has log-odds of words and of stems (with "-").

    A token is looked at once: most are plain, and only the others are counted.  Signs and
    capitals stand in words that are not all letters in lower or title case; the patterns
    look at these words alone, as none of them reaches over white space.
    """

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.plain: set[str] = set()
        self.special: dict[str, tuple[float, bool, bool, int]] = {}

    def weight(self, token: str) -> float:
        """Largest log-odds of the token or of its beginnings, 0 if none is learned."""
        get = self.lexicon.get
        return max(get(token, 0.0), *(get(token[:k] + "-", 0.0) for k in STEMS if len(token) > k), 0.0)

    def _look(self, token: str) -> tuple[float, bool, bool, int] | None:
        """(weight, insult, second person, stretched letters) of a token; None for a plain one."""
        found = self.special.get(token)
        if found is None:
            found = self.weight(token) if self.lexicon else 0.0, token in INSULTS, token in SECOND_PERSON, len(_RUN.findall(token))
            if len(self.plain) + len(self.special) >= _CACHE_WORDS:
                self.plain.clear()
                self.special.clear()
            if found[0] >= WEAK or any(found[1:]):
                self.special[token] = found
            else:
                self.plain.add(token)
                return None
        return found

    def __call__(self, text: str) -> list[float]:
        tokens = _TOKEN.findall(text.lower())
        n, size = max(1, len(tokens)), max(1, len(text))
        plain = self.plain
        seen = [(i, t, x) for i, t in enumerate(tokens) if t not in plain and (x := self._look(t)) is not None]
        hits = [x[0] for *_, x in seen if x[0] >= WEAK]
        strong = sum(w >= STRONG for w in hits)
        kinds = len({t for _, t, x in seen if x[0] >= WEAK})
        insults, stretched = sum(x[1] for *_, x in seen), sum(x[3] for *_, x in seen)
        you = [i for i, _, x in seen if x[2]]
        near = 0.0
        if you and (insults or strong):
            places = [i for i, _, x in seen if x[1] or x[0] >= STRONG]
            close = {j for i in you for j in range(i - NEAR, i + NEAR + 1)}
            near = sum(i in close for i in places) / len(places)
        signs = " ".join([w for w in text.split() if not (w.isalpha() and (w.islower() or w.istitle()))])
        odd = _ODD.findall(signs.lower())
        odd_hits = sum(o.translate(_LEET).replace(" ", "") in INSULTS for o in odd)
        letters = max(1, sum(map(len, tokens)))
        return [
            insults / n, math.log1p(insults), strong / n, math.log1p(strong), (len(hits) - strong) / n, math.log1p(len(hits) - strong),
            math.log1p(kinds), sum(hits) / n, math.log1p(sum(hits)), max(hits, default=0.0),
            near, len(you) / n, len(_UPPER.findall(text)) / letters, len(_LOUD.findall(signs)) / n,
            text.count("!") / size, text.count("?") / size, len(_PUNCTUATION.findall(signs)) / size, len(_MARKS.findall(signs)) / n,
            len(odd) / n, math.log1p(odd_hits), stretched / n, math.log1p(len(tokens)), letters / n,
        ]


def _features(docs: DataFrame, lexicons: dict[int | None, dict]) -> DataFrame:
    """`docs` (text, fold, then others) with the text replaced by the array `features`.

    The lexicon is the one of the row's fold, or that of None.
    """
    arrow_batches(docs.sparkSession)
    rest = docs.columns[1:]
    schema = "features array<double>" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold = {k: TextFeatures(v) for k, v in lexicons.items()}
        for batch in batches:
            rows = [by_fold.get(k, by_fold[None])(t or "") for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["features", *rest])

    return docs.mapInArrow(run, schema)


_COUNTS = [f"{kind}{k}" for k in FOLDS for kind in ("toxic", "other")]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task that hold a term, by fold and label."""
    counts = {c: Counter() for c in _COUNTS}
    for batch in batches:
        for text, label, k in zip(*(c.to_pylist() for c in batch.columns)):
            tokens = set(_TOKEN.findall((text or "").lower()))
            stems = {f"{t[:n]}-" for n in STEMS for t in tokens if len(t) > n}
            counts[f"{'toxic' if label else 'other'}{k}"].update(tokens | stems)
    terms = list(set().union(*counts.values()))
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([counts[c][t] for t in terms], pa.int64()) for c in _COUNTS]], ["term", *_COUNTS])


def learn_lexicons(training: DataFrame, *, size: int = 4000, min_docs: int = 3) -> dict[int | None, dict[str, float]]:
    """Log-odds of terms that mark toxic texts: for each fold from the other folds, and
    for None from all.  `training` has text, label and fold; at most `size` terms of each
    lexicon reach the driver.  A null text holds no terms; where a class has no rows the
    lexicon is empty.
    """
    totals = {f"{'toxic' if r['label'] else 'other'}{r['fold']}": r["n"] for r in training.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = training.select("text", "label", "fold").mapInArrow(_term_counts, "term string, " + ", ".join(f"{c} long" for c in _COUNTS))
    terms = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    terms = materialize(terms.where(sum((F.col(f"toxic{k}") for k in FOLDS), F.lit(0)) >= min_docs), "toxicity-terms")
    found: dict[int | None, dict[str, float]] = {}
    for own in (*FOLDS, None):
        others = [k for k in FOLDS if k != own]
        n = {kind: sum(totals.get(f"{kind}{k}", 0) for k in others) for kind in ("toxic", "other")}
        if not n["toxic"] or not n["other"]:
            found[own] = {}
            continue
        toxic, other = (sum((F.col(f"{kind}{k}") for k in others), F.lit(0)) for kind in ("toxic", "other"))
        odds = F.log((toxic + 0.1) / n["toxic"]) - F.log((other + 0.5) / n["other"])
        best = terms.select("term", odds.alias("odds"), toxic.alias("toxic")).where((F.col("odds") >= WEAK) & (F.col("toxic") >= min_docs))
        rows = best.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(size).collect()
        found[own] = {r["term"]: r["odds"] for r in rows}
    return found


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)).cast("int")


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    max_training: int = 40_000,
    trees: int = 20,
    depth: int = 4,
) -> DataFrame:
    """The columns of `docs` with held_out, score and predicted (same names are replaced).

    Folds by crc32 of the id: 0 and 1 teach the trees, 3 the isotonic calibration, with a
    lexicon of words and stems that the other folds taught; labels of fold 2 are never
    read.  Rows to score get the lexicon of all three folds.  At most about
    `max_training` labelled rows (chosen by hash of the id) are used to fit; every row is
    scored.  The score is 0.99 of the calibrated probability plus 0.01 of the trees' own,
    which keeps their order within a level of the calibration.

    Defined cases: a null text is the empty text; a null id is scored and not held out;
    a null label or unlabelled row teaches nothing; an id labelled more than once counts
    as toxic if any label says so; without labels of both classes every score is the share
    of toxic labels (0 without labels); an empty table gives an empty table.
    """
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isNotNull()).groupBy("key").agg(F.max("label").alias("label"))
    known = known.select("key", (F.col("label") > 0).cast("double").alias("label"), fold("key").alias("fold")).where("fold <> 2")
    n = known.count()
    if n > max_training:
        known = known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1e6 * max_training / n))
    # Bounded by max_training rows of 24 bytes.
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(known), "key")
    training = materialize(texts.select("text", "label", "fold"), "toxicity-training")
    shares = {(r["fold"], r["label"]): r["n"] for r in training.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    usable = all(shares.get((3, y)) and shares.get((0, y), 0) + shares.get((1, y), 0) for y in (0.0, 1.0))
    held = F.coalesce(fold(id_col) == 2, F.lit(False))
    if not usable:
        total = sum(shares.values())
        share = sum(c for (_, y), c in shares.items() if y) / total if total else 0.0
        scored = docs.select(*[F.col(f"`{c}`") for c in names], held.alias("held_out"), F.lit(float(share)).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    lexicons = learn_lexicons(training)
    rows = materialize(_features(training.select("text", "fold", "label"), lexicons), "toxicity-features").withColumn("vector", array_to_vector("features"))
    trained = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=42, checkpointInterval=-1).fit(rows.where("fold <> 3").coalesce(4))
    chance = vector_to_array("probability")[1]
    calibration = trained.transform(rows.where("fold = 3")).select(chance.alias("raw"), "label")
    # Equal raw scores are one weighted row: rows of one score would all go to one task.
    levels = calibration.groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(levels)

    others = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    every = _features(docs.select(F.col(text_col).alias("text"), F.lit(None).cast("int").alias("fold"), others, held.alias("held_out")), {None: lexicons[None]})
    raw = trained.transform(every.withColumn("vector", array_to_vector("features"))).select("row", "held_out", chance.alias("raw"))
    level = isotonic.transform(raw)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("prediction") + 0.01 * F.col("raw")))
    scored = level.select("row.*", "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
