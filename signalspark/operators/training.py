"""Training sets and offline evaluation of recommenders (G)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import last_n, uniform_hash
from ..functions.vectors import as_doubles, dot, unit
from ..sources.scratch import materialize

#: Users of a block and items of a part that meet in one group of the similarity matrix.
USERS_OF_BLOCK, ITEMS_OF_PART = 1024, 4096
#: Components of a vector at most whose product is compiled; the method of more is too long for the JVM's compiler.
COMPILED = 64
#: Tasks of the similarity matrix at most.
MAX_TASKS = 4096



def preprocess(df: DataFrame, min_user: int = 5, min_item: int = 5) -> DataFrame:
    """Without repeated (user, item, time); users with `min_user` rows, then items with
    `min_item` of the rest; one pass each."""
    rows = df.dropDuplicates(["user_id", "item_id", "event_ts"])
    users = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_user)
    rows = rows.join(users, "user_id", "left_semi")
    items = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_item)
    return rows.join(items, "item_id", "left_semi")


def number_rows(df: DataFrame, *order: str | Column, name: str = "index") -> DataFrame:
    """Add a dense 0-based position in the global order of `order` (which should be unique).

    Rows are range-partitioned and sorted; each partition numbers its rows from the
    sum of the counts before it, so that no task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    # Written once: the bounds of a range partitioning are sampled, and both uses need the same.
    ranged = materialize(ranged, "ranged")
    own = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: the running sum is small.
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__before")


def id_map(df: DataFrame, col: str) -> DataFrame:
    """Distinct ids of `col` with a dense 0-based index in their order."""
    return number_rows(df.select(col).where(F.col(col).isNotNull()).distinct(), col, name=f"{col}_index")


def user_history(df: DataFrame, known_items: DataFrame | None = None) -> DataFrame:
    """user_id and its items in order of time (then id) as an array of (event_ts, item_id)."""
    rows = df if known_items is None else df.join(known_items.select("item_id"), "item_id", "left_semi")
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_ts", "item_id"))).alias("history"))


def history_sequence(samples: DataFrame, history: DataFrame, max_len: int = 50, *, causal: bool = True) -> DataFrame:
    """Samples with items (last `max_len` of the history without the sample's item, padded
    with 0) and mask; `causal` leaves out what is not before the sample.

    Samples and histories are ordered together once; a sample looks at the newest rows before
    it.  Only a sample whose own item fills these rows looks through the whole history.
    """
    look = 4 * max_len
    kind = history.schema["history"].dataType.elementType["item_id"].dataType
    row = samples.select(F.struct(*[F.col(f"`{c}`") for c in samples.columns]).alias("s"), F.col("user_id").alias("user"), F.col("event_ts").alias("t"))
    if causal:
        known = history.where("user_id is not null").select(F.col("user_id").alias("user"), F.explode("history").alias("h")).where("h.event_ts is not null and h.item_id is not null")
        events = known.select(F.lit(None).cast(row.schema["s"].dataType).alias("s"), "user", F.col("h.event_ts").alias("t"), F.lit(1).alias("side"), F.col("h.item_id").alias("item"))
        both = row.select("s", "user", "t", F.lit(0).alias("side"), F.lit(None).cast(kind).alias("item")).unionByName(events)
        order = Window.partitionBy("user").orderBy("t", "side", "item")  # a sample comes before events of its time
        near = both.withColumns({"near": F.collect_list("item").over(order.rowsBetween(-look, 0)), "n": F.count("item").over(order.rowsBetween(Window.unboundedPreceding, 0))}).where("side = 0")
    else:
        tail = history.select(F.col("user_id").alias("user"), last_n(F.transform("history", lambda x: x["item_id"]), look).alias("near"), F.size("history").alias("n"))
        near = row.join(tail, "user", "left").withColumns({"near": F.coalesce("near", F.array().cast(f"array<{kind.simpleString()}>")), "n": F.coalesce("n", F.lit(0))})
    others = F.filter("near", lambda x: x != F.col("s.item_id"))
    near = materialize(near.select("s", others.alias("past"), (F.size(others) >= max_len) | (F.col("n") <= F.size("near")) | F.col("s.item_id").isNull()), "near-history").toDF("s", "past", "whole")
    short = near.where("not whole").select("s").join(history.select(F.col("user_id").alias("user"), "history"), F.col("s.user_id") == F.col("user"))
    past = F.filter("history", lambda x: (x["item_id"] != F.col("s.item_id")) & ((x["event_ts"] < F.col("s.event_ts")) if causal else F.lit(True)))
    rows = near.where("whole").select("s", "past").unionByName(short.select("s", F.transform(past, lambda x: x["item_id"]).alias("past")))
    items = last_n(F.transform("past", lambda x: x.cast("long")), max_len)
    rows = rows.withColumn("__items", items)
    size = F.size("__items")
    padded = F.concat("__items", F.array_repeat(F.lit(0).cast("long"), max_len - size))
    mask = F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), max_len - size))
    return rows.select(*[F.col("s")[c].alias(c) for c in samples.columns], padded.alias("items"), mask.alias("mask"), size.alias("history_length"))


def item_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def negative_probs(items: DataFrame, counts: DataFrame, strategy: str = "adaptive") -> DataFrame:
    """item_id and its probability as a negative: uniform, popular or adaptive."""
    weight = {"uniform": F.lit(1.0), "popular": F.col("n").cast("double"), "adaptive": F.when(F.col("n") > 0, 1.0 / (F.col("n") + 1)).otherwise(F.lit(0.0))}.get(strategy)
    if weight is None:
        raise ValueError(f"unknown strategy: {strategy}")
    rows = items.select("item_id").distinct().join(counts, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("item_id", weight.alias("w"))
    total = rows.agg(F.sum("w").alias("total"))
    return rows.join(F.broadcast(total)).select("item_id", F.coalesce(F.try_divide("w", "total"), F.lit(0.0)).alias("p"))


def cumulative(probs: DataFrame) -> DataFrame:
    """item_id, p and its range [lo, hi) of running sums of p in order of item_id.

    Range-partitioned: each part sums its own rows and adds the total of the parts before it.
    """
    parts = int(probs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(probs.where("p > 0").select("item_id", "p").repartitionByRange(parts, "item_id").withColumn("__part", F.spark_partition_id()), "ranged-weights")
    own = Window.partitionBy("__part").orderBy("item_id").rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("__part").agg(F.sum("p").alias("__sum"))
    # One row per part.
    before = totals.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    rows = ranged.withColumn("__upto", F.sum("p").over(own)).join(F.broadcast(before), "__part")
    hi = F.col("__before") + F.col("__upto")
    return rows.select("item_id", "p", (hi - F.col("p")).alias("lo"), hi.alias("hi"))


def sample_negatives(samples: DataFrame, history: DataFrame, probs: DataFrame, n: int = 5, *, seed: int = 42, attempts: int = 40) -> DataFrame:
    """(sample_id, item_id, draw): `n` distinct negatives per sample, none in the user's
    history and not the positive, drawn by weight without replacement.

    Attempt t of a sample is a hash-uniform point that falls into one item's range of the
    running weights; the first `n` distinct eligible items count.  Points find their item by
    a join on equal slices of the weights, of which a heavy item covers several.  A sample
    still short after `attempts` (its eligible items are few or light) goes on by exponential
    keys -ln(u) / p over all items left to it, so that it gets `n` unless fewer are eligible.
    """
    items = materialize(cumulative(probs), "weights")
    size, total = items.agg(F.count(F.lit(1)), F.max("hi")).first()
    slices = max(1, size)
    cut = lambda x: F.floor(x / F.lit(float(total or 1.0)) * slices).cast("long")
    ranges = items.select("item_id", "lo", "hi", F.explode(F.sequence(cut(F.col("lo")), cut(F.col("hi")))).alias("slice"))
    asked = samples.select("sample_id", "user_id", "item_id")

    def points(rows: DataFrame, first: int, last: int) -> DataFrame:
        """(sample_id, drawn): the items of the attempts `first` to `last` in their order."""
        tried = rows.select("sample_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("t"))
        tried = tried.withColumn("at", uniform_hash(F.col("sample_id"), F.col("t"), F.lit(seed)) * F.lit(float(total or 0.0)))
        hits = tried.withColumn("slice", cut(F.col("at"))).join(ranges, "slice").where((F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")))
        drawn = hits.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("t", "item_id"))).alias("drawn"))
        return drawn.withColumn("drawn", F.transform("drawn", lambda x: x["item_id"]))

    seen = history.select("user_id", F.transform("history", lambda x: x["item_id"]).alias("seen"))
    none = F.array().cast(seen.schema["seen"].dataType)
    # Most samples have their items after twice as many points; only the others go on.
    few = min(2 * n, attempts)
    rows = asked.join(points(asked, 1, few), "sample_id", "left").join(seen, "user_id", "left").select(
        "sample_id", F.array_append(F.coalesce("seen", none), F.col("item_id")).alias("taken"), F.coalesce("drawn", none).alias("drawn")
    )
    rows = materialize(rows.select("sample_id", "taken", F.array_except("drawn", "taken").alias("drawn")), "first-points")
    if few < attempts:
        open_ = rows.where(F.size("drawn") < n)
        more = open_.join(points(open_, few + 1, attempts).withColumnRenamed("drawn", "more"), "sample_id", "left")
        more = more.select("sample_id", "taken", F.array_except(F.concat("drawn", F.coalesce("more", none)), "taken").alias("drawn"))
        rows = materialize(rows.where(F.size("drawn") >= n).unionByName(more), "drawn")
    rows = rows.withColumn("drawn", F.slice("drawn", 1, n))
    first = rows.select("sample_id", F.posexplode("drawn").alias("draw", "item_id")).select("sample_id", "item_id", (F.col("draw") + 1).alias("draw"))
    short = rows.where(F.size("drawn") < n)
    # Few samples meet the whole catalog, in parts; a part keeps `n` of a sample.
    met = short.select("sample_id", "taken", "drawn", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("part")).join(items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(64)).cast("int")), "part")
    met = met.where(~F.array_contains("taken", F.col("item_id")) & ~F.array_contains("drawn", F.col("item_id")))
    u = F.greatest(uniform_hash(F.col("sample_id"), F.col("item_id"), F.lit(seed)), F.lit(1e-12))
    best = Window.partitionBy("sample_id").orderBy("key", "item_id")
    rest = met.select("sample_id", "item_id", F.size("drawn").alias("had"), (-F.ln(u) / F.col("p")).alias("key")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= n)
    return first.unionByName(rest.where(F.col("nth") + F.col("had") <= n).select("sample_id", "item_id", (F.col("nth") + F.col("had")).alias("draw")))


def assemble_samples(samples: DataFrame, negatives: DataFrame, user_features: DataFrame, item_features: DataFrame) -> DataFrame:
    """Samples with user and item features and an array of their negatives' features.
    Samples of unknown users or items are dropped (unknown_samples counts them)."""
    item = item_features.select("item_id", F.struct(*[c for c in item_features.columns]).alias("item"))
    user = user_features.select("user_id", F.struct(*[c for c in user_features.columns]).alias("user"))
    packed = negatives.join(item, "item_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("draw", "item"))).alias("negatives"))
    return samples.join(user, "user_id").join(item, "item_id").join(packed, "sample_id", "left")


def unknown_samples(samples: DataFrame, user_features: DataFrame, item_features: DataFrame) -> DataFrame:
    """One row: samples, those of unknown users, of unknown items, and those dropped by either."""
    known = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = samples.join(known(user_features, "user_id", "__u"), "user_id", "left").join(known(item_features, "item_id", "__i"), "item_id", "left")
    no_user, no_item = F.col("__u").isNull(), F.col("__i").isNull()
    return rows.agg(F.count(F.lit(1)).alias("samples"), F.count_if(no_user).alias("unknown_users"), F.count_if(no_item).alias("unknown_items"), F.count_if(no_user | no_item).alias("dropped"))


def split(df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), *, seed: int = 42, mode: str = "shuffled", order: list[str] | None = None) -> DataFrame:
    """Add split (train, validation, test) with exact sizes int(n * ratio).

    shuffled orders by a hash of key and seed, position by `order`, buckets cuts the hash
    itself (no global order, sizes only about right: for very large inputs).
    """
    u = uniform_hash(F.col(key), F.lit(seed))
    name = lambda x, a, b: F.when(x < a, "train").when(x < b, "validation").otherwise("test")
    if mode == "buckets":
        return df.withColumn("split", name(u, ratios[0], ratios[0] + ratios[1]))
    if mode not in ("shuffled", "position"):
        raise ValueError(f"unknown mode: {mode}")
    by = ["__u", key] if mode == "shuffled" else (order or [key])
    rows = number_rows(df.withColumn("__u", u), *by, name="__at")
    n = df.agg(F.count(F.lit(1)).alias("__total"))
    first, second = F.floor(F.col("__total") * ratios[0]), F.floor(F.col("__total") * ratios[0]) + F.floor(F.col("__total") * ratios[1])
    return rows.join(F.broadcast(n)).withColumn("split", name(F.col("__at"), first, second)).drop("__u", "__at", "__total")


def split_sizes(split_rows: DataFrame) -> DataFrame:
    """split and its number of rows."""
    return split_rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def write_splits(split_rows: DataFrame, path: str) -> DataFrame:
    """Write one folder per split (split=train, ...) under `path` and its sizes under
    `path`_sizes; returns the sizes."""
    split_rows.write.mode("overwrite").partitionBy("split").parquet(path)
    spark = split_rows.sparkSession
    split_sizes(spark.read.parquet(path)).coalesce(1).write.mode("overwrite").json(f"{path}_sizes")
    return spark.read.schema("split string, n long").json(f"{path}_sizes")


def shard(df: DataFrame, world_size: int, *order: str) -> DataFrame:
    """Add rank: equal shards in turn; the remainder is dropped."""
    rows = number_rows(df, *order, name="__at")
    n = df.agg(F.count(F.lit(1)).alias("__total"))
    rows = rows.join(F.broadcast(n)).where(F.col("__at") < F.col("__total") - F.col("__total") % world_size)
    return rows.withColumn("rank", (F.col("__at") % world_size).cast("int")).drop("__at", "__total")


def collate(df: DataFrame, batch_size: int, *order: str, col: str = "items") -> DataFrame:
    """Add batch_id and pad `col` with 0 to the longest of its batch, with mask."""
    rows = number_rows(df, *order, name="__at").withColumn("batch_id", F.floor(F.col("__at") / batch_size))
    longest = F.max(F.size(col)).over(Window.partitionBy("batch_id"))
    rows = rows.withColumn("__n", longest).drop("__at")
    short = F.col("__n") - F.size(col)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(col)), F.array_repeat(F.lit(0), short))
    return rows.withColumn("mask", mask).withColumn(col, F.concat(col, F.array_repeat(F.lit(0).cast("long"), short))).drop("__n")


def train_factors(interactions: DataFrame, rank: int = 16, *, seed: int = 42, iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors) of implicit matrix factorization, at unit length.

    Columns: user_id or item_id (of any type; they are indexed for the factorization, which
    takes integers) and embedding.  Rows with a null id take no part.
    """
    counts = interactions.where("user_id is not null and item_id is not null").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("float").alias("n"))
    counts = materialize(counts, "pair-counts")  # read three times; the interactions are put together once
    users, items = (materialize(id_map(counts, c), f"{c}-map") for c in ("user_id", "item_id"))
    ids = counts.join(users, "user_id").join(items, "item_id").select(F.col("user_id_index").cast("int").alias("u"), F.col("item_id_index").cast("int").alias("i"), "n")
    model = ALS(rank=rank, maxIter=iterations, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="n", seed=seed).fit(ids)

    def side(factors: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        return factors.join(ids, F.col("id") == F.col(f"{name}_index")).select(name, unit(F.col("features").cast("array<double>")).alias("embedding"))

    return side(model.userFactors, users, "user_id"), side(model.itemFactors, items, "item_id")


def mean_pool_history(history: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """user_id and the mean vector of the history's items that have one."""
    rows = history.select("user_id", F.explode("history").alias("h")).select("user_id", F.col("h.item_id").alias("item_id"))
    parts = rows.join(item_vectors, "item_id").select("user_id", F.posexplode("embedding").alias("d", "x"))
    means = parts.groupBy("user_id", "d").agg(F.avg("x").alias("x"))
    return means.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("embedding"))


def pair_scores(pairs: DataFrame, users: DataFrame, items: DataFrame, temperature: float = 0.1) -> DataFrame:
    """pairs (user_id, item_id, ...) with score = inner product / temperature."""
    u, i = users.select("user_id", F.col("embedding").alias("__u")), items.select("item_id", F.col("embedding").alias("__i"))
    return pairs.join(u, "user_id").join(i, "item_id").withColumn("score", dot(F.col("__u"), F.col("__i")) / temperature).drop("__u", "__i")


def group_scores(users: DataFrame, items: DataFrame, group: str, temperature: float = 0.1, *, parts: int = 64) -> DataFrame:
    """user_id, item_id and score of every user with every item of the same `group`.

    Vectors meet by group, in `parts` parts of its items, and are scored there: pairs are
    not shuffled.
    """
    tasks = max(parts, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    i = items.select(group, "item_id", F.col("embedding").alias("__i"), F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("__part"))
    u = users.select(group, "user_id", F.col("embedding").alias("__u"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
    i, u = (x.repartition(tasks, group, "__part") for x in (i, u))
    return u.join(i.hint("shuffle_hash"), [group, "__part"]).select("user_id", "item_id", (dot(F.col("__u"), F.col("__i")) / temperature).alias("score"))


def similarity_matrix(users: DataFrame, items: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Scores of every user with every item, which is what is asked for; they meet in blocks.
    For the best items of each user alone take vectors.exact_topk.

    A group joins a block of users in memory to one part of the items.  Vectors of up to
    COMPILED components are one compiled expression, added in the same order as `dot`: half of
    the columns that Spark compiles at most for each side, and an array of the components left.
    """
    conf = items.sparkSession.conf
    count = lambda df: df.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    (n_users, user_width), (n_items, item_width) = count(users), count(items)
    width, tasks = max(user_width or 0, item_width or 0), int(conf.get("spark.sql.shuffle.partitions"))
    plain = width > COMPILED
    columns = min(width, max(0, int(conf.get("spark.sql.codegen.maxFields", "100")) - 8) // 2)
    # Several groups for each task, so that they end together.
    blocks, parts = max(1, -(-n_users // USERS_OF_BLOCK)), max(4 * tasks, -(-n_items // ITEMS_OF_PART))

    def side(df: DataFrame, key: str, name: str, group: Column) -> DataFrame:
        vector = as_doubles(F.col("embedding"))
        at = lambda k: F.coalesce(F.get(vector, k), F.lit(0.0))
        # Components beyond the end are 0 and change no sum; a vector with a null has no size.
        size = F.when(F.forall(vector, lambda x: x.isNotNull()), F.size(vector)).alias(f"{name}_size")
        rest = [F.transform(F.sequence(F.lit(columns), F.lit(width - 1)), at).alias(f"{name}_rest")] if width > columns else []
        own = [vector.alias(name)] if plain else [size, *[at(F.lit(k)).alias(f"{name}{k}") for k in range(columns)], *rest]
        return df.select(key, *own, group.alias("__group")).repartition(max(tasks, min(blocks * parts, MAX_TASKS)), "__group")

    part, block = F.pmod(F.xxhash64("item_id"), F.lit(parts)), F.pmod(F.xxhash64("user_id"), F.lit(blocks))
    left = side(items, "item_id", "i", F.explode(F.sequence(part, part + F.lit((blocks - 1) * parts), F.lit(parts))))
    right = side(users, "user_id", "u", F.explode(F.sequence(block * parts, block * parts + F.lit(parts - 1))))
    pairs = left.join(right.hint("shuffle_hash"), "__group")
    get = lambda name, k: F.col(f"{name}{k}") if k < columns else F.get(F.col(f"{name}_rest"), F.lit(k - columns))
    if plain:
        score = dot(F.col("u"), F.col("i"))
    else:
        score = F.when(F.col("u_size") == F.col("i_size"), reduce(lambda total, k: total + get("u", k) * get("i", k), range(width), F.lit(0.0)))
    return pairs.select("user_id", "item_id", (score / temperature).alias("score"))


def ranking_metrics(scores: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean loss, accuracy and recall over samples with one positive.

    `scores`: sample_id, score, is_positive.  recall@k is null where k exceeds the list.
    """
    top = Window.partitionBy("sample_id")
    rows = scores.select("*", F.max("score").over(top).alias("m"))
    per = rows.groupBy("sample_id").agg(
        (F.max("m") + F.ln(F.sum(F.exp(F.col("score") - F.col("m"))))).alias("log_sum"), F.max(F.when(F.col("is_positive"), F.col("score"))).alias("own"), F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("is_positive")).alias("n_positive"), F.collect_list(F.when(~F.col("is_positive"), F.col("score"))).alias("others"),
    )
    per = per.where("n_positive = 1").withColumn("rank", F.size(F.filter("others", lambda x: x > F.col("own"))) + 1)
    recalls = [F.when(F.min("size") >= k, F.avg((F.col("rank") <= k).cast("double"))).alias(f"recall_{k}") for k in ks]
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("log_sum") - F.col("own")).alias("loss"), F.avg((F.col("rank") == 1).cast("double")).alias("accuracy"), *recalls)
