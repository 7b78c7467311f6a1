"""The pipeline's near-duplicate stage against all pairs of documents."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from signalspark.llm import near_copies


def _shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _kept(rows):
    """Ids that are the smallest of their component of Jaccard similarity 0.8 or more, by all pairs."""
    sets = [_shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                label[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return sorted(min(i for i in g if i is not None) for g in groups.values() if any(i is not None for i in g))


def _documents(seed=5):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(400)])
    rows = []
    for size in (6, 40, 150, 300):
        for _ in range(6):
            base = rng.choice(words, size)
            for changes in (0, 0, 1, 2, 5, 9):
                copy = base.copy()
                copy[rng.integers(0, size, changes if size > 6 else 0)] = "new"
                rows.append((len(rows) + 1, " ".join(copy)))
    hub = rng.choice(words, 200)
    for k in range(60):  # one group whose members reach each other over others only
        copy = hub.copy()
        copy[rng.integers(0, 200, 1 + k % 5)] = "x"
        rows.append((1000 + k, " ".join(copy)))
    return rows + [(2000, ""), (2001, None), (2002, " \n"), (2003, "one two"), (2004, "One TWO"), (2005, "one three"), (None, rows[0][1]), (2006, rows[30][1]), (2006, rows[30][1])]


def test_stage_keeps_one_of_each_near_copy_group(spark):
    rows = _documents()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    assert got.count(None) == 1
    assert sorted(i for i in got if i is not None) == _kept(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_tiles_alone_find_what_shared_minima_do_not(spark, monkeypatch):
    def no_pairs(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["u", "v"])

    rows = _documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "_neighbours", no_pairs)
    got = near_copies.drop_near_copies(docs, tile=16)
    assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == _kept(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == _kept(rows)


def test_repeated_ids_with_other_texts_stay(spark):
    one, two = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, one, 1), (1, two, 2), (1, two, 3), (2, two + " c", 4), (3, one, 5), (None, one, 6), (None, one, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key int")
    got = [(r.doc_id, r.text) for r in near_copies.drop_near_copies(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, one), (1, two), (None, one), (None, one)], key=repr)


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(8)
    for _ in range(200):
        common = rng.integers(0, 2**63, rng.integers(0, 3000), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(1, 800), dtype=np.uint64)])) for _ in range(2))
        apart = int(near_copies._apart(near_copies.sketch(a)[None, :], near_copies.sketch(b)[None, :])[0])
        assert apart <= len(np.setxor1d(a, b))


def test_close_but_not_similar_texts_emit_no_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    rows = []
    for k in range(60):  # near in SimHash, Jaccard about 0.6
        own = np.unique(np.concatenate([base[rng.random(400) < 0.87], rng.integers(0, 2**63, 50, dtype=np.uint64)]))
        rows.append((near_copies._simhash(own), k, k, len(own), bytearray(near_copies.sketch(own).tobytes())))
    frame = spark.createDataFrame(rows, "fp long, sid long, label long, size long, sketch binary")
    assert near_copies._near_pairs(frame, 40, 16).count() < 60
