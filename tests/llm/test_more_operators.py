"""Vector, license and SentencePiece operators, and the pipeline."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from signalspark.llm import ann, bitsliced, license_scan, queries, sentence_pieces
from signalspark.llm.license_templates import TEMPLATES
from signalspark.llm.vector_blocks import Block

from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _vectors(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    v = centres[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:160] = v[100]  # a group of equal vectors
    rows = [(int(i), [float(np.float32(x)) for x in r], 1, "clash") for i, r in enumerate(v)]
    odd = [(2000, None), (2050, [None] * dim), (2100, [NAN] * dim), (2150, [INF] + [0.0] * (dim - 1)), (2200, [0.0] * dim), (2250, []), (None, [1.0] * dim), (2300, [1.0, 2.0]), (2301, [1.0, 2.5])]
    rows += [(i, x, 1, "clash") for i, x in odd]
    return rows + [rows[7], rows[50]]  # repeated rows


SCHEMA = "vec_id long, embedding array<float>, label int, v string"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(_vectors(), SCHEMA)


def _usable(zero):
    return [(i, np.array(v)) for i, v, *_ in _vectors() if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def _by_query(rows):
    """Lists of (vec_id, score) by query id, one for each row of the query, in any order."""
    lists = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, {}).setdefault(r.rank, []).append((r.vec_id, r.score))
    return lists


def test_nearest(spark, vectors):
    known = _usable(zero=False)
    got = _by_query(ann.nearest(vectors, F.col("id") % 50 == 0).collect())
    hits = total = 0
    for q in {i for i, _ in known if i % 50 == 0}:
        copies = [at for at, (i, _) in enumerate(known) if i == q]
        for place, at in enumerate(copies):
            near = sorted((float(np.sqrt(((known[at][1] - v) ** 2).sum())), i) for k, (i, v) in enumerate(known) if k != at and len(v) == len(known[at][1]))[:10]
            if not near:
                continue
            assert sorted(got[q]) == list(range(1, len(near) + 1)) and all(len(x) == len(copies) for x in got[q].values())
            found = {got[q][r][place] for r in got[q]}
            hits += sum(any(i == j and abs(d - s) < 1e-12 for j, s in found) for d, i in near)
            total += len(near)
    assert hits / total >= 0.9
    assert [got[100][r][0][0] for r in range(1, 11)] == list(range(101, 111))
    assert any(i == 50 and s == 0 for i, s in got[50][1])  # the other row of this id
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("dim", [1, 2, 5, 64, 300])
def test_threshold_fits_the_dimension(dim):
    chosen, threshold = ann.directions(dim, 42)
    assert chosen.shape == (dim, ann.PROJECTIONS) and 0 < threshold <= ann.PROJECTIONS
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((500, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert ((np.abs(v @ chosen) <= ann.HALF_WIDTH).sum(axis=1) >= threshold).mean() > 0.85


def _measure(v, asked, k=10, sample=4096):
    """Recall and share verified of a search in blocks, with the radius of a sample."""
    rng = np.random.default_rng(0)
    row = np.arange(len(v))
    chosen = rng.permutation(len(v))[:sample]
    block = lambda own, radius: Block(row[own], row[own], v[own], row[asked], v[asked], radius)
    radius = ann.sample_radius(block(np.sort(chosen), None), k)
    best, verified = [[] for _ in asked], []
    for own in np.array_split(row, -(-len(v) // 2048)):
        for q, i, d in zip(*ann.search_block(block(own, radius), k, verified=verified)):
            best[q].append((d, own[i]))
    hits = 0
    for q, found in zip(asked, best):
        apart = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        apart[q] = np.inf
        hits += len({i for _, i in sorted(found)[:k]} & set(np.argsort(apart)[:k].tolist()))
    return hits / (k * len(asked)), sum(verified) / (len(asked) * len(v))


def test_index_verifies_few(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], float)
    asked = [k for k, r in enumerate(rows) if r.vec_id % 100 == 0]
    recall, share = _measure(v, asked)
    assert recall >= 0.9 and share < 0.1
    recall, share = _measure(v * 37.0, asked)
    assert recall >= 0.9 and share < 0.1
    recall, share = _measure(np.random.default_rng(1).standard_normal((12_000, 64)), list(range(0, 12_000, 600)))
    assert recall >= 0.9 and share < 0.1


def test_exact_topk(spark, vectors):
    known = [(i, np.floor(256 * v).astype(np.int64)) for i, v in _usable(zero=True)]
    want = []
    for at, (q, x) in enumerate(known):
        if q % 50 == 0:
            best = sorted((-int(x @ v), i) for k, (i, v) in enumerate(known) if k != at and len(v) == len(x))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best[:5])]
    got = [tuple(r) for r in bitsliced.exact_topk(vectors, F.col("id") % 50 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert bitsliced.exact_topk(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0


def test_exact_topk_keeps_large_components(spark):
    rows = [(0, [1e6, -2.0]), (1, [3e5, 1.0]), (2, [-4e7, 0.5]), (2, [2e7, 0.5]), (3, [1e6, -2.0])]
    got = bitsliced.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    best = sorted((-sum(a * b for a, b in zip(whole[0][1], v)), i) for i, v in whole[1:])
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    with pytest.raises(Exception, match="64 bits"):
        bitsliced.exact_topk(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"), F.col("id") == 0).collect()


@pytest.mark.parametrize("seed", range(4))
def test_bit_sliced_block(seed):
    rng = np.random.default_rng(seed)
    n, dim, k = int(rng.integers(1, 300)), int(rng.integers(1, 9)), int(rng.integers(1, 7))
    v = rng.integers(-(10 ** int(rng.integers(1, 7))), 50, (n, dim))
    ids = np.sort(rng.choice(10_000, n, replace=False))
    asked = np.concatenate([ids[:5], [20_000]])
    queries_ = np.concatenate([v[:5], rng.integers(-9, 9, (1, dim))])
    q, i, s = bitsliced.search_block(Block(ids, ids, v.astype(float), asked, queries_.astype(float), None), k)
    want = []
    for a, x in zip(asked, queries_):
        best = sorted((-int(x @ y), int(b)) for b, y in zip(ids, v) if b != a)[:k]
        want += [(int(a), b, -t) for t, b in best]
    assert sorted(zip(asked[q].tolist(), ids[i].tolist(), s.tolist())) == sorted(want)


# -- licenses ----------------------------------------------------------------------------


def test_license_scan(spark):
    apache, mit = TEMPLATES["apache-2.0"], TEMPLATES["mit"]
    changed = mit.replace("free of charge", "at no charge").replace("sublicense, ", "")
    rows = [
        (1, "some words before " + apache + " and after"), (2, "x\n# " + "\n# ".join(re.findall(r".{1,60}(?:\s|$)", changed))), (3, None), (4, ""),
        (5, "Released under the MIT License. And: Licensed under CC BY-NC 4.0."), (None, "released UNDER the mit license"), (6, "the license of the"),
        (7, "İİİ ok Released under the MIT License"), (5, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = license_scan.scan_licenses(docs).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert found == {(1, "apache-2.0"), (2, "mit"), (5, "mit-line"), (5, "cc-by-nc-4.0-line"), (None, "mit-line"), (7, "mit-line")}
    text = dict(rows[:5])
    for r in got:
        if r.doc_id in (1, 2):
            assert r.coverage > 0.9
            assert text[r.doc_id][r.span_start : r.span_end].lower().startswith(("licensed under", "permission is"))
        if r.doc_id == 7:
            assert rows[7][1][r.span_start : r.span_end] == "Released under the MIT License"
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_adjacent_and_changed_short_notices():
    index = license_scan.Index(TEMPLATES)
    text = "a.js Released under the MIT License. b.js Released under the MIT License. c Released under the MIT License."
    found = license_scan.scan_text(text, index, 0.8, license_scan.BAND)
    assert [f[0] for f in found] == ["mit-line"] * 3 and len({f[3] for f in found}) == 3
    for name in (n for n in TEMPLATES if n.endswith("-line")):
        words = re.findall(r"\w+", TEMPLATES[name])
        for k in range(len(words)):
            changed = " ".join([*words[:k], "zzz", *words[k + 1 :]])
            assert [f[0] for f in license_scan.scan_text(f"x y {changed} z", index, 0.8, license_scan.BAND)] == [name], (name, k)


@pytest.mark.parametrize("seed", range(3))
def test_scan_against_alignment_of_everything(spark, seed):
    """Every template aligned at every diagonal, without index: the same notices are found."""
    rng = np.random.default_rng(seed)
    names = ["mit-line", "apache-2.0-line", "cc-by-nc-4.0-line", "mpl-2.0", "isc"]
    chosen = {n: TEMPLATES[n] for n in names}
    rows = []
    for k in range(12):
        parts = [" ".join(rng.choice(["the", "license", "of", "code", "free", "software", "under"], rng.integers(3, 25)))]
        for n in rng.choice(names, rng.integers(0, 3), replace=False):
            words = TEMPLATES[n].split()
            parts += [" ".join(w for w in words if rng.random() > 0.06), " ".join(rng.choice(["plain", "words", "here"], 20))]
        rows.append((k, " ".join(parts)))
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=chosen).collect()}
    index, want = license_scan.Index(chosen), set()
    for k, text in rows:
        ids = [index.vocabulary.get(w, 0) for w in re.findall(r"\w+", text.lower())]
        for t, template in enumerate(index.templates):
            best = max(license_scan.align(template, ids, d, license_scan.BAND)[1] for d in range(-len(template), len(ids), 4))
            if best / len(template) >= 0.8:
                want.add((k, names[t]))
    assert want and got == want


def _full_alignment(a, b):
    """Largest local alignment score without index or band."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
            best = max(best, row[-1])
        above = row
    return best


@pytest.mark.parametrize("seed", range(5))
def test_banded_alignment_equals_full(seed):
    rng = np.random.default_rng(seed)
    template = rng.integers(1, 30, 60).tolist()
    words = [int(x) for x in rng.integers(30, 60, 20)] + [t for t in template if rng.random() > 0.05] + [99] * 10
    for _ in range(3):
        words.insert(int(rng.integers(20, 70)), 77)
    assert license_scan.align(template, words, 20, 12)[0] == _full_alignment(template, words)


def test_license_counts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()}
    lines = {n: TEMPLATES[n] for n in TEMPLATES if n.endswith("-line")}
    want = {(r.doc_id, n) for r in docs.collect() for n, line in lines.items() if line in r.text}
    assert want and want <= got


# -- SentencePiece -----------------------------------------------------------------------

ODD_TEXTS = ["", " ", "  a  b ", "a\nb\tc", "<s> hi", "ﬁ Ⅳ ｆ", "é é", "▁x▁", "\xa0x", "中文 \U0001f600", "a\x00b", "x" * 3000, "The quick brown fox, unbelievable!\n\nNew    line"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark, library):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (2, texts[2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = queries.tokenizer_file("piece_bpe_32k.model")
    encoded = sentence_pieces.encode(docs, path)
    for r in sentence_pieces.decode(encoded, path).collect():
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == library.encode(r.text)
            assert r.decoded == library.decode(r.ids) == r.text.replace("▁", " ")
    assert sentence_pieces.encode(docs.limit(0), path).count() == 0
    apart = sentence_pieces.ids_digest(sentence_pieces.decode(encoded, path))
    assert sorted(map(repr, sentence_pieces.round_trip(docs, path).select(*apart.columns).collect())) == sorted(map(repr, apart.collect()))


def test_unigram_viterbi_against_search():
    words = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a"]
    scores = [-3.0, -3.1, -2.9, -4.0, -4.2, -5.5, -4.5, -2.0, -3.3]
    model = sentence_pieces.Pieces(["<unk>", *words], [0.0, *scores], [], 0, set(), True)
    score = dict(zip(words, scores))

    def best(w):
        if not w:
            return 0.0, []
        options = []
        for k in range(1, len(w) + 1):
            if w[:k] in score or k == 1:
                rest = best(w[k:])
                options.append((score.get(w[:k], min([0.0, *scores]) - 10) + rest[0], [w[:k], *rest[1]]))
        return max(options, key=lambda o: o[0])

    rng = np.random.default_rng(0)
    for text in ["".join(rng.choice(list("abcx "), int(rng.integers(1, 12)))) for _ in range(60)]:
        ids = model.encode(pa.array([text]))[0].astype(int)
        want = [u for unit in model.units.findall("▁" + text.replace(" ", "▁")) for u in best(unit)[1]]
        total = sum(score.get(u, min(scores) - 10) for u in want)
        assert sum(scores[i - 1] if i else min(scores) - 10 for i in ids) == pytest.approx(total)


def test_pairs_share_a_slot(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "PAIR_SLOTS", 64)
    monkeypatch.setattr(sentence_pieces, "CACHE_WORDS", 300)
    model = sentence_pieces.load_pieces.__wrapped__(queries.tokenizer_file("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    syllables = "eux ach ti an ber ion the re wh qu é ß 7 ! \n  x".split(" ")
    texts = [" ".join("".join(rng.choice(syllables, rng.integers(0, 6))) for _ in range(30)) for _ in range(60)] + ["長い文字列" * 40, "x" * 500]
    ids, offsets = model.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [library.encode(t) for t in texts]


def test_no_pieces():
    model = sentence_pieces.Pieces(["<unk>"], [0.0], [], 0, set(), False)
    assert model.encode(pa.array(["ab c", None, ""]))[0].tolist() == [0] * 5


def test_op9_digests(spark, library):
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op9_sentence_pieces(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(text[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# -- pipeline ----------------------------------------------------------------------------


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, name)
        sizes.append(docs.count())
    assert before.count() > sizes[0] == sizes[1] > sizes[2] == sizes[3]
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.select("doc_id").distinct().count() == sizes[3]
    assert sorted(map(repr, last.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(repr, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect())
    )
