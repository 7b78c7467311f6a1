"""URL filters, importance resampling and ranked lexical search against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from signalspark.llm import byte_words, importance, lexical, queries, url_filters
from signalspark.llm.oracle import ORACLE
from tools.compare import TABLES, plain

FOLDER = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def _texts(n=400, seed=3):
    """Texts over a skewed vocabulary, a third of them copies, and odd rows; ids repeat and may be null."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ärger", "naïve", "x" * 16, "y" * 17, "z" * 90, "日本語", "U.S.", "e-mail"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))), 7, "clash") for k in range(n)]
    rows += [(n + k, rows[5][1], 7, "clash") for k in range(n // 3)]
    odd = [None, "", "   ", "...", "\x00\x01", "One", "ALL CAPS and\nlines", "w1 " * 20_000 + "w2", "ÀÉ" * 50]
    rows += [(2000 + k, t, 7, "clash") for k, t in enumerate(odd)]
    return rows + [(None, rows[1][1], 7, "clash"), (3, "w1 w2 another text of this id" * 9, 7, "clash"), rows[9], rows[9]]


DOCS = "doc_id long, text string, n_words int, weight string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_texts(), DOCS).repartition(5)


@pytest.mark.parametrize("name", ["op11_url_filters", "op12_importance_resampling", "op13_ranked_search"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, FOLDER), con.sql(ORACLE[name])
    cols = sorted(df.columns)
    order = [rel.columns.index(c) for c in cols]
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr) and ours


def test_words_of_columns():
    texts = [t for _, t, *_ in _texts()]
    whole = [(k, w) for k, t in enumerate(texts) for w in words(t)]
    for kind in (pa.string(), pa.large_string()):
        for a, b in ((0, len(texts)), (3, 90), (400, 400), (530, len(texts))):
            found = byte_words.byte_words(pa.array(texts, kind)[a:b])
            assert [(int(r) + a, found.word(k)) for k, r in enumerate(found.rows)] == [x for x in whole if a <= x[0] < b]
    known = sorted({w for _, w in whole})[::2]
    number = {w: k for k, w in enumerate(known)}
    found = byte_words.byte_words(pa.array(texts))
    assert byte_words.Vocabulary(known).find(found).tolist() == [number.get(w, -1) for _, w in whole]
    assert set(byte_words.Vocabulary([]).find(found).tolist()) == {-1}


def _importance(rows, target, percent=25, buckets=10_000, seed=7):
    def features(text):
        own = words(text)
        return Counter(zlib.crc32(f) % buckets for f in own + [a + b" " + b for a, b in zip(own, own[1:])])

    source, wanted = [features(t) for _, t, *_ in rows], [features(t) for t in target]
    s, t = sum(source, Counter()), sum(wanted, Counter())
    ratio = lambda b: ((t[b] + 1.0) * (sum(s.values()) + buckets)) / ((s[b] + 1.0) * (sum(t.values()) + buckets))
    gain = {b: math.floor(1000 * math.log(ratio(b))) for b in s}
    out = []
    for (i, text, *_), own in zip(rows, source):
        n = sum(own.values())
        weight = sum(gain[b] * c for b, c in own.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter((*r[:5], k + 1) for k, r in enumerate(able[: len(able) * percent // 100]))
    return out, drawn


@pytest.mark.parametrize("share", [1e-4, 0.02, 0.9])
def test_importance_resampling(spark, docs, share):
    target = ["w1 w2 w3 naïve", "Ärger w1", None, "unseen words here"]
    got = importance.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), head_share=share).collect()
    rows, drawn = _importance(_texts(), target)
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, sum(drawn.values()) + 1))
    # Rows that are equal in all but the text of one id may take either rank.
    assert Counter(tuple(r) for r in got if r["rank"]) == drawn


def test_importance_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], DOCS)
    assert importance.importance_resample(none, docs).count() == 0
    out = importance.importance_resample(docs, none).collect()
    assert Counter(tuple(r)[:5] for r in out) == Counter(_importance(_texts(), [])[0])


def test_head_is_bounded_and_holds_what_is_frequent():
    rng = np.random.default_rng(5)
    texts = [" ".join(["common"] * 30 + [f"r{x}" for x in rng.integers(0, 10**9, 300)]) for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10])], ["text"]) for k in range(0, 200, 10)]
    rows = [r for b in importance._frequent(100)(iter(batches)) for r in b.to_pylist()]
    assert sum(r["kind"] == 1 for r in rows) <= 200 and sum(r["kind"] == 2 for r in rows) <= 200
    most = max((r for r in rows if r["kind"] == 1), key=lambda r: r["n"])
    assert np.uint64(most["a"]).tobytes() == b"common\0\0" and 6000 - 66_000 / 100 <= most["n"] <= 6000


def _ranked(rows, items, k=10):
    docs = [(i, words(t)) for i, t, *_ in rows]
    docs = [(i, Counter(w), len(w)) for i, w in docs if w]
    n, length = len(docs), sum(x[2] for x in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in docs:
            m = 25 + 75 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if w in c)
            scores.append((-score, i is None, i or 0))
        best = sorted(x for x in scores if x[0] < 0)[:k]
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return sorted(out, key=repr)


ITEMS = [(0, "w1 w2 w59"), (1, "Naïve ärger; E-MAIL u.s."), (2, "nothing known"), (3, None), (4, ""), (None, "w40 w41 w41"), (5, "y" * 17 + " " + "z" * 90), (6, "w0"), (7, "w1 w2 another text"), (6, "w30"), (8, " ".join(f"w{k}" for k in range(60)) * 30)]


@pytest.mark.parametrize("bucket, part, per_block", [(2048, 32768, 1024), (16, 40, 3)])
def test_ranked_search(spark, docs, monkeypatch, bucket, part, per_block):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "PART", part)
    monkeypatch.setattr(lexical, "ITEMS", per_block)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, score int")
    got = lexical.ranked_search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _ranked(_texts(), ITEMS)


def test_ranked_search_of_empty_tables(spark, docs):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([], DOCS)
    assert lexical.ranked_search(none, items).count() == 0
    assert lexical.ranked_search(docs, items.where("false")).count() == 0
    assert lexical.ranked_search(docs.where("doc_id in (2000, 2001)"), items).count() == 0


def test_bounds_leave_few_documents():
    rng = np.random.default_rng(1)
    sizes = rng.integers(20, 60, 2000)
    terms = np.concatenate([np.sort(rng.choice(500, s, replace=False)) for s in sizes])
    impacts = rng.integers(1, 10**6, len(terms))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    lengths = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, edges[:-1]))
    bucket = lexical.Bucket(lengths, sizes, terms, impacts)
    query, weights = np.arange(0, 200, 10), np.sort(rng.integers(1, 20_000, 20))[::-1]
    weight_of = np.zeros(500, np.int64)
    weight_of[query] = weights
    exact = np.array([(weight_of[terms[a:b]] * impacts[a:b]).sum() for a, b in zip(edges, edges[1:])])
    assert np.array_equal(bucket.scores(np.arange(2000), weight_of), exact)
    least = int(np.sort(exact)[-10])
    left = bucket.survivors(query, weights, least)
    assert set(np.flatnonzero(exact >= least)) <= set(left.tolist()) and len(left) < 100
    assert len(bucket.survivors(query, weights, int(lengths.max() * np.sqrt((weights.astype(float) ** 2).sum()) * 1.01))) == 0


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: URL, host, path, rule.
CASES = [
    ("http://A.B.Example.NET/en/1?x=1", "a.b.example.net", "/en/1", "example.net/en/"),
    ("http://example.net/EN/1", "example.net", "/EN/1", "net/"),
    ("http://notexample.net/en/1#x/y", "notexample.net", "/en/1", "net/"),
    ("https://net", "net", "", None),
    ("https://net/", "net", "/", "net/"),
    ("https://x.net?/en/", "x.net", "", None),
    ("https://www.example.com/de/#/", "www.example.com", "/de/", "example.com/de/"),
    ("https://example.com/de", "example.com", "/de", None),
    ("https://a.org/fr/x?y#z", "a.org", "/fr/x", "org/fr/"),
    ("https://b.aorg/fr/", "b.aorg", "/fr/", None),
    ("ftp://u://v/w", "u:", "//v/w", None),
    ("https://ÄB.org/\nfr", "Äb.org", "/\nfr", None),
    ("no scheme.net/", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("https://long.example/" + "a-b/" * 40_000, "long.example", "/" + "a-b/" * 40_000, None),
]


def _pages(n=1200, seed=11):
    rng = random.Random(seed)
    pages, labels = [], []
    for k in range(n):
        host, path, query = rng.choice(["casino-win", "spam-farm", "good", "fine", "news"]), rng.choice(["en", "de", "fr"]), rng.choice(["", "?ref=x", "?page=2"])
        url = f"https://{rng.choice(['www.', 'm.', ''])}{host}.example.{rng.choice(['com', 'org'])}/{path}/{k}{query}"
        chance = 0.9 if host == "casino-win" or (host == "spam-farm" and path == "en" and query == "?ref=x") else 0.1
        pages.append((k, url, 1))
        if k % 3:
            labels.append((k, 1, int(rng.random() < chance), "clash"))
    same = "https://hot.example.com/" + "/".join(f"t{k}" for k in range(80))
    pages += [(n + k, same, 1) for k in range(n // 2)] + [(None, pages[0][1], 1), pages[1], pages[1]]
    labels += [(n + k, 1, 0, "clash") for k in range(n // 2)] + [(1, 0, 0, "clash"), (2, None, None, "clash"), (None, 0, 1, "clash")]
    return pages, labels


def _mined(pages, labels):
    marks = {}
    for i, quality, toxic, _ in labels:
        if i is not None:
            marks[i] = marks.get(i, False) or toxic == 1 or quality == 0
    known = [(url_filters.url_tokens(u)[: url_filters.MAX_TOKENS], marks[i]) for i, u, _ in pages if i in marks]
    least, share = max(5, math.ceil(0.002 * len(known))), sum(b for _, b in known) / len(known)
    counts = Counter(t for own, _ in known for t in own if len(t) <= 64)
    n, hits = Counter(), Counter()
    for own, bad in known:
        items = sorted((t for t in own if counts[t] >= least), key=lambda t: (counts[t], t))[:12]
        for size in (1, 2, 3):
            for rule in itertools.combinations(sorted(items), size):
                n[rule] += 1
                hits[rule] += bad
    z = url_filters.QUANTILE
    bound = lambda h, m: (h / m + z * z / (2 * m) - z * math.sqrt(h / m * (1 - h / m) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return {r: (n[r], hits[r]) for r in n if hits[r] >= least and 2 * hits[r] >= n[r] and bound(hits[r], n[r]) > share}


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "clash") for k, (u, *_) in enumerate(CASES)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int, n string")
    verdicts = {f"{h}{p}": v for v, h, p in RULES}
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, labels, RULES).collect()}
    for k, (_, host, path, rule) in enumerate(CASES):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdicts.get(rule, "allow"))
    assert url_filters.filter_urls(pages.limit(0), labels, RULES).count() == 0


def test_mined_url_rules(spark):
    pages, labels = _pages()
    frame = spark.createDataFrame(pages, "page_id long, url string, verdict int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, url string")
    expected = _mined(pages, labels)
    assert ("h:casino",) in expected and ("h:spam", "p:en", "q:ref") in expected and len(expected) > 20
    joined = frame.join(marks.where("doc_id is not null").groupBy("doc_id").agg({"toxic": "max", "quality": "min"}).toDF("page_id", "t", "q"), "page_id")
    found, _ = url_filters.mine_rules(joined.selectExpr("url", "coalesce(t = 1 or q = 0, false) as bad"))
    assert {tuple(r["tokens"]): (r["n"], r["hits"]) for r in found.collect()} == expected
    rows = url_filters.filter_urls(frame, marks, RULES).collect()
    assert Counter((r["page_id"], r["url"]) for r in rows) == Counter(p[:2] for p in pages)
    for r in rows:
        own = set(url_filters.url_tokens(r["url"]))
        caught = any(own.issuperset(rule) for rule in expected)
        assert r["rule"] or (r["verdict"] == "block") == caught == (r["mined"] is not None)
        assert not (r["url"] and "casino" in r["url"]) or r["verdict"] == "block" or r["rule"]
