"""Lexical search, nearest neighbours and spelling variants against brute force, and on awkward tables."""

import collections
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from compare import close, table_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.llm import lexical, nearest, queries, spelling

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, score int, term string, n long, row int, bucket string, word string, id string"
TEXTS = ["The cat, the CAT and a dog", None, "", " \n!! ", "the cat the cat the cat", "İstanbul ÀÉ 中文 a_b x²", "dog " * 5000 + "cat", "The cat, the CAT and a dog", "zebra", "the"]


@pytest.fixture(scope="module")
def odd(spark):
    ids = [5, 1, 2, 3, 9, 7, 8, 5, None, 4]
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "b", "w", "i") for i, t in zip(ids, TEXTS)], DOCS)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


# ---- lexical ----


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_terms(text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert [t.decode() for t in lexical.terms(text)] == TERM.findall(text.translate(LOWER))


def brute_search(docs, items, k):
    held = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, collections.Counter(t), len(t)) for i, t in held if t]
    n, length = len(held), sum(x[2] for x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for doc, c, size in held:
            m = 100 - 25 + (25 * size * n) // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "cat cat DOG"), (2, None), (3, "!!"), (4, "nothing here"), (5, "The the a zebra"), (None, "中文"), (1, "cat cat DOG")]


@pytest.mark.parametrize("k", [1, 2, 20])
@pytest.mark.parametrize("most", [0, 200_000])
def test_lexical(spark, odd, k, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("x"))
    found = lexical.index(odd, buckets=3, salts=2)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(found, items, k, most_broadcast=most).collect()), key=str)
    assert got == brute_search([(r.doc_id, r.text) for r in odd.collect()], ITEMS[:-1], k)
    assert lexical.search(found, items.limit(0)).count() == 0 and lexical.search(lexical.index(odd.limit(0)), items, k).count() == 0


def test_lexical_query(spark, db):
    got, want = queries.op11_lexical(spark, SF).toPandas(), db.sql(lexical.ORACLE).df()
    assert list(got.columns) == ["item_id", "rank", "doc_id", "score"] and close(table_rows(got), table_rows(want))
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, brute_search([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items], 20)))
    assert dict(got.dtypes.astype(str)) == {"item_id": "int64", "rank": "int32", "doc_id": "int64", "score": "int64"}


def test_lexical_index_is_whole(spark):
    """The index has every term of every document, each in its bucket, and sums are made where the postings are: one exchange of them by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = lexical.index(docs)
    want = collections.Counter(t for r in docs.collect() for t in set(TERM.findall(r.text.translate(LOWER))))
    got = {r.term: (r.n, r.buckets) for r in of.postings.where("term is not null").groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("bucket").alias("buckets")).collect()}
    assert got == {t: (n, 1) for t, n in want.items()} and of.documents == docs.count()


# ---- nearest neighbours ----


def brute_nearest(rows, asked, k):
    out = {}
    for q, (i, v) in enumerate(rows):
        if asked(i):
            d = [(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j is None, j or 0) for p, (j, w) in enumerate(rows) if p != q]
            out.setdefault(i, []).append([(s, None if none else j) for s, none, j in sorted(d)[:k]])
    return out


def found_of(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_nearest_odd(spark):
    nan, inf = math.nan, math.inf
    good = [(100, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 4.0]), (3, [-1.0, 0.0, 0.0]), (200, [0.5, 0.5, 0.5]), (4, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.5]), (5, [2.0, 2.0, 3.0]), (5, [1.0, 2.0, 4.0])]
    bad = [(300, None), (0, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [-inf, 1.0, 1.0]), (400, [1.0, 2.0]), (10, []), (11, [None, None, None])]
    df = spark.createDataFrame([(i, v, 1, 2, "p") for i, v in good + bad], "vec_id long, embedding array<double>, score int, row int, part string")
    for k, size in ((10, 4096), (3, 1), (1, 2)):
        got = found_of(nearest.search(nearest.index(df), F.col("id") % 100 == 0, k, slice_rows=size))
        assert {q: [v] for q, v in got.items()} == brute_nearest(good, lambda i: i is not None and i % 100 == 0, k)
    assert nearest.search(nearest.index(df.limit(0)), F.lit(True)).count() == nearest.search(nearest.index(df.where("vec_id = 100")), F.lit(True)).count() == 0
    assert nearest.search(nearest.index(df), F.col("id") == 300).count() == 0


def test_nearest_copies(spark):
    """A third of all rows is one vector, and its copies are queries as well."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [float(x) for x in rng.integers(1, 9, 2)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found_of(nearest.search(nearest.index(df, part_rows=16), F.col("id") % 100 == 0, slice_rows=64))
    want = brute_nearest(rows, lambda i: i % 100 == 0, 10)
    assert got[0] == want[0][0] and got[300] == want[300][0] and set(got) == set(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=2, max_size=40), st.integers(1, 12))
def test_nearest_of(points, k):
    x = np.array(points, float)
    ids = np.arange(len(x))[::-1].copy()
    i, j, s = nearest.nearest_of(x, np.arange(len(x)), x, ids, np.arange(len(x)), k)
    for q in range(len(x)):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[p], ids[p], p) for p in range(len(x)) if p != q)[:k]
        assert [(s[n], ids[j[n]], j[n]) for n in np.flatnonzero(i == q)] == want


def test_balanced_parts():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((125, 4)) + 8 * c for c in np.eye(4)])
    near = np.argsort(nearest.squared(x, x) + np.eye(500) * 1e9, axis=1)[:, :5]
    a, b = np.repeat(np.arange(500), 5), near.ravel()
    part = nearest.balanced(500, np.concatenate([a, b]), np.concatenate([b, a]), 2)
    assert np.bincount(part).tolist() == [125] * 4 and (part[a] != part[b]).mean() < 0.02  # the four clouds
    assert nearest.balanced(7, np.array([], int), np.array([], int), 1).tolist().count(0) in (3, 4)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_nearest_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    out = queries.op12_nearest(spark, path)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, hit, total = found_of(out), 0, 0
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 100 == 0)
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = {int(ids[n]) for n in np.lexsort((ids, d))[:10]}
        hit, total = hit + len(best & {v for _, v in found}), total + 10
        assert len(found) == 10 and found == sorted(found) and all(s == d[ids == v][0] for s, v in found)
    assert hit / total >= 0.9


def test_routes_reach_several_parts_of_many(spark):
    """Clouds far apart are told apart: queries go to few parts, and hardly anything is missed."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.standard_normal(8) + 10 * np.eye(8)[i % 8]]) for i in range(2400)]
    of = nearest.index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = np.array([v for _, v in rows])
    row, _ = of.model.routes(x[::100])
    assert of.model.parts == 16 and np.bincount(row).mean() <= 6
    got, want = found_of(nearest.search(of, F.col("id") % 100 == 0)), brute_nearest(rows, lambda i: i % 100 == 0, 10)
    assert np.mean([len(set(got[q]) & set(want[q][0])) / 10 for q in want]) >= 0.9


# ---- spelling ----


def brute_words(docs, every=199):
    n = collections.Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def as_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAzZéÉ×÷ÿĀ 1-_\n中🙂ß", max_size=40))
def test_runs(text):
    assert [r.decode("latin-1") for r in spelling.runs(text)] == [r.translate(LOWER) for r in RUN.findall(text)]


def test_word_counts(spark, odd):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["Étoiles", "etoiles", "étoile", "planet", "PLANETS", "abc", "ÿÿÿÿÿÿ", "aaaaaaa"], 40)) for _ in range(60)] + [None, "", "planet"]
    docs = [(None if k % 9 == 0 else k % 20, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string")
    for every in (1, 3, 199):
        assert {r.word: r.n for r in spelling.word_counts(df, every=every).collect()} == brute_words(docs, every)
    assert spelling.word_counts(df.limit(0)).count() == 0 and spelling.word_counts(odd.where("text is null")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(alphabet="abé", min_size=1, max_size=6), st.integers(1, 2000), min_size=1, max_size=40))
def test_near_in_one_task(words):
    """The vectors of keys and the sorted runs give every pair one apart, and no other."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
    rows = pa.Table.from_batches(list(spelling._keyed(iter([batch])))).sort_by("key")
    for size in (1, 7, 10_000):
        near, best = collections.Counter(), {}
        for b in spelling._near(iter(rows.to_batches(max_chunksize=size))):
            for w, k, n, v in zip(*(c.to_pylist() for c in b.columns)):
                near[w] += k
                best[w] = min(best.get(w, (0, "")), (-n, v))
        want = {w: [v for v in words if one_apart(w, v)] for w in words}
        assert near == {w: len(v) for w, v in want.items() if v}
        assert best == {w: min((-words[x], x) for x in v) for w, v in want.items() if v}


def test_strings_decide_where_keys_collide():
    """Rows of different words that have one key by chance don't become near."""
    group = [(0, "planet", 9, 2, 2), (0, "plonet", 90, 2, 2), (0, "zebras", 50, 2, 2), (0, "abcdefg", 7, -2, 6), (0, "abcdef", 8, -1, 0), (0, "qrstuv", 8, -1, 0)]
    assert sorted(spelling._group(group)) == [("abcdef", 1, 7, "abcdefg"), ("abcdefg", 1, 8, "abcdef"), ("planet", 1, 90, "plonet"), ("plonet", 1, 9, "planet")]


def test_variants(spark):
    words = {"colour": 5000, "color": 9, "colours": 700, "colxour": 30, "colxxour": 6, "colouur": 1000, "colouurs": 10, "couleur": 7, "ab": 3}
    rng = np.random.default_rng(4)
    for n in range(300):
        words["".join(rng.choice(list("abc"), rng.integers(4, 8)))] = int(rng.integers(1, 3000))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = as_rows(spelling.variants(df))
    assert got == brute_variants(words) and any(f and f != r for _, f, r, *_ in got)
    assert spelling.variants(df.limit(0)).count() == 0
    chain = {"x" * k: 6**k for k in range(1, 12)}
    assert as_rows(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long"))) == brute_variants(chain)


def test_spelling_query(spark, db):
    got, want = queries.op13_spelling(spark, SF).toPandas(), db.sql(spelling.ORACLE).df()
    assert len(got) > 500 and close(table_rows(got), table_rows(want))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_rows(queries.op13_spelling(spark, SF)) == brute_variants(brute_words(docs))


def test_hot_words_stay_apart(spark):
    """However many words share what a deletion leaves, rows of near words are a few a word: no pairs are listed."""
    words = [("prefix" + a + b + "suffix", 5 + k) for k, (a, b) in enumerate(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=2))]
    df = spark.createDataFrame(words, "word string, n long")
    got = {r.word: r.n_near for r in spelling.near_words(df).collect()}
    assert len(got) == 676 and set(got.values()) == {50}
