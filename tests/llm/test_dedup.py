"""Exact and near deduplication against brute force."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from passagemill.llm import exact, omh
from passagemill.llm.components import connected_components

from .conftest import EDGES


def roots(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(random.Random(3).randrange(200), random.Random(i).randrange(200)) for i in range(150)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert dict(rows(connected_components(df))) == roots([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("fan_in,partitions", [(2, 8), (3, 9), (8, 4)])
def test_merge_runs(spark, fan_in, partitions):
    """Several rounds give the smallest id of each text, wherever its copies began."""
    rng = random.Random(1)
    data = [(i, f"t{rng.randrange(40)}") for i in range(300)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id bigint, text string").repartition(7)
    entries = df.select("id", *exact._proof(F.col("text"))).withColumn("copies", F.lit(1).cast("bigint"))
    merged = exact.merge_runs(entries, fan_in, partitions)
    by_text = defaultdict(list)
    for i, t in data:
        by_text[t].append(i)
    assert sorted((r.id, r.rows) for r in merged.collect()) == sorted((min(x), len(x)) for x in by_text.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1), st.one_of(st.none(), st.integers(0, 9))), max_size=12), min_size=1, max_size=5))
def test_merge_of_runs(runs):
    """Merged runs are sorted, and hold each text once with its smallest id, the rows that have it and all rows."""
    import pyarrow as pa

    kind = pa.schema([("digest", pa.binary()), ("check", pa.int64()), ("n", pa.int32()), ("id", pa.int64()), ("copies", pa.int64()), ("rows", pa.int64())])
    tables = [pa.Table.from_pylist([{"digest": bytes([d]) * 32, "check": c, "n": 1, "id": i, "copies": 1, "rows": 1} for d, c, i in sorted(run, key=lambda x: x[0])], kind) for run in runs]
    got = exact.merge([exact._one_each(t) for t in tables]).to_pylist()
    by = defaultdict(list)
    for run in runs:
        for d, c, i in run:
            by[d, c].append(i)
    least = {k: min(v, key=lambda i: (i is None, i or 0)) for k, v in by.items()}
    assert [r["digest"] for r in got] == sorted(r["digest"] for r in got)
    assert {(r["digest"][0], r["check"]): (r["id"], r["copies"], r["rows"]) for r in got} == {k: (least[k], v.count(least[k]), len(v)) for k, v in by.items()} and len(got) == len(by)


def test_exact_edges(docs):
    df = docs(EDGES)
    assert rows(exact.exact_duplicates(df)) == [(4, 1), (6, 5)]
    kept = exact.drop_exact_duplicates(df)
    assert sorted((str(r.doc_id), (r.text or "")[:4]) for r in kept.collect()) == sorted([("1", "a b "), ("2", ""), ("None", "no i"), ("3", ""), ("5", "word"), ("7", "!!! "), ("None", ""), ("8", "xxxx")])
    assert set(kept.columns) == set(df.columns)


def test_exact_repeated_rows_and_ids(docs):
    df = docs([(5, "a"), (3, "a"), (5, "b"), (9, "c"), (9, "c"), (9, "d"), (None, "a"), (None, "z"), (None, "z")])
    assert rows(exact.exact_duplicates(df)) == sorted([(5, 3), (None, 3)], key=str)
    assert sorted((str(r.doc_id), r.text) for r in exact.drop_exact_duplicates(df).collect()) == [("3", "a"), ("5", "b"), ("9", "c"), ("9", "d"), ("None", "z")]


def test_empty(docs):
    for f in (exact.exact_duplicates, exact.drop_exact_duplicates, omh.near_duplicates, omh.drop_near_duplicates):
        assert f(docs([])).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 16))
def test_banded_distance(a, b, most):
    d = levenshtein(a, b)
    assert omh.banded_distance(a, b, most) == (d if d <= most else most + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=60), st.integers(0, 2**32))
def test_edit_similarity(a, seed):
    rng = random.Random(seed)
    b = [rng.randrange(10) if rng.random() < 0.15 else x for x in a if rng.random() > 0.05]
    true = 1 - levenshtein(a, b) / max(1, len(a), len(b))
    got = omh.edit_similarity(a, b, 0.7)
    assert got == pytest.approx(true) if true >= 0.7 - 1e-9 else got == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 300), st.integers(1, 40), st.floats(0, 0.5), st.integers(0, 2**32))
def test_bag_never_loses_a_pair(n, vocabulary, share, seed):
    import numpy as np

    rng = random.Random(seed)
    word = lambda: str(rng.randrange(vocabulary)).encode()
    a = [word() for _ in range(n)]
    b = [word() if rng.random() < share else w for w in a if rng.random() > share / 2] + [word() for _ in range(rng.randrange(20))]
    data = np.frombuffer(b" ".join(a) + b" " + b" ".join(b), np.uint8)
    words, counts = omh.word_hashes(data, np.array([0, len(b" ".join(a)), len(data)]))
    x, y = (omh._counts(omh.bag(w)) for w in np.split(words, [counts[0]]))
    assert x.sum() == len(a) and y.sum() == len(b)
    one, two = omh.word_bits(words, counts).view(np.uint64)
    lone = max(int(np.bitwise_count(one & ~two).sum()), int(np.bitwise_count(two & ~one).sum()))
    if omh.edit_similarity(a, b, omh.THRESHOLD):
        assert omh.may_be_similar(x, y, omh.THRESHOLD)
        assert lone <= int((1 - omh.THRESHOLD) * max(len(a), len(b)) + 1e-9)


def test_sketch_keeps_order():
    import numpy as np

    def sketch(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return omh.order_minhash(*omh._labelled(*omh.word_hashes(data, np.array([0, len(data)])), 1), 2, 64)[0]

    one, two = sketch("a b c d e f g h"), sketch("h g f e d c b a")
    assert (sketch("a b c d e f g h") == one).all()
    assert (one != two).mean() > 0.9  # the same words, in another order
    assert (sketch("a a") != sketch("a")).any()  # repeats are labelled


def test_near_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: omh.words_of(r.text) for r in df.collect()}
    ids = sorted(texts)
    true = roots([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if omh.edit_similarity(texts[a], texts[b], omh.THRESHOLD)])
    want = {(i, r) for i, r in true.items() if i != r}
    got = set(map(tuple, omh.near_duplicates(df).collect()))
    assert got == set(map(tuple, omh.near_duplicates(df, hot=1).collect()))
    assert len(got & want) >= 0.9 * len(want) and not got - {(i, r) for i in texts for r in texts if omh.edit_similarity(texts[i], texts[r], omh.THRESHOLD)} - want
    assert got == want


def planted(seed, share, n=120, size=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for i in range(n):
        base = [word() for _ in range(size)]
        out.append((2 * i, " ".join(base)))
        out.append((2 * i + 1, " ".join(word() if rng.random() < share else w for w in base)))
    return out


@pytest.mark.parametrize("share,least", [(0.05, 0.99), (0.12, 0.97), (0.18, 0.9)])
def test_near_recall(docs, share, least):
    """Pairs that differ in a share of their words, and nothing else, are found."""
    data = planted(1, share)
    got = set(map(tuple, omh.near_duplicates(docs(data)).collect()))
    texts = dict(data)
    want = {(i + 1, i) for i in range(0, len(data), 2) if omh.edit_similarity(omh.words_of(texts[i]), omh.words_of(texts[i + 1]), omh.THRESHOLD)}
    assert not got - want and len(got & want) >= least * len(want) and len(want) > 80


@pytest.mark.parametrize("size,least", [(4, 1.0), (5, 1.0), (7, 1.0), (10, 1.0), (12, 1.0), (14, 0.9), (20, 0.9), (30, 0.9), (60, 0.9), (70, 0.9), (250, 0.9)])
def test_near_recall_at_threshold(docs, size, least):
    """Pairs with as many scattered edits as the threshold allows: exact for few words, and found mostly for more."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    data = []
    for i in range(300):
        base = [word() for _ in range(size)]
        edited = list(base)
        for j in rng.sample(range(size), int(0.3 * size + 1e-9)):
            edited[j] = word()
        data += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
    got = set(map(tuple, omh.near_duplicates(docs(data)).collect()))
    want = {(i + 1, i) for i in range(0, len(data), 2)}
    print(size, len(got & want) / len(want))
    assert not got - want and len(got & want) >= least * len(want)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=omh.SHORT), st.lists(st.integers(0, 3), min_size=1, max_size=omh.SHORT))
def test_piece_keys_never_lose_a_pair(a, b):
    if a != b and omh.edit_similarity(a, b, omh.THRESHOLD):
        assert omh.piece_keys(a, omh.THRESHOLD) & omh.piece_keys(b, omh.THRESHOLD)


def test_near_shared_passage(docs):
    """Documents that share a passage, in a bucket of many, are no duplicates; two copies among them are."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    data = [(i, " ".join(word() for _ in range(60)) + " " + passage) for i in range(60)]
    data.append((100, data[7][1].replace(".", "") + " tail"))
    assert rows(omh.near_duplicates(docs(data))) == [(100, 7)]
    assert rows(omh.near_duplicates(docs(data), hot=1)) == [(100, 7)]  # the way of buckets that many texts are in


def test_near_edges(docs):
    df = docs(EDGES)
    assert rows(omh.near_duplicates(df)) == [(4, 1), (6, 5)]
    assert sorted(str(r.doc_id) for r in omh.drop_near_duplicates(df).collect()) == ["1", "2", "3", "5", "7", "8", "None", "None"]
    assert rows(omh.near_duplicates(docs([(1, "A, b c!"), (2, "a b  C")]))) == [(2, 1)]  # equal words
    text = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert rows(omh.near_duplicates(text)) == [("d4", "d1"), ("d6", "d5")] and omh.drop_near_duplicates(text).count() == 8
    assert rows(exact.exact_duplicates(text)) == [("d4", "d1"), ("d6", "d5")]
