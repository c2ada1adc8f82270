"""Mixing, packing and sharding against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from passagemill.llm import mixing, packing, sharding
from passagemill.llm.tokenizer import VOCABULARY, encoding

from .conftest import EDGES


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 8), st.tuples(st.integers(0, 50), st.integers(0, 5)), max_size=8), st.integers(0, 400), st.integers(1, 4))
def test_water_fill(sources, budget, epochs):
    sizes, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    share = mixing.water_fill(sizes, weights, budget, epochs)
    live = [s for s in sizes if sizes[s] and weights[s]]
    assert all(0 <= share[s] <= epochs * sizes[s] for s in sizes) and all(share[s] == 0 for s in sizes if s not in live)
    assert sum(share.values()) == min(budget, sum(epochs * sizes[s] for s in live))
    levels = {Fraction(share[s], weights[s]) for s in live if share[s] < epochs * sizes[s]}
    assert len(levels) <= 1  # the same level wherever no cap holds
    assert all(Fraction(share[s], weights[s]) <= max(levels) for s in live) if levels else True


def duck(sql, pdf):
    con = duckdb.connect()
    con.register("documents", pdf)
    return con.execute(sql).df()


@pytest.mark.parametrize("weights,epochs", [({"a": 1, "b": 30}, 2), ({"a": 7}, 4), ({"a": 1, "b": 1, "c": 100}, 1)])
def test_mix_oracle(spark, weights, epochs):
    rng = random.Random(4)
    pdf = pd.DataFrame([(i, "x" * rng.randrange(0, 60), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(400)], columns=["doc_id", "text", "lang", "source", "n_chars"])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter((r.doc_id, r.copy) for r in mixing.mix(df, weights=weights, max_epochs=epochs).select("doc_id", "copy").collect())
    want = duck(mixing.oracle_sql(weights, 1, epochs), pdf)
    assert got == Counter(zip(want["doc_id"], want["copy"])) and got and max(c for _, c in got) <= epochs


def test_mix_edges(docs):
    df = docs(EDGES)
    got = mixing.mix(df, budget=3 * sum(len(t or "") for _, t in EDGES))
    assert set(got.columns) >= {"doc_id", "text", "copy", "input_copy"}
    by = Counter((r.doc_id, r.copy) for r in got.select("doc_id", "copy").collect())
    assert by[1, 1] == by[1, 3] == 1 and by[4, 2] == 2 and (1, 4) not in by and by[None, 1] == 2
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs([(1, None), (2, "")])).count() == 0  # nothing to repeat


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 8), st.integers(1, 12), st.integers(0, 2**32))
def test_nnls(rows, cols, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((rows, cols)).round(1), rng.random(rows)
    x = packing.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope >= -1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6  # optimal


def test_patterns():
    found = {tuple(p) for p in packing.patterns(12, 3)}
    want = set()
    for a in range(13):
        for b in range(a + 1):
            for c in range(b + 1):
                if a + b + c == 12:
                    row = [0.0] * 13
                    for x in (a, b, c):
                        if x:
                            row[x] += 1
                    want.add(tuple(row))
    assert found == want


ENC = encoding(VOCABULARY)


def check_pack(rows, data, capacity, size=lambda t: len(t or "")):
    used, pieces = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.pack, r.slot)):
        assert r.offset == used[r.pack] and 0 < r.length <= capacity
        used[r.pack] += r.length
        pieces[r.doc_id].append((r.start, r.length))
    assert all(n <= capacity for n in used.values())
    want = defaultdict(list)
    for i, t in data:
        n = size(t)
        want[i] += [(s, min(capacity, n - s)) for s in range(0, n, capacity)]
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items() if p}
    return used


@pytest.mark.parametrize("groups", [50, 5000])
def test_pack(docs, groups):
    rng = random.Random(9)
    data = [(i, "x" * max(1, int(rng.lognormvariate(5, 1)))) for i in range(1500)]
    df = docs(data)
    rows = packing.pack(df, capacity=1024, group_docs=groups, vocabulary=None).collect()
    used = check_pack(rows, data, 1024)
    least = -(-sum(len(t) for _, t in data) // 1024)
    assert len(used) <= least * (1.06 if groups == 5000 else 1.35)
    assert sorted(rows) == sorted(packing.pack(df.repartition(7), capacity=1024, group_docs=groups, vocabulary=None).collect())


def test_pack_edges(docs):
    data = [*EDGES, (50, "y" * 8192), (51, "y" * 16384)]
    check_pack(packing.pack(docs(data)).collect(), data, packing.CAPACITY, lambda t: len(ENC.encode_ordinary(t or "")))
    check_pack(packing.pack(docs(data), capacity=7, grid=128, vocabulary=None).collect(), data, 7)
    assert packing.pack(docs([])).count() == 0 and packing.pack(docs([(1, None), (2, "")])).count() == 0


def test_pack_of_one_id(docs):
    """Rows of one id, or none, fall in all groups alike, and every row is packed."""
    data = [(None, "x" * 700)] * 900 + [(7, "y" * 300)] * 900 + [(i, "z" * (1 + i % 50)) for i in range(100)]
    rows = packing.pack(docs(data).repartition(3), capacity=1024, group_docs=100, vocabulary=None).collect()
    check_pack(rows, data, 1024)
    by = Counter(r.pack >> 32 for r in rows)
    assert len(by) == 19 and max(by.values()) < 200
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack(docs(data), capacity=1024, group_docs=100, vocabulary=None).collect()))


def brute_first_fit(lengths, capacity):
    """Plain best fit, longest first: how many sequences it takes."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_pack_against_plain_best_fit(docs):
    """Patterns and residuals together need hardly more sequences than best fit over all documents at once."""
    rng = random.Random(5)
    data = [(i, "x" * max(1, min(1024, int(rng.lognormvariate(5.3, 0.8))))) for i in range(1200)]
    rows = packing.pack(docs(data), capacity=1024, vocabulary=None).collect()
    used = check_pack(rows, data, 1024)
    assert len(used) <= 1.04 * brute_first_fit([len(t) for _, t in data], 1024)


def bits(key):
    return bin(int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def brute_shards(data, limit):
    """Splits one oversized bucket after another."""
    open_, out = [("", data)], {}
    while open_:
        prefix, rows = open_.pop()
        size = sum(len((t or "").encode()) for _, t in rows)
        if size <= limit or len(prefix) == 60:
            if rows:
                out[prefix] = (size, sorted((str(i), t or "") for i, t in rows))
        else:
            for b in "01":
                open_.append((prefix + b, [r for r in rows if bits(r[0])[len(prefix)] == b]))
    return {p: (n, [(i, (t or "")[:5]) for i, t in rows]) for p, (n, rows) in out.items()}


@pytest.mark.parametrize("limit,step", [(300, 2), (1000, 3), (5000, 12), (10**9, 12), (0, 7)])
def test_shard(docs, limit, step):
    rng = random.Random(2)
    data = [(i, "é" * rng.randrange(0, 80)) for i in range(60)] + [(7, "z" * 900), (None, "n"), (None, None)]
    got = sharding.shard(docs(data), shard_bytes=limit, step=step)
    assert {"shard", "shard_bytes", "input_shard"} <= set(got.columns)
    found, parts = {}, defaultdict(set)
    for part, r in got.rdd.mapPartitionsWithIndex(lambda i, it: [(i, r) for r in it]).collect():
        found.setdefault(r.shard, (r.shard_bytes, []))[1].append((str(r.doc_id), (r.text or "")[:5]))
        parts[r.shard].add(part)
    assert all(len(p) == 1 for p in parts.values())
    assert {p: (n, sorted(rows)) for p, (n, rows) in found.items()} == {p: (n, sorted(rows)) for p, (n, rows) in brute_shards(data, limit).items()}


def test_shard_oracle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = duck(sharding.ORACLE_SQL.format(limit=20_000), df.toPandas())
    got = sharding.shard(df, shard_bytes=20_000).toPandas()
    assert got.shard.nunique() > 20
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True)[sorted(got)], want.sort_values("doc_id", ignore_index=True)[sorted(want)], check_dtype=False)


def test_shard_edges(docs):
    assert sharding.shard(docs(EDGES), shard_bytes=1000).count() == len(EDGES)
    assert sharding.shard(docs([])).count() == 0
