"""Kernels hold a bounded part of an Arrow batch, however much the batch has: what they give back in one is the measure."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.operators import chunk as ch, embed
from passagemill.runtime import PIECE, pieces


class Captured:
    """Stands for a DataFrame, and keeps the kernel that it is given."""

    columns: tuple = ()

    def __getattr__(self, name):
        return lambda *_, **__: self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def large(n=3000):
    """Documents of 2,000 characters, and one of a megabyte."""
    text = "Some words of a sentence. " * 77
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([*[text] * (n - 1), text * 500])], ["doc_id", "text"])


def results(make, batch):
    table = Captured()
    make(table)
    return list(table.run(iter([batch])))


def test_pieces_tile_a_batch():
    texts = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 40, None, "b" * 300, "", "c" * 40])], ["i", "t"])
    assert [p.column(0).to_pylist() for p in pieces(texts, 1, 100)] == [[0, 1], [2], [3, 4]]
    lists = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array([["a"] * 9, None, ["b"] * 9])], ["i", "t"])
    assert [p.column(0).to_pylist() for p in pieces(lists, "t", 100)] == [[0, 1], [2]]
    assert list(pieces(texts.slice(0, 0))) == []


def bounded(make):
    got = results(make, large())
    assert len(got) > 5 and max(b.nbytes for b in got) < 3 * PIECE
    return got


@pytest.mark.parametrize(("name", "how"), [("sentence", {"window": 3}), ("recursive", {"size": 256}), ("semantic", {"cut_at": 90.0}), ("fixed", {"size": 512, "tokenizer": "character"})])
def test_chunks_come_in_bounded_batches(spark, name, how):
    got = bounded(lambda t: ch.chunk(t, name, **how))
    by = np.concatenate([b.column("doc_id").to_numpy() for b in got])
    assert set(by) == set(range(3000)) and (np.diff(by) >= 0).all()


def test_a_scan_holds_little_at_a_time():
    import tracemalloc

    from passagemill.functions import ranking

    rng = np.random.default_rng(0)
    terms = [f"w{i}" for i in range(500)]
    q, t = np.repeat(np.arange(200), 40), rng.integers(0, 500, 8000)
    asked = ranking.Asked(pa.array(range(200)), pa.array(terms), q, t, np.ones(8000))
    words = pa.array([[terms[i] for i in row] for row in rng.integers(0, 500, (10_000, 75))])
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(10_000)]), words], ["chunk_id", "w"])
    tracemalloc.start()
    try:
        (out,) = ranking.sparse_scan(asked, [lambda p: p[2]], 10)(iter([batch]))
        assert out.num_rows == 2000 and tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_a_count_holds_little_at_a_time(spark):
    """The first pass of BM25 gives one batch a task, so that what it holds on the way is the measure."""
    import tracemalloc

    from passagemill.operators import search

    class Counted(Captured):
        sparkSession = spark  # noqa: N815

        def collect(self):
            return ()  # no row, no second pass

    terms = [f"w{i}" for i in range(500)]
    table = Counted()
    search._bm25(table, spark.createDataFrame([(1, " ".join(terms))], "query_id bigint, text string"), 10, [(1.5, 0.75)])
    words = np.random.default_rng(0).integers(0, 500, (10_000, 75))
    batch = pa.RecordBatch.from_arrays([pa.array([[terms[i] for i in row] for row in words])], ["w"])
    tracemalloc.start()
    try:
        (out,) = table.run(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    counts = dict(zip(out.column("i").to_pylist(), out.column("n").to_pylist()))
    assert counts[500] == 10_000 and counts[501] == 750_000
    assert sum(counts.values()) - 760_000 == sum(len(set(row)) for row in words.tolist())
    assert peak < 12 << 20


def test_hashed_vectors_come_in_bounded_batches(spark):
    from pyspark.sql import types as T

    class Typed(Captured):
        schema = T.StructType([T.StructField("chunk_id", T.LongType())])

    table = Typed()
    embed.hash_vectors(table)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(["some words"] * 6000)], ["chunk_id", "text"])
    got = list(table.run(iter([batch])))
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(6000)) and max(b.nbytes for b in got) < 2 * PIECE


def test_weights_come_in_bounded_batches(spark):
    from pyspark.sql import types as T

    class Typed(Captured):
        schema = T.StructType([T.StructField("chunk_id", T.LongType())])
        sparkSession = spark  # noqa: N815

    terms = [f"w{i}" for i in range(200)]
    table = Typed()
    embed.tfidf_rows(table, spark.createDataFrame([(t, 1.0) for t in terms], "term string, idf double"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([terms] * 5000)], ["chunk_id", "w"])
    got = list(table.run(iter([batch])))
    assert sum(b.num_rows for b in got) == 1_000_000 and len(got) > 5 and max(b.nbytes for b in got) < 6 * PIECE


def test_runs_of_one_pass_are_those_of_each(spark):
    from passagemill.operators import search

    chunks = spark.createDataFrame([(str(i), " ".join(f"w{j % 7}" for j in range(i, i + 3 + i % 5))) for i in range(40)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3 w3 w6"), (3, "none")], "query_id bigint, text string")
    ways = [(1.5, 0.75), (0.9, 0.75), (1.2, 0.0)]
    for (k1, b), got in zip(ways, search.bm25_runs(chunks, asked, 5, ways)):
        assert sorted(got.select("query_id", "chunk_id", "score", "rank").collect()) == sorted(search.bm25(chunks, asked, 5, k1, b).collect())


@pytest.mark.parametrize("name", ["run_disagreement", "compare_runs", "significance"])
def test_two_runs_share_their_passes(spark, monkeypatch, name):
    """The texts are cut once for the judgements and once for both searches."""
    from passagemill.plans import catalogue

    made = []
    monkeypatch.setattr(catalogue._T, "chunks", lambda t, own=catalogue._T.chunks: made.append(1) or own(t))
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 2


def test_feedback_searches_each_list_once(spark):
    """The second search reads its queries several times; the first is not made anew for that."""
    from passagemill.operators import questions as qs

    seen = spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame([("a", "one two three"), ("b", "two four")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "one"), (2, "four")], "query_id bigint, text string")
    told = F.udf(lambda x: seen.add(1) or x, "string")

    def search(queries, k):
        queries.count(), queries.collect()
        hits = spark.createDataFrame([(1, "a", 1.0, 1), (2, "b", 1.0, 1)], "query_id bigint, chunk_id string, score double, rank int")
        return hits.withColumn("chunk_id", told("chunk_id"))

    got = qs.relevance_feedback(search, chunks, asked, 2).select("query_id", "chunk_id").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b")] and seen.value == 4


def test_probes_of_one_chunk_shuffle_its_quote_once(spark):
    """Before the words meet their counts only ids and words go; a word of several rows of one id counts once."""
    from passagemill.operators import questions as qs

    rows = [("a", "Golden lanterns burned brightly."), ("a", "Golden lanterns burned brightly."), ("b", "Golden rivers. Silver lanterns drift over rivers."), ("c", "No so.")]
    got = qs.keyword_probes(spark.createDataFrame(rows, "chunk_id string, text string"), 3)
    assert sorted(map(tuple, got.collect())) == [("a", "brightly burned golden", "Golden lanterns burned brightly."), ("b", "drift over rivers", "Silver lanterns drift over rivers.")]


def test_a_chunker_and_the_count_of_its_tokens_share_a_pass(spark, monkeypatch):
    """The semantic chunker and the count of its chunks' tokens read the tokens of a text once."""
    from passagemill.functions import text as tx

    read = []
    monkeypatch.setattr(tx, "token_spans", lambda text, tokenizer="regex", own=tx.token_spans: read.append(text) or own(text, tokenizer))
    texts = [f"One sentence {i} of a few words. Another is here. A third has more of them! Is it so?" for i in range(5)]
    (got,) = results(lambda t: ch.chunk(t, "semantic", cut_at=90.0), pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["doc_id", "text"]))
    assert read == texts
    assert all(n == len(tx.token_spans(part)) for n, part in zip(got.column("n_tokens").to_pylist(), got.column("text").to_pylist()))


def test_abbreviations_are_those_of_the_pattern():
    """The scan back from a mark finds what a search by pattern does, also behind closers, a line feed or 200 characters."""
    import random
    import re

    from passagemill.functions import text as tx

    last = re.compile(rf"(\d+|[a-zA-Z]+)[{tx._CLOSERS}!.?]*$")

    def by_pattern(text, at):
        if text[at + 1 : at + 2].isdigit():
            return True
        m = last.search(text, max(0, at - 200), at)
        return m is not None and (m[1].isdigit() or m[1].lower() in tx._SHORT or m[1] in tx._SHORT_CAPITAL)

    rng = random.Random(5)
    texts = ["".join(rng.choice("aB1.!?\"')]’”\n \tſ٣²ı") for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    ends = ["dr.", "Fig.", "fig).", "approx\n.", "approxi.", "xapprox.", "e" * 9 + ".", "7\n\n.", "Dr" + ")" * 198 + ".", "Dr" + ")" * 199 + ".", "xdr" + ")" * 198 + ".", "٣."]
    cases = [(t + e, len(t + e) - 1) for t in ["", " ", "a b ", "3"] for e in ends] + [(t, at) for t in texts for at in range(len(t))]
    assert [tx._goes_on(*c) for c in cases] == [by_pattern(*c) for c in cases]


def test_neighbours_are_alike_to_the_last_bit():
    import math
    from collections import Counter

    from passagemill.functions.vectors import _WORD, tfidf_neighbours

    def plain(windows, features):
        bags = [Counter(_WORD.findall(w.lower())) for w in windows]
        df = Counter(t for b in bags for t in b)
        idf = {t: math.log((1 + len(bags)) / (1 + df[t])) + 1 for t in sorted(df, key=lambda t: (-df[t], t))[:features]}
        rows = []
        for b in bags:
            v = {t: (1 + math.log(n)) * idf[t] for t, n in b.items() if t in idf}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            rows.append({t: x / norm for t, x in v.items()})
        return [sum(x * b.get(t, 0.0) for t, x in a.items()) for a, b in zip(rows, rows[1:])]

    words = np.random.default_rng(2).zipf(1.4, (60, 30)) % 97
    windows = [" ".join(f"w{i}" for i in row) for row in words.tolist()] + ["", "only"]
    for features in (4096, 11):
        assert tfidf_neighbours(windows, features) == plain(windows, features)
