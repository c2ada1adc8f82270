"""Sequential kernels and small tables against plain Python."""

import math
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from passagemill.functions import spans as sp, text as tx
from passagemill.functions.vectors import hashed
from passagemill.operators import chunk as ch, embed, metrics, questions as qs, resolve, search
from passagemill.plans import grid

TEXTS = st.text(alphabet="ab. \n#!?|-1,;", max_size=200)
PROSE = "Dr. Smith paid 3.5 percent, etc. and more. Why? See No. 7! It ended.\n\nA second paragraph follows here."
MARKDOWN = "# Top\nintro text\n\n## Part one\n- item a\n- item b\n\n```\ncode # no heading\n```\n\n| a | b |\n| 1 | 2 |\n\nTitle\n=====\nlast words"


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from(["fixed", "recursive", "sentence", "structural", "semantic"]))
def test_chunks_lie_in_order_and_cover_all_words(text, name):
    how = {"sentence": {"window": 2}, "semantic": {"max_size": 8}, "structural": {"max_size": 6}}.get(name, {"size": 6, "overlap": 2})
    ranges = tx.CHUNKERS[name](text, **how)
    assert all(0 <= a <= b <= len(text) for a, b in ranges) and ranges == sorted(ranges)
    covered = {i for a, b in ranges for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(text) if c.isalnum())


def test_fixed_windows():
    text = " ".join(f"w{i}" for i in range(20))
    assert [text[a:b] for a, b in tx.fixed(text, 8, 2)] == [" ".join(f"w{i}" for i in range(max(0, at - 2), min(20, at + 8))) for at in (0, 6, 12)]
    with pytest.raises(ValueError):
        tx.fixed(text, 8, 8)


def test_recursive_by_hand():
    """Paragraphs that fit stay together, one that does not is cut at its sentences, and pieces are packed again."""
    text = "a b c.\n\nd e f g. h i j k. l m\n\nn o"
    cut = lambda **how: [text[a:b] for a, b in tx.recursive(text, **how)]
    assert cut(size=30, overlap=0) == [text]
    assert cut(size=6, overlap=0) == ["a b c.", "d e f g.", "h i j k.", "l m\n\nn o"]
    assert cut(size=6, overlap=2) == ["a b c.", "c.\n\nd e f g.", "g. h i j k.", "k. l m\n\nn o"]
    assert [x for x in tx.recursive("abcdef", 2, 0, "character")] == [(0, 2), (2, 4), (4, 6)]


def test_structural_by_hand():
    """A section a heading; a small one joins the one before, a table is never cut."""
    table = "| a | b |\n| 1 | 2 |\n| 3 | 4 |"
    text = f"intro words here\n\n# One\nalpha beta gamma delta\n\n# Two\nx\n\n# Three\n{table}\n\nafter the table"
    cut = lambda **how: [text[a:b] for a, b in tx.structural(text, **how)]
    assert cut(max_size=60, min_size=5) == ["intro words here", "# One\nalpha beta gamma delta\n\n# Two\nx", f"# Three\n{table}\n\nafter the table"]
    kept = cut(max_size=10, min_size=2)
    assert table in kept and "after the table" in kept and "# Three" in kept
    assert table not in cut(max_size=10, min_size=2, split_tables=True)


def test_semantic_by_hand():
    """The cut falls where neighbouring windows have least in common."""
    text = "Cats purr softly. Cats sleep softly. Engines burn fuel. Engines burn oil."
    assert [text[a:b] for a, b in tx.semantic(text, 95.0, 0)] == ["Cats purr softly. Cats sleep softly.", "Engines burn fuel. Engines burn oil."]
    assert len(tx.semantic(text, 100.0, 0, 1)) == 4  # the size alone


def test_sentences_keep_abbreviations_and_numbers():
    assert [PROSE[a:b] for a, b in tx.sentences(PROSE)][:2] == ["Dr. Smith paid 3.5 percent, etc. and more.", "Why?"]


def test_markdown_blocks():
    kinds = [(k, l, MARKDOWN[a:b].split("\n")[0]) for a, b, k, l in tx.markdown_blocks(MARKDOWN)]
    assert kinds == [("heading", 1, "# Top"), ("paragraph", None, "intro text"), ("heading", 2, "## Part one"), ("list_item", None, "- item a"), ("code", None, "```"), ("table", None, "| a | b |"), ("heading", 1, "Title"), ("paragraph", None, "last words")]
    assert [p for _, p in tx.heading_paths(MARKDOWN)] == [["Top"], ["Top", "Part one"], ["Title"]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 10), min_size=1, max_size=20), st.floats(0, 100))
def test_percentile(values, p):
    import numpy as np

    assert tx.percentile(values, p) == pytest.approx(float(np.percentile(values, p)))


SPANS = [(1, 0, 5), (1, 5, 7), (1, 6, 9), (1, 12, 14), (1, 13, 13), (2, 3, 4), (2, 3, 4)]


def test_merge_spans(spark):
    df = spark.createDataFrame(SPANS, "doc_id int, start int, end int")
    assert sorted(map(tuple, sp.merge_spans(df, ["doc_id"]).select("doc_id", "start", "end").collect())) == [(1, 0, 9), (1, 12, 14), (2, 3, 4)]
    assert sorted(map(tuple, sp.total_length(df, ["doc_id"]).collect())) == [(1, 11), (2, 1)]
    other = spark.createDataFrame([(1, 4, 13), (3, 0, 9)], "doc_id int, start int, end int")
    assert list(map(tuple, sp.intersection_length(df, other, ["doc_id"]).collect())) == [(1, 6)]
    assert sp.merge_spans(df.limit(0), ["doc_id"]).count() == 0


def test_locate():
    text = "one  two\nthree one two four"
    assert resolve.locate("one  two", text) == (0, 8, "exact", 1)
    assert resolve.locate("two three", text) == (5, 14, "normalised", 1)
    assert resolve.locate("one two", text) == (15, 22, "exact", 1) and resolve.locate("one two", text, 1) == (15, 22, "normalised", 2)
    assert resolve.locate("one two", text, 2) == (None, None, "out_of_range", 2)
    assert resolve.locate("absent", text) == resolve.locate(" ", text) == (None, None, "not_found", 0)
    long = "alpha beta gamma was here and delta epsilon zeta"
    assert resolve.locate("alpha beta gamma is there and delta epsilon zeta", long, bounded=True) == (0, len(long), "bounded", 1)
    paged = "same words\nsame words\nsame words"
    pages = [(0, 1), (11, 2), (22, 3)]
    assert resolve.locate("same words", paged, page_hint=3, pages=pages)[:2] == (22, 32) and resolve.locate("same words", paged, page_hint=9, pages=pages)[:2] == (0, 10)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=40))
def test_collapse_maps_back(text):
    flat, marks = resolve.collapse(text)
    assert flat == re.sub(r"\s+", " ", text)
    for i, c in enumerate(flat):
        at = resolve._origin(marks, i)
        assert text[at].isspace() if c == " " else text[at] == c


def test_resolve_everywhere(spark):
    """Every item in every document, by brute force: verbatim, in other white space, abridged, and nowhere."""
    quote = "alpha beta gamma delta epsilon zeta eta"
    docs = spark.createDataFrame([(1, f"x {quote} y {quote}"), (2, quote.replace(" ", "\n ")), (3, "alpha beta gamma other words epsilon zeta eta"), (4, "alpha beta gamma and no end"), (5, None), (6, "")], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, quote), (2, "nowhere at all"), (3, " "), (4, None), (5, "alpha beta")], "item_id bigint, quote string")
    got = sorted((tuple(r) for r in resolve.resolve_everywhere(quotes, docs).collect()), key=str)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = []
    for r in quotes.collect():
        found = [(r.item_id, d, *resolve.locate(r.quote or "", t, bounded=True)[:3]) for d, t in texts.items()]
        want += [f for f in found if f[2] is not None] or [(r.item_id, None, None, None, "not_found")]
    assert got == sorted(want, key=str) and {g[4] for g in got} == {"exact", "normalised", "bounded", "not_found"}


def test_anchor_reasons(spark):
    docs = spark.createDataFrame([(1, "one two two", [(0, 1), (8, 2)]), (2, "zwei", None)], "doc_id bigint, text string, pages array<struct<start:int,number:int>>")
    anchors = spark.createDataFrame([(1, 1, "two", 0, None), (2, 1, "two", 0, 2), (3, 1, "two", 5, None), (4, 2, "two", 0, None), (5, 7, "two", 0, None)], "item_id bigint, doc_id bigint, quote string, occurrence int, page_hint int")
    rows = resolve.resolve_anchors(anchors, docs)
    assert {r.item_id: (r.start, r.strategy, r.ambiguous) for r in rows.collect()} == {1: (4, "exact", True), 2: (8, "exact", False), 3: (None, "out_of_range", False), 4: (None, "not_found", False), 5: (None, "no_document", False)}
    assert {r.strategy: (r.n, r.ambiguous) for r in resolve.resolution_report(rows).collect()}["exact"] == (2, 1)


def test_anchors(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id bigint, text string")
    anchors = spark.createDataFrame([(1, 1, "two", 0), (2, 1, "zwei", 0), (3, 9, "two", 0), (4, 2, "two", None)], "item_id bigint, doc_id bigint, quote string, occurrence int")
    got = {r.item_id: (r.start, r.end, r.strategy) for r in resolve.resolve_anchors(anchors, docs).collect()}
    assert got == {1: (4, 7, "exact"), 2: (None, None, "not_found"), 3: (None, None, "no_document"), 4: (None, None, "not_found")}


def test_quotes_in_slabs(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aaaa b"), (2, ""), (3, None)], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, "aa"), (2, "b"), (3, ""), (4, None), (5, "aa")], "item_id bigint, quote string")
    one = sorted(map(tuple, resolve.find_quotes(docs, quotes).collect()))
    monkeypatch.setattr(resolve, "SLAB", 2)
    assert one == sorted(map(tuple, resolve.find_quotes(docs, quotes).collect())) and len(one) == 7


@pytest.mark.parametrize("seed", [1, 2])
def test_drop_similar_against_greedy_pass(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") * 2 for _ in range(9)] for _ in range(12)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(9)] = rng.choice("abcdefghijklmnop") * 2
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, rows[0][1].upper())]
    kept, want = [], {}
    for i, t in rows:
        bag = set((t or "").lower().split())
        first = next((k for k, b in kept if bag and len(b & bag) / len(b | bag) >= 0.8), None)
        if first is None:
            kept.append((i, bag))
        else:
            want[i] = first
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    assert {r.item_id: r.duplicate_of for r in qs.drop_similar(items).collect()} == want and want
    assert qs.drop_similar(items.limit(0)).count() == 0


def brute_bm25(chunks, queries, k, k1=1.5, b=0.75):
    bags = {c: re.findall(r"\w+", t.lower()) for c, t in chunks}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    out = []
    for q, text in queries:
        scores = {}
        for w in re.findall(r"\w+", text.lower()):
            df = sum(w in x for x in bags.values())
            for c, bag in bags.items():
                if f := bag.count(w):
                    scores[c] = scores.get(c, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(bag) / mean))
        ranked = sorted(((-round(s, 6), c) for c, s in scores.items()))[:k]
        out += [(q, c, -s, i + 1) for i, (s, c) in enumerate(ranked)]
    return out


def test_searches_in_slabs(spark, monkeypatch):
    """Many slabs and small blocks give what one gives, and both what plain Python gives."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    chunks = [(f"c{i:03d}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(90)] + [("empty", ""), ("twin1", "w1 w2"), ("twin2", "w1 w2")]
    queries = [(i, " ".join(rng.choice(words) for _ in range(4))) for i in range(15)] + [(90, "w1 w2 w2"), (91, "unknown"), (92, "")]
    c, q = spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3), spark.createDataFrame(queries, "query_id bigint, text string")
    want = sorted(brute_bm25(chunks, queries, 7))
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in df.collect())
    near = lambda got: [(a, b, pytest.approx(s, abs=2e-6), n) for a, b, s, n in got]
    assert rows(search.bm25(c, q, 7)) == near(want)
    tfidf = rows(search.tfidf_search(c, q, embed.tfidf_fit(c), 7))
    monkeypatch.setattr(search, "SLAB_TERMS", 9)
    assert rows(search.bm25(c, q, 7)) == near(want) and rows(search.tfidf_search(c, q, embed.tfidf_fit(c), 7)) == tfidf
    idf = embed.tfidf_fit(c)
    a, b = embed.tfidf_rows(c, idf).withColumnRenamed("weight", "x"), embed.tfidf_rows(q, idf, "query_id")
    plain = search.top_k(a.join(b, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("x") * F.col("weight")), 6).alias("score")), 7)
    assert [(x[0], x[2]) for x in tfidf] == [(x[0], pytest.approx(x[2], abs=2e-6)) for x in rows(plain)]
    assert search.bm25(c.limit(0), q, 7).count() == 0 and search.bm25(c, q.limit(0), 7).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5), st.lists(st.lists(st.integers(0, 4), min_size=4, max_size=4), max_size=30), st.integers(1, 7))
def test_keeper(queries, k, scores, step):
    import numpy as np

    from passagemill.functions import ranking

    s = np.array(scores, float).reshape(-1, 4)[:, :queries].T
    ids = np.array([f"i{(7 * j) % 31:02d}" for j in range(s.shape[1])], object)
    keeper = ranking.Keeper(queries, k)
    for lo in range(0, s.shape[1], step):
        keeper.add_block(s[:, lo : lo + step], ids[lo : lo + step])
        if lo % 2:
            keeper.compact()
    got = list(zip(*(x.tolist() for x in keeper.compact())))
    assert got == [(q, i, v) for q in range(queries) for v, i in sorted(((v, i) for v, i in zip(s[q], ids)), key=lambda x: (-x[0], x[1]))[:k]]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aé日 b.\n😀", max_size=30))
def test_bpe_spans_tile_the_text(text):
    spans = tx.token_spans(text, "bpe:/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert "".join(text[a:b] for a, b in spans) == text and all(a < b for a, b in spans)


def test_bpe_chunks(spark):
    docs = spark.createDataFrame([(1, "one two three four five " * 20)], "doc_id bigint, text string")
    chunks = ch.chunk(docs, "fixed", size=16, overlap=0, tokenizer="bpe:/opt/tokenizers/byte_bpe_50k.tiktoken").collect()
    assert all(c.n_tokens <= 17 for c in chunks) and len(chunks) >= 6


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1), (3, "d", 0)], "query_id bigint, chunk_id string, grade int")
    run = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "a", 3)], "query_id bigint, chunk_id string, rank int")
    got = {(r.query_id, r.k): r for r in metrics.per_query(qrels, run, (1, 3)).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 1), (2, 3)}
    r = got[1, 3]
    ideal = 2 / math.log2(2) + 1 / math.log2(3)
    assert (r.recall, r.mrr, r.hit_rate) == (1.0, 0.5, 1.0) and r.precision == pytest.approx(2 / 3, abs=1e-6)
    assert r.map == pytest.approx((1 / 2 + 2 / 3) / 2, abs=1e-6) and r.ndcg == pytest.approx((1 / math.log2(3) + 2 / math.log2(4)) / ideal, abs=1e-6)
    assert got[2, 3].recall == 0
    with pytest.raises(ValueError):
        metrics.per_query(qrels, run, (0,))
    assert metrics.check_run(run.union(run)).count() == 3


def test_significance():
    import numpy as np

    assert metrics.sign_flip(np.zeros(5)) == 1.0
    assert metrics.sign_flip(np.full(20, 0.5)) < 0.01
    mean, low, high = metrics.bootstrap(np.arange(10.0))
    assert low < mean == 4.5 < high


def test_pareto(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("b", 0.5, 3), ("c", 0.4, 3), ("d", 0.9, 9), ("e", 0.5, 4)], "name string, q double, c int")
    assert {r.name for r in metrics.pareto(df, "q", "c", "name").collect()} == {"a", "b"}


def test_dense_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in search.dense(df, df, 3, "l2").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(far, np.inf)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {i: np.argsort(far[i])[:3].tolist() for i in range(40)}


def test_embedding_quality_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((30, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    r = search.embedding_quality(df).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert r.n == 30 and r.anisotropy == pytest.approx((u @ u.T)[~np.eye(30, dtype=bool)].mean(), abs=1e-5) and r.participation == pytest.approx(s.sum() ** 2 / (s**2).sum(), abs=1e-5)


def test_hashed():
    import numpy as np

    assert np.linalg.norm(hashed("a b b c")) == pytest.approx(1) and not hashed("").any()


def test_embedders(spark):
    df = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None)], "chunk_id string, text string")
    assert {r.chunk_id: sum(x * x for x in r.embedding) for r in embed.hash_vectors(df).collect()} == pytest.approx({"a": 1.0, "b": 0.0, "c": 0.0}, abs=1e-5)
    assert {r.chunk_id: r.truncated for r in embed.truncate(df, 1).collect()} == {"a": True, "b": False, "c": None}
    assert embed.with_prefix(df, "intfloat/e5-small", True).first().text.startswith("query: ")
    assert {r.chunk_id: list(r.embedding) for r in embed.remote(df, lambda texts: [[float(len(t))] for t in texts]).collect()} == {"a": [11.0], "b": [0.0], "c": [0.0]}


def test_mmr_prefers_what_is_new(spark):
    chunks = spark.createDataFrame([("a", "x y z"), ("b", "x y z"), ("c", "u v w")], "chunk_id string, text string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id bigint, chunk_id string, rank int")
    assert [r.chunk_id for r in sorted(qs.mmr_rerank(hits, chunks, 3, 0.7).collect(), key=lambda r: r.rank)] == ["a", "c", "b"]


def test_assemble(spark):
    chunks = spark.createDataFrame([("a", 1, 0, 10, 5), ("b", 1, 5, 10, 2), ("c", 2, 0, 4, 4), ("d", 3, 0, 9, 9)], "chunk_id string, doc_id bigint, start int, end int, n_tokens int")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4)], "query_id bigint, chunk_id string, rank int")
    assert [r.chunk_id for r in sorted(qs.assemble(hits, chunks, 10).collect(), key=lambda r: r.place)] == ["a", "c"]


def test_filters(spark):
    items = spark.createDataFrame([(1, "What is the notice period of the contract"), (2, "What is the notice period of the contract"), (3, "Why so"), (4, "Does it apply to every supplier contract")], "item_id bigint, text string")
    assert {r.item_id: r.reason for r in qs.filter_chain(items).collect()} == {1: None, 2: "near-duplicate", 3: "too-short", 4: "dangling-reference"}


def test_fragments_keep_their_numbers(spark):
    """A fragment or a sentence that begins with a digit keeps it, and loses the blanks around it."""
    q = spark.createDataFrame([(1, "what is alpha beta; 1 gamma delta and 2 epsilon zeta"), (2, "")], "query_id bigint, text string")
    assert sorted(map(tuple, qs.decompose(q).collect())) == [(1, 0, "what is alpha beta; 1 gamma delta and 2 epsilon zeta"), (1, 1, "what is alpha beta"), (1, 2, "1 gamma delta"), (1, 3, "2 epsilon zeta"), (2, 0, "")]
    c = spark.createDataFrame([("a", "Short one here.  0 seven silver lanterns burned brightly.")], "chunk_id string, text string")
    assert qs.keyword_probes(c).first().quote == "0 seven silver lanterns burned brightly."


def test_specs():
    assert grid.parse_spec("chunker", "recursive:512,overlap=64") == ("recursive", {"size": 512, "overlap": 64})
    with pytest.raises(grid.SpecError):
        grid.parse_spec("chunker", "nothing:1")
    m = grid.Matrix({"index": ("bm25", "dense"), "embedder": (None, "tfidf")})
    kept, account = grid.distinct_runnable(m.factorial())
    assert account == {"given": 4, "impossible": 1, "repeated": 1, "kept": 2} and len(m.one_at_a_time()) == 3 and len(kept) == 2


def test_runner(spark):
    docs = spark.createDataFrame([(i, f"Document {i} speaks of topic{i} and of nothing else. " * 3) for i in range(6)], "doc_id bigint, text string")
    questions = spark.createDataFrame([(i, f"topic{i}") for i in range(6)], "query_id bigint, text string")
    gold = spark.createDataFrame([(i, i, 0, 40, 2) for i in range(6)], "item_id bigint, doc_id bigint, start int, end int, grade int")
    runner = grid.Runner(docs, questions, gold)
    configs = [grid.Config(index="bm25"), grid.Config(index="hybrid", embedder="tfidf", reranker="lexical")]
    out, notes = runner.sweep(configs)
    assert [n["status"] for n in notes] == ["ok", "ok"]
    board = grid.leaderboard(out, "recall", 5).collect()
    assert [r.value for r in board] == [1.0, 1.0]


def test_parsers_and_decoding(spark):
    raw = spark.createDataFrame([(1, bytearray(b"\xef\xbb\xbfabc")), (2, bytearray(b"\xff\xfe")), (3, bytearray(b"a\x00b")), (4, bytearray(b""))], "id int, content binary")
    got = {r.id: (r.text, r.binary) for r in raw.select("id", ch.decode(F.col("content")).alias("text"), ch.looks_binary(F.col("content")).alias("binary")).collect()}
    assert got == {1: ("abc", False), 2: ("", False), 3: ("a\x00b", True), 4: ("", False)}
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id bigint, text string")
    blocks = ch.parse(docs, "markdown")
    assert blocks.count() == 8 and ch.verify_blocks(blocks, docs).count() == 0


def test_pages(spark):
    docs = spark.createDataFrame([(1, "one<!-- page: 2 -->two<!--page:7-->seven"), (2, "<!-- page: 4 -->four"), (3, "none"), (4, None)], "doc_id bigint, text string")
    pages = ch.page_table(docs)
    assert sorted(map(tuple, pages.collect())) == [(1, 0, 1), (1, 3, 2), (1, 22, 7), (2, 0, 4), (3, 0, 1)]
    spans = spark.createDataFrame([(1, 0), (1, 21), (1, 22), (2, 3), (9, 0)], "doc_id bigint, start int")
    assert sorted((r.doc_id, r.start, r.page) for r in ch.page_at(spans, pages).collect()) == [(1, 0, 1), (1, 21, 2), (1, 22, 7), (2, 3, 4), (9, 0, None)]
    anchors = spark.createDataFrame([(1, 1, "seven", 0, 7)], "item_id bigint, doc_id bigint, quote string, occurrence int, page_hint int")
    assert resolve.resolve_anchors(anchors, ch.with_pages(docs)).first().strategy == "exact"


def test_blocks_at(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id bigint, text string")
    blocks = ch.parse(docs, "markdown")
    assert ch.blocks_of(blocks, "table", "code").count() == 2
    at = spark.createDataFrame([(1, 0), (1, MARKDOWN.index("| a")), (1, 5), (2, 0)], "doc_id bigint, at int")
    assert sorted(((r.doc_id, r.kind) for r in ch.block_at(at, blocks).collect()), key=str) == [(1, "heading"), (1, "table"), (1, None), (2, None)]
    chunks = ch.chunk(docs, "fixed", size=8)
    assert ch.require_parse(chunks, docs).count() == chunks.count()
    with pytest.raises(Exception, match="another parse"):
        ch.require_parse(chunks, docs.withColumn("text", F.upper("text"))).collect()


def test_quality_report_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 6)) + np.repeat(rng.standard_normal((12, 6)), 5, 0)
    x[41] = x[7] * 2  # one point, other words
    rows = [(i, i // 5, i % 5, f"word{i} only here", v.tolist()) for i, v in enumerate(x)]
    got = search.quality_report(spark.createDataFrame(rows, "chunk_id bigint, doc_id bigint, start int, text string, embedding array<double>"), every=1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    doc = np.arange(60) // 5
    c = u @ u.T
    across = c[doc[:, None] != doc].mean()
    adjacent = np.mean([c[i, i + 1] for i in range(59) if doc[i] == doc[i + 1]])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert got["anisotropy"] == pytest.approx(across) and got["separation"] == pytest.approx(adjacent - across) and got["redundancy"] == pytest.approx(across - adjacent)
    assert got["participation"] == pytest.approx(s.sum() ** 2 / (s**2).sum()) and got["collapsed"] == pytest.approx(2 / 60) and 0 <= got["score"] <= 1
