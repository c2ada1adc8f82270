"""Operators with an injected model, codecs, adapters and rules."""

import json

import numpy as np
import pytest

from passagemill.operators import codecs, models, rules, search


@pytest.mark.parametrize("reply,want", [('["a", "b", "a"]', ["a", "b"]), ('Here:\n```json\n["x"]\n```', ["x"]), ("- one\n2) two\n\n* three", ["one", "two", "three"]), (None, []), ("[broken", ["[broken"]), ("", [])])
def test_parse_list(reply, want):
    assert models.parse_list(reply) == want


def echo(prompts):
    return [json.dumps([p.splitlines()[-1] + f" {i}" for i in range(2)]) for p in prompts]


def test_rewrite_and_ingest(spark):
    q = spark.createDataFrame([(1, "what is it"), (2, "who")], "query_id bigint, text string")
    assert sorted(map(tuple, models.rewrite(q, echo, "multi-query").collect())) == [(1, 0, "what is it"), (1, 1, "what is it 0"), (1, 2, "what is it 1"), (2, 0, "who"), (2, 1, "who 0"), (2, 2, "who 1")]
    assert models.rewrite(q, lambda ps: [""] * len(ps), "hyde").count() == 2
    c = spark.createDataFrame([("a", "text a"), ("b", "text b")], "chunk_id string, text string")
    assert {r.indexed_id: (r.chunk_id, r.text) for r in models.ingest(c, echo, "propositions").collect()}["b#1"] == ("b", "text b 1")
    assert {r.text for r in models.ingest(c, lambda ps: [""] * len(ps), "propositions").collect()} == {"text a", "text b"}
    assert models.ingest(c, lambda ps: ["ctx"] * len(ps), "contextual").where("chunk_id = 'a'").first().text == "ctx\n\ntext a"
    hits = spark.createDataFrame([(1, "a#0", 0.5, 1), (1, "a#1", 0.9, 2), (1, "b#0", 0.7, 3)], "query_id bigint, chunk_id string, score double, rank int")
    assert [(r.chunk_id, r.rank) for r in sorted(models.to_returned(hits, models.ingest(c, echo, "propositions"), 5).collect(), key=lambda r: r.rank)] == [("a", 1), ("b", 2)]


def test_ask_skips_null_prompts(spark):
    t = spark.createDataFrame([(1, "x"), (2, None)], "id bigint, prompt string")
    assert {r.id: r.reply for r in models.ask(t, lambda ps: [p.upper() for p in ps]).collect()} == {1: "X", 2: None}


def test_agentic_and_rerank(spark):
    chunks = spark.createDataFrame([("a", "red apple"), ("b", "green pear")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "pear")], "query_id bigint, text string")
    find = lambda qs, k: search.bm25(chunks, qs, k)
    assert {r.chunk_id for r in models.agentic(find, q, lambda ps: ['["apple", "pear"]'] * len(ps), 5).collect()} == {"a", "b"}
    assert [r.chunk_id for r in models.agentic(find, q, lambda ps: [""] * len(ps), 5).collect()] == ["b"]
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id bigint, chunk_id string, rank int")
    assert [r.chunk_id for r in sorted(models.rerank(hits, chunks, q, lambda question, texts: [float(question in t) for t in texts]).collect(), key=lambda r: r.rank)] == ["b", "a"]


def test_answer(spark):
    c = spark.createDataFrame([(1, "q?", ["p1", "p2"])], "query_id bigint, question string, passages array<string>")
    r = models.answer(c, lambda ps: ["Yes [2], and [2] [1]."] * len(ps)).first()
    assert list(r.cited) == [1, 2]


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(3).standard_normal((400, 16)) + np.repeat(np.random.default_rng(4).standard_normal((10, 16)) * 2, 40, 0)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").cache()


def test_product_and_ivf_recall(spark, vectors):
    asked = vectors.where("vec_id % 20 = 0")
    exact = search.dense(vectors, asked, 10, "dot")
    assert search.recall_against(codecs.product_search(vectors, asked, codecs.product_fit(vectors, 8, 64), 10), exact).first().recall > 0.5
    cosine = search.dense(vectors, asked, 10)
    assert search.recall_against(codecs.ivf_search(vectors, asked, 10, probes=3), cosine).first().recall > 0.9
    assert codecs.compression(vectors, "binary").first().ratio == 32


@pytest.mark.parametrize("name,metric", [("product_topk", "dot"), ("ivf_topk", "cosine")])
def test_registered_recall(spark, name, metric):
    """The registered searches against brute force."""
    from passagemill.plans import catalogue

    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = catalogue.QUERIES[name](spark, folder)
    recall = search.recall_against(found, search.dense(rows, rows.where("vec_id % 50 = 0"), 10, metric)).first().recall
    print(name, recall)
    assert recall >= 0.9


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codecs_by_numpy(vectors, codec):
    """Codes rank as plain numpy ranks them, and rescoring everything gives the exact order."""
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    asked = vectors.where("vec_id % 50 = 0")
    q = x[ids % 50 == 0]
    if codec == "scalar":
        lo, step = x.min(0), (x.max(0) - x.min(0)) / 255
        s = q @ (np.rint((x - lo) / step) * step + lo).T
    elif codec == "binary":
        bits = x > np.round(x.mean(0), 9)
        s = -(bits[ids % 50 == 0][:, None] != bits).sum(-1).astype(float)
    elif codec == "none":
        s = q @ x.T
    else:
        s = None
    if s is not None:
        s[ids[ids % 50 == 0][:, None] == ids] = -np.inf
        want = {(int(ids[ids % 50 == 0][i]), n + 1): round(float(v), 4) for i in range(len(q)) for n, v in enumerate(np.sort(s[i])[::-1][:5])}
        assert {(r.query_id, r.rank): round(r.score, 4) for r in codecs.quantized_search(vectors, asked, codec, 5).collect()} == pytest.approx(want, abs=2e-4)
    order = lambda df: sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())
    assert order(codecs.quantized_search(vectors, asked, codec, 5, 400)) == order(search.dense(vectors, asked, 5, "dot"))


def test_unknown_codec(vectors):
    with pytest.raises(ValueError):
        codecs.quantized_search(vectors, vectors, "zip")


def test_adapter_moves_queries_towards_answers(spark):
    rng = np.random.default_rng(5)
    q, turn = rng.standard_normal((200, 6)), np.linalg.qr(rng.standard_normal((6, 6)))[0]
    rows = [(a.tolist(), (a @ turn).tolist(), [0.0] * 6) for a in q]
    w = codecs.adapter_fit(spark.createDataFrame(rows, "q array<double>, pos array<double>, neg array<double>"), 1e-6)
    assert np.allclose(w, turn, atol=1e-3)
    t = spark.createDataFrame([(0, q[0].tolist())], "id bigint, embedding array<double>")
    assert np.allclose(codecs.adapter_apply(t, w).first().embedding, q[0] @ turn / np.linalg.norm(q[0]), atol=1e-3)


def test_triplets(spark):
    qrels = spark.createDataFrame([(1, "b", 1)], "query_id bigint, chunk_id string, grade int")
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "query_id bigint, chunk_id string, rank int")
    assert [(r.query_id, r.positive, list(r.negatives)) for r in codecs.mine_triplets(qrels, run).collect()] == [(1, "b", ["a", "c"])]


def test_rules(spark):
    results = spark.createDataFrame([("c1", "recall", 5, 1.0), ("c2", "recall", 5, 1.0)], "config_id string, metric string, k int, value double")
    chunks = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "doc_id bigint, start int, end int")
    configs = spark.createDataFrame([("quantized:binary", None, 50), ("bm25", "none", 100)], "index string, reranker string, candidates int")
    found = rules.unique(rules.at_ceiling(results, "recall", 5), rules.one_chunk_a_document(chunks), rules.approximate_alone(configs), rules.depth_without_reranker(configs), rules.at_ceiling(results, "recall", 5))
    assert sorted(r.code for r in found.collect()) == ["at_ceiling", "chunking_invisible", "depth_does_nothing", "no_exact_arm"]
    assert rules.validate(results, spark.createDataFrame([("recall", 5, 0.97)], "metric string, k int, expected double")).first().within
