"""The pipeline against a brute-force run of its stages, and its registration."""

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from passagemill.llm import langid, mixing, omh, packing, queries

from .conftest import EDGES
from .test_dedup import roots
from .test_layout import ENC, check_pack


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(table)
    accepted = {r.doc_id for r in langid.identify(table, model).where("accepted").collect()}
    docs = {r.doc_id: r for r in table.collect() if r.doc_id in accepted}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i].text, i)
    docs = {i: docs[i] for i in first.values()}
    words = {i: omh.words_of(d.text) for i, d in docs.items()}
    ids = sorted(docs)
    near = roots([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if omh.edit_similarity(words[a], words[b], omh.THRESHOLD)])
    docs = {i: d for i, d in docs.items() if near.get(i, i) == i}
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(d.text)
    share = mixing.water_fill(sizes, {s: mixing.TARGET_WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in sizes}, sum(sizes.values()), mixing.MAX_EPOCHS)
    mixed = []
    for i, d in docs.items():
        rate = share[d.source] / sizes[d.source]
        whole = int(rate)
        drawn = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:15], 16)
        mixed += [(i, d.text)] * (whole + (drawn < int((rate - whole) * mixing.UNIT)))
    rows = corpus_pipeline.run(spark, sf).collect()
    check_pack(rows, mixed, packing.CAPACITY, lambda t: len(ENC.encode_ordinary(t or "")))


def test_stages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(20), "").columns == table.columns
        assert stage(spark, table.limit(0), "").columns == table.columns and stage(spark, table.limit(0), "").count() == 0
    assert corpus_pipeline.best_fit_packing(spark, table.limit(0), "").count() == 0


def test_stages_on_edges(spark, docs):
    """Nulls, empty and long texts, repeats and clashing names, through each stage alone and through all of them."""
    df = docs([*EDGES, (9, "the cat and the dog ran over the road to the house"), (None, "the cat and the dog ran over the road to the house")])
    texts = lambda d: sorted(((r.doc_id, (r.text or "")[:20]) for r in d.select("doc_id", "text").collect()), key=str)
    kept = corpus_pipeline.language_id(spark, df, "")
    assert {t for _, t in texts(kept)} <= {(t or "")[:20] for _, t in EDGES if t and any(c.isalpha() for c in t)} | {"the cat and the dog ran"[:20]}
    assert "lang" in kept.columns and kept.where("lang is null").count() == 0
    once = corpus_pipeline.exact_dedup(spark, df, "")
    assert len(texts(once)) == len(EDGES) + 2 - 2 - 1 - 1  # two copies of 1, one of 5, the row without an id
    near = corpus_pipeline.near_dedup(spark, df, "")
    assert {i for i, _ in texts(df)} - {i for i, _ in texts(near)} == {4, 6}
    assert set(corpus_pipeline.mix_sources(spark, df, "").columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
    check_pack(corpus_pipeline.best_fit_packing(spark, df, "").collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], packing.CAPACITY, lambda t: len(ENC.encode_ordinary(t or "")))
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() >= 0


def test_language_stage_takes_effect(spark):
    """What is no text goes, what is stays, and lang is the language found."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    noise = [(10_001, "4711 0815 !!! --- 12:30"), (10_002, "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b" * 20), (10_003, " ".join(f"{i * 7919:x}zq{i * 104729:o}kx" for i in range(60)))]
    rows = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in noise], table.schema)
    kept = corpus_pipeline.language_id(spark, table.unionByName(rows), "")
    assert kept.where("doc_id > 10000").count() == 0 and kept.count() >= 0.95 * table.count()
    wrong = kept.select("doc_id", F.col("lang").alias("found")).join(table, "doc_id").where("found <> lang").count()
    assert wrong <= 0.05 * table.count()


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
