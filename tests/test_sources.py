"""Readers and writers of corpora and evaluation sets."""

import json

import pytest
from pyspark.sql import functions as F

from passagemill.sources import corpus, evalset


def test_corpus_from_dir(spark, tmp_path):
    for name, text in {"a.md": b"# A", "sub/b.txt": b"\xef\xbb\xbfb", ".hidden/c.txt": b"c", "node_modules/d.md": b"d", "e.bin": b"e", "f.txt": b"\xff"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    files = corpus.from_dir(spark, str(tmp_path))
    assert {(r.id, r.media_type) for r in files.collect()} == {("a.md", "markdown"), ("sub/b.txt", "text"), ("f.txt", "text")}
    assert {r.id: (r.text, r.decoded) for r in corpus.texts_of(files).collect()} == {"a.md": ("# A", True), "sub/b.txt": ("b", True), "f.txt": ("", False)}
    assert corpus.from_dir(spark, str(tmp_path), max_files=1).count() == 1 and corpus.of_type(files, "markdown").count() == 1


def test_jsonl_round_trip(spark, tmp_path):
    item = {"id": "q1", "question": "Q?", "gold": [{"doc_id": "d", "start": 1, "end": 3, "grade": 2}], "anchors": [], "qtype": "factoid", "answer": None, "meta": {"k": "v"}}
    (tmp_path / "in.jsonl").write_text('{"_evalset": {"id": "x"}}\n\n' + json.dumps(item) + "\nnot json\n")
    got = evalset.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    good = got.where("_bad is null").drop("_bad", "_line")
    assert good.count() == 1 and [r._line for r in got.where("_bad is not null").collect()] == [4]
    evalset.write_jsonl(good, str(tmp_path / "out"), {"id": "x", "version": 2})
    assert evalset.read_jsonl(spark, str(tmp_path / "out")).drop("_bad", "_line").collect() == good.collect()
    assert evalset.read_header(spark, str(tmp_path / "out")) == {"id": "x", "version": 2} and len(list((tmp_path / "out").glob("*.txt"))) == 1
    flags = evalset.subsets(good).first()
    assert (flags.answerable, flags.resolved, flags.portable) == (True, True, False)


def test_csv_ids_and_losses(spark, tmp_path):
    (tmp_path / "in.csv").write_text("question,source,quote\none,d,x\n,d,y\ntwo,d,z\n")
    items = evalset.read_csv(spark, str(tmp_path / "in.csv"))
    assert [(r.id, r.question) for r in items.orderBy("id").collect()] == [("q1", "one"), ("q2", "two")]
    assert evalset.write_csv(items, str(tmp_path / "out")) == 0
    more = items.withColumn("anchors", F.concat("anchors", "anchors"))
    with pytest.warns(UserWarning, match="2 items"):
        assert evalset.write_csv(more, str(tmp_path / "out")) == 2


def test_lookups(spark):
    texts = corpus.from_texts(spark, {"a.md": "# A", "b.md": "b"})
    assert corpus.get(texts, "a.md").text == "# A" and corpus.get(texts, "c") is None and corpus.require(texts, "b.md").text == "b"
    with pytest.raises(KeyError, match="near: b.md"):
        corpus.require(texts, "bb.md")
    assert [tuple(r) for r in corpus.media_types(texts).collect()] == [("text", 2)]
    one = spark.createDataFrame([(i, f"t{i % 50}") for i in range(90)], "doc_id bigint, text string")
    h = lambda d: corpus.content_hash(d).first().content_hash
    assert h(one) == h(one.repartition(5)) and h(one) != h(one.where("doc_id <> 3")) and len(h(one.limit(0))) == 64
    blocks = spark.createDataFrame([("table", 0, 30), ("paragraph", 30, 100)], "kind string, start int, end int")
    assert {r.kind: r.ratio for r in corpus.block_ratios(blocks).collect()} == {"table": 0.3, "paragraph": 0.7}


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text('﻿query,source,evidence,page\n"What, now?",d1,"a ""b""",3\n,d2,x,\n', encoding="utf-8")
    r = evalset.read_evalset(spark, str(tmp_path / "in.csv")).collect()
    assert len(r) == 1 and r[0].question == "What, now?" and r[0].anchors[0].quote == 'a "b"' and r[0].anchors[0].page_hint == 3 and r[0].anchors[0].grade == 2


def test_beir_and_nested(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"_id": "1", "text": "one"}\n{"_id": "2", "text": "two"}\n')
    judged = [("query-id", "corpus-id", "score"), ("1", "b", "1"), ("1", "a", "2"), ("2", "c", "0")]
    (tmp_path / "r.tsv").write_text("".join("\t".join(row) + "\n" for row in judged))
    assert [(r.id, list(r.doc_ids)) for r in evalset.read_beir(spark, str(tmp_path / "q.jsonl"), str(tmp_path / "r.tsv")).collect()] == [("1", ["a", "b"])]
    found = [dict(file_path="f", span=[1, 4]), dict(file_path="f", span=[4, 4]), dict(span=[1, 2])]
    nested = [dict(query="q", snippets=found), dict(query="", snippets=found[:1])]
    (tmp_path / "n.json").write_text(json.dumps(dict(tests=nested)))
    gold, skipped = evalset.read_legalbench(spark, str(tmp_path / "n.json"))
    assert [(r.id, r.start, r.end) for r in gold.collect()] == [("q1", 1, 4)]
    assert {r.reason: r["count"] for r in skipped.collect()} == {"empty span": 1, "no file": 1, "no question": 1}
