"""Language ID, prefix counts and token files against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from passagemill.llm import langid, prefix_counts as pc, sequences
from passagemill.llm._common import code_points
from passagemill.llm.tokenizer import VOCABULARY, encoding

from .conftest import EDGES, LONG

SAMPLE = {"en": "the cat sat on the mat and the dog ran off\nwith it all", "de": "der hund und die katze sind nicht da\nüber den zaun", "xx": "qzv qzv qqz"}


def parse(text, train):
    """Greedy phrases of text among the substrings of train; a character that train lacks is a phrase."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train and text[at : at + size] in train:
            size += 1
        n, at = n + 1, at + size
    return n


def plain(text):
    return " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split())


def train_text(text):
    return "".join(plain(p) + " " for p in text.split("\n") if plain(p))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("thecat undrmüz.,!Q\n", max_size=40), min_size=1, max_size=5))
def test_phrases(texts):
    model = langid.Model(SAMPLE)
    low, offsets = langid.normalised(*code_points(pa.array(texts)))
    got = model.phrases(model.encode(low), offsets)
    assert np.diff(offsets).tolist() == [len(plain(t)) for t in texts]
    for i, lang in enumerate(model.languages):
        assert got[i].tolist() == [parse(plain(t), train_text(SAMPLE[lang])) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", min_size=1, max_size=6))
def test_suffix_automaton(text, part):
    nxt, state = langid.suffix_automaton(list(text)), 0
    for c in part:
        state = nxt[state].get(c, -1) if state >= 0 else -1
    assert (state >= 0) == (part in text)


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(df, langid.fit(df)).withColumnRenamed("lang", "found").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000 and sum(r.found == r.lang for r in found) >= 990
    assert sum(r.accepted for r in found) >= 998


def test_rare_label(docs):
    """A label with hardly any text neither takes texts from others nor lets everything pass."""
    rng = random.Random(2)
    strange = " ".join("".join(rng.choice("qxzjkvw") for _ in range(7)) for _ in range(40))
    data = docs([(1, "the cat sat on the mat and looked at the dog"), (2, strange), (3, "Кошка сидит на ковре и смотрит на собаку")])
    for texts in ({**SAMPLE, "rare": "ok"}, {**SAMPLE, "rare": "a short note about nothing much"}, {"rare": "a short note"}):
        found = {r.doc_id: r for r in langid.identify(data, langid.Model(texts)).collect()}
        assert not found[2].accepted and not found[3].accepted
        assert "en" not in texts or found[1].lang == "en"


def test_language_edges(docs, spark):
    model = langid.Model(SAMPLE)
    df = docs([*EDGES, (20, "the cat sat"), (21, "Кошка сидит на ковре и смотрит"), (22, "１２３ ...")])
    found = langid.identify(df, model, max_bits=2.8)  # a foreign character costs log2 of the text's length, 5 here
    assert found.columns == ["doc_id", "lang", "bits", "phrases", "chars", "accepted"]
    by = {r.doc_id: r for r in found.collect()}
    assert by[20].lang == "en" and by[20].accepted
    for i in (2, 3, 7, 22):
        assert by[i].lang is None and by[i].bits is None and not by[i].accepted
    assert not by[21].accepted and found.count() == len(EDGES) + 3
    assert langid.identify(docs([]), model).count() == 0
    none = langid.Model({})
    assert [r.accepted for r in langid.identify(docs([(1, "a")]), none).collect()] == [False]
    assert langid.keep_identified(docs([(1, "a")]), none).count() == 0
    kept = langid.keep_identified(df, model, max_bits=2.8)
    assert {r.doc_id for r in kept.collect()} >= {20} and 21 not in {r.doc_id for r in kept.collect()} and len(kept.columns) == len(df.columns)
    tie = langid.Model({"b": "same text", "a": "same text"})
    assert langid.identify(docs([(1, "same text")]), tie).first().lang == "a"
    assert langid.fit(docs([(None, "x"), (1, None)], lang=None)).languages == []


ENC = encoding(VOCABULARY)
PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'re", "'l", "don't", "12", "!", "?!", "é", "日本", "😀", " ", "ing", "X", "'", "\x1c", "​", "́", "²", "Ⅷ", " \n ", "'S", "'ve"]


def brute(t):
    return [len(ENC.encode_ordinary(t[:i])) for i in range(1, len(t) + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=4))
def test_prefix_counts(texts):
    got = pc.counter(VOCABULARY).counts(*code_points(pa.array(texts)))
    assert got.tolist() == sum(map(brute, texts), [])


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=25))
def test_prefix_counts_any_text(text):
    assert pc.counter(VOCABULARY).counts(*code_points(pa.array([text]))).tolist() == brute(text)


def test_prefix_query(docs):
    rng = random.Random(2)
    data = [*EDGES, (30, " " * 5000 + "a" * 6000 + " tail"), (31, "".join(rng.choice(PIECES) for _ in range(300)))]
    df = docs(data)
    counted = pc.prefix_counts(df, budgets=(5, 100))
    got = counted.collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id in (31, 1, 7):
            text = dict(data)[r.doc_id]
            counts = [0, *brute(text)]
            assert pc.decoded(r.differences, r.width).tolist() == counts and r.tokens == counts[-1]
            assert r.fit_5 == max(i for i, c in enumerate(counts) if c <= 5)
        if r.doc_id == 30:
            counts = pc.decoded(r.differences, r.width)
            for i in (1, 17, 4999, 5000, 5001, 5002, 7000, 10_999, 11_005):
                assert counts[i] == len(ENC.encode_ordinary(data[-2][1][:i]))
        if r.doc_id in (5, 6):
            assert r.tokens == len(ENC.encode_ordinary(LONG))
        if r.doc_id == 2:
            assert r.tokens is None and r.differences is None and r.fit_5 is None
        if r.doc_id == 3:
            assert r.tokens == 0 and r.differences == b"" and r.fit_5 == 0
    cut_ = {r.doc_id: r for r in pc.truncate(df.where("doc_id = 31"), counted, 40).collect()}
    assert cut_[31].tokens <= 40 and data[-1][1].startswith(cut_[31].text) and cut_[31].tokens == len(ENC.encode_ordinary(cut_[31].text))
    assert pc.prefix_counts(docs([])).count() == 0


def test_token_round_trip(docs, tmp_path):
    data = [*EDGES, (40, "a <|endoftext|> b")]
    files = sequences.token_files(docs(data), length=64, batch_rows=8, file_rows=40)
    rows = files.collect()
    assert all(r.sequences <= 40 for r in rows)
    back = {}
    for r in rows:
        reader = sequences.Reader(bytes(r.payload))
        assert len(reader) == r.sequences and {reader[i][0] for i in range(len(reader))} == set(r.doc_ids)
        for i in range(len(reader)):
            doc, part, ids, mask = reader[i]
            assert len(ids) == 64 and mask.any() and not ids[mask == 0].any() and not ids.flags.owndata
            back.setdefault(doc, []).append((part, ids[mask == 1].tolist()))
    for doc in (1, 5, 7, 8, 40):
        tokens = [x for _, ids in sorted(back[doc]) for x in ids]
        assert ENC.decode(tokens) == dict(data)[doc]
    assert len(back[4]) == 2 and back[4][0] == back[4][1] and set(back) == {1, None, 4, 5, 6, 7, 8, 40}
    assert sum(r.tokens for r in rows) == sum(len(ENC.encode_ordinary(t)) for _, t in data if t)
    n = sequences.write_files(files, str(tmp_path / "out"))
    written = sorted((tmp_path / "out").glob("*.arrow"))
    assert n == len(written) == len(rows) and sum(len(sequences.Reader(p)) for p in written) == sum(r.sequences for r in rows)
    assert {sequences.Reader(p)[0][0] for p in written} <= set(back)
    equal = docs([(1, "one two three " * 40)] * 4).repartition(1)
    files = sequences.token_files(equal, length=64, batch_rows=1, file_rows=sequences.token_files(equal, length=64).first().sequences // 4)
    assert files.select("payload").distinct().count() == 1 and sequences.write_files(files, str(tmp_path / "equal")) == 4
    assert len(list((tmp_path / "equal").glob("*.arrow"))) == 4
    text = sequences.token_files(docs(data).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).first()
    assert "d1" in text.doc_ids and {sequences.Reader(text.payload)[i][0] for i in range(2)} <= set(text.doc_ids)
    assert sequences.token_files(docs([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9])
def test_reader_sizes(n):
    run = sequences._batches(4, 4, 100, VOCABULARY)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["a"] * n, pa.string())], ["id", "text"])
    files = list(run([batch]))
    assert len(files) == (n > 0)
    for f in files:
        reader = sequences.Reader(f.column(3)[0].as_py())
        assert len(reader) == n and [reader[i][0] for i in range(n)] == list(range(n))
        with pytest.raises(IndexError):
            reader[n]
