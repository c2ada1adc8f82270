"""Operators that ask a language model. The model is an injected function of prompts to replies, so that nothing here
knows a provider: it runs in Arrow batches on the workers, a batch of prompts a call."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

Model = Callable[[Sequence[str]], Sequence[str]]

_FENCED = re.compile(r"`{3}\w*\s*(.*?)`{3}", re.S)
_BULLET = re.compile(r"\A\s*(?:\d+[).]|[•*-])\s*")


def parse_list(reply: str | None, most: int | None = None) -> list:
    """The texts of a reply: a JSON array, fenced or not, or lines with or without bullets; each once, in order."""
    body = (reply or "").strip()
    if m := _FENCED.search(body):
        body = m[1].strip()
    found: list = []
    lo, hi = body.find("["), body.rfind("]")
    if 0 <= lo < hi:
        try:
            found = [x for x in json.loads(body[lo : hi + 1]) if isinstance(x, str)]
        except ValueError:
            found = []
    if not found:
        found = [_BULLET.sub("", line) for line in body.splitlines()]
    out = list(dict.fromkeys(s for x in found if (s := x.strip().strip('"').strip())))
    return out if most is None else out[:most]


def ask(table: DataFrame, model: Model, prompt_col: str = "prompt", id_cols: Sequence[str] = ("id",), batch: int = 32) -> DataFrame:
    """(ids..., reply, prompt_chars, reply_chars) for every row; a null prompt is not asked and has a null reply."""
    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                prompts = part.column(len(id_cols)).to_pylist()
                said = iter(model([p for p in prompts if p is not None]) if any(p is not None for p in prompts) else ())
                replies = [None if p is None else next(said) for p in prompts]
                sizes = [pa.array([len(x or "") for x in xs], pa.int64()) for xs in (prompts, replies)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(id_cols)], pa.array(replies, pa.string()), *sizes], [*id_cols, "reply", "prompt_chars", "reply_chars"])

    return table.select(*id_cols, prompt_col).mapInArrow(run, f"{kinds}, reply string, prompt_chars bigint, reply_chars bigint")


def _listed(most: int | None):
    return F.pandas_udf(lambda s: s.map(lambda r: parse_list(r, most)), "array<string>")


#: What each way of rewriting asks for, how many replies it takes, and whether the question itself is searched too.
REWRITES = {
    "hyde": ("Write a short passage that would answer this question:\n", 1, True),
    "multi-query": ("Rephrase this question in {n} different ways, as a JSON array of strings:\n", 3, True),
    "decompose": ("Split this question into at most {n} simpler ones, as a JSON array of strings:\n", 3, True),
    "step-back": ("Ask a more general question behind this one. Reply with it alone:\n", 1, True),
}


def rewrite(questions: DataFrame, model: Model, way: str, n: int | None = None) -> DataFrame:
    """(query_id, part, text): what is searched for each question, itself first; equal texts once."""
    prompt, most, keep = REWRITES[way]
    most = n or most
    asked = questions.select(F.col("query_id").alias("id"), F.concat(F.lit(prompt.format(n=most)), F.col("text")).alias("prompt"))
    replies = ask(asked, model).withColumnRenamed("id", "query_id")
    more = F.array(F.trim(F.coalesce("reply", F.lit("")))) if most == 1 else _listed(most)("reply")
    both = questions.select("query_id", "text").join(replies.select("query_id", more.alias("more")), "query_id")
    every = F.array_distinct(F.concat(F.array("text"), "more") if keep else F.col("more"))
    return both.select("query_id", F.posexplode(F.filter(every, lambda x: F.length(x) > 0)).alias("part", "text"))


#: What each way of indexing asks for.
INGESTIONS = {
    "contextual": "In one or two sentences, say where this passage stands in its document and what it is about:\n",
    "hypothetical-questions": "List {n} questions that this passage answers, as a JSON array of strings:\n",
    "propositions": "List at most {n} facts that this passage states, each complete by itself, as a JSON array of strings:\n",
}


def ingest(chunks: DataFrame, model: Model, way: str, n: int = 3) -> DataFrame:
    """(indexed_id, chunk_id, text): what is indexed in place of each chunk, and the chunk that it returns. A chunk that the
    model says nothing of is indexed as it is."""
    asked = chunks.select(F.col("chunk_id").alias("id"), F.concat(F.lit(INGESTIONS[way].format(n=n)), F.col("text")).alias("prompt"))
    replies = ask(asked, model).select(F.col("id").alias("chunk_id"), "reply")
    own = chunks.select("chunk_id", F.col("text").alias("own")).join(replies, "chunk_id")
    if way == "contextual":
        said = F.trim(F.coalesce("reply", F.lit("")))
        return own.select(F.col("chunk_id").alias("indexed_id"), "chunk_id", F.when(said != "", F.concat(said, F.lit("\n\n"), F.col("own"))).otherwise(F.col("own")).alias("text"))
    listed = own.withColumn("l", _listed(n)("reply"))
    listed = listed.withColumn("l", F.when(F.size("l") > 0, F.col("l")).otherwise(F.array("own")))
    return listed.select("chunk_id", F.posexplode("l").alias("n", "text")).select(F.concat("chunk_id", F.lit("#"), "n").alias("indexed_id"), "chunk_id", "text")


def summarise(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text): a summary to index for each document; the document itself where there is none."""
    asked = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("Summarise this document in a few sentences:\n"), F.col("text")).alias("prompt"))
    said = ask(asked, model).select(F.col("id").alias("doc_id"), F.trim("reply").alias("reply"))
    return docs.select("doc_id", "text").join(said, "doc_id").select("doc_id", F.when(F.length("reply") > 0, F.col("reply")).otherwise(F.col("text")).alias("text"))


def to_returned(hits: DataFrame, mapping: DataFrame, k: int) -> DataFrame:
    """Hits of what is indexed as hits of what is returned: mapping(indexed_id, chunk_id); the best score counts."""
    best = hits.withColumnRenamed("chunk_id", "indexed_id").join(mapping.select("indexed_id", "chunk_id"), "indexed_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)


def agentic(search: Callable[[DataFrame, int], DataFrame], questions: DataFrame, model: Model, k: int, max_queries: int = 4) -> DataFrame:
    """The model plans at most max_queries searches for each question; without a plan the question is searched."""
    from .questions import fuse_parts

    asked = questions.select(F.col("query_id").alias("id"), F.concat(F.lit(f"Plan at most {max_queries} searches to answer this, as a JSON array of strings:\n"), F.col("text")).alias("prompt"))
    plans = ask(asked, model).select(F.col("id").alias("query_id"), _listed(max_queries)("reply").alias("l"))
    both = questions.join(plans, "query_id").select("query_id", F.when(F.size("l") > 0, F.col("l")).otherwise(F.array("text")).alias("l"))
    return fuse_parts(search, both.select("query_id", F.posexplode("l").alias("part", "text")), k)


def answer(contexts: DataFrame, model: Model) -> DataFrame:
    """contexts(query_id, question, passages array<string>) -> (query_id, answer, cited): the numbers of the passages that
    the answer names."""
    shown = F.concat_ws("\n\n", F.transform("passages", lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)))
    prompt = F.concat(F.lit("Answer from these passages alone and cite them by number, as [1]. If they do not say, say that you do not know.\n\n"), shown, F.lit("\n\nQuestion: "), F.col("question"))
    said = ask(contexts.select(F.col("query_id").alias("id"), prompt.alias("prompt")), model)
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("reply", F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("int"))))
    return said.select(F.col("id").alias("query_id"), F.col("reply").alias("answer"), cited.alias("cited"))


def write_questions(chunks: DataFrame, model: Model, least_words: int = 25, n: int = 1) -> DataFrame:
    """(chunk_id, question): questions about each chunk of at least so many words."""
    from ..functions.text import words

    long = chunks.where(F.size(words(F.col("text"))) >= least_words)
    asked = long.select(F.col("chunk_id").alias("id"), F.concat(F.lit(f"Write {n} question(s) that only this passage answers, as a JSON array of strings:\n"), F.col("text")).alias("prompt"))
    return ask(asked, model).select(F.col("id").alias("chunk_id"), F.explode(_listed(n)("reply")).alias("question"))


def rerank(hits: DataFrame, chunks: DataFrame, questions: DataFrame, score: Callable[[str, Sequence[str]], Sequence[float]], k: int = 10, most_chars: int = 8000) -> DataFrame:
    """Hits of each query in the order of an injected scoring service; texts are sent up to most_chars characters, which
    is the service's own limit. Ties go to the smaller id."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(score=[round(float(x), 6) for x in score(pdf["q"].iloc[0], [t[:most_chars] for t in pdf["text"]])]).sort_values(["score", "chunk_id"], ascending=[False, True])[:k]
        return pdf.assign(rank=range(1, len(pdf) + 1))[["query_id", "chunk_id", "score", "rank"]]

    j = hits.select("query_id", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("query_id", F.col("text").alias("q")), "query_id")
    kind = j.schema["query_id"].dataType.simpleString()
    return j.groupBy("query_id").applyInPandas(run, f"query_id {kind}, chunk_id string, score double, rank int")
