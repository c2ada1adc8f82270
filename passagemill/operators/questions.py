"""Queries, rerankers, evaluation sets, context and answers."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..runtime import cut, sized
from .search import rrf, top_k

#: Words that carry no topic: articles, pronouns, auxiliaries and question words of English.
STOPWORDS = "a an and are as at be by can do does for from has have how i in is it of on or that the this to was what when where which who why will with you your".split()


def expand(question: Column, acronyms: dict[str, str]) -> Column:
    """Each acronym, as a whole word in any case, followed by what it stands for."""
    for short, long in acronyms.items():
        question = F.regexp_replace(question, rf"(?i)\b({re.escape(short)})\b", f"$1 {long}")
    return question


def decompose(questions: DataFrame, min_words: int = 2, max_parts: int = 4) -> DataFrame:
    """(query_id, part, text): the question, then fragments between and, or, also, ; and ?, of at least min_words words
    beside stop words, each set of words once; max_parts in all."""
    stop = F.array(*map(F.lit, STOPWORDS))
    pieces = F.transform(F.concat(F.array(F.col("text")), F.split(F.col("text"), r"(?i)\s*(?:[;?]|,?\s+(?:and|or|also)\b)\s*")), lambda x: F.trim(x))
    parts = questions.select("query_id", F.posexplode(pieces).alias("n", "text"))
    sig = F.array_sort(F.array_distinct(F.array_except(tx.words(F.col("text")), stop)))
    parts = parts.withColumn("sig", sig).where((F.col("n") == 0) | (F.size("sig") >= min_words))
    first = parts.withColumn("again", F.row_number().over(W.partitionBy("query_id", "sig").orderBy("n"))).where("again = 1")
    return first.withColumn("part", F.row_number().over(W.partitionBy("query_id").orderBy("n")) - 1).where(F.col("part") < max_parts).select("query_id", "part", "text")


def fuse_parts(search: Callable[[DataFrame, int], DataFrame], parts: DataFrame, k: int) -> DataFrame:
    """Search each part and fuse the lists of a question by reciprocal ranks. search(queries(query_id, text), k)."""
    keyed = parts.withColumn("p", F.struct("query_id", "part"))
    hits = search(keyed.select(F.col("p").alias("query_id"), "text"), k)
    return rrf([hits.withColumn("query_id", F.col("query_id.query_id"))], k)


def feedback_terms(hits: DataFrame, chunks: DataFrame, queries: DataFrame, terms: int = 5) -> DataFrame:
    """(query_id, term): of the best chunk's words that the query lacks, those it has least often, ties by word."""
    best = chunks.select("chunk_id", "text").join(sized(cut(hits.where("rank = 1").select("query_id", "chunk_id"))), "chunk_id").select("query_id", F.explode(tx.words(F.col("text"))).alias("term"))
    asked = queries.select("query_id", F.explode(tx.words(F.col("text"))).alias("term")).distinct()
    counted = best.join(asked, ["query_id", "term"], "left_anti").groupBy("query_id", "term").agg(F.count("*").alias("n"))
    return counted.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("n", "term"))).where(F.col("pos") <= terms).select("query_id", "pos", "term")


def relevance_feedback(search: Callable[[DataFrame, int], DataFrame], chunks: DataFrame, queries: DataFrame, k: int, terms: int = 5) -> DataFrame:
    """Search, search again with the best chunk's rarest words, and fuse both lists. The first list and the second queries are
    materialised: the search reads its queries several times, and each time they would be searched for anew."""
    first = cut(search(queries, k))
    more = feedback_terms(first, chunks, queries, terms).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("t"))
    again = queries.join(more, "query_id").select("query_id", F.concat_ws(" ", F.col("text"), F.concat_ws(" ", "t")).alias("text"))
    return rrf([first, search(cut(again), k)], k)


def lexical_rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 10, length_penalty: float = 0.25) -> DataFrame:
    """Rank hits by the share of the query's distinct words they have, plus 0.1 * matches / length ** penalty."""
    q = queries.select("query_id", F.array_distinct(tx.words(F.col("text"))).alias("q"))
    c = chunks.select("chunk_id", tx.words(F.col("text")).alias("w"))
    j = hits.select("query_id", "chunk_id").join(q, "query_id").join(c, "chunk_id")
    both = F.size(F.array_intersect("q", "w"))
    every = F.size(F.filter("w", lambda x: F.array_contains(F.col("q"), x)))
    score = F.when(F.size("q") > 0, both / F.size("q")).otherwise(F.lit(0.0)) + F.when(F.size("w") > 0, 0.1 * every / F.pow(F.size("w"), F.lit(length_penalty))).otherwise(F.lit(0.0))
    return top_k(j.select("query_id", "chunk_id", F.round(score, 6).alias("score")), k)


def mmr_rerank(hits: DataFrame, chunks: DataFrame, k: int = 10, diversity: float = 0.3) -> DataFrame:
    """Pick hits one by one: (1 - diversity) * (1 - place / n) - diversity * the largest Jaccard similarity to those picked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        sets, n, left, out = [set(w) for w in pdf["w"]], len(pdf), list(range(len(pdf))), []
        near = [0.0] * n
        while left and len(out) < k:
            score, _, at = max(((1 - diversity) * (1 - i / n) - diversity * near[i], -i, i) for i in left)
            out.append((pdf["query_id"][at], pdf["chunk_id"][at], round(score, 6), len(out) + 1))
            left.remove(at)
            for i in left:
                union = len(sets[i] | sets[at])
                near[i] = max(near[i], len(sets[i] & sets[at]) / union if union else 0.0)
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "score", "rank"])

    j = hits.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", tx.words(F.col("text")).alias("w")), "chunk_id")
    kind = j.schema["query_id"].dataType.simpleString()
    return j.groupBy("query_id").applyInPandas(run, f"query_id {kind}, chunk_id string, score double, rank int")


def _phrases(*parts: str) -> str:
    """Any of the phrases between word borders, in any case; Java and RE2 read it alike."""
    return r"(?i)\b(" + "|".join(parts) + r")\b"


PATTERNS = (
    ("summarisation", _phrases("overview", "outline", r"summar\w*", "describe the", "in general", "what are the (main|key)")),
    ("comparative", _phrases("compare", "comparison", "difference between", "versus", r"vs\.?", "(more|less|higher|lower) than", "which is (better|cheaper|more|less)")),
    ("tabular", _phrases("table", "tier", "row", "column", "rate", "price", "fee", "cost", "monthly", "annual", "per month", "schedule of")),
    ("numeric", _phrases("number of", "what percentage", "how (far|long|many|much|often)", r"\d+\s*(%|years?|months?|days?)", r"within \d+")),
    ("multi_hop", _phrases("for every", "in each", "across (both|all)", "both .+ and", "after .+ what", "and (then|also)")),
)


def classify(question: Column, has_evidence: Column | None = None) -> Column:
    """The type of a question: the first pattern that matches, else factoid; unanswerable without evidence."""
    out = F.when(~has_evidence, "unanswerable") if has_evidence is not None else F.when(F.lit(False), "")
    for label, pattern in PATTERNS:
        out = out.when(question.rlike(pattern), label)
    return out.otherwise("factoid")


def too_short(question: Column, least: int = 4) -> Column:
    return F.size(tx.words(question)) < least


DANGLING = r"(?i)\b(he|her|him|his|it|its|she|that|their|them|these|they|this|those)\b"


def dangling(question: Column) -> Column:
    """Whether the first pronoun has nothing before it that it could mean: an article and a noun, or a capitalised word
    that is not the first."""
    before = F.regexp_extract(question, r"(?is)^(.*?)" + DANGLING[4:], 1)
    named = before.rlike(r"(?i)\b(these|this|an?|the)\s+\w") | F.regexp_replace(before, r"^\s*\S+\s*", "").rlike(r"\b[A-Z][a-z]{1,}\b")
    return question.rlike(DANGLING) & ~named


def drop_similar(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(item_id, duplicate_of): questions whose words are as similar (Jaccard) to an earlier one that was kept, and the first
    such one.

    Questions of equal words stand behind the first of them. Candidates share one of their rarest words, as many as it takes
    for two sets of this similarity to meet there. Which are kept is settled in rounds: a question goes once an earlier
    similar one is kept, and is kept once all earlier similar ones are gone; rounds are as many as the longest chain."""
    sets = items.select("item_id", F.array_sort(F.array_distinct(tx.words(F.col("text")))).alias("w")).where("size(w) > 0")
    sets = sets.withColumn("key", F.sha2(F.array_join("w", " "), 256))
    groups = cut(sets.groupBy("key").agg(F.min("item_id").alias("rep"), F.min_by("w", "item_id").alias("w")))
    copies = sets.join(groups.select("key", "rep"), "key").where("item_id <> rep").select("item_id", "rep")
    each = groups.select("rep", F.size("w").alias("n"), F.explode("w").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("rep").orderBy("df", "word"))
    least = F.ceil(F.round(F.lit(threshold) * F.col("n"), 9))
    rare = each.join(df, "word").withColumn("place", place).where(F.col("place") <= F.col("n") - least + 1).select("rep", "n", "word")
    a, b = (rare.select("word", F.col("rep").alias("i" + x), F.col("n").alias("n" + x)) for x in "ab")
    near = a.join(b, "word").where("ia < ib").where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9).select("ia", "ib").distinct()
    own = groups.select("rep", "w")
    both = near.join(own.withColumnsRenamed({"rep": "ia", "w": "wa"}), "ia").join(own.withColumnsRenamed({"rep": "ib", "w": "wb"}), "ib")
    alike = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    pairs = cut(both.where(alike >= threshold).select("ia", "ib"))
    state = cut(pairs.select(F.col("ia").alias("item_id")).union(pairs.select("ib")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        earlier = pairs.join(state.select(F.col("item_id").alias("ia"), "kept"), "ia").groupBy(F.col("ib").alias("item_id")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("meets"), F.bool_and(F.coalesce(~F.col("kept"), F.lit(False))).alias("free"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("meets"), F.lit(False)).when(F.coalesce("free", F.lit(True)), F.lit(True))
        state = cut(state.join(earlier, "item_id", "left").select("item_id", now.alias("kept")))
    gone = pairs.join(state.where("kept").select(F.col("item_id").alias("ia")), "ia").join(state.where("not kept").select(F.col("item_id").alias("ib")), "ib").groupBy(F.col("ib").alias("item_id")).agg(F.min("ia").alias("duplicate_of"))
    behind = copies.join(gone.withColumnRenamed("item_id", "rep"), "rep", "left").select("item_id", F.coalesce("duplicate_of", "rep").alias("duplicate_of"))
    return gone.unionByName(behind)


def filter_chain(items: DataFrame, baseline: DataFrame | None = None, unresolved: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """(item_id, reason): the first filter that rejects each question, null if none does. baseline(item_id, score);
    unresolved(item_id); answers(item_id, expected, given): what a model answers without the corpus."""
    dup = drop_similar(items.where(~too_short(F.col("text")) & ~dangling(F.col("text")))).select("item_id", F.lit(True).alias("dup"))
    j = items.join(dup, "item_id", "left")
    none = items.sparkSession.createDataFrame([], "item_id bigint")
    j = j.join((unresolved if unresolved is not None else none).select("item_id", F.lit(True).alias("lost")), "item_id", "left")
    easy = baseline.where("score >= 1.0").select("item_id", F.lit(True).alias("easy")) if baseline is not None else none.select("item_id", F.lit(True).alias("easy"))
    j = j.join(easy, "item_id", "left")
    if answers is not None:
        a, b = F.array_distinct(tx.words(F.col("expected"))), F.array_distinct(tx.words(F.col("given")))
        alike = F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0)) >= 0.6
        j = j.join(answers.where(alike).select("item_id", F.lit(True).alias("known")), "item_id", "left")
    else:
        j = j.withColumn("known", F.lit(None).cast("boolean"))
    reason = F.when(too_short(F.col("text")), "too-short").when(dangling(F.col("text")), "dangling-reference").when(F.col("lost"), "unresolved-evidence").when(F.col("dup"), "near-duplicate").when(F.col("easy"), "non-discriminating").when(F.col("known"), "general-knowledge")
    return j.select("item_id", reason.alias("reason"))


def minimum_detectable(n: Column) -> Column:
    """The smallest difference of means that n questions show, rounded up to two places."""
    return F.ceil(F.round(F.lit(2.8) * F.sqrt(F.lit(0.5) / n), 9) * 100) / 100


def keyword_probes(chunks: DataFrame, terms: int = 6) -> DataFrame:
    """(chunk_id, question, quote): the words of over three letters of each chunk's longest sentence that fewest chunks have. What
    meets the counts of the words is a chunk's id and a word; the quote joins them once, by chunk."""
    w = F.filter(F.array_distinct(tx.words(F.col("text"))), lambda x: F.length(x) > 3)
    df = chunks.select(F.explode(w).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    parts = F.transform(F.filter(F.regexp_extract_all(F.col("text"), F.lit(r"[^\n?!.]+[?!.]?"), 0), lambda s: F.length(F.trim(s)) > 0), lambda x: F.trim(x))
    longest = F.array_max(F.transform(parts, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    picked = chunks.select("chunk_id", longest.alias("quote")).where("quote is not null")
    each = picked.select("chunk_id", F.explode(F.array_distinct(tx.words(F.col("quote")))).alias("word")).where(F.length("word") > 3).join(df, "word")
    rows = each.select("chunk_id", F.struct("df", "word").alias("t"), F.lit(None).cast("string").alias("quote")).unionByName(picked.select("chunk_id", F.lit(None).alias("t"), "quote"), allowMissingColumns=True)
    asked = rows.groupBy("chunk_id").agg(F.slice(F.array_sort(F.collect_set("t")), 1, terms).alias("q"), F.max("quote").alias("quote"))
    return asked.where(F.size("q") >= 2).select("chunk_id", F.array_join(F.transform("q", lambda x: x["word"]), " ").alias("question"), "quote")


def spread_sample(chunks: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """size chunks, dealt round by round over the documents; a document's order is a seeded hash of its chunks."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id"))), "chunk_id"))
    return chunks.withColumn("nth", nth).orderBy("nth", "doc_id").limit(size)


def review(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items after a review: decisions(item_id, decision, text, seq), the last of each item counts; rejected and skipped
    ones go, edited ones have the new text."""
    last = decisions.withColumn("n", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("seq")))).where("n = 1").select("item_id", "decision", F.col("text").alias("edit"))
    j = items.join(last, "item_id", "left").where(~F.coalesce(F.col("decision").isin("reject", "skip"), F.lit(False)))
    return j.withColumn("text", F.when(F.col("decision") == "edit", F.coalesce("edit", "text")).otherwise(F.col("text"))).drop("decision", "edit")


def assemble(hits: DataFrame, chunks: DataFrame, budget: int = 2000, order: str = "relevance") -> DataFrame:
    """(query_id, place, chunk_id, tokens): the context of each query. Chunks that those kept cover together go; then the
    longest prefix within the budget of tokens, one chunk at least; then by relevance, ends, position or reversed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, held = [], {}
        for r in pdf.sort_values("rank").itertuples():
            lo = r.start
            for a, b in sorted(held.get(r.doc_id, [])):
                if a <= lo < b:
                    lo = b
            if lo < r.end or not kept:
                kept.append(r)
                held.setdefault(r.doc_id, []).append((r.start, r.end))
        used, out = 0, []
        for r in kept:
            used += r.n_tokens
            if out and used > budget:
                break
            out.append(r)
        if order == "ends":
            out = out[::2] + out[1::2][::-1]
        elif order == "position":
            out.sort(key=lambda r: (r.doc_id, r.start))
        elif order == "reversed":
            out.reverse()
        return pd.DataFrame([(r.query_id, i, r.chunk_id, r.n_tokens) for i, r in enumerate(out)], columns=["query_id", "place", "chunk_id", "tokens"])

    j = hits.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "doc_id", "start", "end", "n_tokens"), "chunk_id")
    return j.groupBy("query_id").applyInPandas(run, "query_id bigint, place int, chunk_id string, tokens int")


def extractive(hits: DataFrame, chunks: DataFrame, sentences: int = 2) -> DataFrame:
    """(query_id, answer): the first sentences of the best chunk."""
    first = F.pandas_udf(lambda s: s.map(lambda t: " ".join(t[a:b] for a, b in tx.sentences(t)[:sentences])), "string")
    return hits.where("rank = 1").join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", first("text").alias("answer"))


REFUSAL = r"(?i)(i (do not|don't) know|cannot (answer|be answered)|not (in|enough) (the )?(context|information))"


def score_answers(answers: DataFrame) -> DataFrame:
    """answers(query_id, answer, context array<string>, gold, answerable) -> groundedness, the share of the answer's
    words that the context has; evidence_overlap, of the gold's words that the answer has; citation_accuracy, of [n]
    that name a passage, null without any; abstention_correct."""
    bag = lambda c: F.array_distinct(tx.words(c))
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))
    plain = F.regexp_replace("answer", r"\[\d+\]", " ")
    cited = F.regexp_extract_all(F.col("answer"), F.lit(r"\[(\d+)\]"), 1)
    valid = F.filter(cited, lambda n: n.cast("int").between(1, F.size("context")))
    return answers.select(
        "query_id", F.round(share(bag(plain), bag(F.concat_ws(" ", "context"))), 6).alias("groundedness"), F.round(share(bag(F.col("gold")), bag(plain)), 6).alias("evidence_overlap"),
        F.round(F.when(F.size(cited) > 0, F.size(valid) / F.size(cited)), 6).alias("citation_accuracy"), (F.col("answer").rlike(REFUSAL) == ~(F.col("answerable") & (F.size("context") > 0))).alias("abstention_correct"),
    )


def answer_report(scores: DataFrame) -> DataFrame:
    """(metric, value, n): means of score_answers() over the answers that have the measure."""
    names = ("groundedness", "evidence_overlap", "citation_accuracy", "abstention_correct")
    as_double = scores.select(*[F.col(n).cast("double").alias(n) for n in names])
    stacked = as_double.selectExpr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) as (metric, value)")
    return stacked.where("value is not null").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


def lift(recall: float, groundedness: float) -> str:
    """What retrieval and answers say of each other."""
    if recall >= 0.8 and groundedness < 0.5:
        return "the evidence is found but the answers do not use it: look at the generator"
    if recall < 0.5 and groundedness >= 0.8:
        return "answers stay with what they are shown, but the evidence is missing: look at retrieval"
    return "retrieval and answers agree"


def tokens_sent(assembled: DataFrame) -> DataFrame:
    """(query_id, tokens) of assemble()."""
    return assembled.groupBy("query_id").agg(F.sum("tokens").alias("tokens"))


def type_distribution(typed: DataFrame) -> DataFrame:
    """(qtype, n), most first."""
    return typed.groupBy("qtype").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "qtype")
