"""Rules that an experiment's results are held against; each finding is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = "code string, severity string, subject string, message string"


def at_ceiling(results: DataFrame, metric: str, k: int, ceiling: float = 0.999) -> DataFrame:
    """If all configurations are at the top, the questions do not tell them apart."""
    low = results.where((F.col("metric") == metric) & (F.col("k") == k)).agg(F.min("value").alias("low"), F.count("*").alias("n"))
    return low.where((F.col("n") > 0) & (F.col("low") >= ceiling)).select(F.lit("at_ceiling").alias("code"), F.lit("caution").alias("severity"), F.lit(f"{metric}@{k}").alias("subject"), F.concat(F.lit("all of "), "n", F.lit(" configurations score the maximum")).alias("message"))


def one_chunk_a_document(chunks: DataFrame) -> DataFrame:
    """If nothing was cut, chunkers cannot differ."""
    n = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))
    return n.where("chunks > 0 and chunks = docs").select(F.lit("chunking_invisible").alias("code"), F.lit("caution").alias("severity"), F.lit("chunker").alias("subject"), F.concat(F.lit("each of "), "docs", F.lit(" documents is one chunk")).alias("message"))


def approximate_alone(configs: DataFrame) -> DataFrame:
    """An approximate index without an exact one beside it: its loss cannot be told. configs(index)."""
    name = F.split("index", ":")[0]
    n = configs.agg(F.bool_or(name == "quantized").alias("approximate"), F.bool_or(name.isin("dense", "hybrid")).alias("exact"))
    return n.where("approximate and not exact").select(F.lit("no_exact_arm").alias("code"), F.lit("caution").alias("severity"), F.lit("index").alias("subject"), F.lit("no exact index to compare with").alias("message"))


def depth_without_reranker(configs: DataFrame) -> DataFrame:
    """Candidate depths that differ, where nothing ranks the candidates again. configs(reranker, candidates)."""
    n = configs.where("reranker is null or reranker = 'none'").agg(F.countDistinct("candidates").alias("n"))
    return n.where("n > 1").select(F.lit("depth_does_nothing").alias("code"), F.lit("info").alias("severity"), F.lit("candidates").alias("subject"), F.concat("n", F.lit(" depths without a reranker are one configuration")).alias("message"))


def unique(*findings: DataFrame) -> DataFrame:
    """All findings, each once."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["code", "subject", "message"])


def validate(results: DataFrame, published: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(metric, k, value, expected, delta, within) against published numbers(metric, k, expected)."""
    delta = F.round(F.col("value") - F.col("expected"), 6)
    return results.join(published, ["metric", "k"]).select("metric", "k", "value", "expected", delta.alias("delta"), (F.abs(delta) <= tolerance).alias("within"))


def question_quality(items: DataFrame, baseline: DataFrame) -> DataFrame:
    """(n, discriminating): how well scores of a baseline spread: 1 at a half, 0 at none or all."""
    return items.join(baseline, "item_id").agg(F.count("*").alias("n"), F.round(F.avg(1.0 - F.abs(F.col("score") - 0.5) * 2), 6).alias("discriminating"))


def none(spark: SparkSession) -> DataFrame:
    """No finding."""
    return spark.createDataFrame([], SCHEMA)


def few_questions(questions: DataFrame, least: int = 30) -> DataFrame:
    """Too few questions to tell configurations apart."""
    n = questions.agg(F.count("*").alias("n"))
    return n.where(F.col("n") < least).select(F.lit("few_questions").alias("code"), F.lit("caution").alias("severity"), F.lit("evalset").alias("subject"), F.concat("n", F.lit(f" questions; below {least} most differences are chance")).alias("message"))


def strategy_did_nothing(searches: DataFrame) -> DataFrame:
    """A retrieval strategy that searched no more than once a question is simple search. searches(retrieval, questions, searches)."""
    idle = searches.where("retrieval is not null and retrieval <> 'simple' and searches <= questions")
    return idle.select(F.lit("strategy_did_nothing").alias("code"), F.lit("info").alias("severity"), F.col("retrieval").alias("subject"), F.concat("searches", F.lit(" searches for "), "questions", F.lit(" questions")).alias("message"))


def unbounded_spend(configs: DataFrame, budget_usd: float | None, names: tuple[str, ...] = ("hyde", "multi-query", "decompose", "step-back", "agentic", "llm", "contextual", "hypothetical-questions", "propositions", "summary", "remote")) -> DataFrame:
    """Configurations that pay for replies, under no limit. configs: columns of specifications."""
    if budget_usd is not None:
        return none(configs.sparkSession)
    paid = [F.split(F.col(c), ":")[0].isin(*names) for c, t in configs.dtypes if t == "string"]
    hit = configs.where(reduce(Column.__or__, [F.coalesce(p, F.lit(False)) for p in paid])) if paid else configs.limit(0)
    n = hit.agg(F.count("*").alias("n")).where("n > 0")
    return n.select(F.lit("unbounded_spend").alias("code"), F.lit("caution").alias("severity"), F.lit("run").alias("subject"), F.concat("n", F.lit(" configurations pay for replies, and no budget ends the run")).alias("message"))


def eval_quality(items: DataFrame) -> DataFrame:
    """(n, reviewed, detectable) of items(item_id, reviewed boolean): how many, the share a person saw, and the least difference
    of means that so many show."""
    n = F.count("*")
    return items.agg(n.alias("n"), F.round(F.avg(F.coalesce(F.col("reviewed"), F.lit(False)).cast("double")), 6).alias("reviewed"), (F.ceil(F.round(F.lit(2.8) * F.sqrt(F.lit(0.5) / n), 9) * 100) / 100).alias("detectable"))
