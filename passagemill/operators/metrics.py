"""Ranking metrics, significance and diagnosis, as joins of a run to its relevance judgements."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

KS = (1, 3, 5, 10, 20)


def check_run(run: DataFrame) -> DataFrame:
    """(query_id, chunk_id, n) of chunks that a ranking has more than once; a run with any cannot be scored."""
    return run.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def once(run: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) of a run; it fails when it is read if a ranking has a chunk more than once. The aggregate
    leaves the rows where the join with the judgements wants them."""
    by = run.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.count("*").alias("n__"))
    why = F.concat(F.lit("a ranking has a chunk more than once: "), F.to_json(F.struct("query_id", "chunk_id")))
    return by.select("query_id", "chunk_id", F.when(F.col("n__") > 1, F.raise_error(why).cast("int")).otherwise(F.col("rank")).alias("rank"))


def per_query(qrels: DataFrame, run: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """(query_id, k, recall, precision, hit_rate, mrr, map, ndcg) for each query with a relevant chunk; one that
    the run lacks scores 0. qrels(query_id, chunk_id, grade), run(query_id, chunk_id, rank)."""
    if any(k < 1 for k in ks):
        raise ValueError("k must be at least 1")
    spark = qrels.sparkSession
    relevant = qrels.where("grade > 0")
    by_query = W.partitionBy("query_id")
    ideal = relevant.withColumn("pos", F.row_number().over(by_query.orderBy(F.desc("grade"), "chunk_id")))
    ideal = ideal.withColumn("n_rel", F.count("*").over(by_query)).select("query_id", "n_rel", "pos", F.col("grade").alias("ideal_grade"))
    hits = once(run).join(relevant, ["query_id", "chunk_id"]).withColumn("found", F.row_number().over(by_query.orderBy("rank")))
    levels = F.broadcast(spark.createDataFrame([(int(k),) for k in ks], "k int"))
    gain = F.col("ideal_grade") / F.log2(F.col("pos") + 1.0)
    base = ideal.crossJoin(levels).groupBy("query_id", "n_rel", "k").agg(F.sum(F.when(F.col("pos") <= F.col("k"), gain).otherwise(F.lit(0.0))).alias("idcg"))
    inside = hits.crossJoin(levels).where(F.col("rank") <= F.col("k"))
    got = inside.groupBy("query_id", "k").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(F.col("found") / F.col("rank")).alias("ap"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    j = base.join(got, ["query_id", "k"], "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return j.select(
        "query_id", "k",
        zero(F.col("n") / F.col("n_rel")).alias("recall"), zero(F.col("n") / F.col("k")).alias("precision"), zero(F.when(F.col("n") > 0, 1.0)).alias("hit_rate"),
        zero(F.lit(1.0) / F.col("first")).alias("mrr"), zero(F.col("ap") / F.col("n_rel")).alias("map"), zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"),
    )


#: Metrics of the caller's own: name -> function of a query's grades in rank order, all its judged grades, and k.
CUSTOM: dict[str, Callable[[Sequence[int], Sequence[int], int], float]] = {}


def custom(qrels: DataFrame, run: DataFrame, ks: Sequence[int] = KS, names: Sequence[str] = ()) -> DataFrame:
    """(query_id, k, metric, value) of registered metrics; one that fails on a query has no row there."""
    if odd := sorted(set(names) - set(CUSTOM)):
        raise ValueError(f"unknown metric {', '.join(odd)}; known: {', '.join(sorted(CUSTOM))}")
    chosen = {n: CUSTOM[n] for n in names or sorted(CUSTOM)}
    judged = qrels.where("grade > 0").groupBy("query_id").agg(F.sort_array(F.collect_list("grade"), False).alias("judged"))
    graded = once(run).join(qrels.select("query_id", "chunk_id", "grade"), ["query_id", "chunk_id"], "left")
    ranked = graded.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("grade", F.lit(0)).alias("grade")))).alias("r"))
    rows = judged.join(ranked, "query_id", "left").select("query_id", "judged", F.coalesce(F.transform("r", lambda x: x["grade"]), F.array().cast("array<int>")).alias("grades"))
    kind = rows.schema["query_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (all_, grades) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for k in ks:
                    for name, f in chosen.items():
                        try:
                            value = float(f(grades[:k], all_, k))
                        except (ArithmeticError, ValueError, IndexError):
                            continue
                        at.append(i)
                        out.append((k, name, value))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.float64())))], ["query_id", "k", "metric", "value"])

    return rows.mapInArrow(score, f"query_id {kind}, k int, metric string, value double")


METRICS = ("ndcg", "map", "mrr", "recall", "precision", "hit_rate")


def evaluate(qrels: DataFrame, run: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """(metric, k, value): means over the queries of per_query()."""
    means = per_query(qrels, run, ks).groupBy("k").agg(*[F.avg(m).alias(m) for m in METRICS])
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return means.selectExpr("k", f"stack({len(METRICS)}, {pairs}) as (metric, value)").select("metric", "k", F.round("value", 6).alias("value"))


def first_relevant(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """(mean_rank, misses): the mean rank of the first relevant chunk, and queries without one."""
    first = once(run).join(qrels.where("grade > 0"), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    queries = qrels.where("grade > 0").select("query_id").distinct().join(first, "query_id", "left")
    return queries.agg(F.round(F.avg("first"), 6).alias("mean_rank"), F.count_if(F.col("first").isNull()).alias("misses"))


def slice_by(per: DataFrame, labels: DataFrame, metric: str, k: int) -> DataFrame:
    """(qtype, n, value): the mean of a metric by question type; no type is unlabelled."""
    j = per.where(F.col("k") == k).join(labels, "query_id", "left")
    return j.groupBy(F.coalesce("qtype", F.lit("unlabelled")).alias("qtype")).agg(F.count("*").alias("n"), F.round(F.avg(metric), 6).alias("value"))


def diagnose(queries: DataFrame, qrels: DataFrame, run: DataFrame, k: int = 5, deep_k: int = 100) -> DataFrame:
    """(query_id, failure): fp1 no relevant chunk; fp3 none returned, or past deep_k; fp2 the first past k; fp7 found, but
    not all within k; none."""
    rel = qrels.where("grade > 0").select("query_id", "chunk_id")
    hit = rel.join(once(run), ["query_id", "chunk_id"], "left")
    each = hit.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("inside"))
    j = queries.select("query_id").join(each, "query_id", "left")
    failure = (
        F.when(F.col("n").isNull(), "fp1_missing_content").when(F.col("first").isNull() | (F.col("first") > deep_k), "fp3_not_retrieved").when(F.col("first") > k, "fp2_missed_top_ranked")
        .when(F.col("inside") < F.col("n"), "fp7_incomplete").otherwise("none")
    )
    return j.select("query_id", failure.alias("failure"))


def cluster(diagnosed: DataFrame) -> DataFrame:
    """(failure, n, query_ids) of diagnose(), most questions first."""
    return diagnosed.groupBy("failure").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("query_id")).alias("query_ids")).orderBy(F.desc("n"), "failure")


def dominant(diagnosed: DataFrame) -> str | None:
    """The failure that most questions have, the first by name if several tie; None without one."""
    row = diagnosed.where("failure <> 'none'").groupBy("failure").count().orderBy(F.desc("count"), "failure").first()
    return row["failure"] if row else None


def compare(left: DataFrame, right: DataFrame, metric: str, k: int) -> DataFrame:
    """(n, wins, losses, ties, mean_difference) of two per_query() tables over the queries of both."""
    a, b = (x.where(F.col("k") == k).select("query_id", F.col(metric).alias(n)) for x, n in ((left, "a"), (right, "b")))
    d = F.col("a") - F.col("b")
    j = a.join(b, "query_id")
    return j.agg(F.count("*").alias("n"), F.count_if(d > 1e-9).alias("wins"), F.count_if(d < -1e-9).alias("losses"), F.count_if(F.abs(d) <= 1e-9).alias("ties"), F.round(F.avg(d), 6).alias("mean_difference"))


#: Draws of a resampling that are held at a time.
_DRAWS = 1 << 22


def bootstrap(values: np.ndarray, resamples: int = 2000, seed: int = 0, confidence: float = 0.95) -> tuple[float, float, float]:
    """Mean, and the interval of the means of resamples. Drawn row by row, so that the numbers are those of one draw."""
    n, rng = len(values), np.random.default_rng(seed)
    if not n:
        return float("nan"), float("nan"), float("nan")
    means, step = np.empty(resamples), max(1, _DRAWS // n)
    for lo in range(0, resamples, step):
        means[lo : lo + step] = values[rng.integers(0, n, (min(step, resamples - lo), n))].mean(1)
    low, high = np.quantile(means, [0.5 - confidence / 2, 0.5 + confidence / 2])
    return float(values.mean()), float(low), float(high)


def sign_flip(differences: np.ndarray, resamples: int = 2000, seed: int = 0) -> float:
    """p of the mean difference, with signs flipped at random; 1 for equal scores."""
    if not differences.any():
        return 1.0
    rng, n, extreme = np.random.default_rng(seed), len(differences), 0
    step = max(1, _DRAWS // n)
    for lo in range(0, resamples, step):
        flips = rng.choice(np.array([-1.0, 1.0]), (min(step, resamples - lo), n))
        extreme += int((np.abs(flips @ differences) >= abs(differences.sum()) - 1e-12 * n).sum())
    return (1 + extreme) / (1 + resamples)


def significance(left: DataFrame, right: DataFrame, metric: str, k: int, resamples: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(n, mean_difference, low, high, p, verdict): better or worse only if p < alpha and the interval leaves out 0."""
    a, b = (x.where(F.col("k") == k).select("query_id", F.col(metric).alias(n)) for x, n in ((left, "a"), (right, "b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        d = (pdf["a"] - pdf["b"]).to_numpy()
        mean, low, high = bootstrap(d, resamples, seed)
        p = sign_flip(d, resamples, seed)
        sure = p < alpha and (low > 0 or high < 0)
        return pd.DataFrame([(len(d), mean, low, high, p, ("better" if mean > 0 else "worse") if sure else "no difference shown")], columns=["n", "mean_difference", "low", "high", "p", "verdict"])

    return a.join(b, "query_id").groupBy().applyInPandas(lambda pdf: run(pdf), "n bigint, mean_difference double, low double, high double, p double, verdict string")


def sample_size_note(n: int, difference: float | None = None) -> str:
    """What so many questions can tell."""
    least = math.ceil(round(2.8 * math.sqrt(0.5 / n), 9) * 100) / 100 if n else 1.0
    if not n:
        return "no question that both runs have"
    if difference is not None and abs(difference) < least:
        return f"{n} questions show differences of {least:.2f} or more; this one is {abs(difference):.3f}"
    return f"{n} questions show differences of {least:.2f} or more"


def disagreement(left: DataFrame, right: DataFrame, metric: str, k: int) -> DataFrame:
    """(query_id, left, right, difference) of the questions on which two per_query() tables part, largest first."""
    a, b = (x.where(F.col("k") == k).select("query_id", F.col(metric).alias(n)) for x, n in ((left, "left"), (right, "right")))
    d = F.col("left") - F.col("right")
    return a.join(b, "query_id").withColumn("difference", F.round(d, 6)).where(F.abs(d) > 1e-9).orderBy(F.desc(F.abs("difference")), "query_id")


def pareto(results: DataFrame, quality: str, cost: str, tie: str | None = None) -> DataFrame:
    """Rows that no other beats: cheaper ones are all worse. Of rows equal in both the first by tie counts. Only
    the best row of each cost reaches the one sorted pass."""
    by_cost = W.partitionBy(cost).orderBy(F.desc(quality), *([tie] if tie else []))
    best = results.withColumn("n__", F.row_number().over(by_cost)).where("n__ = 1").drop("n__")
    before = F.max(quality).over(W.orderBy(F.asc(cost)).rowsBetween(W.unboundedPreceding, -1))
    return best.withColumn("b__", before).where(F.col("b__").isNull() | (F.col(quality) > F.col("b__"))).drop("b__")


#: What the parts of a pipeline are judged by: the mean of the metrics that are there.
DIMENSIONS = {"parse": ("evidence_resolvable",), "chunk": ("char_recall",), "embed": ("embedding_quality",), "retrieval": ("recall", "ndcg"), "generation": ("faithfulness", "answer_relevancy")}


def dominant_cutoff(results: DataFrame, prefer: int = 5) -> int | None:
    """The k that most metrics have; prefer if it is one of the commonest, else the largest of them."""
    rows = results.groupBy("k").agg(F.countDistinct("metric").alias("n")).collect()  # a row a cut-off
    if not rows:
        return None
    most = max(r["n"] for r in rows)
    ks = sorted(r["k"] for r in rows if r["n"] == most)
    return prefer if prefer in ks else ks[-1]


def composite_score(results: DataFrame, k: int) -> DataFrame:
    """(config_id, parse, chunk, embed, retrieval, generation, composite) of results(config_id, metric, k, value): each
    dimension is the mean of its metrics at k, or at their only cut-off; those without a metric stay out."""
    chosen = results.withColumn("n__", F.row_number().over(W.partitionBy("config_id", "metric").orderBy(F.desc(F.col("k") == k), F.desc("k")))).where("n__ = 1")
    parts = [F.avg(F.when(F.col("metric").isin(*names), F.col("value"))).alias(d) for d, names in DIMENSIONS.items()]
    return composite(chosen.groupBy("config_id").agg(*parts), list(DIMENSIONS))


def axis_effect(results: DataFrame, axis: str, metric: str) -> DataFrame:
    """(value, n, mean) of a metric for each value of an axis."""
    return results.groupBy(F.col(axis).cast("string").alias("value")).agg(F.count("*").alias("n"), F.round(F.avg(metric), 6).alias("mean"))


def composite(results: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Results with composite: 100 times the harmonic mean of the dimensions that are there and from 0 to 1; 0 if any is 0."""
    ok = [F.when(F.col(d).between(0, 1), F.col(d).cast("double")) for d in dimensions]
    n = sum((x.isNotNull().cast("int") for x in ok), F.lit(0))
    zero = F.greatest(*[F.coalesce((x == 0).cast("int"), F.lit(0)) for x in [*ok, *ok[:1]]]) == 1
    inverse = sum((F.coalesce(F.when(x > 0, F.lit(1.0) / x), F.lit(0.0)) for x in ok), F.lit(0.0))
    return results.withColumn("composite", F.round(F.when(n == 0, F.lit(None)).when(zero, F.lit(0.0)).otherwise(100.0 * n / inverse), 6))


def latency_percentile(timings: DataFrame, value: str, fraction: float, *keys: str) -> DataFrame:
    """(keys..., value): the element at floor(fraction * n) of the sorted values, by ranks, without collecting a list."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ranked = timings.where(F.col(value).isNotNull()).withColumns({"r__": F.row_number().over(w.orderBy(value)), "n__": F.count("*").over(w)})
    at = F.least(F.floor(F.lit(fraction) * F.col("n__")), F.col("n__") - 1) + 1
    return ranked.where(F.col("r__") == at).select(*keys, F.col(value).alias("value"))


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(model, input_tokens, output_tokens) with prices(model, input_price, output_price) a million tokens -> usd; an
    unknown model has a null cost."""
    j = usage.join(F.broadcast(prices), "model", "left")
    return j.withColumn("usd", F.round((F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6, 9)).drop("input_price", "output_price")
