"""Experiments: specifications, the grid of configurations, and runs over it."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as tx
from ..operators import chunk as ch, codecs, embed, metrics, models, questions as qs, resolve, search
from . import cost, ingest

#: Names that a specification may use, and the parameter that its first bare value sets.
REGISTRY: dict[str, dict[str, str]] = {
    "parser": {"text": "", "markdown": ""},
    "chunker": {"fixed": "size", "recursive": "size", "sentence": "window", "structural": "max_size", "semantic": "cut_at"},
    "embedder": {"tfidf": "features", "hash": "dimensions", "length": "", "remote": "model"},
    "index": {"bm25": "k1", "dense": "metric", "hybrid": "fusion", "quantized": "codec", "ivf": "lists"},
    "transform": {"none": "", "expand": "", "hyde": "", "multi-query": "n", "decompose": "n", "step-back": ""},
    "retrieval": {"simple": "", "widened": "factor", "decomposed": "min_words", "relevance-feedback": "terms", "agentic": "max_queries"},
    "reranker": {"none": "", "lexical": "length_penalty", "mmr": "diversity", "remote": "model"},
    "ingestion": {"plain": "", "parent-document": "group", "sentence-window": "window", "hierarchical": "group", "contextual": "", "hypothetical-questions": "count", "propositions": "count", "summary": ""},
    "generator": {"none": "", "extractive": "sentences", "llm": ""},
}
#: Names that need a model or a service from the caller.
NEED_MODEL = {"transform": ("hyde", "multi-query", "decompose", "step-back"), "retrieval": ("agentic",), "ingestion": ("contextual", "hypothetical-questions", "propositions", "summary"), "generator": ("llm",), "embedder": ("remote",), "reranker": ("remote",)}


def register(axis: str, name: str, build: Callable[..., Any], first: str = "") -> None:
    """A name of the caller's own on an axis. build: a chunker of a text (chunker), or a metric's function (see metrics.CUSTOM)."""
    if axis == "chunker":
        tx.CHUNKERS[name] = build
    elif axis == "metric":
        metrics.CUSTOM[name] = build
        return
    else:
        raise SpecError(f"names of axis {axis!r} cannot be added; chunker and metric can")
    REGISTRY[axis][name] = first


class SpecError(ValueError):
    """A specification that cannot be read."""


def coerce(value: str) -> Any:
    low = value.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", "null"):
        return None
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value.strip()


Spec = tuple[str, dict[str, Any]]


def parse_spec(axis: str, spec: str) -> Spec:
    """name[:first,key=value,...]: the longest registered name that the specification begins with, and its parameters."""
    names = [n for n in REGISTRY[axis] if spec == n or spec.startswith(n + ":")]
    if not names:
        raise SpecError(f"unknown {axis} {spec!r}; known: {', '.join(REGISTRY[axis])}")
    name = max(names, key=len)
    out: dict[str, Any] = {}
    for i, part in enumerate(p for p in spec[len(name) + 1 :].split(",") if p.strip()):
        key, eq, value = part.partition("=")
        if eq:
            out[key.strip()] = coerce(value)
        elif i == 0 and REGISTRY[axis][name]:
            out[REGISTRY[axis][name]] = coerce(part)
        else:
            raise SpecError(f"{part!r} in {spec!r} needs a name")
    return name, out


@dataclass(frozen=True)
class Config:
    chunker: str = "fixed"
    index: str = "bm25"
    embedder: str | None = None
    transform: str | None = None
    retrieval: str | None = None
    reranker: str | None = None
    ingestion: str | None = None
    k: int = 10
    candidates: int = 50
    parser: str = "text"
    generator: str | None = None

    @property
    def id(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    @property
    def label(self) -> str:
        """What distinguishes it, in words."""
        return " | ".join(str(v) for v in (self.parser, self.chunker, self.ingestion, self.embedder, self.index, self.transform, self.retrieval, self.reranker and f"{self.reranker}@{self.candidates}", self.generator) if v)

    def check(self) -> None:
        """Raise for a specification that names nothing."""
        for axis in REGISTRY:
            if (value := getattr(self, axis)) is not None:
                parse_spec(axis, value)


AXES = ("chunker", "index", "embedder", "transform", "retrieval", "reranker", "ingestion", "candidates", "parser", "generator")


def canonical(c: Config) -> Config:
    """Equal experiments as equal configurations: what does nothing is left out."""
    out = replace(c, **{a: None for a in ("transform", "reranker", "generator") if getattr(c, a) == "none"})
    out = replace(out, ingestion=None if out.ingestion == "plain" else out.ingestion, retrieval=None if out.retrieval == "simple" else out.retrieval)
    if out.reranker is None:
        out = replace(out, candidates=50)
    if out.index.split(":")[0] == "bm25":
        out = replace(out, embedder=None)
    return out


def runnable(c: Config) -> bool:
    return c.index.split(":")[0] == "bm25" or c.embedder is not None


@dataclass(frozen=True)
class Matrix:
    """Values of each axis."""

    axes: Mapping[str, Sequence] = field(default_factory=dict)
    k: int = 10

    def frame(self, spark: SparkSession) -> DataFrame:
        """The product of all axes, a row each."""
        out = spark.range(1, numPartitions=1).select(F.lit(self.k).alias("k"))
        for axis in AXES:
            kind = "int" if axis == "candidates" else "string"
            values = self.axes.get(axis, [getattr(Config(), axis)])
            out = out.withColumn(axis, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
        return out

    def factorial(self) -> list[Config]:
        found = [Config(k=self.k)]
        for axis, values in self.axes.items():
            found = [replace(c, **{axis: v}) for c in found for v in values]
        return found

    def one_at_a_time(self) -> list[Config]:
        """The first value of each axis, and each other value alone."""
        base = replace(Config(k=self.k), **{a: v[0] for a, v in self.axes.items()})
        return [base, *(replace(base, **{a: v}) for a, values in self.axes.items() for v in values[1:])]


def canonical_frame(grid: DataFrame) -> DataFrame:
    """canonical() and runnable() over a frame of configurations, with how many each stands for."""
    bm25 = F.col("index").startswith("bm25")
    drop = lambda c, v: F.when(F.col(c) != v, F.col(c))
    out = grid.where(bm25 | F.col("embedder").isNotNull())
    out = out.withColumns({"transform": drop("transform", "none"), "reranker": drop("reranker", "none"), "ingestion": drop("ingestion", "plain"), "retrieval": drop("retrieval", "simple"), "embedder": F.when(~bm25, F.col("embedder"))})
    out = out.withColumn("candidates", F.when(F.col("reranker").isNull(), F.lit(50)).otherwise(F.col("candidates")))
    return out.groupBy(*grid.columns).agg(F.count("*").alias("stands_for"))


Account = dict[str, int]


def distinct_runnable(configs: Sequence[Config]) -> tuple[list[Config], Account]:
    """Runnable, canonical, distinct configurations in order, and the account: given, impossible, repeated, kept."""
    ok = [canonical(c) for c in configs if runnable(c)]
    kept = list(dict.fromkeys(ok))
    return kept, {"given": len(configs), "impossible": len(configs) - len(ok), "repeated": len(ok) - len(kept), "kept": len(kept)}


def cache_key(stage: str, version: str, params: Mapping, inputs: Sequence[str]) -> str:
    return hashlib.sha256(json.dumps([stage, version, dict(params), list(inputs)], sort_keys=True, default=str).encode()).hexdigest()


class Cache:
    """Stages that configurations share: persisted in memory, or as Parquet under a folder that all executors share, where the
    next run finds them."""

    def __init__(self, folder: str | None = None) -> None:
        self.folder, self.held, self.hits = folder, {}, 0

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self.held:
            self.hits += 1
            return self.held[key]
        if self.folder is None:
            found = make().persist()
        else:
            found = self._stored(f"{self.folder.rstrip('/')}/{key}", make)
        self.held[key] = found
        return found

    def _stored(self, path: str, make: Callable[[], DataFrame]) -> DataFrame:
        spark = SparkSession.getActiveSession()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            self.hits += 1
        else:
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def release(self) -> None:
        """Give back what is held in memory."""
        for df in self.held.values():
            df.unpersist()
        self.held.clear()


@dataclass
class Services:
    """What a grid asks that is not here: functions from the caller."""

    model: models.Model | None = None
    embed: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None
    rerank: Callable[[str, Sequence[str]], Sequence[float]] | None = None

    def need(self, name: str, axis: str) -> Any:
        found = {"embedder": self.embed, "reranker": self.rerank}.get(axis, self.model)
        if found is None:
            raise SpecError(f"{axis} {name!r} needs a {'service' if axis in ('embedder', 'reranker') else 'model'}, and none was given")
        return found


class Runner:
    """Runs configurations over docs(doc_id, text), questions(query_id, text) and gold(item_id, doc_id, start, end, grade)."""

    def __init__(self, docs: DataFrame, questions: DataFrame, gold: DataFrame, acronyms: Mapping[str, str] | None = None, services: Services | None = None, cache: Cache | None = None, policy: str = "coverage", threshold: float = 0.5) -> None:
        self.docs, self.questions, self.gold, self.acronyms = docs, questions, gold, dict(acronyms or {})
        self.services, self.cache = services or Services(), cache or Cache()
        self.policy, self.threshold = policy, threshold
        self._fans: dict[str, int] = {}

    def _spec(self, c: Config, axis: str, default: str = "none") -> Spec:
        return parse_spec(axis, getattr(c, axis) or default)

    def _chunk_key(self, c: Config) -> str:
        return cache_key("chunk", "2", self._spec(c, "chunker")[1], [self._spec(c, "chunker")[0], c.parser])

    def chunks(self, c: Config) -> DataFrame:
        name, how = self._spec(c, "chunker")
        return self.cache.get(self._chunk_key(c), lambda: ch.chunk(self.docs, name, self._spec(c, "parser")[0] == "markdown", **how))

    def ingested(self, c: Config) -> ingest.Ingested:
        name, how = self._spec(c, "ingestion", "plain")
        model = self.services.need(name, "ingestion") if name in NEED_MODEL["ingestion"] else None
        made = ingest.ingest(name, self.docs, self.chunks(c), model, **how)
        if model is not None:  # a reply is paid for once
            made.indexed = self.cache.get(cache_key("ingest", "1", how, [name, self._chunk_key(c)]), lambda: made.indexed)
        return made

    def _vectors(self, c: Config, indexed: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """(chunk_id, embedding) of what is indexed, and how queries(query_id, text) get theirs."""
        name, how = self._spec(c, "embedder")
        if name == "tfidf":
            idf = embed.tfidf_fit(indexed, features=how.get("features", 4096))
            make = lambda t, i: embed.tfidf_vectors(t, idf, i)
        elif name == "hash":
            make = lambda t, i: embed.hash_vectors(t, i, how.get("dimensions", 256), how.get("seed", 0))
        elif name == "length":
            make = lambda t, i: embed.lengths(t, i).select(i, F.array(F.col("length").cast("float")).alias("embedding"))
        else:
            call = self.services.need(name, "embedder")
            model = str(how.get("model", ""))
            make = lambda t, i: embed.remote(embed.with_prefix(t, model, i == "query_id"), call, i)
        key = cache_key("vectors", "1", how, [name, c.ingestion or "plain", self._chunk_key(c)])
        return self.cache.get(key, lambda: make(indexed, "chunk_id")), lambda q: make(q.select("query_id", "text"), "query_id")

    def _index(self, c: Config, made: ingest.Ingested) -> Callable[[DataFrame, int], DataFrame]:
        """The search over what is indexed: (queries, k) -> (query_id, chunk_id, score, rank)."""
        indexed = made.indexed.select(F.col("indexed_id").alias("chunk_id"), "text")
        index, how = self._spec(c, "index")
        known = {"bm25": ("k1", "b"), "dense": ("metric",), "hybrid": ("fusion", "alpha", "k1", "b", "candidates", "rrf_k"), "quantized": ("codec", "rescore", "subspaces"), "ivf": ("lists", "probes")}[index]
        if odd := sorted(set(how) - set(known)):
            raise SpecError(f"index {index!r} knows no {', '.join(odd)}; known: {', '.join(known)}")
        bm = {x: how[x] for x in ("k1", "b") if x in how}
        if index == "bm25":
            return lambda q, k: search.bm25(indexed, q, k, **bm)
        same = {"id_col": "chunk_id", "skip_self": False, "query_col": "query_id"}
        if self._spec(c, "embedder")[0] == "tfidf" and index in ("dense", "hybrid") and how.get("metric", "cosine") != "l2":
            idf = embed.tfidf_fit(indexed, features=self._spec(c, "embedder")[1].get("features", 4096))
            near = lambda q, k: search.tfidf_search(indexed, q, idf, k)  # noqa: E731  # rows of length one: cosine and product are one
        else:
            vectors, asked = self._vectors(c, indexed)
            if index == "quantized":
                return lambda q, k: codecs.quantized_search(vectors, asked(q), how.get("codec", "scalar"), k, how.get("rescore", 0), how.get("subspaces", 8), **same)
            if index == "ivf":
                return lambda q, k: codecs.ivf_search(vectors, asked(q), k, how.get("lists", 100), how.get("probes", 8), **same)
            near = lambda q, k: search.dense(vectors, asked(q), k, how.get("metric", "cosine"), **same)
        if index == "dense":
            return near

        def both(q: DataFrame, k: int) -> DataFrame:
            deep = max(how.get("candidates", 100), k)
            a, b = near(q, deep), search.bm25(indexed, q, deep, **bm)
            fusion = how.get("fusion", "rrf")
            if fusion not in ("rrf", "weighted"):
                raise SpecError(f"unknown fusion {fusion!r}; known: rrf, weighted")
            return search.weighted(a, b, k, how.get("alpha", 0.5)) if fusion == "weighted" else search.rrf([a, b], k, how.get("rrf_k", 60))

        return both

    def _asked(self, c: Config) -> tuple[DataFrame, bool]:
        """What is searched for each question: (query_id, text), or with several texts query_id(query_id, part)."""
        name, how = self._spec(c, "transform")
        if name == "none":
            return self.questions, False
        if name == "expand":
            return self.questions.withColumn("text", qs.expand(F.col("text"), {**self.acronyms, **how})), False
        made = models.rewrite(self.questions, self.services.need(name, "transform"), name, how.get("n"))
        made = self.cache.get(cache_key("transform", "1", how, [name]), lambda: made)
        return made.select(F.struct("query_id", "part").alias("query_id"), "text"), True

    def returned(self, c: Config) -> DataFrame:
        """(query_id, chunk_id, score, rank): the passages that come back, all questions in one plan."""
        c.check()
        made = self.ingested(c)
        index = self._index(c, made)
        fan = self._fans.setdefault(cache_key("fan", "1", {}, [self._chunk_key(c), c.ingestion or "plain"]), 0) or made.fan_out()
        self._fans[cache_key("fan", "1", {}, [self._chunk_key(c), c.ingestion or "plain"])] = fan
        find = lambda q, k: made.returned(index(q, k * fan), k)
        depth = max(c.candidates, c.k) if c.reranker and c.reranker != "none" else c.k
        asked, several = self._asked(c)
        name, how = self._spec(c, "retrieval", "simple")
        passages = made.passages()
        if name == "widened":
            hits = search.top_k(find(asked, depth * how.get("factor", 4)).drop("rank"), depth)
        elif name == "decomposed":
            hits = qs.fuse_parts(find, qs.decompose(asked, **how), depth)
        elif name == "relevance-feedback":
            hits = qs.relevance_feedback(find, passages, asked, depth, **how)
        elif name == "agentic":
            hits = models.agentic(find, asked, self.services.need(name, "retrieval"), depth, **how)
        else:
            hits = find(asked, depth)
        if several:
            hits = search.rrf([hits.withColumn("query_id", F.col("query_id.query_id"))], depth)
        ranker, more = self._spec(c, "reranker")
        if ranker == "lexical":
            return qs.lexical_rerank(hits, passages, self.questions, c.k, **more)
        if ranker == "mmr":
            return qs.mmr_rerank(hits, passages, c.k, **more)
        if ranker == "remote":
            return models.rerank(hits, passages, self.questions, self.services.need(ranker, "reranker"), c.k)
        return hits

    def search(self, c: Config) -> DataFrame:
        """(query_id, chunk_id, rank): what the returned passages count as."""
        return self.ingested(c).scored(self.returned(c))

    def qrels(self, c: Config) -> DataFrame:
        return resolve.qrels(self.gold, self.ingested(c).retrievable, self.policy, self.threshold)

    def run(self, c: Config, ks: Sequence[int] = metrics.KS) -> DataFrame:
        """(config_id, metric, k, value), with the character metrics of the returned passages at the configuration's k."""
        ranked = metrics.evaluate(self.qrels(c), self.search(c), ks)
        spans = self.returned(c).join(self.ingested(c).passages().drop("text"), "chunk_id").select(F.col("query_id").alias("item_id"), "doc_id", "start", "end")
        chars = resolve.character_metrics(self.gold, spans).join(self.gold.select("item_id").distinct(), "item_id", "left_semi")
        means = chars.agg(*[F.round(F.avg(m), 6).alias(m) for m in ("char_recall", "char_precision", "char_f1")])
        wide = means.selectExpr("stack(3, 'char_recall', char_recall, 'char_precision', char_precision, 'char_f1', char_f1) as (metric, value)")
        return ranked.unionByName(wide.where("value is not null").select("metric", F.lit(c.k).alias("k"), "value")).withColumn("config_id", F.lit(c.id))

    def answers(self, c: Config, budget: int = 2000, order: str = "relevance") -> DataFrame:
        """(query_id, answer, context, gold, answerable) of the configuration's generator."""
        name, how = self._spec(c, "generator")
        if name == "none":
            raise SpecError("the configuration has no generator")
        hits, passages = self.returned(c), self.ingested(c).passages()
        held = qs.assemble(hits, passages, budget, order).join(passages.select("chunk_id", "text"), "chunk_id")
        context = held.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("context"))
        if name == "extractive":
            said = qs.extractive(hits, passages, how.get("sentences", 2))
        else:
            asked = context.join(self.questions, "query_id").select("query_id", F.col("text").alias("question"), F.col("context").alias("passages"))
            said = models.answer(asked, self.services.need(name, "generator")).drop("cited")
        quote = self.gold.join(self.docs, "doc_id").select(F.col("item_id").alias("query_id"), F.expr("substring(text, start + 1, end - start)").alias("quote"))
        gold = quote.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("quote")), " ").alias("gold"))
        return said.join(context, "query_id", "left").join(gold, "query_id", "left").withColumns({"answerable": F.col("gold").isNotNull(), "context": F.coalesce("context", F.array().cast("array<string>")), "gold": F.coalesce("gold", F.lit(""))})

    def answer_report(self, c: Config) -> DataFrame:
        """(metric, value): the means of score_answers(), nulls left out."""
        return qs.answer_report(qs.score_answers(self.answers(c)))

    def sweep(self, configs: Sequence[Config], seconds: float | None = None, usd: float | None = None, costs: cost.CostModel | None = None) -> tuple[DataFrame | None, list[dict]]:
        """All results, and what became of each configuration: one that cannot be run, or whose plan fails, is noted, and past a
        budget none starts. usd: what the configurations may cost by costs.estimate(), machine time apart."""
        out, notes, began, spent = None, [], time.monotonic(), 0.0
        for c in distinct_runnable(configs)[0]:
            note = {"config": c.id, "label": c.label}
            if (seconds is not None and time.monotonic() - began > seconds) or (usd is not None and spent >= usd):
                notes.append({**note, "status": "budget"})
                continue
            try:
                started = time.monotonic()
                got = self.cache.get(cache_key("result", "1", asdict(c), [self.policy, str(self.threshold)]), lambda c=c: self.run(c))
                got.count()
            except (SpecError, ValueError, TypeError, PySparkException) as e:
                notes.append({**note, "status": "failed", "why": str(e)[:200]})
                continue
            out = got if out is None else out.unionByName(got)
            bill = cost.estimate(self, c, costs or cost.CostModel())
            spent += bill.metered_now(bill.queries)
            notes.append({**note, "status": "ok", "seconds": round(time.monotonic() - started, 3), "usd": round(bill.spent_now(bill.queries), 6)})
        return out, notes

    def staged(self, axes: Mapping[str, Sequence], metric: str = "recall", k: int = 5) -> tuple[Config, list[tuple[Config, float]]]:
        """Axis by axis, the best value so far is kept."""
        best = replace(Config(), **{a: v[0] for a, v in axes.items()})
        seen: dict[Config, float] = {}

        def score(c: Config) -> float:
            d = canonical(c)
            if d not in seen:
                row = self.run(d, (k,)).where((F.col("metric") == metric) & (F.col("k") == k)).first() if runnable(d) else None
                seen[d] = row["value"] if row else 0.0
            return seen[d]

        for axis, values in axes.items():
            best = max((replace(best, **{axis: v}) for v in values), key=score)
        return best, list(seen.items())


def leaderboard(results: DataFrame, metric: str, k: int) -> DataFrame:
    """(place, config_id, value), best first, ties by configuration."""
    r = results.where((F.col("metric") == metric) & (F.col("k") == k))
    return r.select(F.row_number().over(W.orderBy(F.desc("value"), "config_id")).alias("place"), "config_id", "value")


def manifest(c: Config, **extra: Any) -> dict[str, Any]:
    """What a run needs to be repeated, with its hash."""
    body = {"config": asdict(c), **extra}
    return {**body, "hash": hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()}


def explain_diff(a: Mapping, b: Mapping, at: str = "") -> list[str]:
    """What differs between two manifests, a line each."""
    out = []
    for key in sorted({*a, *b} - {"hash"}):
        x, y = a.get(key), b.get(key)
        if isinstance(x, Mapping) and isinstance(y, Mapping):
            out += explain_diff(x, y, f"{at}{key}.")
        elif x != y:
            out.append(f"{at}{key}: {x!r} -> {y!r}")
    return out
