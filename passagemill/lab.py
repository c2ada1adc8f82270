"""One object for the common experiments, and the command line over it."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import chunk as ch, questions as qs, resolve
from .plans import config as cfg, cost, grid, report
from .runtime import ship
from .sources import corpus, evalset


class Lab:
    """docs(doc_id, text), questions(query_id, text) and gold(item_id, doc_id, start, end, grade), and what is done with them."""

    def __init__(self, docs: DataFrame, questions: DataFrame, gold: DataFrame, acronyms: Mapping[str, str] | None = None, services: grid.Services | None = None, cache: str | None = None, policy: str = "coverage", threshold: float = 0.5) -> None:
        ship(docs.sparkSession)
        self.runner = grid.Runner(docs, questions, gold, acronyms, services, grid.Cache(cache), policy, threshold)

    @classmethod
    def open(cls, spark: SparkSession, documents: str, items: str, **how: Any) -> Lab:
        """From a folder of files, or Parquet with doc_id and text, and an evaluation set; its anchors are resolved."""
        if Path(documents).is_dir() and not any(Path(documents).glob("*.parquet")):
            docs = corpus.texts_of(corpus.from_dir(spark, documents)).select(F.col("id").alias("doc_id"), "text")
        else:
            docs = spark.read.parquet(documents).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        docs = docs.withColumn("doc_key", F.xxhash64("doc_id"))
        found = evalset.read_evalset(spark, items)
        keyed = found.where("id is not null").withColumn("item_id", F.xxhash64("id"))
        spans = keyed.select("item_id", F.explode("gold").alias("g")).select("item_id", F.xxhash64("g.doc_id").alias("doc_id"), F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.coalesce("g.grade", F.lit(2)).alias("grade"))
        anchors = keyed.select("item_id", F.explode("anchors").alias("a")).select("item_id", F.xxhash64("a.source_id").alias("doc_id"), F.col("a.quote").alias("quote"), F.coalesce("a.occurrence", F.lit(0)).alias("occurrence"), F.col("a.page_hint").alias("page_hint"), F.coalesce("a.grade", F.lit(2)).alias("grade"))
        plain = docs.select(F.col("doc_key").alias("doc_id"), "text")
        placed = resolve.resolve_anchors(anchors, plain).where("start is not null").join(anchors.select("item_id", "doc_id", "quote", "grade"), ["item_id", "doc_id", "quote"])
        gold = spans.unionByName(placed.select("item_id", "doc_id", "start", "end", "grade")).distinct()
        return cls(plain, keyed.select(F.col("item_id").alias("query_id"), F.col("question").alias("text")), gold, **how)

    def grid(self, axes: Mapping[str, Sequence], mode: str = "ofat", k: int = 10, seconds: float | None = None, usd: float | None = None, costs: cost.CostModel | None = None) -> report.Results:
        """Run configurations and gather what they score."""
        matrix = grid.Matrix(axes, k)
        if mode == "staged":
            configs = [c for c, _ in self.runner.staged(axes)[1]]
        else:
            configs = matrix.factorial() if mode == "factorial" else matrix.one_at_a_time()
        values, notes = self.runner.sweep(configs, seconds, usd, costs)
        if values is None:
            values = self.runner.docs.sparkSession.createDataFrame([], "metric string, k int, value double, config_id string")
        return report.Results(values, {c.id: c for c in grid.distinct_runnable(configs)[0]}, notes, self.runner)

    def run(self, experiment: cfg.Experiment) -> report.Results:
        r = experiment.run
        return self.grid(experiment.axes, r.mode, r.k, r.budget_seconds, r.budget_usd, cost.CostModel(r.machine_usd_per_hour))

    def estimate(self, axes: Mapping[str, Sequence], k: int = 10, costs: cost.CostModel | None = None) -> list[dict]:
        """What the configurations would cost, none of them run."""
        kept = grid.distinct_runnable(grid.Matrix(axes, k).factorial())[0]
        return [{"config": c.id, "label": c.label, **cost.estimate(self.runner, c, costs or cost.CostModel()).as_dict()} for c in kept]

    def preview(self, chunker: str = "recursive:512") -> DataFrame:
        """The chunks of a specification."""
        return self.runner.chunks(grid.Config(chunker=chunker))

    def fingerprint(self) -> DataFrame:
        return corpus.fingerprint(self.runner.docs)

    def probes(self, sample: int = 50) -> DataFrame:
        """Questions made of rare words, for a corpus that has none."""
        return qs.keyword_probes(qs.spread_sample(ch.chunk(self.runner.docs, "fixed", size=256), sample))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="passagemill", description="Retrieval experiments on Spark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init", help="write an experiment file to begin with").add_argument("path", nargs="?", default="passagemill.yaml")
    for name, text in (("check", "check an experiment file"), ("plan", "list the configurations of an experiment"), ("estimate", "tell what an experiment would cost"), ("run", "run an experiment")):
        sub = verbs.add_parser(name, help=text)
        sub.add_argument("path")
        if name == "run":
            sub.add_argument("--out", default="report")
    verbs.add_parser("list", help="list the names of each axis")
    verbs.add_parser("fingerprint", help="describe a corpus").add_argument("corpus")
    verbs.add_parser("clear", help="remove a report's files").add_argument("folder")
    given = parser.parse_args(argv)
    session = lambda: spark or SparkSession.builder.getOrCreate()
    try:
        if given.verb == "init":
            if Path(given.path).exists():
                raise cfg.ConfigError(f"{given.path} is there already")
            Path(given.path).write_text(cfg.template(), encoding="utf-8")
        elif given.verb == "list":
            print("\n".join(f"{axis}: {', '.join(names)}" for axis, names in grid.REGISTRY.items()))
        elif given.verb == "clear":
            print("\n".join(report.clear_bundle(given.folder)))
        elif given.verb == "fingerprint":
            files = corpus.from_dir(session(), given.corpus)
            corpus.fingerprint(corpus.texts_of(files).select(F.col("id").alias("doc_id"), "text")).show(truncate=False)
        else:
            e = cfg.load(given.path)
            if given.verb == "check":
                print(f"{given.path}: {len(e.configs())} configurations")
            elif given.verb == "plan":
                kept, account = grid.distinct_runnable(e.configs())
                print("\n".join([*(c.label for c in kept), json_line(account)]))
            else:
                lab = Lab.open(session(), e.corpus, e.evalset or "", acronyms=e.acronyms, cache=e.run.cache, policy=e.run.policy, threshold=e.run.threshold)
                if given.verb == "estimate":
                    print("\n".join(json_line(x) for x in lab.estimate(e.axes, e.run.k, cost.CostModel(e.run.machine_usd_per_hour))))
                else:
                    results = lab.run(e)
                    report.write_bundle(results, given.out)
                    print(report.to_text(results))
    except (cfg.ConfigError, grid.SpecError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


def json_line(value: Any) -> str:
    import json

    return json.dumps(value, sort_keys=True)


if __name__ == "__main__":
    sys.exit(main())
