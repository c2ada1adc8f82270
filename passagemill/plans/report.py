"""Results of a grid: boards, comparisons, and the files of a report."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics, rules
from . import config as cfg, grid

#: The files of a bundle; a bundle is cleared of these alone.
FILES = ("results.json", "results.md", "winner.yaml", "winner.py", "manifest.json")


@dataclass
class Results:
    """values(config_id, metric, k, value) of configurations, and what became of each."""

    values: DataFrame
    configs: Mapping[str, grid.Config]
    notes: Sequence[Mapping[str, Any]] = ()
    runner: grid.Runner | None = None

    def board(self, metric: str = "recall", k: int = 5) -> DataFrame:
        return grid.leaderboard(self.values, metric, k)

    def best(self, metric: str = "recall", k: int = 5) -> grid.Config | None:
        row = self.board(metric, k).where("place = 1").first()
        return self.configs[row["config_id"]] if row else None

    def axis_effect(self, axis: str, metric: str = "recall", k: int = 5) -> DataFrame:
        """(value, n, mean) of a metric for each value of an axis."""
        spark = self.values.sparkSession
        of = spark.createDataFrame([(i, None if getattr(c, axis) is None else str(getattr(c, axis))) for i, c in self.configs.items()], "config_id string, axis string")
        chosen = self.values.where((F.col("metric") == metric) & (F.col("k") == k))
        return metrics.axis_effect(chosen.join(F.broadcast(of), "config_id").withColumn("axis", F.coalesce("axis", F.lit("none"))), "axis", "value")

    def compare(self, left: grid.Config, right: grid.Config, metric: str = "recall", k: int = 5) -> DataFrame:
        """The questions on which two configurations part."""
        return metrics.disagreement(*(self._per_query(c, k) for c in (left, right)), metric, k)

    def _per_query(self, c: grid.Config, k: int) -> DataFrame:
        if self.runner is None:
            raise ValueError("these results have no runner to ask")
        return metrics.per_query(self.runner.qrels(c), self.runner.search(c), (k,))

    def is_the_winner_real(self, metric: str = "recall", k: int = 5) -> DataFrame | None:
        """The first against the second: (n, mean_difference, low, high, p, verdict); None without a second."""
        two = [r["config_id"] for r in self.board(metric, k).where("place <= 2").orderBy("place").collect()]
        if len(two) < 2:
            return None
        return metrics.significance(*(self._per_query(self.configs[i], k) for i in two), metric, k)

    def warnings(self, metric: str = "recall", k: int = 5) -> DataFrame:
        """What the results are held against."""
        spark = self.values.sparkSession
        table = spark.createDataFrame([(c.index, c.reranker, c.candidates, c.retrieval, c.generator) for c in self.configs.values()], "index string, reranker string, candidates int, retrieval string, generator string")
        return rules.unique(rules.at_ceiling(self.values, metric, k), rules.approximate_alone(table), rules.depth_without_reranker(table), rules.few_questions(self.runner.questions) if self.runner else rules.none(spark))

    def summary(self, metric: str = "recall", k: int = 5) -> str:
        """The results in words."""
        rows = self.board(metric, k).orderBy("place").collect()  # a row a configuration
        if not rows:
            return "No configuration was scored."
        lines = [f"{len(rows)} of {max(len(rows), len(self.notes))} configurations were scored by {metric}@{k}.", f"Best: {self.configs[rows[0]['config_id']].label} at {rows[0]['value']:.3f}."]
        if len(rows) > 1:
            gap = rows[0]["value"] - rows[1]["value"]
            lines.append(f"Next: {self.configs[rows[1]['config_id']].label} at {rows[1]['value']:.3f}, {gap:.3f} behind.")
            if self.runner is not None:
                lines.append(metrics.sample_size_note(self.runner.questions.count(), gap) + ".")
        lines += [f"{n['status']}: {n.get('label', n.get('config'))}: {n.get('why', '')}".rstrip(": ") for n in self.notes if n.get("status") != "ok"]
        return "\n".join(lines)


def to_rows(results: Results) -> list[dict[str, Any]]:
    """A record a configuration: what it is and its metrics, best first by recall@5."""
    by: dict[str, dict[str, float]] = {}
    for r in results.values.collect():  # a row a configuration, metric and cut-off
        by.setdefault(r["config_id"], {})[f"{r['metric']}@{r['k']}"] = r["value"]
    rows = [{"id": i, "label": results.configs[i].label, "config": asdict(results.configs[i]), "metrics": dict(sorted(m.items()))} for i, m in by.items()]
    return sorted(rows, key=lambda r: (-r["metrics"].get("recall@5", 0.0), r["id"]))


def to_json(results: Results) -> str:
    return json.dumps({"results": to_rows(results), "notes": list(results.notes)}, indent=1, sort_keys=True)


def _cells(results: Results, columns: Sequence[str]) -> list[list[str]]:
    rows = [["place", "configuration", *columns]]
    for i, r in enumerate(to_rows(results), 1):
        rows.append([str(i), r["label"], *(f"{r['metrics'][c]:.3f}" if c in r["metrics"] else "-" for c in columns)])
    return rows


COLUMNS = ("recall@5", "ndcg@5", "mrr@5", "char_recall@10")


def to_markdown(results: Results, columns: Sequence[str] = COLUMNS) -> str:
    head, *rows = _cells(results, columns)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(head), "|" + " --- |" * len(head), *map(line, rows)])


def to_text(results: Results, columns: Sequence[str] = COLUMNS) -> str:
    rows = _cells(results, columns)
    widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


def evalset_hash(gold: DataFrame, questions: DataFrame) -> str:
    """SHA-256 of questions and evidence in order, whatever their partitions: sums of row hashes, no list in one task."""
    def digest(df: DataFrame) -> str:
        h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        row = df.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
        return f"{row['n']}:{row['h']}"

    return hashlib.sha256(f"{digest(questions)}|{digest(gold)}".encode()).hexdigest()


def build_manifest(results: Results, c: grid.Config) -> dict[str, Any]:
    """What a configuration's run needs to be repeated."""
    import numpy
    import pyspark

    extra: dict[str, Any] = {"versions": {"pyspark": pyspark.__version__, "numpy": numpy.__version__}}
    if results.runner is not None:
        extra |= {"evalset": evalset_hash(results.runner.gold, results.runner.questions), "resolution": {"policy": results.runner.policy, "threshold": results.runner.threshold}}
    return grid.manifest(c, **extra)


def clear_bundle(folder: str | Path) -> list[str]:
    """Remove a bundle's own files; others stay."""
    gone = [f for f in FILES if (Path(folder) / f).is_file()]
    for f in gone:
        (Path(folder) / f).unlink()
    return gone


def write_bundle(results: Results, folder: str | Path, metric: str = "recall", k: int = 5) -> list[str]:
    """The report as files of the driver, and the values as Parquet beside them."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    clear_bundle(to)
    files = {"results.json": to_json(results), "results.md": to_markdown(results) + "\n\n" + results.summary(metric, k) + "\n"}
    if (winner := results.best(metric, k)) is not None:
        files |= {"winner.yaml": cfg.config_to_yaml(winner), "winner.py": cfg.config_to_python(winner), "manifest.json": json.dumps(build_manifest(results, winner), indent=1, sort_keys=True)}
    for name, text in files.items():
        (to / name).write_text(text, encoding="utf-8")
    results.values.write.mode("overwrite").parquet(str(to / "values"))
    return sorted(files)
