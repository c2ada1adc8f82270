"""Experiments as YAML or JSON files: read, checked as a whole, and written."""

from __future__ import annotations

import difflib
import importlib
import json
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from . import grid

_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}")
SECTIONS = ("corpus", "evalset", "axes", "run", "plugins", "acronyms")
MODES = ("factorial", "ofat", "staged")


class ConfigError(ValueError):
    """A file that describes no experiment; the message has all that is wrong with it."""


def expand(value: Any) -> Any:
    """Strings with ${NAME} and ${NAME:-default} replaced from the environment, at any depth."""
    if isinstance(value, Mapping):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        found = os.environ.get(m[1], m[2])
        if found is None:
            raise ConfigError(f"the environment has no {m[1]}")
        return found

    return _VARIABLE.sub(one, value)


@dataclass(frozen=True)
class Run:
    """How an experiment is run."""

    mode: str = "ofat"
    k: int = 10
    headline: str = "recall@5"
    budget_seconds: float | None = None
    budget_usd: float | None = None
    seed: int = 0
    machine_usd_per_hour: float = 0.0
    policy: str = "coverage"
    threshold: float = 0.5
    cache: str | None = None
    metrics: tuple[str, ...] = ()

    def problems(self) -> list[str]:
        out = []
        if self.mode not in MODES:
            out.append(f"run.mode is {self.mode!r}; known: {', '.join(MODES)}")
        if self.k < 1:
            out.append("run.k has to be at least 1")
        if self.policy not in ("coverage", "iou", "containment"):
            out.append(f"run.policy is {self.policy!r}; known: coverage, iou, containment")
        if not 0 < self.threshold <= 1:
            out.append("run.threshold has to be above 0 and at most 1")
        if not re.fullmatch(r"\w+@\d+", self.headline):
            out.append("run.headline is a metric and a cut-off, such as recall@5")
        out += [f"run.{name} has to be positive" for name in ("budget_seconds", "budget_usd") if (v := getattr(self, name)) is not None and v <= 0]
        return out


@dataclass(frozen=True)
class Experiment:
    corpus: str
    evalset: str | None = None
    axes: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    run: Run = Run()
    plugins: tuple[str, ...] = ()
    acronyms: Mapping[str, str] = field(default_factory=dict)

    def configs(self) -> list[grid.Config]:
        """The configurations that the mode asks for; those of a staged search depend on its results."""
        m = grid.Matrix(self.axes, self.run.k)
        return m.factorial() if self.run.mode == "factorial" else m.one_at_a_time()


def _unknown(where: str, key: str, known: Sequence[str]) -> str:
    near = difflib.get_close_matches(key, known, 1)
    return f"{where} has no {key!r}" + (f"; is it {near[0]!r}?" if near else f"; known: {', '.join(known)}")


def load_plugins(modules: Sequence[str]) -> None:
    """Import modules that register names of their own."""
    for name in modules:
        importlib.import_module(name)


def build(data: Any, base: Path = Path()) -> Experiment:
    """An experiment from nested mappings; every problem is told at once. Paths are relative to base."""
    if not isinstance(data, Mapping):
        raise ConfigError("an experiment is a mapping")
    data, problems = expand(data), []
    problems += [_unknown("the file", k, SECTIONS) for k in data if k not in SECTIONS]
    if not data.get("corpus"):
        problems.append("corpus is missing")
    load_plugins(tuple(data.get("plugins") or ()))
    axes: dict[str, list] = {}
    for axis, values in (data.get("axes") or {}).items():
        if axis not in grid.AXES:
            problems.append(_unknown("axes", axis, grid.AXES))
            continue
        axes[axis] = list(values) if isinstance(values, list) else [values]
        for v in axes[axis] if axis in grid.REGISTRY else ():
            try:
                if v is not None:
                    grid.parse_spec(axis, v)
            except grid.SpecError as e:
                problems.append(str(e))
    known = [f.name for f in fields(Run)]
    given = {}
    for k, v in (data.get("run") or {}).items():
        if k in known:
            given[k] = tuple([v] if isinstance(v, str) else v) if k == "metrics" else v
        else:
            problems.append(_unknown("run", k, known))
    try:
        run = Run(**given)
        problems += run.problems()
    except TypeError as e:
        problems.append(f"run: {e}")
    if problems:
        raise ConfigError("\n".join(problems))
    place = lambda p: str(base / p) if p and "://" not in str(p) else p
    return Experiment(place(data["corpus"]), place(data.get("evalset")), axes, run, tuple(data.get("plugins") or ()), dict(data.get("acronyms") or {}))


def loads(text: str, base: Path = Path()) -> Experiment:
    """YAML, of which JSON is a part."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"the text is neither YAML nor JSON: {e}") from None
    return build(data, base)


def load(path: str | Path) -> Experiment:
    source = Path(path)
    if not source.is_file():
        raise ConfigError(f"there is no file {source}")
    try:
        return loads(source.read_text(encoding="utf-8"), source.parent)
    except UnicodeDecodeError:
        raise ConfigError(f"{source} is not text") from None


def template() -> str:
    """A file to begin with."""
    return """# An experiment: what is searched, what is asked, and what is compared.
corpus: documents            # a folder of files, or Parquet with doc_id and text
evalset: questions.jsonl
axes:
  chunker: ["recursive:512", "sentence:3"]
  embedder: [tfidf]
  index: [bm25, dense, hybrid]
  reranker: [none, lexical]
run:
  mode: ofat                 # ofat, factorial or staged
  k: 10
  headline: recall@5
"""


def config_to_yaml(c: grid.Config, corpus: str = "documents", evalset: str = "questions.jsonl") -> str:
    """A file that runs one configuration again."""
    axes = {a: [getattr(c, a)] for a in grid.AXES if getattr(c, a) is not None}
    return yaml.safe_dump({"corpus": corpus, "evalset": evalset, "axes": axes, "run": {"k": c.k, "mode": "factorial"}}, sort_keys=False)


def config_to_python(c: grid.Config) -> str:
    """A call that builds one configuration again."""
    given = ", ".join(f"{f.name}={getattr(c, f.name)!r}" for f in fields(c) if getattr(c, f.name) is not None)
    return f"from passagemill.plans.grid import Config\n\nconfig = Config({given})\n"


def as_dict(e: Experiment) -> dict[str, Any]:
    return json.loads(json.dumps({"corpus": e.corpus, "evalset": e.evalset, "axes": dict(e.axes), "run": {f.name: getattr(e.run, f.name) for f in fields(Run)}, "plugins": e.plugins, "acronyms": dict(e.acronyms)}))
