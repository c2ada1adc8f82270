"""The grid: every registered name is reachable and does what it says, and what is made of its results."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from passagemill import lab
from passagemill.operators import metrics, rules
from passagemill.plans import config as cfg, cost, grid, ingest, report

WORDS = "river stone cloud maple engine copper violin harbour lantern meadow".split()


@pytest.fixture(scope="module")
def runner(spark):
    docs = [(i, "\n\n".join(f"# Part {j}\n\nThe {w} of topic{i} speaks of {w} number {j}. It is{' and' * (j % 3)} long; nothing else is said about {WORDS[(i + j) % 10]} here." for j, w in enumerate(WORDS[: 4 + i % 5]))) for i in range(8)]
    gold = [(i, i, t.index("speaks"), t.index("speaks") + 30, 2) for i, t in docs] + [(i, i, t.rindex("nothing"), t.rindex("nothing") + 20, 1) for i, t in docs[:4]]
    questions = [(i, f"what of topic{i} speaks and the {WORDS[i % 10]} SLA") for i, _ in docs]
    make = lambda rows, kind: spark.createDataFrame(rows, kind).coalesce(1).cache()

    def model(prompts):
        """Texts that depend on the instruction and on what it is about, and on nothing else."""
        seeds = [random.Random(p) for p in prompts]
        return [json.dumps([f"{r.choice(WORDS)} of topic{r.randrange(8)} number {r.randrange(9)}" for _ in range(2)]) for r in seeds]

    services = grid.Services(model, lambda texts: [[float(len(t)), float(t.count("topic")), float(sum(map(ord, t)) % 97)] for t in texts], lambda q, texts: [float(len(set(q.split()) & set(t.split()))) for t in texts])
    return grid.Runner(make(docs, "doc_id bigint, text string"), make(questions, "query_id bigint, text string"), make(gold, "item_id bigint, doc_id bigint, start int, end int, grade int"), {"SLA": "service level"}, services)


BASE = grid.Config(chunker="fixed:16,overlap=0", k=3)


def hits(runner, c):
    return sorted((r.query_id, r.rank, r.chunk_id) for r in runner.returned(c).select("query_id", "rank", "chunk_id").collect())


#: A specification for each registered name; those of one axis give different rankings.
ARMS = {
    "chunker": ["fixed:16,overlap=0", "recursive:16", "sentence:2", "structural:16", "semantic:50"],
    "embedder": ["tfidf", "hash:16", "length", "remote:e5"],
    "index": ["bm25", "dense", "hybrid:weighted", "quantized:binary"],
    "retrieval": ["simple", "decomposed", "relevance-feedback", "agentic"],
    "transform": ["none", "hyde", "multi-query", "step-back"],
    "reranker": ["none", "lexical", "mmr:0.9", "remote"],
    "ingestion": ["plain", "parent-document:2", "sentence-window:1", "hierarchical:2", "contextual", "hypothetical-questions", "propositions", "summary"],
}


@pytest.mark.parametrize("axis", sorted(ARMS))
def test_every_name_differs(runner, axis):
    """No two names of an axis are one arm: a name that is read and ignored would show here."""
    base = replace(BASE, index="dense", embedder="hash:64") if axis in ("embedder",) else replace(BASE, embedder="hash:64")
    found = {}
    for spec in ARMS[axis]:
        rows = hits(runner, replace(base, **{axis: spec}, candidates=6))
        assert rows and {q for q, _, _ in rows} <= set(range(8)), spec
        assert str(rows) not in found, f"{spec} gives what {found.get(str(rows))} gives"
        found[str(rows)] = spec


def test_codecs_and_depths_differ(runner):
    base = replace(BASE, embedder="hash:64")
    arms = ["quantized:scalar", "quantized:product,subspaces=32", "quantized:binary", "dense:l2", "dense:dot"]
    scores = {a: sorted(map(tuple, runner.returned(replace(base, index=a)).select("query_id", "chunk_id", "score").collect())) for a in arms}
    assert len({str(v) for v in scores.values()}) >= 4
    exact = sorted(map(tuple, runner.returned(replace(base, index="dense:dot")).select("query_id", "chunk_id").collect()))
    assert sorted(map(tuple, runner.returned(replace(base, index="quantized:binary,rescore=1000")).select("query_id", "chunk_id").collect())) == exact


@pytest.mark.parametrize("c", [replace(BASE, index="quantized:zip", embedder="tfidf"), replace(BASE, index="hybrid:sum", embedder="tfidf"), replace(BASE, index="bm25,depth=3"), replace(BASE, index="nothing"), replace(BASE, ingestion="parent-document:1"), replace(BASE, index="dense:angle", embedder="hash")])
def test_what_is_not_built_raises(runner, c):
    with pytest.raises(ValueError):
        runner.run(c).count()


def test_models_are_needed(runner):
    bare = grid.Runner(runner.docs, runner.questions, runner.gold)
    for axis, names in grid.NEED_MODEL.items():
        for name in names:
            c = replace(BASE, **{axis: name}, **({"index": "dense"} if axis == "embedder" else {}))
            with pytest.raises(grid.SpecError):
                bare.answers(c) if axis == "generator" else bare.returned(c)


def test_inverted_lists(runner):
    """One list of few vectors is the exact search."""
    base = replace(BASE, embedder="hash:64")
    assert hits(runner, replace(base, index="ivf:4")) == hits(runner, replace(base, index="dense"))


def test_parser_axis(runner):
    text, marked = (runner.chunks(replace(BASE, chunker="structural:16", parser=p)).collect() for p in ("text", "markdown"))
    assert {len(r.heading_path) for r in text} == {0} and {len(r.heading_path) for r in marked} == {1}


def test_windows_count_as_their_chunks(runner):
    """A window is scored as the chunk in its middle, then its neighbours; qrels are those of plain chunks."""
    c = replace(BASE, ingestion="sentence-window:1", k=2)
    made = runner.ingested(c)
    plain = {r.chunk_id for r in runner.chunks(c).collect()}
    assert {r.chunk_id for r in made.scored(runner.returned(c)).collect()} <= plain
    assert {r.chunk_id for r in runner.returned(c).collect()} & plain == set()
    first = {r.query_id: r.chunk_id for r in runner.search(c).where("rank = 1").collect()}
    assert first == {r.query_id: r.chunk_id for r in runner.search(replace(c, ingestion=None)).where("rank = 1").collect()}
    assert sorted(map(tuple, runner.qrels(c).collect())) == sorted(map(tuple, runner.qrels(replace(c, ingestion=None)).collect()))


def test_merged_text(spark):
    rows = [("a", 1, 0, 5, "01234", 1), ("b", 1, 3, 8, "34567", 1), ("c", 1, 8, 10, "89", 1), ("d", 2, 0, 2, "xy", 1), ("e", 2, 4, 6, "zw", 1), ("f", 3, 0, 1, "q", 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id bigint, start int, end int, text string, n_tokens int")
    got = {r.chunk_id: (r.text, r.n_tokens) for r in ingest.parent_document(chunks, 3).retrievable.collect()}
    assert got == {"1:0-10:parent": ("0123456789", 3), "2:0-6:parent": ("xy\nzw", 2), "f": ("q", 1)}
    windows = {r.chunk_id: r.text for r in ingest.sentence_window(chunks, 1).shown.collect()}
    assert windows["1:0-8:window1@a"] == "01234567" and windows["1:3-10:window1@c"] == "3456789" and windows["f@f"] == "q"


def test_results(runner, spark, tmp_path):
    runner.cache = grid.Cache(str(tmp_path / "cache"))
    arms = {"chunker": ["fixed:16,overlap=0", "sentence:2"], "index": ["bm25", "quantized:zip"], "embedder": ["tfidf"]}
    made = lab.Lab.__new__(lab.Lab)
    made.runner = runner
    results = made.grid(arms, "factorial", 5)
    assert sorted(n["status"] for n in results.notes) == ["failed", "failed", "ok", "ok"]
    again = made.grid(arms, "factorial", 5)
    assert report.to_json(again).count('"ok"') == 2 and runner.cache.hits >= 2
    rows = report.to_rows(results)
    assert len(rows) == 2 and rows[0]["metrics"]["recall@5"] >= rows[1]["metrics"]["recall@5"] and "char_recall@5" in rows[0]["metrics"]
    names = report.write_bundle(results, tmp_path / "out")
    assert names == sorted(report.FILES) and (tmp_path / "out" / "results.md").read_text().startswith("| place | configuration |")
    scope: dict = {}
    exec((tmp_path / "out" / "winner.py").read_text(), scope)
    assert scope["config"] == results.best() and cfg.loads((tmp_path / "out" / "winner.yaml").read_text()).configs()[0] == replace(results.best())
    (tmp_path / "out" / "own.txt").write_text("x")
    assert report.clear_bundle(tmp_path / "out") == list(report.FILES) and (tmp_path / "out" / "own.txt").exists()
    assert "configurations were scored" in results.summary() and results.is_the_winner_real().count() == 1
    assert {r.value for r in results.axis_effect("chunker").collect()} == set(arms["chunker"])
    assert "few_questions" in {r.code for r in results.warnings().collect()} and report.to_text(results).count("\n") == 2
    two = list(results.configs.values())[:2]
    assert results.compare(two[0], two[0]).count() == 0
    runner.cache = grid.Cache()


def test_budgets(runner):
    values, notes = runner.sweep([BASE], usd=0.0)
    assert values is None and [n["status"] for n in notes] == ["budget"]
    bill = cost.estimate(runner, replace(BASE, index="dense", embedder="remote:text-embedding-3-small"), cost.CostModel(3.6), seconds=1000)
    assert bill.index_tokens > 0 and bill.priced and bill.machine_usd == pytest.approx(1.0) and bill.metered_now(8) == pytest.approx(bill.index_tokens * 0.02 / 1e6 + 8 * bill.query_tokens_per_query * 0.02 / 1e6)
    assert not cost.CostModel().bill("remote:other/unknown", 10, 1).priced and cost.price_key("remote:a/b,dimensions=2") == "b"
    assert cost.Usage(1, 2, 3) + cost.Usage(1, 1, 1) == cost.Usage(2, 3, 4)


def test_metered(spark):
    t = spark.createDataFrame([("one two", "three"), (None, "a b!")], "prompt string, reply string")
    assert tuple(cost.metered(t).first()) == (2, 2, 4)


def test_generators(runner):
    for name in ("extractive", "llm"):
        rows = runner.answers(replace(BASE, generator=name)).collect()
        assert len(rows) == 8 and all(r.answer and r.context and r.answerable for r in rows)
    got = {r.metric: r.value for r in runner.answer_report(replace(BASE, generator="extractive")).collect()}
    assert got["groundedness"] == 1.0 and "citation_accuracy" not in got


def test_staged(runner):
    best, seen = runner.staged({"chunker": ["fixed:16,overlap=0", "sentence:2"], "index": ["bm25", "bm25:0.1"]}, k=3)
    assert len(seen) == 3 and max(s for _, s in seen) == dict(seen)[grid.canonical(best)]


def test_custom_metric(spark):
    grid.register("metric", "top1_only", lambda grades, judged, k: grades[0])
    qrels = spark.createDataFrame([(1, "a", 2), (2, "c", 1)], "query_id bigint, chunk_id string, grade int")
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id bigint, chunk_id string, rank int")
    assert sorted(map(tuple, metrics.custom(qrels, run, (1, 2), ["top1_only"]).collect())) == [(1, 1, "top1_only", 2.0), (1, 2, "top1_only", 2.0)]
    with pytest.raises(ValueError):
        metrics.custom(qrels, run, names=["nothing"])
    with pytest.raises(Exception, match="more than once"):
        metrics.per_query(qrels, run.union(run)).collect()


def test_rules_of_a_run(spark):
    configs = spark.createDataFrame([("hyde", None), (None, "mmr")], "transform string, reranker string")
    assert rules.unbounded_spend(configs, None).count() == 1 and rules.unbounded_spend(configs, 1.0).count() == 0
    done = spark.createDataFrame([("decomposed", 10, 10), ("simple", 10, 10), ("agentic", 10, 14)], "retrieval string, questions int, searches int")
    assert [r.subject for r in rules.strategy_did_nothing(done).collect()] == ["decomposed"]
    items = spark.createDataFrame([(1, True), (2, None)], "item_id bigint, reviewed boolean")
    assert tuple(rules.eval_quality(items).first()) == (2, 0.5, 1.4)


def test_composite_score(spark):
    rows = [("a", "recall", 5, 0.5), ("a", "ndcg", 5, 1.0), ("a", "char_recall", 10, 0.5), ("b", "recall", 5, 0.0), ("b", "char_recall", 10, 2.0)]
    got = {r.config_id: r.composite for r in metrics.composite_score(spark.createDataFrame(rows, "config_id string, metric string, k int, value double"), 5).collect()}
    assert got == {"a": 60.0, "b": 0.0}
    assert metrics.dominant_cutoff(spark.createDataFrame(rows, "config_id string, metric string, k int, value double")) == 5


def test_config_files(tmp_path, monkeypatch):
    monkeypatch.setenv("WHERE", "docs")
    e = cfg.loads("corpus: ${WHERE}\naxes:\n  index: [bm25, dense]\n  embedder: tfidf\n  chunker: ['fixed:${SIZE:-64}']\nrun: {k: 3, mode: factorial}\n")
    assert e.corpus == "docs" and e.axes["chunker"] == ["fixed:64"] and len(e.configs()) == 2 and e.run.k == 3
    assert cfg.as_dict(cfg.build(cfg.as_dict(e))) == cfg.as_dict(e)
    with pytest.raises(cfg.ConfigError) as wrong:
        cfg.loads('{"axs": {}, "axes": {"index": ["bm26"], "chunkr": 1}, "run": {"mode": "all", "kk": 2, "budget_usd": -1}}')
    for part in ("corpus is missing", "is it 'axes'?", "unknown index 'bm26'", "is it 'chunker'?", "run.mode", "no 'kk'", "budget_usd"):
        assert part in str(wrong.value)
    for bad in ("- 1", "a: [", "corpus: ${NOT_THERE_AT_ALL}"):
        with pytest.raises(cfg.ConfigError):
            cfg.loads(bad)
    with pytest.raises(cfg.ConfigError):
        cfg.load(tmp_path)
    assert cfg.loads(cfg.template()).run.headline == "recall@5"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "documents").mkdir()
    for i in range(4):
        (tmp_path / "documents" / f"d{i}.txt").write_text(f"This is about subject{i}. " * 6)
    items = [{"id": f"q{i}", "question": f"what is subject{i}", "anchors": [{"source_id": f"d{i}.txt", "quote": f"about subject{i}"}]} for i in range(4)]
    (tmp_path / "questions.jsonl").write_text("\n".join(map(json.dumps, items)))
    path = tmp_path / "e.yaml"
    assert lab.main(["init", str(path)]) == 0 and lab.main(["init", str(path)]) == 2
    path.write_text("corpus: documents\nevalset: questions.jsonl\naxes: {chunker: ['fixed:8,overlap=0'], index: [bm25]}\n")
    assert lab.main(["check", str(path)]) == 0 and lab.main(["plan", str(path)]) == 0 and lab.main(["list"]) == 0
    assert lab.main(["estimate", str(path)], spark) == 0 and lab.main(["run", str(path), "--out", str(tmp_path / "out")], spark) == 0
    out = capsys.readouterr().out
    assert "1 configurations" in out and '"index_tokens": 0' in out and "recall@5" in out
    best = json.loads((tmp_path / "out" / "results.json").read_text())["results"][0]
    assert best["metrics"]["hit_rate@5"] == 1.0
    assert lab.main(["clear", str(tmp_path / "out")]) == 0 and lab.main(["fingerprint", str(tmp_path / "documents")], spark) == 0 and lab.main(["check", "nowhere"]) == 2
