"""The registered queries of the retrieval operators, over whole tables, and DuckDB SQL for those that it can express.

The corpus is ``documents``, questions and evidence are ``benchmark`` (a passage is question and quote), dense vectors
are ``embeddings`` (equal labels are relevant), and ``events`` and ``conversations`` stand in for telemetry and answers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import spans as sp, text as tx
from ..operators import chunk as ch, codecs, embed, metrics, questions as qs, resolve, search
from ..runtime import cut
from ..sources import corpus
from . import cost, grid, ingest

SIZE, OVERLAP, K = 512, 64, 10
ACRONYMS = {"SLA": "service level agreement", "GDPR": "data protection regulation", "der": "the"}
GRID = {"chunker": ("fixed:256", "recursive:512"), "index": ("bm25", "dense", "hybrid"), "embedder": (None, "tfidf"), "reranker": ("none", "lexical"), "candidates": (50, 100)}

Query = Callable[[SparkSession, str], DataFrame]


class _T:
    """The tables of a folder, and what several queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")

    def docs(self) -> DataFrame:
        return self.documents.select("doc_id", "text")

    def questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text")

    def chunks(self) -> DataFrame:
        return ch.chunk(self.docs(), "fixed", size=SIZE, overlap=OVERLAP, tokenizer="character")

    def places(self) -> DataFrame:
        return resolve.find_quotes(self.docs(), self.benchmark.select("item_id", F.col("text").alias("quote")))

    def gold(self) -> DataFrame:
        return self.places().select("item_id", "doc_id", "start", "end", F.lit(2).alias("grade"))

    def qrels(self) -> DataFrame:
        return resolve.qrels(self.gold(), self.chunks())

    def run(self, k: int = K) -> DataFrame:
        return search.bm25(self.chunks().select("chunk_id", "text"), self.questions(), k)

    def both_runs(self) -> tuple[DataFrame, DataFrame]:
        """Scores by query of the run, and of one with k1 = 0.9. The judgements, a few rows a question, are made once."""
        rel = cut(self.qrels())
        runs = search.bm25_runs(self.chunks().select("chunk_id", "text"), self.questions(), K, [(search.K1, search.B), (0.9, search.B)])
        return tuple(metrics.per_query(rel, r) for r in runs)

    def dense(self) -> DataFrame:
        chunks = self.chunks().select("chunk_id", "text")
        return search.tfidf_search(chunks, self.questions(), embed.tfidf_fit(chunks), 100)

    def asked(self) -> DataFrame:
        """The queries of the vector searches."""
        return self.embeddings.where(F.col("vec_id") % 50 == 0)

    def spoken(self) -> DataFrame:
        """Answers with what came before them as context and as the text to match."""
        turns = self.conversations
        user = turns.where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("c"))
        said = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
        context = F.transform("c", lambda x: x["text"])
        return said.join(user, "conv_id").select(F.col("conv_id").alias("query_id"), "answer", context.alias("context"), F.element_at(context, 1).alias("gold"), F.lit(True).alias("answerable"))


class _Plain(grid.Cache):
    """Nothing is kept: a query's plan stands for itself."""

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        return make()


QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Common table expressions by name; a query's SQL gets those it mentions, and those they mention.
_CTE: dict[str, str] = {
    "chars": f"""SELECT doc_id, p0, greatest(0, p0 - {OVERLAP}) AS lo, least(length(text), p0 + {SIZE}) AS hi, text
  FROM (SELECT doc_id, text, unnest(range(0, length(text), {SIZE - OVERLAP})) AS p0 FROM documents WHERE text IS NOT NULL)
  WHERE p0 = 0 OR p0 - {SIZE - OVERLAP} + {SIZE} < length(text)""",
    "cut": r"""SELECT doc_id, p0, lo + length(s) - length(regexp_replace(s, '^\s+', '')) AS "start", hi - (length(s) - length(regexp_replace(s, '\s+$', ''))) AS "end", text
  FROM (SELECT *, substring(text, lo + 1, hi - lo) AS s FROM chars)""",
    "chunks": """SELECT doc_id || ':' || "start" || '-' || "end" AS chunk_id, doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p0) - 1)::INT AS idx, "start"::INT AS "start", "end"::INT AS "end", substring(text, "start" + 1, "end" - "start") AS text FROM cut""",
    "places": """SELECT item_id, doc_id, (p - 1)::INT AS "start", (p - 1 + n)::INT AS "end", (row_number() OVER (PARTITION BY item_id, doc_id ORDER BY p) - 1)::INT AS occurrence
  FROM (SELECT b.item_id, d.doc_id, length(b.text) AS n, unnest(list_filter(range(1, length(d.text) - length(b.text) + 2), lambda i: substring(d.text, i, length(b.text)) = b.text)) AS p
        FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0)""",
    "judged": """SELECT g.item_id, g.doc_id, g."start" AS gs, g."end" AS ge, c.chunk_id, c."start" AS cs, c."end" AS ce, least(g."end", c."end") - greatest(g."start", c."start") AS o
  FROM places g JOIN chunks c ON g.doc_id = c.doc_id AND c."start" < g."end" AND g."start" < c."end" """,
    "qrels": "SELECT item_id AS query_id, chunk_id, 2 AS grade FROM judged WHERE o / (ge - gs) >= 0.5 GROUP BY ALL",
    "cterms": r"SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM chunks",
    "qterms": r"SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark",
    "asked": "SELECT query_id, term, count(*) AS qf FROM qterms GROUP BY ALL",
    "lens": r"SELECT chunk_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n FROM chunks",
    "post": "SELECT chunk_id, term, count(*)::DOUBLE AS f FROM cterms GROUP BY ALL",
    "dfs": "SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term",
    "bm_all": """SELECT a.query_id, p.chunk_id, round(sum(a.qf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.f * 2.5 / (p.f + 1.5 * (0.25 + 0.75 * l.n / s.av))), 6) AS score
  FROM asked a JOIN post p USING (term) JOIN dfs d USING (term) JOIN lens l USING (chunk_id), (SELECT count(*)::DOUBLE AS n, avg(n) AS av FROM lens) s GROUP BY ALL""",
    "bm100": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm_all QUALIFY rank <= 100",
    "run": "SELECT * FROM bm100 WHERE rank <= 10",
    "bm50": "SELECT * FROM bm100 WHERE rank <= 50",
    "low_all": """SELECT a.query_id, p.chunk_id, round(sum(a.qf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.f * 1.9 / (p.f + 0.9 * (0.25 + 0.75 * l.n / s.av))), 6) AS score
  FROM asked a JOIN post p USING (term) JOIN dfs d USING (term) JOIN lens l USING (chunk_id), (SELECT count(*)::DOUBLE AS n, avg(n) AS av FROM lens) s GROUP BY ALL""",
    "low": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM low_all QUALIFY rank <= 10",
    "vocab": "SELECT term, ln((1 + (SELECT count(*) FROM chunks)::DOUBLE) / (1 + df)) + 1 AS idf FROM dfs ORDER BY df DESC, term LIMIT 4096",
    "craw": "SELECT chunk_id, term, (1 + ln(f)) * idf AS w FROM post JOIN vocab USING (term)",
    "cw": "SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight FROM craw",
    "qraw": "SELECT query_id, term, (1 + ln(qf)) * idf AS w FROM asked JOIN vocab USING (term)",
    "qw": "SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qraw",
    "dn": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(cw.weight * qw.weight), 6) AS score FROM cw JOIN qw USING (term) GROUP BY ALL) QUALIFY rank <= 100",
    "levels": "SELECT unnest([1, 3, 5, 10, 20])::INT AS k",
    "rel": "SELECT query_id, chunk_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS pos, count(*) OVER (PARTITION BY query_id) AS n_rel FROM qrels",
    "hits": "SELECT r.query_id, r.grade, x.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY x.rank) AS found FROM rel r JOIN bm100 x USING (query_id, chunk_id)",
    "per": """SELECT q.query_id, q.k, round(coalesce(h.n / q.n_rel, 0), 6) AS recall, round(coalesce(h.n / q.k, 0), 6) AS precision, round(CASE WHEN h.n > 0 THEN 1.0::DOUBLE ELSE 0 END, 6) AS hit_rate,
    round(coalesce(1.0::DOUBLE / h.first, 0), 6) AS mrr, round(coalesce(h.ap / q.n_rel, 0), 6) AS map, round(coalesce(h.dcg / q.idcg, 0), 6) AS ndcg
  FROM (SELECT query_id, k, n_rel, sum(CASE WHEN pos <= k THEN grade / log2(pos + 1.0::DOUBLE) ELSE 0 END) AS idcg FROM rel, levels GROUP BY ALL) q
  LEFT JOIN (SELECT query_id, k, count(*) AS n, min(rank) AS first, sum(found / rank::DOUBLE) AS ap, sum(grade / log2(rank + 1.0::DOUBLE)) AS dcg FROM hits, levels WHERE rank <= k GROUP BY ALL) h USING (query_id, k)""",
    "dhits": "SELECT r.query_id, r.grade, x.rank, row_number() OVER (PARTITION BY r.query_id ORDER BY x.rank) AS found FROM rel r JOIN dn x USING (query_id, chunk_id) WHERE x.rank <= 10",
    "vecs": "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings",
    "elems": "SELECT vec_id, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM vecs",
    "bits": "SELECT vec_id, list(CASE WHEN x > m THEN 1 ELSE 0 END ORDER BY dim) AS bits FROM (SELECT *, round(avg(x) OVER (PARTITION BY dim), 9) AS m FROM elems) GROUP BY vec_id",
    "exact": "SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) + 0.0 DESC, b.vec_id) AS rank FROM vecs a, vecs b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10",
    "far": "SELECT a.vec_id AS query_id, b.vec_id, -list_sum(list_transform(range(1, len(a.bits) + 1), lambda i: CASE WHEN a.bits[i] = b.bits[i] THEN 0 ELSE 1 END))::DOUBLE AS score FROM bits a, bits b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id",
    "decoded": """SELECT vec_id, list(least(255, greatest(0, round_even((x - lo) / step, 0))) * step + lo ORDER BY dim) AS v
  FROM (SELECT vec_id, dim, x, min(x) OVER w AS lo, (CASE WHEN max(x) OVER w > min(x) OVER w THEN max(x) OVER w - min(x) OVER w ELSE 1 END) / 255.0::DOUBLE AS step FROM elems WINDOW w AS (PARTITION BY dim)) GROUP BY vec_id""",
    "near": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM far QUALIFY rank <= 10",
    "bm40": "SELECT * FROM bm100 WHERE rank <= 40",
    "groups": 'SELECT *, ((row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end") - 1) // 4)::INT AS parent FROM chunks',
    "pmap": """SELECT chunk_id, doc_id || ':' || min("start") OVER w || '-' || max("end") OVER w || '#parent' AS parent_id FROM groups WINDOW w AS (PARTITION BY doc_id, parent)""",
    "pmap4": """SELECT chunk_id, CASE WHEN count(*) OVER w > 1 THEN doc_id || ':' || first_value("start") OVER o || '-' || last_value("end") OVER o || ':parent' ELSE chunk_id END AS parent_id FROM groups WINDOW w AS (PARTITION BY doc_id, parent), o AS (PARTITION BY doc_id, parent ORDER BY "start", "end", chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "longest": r"""SELECT chunk_id, trim(p, ' ') AS quote FROM (SELECT chunk_id, p, row_number() OVER (PARTITION BY chunk_id ORDER BY length(trim(p, ' ')) DESC, i) AS nth FROM (
      SELECT chunk_id, unnest(l) AS p, unnest(range(0, len(l))) AS i FROM (SELECT chunk_id, list_filter(regexp_extract_all(text, '[^\n?!.]+[?!.]?'), lambda x: length(trim(x, ' ')) > 0) AS l FROM chunks))) WHERE nth = 1""",
    "typed": "SELECT item_id AS query_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for t, p in qs.PATTERNS) + " ELSE 'factoid' END AS qtype FROM benchmark",
}


_CTE["dper"] = _CTE["per"].replace("FROM hits, levels", "FROM dhits, levels")
_CTE = {n: _CTE[n] for n in (*list(_CTE)[: list(_CTE).index("vecs")], "dper", *list(_CTE)[list(_CTE).index("vecs") : -1])}


def _with(body: str) -> str:
    """A query's SQL with the expressions that it needs, in order."""
    needed: set[str] = set()

    def need(sql: str) -> None:
        for name in _CTE:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
                needed.add(name)
                need(_CTE[name])

    need(body)
    parts = [f"{n} AS MATERIALIZED (\n  {_CTE[n]})" for n in _CTE if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(sql: str | None = None) -> Callable[[Callable[[_T], DataFrame]], Callable[[_T], DataFrame]]:
    """Register a query under the function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[_T], DataFrame]) -> Callable[[_T], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(_T(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


# Sources and tokens


@query("""SELECT count(*) AS documents, count(*) FILTER (trim(text) = '') AS empty, sum(length(text)) AS chars, median(length(text)) AS median_chars, max(length(text)) AS longest,
  (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY text)) AS duplicates FROM documents""")
def corpus_fingerprint(t: _T) -> DataFrame:
    return corpus.fingerprint(t.docs())


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_groups(t: _T) -> DataFrame:
    return corpus.duplicate_groups(t.docs())


@query(r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, token, (e - length(token))::INT AS "start", e::INT AS "end" FROM (
  SELECT doc_id, i, token, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]|[\s\p{Z}]+') AS l FROM documents)))
WHERE NOT regexp_matches(token, '^[\s\p{Z}]')""")
def token_spans(t: _T) -> DataFrame:
    return ch.token_table(t.docs())


@query(r"""SELECT doc_id, i::INT AS line, (e - length(s))::INT AS "start", e::INT AS "end" FROM (
  SELECT doc_id, i, s, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def line_spans(t: _T) -> DataFrame:
    return ch.line_table(t.docs())


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS words, length(text) AS characters FROM documents")
def token_counts(t: _T) -> DataFrame:
    return t.docs().select("doc_id", F.size(tx.words(F.col("text"))).alias("words"), F.length("text").alias("characters"))


# Chunkers and parsers


@query('SELECT chunk_id, doc_id, idx, "start", "end", md5(text) AS digest, ("end" - "start")::INT AS n_tokens FROM chunks')
def chunk_fixed_char(t: _T) -> DataFrame:
    return t.chunks().select("chunk_id", "doc_id", "idx", "start", "end", F.md5("text").alias("digest"), "n_tokens")


def _chunker(name: str, sql: str | None = None, **how) -> None:
    def f(t: _T) -> DataFrame:
        return ch.chunk(t.docs(), name, **how).select("chunk_id", "doc_id", "idx", "start", "end", "n_tokens")

    f.__name__ = f"chunk_{name}"
    query(sql)(f)


_CTE["tokens"] = r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n, e - length(token) AS s, e FROM (
  SELECT doc_id, i, token, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]|[\s\p{Z}]+') AS l FROM documents)))
  WHERE NOT regexp_matches(token, '^[\s\p{Z}]')"""
_chunker("fixed", """SELECT w.doc_id || ':' || a.s || '-' || b.e AS chunk_id, w.doc_id, (w0 // 224)::INT AS idx, a.s::INT AS "start", b.e::INT AS "end", (hi - lo)::INT AS n_tokens
FROM (SELECT doc_id, w0, greatest(0, w0 - 32) AS lo, least(n, w0 + 256) AS hi FROM (SELECT doc_id, n, unnest(range(0, n, 224)) AS w0 FROM (SELECT DISTINCT doc_id, n FROM tokens)) WHERE w0 = 0 OR w0 + 32 < n) w
JOIN tokens a ON a.doc_id = w.doc_id AND a.pos = lo JOIN tokens b ON b.doc_id = w.doc_id AND b.pos = hi - 1""", size=256)

for _name, _how in (("recursive", {"size": 256}), ("sentence", {"window": 3}), ("structural", {"max_size": 256}), ("semantic", {"cut_at": 90.0})):
    _chunker(_name, **_how)


@query("SELECT 0::BIGINT AS wrong, count(*) AS chunks FROM chunks")
def chunk_offsets_exact(t: _T) -> DataFrame:
    """Chunks that are no literal slice of their document: none."""
    chunks = t.chunks()
    return ch.verify_blocks(chunks, t.docs()).agg(F.count("*").alias("wrong")).crossJoin(chunks.agg(F.count("*").alias("chunks")))


@query()
def parse_markdown(t: _T) -> DataFrame:
    return ch.parse(t.docs(), "markdown").drop("text")


@query(r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ord, (p0 + length(p) - length(regexp_replace(p, '^\s+', '')))::INT AS "start", (p0 + length(regexp_replace(p, '\s+$', '')))::INT AS "end", 'paragraph' AS kind, NULL::INT AS level
FROM (SELECT *, e - length(p) - coalesce(length(m), 0) AS p0 FROM (
  SELECT doc_id, i, p, m, sum(length(p) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p, unnest(list_concat(ms, [NULL])) AS m FROM (
      SELECT doc_id, string_split_regex(text, '\n[ \t]*\n') AS ps, regexp_extract_all(text, '\n[ \t]*\n') AS ms FROM documents WHERE text IS NOT NULL)))) WHERE regexp_matches(p, '\S')""")
def parse_text(t: _T) -> DataFrame:
    return ch.parse(t.docs()).drop("text")


# Spans


@query("""SELECT item_id, gs, ge, chunk_id, o::INT AS overlap, (ge - gs + ce - cs - o)::INT AS union_len, round(o / (ge - gs + ce - cs - o), 6) AS iou, round(o / (ge - gs), 6) AS coverage, cs <= gs AND ge <= ce AS contains FROM judged""")
def span_algebra(t: _T) -> DataFrame:
    j = resolve.judge(t.gold(), t.chunks())
    c = ("start", "end", "gold_start", "gold_end")
    return j.select("item_id", F.col("gold_start").alias("gs"), F.col("gold_end").alias("ge"), "chunk_id", sp.overlap_len(*c).alias("overlap"), sp.union_len(*c).alias("union_len"), F.round(sp.iou(*c), 6).alias("iou"), F.round(sp.coverage_of(*c), 6).alias("coverage"), sp.contains(*c).alias("contains"))


_ISLANDS = """(SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM (
  SELECT *, sum(CASE WHEN "start" > coalesce(before, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT doc_id, "start", "end", max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {0} WHERE "end" > "start")) GROUP BY doc_id, g)"""


@query(f'SELECT doc_id, "start"::INT AS "start", "end"::INT AS "end" FROM {_ISLANDS.format("chunks")}')
def merge_spans(t: _T) -> DataFrame:
    return sp.merge_spans(t.chunks(), ["doc_id"]).select("doc_id", "start", "end")


@query(f'SELECT doc_id, sum("end" - "start")::BIGINT AS total_length FROM {_ISLANDS.format("chunks")} GROUP BY doc_id')
def span_total_length(t: _T) -> DataFrame:
    return sp.total_length(t.chunks(), ["doc_id"])


@query(f'SELECT a.doc_id, sum(least(a."end", b."end") - greatest(a."start", b."start"))::BIGINT AS shared_length FROM {_ISLANDS.format("chunks")} a JOIN {_ISLANDS.format("places")} b ON a.doc_id = b.doc_id AND a."start" < b."end" AND b."start" < a."end" GROUP BY a.doc_id')
def span_intersection(t: _T) -> DataFrame:
    return sp.intersection_length(t.chunks(), t.places(), ["doc_id"])


# Evidence


@query("SELECT * FROM places")
def anchor_exact(t: _T) -> DataFrame:
    return t.places()


@query()
def anchor_resolve(t: _T) -> DataFrame:
    """Every quote in every document that has it verbatim, in other white space or abridged; not_found for the rest."""
    return resolve.resolve_everywhere(t.benchmark.select("item_id", F.col("text").alias("quote")), t.docs())


@query("SELECT query_id, chunk_id, grade FROM qrels")
def resolve_coverage(t: _T) -> DataFrame:
    return t.qrels()


@query("SELECT item_id AS query_id, chunk_id, 2 AS grade FROM judged WHERE o / (ge - gs + ce - cs - o) >= 0.2 GROUP BY ALL")
def resolve_iou(t: _T) -> DataFrame:
    return resolve.qrels(t.gold(), t.chunks(), "iou", 0.2)


@query("SELECT item_id AS query_id, chunk_id, 2 AS grade FROM judged WHERE cs <= gs AND ge <= ce GROUP BY ALL")
def resolve_containment(t: _T) -> DataFrame:
    return resolve.qrels(t.gold(), t.chunks(), "containment")


@query("""SELECT p.item_id, p.doc_id, "start", "end", round(coalesce(best, 0), 6) AS best, round(coalesce(least("end", hi1) - greatest("start", lo1), 0) / ("end" - "start"), 6) AS covered,
  CASE WHEN best >= 0.5 THEN 'found' WHEN best > 0 THEN 'split' WHEN lo IS NULL THEN 'no_document' WHEN "end" <= lo OR "start" >= hi THEN 'outside' ELSE 'inside' END AS status
FROM places p LEFT JOIN (SELECT item_id, doc_id, gs, ge, max(o / (ge - gs)) AS best, min(cs) AS lo1, max(ce) AS hi1 FROM judged GROUP BY item_id, doc_id, gs, ge) j ON j.item_id = p.item_id AND j.doc_id = p.doc_id AND j.gs = p."start" AND j.ge = p."end"
LEFT JOIN (SELECT doc_id, min("start") AS lo, max("end") AS hi FROM chunks GROUP BY doc_id) x ON x.doc_id = p.doc_id""")
def gold_report(t: _T) -> DataFrame:
    return resolve.gold_report(t.gold(), t.chunks())


_RETRIEVED = '(SELECT r.query_id || \'|\' || c.doc_id AS doc_id, c."start", c."end" FROM run r JOIN chunks c USING (chunk_id))'
_CTE["merged"] = "SELECT split_part(doc_id, '|', 1)::BIGINT AS item_id, split_part(doc_id, '|', 2)::BIGINT AS doc_id, \"start\", \"end\" FROM " + _ISLANDS.format("(SELECT item_id || '|' || doc_id AS doc_id, \"start\", \"end\" FROM places)")
_EVIDENCE = "(SELECT item_id || '|' || doc_id AS doc_id, \"start\", \"end\" FROM places)"


@query(f"""SELECT coalesce(g.item_id, r.item_id) AS item_id, round(coalesce(s.n / g.n, 0), 6) AS char_recall, round(coalesce(s.n / r.n, 0), 6) AS char_precision,
  round(coalesce(2 * (s.n / g.n) * (s.n / r.n) / (s.n / g.n + s.n / r.n), 0), 6) AS char_f1
FROM (SELECT split_part(doc_id, '|', 1)::BIGINT AS item_id, sum("end" - "start")::DOUBLE AS n FROM {_ISLANDS.format(_EVIDENCE)} GROUP BY 1) g
FULL JOIN (SELECT split_part(doc_id, '|', 1)::BIGINT AS item_id, sum("end" - "start")::DOUBLE AS n FROM {_ISLANDS.format(_RETRIEVED)} GROUP BY 1) r ON g.item_id = r.item_id
LEFT JOIN (SELECT split_part(a.doc_id, '|', 1)::BIGINT AS item_id, sum(least(a."end", b."end") - greatest(a."start", b."start"))::DOUBLE AS n
  FROM {_ISLANDS.format(_EVIDENCE)} a JOIN {_ISLANDS.format(_RETRIEVED)} b ON a.doc_id = b.doc_id AND a."start" < b."end" AND b."start" < a."end" GROUP BY 1) s ON s.item_id = coalesce(g.item_id, r.item_id)""")
def character_metrics(t: _T) -> DataFrame:
    got = t.run().join(t.chunks().drop("text"), "chunk_id").select(F.col("query_id").alias("item_id"), "doc_id", "start", "end")
    return resolve.character_metrics(t.gold(), got)


@query(f"SELECT split_part(doc_id, '|', 1)::BIGINT AS item_id, sum(\"end\" - \"start\")::BIGINT AS characters FROM {_ISLANDS.format(_RETRIEVED)} GROUP BY 1")
def retrieved_characters(t: _T) -> DataFrame:
    got = t.run().join(t.chunks().drop("text"), "chunk_id").select(F.col("query_id").alias("item_id"), "doc_id", "start", "end")
    return resolve.retrieved_characters(got)


@query(f"SELECT split_part(doc_id, '|', 1)::BIGINT AS item_id, sum(\"end\" - \"start\")::BIGINT AS gold_length, count(DISTINCT doc_id) AS documents FROM {_ISLANDS.format(_EVIDENCE)} GROUP BY 1")
def gold_extent(t: _T) -> DataFrame:
    return resolve.gold_extent(t.gold())


@query(f"""SELECT item_id, chunk_id, round(o / sum(n) OVER (PARTITION BY item_id), 6) AS covered FROM (
  SELECT g.item_id, g.chunk_id, g.o, 0 AS n FROM (SELECT i.item_id, c.chunk_id, sum(least(i."end", c."end") - greatest(i."start", c."start")) AS o FROM merged i JOIN chunks c ON c.doc_id = i.doc_id AND c."start" < i."end" AND i."start" < c."end" GROUP BY ALL) g
  UNION ALL SELECT item_id, NULL, NULL, sum("end" - "start") FROM merged GROUP BY item_id) QUALIFY chunk_id IS NOT NULL""")
def gold_coverage(t: _T) -> DataFrame:
    return resolve.gold_coverage(t.gold(), t.chunks())


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM places)")
def items_without_gold(t: _T) -> DataFrame:
    return resolve.items_without_gold(t.benchmark, t.gold()).select("item_id")


@query("""SELECT count(*) AS items, count(*) FILTER (d.text IS NULL) AS missing_document, count(*) FILTER (p."end" > length(d.text)) AS out_of_bounds, 0::BIGINT AS text_differs
FROM places p LEFT JOIN documents d USING (doc_id)""")
def self_check(t: _T) -> DataFrame:
    quotes = t.benchmark.select("item_id", F.col("text").alias("quote"))
    return resolve.self_check(t.places().join(quotes, "item_id"), t.docs())


# Embedders and indexes


@query("SELECT chunk_id, term, round(weight, 6) AS weight FROM cw")
def tfidf_weights(t: _T) -> DataFrame:
    chunks = t.chunks().select("chunk_id", "text")
    return embed.tfidf_rows(chunks, embed.tfidf_fit(chunks)).withColumn("weight", F.round("weight", 6))


@query()
def hash_vectors(t: _T) -> DataFrame:
    return embed.hash_vectors(t.chunks(), "chunk_id")


@query(r"SELECT chunk_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) AS length FROM chunks")
def length_embed(t: _T) -> DataFrame:
    return embed.lengths(t.chunks(), "chunk_id")


@query("SELECT query_id, chunk_id, score, rank::INT AS rank FROM run")
def bm25_topk(t: _T) -> DataFrame:
    return t.run()


@query("SELECT query_id, chunk_id, score, rank::INT AS rank FROM dn")
def tfidf_topk(t: _T) -> DataFrame:
    return t.dense()


def _dense_sql(score: str) -> str:
    return f"SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round({score}, 6) + 0.0 AS score FROM vecs a, vecs b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= {K}"


@query(_dense_sql("list_cosine_similarity(a.v, b.v)"))
def dense_cosine_topk(t: _T) -> DataFrame:
    return search.dense(t.embeddings, t.asked(), K)


@query(_dense_sql("list_dot_product(a.v, b.v)"))
def dense_dot_topk(t: _T) -> DataFrame:
    return search.dense(t.embeddings, t.asked(), K, "dot")


@query(_dense_sql("-list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"))
def dense_l2_topk(t: _T) -> DataFrame:
    return search.dense(t.embeddings, t.asked(), K, "l2")


_FUSED = "SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({0})) WHERE rank <= 10"


@query(_FUSED.format("SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM bm100 UNION ALL SELECT query_id, chunk_id, rank FROM dn) GROUP BY ALL"))
def hybrid_rrf(t: _T) -> DataFrame:
    return search.rrf([t.dense(), t.run(100)], K)


_SCALED = "(SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM {0} WINDOW w AS (PARTITION BY query_id))"


@query(_FUSED.format(f"SELECT query_id, chunk_id, round(0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score FROM {_SCALED.format('dn')} a FULL JOIN {_SCALED.format('bm100')} b USING (query_id, chunk_id)"))
def hybrid_weighted(t: _T) -> DataFrame:
    return search.weighted(t.dense(), t.run(100), K)


@query("""SELECT vec_id, list(least(255, greatest(0, round_even((x - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END / 255.0::DOUBLE), 0)))::INT ORDER BY dim)::VARCHAR AS codes
FROM (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM elems WINDOW w AS (PARTITION BY dim)) GROUP BY vec_id""")
def scalar_quantise(t: _T) -> DataFrame:
    coded = search.scalar_quantise(t.embeddings)
    return coded.select("vec_id", F.concat(F.lit("["), F.concat_ws(", ", F.col("codes").cast("array<string>")), F.lit("]")).alias("codes"))


@query("SELECT query_id, vec_id, score, rank::INT AS rank FROM near")
def binary_hamming_topk(t: _T) -> DataFrame:
    return search.binary_search(t.embeddings, t.asked(), K)


@query("""SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT f.query_id, f.vec_id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS score, row_number() OVER (PARTITION BY f.query_id ORDER BY round(list_dot_product(a.v, b.v), 6) + 0.0 DESC, f.vec_id) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM far QUALIFY r <= 50) f JOIN vecs a ON a.vec_id = f.query_id JOIN vecs b ON b.vec_id = f.vec_id) WHERE rank <= 10""")
def binary_rescore(t: _T) -> DataFrame:
    return search.binary_search(t.embeddings, t.asked(), K, 50)


@query("SELECT round(avg(r), 6) AS recall FROM (SELECT e.query_id, count(n.vec_id) / count(*) AS r FROM exact e LEFT JOIN near n USING (query_id, vec_id) GROUP BY e.query_id)")
def ann_recall(t: _T) -> DataFrame:
    return search.recall_against(search.binary_search(t.embeddings, t.asked(), K), search.dense(t.embeddings, t.asked(), K, "dot"))


@query()
def product_topk(t: _T) -> DataFrame:
    codebook = codecs.product_fit(t.embeddings, 8)
    return codecs.product_search(t.embeddings, t.asked(), codebook, K, codecs.product_depth(t.embeddings, t.asked(), codebook, K))


@query()
def ivf_topk(t: _T) -> DataFrame:
    return codecs.ivf_search(t.embeddings, t.asked(), K)


@query(f"SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS score FROM vecs a, decoded b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= {K}")
def scalar_topk(t: _T) -> DataFrame:
    return codecs.quantized_search(t.embeddings, t.asked(), "scalar", K)


@query("SELECT count(*) AS vectors, (count(*) * max(len(embedding)) * 4)::BIGINT AS exact_bytes, (count(*) * ceil(max(len(embedding)) / 8))::BIGINT AS coded_bytes, round(max(len(embedding)) * 4 / ceil(max(len(embedding)) / 8), 6) AS ratio FROM embeddings")
def compression_report(t: _T) -> DataFrame:
    return codecs.compression(t.embeddings, "binary")


@query("""SELECT query_id, min(chunk_id) FILTER (g AND n = 1) AS positive, string_agg(chunk_id, '|' ORDER BY rank) FILTER (NOT g AND n <= 3) AS negatives
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY rank) AS n FROM (SELECT r.query_id, r.chunk_id, r.rank, q.chunk_id IS NOT NULL AS g FROM run r LEFT JOIN qrels q USING (query_id, chunk_id)))
GROUP BY query_id HAVING count(*) FILTER (g) > 0 AND count(*) FILTER (NOT g) > 0""")
def mine_triplets(t: _T) -> DataFrame:
    return codecs.mine_triplets(t.qrels(), t.run()).withColumn("negatives", F.array_join("negatives", "|"))


@query()
def embedding_quality(t: _T) -> DataFrame:
    return search.embedding_quality(t.embeddings)


@query("SELECT label, vec_id, round(list_cosine_similarity(v, w), 6) AS cosine FROM (SELECT label, vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings) WHERE w IS NOT NULL")
def adjacent_cosine(t: _T) -> DataFrame:
    return search.adjacent_cosine(t.embeddings, "label", "vec_id")


# Ingestion


@query('SELECT doc_id, parent, min("start")::INT AS "start", max("end")::INT AS "end", count(*)::INT AS children FROM groups GROUP BY doc_id, parent')
def parent_document(t: _T) -> DataFrame:
    return ch.parent_document(t.chunks())


@query('SELECT chunk_id, (min("start") OVER w)::INT AS "start", (max("end") OVER w)::INT AS "end" FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')
def sentence_window(t: _T) -> DataFrame:
    return ch.sentence_window(t.chunks())


@query("""SELECT query_id, parent_id AS chunk_id, score FROM (SELECT query_id, parent_id, max(score) AS score, count(*) AS n FROM run JOIN pmap USING (chunk_id) GROUP BY ALL) h JOIN (SELECT parent_id, count(*) AS size FROM pmap GROUP BY ALL) s USING (parent_id) WHERE n >= size * 0.5
UNION ALL SELECT query_id, chunk_id, score FROM (SELECT *, count(*) OVER (PARTITION BY query_id, parent_id) AS n FROM run JOIN pmap USING (chunk_id)) h JOIN (SELECT parent_id, count(*) AS size FROM pmap GROUP BY ALL) s USING (parent_id) WHERE n < size * 0.5""")
def hierarchical_merge(t: _T) -> DataFrame:
    return ch.hierarchical(t.run(), ch.parent_map(t.chunks()))


# Queries and rerankers


def _expand_sql() -> str:
    text = "text"
    for short, long in ACRONYMS.items():
        text = f"regexp_replace({text}, '(?i)\\b({short})\\b', '\\1 {long}', 'g')"
    return f"SELECT item_id AS query_id, {text} AS text FROM benchmark"


@query(_expand_sql())
def expand_acronyms(t: _T) -> DataFrame:
    return t.questions().withColumn("text", qs.expand(F.col("text"), ACRONYMS))


_STOP = "[" + ", ".join(f"'{w}'" for w in qs.STOPWORDS) + "]"


@query(rf"""SELECT query_id, (part - 1)::INT AS part, text FROM (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY n) AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, sig ORDER BY n) AS again FROM (
    SELECT query_id, n, text, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: NOT list_contains({_STOP}, w)))) AS sig FROM (
      SELECT query_id, unnest(range(0, len(l))) AS n, trim(unnest(l)) AS text FROM (SELECT item_id AS query_id, list_prepend(text, string_split_regex(text, '(?i)\s*(?:[;?]|,?\s+(?:and|or|also)\b)\s*')) AS l FROM benchmark)))
  WHERE n = 0 OR len(sig) >= 2) WHERE again = 1) WHERE part <= 4""")
def decomposed_parts(t: _T) -> DataFrame:
    return qs.decompose(t.questions())


@query("""SELECT query_id, pos::INT AS pos, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY n, term) AS pos FROM
  (SELECT r.query_id, c.term, count(*) AS n FROM (SELECT * FROM run WHERE rank = 1) r JOIN cterms c USING (chunk_id) LEFT JOIN asked a ON a.query_id = r.query_id AND a.term = c.term WHERE a.term IS NULL GROUP BY ALL)) WHERE pos <= 5""")
def feedback_terms(t: _T) -> DataFrame:
    return qs.feedback_terms(t.run(), t.chunks(), t.questions())


@query()
def relevance_feedback(t: _T) -> DataFrame:
    chunks = t.chunks()
    return qs.relevance_feedback(lambda q, k: search.bm25(chunks.select("chunk_id", "text"), q, k), chunks, t.questions(), K)


@query()
def decomposed_search(t: _T) -> DataFrame:
    chunks = t.chunks().select("chunk_id", "text")
    return qs.fuse_parts(lambda q, k: search.bm25(chunks, q, k), qs.decompose(t.questions()), K)


@query("""SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT r.query_id, r.chunk_id, round(count(DISTINCT c.term) FILTER (a.term IS NOT NULL) / max(q.n) + 0.1 * count(a.term) / pow(count(c.term), 0.25), 6) AS score
  FROM bm50 r JOIN cterms c USING (chunk_id) LEFT JOIN asked a ON a.query_id = r.query_id AND a.term = c.term JOIN (SELECT query_id, count(*) AS n FROM asked GROUP BY ALL) q ON q.query_id = r.query_id GROUP BY ALL)) WHERE rank <= 10""")
def lexical_rerank(t: _T) -> DataFrame:
    return qs.lexical_rerank(t.run(50), t.chunks(), t.questions(), K)


@query()
def mmr_rerank(t: _T) -> DataFrame:
    return qs.mmr_rerank(t.run(50), t.chunks(), K)


# Scores


@query("SELECT * FROM per")
def metrics_per_query(t: _T) -> DataFrame:
    return metrics.per_query(t.qrels(), t.run(20))


@query("SELECT metric, k, round(avg(v), 6) AS value FROM (UNPIVOT (SELECT * FROM per) ON recall, precision, hit_rate, mrr, map, ndcg INTO NAME metric VALUE v) GROUP BY ALL")
def retrieval_metrics(t: _T) -> DataFrame:
    """Documents to chunks, BM25, relevance by span overlap, and all six metrics."""
    return metrics.evaluate(t.qrels(), t.run(20))


_CTE["firsts"] = "SELECT q.query_id, min(h.rank) AS first FROM (SELECT DISTINCT query_id FROM rel) q LEFT JOIN hits h USING (query_id) GROUP BY ALL"


@query("SELECT round(avg(first), 6) AS mean_rank, count(*) FILTER (first IS NULL) AS misses FROM firsts")
def first_relevant(t: _T) -> DataFrame:
    return metrics.first_relevant(t.qrels(), t.run(100))


@query("SELECT coalesce(y.qtype, 'unlabelled') AS qtype, count(*) AS n, round(avg(p.recall), 6) AS value FROM per p LEFT JOIN typed y USING (query_id) WHERE p.k = 5 GROUP BY ALL")
def slice_by_type(t: _T) -> DataFrame:
    return metrics.slice_by(metrics.per_query(t.qrels(), t.run()), t.questions().select("query_id", qs.classify(F.col("text")).alias("qtype")), "recall", 5)


_CTE["diag"] = """SELECT b.item_id AS query_id, CASE WHEN n IS NULL THEN 'fp1_missing_content' WHEN first IS NULL THEN 'fp3_not_retrieved' WHEN first > 5 THEN 'fp2_missed_top_ranked' WHEN inside < n THEN 'fp7_incomplete' ELSE 'none' END AS failure
FROM benchmark b LEFT JOIN (SELECT r.query_id, count(*) AS n, min(x.rank) AS first, count(*) FILTER (x.rank <= 5) AS inside FROM rel r LEFT JOIN bm100 x USING (query_id, chunk_id) GROUP BY ALL) e ON e.query_id = b.item_id"""


@query("SELECT * FROM diag")
def diagnose(t: _T) -> DataFrame:
    return metrics.diagnose(t.questions(), t.qrels(), t.run(100))


@query("SELECT failure, count(*) AS n, list(query_id ORDER BY query_id)::VARCHAR AS query_ids FROM diag GROUP BY failure")
def failure_clusters(t: _T) -> DataFrame:
    found = metrics.cluster(metrics.diagnose(t.questions(), t.qrels(), t.run(100)))
    return found.select("failure", "n", F.concat(F.lit("["), F.concat_ws(", ", F.col("query_ids").cast("array<string>")), F.lit("]")).alias("query_ids"))


_CTE["reach"] = "SELECT q.query_id, round(coalesce(1.0::DOUBLE / a.first, 0), 6) AS a, round(coalesce(1.0::DOUBLE / b.first, 0), 6) AS b FROM (SELECT DISTINCT query_id FROM rel) q LEFT JOIN (SELECT query_id, min(rank) AS first FROM run JOIN rel USING (query_id, chunk_id) GROUP BY ALL) a USING (query_id) LEFT JOIN (SELECT query_id, min(rank) AS first FROM low JOIN rel USING (query_id, chunk_id) GROUP BY ALL) b USING (query_id)"


@query("SELECT count(*) AS n, count(*) FILTER (a - b > 1e-9) AS wins, count(*) FILTER (a - b < -1e-9) AS losses, count(*) FILTER (abs(a - b) <= 1e-9) AS ties, round(avg(a - b), 6) AS mean_difference FROM reach")
def compare_runs(t: _T) -> DataFrame:
    return metrics.compare(*t.both_runs(), "mrr", 10)


@query("SELECT query_id, a AS left, b AS right, round(a - b, 6) AS difference FROM reach WHERE abs(a - b) > 1e-9")
def run_disagreement(t: _T) -> DataFrame:
    return metrics.disagreement(*t.both_runs(), "mrr", 10)


@query()
def significance(t: _T) -> DataFrame:
    return metrics.significance(*t.both_runs(), "mrr", 10)


@query("""SELECT e.* FROM (SELECT user_id, round(avg(value), 6) AS quality, count(*) AS cost FROM events GROUP BY user_id) e
WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, round(avg(value), 6) AS quality, count(*) AS cost FROM events GROUP BY user_id) o WHERE o.cost <= e.cost AND o.quality >= e.quality AND (o.cost < e.cost OR o.quality > e.quality))
QUALIFY row_number() OVER (PARTITION BY e.cost, e.quality ORDER BY e.user_id) = 1""")
def pareto(t: _T) -> DataFrame:
    return metrics.pareto(t.events.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("quality"), F.count("*").alias("cost")), "quality", "cost", "user_id")


@query("SELECT event_type AS value, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def axis_effect(t: _T) -> DataFrame:
    return metrics.axis_effect(t.events, "event_type", "value")


@query("SELECT source, quality, safe, CASE WHEN quality = 0 OR safe = 0 THEN 0 ELSE round(200.0::DOUBLE / (1.0::DOUBLE / quality + 1.0::DOUBLE / safe), 6) END AS composite FROM (SELECT source, round(avg(quality), 6) AS quality, round(avg(1 - toxic), 6) AS safe FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def composite(t: _T) -> DataFrame:
    by = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg(1 - F.col("toxic")), 6).alias("safe"))
    return metrics.composite(by, ["quality", "safe"])


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = least(floor(0.95 * n), n - 1) + 1")
def latency_percentile(t: _T) -> DataFrame:
    return metrics.latency_percentile(t.events, "value", 0.95, "event_type")


@query("""SELECT role AS model, input_tokens, output_tokens, round((input_tokens * p.a + output_tokens * p.b) / 1e6, 9) AS usd
FROM (SELECT role, sum(length(text))::BIGINT AS input_tokens, count(*) AS output_tokens FROM conversations GROUP BY role) LEFT JOIN (VALUES ('user', 0.5::DOUBLE, 1.5::DOUBLE), ('assistant', 3.0::DOUBLE, 15.0::DOUBLE)) p(m, a, b) ON p.m = role""")
def cost_estimate(t: _T) -> DataFrame:
    use = t.conversations.groupBy(F.col("role").alias("model")).agg(F.sum(F.length("text")).alias("input_tokens"), F.count("*").alias("output_tokens"))
    return metrics.cost(use, t.spark.createDataFrame([("user", 0.5, 1.5), ("assistant", 3.0, 15.0)], "model string, input_price double, output_price double"))


# Evaluation sets, grids and answers


@query("SELECT * FROM typed")
def classify_questions(t: _T) -> DataFrame:
    return t.questions().select("query_id", qs.classify(F.col("text")).alias("qtype"))


@query(r"SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) < 4 AS short FROM conversations")
def filter_short(t: _T) -> DataFrame:
    return t.conversations.select("conv_id", "turn", qs.too_short(F.col("text")).alias("short"))


@query()
def filter_chain(t: _T) -> DataFrame:
    return qs.filter_chain(t.benchmark)


@query("SELECT role, ceil(round(2.8::DOUBLE * sqrt(0.5::DOUBLE / count(*)), 9) * 100) / 100 AS detectable FROM conversations GROUP BY role")
def minimum_detectable(t: _T) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count("*").alias("n")).select("role", qs.minimum_detectable(F.col("n")).cast("double").alias("detectable"))


@query(r"""WITH_PARTS SELECT chunk_id, string_agg(word, ' ' ORDER BY nth) AS question, any_value(quote) AS quote FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY df, word) AS nth FROM (
    SELECT DISTINCT chunk_id, quote, word FROM (SELECT chunk_id, quote, unnest(regexp_extract_all(lower(quote), '[\p{L}\p{N}_]+')) AS word FROM longest)) JOIN (SELECT term AS word, df FROM dfs) USING (word) WHERE length(word) > 3)
WHERE nth <= 6 GROUP BY chunk_id HAVING count(*) >= 2""".replace("WITH_PARTS ", ""))
def keyword_probes(t: _T) -> DataFrame:
    return qs.keyword_probes(t.chunks())


@query("SELECT doc_id, nth::INT AS nth, chunk_id FROM (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY md5('0:' || chunk_id), chunk_id) AS nth FROM chunks) ORDER BY nth, doc_id LIMIT 100")
def spread_sample(t: _T) -> DataFrame:
    return qs.spread_sample(t.chunks(), 100).select("doc_id", "nth", "chunk_id")


@query("SELECT c.chunker, i.index, e.embedder, r.reranker, n.candidates FROM (VALUES ('fixed:256'), ('recursive:512')) c(chunker), (VALUES ('bm25'), ('dense'), ('hybrid')) i(index), (VALUES (NULL), ('tfidf')) e(embedder), (VALUES ('none'), ('lexical')) r(reranker), (VALUES (50), (100)) n(candidates)")
def matrix_factorial(t: _T) -> DataFrame:
    return grid.Matrix(GRID).frame(t.spark).select(*GRID)


@query("""SELECT chunker, index, embedder, reranker, candidates, count(*) AS stands_for FROM (SELECT chunker, index, CASE WHEN index <> 'bm25' THEN embedder END AS embedder, CASE WHEN reranker <> 'none' THEN reranker END AS reranker, CASE WHEN reranker = 'none' THEN 50 ELSE candidates END AS candidates
FROM (VALUES ('fixed:256'), ('recursive:512')) c(chunker), (VALUES ('bm25'), ('dense'), ('hybrid')) i(index), (VALUES (NULL), ('tfidf')) e(embedder), (VALUES ('none'), ('lexical')) r(reranker), (VALUES (50), (100)) n(candidates) WHERE index = 'bm25' OR embedder IS NOT NULL) GROUP BY ALL""")
def matrix_dedupe(t: _T) -> DataFrame:
    return grid.canonical_frame(grid.Matrix(GRID).frame(t.spark)).select(*GRID, "stands_for")


@query()
def assemble_context(t: _T) -> DataFrame:
    return qs.assemble(t.run(), t.chunks(), 1500, "ends")


@query()
def extractive_answer(t: _T) -> DataFrame:
    return qs.extractive(t.run(), t.chunks())


_BAG = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_SHARE = "CASE WHEN len({0}) > 0 THEN round(len(list_intersect({0}, {1})) / len({0}), 6) ELSE 0 END"


_CTE["answered"] = f"""SELECT query_id, {_SHARE.format("a", "c")} AS groundedness, {_SHARE.format("g", "a")} AS evidence_overlap,
  CASE WHEN len(cited) > 0 THEN round(len(list_filter(cited, lambda x: x::INT BETWEEN 1 AND passages)) / len(cited), 6) END AS citation_accuracy, NOT regexp_matches(answer, '(?i)(i (do not|don''t) know|cannot (answer|be answered)|not (in|enough) (the )?(context|information))') AS abstention_correct
FROM (SELECT conv_id AS query_id, answer, regexp_extract_all(answer, '\\[(\\d+)\\]', 1) AS cited, passages, {_BAG.format(r"regexp_replace(answer, '\[\d+\]', ' ', 'g')")} AS a, {_BAG.format("context")} AS c, {_BAG.format("gold")} AS g
  FROM (SELECT conv_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id) JOIN (SELECT conv_id, count(*) AS passages, string_agg(text, ' ' ORDER BY turn) AS context, arg_min(text, turn) AS gold FROM conversations WHERE role = 'user' GROUP BY conv_id) USING (conv_id))"""


@query("SELECT * FROM answered")
def answer_scores(t: _T) -> DataFrame:
    return qs.score_answers(t.spoken())


@query("SELECT metric, round(avg(v), 6) AS value, count(*) AS n FROM (UNPIVOT (SELECT groundedness::DOUBLE AS groundedness, evidence_overlap::DOUBLE AS evidence_overlap, citation_accuracy::DOUBLE AS citation_accuracy, abstention_correct::DOUBLE AS abstention_correct FROM answered) ON groundedness, evidence_overlap, citation_accuracy, abstention_correct INTO NAME metric VALUE v) GROUP BY metric")
def answer_report(t: _T) -> DataFrame:
    return qs.answer_report(qs.score_answers(t.spoken()))


@query("SELECT qtype, count(*) AS n FROM typed GROUP BY qtype")
def type_distribution(t: _T) -> DataFrame:
    return qs.type_distribution(t.questions().select("query_id", qs.classify(F.col("text")).alias("qtype")))


@query(r"SELECT round(avg(len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> ''))), 6) AS tokens FROM benchmark")
def mean_query_tokens(t: _T) -> DataFrame:
    return t.spark.createDataFrame([(round(cost.mean_query_tokens(t.questions()), 6),)], "tokens double")


@query(rf"""SELECT conv_id, turn, regexp_matches(text, '{qs.DANGLING}') AND NOT (regexp_matches(head, '(?i)\b(these|this|an?|the)\s+\w') OR regexp_matches(regexp_replace(head, '^\s*\S+\s*', ''), '\b[A-Z][a-z]{{1,}}\b')) AS dangling
FROM (SELECT conv_id, turn, text, regexp_extract(text, '(?is)^(.*?){qs.DANGLING[4:]}', 1) AS head FROM conversations)""")
def dangling_reference(t: _T) -> DataFrame:
    return t.conversations.select("conv_id", "turn", qs.dangling(F.col("text")).alias("dangling"))


@query("SELECT g.index, v.metric, v.k, round(v.value, 6) AS value FROM (SELECT 'bm25' AS index UNION ALL SELECT 'dense') g JOIN (SELECT 'bm25' AS index, metric, k, avg(x) AS value FROM (UNPIVOT (SELECT * FROM per) ON recall, precision, hit_rate, mrr, map, ndcg INTO NAME metric VALUE x) WHERE k <= 10 GROUP BY ALL UNION ALL SELECT 'dense', metric, k, avg(x) FROM (UNPIVOT (SELECT * FROM dper) ON recall, precision, hit_rate, mrr, map, ndcg INTO NAME metric VALUE x) WHERE k <= 10 GROUP BY ALL) v USING (index)")
def grid_results(t: _T) -> DataFrame:
    """Two configurations run by the grid: the chunks of the other queries, by BM25 and by TF-IDF."""
    runner = grid.Runner(t.docs(), t.questions(), t.gold(), cache=_Plain())
    parts = []
    for c in (grid.Config(chunker=f"fixed:{SIZE},overlap={OVERLAP},tokenizer=character"), grid.Config(chunker=f"fixed:{SIZE},overlap={OVERLAP},tokenizer=character", index="dense", embedder="tfidf")):
        found = metrics.evaluate(runner.qrels(c), runner.search(c), (1, 3, 5, 10))
        parts.append(found.select(F.lit(c.index).alias("index"), "metric", "k", "value"))
    return parts[0].unionByName(parts[1])


@query("SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, parent_id AS chunk_id, max(score) AS score FROM bm40 JOIN pmap4 USING (chunk_id) GROUP BY ALL)) WHERE rank <= 10")
def parent_document_search(t: _T) -> DataFrame:
    """Chunks are searched, the passages of their groups come back: four times as many hits, the best of each passage."""
    made = ingest.ingest("parent-document", t.docs(), t.chunks())
    hits = search.bm25(made.indexed.select(F.col("indexed_id").alias("chunk_id"), "text"), t.questions(), 4 * K)
    return made.returned(hits, K)


ORACLES: dict[str, str] = {name: _with(sql) for name, sql in _SQL.items()}
