"""Evaluation sets: readers and writers."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

GOLD = "array<struct<doc_id:string,start:int,end:int,grade:int>>"
ANCHORS = "array<struct<source_id:string,quote:string,grade:int,page_hint:int,occurrence:int>>"
ITEM = f"id string, question string, gold {GOLD}, anchors {ANCHORS}, qtype string, answer string, meta map<string,string>"
ALIASES = {"id": ("id", "item_id"), "question": ("question", "query"), "source_id": ("source_id", "source", "document"), "quote": ("quote", "evidence"), "grade": ("grade",), "page": ("page", "page_hint"), "occurrence": ("occurrence",), "qtype": ("qtype", "type"), "answer": ("answer",), "meta": ("meta",)}


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Items, a line each; a header line is left out, and lines that are no item are in column _bad, with their numbers in _line."""
    raw = _numbered(spark.read.text(path), "_line").where("trim(value) <> ''")
    parsed = raw.select(F.from_json("value", ITEM + ", _evalset string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"), "_line").select("x.*", "_line")
    return parsed.where("_evalset is null").drop("_evalset")


def read_header(spark: SparkSession, path: str) -> dict | None:
    """The header of JSON lines: what the set is called, its version and source; None without one."""
    row = spark.read.text(path).select(F.get_json_object("value", "$._evalset").alias("h")).where("h is not null").first()
    return json.loads(row["h"]) if row else None


def _numbered(table: DataFrame, name: str) -> DataFrame:
    """Rows with their numbers in their file, from 1. An evaluation set is as large as people make it: a file is one task's."""
    at = table.withColumns({"file__": F.input_file_name(), "at__": F.monotonically_increasing_id()})
    return at.withColumn(name, F.row_number().over(W.partitionBy("file__").orderBy("at__"))).drop("file__", "at__")


def write_jsonl(items: DataFrame, path: str, header: Mapping | None = None) -> None:
    """Items, a line each, after a line with the header if there is one; then one file holds them all."""
    items = items.drop("_bad", "_line")
    rows = items.select(F.to_json(F.struct(*items.columns)).alias("value"))
    if header is not None:
        first = items.sparkSession.createDataFrame([(json.dumps({"_evalset": dict(header)}),)], "value string").coalesce(1)
        rows = first.unionByName(rows).coalesce(1)
    rows.write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One anchor a row; headers may go by other names, blank questions are left out, ids default to q1, q2, ... within a file."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip().lower() for c in raw.columns])

    def col(name: str) -> Column:
        have = [F.col(a) for a in ALIASES[name] if a in raw.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    rows = _numbered(raw.select(*[col(n).alias(n) for n in ALIASES]).where("trim(question) <> ''"), "n__")
    anchor = F.struct(F.col("source_id"), F.col("quote"), F.coalesce(F.col("grade").cast("int"), F.lit(2)).alias("grade"), F.col("page").cast("int").alias("page_hint"), F.coalesce(F.col("occurrence").cast("int"), F.lit(0)).alias("occurrence"))
    anchors = F.when(F.col("quote").isNotNull() & F.col("source_id").isNotNull(), F.array(anchor)).otherwise(F.array().cast(ANCHORS))
    return rows.select(F.coalesce("id", F.concat(F.lit("q"), F.col("n__"))).alias("id"), "question", F.array().cast(GOLD).alias("gold"), anchors.alias("anchors"), "qtype", "answer", F.from_json("meta", "map<string,string>").alias("meta"))


def write_csv(items: DataFrame, path: str) -> int:
    """The first anchor of each item only; how many items lose anchors or spans by that, with a warning if any do."""
    lost = items.where("coalesce(size(anchors), 0) > 1 or coalesce(size(gold), 0) > 0").count()
    if lost:
        warnings.warn(f"{lost} items have more evidence than a CSV row holds; JSON lines keep it", stacklevel=2)
    a = F.get("anchors", F.lit(0))
    items.select("id", "question", a["source_id"].alias("source_id"), a["quote"].alias("quote"), a["grade"].alias("grade"), a["page_hint"].alias("page"), a["occurrence"].alias("occurrence"), "qtype", "answer", F.to_json("meta").alias("meta")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return lost


def read_evalset(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv, or JSON lines."""
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_jsonl(spark, path)


def read_beir(spark: SparkSession, queries: str, judgements: str) -> DataFrame:
    """(id, question, doc_ids): queries as JSON lines with the documents judged above 0, of a tab-separated table."""
    q = spark.read.schema("_id string, text string").json(queries)
    j = spark.read.option("sep", "\t").option("header", True).csv(judgements)
    j = j.toDF("query", "doc", "score").where(F.col("score").cast("int") > 0)
    return q.join(j, q["_id"] == j["query"]).groupBy(F.col("_id").alias("id"), F.col("text").alias("question")).agg(F.sort_array(F.collect_set("doc")).alias("doc_ids"))


def read_legalbench(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gold spans (id, question, doc_id, start, end) of nested tests and snippets, and snippets skipped by reason."""
    raw = spark.read.option("multiLine", True).schema("tests array<struct<id:string,query:string,answer:string,snippets:array<struct<file_path:string,span:array<int>>>>>").json(path)
    t = raw.select(F.posexplode("tests").alias("n", "t")).select(F.coalesce("t.id", F.concat(F.lit("q"), F.col("n") + 1)).alias("id"), F.col("t.query").alias("question"), F.explode_outer("t.snippets").alias("s"))
    s = t.select("id", "question", F.col("s.file_path").alias("doc_id"), F.get("s.span", F.lit(0)).alias("start"), F.get("s.span", F.lit(1)).alias("end"))
    reason = F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "no question").when(F.col("doc_id").isNull(), "no file").when(F.col("start").isNull() | F.col("end").isNull(), "no span").when(F.col("end") <= F.col("start"), "empty span")
    marked = s.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").count()


def load_benchmark(items: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """The documents that some gold span of items(id, doc_id, ...) names; limit: of the first so many items by id."""
    if limit is not None:
        items = items.join(items.select("id").distinct().orderBy("id").limit(limit), "id", "left_semi")
    return docs.join(items.select("doc_id").distinct(), "doc_id", "left_semi")


def subsets(items: DataFrame) -> DataFrame:
    """Items with answerable (any gold or anchor), resolved (any gold) and portable (any anchor)."""
    g, a = F.coalesce(F.size("gold"), F.lit(0)) > 0, F.coalesce(F.size("anchors"), F.lit(0)) > 0
    return items.withColumns({"answerable": g | a, "resolved": g, "portable": a})
