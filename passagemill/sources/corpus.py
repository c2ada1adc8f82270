"""Corpora: files, tables and fingerprints."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

PATTERNS = tuple(f"*.{suffix}" for suffix in "docx htm html markdown md pdf pptx text txt xlsx".split())
TOOL_DIRS = ("node_modules", "__pycache__", "venv", "dist", "build", "target", "site-packages")
MEDIA = {"txt": "text", "text": "text", "log": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx"}


def media_type(path: Column) -> Column:
    """By suffix; unknown for any other."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[suffix], F.lit("unknown"))


def is_candidate(relative: Column) -> Column:
    """Neither the file nor a folder on its way is hidden, nor is a folder a tool's own."""
    return ~relative.rlike(r"(^|/)\.") & ~relative.rlike(rf"(^|/)({'|'.join(TOOL_DIRS)})/")


def from_dir(spark: SparkSession, path: str, patterns: tuple[str, ...] = PATTERNS, recursive: bool = True, max_files: int | None = None) -> DataFrame:
    """(id, media_type, path, content): the files of a folder that match a pattern; ids are paths below it. max_files
    keeps the first by id."""
    glob = "{" + ",".join(patterns) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(path)
    root = "file:" + path.rstrip("/") if path.startswith("/") else path.rstrip("/")
    relative = F.regexp_replace(F.expr("substring(path, length('{}') + 2)".format(root.replace("'", ""))), "^/+", "")
    found = files.select(relative.alias("id"), "path", "content").where(is_candidate(F.col("id"))).select("id", media_type(F.col("id")).alias("media_type"), "path", "content")
    return found.orderBy("id").limit(max_files) if max_files is not None else found


def from_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("id"), media_type(F.col("path")).alias("media_type"), "path", "content")


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, "text", v) for k, v in sorted(texts.items())], "id string, media_type string, text string")


def of_type(corpus: DataFrame, *types: str) -> DataFrame:
    return corpus.where(F.col("media_type").isin(*types))


def get(corpus: DataFrame, id_: str) -> Row | None:
    """The file of an id, or None."""
    return corpus.where(F.col("id") == id_).first()


def require(corpus: DataFrame, id_: str) -> Row:
    found = get(corpus, id_)
    if found is None:
        near = difflib.get_close_matches(id_, [r["id"] for r in corpus.select("id").limit(1000).collect()], 3)
        raise KeyError(f"the corpus has no {id_!r}" + (f"; near: {', '.join(near)}" if near else ""))
    return found


def media_types(corpus: DataFrame) -> DataFrame:
    """(media_type, n)."""
    return corpus.groupBy("media_type").agg(F.count("*").alias("n"))


def block_ratios(blocks: DataFrame) -> DataFrame:
    """(kind, n, ratio) of blocks(kind, start, end): the share of the blocks' characters that each kind has."""
    by = blocks.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))
    total = by.agg(F.sum("chars").alias("all"))
    return by.join(F.broadcast(total)).select("kind", "n", F.round(F.col("chars") / F.col("all"), 6).alias("ratio"))


def texts_of(files: DataFrame) -> DataFrame:
    """(id, text, decoded): UTF-8 files without a byte order mark; what is not UTF-8 is empty and not decoded."""
    ok = F.expr("is_valid_utf8(cast(content as string))")
    text = F.regexp_replace(F.col("content").cast("string"), "^\\x{FEFF}", "")
    return files.select("id", F.when(ok, text).otherwise(F.lit("")).alias("text"), ok.alias("decoded"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(digest, copies, first_id) of texts that several documents have. Digests shuffle, texts do not."""
    return docs.where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(documents, empty, chars, median_chars, longest, duplicates): one pass and the count of copies."""
    n = F.length("text")
    base = docs.agg(F.count("*").alias("documents"), F.count_if(F.trim("text") == "").alias("empty"), F.sum(n).alias("chars"), F.median(n).alias("median_chars"), F.max(n).alias("longest"))
    extra = duplicate_groups(docs).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))
    return base.crossJoin(extra)


def hints(stats: DataFrame) -> DataFrame:
    """(hint) of what the shape of a corpus asks for; stats(table_ratio, code_ratio, median_chars)."""
    rules = ((F.col("table_ratio") >= 0.15, "keep tables whole: structural"), (F.col("code_ratio") >= 0.2, "cut code at its blocks"), (F.col("median_chars") < 2000, "short documents: chunk size hardly matters"), (F.col("median_chars") > 50_000, "long documents: use headings or a hierarchy"))
    return stats.select(F.explode(F.filter(F.array(*[F.when(c, h) for c, h in rules]), lambda x: x.isNotNull())).alias("hint"))


def content_hash(docs: DataFrame) -> DataFrame:
    """(content_hash): SHA-256 over the sorted digests of all texts, in a tree of two levels of 4096 branches each, so that no
    row holds them all; a text that is there several times is in it once, with how often."""
    each = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("d")).agg(F.count("*").alias("n")).select(F.concat_ws(":", "d", "n").alias("h"), F.substring("d", 1, 6).alias("g"))
    for width in (3, 0):
        each = each.groupBy("g").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("h")).select("h", F.substring("g", 1, width).alias("g"))
    return each.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("content_hash"))
