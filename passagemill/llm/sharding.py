"""Sharding by extendible hashing.

The directory starts with one bucket. A bucket whose rows hold more bytes than a shard may is split on the next
bit of the hash, and only such a bucket, until every one fits. A shard is thus a hash prefix; its local depth
is the prefix's length, and a row's shard is the shortest prefix of its hash whose bucket fits.

The directory comes from byte sums by hash prefix, ``step`` bits at a time: one aggregation finds all splits of
the next ``step`` levels, and only rows of buckets that are still too large take part in the one after.
Texts are read for their length, and move once, when the shards are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut, free_names, named, pick, sized

SHARD_BYTES = 16 << 20
STEP, MAX_DEPTH = 12, 60
#: Shards of a partition of the result, on average, whatever spark.sql.shuffle.partitions says.
SHARDS_A_PARTITION = 1


def hash_bits(key: Column) -> Column:
    """60 bits of the MD5 of the key's text, as a number; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _at(hash_: Column, depth: int) -> Column:
    return F.shiftright(hash_, MAX_DEPTH - depth)


def directory(rows: DataFrame, shard_bytes: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """rows(hash, size), materialised -> the shards (depth, prefix, bytes). A shard exceeds shard_bytes only at
    depth 60, where all its rows have one hash."""
    shards, open_rows, depth = None, rows, 0
    while True:
        fine = min(step, MAX_DEPTH - depth)
        low = open_rows.groupBy(_at(F.col("hash"), depth + fine).alias("low")).agg(F.sum("size").alias("bytes"))
        spread = low.select("low", "bytes", F.explode(F.sequence(F.lit(0), F.lit(fine))).alias("up"))
        sums = cut(spread.groupBy((F.col("up") + depth).alias("depth"), F.expr(f"shiftright(low, {fine} - up)").alias("prefix")).agg(F.sum("bytes").alias("bytes")))
        over = sums.where(F.col("bytes") > shard_bytes)
        split = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = sums.where(F.col("bytes") <= shard_bytes)
        found = fits.withColumn("parent", F.shiftright("prefix", 1)).join(split, ["depth", "parent"], "left_semi").drop("parent").unionByName(fits.where("depth = 0"))
        depth += fine
        last = over.where(F.col("depth") == depth)
        if depth == MAX_DEPTH:
            found = found.unionByName(last)
        shards = found if shards is None else shards.unionByName(found)
        still = cut(last.select("prefix"))
        if depth == MAX_DEPTH or still.isEmpty():
            return cut(shards)
        open_rows = cut(open_rows.join(sized(still), _at(F.col("hash"), depth) == F.col("prefix"), "left_semi"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """The rows of docs with shard (the hash prefix in bits, empty for the only shard) and shard_bytes, laid
    out so that the rows of a shard are next to each other in one partition.

    A row's size is the bytes of its text in UTF-8, 0 if null. Rows with one key always share a shard, which may
    then exceed the limit, as may a row that alone does: at depth 60. A null key counts as the empty text.
    Clashing input columns are renamed as in free_names(). An empty table gives an empty table.
    """
    picked = pick(docs, id=id_col, text=text_col)
    sizes = picked.select(hash_bits(F.col("id")).alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    shards = directory(cut(sizes.groupBy("hash").agg(F.sum("size").alias("size"))), shard_bytes, step)
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect())  # 61 at most
    docs = free_names(docs, "shard", "shard_bytes", "hash__", "prefix__")
    names = docs.columns
    placed = docs.withColumn("hash__", hash_bits(docs[named(docs, id_col)]))
    bits, size = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for d in depths:  # one lookup a depth in use, without moving a text if the directory is small
        level = shards.where(F.col("depth") == d).select(F.col("prefix").alias(f"prefix{d}__"), F.col("bytes").alias(f"bytes{d}__"))
        placed = placed.join(sized(level), _at(F.col("hash__"), d) == F.col(f"prefix{d}__"), "left")
        own = F.lpad(F.bin(F.col(f"prefix{d}__")), d, "0") if d else F.when(F.col("prefix0__").isNotNull(), F.lit(""))
        bits, size = F.coalesce(bits, own), F.coalesce(size, F.col(f"bytes{d}__"))
    placed = placed.select(*names, bits.alias("shard"), size.alias("shard_bytes"))
    return placed.repartition(max(1, -(-shards.count() // SHARDS_A_PARTITION)), "shard").sortWithinPartitions("shard")


ORACLE_SQL = f"""
WITH h AS (
  SELECT d.*, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS hash,
         coalesce(strlen(text), 0) AS size FROM documents d),
sums AS (
  SELECT depth, hash >> (60 - depth) AS prefix, sum(size)::BIGINT AS bytes
  FROM h, (SELECT unnest(range(0, 61))::INTEGER AS depth) GROUP BY ALL),
found AS (
  SELECT h.doc_id, min(s.depth) AS depth FROM h JOIN sums s ON h.hash >> (60 - s.depth) = s.prefix
  WHERE s.bytes <= {{limit}} OR s.depth = 60 GROUP BY ALL)
SELECT h.doc_id, h.text, h.lang, h.source, h.n_chars,
       right(lpad(bin(h.hash), 60, '0')[1:60], 60)[1:f.depth] AS shard, s.bytes AS shard_bytes
FROM h JOIN found f USING (doc_id) JOIN sums s ON s.depth = f.depth AND s.prefix = h.hash >> (60 - f.depth)
"""
