"""Mixing sources to target weights by capped water-filling.

A budget of characters is shared among sources in proportion to their weights. A source whose share exceeds
max_epochs times what it has is clamped there, and the excess goes to the others in proportion to their weights,
until every share is feasible. A source's rate is its share over its size: every document is repeated
floor(rate) times, and once more if its seeded hash falls below the fraction. Sizes are exact sums over
all documents and shares are exact fractions, so that the result does not depend on the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F, types as T

from ._common import free_names, named, pick, sized

#: Target weights by source; every source that is not named has DEFAULT_WEIGHT.
TARGET_WEIGHTS: dict[str, int] = {"src0": 5, "src1": 3, "src2": 2}
DEFAULT_WEIGHT, MAX_EPOCHS, SEED = 1, 4, "mix-1"
UNIT = 1 << 60


def water_fill(sizes: Mapping, weights: Mapping, budget: int, max_epochs: int) -> dict:
    """Shares of the budget by source: exact fractions, none above max_epochs * size, in proportion to the
    weights among those below their cap. They sum to the budget, or to all caps if those are less."""
    share: dict = {}
    free = {s for s, n in sizes.items() if n > 0 and weights[s] > 0}
    left = Fraction(budget)
    while free:
        total = sum(Fraction(weights[s]) for s in free)
        full = [s for s in free if Fraction(weights[s]) * left / total >= max_epochs * sizes[s]]
        if not full:
            share |= {s: Fraction(weights[s]) * left / total for s in free}
            break
        for s in full:
            share[s] = Fraction(max_epochs * sizes[s])
        left -= sum(share[s] for s in full)
        free -= set(full)
    return {s: share.get(s, Fraction(0)) for s in sizes}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Mapping[str, int] = TARGET_WEIGHTS, default_weight: int = DEFAULT_WEIGHT, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of docs, each repeated as its source's rate says, with copy: 1, 2, ... budget: characters, by
    default as many as docs has.

    A null source is a source of its own, with the default weight. Null and empty texts have size 0; a
    source of size 0 or weight 0 gives nothing. Rows with one id are sampled alike, ties cannot matter;
    a null id is hashed as the empty string. Clashing input columns are renamed as in free_names(). An
    empty table gives an empty table. One scan for the sizes, one for the rows, no shuffle of texts.
    """
    stats = pick(docs, source=source_col, text=text_col).groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    sizes = {r.source: int(r.n) for r in stats.collect()}
    shares = water_fill(sizes, {s: weights.get(s, default_weight) for s in sizes}, sum(sizes.values()) if budget is None else budget, max_epochs)
    rows = []
    for s, n in sizes.items():
        rate = shares[s] / n if n else Fraction(0)
        whole = rate.numerator // rate.denominator
        rows.append((s, whole, int((rate - whole) * UNIT)))
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("source__", stats.schema["source"].dataType), T.StructField("whole__", T.LongType()), T.StructField("part__", T.LongType())])
    rates = spark.createDataFrame(rows, schema)
    docs = free_names(docs, "copy", "source__", "whole__", "part__")
    joined = docs.join(sized(rates), docs[named(docs, source_col)].eqNullSafe(F.col("source__")))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[named(docs, id_col)].cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    copies = F.col("whole__") + (drawn < F.col("part__")).cast("bigint")
    copy = F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("bigint"), copies)).otherwise(F.array().cast("array<bigint>")))
    return joined.select(*docs.columns, copy.alias("copy"))


def oracle_sql(weights: Mapping[str, int] = TARGET_WEIGHTS, default_weight: int = DEFAULT_WEIGHT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    """The same in DuckDB SQL: sources sorted by cap over weight are clamped up to a point."""
    named_weights = " ".join(f"WHEN '{s}' THEN {w}" for s, w in weights.items())
    return f"""
WITH s AS (
  SELECT source, sum(coalesce(length(text), 0))::HUGEINT AS n, (CASE source {named_weights} ELSE {default_weight} END)::HUGEINT AS w FROM documents GROUP BY source),
c AS (
  SELECT *, {max_epochs} * n AS cap, (SELECT sum(n) FROM s)::HUGEINT AS budget,
         (sum({max_epochs} * n) OVER (ORDER BY {max_epochs} * n / w, source ROWS UNBOUNDED PRECEDING) - {max_epochs} * n)::HUGEINT AS before,
         (sum(w) OVER (ORDER BY {max_epochs} * n / w DESC, source DESC ROWS UNBOUNDED PRECEDING))::HUGEINT AS rest
  FROM s WHERE n > 0 AND w > 0),
f AS (SELECT *, cap * rest <= w * (budget - before) AS clamped FROM c),
l AS (SELECT coalesce(sum(cap) FILTER (clamped), 0)::HUGEINT AS used, coalesce(sum(w) FILTER (NOT clamped), 1)::HUGEINT AS open FROM f),
r AS (
  SELECT source, CASE WHEN clamped THEN {max_epochs}::HUGEINT ELSE w * (budget - used) // (open * n) END AS whole,
         CASE WHEN clamped THEN 0::HUGEINT ELSE (w * (budget - used)) % (open * n) * {UNIT}::HUGEINT // (open * n) END AS part
  FROM f, l)
SELECT d.*, unnest(range(1, 1 + (whole + CASE WHEN ('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT < part THEN 1 ELSE 0 END)::BIGINT)) AS copy
FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


ORACLE_SQL = oracle_sql()
