"""Joins that stay spread when a key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A join's keys with at least this fraction of its rows are broadcast (so at most so many keys) instead of shuffled.
HEAVY = 10_000


def heavy_keys(counts: DataFrame, keys: list[str], heavy: int = HEAVY) -> DataFrame:
    """The keys of a table of counts ``n`` that hold 1/``heavy`` of the sum or more: ``heavy`` keys at most."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") >= max(total / heavy, 2)).select(*keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, spread: str, payload: list[str]) -> DataFrame:
    """``left`` with the ``payload`` of the row of ``right`` (unique by ``keys``), where there is one; rows of ``left``
    whose keys are in ``heavy`` (few, and all of them in ``right``) get it by a broadcast and stay spread by the hash of
    column ``spread``."""
    there, none = F.struct(*payload), F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")  # 0, but no literal: it has to stay a key of the join
    few = right.join(F.broadcast(heavy), keys, "left_semi").select(*keys, there.alias("_few"))
    rest = right.join(F.broadcast(heavy), keys, "left_anti").select(*keys, there.alias("_rest"), none.alias("_salt"))
    salted = left.join(F.broadcast(few), keys, "left").withColumn("_salt", F.when(F.col("_few").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(100_003))).otherwise(0).cast("int"))
    both = salted.join(rest, [*keys, "_salt"], "left").withColumn("_got", F.coalesce("_few", "_rest")).filter("_got is not null")
    return both.select(*left.columns, *[F.col("_got")[c].alias(c) for c in payload])
