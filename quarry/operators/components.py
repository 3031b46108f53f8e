"""Connected components of an edge table, without gathering them anywhere.

Each round first contracts the edges of every partition to forests (a disjoint-set pass over runs of its edges), then joins neighbours by the large-star / small-star steps; it ends when every node hangs on its root directly.
Rounds are written tables, so no lineage grows and a lost executor costs one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.operators.joins import heavy_keys, spread_join
from quarry.storage import materialise, remove, spark_table

#: Edges that are contracted together.
RUN = 400_000
#: Edges from which a hub is worth spreading (fewer fit one task whatever their keys).
SPREAD_FROM = 1_000_000


def forest(pairs: Iterator[tuple]) -> dict:
    """Each node that isn't the least of its set, with the least."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent) if root(x) != x}


def _contract(batches):
    """The forest of each run of ``RUN`` edges, so that a task's memory doesn't grow with its partition."""
    held, n = [], 0
    for b in chain(batches, [None]):
        if held and (b is None or n + b.num_rows > RUN):
            hung = forest(p for x in held for p in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True))
            if hung:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((hung.values(), hung.keys()), held[0].schema.types, strict=True)], schema=held[0].schema)
            held, n = [], 0
        if b is not None and b.num_rows:
            held.append(b)
            n += b.num_rows


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (id) with the ``component`` of those that share a key (not null): its least id, as
    :func:`connected_components` finds it from edges between them, for one small shuffle."""
    least = materialise(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("component")))
    few = least.limit(SPREAD_FROM + 1).count() <= SPREAD_FROM
    return rows.join(F.broadcast(least) if few else least, key)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", forests: bool = False) -> DataFrame:
    """``id, component`` for every node with an edge to another; the component is the least id reachable.

    Edges with a null end and self-loops are ignored, repeated and reversed edges count once; no edges, no rows.
    ``forests``: the edges of each partition are a forest already."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)[src]
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") < F.col("b")))
    contract = lambda df: df.mapInArrow(_contract, f"a {kind}, b {kind}").distinct()
    table, path = spark_table(pairs.distinct() if forests else contract(pairs))
    while True:
        state = table.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("edges")).first()
        if (state["most"] or 1) == 1 and not table.join(table.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break
        both = table.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(table.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        more = both.filter("v > u")
        if state["edges"] < SPREAD_FROM:
            named = more.join(least, "u")
        else:  # the hub of a large component is a heavy key
            least = materialise(least)
            named = spread_join(more, least, ["u"], heavy_keys(least, ["u"]), "v", ["m"])
        large = named.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))  # after the first step no node has many lesser neighbours
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e")).select("e.*").filter("a < b")
        previous, (table, path) = path, spark_table(contract(small.distinct()))
        remove(spark, previous)
    return table.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(table.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
