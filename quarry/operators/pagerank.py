"""Weighted personalised PageRank over an undirected graph.

r' = alpha * (r P + (mass of nodes without edges) p) + (1 - alpha) p, with P the row-normalised weights and p the
personalisation, from r = 1/N until the L1 change is below N * tol; the last iterate is the result either way.
A graph of at most ``LOCAL_EDGES`` edges and nodes (counted first) is iterated on the driver with numpy, as a
query's latency is what counts there; a larger one by joins over written tables.  Edges without a weight don't count.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, functions as F

from quarry.storage import materialise, remove, spark_table

LOCAL_EDGES = 1_000_000


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, other: float = 0.001, max_iter: int = 100, tol: float = 1e-6, local: bool | None = None) -> DataFrame:
    """``id, score`` of all ``nodes`` (id).  ``seeds`` (id) weigh 1 and other nodes ``other``; none that is a node:
    uniform.  ``local`` None decides by size."""
    spark = nodes.sparkSession
    ids = nodes.select("id").distinct()
    if local is None:
        local = edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES and ids.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES
    start = ids.withColumn("p", F.lit(1.0))
    if seeds is not None:
        mine = ids.join(seeds.select("id").distinct().withColumn("seed", F.lit(True)), "id", "left")
        start = mine.select("id", F.when(F.col("seed"), 1.0).otherwise(other).alias("p")) if ids.join(seeds, "id", "left_semi").limit(1).count() else start
    if local:
        return _local(spark, start, edges, alpha, max_iter, tol)

    edges = edges.filter("weight is not null")
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter("src <> dst")
    out = both.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = materialise(both.join(out, "src").select(F.col("src").alias("id"), "dst", (F.col("weight") / F.col("total")).alias("share")))
    # kept by source on the executors' disks, so that a round shuffles ranks only; what is lost is read again
    dealt = steps.repartition("id").persist(StorageLevel.DISK_ONLY)
    n, mass = start.agg(F.count("*").alias("n"), F.sum("p").alias("s")).first()
    linked = steps.select("id").distinct().withColumn("linked", F.lit(True))
    table, path = spark_table(start.select("id", (F.col("p") / mass).alias("p"), F.lit(1.0 / max(n, 1)).alias("score")).join(linked, "id", "left").withColumn("linked", F.coalesce("linked", F.lit(False))))
    loose = table.filter("not linked").agg(F.sum("score")).first()[0] or 0.0
    for _ in range(max_iter if n else 0):
        flow = dealt.join(table.select("id", "score"), "id").groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("got")).withColumnRenamed("dst", "id")
        new = alpha * (F.coalesce("got", F.lit(0.0)) + loose * F.col("p")) + (1 - alpha) * F.col("p")
        before, told = path, Observation()  # one job a round: its write also tells the change and the loose mass
        fresh = table.join(flow, "id", "left").select("id", "p", new.alias("score"), "linked", F.abs(new - F.col("score")).alias("change"))
        table, path = spark_table(fresh.observe(told, F.sum("change").alias("change"), F.sum(F.when(~F.col("linked"), F.col("score"))).alias("loose")).drop("change"))
        remove(spark, before)
        loose = told.get["loose"] or 0.0
        if told.get["change"] < n * tol:
            break
    dealt.unpersist()
    return table.select("id", "score")


def _local(spark, start: DataFrame, edges: DataFrame, alpha: float, max_iter: int, tol: float) -> DataFrame:
    kind = dict(start.dtypes)["id"]
    rows = start.orderBy("id").toPandas()
    if rows.empty:
        return spark.createDataFrame([], f"id {kind}, score double")
    p = rows["p"].to_numpy() / rows["p"].sum()
    at = {x: k for k, x in enumerate(rows["id"])}
    es = [(at[a], at[b], w) for a, b, w in edges.filter("weight is not null").select("src", "dst", "weight").toPandas().itertuples(index=False) if a != b]
    src, dst = (np.array([e[k] for e in es] + [e[1 - k] for e in es], dtype=int) for k in (0, 1))
    weight = np.array([e[2] for e in es] * 2, dtype=float)
    total = np.bincount(src, weights=weight, minlength=len(p))
    share = weight / total[src] if len(src) else weight
    r = np.full(len(p), 1 / len(p))
    for _ in range(max_iter):
        new = alpha * (np.bincount(dst, weights=share * r[src], minlength=len(p)) + r[total == 0].sum() * p) + (1 - alpha) * p
        change, r = np.abs(new - r).sum(), new
        if change < len(p) * tol:
            break
    rows["score"] = r
    return spark.createDataFrame(rows[["id", "score"]], f"id {kind}, score double")
