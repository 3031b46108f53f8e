"""From a task to ranked datasets, and to an answer's context."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from quarry.operators.graph import neighbours
from quarry.operators.knn import topk_query
from quarry.operators.pagerank import pagerank
from quarry.operators.services import ANSWER_PROMPT

NOTHING_FOUND = "Sorry, no related dataset was found."
NO_ANSWER = "Sorry, the answer came back empty."
FAILED = "Sorry, no answer could be generated."


def candidate_count(top_k: int) -> int:
    """How many tasks of highest rank are looked at for ``top_k`` datasets."""
    return top_k * 3 * math.ceil(math.log2(top_k) + 1) if top_k > 0 else 0


def seeds(nearest: DataFrame, k: int, similarity: float = 0.85, least: float = 0.6) -> DataFrame:
    """``id, cos`` of the nearest tasks at or above ``similarity``; if there is none, the best few of those at or
    above ``least`` (a third of k, one at least)."""
    good = nearest.filter(F.col("cos") >= similarity)
    fallback = nearest.filter(F.col("cos") >= least).orderBy(F.desc("cos"), "id").limit(max(1, k // 3))
    none_good = good.agg((F.count("*") == 0).alias("none"))  # one row
    return good.select("id", "cos").unionByName(fallback.crossJoin(F.broadcast(none_good)).filter("none").select("id", "cos"))


def top_tasks(ranks: DataFrame, seed_ids: DataFrame, top_k: int) -> DataFrame:
    """``id, score``: the tasks of highest rank and the seeds (0 for one without a rank)."""
    best = ranks.orderBy(F.desc("score"), "id").limit(candidate_count(top_k)).select("id")
    return best.unionByName(seed_ids.select("id")).distinct().join(ranks, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def dataset_scores(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, offset: float = 0.1) -> DataFrame:
    """``id, score``: for each dataset next to one of the tasks, its best task's rank plus a constant."""
    near = neighbours(edges, tasks, nodes, "dataset")
    return near.join(tasks, "id").groupBy(F.col("neighbour").alias("id")).agg(F.max(F.col("score") + offset).alias("score"))


def search(query: list[float], vectors: DataFrame, task_nodes: DataFrame, task_edges: DataFrame, nodes: DataFrame, edges: DataFrame, datasets: DataFrame, top_k: int = 5, initial_k: int = 2, similarity: float = 0.85, least: float = 0.6, alpha: float = 0.85, other: float = 0.001, offset: float = 0.1, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """``rank, score, id, document_id, title, description, link`` of the best datasets for a query vector.  Without
    a seed the ranks are those of the whole task graph."""
    found = seeds(topk_query(vectors, query, initial_k), initial_k, similarity, least)
    ranks = pagerank(task_nodes, task_edges, found, alpha, other, max_iter=max_iter, tol=tol)
    scores = dataset_scores(top_tasks(ranks, found, top_k), nodes, edges, offset)
    best = scores.orderBy(F.desc("score"), "id").limit(max(0, top_k)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return datasets.join(F.broadcast(best), "id").select("rank", "score", "id", "document_id", "title", "description", "link").orderBy("rank")


def context_rows(hits: DataFrame, tasks: DataFrame, also: DataFrame | None = None, every: bool = False) -> DataFrame:
    """``rank, line``: each hit with its dataset's task descriptions (in order), and those of merged datasets
    (``id, representative``) if given.  ``every``: all datasets are hits, so that tasks needn't be looked up first."""
    of = tasks.select(F.col("dataset_id").alias("id"), "task_description")
    if also is not None:
        of = of.join(also, "id", "left").select(F.coalesce("representative", "id").alias("id"), "task_description")
    told = (of if every else of.join(hits.select("id"), "id", "left_semi")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("task_description", F.lit("N/A")))), "; ").alias("told"))
    part = lambda name, c: F.concat(F.lit(f"   **{name}**: "), F.coalesce(c, F.lit("N/A")))
    head = F.concat(F.col("rank").cast("string"), F.lit(". **Dataset**: "), F.coalesce("title", F.lit("N/A")))
    line = F.concat_ws("\n", head, part("Description", F.col("description")), part("Related Tasks", F.col("told")), part("Link", F.col("link")))
    return hits.join(told, "id", "left").select("rank", line.alias("line"))


def answer(task: str, hits: DataFrame, tasks: DataFrame, top_k: int = 5, chat: Callable[[list[dict]], str] | None = None, also: DataFrame | None = None) -> str:
    """An answer from the hits (a few rows); without a chat client the context itself."""
    lines = [r["line"] for r in context_rows(hits, tasks, also).orderBy("rank").collect()]
    if not lines:
        return NOTHING_FOUND
    context = "\n\n".join(lines)
    if chat is None:
        return context
    try:
        return chat([{"role": "user", "content": ANSWER_PROMPT.format(top_k=top_k, context=context, task=task)}]) or NO_ANSWER
    except Exception:
        return FAILED


def wanted(top_k: int, rate: float = 2.0) -> int:
    """How many hits to fetch for an answer that names ``top_k``."""
    return math.ceil(top_k * max(1.0, rate))


def recall_at_k(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``k, queries, hit_rate, mrr`` of ``task, rank, title`` against ``task, ground_truth``, titles normalised."""
    from quarry.functions.scalars import normalize_title

    want = truth.select("task", normalize_title("ground_truth").alias("t"))
    got = hits.filter(F.col("rank") <= k).select("task", normalize_title("title").alias("t"), "rank")
    first = want.join(got, ["task", "t"], "left").groupBy("task").agg(F.min("rank").alias("first"))
    return first.agg(F.count("*").alias("queries"), F.avg(F.col("first").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")).select(F.lit(k).alias("k"), "queries", "hit_rate", "mrr")
