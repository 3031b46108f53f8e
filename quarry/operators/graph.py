"""The document-dataset-task graph: nodes ``id, type, aliases`` and undirected edges ``src < dst, type, weight``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions.scalars import keyword_overlap
from quarry.operators.knn import topk_join, unordered
from quarry.storage import materialise

#: Ids that are broadcast if there are no more of them (counted).
BROADCAST_IDS = 1_000_000


def _edge(a: str, b: str, kind: str, weight=None) -> list:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.lit(kind).alias("type"), (F.lit(None) if weight is None else weight).cast("double").alias("weight")]


def build_graph(documents: DataFrame, datasets: DataFrame, tasks: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """The basic graph, added to an existing one if given: a node's first type stays (existing, then document,
    dataset, task), an edge needs both of its nodes, and nothing is ever removed.  ``apart``: the tables are those of one
    :func:`store.import_apart`, so that no id occurs twice, every link has its nodes and nothing has to be looked up."""
    none = F.array().cast("array<string>")
    parts = [t.select("id", F.lit(kind).alias("type"), none.alias("aliases"), F.lit(k).alias("nth")) for k, (t, kind) in enumerate(((documents, "document"), (datasets, "dataset"), (tasks, "task")), 1)]
    link = datasets.select(F.col("document_id").alias("x"), F.col("id").alias("y"), F.lit("contains_dataset").alias("k")).unionByName(tasks.select(F.col("dataset_id").alias("x"), F.col("id").alias("y"), F.lit("used_for_task").alias("k")))
    ends = (F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), F.col("k").alias("type"), F.lit(None).cast("double").alias("weight"))
    if apart and nodes is None and edges is None:
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("nth"), link.select(*ends)
    if nodes is not None:
        parts.insert(0, nodes.select("id", "type", "aliases", F.lit(0).alias("nth")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    firsts = every.filter("id is not null").groupBy("id").agg(F.min_by(F.struct("type", "aliases"), "nth").alias("f")).select("id", "f.type", "f.aliases")
    ids = firsts.select("id")
    link = link.filter("x <> y").join(ids.withColumnRenamed("id", "x"), "x", "left_semi").join(ids.withColumnRenamed("id", "y"), "y", "left_semi")
    fresh = link.select(*ends)
    return firsts, _first_edges(fresh if edges is None else edges.unionByName(fresh.join(edges, ["src", "dst"], "left_anti")))


def _first_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.min(F.struct("type", "weight")).alias("f")).select("src", "dst", "f.type", "f.weight")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def degrees_apart(datasets: DataFrame, tasks: DataFrame) -> DataFrame:
    """The same of the graph of one :func:`store.import_apart`: a task has one edge, a dataset one and those to its tasks
    (one at least), a document those to its datasets, so that ids of tasks needn't be counted."""
    of = datasets.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("degree"))
    return of.unionByName(tasks.groupBy(F.col("dataset_id").alias("id")).agg((F.count("*") + 1).alias("degree"))).unionByName(tasks.select("id", F.lit(1).cast("long").alias("degree")))


def task_edges(vectors: DataFrame, tasks: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10, strong: float = 0.8, overlap: float = 0.7, weak: float = 0.6) -> DataFrame:
    """New ``similar_task`` edges: of each task's k nearest (itself among them) those at ``weak`` similarity or
    more; weight 1 above ``strong`` or with that keyword overlap, else the similarity."""
    ids = nodes.select("id")
    pairs = unordered(topk_join(vectors, vectors, k), weak)
    pairs = pairs.join(ids.withColumnRenamed("id", "lo"), "lo", "left_semi").join(ids.withColumnRenamed("id", "hi"), "hi", "left_semi")
    pairs = pairs.join(edges.select(F.col("src").alias("lo"), F.col("dst").alias("hi")), ["lo", "hi"], "left_anti")
    pairs = materialise(pairs)
    # only pairs that are not strong travel with keywords, and only keywords of theirs
    mild = pairs.filter(~(F.col("sim") > strong))
    asked = materialise(mild.select(F.explode(F.array("lo", "hi")).alias("id")).distinct())
    few = asked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    words = tasks.select("id", "keywords").join(F.broadcast(asked) if few else asked, "id", "left_semi")
    both = mild.join(words.toDF("lo", "k1"), "lo", "left").join(words.toDF("hi", "k2"), "hi", "left")
    weight = F.when(keyword_overlap("k1", "k2") >= overlap, 1.0).otherwise(F.col("sim"))
    return pairs.filter(F.col("sim") > strong).select(*_edge("lo", "hi", "similar_task", F.lit(1.0))).unionByName(both.select(*_edge("lo", "hi", "similar_task", weight)))


def task_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All task nodes, and the similarity edges of positive weight between two of them."""
    tasks = nodes.filter("type = 'task'")
    near = edges.filter("type = 'similar_task' and coalesce(weight, 0) > 0")
    return tasks, near.join(tasks.select(F.col("id").alias("src")), "src", "left_semi").join(tasks.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "weight")


def contract(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges each component (``id, component``; the representative is the component's least id) into its
    representative: edges move there, without loops and with one edge for each pair (a representative's own edge
    first, then the lesser one); the others become aliases.  Groups whose representative has no node stay."""
    known = components.join(nodes.select(F.col("id").alias("component")), "component", "left_semi").select("id", "component")
    alias = known.filter("id <> component")
    names = alias.groupBy("component").agg(F.sort_array(F.collect_set("id")).alias("more"))
    kept = nodes.join(alias, "id", "left_anti").join(names.withColumnRenamed("component", "id"), "id", "left")
    merged = kept.select("id", "type", F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))))).alias("aliases"))
    to = alias.select(F.col("id").alias("x"), "component")
    moved = edges.join(to.toDF("src", "s"), "src", "left").join(to.toDF("dst", "d"), "dst", "left")
    moved = moved.select(F.coalesce("s", "src").alias("a"), F.coalesce("d", "dst").alias("b"), "type", "weight", (F.col("s").isNotNull() | F.col("d").isNotNull()).alias("was_moved")).filter("a <> b")
    best = moved.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min(F.struct("was_moved", "type", "weight")).alias("f"))
    return merged, best.select("src", "dst", "f.type", "f.weight")


def representatives(nodes: DataFrame) -> DataFrame:
    """``id, representative`` of every dataset node and of its aliases."""
    sets = nodes.filter("type = 'dataset'")
    named = sets.select(F.explode("aliases").alias("id"), F.col("id").alias("representative"))
    return named.unionByName(sets.select("id", F.col("id").alias("representative"))).groupBy("id").agg(F.min("representative").alias("representative"))


def document_counts(datasets: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``document_id, title, doc_count``: in how many documents the dataset (or what it was merged into: its column
    ``representative`` if it has one, else what the graph says) occurs.  Without a graph each dataset stands for itself;
    of equal titles of a document the largest count counts."""
    rows = datasets.filter("coalesce(id, '') <> '' and coalesce(document_id, '') <> ''")
    if merged := "representative" in datasets.columns:
        of = rows
    else:
        of = rows.withColumn("representative", F.col("id")) if nodes is None else rows.join(representatives(nodes), "id", "left").withColumn("representative", F.coalesce("representative", "id"))
    counts = of.groupBy("representative").agg(F.countDistinct("document_id").alias("doc_count"))
    if merged:  # then there may be few
        counts = materialise(counts)
        counts = F.broadcast(counts) if counts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else counts
    return of.join(counts, "representative").groupBy("document_id", "title").agg(F.max("doc_count").alias("doc_count"))


def neighbours(edges: DataFrame, ids: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``id, neighbour``: adjacent nodes of one type."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour")))
    return both.join(ids.select("id").distinct(), "id", "left_semi").join(nodes.filter(F.col("type") == kind).select(F.col("id").alias("neighbour")), "neighbour", "left_semi").select("id", "neighbour")
