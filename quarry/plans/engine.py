"""The engine: builds the stored tables and the graph from a folder, and answers queries from them.

Every stage is a written table below ``cache_root``; running it again computes only what is missing.
"""

from __future__ import annotations

import logging
from dataclasses import fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry import schemas
from quarry.config import Config
from quarry.operators import extract as ex
from quarry.operators import graph, resolve, search, services
from quarry.session import ship
from quarry.sources import files, pdf, store
from quarry.storage import materialise

log = logging.getLogger("quarry")


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, **options):
        self.spark, self.config = spark, config or Config(**options)
        ship(spark)
        c = self.config
        chat = services.http_chat(c.api_base, c.api_key, c.model, c.temperature) if c.api_base and c.api_key else None
        self.extractor = c.extractor or (services.chat_extractor(chat) if chat else services.rule_extractor)
        self.embedder = c.embedder or (services.http_embedder(c.api_base, c.api_key, "text-embedding-3-small", c.embedding_batch) if chat else services.hash_embedder(c.embedding_dimension))
        self.judge = c.judge or (services.chat_judge(chat, c.llm_retries, c.llm_retry_delay) if chat else services.same_words_judge)
        self.chat = c.answerer or (services.http_chat(c.qa_api_base, c.qa_api_key, c.qa_model, c.qa_temperature) if c.qa_api_base and c.qa_api_key else None)

    # stored tables

    def _path(self, name: str) -> str:
        c = self.config
        return {"task_vectors": c.task_vectors_path, "dataset_vectors": c.dataset_vectors_path, "nodes": f"{c.graph_path}/nodes", "edges": f"{c.graph_path}/edges", "processed_nodes": f"{c.graph_processed_path}/nodes", "processed_edges": f"{c.graph_processed_path}/edges", "task_nodes": f"{c.graph_tasks_path}/nodes", "task_edges": f"{c.graph_tasks_path}/edges"}.get(name) or (
            f"{c.db_path}/{name}" if name in ("documents", "datasets", "tasks", "aliases", "different") else f"{c.cache_root.rstrip('/')}/{name}"
        )

    def table(self, name: str) -> DataFrame:
        schema = {"preprocessed": schemas.PREPROCESSED, "extractions": schemas.EXTRACTIONS, "documents": schemas.DOCUMENTS, "datasets": schemas.DATASETS, "tasks": schemas.TASKS, "aliases": schemas.ALIASES, "different": schemas.DIFFERENT, "filename_map": "fingerprint string, path string", "failed": "path string, reason string"}
        kind = schema.get(name) or (schemas.VECTORS if name.endswith("vectors") else schemas.NODES if name.endswith("nodes") else schemas.EDGES)
        return store.read_table(self.spark, self._path(name), kind)

    def _append(self, name: str, rows: DataFrame) -> None:
        store.append(rows, self._path(name))

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Writes beside the old table and then takes its place, so that a crash leaves one of them whole."""
        store.replace(rows, self._path(name))

    # stages

    def preprocess(self, folder: str | None = None) -> DataFrame:
        """Reads a folder; returns the files that failed with the reason."""
        found = files.scan_folder(self.spark, folder or self.config.input_folder)
        texts, failed = files.load_texts(found, self.config.pdf_text or pdf.pdf_text, self.config.preprocess_workers)
        self._append("preprocessed", texts.join(self.table("preprocessed").select("fingerprint"), "fingerprint", "left_anti"))
        self._replace("filename_map", self.table("filename_map").unionByName(files.filename_map(found)).groupBy("fingerprint").agg(F.max("path").alias("path")))
        return failed

    def extract(self, fingerprint: str | None = None) -> DataFrame:
        """Extracts from texts that have no result yet; returns the failures."""
        c, texts = self.config, self.table("preprocessed")
        texts = texts if fingerprint is None else texts.filter(F.col("fingerprint") == fingerprint)
        missing = texts.join(self.table("extractions").select("fingerprint"), "fingerprint", "left_anti")
        done, failed = ex.extract(missing, self.extractor, c.extract_workers, c.retry_limit, c.retry_initial_delay, c.retry_max_delay)
        self._append("extractions", done)
        return failed

    def preprocess_and_extract(self) -> DataFrame:
        return self.preprocess().unionByName(self.extract().withColumnRenamed("fingerprint", "path"))

    def import_all(self, fingerprint: str | None = None) -> None:
        rows = self.table("extractions")
        rows = rows if fingerprint is None else rows.filter(F.col("fingerprint") == fingerprint)
        for name, fresh in zip(("documents", "datasets", "tasks"), store.import_extractions(rows), strict=True):
            self._append(name, materialise(fresh.join(self.table(name).select("id"), "id", "left_anti")).select(*self.table(name).columns))

    def embed(self) -> None:
        c = self.config
        for name, texts in (("task_vectors", ex.task_texts(self.table("tasks"))), ("dataset_vectors", ex.dataset_texts(self.table("datasets")))):
            fresh = lambda missing: ex.embed(missing.withColumnRenamed("hex_id", "id"), self.embedder, c.embedding_batch, c.embedding_dimension)
            store.load_or_compute(self.spark, texts.withColumnRenamed("id", "hex_id"), self._path(name), schemas.VECTORS, fresh, "hex_id")

    def build_graph(self) -> None:
        nodes, edges = graph.build_graph(self.table("documents"), self.table("datasets"), self.table("tasks"), self.table("nodes"), self.table("edges"))
        nodes, edges = materialise(nodes), materialise(edges)
        self._replace("nodes", nodes)
        self._replace("edges", edges)
        log.info("graph: %s", self.counts(processed=False))

    def link_tasks(self) -> None:
        c, nodes, edges = self.config, self.table("nodes"), self.table("edges")
        fresh = graph.task_edges(self.table("task_vectors"), self.table("tasks"), nodes, edges, c.task_max_merge, c.strong_similarity_threshold, c.keyword_overlap_threshold, c.weak_similarity_threshold)
        self._replace("processed_nodes", nodes)
        self._replace("processed_edges", edges.unionByName(fresh))

    def merge_datasets(self) -> None:
        c = self.config
        pairs = resolve.candidates(self.table("dataset_vectors"), c.dataset_merge_k_neighbors, c.dataset_merge_similarity_threshold)
        components, aliases, different = resolve.resolve(pairs, self.table("datasets"), self.judge, self.table("aliases"), self.table("different"))
        nodes, edges = graph.contract(self.table("processed_nodes"), self.table("processed_edges"), components)
        nodes, edges = materialise(nodes), materialise(edges)
        self._replace("processed_nodes", nodes)
        self._replace("processed_edges", edges)
        self._append("aliases", materialise(aliases.join(self.table("aliases").select("key"), "key", "left_anti")))
        self._append("different", different)

    def separate_tasks(self) -> None:
        nodes, edges = graph.task_graph(self.table("processed_nodes"), self.table("processed_edges"))
        self._replace("task_nodes", nodes)
        self._replace("task_edges", edges)

    def build(self) -> DataFrame:
        """All stages; returns what failed (path, reason)."""
        if not self.config.input_folder:
            raise ValueError("input_folder is needed")
        failed = self.preprocess_and_extract()
        self.finish()
        log.info("stored: %s", {r["stage"]: r["rows"] for r in self.progress().collect()})
        return failed

    def finish(self) -> None:
        """The stages after extraction, up to a searchable graph."""
        for stage in (self.import_all, self.embed, self.build_graph, self.link_tasks, self.merge_datasets, self.separate_tasks):
            log.info("stage %s", stage.__name__)
            stage()

    def counts(self, processed: bool = True) -> dict[str, int]:
        """Nodes and edges of a graph by type, as ``node document``, ``edge similar_task`` and so on."""
        name = "processed_" if processed else ""
        told = self.table(f"{name}nodes").select(F.lit("node").alias("of"), "type").unionByName(self.table(f"{name}edges").select(F.lit("edge").alias("of"), "type"))
        return {f"{r['of']} {r['type']}": r["n"] for r in told.groupBy("of", "type").agg(F.count("*").alias("n")).collect()}

    def progress(self) -> DataFrame:
        """``stage, rows``: how much each stage has stored."""
        names = ("preprocessed", "extractions", "documents", "datasets", "tasks", "task_vectors", "dataset_vectors")
        return reduce(DataFrame.unionByName, [self.table(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("stage"), "rows") for n in names])

    # queries

    def search(self, task: str, top_k_datasets: int | None = None, initial_k: int | None = None, similarity_threshold: float | None = None, min_seed_similarity: float | None = None, pagerank_alpha: float | None = None) -> DataFrame:
        given = {"top_k_datasets": top_k_datasets, "initial_k": initial_k, "similarity_threshold": similarity_threshold, "min_seed_similarity": min_seed_similarity, "pagerank_alpha": pagerank_alpha}
        k, first, similar, least, alpha = (getattr(self.config, n) if v is None else v for n, v in given.items())
        query = [float(x) for x in self.embedder([task.replace("\n", " ")])[0]]
        return search.search(query, self.table("task_vectors"), self.table("task_nodes"), self.table("task_edges"), self.table("processed_nodes"), self.table("processed_edges"), self.table("datasets"), k, first, similar, least, alpha, self.config.other_seed_weight, self.config.score_offset)

    def qa(self, task: str, top_k_datasets: int | None = None, search_rate: float | None = None, with_merged: bool = False, **options) -> str:
        k = self.config.top_k_datasets if top_k_datasets is None else top_k_datasets
        hits = materialise(self.search(task, search.wanted(k, search_rate or self.config.qa_search_rate), **options))
        also = graph.representatives(self.table("processed_nodes")) if with_merged else None
        return search.answer(task, hits, self.table("tasks"), k, self.chat, also)

    def statistics(self) -> DataFrame:
        nodes = self.table("processed_nodes")
        return graph.document_counts(self.table("datasets"), nodes if nodes.limit(1).count() else None)

    def export_graphml(self, path: str, processed: bool = True) -> None:
        """Writes a graph as one GraphML file in a folder."""
        name = "processed_" if processed else ""
        store.graphml(self.table(f"{name}nodes"), self.table(f"{name}edges")).orderBy("part", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


OPTIONS = [f.name for f in fields(Config)]
