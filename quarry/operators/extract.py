"""Extraction and embedding: injected callables over Arrow batches, with incremental (anti-join) variants."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarry import schemas
from quarry.functions.scalars import low63, strip
from quarry.operators.services import hash_embedder, rule_extractor, with_retries
from quarry.storage import materialise


def extract(texts: DataFrame, extractor: Callable[[str], dict] | None = None, workers: int | None = None, retries: int = 1, delay: float = 1.0, most: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(extractions, ``fingerprint, reason`` of failures) from ``fingerprint, text``.  ``workers`` bounds how many
    calls run at once; each row is tried ``retries`` times."""
    call = with_retries(extractor or rule_extractor, retries, delay, most)

    def run(batches):
        for b in batches:
            out = []
            for fp, text in zip(b["fingerprint"], b["text"], strict=True):
                try:
                    x = call(text or "")
                    out.append((fp, bool(x["datasets_used"]), [{k: d.get(k) for k in ("title", "description", "task_description", "link", "task")} for d in x.get("datasets") or []], None))
                except Exception as e:
                    out.append((fp, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["fingerprint", "datasets_used", "datasets", "reason"])

    rows = texts.select("fingerprint", "text")
    rows = rows.repartition(workers) if workers else rows
    done = materialise(rows.mapInPandas(run, f"{schemas.EXTRACTIONS}, reason string"))  # written: no call is made twice
    return done.filter("reason is null").drop("reason"), done.filter("reason is not null").select("fingerprint", "reason")


def embed(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None, batch: int = 100, dimension: int = 256) -> DataFrame:
    """Vectors (hex_id, int64_id, text, embedding) of ``id, text``; line ends are spaces to the embedder only."""
    call = embedder or hash_embedder(dimension)

    def run(batches):
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                x = np.asarray(call([t.replace("\n", " ") for t in part["text"]]), np.float32)
                yield pd.DataFrame({"hex_id": part["id"].to_numpy(), "text": part["text"].to_numpy(), "embedding": list(x)})

    vectors = rows.select("id", "text").mapInPandas(run, "hex_id string, text string, embedding array<float>")
    return vectors.select("hex_id", low63("hex_id").alias("int64_id"), "text", "embedding")


def task_texts(tasks: DataFrame) -> DataFrame:
    """``id, text`` of the tasks that have a description."""
    return tasks.filter("id <> '' and task_description <> ''").select("id", F.col("task_description").alias("text"))


def dataset_texts(datasets: DataFrame) -> DataFrame:
    """``id, text``: title and description, where one is there (a null one reads None)."""
    some = datasets.filter("id <> '' and (coalesce(title, '') <> '' or coalesce(description, '') <> '')")
    return some.select("id", strip(F.concat(F.coalesce("title", F.lit("None")), F.lit(" "), F.coalesce("description", F.lit("None")))).alias("text"))


def without_vectors(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Texts that have no vector yet."""
    return texts.join(vectors.select(F.col("hex_id").alias("id")), "id", "left_anti")
