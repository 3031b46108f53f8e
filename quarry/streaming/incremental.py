"""Incremental builds as a stream: new files of a folder, each taken once, go through the batch stages."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry import schemas
from quarry.plans.engine import Engine
from quarry.sources import files, pdf


def watch(engine: Engine, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query over ``folder``; by default it takes what is there and ends.  The stages' own anti-joins make
    a batch that is run again harmless.  After each batch the graph can be searched; what failed is in the table ``failed``."""
    stream = engine.spark.readStream.format("binaryFile").schema(schemas.FILES).option("recursiveFileLookup", "true").load(folder)

    def take(batch: DataFrame, _: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)
        texts, failed = files.load_texts(batch, engine.config.pdf_text or pdf.pdf_text, engine.config.preprocess_workers)
        engine._append("preprocessed", texts.join(engine.table("preprocessed").select("fingerprint"), "fingerprint", "left_anti"))
        engine._replace("filename_map", engine.table("filename_map").unionByName(files.filename_map(batch)).groupBy("fingerprint").agg(F.max("path").alias("path")))
        engine._append("failed", failed.unionByName(engine.extract().withColumnRenamed("fingerprint", "path")))
        engine.finish()
        batch.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
