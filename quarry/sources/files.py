"""From a folder of files to texts: recursive scan, loader by extension, content fingerprints, file name map."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions.scalars import extension, sha256_hex
from quarry.storage import materialise

# The extensions that are read as plain UTF-8 text.
TEXT_EXTENSIONS = [".txt", ".md", ".csv", ".json", ".xml", ".html", ".htm", ".rst", ".tex", ".log", ".yaml", ".yml", ".ini", ".cfg"]
PDF_EXTENSION = ".pdf"


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every file at any depth, with its bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def loader_of(path: Column | str) -> Column:
    """``text``, ``pdf`` or null (not supported)."""
    ext = extension(path)
    return F.when(ext == PDF_EXTENSION, "pdf").when(ext.isin(TEXT_EXTENSIONS), "text")


def load_texts(files: DataFrame, pdf_text: Callable[[bytes], str] | None = None, workers: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``fingerprint, path, text``, one row for each distinct content; ``path, reason`` of files that failed).

    ``pdf_text`` turns a PDF's bytes into text (pages joined by line ends; :mod:`quarry.sources.pdf` has one); a PDF
    it can't read is a failure, and without it all PDFs are.  ``workers`` bounds how many PDFs are read at once.
    Of files with equal bytes the last modified, then the last path, stands for them."""
    told = files.select("path", "modificationTime", "content", loader_of("path").alias("loader"))
    is_text = (F.col("loader") == "text") & F.expr("is_valid_utf8(cast(content as string))")
    good = is_text | ((F.col("loader") == "pdf") if pdf_text else F.lit(False))
    reason = F.when(F.col("loader").isNull(), "unsupported extension").when(F.col("loader") == "pdf", "no PDF reader").otherwise("not UTF-8")
    failed = told.filter(~F.coalesce(good, F.lit(False))).select("path", reason.alias("reason"))
    latest = told.filter(F.coalesce(good, F.lit(False))).withColumn("fingerprint", sha256_hex("content")).groupBy("fingerprint").agg(F.max_by(F.struct("path", "loader", "content"), F.struct("modificationTime", "path")).alias("f")).select("fingerprint", "f.*")
    texts = latest.filter("loader = 'text'").select("fingerprint", "path", F.decode("content", "UTF-8").alias("text"))
    if pdf_text:

        def tried(content: bytes) -> tuple[str | None, str | None]:
            try:
                return pdf_text(bytes(content)), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                told = [tried(c) for c in b["content"]]
                yield pd.DataFrame({"fingerprint": b["fingerprint"], "path": b["path"], "text": [t for t, _ in told], "reason": [r for _, r in told]})

        pdfs = latest.filter("loader = 'pdf'")
        pdfs = pdfs.repartition(workers) if workers else pdfs
        done = materialise(pdfs.mapInPandas(read, "fingerprint string, path string, text string, reason string"))  # written: read once
        texts = texts.unionByName(done.filter("reason is null").drop("reason"))
        failed = failed.unionByName(done.filter("reason is not null").select("path", "reason"))
    return texts, failed


def filename_map(files: DataFrame) -> DataFrame:
    """``fingerprint, path``: of equal contents the last modified file."""
    return files.groupBy(sha256_hex("content").alias("fingerprint")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
