import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # columns whose names clash with the operators' own
    + [T.StructField(c, T.StringType()) for c in ("row", "h", "starts", "length", "score", "n", "fp")]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with clashing extra columns from (doc_id, text[, lang]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def write_docs(docs_of, tmp_path_factory):
    """The same, written as an sf_dir."""

    def make(rows):
        path = str(tmp_path_factory.mktemp("sf"))
        docs_of(rows).write.parquet(f"{path}/documents.parquet")
        return path

    return make
