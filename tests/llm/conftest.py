from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


@pytest.fixture
def make(spark, tmp_path):
    """Writes tables as Parquet under a folder of the test and gives the folder."""

    def write(documents=None, labels=None, benchmark=None, pages=None, embeddings=None) -> str:
        for name, rows, schema in (
            ("documents", documents, DOCS), ("labels", labels, LABELS), ("benchmark", benchmark, "item_id long, text string"),
            ("pages", pages, "page_id long, url string, html string"), ("embeddings", embeddings, "vec_id long, embedding array<float>, label int"),
        ):
            if rows is not None:
                spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def docs():
    return lambda texts, first=0: [(first + i, t, None, None, None) for i, t in enumerate(texts)]
