import pytest
from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
SCHEMAS = {
    "documents": DOCS,
    "labels": T.StructType().add("doc_id", "long").add("quality", "integer").add("toxic", "integer"),
    "benchmark": T.StructType().add("item_id", "long").add("text", "string"),
    "pages": T.StructType().add("page_id", "long").add("url", "string").add("html", "string"),
    "embeddings": T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("label", "integer"),
}


@pytest.fixture
def tables(spark, tmp_path):
    """tables(documents=rows, ...) writes the tables, with an extra column of each name that operators add, and gives the folder."""

    def write(**named):
        from pyspark.sql import functions as F

        for name, rows in named.items():
            rows = [(*r, None, None, None)[:5] if name == "documents" else r for r in rows]
            df = spark.createDataFrame(rows, SCHEMAS[name]).repartition(3)
            extra = {c: F.lit("x") for c in ("size", "target", "score", "key", "node", "n_words", "findings", "copies", "_label", "fp", "page", "_toxicity", "_copy", "_repeated", "_leak", "_redacted", "_findings", "_mix_source", "_tox_text", "_sec_text", "_fm_text", "mix_size", "mix_copy", "a", "b", "text_") if c not in df.columns}
            df.withColumns(extra).write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write
