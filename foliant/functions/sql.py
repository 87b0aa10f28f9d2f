"""Functions by name for SQL: the Arrow UDFs, the class of a line as an expression, and table functions for FROM: a document's chunks and its lines."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliant.functions import blocks, udfs
from foliant.functions import text as X

FUNCTIONS = {"chunk_text": udfs.chunks, "build_preview": udfs.preview, "strip_markup": udfs._without_leak, "html_unescape": udfs.html_unescape}


class Chunks:
    """chunks(doc_id, text): a row per chunk. A null text has none."""

    def eval(self, doc_id: int, text: str):
        for k, chunk in enumerate(udfs.chunk_text(text) if text is not None else []):
            yield k, chunk


def register(spark: SparkSession) -> None:
    """Afterwards ``SELECT explode(chunk_text(text)) FROM documents``, ``FROM documents, LATERAL chunks(doc_id, text)``, ``FROM documents, LATERAL text_lines(text)`` and the like work."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    rows = spark.range(1).select(F.lit("").alias("line")).select(blocks.line_class(F.col("line")).alias("kind"))
    expression = rows._jdf.queryExecution().analyzed().expressions().head().child().sql()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION line_class(line STRING) RETURNS STRING RETURN {expression}")
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="chunk_index int, chunk string", useArrow=True))
    white = "".join(f"\\u{ord(c):04x}" for c in X.WHITE)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION text_lines(t STRING) RETURNS TABLE(line INT, line_text STRING, kind STRING) "
        f"RETURN SELECT pos, col, line_class(btrim(col, '{white}')) FROM posexplode(split(t, '\\n'))"
    )
