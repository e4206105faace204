"""Ingestion from a loader to a table of chunks: load, check, cut, embed, write."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import chunking
from quillmesh.session import cut_lineage


class DocumentLoader(Protocol):
    """Anything that loads documents: (id, content), and other columns that are carried by nobody here."""

    def load(self, spark: SparkSession) -> DataFrame: ...


def run_ingestion(spark: SparkSession, source: DocumentLoader | DataFrame, existing: DataFrame, write: Callable[[DataFrame], None], size: int, overlap: int = 0, embed: chunking.Embedder | None = None, dimensions: int | None = None) -> int:
    """Ingests documents (id, content) and hands the whole new table to ``write``; the number of chunks made.

    A document with a blank id or null content, or a vector of other than ``dimensions``, is an error, and nothing is written. No documents
    are no chunks, and nothing is written either. Chunks are embedded once: they are checkpointed before they are counted and written.
    """
    documents = source if isinstance(source, DataFrame) else source.load(spark)
    documents = documents.select(F.col("id").cast("string").alias("id"), F.col("content").cast("string").alias("content"))
    wrong = chunking.document_errors(F.col("id"), F.col("content"))
    bad = documents.where(wrong.isNotNull()).select("id", wrong.alias("error")).limit(1).collect()
    if bad:
        raise ValueError(f"document {bad[0].id!r}: {bad[0].error}")
    given = documents.distinct()
    if given.isEmpty():
        return 0
    new = chunking.chunk_documents(given, "id", "content", size, overlap)
    if embed is not None:
        new = new.withColumn("embedding", embed(F.col("content")))
    new = cut_lineage(new)
    if embed is not None and dimensions is not None:
        bad = new.select(chunking.dimension_errors(F.col("embedding"), dimensions).alias("error")).where("error is not null").limit(1).collect()
        if bad:
            raise ValueError(bad[0].error)
    write(chunking.replace_chunks(existing, new, given.select(F.col("id").alias("doc_id"))))
    return new.count()
