"""Overlapping windows over documents, chunk ids, and keyed re-ingestion of chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import is_blank


def check_window(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap between 0 and size - 1")


def windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of windows of ``size`` characters, each starting ``size - overlap`` after the one before, as far as the text
    reaches; empty for the empty text, null for null. For texts of the basic plane; others go to ``safe_windows``."""
    check_window(size, overlap)
    step, n = size - overlap, F.length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    some = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n > 0, some)


def unit_windows(text: str, size: int, overlap: int) -> list[str]:
    """The same in UTF-16 units, never splitting a pair of surrogates and always moving on."""
    starts, at = [], 0
    for c in text:
        starts.append(at)
        at += 2 if c > "￿" else 1
    total, bounds = at, {b: i for i, b in enumerate(starts)} | {at: len(text)}
    out, lo = [], 0
    while lo < total:
        hi = min(lo + size, total)
        if hi not in bounds:
            hi = hi - 1 if hi - 1 > lo else hi + 1
        out.append(text[bounds[lo] : bounds[hi]])
        if hi == total:
            break
        nxt = hi - overlap
        if nxt not in bounds:
            nxt -= 1
        lo = nxt if nxt > lo else hi
    return out


def safe_windows(size: int, overlap: int = 0):
    check_window(size, overlap)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unit_windows(t, size, overlap))

    return cut


def chunk_documents(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """(id, doc_id, chunk_index, content): null and empty texts give no chunks.

    One scan: texts beyond the basic plane are cut in Python, which is shown null for all others."""
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wide = F.coalesce(F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]"), F.lit(False))
    odd = rows.withColumn("odd", safe_windows(size, overlap)(F.when(wide, F.col("text"))))
    cut = F.when(F.col("odd").isNotNull(), F.col("odd")).otherwise(windows(F.col("text"), size, overlap))
    return odd.select("doc_id", F.posexplode(cut).alias("chunk_index", "content")).select(F.concat_ws("#", "doc_id", F.col("chunk_index").cast("string")).alias("id"), "doc_id", "chunk_index", "content")


def document_errors(id_col: Column, content: Column) -> Column:
    """Why a document can't be ingested, or null: blank id, null content."""
    return F.when(is_blank(id_col), F.lit("document id must not be blank")).when(content.isNull(), F.lit("document content must not be null"))


def dimension_errors(vec: Column, dimensions: int) -> Column:
    return F.when(vec.isNotNull() & (F.size(vec) != dimensions), F.concat(F.lit(f"expected {dimensions} dimensions, found "), F.size(vec).cast("string")))


def embedding_dimensions(df: DataFrame, vec_col: str) -> DataFrame:
    """(n, n_null, min_dim, max_dim) of the vectors; one row, also for an empty table."""
    size = F.when(F.col(vec_col).isNotNull(), F.size(vec_col))
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(vec_col).isNull()).alias("n_null"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))


def upsert_chunks(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``existing`` whose key isn't new, and all new rows. Columns follow ``existing``; those that ``new`` lacks are null."""
    names = [f"`{c}`" for c in existing.columns]
    kept = existing.join(new.select(key).distinct().hint("merge"), key, "left_anti").select(*names)
    return kept.unionByName(new.select(*[n for n, c in zip(names, existing.columns) if c in new.columns]), allowMissingColumns=True)


# An embedder maps a text column to a column of vectors: native expressions, or a pandas UDF around a model.
Embedder = Callable[[Column], Column]


def ingest(existing: DataFrame, documents: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0, embed: Embedder | None = None) -> DataFrame:
    """Chunks after re-ingesting documents: embedded, upserted by id, and chunks of those documents that are gone are deleted.

    A document with an empty text loses all its chunks; documents not given keep theirs, and so do chunks without a document.
    ``existing`` has (id, doc_id, chunk_index, content) and, with ``embed``, embedding; other columns of it are kept for chunks that stay and
    null for new ones. Rows with a blank id or null content aren't ingested; ``document_errors`` tells of them. Repeated documents count once.
    """
    usable = documents.where(document_errors(F.col(id_col), F.col(text_col)).isNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("content")).distinct()
    new = chunk_documents(usable, "doc_id", "content", size, overlap)
    if embed is not None:
        new = new.withColumn("embedding", embed(F.col("content")))
    return replace_chunks(existing, new, usable.select("doc_id"))


def replace_chunks(existing: DataFrame, new: DataFrame, given: DataFrame) -> DataFrame:
    """The table of chunks after those of the given documents (doc_id) are replaced by the new ones."""
    others = existing.join(given.distinct().hint("merge"), "doc_id", "left_anti")
    # A chunk of another document that happens to have a new id is replaced, as by its key.
    return upsert_chunks(others.select(*[f"`{c}`" for c in existing.columns]), new)


def ingested(new: DataFrame) -> DataFrame:
    """(n_documents, n_chunks): how much was ingested; one row, also for nothing."""
    return new.agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"))


def orphans(existing: DataFrame, new: DataFrame, given_docs: DataFrame) -> DataFrame:
    """Chunks of the given documents that are no more among the new ones."""
    return existing.join(given_docs.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").join(new.select("id").distinct().hint("merge"), "id", "left_anti")
