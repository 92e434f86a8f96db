"""Listings, counts and reports of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def listed(books: DataFrame) -> DataFrame:
    """Books with their place in library order, newest first.  A library's books are few next to its chunks."""
    return books.withColumn("place", F.row_number().over(Window.orderBy(F.desc("added_at"), "book_id")))


def counts(books: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(book_id, n_chunks, n_vectors); books without either count 0."""
    own = chunks.select("book_id", "chunk_id").join(vectors.select("chunk_id", F.lit(1).alias("v")), "chunk_id", "left")
    n = own.groupBy("book_id").agg(F.count("chunk_id").alias("n_chunks"), F.count("v").alias("n_vectors"))
    return books.select("book_id").join(n, "book_id", "left").na.fill(0)


def manifest_counts(books: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row with the three table sizes."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(books, "books").crossJoin(one(chunks, "chunks")).crossJoin(one(vectors, "vectors"))


def reindex_report(rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Counts by status, and whether all succeeded."""
    status = F.col("status")
    return rows.agg(*(F.count(F.when(status == x, 1)).alias(x) for x in statuses), F.every(status == "success").alias("ok"))


def path_list(books: DataFrame) -> DataFrame:
    """One known file path a row."""
    return books.where("file_path is not null").select("file_path")
