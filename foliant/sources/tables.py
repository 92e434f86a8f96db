"""The library's tables over the driver's test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer files than there are cores.

    A small table is often one row group, which one task would read and work
    through alone; a large one has many files and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a document; a source is a book, and documents follow each other by id.

    Every 25th chunk is back matter, the others have chapters of ten.  The
    sequence is the only thing that needs a shuffle, and Catalyst drops its
    window where no query asks for it or for sections.
    """
    d = spread(read(spark, sf_dir, "documents"))
    seq = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("int")
    section = F.when(F.col("sequence") % 25 == 0, "Index").otherwise(F.concat(F.lit("Chapter "), (F.floor(F.col("sequence") / 10) + 1).cast("string")))
    kind = F.when(F.col("doc_id") % 10 == 0, "code").when(F.col("doc_id") % 10 == 1, "table").otherwise("text")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.substring(F.sha2("source", 256), 1, 6).alias("book_id"), F.col("text").alias("content"),
        kind.alias("content_type"), F.col("lang").alias("language"), seq.alias("sequence"),
    ).withColumn("section_path", F.array("language", section))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book a source; its collection is its most frequent language."""
    d = read(spark, sf_dir, "documents")
    n = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    best = n.groupBy("source").agg(F.max(F.struct("n", F.col("lang").alias("l"))).alias("b"), F.min("first").alias("first"))
    return best.select(
        F.substring(F.sha2("source", 256), 1, 6).alias("book_id"), F.col("source").alias("title"), F.col("b.l").alias("collection"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("first")).alias("added_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors; not every chunk has one."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


#: The same tables for DuckDB.
SQL_CHUNKS = """
chunks AS (SELECT *, [language, CASE WHEN sequence % 25 = 0 THEN 'Index' ELSE 'Chapter ' || CAST(sequence // 10 + 1 AS VARCHAR) END] AS section_path
  FROM (SELECT doc_id AS chunk_id, substr(sha256(source), 1, 6) AS book_id, text AS content,
    CASE doc_id % 10 WHEN 0 THEN 'code' WHEN 1 THEN 'table' ELSE 'text' END AS content_type, lang AS language,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sequence FROM documents))"""
SQL_BOOKS = """
books AS (SELECT substr(sha256(source), 1, 6) AS book_id, source AS title, lang AS collection, first FROM (
  SELECT source, lang, min(min(doc_id)) OVER (PARTITION BY source) AS first, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang DESC) AS r
  FROM documents GROUP BY source, lang) WHERE r = 1)"""
SQL_VECTORS = "vectors AS (SELECT vec_id AS chunk_id, embedding FROM embeddings)"
