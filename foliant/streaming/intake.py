"""Continuous intake: new files of a folder become books and chunks.

An extension: the same parse and chunk plans run on each micro-batch, and a
file that was seen is known by the hash of its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import chunker
from foliant.sources import files
from foliant.sources.store import Store


def take_in(batch: DataFrame, store: Store) -> None:
    """Add the files of a batch that the store does not hold yet; runs again without harm."""
    known = store.read("books").select("file_hash")
    fresh = batch.withColumn("file_hash", F.sha2("content", 256)).dropDuplicates(["file_hash"]).join(known, "file_hash", "left_anti")
    parsed = files.parse(fresh).where("status = 'parsed'")
    if parsed.isEmpty():
        return
    books = parsed.select("book_id", "title", "authors", "isbn", "file_hash", F.col("path").alias("file_path"), F.lit("toc").alias("structure_source"), F.current_timestamp().alias("added_at"))
    store.add(books, chunker.linked(chunker.chunk(files.blocks(parsed))))


def watch(spark: SparkSession, folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """Follow a folder; the checkpoint makes restarts go on where they stopped."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return stream.writeStream.foreachBatch(lambda batch, _: take_in(batch, Store(spark, root))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
