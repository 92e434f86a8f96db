"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  The driver of the stages writes each result as Parquet and hands the
next stage the table it reads back.

All stages but the last return the columns of the documents.  A null or empty
text scores like any other; what is kept has no shingles, holds no passage and
no personal data, and is packed as its end id.  Rows with a null id are kept by
all stages that keep their text.  Rows that share an id go or stay together
where ids decide (near duplicates, decontamination); repeated rows of a kept id
all stay.  Of equal documents the smallest id stays.  Empty tables give empty
tables.  Other columns are carried along, whatever they are called.  Texts of
any length are read whole; only packing cuts documents, into whole pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import classifier, decontaminate, near_dup, packing, pii
from foliant.llm.common import discard, folders, join_ids, materialise
from foliant.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    found = near_dup.near_duplicates(docs, percent=80, width=5)
    copies = materialise(found.where("not kept").select("doc_id").distinct(), "copies")
    return join_ids(docs, copies, "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Scores, tokens and packing have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's own tables go when its result is written."""
    docs, older = table(spark, sf_dir, "documents"), folders()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(spark, docs, older)
    return docs
