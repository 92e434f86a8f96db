"""The library as versioned Parquet tables, with backup and restore.

A write makes a new version folder and then a numbered file in ``versions``
that names it.  Such a file is made only if its number is free and never changed,
so readers see the old state or the new one, and of two writers one fails.
Everything goes through Spark's readers and writers and Hadoop's file system.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.schema import BOOKS, CHUNKS, SCHEMA_VERSION, VECTORS

TABLES = {"books": BOOKS, "chunks": CHUNKS, "vectors": VECTORS}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write_text(self, name: str, text: str) -> None:
        """Write beside the file, then put it in its place."""
        new, old = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(old, False)
        self._fs.rename(new, old)

    def _read_text(self, name: str) -> str | None:
        path = f"{self.root}/{name}"
        if not self._fs.exists(self._path(path)):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(path).collect())

    def _current(self) -> tuple[int, str | None]:
        """Number and folder of the newest version whose file is complete; 0 and None before the first."""
        folder = self._path(f"{self.root}/versions")
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(folder) if s.getLen()), reverse=True) if self._fs.exists(folder) else []
        return (int(names[0]), self._read_text(f"versions/{names[0]}")) if names else (0, None)

    def exists(self) -> bool:
        return self._current()[1] is not None

    def read(self, name: str) -> DataFrame:
        """A table of the current version; empty before the first write."""
        version = self._current()[1]
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{version}/{name}")

    def write(self, **tables: DataFrame) -> str:
        """A new version with the given tables; the others are taken over."""
        version, number = f"v-{uuid.uuid4().hex}", self._current()[0] + 1
        for name in TABLES:
            df = tables.get(name)
            df = self.read(name) if df is None else df
            df.write.parquet(f"{self.root}/{version}/{name}")
        out = self._fs.create(self._path(f"{self.root}/versions/{number:010d}"), False)  # fails if another writer was first
        out.write(bytearray(version.encode()))
        out.close()
        return version

    def add(self, books: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> str:
        """Replace or add books with their chunks, and with the vectors if there are any."""
        ids = books.select("book_id").distinct()
        rest = {n: self.read(n).join(ids, "book_id", "left_anti") for n in TABLES}
        align = lambda df, name: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in self.read(name).schema)))
        new = {"books": books, "chunks": chunks} | ({"vectors": vectors} if vectors is not None else {})
        return self.write(**{n: rest[n].select(*self.read(n).columns).unionByName(align(new[n], n)) if n in new else rest[n] for n in TABLES})

    def remove(self, book_id: str) -> bool:
        """Take out a book with its chunks and vectors; tells whether it was there."""
        gone = F.col("book_id") == book_id
        if self.read("books").where(gone).isEmpty():
            return False
        self.write(**{n: self.read(n).where(~gone) for n in TABLES})
        return True

    def backup(self, folder: str) -> dict:
        """Copy the current version with a manifest of versions and counts."""
        target = Store(self.spark, folder)
        counts = {n: self.read(n).count() for n in TABLES}
        target.write(**{n: self.read(n) for n in TABLES})
        manifest = {"schema_version": SCHEMA_VERSION, "counts": counts}
        target._write_text("manifest.json", json.dumps(manifest, sort_keys=True))
        return manifest

    def restore(self, folder: str, force: bool = False) -> dict:
        """Take over a backup; refuses to replace a library unless forced, and newer layouts always."""
        source = Store(self.spark, folder)
        text = source._read_text("manifest.json")
        if text is None:
            raise ValueError("not a backup: it has no manifest")
        manifest = json.loads(text)
        if manifest["schema_version"] > SCHEMA_VERSION:
            raise ValueError("the backup comes from a newer version")
        if self.exists() and not force:
            raise FileExistsError("the library exists; use force to replace it")
        self.write(**{n: source.read(n) for n in TABLES})
        return manifest


def export_paths(books: DataFrame, folder: str) -> int:
    """Write the known file paths, one a line; tells how many there are."""
    paths = books.where("file_path is not null").select("file_path")
    n = paths.count()
    if n:
        paths.write.mode("overwrite").text(folder)
    return n
