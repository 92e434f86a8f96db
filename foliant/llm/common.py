"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, wherever an operator's contract speaks of words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 500

#: A key is hot when it holds more than 1/HOT_SHARE of a table's rows (and HOT_LEAST rows), so
#: no table can have more than HOT_SHARE hot keys, whatever its size.
HOT_SHARE, HOT_LEAST = 20_000, 1000


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share.

    ``spark.checkpoint.dir`` names it on a cluster, and has to.  Only in local
    mode, as in tests, a temporary folder takes its place where it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    _folders.append(f"{base.rstrip('/')}/foliant-{uuid.uuid4().hex}")
    return _folders[-1]


#: Folders that this driver has named and not removed yet.
_folders: list[str] = []


def folders() -> set[str]:
    """The work folders named so far."""
    return set(_folders)


def discard(spark: SparkSession, but: DataFrame, older: set[str]) -> None:
    """Remove the work folders that came after `older`, except those that `but` reads."""
    kept = " ".join(but.inputFiles())
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in [f for f in _folders if f not in older and f.rsplit("/", 1)[1] not in kept]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
        _folders.remove(folder)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor makes later stages read files again
    instead of running Python stages anew.
    """
    path = f"{work_folder(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., tuple | None]],
    schema: T.StructType,
) -> DataFrame:
    """One Python row function over Arrow batches.

    ``make()`` runs once a partition and returns f(*column values), which gives
    the output row or None for no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # bounds the Python objects of a task
                part = batch.slice(at, SLICE)
                rows = [r for r in map(f, *(part.column(i).to_pylist() for i in range(part.num_columns))) if r is not None]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(cols, target, strict=True)], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def list_values(column: pa.Array) -> Iterator[np.ndarray]:
    """The values of a list column (without nulls inside) as numpy arrays, without copies."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[i:j] for i, j in zip(at[:-1], at[1:], strict=True))


def hot_floor(total: float, least: int = HOT_LEAST) -> int:
    """A key with more rows than this is hot in a table of `total` rows."""
    return max(least, int(total) // HOT_SHARE)


def hot_keys(counts: DataFrame, key: str, n: str, least: int = HOT_LEAST) -> list[tuple]:
    """(key, tasks) of the hot keys among `counts`, which has one row a key; at most HOT_SHARE of them."""
    floor = hot_floor(counts.agg(F.sum(n)).first()[0] or 0, least)
    return list({r[0]: -(-r[1] // floor) for r in counts.where(F.col(n) > floor).select(key, n).orderBy(n).collect()}.items())


def join_unique(big: DataFrame, unique: DataFrame, key: str, spread: str, how: str = "inner", least: int = HOT_LEAST, counts: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """big join unique on key, where unique has one row (or few) a key and big may have hot keys.

    The list of hot keys is bounded by HOT_SHARE, so it is gathered and broadcast.  Rows of a hot
    key in `big` are dealt by a hash of `spread` over as many tasks as its count asks for, and only
    its rows in `unique` are repeated as often.  A caller that has written the rows a key already
    gives them as `counts` (key, n).  Rows also have to agree in the columns `also`, which need not
    be spread.  Columns of other names are kept, whatever they are called.
    """
    hot = hot_keys(big.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts, key, "n", least)
    if not hot:
        return big.join(unique, [key, *also], how)
    salt, tasks = (fresh(x, big, unique) for x in ("_salt", "_tasks"))
    listed = F.broadcast(big.sparkSession.createDataFrame(hot, T.StructType([T.StructField(key, big.schema[key].dataType), T.StructField(tasks, T.IntegerType())])))
    nulls = next((n for k, n in hot if k is None), 1)  # they match nothing, but are rows of the result too
    shares = F.when(F.col(key).isNull(), nulls).otherwise(F.coalesce(tasks, F.lit(1)))
    dealt = big.join(listed, key, "left").withColumn(salt, F.pmod(F.xxhash64(spread), shares).cast("int")).drop(tasks)
    repeated = unique.join(listed, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(tasks, F.lit(1)) - 1))).drop(tasks)
    return dealt.join(repeated, [key, *also, salt], how).drop(salt)


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores before it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str, most: int = 500_000) -> DataFrame:
    """Semi or anti join with a written table of ids, broadcast only if it has at most `most` rows."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, how)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the undirected edges; component is the smallest node reachable.

    Each round lets every root point to its smallest neighbour, follows the
    pointers to their ends and relabels the edges, so the graph shrinks and
    nothing but counts reaches the driver.  The smallest neighbour is a
    combinable minimum, so a hub costs no more than other nodes.
    """
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    edges = materialise(edges, "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("r"), F.least("a", "p").alias("p"))
        parent = materialise(parent, "parent")
        while True:  # pointers only go to smaller nodes, so this ends
            up = parent.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            jumped = join_unique(parent, up, "p", "r", "left").select("r", F.coalesce("pp", "p").alias("p2"), "p")
            jumped = materialise(jumped, "jump")
            moved = not jumped.where("p2 <> p").isEmpty()
            parent = jumped.select("r", F.col("p2").alias("p"))
            if not moved:
                break
        to = parent.select(F.col("r").alias("component"), F.col("p").alias("_p"))
        labels = materialise(join_unique(labels, to, "component", "node", "left").select("node", F.coalesce("_p", "component").alias("component")), "labels")
        for end, other in (("a", "b"), ("b", "a")):
            to = parent.select(F.col("r").alias(end), F.col("p").alias("_p"))
            edges = join_unique(edges, to, end, other, "left").withColumn(end, F.coalesce("_p", end)).drop("_p")
        edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    return labels
