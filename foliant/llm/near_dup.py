"""Near-duplicate detection with bottom-k sketches.

1. Every text becomes its set of distinct word shingles, hashed once to 63 bits.
   Of the set its size, a digest and its k smallest hashes (the bottom-k sketch)
   are kept.  Texts with equal digests form a class, and one document stands
   for it from here on.
2. Inverted lists of the retained values tell how many values of a sketch other
   sketches have too.  Two sets with the wanted similarity share at least
   ``least_hits`` of them, so most documents drop out here.
3. Of the others the whole sets are kept.  A set with too many values that no
   other one has cannot reach the similarity and drops out as well.
4. The inverted lists of what is left generate the overlaps.  A document is
   listed by the rarest values of its sketch, just so many that two similar
   documents meet; what a great many documents share lists nobody.
5. In each list every document meets one hub, the document with the fewest
   values of its own: one pair a row, however long the list.  The bottom-k
   sketch of the union estimates the similarity and drops most false pairs, the
   full sets confirm the others, and links join documents into components.
6. Lists that still span several components chain into clusters, and inside a
   cluster the remaining pairs are compared on their full sets by ``spanning``:
   only documents outside the cluster's largest component ask, as a pair of
   different components has one of them.  Clusters are cut into cells of a
   bounded number of documents and values, and a cell gives at most one link for
   each component that it joins, never the pairs of a group.

With sketches a link is missed with a probability of LOSS at most for sets
exactly at the threshold (less above it).  ``exact=True`` retains whole sets and
estimates nothing: it misses nothing and moves every shingle.  No list, group
or cell is cut short on either way.

Nulls and empty texts have no shingles and link with nothing.  Rows with a
null id get no component and are kept.  Rows that share an id are one node:
they get the same component.  Repeated rows and ties have equal digests, and
the smallest id wins.  An empty table gives an empty result.  Other columns of
the input are ignored, whatever they are called.  A text of any length is one
row of its shingles' hashes (8 bytes each), so it has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import components, join_ids, join_unique, list_values, map_rows, materialise

#: The probability of losing a link at the threshold, in each place that estimates.
LOSS = 3e-9
#: Values that the estimate of a pair reads of each set.
WIDE = 192


def least_hits(k: int, percent: int) -> int:
    """The number of common values that k values of a union have at least, but for LOSS, at `percent` similarity."""
    p, tail = percent / 100, 0.0
    for hits in range(k + 1):
        tail += math.comb(k, hits) * p**hits * (1 - p) ** (k - hits)
        if tail > LOSS:
            return hits
    return k


def sketch_size(percent: int) -> int:
    """Values to retain of a set: 48, or more where few of them are common."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    return max(48, math.ceil(40 / (percent / 100)))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width_here = min(width, len(h))
    out = np.full(len(h) - width_here + 1, width_here, np.uint64)
    for j in range(width_here):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width_here + 1 + j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique((out >> np.uint64(1)).astype(np.int64))


def sketches(df: DataFrame, k: int | None, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, digest, sketch) of every row; the digest is null without shingles, k None retains all."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def make():
        def one(key, text):
            h = shingle_hashes(text, width)
            return key, len(h), blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None, h[:k].tolist()

        return one

    return map_rows(df, [F.col(id_col).cast("long"), F.col(text_col)], make, schema)


def least_shared(n: Column, k: int | None, percent: int) -> Column:
    """Retained values that a set of n shares at least with a similar one."""
    exact = F.ceil(n * percent / 100).cast("int")
    # A partner of a set this small is retained whole as well.
    return exact if k is None else F.when(n <= k * percent // 100, exact).otherwise(F.lit(least_hits(k, percent)))


def with_own(sets: DataFrame, values: str, several: DataFrame) -> DataFrame:
    """sets with `own`, the number of values that no other row has; 0 for documents of `several` texts.

    Lists of one document name it at once, so no list is joined back.
    """
    postings = sets.select(F.explode(values).alias("v"), "doc")
    own = postings.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("doc")).where("m = 1").groupBy("doc").agg(F.count(F.lit(1)).alias("own"))
    return sets.join(own.join(several, "doc", "left_anti"), "doc", "left").withColumn("own", F.coalesce("own", F.lit(0)))


def with_partners(reps: DataFrame, several: DataFrame, k: int | None, percent: int) -> DataFrame:
    """Ids of the documents whose sketch shares enough values with other sketches."""
    shared = F.size("sketch") - F.col("own")
    found = with_own(reps.withColumnRenamed("doc_id", "doc"), "sketch", several)
    return found.where(shared >= least_shared(F.col("n"), k, percent)).select(F.col("doc").alias("id")).distinct()


def whole_sets(df: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, s) with the sorted hashes of the given documents."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])

    def make():
        def one(key, text):
            h = shingle_hashes(text, width)
            return (key, len(h), h.tolist()) if len(h) else None

        return one

    return map_rows(join_ids(texts, ids, "id", "left_semi"), ["id", "t"], make, schema)


def linkable(sets: DataFrame, several: DataFrame, percent: int) -> DataFrame:
    """The sets (doc, n, own, s) but for those with too many values of their own to reach the similarity."""
    return with_own(sets, "s", several).where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")).select("doc", "n", "own", "s")


def inverted_lists(sets: DataFrame, k: int | None, percent: int) -> DataFrame:
    """(v, doc, n, own): each document under the rarest retained values of its set, as far as other sets have them."""
    kept = F.col("s") if k is None else F.slice("s", 1, k)
    postings = sets.select("doc", "n", "own", F.size(kept).alias("k"), F.explode(kept).alias("v"))
    counts = materialise(postings.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    listed = join_unique(postings, counts.withColumnRenamed("n", "len"), "v", "doc", counts=counts)
    rare = listed.groupBy("doc", "n", "own", "k").agg(F.sort_array(F.collect_list(F.struct("len", "v"))).alias("vs"))  # at most the retained values
    # k values, the least m of them shared: two similar documents meet in their k - m + 1 rarest.  Values of its own come first.
    reach = F.col("k") - least_shared(F.col("n"), k, percent) + 1 - (F.col("k") - F.size("vs"))
    return rare.where(reach > 0).select("doc", "n", "own", F.explode(F.slice("vs", F.lit(1), reach.cast("int"))).alias("x")).select("x.v", "doc", "n", "own")


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, estimate: bool = True) -> DataFrame:
    """The pairs (a, b) that the sketch of the union leaves and whose full sets have the similarity.

    Wide sketches are whole sets for most short texts; only pairs of longer
    ones that pass the estimate fetch the full sets.
    """

    def side(x: str, s: Column) -> DataFrame:
        return sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), s.alias(f"s{x}"))

    def exact() -> Column:
        shared = F.size(F.array_intersect("sa", "sb"))
        return 100 * shared >= percent * (F.col("na") + F.col("nb") - shared)

    sizes = sets.select("doc", "n")
    near = pairs.join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
    near = materialise(near.where(similar_sizes(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct(), "pairs")
    whole = F.col("s")
    if not estimate:
        return join_unique(join_unique(near, side("b", whole), "b", "a"), side("a", whole), "a", "b").where(exact()).select("a", "b").distinct()
    wide = F.slice("s", 1, WIDE)
    both = join_unique(join_unique(near, side("b", wide), "b", "a"), side("a", wide), "a", "b")
    short = F.greatest("na", "nb") <= WIDE
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.slice(F.sort_array(F.array_union("sa", "sb")), 1, WIDE)))
    left = materialise(both.where(F.when(short, exact()).otherwise(shared >= least_hits(WIDE, percent))).select("a", "b", short.alias("done")).distinct(), "left")
    long = join_unique(join_unique(left.where("not done").select("a", "b"), side("b", whole), "b", "a"), side("a", whole), "a", "b")
    return left.where("done").select("a", "b").union(long.where(exact()).select("a", "b")).distinct()


def cells(members: DataFrame, docs: int, values: int) -> DataFrame:
    """members (cluster, doc, n, component) dealt into cells (cluster, i, j), with the parts a document plays there.

    Documents outside a cluster's largest component ask, all of them answer.
    Askers are cut into blocks i and answerers into blocks j by a hash, so that a
    block has about `docs` documents and `values` values; each pair of an asker
    and an answerer meets in one cell.
    """
    sizes = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    top = sizes.groupBy("cluster").agg(F.max(F.struct("m", "t", "component")).alias("top"), F.sum("m").alias("m"), F.sum("t").alias("t"))
    blocks = lambda m, t: F.greatest(F.ceil(m / docs), F.ceil(t / values), F.lit(1)).cast("int")
    dealt = top.select("cluster", F.col("m").alias("n"), F.col("top.component").alias("most"), blocks(F.col("m") - F.col("top.m"), F.col("t") - F.col("top.t")).alias("rows"), blocks(F.col("m"), F.col("t")).alias("cols"))
    dealt = materialise(dealt, "blocks")
    told = join_unique(members, dealt.drop("n"), "cluster", "doc", counts=dealt)
    at = F.xxhash64("doc", F.lit(1))
    told = told.withColumn("asker", F.col("component") != F.col("most")).withColumn("row", F.pmod(at, "rows").cast("int")).withColumn("col", F.pmod(at, "cols").cast("int"))
    answers = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("col").alias("j"), (F.col("asker") & (i == F.col("row"))).alias("asks"), F.lit(True).alias("answers")))
    asks = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: F.struct(F.col("row").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("answers")))
    asks = F.when(F.col("asker"), F.filter(asks, lambda x: x["j"] != F.col("col"))).otherwise(F.slice(asks, 1, 0))
    return told.select("cluster", "component", "doc", "n", F.explode(F.concat(answers, asks)).alias("x")).select("cluster", "x.i", "x.j", "x.asks", "x.answers", "component", "doc", "n")


def cell_links(percent: int, component: np.ndarray, asks: np.ndarray, answers: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of components of a cell that similar sets join: a spanning forest of them."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids, ends = ids.astype(np.int32), np.cumsum(sizes)
    common = np.bincount(ids, minlength=len(values))[ids] > 1  # nobody else has the others
    before = np.concatenate([[0], np.cumsum(common)])
    begins, ends = before[ends - sizes], before[ends]
    ids = ids[common]
    able = 100 * (ends - begins) >= percent * sizes
    answer = np.flatnonzero(answers & able)
    flat = np.concatenate([ids[begins[i] : ends[i]] for i in answer]) if len(answer) else ids[:0]
    stops = np.cumsum(ends[answer] - begins[answer])
    starts = stops - (ends[answer] - begins[answer])
    label, mark, out = component.copy(), np.zeros(len(values), bool), []
    for a in np.flatnonzero(asks & able):
        n = sizes[answer]
        todo = (label[answer] != label[a]) & (100 * np.minimum(n, sizes[a]) >= percent * np.maximum(n, sizes[a]))
        if not todo.any():
            continue
        mine = ids[begins[a] : ends[a]]
        mark[mine] = True
        total = np.concatenate([[0], np.cumsum(mark[flat], dtype=np.int64)])
        mark[mine] = False
        shared = total[stops] - total[starts]
        for b in answer[todo & (100 * shared >= percent * (n + sizes[a] - shared))]:
            if label[b] != label[a]:
                out.append((int(component[a]), int(component[b])))
                label[label == label[b]] = label[a]
    return out


def spanning(members: DataFrame, sets: DataFrame, percent: int, docs: int = 1024, values: int = 2_000_000) -> DataFrame:
    """(a, b): links between the components of each cluster, at most one for each component in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        cell = None

        def links() -> pa.RecordBatch:
            asks, answers, component, sets = zip(*held, strict=True)
            found = cell_links(percent, np.array(component, np.int64), np.array(asks), np.array(answers), list(sets))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            names = [batch.column(i).to_pylist() for i in range(6)]
            for *key, asks, answers, component, s in zip(*names, list_values(batch.column(6)), strict=True):
                if key != cell:
                    if held:
                        yield links()
                    held, cell = [], key
                held.append((asks, answers, component, s.copy()))
        if held:
            yield links()

    dealt = cells(members, docs, values).join(sets.select("doc", "n", "s"), ["doc", "n"]).select("cluster", "i", "j", "asks", "answers", "component", "s")
    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; sets are linked from `percent` similarity on."""
    k = None if exact else sketch_size(percent)
    rows = materialise(sketches(df, k, width, id_col, text_col), "sketches")
    with_set = rows.where("digest is not null and doc_id is not null")
    classes = materialise(with_set.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = with_set.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest"])
    reps = materialise(reps.select("doc_id", "n", "sketch"), "reps")
    shared_ids = with_set.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    several = materialise(shared_ids.select(F.col("doc_id").alias("doc")), "several")
    ids = materialise(with_partners(reps, several, k, percent), "ids")
    sets = materialise(whole_sets(df, ids, width, id_col, text_col), "sets")
    if sets.count() > ids.count():  # rows that share an id
        sets = materialise(sets.distinct(), "sets")
    sets = materialise(linkable(sets, several, percent), "linkable")
    lists = materialise(inverted_lists(sets, k, percent), "lists")

    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(min(percent, 99) / 100))
    banded = lists.withColumn("list", F.xxhash64("v", band))
    hubs = materialise(banded.groupBy("list").agg(F.min(F.struct("own", "doc")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    met = join_unique(banded.select("list", F.col("doc").alias("b")), hubs.select("list", F.col("hub.doc").alias("a")), "list", "b", counts=hubs.select("list", "n"))
    links = confirm(met.where("a <> b").select("a", "b").distinct(), sets, percent, not exact)
    # Rows that share an id but not a text tie their classes together.
    ties = with_set.join(several.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(links.union(ties).where("a <> b"))

    told = materialise(lists.select("v", "doc").join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "told")
    several = told.groupBy("v").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("x < y")
    several = materialise(several.select("v", "first", "n"), "several")
    open_ = materialise(join_unique(told, several.select("v", "first"), "v", "doc", counts=several.select("v", "n")), "open")
    clusters = components(open_.select(F.col("doc").alias("a"), F.col("first").alias("b")))
    # A list that spans several components has two documents at least, so all of its documents are nodes.
    members = open_.select("doc", "component").distinct().join(clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc")
    members = materialise(members.join(sets.select("doc", "n"), "doc").distinct(), "members")
    more = components(spanning(members, sets, percent))
    if not more.isEmpty():
        to = more.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        moved = join_unique(labels, to, "component", "node", "left").select("node", F.coalesce("_to", "component").alias("component"))
        labels = materialise(moved.union(more.join(labels.select("node"), "node", "left_anti").select("node", "component")), "labels")

    # Only classes that are linked or have copies need a lookup.
    linked = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or component is not null")
    linked = materialise(linked.select("digest", F.coalesce("component", "rep").alias("component"), "copies"), "linked")
    out = join_unique(rows.select("doc_id", "n", "digest"), linked.drop("copies"), "digest", "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
