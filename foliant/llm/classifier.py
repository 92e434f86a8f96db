"""Quality scores from random Fourier features, ridge regression and isotonic calibration.

Document statistics are standardised and mapped by random Fourier features,
whose inner products approximate a Gaussian kernel.  Each partition sums its
part of the normal equations, parts are added FAN at a time until a few are
left, and the driver solves one small system for each left-out fold and one for
all folds.  Scores
of rows that a model has not seen are counted in bins, and pool-adjacent
violators turn the bins into a monotone map from raw score to probability.

The statistics read the text alone: no id, language, source or label.
Nulls: a null text counts as an empty one, and empty texts are scored too.  A
null id is not held out.  Label rows without a label or document are left out;
several labels of one document all count, and so do all rows that share an id.
Equal texts get equal scores.  Without any label, as with empty tables, every
score is 0.5.  Other columns are kept whatever they are called.  A text of any
length is read whole, one row at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import fresh, map_rows, materialise
from foliant.llm.quality_rules import Doc

#: Partial sums that one task adds up; each has about half a megabyte.
FAN = 16

STATISTICS = (
    "log_words", "mean_word", "upper", "symbols", "no_letters", "digits", "exclaims", "commas", "stops", "distinct",
    "top_word", "same_next", "repeated", "dup_lines", "line_words", "short_words", "long_words", "capitalised",
)


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS, finite for every text."""
    d = Doc(text)
    words, n = d.words, max(d.n_words, 1)
    counts = Counter(words)
    chars = max(d.word_chars, 1)
    return [
        log1p(d.n_words), d.word_chars / n, d.n_upper / max(d.n_letters, 1), min(d.n_symbols / n, 4.0), 1 - d.n_letter_words / n,
        sum(map(d.text.count, "0123456789")) / chars, min(d.text.count("!") / n, 4.0), min(d.text.count(",") / n, 4.0), min(d.text.count(".") / n, 4.0),
        len(counts) / n**0.75, max(counts.values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n, d.n_repeat_words / n, d.n_dup_lines / max(d.n_lines, 1),
        log1p(d.n_words / max(d.n_lines, 1)), sum(len(w) <= 3 for w in words) / n, sum(len(w) > 12 for w in words) / n, sum(w[0].isupper() for w in words) / n,
    ]


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.FloatType()))])
    return map_rows(df, [F.col(id_col), F.col(text_col)], lambda: lambda key, text: (key, statistics(text)), schema)


def fold_of(doc_id: Column) -> Column:
    """0 to 4; fold 0 is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)).cast("int"), F.lit(0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of the statistics, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.lift(x) @ self.weights, self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points x (rising) with n rows, y of them positive: block centres and means."""
    blocks: list[list[float]] = []
    for xi, ni, yi in zip(x, n, y, strict=True):
        blocks.append([xi * ni, ni, yi])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), len(STATISTICS)).astype(np.float64)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", features: int = 256, ridge: float = 1e-3, bins: int = 2048, seed: int = 11) -> Model:
    """A model from `stats` (doc_id, x) and the labels of rows outside fold 0.

    Means and scales come from all rows of `stats`.  All labelled rows count;
    the driver gets at most FAN partial sums for each fold and `bins` bin counts.
    """
    d = len(STATISTICS)
    both = stats.agg(*(f(F.col("x")[i].cast("double")).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([both[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([both[f"s{i}"] or 0.0 for i in range(d)])
    rng = np.random.default_rng(seed)
    blank = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(d, features)) / np.sqrt(d / 2), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(0), np.zeros(0))

    train = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("y is not null").withColumn("fold", fold_of(F.col("doc_id"))).where("fold <> 0")
    train = materialise(stats.join(train, "doc_id").select("x", "y", "fold"), "train")
    width = features + 1

    def sums(batches):
        from pyspark import TaskContext

        a, b = np.zeros((5, width, width)), np.zeros((5, width))
        for batch in batches:
            z, y, fold = blank.lift(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in np.unique(fold):
                at = fold == f
                a[f] += z[at].T @ z[at]
                b[f] += z[at].T @ y[at]
        part = TaskContext.get().partitionId()
        for f in np.flatnonzero(a[:, -1, -1]):
            yield pa.RecordBatch.from_arrays([pa.array([int(f)], pa.int32()), pa.array([part], pa.int32()), pa.array([np.concatenate([a[f].ravel(), b[f]]).tobytes()], pa.binary())], ["fold", "part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf.sort_values("part")["sums"])
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN, "sums": [total.tobytes()]})

    parts = train.mapInArrow(sums, "fold int, part int, sums binary")
    left = (train.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    while left > FAN:
        parts, left = parts.groupBy("fold", F.floor(F.col("part") / FAN)).applyInPandas(add, "fold int, part int, sums binary"), -(-left // FAN)
    per_fold: dict[int, np.ndarray] = {}
    for row in sorted(parts.collect(), key=lambda r: (r["fold"], r["part"])):
        per_fold[row["fold"]] = per_fold.get(row["fold"], 0) + np.frombuffer(row["sums"])
    if not per_fold:
        return blank

    def solve(folds) -> np.ndarray:
        total = sum(per_fold[f] for f in folds)
        a, b = total[: width * width].reshape(width, width), total[width * width :]
        return np.linalg.solve(a + ridge * max(a[-1, -1], 1) * np.eye(width) / features, b)

    others = {f: solve([g for g in per_fold if g != f] or [f]) for f in per_fold}

    def count(batches):
        n, y = np.zeros(bins, np.int64), np.zeros(bins)
        for batch in batches:
            z, label_, fold = blank.lift(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                bin_ = np.clip(((z[at] @ others[f] + 0.5) / 2 * bins).astype(int), 0, bins - 1)
                n += np.bincount(bin_, minlength=bins)
                y += np.bincount(bin_, label_[at], minlength=bins)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(y[at])], ["bin", "n", "y"])

    hist = train.mapInArrow(count, "bin int, n long, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    centre = (np.array([r["bin"] for r in hist]) + 0.5) / bins * 2 - 0.5
    knots, values = isotonic(centre, np.array([float(r["n"]) for r in hist]), np.array([r["y"] for r in hist]))
    return Model(blank.mean, blank.scale, blank.directions, blank.phases, solve(per_fold), knots, values)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of `stats`."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df, with all their columns, whose text scores the threshold or more by a model of df and labels.

    The statistics are written beside the rows, so they are made once.
    """

    @F.pandas_udf("array<float>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.array(statistics(t), np.float32))

    name = fresh("_statistics", df)
    marked = materialise(df.withColumn(name, measured(F.coalesce(text_col, F.lit("")))), "marked")
    model = fit(marked.select(F.col(id_col).alias("doc_id"), F.col(name).alias("x")), labels, **options)

    @F.pandas_udf("boolean")
    def good(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_list()).astype(np.float64)) >= threshold if len(x) else [], dtype=bool)

    return marked.where(good(F.col(name))).select(*df.columns)
