"""Embedding whitening by hierarchical SVD merging.

Every task sums its rows up as their number, their sums (whole numbers, so exact), and all singular values and right
singular vectors of the rows less their mean. Two summaries merge without loss: their scaled vectors and one row for the
difference of the means have the scatter matrix of all rows, and are decomposed again. Summaries are merged in a tree of
Spark jobs; what reaches the driver is one summary, whose size is a matter of the dimension alone.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import discard, slices, stored
from parlance.llm.vectors import complete, floors, lists, matrix

#: An entry c counts as floor(SCALE * c) + SHIFT; entries saturate where that is BOUND either way.
SCALE, SHIFT, BOUND = 1024, 100_000, 2**40
COMPONENTS = 8
#: Rows decomposed at once, and the bytes of summaries that one task of a merge holds.
BLOCK_ROWS, MERGE_BYTES = 4096, 256 << 20


@dataclass(frozen=True)
class Summary:
    """n rows, the exact sums of their entries, and the singular values and vectors (as rows) of the rows less their mean."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """Of a block of whole numbers. The mean's whole part is taken off before anything is rounded."""
        n, sums = len(x), tuple(int(s) for s in x.sum(0))
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([(s % n) / n for s in sums])
        return Summary(n, sums, *decomposed((x - whole).astype(np.float64) - rest))

    def merged(self, other: Summary) -> Summary:
        """The summary of the rows of both."""
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        correction = math.sqrt(self.n / n * other.n) * apart
        rows = np.concatenate([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, correction[None]])
        return Summary(n, tuple(a + b for a, b in zip(self.sums, other.sums)), *decomposed(rows))


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right singular vectors of ``rows``, by way of their triangular factor if there are many."""
    tall = len(rows) > 2 * rows.shape[1]
    _, values, vectors = np.linalg.svd(np.linalg.qr(rows, mode="r") if tall else rows, full_matrices=False)
    return values, vectors


def merged(summaries: Iterable[Summary]) -> Summary:
    return functools.reduce(Summary.merged, summaries)


SUMMARY = "part long, n long, sums array<decimal(38,0)>, values array<double>, vectors array<double>"


def as_row(part: int, s: Summary) -> dict:
    return {"part": part, "n": s.n, "sums": [Decimal(x) for x in s.sums], "values": s.values.tolist(), "vectors": s.vectors.ravel().tolist()}


def from_row(row) -> Summary:
    sums = tuple(int(x) for x in row["sums"])
    values = np.asarray(row["values"], np.float64)
    return Summary(int(row["n"]), sums, values, np.asarray(row["vectors"], np.float64).reshape(len(values), len(sums)))


@dataclass(frozen=True)
class Whitening:
    """n, the exact sums, and components by falling eigenvalue: unit vectors as rows, variances, and the sum of all variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def summary(rows: DataFrame, d: int) -> Summary | None:
    """The merged summary of ``rows`` (vector: ``d`` finite entries); None without rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Summary | None = None
        for batch in slices(batches, BLOCK_ROWS):
            if batch.num_rows:
                here = Summary.of(floors(matrix(batch.column(0), d), SCALE, BOUND) + SHIFT)
                own = here if own is None else own.merged(here)
        if own is not None:
            row = as_row(TaskContext.get().partitionId(), own)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    fan = max(2, min(16, MERGE_BYTES // (8 * d * d)))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        told = sorted(group.to_dict("records"), key=lambda r: r["part"])
        return pd.DataFrame([as_row(told[0]["part"] // fan, merged(from_row(r) for r in told))])

    level = stored(rows.select("vector").mapInArrow(summed, SUMMARY), "summaries")
    while level.limit(2).count() > 1:
        above = stored(level.groupBy(F.floor(F.col("part") / fan)).applyInPandas(merge, SUMMARY), "summaries")
        discard(level)
        level = above
    last = level.first()
    discard(level)
    return from_row(last) if last else None


def fit(rows: DataFrame, d: int) -> Whitening | None:
    """The whitening of all ``rows``; None without rows. A component's greatest entry is positive. All components of the data are
    there, those without variance left out."""
    s = summary(rows, d)
    if s is None:
        return None
    live = s.values > s.values[0] * max(s.n, d) * np.finfo(float).eps if s.values[0] > 0 else np.zeros(len(s.values), bool)
    vectors = s.vectors[live]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]) if len(vectors) else np.zeros(0)
    return Whitening(s.n, s.sums, vectors * signs[:, None], s.values[live] ** 2 / s.n, float((s.values**2).sum() / s.n))


def projected(rows: DataFrame, model: Whitening, d: int, k: int) -> DataFrame:
    """vec_id, deviation and the array ``whitened`` of the first ``k`` components of each row."""
    n, sums, most = model.n, model.sums, math.isqrt((2**63 - 1) // d)
    rotation = (model.components[:k] / np.sqrt(model.variances[:k])[:, None]).T
    centre = np.array(sums, np.int64) if max(map(abs, sums)) < 2**62 else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_ROWS):
            x = floors(matrix(batch.column(1), d), SCALE, BOUND) + SHIFT
            if centre is not None and len(x) and int(np.abs(x).max()) * n < 2**62:
                off = n * x - centre
                small = int(np.abs(off).max()) <= most
                deviation = (off * off).sum(1).tolist() if small else [sum(int(v) ** 2 for v in row) for row in off]
                away = off / n
            else:
                exact = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
                deviation = [sum(v * v for v in row) for row in exact]
                away = np.array([[v / n for v in row] for row in exact]).reshape(len(x), d)
            deviation = [v if v < 2**63 else None for v in deviation]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists(away @ rotation, pa.float64())], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "vector").mapInArrow(scan, "vec_id long, deviation long, whitened array<double>")


def identity_error(table: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened``, less the identity; centred before multiplying."""
    if not k:
        return 0.0
    at = [F.col("whitened")[i] for i in range(k)]
    means = table.agg(*[(F.sum(w) / n).alias(f"m{i}") for i, w in enumerate(at)]).first()
    off = [w - F.lit(m) for w, m in zip(at, means)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = table.agg(*[F.abs(F.sum(off[i] * off[j]) / n - float(i == j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(found)


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each kept row and of its first ``k`` components.

    Rows whose vector is null, empty or holds null or non-finite entries, and those of an odd length (see
    :func:`parlance.llm.vectors.complete`), are dropped and count nowhere. Repeated rows and ids, and null ids, each have
    their rows. There are as many components as the data vary in, so one row, or equal rows, have none and give nothing.
    Components of equal variance are any orthonormal ones of their space, the same for all rows. A deviation that doesn't fit
    in 64 bits is null. Other columns are ignored. Kept rows are read twice; projections are written to the shared folder.
    """
    rows, d = complete(embeddings, id_column, vector_column)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, d) if d else None
    if model is None or not len(model.variances):
        return embeddings.sparkSession.createDataFrame([], schema)
    k = min(k, len(model.variances))
    table = stored(projected(rows, model, d, k), "whitened")
    error = identity_error(table, model.n, k)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances[:k]])
    each = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
