"""Whitening of embeddings by principal components from a compensated covariance.

Entries become integers (floor of SCALE times the entry), so that equal vectors are equal bytes and sums are exact. The fit
list is every distinct vector once. Its covariance adds up centred outer products as unevaluated sums of two doubles:
a block of centred rows (high and low parts) is cut into slices of SLICE_BITS bits whose products over BLOCK rows are exact
in one double, and each exact product goes into the high and low parts by error-free additions. Tasks send their high and
low parts for each row of the matrix, which are merged the same way, in two steps. The matrix has the size of the
embedding and is decomposed by numpy's symmetric solver, which reduces it to tridiagonal form and divides and conquers.

Edge cases: rows whose vector is null or holds a null or non-finite entry are dropped; a shorter vector counts as filled
up with zeros, an empty one as zeros alone; scaled entries beyond 2^53 are held at that bound; with no rows left the
result is empty. A component without variance (rank too low, one distinct vector) has a null whitened value, and takes no
part in identity_error; explained is 0 where there is no variance at all; deviation is null where it does not fit a long.
Repeated rows and repeated or null vec_ids give as many rows as they are; equal eigenvalues give one of their bases, the
same for all rows; the largest entry of a component by size is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import materialize

SCALE = 256
MOST = 2.0**53
BLOCK, SLICE_BITS, SLICES = 2048, 21, 5  # 2 * 21 bits and 2048 rows make 53 bits; 5 slices hold a high and a low part
MERGES = 64  # groups of tasks whose parts are merged first


def two_sum(a, b):
    """(s, e): s is a + b rounded and s + e is a + b exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high, low, more):
    """A sum in two parts and a double (or a second sum's part): the new parts."""
    s, e = two_sum(high, more)
    return two_sum(s, low + e)


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their scaled entries as a matrix of floats that are integers)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), lengths)
    matrix = np.zeros((len(vectors), width))
    with np.errstate(invalid="ignore", over="ignore"):
        matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.clip(np.floor(flat * SCALE), -MOST, MOST)
    good = pc.is_valid(vectors).to_numpy(zero_copy_only=False).copy()
    good[row[~np.isfinite(flat)]] = False
    return np.flatnonzero(good), matrix[good] + 0.0


def pack(matrix: np.ndarray) -> list[bytes]:
    """Rows as bytes, two for each entry where all of a row fit and eight elsewhere; equal rows are equal bytes."""
    small = np.abs(matrix).max(axis=1, initial=0) < 2**15
    return [r.astype("<i2" if s else "<i8").tobytes() for r, s in zip(matrix, small)]


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(rows), width))
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, "<i2" if len(r) == 2 * width else "<i8")
    return out


def slices(high: np.ndarray, low: np.ndarray, top: np.ndarray) -> list[np.ndarray]:
    """high + low as a sum of SLICES matrices; in slice s (from 0) the entries of column j are multiples of 2^(top_j - SLICE_BITS * (s + 1))."""
    out = []
    for s in range(SLICES):
        step = np.ldexp(0.75, top - SLICE_BITS * (s + 1) + 53)  # adding and taking away rounds to a multiple of the unit
        part = (high + step) - step
        out.append(part)
        high, low = two_sum(high - part, low)  # the difference is exact
    return out


def outer_products(high: np.ndarray, low: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """total (two parts) plus the products of all columns of the rows high + low with each other."""
    for at in range(0, len(high), BLOCK):
        h, r = high[at : at + BLOCK], low[at : at + BLOCK]
        top = np.frexp(np.abs(h).max(axis=0, initial=0))[1] + 1
        cut = slices(h, r, top)
        for a in range(SLICES):
            for b in range(a, SLICES - a):
                product = cut[a].T @ cut[b]  # exact: integers below 2^53 times a unit
                total = add(*total, product)
                if a != b:
                    total = add(*total, product.T)
    return total


@dataclass(frozen=True)
class Whitener:
    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # components as columns
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Which components have variance, beyond the solver's rounding."""
        return self.values > len(self.values) * np.finfo(float).eps * max(self.values[0], 0.0)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean in two parts."""
        exact = [Fraction(s, self.n) for s in self.sums]
        high = np.array([float(m) for m in exact])
        return high, np.array([float(m - Fraction(h)) for m, h in zip(exact, high)])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = self.centre()
        s, e = two_sum(x, -high)
        return two_sum(s, e - low)

    def project(self, x: np.ndarray, count: int) -> np.ndarray:
        """Whitened values of the first components; those without variance are not a number."""
        high, low = self.centred(x)
        root = np.sqrt(np.where(self.usable, self.values, np.nan))[:count]
        return (high @ self.vectors[:, :count] + low @ self.vectors[:, :count]) / root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2 over the entries of each row."""
        sums = np.array(self.sums, object)
        most = len(sums) * (self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)) ** 2
        kind = np.int64 if most < 2**63 else object
        whole = x.astype(np.int64).astype(kind) * self.n - sums.astype(kind)
        return [int(d) if d < 2**63 else None for d in (whole * whole).sum(axis=1)]


def _merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the two-part rows (high, low) of each group, in the order of their tasks."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        high, low = np.array(pdf["high"].iloc[0]), np.array(pdf["low"].iloc[0])
        for h, r in zip(pdf["high"].iloc[1:], pdf["low"].iloc[1:]):
            high, low = add(high, low, h)
            high, low = two_sum(high, low + r)
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "task": [pdf["task"].iloc[0]], "high": [high], "low": [low]})

    return parts.groupBy(*keys).applyInPandas(merge, "i int, task long, high array<double>, low array<double>")


def _covariance(vectors: DataFrame, run, width: int) -> np.ndarray:
    """The summed outer products (two parts, rounded at the end) of what run(batch) gives for the vectors of each batch."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = (np.zeros((width, width)), np.zeros((width, width)))
        for pdf in batches:
            total = outer_products(*run(pdf["x"].tolist()), total)
        task = TaskContext.get().partitionId()
        yield pd.DataFrame({"i": range(width), "task": task, "high": list(total[0]), "low": list(total[1])})

    parts = vectors.mapInPandas(add_up, "i int, task long, high array<double>, low array<double>")
    some = _merged(parts.withColumn("share", F.col("task") % MERGES), ["i", "share"])
    out = np.zeros((width, width))
    for r in _merged(some, ["i"]).collect():  # a row for each dimension
        out[r.i] = np.array(r.high) + np.array(r.low)
    return out


def fit(df: DataFrame, column: str = "embedding", count: int = 4) -> tuple[Whitener | None, float | None]:
    """(whitener of the distinct scaled vectors, largest absolute entry of the whitened covariance minus the identity over `count` components)."""
    width = df.agg(F.max(F.size(column))).first()[0] or 0
    width = max(width, 0)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integers(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array(pack(x), pa.binary())], ["x"])

    distinct = materialize(df.select(F.col(column).alias("v")).mapInArrow(scale, "x binary").distinct())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(width, object)
        for pdf in batches:
            x = unpack(pdf["x"].tolist(), width).astype(np.int64)
            n, total = n + len(pdf), total + (x >> 20).sum(axis=0).astype(object) * 2**20 + (x & 2**20 - 1).sum(axis=0)
        if n:
            yield pd.DataFrame({"i": range(-1, width), "s": [str(n), *map(str, total)]})

    found = {r.i: int(r.s) for r in distinct.mapInPandas(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n = found.get(-1, 0)
    if not n or not width:
        return None, None
    first = Whitener(n, tuple(found[i] for i in range(width)), np.zeros(width), np.eye(width), 0.0)
    covariance = _covariance(distinct, lambda rows: first.centred(unpack(rows, width)), width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(width)])
    model = Whitener(n, first.sums, values, vectors, float(np.trace(covariance)))
    used = int(model.usable[:count].sum())
    if not used:
        return model, 0.0
    # the whitened rows are centred as x is; a column of ones gives what is left of their sums
    whitened = lambda rows: np.column_stack([model.project(unpack(rows, width), used), np.ones(len(rows))])
    second = _covariance(distinct, lambda rows: (w := whitened(rows), np.zeros_like(w)), used + 1) / n
    rest = second[:used, :used] - np.outer(second[:used, used], second[:used, used])
    return model, float(np.abs(rest - np.eye(used)).max())


def whiten(df: DataFrame, count: int = 4, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each counted row and each of the first `count` components."""
    model, error = fit(df, column, count)
    kept = 0 if model is None else min(count, len(model.values))

    @F.pandas_udf("array<struct<component int, deviation long, whitened double>>")
    def run(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        if kept:
            rows, x = integers(pa.array(vectors.tolist(), pa.list_(pa.float64())), len(model.values))
            for i, d, w in zip(rows, model.deviations(x), model.project(x, kept)):
                out[i] = [(c + 1, d, None if np.isnan(w[c]) else float(w[c])) for c in range(kept)]
        return pd.Series(out, dtype=object)

    shares = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values[:kept]] if kept else [0.0]
    one = df.select(F.col(id_col), F.explode(run(column)).alias("_c"))
    return one.select(id_col, "_c.component", F.lit(model.n if model else 0).cast("long").alias("n"), "_c.deviation", "_c.whitened",
                      F.element_at(F.array(*map(F.lit, shares)), F.col("_c.component")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
