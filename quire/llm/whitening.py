"""Whitening of integer vectors by a digit-slice GEMM.

The covariance of integer vectors is summed exactly: rows are centred as n * x - S, which are integers, and cut into
limbs of LIMB bits, so that products of limbs, summed over ROWS rows, are integers that float64 BLAS gets exactly.
Each task puts its limb products together as big integers and sends them as 32-bit digits, which Spark adds up;
only the d * d sums come to the driver, where they are decomposed. What rows cost there doesn't grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .util import Staged

#: Bits of a limb and rows of one product: 2 * LIMB bits and the rows' 12 stay below the 53 of a double.
LIMB, ROWS = 20, 4096
#: What a component becomes: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
_LARGEST = (1 << 63) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows that stay: not null, no entry null or not finite. Entries beyond a long's range are the nearest that has room for SHIFT."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.col("embedding").isNotNull() & ~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(sound).select("vec_id", F.transform(c, lambda e: F.least(F.floor(e * float(SCALE)), F.lit(_LARGEST - SHIFT)) + F.lit(SHIFT)).alias("x"))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _digits(value: int) -> list[int]:
    """Signed digits to base 2^32, lowest first; sums of them stay exact for 2^31 tasks."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & 0xFFFFFFFF))
        value >>= 32
    return out


def _batch(cells: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    found = [(cell, k, v) for cell, value in cells for k, v in enumerate(_digits(value))]
    columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["cell", "digit", "v"])


def _summed(parts: DataFrame) -> dict[int, int]:
    """Cells as big integers. Their number depends on the dimensions alone."""
    total: dict[int, int] = {}
    for r in parts.groupBy("cell", "digit").agg(F.sum("v").alias("v")).toLocalIterator():
        total[r.cell] = total.get(r.cell, 0) + (r.v << (32 * r.digit))
    return total


def column_sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and each dimension's exact sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            x = _rows(b.column(0), d)
            n += len(x)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)  # neither can overflow within a batch
            sums = [s + (int(h) << 32) + int(v) for s, h, v in zip(sums, high, low, strict=True)]
        yield _batch(iter([*enumerate(sums), (d, n)]))

    total = _summed(distinct.select("x").mapInArrow(run, "cell long, digit int, v long"))
    return total.get(d, 0), [total.get(j, 0) for j in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers where they fit, else Python's."""
    base = [s // max(n, 1) for s in sums]  # takes the size out before multiplying
    rest = [s - n * m for s, m in zip(sums, base, strict=True)]
    far = max((max(abs(int(hi) - m), abs(int(lo) - m)) for hi, lo, m in zip(x.max(0), x.min(0), base, strict=True)), default=0) if len(x) else 0
    if (far + 1) * n < 1 << 62:
        return (x - np.array(base, np.int64)) * n - np.array(rest, np.int64)
    return (x.astype(object) - np.array(base, object)) * n - np.array(rest, object)


def sliced(y: np.ndarray) -> list[np.ndarray]:
    """Limbs of integers, lowest first, as doubles: all but the last in 0 .. 2^LIMB - 1, the last with the sign."""
    most = int(np.abs(y).max(initial=0))
    out = []
    while most >> LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y, most = y >> LIMB, (most >> LIMB) + 1  # a shift rounds down, so a negative number may end one farther from 0
    return [*out, y.astype(np.float64)]


def gram(y: np.ndarray) -> np.ndarray:
    """y^T y of integer rows as big integers, through exact float64 products of limbs."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for at in range(0, len(y), ROWS):
        limbs = sliced(y[at : at + ROWS])
        for a in range(len(limbs)):
            for b in range(a + 1):
                product = (limbs[a].T @ limbs[b]).astype(np.int64)
                total += (product if a == b else product + product.T).astype(object) * (1 << (LIMB * (a + b)))
    return total


def scatter(distinct: DataFrame, d: int, n: int, sums: list[int]) -> list[list[int]]:
    """The exact sum over rows of (n * x - sums)^T (n * x - sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for b in batches:
            x = _rows(b.column(0), d)
            if len(x):
                total += gram(centred(x, n, sums))
        yield _batch((i * d + j, int(total[i, j])) for i in range(d) for j in range(i + 1))

    total = _summed(distinct.select("x").mapInArrow(run, "cell long, digit int, v long"))
    return [[total.get(max(i, j) * d + min(i, j), 0) for j in range(d)] for i in range(d)]


def _wide(values: list[list[int]], shift: int) -> np.ndarray:
    """Integers over 2^shift with all the bits that an extended double holds."""
    high = np.array([[float(v) for v in row] for row in values])
    rest = np.array([[float(v - int(h)) for v, h in zip(row, own, strict=True)] for row, own in zip(values, high.tolist(), strict=True)])
    return np.ldexp(high.astype(np.longdouble) + rest.astype(np.longdouble), -shift)


def eigen(values: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, shift) of a symmetric integer matrix over 2^shift.

    LAPACK's vectors are refined in extended precision (Ogita and Aishima, 2018), so that they are right to double
    precision also where eigenvalues lie close. A vector's largest entry is positive.
    """
    d = len(values)
    shift = max((abs(v).bit_length() for row in values for v in row), default=0)
    a = _wide(values, shift)
    e, v = np.linalg.eigh(a.astype(np.float64))
    v, eye = v.astype(np.longdouble), np.eye(d, dtype=np.longdouble)
    for _ in range(4):
        r, s = eye - v.T @ v, v.T @ (a @ v)
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(e)
        close = 2 * (np.abs(off).max(initial=0) + np.abs(a).max(initial=0) * np.abs(r).max(initial=0))
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > close
        v = v + v @ np.where(far, (s + e[None, :] * r) / np.where(far, gap, 1), r / 2)
    order = np.argsort(-e, kind="stable")
    v = v[:, order] / np.sqrt((v[:, order] ** 2).sum(0))
    signs = np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1, 1) if d else 1
    return np.maximum(e[order], 0), v * signs, shift


def _projected(y: np.ndarray, n: int, axes: np.ndarray) -> np.ndarray:
    return (y.astype(np.float64) / n) @ axes


def _identity_error(distinct: DataFrame, d: int, n: int, sums: list[int], axes: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, as measured over the fit list."""
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            x = _rows(b.column(0), d)
            if len(x):
                w = _projected(centred(x, n, sums), n, axes)
                products, total = products + w.T @ w, total + w.sum(0)
        flat = np.concatenate([products.ravel(), total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "v"])

    found = np.zeros(k * k + k)
    for r in distinct.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        found[r.cell] = r.v / n
    mean = found[k * k :]
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each sound row of `vectors` (vec_id, embedding) and each component.

    A row without vec_id, and rows that repeat one, come out once each; rows that repeat a vector count once in the
    statistics. Vectors may differ in length: missing entries are 0. There are as many components as dimensions, `components` at most; one
    along which the vectors don't differ at all (its eigenvalue is 0 as far as extended doubles tell) has `whitened` null and takes
    no part in identity_error, and `explained` is 0 where nothing differs. `deviation` is null where it is beyond a long. Very long vectors
    cost d * d numbers in each task and on the driver, whatever the rows. An empty table, or one with empty vectors alone, gives an
    empty result. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "whitening")
    sound = staged.put(integers(vectors))
    d = sound.agg(F.max(F.size("x"))).first()[0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    filled = sound.select("vec_id", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(d) - F.size("x"))).alias("x"))
    distinct = staged.put(filled.select("x").distinct())
    n, sums = column_sums(distinct, d)
    values = scatter(distinct, d, n, sums)
    e, axes, shift = eigen(values)
    k = min(components, d)
    trace = sum(values[j][j] for j in range(d))
    explained = [float(np.ldexp(x, shift) / np.longdouble(trace)) if trace else 0.0 for x in e[:k]]
    differs = [bool(x > e[0] * d * np.finfo(np.longdouble).eps * 4) for x in e[:k]] if trace else [False] * k
    # n^3 times an eigenvalue of the covariance is one of `values`: the deviations are n times as large, and summed over n rows
    sizes = [float(np.sqrt(np.ldexp(x, shift) / np.longdouble(n) ** 3)) if own else 1.0 for x, own in zip(e[:k], differs, strict=True)]
    own = axes[:, :k].astype(np.float64) / np.array(sizes)
    some = np.flatnonzero(differs)
    error = _identity_error(distinct, d, n, sums, own[:, some]) if len(some) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                y = centred(_rows(b.column(1), d), n, sums)
                w = _projected(y, n, own)
                squares = (y.astype(object) ** 2).sum(1) if int(np.abs(y).max(initial=0)) ** 2 * d >= 1 << 62 else (y * y).sum(1)
                deviation = pa.array([v if v <= _LARGEST else None for v in squares.tolist()], pa.int64())
                rows = np.repeat(np.arange(len(y)), k)
                take = lambda c, rows=rows: c.take(pa.array(rows))
                dead = np.tile(~np.array(differs), len(y))
                columns = [take(b.column(0).cast(pa.int64())), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(rows), n)), take(deviation), pa.array(w.ravel(), mask=dead), pa.array(np.tile(explained, len(y))), pa.array(np.full(len(rows), error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return filled.select("vec_id", "x").mapInArrow(run, schema)
