"""Embedding whitening: integer-exact centring, distributed covariance, own symmetric eigensolver, broadcast projection.

Vectors are turned to integers, ``floor(256 * entry)``, and every distinct integer vector is fitted once.  Three passes over the
written fit list sum the vectors, the products of the centred ones and the products of the whitened ones; what reaches the driver
is bounded by the square of the vectors' length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import materialize

#: Entries that a task holds as a matrix at once.
_SLICE = 1 << 19
#: Doubles of a matrix per summed row, and rows that one task adds up at each of the two steps.
_PIECE, _FAN = 4096, 512
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def integer_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of valid vectors: (row numbers, integer matrix padded with zeros, lengths).  Entries beyond 64 bits are held at the ends."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = column.is_valid().to_numpy(zero_copy_only=False).astype(bool) & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows = np.flatnonzero(whole)
    step = max(1, _SLICE // max(1, int(lengths.max(initial=1))))
    for k in range(0, len(rows), step):
        part = rows[k : k + step]
        size = lengths[part]
        x = np.zeros((len(part), int(size.max(initial=0))), np.int64)
        row = np.repeat(np.arange(len(part)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        with np.errstate(over="ignore"):
            scaled = np.floor(values[np.repeat(offsets[part], size) + at] * 256.0)
        inside = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        x[row, at] = np.where(scaled >= 2.0**63, np.int64(2**63 - 1), inside)
        yield part, x, size


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, the same for the same vector: trailing zeros fall away, then the width of its entries and these."""
    most = np.maximum(x, -(x + 1)).max(axis=1, initial=0)  # without the overflow of abs
    kept = np.where(x.any(axis=1), x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1), 0) if x.shape[1] else np.zeros(len(x), int)
    out: list[bytes] = [b""] * len(x)
    for width, low in ((1, 0), (2, 1 << 7), (4, 1 << 15), (8, 1 << 31)):
        rows = np.flatnonzero((most >= low) & ((most < 1 << (8 * width - 1)) if width < 8 else True))
        flat = x[rows].astype(f"<i{width}").tobytes()
        span = x.shape[1] * width
        for k, (i, n) in enumerate(zip(rows.tolist(), kept[rows].tolist(), strict=True)):
            out[i] = bytes([width]) + flat[k * span : k * span + n * width]
    return out


def unpacked(cells: list[bytes], size: int) -> np.ndarray:
    """Integer matrix of packed rows, ``size`` wide."""
    x = np.zeros((len(cells), size), np.int64)
    for width in (1, 2, 4, 8):
        rows = [i for i, c in enumerate(cells) if c[0] == width]
        if rows:
            flat = b"".join(cells[i][1:].ljust(size * width, b"\0") for i in rows)
            x[rows] = np.frombuffer(flat, f"<i{width}").reshape(len(rows), size)
    return x


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, rounded once: n * x - sums is an exact integer."""
    top = max(int(np.maximum(x, -(x + 1)).max(initial=0)) + 1, 1)
    if n * top + max(map(abs, sums), default=0) < 1 << 62:
        return (x * n - np.array(sums, np.int64)).astype(float) / n
    return (x.astype(object) * n - np.array(sums, object)).astype(float) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the entries of (n * x - sums) ** 2 for each row, exact."""
    top = n * (int(np.maximum(x, -(x + 1)).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    if top * top * max(1, x.shape[1]) < 1 << 62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


# Householder, Sturm counts and inverse iteration: matrices of the vectors' length only, on the driver.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, side diagonal and reflectors (first row, unit vector) of a symmetric matrix whose largest entry is about 1."""
    a = a.astype(float).copy()
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if np.abs(v[1:]).max() < 1e-100:  # of a matrix scaled to 1: its square would underflow
            a[k + 2 :, k] = a[k, k + 2 :] = 0.0
            continue
        alpha = -math.copysign(float(np.linalg.norm(v)), v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = alpha
        reflectors.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    for diagonal, square in zip(d, np.concatenate([[0.0], e * e]), strict=True):
        q = diagonal - at - square / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bit."""
    n = len(d)
    around = np.concatenate([[0.0], np.abs(e)]) + np.concatenate([np.abs(e), [0.0]])
    low, high = np.full(k, (d - around).min()), np.full(k, (d + around).max())
    room = np.finfo(float).eps * max(np.abs(low[0]), np.abs(high[0]))
    low, high = low - room, high + room
    rank = n - np.arange(k)  # the i-th largest is above x if fewer than rank eigenvalues lie below x
    while True:
        middle = low + (high - low) / 2
        moving = (middle > low) & (middle < high)
        if not moving.any():
            return middle
        above = sturm_counts(d, e, middle) < rank
        low = np.where(moving & above, middle, low)
        high = np.where(moving & ~above, middle, high)


def _solver(d: np.ndarray, e: np.ndarray, value: float, floor: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - value) y = b; LU with row exchanges, pivots of at least ``floor``."""
    n = len(d)
    main, upper, second = (d - value).tolist(), [*e.tolist(), 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        low = float(e[i])
        if abs(main[i]) >= abs(low):
            if abs(main[i]) < floor:
                main[i] = floor
            f = low / main[i]
            main[i + 1] -= f * upper[i]
            steps.append((False, f))
        else:
            f = main[i] / low
            main[i], upper[i], main[i + 1], kept = low, main[i + 1], upper[i] - f * main[i + 1], upper[i + 1]
            second[i], upper[i + 1] = kept, -f * kept
            steps.append((True, f))
    if abs(main[-1]) < floor:
        main[-1] = floor

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i, (swapped, f) in enumerate(steps):
            if swapped:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= f * y[i]
        for i in range(n - 1, -1, -1):
            s = y[i] - (upper[i] * y[i + 1] if i + 1 < n else 0.0) - (second[i] * y[i + 2] if i + 2 < n else 0.0)
            y[i] = s / main[i]
        return np.array(y)

    return solve


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    n = len(v)
    k = min(k, n)
    scale = float(np.abs(v).max(initial=0.0))
    if k == 0 or scale == 0.0:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, reflectors = tridiagonal(v / scale)
    values = leading_values(d, e, k)
    norm = float(np.abs(d).max() + 2 * np.abs(e).max(initial=0.0))
    eps = np.finfo(float).eps
    found = np.zeros((n, k))
    start = np.random.default_rng(n)
    for i in range(k):
        solve = _solver(d, e, values[i] + i * eps * norm, eps * norm)
        # Vectors of close eigenvalues are kept apart by hand.
        cluster = found[:, [j for j in range(i) if values[j] - values[i] <= 1e-3 * norm]]
        y = start.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                y -= cluster @ (cluster.T @ y)
            y = solve(y / np.linalg.norm(y))
        for _ in range(2):
            y -= cluster @ (cluster.T @ y)
        found[:, i] = y / np.linalg.norm(y)
    for first, w in reversed(reflectors):
        found[first:] -= 2.0 * np.outer(w, w @ found[first:])
    return values * scale, found / np.linalg.norm(found, axis=0)


# Passes over the fit list.


def fit_list(embeddings: DataFrame) -> DataFrame:
    """(x, size): each distinct integer vector of the valid rows once, packed, with the largest length it came in."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, size in integer_rows(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary()), pa.array(size, pa.int32())], ["x", "size"])

    # Copies are combined inside every task before the exchange.
    return embeddings.select("embedding").mapInArrow(cells, "x binary, size int").groupBy("x").agg(F.max("size").alias("size"))


def sums_of(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(size, object)
        for frame in frames:
            for k in range(0, len(frame), step := max(1, _SLICE // max(1, size))):
                x = unpacked(frame["x"].tolist()[k : k + step], size)
                n += len(x)
                safe = len(x) * (int(np.maximum(x, -(x + 1)).max(initial=0)) + 1) < 1 << 62
                total = total + (x if safe else x.astype(object)).sum(axis=0).astype(object)
        yield pd.DataFrame({"i": range(-1, size), "total": [str(n), *map(str, total)]})

    parts = fit.select("x").mapInPandas(summed, "i int, total string")
    rows = dict(parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())
    return int(rows.get(-1, 0)), [int(rows[i]) for i in range(size)] if rows else [0] * size


def _matrix_sum(fit: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray], cells: int) -> np.ndarray:
    """Sum of ``part`` (``cells`` doubles) over slices of the fit list; partitions are added up in two steps of bounded groups."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total, seen = np.zeros(cells), False
        for frame in frames:
            for k in range(0, len(frame), step := max(1, _SLICE // max(1, size))):
                total += part(unpacked(frame["x"].tolist()[k : k + step], size)).ravel()
                seen = True
        if seen:
            group = TaskContext.get().partitionId() % _FAN
            at = range(0, cells, _PIECE)
            yield pd.DataFrame({"group": group, "piece": [i // _PIECE for i in at], "cells": [total[i : i + _PIECE].tobytes() for i in at]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c) for c in frame["cells"]], axis=0)
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "cells": [total.tobytes()]})

    parts = fit.select("x").mapInPandas(partial, "group int, piece int, cells binary")
    first = parts.groupBy("group", "piece").applyInPandas(added, "piece int, cells binary")
    rows = first.groupBy("piece").applyInPandas(added, "piece int, cells binary").collect()
    return np.concatenate([np.frombuffer(r["cells"]) for r in sorted(rows, key=lambda r: r["piece"])]) if rows else np.zeros(cells)


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Whitened coordinates of every valid vector, a row for each of the ``components`` leading components.

    Rows whose vector is null or holds a null or non-finite entry go; null and repeated ids stay, a row each; other columns are not
    read; an empty table gives none.  Vectors of unequal length count as followed by zeros, and there are no more components than
    entries in the longest one.  A component without variance (fewer distinct vectors than components) has null in ``whitened`` and
    is left out of ``identity_error``, which is null if none is left.  Of equal eigenvalues any orthogonal vectors are taken, the
    same for all rows.  ``deviation_exact`` is exact up to 38 digits; ``deviation`` is null where it leaves 64 bits.
    """
    spark = embeddings.sparkSession
    fit = materialize(fit_list(embeddings), "whitening-fit")
    size = fit.agg(F.max("size")).first()[0] or 0
    n, sums = sums_of(fit, size)
    k = min(components, size)
    if n == 0 or k == 0:
        return spark.createDataFrame([], _RESULT)

    def gram(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, sums)
        return c.T @ c

    covariance = _matrix_sum(fit, size, gram, size * size).reshape(size, size) / n
    values, vectors = leading_components((covariance + covariance.T) / 2, k)
    trace = float(np.trace(covariance))
    live = values > trace * np.finfo(float).eps * size
    scaled = vectors / np.sqrt(np.where(live, values, 1.0))
    known = spark.sparkContext.broadcast(scaled)  # length x components doubles
    centre = _matrix_sum(fit, size, lambda x: (centred(x, n, sums) @ known.value).sum(axis=0), k) / n

    def whitened_gram(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ known.value - centre
        return w.T @ w

    spread = (_matrix_sum(fit, size, whitened_gram, k * k).reshape(k, k) / n)[np.ix_(live, live)]
    error = float(np.abs(spread - np.eye(len(spread))).max()) if live.any() else None
    explained = [float(v) / trace if a else 0.0 for v, a in zip(values, live, strict=True)]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        long = pa.int64()
        for batch in batches:
            for rows, x, _ in integer_rows(batch.column(1)):
                x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
                w = centred(x, n, sums) @ known.value
                exact = deviations(x, n, sums)
                times = len(rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)),
                    pa.array(np.full(times * k, n), long),
                    pa.array([d if d < 1 << 63 else None for d in exact for _ in range(k)], long),
                    pa.array(w.ravel(), mask=np.tile(~live, times)),
                    pa.array(explained * times, pa.float64()),
                    pa.array([error] * (times * k), pa.float64()),
                    pa.array([Decimal(d) if d < 10**38 else None for d in exact for _ in range(k)], pa.decimal128(38, 0)),
                ], names)

    names = [c.split(" ")[0] for c in _RESULT.split(", ")]
    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(projected, _RESULT)
