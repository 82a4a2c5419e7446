"""Whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block Q of three times the wanted columns is
multiplied by it in one pass over the centred vectors: each task adds up its batches'
X'(XQ), and Spark adds up the tasks'. A round is a polynomial of such passes, which
follows the three-term recurrence of the Chebyshev polynomials and damps all below the
block's least Ritz value, then a QR step and a Rayleigh-Ritz step. Two columns of each
round are new random directions, so that no direction stays unseen: a larger pair that
the block had missed would show in their Ritz values, which are ranked with the rest.
It ends when each of the first pairs is certified by its residual, which is at the
level of rounding then.

The fit takes each distinct vector once. Vectors of different widths have fits of
their own.

Defined results: vectors that are null, empty, or hold null or non-finite entries are
dropped; a null id stays; repeated rows each have their results; components whose
eigenvalue is not above rounding (1e-12 of the trace) have no whitened coordinate and
are left out, so a single distinct vector gives no row; empty tables give none; extra
columns are ignored. It is an error if a fit isn't certified after ``ROUNDS`` rounds,
if there are more than ``WIDTHS`` widths, or if a deviation can't be held in 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import finite, matrix, scaled
from .common import written

#: Passes of a round, rounds at most, random columns of a round, widths at most, the seed.
DEGREE, ROUNDS, FRESH, WIDTHS, SEED = 8, 60, 2, 16, 23
#: A pair is certified when its residual is below this share of the largest eigenvalue; components below NOTHING of the trace have no length.
RESIDUAL, NOTHING = 1e-13, 1e-12


@dataclass(frozen=True)
class Fit:
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    rounds: int
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once: the integers n * x - S are exact."""
    return differences(x, n, sums).astype(np.float64) / n


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S as integers of 64 bits, or of Python's where those don't hold them."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """The sum of (n * x - S)^2 of each row, exact; an error beyond 64 bits."""
    d = differences(x, n, sums)
    if len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part(x)`` over batches x of ``rows`` (x: integers): added up in each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                total += part(matrix(own.column(0), own.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "y"])

    added = rows.select("x").mapInArrow(run, "i bigint, y double").groupBy("i").agg(F.sum("y").alias("y")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[added["i"].to_numpy()] = added["y"].to_numpy()
    return out.reshape(shape)


def fit(vectors: DataFrame, width: int, k: int, degree: int = DEGREE) -> Fit | None:
    """The first ``k`` eigenpairs of the covariance of ``vectors`` (x: distinct integer vectors of one width); None without rows."""
    each = vectors.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect()
    if not each:
        return None
    n, sums = each[0].n, np.array([r.s for r in sorted(each)], np.int64)
    trace = float(summed(vectors, lambda x: np.square(centred(x, n, sums)).sum(keepdims=True).reshape(1), (1,))[0]) / n
    rng = np.random.default_rng(SEED)
    size = min(width, 3 * k + FRESH)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return summed(vectors, part, q.shape) / n

    q = np.linalg.qr(rng.normal(size=(width, size)))[0]
    low = np.inf
    for rounds in range(1, ROUNDS + 1):
        vq = times(q)
        values, turn = np.linalg.eigh(q.T @ vq)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq - q * values, axis=0)
        wanted = min(k, size)
        scale = max(float(values[0]), 0.0)
        if trace == 0 or (rounds > 1 or size == width) and residual[:wanted].max() <= RESIDUAL * scale:
            keep = values[:wanted] > NOTHING * trace if trace > 0 else np.zeros(wanted, bool)
            return Fit(n, sums, values[:wanted][keep], q[:, :wanted][:, keep], trace, rounds, passes)
        # what is to be damped: up to the least Ritz value but the random columns', from below the least that any round has seen
        low = min(values[-1], low)
        high = max(values[-1 - FRESH], values[0] * 1e-9)
        floor = 0.9 * max(0.0, low) if rounds > 2 else 0.0
        q = filtered(times, q, vq, floor, float(high), float(values[0]), degree)
        if size < width:
            q[:, size - FRESH :] = rng.normal(size=(width, FRESH))
        q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]
    raise RuntimeError(f"the eigenpairs aren't certified after {ROUNDS} rounds: residuals {residual[:wanted].max():.1e} of {scale:.1e}")


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, largest: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the covariance on [low, high], scaled by its value at ``largest``, times q; ``vq`` is known."""
    half, middle = (high - low) / 2, (high + low) / 2
    if half <= 0 or largest <= middle:
        return vq
    first = half / (largest - middle)
    sigma, before, now = first, q, (vq - middle * q) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def whiten(rows: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``rows`` (vec_id, embedding): vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    good = rows.filter(finite(F.col("embedding"))).select("vec_id", scaled(F.col("embedding"), scale, shift).alias("x"))
    distinct = written(good.select("x").distinct())
    widths = sorted(r.w for r in distinct.select(F.size("x").alias("w")).distinct().limit(WIDTHS + 1).collect())
    if len(widths) > WIDTHS:
        raise ValueError(f"more than {WIDTHS} widths of vectors")
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fits = {}
    for w in widths:
        own = distinct.filter(F.size("x") == w) if len(widths) > 1 else distinct
        found = fit(own, w, components)
        fits[w] = (found, identity_error(own, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for w in np.unique(lengths):
                rows_of = batch.filter(pa.array(lengths == w))
                f, error = fits[int(w)]
                k = len(f.values)
                for at in range(0, rows_of.num_rows, 1024):
                    own = rows_of.slice(at, 1024)
                    x = matrix(own.column(1), own.num_rows)
                    m = own.num_rows
                    each = pa.array(np.repeat(np.arange(m), k))
                    columns = [
                        own.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)),
                        pa.array(deviations(x, f.n, f.sums), pa.int64()).take(each), pa.array(f.project(x).ravel()),
                        pa.array(np.tile(f.values / f.trace if k else f.values, m)), pa.array(np.full(m * k, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, schema)


def identity_error(vectors: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, centred, minus the identity."""
    k = len(f.values)
    if not k:
        return 0.0
    mean = summed(vectors, lambda x: f.project(x).sum(axis=0), (k,)) / f.n

    def part(x: np.ndarray) -> np.ndarray:
        c = f.project(x) - mean
        return c.T @ c

    return float(np.abs(summed(vectors, part, (k, k)) / f.n - np.eye(k)).max())
