"""Whitening of vectors by shifted CholeskyQR.

A pass over all rows sums up the Gram matrix of the centred rows. Its Cholesky
factor, with a small shift on the diagonal where it would not exist otherwise, turns the rows into
nearly orthonormal ones by a triangular solve, and the next pass starts from
these. When the Gram matrix is the identity, the product R of the factors has
the singular values and right singular vectors of the centred rows, with none of
the digits lost that squaring a badly conditioned matrix costs.

Entries are whole numbers, ``floor(1024 * c) + 100000``, so their sums are exact
and centring rounds once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import carried, staged, with_fields

SCALE, SHIFT = 1024.0, 100_000
# From here on not every whole number is a double, and a scaled entry counts as not finite.
LARGEST = float(1 << 52)
COMPONENTS = 8
MOST_PASSES = 8
# Entries handled at once in a task.
BLOCK_ENTRIES = 1 << 20
# Shares of the whole variance below this are rounding.
LEAST_SHARE = 1e-25
_UNIT = 2.0**-53


@dataclass(frozen=True)
class Whitening:
    """What was fitted. The mean is ``whole`` + ``rest`` / ``n``, exactly."""

    n: int
    whole: np.ndarray  # whole part of the mean
    rest: np.ndarray  # what is left of the sums
    components: np.ndarray  # unit columns, by falling variance
    variances: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / max(self.n, 1)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def _integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors of this length without NULL or non-finite entries: their rows, and their entries as whole numbers."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    entries = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(entries.reshape(len(rows), width) * SCALE)
    good = (np.abs(scaled) < LARGEST).all(axis=1)
    return rows[good], scaled[good].astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], width: int, at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    step = max(1, BLOCK_ENTRIES // max(width, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            block = batch.slice(start, step)
            rows, x = _integers(block.column(at), width)
            if len(rows):
                yield block, rows, x


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Of the vectors of the commonest length, the longer of equally common ones: length, number, and exact sums."""
    types = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for width in pc.unique(pc.list_value_length(batch.column(0)).drop_null()).to_pylist():
                for _, rows, x in _blocks([batch], width) if width else ():
                    own = sums.setdefault(width, [0, [0] * width])
                    own[0] += len(rows)
                    exact = x if len(x) * int(np.abs(x).max()) < 1 << 62 else x.astype(object)
                    own[1] = [a + int(b) for a, b in zip(own[1], exact.sum(axis=0))]
        for width, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(([width], [n], [total]), types)], schema=types
            )

    # One row per task and length.
    partial = staged(vectors.mapInArrow(run, "width int, n long, sums array<decimal(38,0)>"), "sums")
    commonest = partial.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if commonest is None:
        return 0, 0, []
    each = partial.where(F.col("width") == commonest["width"]).select(F.posexplode("sums").alias("at", "value"))
    sums = {r["at"]: int(r["total"]) for r in each.groupBy("at").agg(F.sum("value").cast("decimal(38,0)").alias("total")).collect()}
    return commonest["width"], commonest["n"], [sums[i] for i in range(commonest["width"])]


def _gram(vectors: DataFrame, width: int, rows_of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows q of the outer products of ``rows_of`` their entries; one partial matrix per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, _, x in _blocks(batches, width):
            q = rows_of(x)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "cells"])

    cells = vectors.mapInArrow(run, "i int, cells array<double>").select("i", F.posexplode("cells").alias("j", "cell"))
    # As many rows as the matrix has cells, however many tasks there are.
    summed = cells.groupBy("i", "j").agg(F.sum("cell").alias("cell")).toArrow()
    out = np.zeros((size, size))
    out[summed.column("i").to_numpy(), summed.column("j").to_numpy()] = summed.column("cell").to_numpy()
    return (out + out.T) / 2


def solve_upper(r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q with ``q r = x`` for an upper triangular ``r``, by substitution from the first column on, half by half."""
    if len(r) == 1:
        return x / r[0, 0]
    half = len(r) // 2
    left = solve_upper(r[:half, :half], x[:, :half])
    return np.concatenate([left, solve_upper(r[half:, half:], x[:, half:] - left @ r[:half, half:])], axis=1)


def _factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor, shifted in the first pass and wherever there is none without."""
    d = len(gram)
    if not first:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * _UNIT * max(float(np.linalg.eigvalsh(gram)[-1]), 0.0)
    for _ in range(60):
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 2
    raise ValueError("the Gram matrix has no Cholesky factor")


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Learn from all vectors without NULL and non-finite entries.

    Where vectors differ in length, those of the commonest length count, the
    longer of two equally common ones. Entries of 2**42 and more count as not
    finite. Directions without variance have no component, so constant vectors, a single one or
    none have no components at all. Repeated vectors count as often as they come.
    """
    given = vectors.select(F.col(column).alias("vector"))
    width, n, sums = _sums(given)
    # Python's division rounds down, so the rest is from 0 to n - 1.
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(s % n) for s in sums])
    model = Whitening(n, whole, rest, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0)
    if not n:
        return model
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        q = model.centred(x)
        for r in factors:
            q = solve_upper(r, q)
        return q

    for _ in range(MOST_PASSES):
        gram = _gram(given, width, orthogonal, width)
        if not factors and not gram.any():
            return model
        if factors and np.abs(gram - np.eye(width)).max() <= 8 * width * _UNIT:
            break
        factors.append(_factor(gram, n, not factors))
    r = factors[0]
    for factor in factors[1:]:
        r = factor @ r
    _, singular, right = np.linalg.svd(r)
    variances = singular**2 / n
    trace = float(variances.sum())
    used = int((variances[:components] > LEAST_SHARE * trace).sum())
    chosen = right[:used].T
    # Either sign is right; the largest entry is positive.
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(used)])
    model = Whitening(n, whole, rest, chosen, variances[:used], trace, 0.0)

    def with_one(x: np.ndarray) -> np.ndarray:
        return np.concatenate([model.whiten(x), np.ones((len(x), 1))], axis=1)

    check = _gram(given, width, with_one, used + 1) / n
    mean = check[-1, :-1]
    error = float(np.abs(check[:-1, :-1] - np.outer(mean, mean) - np.eye(used)).max(initial=0.0))
    return Whitening(n, whole, rest, chosen, variances[:used], trace, error)


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Per row the exact sum of (n x - S)^2; None where a long does not hold it."""
    apart = x - model.whole
    most = model.n * (int(np.abs(apart).max()) + 1)
    if most * most * x.shape[1] < 1 << 63:
        exact = model.n * apart - model.rest.astype(np.int64)
        return (exact * exact).sum(axis=1).tolist()
    exact = model.n * apart.astype(object) - np.array([int(r) for r in model.rest], object)
    return [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]


def whiten(
    vectors: DataFrame, model: Whitening, keep: list[str] | None = None, column: str = "embedding"
) -> DataFrame:
    """The columns ``keep`` (all but the vector by default) of each vector fit for ``model``, once per component.

    Adds component (from 1), n, deviation, whitened, explained and
    identity_error. Vectors that are NULL, of another length, or with NULL or
    non-finite entries are left out. ``deviation`` is NULL where a long cannot hold it.
    Kept columns of the names added are replaced.
    """
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    keep = [c for c in (vectors.columns if keep is None else keep) if c not in added and (keep is not None or c != column)]
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Whitening = shared.value
        width, used = own.components.shape
        if not used:
            return
        for block, rows, x in _blocks(batches, width, 1):
            size = len(rows) * used
            deviations = np.repeat(np.array(_deviations(x, own), object), used)
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(np.repeat(rows, used))), pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), len(rows))),
                 pa.array(np.full(size, own.n)), pa.array(deviations.tolist(), pa.int64()), pa.array(own.whiten(x).ravel()),
                 pa.array(np.tile(own.variances / own.trace, len(rows))), pa.array(np.full(size, own.identity_error))],
                ["row", *added],
            )

    given = vectors.select(carried(keep).alias("row"), F.col(column).alias("vector"))
    ddl = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = given.mapInArrow(run, with_fields(given.select("row").schema, ddl))
    return out.select(*(F.col("row")[c].alias(c) for c in keep), *added)
