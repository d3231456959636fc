"""Whitened embeddings by Golub-Kahan-Lanczos bidiagonalisation of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import written

#: Entries become ``floor(SCALE * c) + OFFSET``.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: A larger ``SCALE * c`` is not exact as a double and counts as not finite.
MOST = 1 << 52
#: Singular values below this share of the largest are zero.
RANK = 1e-10
#: A singular vector is found when its residual is below this share of the norm of all rows.
SETTLED = 4e-15
#: Partial sums that the driver adds up; more are added up in tasks first.
PARTS = 256
#: Rows that a task holds as doubles at a time.
_ROWS = 4096
_SEED = 12


@dataclass(frozen=True)
class Fit:
    """What was learned: ``n`` rows with per-dimension sums ``sums`` (exact), unit
    components in columns, their variances, and the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - S/n``, subtracted as integers but for the fraction of the mean."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x``: the vectors as integers, without null, non-finite or empty ones.

    Vectors of another length than most (of the longest among ties) cannot be in
    one covariance with them and are dropped too.
    """
    c = F.col(vector)
    bad = F.exists(
        c,
        lambda v: v.isNull()
        | F.isnan(v)
        | (F.abs(v.cast("double")) > F.lit(float(MOST // SCALE))),
    )
    kept = rows.filter(c.isNotNull() & (F.size(c) > 0) & ~bad).select(
        F.col(vec_id).alias("id"),
        F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + OFFSET).alias("x"),
    )
    kept = written(kept, "integer-vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return kept.filter(F.size("x") == (most.d if most else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _summed(
    rows: DataFrame, tasks: int, width: int, add: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum of ``add(x)``, ``width`` doubles, over blocks of rows.

    Each of the ``tasks`` that read the rows gives one array. Where they are
    many, other tasks add those up, so the driver gets ``PARTS`` arrays at most.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                total += add(_matrix(batch.column(0).slice(i, _ROWS)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += _matrix(batch.column(0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = rows.select("x").mapInArrow(partial, "v array<double>")
    if tasks > PARTS:
        parts = parts.repartition(PARTS).mapInArrow(together, "v array<double>")
    return np.sum([r.v for r in parts.collect()], axis=0) if width else np.zeros(0)


class _Rows:
    """Products with the centred rows, over all of them."""

    def __init__(self, rows: DataFrame, n: int, sums: tuple[int, ...]):
        self.rows, self.n, self.sums, self.d = rows, n, sums, len(sums)
        self.tasks = rows.rdd.getNumPartitions()

    def summed(self, width: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``add`` over blocks of centred rows."""
        n, sums = self.n, self.sums
        return _summed(self.rows, self.tasks, width, lambda x: add(_centred(x, n, sums)))

    def total_variance(self) -> float:
        return float(self.summed(1, lambda c: np.array([(c**2).sum()]))[0]) / self.n

    def products(self, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """``|Xy|**2``, ``X'(Xy)`` and ``(XW)'(Xy)``: a task multiplies its rows
        with y, then what it got with its rows."""
        d = self.d

        def add(c: np.ndarray) -> np.ndarray:
            u = c @ y
            return np.concatenate([[u @ u], u @ c, (c @ w).T @ u])

        out = self.summed(1 + d + w.shape[1], add)
        return float(out[0]), out[1 : 1 + d], out[1 + d :]


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """v without its parts along the columns of basis; twice is enough."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _fresh(basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A unit vector across the columns of basis."""
    v = _orthogonal(rng.standard_normal(len(basis)), basis)
    return v / np.linalg.norm(v)


def _chain(
    rows: _Rows, locked: tuple[np.ndarray, np.ndarray], count: int, scale: float, rng
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and values of the centred rows, found in
    what ``locked`` leaves: ``count`` of them, or all where that takes every dimension.

    The left vectors are as long as the table and never gathered: each is
    ``X w`` for a short w, so a task makes its entries from its own rows, and the
    reorthogonalisation against all of them comes with the product.
    """
    d = rows.d
    v_all, w_all = locked
    start = v_all.shape[1]
    alphas: list[float] = []
    betas: list[float] = []
    v = _fresh(v_all, rng)
    last_w, beta = np.zeros(d), 0.0
    while True:
        v_all = np.column_stack([v_all, v])
        y = v - beta * last_w
        for _ in range(3):
            square, z, along = rows.products(y, w_all)
            alpha = square**0.5
            if alpha <= RANK * scale or not along.size or np.abs(along).max() <= 4e-16 * alpha:
                break
            y = y - w_all @ along
        if alpha <= RANK * scale:
            # nothing new in this direction: a left vector across all rows
            alpha, last_w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            last_w, z = y / alpha, z / alpha
        w_all = np.column_stack([w_all, last_w])
        alphas.append(alpha)
        k = len(alphas)
        b = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(b)
        if start + k == d:
            count = k
            break
        rest = _orthogonal(z - alpha * v, v_all)
        beta = float(np.linalg.norm(rest))
        open_ = beta * np.abs(left[-1, :count])
        if k >= count and open_.max() <= SETTLED * scale:
            break
        if beta <= RANK * scale:
            beta, v = 0.0, _fresh(v_all, rng)
        else:
            v = rest / beta
        betas.append(beta)
    return (v_all[:, start:] @ right.T)[:, :count], values[:count]


def fit(vectors: DataFrame, count: int = COMPONENTS) -> Fit | None:
    """Learn the components of ``integer_vectors``, None for an empty table.

    Alternating products with the centred rows and their transpose, each pair one
    pass over the table, bidiagonalise them; every new vector is made orthogonal
    to all before, on both sides. The singular values of the small bidiagonal
    matrix are deviations times sqrt(n). One chain finds one vector for each
    different value, so another is run across what was found, until it adds
    none above the last component: repeated variances are found as well. A chain that has
    seen all dimensions needs no other. Directions without variance are left
    out.
    """
    sums = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    found = sorted(sums.collect(), key=lambda r: r.i)  # a row per dimension
    if not found:
        return None
    n, totals = found[0].n, tuple(int(r.s) for r in found)
    rows, rng, d = _Rows(vectors, n, totals), np.random.default_rng(_SEED), len(totals)
    trace = rows.total_variance()
    scale = (trace * n) ** 0.5
    v, w, values = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros(0)
    count = min(count, d)
    while scale > 0 and v.shape[1] < d:
        more, own = _chain(rows, (v, w), 1 if len(values) else count, scale, rng)
        keep = own > RANK * scale
        if len(values) >= count:
            keep &= own > values[count - 1] * (1 - 1e-12)
        done = more.shape[1] + v.shape[1] == d or not keep.any()
        v = np.column_stack([v, more[:, keep]])
        w = np.column_stack([w, more[:, keep] / own[keep]])
        values = np.concatenate([values, own[keep]])
        order = np.argsort(-values, kind="stable")
        v, w, values = v[:, order], w[:, order], values[order]
        if done:
            break
    return Fit(n, totals, v[:, :count], values[:count] ** 2 / n, trace)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of ``(n*x - S)**2``, null where no long holds it."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object if n > 1 << 62 else np.int64)
    apart = x - whole
    far = float(np.abs(apart).max(initial=0) + 1) * n
    if far**2 * max(1, len(sums)) < 2.0**62:
        part = n * apart - rest
        return (part * part).sum(axis=1).tolist()
    exact = (n * apart.astype(object) - rest.astype(object)) ** 2
    return [int(v) if v < 1 << 63 else None for v in exact.sum(axis=1)]


def identity_error(vectors: DataFrame, fitted: Fit) -> float:
    """How far the covariance of the whitened fit rows is from the identity."""
    to = fitted.components / np.sqrt(fitted.variances)
    k, rows = to.shape[1], _Rows(vectors, fitted.n, fitted.sums)
    if not k:
        return 0.0
    mean = rows.summed(k, lambda c: (c @ to).sum(axis=0)) / fitted.n

    def squares(c: np.ndarray) -> np.ndarray:
        apart = c @ to - mean
        return (apart.T @ apart).reshape(-1)

    covariance = rows.summed(k * k, squares).reshape(k, k) / fitted.n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, fitted: Fit) -> DataFrame:
    """``id, deviation, values``: each row's whitened coordinates, one a component."""
    to = fitted.components / np.sqrt(fitted.variances)
    n, sums, k = fitted.n, fitted.sums, to.shape[1]
    kind = vectors.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                x = _matrix(part.column(1))
                offsets = pa.array(np.arange(len(x) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(_deviations(x, n, sums), pa.int64()),
                        pa.ListArray.from_arrays(offsets, (_centred(x, n, sums) @ to).reshape(-1)),
                    ],
                    ["id", "deviation", "values"],
                )

    return vectors.mapInArrow(project, f"id {kind}, deviation bigint, values array<double>")


def whiten_embeddings(
    rows: DataFrame, count: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Each vector in the unit-variance coordinates of the leading components.

    The fit list is every vector that is kept (``integer_vectors``); repeated rows
    count as often as they occur and come out as often, null ids are kept as
    null. Fewer than ``count`` components come out where no more directions have
    variance: none for a single row, equal rows or an empty table, which give
    no rows. ``deviation`` is null where it exceeds a long. The sign of a component is
    the same for all rows. Columns other than the two named are not read.

    Returns ``vec_id, component, n, deviation, whitened, explained,
    identity_error``.
    """
    vectors = integer_vectors(rows, vec_id, vector)
    fitted = fit(vectors, count)
    if fitted is None:
        kind = vectors.schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame(
            [],
            f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
            "explained double, identity_error double",
        )
    explained = (fitted.variances / fitted.trace).tolist() if fitted.trace else []
    return (
        whitened(vectors, fitted)
        .select("id", "deviation", F.posexplode("values").alias("_i", "whitened"))
        .select(
            F.col("id").alias("vec_id"),
            (F.col("_i") + 1).alias("component"),
            F.lit(fitted.n).cast("bigint").alias("n"),
            "deviation",
            "whitened",
            F.get(F.array(*[F.lit(e) for e in explained]).cast("array<double>"), F.col("_i")).alias("explained"),
            F.lit(identity_error(vectors, fitted)).alias("identity_error"),
        )
    )
