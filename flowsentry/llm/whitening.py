"""Whitening of vectors by an incremental eigendecomposition.

Entries become whole numbers, floor(256 c); the covariance is that of the distinct vectors, divisor n, and its leading
unit eigenvectors are the components.

Each task holds a spectrum: count, exact sums, mean, and the eigenpairs of the scatter matrix of the vectors it has
met. A vector is one centred rank-one update: its part outside the eigenvectors so far becomes a new direction, then
the eigenvalues of diag(d) + zz' are the roots of a secular equation, found by rational interpolation inside their
brackets. Deflation comes first: a direction that z does not touch stays as it is, and of two equal eigenvalues one
direction is rotated free. The weights are then computed anew from the roots (Löwner's formula), so eigenvectors stay
orthogonal however close eigenvalues are. Spectra of tasks are combined, `FAN_IN` at a time, by one such update per
eigenpair and one for the distance of their means. Last, a Rayleigh-Ritz step over all vectors in the basis that
results removes the rounding of the updates; it is repeated on a basis grown by its residuals while these are not
down to rounding, which happens only where a spectrum was cut to `DIRECTIONS`.

What travels is of the model's size: a task's spectrum, one matrix row per direction and task, the components.

Defined results: null vectors and vectors with null or non-finite entries are dropped, as are empty ones and those
of another length than the commonest (of equally common lengths the smallest counts). Components without variance have
null `whitened`; `explained` is null where no vector differs from another. A deviation beyond a long is null. Equal
rows count once in the fit and are all returned. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import written

register_pickle_by_value(sys.modules[__name__])

#: Directions a spectrum keeps, spectra combined by one task, Rayleigh-Ritz steps at most, relative residual to reach.
DIRECTIONS, FAN_IN, STEPS, RESIDUAL = 512, 8, 100, 1e-11
#: Relative sizes below which a weight is none, and two eigenvalues are one; convergence of a root.
NO_WEIGHT, SAME, ROOT = 1e-15, 1e-14, 1e-13
SPECTRUM = "task long, n long, sums array<long>, mean array<double>, values array<double>, basis array<double>"


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + zz' for strictly rising d and z without zeros, and the matrix d_j - root_i."""
    k = len(d)
    z2 = z * z
    width = np.append(d[1:], d[-1] + z2.sum()) - d
    middle = width / 2
    rows = np.arange(k)
    below = 1 + (z2 / (d - d[:, None] - middle[:, None])).sum(1) < 0
    # offsets count from the nearer pole, so that they do not cancel
    right = below & (rows < k - 1)
    origin = rows + right
    poles = d - d[origin][:, None]
    low = np.where(right, -middle, np.where(below, middle, 0.0))
    high = np.where(right, 0.0, np.where(below, width, middle))
    at = np.where(right, -middle, middle)
    # f is taken as c + (weight of the nearer pole, exact) + (some weight on the pole at the other side)
    near, far = origin, np.where(right, rows, rows + 1)
    far[-1] = max(k - 2, 0)
    apart, weight = d[near] - d[far], z2[near]
    for _ in range(80):
        gaps = poles - at[:, None]
        p = z / gaps
        terms, f = np.abs(p * z).sum(1), 1 + p @ z
        found = np.abs(f) <= ROOT * (1 + terms)
        if found.all():
            break
        low, high = np.where(f < 0, at, low), np.where(f > 0, at, high)
        slope, x, y = np.einsum("ij,ij->i", p, p), gaps[rows, near], gaps[rows, far]
        with np.errstate(all="ignore"):
            a, b = (x + y) * f - x * y * slope, x * y * f
            c = f - y * slope - weight / (x * x) * apart
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            last = (a[-1] + root[-1]) / (2 * c[-1]) if a[-1] >= 0 else 2 * b[-1] / (a[-1] - root[-1])
            step[-1] = last if k > 1 else width[-1] - at[-1]
            new = at + step
            new = np.where((new >= low) & (new <= high) & (new != 0), new, (low + high) / 2)
        at = np.where(found, at, new)
    return d[origin] + at, poles - at[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (rows) of basis' diag(values) basis + vv'."""
    z = basis @ v
    if len(basis) < len(v):
        rest = v - z @ basis
        again = basis @ rest
        z, rest = z + again, rest - again @ basis
        size = np.linalg.norm(rest)
        if size > 1e-12 * np.linalg.norm(v):
            values, basis, z = np.append(0.0, values), np.vstack([rest / size, basis]), np.append(size, z)
    scale = (values[-1] if len(values) else 0.0) + z @ z
    if scale == 0:
        return values, basis
    weight = np.sqrt(z @ z)
    touched = np.abs(z) * weight > NO_WEIGHT * scale
    places = np.flatnonzero(touched)
    if np.any(np.diff(values[places]) <= SAME * scale):
        values, basis = values.copy(), basis.copy()
        for i, j in zip(places[:-1], places[1:]):
            if values[j] - values[i] <= SAME * scale:  # one direction of the plane takes all weight
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                basis[i], basis[j] = c * basis[i] - s * basis[j], s * basis[i] + c * basis[j]
                z[i], z[j], touched[i] = 0.0, r, False
        places = np.flatnonzero(touched)
    if not len(places):
        return values, basis
    d, w = values[places], z[places]
    roots, gaps = secular_roots(d, w)
    apart = d[:, None] - d
    np.fill_diagonal(apart, 1.0)
    w = np.copysign(np.sqrt(np.abs(gaps / apart).prod(0)), w)
    inner = w / gaps
    inner /= np.sqrt((inner * inner).sum(1))[:, None]
    turned = inner @ basis[places]
    if len(places) < len(values):
        still = ~touched
        roots, turned = np.append(values[still], roots), np.vstack([basis[still], turned])
    order = np.argsort(roots, kind="stable")
    return roots[order][-DIRECTIONS:], turned[order][-DIRECTIONS:]


class Spectrum:
    """Count, exact sums, mean and the eigenpairs of the scatter matrix of the vectors so far."""

    def __init__(self, n: int, sums, mean, values, basis):
        self.n, self.sums, self.mean, self.values, self.basis = n, sums, mean, values, basis

    @classmethod
    def of_none(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.empty(0), np.empty((0, width)))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def join(self, other: Spectrum) -> None:
        if not other.n:
            return
        n, away = self.n + other.n, other.mean - self.mean
        for value, direction in zip(other.values, other.basis):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, np.sqrt(value) * direction)
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, away * np.sqrt(self.n * other.n / n))
        self.mean, self.sums, self.n = self.mean + away * (other.n / n), self.sums + other.sums, n

    def row(self, task: int) -> dict:
        return {"task": task, "n": self.n, "sums": self.sums.tolist(), "mean": self.mean.tolist(),
                "values": self.values.tolist(), "basis": self.basis.ravel().tolist()}

    @classmethod
    def of_row(cls, row: dict) -> Spectrum:
        width = len(row["mean"])
        return cls(row["n"], np.array(row["sums"], np.int64), np.array(row["mean"]), np.array(row["values"]),
                   np.array(row["basis"]).reshape(-1, width))


_SPECTRUM_TYPES = pa.schema([("task", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
                             ("mean", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())),
                             ("basis", pa.list_(pa.float64()))])


@dataclass
class Model:
    """Components (rows, by falling variance) of the distinct vectors; `sums` / `n` is their mean."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @property
    def varied(self) -> np.ndarray:
        return self.variances > 1e-13 * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan where a component has no variance."""
        with np.errstate(all="ignore"):
            return ((x - self.mean) @ self.components.T) / np.where(self.varied, np.sqrt(self.variances), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        most = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        exact = x.astype(object) if most ** 2 * x.shape[1] >= 1 << 63 else x
        sums = self.sums.astype(object) if exact is not x else self.sums
        return [int(v) if v < 1 << 63 else None for v in ((self.n * exact - sums) ** 2).sum(1)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows whose entries are all finite."""
    entry = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), entry.alias("v")).filter(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("v") > 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("x"))


def _summed_rows(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Sums of equally numbered arrays of all tasks."""
    def add(key, table):
        total = _matrix(table.column("part").combine_chunks(), width).sum(0)
        return pa.table({"line": [key[0].as_py()], "part": [total.tolist()]})

    rows = parts.groupBy("line").applyInArrow(add, "line long, part array<double>").collect()  # of the model's size
    return {r.line: np.array(r.part) for r in rows}


def _spectrum(fit: DataFrame, width: int) -> Spectrum | None:
    def gather(batches):
        from pyspark import TaskContext

        found = Spectrum.of_none(width)
        for batch in batches:
            block = _matrix(batch.column("x"), width)
            found.sums = found.sums + block.sum(0)
            for x in block.astype(float):
                found.add(x)
        if found.n:
            yield pa.RecordBatch.from_pylist([found.row(TaskContext.get().partitionId())], _SPECTRUM_TYPES)

    def combine(key, table):
        rows = sorted(table.drop_columns("bucket").to_pylist(), key=lambda r: r["task"])
        total = Spectrum.of_row(rows[0])
        for r in rows[1:]:
            total.join(Spectrum.of_row(r))
        return pa.Table.from_pylist([total.row(rows[0]["task"])], _SPECTRUM_TYPES)

    spectra = written(fit.mapInArrow(gather, SPECTRUM), "spectra")
    tasks = spectra.agg(F.max("task")).first()[0]
    if tasks is None:
        return None
    reach = 1
    while reach <= tasks:
        reach *= FAN_IN
        spectra = (spectra.withColumn("bucket", F.floor(F.col("task") / reach)).groupBy("bucket")
                   .applyInArrow(combine, SPECTRUM))
    return Spectrum.of_row(spectra.first().asDict())


def _times_covariance(fit: DataFrame, basis: np.ndarray, mean: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """basis times the covariance, and the trace."""
    width = len(mean)

    def gather(batches):
        total, trace = np.zeros(basis.shape), 0.0
        for batch in batches:
            away = _matrix(batch.column("x"), width) - mean
            total += (away @ basis.T).T @ away
            trace += float((away * away).sum())
        yield pa.RecordBatch.from_pydict({
            "line": pa.array(range(len(basis) + 1), pa.int64()),
            "part": pa.array([*total.tolist(), [trace] + [0.0] * (width - 1)], pa.list_(pa.float64()))})

    lines = _summed_rows(fit.mapInArrow(gather, "line long, part array<double>"), width)
    return np.array([lines[i] for i in range(len(basis))]).reshape(basis.shape) / n, lines[len(basis)][0] / n


def _identity_error(fit: DataFrame, model: Model) -> float | None:
    live = np.flatnonzero(model.varied)
    if not len(live):
        return None
    size, width = len(live), len(model.sums)

    def gather(batches):
        total = np.zeros((size + 1, size))
        for batch in batches:
            y = model.project(_matrix(batch.column("x"), width).astype(float))[:, live]
            total[:size] += y.T @ y
            total[size] += y.sum(0)
        yield pa.RecordBatch.from_pydict({"line": pa.array(range(size + 1), pa.int64()),
                                          "part": pa.array(total.tolist(), pa.list_(pa.float64()))})

    lines = _summed_rows(fit.mapInArrow(gather, "line long, part array<double>"), size)
    mean = lines[size] / model.n
    covariance = np.array([lines[i] for i in range(size)]) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(size)).max())


def fit_model(vectors: DataFrame, components: int = 4) -> Model | None:
    """Components of the distinct `x` of `vectors`, all of one length; none where there is no vector."""
    fit = written(vectors.select("x").distinct(), "distinct-vectors")
    first = fit.select(F.size("x")).first()
    if first is None:
        return None
    width = first[0]
    found = _spectrum(fit, width)
    mean = found.sums / found.n
    # directions without variance complete the basis where there are fewer vectors than components
    basis = np.linalg.qr(np.vstack([found.basis[::-1], np.eye(width)[:max(0, components)]]).T)[0].T
    for _ in range(STEPS):
        image, trace = _times_covariance(fit, basis, mean, found.n)
        small = image @ basis.T
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
        ritz = turn.T @ basis
        rest = turn.T @ image - values[:, None] * ritz
        rest -= rest @ basis.T @ basis
        if len(basis) >= width or np.linalg.norm(rest, axis=1).max(initial=0) <= RESIDUAL * max(values[0], 0):
            break
        basis = np.linalg.qr(np.vstack([ritz, basis, rest])[:width].T if len(basis) + len(rest) <= width
                             else np.vstack([ritz, rest, basis])[:width].T)[0].T
    signs = np.sign(ritz[np.arange(len(ritz)), np.abs(ritz).argmax(1)])
    model = Model(found.n, found.sums, np.maximum(values, 0), ritz * signs[:, None], trace)
    model.identity_error = _identity_error(fit, model)
    return model


def transform(model: Model, vectors: DataFrame) -> DataFrame:
    """vec_id, deviation, whitened (an array, null where a component has no variance) of every row."""
    width = len(model.sums)

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            y = model.project(x.astype(float))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array(model.deviation(x), pa.int64()),
                pa.array([[None if np.isnan(v) else v for v in row] for row in y.tolist()], pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = whole_vectors(df, id_col, vector_col)
    common = vectors.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    model = None
    if common is not None:
        vectors = vectors.filter(F.size("x") == common["width"])
        model = fit_model(vectors, min(components, common["width"]))
    if model is None:
        return vectors.select("vec_id", F.lit(0).alias("component"), *[
            F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "double"),
                                                      ("explained", "double"), ("identity_error", "double"))]).limit(0)
    shares = [float(v / model.trace) if model.trace > 0 else None for v in model.variances]
    explained = F.array(*[F.lit(s).cast("double") for s in shares])
    return (transform(model, vectors)
            .select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
            .select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", explained[F.col("i")].alias("explained"),
                    F.lit(model.identity_error).cast("double").alias("identity_error")))
