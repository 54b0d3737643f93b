"""Embedding whitening by an incremental eigendecomposition.

Every partition keeps the spectrum of its own centred scatter matrix: eigenvalues and eigenvectors, a mean and a count. Rows
come in as centred rank-one updates. An update solves the secular equation 1 + r * sum(z_i^2 / (d_i - x)) = 0 between the
poles d_i, after deflation has set aside the directions that it does not move. Two spectra are combined the same way: every
eigenpair of one, and the difference of the means, is a rank-one update of the other. Of a batch of rows, first the triangular
factor of the centred batch is taken, whose rows have the same scatter, so a batch costs as many updates as there are
dimensions. The spectrum of all partitions spans the space in which a last distributed pass forms the Rayleigh quotient of the
exact centred integers; its eigenvectors turn the basis to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

OFFSET, SCALE = 100_000, 1024
ROOT_ROUNDS = 80  # of the secular equation; every round at least halves the bracket
BATCH = 1 << 14  # rows whose triangular factor is taken at once
FAN_IN = 64  # spectra combined in one task
LIMIT = float(1 << 62)
_STATE = pa.schema([("n", pa.int64()), ("mean", pa.binary()), ("values", pa.binary()), ("vectors", pa.binary())])
STATE = "n long, mean binary, values binary, vectors binary"


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z_i^2 / (d_i - x)) with d rising strictly and no z zero: each as its nearer pole's place and the
    distance from there, so differences to the poles keep their full precision."""
    n, w = len(d), z * z
    gap = np.append(d[1:] - d[:-1], w.sum())
    # which half a root lies in, by the sign in the middle; the last root is measured from its own pole
    middle = d + gap / 2
    below = (1 + (w[None, :] / (d[None, :] - middle[:, None])).sum(1)) > 0  # root lies left of the middle
    base = np.where(below | (np.arange(n) == n - 1), np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    poles = d[None, :] - d[base][:, None]
    left = base == np.arange(n)
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.where(np.arange(n) == n - 1, gap, gap / 2), 0.0)
    x = (low + high) / 2
    for _ in range(ROOT_ROUNDS):
        with np.errstate(divide="ignore", invalid="ignore"):
            part = poles - x[:, None]
            f = 1 + (w / part).sum(1)
            slope = (w / (part * part)).sum(1)
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            # Newton on the equation times the distance to the nearest pole, kept in the bracket, else halve
            g, dg = f * x, f + slope * x
            step = x - g / dg
        ok = np.isfinite(step) & (step > low) & (step < high)
        new = np.where(ok, step, (low + high) / 2)
        if (np.abs(new - x) <= 4e-16 * np.abs(new)).all():
            x = new
            break
        x = new
    return base, x


class Spectrum:
    """Eigenvalues (rising) and eigenvectors (columns) of a centred scatter matrix, with the mean and count of its rows."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def update(self, u: np.ndarray) -> None:
        """Add the outer product of u with itself."""
        z = self.vectors.T @ u
        size = np.sqrt((z * z).sum())
        if not size:
            return
        scale = max(float(self.values[-1]), size * size)
        tiny = 8 * np.finfo(float).eps
        # deflation: directions u does not touch stay, equal eigenvalues are turned so that only one of them is touched
        live = np.abs(z) * size > tiny * scale
        places = np.flatnonzero(live)
        keep = []
        for i in places.tolist():
            if keep and self.values[i] - self.values[keep[-1]] <= tiny * scale:
                j = keep[-1]
                r = np.hypot(z[i], z[j])
                c, s = z[i] / r, z[j] / r
                vi, vj = self.vectors[:, i].copy(), self.vectors[:, j].copy()
                self.vectors[:, i], self.vectors[:, j] = c * vi + s * vj, c * vj - s * vi
                z[i], z[j] = r, 0.0
                keep[-1] = i
            else:
                keep.append(i)
        at = np.array(keep)
        if len(at):
            d, zz = self.values[at], z[at]
            base, x = secular_roots(d, zz)
            poles = d[None, :] - d[base][:, None] - x[:, None]  # d_i - root_k, row k
            # the z that has exactly these roots gives orthogonal eigenvectors
            m = len(d)
            ratio = np.empty(m)
            for i in range(m):
                other = np.arange(m) != i
                below = -poles[:, i]  # root_k - d_i
                gaps = d - d[i]
                pairs = np.concatenate([below[:i] / gaps[:i], below[i:m - 1] / gaps[i + 1:]]) if other.any() else np.array([])
                ratio[i] = np.prod(pairs) * below[m - 1]
            exact = np.sqrt(np.maximum(ratio, 0)) * np.sign(zz)
            q = exact[None, :] / poles
            q /= np.sqrt((q * q).sum(1))[:, None]
            self.vectors[:, at] = self.vectors[:, at] @ q.T
            self.values[at] = d[base] + x
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = np.maximum(self.values[order], 0), self.vectors[:, order]

    def combine(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Add n rows with this mean whose centred scatter is that of ``rows``."""
        if not n:
            return
        away = mean - self.mean
        for u in rows:
            self.update(u)
        if self.n:
            self.update(away * np.sqrt(self.n * n / (self.n + n)))
        self.n += n
        self.mean = self.mean + away * (n / self.n)

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), BATCH):
            part = x[at:at + BATCH]
            mean = part.mean(0)
            centred = part - mean
            self.combine(len(part), mean, np.linalg.qr(centred, mode="r") if len(centred) > centred.shape[1] else centred)

    def merge(self, other: Spectrum) -> None:
        self.combine(other.n, other.mean, np.sqrt(other.values)[:, None] * other.vectors.T)

    def pack(self) -> pa.RecordBatch:
        values = [self.n], *([np.ascontiguousarray(a).tobytes()] for a in (self.mean, self.values, self.vectors))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, _STATE.types, strict=True)], schema=_STATE)

    @classmethod
    def unpack(cls, n: int, mean: bytes, values: bytes, vectors: bytes) -> Spectrum:
        out = cls(len(mean) // 8)
        out.n, out.mean, out.values = n, np.frombuffer(mean), np.frombuffer(values).copy()
        out.vectors = np.frombuffer(vectors).reshape(len(out.values), -1).copy()
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def spectrum(rows: DataFrame, width: int) -> Spectrum:
    """The spectrum of all rows (column x, array of long): one of each partition, then combined FAN_IN at a time."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(width)
        for batch in batches:
            s.add(_matrix(batch["x"], width).astype(np.float64))
        if s.n:
            yield s.pack()

    def combine(part: pa.Table) -> pa.Table:
        s = Spectrum(width)
        for row in sorted(part.select(_STATE.names).to_pylist(), key=lambda r: (r["n"], r["mean"])):
            s.merge(Spectrum.unpack(**row))
        return pa.Table.from_batches([s.pack()])

    states = written(rows.select("x").mapInArrow(fold, STATE), "whiten-states")
    while (many := states.count()) > FAN_IN:
        groups = -(-many // FAN_IN)
        states = written(states.groupBy(F.pmod(F.xxhash64("mean", "n"), F.lit(groups)).alias("part")).applyInArrow(combine, STATE), "whiten-states")
    s = Spectrum(width)
    for row in sorted((r.asDict() for r in states.collect()), key=lambda r: (r["n"], bytes(r["mean"]))):  # FAN_IN at most
        s.merge(Spectrum.unpack(**row))
    return s


def _scatter(rows: DataFrame, width: int, project, out: int) -> np.ndarray:
    """Sum over all rows of the outer product of project(x) with itself, one small matrix of each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out, out))
        for batch in batches:
            y = project(_matrix(batch["x"], width))
            total += y.T @ y
        i, j = np.triu_indices(out)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.array_sort(F.collect_list("s")).alias("s"))
    got = sums.select("i", "j", F.aggregate("s", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()  # out * out / 2 numbers
    total = np.zeros((out, out))
    for r in got:
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["s"]
    return total


def whitened(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    ``vectors`` needs vec_id, embedding; other columns are ignored. Vectors that are null or hold a null or non-finite entry
    are left out; an entry c becomes floor(1024 * c) + 100000. Vectors of different lengths are an error, as are values too
    large for exact 64-bit deviations. Repeated rows and rows without vec_id count like any other. Components without
    variance (rank below ``components``; a single vector; equal vectors only) have no rows. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE) + OFFSET)
    rows = vectors.filter(F.col("embedding").isNotNull()).filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))
    rows = written(rows, "whiten-rows")
    n, width, shortest, low, high = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not width:
        return spark.createDataFrame([], schema)
    if shortest != width:
        raise ValueError(f"vectors have {shortest} to {width} components")
    if float(n) * max(abs(low), abs(high)) >= LIMIT:
        raise OverflowError(f"sums of {n} entries between {low} and {high} leave 64 bits")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += _matrix(batch["x"], width).sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    sums = np.zeros(width, np.int64)
    for r in rows.select("x").mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect():  # one number a dimension
        sums[r["i"]] = r["s"]
    centred = lambda x: (x * n - sums) / n  # noqa: E731  exact integers, rounded once
    basis = np.linalg.qr(spectrum(rows, width).vectors)[0]
    quotient = _scatter(rows, width, lambda x: centred(x) @ basis, width) / n
    values, turn = np.linalg.eigh(quotient)
    order = np.argsort(-values, kind="stable")
    values, directions = values[order], (basis @ turn)[:, order]
    trace = float(np.trace(quotient))
    m = int((values[:components] > max(values[0], 0) * width * np.finfo(float).eps).sum())
    if not m:
        return spark.createDataFrame([], schema)
    weights = directions[:, :m] / np.sqrt(values[:m])
    project = lambda x: centred(x) @ weights
    error = float(np.abs(_scatter(rows, width, project, m) / n - np.eye(m)).max())
    shares = (values[:m] / trace).tolist()
    arrow = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = _matrix(part["x"], width)
                away = x * n - sums
                if (away.astype(np.float64) ** 2).sum(1).max(initial=0) >= LIMIT:
                    raise OverflowError("a deviation leaves 64 bits")
                columns = (np.repeat(part["vec_id"].to_numpy(zero_copy_only=False), m) if not part["vec_id"].null_count else [i for i in part["vec_id"].to_pylist() for _ in range(m)],
                           np.tile(np.arange(1, m + 1), len(x)), np.repeat((away * away).sum(1), m), project(x).reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    found = rows.mapInArrow(final, "vec_id long, component int, deviation long, whitened double")
    return found.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                        F.get(F.array(*[F.lit(s) for s in shares]), F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
