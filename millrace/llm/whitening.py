"""Whitening of embeddings: Welford's streaming moments, merged across partitions, and a symmetric QR eigen-solve.

Each task folds its vectors one by one into a count, a mean and a scatter matrix (a rank-one update a vector); states of tasks are
merged, sixteen to one in rounds, by the parallel form of the same update. What reaches the driver is one state for each length of
vectors. Its eigenvectors come from Householder reflections to a tridiagonal matrix and implicit QR steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._base import Workspace, give_back, mapped, rows_of, table

#: Entries are taken in steps of 1 / UNITS.
UNITS = 256
COMPONENTS = 4
#: States of tasks that one task of the next round merges.
FAN_IN = 16
#: Variance, as a share of the largest, below which a component has no whitened values.
LEAST_VARIANCE = 1e-11
STATE = "part int, d int, n long, high array<long>, low array<long>, mean array<double>, scatter binary"


class Moments:
    """Count, exact sums (in high and low halves), mean and scatter matrix of vectors of d whole numbers or doubles."""

    def __init__(self, d: int):
        self.n, self.high, self.low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        self.mean, self.scatter, self._step = np.zeros(d), np.zeros((d, d)), np.empty((d, d))

    def add(self, block: np.ndarray) -> None:
        """A rank-one update for each row of a block."""
        if block.dtype == np.int64:
            self.carry((block >> 32).sum(axis=0), (block & 0xFFFFFFFF).sum(axis=0))
        mean, scatter, step = self.mean, self.scatter, self._step
        for x in block.astype(np.float64):
            self.n += 1
            x -= mean
            np.multiply(x[:, None], x * ((self.n - 1) / self.n), out=step)
            scatter += step
            x /= self.n
            mean += x

    def carry(self, high: np.ndarray, low: np.ndarray) -> None:
        low = self.low + low
        self.high, self.low = self.high + high + (low >> 32), low & 0xFFFFFFFF

    def merge(self, o: Moments) -> None:
        """The moments of both lists together."""
        n = self.n + o.n
        if o.n:
            away = o.mean - self.mean
            self.scatter += o.scatter + np.outer(away, away * (self.n * o.n / n))
            self.mean += away * (o.n / n)
            self.n = n
            self.carry(o.high, o.low)

    def sums(self) -> list[int]:
        return [(h << 32) + x for h, x in zip(self.high.tolist(), self.low.tolist(), strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * max(1, self.n))

    @staticmethod
    def rows(states: dict[int, Moments]) -> pa.RecordBatch:
        """States by length of vectors, as a batch of STATE."""
        found = [(d, m) for d, m in states.items() if m.n]
        listed = lambda f, kind: pa.array([f(m).tolist() for _, m in found], pa.list_(kind))
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(found), pa.int32()),
                pa.array([d for d, _ in found], pa.int32()),
                pa.array([m.n for _, m in found], pa.int64()),
                listed(lambda m: m.high, pa.int64()),
                listed(lambda m: m.low, pa.int64()),
                listed(lambda m: m.mean, pa.float64()),
                pa.array([m.scatter.tobytes() for _, m in found], pa.binary()),
            ],
            names=["part", "d", "n", "high", "low", "mean", "scatter"],
        )

    @staticmethod
    def of(row: dict) -> Moments:
        m = Moments(len(row["mean"]))
        m.n, m.high, m.low = row["n"], np.array(row["high"], np.int64), np.array(row["low"], np.int64)
        m.mean, m.scatter = np.array(row["mean"], float), np.frombuffer(bytes(row["scatter"])).reshape(m.scatter.shape).copy()
        return m


def merge_into(states: dict[int, Moments], row: dict) -> None:
    m = Moments.of(row)
    if row["d"] in states:
        states[row["d"]].merge(m)
    else:
        states[row["d"]] = m


def merged(states: DataFrame, parts: int) -> dict[int, Moments]:
    """One state for each length of vectors, from the states of `parts` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for b in batches:
            for row in b.to_pylist():
                merge_into(own, row)
        yield Moments.rows(own)

    while parts > 1:
        parts = -(-parts // FAN_IN)
        states = mapped(states.repartition(parts, F.floor(F.col("part") / FAN_IN)), run, STATE)
    out: dict[int, Moments] = {}
    for row in states.collect():  # of one task: a row for each length
        merge_into(out, row.asDict())
    return out


def whole_vectors(column: pa.Array, units: int = UNITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers floor(units * entry) by row) for each length. Rows that are null, hold a null or an entry that is
    not finite or beyond a long in these units, and empty ones, are in none."""
    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * units)
    end = np.cumsum(n)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 2.0**63))])
    ok = (n > 0) & (bad[end] == bad[end - n])
    out = []
    for d in np.unique(n[ok]).tolist():
        rows = np.flatnonzero(ok & (n == d))
        out.append((rows, flat[(end[rows] - d)[:, None] + np.arange(d)].astype(np.int64)))
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: the number of bytes an entry, then the entries."""
    width = np.where((np.abs(x) < 1 << 15).all(axis=1), 2, 8)
    return [(b"\2" + r.astype("<i2").tobytes()) if w == 2 else (b"\x08" + r.astype("<i8").tobytes()) for r, w in zip(x, width.tolist(), strict=True)]


def unpacked(raws: list[bytes]) -> dict[int, np.ndarray]:
    """The rows of packed bytes by length."""
    by: dict[tuple[int, int], list[bytes]] = {}
    for r in raws:
        by.setdefault((r[0], len(r)), []).append(r[1:])
    out: dict[int, list[np.ndarray]] = {}
    for (w, size), rs in by.items():
        d = (size - 1) // w
        out.setdefault(d, []).append(np.frombuffer(b"".join(rs), f"<i{w}").reshape(len(rs), d).astype(np.int64))
    return {d: np.concatenate(xs) for d, xs in out.items()}


def distinct_vectors(df: DataFrame, vector: str = "embedding", units: int = UNITS) -> DataFrame:
    """Each vector of whole numbers once, packed, in a column x. Copies are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [r for _, x in whole_vectors(b.column("v"), units) for r in packed(x)]
            yield pa.RecordBatch.from_arrays([pa.array(raws, pa.binary())], names=["x"])
        give_back()

    return mapped(rows_of(df, v=vector), run, "x binary").distinct()


def moments(vectors: DataFrame, project: dict[int, Projection] | None = None) -> dict[int, Moments]:
    """The moments of packed vectors, or of what `project` whitens them to, by the vectors' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for b in batches:
            for d, x in unpacked(b.column("x").to_pylist()).items():
                values = x if project is None else project[d].whitened(x)
                own.setdefault(d, Moments(values.shape[1])).add(values)
        yield Moments.rows(own)

    return merged(mapped(vectors, run, STATE), vectors.rdd.getNumPartitions())


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric matrix: reflections to a tridiagonal one, then implicit
    QR steps with Wilkinson's shift, each chasing its bulge by rotations."""
    n = len(a)
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    a, rows = np.array(a, float) / scale, np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = float(np.copysign(np.linalg.norm(x), x[0]))
        if not np.any(x[1:]):
            continue
        x[0] += norm
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = p - (x @ p) * x
        rest -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -norm
        rows[k + 1 :] -= 2 * np.outer(x, x @ rows[k + 1 :])
    d, e = np.diag(a).tolist(), np.diag(a, -1).tolist()
    eps, last = np.finfo(float).eps, n - 1
    while last > 0:
        for i in range(last):
            if abs(e[i]) <= eps * (abs(d[i]) + abs(d[i + 1])) + 1e-300:
                e[i] = 0.0
        if e[last - 1] == 0:
            last -= 1
            continue
        first = last - 1
        while first > 0 and e[first - 1] != 0:
            first -= 1
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + np.copysign(np.hypot(half, e[last - 1]), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = float(np.hypot(x, z))
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            u, v, w = d[k], d[k + 1], e[k]
            d[k], d[k + 1], e[k] = c * c * u + 2 * c * s * w + s * s * v, s * s * u - 2 * c * s * w + c * c * v, c * s * (v - u) + (c * c - s * s) * w
            rows[k : k + 2] = np.array([[c, s], [-s, c]]) @ rows[k : k + 2]
            if k < last - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
    values = np.array(d) * scale
    order = np.argsort(-values, kind="stable")
    return values[order], rows[order]


@dataclass
class Projection:
    """The fitted whitening of vectors of one length: n distinct vectors with sums S, and of the leading components the variances,
    their shares of the whole and the unit eigenvectors. identity_error: how far the whitened fit list is from unit covariance."""

    n: int
    sums: list[int]
    variance: np.ndarray
    share: list[float | None]
    axes: np.ndarray
    identity_error: float | None = None

    @property
    def kept(self) -> int:
        """Leading components with a variance that counts."""
        return int((self.variance > LEAST_VARIANCE * self.variance[0]).sum()) if len(self.variance) else 0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        k = self.kept
        away = x - np.array([s / self.n for s in self.sums])
        if not k:
            return np.zeros((len(x), 0))
        return np.stack([(away * axis).sum(axis=1) / np.sqrt(v) for axis, v in zip(self.axes[:k], self.variance[:k], strict=True)], axis=1)  # a row's value depends on that row alone

    def deviation(self, x: np.ndarray) -> list[int]:
        """sum((n x - S)^2) of each row, exactly."""
        most = max(self.n * (int(np.abs(x.astype(float)).max(initial=0)) + 1), max(map(abs, self.sums)))
        if 4 * most * most * x.shape[1] < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * c - s) ** 2 for c, s in zip(r, self.sums, strict=True)) for r in x.tolist()]


def fitted(m: Moments, components: int = COMPONENTS) -> Projection:
    """From the moments of a fit list. Each eigenvector's entry of largest size is positive."""
    v = m.covariance()
    values, axes = symmetric_qr(v)
    values, axes, total = np.maximum(values[:components], 0), axes[:components], float(np.trace(v))
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Projection(m.n, m.sums(), values, [float(x / total) if total > 0 else None for x in values], axes)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, units: int = UNITS) -> dict[int, Projection]:
    """The whitening of the distinct whole-number vectors of df, for each length of vectors. The distinct vectors are written to the
    shared folder and read twice: for the moments, and for the covariance of what they are whitened to."""
    ws = Workspace(df.sparkSession, "whitening")
    vectors = ws.save(distinct_vectors(df, vector, units), "vectors")
    found = {d: fitted(m, components) for d, m in moments(vectors).items()}
    for d, m in (moments(vectors, found) if found else {}).items():
        if len(m.mean):
            found[d].identity_error = float(np.abs(m.covariance() - np.eye(len(m.mean))).max())
    ws.drop("vectors")
    return found


def whiten(df: DataFrame, projections: dict[int, Projection], vector: str = "embedding", whitened: str = "whitened", units: int = UNITS) -> DataFrame:
    """The rows of df that have a vector, with an array column `whitened` of structs, one for each component: component (from 1), n
    (the fit list's size), deviation (decimal: sum((n x - S)^2), exact; null beyond 38 digits), whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null, an entry that is not finite or one beyond a long in the units are dropped; a
    vector of d entries is whitened by the fit of that length, and has at most d components. Components of no variance (copies of
    one vector, say) have a null `whitened`. Equal vectors get equal values; repeated rows and null keys are rows like others. An
    input column named as the new one is replaced. An empty table gives none. No shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(projections)  # a few vectors for each length
    item = T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    schema = T.StructType([f for f in df.schema.fields if f.name != whitened] + [T.StructField(whitened, T.ArrayType(item))])
    kind = pa.struct([("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                for rows, x in whole_vectors(b.column(vector), units):
                    p = sent.value[x.shape[1]]
                    n, k = len(rows), len(p.share)
                    w = np.full((n, k), np.nan)
                    w[:, : p.kept] = p.whitened(x)
                    away = [Decimal(v) if v < 10**38 else None for v in p.deviation(x)]
                    made = [
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, p.n)),
                        pa.array([v for v in away for _ in range(k)], pa.decimal128(38, 0)),
                        pa.array(w.ravel(), pa.float64(), from_pandas=True),
                        pa.array(p.share * n, pa.float64()),
                        pa.array([p.identity_error] * (n * k), pa.float64()),
                    ]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.StructArray.from_arrays(made, fields=list(kind)))
                    kept = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([lists if f.name == whitened else kept.column(f.name) for f in schema.fields], names=schema.names)
        give_back()

    return mapped(df, run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of embeddings that has a vector, whitened to four components. deviation is null beyond a long."""
    rows = rows_of(table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding")
    out = whiten(rows, fit(rows)).select("vec_id", F.inline("whitened"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
