r"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined by Ogita-Aishima iterations.

Vectors become whole numbers x = floor(``SCALE`` * c). The fit list holds each distinct x once. Its count n and sums S are exact, and
so is its covariance: every y = x - round(S / n) is cut into ``LIMB``-bit parts whose products sum exactly in tasks and in
Spark, and the driver takes (n * sum(y y') - sum(y) sum(y)') / n**2 in whole numbers. What reaches the driver is a row for each
pair of dimensions, whatever the table holds.

``eigenvectors`` starts from a float32 decomposition. Each refinement is four matrix products (Ogita and Aishima): the
residuals R = I - X'X and X'AX give the correction of every pair of vectors whose eigenvalues are apart by more than the
residuals; other pairs (a cluster) only become orthogonal. Clusters are then solved by themselves: the matrix, shifted by the
cluster's mean and projected on its vectors, is decomposed and turns them, and refinement goes on. Rounds run in double precision
and the last ones in the widest float of the machine.

Rows are projected where they stand: no shuffle but that of the distinct vectors.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry go; of vectors of different length the shorter
count as padded by zeros; x ends at the ends of a long; repeated rows and ids are projected each by itself; an empty table gives no rows;
a component without variance (all vectors equal, or fewer distinct vectors than components) has whitened and explained 0 and no part in
identity_error; a deviation beyond a long is null; vectors of no entries give no rows. Of an input's columns only ``keep`` stays; one with
the name of an output is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.llm import textkit as tk

SCALE = 256
#: Bits of a part of a centred entry: products of two parts of 2**21 rows sum exactly in a double.
LIMB = 16
#: Rows of vectors that are worked on together.
ROWS = 2048
#: Steps of the summed products of whitened values, which are then the same for any partitioning.
STEPS = 1 << 40
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")
WIDE = np.longdouble


@dataclass(frozen=True)
class Model:
    """Exact counts and sums of the fit list, its eigenvalues (falling) with unit vectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries as doubles, n+1 offsets, and whether each row's vector is whole (no null, all finite)."""
    column = column.cast(pa.large_list(pa.float64()))
    offs = column.offsets.to_numpy()
    inner = column.values
    values = pc.fill_null(inner, float("nan")).to_numpy(zero_copy_only=False)
    bad = tk.sums(~np.isfinite(values))
    whole = (np.diff(bad[offs]) == 0) & column.is_valid().to_numpy(zero_copy_only=False)
    return values, offs, whole


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) as long, at most the ends of a long."""
    with np.errstate(over="ignore"):
        x = np.floor(values * SCALE)
    out = np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)
    out[x >= 2.0**63] = np.iinfo(np.int64).max
    out[x < -(2.0**63)] = np.iinfo(np.int64).min
    far = (np.abs(x) > 2.0**62) & (x < 2.0**63) & (x >= -(2.0**63))
    out[far] = x[far].astype(np.int64)
    return out


def _matrix(values: np.ndarray, offs: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """x-vectors of ``rows``, padded with zeros to ``width``."""
    out = np.zeros((len(rows), width), np.int64)
    size = np.diff(offs)[rows]
    picked, _ = tk.gather(values, offs, rows)
    out[np.arange(width) < size[:, None]] = quantised(picked)
    return out


def _packed(x: np.ndarray) -> pa.Array:
    """Each vector as bytes in the narrowest width that holds it: equal vectors have equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    rows: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), bool)
    for kind in ("<i2", "<i4", "<i8"):
        info = np.iinfo(kind)
        now = np.flatnonzero(left & (low >= info.min) & (high <= info.max))
        left[now] = False
        small = np.ascontiguousarray(x[now].astype(kind))
        for r, row in zip(now.tolist(), small, strict=True):
            rows[r] = row.tobytes()
    return pa.array(rows, pa.large_binary())


def _unpacked(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The vectors again, up to ``ROWS`` at a time."""
    data, offs = tk.strings(column)
    size = np.diff(offs)
    for lo in range(0, len(size), ROWS):
        part = np.arange(lo, min(len(size), lo + ROWS))
        out = np.zeros((len(part), width), np.int64)
        for kind in ("<i2", "<i4", "<i8"):
            mine = size[part] == width * np.dtype(kind).itemsize
            if mine.any():
                picked, _ = tk.gather(data, offs, part[mine])
                out[mine] = np.frombuffer(picked.tobytes(), kind).reshape(-1, width)
        yield out


def _less(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """x - base; in Python's whole numbers where the difference may not fit a long."""
    far = max(int(np.abs(x).max(initial=0)), int(np.abs(base).max(initial=0))) >= 1 << 62 or (x == np.iinfo(np.int64).min).any()
    return x.astype(object) - base if far else x - base


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed parts of LIMB bits, lowest first, that sum to ``y``; as doubles."""
    parts = []
    while (y != 0).any() or not parts:
        low = ((y + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        parts.append(low.astype(np.float64))
        y = (y >> LIMB) + (low < 0)
    return parts


def eigenvectors(exact: np.ndarray, *, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit vectors, as columns, of the symmetric ``exact``; longdouble accuracy where vectors are apart."""
    size = float(np.abs(exact).max(initial=0)) or 1.0
    matrix = (exact / size).astype(WIDE)
    _, start = np.linalg.eigh(matrix.astype(np.float32))
    vectors = start.astype(np.float64)
    for kind in (np.float64, WIDE):
        a, x = matrix.astype(kind), vectors.astype(kind)
        before = None
        for _ in range(rounds):
            x, values, gap, moved = _refined(a, x)
            x = _separated(a, x, values, gap)
            if moved <= 4 * float(np.finfo(kind).eps) or (before is not None and moved > before / 2 and moved < 1e-9):
                break
            before = moved
        vectors = x
    x, values, _, _ = _refined(matrix, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order] * WIDE(size), x[:, order]


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: vectors, eigenvalues, the gap below which two values are one cluster, and the largest change."""
    rest = np.eye(len(a), dtype=a.dtype) - x.T @ x
    seen = x.T @ (a @ x)
    # The correction is half the residual, symmetric, and a turn, antisymmetric; so rounding in close pairs can't undo orthogonality.
    rest, seen = (rest + rest.T) / 2, (seen + seen.T) / 2
    values = np.diag(seen) / (1 - np.diag(rest))
    off = seen - np.diag(values)
    gap = 2 * float(np.sqrt((off * off).sum()) + np.abs(values).max(initial=0) * np.sqrt((rest * rest).sum()))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    step = rest / 2 + np.where(far, (seen + (values[None, :] + values[:, None]) / 2 * rest) / np.where(far, apart, 1), 0)
    return x + x @ step, values, gap, float(np.abs(step).max(initial=0))


def _separated(a: np.ndarray, x: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """``x`` with the vectors of each cluster turned by the decomposition of the shifted matrix on their span."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order].astype(np.float64)) > gap) + 1
    out = x.copy()
    for members in np.split(order, cuts):
        if len(members) < 2:
            continue
        span = x[:, members]
        shift = values[members].mean()
        small = span.T @ (a @ span - shift * span)
        small = ((small + small.T) / 2).astype(np.float64)
        scale = float(np.abs(small).max())
        if scale:
            _, turn = np.linalg.eigh(small / scale)
            out[:, members] = span @ turn.astype(a.dtype)
    return out


def fit(table: DataFrame, *, vector: str = "embedding", components: int = 4) -> Model | None:
    """The whitening of the distinct vectors of ``table``; None without any."""
    tk.checkpoint_dir(table.sparkSession)
    taken = table.select(F.col(vector).alias("v"))
    whole = taken.filter(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))))
    width = whole.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    if not width:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offs, sound = _lists(batch.column(0))
            rows = np.flatnonzero(sound)
            for lo in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([_packed(_matrix(values, offs, rows[lo : lo + ROWS], width)).cast(pa.binary())], names=["x"])

    distinct = taken.mapInArrow(pack, "x binary").distinct().checkpoint()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A long cut in two halves of 32 bits: each half's sum over a task fits a long.
        count, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for x in _unpacked(batch.column(0), width):
                count += len(x)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                high += (x >> 32).sum(axis=0)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width)), pa.array(np.concatenate([[count], low])), pa.array(np.concatenate([[0], high]))], names=["i", "low", "high"])

    exact = "decimal(38,0)"
    sums = distinct.mapInArrow(add, "i long, low long, high long").groupBy("i").agg(F.sum(F.col("low").cast(exact)).alias("low"), F.sum(F.col("high").cast(exact)).alias("high")).collect()
    found = {r["i"]: int(r["low"]) + (int(r["high"]) << 32) for r in sums}
    n, total = found[-1], [found[i] for i in range(width)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    middle = np.array([min(max(c, -(1 << 63)), (1 << 63) - 1) for c in centre], np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _unpacked(batch.column(0), width):
                parts = _limbs(_less(x, middle))
                for a, left in enumerate(parts):
                    for b, right in enumerate(parts):
                        products[a + b] = products.get(a + b, 0) + (left.T @ right).astype(np.int64)
        for weight, product in products.items():
            at = np.flatnonzero(product)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), weight)), pa.array(at), pa.array(product.ravel()[at])], names=["weight", "at", "v"])

    rows = distinct.mapInArrow(multiply, "weight long, at long, v long").groupBy("weight", "at").agg(F.sum(F.col("v").cast(exact)).alias("v")).collect()
    raw = [0] * (width * width)
    for r in rows:
        raw[r["at"]] += int(r["v"]) << (LIMB * r["weight"])
    rest = [s - n * c for s, c in zip(total, middle.tolist(), strict=True)]
    square = [n * raw[i * width + j] - rest[i] * rest[j] for i in range(width) for j in range(width)]
    # Whole numbers of any size divided once: the quotient is right to the last bit of a longdouble's two halves.
    covariance = np.array([_quotient(v, n * n) for v in square], WIDE).reshape(width, width)
    values, vectors = eigenvectors(covariance)
    trace = _quotient(sum(square[i * width + i] for i in range(width)), n * n)
    took = min(components, width)
    values = np.where(values > trace * WIDE(2.0**-50) * width, values, 0)[:took]
    model = Model(n, total, values.astype(np.float64), vectors[:, :took].astype(np.float64), float(trace))
    return Model(n, total, model.values, model.vectors, model.trace, _identity_error(distinct, model, width))


def _quotient(a: int, b: int) -> np.longdouble:
    head = a / b
    top, bottom = head.as_integer_ratio()
    return WIDE(head) + WIDE((a * bottom - top * b) / (b * bottom))


class _Projection:
    """Projects x-vectors by a model: (x - S / n) on each component, over the root of its value."""

    def __init__(self, model: Model):
        self.n = model.n
        self.sums = model.sums
        self.whole = [s // model.n for s in model.sums]
        self.part = np.array([s % model.n / model.n for s in model.sums])
        self.base = np.array([min(max(w, -(1 << 63)), (1 << 63) - 1) for w in self.whole], np.int64)
        root = np.sqrt(model.values)
        self.weight = np.where(root > 0, model.vectors / np.where(root > 0, root, 1), 0.0)
        self.most = max(abs(s) for s in model.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (_less(x, self.base).astype(np.float64) - self.part) @ self.weight

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - S)**2 of each row, in whole numbers; null beyond a long."""
        largest = (self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + self.most) ** 2 * x.shape[1]
        if largest < 1 << 63:
            d = x * self.n - np.array(self.sums, np.int64)
            return pa.array((d * d).sum(axis=1))
        sums = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in sums], pa.int64())


def _identity_error(distinct: DataFrame, model: Model, width: int) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity, over the components with variance."""
    took = np.flatnonzero(model.values > 0)
    if not len(took):
        return 0.0
    sent = distinct.sparkSession.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _Projection(sent.value)
        for batch in batches:
            for x in _unpacked(batch.column(0), width):
                w = project.whitened(x)[:, took]
                both = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(np.rint(both * STEPS).astype(np.int64))], names=["i", "v"])

    rows = distinct.mapInArrow(moments, "i long, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    mean = np.zeros(len(took) * (len(took) + 1))
    for r in rows:
        mean[r["i"]] = int(r["v"]) / (STEPS * model.n)
    first, second = mean[: len(took)], mean[len(took) :].reshape(len(took), -1)
    return float(np.abs(second - np.outer(first, first) - np.eye(len(took))).max())


def transform(table: DataFrame, model: Model | None, *, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """(keep, component, n, deviation, whitened, explained, identity_error) of every whole vector of ``table``."""
    keep = [c for c in table.columns if c != vector] if keep is None else keep
    if clash := set(keep) & set(ADDED):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*(table.schema[c] for c in keep), *(T.StructField(c, k) for c, k in zip(ADDED, kinds, strict=True))])
    taken = table.select(*keep, F.col(vector).alias("__vector"))
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    # A few vectors of one entry a dimension: a bounded broadcast.
    sent, width, took = table.sparkSession.sparkContext.broadcast(model), len(model.sums), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        by = _Projection(model)
        share = model.values / model.trace if model.trace else model.values
        for batch in batches:
            values, offs, sound = _lists(batch.column(batch.num_columns - 1))
            rows = np.flatnonzero(sound)
            for lo in range(0, len(rows), ROWS):
                part = rows[lo : lo + ROWS]
                x = _matrix(values, offs, part, width)
                each = pa.array(np.repeat(np.arange(len(part)), took))
                kept = [c.take(pa.array(part)).take(each) for c in batch.columns[:-1]]
                columns = [
                    pa.array(np.tile(np.arange(1, took + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(len(each), model.n)),
                    by.deviation(x).take(each),
                    pa.array(by.whitened(x).ravel()),
                    pa.array(np.tile(share, len(part))),
                    pa.array(np.full(len(each), model.error)),
                ]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=schema.names)

    return taken.mapInArrow(project, schema)
