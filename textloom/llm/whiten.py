"""Embedding whitening with eigenvectors by FEAST contour integration.

Entries become whole numbers, x = floor(256 * c). The fit list is every distinct x vector
once; its size n, sums S and centred second moments are whole numbers too, added up by
Spark and combined exactly, so the covariance does not depend on partitions, copies or the
order of rows. Only sums leave the tasks: dim * (dim + 1) / 2 numbers, whatever the number
of rows.

The leading eigenpairs of the covariance V come from contour integrals. Counts of the signs
in a symmetric factorisation of V - s (its inertia) tell how many eigenvalues lie above s;
bisecting on them finds intervals that hold the wanted eigenvalues, a few each, with edges
in gaps. For an interval, the resolvent of V is integrated along a circle around it: a
quadrature of solves with complex shifts projects a block of start vectors onto the
interval's eigenvectors. Rayleigh-Ritz in that subspace gives values and vectors, which
start the next pass until residuals are at rounding. The inertia at both edges must equal
the number of pairs found; otherwise the block is enlarged.

Rows whose vector is null, or holds a null or non-finite entry, are dropped. The vectors
left must have one length and entries below 2**31, else an error is raised; vectors without
entries and empty tables give no rows. Components of no variance (n = 1, or vectors in a
subspace) have a null ``whitened`` and ``explained`` 0; with no component of variance
``identity_error`` is null. A ``deviation`` beyond 64 bits is null. Repeated rows and null
ids are rows of their own. Input columns of the added names are replaced.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.sources.tables import checkpoint

SCALE = 256
LIMIT = 1 << 31
#: Nodes of the quadrature on the upper half of a circle, eigenvalues of an interval, passes.
NODES, SLICE, PASSES = 12, 8, 30
#: Residual of a finished eigenpair, and variance that counts as none, in parts of the norm.
RESIDUAL, NO_VARIANCE = 2e-15, 1e-13


# --- eigenpairs -------------------------------------------------------------------


def inertia(matrix: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: the signs of its pivots, each one or two
    rows wide and chosen as the largest there is (Bunch and Parlett)."""
    a, positive = np.array(matrix, float), 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        i = int(diagonal.argmax())
        r, s = sorted(divmod(int(np.abs(a).argmax()), len(a)))
        if a[r, s] == 0:
            break
        if diagonal[i] >= 0.6404 * abs(a[r, s]):
            positive += int(a[i, i] > 0)
            own = [i]
        else:
            positive += 1  # such a pivot has one eigenvalue of either sign
            own = [r, s]
        rest = np.setdiff1d(np.arange(len(a)), own)
        side = a[np.ix_(rest, own)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(own, own)], side.T)
        a = (a + a.T) / 2
    return positive


def above(matrix: np.ndarray, shift: float) -> int:
    return inertia(matrix - shift * np.eye(len(matrix)))


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) that hold the greatest eigenvalues.

    Edges lie in the middle of gaps. Equal eigenvalues are never parted, so that more than
    ``wanted`` may be held.
    """
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max())
    top, known = norm * 1.01, {}

    def place(k: int) -> float:
        """The k-th greatest eigenvalue, to a millionth of the norm's scale and finer below."""
        if k not in known:
            low, high = -norm * 1e-3, top
            while high - low > max(1e-7 * abs(high), 1e-15 * norm):
                middle = (low + high) / 2
                low, high = (middle, high) if above(matrix, middle) >= k else (low, middle)
            known[k] = (low + high) / 2
        return known[k]

    found, high, done = [], top, 0
    while done < wanted:
        # The widest gap, in proportion, among those that end an interval of few eigenvalues.
        most = min(SLICE, wanted - done)
        choices = range(done + most if done + most == wanted else done + 1, done + most + 1)
        def gap(k):
            return (place(k) - place(k + 1)) / (place(done + 1) or 1) if k < d else 1.0

        k = max(choices, key=gap)
        while k < d and place(k) - place(k + 1) <= 1e-6 * place(done + 1):
            k += 1
        low = (place(k) + place(k + 1)) / 2 if k < d else -norm * 1e-3
        inside = above(matrix, low) - done
        found.append((low, high, inside))
        done, high = done + inside, low
    return found


def feast(matrix: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in an interval, falling, and their unit eigenvectors as columns."""
    d, norm = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - nodes)
    block = min(d, inside + max(4, inside // 2))
    while True:
        # The circle's right end need not reach far beyond the greatest eigenvalue.
        centre, radius = (low + high) / 2, (high - low) / 2
        points = centre + radius * np.exp(1j * angle)
        y = np.random.default_rng(0).standard_normal((d, block))
        for _ in range(PASSES):
            q = np.zeros((d, block))
            for z, w, t in zip(points, weights, angle):
                q += 0.5 * w * (radius * np.exp(1j * t) * np.linalg.solve(z * np.eye(d) - matrix, y)).real
            q, _ = np.linalg.qr(q)
            values, turn = np.linalg.eigh(q.T @ matrix @ q)
            y = q @ turn
            mine = (values > low) & (values < high)
            residual = np.linalg.norm(matrix @ y[:, mine] - y[:, mine] * values[mine], axis=0)
            if mine.sum() == inside and (residual <= RESIDUAL * norm * np.sqrt(d)).all():
                order = np.argsort(-values[mine], kind="stable")
                return values[mine][order], y[:, mine][:, order]
        if block == d:
            raise ArithmeticError("the eigenvalues of an interval were not found")
        block = min(d, 2 * block)


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their eigenvectors as columns."""
    values, vectors = zip(*(feast(matrix, *x) for x in intervals(matrix, wanted)))
    return np.concatenate(values)[:wanted], np.concatenate(vectors, axis=1)[:, :wanted]


# --- sums over the corpus -----------------------------------------------------------


def _rows(column: pa.Array) -> np.ndarray:
    """A batch of vectors as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def products(z: np.ndarray) -> np.ndarray:
    """The sum of outer products of rows, exactly, as Python integers."""
    largest = int(np.abs(z).max()) if z.size else 0
    exact = (1 << 53) // max(1, largest * largest)
    if exact < 16:
        whole = z.astype(object)
        return whole.T @ whole
    out = np.zeros((z.shape[1], z.shape[1]), object)
    for i in range(0, len(z), exact):
        part = z[i : i + exact].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _summed(fit: DataFrame, of_rows, shape: tuple[int, ...]) -> np.ndarray:
    """Exact sums over the fit list of an array that ``of_rows`` makes of a batch."""
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros(size, object)
        for batch in batches:
            if batch.num_rows:
                total = total + of_rows(_rows(batch.column(0))).ravel()
        values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), values], names=["place", "value"])

    sums = fit.select("x").mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size, object)
    for r in sums.collect():  # as many rows as the array has entries
        out[r.place] = int(r.value)
    return out.reshape(shape)


def covariance(fit: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums S of the fit list and its covariance; rows are centred before they multiply.

    The centre taken off in the tasks is the whole part of the mean, so that all products
    are whole; what it leaves over is taken off at the end, in exact fractions.
    """
    sums = _summed(fit, lambda x: x.sum(axis=0).astype(object), (dim,))
    middle = np.array([int(s) // n for s in sums], np.int64)
    moments = _summed(fit, lambda x: products(x - middle), (dim, dim))
    rest = [int(s) - n * int(m) for s, m in zip(sums, middle)]
    v = [[(n * int(moments[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)]
    return sums, np.array(v, float).reshape(dim, dim)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - S) ** 2, exactly; null beyond 64 bits."""
    largest = max((abs(n * int(v) - s) for s, column in zip(sums, x.T) for v in (column.min(), column.max())), default=0)
    if n * int(np.abs(x).max()) < 1 << 62 and largest * largest * x.shape[1] < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def whole_numbers(rows: DataFrame, vector: str) -> DataFrame:
    """Rows that have a vector of finite entries, with ``x``; other columns stay."""
    entries = F.col(vector)
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    far = F.exists(entries, lambda c: F.abs(c.cast("double")) >= float(LIMIT))
    x = F.transform(entries, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    kept = rows.where(entries.isNotNull() & (F.size(entries) > 0) & ~odd)
    return kept.withColumn("x", F.when(far, F.raise_error(F.lit("an entry is too large to be made a whole number"))).otherwise(x))


ADDED = T.StructType(
    [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
     T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]
)


def whiten(rows: DataFrame, components: int = 4, keep: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """One row for each row with a vector and each component; see the top."""
    keep = [c for c in (rows.columns if keep is None else keep) if c not in ADDED.names]
    schema = T.StructType([rows.schema[c] for c in keep] + ADDED.fields)
    places = [f"c{i}" for i in range(len(keep))]
    plain = whole_numbers(rows.select(*(F.col(c).alias(p) for c, p in zip(keep, places)), F.col(vector).alias("vector")), "vector").drop("vector")
    # A vector's copies meet in the task that reads them before they cross the network.
    fit = checkpoint(plain.select("x").distinct())
    found = fit.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not found.n:
        return rows.sparkSession.createDataFrame([], schema)
    if found.least != found.most:
        raise ValueError(f"vectors have {found.least} to {found.most} entries: they must have the same number")
    n, dim = found.n, found.most
    sums, v = covariance(fit, n, dim)
    total, k = float(np.trace(v)), min(components, dim)
    rank = min(k, above(v, NO_VARIANCE * total)) if total > 0 else 0
    values, vectors = leading(v, rank) if rank else (np.zeros(0), np.zeros((dim, 0)))
    mean, onto = np.array([int(s) / n for s in sums]), vectors / np.sqrt(values)

    error = None
    if rank:

        def moments(batches):
            first, second = np.zeros(rank), np.zeros((rank, rank))
            for batch in batches:
                if batch.num_rows:
                    w = (_rows(batch.column(0)) - mean) @ onto
                    first, second = first + w.sum(axis=0), second + w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array([first.tolist()]), pa.array([second.ravel().tolist()])], names=["first", "second"])

        parts = fit.select("x").mapInArrow(moments, "first array<double>, second array<double>")
        entry = lambda c, size: [F.sum(F.get(c, F.lit(i))) for i in range(size)]
        got = list(parts.agg(*entry("first", rank), *entry("second", rank * rank)).first())
        first, second = np.array(got[:rank]) / n, np.array(got[rank:]).reshape(rank, rank) / n
        error = float(np.abs(second - np.outer(first, first) - np.eye(rank)).max())

    explained = [float(e) / total for e in values] + [0.0] * (k - rank)
    whole, out = [int(s) for s in sums], to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _rows(batch.column(batch.num_columns - 1))
            white = np.full((rows, k), np.nan)
            white[:, :rank] = (x - mean) @ onto
            at = np.repeat(np.arange(rows), k)
            arrays = [batch.column(i).take(pa.array(at)).cast(f.type) for i, f in enumerate(list(out)[: len(keep)])]
            arrays.append(pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()))
            arrays.append(pa.array(np.full(rows * k, n), pa.int64()))
            arrays.append(pa.array(_deviations(x, n, whole), pa.int64()).take(pa.array(at)))
            arrays.append(pa.array(white.ravel(), pa.float64(), from_pandas=True))
            arrays.append(pa.array(np.tile(explained, rows), pa.float64()))
            arrays.append(pa.array([error] * (rows * k), pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return plain.select(*places, "x").mapInArrow(run, schema)
