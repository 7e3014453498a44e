"""Whitened principal components by Chebyshev-filtered subspace iteration.

Vectors stay in Spark; each pass multiplies the centred covariance with a narrow block Q (length x
columns) and brings back a matrix of Q's shape. The driver holds such blocks only, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import settle

BLOCK_BYTES = 4 << 20  # of vectors in one stored block
DEGREE = 6  # passes of one filter
GUARD = 44  # columns of the block beside the wanted ones
ROUNDS = 12  # filters before the block is widened
CERTIFIED = 1e-13  # residual of a wanted pair, in parts of the largest eigenvalue
SETTLED = 1e-10  # accepted once rounding keeps the residual from falling further
NO_VARIANCE = 1e-12  # eigenvalues below this part of the largest are none


@dataclass(frozen=True)
class Whitening:
    """What was fitted to the vectors of one length."""

    n: int
    sums: list[int]
    values: list[float]  # eigenvalues, falling
    vectors: list[list[float]]  # length x components
    explained: list[float]
    residual: float  # largest norm of V q - e q, in parts of the largest eigenvalue
    identity_error: float

    @property
    def dim(self) -> int:
        return len(self.sums)


def finite(vector: Column) -> Column:
    """Not null, no null and no non-finite entry."""
    return F.coalesce(
        F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)
    )


def steps(vector: Column, scale: int = 256) -> Column:
    """Each entry as the whole number of 1/scale steps below it; beyond a long it stays at the long's end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def _pack(batches):
    """Vectors of a task as blocks of one length, of at most BLOCK_BYTES."""
    import numpy as np
    import pyarrow as pa

    held: dict[int, list] = {}

    def block(dim, rows):
        x = np.concatenate(rows)
        return pa.RecordBatch.from_pydict(
            {"dim": pa.array([dim], pa.int32()), "data": pa.array([x.astype("<i8").tobytes()], pa.binary())}
        )

    for batch in batches:
        for dim, _, x in _by_length(batch.column("x")):
            most = max(1, BLOCK_BYTES // (8 * dim))
            for i in range(0, len(x), most):
                part = x[i : i + most]
                rows = held.setdefault(dim, [])
                if rows and sum(map(len, rows)) + len(part) > most:
                    yield block(dim, rows)
                    rows.clear()
                rows.append(part)
    for dim, rows in held.items():
        if rows:
            yield block(dim, rows)


def _by_length(column):
    """From an Arrow column of lists: length, positions of its rows, and their matrix. Empty lists are left out."""
    import numpy as np

    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, flat[(starts[at][:, None] + np.arange(dim)[None, :])]


def _matrices(batches, dim):
    import numpy as np

    for batch in batches:
        for data in batch.column("data"):
            yield np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim)


def _totals(blocks: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and sums of the vectors of each length, exactly."""

    def tally(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for dim, data in zip(batch.column("dim").to_pylist(), batch.column("data")):
                x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # a block's sums fit
                yield pa.RecordBatch.from_pydict(
                    {
                        "dim": pa.array([dim] * dim, pa.int32()),
                        "j": pa.array(range(dim), pa.int32()),
                        "n": pa.array([len(x)] * dim, pa.int64()),
                        "high": pa.array(high, pa.int64()),
                        "low": pa.array(low, pa.int64()),
                    }
                )

    sums = blocks.mapInArrow(tally, "dim int, j int, n long, high long, low long").groupBy("dim", "j")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    found: dict[int, dict] = {}
    for r in sums.agg(*exact).collect():
        found.setdefault(r.dim, {})[r.j] = (int(r.n), (int(r.high) << 32) + int(r.low))
    return {d: (at[0][0], [at[j][1] for j in range(d)]) for d, at in found.items()}


class _Covariance:
    """The covariance of the stored vectors of one length, known only by its products with narrow blocks."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        import numpy as np

        self.blocks = blocks.where(F.col("dim") == len(sums)).select("data")
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])

    def _sum(self, rows: int, columns: int, of):
        """The sum over all blocks of a rows x columns matrix that ``of`` makes of a centred block."""
        import numpy as np

        dim, mean = len(self.sums), self.mean

        def partial(batches):
            import numpy as np
            import pyarrow as pa

            total = np.zeros((rows, columns))
            for x in _matrices(batches, dim):
                total += of(x - mean)
            cells = np.arange(rows * columns, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], names=["cell", "value"])

        cells = self.blocks.mapInArrow(partial, "cell int, value double").groupBy("cell")
        total = np.zeros(rows * columns)
        for cell, value in cells.agg(F.sum("value")).collect():
            total[cell] = value
        return total.reshape(rows, columns)

    def times(self, q):
        return self._sum(len(self.sums), q.shape[1], lambda x: x.T @ (x @ q)) / self.n

    def trace(self) -> float:
        return float(self._sum(1, 1, lambda x: (x * x).sum().reshape(1, 1))[0, 0]) / self.n

    def spread(self, w):
        """The covariance of the vectors projected on the columns of w, centred once more."""
        import numpy as np

        k = w.shape[1]
        s = self._sum(k + 1, k, lambda x: (lambda z: np.vstack([z.T @ z, z.sum(axis=0)]))(x @ w)) / self.n
        return s[:k] - np.outer(s[k], s[k])


def leading_pairs(times, dim: int, wanted: int, guard: int = GUARD, degree: int = DEGREE):
    """The ``wanted`` largest eigenvalues and their unit vectors of a symmetric, non-negative operator.

    ``times(q)`` multiplies it with a block of columns. Each round takes Rayleigh-Ritz pairs of the block
    and, until the residuals certify the wanted ones, damps everything below the least Ritz value by a
    Chebyshev polynomial (three-term recurrence, scaled so that nothing overflows), then orthonormalises.
    A round that brings no certificate in ROUNDS filters goes on with a block twice as wide, up to all columns.
    """
    import numpy as np

    rng = np.random.default_rng(12)
    wanted = min(wanted, dim)
    width = min(dim, wanted + guard)
    q = np.linalg.qr(rng.normal(size=(dim, width)))[0]
    before, rounds = np.inf, 0
    while True:
        aq = times(q)
        h = q.T @ aq
        ritz, u = np.linalg.eigh((h + h.T) / 2)
        ritz, u = ritz[::-1], u[:, ::-1]
        q, aq = q @ u, aq @ u
        if ritz[0] <= 0:
            return ritz[:0], q[:, :0], 0.0
        residual = np.linalg.norm(aq[:, :wanted] - q[:, :wanted] * ritz[:wanted], axis=0).max() / ritz[0]
        still = residual > before / 2
        if residual <= CERTIFIED or (residual <= SETTLED and still) or (width == dim and rounds):
            return ritz[:wanted], q[:, :wanted], float(residual)
        before, rounds = residual, rounds + 1
        if rounds % ROUNDS == 0:
            width = min(dim, 2 * width)
            q = np.linalg.qr(np.hstack([q, rng.normal(size=(dim, width - q.shape[1]))]))[0]
            continue
        half = max(ritz[-1], ritz[0] * 1e-12) / 2  # what is damped: from 0 to the least Ritz value
        sigma = half / (ritz[0] - half) if ritz[0] > half else 1.0
        tau = 2 / sigma
        last, now = q, (aq - half * q) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (tau - sigma)
            nxt = (times(now) - half * now) * (2 * following / half) - (sigma * following) * last
            last, now, sigma = now, nxt, following
        q = np.linalg.qr(now)[0]


def fit(df: DataFrame, vector: str, components: int = 4, scale: int = 256) -> list[Whitening]:
    """Fit each length of vector apart, on the distinct vectors of whole steps of 1/scale."""
    import numpy as np

    usable = df.where(finite(F.col(vector))).select(steps(F.col(vector), scale).alias("x"))
    blocks = settle(usable.distinct().mapInArrow(_pack, "dim int, data binary"), "whitening")
    models = []
    for _, (n, sums) in sorted(_totals(blocks).items()):
        v = _Covariance(blocks, n, sums)
        values, vectors, residual = leading_pairs(v.times, len(sums), components)
        keep = int((values > NO_VARIANCE * values[:1].sum()).sum())
        values, vectors = values[:keep], vectors[:, :keep]
        # a fixed sign: the entry of largest size is positive
        if keep:
            top = np.abs(vectors).argmax(axis=0)
            vectors = vectors * np.sign(vectors[top, np.arange(keep)])
            error = float(np.abs(v.spread(vectors / np.sqrt(values)) - np.eye(keep)).max())
            explained = (values / v.trace()).tolist()
        else:
            error, explained = 0.0, []
        models.append(Whitening(n, sums, values.tolist(), vectors.tolist(), explained, residual, error))
    return models


def apply(models: list[Whitening], df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """Each usable row of a fitted length: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    by_dim = {m.dim: m for m in models if m.values}
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, dim int, deviation long, whitened array<double>"

    def project(batches):
        import numpy as np
        import pyarrow as pa

        prepared = {}
        for d, m in by_dim.items():
            fits = m.n < 2**62 and all(abs(s) < 2**62 for s in m.sums)
            prepared[d] = (m, np.array(m.sums, dtype=np.int64 if fits else object), np.array(m.vectors) / np.sqrt(m.values))
        for batch in batches:
            for dim, at, x in _by_length(batch.column("x")):
                if dim not in prepared:
                    continue
                m, sums, w = prepared[dim]
                far = m.n * float(np.abs(x.astype(float)).max()) + float(np.abs(sums.astype(float)).max())
                if far < 2**62 and dim * far * far < 2**62:
                    away = m.n * x - sums
                    deviation = (away * away).sum(axis=1).tolist()
                else:  # Python's whole numbers, without a bound
                    away = m.n * x.astype(object) - sums.astype(object)
                    deviation = [v if v < 2**63 else None for v in (away * away).sum(axis=1).tolist()]
                z = (away.astype(float) / m.n) @ w
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(at)),
                        pa.array([dim] * len(at), pa.int32()),
                        pa.array(deviation, pa.int64()),
                        pa.array(list(z), pa.list_(pa.float64())),
                    ],
                    names=["key", "dim", "deviation", "whitened"],
                )

    rows = df.where(finite(F.col(vector))).select(F.col(key).alias("key"), steps(F.col(vector), scale).alias("x"))
    rows = rows.mapInArrow(project, schema)
    rows = rows.select("key", "dim", "deviation", F.posexplode("whitened").alias("at", "whitened"))

    def of_model(value, kind):
        choice = F.lit(None).cast(kind)
        for d, m in by_dim.items():
            choice = F.when(F.col("dim") == d, value(m)).otherwise(choice)
        return choice

    return rows.select(
        "key",
        (F.col("at") + 1).cast("int").alias("component"),
        of_model(lambda m: F.lit(m.n).cast("long"), "long").alias("n"),
        "deviation",
        "whitened",
        of_model(lambda m: F.element_at(F.array(*[F.lit(e) for e in m.explained]), F.col("at") + 1), "double").alias("explained"),
        of_model(lambda m: F.lit(m.identity_error), "double").alias("identity_error"),
    )


def whiten(df: DataFrame, key: str, vector: str, components: int = 4, scale: int = 256) -> DataFrame:
    """Fit and project: a row for each usable vector and leading component.

    Rows whose vector is null or holds null or non-finite entries are left out; zero vectors, null keys and
    repeated rows stay (repeated vectors are fitted once). Other columns are ignored, whatever their names. Vectors of another
    length are fitted on their own, one length after the other; empty ones have no component. Components without variance
    (one distinct vector, fewer directions than asked for) have no row. A deviation beyond a long is null.
    Equal eigenvalues leave their vectors open to rotation; one choice is made for all rows. Driver memory is bounded
    by vector length x columns, a task's by an Arrow batch and BLOCK_BYTES. Lost executors cost a re-read of the
    blocks, which are written to the shared folder once.
    """
    return apply(fit(df, vector, components, scale), df, key, vector, scale)
