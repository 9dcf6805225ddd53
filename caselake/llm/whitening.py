"""Whitening of embeddings by a Jacobi-Davidson eigensolver over distributed, matrix-free products.

Entries become whole numbers (floor of ``SCALE`` times the entry, plus ``SHIFT``), so counts, sums and squared
deviations are exact. The covariance is never formed: the one thing asked of the table is the product of its
centred rows with a narrow block of directions, a pass over packed rows whose partial sums are added up.

* The search space starts from a fixed random block. Rayleigh-Ritz in it gives approximate eigenpairs.
* Each pair that isn't good enough asks for a correction, orthogonal to it and to the locked vectors. Its projected
  equation is solved roughly by MINRES; all pairs' solvers run side by side, so one pass over the table serves
  a step of every one of them.
* Corrections widen the space; a space that became too wide restarts from its best Ritz vectors.
* Leading pairs whose residual reaches rounding error of a double (``TIGHT`` of the largest eigenvalue, more in long vectors) are locked.
  The loop ends when all wanted ones are.

The driver holds blocks of the vectors' length and nothing that grows with rows.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; so are vectors whose length
isn't the most frequent one (the longer one on a tie), empty ones, and those with entries whose whole number would pass
2^52. Equal rows all count. Directions without variance (below ``FLAT`` of the largest) are no components; a table of
equal rows, or an empty one, has none and gives an empty result. Squared deviations are decimals of 38 digits. Columns
other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DecimalType, DoubleType, IntegerType, StructField, StructType

from caselake.session import materialise

SCALE, SHIFT = 1024, 100_000
TIGHT, FLAT = 1e-14, 1e-12
EXTRA, WIDEST = 16, 8
INNER, OUTER = 4, 100
FEW_TASKS, SUMMED = 256, 64
LARGEST = float(1 << 52)

Product = Callable[[np.ndarray], np.ndarray]


def whole_numbers(vectors: DataFrame, vec: str, vector: str) -> DataFrame:
    """``vec`` and ``x``, packed 64-bit whole numbers, of the usable rows."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE + 0.0))
    usable = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)) \
        .where(~F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) > LARGEST / SCALE)))
    sizes = usable.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    wide = usable.where(F.size(vector) == (most.d if most else 0)).select(F.col(vec).alias("vec"), scaled.alias("x"))
    out = StructType([StructField("vec", vectors.schema[vec].dataType), StructField("x", BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = most.d
            x = (batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8") + SHIFT).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=out.names)

    return wide.mapInArrow(pack, out)


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


@dataclass(frozen=True)
class Centred:
    """The usable rows, how many there are, and their exact sums."""

    rows: DataFrame
    tasks: int
    n: int
    sums: list[int]

    @property
    def d(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    def summed(self, task: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all rows of what ``task`` makes of a block of rows; with many tasks in two levels."""
        d = self.d

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = added(task(unpacked(b.column(0), d)) for b in batches)
            yield from packed(TaskContext.get().partitionId() % SUMMED, total)

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from packed(0, added(np.frombuffer(data).reshape(shape) for b in batches for data in b.column(1).to_pylist()))

        def added(parts: Iterable[np.ndarray]) -> np.ndarray:
            """Each sum's rounding error is carried along, so that many parts lose no more than few."""
            total, lost = np.zeros(shape), np.zeros(shape)
            for part in parts:
                after = total + part
                back = after - total
                lost += (total - (after - back)) + (part - back)
                total = after
            return total + lost

        def packed(at: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "sums"])

        sums = self.rows.select("x").mapInArrow(first, "at int, sums binary")
        if self.tasks > FEW_TASKS:
            sums = sums.repartition(SUMMED, "at").mapInArrow(second, "at int, sums binary")
        return added(np.frombuffer(r.sums).reshape(shape) for r in sums.collect())

    def product(self) -> Product:
        """Covariance times a block of directions, one pass each."""
        mean = self.mean

        def apply(block: np.ndarray) -> np.ndarray:
            def task(x: np.ndarray) -> np.ndarray:
                centred = x - mean
                return centred.T @ (centred @ block)
            return self.summed(task, block.shape) / self.n
        return apply


def centre(rows: DataFrame) -> Centred:
    """Counts and exact sums: each task adds whole numbers of its rows, as Python's own where 64 bits may not do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # 512 numbers below 2^53 stay within 64 bits
                packed = batch.column(0).slice(at, 512).to_pylist()
                part = np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), -1).sum(axis=0)
                n += len(packed)
                total = part.tolist() if total is None else [a + b for a, b in zip(total, part.tolist())]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array([str(s) for s in total], pa.string())],
                names=["n", "at", "s"])

    sums = rows.select("x").mapInArrow(run, "n long, at int, s string").groupBy("at") \
        .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(DecimalType(28, 0))).alias("s")).orderBy("at").collect()
    return Centred(rows, rows.rdd.getNumPartitions(), sums[0].n if sums else 0, [int(r.s) for r in sums])


def minres(b: np.ndarray, tolerance: float, most: int) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Solves A t = b for a symmetric A: yields what is to be multiplied by A, is sent the product, returns t.

    Lanczos vectors and one Givens rotation a step; ends at the tolerance, in proportion to b, or after ``most`` steps.
    """
    t = np.zeros_like(b)
    size = beta = float(np.linalg.norm(b))
    if size == 0:
        return t
    before, v = np.zeros_like(b), b / beta
    w_before = w = np.zeros_like(b)
    c_before, s_before, c, s = 1.0, 0.0, 1.0, 0.0
    beta, left = 0.0, size
    for _ in range(most):
        p = yield v
        alpha = float(v @ p)
        p = p - alpha * v - beta * before
        after = float(np.linalg.norm(p))
        # The new column of the tridiagonal matrix, under the last two rotations and the one that ends it.
        over = s_before * beta
        on = c * (c_before * beta) + s * alpha
        diagonal = -s * (c_before * beta) + c * alpha
        length = float(np.hypot(diagonal, after))
        if length == 0:
            break
        c_before, s_before, c, s = c, s, diagonal / length, after / length
        w_before, w = w, (v - over * w_before - on * w) / length
        t = t + c * left * w
        left = -s * left
        if abs(left) <= tolerance * size or after <= 1e-15 * abs(alpha):
            break
        before, v, beta = v, p / after, after
    return t


def together(solvers: list[tuple[Generator, Callable[[np.ndarray, np.ndarray], np.ndarray]]], product: Product) -> list[np.ndarray]:
    """Run solvers side by side: their wishes make one block, so each step of all of them is one product."""
    answers: list[np.ndarray | None] = [None] * len(solvers)
    wishes: dict[int, np.ndarray] = {}

    def go_on(i: int, said: np.ndarray | None) -> None:
        try:
            wishes[i] = solvers[i][0].send(said)
        except StopIteration as end:
            wishes.pop(i, None)
            answers[i] = end.value

    for i in range(len(solvers)):
        go_on(i, None)
    while wishes:
        order = list(wishes)
        made = product(np.stack([wishes[i] for i in order], axis=1))
        for k, i in enumerate(order):
            go_on(i, solvers[i][1](wishes[i], made[:, k]))
    return answers


def without(block: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """Take orthonormal spaces out of a block, twice, since once leaves rounding behind."""
    for _ in range(2):
        for space in spaces:
            if space.shape[1]:
                block = block - space @ (space.T @ block)
    return block


def widened(space: np.ndarray, new: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``new`` beyond ``space`` and ``others``; those that say nothing new are left out."""
    added = np.zeros((len(new), 0))
    for k in range(new.shape[1]):
        v = new[:, k]
        v = v / (np.linalg.norm(v) or 1.0)
        v = without(v[:, None], space, *others, added)
        size = np.linalg.norm(v)
        if size > 1e-10:
            v = without(v / size, space, *others, added)
            added = np.concatenate([added, v / np.linalg.norm(v)], axis=1)
    return added


def eigenpairs(product: Product, d: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading eigenvalues, unit eigenvectors, and the norms of their residuals, by Jacobi-Davidson.

    A residual is measured by a product of its own with the vector as it is returned.
    """
    wanted, tight = min(wanted, d), max(TIGHT, d * 2.0 ** -53)
    rng = np.random.default_rng(seed)
    start = min(d, wanted + EXTRA)
    locked, held, sizes = np.zeros((d, 0)), [], []
    space = widened(np.zeros((d, 0)), rng.standard_normal((d, start)))
    image = product(space)
    largest = 0.0
    for step in range(OUTER):
        values, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        largest = max(largest, float(values[0]) if len(values) else 0.0, *held)
        open_pairs = wanted - locked.shape[1]
        residuals = without(ritz_image[:, :open_pairs] - ritz[:, :open_pairs] * values[:open_pairs], locked)
        norms = np.linalg.norm(residuals, axis=0)
        full = space.shape[1] + locked.shape[1] == d
        good = 0
        while good < len(norms) and (norms[good] <= tight * largest or full or largest == 0.0):
            good += 1
        if good:
            locked = np.concatenate([locked, ritz[:, :good]], axis=1)
            held, sizes = held + values[:good].tolist(), sizes + norms[:good].tolist()
            ritz, ritz_image, values = ritz[:, good:], ritz_image[:, good:], values[good:]
            residuals, norms = residuals[:, good:], norms[good:]
        if locked.shape[1] == wanted:
            break
        if ritz.shape[1] + len(norms) > max(WIDEST * wanted, start):
            keep = min(ritz.shape[1], start)
            ritz, ritz_image = ritz[:, :keep], ritz_image[:, :keep]
        space, image = ritz, ritz_image

        def equation(k: int) -> tuple[Generator, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
            u, theta = ritz[:, k:k + 1], values[k]

            def projected(v: np.ndarray, product_of_v: np.ndarray) -> np.ndarray:
                return without((product_of_v - theta * v)[:, None], u, locked)[:, 0]
            b = without(-residuals[:, k:k + 1], u, locked)[:, 0]
            return minres(b, max(1e-3, 0.3 * 0.5 ** step), INNER), projected

        wrong = [k for k in range(len(norms)) if norms[k] > tight * largest]
        corrections = together([equation(k) for k in wrong], product)
        new = widened(space, np.stack(corrections, axis=1) if corrections else np.zeros((d, 0)), locked)
        if not new.shape[1]:
            new = widened(space, rng.standard_normal((d, wanted)), locked)
        space, image = np.concatenate([space, new], axis=1), np.concatenate([image, product(new)], axis=1)
    else:
        raise ArithmeticError(f"{wanted - locked.shape[1]} of {wanted} eigenpairs did not reach double precision in {OUTER} rounds")
    # One more Rayleigh-Ritz in the locked space: orders ties and evens out what each lock left of the others.
    image = product(locked)
    values, turn = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
    values, vectors, image = values[::-1], (locked @ turn)[:, ::-1], (image @ turn)[:, ::-1]
    return values, vectors, np.linalg.norm(image - vectors * values, axis=0)


@dataclass(frozen=True)
class Whitening:
    centred: Centred
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float


def exact_deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - S)^2 of each row; whole numbers of any size where 64 bits may not do."""
    mean = np.array([s / n for s in sums])
    reach = float(np.abs(x - mean).max(initial=0.0)) + 1.0
    if n * (float(np.abs(x).max(initial=0)) + 1.0) < 2.0 ** 62 and (n * reach) ** 2 * x.shape[1] < 2.0 ** 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [int(v) for v in ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)]


def fit(vectors: DataFrame, vec: str = "vec_id", vector: str = "embedding", wanted: int = 8) -> Whitening:
    """Mean, leading eigenpairs of the covariance, its trace, and how far the whitened rows' covariance is from the identity."""
    centred = centre(materialise(whole_numbers(vectors, vec, vector), "whole-numbers"))
    none = np.zeros((centred.d, 0))
    if not centred.n:
        return Whitening(centred, np.zeros(0), none, np.zeros(0), 0.0, 0.0)
    values, basis, residuals = eigenpairs(centred.product(), centred.d, wanted)
    real = values > FLAT * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    values, basis, residuals = values[real], basis[:, real], residuals[real]
    mean, d = centred.mean, centred.d
    trace = float(centred.summed(lambda x: ((x - mean) ** 2).sum(axis=0), (d,)).sum()) / centred.n
    if not len(values):
        return Whitening(centred, values, basis, residuals, trace, 0.0)
    k, scaled = len(values), basis / np.sqrt(values)
    middle = centred.summed(lambda x: ((x - mean) @ scaled).sum(axis=0), (k,)) / centred.n

    def outer(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled - middle
        return w.T @ w
    spread = centred.summed(outer, (k, k)) / centred.n
    return Whitening(centred, values, basis, residuals, trace, float(np.abs(spread - np.eye(k)).max()))


def whitened(model: Whitening, name: str = "vec_id") -> DataFrame:
    """``name``, component (from 1), n, deviation, whitened, explained and identity_error of every row and component."""
    centred = model.centred
    out = StructType([StructField(name, centred.rows.schema["vec"].dataType), StructField("component", IntegerType())]) \
        .add("n", "long").add(StructField("deviation", DecimalType(38, 0))).add(StructField("whitened", DoubleType())) \
        .add(StructField("explained", DoubleType())).add(StructField("identity_error", DoubleType()))
    k, n, sums, mean = len(model.values), centred.n, centred.sums, centred.mean
    if not k:
        return centred.rows.sparkSession.createDataFrame([], out)
    scaled, explained, error, d = model.vectors / np.sqrt(model.values), model.values / model.trace, model.identity_error, centred.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = unpacked(batch.column(1), d), batch.num_rows
            rows = pa.array(np.repeat(np.arange(m), k))
            deviations = pa.array([Decimal(v) for v in exact_deviations(x, n, sums)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                deviations.take(rows), pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))], names=out.names)

    return centred.rows.mapInArrow(run, out)
