"""Embedding whitening by a bidiagonal qd solver.

Rows are fitted on the distinct vectors.  Blocks of centred vectors are reduced to triangular
factors by QR, and factors to one factor R in rounds that each stack sixteen, so a task holds one
block or a few factors of (dimension x dimension) numbers, however many rows there are.
Householder reflections make R bidiagonal; dqds finds its singular values, each to nearly full
relative accuracy; twisted factorisations of B'B at the squared values give its right singular
vectors, and the reflections turn them into the directions of the data.  No product X'X is formed.

A vector's entries become long integers floor(64 * c) + 1000000 first; sums, counts and deviations
are exact.  A component's eigenvalue is its squared singular value over the number of vectors.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped.
Vectors of each length are fitted on their own.  Entries beyond 2^62 / 64 count as that bound, and a
deviation beyond a long is null.  Components of no variance, relative to rounding of the largest,
do not exist, so fewer distinct vectors than dimensions give fewer components, and one vector or an
empty table no rows.  Equal eigenvalues get any orthonormal directions.  Null ids stay null, rows
that are repeated get their results each, and copies weigh once in the fit.  Extra columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexorder.staging import Stages

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BOUND = float(1 << 62)
BLOCK_BYTES = 8 << 20       # centred vectors that are reduced at once
STACKED = 16                # factors that a task reduces to one
EPS = np.finfo(float).eps
CLOSE = 1e-3                # eigenvalues this near, relative to the larger, may share directions


# --- small matrices -----------------------------------------------------------------------------

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A square matrix to (diagonal, superdiagonal, V): r = U B V' by Householder reflections."""
    b, size = r.astype(float), len(r)
    v = np.eye(size)

    def reflector(x):
        w = x.copy()
        w[0] += np.copysign(np.linalg.norm(x), x[0])
        norm = np.linalg.norm(w)
        return w / norm if norm else w

    for k in range(size):
        w = reflector(b[k:, k])
        b[k:, k:] -= 2 * np.outer(w, w @ b[k:, k:])
        if k + 2 < size:
            w = reflector(b[k, k + 1:])
            b[k:, k + 1:] -= 2 * np.outer(b[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(b).copy(), np.diag(b, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple | None:
    """One transformation; null where the shift is beyond the least eigenvalue."""
    size = len(q)
    new_q, new_e = np.empty(size), np.empty(size - 1)
    d = q[0] - shift
    for k in range(size - 1):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        if new_q[k] == 0:
            new_e[k], d = 0.0, q[k + 1] - shift
            continue
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, by differential qd with shifts.

    Blocks split where an off-diagonal square is negligible; a block is turned round where it is
    graded the wrong way, so that the least values come out at its end.
    """
    found = []
    blocks = [(diagonal.astype(float) ** 2, above.astype(float) ** 2, 0.0)]
    while blocks:
        q, e, total = blocks.pop()      # total: what has been shifted off
        while len(q):
            size = len(q)
            if size == 1:
                found.append(q[0] + total)
                break
            small = np.flatnonzero(e <= EPS ** 2 * (total + q[:-1]))
            if len(small):
                cut = small[-1] + 1
                blocks.append((q[:cut], e[:cut - 1], total))
                q, e = q[cut:], e[cut:]
                continue
            if e[-1] <= EPS ** 2 * (total + q[-1]):
                found.append(q[-1] + total)
                q, e = q[:-1], e[:-1]
                continue
            if size == 2:               # both values, without cancellation
                a, b, c = q[0], q[1], e[0]
                half = (a + b + c) / 2
                large = half + np.sqrt(max(half * half - a * b, 0.0))
                found += [large + total, (a * (b / large) if large else 0.0) + total]
                break
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            # The least value of the last two rows is no less than that of the block.
            half = (q[-2] + q[-1] + e[-1]) / 2
            large = half + np.sqrt(max(half * half - q[-2] * q[-1], 0.0))
            shift = q[-1] * (q[-2] / large) if large else 0.0
            shift = max(shift - np.sqrt(e[-2] * shift), 0.0) if size > 2 else shift
            step = None
            for tried in (shift, shift / 4, shift / 16, 0.0):
                if total + tried == total:
                    tried = 0.0
                step = _dqds_step(q, e, tried)
                if step is not None:
                    break
            q, e = step
            total += tried
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float,
             right: np.ndarray | None = None) -> np.ndarray:
    """A vector of B'B at an eigenvalue: the twisted factorisation's own, or one more step.

    B'B less the value is factored from both ends by the differential transformations, which start
    from B's own entries; the two meet where the pivot is least, and the vector is read off from
    there.  With ``right`` the factored system is solved for it instead.
    """
    size = len(diagonal)
    main, off, across = diagonal ** 2, above ** 2, diagonal[:-1] * above
    tiny = EPS ** 2 * max(main.max(), off.max(initial=0.0), np.finfo(float).tiny)

    def safe(pivot):
        return pivot if abs(pivot) > tiny else np.copysign(tiny, pivot)

    down, up = np.empty(size), np.empty(size)       # pivots from the top and from the bottom
    s, p = np.empty(size), np.empty(size)           # what the transformations carry along
    s[0], p[-1] = -value, main[-1] - value
    for k in range(size - 1):
        down[k] = safe(main[k] + s[k])
        s[k + 1] = off[k] * (s[k] / down[k]) - value
    for k in range(size - 2, -1, -1):
        up[k + 1] = safe(off[k] + p[k + 1])
        p[k] = main[k] * (p[k + 1] / up[k + 1]) - value
    pivot = s + p + value
    at = int(np.argmin(np.abs(pivot)))
    lower, upper = across[:at] / down[:at], across[at:] / up[at + 1:]
    z = np.zeros(size)
    if right is None:
        z[at] = 1.0
    else:                               # eliminate from both ends up to the twist
        z = right.astype(float)
        for k in range(at):
            z[k + 1] -= lower[k] * z[k]
        for k in range(size - 2, at - 1, -1):
            z[k] -= upper[k - at] * z[k + 1]
        z[:at] /= down[:at]
        z[at + 1:] /= up[at + 1:]
        z[at] /= safe(pivot[at])
    for k in range(at - 1, -1, -1):
        z[k] -= lower[k] * z[k + 1]
    for k in range(at, size - 1):
        z[k + 1] -= upper[k - at] * z[k]
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal right singular vectors of a bidiagonal matrix, as columns."""
    out = np.empty((len(diagonal), len(values)))
    first, seed = 0, np.random.default_rng(1)
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * values[k - 1]:
            first = k                   # the vectors from here on are close to each other
        z = _twisted(diagonal, above, value)
        near = out[:, first:k]
        for _ in range(20):
            rest = z - near @ (near.T @ z)
            size = np.linalg.norm(rest)
            if size > 0.5:
                break
            # The direction is taken: another one of the same value, by inverse iteration.
            start = seed.standard_normal(len(z))
            start -= near @ (near.T @ start)
            z = _twisted(diagonal, above, value, start / np.linalg.norm(start))
        rest /= np.linalg.norm(rest)
        rest -= near @ (near.T @ rest)
        out[:, k] = rest / np.linalg.norm(rest)
    return out


def principal(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, directions as columns, trace) of the covariance R'R / n, largest first."""
    scale = np.abs(r).max(initial=0.0)
    if not scale:
        return np.empty(0), np.empty((len(r), 0)), 0.0
    diagonal, above, v = bidiagonalise(r / scale)
    values = dqds(diagonal, above)
    values = values[:most][values[:most] > (EPS * len(r)) ** 2 * values[0]]
    trace = float(np.sum((r / scale) ** 2)) * scale ** 2 / n
    return values * scale ** 2 / n, v @ right_vectors(diagonal, above, values), trace


# --- tables -------------------------------------------------------------------------------------

def whole_entries(vector: Column) -> Column:
    """The vector's long integers; null where the vector is to be dropped."""
    def usable(c):
        c = c.cast("double")
        return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))

    def whole(c):
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-BOUND)), F.lit(BOUND))
        return F.floor(scaled).cast("long") + SHIFT

    return F.when(F.forall(vector, usable) & (F.size(vector) > 0), F.transform(vector, whole))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimension)


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("dimension").to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each dimension the number of vectors and the sums of their entries.

    The result has one row per dimension and entry: it grows with the vectors' width alone.
    """
    rows = (fit.select("dimension", F.posexplode("x").alias("at", "c"))
            .groupBy("dimension", "at").agg(F.count("*").alias("n"),
                                            F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
            .collect())
    found: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(rows, key=lambda r: (r["dimension"], r["at"])):
        found.setdefault(row["dimension"], (row["n"], []))[1].append(int(row["s"]))
    return found


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles, the whole part of S / n taken off exactly."""
    whole = np.array([s // n for s in sums])
    return (x - whole) - np.array([s % n / n for s in sums])


FACTOR = "dimension int, part long, r array<double>"


def _reduced(rows: np.ndarray, dimension: int) -> np.ndarray:
    """The triangular factor of some rows, filled up with zeros to a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((dimension - len(r), dimension))])


def factors(fit: DataFrame, sums: dict, stages: Stages) -> dict[int, np.ndarray]:
    """For each dimension the triangular factor of all centred vectors."""
    def reduce_blocks(batches):
        held = {}
        for batch in batches:
            for dimension, part in _by_dimension(batch):
                rows = _centred(_matrix(part.column("x"), dimension), *sums[dimension])
                step = max(dimension, BLOCK_BYTES // (8 * dimension))
                for begin in range(0, len(rows), step):
                    block = rows[begin:begin + step]
                    if dimension in held:
                        block = np.vstack([held[dimension], block])
                    held[dimension] = _reduced(block, dimension)
        for dimension, r in held.items():
            yield pa.RecordBatch.from_pydict({"dimension": pa.array([dimension], pa.int32()),
                                              "r": [r.ravel()]})

    def stack(table):
        dimension = table.column("dimension")[0].as_py()
        rows = _matrix(table.column("r").combine_chunks(), dimension)
        return pa.table({"dimension": pa.array([dimension], pa.int32()),
                         "part": table.column("part")[:1].cast(pa.int64()),
                         "r": [_reduced(rows, dimension).ravel()]})

    at = stages.save(fit.mapInArrow(reduce_blocks, "dimension int, r array<double>")
                     .withColumn("part", F.spark_partition_id().cast("long"))
                     .select("dimension", "part", "r"), "factors-0")
    most, turn = at.agg(F.max("part")).first()[0] or 0, 0
    while most:                         # parts of one place in sixteen go to one task
        turn += 1
        at = stages.save(at.withColumn("part", F.expr(f"part div {STACKED}"))
                         .groupBy("dimension", "part").applyInArrow(stack, FACTOR),
                         f"factors-{turn}")
        most //= STACKED
    return {row["dimension"]: np.array(row["r"]).reshape(row["dimension"], -1)
            for row in at.collect()}    # one row per dimension


def identity_errors(fit: DataFrame, sums: dict, directions: dict) -> dict[int, float]:
    """How far the whitened fit list's covariance is from the identity, per dimension."""
    def products(batches):
        held = {}
        for batch in batches:
            for dimension, part in _by_dimension(batch):
                w = _centred(_matrix(part.column("x"), dimension),
                             *sums[dimension]) @ directions[dimension]
                w = np.hstack([w, np.ones((len(w), 1))])
                held[dimension] = held.get(dimension, 0) + w.T @ w
        for dimension, total in held.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_pydict({
                "dimension": pa.array([dimension] * len(flat), pa.int32()),
                "at": pa.array(range(len(flat)), pa.int32()), "s": flat})

    rows = (fit.mapInArrow(products, "dimension int, at int, s double")
            .groupBy("dimension", "at").agg(F.sum("s").alias("s")).collect())
    found = {}
    for dimension, (n, _) in sums.items():
        size = directions[dimension].shape[1]
        total = np.zeros((size + 1) ** 2)
        for row in rows:
            if row["dimension"] == dimension:
                total[row["at"]] = row["s"]
        total = total.reshape(size + 1, -1) / n
        mean = total[:size, size]
        covariance = total[:size, :size] - np.outer(mean, mean)
        found[dimension] = float(np.abs(covariance - np.eye(size)).max(initial=0.0))
    return found


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums of (n * x - S)^2, exact; null beyond a long."""
    spread = max(abs(n * int(edge) - s) for row in (x.min(axis=0), x.max(axis=0))
                 for edge, s in zip(row, sums))
    if spread ** 2 * len(sums) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63:
        d = n * x - np.array(sums)
        return pa.array(np.einsum("ij,ij->i", d, d))
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x)
    return pa.array([value if value < 1 << 63 else None for value in exact], pa.int64())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of usable rows."""
    stages = Stages(vectors.sparkSession)
    rows = stages.save(
        vectors.select(F.col(vec_id).alias("vec_id"), whole_entries(F.col(vector)).alias("x"))
        .filter("x is not null").withColumn("dimension", F.size("x")), "rows")
    fit = stages.save(rows.select("x", "dimension").distinct(), "fit")
    sums = exact_sums(fit)
    fitted = {dimension: principal(r, sums[dimension][0], components)
              for dimension, r in factors(fit, sums, stages).items()}
    directions = {dimension: v / np.sqrt(values) for dimension, (values, v, _) in fitted.items()}
    errors = identity_errors(fit, sums, directions)
    explained = {dimension: values / trace if trace else values
                 for dimension, (values, _, trace) in fitted.items()}
    schema = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")])

    def project(batches):
        for batch in batches:
            for dimension, part in _by_dimension(batch):
                size = directions[dimension].shape[1]
                if not size:
                    continue
                n, s = sums[dimension]
                x = _matrix(part.column("x"), dimension)
                each = np.repeat(np.arange(len(x)), size)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)),
                    _deviations(x, n, s).take(pa.array(each)),
                    pa.array((_centred(x, n, s) @ directions[dimension]).ravel()),
                    pa.array(np.tile(explained[dimension], len(x))),
                    pa.array(np.full(len(each), errors[dimension]))], names=schema.names)

    return rows.mapInArrow(project, schema)
