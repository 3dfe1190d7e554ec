"""Embedding whitening by a bidiagonal qd solver.

Entries become whole numbers x = floor(64 * c) + 1000000; each distinct x
vector is fitted once.  Tasks reduce blocks of exactly centred rows to
triangular factors (blockwise QR), which merge a few at a time until one R is
left; only R, as large as dimension squared, is solved: Householder reflections
make it bidiagonal, dqds finds its singular values to high relative accuracy,
and twisted factorisations give the right singular vectors.  Rows are then
projected where they lie.

Rows whose vector is null or empty, or holds null, NaN or infinite entries,
have no result.  Vectors of another length are whitened among themselves.
Repeated rows are fitted once and each returned.  Entries beyond 2**56 count as
2**56.  ``deviation`` is null where it does not fit a long.  Components without
variance (below rounding against the largest) cannot be whitened and are left
out, so equal vectors or a single one give no rows, and neither does an empty
table.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import written

COMPONENTS = 16
OFFSET = 1_000_000
SCALE = 64.0
LARGEST = 1 << 56
BLOCK_ROWS = 4_096  # rows of a block that QR reduces at once
FAN_IN = 16  # triangular factors merged in one task
DIRECTIONS_BYTES = 32_000_000  # of all lengths whose directions travel with one pass
EPS = np.finfo(np.float64).eps

WIDTHS = [np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8")]


# ---------------------------------------------------------------- the solver for one triangular factor

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of an upper bidiagonal B with r = U B V^T."""
    a = np.array(r, dtype=np.float64)
    d = a.shape[0]
    v = np.eye(d)
    for k in range(d):
        u, beta = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(u, u @ a[k:, k:])
        if k < d - 2:
            u, beta = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= beta * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """u and beta of I - beta u u^T, which sends x to a multiple of the first unit vector."""
    scale = np.abs(x).max()
    if scale == 0 or len(x) == 1:
        return x, 0.0
    u = x / scale
    u[0] += np.copysign(np.linalg.norm(u), u[0])
    return u, 2.0 / (u @ u)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal, falling: differential qd steps with shifts.

    A shift beyond the least eigenvalue shows as a negative d and is tried
    again smaller, at last as zero, which cannot fail.
    """
    found: list[float] = []
    blocks = [(diagonal ** 2, above ** 2, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        low = 0.0
        for _ in range(60 * len(q) + 60):
            tiny = EPS * EPS * 16 * (moved + np.minimum(q[:-1], q[1:]))
            cut = np.flatnonzero(e <= tiny)
            if len(cut):
                at = int(cut[-1]) + 1
                blocks.append((q[:at], e[:at - 1], moved))
                q, e = q[at:], e[at:]
            if len(q) == 1:
                found.append(moved + q[0])
                break
            shift = _shift(q, e, low)
            while True:
                new = _step(q, e, shift)
                if new is not None:
                    break
                shift = shift / 4 if shift > EPS * q[-1] else 0.0
            q, e, low = new
            moved += shift
        else:
            raise ArithmeticError("dqds did not converge")
    return np.sort(np.maximum(found, 0.0))[::-1]


def _shift(q: np.ndarray, e: np.ndarray, low: float) -> float:
    """Near the lesser eigenvalue of the last two by two part, and not above the least d seen."""
    a, b = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1]
    c = q[-2] * e[-1]
    root = (a + b) / 2 - np.hypot((a - b) / 2, np.sqrt(c))
    guess = min(root, low) if low > 0 else root
    return max(0.0, guess * (1 - 1e-8)) if np.isfinite(guess) else 0.0


def _step(q: np.ndarray, e: np.ndarray, shift: float):
    """One dqds transform: q, e and the least d, or None where the shift was too large."""
    n = len(q)
    hat_q, hat_e = np.empty(n), np.empty(n - 1)
    d = low = float(q[0]) - shift
    if d < 0:
        return None
    for k, (ek, after) in enumerate(zip(e.tolist(), q[1:].tolist())):
        total = d + ek
        hat_q[k] = total
        share = after / total if total > 0 else 0.0
        hat_e[k] = ek * share
        d = d * share - shift if total > 0 else after - shift
        if d < 0 or d != d:
            return None
        low = min(low, d)
    hat_q[n - 1] = d
    return hat_q, hat_e, low


def twisted_vector(q: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Eigenvector of the tridiagonal (diagonal q, beside it b) by the best twist.

    The factorisations from above and from below meet where their residual is
    least; from there the vector is a product in each direction.
    """
    n = len(q)
    down, up = np.empty(n), np.empty(n)
    guard = EPS * max(abs(value), np.abs(q).max(), np.abs(b).max() if n > 1 else 0.0) * EPS
    down[0] = q[0] - value
    for k in range(1, n):
        p = down[k - 1] if down[k - 1] != 0 else guard
        down[k] = q[k] - value - b[k - 1] * (b[k - 1] / p)
    up[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        p = up[k + 1] if up[k + 1] != 0 else guard
        up[k] = q[k] - value - b[k] * (b[k] / p)
    twist = int(np.argmin(np.abs(down + up - (q - value))))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -b[k] / (down[k] if down[k] != 0 else guard) * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -b[k] / (up[k + 1] if up[k + 1] != 0 else guard) * z[k]
    return z / np.linalg.norm(z)


def _tridiagonal_solve(q: np.ndarray, b: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """(T - value) y = right by elimination with row exchanges; zero pivots count as tiny."""
    n = len(q)
    main, over, far, y = q - value, np.append(b, 0.0), np.zeros(n), right.copy()
    tiny = EPS * max(np.abs(main).max(), np.abs(b).max() if n > 1 else 0.0, np.finfo(float).tiny)
    for k in range(n - 1):
        low = [b[k], main[k + 1], over[k + 1]]
        if abs(low[0]) > abs(main[k]):
            (main[k], over[k], far[k]), low = low, [main[k], over[k], far[k]]
            y[k], y[k + 1] = y[k + 1], y[k]
        ratio = low[0] / (main[k] if main[k] != 0 else tiny)
        main[k + 1], over[k + 1] = low[1] - ratio * over[k], low[2] - ratio * far[k]
        y[k + 1] -= ratio * y[k]
    for k in range(n - 1, -1, -1):
        rest = y[k] - (over[k] * y[k + 1] if k + 1 < n else 0.0) - (far[k] * y[k + 2] if k + 2 < n else 0.0)
        y[k] = rest / (main[k] if abs(main[k]) > tiny else tiny)
    return y / np.linalg.norm(y)


def directions(r: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of r^T r, falling, and their unit eigenvectors as columns.

    Vectors are kept at right angles to those before; where eigenvalues are too
    near each other for a twisted factorisation each, solves refine them.
    """
    d = r.shape[0]
    scale = np.abs(r).max()
    if not scale > 0:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, above, v = bidiagonal(r / scale)
    values = dqds(diagonal, above)
    # T = B^T B
    main = diagonal ** 2
    main[1:] += above ** 2
    beside = diagonal[:-1] * above
    take = values[:count]
    take = take[take > values[0] * d * 4 * EPS]
    vectors = np.zeros((d, len(take)))
    rng = np.random.default_rng(d)
    for i, value in enumerate(take):
        z = twisted_vector(main, beside, value)
        mates = vectors[:, :i]
        for _ in range(6):
            flat = z - mates @ (mates.T @ z)
            size = np.linalg.norm(flat)
            if size < 1e-3:  # the same vector again
                z = _tridiagonal_solve(main, beside, value, _right_angled(rng.normal(size=d), mates))
                continue
            z = flat / size
            residual = main * z - value * z
            residual[:-1] += beside * z[1:]
            residual[1:] += beside * z[:-1]
            if np.linalg.norm(residual) <= 32 * EPS * values[0] and abs(mates.T @ z).max(initial=0.0) <= 32 * EPS:
                break
            z = _tridiagonal_solve(main, beside, value, z)
        vectors[:, i] = z
    return take * scale ** 2, v @ vectors


def _right_angled(z: np.ndarray, mates: np.ndarray) -> np.ndarray:
    z = z - mates @ (mates.T @ z)
    return z / np.linalg.norm(z)


# ---------------------------------------------------------------- rows as whole numbers

def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them all."""
    low, high = int(values.min()), int(values.max())
    return values.astype(next(w for w in WIDTHS if np.iinfo(w).min <= low and high <= np.iinfo(w).max)).tobytes()


def _unpack(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // d}").astype(np.int64)


def whole_numbers(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``keep``, the length ``_d`` and the packed floor(64 * c) of every usable row."""
    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("_v")).where("size(_v) > 0")
    schema = rows.select(*keep).schema.add("_d", "integer").add("_x", "binary")
    names = schema.names

    def run(batches):
        for b in batches:
            lists = b.column("_v")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)  # nulls as NaN
            with np.errstate(over="ignore"):  # the ends are clipped
                whole = np.clip(np.floor(SCALE * flat), -float(LARGEST), float(LARGEST))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
            raw = [_pack(whole[ends[i]:ends[i + 1]].astype(np.int64)) for i in good]
            part = b.take(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [part.column(k) for k in keep] + [pa.array((ends[1:] - ends[:-1])[good], pa.int32()), pa.array(raw, pa.binary())],
                names=names)

    return rows.mapInArrow(run, schema)


def _by_length(batch):
    """(length, whole numbers as rows, row places) of each vector length in a batch."""
    lengths = batch.column("_d").to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        raw = batch.column("_x").take(pa.array(at)).to_pylist()
        yield int(d), np.stack([_unpack(x, int(d)) for x in raw]), at


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length: distinct vectors, and the exact sum of every dimension."""

    def run(batches):
        totals: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for d, x, _ in _by_length(b):
                n, s = totals.get(d, (0, [0] * d))
                # halves of the numbers, so that no sum of a batch leaves 64 bits
                high, low = (x >> 28).sum(axis=0).tolist(), (x & ((1 << 28) - 1)).sum(axis=0).tolist()
                totals[d] = (n + len(x), [a + (h << 28) + w for a, h, w in zip(s, high, low)])
        for d, (n, s) in totals.items():
            yield pa.RecordBatch.from_pydict({"_d": pa.array([d] * (d + 1), pa.int32()), "k": pa.array(range(-1, d), pa.int32()),
                                              "s": pa.array([str(v) for v in [n, *s]])})

    parts = fit.mapInArrow(run, "_d int, k int, s string")
    rows = parts.groupBy("_d", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    found: dict[int, dict[int, int]] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r["_d"], {})[r["k"]] = int(r["s"])
    return {d: (t[-1], [t[k] for k in range(d)]) for d, t in found.items()}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit numbers where all fit, else as Python's."""
    if max(1, int(np.abs(x).max())) * n < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(dev: np.ndarray) -> list[int | None]:
    """Sum of squares of every row, exact; None beyond 64 bits."""
    if dev.dtype != object and int(np.abs(dev).max()) ** 2 * dev.shape[1] < 1 << 63:
        return (dev * dev).sum(axis=1).tolist()
    exact = (dev.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(np.float64)


# ---------------------------------------------------------------- blockwise QR and the projections

def _triangular(blocks: list[np.ndarray]) -> np.ndarray:
    r = np.linalg.qr(np.vstack(blocks), mode="r")
    d = r.shape[1]
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def triangular_factor(fit: DataFrame, sums: dict[int, tuple[int, list[int]]], fan_in: int = FAN_IN) -> dict[int, np.ndarray]:
    """R of the centred rows of each length; factors merge ``fan_in`` at a time."""
    def reduce_rows(batches):
        held: dict[int, list[np.ndarray]] = {}
        rows: dict[int, int] = {}
        for b in batches:
            for d, x, _ in _by_length(b):
                held.setdefault(d, []).append(_centred(x, *sums[d]))
                rows[d] = rows.get(d, 0) + len(x)
                if rows[d] >= max(BLOCK_ROWS, 2 * d):
                    held[d] = [_triangular(held[d])]
                    rows[d] = d
        for d, blocks in held.items():
            yield pa.RecordBatch.from_pydict({"_d": pa.array([d], pa.int32()), "r": [_triangular(blocks).tobytes()]})

    def merge(pdf):
        d = int(pdf["_d"].iloc[0])
        r = _triangular([np.frombuffer(x, np.float64).reshape(-1, d) for x in pdf["r"]])
        pdf = pdf.iloc[:1].copy()
        pdf["r"] = [r.tobytes()]
        return pdf[["_d", "g", "r"]]

    parts = fit.mapInArrow(reduce_rows, "_d int, r binary").withColumn("g", F.spark_partition_id())
    parts = written(parts.select("_d", "g", "r"), "factors")
    most = parts.agg(F.max("g")).first()[0] or 0
    while most > 0:
        most //= fan_in
        parts = parts.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).groupBy("_d", "g").applyInPandas(merge, parts.schema)
        parts = written(parts, "factors")
    return {r["_d"]: np.frombuffer(r["r"], np.float64).reshape(-1, r["_d"]) for r in parts.toLocalIterator()}


def _identity_errors(fit: DataFrame, sums, weights: dict[int, np.ndarray]) -> dict[int, float]:
    """Largest entry of (covariance of the whitened fit list - identity), by length."""
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for d, x, _ in _by_length(b):
                if d in weights:
                    w = _centred(x, *sums[d]) @ weights[d]
                    w = np.column_stack([w, np.ones(len(w))])
                    totals[d] = totals.get(d, 0.0) + w.T @ w
        for d, t in totals.items():
            i, j = np.indices(t.shape)
            yield pa.RecordBatch.from_pydict({"_d": pa.array([d] * t.size, pa.int32()), "i": pa.array(i.ravel(), pa.int32()),
                                              "j": pa.array(j.ravel(), pa.int32()), "s": t.ravel()})

    rows = fit.mapInArrow(run, "_d int, i int, j int, s double").groupBy("_d", "i", "j").agg(F.sum("s").alias("s"))
    moments: dict[int, np.ndarray] = {}
    for r in rows.toLocalIterator():
        k = weights[r["_d"]].shape[1] + 1
        moments.setdefault(r["_d"], np.zeros((k, k)))[r["i"], r["j"]] = r["s"]
    out = {}
    for d, m in moments.items():
        n, mean = sums[d][0], m[:-1, -1] / sums[d][0]
        out[d] = float(np.abs(m[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("_vector")), "_vector", ["vec_id"])
    fit = written(rows.select("_d", "_x").distinct(), "fit-list")
    sums = _sums(fit)
    weights: dict[int, np.ndarray] = {}
    explained: dict[int, list[float]] = {}
    for d, r in triangular_factor(fit, sums).items():
        values, found = directions(r, count)
        if len(values):
            weights[d] = found / np.sqrt(values / sums[d][0])
            explained[d] = (values / (r * r).sum()).tolist()
    errors = _identity_errors(fit, sums, weights)
    schema = rows.select("vec_id").schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"),
                       ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)

    def project(lengths):
        its = {d: (sums[d], weights[d], explained[d], errors[d]) for d in lengths}

        def run(batches):
            for b in batches:
                for d, x, at in _by_length(b):
                    (n, s), w, share, error = its[d]
                    dev, k = deviations(x, n, s), w.shape[1]
                    m = len(x) * k
                    yield pa.RecordBatch.from_arrays([
                        b.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array(np.full(m, n), pa.int64()), pa.array(_squares(dev), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(((dev / n).astype(np.float64) @ w).ravel()), pa.array(np.tile(share, len(x))),
                        pa.array(np.full(m, error))], names=schema.names)
        return rows.where(F.col("_d").isin(lengths)).mapInArrow(run, schema)

    # the directions of a pass travel with its code; lengths beyond the bound take further passes
    passes: list[list[int]] = []
    size = DIRECTIONS_BYTES
    for d in sorted(weights):
        size += weights[d].nbytes + 40 * d
        if size > DIRECTIONS_BYTES or not passes:
            passes.append([])
            size = weights[d].nbytes + 40 * d
        passes[-1].append(d)
    out = spark.createDataFrame([], schema)
    for k, lengths in enumerate(passes):
        out = out.unionByName(project(lengths)) if k else project(lengths)
    return out
