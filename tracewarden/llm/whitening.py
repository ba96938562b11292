"""Whitening by a bidiagonal qd solver.

Entries become integers, so sums and deviations are exact. Tasks reduce their centred rows block by block to a triangle (QR), and triangles
are reduced in groups of ``FAN`` until one is left. What follows works on that one triangle, whose size depends on the dimension alone: Householder
reflections make it bidiagonal, dqds finds the squared singular values to high relative accuracy, and a twisted factorisation of each shifted
tridiagonal gives its vector, which the reflections carry back. Close values get their vectors by repeated twisted solves that are kept orthogonal.

Defined results. Rows whose vector is null, empty, or holds a null or non-finite entry take no part. A covariance needs vectors of one length, so the
vectors of each length are a fit list of their own. Repeated rows and rows with a null id count as often as they stand there. Components whose eigenvalue is zero up to
rounding (fewer rows than dimensions, constant entries) cannot be scaled to one and are left out; constant vectors give no rows. Equal eigenvalues may have any
orthogonal vectors of their space. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_length, stored

#: rows of one QR step, and triangles that meet in one task
ROWS, FAN = 2048, 16
EPS = float(np.finfo(float).eps)


# -- the solver of one bidiagonal matrix ---------------------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, v) with r = u b v': Householder reflections from the left and the right in turn."""
    a, d = r.astype(float).copy(), r.shape[0]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or not np.abs(x[1:]).max(initial=0.0):
            return None
        w = x / scale
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w = reflector(a[k, k + 1:])
            if w is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential quotient-difference step; None where the shift was too large."""
    qq, ee = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        qq[i] = d + e[i]
        t = q[i + 1] / qq[i] if qq[i] > 0 else 0.0
        ee[i] = e[i] * t
        d = d * t - shift
        if np.isnan(d):
            return None
    if d < 0:
        return None
    qq[-1] = d
    return qq, ee


def singular_squares(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of a bidiagonal matrix, largest first, by dqds."""
    out: list[float] = []
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not scale:
        return np.zeros(len(diagonal))
    work = [(np.square(diagonal / scale), np.square(above / scale), 0.0)]
    while work:
        q, e, moved = work.pop()
        while len(q):
            if len(q) == 1:
                out.append(moved + q[0])
                break
            # parts that hardly touch are solved apart
            tiny = np.flatnonzero(e <= EPS * EPS * (moved + np.minimum(q[:-1], q[1:])) + 1e-300)
            if len(tiny):
                i = int(tiny[-1])
                if i == len(e) - 1:
                    out.append(moved + q[-1])
                    q, e = q[:-1], e[:-1]
                else:
                    work.append((q[:i + 1], e[:i], moved))
                    q, e = q[i + 1:], e[i + 1:]
                continue
            if q[0] < q[-1]:  # graded the wrong way: turn the part around
                q, e = _reversed(q, e)
            shift = _shift(q, e)
            while (step := _dqds_step(q, e, shift)) is None:
                shift = 0.0 if shift < EPS * q[-1] else shift / 4
            q, e, moved = step[0], step[1], moved + shift
    return np.sort(np.array(out))[::-1] * scale * scale


def _reversed(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values with the part written from its other end."""
    return q[::-1].copy(), e[::-1].copy()


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller value of the last two by two block, a little less than it."""
    a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half = (a - b) / 2
    low = b - c / (half + np.copysign(np.hypot(half, np.sqrt(max(c, 0.0))), half)) if half or c else b
    return max(0.0, min(low, float(q.min()))) * (1 - 1e-3)


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, against: list[np.ndarray], start: np.ndarray | None = None) -> np.ndarray:
    """A unit vector of b'b for an eigenvalue, from the twisted factorisation with the least twist element."""
    q, e = np.square(diagonal), np.square(above)
    t_off = diagonal[:-1] * above  # beside the diagonal of b'b
    d, tiny = len(q), EPS * max(value, 1e-300)
    down, up = np.empty(d), np.empty(d)
    lower, upper = np.zeros(d), np.zeros(d)
    # stationary qd from the top: s is what the first i rows leave of the shift
    s = -value
    for i in range(d):
        p = q[i] + s
        down[i] = p if abs(p) > tiny else -tiny
        if i < d - 1:
            lower[i] = t_off[i] / down[i]
            s = e[i] * (s / down[i]) - value
    # progressive qd from the bottom
    p = q[-1] - value
    ps = np.empty(d)
    ps[-1] = p
    for i in range(d - 2, -1, -1):
        u = e[i] + p
        up[i + 1] = u if abs(u) > tiny else -tiny
        upper[i] = t_off[i] / up[i + 1]
        p = (p * (q[i] / up[i + 1]) if e[i] else q[i]) - value
        ps[i] = p
    # the twist element of row k, what elimination from both ends leaves of it, is s + p + the shift
    gamma = down - q + ps + value
    gamma[0] = ps[0]
    order = np.argsort(np.where(np.isfinite(gamma), np.abs(gamma), np.inf))
    k = int(order[0]) if start is None else int(order[min(len(order) - 1, len(against))])
    z = np.zeros(d)
    z[k] = 1.0
    if start is None:
        for i in range(k - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(k, d - 1):
            z[i + 1] = -upper[i] * z[i]
    else:  # one solve of the twisted system for a given right side
        y = start.copy()
        for i in range(k):
            y[i + 1] -= lower[i] * y[i]
        for i in range(d - 1, k, -1):
            y[i - 1] -= upper[i - 1] * y[i]
        pivot = gamma[k] if abs(gamma[k]) > tiny else tiny
        z[k] = y[k] / pivot
        for i in range(k - 1, -1, -1):
            z[i] = y[i] / down[i] - lower[i] * z[i + 1]
        for i in range(k, d - 1):
            z[i + 1] = y[i + 1] / up[i + 1] - upper[i] * z[i]
    for _ in range(2):
        for w in against:
            z -= (w @ z) * w
    n = np.linalg.norm(z)
    return z / n if n > 0 and np.isfinite(n) else np.full(d, np.nan)


def _exact(diagonal: np.ndarray, above: np.ndarray, value: float, z: np.ndarray, largest: float) -> bool:
    """Is (value, z) an eigenpair of b'b up to rounding?"""
    bz = diagonal * z
    bz[:-1] += above * z[1:]
    t = diagonal * bz
    t[1:] += above * bz[:-1]
    return bool(np.abs(t - value * z).max() <= 64 * EPS * largest)


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of a triangle and their right vectors, as columns, largest first."""
    # large columns first: the matrix is graded the way that reflections and twists work best
    graded = np.argsort(-np.square(r).sum(axis=0), kind="stable")
    diagonal, above, v = bidiagonal(triangle_of([r[:, graded]]))
    v = v[np.argsort(graded)]
    values = singular_squares(diagonal, above)
    full = values > len(values) * EPS * values.max(initial=0.0)
    values, found = values[full][:most], []
    rng = np.random.default_rng(1)
    for i, x in enumerate(values):
        close = [found[j] for j in range(i) if values[j] - x <= 1e-3 * x]
        z = twisted_vector(diagonal, above, x, close)
        if close or not _exact(diagonal, above, x, z, values[0]):
            for _ in range(4):
                z = twisted_vector(diagonal, above, x * (1 - 4 * EPS), close, z if np.isfinite(z).all() else rng.normal(size=len(z)))
        found.append(z)
    vectors = v @ np.column_stack(found) if found else np.zeros((len(v), 0))
    # either sign serves; the largest entry is made positive so that runs agree
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


# -- reduction on Spark --------------------------------------------------------------------------------------------

def usable(rows: DataFrame, vec_id: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(id, x) of the rows that take part, as integers."""
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    return rows.select(F.col(vec_id).alias("id"), v.alias("v")).where(fine).select(
        "id", F.transform("v", lambda c: F.floor(c * scale).cast("bigint") + offset).alias("x"))


def sums(ints: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Vector length -> (rows, exact sum of each entry); a task sends one row per length."""
    def run(batches):
        found: dict[int, list] = {}
        for b in batches:
            for d, (at, x) in by_length(b.column("x")).items():
                n, s = found.get(d, (0, np.zeros(d, dtype=np.int64)))
                found[d] = [n + len(at), s + x.sum(axis=0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()),
             pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.int64()))], ["d", "n", "s"])

    part = ints.select("x").mapInArrow(run, "d int, n long, s array<long>")
    rows = part.select("d", "n", F.posexplode("s")).groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    return {d: (next(r["n"] for r in rows if r["d"] == d), [int(r["s"]) for r in sorted((r for r in rows if r["d"] == d), key=lambda r: r["pos"])])
            for d in {r["d"] for r in rows}}  # a number per length and entry


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact; as objects where 64 bits do not hold it."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
    if top * n + max(map(abs, s)) < 2**62:
        return x * n - np.array(s, dtype=np.int64)
    return x.astype(object) * n - np.array(s, dtype=object)


def triangle_of(blocks) -> np.ndarray | None:
    """The triangle of all rows of the blocks."""
    r = None
    for b in blocks:
        r = np.linalg.qr(b if r is None else np.vstack([r, b]), mode="r")
    return r


def triangles(ints: DataFrame, total: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Vector length -> the triangle of all its centred rows."""
    def packed(of: dict[int, np.ndarray], part: int):
        return pa.RecordBatch.from_arrays([pa.array(list(of), pa.int32()), pa.array([part] * len(of), pa.int32()), pa.array([r.ravel().tolist() for r in of.values()], pa.list_(pa.float64()))],
                                          ["d", "part", "r"])

    def run(batches):
        from pyspark import TaskContext

        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                for d, (_, x) in by_length(b.column("x").slice(i, ROWS)).items():
                    n, s = total[d]
                    found[d] = triangle_of(([found[d]] if d in found else []) + [(centred(x, n, s) / n).astype(float)])
        yield packed(found, TaskContext.get().partitionId())

    def join(group: pa.Table) -> pa.Table:
        d = group["d"][0].as_py()
        blocks = (np.array(r.as_py()).reshape(-1, d) for r in group["r"])
        return pa.Table.from_batches([packed({d: triangle_of(blocks)}, group["part"][0].as_py())])

    schema = "d int, part int, r array<double>"
    left = stored(ints.select("x").mapInArrow(run, schema), "triangles")
    while (left.agg(F.max("part")).first()[0] or 0) > 0:
        left = stored(left.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("d", "part").applyInArrow(join, schema), "triangles")
    return {r["d"]: np.array(r["r"]).reshape(-1, r["d"]) for r in left.collect()}  # one triangle per length


def whiten(rows: DataFrame, most: int = 8, scale: int = 1024, offset: int = 100_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for the first ``most`` components of each row.

    ``deviation`` is a decimal, exact up to 38 digits; ``identity_error`` is measured over all whitened rows.
    """
    ints = usable(rows, vec_id, vector, scale, offset)
    total = sums(ints)
    models = {}
    for d, r in triangles(ints, total).items():
        n, _ = total[d]
        square = np.zeros((d, d))
        square[:len(r)] = r
        values, vectors = principal(square, most)
        models[d] = vectors / np.sqrt(values / n) if len(values) else vectors, values / np.square(r).sum() if len(values) else values

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                for d, (at, x) in by_length(b.column("x")).items():
                    n, s = total[d]
                    turn, explained = models[d]
                    k = turn.shape[1]
                    if not k:
                        continue
                    c = centred(x, n, s)
                    z = (c / n).astype(float) @ turn
                    big = c.astype(object) if c.dtype != object and d * int(np.abs(c).max(initial=0)) ** 2 >= 2**63 else c
                    dev = [str(y) for y in (big * big).sum(axis=1)]
                    rep = np.repeat(np.arange(len(at)), k)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(at[rep])), pa.array(np.full(len(rep), d), pa.int32()), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                         pa.array(np.full(len(rep), n), pa.int64()), pa.array(dev, pa.string()).take(pa.array(rep)),
                         pa.array(z.ravel()), pa.array(np.tile(explained, len(at)))], ["id", "d", "component", "n", "deviation", "whitened", "explained"])

    id_type = ints.schema["id"].dataType.simpleString()
    out = ints.mapInArrow(run, f"id {id_type}, d int, component int, n long, deviation string, whitened double, explained double")
    out = out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    return out.join(F.broadcast(identity_errors(ints, total, models)), "d").select("id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def identity_errors(ints: DataFrame, total: dict, models: dict) -> DataFrame:
    """(d, identity_error): the largest absolute entry of the whitened rows' covariance minus the identity; tasks merge means and products."""
    def run(batches):
        found: dict[int, list] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                for d, (at, x) in by_length(whole.column("x").slice(i, ROWS)).items():
                    n, s = total[d]
                    z = (centred(x, n, s) / n).astype(float) @ models[d][0]
                    mean = z.mean(axis=0)
                    y = z - mean
                    m, mu, c = found.get(d, (0, np.zeros(len(mean)), np.zeros((len(mean), len(mean)))))
                    gap, both = mean - mu, m + len(at)
                    found[d] = [both, mu + gap * (len(at) / both), c + y.T @ y + np.outer(gap, gap) * (m * len(at) / both)]
        for d, (m, mu, c) in found.items():
            full = np.vstack([mu * m, c + m * np.outer(mu, mu)])  # about zero: the rows were centred before
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([full.ravel().tolist()], pa.list_(pa.float64()))], ["d", "m"])

    parts = ints.select("x").mapInArrow(run, "d int, m array<double>").select("d", F.posexplode("m")).groupBy("d", "pos").agg(F.sum("col").alias("m"))
    spark, errors = ints.sparkSession, []
    found: dict[int, dict[int, float]] = {}
    for r in parts.collect():  # (k + 1) * k numbers per length
        found.setdefault(r["d"], {})[r["pos"]] = r["m"]
    for d, m in found.items():
        n, k = total[d][0], models[d][0].shape[1]
        full = np.array([m[i] for i in range(len(m))]).reshape(k + 1, k) / n if k else np.zeros((1, 0))
        cov = full[1:] - np.outer(full[0], full[0])
        errors.append((d, float(np.abs(cov - np.eye(k)).max(initial=0.0))))
    return spark.createDataFrame(errors, "d int, identity_error double")
