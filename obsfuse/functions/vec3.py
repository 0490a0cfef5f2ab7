"""3-vector and packed symmetric 3x3 algebra as Spark columns.

Vectors are triples of columns; symmetric matrices are six columns in the order
xx, xy, xz, yy, yz, zz; general 3x3 matrices are nine columns in row-major order.
Everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Sym = tuple[Column, Column, Column, Column, Column, Column]

SYM = ("xx", "xy", "xz", "yy", "yz", "zz")
#: chi-squared (3 degrees of freedom) quantiles; fixed values.
CHI2_3 = {0.50: 2.36597388, 0.80: 4.64162768, 0.90: 6.25138863, 0.95: 7.81472790}
LOG_2PI = 1.8378770664093453


def d(value: float) -> Column:
    return F.lit(float(value))


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    return tuple(F.col(f"{prefix}{n}").cast("double") for n in names)  # type: ignore[return-value]


def sym(prefix: str = "c_") -> Sym:
    return tuple(F.col(f"{prefix}{s}").cast("double") for s in SYM)  # type: ignore[return-value]


def named(values: Sequence[Column], names: Sequence[str]) -> list[Column]:
    return [v.alias(n) for v, n in zip(values, names, strict=True)]


def named_sym(m: Sym, prefix: str = "c_") -> list[Column]:
    return named(m, [f"{prefix}{s}" for s in SYM])


def add(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(k: Column, a: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(k * x for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def unit(a: Vec, eps: float = 1e-12) -> Vec:
    """Unit vector, or the zero vector when the norm does not exceed ``eps``."""
    n = norm(a)
    return tuple(F.when(n > eps, x / n).otherwise(d(0.0)) for x in a)  # type: ignore[return-value]


def finite(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def outer_sym(a: Vec) -> Sym:
    return (a[0] * a[0], a[0] * a[1], a[0] * a[2], a[1] * a[1], a[1] * a[2], a[2] * a[2])


def trace(m: Sym) -> Column:
    return m[0] + m[3] + m[5]


def det(m: Sym) -> Column:
    xx, xy, xz, yy, yz, zz = m
    return xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)


def log_det(m: Sym) -> Column:
    return F.log(det(m))


def inverse(m: Sym) -> Sym:
    """Adjugate inverse; see :func:`ill_conditioned` for the rows it must not see."""
    xx, xy, xz, yy, yz, zz = m
    k = d(1.0) / det(m)
    return (
        (yy * zz - yz * yz) * k,
        (xz * yz - xy * zz) * k,
        (xy * yz - xz * yy) * k,
        (xx * zz - xz * xz) * k,
        (xy * xz - xx * yz) * k,
        (xx * yy - xy * xy) * k,
    )


def inverse_scaled(m: Sym, k: Column) -> Sym:
    """Adjugate times ``k`` (a staged 1 / det column)."""
    xx, xy, xz, yy, yz, zz = m
    return (
        (yy * zz - yz * yz) * k,
        (xz * yz - xy * zz) * k,
        (xy * yz - xz * yy) * k,
        (xx * zz - xz * xz) * k,
        (xy * xz - xx * yz) * k,
        (xx * yy - xy * xy) * k,
    )


def with_inverse(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the inverse of the packed columns ``source*`` as ``target*``.

    The determinant is staged in its own projection, so it is evaluated once per row and
    later formulas see plain columns instead of nested copies.
    """
    m = sym(source)
    staged = df.withColumn("__k", d(1.0) / det(m))
    return staged.withColumns(
        {f"{target}{s}": c for s, c in zip(SYM, inverse_scaled(m, F.col("__k")), strict=True)}
    ).drop("__k")


def ill_conditioned(m: Sym, ratio: float = 1e-9) -> Column:
    """Rows whose closed-form inverse is unsafe and need the eigenvalue floor."""
    t = trace(m) / 3.0
    return (t <= 1e-10) | (det(m) <= ratio * t * t * t)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def floored_inverse(m: Sym, floor: float = 1e-12, sweeps: int = 10) -> Column:
    """Packed inverse with eigenvalues not below ``floor``, as an array: Jacobi rotations, for the few rows that need them."""
    xx, xy, xz, yy, yz, zz = m
    start = F.struct(F.array(xx, xy, xz, xy, yy, yz, xz, yz, zz).alias("a"), F.array(*[d(float(i % 4 == 0)) for i in range(9)]).alias("v"))

    def turned(at: Column, cs: Column, p: int, q: int, rows: bool) -> Column:
        out = [at[i] for i in range(9)]
        for i in range(3):
            one, two = (3 * p + i, 3 * q + i) if rows else (3 * i + p, 3 * i + q)
            out[one], out[two] = cs["c"] * at[one] - cs["s"] * at[two], cs["s"] * at[one] + cs["c"] * at[two]
        return F.array(*out)

    def step(state: Column, p: int, q: int) -> Column:
        a, v = state["a"], state["v"]
        angle = (a[4 * q] - a[4 * p]) / (2.0 * a[3 * p + q])
        tangent = F.when(a[3 * p + q] == 0, d(0.0)).otherwise(
            _bound(angle, lambda t: F.when(t >= 0, d(1.0)).otherwise(d(-1.0)) / (F.abs(t) + F.sqrt(t * t + 1.0)))
        )
        cosine = _bound(tangent, lambda t: F.struct(t.alias("t"), (d(1.0) / F.sqrt(t * t + 1.0)).alias("c")))
        turn = _bound(cosine, lambda t: F.struct(t["c"].alias("c"), (t["t"] * t["c"]).alias("s")))
        return _bound(turn, lambda cs: F.struct(turned(turned(a, cs, p, q, False), cs, p, q, True).alias("a"), turned(v, cs, p, q, False).alias("v")))

    def sweep(state: Column, k: Column) -> Column:
        return F.when(k % 3 == 0, step(state, 0, 1)).when(k % 3 == 1, step(state, 0, 2)).otherwise(step(state, 1, 2))

    def inverse(state: Column) -> Column:
        v, size = state["v"], [F.greatest(state["a"][4 * k], d(floor)) for k in range(3)]
        return F.array(*[sum((v[3 * i + k] * v[3 * j + k] / size[k] for k in (1, 2)), v[3 * i] * v[3 * j] / size[0]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))])

    return F.aggregate(F.sequence(F.lit(0), F.lit(3 * sweeps - 1)), start, sweep, inverse)


def sym_vec(m: Sym, v: Vec) -> Vec:
    xx, xy, xz, yy, yz, zz = m
    return (
        xx * v[0] + xy * v[1] + xz * v[2],
        xy * v[0] + yy * v[1] + yz * v[2],
        xz * v[0] + yz * v[1] + zz * v[2],
    )


def quad(m: Sym, v: Vec) -> Column:
    return dot(sym_vec(m, v), v)


def mahalanobis2(m: Sym, v: Vec) -> Column:
    """v^T M^-1 v as one quotient: adjugate form over the determinant."""
    xx, xy, xz, yy, yz, zz = m
    a, b, c = v
    form = (
        (yy * zz - yz * yz) * a * a
        + (xx * zz - xz * xz) * b * b
        + (xx * yy - xy * xy) * c * c
        + d(2.0)
        * ((xz * yz - xy * zz) * a * b + (xy * yz - xz * yy) * a * c + (xy * xz - xx * yz) * b * c)
    )
    return form / det(m)


def gaussian_nll(m: Sym, v: Vec) -> Column:
    return d(0.5) * (d(3 * LOG_2PI) + log_det(m) + mahalanobis2(m, v))


def mat_vec(r: Sequence[Column], v: Vec) -> Vec:
    return tuple(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3))  # type: ignore[return-value]


def congruence(r: Sequence[Column], m: Sym) -> Sym:
    """R M R^T for a general 3x3 R and packed symmetric M."""
    full = [[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]]
    left = [
        [sum((r[3 * i + k] * full[k][j] for k in range(1, 3)), r[3 * i] * full[0][j]) for j in range(3)]
        for i in range(3)
    ]

    def cell(i: int, j: int) -> Column:
        return left[i][0] * r[3 * j] + left[i][1] * r[3 * j + 1] + left[i][2] * r[3 * j + 2]

    return (cell(0, 0), cell(0, 1), cell(0, 2), cell(1, 1), cell(1, 2), cell(2, 2))


def structured(var_par: Column, var_lat: Column, ray: Vec) -> Sym:
    """lat * I + (par - lat) * ray ray^T."""
    o = outer_sym(ray)
    k = var_par - var_lat
    return (
        var_lat + k * o[0],
        k * o[1],
        k * o[2],
        var_lat + k * o[3],
        k * o[4],
        var_lat + k * o[5],
    )


def apply_similarity(scale_: Column, rot: Sequence[Column], t: Vec, p: Vec) -> Vec:
    return tuple(scale_ * a + b for a, b in zip(mat_vec(rot, p), t, strict=True))  # type: ignore[return-value]


def solve3(m: Sym, b: Vec) -> Vec:
    return sym_vec(inverse(m), b)
