"""Small vectors and matrices as Python lists of Columns, so that everything stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]
#: Names of a symmetric 3x3 matrix's entries, and the places they stand for.
SYM = ("xx", "xy", "xz", "yy", "yz", "zz")
SYM_AT = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def vector(prefix: str = "", names: Sequence[str] = ("x", "y", "z")) -> Vector:
    return [F.col(prefix + n) for n in names]


def dot(a: Sequence, b: Sequence) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Sequence, b: Sequence) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Sequence) -> Column:
    return F.sqrt(dot(a, a))


def apply(matrix: Sequence[Sequence], v: Sequence) -> Vector:
    """matrix (rows of numbers or Columns) times v."""
    return [dot([_column(m) for m in row], v) for row in matrix]


def symmetric(prefix: str) -> list[list[Column]]:
    """The 3x3 matrix whose entries are the columns prefix + xx, xy, ..."""
    at = {k: F.col(prefix + n) for n, k in zip(SYM, SYM_AT, strict=True)}
    return [[at[min(i, j), max(i, j)] for j in range(3)] for i in range(3)]


def sandwich(r: Sequence[Sequence], m: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """r m r^T for a symmetric m; the upper triangle is computed and mirrored."""
    rm = [[dot([_column(x) for x in r[i]], [m[k][j] for k in range(3)]) for j in range(3)] for i in range(3)]
    out: list[list] = [[None] * 3 for _ in range(3)]
    for i, j in SYM_AT:
        out[i][j] = out[j][i] = dot(rm[i], [_column(x) for x in r[j]])
    return out


def hat(v: Sequence) -> list[list[Column]]:
    """The matrix that takes w to v x w."""
    zero = F.lit(0.0)
    return [[zero, -v[2], v[1]], [v[2], zero, -v[0]], [-v[1], v[0], zero]]


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison; negative zero becomes zero."""
    return F.round(c, digits) + F.lit(0.0)


def _column(x) -> Column:  # noqa: ANN001
    return x if isinstance(x, Column) else F.lit(float(x))
