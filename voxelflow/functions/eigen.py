"""Closed-form eigenvalues of symmetric 3x3 matrices, and the unit vector of the least one.

Intermediate values are bound once (`let`) and not named by projections: a filter that the optimizer moves below
projections would otherwise copy each of them wherever it is used, and those copies multiply.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import SYM, SYM_AT


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of values, each of which is computed once."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 1)


def eigenvalues(c: Sequence[Column]) -> Column:
    """Struct (l0, l1, l2), ascending, of the matrix with entries c (xx, xy, xz, yy, yz, zz), by the trigonometric form; all are the mean where it is a multiple of the identity."""

    def spread(s: Column) -> Column:
        a, b, d = s["xx"] - s["q"], s["yy"] - s["q"], s["zz"] - s["q"]
        p = F.sqrt((a * a + b * b + d * d + 2 * (s["xy"] * s["xy"] + s["xz"] * s["xz"] + s["yz"] * s["yz"])) / 6)
        det = a * (b * d - s["yz"] * s["yz"]) - s["xy"] * (s["xy"] * d - s["yz"] * s["xz"]) + s["xz"] * (s["xy"] * s["yz"] - b * s["xz"])
        return let({"q": s["q"], "p": p, "det": det}, angle)

    def angle(s: Column) -> Column:
        r = F.when(s["p"] < 1e-15, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["det"] / (2 * F.nullif(s["p"] * s["p"] * s["p"], F.lit(0.0))))))
        return let({"q": s["q"], "p": s["p"], "phi": F.acos(r) / 3}, ends)

    def ends(s: Column) -> Column:
        high, low = s["q"] + 2 * s["p"] * F.cos(s["phi"]), s["q"] + 2 * s["p"] * F.cos(s["phi"] + F.lit(2 * pi / 3))
        return let({"low": low, "high": high, "q": s["q"]}, lambda e: F.struct(e["low"].alias("l0"), (3 * e["q"] - e["low"] - e["high"]).alias("l1"), e["high"].alias("l2")))

    return let(dict(zip(SYM, c, strict=True)) | {"q": (c[0] + c[3] + c[5]) / 3}, spread)


def with_eigenvalues(df: DataFrame, prefix: str = "c", digits: int | None = None) -> DataFrame:
    """df with l0, l1, l2 of the matrix in columns prefix + xx, ...; rounded, if digits is set."""
    out = df.withColumn("__e", eigenvalues([F.col(prefix + n) for n in SYM]))
    value = lambda k: F.round(F.col("__e")[k], digits) if digits else F.col("__e")[k]
    return out.withColumns({k: value(k) for k in ("l0", "l1", "l2")}).drop("__e")


def least_direction(c: Sequence[Column], l: Sequence[Column]) -> Column:  # noqa: E741
    """Struct (x, y, z): the unit vector n of the least eigenvalue, its largest component positive; null if it isn't single.

    (C - l1)(C - l2) is n n^T up to a factor; n is its column with the largest diagonal, scaled.
    """

    def projector(s: Column) -> Column:
        m = {k: s[n] for n, k in zip(SYM, SYM_AT, strict=True)}
        at = lambda i, j, k: m[min(i, j), max(i, j)] - s[k] if i == j else m[min(i, j), max(i, j)]
        scale = F.nullif((s["l0"] - s["l1"]) * (s["l0"] - s["l2"]), F.lit(0.0))
        entry = lambda i, j: (at(i, 0, "l1") * at(0, j, "l2") + at(i, 1, "l1") * at(1, j, "l2") + at(i, 2, "l1") * at(2, j, "l2")) / scale
        return let({n: entry(i, j) for n, (i, j) in zip(SYM, SYM_AT, strict=True)}, column)

    def column(p: Column) -> Column:
        top = F.greatest(p["xx"], p["yy"], p["zz"])
        pick = lambda x, y, z: F.when(p["xx"] == top, p[x]).when(p["yy"] == top, p[y]).otherwise(p[z]) / F.sqrt(F.nullif(top, F.lit(0.0)))
        return F.struct(pick("xx", "xy", "xz").alias("x"), pick("xy", "yy", "yz").alias("y"), pick("xz", "yz", "zz").alias("z"))

    return let(dict(zip(SYM, c, strict=True)) | dict(zip(("l0", "l1", "l2"), l, strict=True)), projector)


def with_normals(df: DataFrame, prefix: str = "c") -> DataFrame:
    """df (with l0, l1, l2) and nx, ny, nz."""
    out = df.withColumn("__n", least_direction([F.col(prefix + n) for n in SYM], [F.col(k) for k in ("l0", "l1", "l2")]))
    return out.withColumns({"n" + a: F.col("__n")[a] for a in "xyz"}).drop("__n")
