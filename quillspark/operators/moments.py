"""Standard deviations that don't depend on the order in which partial sums merge.

A double is cut into three whole numbers ("limbs") of 26 bits after the point each. Their sums and sums of products are
exact in DECIMAL(38,0), so any split of the rows into tasks, and rows that stand for several, give the same sums; the
deviation is then one expression of them. Values of 2^-25 or more in size are represented in full; of smaller ones what lies
below 2^-78 is cut off, the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,0)"
LIMB = float(1 << 26)


def limbs(x: Column) -> list[Column]:
    """Whole numbers l0, l1, l2 with ``x = l0 / 2^26 + l1 / 2^52 + l2 / 2^78`` (each step is exact in doubles)."""
    scaled = x * F.lit(LIMB)
    l0 = F.floor(scaled)
    rest = (scaled - l0) * F.lit(LIMB)
    l1 = F.floor(rest)
    return [l0, l1, F.floor((rest - l1) * F.lit(LIMB))]


def stddev_samp(x: str, count: str | None = None) -> Column:
    """Sample standard deviation of a double column as an aggregate; ``count``: rows that each row stands for. Null values
    are skipped; null for fewer than two rows."""
    times = (F.col(count) if count else F.lit(1)).cast("bigint")
    l0, l1, l2 = (v.cast(DEC) for v in limbs(F.col(x).cast("double")))
    known = F.col(x).isNotNull()

    def total(v: Column) -> Column:
        return F.sum(F.when(known, v.cast("decimal(28,0)") * times.cast("decimal(10,0)"))).cast(DEC)

    n = F.sum(F.when(known, times)).cast(DEC)
    s0, s1, s2 = total(l0), total(l1), total(l2)
    s00, s01, s11, s02 = total(l0 * l0), total(l0 * l1), total(l1 * l1), total(l0 * l2)

    def cross(sum_of_products: Column, a: Column, b: Column) -> Column:
        """``n * sum(u v) - sum(u) * sum(v)`` exactly, or in doubles where that has over 38 digits."""
        exact = F.try_subtract(F.try_multiply(n, sum_of_products), F.try_multiply(a, b)).cast("double")
        return F.coalesce(exact, n.cast("double") * sum_of_products.cast("double") - a.cast("double") * b.cast("double"))

    spread = cross(s00, s0, s0) + F.lit(2 / LIMB) * cross(s01, s0, s1) + F.lit(1 / LIMB**2) * (cross(s11, s1, s1) + F.lit(2.0) * cross(s02, s0, s2))
    m = n.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), spread / (m * (m - 1)))) / F.lit(LIMB))
