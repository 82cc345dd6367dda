"""Student's t distribution as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of Stirling's series.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
# Steps by which an argument is moved up before the series is used.
SHIFT = 8
# Steps of the continued fraction. It needs about the root of its larger parameter, and settles.
STEPS = 400
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number."""
    up = z + SHIFT
    series = (up - 0.5) * F.log(up) - up + F.lit(0.9189385332046727)  # half the logarithm of two pi
    for k, c in enumerate(STIRLING):
        series = series + c / F.pow(up, 2 * k + 1)
    product = z
    for k in range(1, SHIFT):
        product = product * (z + k)
    return series - F.log(product)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    def guarded(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def half(state: Column, numerator: Column) -> Column:
        d = 1 / guarded(1 + numerator * state["d"])
        c = guarded(1 + numerator / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(half(state, even), odd)

    first = 1 / guarded(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def with_student_above(df: DataFrame, t: str, freedom: str, into: str) -> DataFrame:
    """Add the chance of a value above ``t`` under so many degrees of freedom: half an incomplete beta function.

    The parts are columns in turn, so that none is written out more than once.
    """
    v, n = F.col(t), F.col(freedom)
    parts = df.withColumns({"_x": n / (n + v * v), "_a": n / 2, "_b": F.lit(0.5)})
    # The fraction settles fast on one side of the mean; on the other the complement is taken.
    parts = parts.withColumn("_turned", F.col("_x") > (F.col("_a") + 1) / (F.col("_a") + F.col("_b") + 2))

    def either(turned: Column, other: Column) -> Column:
        return F.when(F.col("_turned"), turned).otherwise(other)

    parts = parts.withColumns({"_p": either(F.col("_b"), F.col("_a")), "_q": either(F.col("_a"), F.col("_b")), "_at": either(1 - F.col("_x"), F.col("_x"))})
    p, q, at = F.col("_p"), F.col("_q"), F.col("_at")
    parts = parts.withColumn("_fraction", _fraction(at, p, q))
    parts = parts.withColumn("_inside", F.when(at <= 0, F.lit(0.0)).otherwise(
        F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(at) + q * F.log(1 - at)) * F.col("_fraction") / p))
    tail = either(1 - F.col("_inside"), F.col("_inside")) / 2
    return (parts.withColumn(into, F.when(v >= 0, tail).otherwise(1 - tail))
            .drop("_x", "_a", "_b", "_turned", "_p", "_q", "_at", "_fraction", "_inside"))
