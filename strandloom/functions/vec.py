"""Vector math on array columns, and the table forms of sigmoid and logarithm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bound and size of the tables (fixed values).
MAX_SIGMOID, TABLE_SIZE, LOG_SHIFT = 8, 512, 1e-5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def add(a, b) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x + y)


def axpy(scale, x, y) -> Column:
    """y + scale * x."""
    s = _c(scale) if isinstance(scale, (str, Column)) else F.lit(float(scale))
    return F.zip_with(_doubles(x), _doubles(y), lambda u, v: v + s * u)


def mul(a, scale) -> Column:
    s = _c(scale) if isinstance(scale, (str, Column)) else F.lit(float(scale))
    return F.transform(_doubles(a), lambda x: x * s)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def uniform(dim: int) -> Column:
    """All components 1 / dim."""
    return F.array_repeat(F.lit(1.0 / dim), dim)


def randomized(dim: int, seed: int) -> Column:
    """Components in [-1, 1)."""
    return F.array(*(F.rand(seed * 10_007 + i) * 2 - 1 for i in range(dim)))


def sigmoid_table(x) -> Column:
    """Sigmoid from a table with 512 steps over [-8, 8]: x is rounded down to a step, beyond the ends it is exactly 0 or 1."""
    x = _c(x).cast("double")
    step = F.floor((x + MAX_SIGMOID) * TABLE_SIZE / (2 * MAX_SIGMOID)) * (2.0 * MAX_SIGMOID / TABLE_SIZE) - MAX_SIGMOID
    return F.when(x < -MAX_SIGMOID, 0.0).when(x > MAX_SIGMOID, 1.0).otherwise(1 / (1 + F.exp(-step)))


def log_table(x) -> Column:
    """Logarithm from a table with 512 steps over [0, 1]; above 1 it is 0."""
    x = _c(x).cast("double")
    return F.when(x > 1, 0.0).otherwise(F.log((F.floor(x * TABLE_SIZE) + LOG_SHIFT) / TABLE_SIZE))


def _summed(vec):
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(_doubles(vec))


#: Up to so many components, built-in sums of each are faster than one sum of vectors.
FEW_COMPONENTS = 16


def mean_by(df, keys: list[str], vec: str, out: str = "vec", weight=None, dim: int | None = None):
    """Componentwise mean of ``vec`` by ``keys``, weighted by ``weight``: one partial sum a key and task goes through the shuffle.

    Groups without rows don't appear; nulls in ``vec`` don't count. Where ``dim`` is given and small, components have sums of their own.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    w = F.lit(1.0) if weight is None else _c(weight).cast("double")
    if dim and dim <= FEW_COMPONENTS:
        total = F.sum(w)
        return df.where(_c(vec).isNotNull()).groupBy(*keys).agg(F.array(*(F.sum(F.get(_c(vec), F.lit(i)).cast("double") * w) / total for i in range(dim))).alias(out))
    return df.where(_c(vec).isNotNull()).groupBy(*keys).agg(vector_to_array(Summarizer.mean(_summed(vec), w)).alias(out))


def sum_by(df, keys: list[str], vec: str, out: str = "vec", dim: int | None = None):
    """Componentwise sum of ``vec`` by ``keys``, in the same way."""
    return df.where(_c(vec).isNotNull()).groupBy(*keys).agg(summed(vec, dim or FEW_COMPONENTS + 1).alias(out))


#: Binary places that exact sums keep.
EXACT_BITS = 40


def exact_sum(x) -> Column:
    """Aggregate: a sum whose bits depend on neither order nor partitions.

    Each number is rounded to a multiple of 2**-40, and these are summed as whole numbers of 38 digits.
    """
    return F.sum(F.rint(_c(x).cast("double") * 2.0**EXACT_BITS).cast("decimal(38,0)")).cast("double") / 2.0**EXACT_BITS


def sum_in_order(order, vec, dim: int) -> Column:
    """Aggregate: the componentwise sum in the order of ``order``, so of the same bits for any partitions. It holds the vectors of a group: for few of them."""
    held = F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), _doubles(vec).alias("v"))))
    return F.aggregate(held, zeros(dim), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b))


def summed(vec, dim: int) -> Column:
    """Aggregate: the componentwise sum of arrays of ``dim`` numbers."""
    if dim <= FEW_COMPONENTS:
        return F.array(*(F.sum(F.get(_c(vec), F.lit(i)).cast("double")) for i in range(dim)))
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.sum(_summed(vec)))


def to_text(vec, digits: int = 6) -> Column:
    """Components with ``digits`` decimals, joined by spaces."""
    return F.concat_ws(" ", F.transform(_doubles(vec), lambda x: F.format_string(f"%.{digits}f", x)))
