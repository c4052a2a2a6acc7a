"""Column expressions on arrays of doubles: they stay in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(f, *columns: ColumnOrName) -> Column:
    """f of columns that are worked out once for each row, however often its lambdas read them.

    (An expression behind a name is copied to where it stands, so inside a lambda it would be worked
    out again for each element.)
    """
    held = F.array(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    return F.get(F.transform(held, lambda s: f(*[s[f"c{i}"] for i in range(len(columns))])), F.lit(0))


def total(values: ColumnOrName) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda s, x: s + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Sum of products; the shorter array decides how many there are."""
    n = F.least(F.size(col(a)), F.size(col(b)))
    return total(F.zip_with(F.slice(col(a), 1, n), F.slice(col(b), 1, n), lambda x, y: x * y))


def scale(values: ColumnOrName, by: ColumnOrName) -> Column:
    return F.transform(col(values), lambda x: x * col(by))


def add(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def subtract(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def matvec(matrix: ColumnOrName, vector: ColumnOrName) -> Column:
    """A matrix (array of rows) times a vector."""
    return F.transform(col(matrix), lambda row: dot(row, vector))


def row_scale(matrix: ColumnOrName, factors: ColumnOrName) -> Column:
    """Each row of a matrix times its own factor."""
    return F.zip_with(col(matrix), col(factors), lambda row, f: F.transform(row, lambda x: x * f))


def quadratic(vector: ColumnOrName, matrix: ColumnOrName) -> Column:
    """c M c' for one vector."""
    return once(lambda c, m: dot(c, matvec(m, c)), vector, matrix)


def matmul(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Product of two matrices that are arrays of rows."""
    def product(a: Column, columns: Column) -> Column:
        return F.transform(a, lambda row: F.transform(columns, lambda column: dot(row, column)))

    at = F.sequence(F.lit(0), F.size(col(b)[0]) - 1)
    return once(product, a, once(lambda b, at: F.transform(at, lambda j: F.transform(b, lambda row: F.get(row, j))), b, at))


def diagonal_of_product(a: ColumnOrName, b: ColumnOrName) -> Column:
    """diag(A B), without the rest of the product."""
    return F.transform(
        F.sequence(F.lit(0), F.size(col(a)) - 1), lambda i: dot(F.get(col(a), i), F.transform(col(b), lambda row: F.get(row, i)))
    )


def pad(values: ColumnOrName, size: ColumnOrName) -> Column:
    """Zeros at the right up to ``size``; longer arrays stay."""
    missing = F.greatest(F.lit(0), col(size) - F.size(col(values)))
    return F.concat(col(values), F.array_repeat(F.lit(0.0), missing))


def lagged_product(values: ColumnOrName, lag: int) -> Column:
    """Sum over t of x[t] x[t + lag], not normalised; 0 where the series is no longer than the lag."""
    n = F.greatest(F.lit(0), F.size(col(values)) - lag)
    return dot(F.slice(col(values), 1, n), F.slice(col(values), lag + 1, n))


def ahead_filter(values: ColumnOrName, coefficients: ColumnOrName) -> Column:
    """y[t] + sum_k a[k] y[t + k], terms past the end being 0.

    With a the parameters of an autoregression this is the product with the factor L' of the banded
    precision matrix L L', so no n x n matrix is made.
    """

    def at(x: Column, a: Column) -> Column:
        ahead = lambda t: F.transform(a, lambda c, k: c * F.coalesce(F.get(x, t + k + 1), F.lit(0.0)))
        return F.transform(x, lambda v, t: v + total(ahead(t)))

    return once(at, values, coefficients)


def relative_to_first(values: ColumnOrName) -> Column:
    """(x - x[0]) / x[0]; with x[0] = 0 as IEEE division gives it: NaN for 0 / 0, else an infinity."""
    odd = lambda d: F.when(d == 0, F.lit(float("nan"))).when(d > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))

    def change(x: Column, base: Column) -> Column:
        return F.transform(x, lambda v: F.when(base == 0, odd(v)).otherwise((v - base) / F.nullif(base, F.lit(0.0))))

    return once(change, values, F.get(col(values), F.lit(0)))
