"""String similarities that Spark lacks, for batches of pairs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    """Jaro similarity; two empty strings are alike."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    in_a: list[str] = []
    places: list[int] = []
    for i, c in enumerate(a):
        low = max(0, i - reach)
        for j in range(low, min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = ""
                in_a.append(c)
                places.append(j)
                break
    m = len(in_a)
    if not m:
        return 0.0
    in_b = [b[j] for j in sorted(places)]
    swapped = sum(x != y for x, y in zip(in_a, in_b, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common prefix of up to four characters where it is above 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    n = 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return j + 0.1 * n * (1 - j)


def _over(f):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, DoubleType())


jaro_column = _over(jaro)
jaro_winkler_column = _over(jaro_winkler)
