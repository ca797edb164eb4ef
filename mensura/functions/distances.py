"""Vector distances on array columns (P06-P12, U01) and the registry behind them.

All are built-in expressions, so they stay in the JVM. The histogram distance
reads its inputs as 32-bit floats, as the published results do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_ZERO = "CAST(0 AS DOUBLE)"
_FLT_EPSILON = 1.1920928955078125e-07


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column], n: int | None) -> Column:
    """Sum of ``term`` over the positions of both arrays.

    With a known length the terms are written out, which compiles to plain arithmetic; the
    higher-order form is interpreted element by element. Both add in the same order.
    """
    if n is None:
        return _sum(F.zip_with(a, b, term))
    terms = [term(F.get(a, i), F.get(b, i)) for i in range(n)]
    return reduce(lambda x, y: x + y, terms)


def delta_e_cie76(a: Column, b: Column, n: int | None = None) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y), n))


def _f32(arr: Column) -> Column:
    return arr.cast("array<float>").cast("array<double>")


def mass(a: Column) -> Column:
    """Sum of a histogram, read as 32-bit floats."""
    return _sum(_f32(a))


def roots(a: Column) -> Column:
    """Square roots of a histogram: made once a side, they turn the overlap of a pair into a dot product."""
    return F.transform(_f32(a), lambda x: F.sqrt(x))


def _bhattacharyya(overlap: Column, product: Column) -> Column:
    scale = F.when(product > _FLT_EPSILON, F.lit(1.0) / F.sqrt(product)).otherwise(F.lit(1.0))
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - overlap * scale))


def bhattacharyya_distance(a: Column, b: Column, n: int | None = None) -> Column:
    a, b = _f32(a), _f32(b)
    both = (_sum(a) * _sum(b)) if n is None else _fold(a, a, lambda x, _: x, n) * _fold(b, b, lambda x, _: x, n)
    return _bhattacharyya(_fold(a, b, lambda x, y: F.sqrt(x * y), n), both)


def bhattacharyya_of_roots(a: Column, mass_a: Column, b: Column, mass_b: Column, n: int | None = None) -> Column:
    return _bhattacharyya(_fold(a, b, lambda x, y: x * y, n), mass_a * mass_b)


def hu_log_distance(a: Column, b: Column, n: int | None = None) -> Column:
    return F.try_divide(_fold(a, b, lambda x, y: F.abs(x - y), n), F.size(a).cast("double"))


def rms_difference(a: Column, b: Column) -> Column:
    return F.sqrt(F.try_divide(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))),
                               F.size(a).cast("double")))


def _clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def color_distance(hue_a: Column, hue_b: Column, hsv_a: Column, hsv_b: Column) -> Column:
    ds = F.abs(F.get(hsv_a, 1) - F.get(hsv_b, 1)) / 255.0
    dv = F.abs(F.get(hsv_a, 2) - F.get(hsv_b, 2)) / 255.0
    return _clip01(0.6 * bhattacharyya_distance(hue_a, hue_b) + 0.2 * dv + 0.2 * ds)


def shape_distance(hu_a: Column, hu_b: Column, circ_a: Column, circ_b: Column) -> Column:
    return _clip01(0.7 * hu_log_distance(hu_a, hu_b) / 5.0 + 0.3 * F.abs(circ_a - circ_b))


# Feature -> (vector column of a measurement, distance). The one extension point.
REGISTRY: dict[str, tuple[str, Callable[..., Column]]] = {
    "delta_e_center": ("lab_center", delta_e_cie76),
    "delta_e_rim": ("lab_rim", delta_e_cie76),
    "hist_center": ("hs_hist_center", bhattacharyya_distance),
    "hist_rim": ("hs_hist_rim", bhattacharyya_distance),
    "hu_log": ("hu_moments", hu_log_distance),
}

SCALAR_SOURCE = {"diameter_mm": "circle_diameter_mm", "circularity": "circularity",
                 "solidity": "solidity"}


def scalar_value(feature: str, prefix: str = "") -> Column:
    """Scalar accessor; a solidity of 0 or less is missing."""
    c = F.col(prefix + SCALAR_SOURCE[feature])
    return F.when(c > 0, c) if feature == "solidity" else c


def usable(vec: Column, proto: Column) -> Column:
    """Neither side missing or empty, and both of one length."""
    return vec.isNotNull() & proto.isNotNull() & (F.size(vec) > 0) & (F.size(vec) == F.size(proto))


def by_length(vec: Column, proto: Column, n: int | None, fn: Callable[[int | None], Column]) -> Column:
    """``fn(n)`` for vectors of the expected length, the general form for others, NULL for unusable pairs."""
    if not n:
        return F.when(usable(vec, proto), fn(None))
    fit = vec.isNotNull() & proto.isNotNull() & (F.size(vec) == n) & (F.size(proto) == n)
    return F.when(fit, fn(n)).when(usable(vec, proto), fn(None))


def proto_distance(feature: str, vec: Column, proto: Column, n: int | None = None) -> Column:
    """NULL when either side is missing, empty or of another length. ``n``: the length most vectors have."""
    fn = REGISTRY[feature][1]
    return by_length(vec, proto, n, lambda k: fn(vec, proto, k))


def register_sql(spark: SparkSession) -> None:
    """The same distances as SQL functions, inlined by the optimizer."""
    def s(arr: str) -> str:
        return f"aggregate({arr}, {_ZERO}, (acc, x) -> acc + x)"

    f32 = "CAST(CAST({} AS ARRAY<FLOAT>) AS ARRAY<DOUBLE>)"
    fa, fb = f32.format("a"), f32.format("b")
    sq = s("zip_with(a, b, (x, y) -> (x - y) * (x - y))")
    bodies = {
        "delta_e_cie76": f"sqrt({sq})",
        "hu_log_distance": f"try_divide({s('zip_with(a, b, (x, y) -> abs(x - y))')},"
                           " CAST(size(a) AS DOUBLE))",
        "rms_difference": f"sqrt(try_divide({sq}, CAST(size(a) AS DOUBLE)))",
        "bhattacharyya_distance":
            f"sqrt(greatest({_ZERO}, 1e0 - {s(f'zip_with({fa}, {fb}, (x, y) -> sqrt(x * y))')}"
            f" * CASE WHEN {s(fa)} * {s(fb)} > {_FLT_EPSILON!r}D"
            f" THEN 1e0 / sqrt({s(fa)} * {s(fb)}) ELSE 1e0 END))",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}"
                  f"(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
