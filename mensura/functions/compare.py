"""Golden-versus-fresh field comparison (P24-P26) and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

DIFF = "struct<field:string,golden:double,actual:double,delta:double,band:string>"


def band(field: str, golden: Column, actual: Column) -> Column:
    delta = F.abs(actual - golden)
    return (F.when(delta <= C.QUANTUM.get(field, C.QUANTUM_DEFAULT), C.PASS)
            .when(delta <= C.SOFT.get(field, C.SOFT_DEFAULT), C.DRIFT).otherwise(C.FAIL))


def band_by_name(field: Column, golden: Column, actual: Column) -> Column:
    """Same rule where the field name is data: limits come from a literal map."""
    def limits(table: dict, default: float) -> Column:
        pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), field), F.lit(default))

    delta = F.abs(actual - golden)
    return (F.when(delta <= limits(C.QUANTUM, C.QUANTUM_DEFAULT), C.PASS)
            .when(delta <= limits(C.SOFT, C.SOFT_DEFAULT), C.DRIFT).otherwise(C.FAIL))


def _diff(field: str, golden: Column, actual: Column, delta: Column, verdict: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), golden.cast("double").alias("golden"),
                    actual.cast("double").alias("actual"), delta.alias("delta"),
                    verdict.alias("band"))


def scalar_diff(field: str, golden: Column, actual: Column) -> Column:
    """NULL when both sides are missing; one missing side fails with a NaN delta."""
    nan = F.lit(float("nan"))
    return (F.when(golden.isNull() & actual.isNull(), F.lit(None).cast(DIFF))
            .when(golden.isNull() | actual.isNull(),
                  _diff(field, golden, actual, nan, F.lit(C.FAIL)))
            .otherwise(_diff(field, golden, actual, actual - golden,
                             band(field, golden, actual))))


def largest_component(golden: Column, actual: Column) -> Column:
    """Struct(abs, neg_pos, golden, actual) of the largest difference, first on ties."""
    return F.array_max(F.transform(F.arrays_zip(golden.alias("g"), actual.alias("a")),
                                   lambda p, i: F.struct(
                                       F.abs(p["a"] - p["g"]).alias("abs"),
                                       (-i).alias("neg_pos"), p["g"].alias("golden"),
                                       p["a"].alias("actual"))))


def vector_diff(field: str, golden: Column, actual: Column) -> Column:
    empty = F.array().cast("array<double>")
    g, a = F.coalesce(golden, empty), F.coalesce(actual, empty)
    best = largest_component(g, a)

    def one(b: Column) -> Column:
        return _diff(field, b["golden"], b["actual"], b["actual"] - b["golden"],
                     band(field, b["golden"], b["actual"]))

    return (F.when((F.size(g) == 0) & (F.size(a) == 0), F.lit(None).cast(DIFF))
            .when(F.size(g) != F.size(a),
                  _diff(field, F.size(g), F.size(a), F.lit(float("nan")), F.lit(C.FAIL)))
            .otherwise(F.get(F.transform(F.array(best), one), 0)))       # best computed once


def severity(b: Column) -> Column:
    return F.when(b == C.FAIL, 2).when(b == C.DRIFT, 1).otherwise(0)


def band_of_severity(s: Column) -> Column:
    return F.when(s == 2, C.FAIL).when(s == 1, C.DRIFT).otherwise(C.PASS)


def worst_band(diffs: Column) -> Column:
    return band_of_severity(F.coalesce(
        F.array_max(F.transform(diffs, lambda d: severity(d["band"]))), F.lit(0)))


def wilson(k: Column, n: Column, z: float = 1.96, corpus: bool = False) -> Column:
    """Struct(p, lo, hi). ``corpus`` rounds to 4 and uses (0,0,0) for n = 0,
    otherwise n = 0 gives (0,0,1) unrounded."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    denom = 1.0 + F.try_divide(F.lit(z * z), n)
    center = (p + F.try_divide(F.lit(z * z), 2.0 * n)) / denom
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1.0 - p), n)
                             + F.try_divide(F.lit(z * z), 4.0 * n * n)) / denom

    def fin(x: Column, empty: float) -> Column:
        x = F.coalesce(x, F.lit(empty))
        return F.round(x, 4) if corpus else x

    return F.struct(
        fin(p, 0.0).alias("p"),
        fin(F.when(n > 0, F.greatest(F.lit(0.0), center - half)), 0.0).alias("lo"),
        fin(F.when(n > 0, F.least(F.lit(1.0), center + half)), 0.0 if corpus else 1.0).alias("hi"))


def rule_of_three(k: Column, n: Column) -> Column:
    """Upper 95 % bound of the error rate after 0 errors in n trials."""
    return F.when((k == 0) & (n > 0), F.lit(3.0) / n)
