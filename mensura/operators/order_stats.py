"""Exact order statistics by radix refinement, without ever sorting a group.

A group (an article, a variant, the whole table) may hold a third of all rows,
so a window over the group, ``collect_list`` or the exact ``percentile`` buffer
is out. Every value has a 64-bit code in the same order (``order_code``), read as four
digits of 16 bits:

* Selection counts a group's rows by the first digit, finds the digit in which each wanted position falls, and
  counts the rows behind that digit by the next one; four passes end at single values. A count table has at
  most 65,536 rows for a group and wanted prefix, is combined before the exchange, and is all that a
  window sees. Rows (keys, value and code, written once as four passes read them) are filtered and counted,
  never exchanged or sorted.
* Positions of all values add up what stands before a value's digit at each of the four levels. Each
  level is counted from the one below it.

Nothing depends on a sample, so equal tables take equal steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

_V, _CODE, _CNT, _BELOW, _N = "_value", "_code", "_cnt", "_below", "_n"
_SHIFTS = (48, 32, 16, 0)


def _exponent(a: Column, near: Column, power: Column) -> Column:
    """The exponent of ``a``: the logarithm only proposes ``near``, whose power of two is then compared."""
    return F.when((a < power) & (near > -1022), near - 1).when((near < 1023) & (a >= power * 2.0), near + 1).otherwise(near)


def _proposed(a: Column) -> Column:
    return F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(a)).cast("double")))


def _finite(v: Column) -> Column:
    """The magnitude of a number, NULL for infinities and NaN: they have no mantissa, and casting them to a long is an error."""
    a = F.abs(v)
    return F.when(a < float("inf"), a)


def _scaled(a: Column, e: Column) -> Column:
    """The 53 bits of the mantissa, in two steps, as one factor may be out of range; scaling by powers of two is exact."""
    half = F.floor((52 - e) / 2)
    return (a * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), 52 - e - half)).cast("long")


def _code_of(v: Column, e: Column, scaled: Column) -> Column:
    a, one = F.abs(v), F.lit(1).cast("long")
    # Below 2 ** -1022 numbers have no leading one.
    bits = F.when(a < 2.0 ** -1022, scaled).otherwise(F.shiftleft((e + 1023).cast("long"), 52) + (scaled - F.shiftleft(one, 52)))
    top = F.shiftleft(F.lit(2047).cast("long"), 52)
    return (F.when(F.isnan(v), top + 1).when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.signum(v).cast("long") * top)
            .otherwise(F.signum(v).cast("long") * bits))


def order_code(v: Column) -> Column:
    """A long in the same order as the double: sign, exponent and mantissa as numbers.

    -0.0 and 0.0 are equal; NaN comes last, as in Spark's order. On tables ``with_order_code`` takes each step once a row.
    """
    a = _finite(v)
    near = _proposed(a)
    e = _exponent(a, near, F.pow(F.lit(2.0), near))
    return _code_of(v, e, _scaled(a, e))


def with_order_code(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the order code of ``value``. Every step is a column of its own: within one expression its
    logarithm and powers would be taken again wherever the step is named, some tens of times a row."""
    v = F.col(value).cast("double")
    a = _finite(v)
    steps = df.withColumn("_near", _proposed(a)).withColumn("_power", F.pow(F.lit(2.0), F.col("_near")))
    steps = steps.withColumn("_e", _exponent(a, F.col("_near"), F.col("_power")))
    steps = steps.withColumn("_scaled", _scaled(a, F.col("_e")))
    return steps.withColumn(out, _code_of(v, F.col("_e"), F.col("_scaled"))).drop("_near", "_power", "_e", "_scaled")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL, keeping the left columns once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _coded(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """_all (a constant that stands for "no keys"), keys, _value and _code of the rows that have a value."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(F.lit(1).alias("_all"), *keys, value.alias(_V)).where(F.col(_V).isNotNull())
    whole = isinstance(rows.schema[_V].dataType, T.IntegralType)
    rows = rows.withColumn(_CODE, F.col(_V).cast("long")) if whole else with_order_code(rows, _V, _CODE)
    return rows.withColumn(_CODE, F.coalesce(_CODE, F.lit(0).cast("long")))


def value_counts(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """keys, _value, _cnt (rows equal), _below (rows smaller), _n (rows in group)."""
    gk = ["_all", *keys]
    leaf = cut_lineage(_coded(df, keys, value).groupBy(*gk, _CODE).agg(F.count(F.lit(1)).alias(_CNT), F.min(_V).alias(_V)))
    levels = [leaf.select(*gk, _V, _CNT, F.col(_CODE).alias("_p0"))]
    for shift in (16, 32, 48):          # counts by ever shorter prefixes, each from the one before
        below = levels[-1].select(*gk, _CNT, F.shiftright(f"_p{shift - 16}", 16).alias(f"_p{shift}"))
        levels.append(below.groupBy(*gk, f"_p{shift}").agg(F.sum(_CNT).alias(_CNT)))
    top = levels[-1]
    w = Window.partitionBy(*gk)
    out = top.select(*gk, "_p48", (F.sum(_CNT).over(w.orderBy("_p48")) - F.col(_CNT)).alias(_BELOW), F.sum(_CNT).over(w).alias(_N))
    for shift, level in ((32, levels[2]), (16, levels[1]), (0, levels[0])):
        parent, own = f"_p{shift + 16}", f"_p{shift}"
        level = level.withColumn(parent, F.shiftright(own, 16))
        before = F.sum(_CNT).over(Window.partitionBy(*gk, parent).orderBy(own)) - F.col(_CNT)
        level = level.withColumn("_before", before)
        if shift:
            level = level.drop(_CNT)
        out = _null_safe_join(level, out, [*gk, parent]).withColumn(_BELOW, F.col(_BELOW) + F.col("_before")).drop(parent, "_before")
    return out.select(*keys, _V, _CNT, _BELOW, _N)


Targets = Callable[[Column], dict[str, Column]]


def positions(df: DataFrame, keys: Sequence[str], value: Column | str, targets: Targets,
              extra: DataFrame | None = None) -> DataFrame:
    """keys, _n (rows of the group) and the values at the 0-based sorted positions ``targets(n)``.

    A position outside the group gives NULL. ``extra`` has the keys and columns that ``targets`` may name.
    """
    gk = ["_all", *keys]
    rows = cut_lineage(_coded(df, keys, value))         # four passes read it
    counts = rows.groupBy(*gk, F.shiftright(_CODE, 48).alias("_p")).agg(F.count(F.lit(1)).alias(_CNT))
    w = Window.partitionBy(*gk)
    counts = counts.select(*gk, "_p", _CNT, (F.sum(_CNT).over(w.orderBy("_p")) - F.col(_CNT)).alias("_before"), F.sum(_CNT).over(w).alias(_N))
    sizes = counts.groupBy(*gk).agg(F.max(_N).alias(_N))
    if extra is not None:
        counts = _null_safe_join(counts, extra, list(keys))
    wanted = targets(F.col(_N))
    items = F.array(*[F.struct(F.lit(name).alias("_t"), pos.cast("long").alias("_pos")) for name, pos in wanted.items()])
    inside = F.filter(items, lambda x: (x["_pos"] >= F.col("_before")) & (x["_pos"] < F.col("_before") + F.col(_CNT)))
    found = counts.select(*gk, "_p", "_before", F.inline(inside)).select(
        *gk, "_t", "_p", (F.col("_pos") - F.col("_before")).alias("_rest"))
    for shift in _SHIFTS[1:]:
        prefixes = found.select(*gk, "_p").distinct()
        behind = _null_safe_join(rows.withColumn("_p", F.shiftright(_CODE, shift + 16)), prefixes, [*gk, "_p"], "left_semi")
        last = [F.min(_V).alias(_V)] if shift == 0 else []
        level = behind.groupBy(*gk, "_p", F.shiftright(_CODE, shift).alias("_q")).agg(F.count(F.lit(1)).alias(_CNT), *last)
        w = Window.partitionBy(*gk, "_p").orderBy("_q")
        level = level.withColumn("_before", F.sum(_CNT).over(w) - F.col(_CNT))
        hit = (F.col("_rest") >= F.col("_before")) & (F.col("_rest") < F.col("_before") + F.col(_CNT))
        found = _null_safe_join(found, level, [*gk, "_p"]).where(hit).select(
            *gk, "_t", F.col("_q").alias("_p"), (F.col("_rest") - F.col("_before")).alias("_rest"), *([_V] if shift == 0 else []))
    values = found.groupBy(*gk).agg(*[F.max(F.when(F.col("_t") == name, F.col(_V))).alias(name) for name in wanted])
    return _null_safe_join(sizes, values, gk, "left").drop("_all")


def linear(q: float) -> tuple:
    return ("linear", float(q))


def lower(q: float) -> tuple:
    return ("lower", float(q))


MEDIAN = ("linear", 0.5)
UPPER_MEDIAN = ("upper_median", 0.0)


def quantiles(df: DataFrame, keys: Sequence[str], value: Column | str,
              specs: dict[str, tuple], *, count: str | None = None) -> DataFrame:
    """One row per group with the requested exact quantiles.

    ``linear(q)`` interpolates between neighbours, ``lower(q)`` takes position
    ``int(q * (n - 1))`` and ``UPPER_MEDIAN`` position ``n // 2``.
    """
    def targets(n: Column) -> dict[str, Column]:
        out = {}
        for name, (kind, q) in specs.items():
            if kind == "linear":
                out[f"_lo_{name}"], out[f"_hi_{name}"] = F.floor(F.lit(q) * (n - 1)), F.ceil(F.lit(q) * (n - 1))
            else:
                out[name] = F.floor(F.lit(q) * (n - 1)) if kind == "lower" else F.floor(n / 2)
        return out

    finals = []
    for name, (kind, q) in specs.items():
        at = F.lit(q) * (F.col(_N) - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        finals.append((lo + (hi - lo) * (at - F.floor(at))).alias(name) if kind == "linear" else F.col(name))
    head = [F.col(_N).alias(count)] if count else []
    return positions(df, keys, value, targets).select(*keys, *head, *finals)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the 1-based average rank of ``value`` inside each group."""
    ranks = value_counts(df, keys, value).select(
        *keys, F.col(_V).alias(value),
        (F.col(_BELOW) + (F.col(_CNT) + 1) / 2.0).alias(out))
    return _null_safe_join(df, ranks, [*keys, value], "left")


def nth_largest(df: DataFrame, keys: Sequence[str], value: Column | str, nth: DataFrame,
                nth_col: str, out: str) -> DataFrame:
    """Per group the ``nth``-largest value; ``nth`` has the keys and a rank column."""
    at = lambda n: {out: F.when(F.col(nth_col) > 0, n - F.col(nth_col))}
    return positions(df, keys, value, at, nth.select(*keys, nth_col)).select(*keys, out)


def loo_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the median of the *other* values of the group.

    Leaving one value out only moves the median among the few values next to the
    middle, so three order statistics per group are enough, for any group size.
    """
    middle = lambda n: {"_loo_lo": F.floor(n / 2) - 1, "_loo_mid": F.floor(n / 2), "_loo_hi": F.floor(n / 2) + 1}
    mid = positions(df, keys, value, middle).withColumnRenamed(_N, "_loo_n")
    x, lo, m, hi = (F.col(c) for c in (value, "_loo_lo", "_loo_mid", "_loo_hi"))
    even_group = F.when(x <= lo, m).otherwise(lo)
    odd_group = (F.when(x < m, (m + hi) / 2).when(x == m, (lo + hi) / 2)
                 .otherwise((lo + m) / 2))
    joined = _null_safe_join(df, mid, list(keys), "left")
    return joined.withColumn(
        out, F.when(F.col("_loo_n") < 2, None)
        .when(F.col("_loo_n") % 2 == 0, even_group).otherwise(odd_group)
    ).drop("_loo_n", "_loo_lo", "_loo_mid", "_loo_hi")
