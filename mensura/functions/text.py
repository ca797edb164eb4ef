"""Text helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def decimal_comma(x: Column, digits: int = 1, sign: bool = False) -> Column:
    pattern = f"%{'+' if sign else ''}.{digits}f"
    return F.replace(F.format_string(pattern, x), F.lit("."), F.lit(","))


def slug(name: Column) -> Column:
    s = F.trim(name)
    for umlaut, ascii_pair in C.UMLAUTS:
        s = F.replace(s, F.lit(umlaut), F.lit(ascii_pair))
    s = F.regexp_replace(s, "[^A-Za-z0-9]+", "-")
    s = F.upper(F.regexp_replace(s, "^-+|-+$", ""))
    return F.when(s == "", "ARTIKEL").otherwise(s)


def natural_sort_key(text: Column) -> Column:
    """Sortable struct: text and number parts in turn, then the folded raw text.

    Digit runs of any length compare as numbers, other parts case-folded. A text always starts with a (possibly empty) text part.
    """
    s = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), F.lit(1))
    lead = F.when(F.regexp_like(s, F.lit(r"^\d")), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>"))
    key = F.transform(F.concat(lead, parts), lambda t: F.struct(
        F.when(F.regexp_like(t, F.lit(r"^\d")), F.lit(1)).otherwise(F.lit(0)).alias("kind"),
        # a number of any length: its digits without leading zeros, longer ones after shorter ones
        F.when(F.regexp_like(t, F.lit(r"^\d")), F.length(F.ltrim(t, F.lit("0")))).otherwise(F.lit(0)).alias("digits"),
        F.when(F.regexp_like(t, F.lit(r"^\d")), F.ltrim(t, F.lit("0"))).otherwise(F.lit("")).alias("num"),
        F.when(F.regexp_like(t, F.lit(r"^\d")), "").otherwise(F.lower(t)).alias("txt")))
    return F.struct(key.alias("parts"), F.lower(s).alias("raw"))


def stem_timestamp(stem: Column) -> Column:
    """``YYYYMMDD-HHMMSS-fff`` as a timestamp; anything else is NULL."""
    ok = F.regexp_like(stem, F.lit(r"^\d{8}-\d{6}-\d{3}$"))
    return F.when(ok, F.try_to_timestamp(stem, F.lit("yyyyMMdd-HHmmss-SSS")))


def stem_text(stem: Column) -> Column:
    return F.coalesce(F.date_format(stem_timestamp(stem), "dd.MM.yyyy HH:mm:ss"), stem)


def format_diameter(corrected: Column, height: Column) -> Column:
    d = decimal_comma(corrected)
    return F.when(F.coalesce(height, F.lit(0.0)) != 0,
                  F.concat(F.lit("Ø "), d, F.lit(" mm (höhenkorrigiert, h = "),
                           decimal_comma(height, 0), F.lit(" mm)"))
                  ).otherwise(F.concat(F.lit("Ø "), d, F.lit(" mm (Bodenebene)")))


def format_delta(error: Column, tol_mm: float) -> Column:
    return F.concat(F.lit("Δ "), decimal_comma(error), F.lit(" mm von ±"),
                    decimal_comma(F.lit(float(tol_mm))))


def format_rank_line(rank: Column, name: Column, posterior: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(". "), name, F.lit(" · "),
                    F.format_string("%.0f", posterior * 100), F.lit(" %"))


def format_measured(diameter: Column, circularity: Column, area: Column) -> Column:
    z = F.lit(0.0)
    return F.concat(F.lit("Gemessen: Ø "), decimal_comma(F.coalesce(diameter, z)),
                    F.lit(" mm (Bodenebene) · Rundheit "),
                    decimal_comma(F.coalesce(circularity, z), 2), F.lit(" · Fläche "),
                    F.format_string("%.0f", F.coalesce(area, z) / 100), F.lit(" cm²"))


def headline(decision: Column, best_name: Column) -> Column:
    done = F.when(F.coalesce(best_name, F.lit("")) == "", "✓ Automatisch übernommen").otherwise(
        F.concat(F.lit("✓ Automatisch übernommen: "), best_name))
    return (F.when(decision == C.ACCEPT, done)
            .when(decision == C.AMBIGUOUS, "Bitte bestätigen").otherwise("Kein Treffer"))


def headline_class(decision: Column) -> Column:
    return (F.when(decision == C.ACCEPT, "accept")
            .when(decision == C.AMBIGUOUS, "confirm").otherwise("reject"))
