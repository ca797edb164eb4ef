"""Size, geometry and score arithmetic on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import decimal_comma


def truthy(c: Column) -> Column:
    """0 and NULL both mean missing."""
    return F.coalesce(c, F.lit(0.0)) != 0.0


def nominal_size_mm(diameter: Column, width: Column, depth: Column) -> Column:
    return (F.when(truthy(diameter), diameter)
            .when(truthy(width) & truthy(depth), F.greatest(width, depth))
            .when(truthy(width), width))


def rounded(c: Column, digits: int) -> Column:
    """``round(c, digits)``, half up, without the way through decimals that costs about a microsecond a number.

    A number that is clearly not halfway between two results is rounded as a double: a whole number divided by a
    power of ten is the double nearest to the decimal. Others, and those too large for that, take the usual way.
    """
    scaled = c * F.lit(10.0 ** digits)
    near = F.rint(scaled)
    clear = (F.abs(scaled) < 1e9) & (F.abs(F.abs(scaled - near) - 0.5) > 1e-6)
    return F.when(clear, near / F.lit(10.0 ** digits) + 0.0).otherwise(F.round(c, digits))      # + 0.0: never -0.0


def correction_factor(height: Column, camera_mm: float) -> Column:
    z = float(camera_mm)
    h = F.least(F.coalesce(height, F.lit(0.0)), F.lit(0.8 * z))
    return (F.lit(z) - h) / F.lit(z)


def height_corrected(measured: Column, height: Column, camera_mm: float) -> Column:
    z = float(camera_mm)
    h = F.least(F.coalesce(height, F.lit(0.0)), F.lit(0.8 * z))
    return measured * (F.lit(z) - h) / F.lit(z)


def area_relative_error(area: Column, height: Column, nominal: Column,
                        camera_mm: float) -> Column:
    corr = correction_factor(height, camera_mm)
    nominal_area = F.lit(math.pi) * F.pow(nominal / 2.0, F.lit(2.0))
    return F.abs(area * corr * corr - nominal_area) / nominal_area


def sigma_floor(feature: Column, floors: dict | None = None) -> Column:
    floors = floors or C.SIGMA_FLOORS
    pairs = [x for f, key in C.FLOOR_KEYS.items() for x in (F.lit(f), F.lit(float(floors[key])))]
    return F.create_map(*pairs)[feature]


def sigma_eff(s_enroll: Column, floor: Column) -> Column:
    sig = F.sqrt(s_enroll * s_enroll + floor * floor)
    return F.when(sig == 0, F.raise_error(
        F.lit("sigma_eff is 0: no spread and no floor")).cast("double")).otherwise(sig)


def feature_score(distance: Column, s_enroll: Column, floor: Column) -> Column:
    """Struct of rounded sigma_eff, z and log contribution."""
    sig = sigma_eff(s_enroll, floor)
    z = distance / sig
    return F.struct(F.round(sig, 4).alias("sigma_eff"), F.round(z, 4).alias("z"),
                    F.round(-0.5 * z * z, 4).alias("log_contrib"))


def nominal_band(nominal: Column, tol: float) -> tuple[Column, Column]:
    return nominal - tol, nominal + tol


def ring_zone(r: Column, center_max: float = 0.60, rim_min: float = 0.75) -> Column:
    return F.when(r < center_max, "center").when(r > rim_min, "rim")


def drift_width(lat_p98: Column, diameter: Column, aspect: Column) -> tuple[Column, Column]:
    """Measured lateral width, else the diameter x aspect proxy, and which one it was."""
    has = F.coalesce(lat_p98, F.lit(0.0)) > 0
    width = F.when(has, lat_p98).otherwise(diameter * F.coalesce(aspect, F.lit(0.0)))
    return width, F.when(has, "lat_p98").otherwise("proxy")


def describe_color(h: Column, s: Column, v: Column) -> Column:
    name = F.when(h.isNull() | s.isNull() | v.isNull(), "")
    name = name.when((s < 40) & (v < 60), "schwarz").when((s < 40) & (v < 170), "grau")
    name = name.when(s < 40, "weiß")
    for bound, word in C.HUE_BOUNDS:
        name = name.when(h <= bound, word)
    return name.otherwise("rot")


def derive_article(shape: dict[str, Column], params) -> dict[str, Column]:
    """Master-data columns of a new article from one measured shape.

    ``shape`` needs circle_diameter_mm, circularity, aspect_ratio, long_mm, short_mm
    (sides at floor level), height_mm, h, s, v and notes.
    """
    z = params.camera_height_mm
    is_round = ((shape["circularity"] >= params.round_min)
                & (shape["aspect_ratio"] >= params.round_min))
    hgt = shape["height_mm"]

    def side(c: Column) -> Column:
        return F.round(height_corrected(c, hgt, z), 2)

    return {
        "diameter_mm": F.when(is_round, side(shape["circle_diameter_mm"])),
        "width_mm": F.when(~is_round, side(shape["long_mm"])),
        "depth_mm": F.when(~is_round, side(shape["short_mm"])),
        "height_mm": F.when(truthy(hgt), hgt),
        "color_desc": describe_color(shape["h"], shape["s"], shape["v"]),
        "notes": F.when(F.coalesce(shape["notes"], F.lit("")) != "", shape["notes"])
        .otherwise("Automatisch per Kamera angelegt."),
    }


def geometry_text(diameter: Column, width: Column, depth: Column) -> Column:
    return (F.when(truthy(diameter), F.format_string("Ø %.1f mm", diameter))
            .when(truthy(width) & truthy(depth),
                  F.format_string("%.1f × %.1f mm", width, depth))
            .otherwise("—"))


def age_text(seconds: Column) -> Column:
    def whole(x: Column) -> Column:
        return F.floor(x).cast("string")

    return (F.when(seconds < 90, F.concat(F.lit("vor "), whole(seconds), F.lit(" s")))
            .when(seconds < 5400, F.concat(F.lit("vor "), whole(seconds / 60), F.lit(" min")))
            .when(seconds < 172800, F.concat(F.lit("vor "), whole(seconds / 3600), F.lit(" h")))
            .otherwise(F.concat(F.lit("vor "), whole(seconds / 86400), F.lit(" Tagen"))))


def kill_text(reason: Column, area_pct: Column, over: Column, tol: Column) -> Column:
    area = F.concat(F.lit("Fläche "), decimal_comma(area_pct, 1, sign=True),
                    F.lit(" % (Ø-Gate bestanden)"))
    diam = F.concat(F.lit("Ø "), decimal_comma(over, 2, sign=True),
                    F.lit(" mm über Toleranz ("), decimal_comma(tol, 1), F.lit(" mm)"))
    return F.when((reason == "area") & area_pct.isNotNull(), area).otherwise(diam)
