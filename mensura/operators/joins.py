"""Band join of measurements and catalogue, prefilter and its kills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sizes

_EPS = 1e-6


def interval_bins(lo, hi, width: float):
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def bin_of(point: Column, width: float, key: str) -> Column:
    """The bin of a point; points without a value match nothing anywhere and are spread by their key."""
    return F.coalesce(F.floor(point / width), F.pmod(F.xxhash64(key), F.lit(1024)))


def band_join(points: DataFrame, point: str, bands: DataFrame, lo: str, hi: str,
              width: float, bin_as: str | None = None, pair: Column | None = None, key: str | None = None) -> DataFrame:
    """Equi-join form of ``point between lo and hi``.

    Each band is copied into the bins it touches, each point has one bin, and the
    exact bounds stay as a residual. A plain ``between`` would plan as a nested
    loop. The bands are many times what the files they come from make the planner expect, so a broadcast, which
    passes through the driver, is not left to it; AQE splits a bin that holds too many points. ``bin_as`` keeps the
    bin: all rows of a point are in one, so what is grouped by bin and point needs no exchange after the join.
    ``pair`` is a further condition on both sides. With ``key`` a point without any band stays as one row without
    band columns; those without a value are spread over bins by their key.
    """
    binned = bands.withColumn("_bin", interval_bins(F.col(lo), F.col(hi), width))
    inside = F.col(point).between(F.col(lo), F.col(hi))
    if pair is not None:
        inside = inside & pair
    if key is None:
        pts = points.where(F.col(point).isNotNull()).withColumn("_bin", F.floor(F.col(point) / width))
        found = pts.join(binned.hint("merge"), "_bin").where(inside)
    else:
        pts = points.withColumn("_bin", bin_of(F.col(point), width, key))
        binned = binned.withColumnRenamed("_bin", "_bin_of_band")
        found = pts.join(binned.hint("merge"), (F.col("_bin") == F.col("_bin_of_band")) & inside, "left").drop("_bin_of_band")
    return found.withColumnRenamed("_bin", bin_as) if bin_as else found.drop("_bin")


def catalogue(articles: DataFrame) -> DataFrame:
    """Articles with an effective nominal size; those without never take part."""
    nominal = sizes.nominal_size_mm(F.col("diameter_mm"), F.col("width_mm"), F.col("depth_mm"))
    return articles.withColumn("nominal_mm", nominal).where(F.col("nominal_mm").isNotNull())


def _with_band(cat: DataFrame, tol: float, camera: float, lo: str, hi: str) -> DataFrame:
    """Accepted interval on the *raw* diameter, widened by a hair against rounding."""
    factor = sizes.correction_factor(F.col("height_mm"), camera)
    return (cat.withColumn(lo, (F.col("nominal_mm") - tol) / factor - _EPS)
            .withColumn(hi, (F.col("nominal_mm") + tol) / factor + _EPS))


def geometry_pairs(measured: DataFrame, articles: DataFrame, tol_mm: float,
                   camera_mm: float = 300.0, bin_as: str | None = None) -> DataFrame:
    """Pairs within ``tol_mm`` of the height-corrected diameter, with the error.

    ``measured`` needs circle_diameter_mm and area_mm2; article columns come along.
    """
    cat = _with_band(catalogue(articles), tol_mm, camera_mm, "_lo", "_hi")
    pairs = band_join(measured, "circle_diameter_mm", cat, "_lo", "_hi", bin_width(tol_mm), bin_as).drop("_lo", "_hi")
    return _with_geo_error(pairs, camera_mm).where(F.col("geo_err") <= tol_mm)


def bin_width(tol_mm: float) -> float:
    """Width of the bins in which measurements meet the catalogue."""
    return max(2.0 * tol_mm, _EPS)


def _corrected(camera_mm: float) -> Column:
    return sizes.height_corrected(F.col("circle_diameter_mm"), F.col("height_mm"), camera_mm)


def _with_geo_error(pairs: DataFrame, camera_mm: float) -> DataFrame:
    return pairs.withColumn("corrected_mm", _corrected(camera_mm)).withColumn(
        "geo_err", F.abs(F.col("corrected_mm") - F.col("nominal_mm")))


def _area_error(camera_mm: float):
    return sizes.area_relative_error(F.col("area_mm2"), F.col("height_mm"),
                                     F.col("nominal_mm"), camera_mm)


def area_gate(pairs: DataFrame, area_tol_pct: float, camera_mm: float = 300.0) -> DataFrame:
    """Adds area_rel and area_ok: round articles fail above twice the tolerance."""
    return pairs.withColumn("area_rel", _area_error(camera_mm)).withColumn("area_ok", _area_ok(F.col("area_rel"), area_tol_pct))


def _area_ok(area_rel: Column, area_tol_pct: float) -> Column:
    return ~(sizes.truthy(F.col("diameter_mm")) & (area_rel > 2.0 * area_tol_pct / 100.0))


def prefilter(measured: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float,
              camera_mm: float = 300.0, bin_as: str | None = None) -> DataFrame:
    """Surviving pairs of both geometric gates."""
    pairs = area_gate(geometry_pairs(measured, articles, tol_mm, camera_mm, bin_as),
                      area_tol_pct, camera_mm)
    return pairs.where("area_ok").drop("area_ok")


def prefilter_all(measured: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float, camera_mm: float,
                  bin_as: str, key: str, matched: str) -> DataFrame:
    """``prefilter`` with one more row for each measurement without a surviving pair, where ``matched`` is null.

    Both gates are conditions of the join, so all rows of a measurement stay in its bin.
    """
    cat = _with_band(catalogue(articles), tol_mm, camera_mm, "_lo", "_hi").withColumn(matched, F.lit(True))
    gates = (F.abs(_corrected(camera_mm) - F.col("nominal_mm")) <= tol_mm) & _area_ok(_area_error(camera_mm), area_tol_pct)
    pairs = band_join(measured, "circle_diameter_mm", cat, "_lo", "_hi", bin_width(tol_mm), bin_as, gates, key).drop("_lo", "_hi")
    return _with_geo_error(pairs, camera_mm).withColumn("area_rel", _area_error(camera_mm))


def _with_errors(pairs: DataFrame, tol_mm: float, area_tol_pct: float, camera_mm: float) -> DataFrame:
    """Pairs at any distance with geo_err, over_tolerance_mm, area_rel and reason (null: not killed)."""
    corrected = sizes.height_corrected(F.col("circle_diameter_mm"), F.col("height_mm"), camera_mm)
    pairs = (pairs.withColumn("corrected_mm", corrected)
             .withColumn("geo_err", F.abs(F.col("corrected_mm") - F.col("nominal_mm")))
             .withColumn("over_tolerance_mm", F.round(F.col("geo_err") - tol_mm, 2)))
    pairs = area_gate(pairs, area_tol_pct, camera_mm)
    return pairs.withColumn("reason", F.when(F.col("geo_err") > tol_mm, "diameter").when(~F.col("area_ok"), "area"))


def _kill_columns(tol_mm: float) -> list:
    return [F.col("article_number"), F.col("name"), F.col("reason"), F.round("geo_err", 2).alias("geometry_error_mm"),
            F.lit(round(tol_mm, 2)).alias("tolerance_mm"), F.col("over_tolerance_mm"),
            F.when(F.col("reason") == "area", F.round(F.col("area_rel") * 100.0, 1)).alias("area_error_pct")]


def _near_pairs(measured: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float, camera_mm: float) -> DataFrame:
    """All pairs that are not far: within the tolerance, or at most as much again beyond it."""
    reach = 2.0 * tol_mm + 0.01                         # over_tolerance_mm is rounded to 2 digits
    wide = _with_band(catalogue(articles), reach, camera_mm, "_lo", "_hi")
    pairs = band_join(measured, "circle_diameter_mm", wide, "_lo", "_hi", 2.0 * reach).drop("_lo", "_hi")
    pairs = _with_errors(pairs, tol_mm, area_tol_pct, camera_mm)
    return pairs.where((F.col("geo_err") <= tol_mm) | (F.col("over_tolerance_mm") <= tol_mm))


def true_kills(measured: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float,
               camera_mm: float = 300.0, label: str = "label") -> DataFrame:
    """The kill of each measurement's own article, at any distance: an equi-join on the label."""
    cat = catalogue(articles)
    own = measured.join(cat.hint("merge"), measured[label] == cat["article_number"])        # no catalogue in the driver
    own = _with_errors(own, tol_mm, area_tol_pct, camera_mm).where(F.col("reason").isNotNull())
    return own.select(*[measured[c] for c in measured.columns], *_kill_columns(tol_mm))


def prefilter_kills(measured: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float,
                    camera_mm: float = 300.0, label: str | None = None) -> DataFrame:
    """Kills that are near, by area, or the measurement's own article, with their reason.

    Near is a diameter at most one more tolerance outside. Far kills are the rest of the catalogue
    for every measurement, a product of both tables; ``kill_summary`` counts them exactly, and
    ``all_kills`` lists them. With ``label`` the own article's kill is listed however far it is.
    """
    near = _near_pairs(measured, articles, tol_mm, area_tol_pct, camera_mm).where(F.col("reason").isNotNull())
    near = near.select(*measured.columns, *_kill_columns(tol_mm))
    if label is None:
        return near
    own = true_kills(measured, articles, tol_mm, area_tol_pct, camera_mm, label)
    far = own.where((F.col("reason") == "diameter") & (F.col("over_tolerance_mm") > tol_mm))
    return near.unionByName(far)


def all_kills(measured: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float,
              camera_mm: float = 300.0) -> DataFrame:
    """Every rejected pair: measurements x catalogue rows by definition, dealt in tiles of the catalogue."""
    tiles = 32
    cat = catalogue(articles).withColumn("_tile", F.pmod(F.xxhash64("article_number"), F.lit(tiles)).cast("int"))
    pairs = measured.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(cat, "_tile").drop("_tile")
    pairs = _with_errors(pairs, tol_mm, area_tol_pct, camera_mm).where(F.col("reason").isNotNull())
    return pairs.select(*measured.columns, *_kill_columns(tol_mm))


def kill_summary(measured: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float,
                 camera_mm: float = 300.0, key: str = "report_id", label: str | None = None) -> DataFrame:
    """Per report: prefiltered (the listed kills) and exact counts of all kills.

    Far kills are counted by complement: the catalogue less the pairs inside the tolerance less the near
    kills, all from one band join and one grouping by report. Counts are null where nothing was measured.
    """
    near = _near_pairs(measured, articles, tol_mm, area_tol_pct, camera_mm)
    inside = F.col("geo_err") <= tol_mm
    item = F.struct(*_kill_columns(tol_mm))
    found = near.groupBy(key).agg(
        F.collect_list(F.when(F.col("reason").isNotNull(), item)).alias("_near"), F.count_if(inside).alias("_inside"),
        F.count_if(F.col("reason") == "area").alias("_area"), F.count_if(~inside).alias("_edge"))
    total = catalogue(articles).agg(F.count(F.lit(1)).alias("_total"))
    keep = [key, "circle_diameter_mm", *([label] if label else [])]
    out = measured.select(*keep).join(found, key, "left").crossJoin(F.broadcast(total))        # a single row
    empty = F.array().cast(near.select(F.array(item)).schema[0].dataType)
    out = out.withColumn("prefiltered", F.coalesce("_near", empty))
    if label:
        own = true_kills(measured, articles, tol_mm, area_tol_pct, camera_mm, label)
        far = own.where((F.col("reason") == "diameter") & (F.col("over_tolerance_mm") > tol_mm))
        far = far.groupBy(key).agg(F.collect_list(F.struct(*[F.col(c) for c in _KILL])).alias("_own"))
        out = out.join(far, key, "left").withColumn("prefiltered", F.concat("prefiltered", F.coalesce("_own", empty)))
    measured_at_all = F.col("circle_diameter_mm").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    diameter = F.when(measured_at_all, F.col("_total") - zero("_inside"))
    area, edge = F.when(measured_at_all, zero("_area")), F.when(measured_at_all, zero("_edge"))
    return out.select(key, F.sort_array("prefiltered").alias("prefiltered"), (diameter + area).alias("n_kills"),
                      diameter.alias("n_kills_diameter"), area.alias("n_kills_area"), (diameter - edge).alias("n_kills_far"))


def with_own_kill(measured: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float, camera_mm: float,
                  label: str, out: str) -> DataFrame:
    """``measured`` with the far kills of its own article as a list ``out`` (empty for nearly all; one for each catalogue
    row of that number). The only exchange of whole measurements besides that by bin."""
    cat = catalogue(articles)
    row = F.struct(*[F.col(c) for c in _KILL_SOURCE])
    own = cat.groupBy(F.col("article_number").alias("_own_number")).agg(F.collect_list(row).alias("_own_rows"))
    found = measured.join(own.hint("merge"), measured[label] == F.col("_own_number"), "left")
    far = F.filter(_kills_of(F.coalesce("_own_rows", F.array().cast(own.schema["_own_rows"].dataType)), tol_mm, area_tol_pct, camera_mm),
                   lambda k: (k["reason"] == "diameter") & (k["over_tolerance_mm"] > tol_mm))
    return found.withColumn(out, F.when(F.col("circle_diameter_mm").isNotNull(), far)).drop("_own_number", "_own_rows")


def _kills_of(rows: Column, tol_mm: float, area_tol_pct: float, camera_mm: float) -> Column:
    """The catalogue rows of a list (``_KILL_SOURCE``) as kills of the measurement; the reason is null for those not killed."""
    def one(a: Column, err: Column) -> Column:
        over = sizes.rounded(err - tol_mm, 2)
        rel = sizes.area_relative_error(F.col("area_mm2"), a["height_mm"], a["nominal_mm"], camera_mm)
        by_area = sizes.truthy(a["diameter_mm"]) & (rel > 2.0 * area_tol_pct / 100.0)
        reason = F.when(err > tol_mm, "diameter").when(by_area, "area")
        return F.struct(a["article_number"].alias("article_number"), a["name"].alias("name"), reason.alias("reason"),
                        sizes.rounded(err, 2).alias("geometry_error_mm"), F.lit(round(tol_mm, 2)).alias("tolerance_mm"),
                        over.alias("over_tolerance_mm"), F.when(reason == "area", F.round(rel * 100.0, 1)).alias("area_error_pct"),
                        (err <= tol_mm).alias("inside"))

    def error(a: Column) -> Column:
        return F.abs(sizes.height_corrected(F.col("circle_diameter_mm"), a["height_mm"], camera_mm) - a["nominal_mm"])

    pairs = F.transform(rows, lambda a: F.struct(a.alias("a"), error(a).alias("e")))
    return F.transform(pairs, lambda p: one(p["a"], p["e"]))


def kills_in_bins(reports: DataFrame, articles: DataFrame, tol_mm: float, area_tol_pct: float, camera_mm: float,
                  bin_as: str, own: str | None = None) -> DataFrame:
    """``kill_summary`` as columns of reports that lie by bin (of ``bin_width``), one report a row, which are not exchanged.

    A bin has one list of the articles that are near anything in it; each report takes its kills from that list,
    which is of the order of the lists of kills themselves. ``own``: far kills of the own article, from ``with_own_kill``.
    """
    reach = 2.0 * tol_mm + 0.01                         # over_tolerance_mm is rounded to 2 digits
    wide = _with_band(catalogue(articles), reach, camera_mm, "_lo", "_hi")
    wide = wide.select(*_KILL_SOURCE, "_lo", "_hi", interval_bins(F.col("_lo"), F.col("_hi"), bin_width(tol_mm)).alias("_bin_of_list"))
    lists = wide.groupBy("_bin_of_list").agg(F.collect_list(F.struct(*_KILL_SOURCE, "_lo", "_hi")).alias("_list"))
    total = catalogue(articles).agg(F.count(F.lit(1)).alias("_total"))
    out = reports.join(lists.hint("merge"), F.col(bin_as) == F.col("_bin_of_list"), "left")
    d = F.col("circle_diameter_mm")
    empty = F.array().cast(lists.schema["_list"].dataType)
    near = F.filter(F.coalesce("_list", empty), lambda a: (d >= a["_lo"]) & (d <= a["_hi"]))
    out = out.withColumn("_near", _kills_of(near, tol_mm, area_tol_pct, camera_mm)).drop("_list", "_bin_of_list")
    out = out.withColumn("_near", F.filter("_near", lambda k: k["inside"] | (k["over_tolerance_mm"] <= tol_mm)))
    out = out.crossJoin(F.broadcast(total))             # a single row
    inside = F.size(F.filter("_near", lambda k: k["inside"])).cast("long")
    area = F.size(F.filter("_near", lambda k: k["reason"] == "area")).cast("long")
    n, d_kills = F.size("_near").cast("long"), F.col("_total") - inside
    killed = F.filter("_near", lambda k: k["reason"].isNotNull())
    if own:
        killed = F.concat(killed, F.coalesce(F.col(own), F.array().cast(out.schema["_near"].dataType)))
    listed = F.sort_array(F.transform(killed, lambda k: F.struct(*[k[c].alias(c) for c in _KILL])))
    known = lambda c: F.when(d.isNotNull(), c)
    return out.withColumns({"prefiltered": listed, "n_kills": known(d_kills + area), "n_kills_diameter": known(d_kills),
                            "n_kills_area": known(area), "n_kills_far": known(d_kills - (n - inside))}).drop("_near", "_total")


_KILL_SOURCE = ("article_number", "name", "diameter_mm", "height_mm", "nominal_mm")
_KILL = ("article_number", "name", "reason", "geometry_error_mm", "tolerance_mm", "over_tolerance_mm", "area_error_pct")


def interval_overlap_join(left: DataFrame, right: DataFrame, lo: str, hi: str,
                          width: float) -> DataFrame:
    """Pairs whose [lo, hi] intervals overlap, each pair once.

    Both sides are copied into the bins they touch; a pair is kept only in the bin
    where the later interval starts, so no distinct is needed. Right columns that
    clash must be renamed by the caller (``lo``/``hi`` get the suffix ``_r``).
    """
    a = left.withColumn("_bin", interval_bins(F.col(lo), F.col(hi), width))
    b = (right.withColumnRenamed(lo, f"{lo}_r").withColumnRenamed(hi, f"{hi}_r"))
    b = b.withColumn("_bin", interval_bins(F.col(f"{lo}_r"), F.col(f"{hi}_r"), width))
    start = F.floor(F.greatest(F.col(lo), F.col(f"{lo}_r")) / width)
    return (a.join(b, "_bin").where((F.col("_bin") == start) & (F.col(lo) <= F.col(f"{hi}_r"))
                                    & (F.col(f"{lo}_r") <= F.col(hi))).drop("_bin"))
