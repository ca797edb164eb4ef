"""Explicit schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

D, S, L, B = T.DoubleType(), T.StringType(), T.LongType(), T.BooleanType()
VEC = T.ArrayType(D)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ARTICLE = _struct(article_number=S, name=S, category=S, diameter_mm=D, width_mm=D,
                  depth_mm=D, height_mm=D, color_desc=S, notes=S)

MEASURED = _struct(
    equiv_diameter_mm=D, circle_diameter_mm=D, area_mm2=D, perimeter_mm=D,
    circularity=D, aspect_ratio=D, lat_p98_mm=D, mean_hsv=VEC, hue_hist=VEC,
    mean_saturation=D, hu_moments=VEC, solidity=D, lab_center=VEC, lab_rim=VEC,
    hs_hist_center=VEC, hs_hist_rim=VEC)

REFERENCE = T.StructType(
    [T.StructField("article_number", S), T.StructField("image_path", S)]
    + MEASURED.fields + [T.StructField("created", T.TimestampType())])

FEATURE_SCORE = _struct(feature=S, measured=D, reference=D, distance=D, sigma_enroll=D,
                        sigma_eff=D, z=D, log_contrib=D, w_eff=D, weighted=D)

CANDIDATE = _struct(
    article_number=S, name=S, nominal_size_mm=D, height_mm=D, corrected_diameter_mm=D,
    geometry_error_mm=D, has_references=B, n_shots=L, features=T.ArrayType(FEATURE_SCORE),
    log_score=D, posterior=D, max_abs_z=D, margin_to_next=D)

KILL = _struct(article_number=S, name=S, reason=S, geometry_error_mm=D, tolerance_mm=D,
               over_tolerance_mm=D, area_error_pct=D)

STATE = _struct(calibration_sha256=S, background_sha256=S, db_zustand_sha256=S,
                features_cfg_sha256=S, matching_cfg_sha256=S, fingerprint=S,
                mm_per_px=D, camera_height_mm=D, system=S, plattform=S, python=S,
                opencv=S, numpy=S)

THRESHOLDS = _struct(max_z_accept=D, min_llr_margin=D, softmax_temperature=D, top_k=L)

REPORT = _struct(
    decision=S, message=S, candidates=T.ArrayType(CANDIDATE),
    feature_names=T.ArrayType(S), fisher_d=T.MapType(S, D), fisher_d_norm=T.MapType(S, D),
    w_global=T.MapType(S, D), w_eff=T.MapType(S, D), alpha=D, llr_margin=D,
    max_z_winner=D, gate_passed=B, thresholds=THRESHOLDS, measured=MEASURED,
    contour=T.ArrayType(T.ArrayType(D)), touches_border=B, timestamp=S, image_path=S,
    label=S, verdict=S, report_path=S, centroid_px=VEC, image_size=VEC,
    prefiltered=T.ArrayType(KILL), zustand=STATE)

EVENTS = T.StructType([
    T.StructField("event_id", L), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", L), T.StructField("event_type", S),
    T.StructField("value", D), T.StructField("props", S)])
