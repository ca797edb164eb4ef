"""Fixed values. They must equal the published ones for results to match."""

# --- fixed values: feature names, order and channels -----------------------
SCALAR_FEATURES = ("diameter_mm", "circularity", "solidity")
PROTO_FEATURES = ("delta_e_center", "delta_e_rim", "hist_center", "hist_rim", "hu_log")
ALL_FEATURES = SCALAR_FEATURES + PROTO_FEATURES
COLOR_FEATURES = ("delta_e_center", "delta_e_rim", "hist_center", "hist_rim")
HIST_FEATURES = ("hist_center", "hist_rim")
CHANNELS = {
    "geometry": ("diameter_mm",),
    "color": COLOR_FEATURES,
    "shape": ("circularity", "solidity", "hu_log"),
}
# Feature -> floor it shares with its sibling zone (others use their own name).
FLOOR_KEYS = {
    "diameter_mm": "diameter_mm",
    "circularity": "circularity",
    "solidity": "solidity",
    "delta_e_center": "delta_e",
    "delta_e_rim": "delta_e",
    "hist_center": "hist_bhattacharyya",
    "hist_rim": "hist_bhattacharyya",
    "hu_log": "hu_log",
}

# --- fixed values: measured noise floors and feature weights ----------------
SIGMA_FLOORS = {
    "diameter_mm": 1.63,
    "circularity": 0.0063,
    "solidity": 0.0043,
    "delta_e": 3.40,
    "hist_bhattacharyya": 0.146,
    "hu_log": 0.38,
}
FEATURE_WEIGHTS = {
    "diameter_mm": 0.50,
    "circularity": 0.07,
    "solidity": 0.06,
    "delta_e_center": 0.08,
    "delta_e_rim": 0.08,
    "hist_center": 0.07,
    "hist_rim": 0.07,
    "hu_log": 0.07,
}
# Weight schemes compared by the weight study.
WEIGHT_SCHEMES = {
    "S0": dict(FEATURE_WEIGHTS),
    "S1": {f: 0.125 for f in ALL_FEATURES},
    "S2": {"diameter_mm": 0.25, "circularity": 0.15, "solidity": 0.15,
           "delta_e_center": 0.075, "delta_e_rim": 0.075,
           "hist_center": 0.075, "hist_rim": 0.075, "hu_log": 0.15},
    "S3": {"diameter_mm": 0.50, "circularity": 0.12, "solidity": 0.12,
           "delta_e_center": 0.0375, "delta_e_rim": 0.0375,
           "hist_center": 0.0375, "hist_rim": 0.0375, "hu_log": 0.11},
    "S4": {"diameter_mm": 0.70, "circularity": 0.05, "solidity": 0.05,
           "delta_e_center": 0.0375, "delta_e_rim": 0.0375,
           "hist_center": 0.0375, "hist_rim": 0.0375, "hu_log": 0.05},
}
WEIGHT_ALPHAS = (0.0, 2.0, 8.0, 32.0)

# --- fixed values: comparison limits (pass <= quantum < drift <= soft) ------
QUANTUM = {
    "equiv_diameter_mm": 0.005, "circle_diameter_mm": 0.005, "perimeter_mm": 0.005,
    "mean_saturation": 0.005, "area_mm2": 0.05, "circularity": 5e-5,
    "aspect_ratio": 5e-5, "solidity": 5e-5, "hu_moments": 5e-5, "mean_hsv": 0.005,
    "hue_hist": 5e-7, "hs_hist_center": 5e-7, "hs_hist_rim": 5e-7,
    "lab_center": 0.0005, "lab_rim": 0.0005, "seg_area_px": 0.5,
    "centroid_x": 0.05, "centroid_y": 0.05, "llr_margin": 5e-5, "max_z_winner": 5e-5,
}
SOFT = {
    "equiv_diameter_mm": 0.2, "circle_diameter_mm": 0.2, "perimeter_mm": 0.5,
    "mean_saturation": 0.5, "area_mm2": 20.0, "circularity": 0.01,
    "aspect_ratio": 0.01, "solidity": 0.01, "hu_moments": 0.01, "mean_hsv": 0.5,
    "hue_hist": 0.001, "hs_hist_center": 0.001, "hs_hist_rim": 0.001,
    "lab_center": 0.05, "lab_rim": 0.05, "seg_area_px": 200.0,
    "centroid_x": 2.0, "centroid_y": 2.0, "llr_margin": 0.05, "max_z_winner": 0.05,
}
QUANTUM_DEFAULT = 5e-5
SOFT_DEFAULT = 0.01
TIER1_SCALARS = ("equiv_diameter_mm", "circle_diameter_mm", "area_mm2", "perimeter_mm",
                 "circularity", "aspect_ratio", "solidity", "mean_saturation")
TIER1_VECTORS = ("mean_hsv", "hue_hist", "hu_moments", "lab_center", "lab_rim",
                 "hs_hist_center", "hs_hist_rim")

# --- fixed values: words and limits used in results -------------------------
NO_MATCH = "NO_MATCH"
ACCEPT, AMBIGUOUS, REJECT = "accept", "ambiguous", "reject"
DECISIONS = (ACCEPT, AMBIGUOUS, REJECT)
PASS, DRIFT, FAIL = "pass", "drift", "fail"
ERROR_RATES = ("false_accept_rate",)
INFO_ONLY = ("accuracy_top1_verdict",)
QUOTA_SEMANTICS = "top1-roh-gegen-label/2026-07-23"
UNIFORM_MIN_SHARE = 0.5
UNIFORM_MAX_SPREAD = 0.25
MIN_FLOOR_N = 10
OUTLIER_Z = 3.0
TAIL_Z = 3.0
MAD_SCALE = 1.4826
ARTICLE_COLUMNS = ("article_number", "name", "category", "diameter_mm", "width_mm",
                   "depth_mm", "height_mm", "color_desc", "notes")
GEOMETRY_COLUMNS = ("diameter_mm", "width_mm", "depth_mm", "height_mm")
# Hue ladder: upper bound of each band on the 0..180 hue circle.
HUE_BOUNDS = ((10, "rot"), (25, "orange"), (35, "gelb"), (85, "grün"), (100, "türkis"),
              (130, "blau"), (150, "violett"), (170, "pink"))
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"),
           ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))
