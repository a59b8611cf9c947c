"""Thresholds, rule tables, name lists and dates the results depend on."""

from datetime import date

# ---- Fixed values: catalogue ------------------------------------------------
LATITUDE_NAMES = ("latitude", "lat", "y", "coord_y")
LONGITUDE_NAMES = ("longitude", "lon", "long", "x", "coord_x")
DATE_NAMES = (
    "flood_start_date", "start_date", "event_start_date", "flood_start",
    "start", "date", "event_date",
)
DATE_PREFERRED = ("flood_start_date", "start_date")
DATE_KEYWORDS = ("date", "start", "begin")
DATE_VALID_FRACTION = 0.5

# ---- Fixed values: calendar limits -------------------------------------------
BAD_PERIODS = (
    (date(2025, 1, 1), date(2025, 1, 4)),
    (date(2024, 11, 27), date(2024, 11, 28)),
    (date(2024, 3, 19), date(2024, 3, 21)),
)
MODEL_TRANSITION = date(2021, 5, 26)
FORECAST_START = date(2019, 11, 5)
RAIN_START = date(2000, 6, 1)
RAIN_EARLY_START = date(2019, 6, 1)
MOISTURE_V008_START = date(2015, 3, 31)
EARLIEST_NEGATIVE = date(1980, 1, 1)

# ---- Fixed values: model release by date --------------------------------------
RELEASES = {
    "before": ("3.1", "control_reforecast", "htessel_lisflood"),
    "after": ("4.0", "ensemble_perturbed_reforecasts", "lisflood"),
}

# ---- Fixed values: flood-type vocabularies -------------------------------------
STRATEGY_NEAREST_TERMS = ("flash", "urban", "pluvial", "wadi", "coastal")
STRATEGY_MEAN_TERMS = (
    "riverine", "river", "snowmelt", "el nino", "elnino", "storm surge", "storm_surge",
)
STRATEGY_MIXED_WITH = ("flash", "urban", "pluvial", "landslide", "dam")
BUFFER_SMALL_TERMS = ("flash", "urban", "local")
BUFFER_LARGE_TERMS = ("riverine", "river", "coastal")
CHECK_FLASH_TERMS = ("flash", "urban", "pluvial")
CHECK_RIVER_TERMS = ("riverine", "river")
CHECK_DRY_TERMS = ("snowmelt", "coastal", "storm surge", "dam", "levee")

# ---- Fixed values: distances (metres, kilometres) -------------------------------
FEATURE_BUFFER_M = 25_000
WATERSHED_BUFFER_M = 50_000
FORECAST_BUFFER_M = 25_000
FORECAST_RIVER_BUFFER_M = 20_000
NEGATIVE_EXCLUSION_M = 75_000
METRES_PER_DEGREE_LAT = 110_540.0
METRES_PER_DEGREE_LON = 111_320.0
EARTH_RADIUS_KM = 6371.0088
MERCATOR_RADIUS_M = 6_378_137.0

# ---- Fixed values: sampling -------------------------------------------------------
NEGATIVE_OFFSETS = (1, 3, 7, 15, 30)
SOFT_LABELS = {1: 0.9, 3: 0.3}
DURATION_STEPS = ((2, 0), (4, 1), (8, 2), (12, 3))  # (longest duration, extra days); longer: 4
DURATION_EXTRA_MAX = 4

# ---- Fixed values: sparse-column clean-up -------------------------------------------
SPARSE_FRACTION = 0.95
NEAR_ZERO = 1e-12
SPARSE_PROTECTED = (
    "latitude", "longitude", "flood_start_date", "target", "year", "flood_type",
    "confidence_score", "data_quality_issues", "data_quality_warnings",
    "data_quality_valid", "gee_river_name", "river_name", "river_name_source",
)
SPARSE_PROTECTED_SUFFIX = "_reduction_method"

# ---- Fixed values: columns that leak the outcome ----------------------------------------
LEAKY_COLUMNS = (
    "confidence_score", "longitude", "latitude", "relative_increase",
    "glofas_rowe_relative_increase", "glofas_swir_relative_increase",
    "glofas_dis24_relative_increase", "glofas_rowe_ratio_on_event_to_mean",
    "glofas_swir_ratio_on_event_to_mean", "glofas_dis24_ratio_on_event_to_mean",
    "glofas_rowe_z_on_event", "glofas_swir_z_on_event", "glofas_dis24_z_on_event",
    "data_quality_issues", "data_quality_warnings", "data_quality_valid",
    "processing_date", "processing_version", "aoi_buffer_meters",
)
LEAKY_SUBSTRING = "event_day"

# ---- Fixed values: range rules by name substring (low, high) ------------------------------
RANGE_RULES = {
    "imerg": (0.0, 10000.0),
    "gee_elevation_mean": (-500.0, 9000.0),
    "gee_slope_mean": (0.0, 90.0),
    "gee_aspect_mean": (0.0, 360.0),
    "gee_gsw_occurrence_mean": (0.0, 100.0),
    "month_sin": (-1.0, 1.0),
    "month_cos": (-1.0, 1.0),
    "doy_sin": (-1.0, 1.0),
    "doy_cos": (-1.0, 1.0),
    "gee_distance_to_river_min_m": (0.0, 1e6),
    "gee_merit_upa_mean": (0.0, 1e10),
    "gee_gfs_temp2m_celsius": (-50.0, 60.0),
    "gee_gfs_relative_humidity_pct": (0.0, 100.0),
    "gee_gfs_wind_speed_ms": (0.0, 100.0),
    "gee_gfs_surface_pressure_pa": (3e4, 1.1e5),
    "gee_gfs_precipitable_water_kg_m2": (0.0, 200.0),
}

# ---- Fixed values: repair rules, feature -> (kind, low, high) ---------------------------------
REPAIR_RULES = {
    "month_sin": ("bounded", -1.0, 1.0),
    "month_cos": ("bounded", -1.0, 1.0),
    "doy_sin": ("bounded", -1.0, 1.0),
    "doy_cos": ("bounded", -1.0, 1.0),
    "gee_ndvi_mean_30d": ("bounded", -1.0, 1.0),
    "gee_ndbi_mean_30d": ("bounded", -1.0, 1.0),
    "gee_ndwi_mean_30d": ("bounded", -1.0, 1.0),
    "gee_smap_surface_soil_moisture": ("fraction", 0.0, 1.0),
    "gee_smap_subsurface_soil_moisture": ("fraction", 0.0, 1.0),
    "gee_impervious_fraction": ("fraction", 0.0, 1.0),
    "land_fraction_saturated": ("fraction", 0.0, 1.0),
    "land_fraction_unsaturated": ("fraction", 0.0, 1.0),
    "land_fraction_wilting": ("fraction", 0.0, 1.0),
    "land_fraction_snow_covered": ("fraction", 0.0, 1.0),
    "gee_gfs_relative_humidity_pct": ("percentage", 0.0, 100.0),
    "gee_gsw_occurrence_mean": ("percentage", 0.0, 100.0),
    "gee_aspect_mean": ("angle_deg", 0.0, 360.0),
    "gee_slope_mean": ("slope_deg", 0.0, 90.0),
    "gee_gfs_temp2m_celsius": ("temperature_c", -90.0, 60.0),
    "surface_temp": ("temperature_k", 180.0, 350.0),
    "gee_imerg_sum_24h_mm": ("non_negative", 0.0, None),
    "gee_imerg_max_1h_intensity_mm": ("non_negative", 0.0, None),
    "gee_imerg_max_3h_intensity_mm": ("non_negative", 0.0, None),
    "gee_imerg_max_6h_intensity_mm": ("non_negative", 0.0, None),
    "gee_imerg_sum_3d_before_mm": ("non_negative", 0.0, None),
    "gee_imerg_sum_7d_before_mm": ("non_negative", 0.0, None),
    "gee_imerg_max_daily_7d_mm": ("non_negative", 0.0, None),
    "imerg_max_1h_intensity_mm": ("non_negative", 0.0, None),
    "imerg_mean_1h_intensity_mm": ("non_negative", 0.0, None),
    "gee_imerg_intensity_3d_mm_per_day": ("non_negative", 0.0, None),
    "gee_imerg_intensity_7d_mm_per_day": ("non_negative", 0.0, None),
    "gee_distance_to_river_min_m": ("non_negative", 0.0, None),
    "gee_elevation_mean": ("allow_negative", -500.0, None),
    "gee_merit_upa_mean": ("unbounded_positive", 0.0, None),
    "gee_gfs_surface_pressure_pa": ("pressure_pa", 30000.0, 110000.0),
    "gee_gfs_precipitable_water_kg_m2": ("non_negative", 0.0, None),
    "gee_gfs_wind_speed_ms": ("non_negative", 0.0, None),
    "gee_flashiness_index": ("non_negative", 0.0, None),
    "gee_saturation_proxy": ("non_negative", 0.0, None),
    "gee_runoff_potential": ("non_negative", 0.0, None),
    "gee_api_weighted_mm": ("non_negative", 0.0, None),
    "gee_flashiness_index_7d": ("non_negative", 0.0, None),
    "gee_precip_x_slope": ("non_negative", 0.0, None),
    "gee_antecedent_moisture_proxy": ("non_negative", 0.0, None),
    "gee_moisture_flux": ("allow_any", None, None),
    "gee_twi": ("allow_any", None, None),
    "gee_smap_soil_moisture_anomaly": ("allow_any", None, None),
}
REPAIR_ZERO_TOLERANCE = 1e-10
REPAIR_CLAMP_TOLERANCE = 0.01

# ---- Fixed values: quality checks ---------------------------------------------------------------
CHECK_MIN_FLASH_MM_H = 10.0
CHECK_MIN_RIVER_7D_MM = 25.0
CHECK_MOISTURE_RANGE = (0.0, 1.0)
CHECK_TEMPERATURE_RANGE = (-50.0, 60.0)
CHECK_INTENSITY_COLUMNS = (
    "gee_imerg_max_1h_intensity_mm", "gee_imerg_max_3h_intensity_mm",
    "gee_imerg_max_6h_intensity_mm",
)

# ---- Fixed values: lineage stamps ------------------------------------------------------------------
PROCESSING_VERSION = "v3.0_imerg_smap_gfs"
PIPELINE_VERSION = "v3.0_temporal_fix"
DATA_SOURCES = "IMERG_Early|IMERG_Late|SMAP|GFS|Static"
MAX_LATENCY_HOURS = 14

# ---- Fixed values: land-cover classes ---------------------------------------------------------------
LAND_COVER_NAMES = {
    10: "Trees", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up",
    60: "Bare/Sparse vegetation", 70: "Snow/Ice", 80: "Water", 90: "Wetland",
    95: "Mangroves", 100: "Moss/Lichen",
}
URBAN_CLASS = 13

# ---- Fixed values: feature roles ------------------------------------------------------------------------
FORECAST_FEATURES = (
    "glofas_forecast_control", "glofas_forecast_mean", "glofas_forecast_median",
    "glofas_forecast_std_dev", "glofas_forecast_10th_percentile",
    "glofas_forecast_90th_percentile",
)
STATIC_FEATURES = (
    "gee_api_weighted_mm", "gee_aspect_mean", "gee_elevation_mean",
    "gee_flashiness_index", "gee_gsw_occurrence_mean",
    "gee_imerg_intensity_7d_mm_per_day", "gee_imerg_max_daily_7d_mm",
    "gee_imerg_sum_7d_before_mm", "gee_merit_upa_mean", "gee_ndbi_mean_30d",
    "gee_ndvi_mean_30d", "gee_ndwi_mean_30d", "gee_saturation_proxy",
    "gee_slope_mean", "gee_smap_subsurface_soil_moisture",
    "gee_smap_surface_soil_moisture", "gee_twi",
)
DYNAMIC_FEATURES = (
    "gee_antecedent_moisture_proxy", "gee_flashiness_index_7d",
    "gee_imerg_intensity_3d_mm_per_day", "gee_imerg_max_1h_intensity_mm",
    "gee_imerg_max_3h_intensity_mm", "gee_imerg_max_6h_intensity_mm",
    "gee_imerg_sum_24h_mm", "gee_imerg_sum_3d_before_mm", "gee_precip_x_slope",
    "gee_runoff_potential", "gee_smap_soil_moisture_anomaly",
    "glofas_forecast_10th_percentile", "glofas_forecast_90th_percentile", "glofas_forecast_control",
    "glofas_forecast_mean", "glofas_forecast_median", "glofas_forecast_std_dev",
    "imerg_max_1h_intensity_mm", "imerg_mean_1h_intensity_mm",
)
# the order of a role is part of the model's input, so it is stated and not derived
FULL_FEATURES = (
    "imerg_max_1h_intensity_mm", "imerg_mean_1h_intensity_mm", "gee_imerg_sum_24h_mm", "gee_imerg_max_1h_intensity_mm",
    "gee_imerg_max_3h_intensity_mm", "gee_imerg_max_6h_intensity_mm", "gee_imerg_sum_3d_before_mm", "gee_imerg_sum_7d_before_mm",
    "gee_imerg_max_daily_7d_mm", "gee_imerg_intensity_3d_mm_per_day", "gee_imerg_intensity_7d_mm_per_day",
    "gee_smap_surface_soil_moisture", "gee_smap_subsurface_soil_moisture", "gee_smap_soil_moisture_anomaly",
    "gee_antecedent_moisture_proxy", "gee_flashiness_index_7d", "gee_api_weighted_mm", "gee_flashiness_index", "gee_saturation_proxy",
    "gee_runoff_potential", "gee_aspect_mean", "gee_elevation_mean", "gee_slope_mean", "gee_gsw_occurrence_mean", "gee_merit_upa_mean",
    "gee_twi", "gee_ndvi_mean_30d", "gee_ndbi_mean_30d", "gee_ndwi_mean_30d", "gee_precip_x_slope",
    "glofas_forecast_control", "glofas_forecast_mean", "glofas_forecast_median", "glofas_forecast_std_dev",
    "glofas_forecast_10th_percentile", "glofas_forecast_90th_percentile",
)
FEATURE_ROLES = {"static": STATIC_FEATURES, "dynamic": DYNAMIC_FEATURES, "full": FULL_FEATURES}
STATIC_BASELINE = (
    "gee_aspect_mean", "gee_elevation_mean", "gee_slope_mean",
    "gee_gsw_occurrence_mean", "gee_merit_upa_mean", "gee_twi",
    "gee_ndvi_mean_30d", "gee_ndbi_mean_30d", "gee_ndwi_mean_30d",
    "gee_runoff_potential", "gee_saturation_proxy", "antecedent_twi",
    "elevation_precip_ratio",
)
STATIC_FORCED = (
    "gee_elevation_mean", "gee_slope_mean", "gee_aspect_mean",
    "gee_merit_upa_mean", "gee_gsw_occurrence_mean", "elevation_precip_ratio",
)
ZERO_IS_VALID = (
    "target", "target_future", "month_sin", "month_cos", "doy1_sin", "doy1_cos",
    "imerg_max_1h_intensity_mm", "imerg_mean_1h_intensity_mm",
    "gee_imerg_sum_24h_mm", "gee_imerg_max_1h_intensity_mm",
    "gee_imerg_max_3h_intensity_mm", "gee_imerg_max_6h_intensity_mm",
    "gee_imerg_sum_3d_before_mm", "gee_imerg_sum_7d_before_mm",
    "gee_imerg_max_daily_7d_mm", "gee_imerg_intensity_3d_mm_per_day",
    "gee_imerg_intensity_7d_mm_per_day", "gee_slope_mean", "gee_aspect_mean",
    "gee_elevation_mean", "gee_merit_upa_mean", "gee_precip_x_slope",
    "precip_soil_interaction", "intensity_slope", "antecedent_twi",
    "elevation_precip_ratio",
) + FORECAST_FEATURES

# ---- Fixed values: training and evaluation -------------------------------------------------------------------
CV_LOW_QUANTILE = 0.35
CV_HIGH_QUANTILE = 0.70
PROBABILITY_EPS = 1e-6
FBETA_TENTHS = tuple(range(10, 31))  # beta 1.0 .. 3.0
THRESHOLD_PERCENTS = tuple(range(10, 91))  # 0.10 .. 0.90
WEIGHT_TWENTIETHS = tuple(range(1, 20))  # 0.05 .. 0.95
WEIGHT_MIN = 0.05
WEIGHT_MAX = 0.90
HOLDOUT_FRACTION = 0.0057
VALIDATION_FRACTION = 0.20
CALIBRATION_FOLDS = 5
SEED = 42

# ---- Fixed values: risk, priority and actions ---------------------------------------------------------------------
RISK_LEVELS = ((0.8, "very-high-risk"), (0.6, "high-risk"), (0.4, "moderate-risk"))
RISK_LEVEL_DEFAULT = "low-risk"
PRIORITY_WIDTH_DEFAULTS = (0.1, 0.2)
ACTION_RULES = (
    ("Immediate mitigation", 0.8, 0.2),
    ("Rapid verification", 0.6, 0.4),
    ("Investigate (uncertain)", 0.4, 0.7),
)
ZONE_QUANTILES = (0.33, 0.66)
MIN_COVERAGE_RATIO = 0.8
SEVERITY_CUT = 1.5

# ---- Fixed values: local expert -----------------------------------------------------------------------------------------
LOCAL_RADIUS_KM = 500.0
LOCAL_MIN_SAMPLES = 200
LOCAL_RECENT_YEARS = 10
LOCAL_SIGMA_KM = 250.0
LOCAL_EPS = 1e-6
LOCAL_DENSITY_HALF = 1000.0
LOCAL_CONFIDENT_SAMPLES = 2000.0

# ---- Fixed values: spectral bands and terrain -------------------------------------------------------------------------------
NDVI_SCALE = 0.0001
SURFACE_REFLECTANCE_SCALE = 0.0000275
SURFACE_REFLECTANCE_OFFSET = -0.2
INDEX_EPS = 1e-6
CLEAR_SCENE_CLASSES = (4, 5, 6)
MAX_CLOUD_PERCENT = 20
CHANNEL_FLOW_THRESHOLD = 500.0
CURVATURE_KERNEL = ((0.0, 0.5, 0.0), (0.5, -2.0, 0.5), (0.0, 0.5, 0.0))
LAPLACIAN_KERNEL = ((-1.0, -1.0, -1.0), (-1.0, 8.0, -1.0), (-1.0, -1.0, -1.0))
DISCHARGE_VARIABLES = ("dis24", "dis", "river_discharge", "streamflow", "sf", "Q", "Qw")
