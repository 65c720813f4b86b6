"""Fixed values of the quality-control rules, in one place."""

EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_REFERENCE_KM = 6371.0088

TEMPERATURE_RANGE = (-45.0, 50.0)
PRESSURE_RANGE = (920.0, 1065.0)
HUMIDITY_RANGE = (0.0, 100.0)
GALE_KMH, STORM_KMH = 75.0, 100.0
DEW_MARGIN = 0.5
HYPSOMETRIC_TOLERANCE_PCT = 8.0

MAX_STEP = {"temperature": 3.5, "pressure": 2.5, "humidity": 15.0}
STEP_SECONDS = 600.0
FROZEN_READINGS, FROZEN_EPSILON, FROZEN_MINUTES = 12, 1e-6, 60.0
FROZEN_HUMIDITY_EXEMPT = 97.0
Z_LIMIT = 3.5
MAD_FLOOR = {"temperature": 0.2, "pressure": 0.15, "humidity": 1.0}
WINDOW = 72
MIN_HISTORY = 24

RADIUS_KM, NEIGHBOURS, TIME_TOLERANCE_MIN = 250.0, 8, 30.0
SPATIAL_Z = 3.0
SPATIAL_STD_FLOOR = {"temperature": 1.0, "pressure": 0.8, "humidity": 4.0}
CLUSTER_KM = 125.0

CUSUM_H, CUSUM_K, CUSUM_LEAK = 5.0, 0.5, 0.98
EMA_BETA, STEP_CLIP = 0.97, 6.0
DRIFT_MULTIPLIERS = {"temperature": (2.0, 2.0), "pressure": (2.5, 2.5), "humidity": (5.0, 4.0)}
DRIFT_TOLERANCE = {"temperature": 1.0, "humidity": 3.0, "pressure": 0.5}

FUSION_WEIGHTS = {"physics": 0.35, "temporal": 0.25, "multivariate": 0.20, "spatial": 0.15}
FUSION_ACUTE = {"physics": 0.75, "temporal": 0.70, "multivariate": 0.80, "spatial": 0.70}
FUSION_THRESHOLD = 0.55

CITY_MATCH_KM = 75.0
MAD_TO_SIGMA = 1.4826
LATE_HOURS, FUTURE_MINUTES = 6, 5
MAX_MAGNITUDE = 1e5
