"""Fixed values the results depend on."""

# --- fixed values: metres in one degree of latitude, and the guard against a zero divisor at the poles
METERS_PER_DEGREE = 111320.0
POLE_EPSILON = 1e-9

# --- fixed values: grid spacing as a multiple of the search radius
STEP_MULTIPLIER = 1.2

# --- fixed values: plateau rule (window of points, mean below, hits in a row, points before it counts)
PLATEAU_WINDOW = 50
PLATEAU_MIN_NEW_AVG = 0.5
PLATEAU_STABLE_POINTS = 5
PLATEAU_WARMUP_POINTS = 80

# --- fixed values: rows wanted per city by the capped collector, result pages per search point
TARGET_PER_CITY = 1000
MAX_PAGES = 3

# --- fixed values: crawl boxes (city, lat_min, lat_max, lng_min, lng_max, radius in metres)
PLATEAU_REGIONS = [
    ("San Francisco", 37.66, 37.84, -122.55, -122.33, 1200),
    ("Los Angeles", 33.70, 34.35, -118.70, -118.10, 3000),
    ("Chicago", 41.65, 42.10, -88.05, -87.45, 1600),
    ("New York", 40.50, 40.95, -74.30, -73.65, 1400),
]
TARGET_REGIONS = [
    ("San Francisco", 37.70, 37.82, -122.52, -122.35, 1200),
    ("Los Angeles", 33.90, 34.12, -118.52, -118.15, 1800),
    ("Chicago", 41.78, 42.05, -87.85, -87.55, 1600),
    ("New York", 40.65, 40.85, -74.05, -73.85, 1400),
]

# --- fixed values: city to census place codes, aliases included
CITY_FIPS = {
    "San Francisco": {"state": "06", "place": "67000"},
    "Los Angeles": {"state": "06", "place": "44000"},
    "Chicago": {"state": "17", "place": "14000"},
    "New York": {"state": "36", "place": "51000"},
    "New York City": {"state": "36", "place": "51000"},
}

# --- fixed values: census variable to column name
AGE_COLUMNS = {
    "NAME": "census_name",
    "S0101_C01_001E": "population_total",
    "S0101_C01_032E": "median_age",
    "S0101_C02_022E": "pct_under_18",
    "S0101_C02_030E": "pct_65_plus",
}
INCOME_COLUMNS = {"B19013_001E": "median_household_income"}
ZCTA_COLUMN = "zip code tabulation area"

# --- fixed values: type tags too generic to report
GENERIC_TYPES = ["restaurant", "food", "point_of_interest", "establishment", "store"]
GENERIC_TYPES_KEEP_STORE = ["restaurant", "food", "establishment", "point_of_interest"]

# --- fixed values: classifier target, features and threshold sweep
HIGH_RATING = 4.6
NUMERIC_FEATURES = [
    "log_reviews", "price_level", "population_total", "median_age",
    "pct_under_18", "pct_65_plus", "median_household_income",
]
CATEGORICAL_FEATURES = ["city"]
THRESHOLDS = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]
TARGET_RECALL = 0.55

# --- fixed values: clustering
CLUSTER_FEATURES = ["rating", "price_level", "median_household_income", "population_total"]
CLUSTER_K = 4
SEED = 42
