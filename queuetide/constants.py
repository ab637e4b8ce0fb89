"""Names, limits and word lists that results depend on."""

KEY = "airport"
TS = "timestamp"
VALUE = "queue"
ID = "id"

# Zone whose wall clock drives the predictor's calendar features.
LOCAL_TZ = "Europe/Copenhagen"

# Readings at or above this are not queue lengths.
MAX_VALUE = 1e10

# Grids, in minutes.
FEATURE_STEP = 5
FORECAST_STEP = 15

# Forecast shape and limits.
HORIZON_STEPS = 32
CONTEXT_DAYS = 60
LAG_DAYS = (30, 365)
HISTORY_DAYS = 432
MAX_FILL_STEPS = 64
MAX_CONTEXT_AGE_MIN = 360
MIN_HORIZON_MIN = 30
LIVE_STALE_MIN = 20
TRAIN_DAYS = 365
MAX_ROUNDS = 1000
HOLDOUT_DAYS = 7

# Quantiles of the predictor, and the 21 levels of a published forecast.
PREDICTOR_LEVELS = [0.1, 0.5, 0.9]
FORECAST_LEVELS = [
    0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5,
    0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99,
]

# Sites that can be forecast, in category order.
FORECAST_KEYS = ["AMS", "ARN", "CPH", "DUB", "DUS", "FRA", "IST", "LHR", "EDI", "MUC"]

# Column orders of the two feature frames.
FEATURE_COLUMNS = [
    "month", "day", "weekday", "hour", "minute", "is_weekend",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "tod_sin", "tod_cos",
    "holiday", "profile_dow_time", "profile_time",
]
COVARIATE_COLUMNS = [
    "hour", "minute", "day_of_week", "is_weekend", "month",
    "tod_sin", "tod_cos", "tow_sin", "tow_cos", "doy_sin", "doy_cos",
    "queue_lag_30d", "queue_lag_365d", "queue_avg_dow_time", "queue_avg_time",
]

# Upper bounds of the pull-duration histogram, seconds.
DURATION_BOUNDS = [0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]

# Backtest defaults, and the order its models are listed in.
BACKTEST_HORIZONS_H = [1, 2, 4, 8, 24, 168]
MODEL_ORDER = ["last_value", "seasonal_naive", "calendar", "forecast"]

# Airline names by carrier code.
AIRLINES = {
    "A3": "Aegean Airlines", "AF": "Air France", "AZ": "ITA Airways",
    "BA": "British Airways", "E9": "Iberojet", "IB": "Iberia", "KL": "KLM",
    "LH": "Lufthansa", "NT": "Binter Canarias", "PC": "Pegasus Airlines",
    "TP": "TAP Air Portugal", "VY": "Vueling", "UX": "Air Europa",
    "AA": "American Airlines", "AV": "Avianca", "B6": "JetBlue Airways",
    "DL": "Delta Air Lines", "TS": "Air Transat", "UA": "United Airlines",
    "2W": "World2Fly", "AT": "Royal Air Maroc", "EK": "Emirates",
    "MS": "EgyptAir", "TK": "Turkish Airlines", "CA": "Air China",
    "MU": "China Eastern Airlines",
}

# Display names by site code.
SITE_NAMES = {
    "CPH": "Copenhagen Airport", "EDI": "Edinburgh Airport",
    "ARN": "Stockholm Airport", "DUS": "Düsseldorf Airport",
    "FRA": "Frankfurt Airport", "MUC": "Munich Airport",
    "LHR": "London Heathrow Airport", "AMS": "Amsterdam Airport",
    "DUB": "Dublin Airport", "IST": "Istanbul Airport",
}
