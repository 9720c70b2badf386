"""Names and numbers the results depend on."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Raw column names and the short names used from then on.
# ---------------------------------------------------------------------------
RAW_TIME = "utc_timestamp"

CLEANING_COLUMNS = {
    "DE_solar_generation_actual": "solar_gen",
    "DE_wind_generation_actual": "wind_gen",
    "DE_wind_onshore_generation_actual": "wind_onshore",
    "DE_wind_offshore_generation_actual": "wind_offshore",
    "DE_load_actual_entsoe_transparency": "load_actual",
    "DE_load_forecast_entsoe_transparency": "load_forecast",
    "DE_solar_capacity": "solar_capacity",
    "DE_LU_price_day_ahead": "price",
}

SUPPLY_COLUMNS = {
    "DE_solar_generation_actual": "solar_raw",
    "DE_solar_capacity": "solar_cap",
    "DE_solar_profile": "solar_profile",
    "DE_wind_generation_actual": "wind_raw",
    "DE_wind_capacity": "wind_cap",
    "DE_wind_profile": "wind_profile",
    "DE_wind_onshore_generation_actual": "wind_onshore_raw",
    "DE_wind_offshore_generation_actual": "wind_offshore_raw",
    "DE_load_actual_entsoe_transparency": "load_actual",
}

# Columns of the package's own tables that hold text, for reading them back from CSV.
TEXT_COLUMNS = ["level", "action", "detail", "live_level", "live_action", "season", "split", "series_id", "model",
                "verdict", "recommended_action"]

# ---------------------------------------------------------------------------
# Model feature lists; the order is part of the contract.
# ---------------------------------------------------------------------------
DEMAND_FEATURES = [
    "lag_1h", "lag_2h", "lag_3h", "lag_24h", "lag_48h", "lag_168h",
    "roll_6h", "roll_24h", "roll_168h", "roll_std_24h", "roll_std_168h",
    "hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos",
    "is_weekend", "year",
]
TIME_FEATURES = [
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "doy_sin", "doy_cos", "is_weekend", "year",
]
SOLAR_FEATURES = TIME_FEATURES + [
    "solar_lag_1h", "solar_lag_24h", "solar_lag_168h", "solar_roll_24h", "solar_cap",
]
WIND_FEATURES = TIME_FEATURES + [
    "wind_lag_1h", "wind_lag_24h", "wind_lag_168h",
    "wind_roll_24h", "wind_roll_72h", "wind_cap",
]

# ---------------------------------------------------------------------------
# Limits, peaks, shares.
# ---------------------------------------------------------------------------
FFILL_ROWS = 3
INTERPOLATE_ROWS = 6
TRAIN_SHARE = 0.80
SEQUENCE_ROWS = 24
SOLAR_PEAK_MW = 30_000.0
WIND_PEAK_MW = 45_000.0
MIN_PROFILE_ROWS = 1_000
MIN_SIDE_ROWS = 10
HISTOGRAM_BINS = 80

THRESHOLD_NAMES = ["low_def", "high_def", "crit_def", "low_sur", "high_sur", "crit_sur"]
FIXED_THRESHOLDS = {
    "low_def": 500.0,
    "high_def": 3000.0,
    "crit_def": 8000.0,
    "low_sur": -500.0,
    "high_sur": -3000.0,
    "crit_sur": -8000.0,
}
DEFICIT_QUANTILES = {"low_def": 0.25, "high_def": 0.65, "crit_def": 0.90}
SURPLUS_QUANTILES = {"low_sur": 0.75, "high_sur": 0.35, "crit_sur": 0.10}

# ---------------------------------------------------------------------------
# Intervention levels. ``{}`` in a detail is the gap in whole MW.
# ---------------------------------------------------------------------------
LEVELS = ["CRITICAL", "HIGH", "MODERATE", "BALANCED", "SURPLUS", "HIGH SURPLUS", "CRITICAL SURPLUS"]

LEVEL_ORDINAL = {
    "CRITICAL": 4, "HIGH": 3, "MODERATE": 2, "BALANCED": 1,
    "SURPLUS": 0, "HIGH SURPLUS": -1, "CRITICAL SURPLUS": -2,
}

ACTIONS = {
    "CRITICAL": "🔴 Emergency import + backup generators",
    "HIGH": "🟠 Demand response + gas peakers",
    "MODERATE": "🟡 Minor demand response",
    "BALANCED": "🟢 Grid balanced — no action needed",
    "SURPLUS": "🔵 Charge storage / export",
    "HIGH SURPLUS": "🟣 Curtail wind + charge all storage",
    "CRITICAL SURPLUS": "⚫ Emergency curtailment",
}

# The report with detail sentences words one action differently.
DETAILED_ACTIONS = {**ACTIONS, "SURPLUS": "🔵 Charge storage / export to neighbours"}

DETAILS = {
    "CRITICAL": "Deficit of {} MW — activate emergency response, import from neighbouring grids, "
                "spin up gas peakers immediately.",
    "HIGH": "Deficit of {} MW — trigger industrial demand response, activate dispatchable gas generation.",
    "MODERATE": "Deficit of {} MW — request voluntary load reduction from industrial consumers.",
    "BALANCED": "Gap of {} MW — within normal operating range.",
    "SURPLUS": "Surplus of {} MW — direct excess to battery storage or export via interconnectors.",
    "HIGH SURPLUS": "Surplus of {} MW — curtail onshore wind, maximize storage charging, ramp up pumped hydro.",
    "CRITICAL SURPLUS": "Surplus of {} MW — emergency grid frequency protection, "
                        "curtail all curtailable generation immediately.",
}

# ---------------------------------------------------------------------------
# Calendar names.
# ---------------------------------------------------------------------------
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SEASONS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Autumn": [9, 10, 11]}

CORRELATION_COLUMNS = [
    "solar_gen", "wind_gen", "wind_onshore", "wind_offshore", "load_actual", "load_forecast",
    "price", "supply_gap", "forecast_error", "hour", "month", "is_weekend",
]
