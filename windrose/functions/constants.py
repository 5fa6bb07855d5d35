"""Scenario names, dimension tables and coefficients."""

from __future__ import annotations

# ── Fixed values ──────────────────────────────────────────────────────────────
SSPS = ["ssp126", "ssp245", "ssp585"]
YEARS = [2030, 2040, 2050]
TECHS = ["wind", "solar"]
HOURS = 8760
DAYS_IN_MONTH = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

EVENTS = {"wind": ["heatwave", "windstorm"], "solar": ["rainstorm", "coldwave", "freezing_rain"]}
EVENT_HOURS = {"heatwave": 95.0, "windstorm": 45.0, "rainstorm": 75.0, "coldwave": 65.0, "freezing_rain": 22.0}
EVENT_INTENSITY = {"heatwave": 1.8, "windstorm": 2.4, "rainstorm": 2.0, "coldwave": 1.7, "freezing_rain": 1.5}
EVENT_VULNERABILITY = {"heatwave": 0.08, "windstorm": 0.18, "rainstorm": 0.14, "coldwave": 0.05, "freezing_rain": 0.22}

DEPLOY_YEAR_FACTOR = {2030: 1.0, 2040: 1.9, 2050: 3.0}
DEPLOY_SSP_FACTOR = {"ssp126": 1.45, "ssp245": 1.0, "ssp585": 0.55}
YEAR_PROGRESS = {2030: 0.35, 2040: 0.65, 2050: 1.0}
HAZARD_SSP_FACTOR = {"ssp126": 0.8, "ssp245": 1.0, "ssp585": 1.35}
CF_SSP_EFFECT = {
    "solar": {"ssp126": 0.005, "ssp245": -0.005, "ssp585": -0.025},
    "wind": {"ssp126": 0.0, "ssp245": -0.01, "ssp585": -0.035},
}

SYSTEM_SCALE = {"China": 7.0, "America": 6.0, "India": 5.0, "Australia": 3.0, "Brazil": 3.0, "Germany": 2.0, "France": 1.8, "United Kingdom": 1.6, "Japan": 1.8}
COUNTRIES = [
    "Netherlands", "Ireland", "South Korea", "Denmark", "Portugal", "Austria", "Greece", "Romania", "United Kingdom", "Poland", "Germany", "Vietnam", "Egypt", "South Africa",
    "Spain", "Italy", "Turkey", "France", "Sweden", "Ukraine", "Japan", "Chile", "México", "India", "Australia", "Brazil", "China", "America",
]

# Rectangles in order of precedence: name, north, west, south, east; longitudes in [0, 360).
AREAS = [
    ("China", 54.95, 70.05, 15.05, 139.95),
    ("Japan", 45.5, 122.9, 24.2, 145.8),
    ("South Korea", 38.6, 124.6, 33.2, 130.9),
    ("India", 37.0, 68.0, 6.0, 98.0),
    ("Turkey", 42.1, 25.7, 35.8, 44.8),
    ("Vietnam", 23.4, 102.1, 8.6, 109.5),
    ("Germany", 55.0, 5.0, 47.0, 15.0),
    ("Italy", 48.0, 6.0, 36.0, 19.0),
    ("Spain", 44.0, 350.0, 35.0, 5.0),
    ("France", 51.1, 354.9, 41.3, 9.6),
    ("United Kingdom", 60.9, 351.4, 50.0, 1.8),
    ("Poland", 54.8, 14.1, 49.0, 24.2),
    ("Greece", 41.8, 19.4, 34.8, 28.2),
    ("Sweden", 69.1, 11.1, 55.3, 24.2),
    ("Denmark", 57.8, 8.1, 54.6, 15.2),
    ("Portugal", 42.2, 328.7, 37.0, 353.8),
    ("Netherlands", 53.6, 3.4, 50.8, 7.2),
    ("Ireland", 55.4, 349.5, 51.4, 354.0),
    ("Romania", 48.3, 20.3, 43.7, 29.7),
    ("Ukraine", 52.4, 22.2, 44.4, 40.2),
    ("Austria", 49.0, 9.5, 46.4, 17.2),
    ("México", 32.7, 241.6, 14.5, 273.3),
    ("Brazil", 5.3, 286.0, -33.8, 325.3),
    ("Chile", -17.5, 283.5, -55.9, 293.6),
    ("South Africa", -22.1, 16.3, -28.3, 32.9),
    ("Egypt", 31.7, 24.7, 22.0, 36.9),
    ("Australia", -9.1, 112.9, -43.6, 153.6),
]

# Macro-regions by number, from 1; 0 is background.
MACRO_REGIONS = [
    "Northern America", "Central America", "Caribbean", "South America", "Northern Europe", "Western Europe", "Southern Europe", "Eastern Europe", "Central Asia", "Eastern Asia",
    "Western Asia", "Southern Asia", "South-eastern Asia", "Melanesia", "Australia-New Zealand", "Northern Africa", "Western Africa", "Middle Africa", "Eastern Africa", "Southern Africa",
]

# Invented studies.  Ranges are (low, high); spreads are (deviation, low, high).
LAT_RANGE, LON_RANGE = (-35.0, 60.0), (-120.0, 140.0)
SCALE_SIGMA = 0.25
SUN_INDEX, SUN_TROPIC, SUN_PER_DEGREE = (0.15, 0.65, 1.45), 30.0, 100.0
WIND_INDEX, WIND_PER_DEGREE = (0.18, 0.65, 1.55), 140.0
WEATHER_INDEX, WEATHER_PER_DEGREE = (0.22, 0.55, 1.75), 120.0
SITES_PER_SCALE, SITES_RANGE, SITES_LEAST = {"solar": 4.0, "wind": 3.0}, (3.0, 180.0), 2
SITE_LAT_SPREAD, SITE_LON_SPREAD = 2.5, 3.0
CAPACITY_MEDIAN_MW, CAPACITY_SIGMA = {"solar": 180.0, "wind": 220.0}, 0.55
BASE_CF = {"solar": (0.18, 0.035, 0.08, 0.34), "wind": (0.32, 0.065, 0.12, 0.58)}
LOCAL_WEATHER = (0.18, 0.3, 2.5)
YEAR_CF = (0.025, 0.02, 0.72)
MONTH_CF = (0.04, 0.01, 0.85)
SUN_SEASON, SUN_SEASON_FROM = 0.18, 3
WIND_SEASON, WIND_SEASON_FROM = 0.12, 1
EVENT_HOURS_SPREAD = (0.25, 1.0, 900.0)
HOURS_PER_EVENT, DURATION_SPREAD = 18.0, (3.0, 1.0, 120.0)
INTENSITY_SPREAD = (0.18, 0.2, 8.0)
AREA_PER_SCALE, AREA_HOURS, AREA_SIGMA = 5e4, 120.0, 0.35
EXPOSED_HOURS_RANGE = (0.0, 1500.0)
EXPOSURE_SIGMA, EXPOSED_GENERATION_SIGMA = 0.22, 0.10
VULNERABILITY_PER_INTENSITY, VULNERABILITY_SIGMA, VULNERABILITY_RANGE = 0.10, 0.25, (0.005, 0.75)
EVENT_CF_RANGE = (0.85, 1.15)
TINY = 1e-9

#: Rotated pole (longitude, latitude) of the curvilinear domain.
ROTATED_POLE = (83.0, 42.5)

# Capacity densities, MW per square kilometre, and what goes with them.
PV_PEAK, PV_FILL = 161.9, 0.15
PV_TILT = (0.35396, 16.84775)
SOLSTICE_TILT = 23.45
WIND_DENSITY, ROTOR_M, SPACING_ROTORS = 3.68, 100.0, 8.0
GRID_PV_DENSITY, GRID_WIND_LAND, GRID_WIND_OTHER, LAND_FROM = 74.0, 4.6, 2.7, 100.0
WEB_MERCATOR_RADIUS = 6378137.0
# ──────────────────────────────────────────────────────────────────────────────
