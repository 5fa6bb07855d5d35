"""Schemas of the tables, as in FIXTURES.md part A."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KEYS = "station_id string, country string, technology string, deploy_ssp string, climate_ssp string, target_year int"
_COUNTRY_KEYS = "country string, technology string, deploy_ssp string, climate_ssp string, target_year int"

_DDL = {
    "stations": "year int, type string, lon double, lat double, capacity_gw double",
    "power": "region string, technology string, climate_ssp string, station_idx int, year int, month int, step_idx int, power_gw double",
    "power_stations": "station_idx int, capacity_gw double, activation_year int, station_lon double, station_lat double",
    "station_annual": f"{_KEYS}, capacity_mw double, annual_capacity_factor double, annual_generation_mwh double",
    "station_monthly": f"{_KEYS}, month int, capacity_mw double, monthly_capacity_factor double, monthly_generation_mwh double",
    "country_annual": f"{_COUNTRY_KEYS}, capacity_mw double, annual_generation_mwh double, mean_cf double",
    "country_base": "country string, lat_center double, lon_center double, system_scale_index double, solar_resource_index double, wind_resource_index double, extreme_weather_index double",
    "station_catalog": "station_id string, country string, deploy_ssp string, target_year int, technology string, lat double, lon double, capacity_mw double, base_capacity_factor double, resource_index double, station_extreme_weather_index double",
    "country_event_hazard": "country string, climate_ssp string, target_year int, technology string, event_type string, event_frequency_hours_per_year double, mean_event_duration_hours double, event_intensity_index double, affected_area_km2 double",
    "station_event_exposure": f"{_KEYS}, event_type string, capacity_mw double, exposed_hours double, exposed_capacity_mw_hours double, exposed_generation_mwh double, event_intensity_index double",
    "per_country_annual_cf": "energy string, model string, scenario string, region string, year int, mean_cf double",
    "global_annual_cf": "energy string, scenario string, year int, mean_cf double",
    "grid": "grid_id string, ilat int, ilon int, lat double, lon double, value double",
    "region_raster": "row int, col int, region_id int",
    "region_names": "region_id int, region_name string",
    "areas": "ordinal int, name string, north double, west double, south double, east double",
    "facilities": "technology string, lon double, lat double, area_m2 double, capacity_gw double",
    "region_coverage": "year int, region_id string, region_name string, n_total long, n_inside long, n_cover_ratio double, cap_total_gw double, cap_inside_gw double, cap_cover_ratio double",
}

_TYPES = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType()}


def _struct(ddl: str) -> StructType:
    """As StructType.fromDDL, but without a session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in map(str.split, ddl.split(","))])


SCHEMAS = {name: _struct(ddl) for name, ddl in _DDL.items()}
