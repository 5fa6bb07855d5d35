"""python -m windrose prepare | study | coverage: whole runs from files to tables."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .functions import constants as K
from .plans import jobs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="windrose", description=__doc__)
    top.add_argument("--log-file")
    runs = top.add_subparsers(dest="run", required=True)
    p = runs.add_parser("prepare", help="power and stations to station and country tables")
    p.add_argument("--power", required=True)
    p.add_argument("--stations", required=True)
    p.add_argument("--polygons")
    p.add_argument("--out", required=True)
    p.add_argument("--ssps", nargs="+", default=K.SSPS)
    p.add_argument("--target-years", nargs="+", type=int, default=K.YEARS)
    p.add_argument("--dt-hours", type=float, default=3.0)
    p = runs.add_parser("study", help="an invented study")
    p.add_argument("--out", required=True)
    p.add_argument("--seed", type=int, default=42)
    p = runs.add_parser("coverage", help="coverage of station sites")
    p.add_argument("--stations", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--raster")
    p.add_argument("--ssp")
    p.add_argument("--domain", nargs=4, type=float, metavar=("WEST", "EAST", "SOUTH", "NORTH"))
    return top


def main(argv: list[str] | None = None) -> dict[str, int]:
    a = parser().parse_args(argv)
    logging.basicConfig(filename=a.log_file, level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(f"windrose {a.run}").getOrCreate()
    if a.run == "prepare":
        rows = jobs.prepare(spark, a.power, a.stations, a.out, a.polygons, a.target_years, a.ssps, a.dt_hours)
    elif a.run == "study":
        rows = jobs.study(spark, a.out, a.seed)
    else:
        rows = jobs.station_coverage(spark, a.stations, a.out, a.raster, a.ssp, tuple(a.domain) if a.domain else None)
    for name, n in rows.items():
        logging.info("%s: %d rows", name, n)
    return rows


if __name__ == "__main__":
    main()
