"""DuckDB SQL for the queries of ``catalog``, written on its own from their meaning."""

from __future__ import annotations

from ..functions import constants as K
from . import views


def _values(rows, names: str) -> str:
    q = lambda v: "'" + v + "'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) AS t({names})"


_POWER = """v_power AS (
    SELECT CASE l_linestatus WHEN 'F' THEN 'solar' ELSE 'wind' END AS technology,
           CASE l_returnflag WHEN 'A' THEN 'ssp126' WHEN 'N' THEN 'ssp245' ELSE 'ssp585' END AS climate_ssp,
           CASE l_orderkey % 3 WHEN 0 THEN 'ssp126' WHEN 1 THEN 'ssp245' ELSE 'ssp585' END AS deploy_ssp,
           l_suppkey AS station_idx, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
           l_shipdate AS step, CASE WHEN l_discount <> 0 THEN l_discount * l_quantity END AS power
    FROM lineitem)"""
_STATION = """v_station AS (
    SELECT s_suppkey AS station_idx, s_acctbal AS cap, CAST(1995 + s_suppkey % 6 AS INT) AS active, n_name AS country
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_SITE = """v_site AS (
    SELECT c_custkey AS site_id, (c_custkey * 377 % 3600) / 10.0::DOUBLE - 180.0::DOUBLE AS lon,
           (c_custkey * 173 % 1500) / 10.0::DOUBLE - 65.0::DOUBLE AS lat, c_acctbal / 1000.0::DOUBLE AS cap,
           CASE WHEN c_custkey % 2 = 0 THEN 'solar' ELSE 'wind' END AS technology, c_nationkey AS nation_key
    FROM customer), v_at AS (SELECT *, CASE WHEN lon < 0 THEN lon + 360.0::DOUBLE ELSE lon END AS lon360 FROM v_site)"""
_CELL = f"""v_cell AS (
    SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CASE WHEN r < 9 AND c < 18 THEN 0 ELSE CAST((r * 7 + c * 3) % 21 AS INT) END AS region_id
    FROM range({views.N_ROWS}) AS a(r), range({views.N_COLS}) AS b(c))"""


def _annual(keys: str = "technology, climate_ssp", by: str = "year", name: str = "v_annual") -> str:
    k = keys.split(", ") + by.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in k)
    year = ", ".join(f"p.{c}" for c in [*keys.split(", "), "station_idx", "year"])
    return f"""{_POWER}, {_STATION}, v_steps AS (
    SELECT {keys}, {by}, count(DISTINCT step) AS n_steps FROM v_power GROUP BY ALL
), v_data AS (SELECT {year} FROM v_power p GROUP BY ALL HAVING count(power) > 0
), v_sum AS (SELECT {keys}, station_idx, {by}, coalesce(sum(power), 0) AS total FROM v_power GROUP BY ALL
), {name} AS (
    SELECT {", ".join("v_sum." + c for c in keys.split(", "))}, v_sum.station_idx, {", ".join("v_sum." + c for c in by.split(", "))}, country, n_steps, cap * 1000 AS capacity_mw,
           total / (n_steps * cap) AS capacity_factor, total * 3 * 1000 AS generation_mwh
    FROM v_sum JOIN v_steps ON {on("v_sum", "v_steps")}
    JOIN v_data ON {" AND ".join(f"v_sum.{c} = v_data.{c}" for c in [*keys.split(", "), "station_idx", "year"])}
    JOIN v_station ON v_sum.station_idx = v_station.station_idx AND cap > 0 AND active <= v_sum.year)"""


_BOTH = "technology, deploy_ssp, climate_ssp"
_COUNTRY = _annual() + """, v_country AS (
    SELECT country, technology, climate_ssp, year, sum(capacity_mw) AS capacity_mw, sum(generation_mwh) AS generation_mwh, avg(capacity_factor) AS mean_cf
    FROM v_annual GROUP BY ALL)"""
_Q01_COLUMNS = "station_idx, country, n_steps, round(capacity_mw, 6) AS capacity_mw, round(capacity_factor, 6) AS capacity_factor, round(generation_mwh, 6) AS generation_mwh"


def _in(box: str = "b", lon: str = "lon360", lat: str = "lat") -> str:
    return f"({lat} <= {box}.north AND {lat} >= {box}.south AND CASE WHEN {box}.west <= {box}.east THEN {lon} >= {box}.west AND {lon} <= {box}.east ELSE {lon} >= {box}.west OR {lon} <= {box}.east END)"


def _code(name: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({name}), '1.?2.?6') THEN 'ssp126' WHEN regexp_matches(lower({name}), '2.?4.?5') THEN 'ssp245' WHEN regexp_matches(lower({name}), '5.?8.?5') OR regexp_matches(lower({name}), '5.?6.?0') THEN 'ssp585'
               WHEN regexp_matches(lower({name}), 'ssp[0-9]{{3}}') THEN 'ssp' || regexp_extract(lower({name}), 'ssp([0-9]{{3}})', 1) ELSE {name} END"""


_BOXES = f"v_box AS (SELECT * FROM {_values(views.BOXES, 'ordinal, name, north, west, south, east')})"
_AREAS = f"v_area AS (SELECT * FROM {_values([(i, *a) for i, a in enumerate(K.AREAS)], 'ordinal, name, north, west, south, east')})"


def _inside(areas: str) -> str:
    return f"v_in AS (SELECT *, EXISTS (SELECT 1 FROM {areas} b WHERE {_in()}) AS inside FROM v_at)"


_COVER = """count(*) AS n_total, count(*) FILTER (inside) AS n_inside, round(coalesce(sum(cap), 0), 6) AS cap_total, round(coalesce(sum(cap) FILTER (inside), 0), 6) AS cap_inside,
    round(CAST(count(*) FILTER (inside) AS DOUBLE) / count(*), 6) AS n_cover_ratio, round(coalesce(coalesce(sum(cap) FILTER (inside), 0) / nullif(sum(cap), 0), 0), 6) AS cap_cover_ratio"""
_RC = """CAST(least(greatest(floor((90.0::DOUBLE - lat) / 10.0::DOUBLE), 0), 17) AS INT) AS row, CAST(least(greatest(floor(lon360 / 10.0::DOUBLE), 0), 35) AS INT) AS col"""

_EVENTS = [e for own in K.EVENTS.values() for e in own]
_EVENT = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EVENTS)) + " END"
_RISK = _annual(_BOTH) + f""", a AS (
    SELECT CAST(station_idx AS VARCHAR) AS station_id, country, technology, deploy_ssp, climate_ssp, year AS target_year, capacity_mw, capacity_factor, generation_mwh FROM v_annual
), h AS (SELECT CAST(user_id AS VARCHAR) AS station_id, {_EVENT} AS event_type, sum(value) AS exposed_hours, avg(value) AS intensity FROM events GROUP BY ALL
), x AS (SELECT a.*, event_type, exposed_hours, intensity, generation_mwh * exposed_hours / 8760 AS exposed FROM a JOIN h USING (station_id)
), k AS (SELECT station_id, deploy_ssp, climate_ssp, sum(generation_mwh) AS annual FROM a GROUP BY ALL
), l AS (
    SELECT x.*, annual, exposed * least(greatest(CASE event_type {" ".join(f"WHEN '{e}' THEN {v}" for e, v in K.EVENT_VULNERABILITY.items())} END * (1.0 + 0.10 * intensity), 0.005), 0.75) AS loss
    FROM x JOIN k USING (station_id, deploy_ssp, climate_ssp)
), c AS (
    SELECT country, technology, deploy_ssp, climate_ssp, target_year, event_type, sum(capacity_mw) AS capacity_mw, sum(annual) AS annual_generation_mwh, sum(exposed) AS exposed_generation_mwh, sum(loss) AS loss_mwh
    FROM l GROUP BY ALL
), m AS (
    SELECT country, technology, target_year, climate_ssp, deploy_ssp, sum(capacity_mw) AS capacity_mw, sum(annual_generation_mwh) AS annual_generation_mwh, sum(loss_mwh) AS loss_mwh FROM c GROUP BY ALL)"""
_R4 = lambda *cs: ", ".join(f"round({c}, 4) AS {c}" for c in cs)
_RATES = """round(loss_mwh / nullif(annual_generation_mwh, 0), 4) AS annual_loss_rate, round(loss_mwh / nullif(exposed_generation_mwh, 0), 4) AS conditional_loss_rate,
    round(loss_mwh / nullif(capacity_mw, 0), 4) AS unit_capacity_loss_mwh_per_mw"""


def _segments(keys: str, value: str, table: str) -> str:
    return f"""w AS (SELECT {keys}, coalesce(max({value}) FILTER (year = 1996), 0) AS a, coalesce(max({value}) FILTER (year = 1998), 0) AS b, coalesce(max({value}) FILTER (year = 2000), 0) AS c FROM {table} GROUP BY ALL),
    s AS (SELECT {keys}, a AS seg_1996, greatest(b - a, 0) AS seg_1998, greatest(c - b, 0) AS seg_2000, c FROM w)"""


_POLY = f"e AS (SELECT * FROM {_values(views.POLYGONS, 'poly, name, x1, y1, x2, y2')})"
_KDE = lambda keys, x, low, high, n, source, least=3: f"""b AS (SELECT {keys}, {x} AS x FROM {source}), st AS (SELECT {keys}, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM b GROUP BY ALL HAVING count(*) >= {least} AND stddev_samp(x) > 0),
    g AS (SELECT CAST(i AS INT) AS point, {low} + ({high} - {low}) * i / {n - 1}.0::DOUBLE AS x FROM range({n}) AS r(i))
    SELECT {", ".join("st." + k for k in keys.split(", "))}, point, round(g.x, 6) AS x, n, round(h, 6) AS bandwidth,
           round(sum(exp(-0.5 * pow((g.x - b.x) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
    FROM st JOIN b USING ({keys}) CROSS JOIN g GROUP BY {", ".join("st." + k for k in keys.split(", "))}, point, g.x, n, h"""  # noqa: E731


def _axis(values: list[float], x: str, periodic: bool) -> str:
    d = f"abs(v - {x})"
    if periodic:
        d = f"least({d}, 360.0::DOUBLE - {d})"
    rows = _values([(i, v) for i, v in enumerate(values)], "i, v")
    return f"(SELECT CAST(arg_min(i, struct_pack(d := {d}, i := i)) AS INT) FROM {rows})"


ORACLE_SQL = {
    "q01_station_annual_cf": f"WITH {_annual()} SELECT technology, climate_ssp, year, {_Q01_COLUMNS} FROM v_annual",
    "q02_station_monthly_cf": f"WITH {_annual(by='year, month')} SELECT technology, climate_ssp, year, month, {_Q01_COLUMNS} FROM v_annual",
    "q03_country_annual": f"WITH {_COUNTRY} SELECT country, technology, climate_ssp, year, round(capacity_mw, 6) AS capacity_mw, round(generation_mwh, 6) AS generation_mwh, round(mean_cf, 6) AS mean_cf FROM v_country",
    "q03b_check_table": f"WITH {_COUNTRY} SELECT technology, climate_ssp, count(*) AS n, round(sum(capacity_mw) / 1e3, 6) AS capacity_gw, round(sum(generation_mwh) / 1e6, 6) AS generation_twh, round(avg(mean_cf), 6) AS mean_cf FROM v_country GROUP BY ALL",
    "q04_capacity_weighted_cf": f"""WITH {_annual()} SELECT technology, climate_ssp, year, round(sum(capacity_mw), 6) AS capacity_mw, round(sum(generation_mwh), 6) AS generation_mwh,
        round(sum(capacity_mw * capacity_factor) / sum(capacity_mw), 6) AS mean_weighted_cf, round(sum(generation_mwh) / (sum(capacity_mw) * 8760), 6) AS hours_cf FROM v_annual GROUP BY ALL""",
    "q04b_monthly_weighted_cf": f"""WITH {_annual(by='year, month')} SELECT technology, climate_ssp, month, round(sum(capacity_mw), 6) AS capacity_mw, round(sum(generation_mwh), 6) AS generation_mwh,
        round(sum(capacity_mw * capacity_factor) / sum(capacity_mw) * 100, 6) AS weighted_cf FROM v_annual GROUP BY ALL""",
    "q04c_generation_totals": f"WITH {_annual()} SELECT technology, climate_ssp, year, round(sum(generation_mwh) / 1e6, 6) AS generation_mwh FROM v_annual GROUP BY ALL",
    "q05_coherent_vs_fixed_fleet": f"""WITH {_annual(_BOTH)}, f AS (SELECT 'coherent' AS fleet, * FROM v_annual WHERE deploy_ssp = climate_ssp UNION ALL SELECT 'fixed', * FROM v_annual WHERE deploy_ssp = 'ssp245')
        SELECT fleet, technology, climate_ssp, year, round(sum(capacity_mw), 6) AS capacity_mw, round(sum(generation_mwh), 6) AS generation_mwh, round(sum(capacity_mw * capacity_factor) / sum(capacity_mw), 6) AS weighted_cf FROM f GROUP BY ALL""",
    "q06_coverage_rollup": f"WITH {_SITE}, {_BOXES}, {_inside('v_box')} SELECT coalesce(technology, 'all') AS technology, {_COVER} FROM v_in GROUP BY GROUPING SETS ((technology), ())",
    "q06b_coverage_by_group_total": f"""WITH {_SITE}, {_AREAS}, {_inside('v_area')} SELECT technology, CASE WHEN grouping(nation_key) = 1 THEN 'ALL' ELSE CAST(nation_key AS VARCHAR) END AS nation_key, {_COVER}
        FROM v_in GROUP BY GROUPING SETS ((technology, nation_key), (technology))""",
    "q06c_dense_regions": f"""WITH {_SITE}, {_CELL}, {_AREAS}, {_inside('v_area')}, p AS (SELECT *, {_RC} FROM v_in), g AS (SELECT region_id, {_COVER} FROM p JOIN v_cell USING (row, col) GROUP BY region_id),
        r AS (SELECT * FROM {_values(list(enumerate(K.MACRO_REGIONS, 1)), 'region_id, region_name')})
        SELECT r.region_id, region_name, coalesce(n_total, 0) AS n_total, coalesce(n_inside, 0) AS n_inside, coalesce(cap_total, 0) AS cap_total, coalesce(cap_inside, 0) AS cap_inside,
               coalesce(n_cover_ratio, 0) AS n_cover_ratio, coalesce(cap_cover_ratio, 0) AS cap_cover_ratio FROM r LEFT JOIN g ON r.region_id = g.region_id""",
    "q07_first_match_region": f"WITH {_SITE}, {_BOXES} SELECT site_id, coalesce((SELECT arg_min(name, ordinal) FROM v_box b WHERE {_in()}), 'outside') AS area FROM v_at",
    "q07b_first_match_constant": f"WITH {_SITE}, {_AREAS} SELECT site_id, coalesce((SELECT arg_min(name, ordinal) FROM v_area b WHERE {_in()}), 'outside') AS area FROM v_at",
    "q08_rotated_domain": f"""WITH {_SITE}, t AS (SELECT site_id, radians(lon - 83.0) AS d, radians(lat) AS f, radians(42.5) AS p FROM v_site), r AS (
        SELECT site_id, degrees(atan2((0.0 - sin(d)) * cos(f), cos(p) * sin(f) - sin(p) * cos(f) * cos(d))) AS rlon, degrees(asin(sin(f) * sin(p) + cos(f) * cos(p) * cos(d))) AS rlat FROM t)
        SELECT site_id, round(rlon, 5) AS rlon, round(rlat, 5) AS rlat, rlon BETWEEN -40 AND 35 AND rlat BETWEEN -30 AND 40 AS inside FROM r""",
    "q09_point_in_polygon": f"""WITH {_SITE}, {_POLY}, t AS (
        SELECT site_id, poly, name, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd,
               bool_or((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge
        FROM v_site CROSS JOIN e GROUP BY ALL)
        SELECT site_id, coalesce(arg_min(name, poly) FILTER (odd AND NOT edge), arg_min(name, poly) FILTER (edge)) AS covers, coalesce(arg_min(name, poly) FILTER (odd AND NOT edge), 'outside') AS contains FROM t GROUP BY site_id""",
    "q10_raster_lookup": f"""WITH {_SITE}, {_CELL}, p AS (SELECT site_id, {_RC},
        CAST(least(greatest(round_even((90.0::DOUBLE - lat) / 10.0::DOUBLE, 0), 0), 17) AS INT) AS r2, CAST(least(greatest(round_even(lon360 / 10.0::DOUBLE, 0), 0), 35) AS INT) AS c2 FROM v_at)
        SELECT site_id, a.region_id AS floor_region, b.region_id AS rint_region FROM p JOIN v_cell a ON p.row = a.row AND p.col = a.col JOIN v_cell b ON r2 = b.row AND c2 = b.col""",
    "q11_nearest_axis": f"WITH {_SITE} SELECT site_id, {_axis(views.LAT_AXIS, 'lat', False)} AS ilat, {_axis(views.LON_AXIS, 'lon360', True)} AS ilon, {_axis(views.LON_AXIS, 'lon360', False)} AS ilon_plain FROM v_at",
    "q11b_nearest_point": f"""WITH {_SITE}, c AS (SELECT s_suppkey AS cell_id, (s_suppkey * 911 % 3600) / 10.0::DOUBLE AS x, (s_suppkey * 577 % 1500) / 10.0::DOUBLE - 65.0::DOUBLE AS y FROM supplier),
        d AS (SELECT site_id, cell_id, pow(y - lat, 2) + pow(x - lon360, 2) AS d2 FROM v_at CROSS JOIN c)
        SELECT site_id, arg_min(cell_id, struct_pack(d := d2, i := cell_id)) AS cell_id, round(sqrt(min(d2)), 6) AS distance, sqrt(min(d2)) < 0.3 AS near FROM d GROUP BY site_id""",
    "q11c_fill_background": f"""WITH {_SITE}, {_CELL}, w AS (SELECT DISTINCT p.row, p.col FROM (SELECT {_RC} FROM v_at) p JOIN v_cell c ON p.row = c.row AND p.col = c.col WHERE region_id = 0)
        SELECT w.row, w.col, arg_min(c.region_id, struct_pack(d := (c.row - w.row) * (c.row - w.row) + (c.col - w.col) * (c.col - w.col), r := c.row, c := c.col)) AS region_id
        FROM w, v_cell c WHERE c.region_id > 0 GROUP BY ALL""",
    "q12_grid_occupancy": f"""WITH {_SITE}, p AS (SELECT *, CAST(floor((90.0::DOUBLE - lat) / 10.0::DOUBLE) AS INT) AS row, CAST(floor(lon360 / 10.0::DOUBLE) AS INT) AS col FROM v_at)
        SELECT row, col, count(*) AS n, round(sum(cap), 6) AS capacity_gw, bool_or(technology = 'solar') AS has_solar, bool_or(technology = 'wind') AS has_wind, bool_or(cap > 0) AS covered
        FROM p WHERE row BETWEEN 0 AND 17 AND col BETWEEN 0 AND 35 GROUP BY ALL""",
    "q12b_grid_by_region": f"""WITH {_SITE}, {_CELL}, p AS (SELECT *, CAST(floor((90.0::DOUBLE - lat) / 10.0::DOUBLE) AS INT) AS row, CAST(floor(lon360 / 10.0::DOUBLE) AS INT) AS col FROM v_at),
        o AS (SELECT row, col, sum(cap) AS cap, bool_or(technology = 'solar') AS s, bool_or(technology = 'wind') AS w, bool_or(cap > 5) AS k FROM p GROUP BY ALL)
        SELECT region_id, count(*) AS n_cells, count(*) FILTER (s) AS n_solar, count(*) FILTER (w) AS n_wind, count(*) FILTER (s OR w) AS n_any, count(*) FILTER (k) AS n_covered, round(coalesce(sum(cap), 0), 6) AS capacity_gw
        FROM v_cell LEFT JOIN o USING (row, col) WHERE region_id > 0 GROUP BY region_id""",
    "q13_raster_mode": f"""WITH {_SITE}, k AS (SELECT {_RC}, site_id FROM v_at), g AS (SELECT row, col, CAST(sum(site_id) % 5 AS INT) AS region_id FROM k GROUP BY ALL),
        b AS (SELECT CAST(row // 5 AS INT) AS row, CAST(col // 5 AS INT) AS col, region_id, count(*) AS n FROM g WHERE row < 15 AND col < 35 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY region_id = 0, n DESC, region_id) AS k FROM b) SELECT row, col, region_id FROM r WHERE k = 1""",
    "q13b_region_rings": f"""WITH RECURSIVE {_SITE}, k AS (SELECT {_RC}, site_id FROM v_at), g AS MATERIALIZED (SELECT row AS r, col AS c, CAST(sum(site_id) % 3 AS INT) AS v FROM k GROUP BY ALL),
        way AS (SELECT * FROM (VALUES (0, -1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1, 0), (2, 1, 0, 1, 1, 0, -1), (3, 0, -1, 1, 0, -1, 0)) t(d, nr, nc, a, b, dy, dx)),
        s AS MATERIALIZED (SELECT g.v, g.r + a AS y, g.c + b AS x, d, g.r + a + dy AS yy, g.c + b + dx AS xx FROM g CROSS JOIN way LEFT JOIN g AS o ON o.r = g.r + nr AND o.c = g.c + nc AND o.v = g.v WHERE o.v IS NULL),
        e AS MATERIALIZED (SELECT s.*, (s.y - min(s.y) OVER ()) * (max(s.x) OVER () - min(s.x) OVER () + 1) * 4 + (s.x - min(s.x) OVER ()) * 4 + s.d AS id FROM s),
        n AS MATERIALIZED (SELECT e.id, e.v, e.d, e.y, e.x, e.yy, e.xx, arg_min(o.id, (o.d - e.d + 6) % 4 * -1) AS nx, arg_min(o.d, (o.d - e.d + 6) % 4 * -1) <> e.d AS turns FROM e JOIN e AS o ON o.v = e.v AND o.y = e.yy AND o.x = e.xx GROUP BY e.id, e.v, e.d, e.y, e.x, e.yy, e.xx),
        w(head, here, seq) AS (SELECT id, id, 0 FROM n UNION ALL SELECT w.head, n.nx, w.seq + 1 FROM w JOIN n ON n.id = w.here WHERE n.nx > w.head),
        done AS (SELECT w.head AS ring, max(w.seq) AS last FROM w GROUP BY w.head), closed AS (SELECT done.ring, last FROM done JOIN w ON w.head = done.ring AND w.seq = done.last JOIN n ON n.id = w.here WHERE n.nx = done.ring),
        a AS (SELECT w.head AS ring, sum(n.x * n.yy - n.xx * n.y) AS area FROM w JOIN closed ON closed.ring = w.head JOIN n ON n.id = w.here GROUP BY ALL)
        SELECT n.v AS region_id, w.head AS ring, a.area < 0 AS hole, CAST(w.seq AS BIGINT) AS seq, n.x, n.y FROM w JOIN closed ON closed.ring = w.head JOIN a ON a.ring = w.head JOIN n ON n.id = w.here JOIN (SELECT DISTINCT nx FROM n WHERE turns) t ON t.nx = n.id""",
    "q14_zero_nan_quality": f"""WITH {_POWER}, s AS (SELECT technology, climate_ssp, CASE WHEN deploy_ssp = 'ssp585' THEN 'nodata' WHEN power IS NULL OR power = 0 THEN 'bad' ELSE 'ok' END AS s FROM v_power)
        SELECT technology, climate_ssp, count(*) AS n, count(*) FILTER (s = 'bad') AS n_bad, count(*) FILTER (s = 'ok') AS n_ok, count(*) FILTER (s = 'nodata') AS n_nodata,
               round(count(*) FILTER (s = 'bad') / CAST(nullif(count(*) FILTER (s <> 'nodata'), 0) AS DOUBLE), 6) AS bad_ratio FROM s GROUP BY ALL""",
    "q14b_agreement": """WITH t AS (SELECT l_returnflag, NOT coalesce(l_discount > 0.02, false) AS a, NOT coalesce(l_tax > 0.01, false) AS b FROM lineitem)
        SELECT l_returnflag, count(*) FILTER (a AND b) AS both_bad, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS both_ok,
               round(count(*) FILTER (a AND b) / CAST(greatest(count(*) FILTER (a OR b), 1) AS DOUBLE), 6) AS jaccard FROM t GROUP BY ALL""",
    "q14c_denominators": f"""WITH {_POWER}, d AS (SELECT * FROM (VALUES ('national', 'ssp126'), ('continental', 'ssp245'), ('continental', 'ssp585'), ('all', 'ssp126'), ('all', 'ssp245'), ('all', 'ssp585')) t(denominator, climate_ssp))
        SELECT denominator, count(*) AS n, count(*) FILTER (power IS NULL OR power = 0) AS n_bad, round(count(*) FILTER (power IS NULL OR power = 0) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS ratio
        FROM d JOIN v_power USING (climate_ssp) GROUP BY ALL""",
    "q14d_missing_by_surface": f"""WITH {_POWER}, t AS (SELECT technology, power IS NULL AS gone, (station_idx % 7) / 6.0::DOUBLE < 0.5 AS sea FROM v_power)
        SELECT technology, count(*) AS n, count(*) FILTER (gone) AS n_missing, count(*) FILTER (gone AND sea) AS n_sea, count(*) FILTER (gone AND NOT sea) AS n_land, count(*) FILTER (sea) AS sea_cells,
               round(count(*) FILTER (gone AND NOT sea) / CAST(greatest(count(*) FILTER (gone), 1) AS DOUBLE), 6) AS land_share, round(count(*) FILTER (sea) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS sea_share FROM t GROUP BY ALL""",
    "q15_edge_bands": f"""WITH {_SITE}, o AS (SELECT nation_key AS grid, CAST(floor((90.0::DOUBLE - lat) / 10.0::DOUBLE) AS INT) AS row, CAST(floor(lon360 / 10.0::DOUBLE) AS INT) AS col FROM v_at WHERE abs(lat) < 30 AND cap IS NOT NULL),
        b AS (SELECT n_nationkey AS grid, CAST(coalesce(min(row), 18) AS INT) AS top, CAST(coalesce(17 - max(row), 18) AS INT) AS bottom, CAST(coalesce(min(col), 36) AS INT) AS left, CAST(coalesce(35 - max(col), 36) AS INT) AS right FROM nation LEFT JOIN o ON grid = n_nationkey GROUP BY n_nationkey)
        SELECT *, top * 10.0::DOUBLE / (1 + grid % 2) AS top_deg, bottom * 10.0::DOUBLE / (1 + grid % 2) AS bottom_deg, "left" * 5.0::DOUBLE / (1 + grid % 2) AS left_deg, "right" * 5.0::DOUBLE / (1 + grid % 2) AS right_deg FROM b""",
    "q16_rms_combine": """SELECT user_id, round(sqrt(avg(value * value) FILTER (event_id % 2 = 0) + avg(value * value) FILTER (event_id % 2 = 1)), 6) AS speed,
        round(avg(value) FILTER (event_id % 2 = 0), 6) AS mean_u FROM events GROUP BY user_id""",
    "q17_percentiles": f"WITH {_annual()} SELECT technology, climate_ssp, " + ", ".join(f"round(quantile_cont(capacity_factor, {p}), 6) AS q{round(100 * p)}" for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) + " FROM v_annual GROUP BY ALL",
    "q18_variation": f"WITH {_annual(by='year, month')} SELECT station_idx, technology, round(stddev_samp(capacity_factor) / nullif(avg(capacity_factor), 0) * 100, 6) AS cv_pct FROM v_annual GROUP BY ALL HAVING count(*) > 1 AND avg(capacity_factor) <> 0",
    "q18b_correlation": f"""WITH {_annual(by='year, month')}, w AS (SELECT country, year, month, sum(generation_mwh) FILTER (technology = 'solar') AS a, sum(generation_mwh) FILTER (technology = 'wind') AS b FROM v_annual GROUP BY ALL)
        SELECT country, count(*) AS n, round(corr(a, b), 5) AS correlation FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY country HAVING count(*) >= 6 AND stddev_samp(a) > 0 AND stddev_samp(b) > 0""",
    "q19_kde": f"WITH {_annual()}, " + _KDE("technology, climate_ssp", "capacity_factor", "0.0::DOUBLE", "0.02::DOUBLE", 30, "v_annual"),
    "q19b_kde_log": f"WITH {_annual()}, " + _KDE("technology", "log10(generation_mwh)", "3.0::DOUBLE", "7.0::DOUBLE", 20, "(SELECT * FROM v_annual WHERE generation_mwh > 0)"),
    "q19d_nested_violins": f"""WITH {_annual()}, b AS (SELECT technology, climate_ssp, year, capacity_factor AS x FROM v_annual WHERE year IN (1996, 1998, 2000) AND (technology = 'solar' OR climate_ssp <> 'ssp245' OR station_idx < 3)),
        st AS (SELECT technology, climate_ssp, year, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM b GROUP BY ALL HAVING count(*) >= 3 AND stddev_samp(x) > 0),
        able AS (SELECT technology, climate_ssp FROM st GROUP BY ALL HAVING count(*) = 3), g AS (SELECT CAST(i AS INT) AS point, 0.0::DOUBLE + 0.02::DOUBLE * i / 29.0::DOUBLE AS x FROM range(30) AS r(i)),
        d AS (SELECT technology, climate_ssp, year, point, g.x AS x, n, h, sum(exp(-0.5 * pow((g.x - b.x) / h, 2))) / (n * h * sqrt(2 * pi())) AS density
            FROM st JOIN able USING (technology, climate_ssp) JOIN b USING (technology, climate_ssp, year) CROSS JOIN g GROUP BY technology, climate_ssp, year, point, g.x, n, h)
        SELECT technology, climate_ssp, year, point, round(x, 6) AS x, n, round(h, 6) AS bandwidth, round(density, 6) AS density,
               round(density * n / nullif(max(density * n) OVER (PARTITION BY technology, climate_ssp), 0) * 0.42::DOUBLE, 6) AS width FROM d""",
    "q20_linear_trend": f"""WITH {_annual()}, y AS (SELECT technology, climate_ssp, year, sum(generation_mwh) / 1e6 AS g FROM v_annual GROUP BY ALL)
        SELECT technology, climate_ssp, round(regr_slope(g, year), 5) AS slope, round(regr_intercept(g, year), 5) AS intercept, count(*) AS n, round(regr_slope(log10(g), year), 5) AS log_slope FROM y GROUP BY ALL""",
    "q21_pivot_change_vs_base": f"""WITH {_COUNTRY}, w AS (SELECT country, technology, climate_ssp, avg(mean_cf) FILTER (year = 1996) AS a, avg(mean_cf) FILTER (year = 1998) AS b, avg(mean_cf) FILTER (year = 2000) AS c FROM v_country GROUP BY ALL)
        SELECT country, technology, climate_ssp, round(a, 6) AS y1996, round(b, 6) AS y1998, round(c, 6) AS y2000, round((c - a) / nullif(a, 0) * 100, 6) AS change_pct FROM w""",
    "q21b_anomaly": f"""WITH {_COUNTRY}, b AS (SELECT country, technology, climate_ssp, year, mean_cf, max(mean_cf) FILTER (year = 1996) OVER (PARTITION BY country, technology, climate_ssp) AS base FROM v_country)
        SELECT country, technology, climate_ssp, year, round(mean_cf, 6) AS mean_cf, round(base, 6) AS base, round(mean_cf - base, 6) AS delta, round((mean_cf - base) / nullif(base, 0) * 100, 6) AS delta_pct FROM b""",
    "q22_period_increments": f"""WITH {_COUNTRY}, t AS (SELECT country, technology, climate_ssp, year, generation_mwh / 1e6 AS g FROM v_country), {_segments('country, technology, climate_ssp', 'g', 't')}
        SELECT country, technology, climate_ssp, round(seg_1996, 6) AS seg_1996, round(seg_1998, 6) AS seg_1998, round(seg_2000, 6) AS seg_2000, round(seg_1996 + seg_1998 + seg_2000, 6) AS total,
               round(CASE WHEN c > 0 THEN (seg_1996 + seg_1998 + seg_2000) / c ELSE 0 END, 6) AS relative_total FROM s""",
    "q22b_relative_to_member": f"""WITH {_COUNTRY}, t AS (SELECT country, climate_ssp, sum(generation_mwh) / 1e6 AS g FROM v_country WHERE year = 1998 GROUP BY ALL)
        SELECT t.country, t.climate_ssp, round(t.g, 6) AS generation_mwh, round(r.g, 6) AS reference, round(t.g / r.g * 100, 6) AS relative FROM t JOIN t r ON t.country = r.country AND r.climate_ssp = 'ssp126' AND r.g > 0""",
    "q22c_covered_increments": f"""WITH {_SITE}, {_AREAS}, {_inside('v_area')}, y AS (SELECT nation_key, CASE site_id % 3 WHEN 0 THEN 2030 WHEN 1 THEN 2040 ELSE 2050 END AS year, coalesce(sum(cap) FILTER (inside), 0) AS i, sum(cap) AS c FROM v_in GROUP BY ALL),
        w AS (SELECT nation_key, coalesce(max(i) FILTER (year = 2030), 0) AS a, coalesce(max(i) FILTER (year = 2040), 0) AS b, coalesce(max(i) FILTER (year = 2050), 0) AS c, coalesce(max(c) FILTER (year = 2050), 0) AS t FROM y GROUP BY ALL),
        s AS (SELECT nation_key, CASE WHEN t > 0 THEN a / t ELSE 0 END AS s1, CASE WHEN t > 0 THEN greatest(b - a, 0) / t ELSE 0 END AS s2, CASE WHEN t > 0 THEN greatest(c - b, 0) / t ELSE 0 END AS s3 FROM w)
        SELECT nation_key, round(s1, 6) AS seg_2030, round(s2, 6) AS seg_2040, round(s3, 6) AS seg_2050, round(s1 + s2 + s3, 6) AS coverage, 'n' || nation_key AS name,
               'n' || nation_key || CASE WHEN s1 + s2 + s3 > s1 + 0.02 THEN '↑' WHEN s1 + s2 + s3 < s1 - 0.02 THEN '↓' ELSE '' END AS label, s1 + s2 + s3 < 0.2 AS below FROM s""",
    "q23_topk_bottomk": f"""WITH {_COUNTRY}, t AS (SELECT country, sum(generation_mwh) / 1e6 AS g FROM v_country WHERE year = 1998 GROUP BY ALL)
        SELECT country, round(g, 6) AS generation_mwh, 'bottom' AS side FROM (SELECT * FROM t ORDER BY g, country LIMIT 8) UNION ALL SELECT country, round(g, 6), 'top' FROM (SELECT * FROM t ORDER BY g DESC, country LIMIT 8)""",
    "q23b_row_mean_order": f"""WITH {_COUNTRY}, w AS (SELECT country, avg(mean_cf) FILTER (climate_ssp = 'ssp126') AS a, avg(mean_cf) FILTER (climate_ssp = 'ssp245') AS b, avg(mean_cf) FILTER (climate_ssp = 'ssp585') AS c FROM v_country GROUP BY ALL),
        s AS (SELECT *, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS score FROM w)
        SELECT country, round(a, 6) AS ssp126, round(b, 6) AS ssp245, round(c, 6) AS ssp585, round(score, 6) AS score FROM s ORDER BY s.score DESC, country LIMIT 12""",
    "q24_quadrants": f"""WITH {_annual()}, p AS (SELECT * FROM v_annual WHERE capacity_mw > 0 AND capacity_factor > 0), m AS (SELECT median(capacity_mw) AS x, median(capacity_factor) AS y FROM p),
        q AS (SELECT climate_ssp, CASE WHEN capacity_mw >= x THEN 'high_' ELSE 'low_' END || CASE WHEN capacity_factor >= y THEN 'high' ELSE 'low' END AS quadrant, generation_mwh FROM p, m),
        g AS (SELECT climate_ssp, quadrant, count(*) AS n, sum(generation_mwh) AS w FROM q GROUP BY ALL)
        SELECT climate_ssp, quadrant, n, round(w, 6) AS weight, round(w / sum(w) OVER (PARTITION BY climate_ssp) * 100, 6) AS share_pct FROM g""",
    "q25_latitude_bins": f"""WITH {_SITE}, b AS (SELECT CAST(ceil((lat + 90.0::DOUBLE) / 10.0::DOUBLE) AS INT) AS bin, cap FROM v_site WHERE lat > -90),
        g AS (SELECT bin, count(*) AS n, quantile_cont(cap, 0.25) AS a, quantile_cont(cap, 0.5) AS b, quantile_cont(cap, 0.75) AS c FROM b GROUP BY bin)
        SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(a, 8) AS q25, round(b, 8) AS q50, round(c, 8) AS q75 FROM range(1, 19) AS r(i) LEFT JOIN g ON i = bin""",
    "q25b_decile_bins": f"""WITH {_SITE}, e AS (SELECT list_sort(list_distinct(quantile_cont(cap, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM v_site),
        b AS (SELECT CAST(greatest(len(list_filter(e, lambda x: x < cap)), 1) AS INT) AS bin, lat FROM v_site, e) SELECT bin, count(*) AS n, round(median(lat), 6) AS q50 FROM b GROUP BY bin""",
    "q26_exposure": f"""WITH {_RISK} SELECT country, technology, deploy_ssp, climate_ssp, target_year, event_type, round(sum(capacity_mw * exposed_hours), 2) AS exposed_capacity_mw_hours, round(sum(exposed), 6) AS exposed_generation_mwh,
        round(avg(exposed_hours), 6) AS mean_exposed_hours, round(avg(intensity), 6) AS mean_event_intensity_index FROM x GROUP BY ALL""",
    "q26b_losses": f"WITH {_RISK} SELECT country, technology, deploy_ssp, climate_ssp, target_year, event_type, {_R4('capacity_mw', 'annual_generation_mwh', 'exposed_generation_mwh', 'loss_mwh')}, {_RATES} FROM c",
    "q27_ssp_decomposition": f"""WITH {_annual(_BOTH)}, t AS (SELECT country, technology, year, climate_ssp AS w, deploy_ssp AS p, sum(generation_mwh) / 1e6 AS v FROM v_annual WHERE year IN (1996, 1998, 2000) GROUP BY ALL),
        k AS (SELECT DISTINCT country, technology, year FROM t), z AS (SELECT k.*, s.s AS target_ssp, max(v) FILTER (w = 'ssp126' AND p = 'ssp126') AS base, max(v) FILTER (w = s.s AND p = s.s) AS tt, max(v) FILTER (w = s.s AND p = 'ssp126') AS tc, max(v) FILTER (w = 'ssp126' AND p = s.s) AS td
            FROM k JOIN t USING (country, technology, year), (VALUES ('ssp245'), ('ssp585')) s(s) GROUP BY ALL)
        SELECT country, technology, year, 'ssp126' AS reference_ssp, 'loss' AS risk_metric, target_ssp, round(base, 6) AS baseline_risk, round(tt, 6) AS target_total_risk, round(tt - base, 6) AS total_change,
               round(tc - base, 6) AS climate_effect, round(td - base, 6) AS deployment_effect, round((tt - base) - (tc - base) - (td - base), 6) AS interaction_effect FROM z""",
    "q27b_risk_matrix": f"""WITH {_RISK} SELECT country, technology, target_year, climate_ssp, deploy_ssp, {_R4('capacity_mw', 'annual_generation_mwh', 'loss_mwh')}, round(loss_mwh / nullif(annual_generation_mwh, 0), 4) AS loss_rate,
        round(loss_mwh / nullif(capacity_mw, 0), 4) AS unit_capacity_loss_mwh_per_mw, round(loss_mwh / nullif(annual_generation_mwh / 1000, 0), 4) AS unit_generation_loss_mwh_per_gwh FROM m""",
    "q28_risk_class": f"""WITH {_COUNTRY}, w AS (SELECT *, median(generation_mwh) OVER g AS gm, median(mean_cf) OVER g AS rm FROM v_country WINDOW g AS (PARTITION BY climate_ssp, year))
        SELECT country, technology, climate_ssp, year, round(capacity_mw, 6) AS capacity_mw, round(generation_mwh, 6) AS generation_mwh, round(mean_cf, 6) AS mean_cf,
               CASE WHEN generation_mwh >= gm THEN 'high' ELSE 'low' END || '_generation_' || CASE WHEN mean_cf >= rm THEN 'high' ELSE 'low' END || '_risk' AS risk_class FROM w""",
    "q28b_country_profile": f"""WITH {_RISK}, p AS (SELECT country, climate_ssp AS ssp, target_year, sum(capacity_mw) AS capacity_mw, sum(annual_generation_mwh) AS annual_generation_mwh, sum(loss_mwh) AS loss_mwh FROM m WHERE climate_ssp = deploy_ssp GROUP BY ALL),
        r AS (SELECT *, loss_mwh / nullif(annual_generation_mwh, 0) AS rate FROM p), w AS (SELECT *, median(annual_generation_mwh) OVER g AS gm, median(rate) OVER g AS rm FROM r WINDOW g AS (PARTITION BY ssp, target_year))
        SELECT country, ssp, target_year, {_R4('capacity_mw', 'annual_generation_mwh', 'loss_mwh')}, round(rate, 4) AS loss_rate, round(loss_mwh / nullif(capacity_mw, 0), 4) AS unit_capacity_loss_mwh_per_mw,
               CASE WHEN annual_generation_mwh >= gm THEN 'high' ELSE 'low' END || '_generation_' || CASE WHEN rate >= rm THEN 'high' ELSE 'low' END || '_risk' AS risk_class FROM w""",
    "q29_event_contribution": """WITH e AS (SELECT user_id % 25 AS grp, event_type, sum(value) AS v FROM events GROUP BY ALL)
        SELECT grp, event_type, round(v, 6) AS value, round(sum(v) OVER (PARTITION BY grp), 6) AS total, round(v / nullif(sum(v) OVER (PARTITION BY grp), 0), 6) AS share FROM e""",
    "q29b_technology_vulnerability": f"""WITH {_RISK}, v AS (SELECT country, climate_ssp AS ssp, target_year, technology, sum(capacity_mw) AS capacity_mw, sum(annual_generation_mwh) AS annual_generation_mwh, sum(exposed_generation_mwh) AS exposed_generation_mwh, sum(loss_mwh) AS loss_mwh
        FROM c WHERE climate_ssp = deploy_ssp GROUP BY ALL) SELECT country, ssp, target_year, technology, {_R4('capacity_mw', 'annual_generation_mwh', 'exposed_generation_mwh', 'loss_mwh')}, {_RATES} FROM v""",
    "q30_window_delta": """WITH o AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS y, o_totalprice AS v FROM orders),
        g AS (SELECT o_orderpriority, o_orderstatus, avg(v) FILTER (y BETWEEN 1995 AND 1996) AS b, avg(v) FILTER (y BETWEEN 1998 AND 2000) AS t FROM o GROUP BY ALL)
        SELECT o_orderpriority, o_orderstatus, round(b, 4) AS base, round(t, 4) AS target, round(t - b, 4) AS change FROM g WHERE b IS NOT NULL AND t IS NOT NULL""",
    "q31_pv_density": f"""WITH {_SITE}, t AS (SELECT *, radians(0.35396 * abs(lat) + 16.84775) AS be, radians(greatest(90.0 - abs(lat) - 23.45, 0.1)) AS al FROM v_at),
        d AS (SELECT *, 161.9::DOUBLE * 0.15 * cos(be) / (cos(be) + sin(be) / tan(al)) AS pv FROM t)
        SELECT site_id, round(lon360, 6) AS lon360, round((((lon * 2.0 + 180.0) % 360.0 + 360.0) % 360.0) - 180.0, 6) AS lon180, round(pv, 6) AS pv_density, round(cap * 1e6 / 1e6 * pv / 1000, 6) AS polygon_gw, round(0.0023552::DOUBLE, 6) AS turbine_gw,
               round(CASE WHEN technology = 'solar' THEN 74.0 WHEN cap * 20.0 > 100 THEN 4.6 ELSE 2.7 END::DOUBLE * 0.4 * (abs(cap) * 100.0) / 1000, 6) AS grid_gw,
               round(degrees(lon * 100000.0 / 6378137.0), 6) AS x, round(degrees(2 * atan(exp(lat * 100000.0 / 6378137.0)) - pi() / 2), 6) AS y FROM d""",
    "q32_ssp_normaliser": f"""WITH e AS (SELECT list_value({", ".join("'" + x + "'" for x in views.SPELLINGS)}) AS l), p AS (SELECT p_partkey AS part, l[p_partkey % {len(views.SPELLINGS)} + 1] AS spelt, regexp_replace(p_name, '[0-9]', '', 'g') AS rest FROM part, e),
        n AS (SELECT part, spelt || ' ' || rest AS name, 'results/' || CASE WHEN part % 2 = 0 THEN spelt ELSE 'all' END || '/stations_' || part || '.csv' AS path FROM p),
        f AS (SELECT *, regexp_extract(lower(path), '(ssp[0-9.\\-]+)', 1) AS found FROM n)
        SELECT part, {_code('name')} AS code, CASE WHEN found <> '' THEN {_code('found')} ELSE CAST(part AS VARCHAR) END AS path_code FROM f""",
    "q33_set_difference": """WITH rich AS (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 7000)
        SELECT n_name, 'missing' AS side FROM (SELECT n_name FROM nation EXCEPT SELECT n_name FROM rich) UNION ALL SELECT n_name, 'common' FROM (SELECT n_name FROM nation INTERSECT SELECT n_name FROM rich)""",
    "q34_matrix_deviation": f"""WITH {_annual(_BOTH)}, g AS (SELECT {_BOTH}, sum(capacity_mw * capacity_factor) / sum(capacity_mw) AS w FROM v_annual GROUP BY ALL)
        SELECT {_BOTH}, round(w, 5) AS weighted_cf, round((w / avg(w) OVER (PARTITION BY technology) - 1) * 100, 5) AS deviation_pct FROM g""",
    "q34b_pair_difference": f"""WITH {_annual(by='year, month')}, g AS (SELECT technology, climate_ssp, month, sum(capacity_mw * capacity_factor) / sum(capacity_mw) AS w FROM v_annual GROUP BY ALL)
        SELECT technology, month, round(avg(w) FILTER (climate_ssp = 'ssp126'), 6) AS m_ssp126, round(avg(w) FILTER (climate_ssp = 'ssp585'), 6) AS m_ssp585,
               round(avg(w) FILTER (climate_ssp = 'ssp585') - avg(w) FILTER (climate_ssp = 'ssp126'), 6) AS difference FROM g GROUP BY ALL""",
    "q35_status_share_by_country": f"""WITH {_POWER}, {_STATION} SELECT CASE WHEN country < 'M' THEN country ELSE 'outside' END AS country, count(*) AS n, count(*) FILTER (power IS NULL OR power = 0) AS n_bad,
        round(count(*) FILTER (power IS NULL OR power = 0) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM v_power JOIN v_station USING (station_idx) GROUP BY ALL""",
    "q36_projection_filters": f"""WITH {_POWER} SELECT 'S' || right(climate_ssp, 3) || '_region_' || lpad(CAST(station_idx AS VARCHAR), CAST(greatest(5, length(CAST(station_idx AS VARCHAR))) AS INT), '0') AS station_id,
        CASE WHEN year + 34 <= 2030 THEN 2030 WHEN year + 34 <= 2040 THEN 2040 ELSE 2050 END AS bucket, count(*) AS n, count(*) FILTER (power = 0) AS n_zero
        FROM v_power WHERE technology = 'solar' AND climate_ssp IN ('ssp126', 'ssp585') AND year BETWEEN 1996 AND 1999 GROUP BY ALL""",
    "q37_value_counts": f"WITH {_POWER} SELECT technology, climate_ssp, count(*) AS n, count(DISTINCT station_idx) AS n_stations FROM v_power WHERE climate_ssp <> 'ssp245' AND power IS NOT NULL GROUP BY ALL",
    "q38_padded_range": f"""WITH {_annual()}, r AS (SELECT technology, min(log10(generation_mwh)) AS a, max(log10(generation_mwh)) AS b FROM v_annual WHERE generation_mwh > 0 GROUP BY ALL)
        SELECT technology, round(a - (b - a) * 0.08, 6) AS low, round(b + (b - a) * 0.08, 6) AS high FROM r""",
    "q39_boundary_points": f"""WITH {_SITE}, d AS (SELECT nation_key, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM v_site GROUP BY ALL),
        p AS (SELECT *, CAST(side AS INT) AS sd, CAST(k AS INT) AS st, k / 24.0::DOUBLE AS f FROM d, range(4) a(side), range(25) b(k))
        SELECT nation_key, sd AS side, st AS step, round(CASE sd WHEN 0 THEN w + (e - w) * f WHEN 1 THEN e WHEN 2 THEN e + (w - e) * f ELSE w END, 6) AS lon, round(CASE sd WHEN 0 THEN n WHEN 1 THEN n + (s - n) * f WHEN 2 THEN s ELSE s + (n - s) * f END, 6) AS lat FROM p""",
    "q40_cell_centres": f"""WITH {_SITE}, c AS (SELECT CAST(least(greatest(floor(90.0::DOUBLE - lat), 0), 179) AS INT) AS row, CAST(least(greatest(floor(lon + 180.0::DOUBLE), 0), 359) AS INT) AS col, count(*) AS n FROM v_site GROUP BY ALL)
        SELECT row, col, n, col - 179.5::DOUBLE AS lon, 89.5::DOUBLE - row AS lat, col * 180 + row AS rank FROM c""",
    "q41_multipliers": f"""WITH {_POWER}, {_STATION}, s AS (SELECT * FROM {_values([(s, K.DEPLOY_SSP_FACTOR[s], K.HAZARD_SSP_FACTOR[s], K.CF_SSP_EFFECT['solar'][s], K.CF_SSP_EFFECT['wind'][s]) for s in K.SSPS], 'ssp, d, h, cs, cw')}),
        y AS (SELECT * FROM {_values([(y, K.DEPLOY_YEAR_FACTOR[y], K.YEAR_PROGRESS[y]) for y in K.YEARS], 'year, f, p')}), m AS (SELECT * FROM {_values([(i, n) for i, n in enumerate(K.DAYS_IN_MONTH, 1)], 'month, days')}),
        g AS (SELECT country, technology, climate_ssp AS ssp, month, sum(power) AS w FROM v_power JOIN v_station USING (station_idx) GROUP BY ALL),
        x AS (SELECT n_name AS country, technology, ssp, year, month, days, d, h, cs, cw, f, p FROM nation, (SELECT DISTINCT technology FROM g), (SELECT DISTINCT month FROM g) JOIN m USING (month) JOIN y ON y.year = [2030, 2040, 2050][month % 3 + 1], s WHERE ssp IN (SELECT ssp FROM g)),
        v AS (SELECT x.*, coalesce(w, 0) AS w FROM x LEFT JOIN g USING (country, technology, ssp, month))
        SELECT country, ssp, year, technology, month, round(f * d, 6) AS deployment, round(1 + (h - 1) * p, 6) AS hazard, round(1 + CASE technology WHEN 'solar' THEN cs ELSE cw END * p, 6) AS cf,
               round(CASE technology WHEN 'solar' THEN 1 + 0.18 * sin((month - 3) / 12.0 * 2 * pi()) ELSE 1 + 0.12 * cos((month - 1) / 12.0 * 2 * pi()) END, 6) AS season, days, round(1 / (1 + exp(-(w / 100.0::DOUBLE))), 6) AS sigmoid,
               round(w * 8760 * 0.25, 6) AS generation FROM v""",
    "q36b_zero_cf_stations": f"""WITH {_POWER}, {_STATION}, p AS (SELECT *, CASE WHEN power > 0.02 * month THEN 0 * power END AS v FROM v_power WHERE year = 1999),
        t AS (SELECT technology, climate_ssp, station_idx FROM p GROUP BY ALL HAVING count(v) > 0 AND sum(v) = 0)
        SELECT technology, climate_ssp, station_idx, CASE WHEN active <= 2030 THEN 2030 WHEN active <= 2040 THEN 2040 ELSE 2050 END AS bucket FROM t JOIN v_station USING (station_idx) WHERE cap > 0 AND active <= 1999""",
    "q36c_missing_mask": f"""WITH {_POWER}, m AS (SELECT station_idx, technology, year, avg(power) FILTER (month > 6) IS NULL AS gone FROM v_power GROUP BY ALL)
        SELECT technology, year, count(*) FILTER (gone) AS n_missing, count(*) AS n FROM m GROUP BY ALL""",
    "q09b_named_polygons": f"""WITH {_SITE}, {_POLY}, w AS (SELECT CASE name WHEN 'inner' THEN 0 ELSE 1 END AS place, CASE name WHEN 'kite' THEN 'dragon' ELSE name END AS called, x1, y1, x2, y2 FROM e WHERE name IN ('inner', 'kite')), t AS (
        SELECT site_id, place, called, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd,
               bool_or((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge
        FROM v_site CROSS JOIN w GROUP BY ALL)
        SELECT site_id, coalesce(arg_min(called, place) FILTER (odd AND NOT edge), arg_min(called, place) FILTER (edge)) AS polygon FROM t GROUP BY site_id""",
    "q19c_kde_own_peak": f"WITH {_COUNTRY}, d AS (WITH " + _KDE("country, technology", "mean_cf", "0.0::DOUBLE", "0.02::DOUBLE", 30, "v_country", 2) + ") SELECT *, round(density / nullif(max(density) OVER (PARTITION BY country, technology), 0), 6) AS share FROM d",
    "q20b_median_trend": f"""WITH {_annual()}, m AS (SELECT technology, climate_ssp, year, quantile_cont(capacity_factor, 0.5) AS q FROM v_annual WHERE capacity_factor > 0 AND year IN (1996, 1998, 2000) GROUP BY ALL),
        p AS (SELECT *, CASE climate_ssp WHEN 'ssp126' THEN 0 WHEN 'ssp245' THEN 1 ELSE 2 END AS x FROM m)
        SELECT technology, round(regr_slope(q, x), 6) AS slope, round(regr_intercept(q, x), 6) AS intercept, count(*) AS n, round(regr_slope(log10(q), x), 6) AS log_slope, round(regr_intercept(log10(q), x), 6) AS log_intercept, count(*) AS log_n,
               round(regr_slope(q, x) FILTER (year = 2000), 6) AS last_slope, round(regr_intercept(q, x) FILTER (year = 2000), 6) AS last_intercept, count(*) FILTER (year = 2000) AS last_n FROM p GROUP BY technology""",
    "q38b_shared_limits": f"WITH {_annual()} SELECT round(min(capacity_factor) * 0.92::DOUBLE, 6) AS capacity_factor_low, round(max(capacity_factor) * 1.05::DOUBLE, 6) AS capacity_factor_high, round(min(capacity_mw) * 0.8::DOUBLE, 6) AS capacity_mw_low, round(max(capacity_mw) * 1.25::DOUBLE, 6) AS capacity_mw_high FROM v_annual",
    "q44_coverage_report": f"""WITH {_SITE}, {_AREAS}, {_inside('v_area')}, d AS (SELECT *, CASE site_id % 3 WHEN 0 THEN 2030 WHEN 1 THEN 2040 ELSE 2050 END AS year FROM v_in), c AS (SELECT year, coalesce(technology, 'ALL') AS technology, {_COVER} FROM d GROUP BY GROUPING SETS ((year, technology), (year)))
        SELECT * REPLACE (round(n_cover_ratio, 4) AS n_cover_ratio, round(cap_cover_ratio, 4) AS cap_cover_ratio) FROM c""",
    "q44b_grid_report": f"""WITH {_SITE}, {_CELL}, p AS (SELECT *, CAST(floor((90.0::DOUBLE - lat) / 10.0::DOUBLE) AS INT) AS row, CAST(floor(lon360 / 10.0::DOUBLE) AS INT) AS col FROM v_at),
        o AS (SELECT row, col, sum(cap) AS cap, bool_or(technology = 'solar') AS s, bool_or(technology = 'wind') AS w, bool_or(cap > 5) AS k FROM p GROUP BY ALL), r AS (SELECT * FROM {_values(list(enumerate(K.MACRO_REGIONS, 1)), 'region_id, region_name')}),
        g AS (SELECT region_id, count(*) AS n_cells, count(*) FILTER (s) AS n_solar, count(*) FILTER (w) AS n_wind, count(*) FILTER (s OR w) AS n_any, count(*) FILTER (k) AS n_covered, coalesce(sum(cap), 0) AS capacity_gw FROM v_cell LEFT JOIN o USING (row, col) WHERE region_id > 0 GROUP BY region_id)
        SELECT CAST(region_id AS VARCHAR) AS region_id, region_name, n_cells, n_solar, n_wind, n_any, n_covered, round(capacity_gw, 5) AS capacity_gw FROM g JOIN r USING (region_id)
        UNION ALL SELECT 'ALL', '', sum(n_cells)::BIGINT, sum(n_solar)::BIGINT, sum(n_wind)::BIGINT, sum(n_any)::BIGINT, sum(n_covered)::BIGINT, round(sum(capacity_gw), 5) FROM g""",
    "q44c_ratio_report": f"""WITH {_POWER}, {_STATION}, p AS (SELECT *, power IS NULL OR power = 0 AS bad FROM v_power), f AS (SELECT * FROM (VALUES ('national', 'ssp126'), ('all', 'ssp126'), ('all', 'ssp245'), ('all', 'ssp585')) t(name, climate_ssp))
        SELECT 'status' AS kind, technology AS name, count(*) AS n, count(*) FILTER (bad) AS n_bad, round(count(*) FILTER (bad) / CAST(count(*) AS DOUBLE), 4) AS ratio FROM p GROUP BY ALL
        UNION ALL SELECT 'country', country, count(*), count(*) FILTER (bad), round(count(*) FILTER (bad) / CAST(count(*) AS DOUBLE), 4) FROM p JOIN v_station USING (station_idx) GROUP BY ALL
        UNION ALL SELECT 'family', name, count(*), count(*) FILTER (bad), round(count(*) FILTER (bad) / CAST(greatest(count(*), 1) AS DOUBLE), 4) FROM p JOIN f USING (climate_ssp) GROUP BY ALL""",
    "q44d_station_selection": f"WITH {_SITE} SELECT CASE site_id % 3 WHEN 0 THEN 2030 WHEN 1 THEN 2040 ELSE 2050 END AS year, technology AS type, printf('%.1f', lon) AS lon, printf('%.1f', lat) AS lat, printf('%.4f', floor(cap * 64.0::DOUBLE) / 64.0::DOUBLE + 0.00001::DOUBLE) AS capacity_gw FROM v_site",
    "q45c_chosen_files": f"""WITH {_COUNTRY}, c AS (SELECT * FROM (VALUES ('last', 1998), ('covers', 1998), ('none_covers', 1996)) t(choice, year))
        SELECT choice, technology AS energy, climate_ssp AS scenario, year, count(*) AS n, round(avg(mean_cf), 6) AS mean_cf FROM v_country JOIN c USING (year) GROUP BY ALL""",
    "q46_published_rounding": """WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT q, n, CAST(round_even(q + 0.5, 0) AS DOUBLE) AS whole, CAST(round_even(q / 8, 2) AS DOUBLE) AS hundredths, CAST(round_even(q / 32 * -1, 4) AS DOUBLE) AS negative, CAST(round_even(q / 16, 3) AS DOUBLE) AS thousandths FROM t""",
    "q46b_published_tables": f"WITH {_annual()} SELECT technology, climate_ssp, year, station_idx, country, n_steps, CAST(round_even(capacity_mw, 4) AS DOUBLE) AS capacity_mw, CAST(round_even(capacity_factor, 6) AS DOUBLE) AS capacity_factor, CAST(round_even(generation_mwh, 3) AS DOUBLE) AS generation_mwh FROM v_annual",
    "q47_power_files": f"WITH {_annual()} SELECT technology, climate_ssp, year, {_Q01_COLUMNS} FROM v_annual",
    "q48_station_files": f"""WITH {_SITE}, d AS (SELECT *, CASE site_id % 3 WHEN 0 THEN 2030 WHEN 1 THEN 2040 ELSE 2050 END AS own_year FROM v_site),
        r AS (SELECT CASE WHEN site_id % 7 = 0 THEN 'tidal' ELSE technology END AS type, CASE WHEN site_id % 11 = 0 THEN 2035 ELSE own_year END AS year, lon, CASE WHEN site_id % 5 = 0 THEN 0 ELSE cap END AS cap FROM d),
        k AS (SELECT * FROM r WHERE type IN ('solar', 'wind') AND year IN (2030, 2040, 2050))
        SELECT type, CAST(year AS INT) AS year, count(*) AS n, round(sum(cap), 6) AS capacity_gw, round(min(lon), 6) AS west, 'all' AS choice FROM k GROUP BY ALL
        UNION ALL SELECT type, CAST(year AS INT), count(*), round(sum(cap), 6), round(min(lon), 6), 'one' FROM k WHERE year = 2040 GROUP BY ALL""",
    "q48b_plain_files": f"WITH {_SITE} SELECT technology, count(*) AS n, count(*) FILTER (site_id % 3 > 0) AS n_area, round(sum(site_id * 10.0::DOUBLE) FILTER (site_id % 3 > 0), 4) AS area_m2, round(sum(cap), 4) AS capacity_gw FROM v_site GROUP BY technology",
    "q49_zero_denominators": """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount <> 0) AS n_null, count(*) FILTER (l_discount <> 0) AS n_change,
        round(avg(CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount ELSE 0 END), 4) AS zero, round(avg(l_extendedprice / l_discount) FILTER (l_discount <> 0), 4) AS "null",
        round(avg(l_extendedprice / greatest(l_discount, 1)), 4) AS floor, round(avg((l_extendedprice - l_discount) / l_discount * 100) FILTER (l_discount <> 0), 4) AS change FROM lineitem GROUP BY ALL""",
    "q49b_single_precision": f"WITH {_annual().replace('l_discount * l_quantity END AS power', 'CAST(CAST(l_discount * l_quantity AS FLOAT) AS DOUBLE) END AS power')} SELECT country, technology, round(sum(generation_mwh), 2) AS generation_mwh FROM v_annual GROUP BY ALL",
    "q45_model_files": f"""WITH {_COUNTRY}, b AS (SELECT technology, year, avg(mean_cf) AS base FROM v_country WHERE climate_ssp = 'ssp126' GROUP BY ALL), m AS (SELECT climate_ssp, technology, year, count(*) AS n, avg(mean_cf) AS cf FROM v_country GROUP BY ALL)
        SELECT climate_ssp AS model, technology AS energy, year, n, round(cf, 6) AS mean_cf, round(base, 6) AS base_cf FROM m LEFT JOIN b USING (technology, year)""",
    "q45b_region_files": f"""WITH {_SITE}, {_AREAS}, {_inside('v_area')}, d AS (SELECT *, CASE site_id % 3 WHEN 0 THEN 2030 WHEN 1 THEN 2040 ELSE 2050 END AS year FROM v_in), c AS (SELECT year, nation_key AS region_id, {_COVER} FROM d GROUP BY ALL)
        SELECT * RENAME (cap_total AS cap_total_gw, cap_inside AS cap_inside_gw) FROM c""",
    "q43_value_by_family": f"""WITH {_SITE}, {_CELL}, g AS (
            SELECT 'even' AS grid_id, row // 2 AS ilat, col AS ilon, 85.0::DOUBLE - 10 * row AS y, 5.0::DOUBLE + 10 * col AS x, region_id FROM v_cell WHERE row % 2 = 0
            UNION ALL SELECT 'third', row, col // 3, 85.0::DOUBLE - 10 * row, 10.0::DOUBLE * col, region_id FROM v_cell WHERE col % 3 = 0
        ), b AS (SELECT row, col, 84.0::DOUBLE - 10.0 * row + 0.07::DOUBLE * col AS y, 4.0::DOUBLE + 9.5 * col + 0.11::DOUBLE * row AS x, region_id FROM v_cell
        ), p AS (SELECT site_id, lat, lon360, CASE site_id % 4 WHEN 0 THEN 'even' WHEN 1 THEN 'third' WHEN 2 THEN 'bent' ELSE 'none' END AS grid_id FROM v_at
        ), r AS (
            SELECT site_id, arg_min(region_id, struct_pack(a := abs(y - lat), i := ilat, o := least(abs(x - lon360), 360 - abs(x - lon360)), j := ilon)) AS v FROM p JOIN g USING (grid_id) GROUP BY site_id
            UNION ALL SELECT site_id, arg_min(region_id, struct_pack(d := pow(y - lat, 2) + pow(CASE WHEN x >= 360 THEN x - 360 ELSE x END - lon360, 2), r := row, c := col)) FROM p, b WHERE grid_id = 'bent' GROUP BY site_id)
        SELECT site_id, grid_id, CAST(v AS DOUBLE) AS value FROM p LEFT JOIN r USING (site_id)""",
}
