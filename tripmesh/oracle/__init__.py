"""Reference answers in plain SQL for each registered query (DuckDB dialect).

Inputs are rebuilt from ``events``. Nothing here shares a method with the Spark
side where that would hide a mistake: brackets come from all candidate rows, and
per-minute totals from every flight at every minute.
"""

from __future__ import annotations

import re
from functools import cache

from tripmesh.config import POLLUTANTS, PRICED, suffixed
from tripmesh.plans.fixtures import AIRPORTS, ARRIVALS, CCD_DURATIONS, DEPARTURES

ZONE = "Australia/Sydney"
MASS, SUM, DEGREES, METRES, MONEY = 3, 3, 5, 3, 2


def rounded(expr: str, name: str, digits: int = MASS) -> str:
    return f"round(({expr}) + 1e-{digits + 4}, {digits}) AS {name}"


def each(template: str, names=POLLUTANTS, sep: str = ", ") -> str:
    return sep.join(template.format(p=p) for p in names)


def masses(names=POLLUTANTS, digits: int = MASS) -> str:
    return ", ".join(rounded(n, n, digits) for n in names)


def text_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def local(seconds: str) -> str:
    return f"timezone('{ZONE}', to_timestamp({seconds}))"


def midnight(day: str) -> str:
    return f"(epoch_us(timezone('{ZONE}', CAST({day} AS TIMESTAMP))) // 1000000)"


def draw(place: str, first_digit: int) -> str:
    digest = f"md5(concat_ws('|', icao24, dep_s, '{place}'))"
    return f"(CAST('0x' || substr({digest}, {first_digit}, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def jitter(place: str, axis: str, scale: float) -> str:
    return f"(({draw(place, 1 if axis == 'lat' else 14)} - 0.5::DOUBLE) * 2 * {scale}::DOUBLE)"


ROUTE_IDS = ", ".join(f"'{a[2]}'" for a in AIRPORTS)
PASSENGER_IDS = ", ".join(f"'{a[2]}'" for a in AIRPORTS if a[0] != "Canberra")
FLIGHT = "CAST(day AS VARCHAR) AS day, icao24, dep_s, arr_s, dep_airport, arr_airport"
BOTH_SUFFIXES = suffixed("lto") + suffixed("ccd")

TABLES = {
    "ev": "SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events",
    "base": f"""
        SELECT event_id,
            'ac' || lpad(CAST(user_id AS VARCHAR), greatest(4, length(CAST(user_id AS VARCHAR)))::INT, '0')
                AS icao24,
            s AS "firstSeen",
            s + 2400 + (event_id * 37) % 6000 AS "lastSeen",
            ({text_list(DEPARTURES)})[(user_id * 7 + event_id) % 5 + 1] AS "estDepartureAirport",
            ({text_list(ARRIVALS)})[(event_id * 5 + event_id // 7) % 6 + 1] AS "estArrivalAirport"
        FROM ev""",
    "raw": """
        SELECT * EXCLUDE (event_id) FROM base
        UNION ALL SELECT * EXCLUDE (event_id) FROM base WHERE event_id % 10 = 0""",
    "clean": f"""
        SELECT *, arr_s - dep_s AS duration_s, {local('dep_s')} AS dep_local,
            {local('arr_s')} AS arr_local, CAST({local('arr_s')} AS DATE) AS day
        FROM (SELECT DISTINCT icao24, "firstSeen" AS dep_s, "lastSeen" AS arr_s,
                "estDepartureAirport" AS dep_airport, "estArrivalAirport" AS arr_airport
            FROM raw WHERE "estArrivalAirport" IS NOT NULL)""",
    "hourly": "SELECT day, hour(arr_local) AS hour, count(*) AS flights FROM clean GROUP BY 1, 2",
    "midday": "SELECT * FROM hourly WHERE hour BETWEEN 8 AND 13",
    "interior": """
        SELECT * FROM hourly
        WHERE day > (SELECT min(day) FROM clean) AND day < (SELECT max(day) FROM clean)""",
    "chosen": "SELECT min(day) AS day FROM interior",
    "route": f"""
        SELECT * FROM clean WHERE dep_airport IN ({ROUTE_IDS}) AND arr_airport IN ({ROUTE_IDS})
            AND dep_airport <> arr_airport""",
    "utc_departures": f"""
        SELECT dep_airport, CAST(to_timestamp(dep_s) AT TIME ZONE 'UTC' AS DATE) AS utc_date FROM clean
        WHERE dep_airport IN ({ROUTE_IDS})""",
    "windows": """
        SELECT CAST(unnest(range(min(utc_date), max(utc_date), INTERVAL 1 DAY)) AS DATE) AS window_start
        FROM utc_departures""",
    "register": """
        SELECT icao24, typecode FROM (
            SELECT 'ac' || lpad(CAST(user_id AS VARCHAR), greatest(4, length(CAST(user_id AS VARCHAR)))::INT, '0')
                AS icao24,
                CASE WHEN user_id % 13 = 0 THEN NULL
                    ELSE 'T' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') END AS typecode
            FROM (SELECT DISTINCT user_id FROM ev) WHERE user_id % 17 <> 16
            UNION ALL
            SELECT 'ac' || lpad(CAST(user_id AS VARCHAR), greatest(4, length(CAST(user_id AS VARCHAR)))::INT, '0'),
                'T' || lpad(CAST((user_id + 1) % 12 AS VARCHAR), 2, '0')
            FROM (SELECT DISTINCT user_id FROM ev) WHERE user_id % 19 = 18 AND user_id % 17 <> 16)""",
    "types": "SELECT n, n % 8 AS j FROM range(10) t(n) UNION ALL SELECT 3, 7",
    "curve": f"""
        SELECT 'T' || lpad(CAST(n AS VARCHAR), 2, '0') AS typecode, 'A' || j AS aircraft_id,
            CASE WHEN ref_s IS NULL THEN 'LTO' ELSE 'CCD' END AS phase, ref_s,
            {', '.join(
                f"CASE WHEN ref_s IS NULL THEN {25 + 2.5 * k}::DOUBLE + j ELSE {100 + 10 * k} * ((1 + j)"
                f" * ((ref_s::DOUBLE / 3600) * (ref_s::DOUBLE / 3600))) END AS {p}"
                for k, p in enumerate(POLLUTANTS))}
        FROM types, (SELECT unnest([{', '.join(map(str, CCD_DURATIONS))}, NULL]::BIGINT[]) AS ref_s)
        WHERE ref_s IS NOT NULL OR j <> 6""",
    "airports": "SELECT * FROM (VALUES "
    + ", ".join(f"('{a[0]}', '{a[2]}', {a[4]!r}::DOUBLE, {a[5]!r}::DOUBLE)" for a in AIRPORTS)
    + ") t(name, airport, latitude, longitude)",
    "typed": "SELECT r.*, typecode FROM route r LEFT JOIN register USING (icao24)",
    "named": """
        SELECT t.*, aircraft_id FROM typed t
        LEFT JOIN (SELECT DISTINCT typecode, aircraft_id FROM curve) USING (typecode)""",
    "with_lto": f"""
        SELECT n.*, {each('c.{p} AS {p}_lto')} FROM named n
        LEFT JOIN (SELECT * FROM curve WHERE phase = 'LTO') c ON c.aircraft_id = n.aircraft_id""",
    "pairs": "SELECT DISTINCT aircraft_id, duration_s FROM named WHERE aircraft_id IS NOT NULL",
    "hi": f"""
        SELECT * FROM (
            SELECT p.aircraft_id, duration_s, ref_s AS ref_hi_s, {each('{p} AS {p}_hi')},
                row_number() OVER (PARTITION BY p.aircraft_id, duration_s ORDER BY ref_s, {each('{p}')}) AS rn
            FROM pairs p JOIN curve c ON c.aircraft_id = p.aircraft_id AND ref_s >= duration_s)
        WHERE rn = 1""",
    "lo": f"""
        SELECT * FROM (
            SELECT p.aircraft_id, duration_s, ref_s AS ref_lo_s, {each('{p} AS {p}_lo')},
                row_number() OVER (PARTITION BY p.aircraft_id, duration_s ORDER BY ref_s DESC, {each('{p}')}) AS rn
            FROM pairs p JOIN curve c ON c.aircraft_id = p.aircraft_id AND ref_s <= duration_s)
        WHERE rn = 1""",
    "brackets": f"""
        SELECT p.*, ref_hi_s, ref_lo_s, {each('{p}_hi')}, {each('{p}_lo')} FROM pairs p
        LEFT JOIN hi USING (aircraft_id, duration_s) LEFT JOIN lo USING (aircraft_id, duration_s)""",
    "factors": """
        SELECT *, CASE WHEN ref_hi_s = ref_lo_s THEN 0::DOUBLE
            ELSE (duration_s - ref_hi_s)::DOUBLE / (ref_lo_s - ref_hi_s) END AS factor
        FROM brackets""",
    "ccd": f"""
        SELECT aircraft_id, duration_s, ref_hi_s, ref_lo_s, factor,
            {each('{p}_hi + factor * ({p}_lo - {p}_hi) AS {p}_ccd')}
        FROM factors""",
    "unfilled": """
        SELECT w.*, c.* EXCLUDE (aircraft_id, duration_s) FROM with_lto w
        LEFT JOIN ccd c ON c.aircraft_id = w.aircraft_id AND c.duration_s = w.duration_s""",
    "means": f"SELECT day, {each('avg({p}) AS {p}_mean', BOTH_SUFFIXES)} FROM unfilled GROUP BY day",
    "emitted": f"""
        SELECT u.* EXCLUDE ({each('{p}', BOTH_SUFFIXES)}),
            {each('coalesce({p}, {p}_mean) AS {p}', BOTH_SUFFIXES)}
        FROM unfilled u JOIN means USING (day)""",
    "pax": f"""
        SELECT day, count(*) FILTER (WHERE CAST(dep_local AS DATE) = day
                AND dep_airport IN ({PASSENGER_IDS}) AND arr_airport IN ({PASSENGER_IDS})) AS passenger_flights
        FROM route GROUP BY day""",
    "shares": """
        SELECT *, (8.04e6::DOUBLE / 365) / nullif(passenger_flights, 0) AS passengers_per_flight FROM pax""",
    "placed": """
        SELECT r.*, d.latitude AS dep_lat, d.longitude AS dep_lon, a.latitude AS arr_lat, a.longitude AS arr_lon,
            a.latitude - d.latitude AS delta_lat, a.longitude - d.longitude AS delta_lon,
            degrees(atan2(a.latitude - d.latitude, a.longitude - d.longitude)) AS bearing
        FROM route r JOIN airports d ON d.airport = dep_airport JOIN airports a ON a.airport = arr_airport""",
    "moved": f"""
        SELECT day, icao24, dep_s, arr_s, dep_airport, arr_airport, bearing,
            dep_lat + {jitter('dep', 'lat', 0.1)} AS dep_lat, dep_lon + {jitter('dep', 'lon', 0.1)} AS dep_lon,
            arr_lat + {jitter('arr', 'lat', 0.1)} AS arr_lat, arr_lon + {jitter('arr', 'lon', 0.1)} AS arr_lon,
            {jitter('mid', 'lat', 1.5)} AS mid_lat_jitter, {jitter('mid', 'lon', 1.5)} AS mid_lon_jitter
        FROM placed""",
    "days": f"""
        SELECT day, {midnight('day')} AS start_s, {midnight('day + 1')} AS end_s
        FROM (SELECT DISTINCT day FROM route)""",
    "grid": "SELECT day, start_s, unnest(range(start_s, end_s + 1, 60)) AS t_s FROM days",
    "states": """
        SELECT r.day, icao24, dep_s, arr_s, dep_airport, arr_airport, t_s, t_s >= dep_s AS has_departed,
            t_s >= arr_s AS has_arrived,
            t_s BETWEEN dep_s AND arr_s AS in_air,
            t_s >= dep_s - 900 AND t_s < dep_s AS taxiing_departure,
            t_s > arr_s AND t_s <= arr_s + 900 AS taxiing_arrival,
            CASE WHEN arr_s = dep_s THEN CASE WHEN t_s >= dep_s THEN 1::DOUBLE ELSE 0::DOUBLE END
                ELSE least(greatest((t_s - dep_s)::DOUBLE / (arr_s - dep_s), 0), 1) END AS progress
        FROM {flights} r JOIN grid g ON g.day = r.day WHERE dep_s >= start_s""",
    "cumulative": f"""
        SELECT day, t_s, icao24, dep_s, arr_s, aircraft_id, in_air, has_departed, has_arrived,
            {each('progress * {p}_ccd + has_departed::INT * {p}_lto AS {p}')}
        FROM emitted_states""",
    "totals": f"""
        SELECT c.day, t_s, {each('coalesce(sum({p}), 0) AS {p}')},
            count(DISTINCT CASE WHEN has_departed THEN struct_pack(a := icao24, b := dep_s, c := arr_s) END)
                AS num_flights,
            CAST(round(count(*) FILTER (WHERE has_arrived) * any_value(passengers_per_flight)) AS BIGINT)
                AS passengers_arrived,
            count(*) FILTER (WHERE in_air) AS planes_in_air
        FROM cumulative c LEFT JOIN shares s ON s.day = c.day GROUP BY c.day, t_s""",
    "located_states": f"""
        SELECT s.day, s.icao24, s.dep_s, s.arr_s, s.t_s, has_departed, has_arrived, in_air, taxiing_departure,
            taxiing_arrival, progress, bearing,
            dep_lon + progress * (arr_lon - dep_lon) + mid_lat_jitter * progress * (1 - progress) AS longitude,
            dep_lat + progress * (arr_lat - dep_lat) + mid_lon_jitter * progress * (1 - progress) AS latitude
        FROM emitted_keys_states s JOIN moved m
            ON m.day = s.day AND m.icao24 = s.icao24 AND m.dep_s = s.dep_s AND m.arr_s = s.arr_s
            AND m.dep_airport = s.dep_airport AND m.arr_airport = s.arr_airport""",
    "shown_hours": f"""
        SELECT day, t_s, t_s = max(t_s) OVER (PARTITION BY day) AS is_last FROM (SELECT DISTINCT day, t_s FROM totals)
        QUALIFY hour({local('t_s')}) >= 5 OR is_last""",
    "times": """
        SELECT day, t_s FROM shown_hours
        QUALIFY (row_number() OVER (PARTITION BY day ORDER BY t_s) - 1) % 4 = 0 OR is_last""",
    "sampled": "SELECT t.* FROM totals t JOIN times USING (day, t_s)",
    "priced": "SELECT *, {sum} AS total_damage FROM (SELECT *, {costs} FROM sampled)",
    "last_rows": "SELECT * FROM priced QUALIFY t_s = max(t_s) OVER (PARTITION BY day)",
    "peaks": """
        SELECT day, t_s FROM sampled WHERE planes_in_air > 0
        QUALIFY row_number() OVER (PARTITION BY day ORDER BY planes_in_air DESC, t_s) = 1""",
}

DAMAGES = [f"{p}_damage" for p in PRICED] + ["total_damage"]


SCENARIOS = ("as_published", "pm_corrected", "official_price")
CARBON = "(308 * (100.32::DOUBLE / 81) * pow(1.015::DOUBLE, 6) * 1.42804505::DOUBLE / 1000)"


def _rates(scenario: str) -> dict[str, str]:
    """AUD per kg, written out once more from the published prices."""
    carbon = "0.08::DOUBLE" if scenario == "official_price" else CARBON
    pounds = {"sox": 26193, "nox": 17172, "hc": 150, "pm": 146743 if scenario == "pm_corrected" else 17172}
    rates = {p: f"({n} * 1.90707364::DOUBLE / 1000)" for p, n in pounds.items()}
    return rates | {"co2": carbon, "co": f"({carbon} * 1.9::DOUBLE)", "hc": f"({rates['hc']} + 10.5::DOUBLE * {carbon})"}


def _costs(scenario: str) -> str:
    rates = _rates(scenario)
    return ", ".join(f"{mass} * {rates[p]} AS {p}_damage" for p, mass in PRICED.items())


TABLES["priced"] = TABLES["priced"].format(sum=" + ".join(DAMAGES[:-1]), costs=_costs("as_published"))
for _name, _flights in (
    ("route_states", "route"),
    ("emitted_states", "emitted"),
    ("emitted_keys_states", "emitted"),
):
    _sql = TABLES["states"].replace("{flights}", _flights)
    if _name == "emitted_states":
        _carried = f"aircraft_id, {each('{p}', BOTH_SUFFIXES)}, t_s"
        _sql = _sql.replace("arr_airport, t_s", f"arr_airport, {_carried}", 1)
    TABLES[_name] = _sql
del TABLES["states"]


def project(lon: str, lat: str) -> tuple[str, str]:
    x = f"radians({lon}) * 6378137.0::DOUBLE"
    y = f"ln(tan(radians({lat}) / 2 + 0.7853981633974483::DOUBLE)) * 6378137.0::DOUBLE"
    return x, y


X, Y = project("longitude", "latitude")
DAY = "CAST(day AS VARCHAR) AS day"
CLEAN_COLUMNS = f"""icao24, dep_s, arr_s, dep_airport, arr_airport, duration_s,
    CAST(dep_local AS VARCHAR) AS dep_local, CAST(arr_local AS VARCHAR) AS arr_local, {DAY}"""
FLAGS = "has_departed, has_arrived, in_air, taxiing_departure, taxiing_arrival"
TOTALS_COLUMNS = f"""{DAY}, t_s, CAST({local('t_s')} AS VARCHAR) AS t_local, {masses(POLLUTANTS, SUM)},
    CAST(num_flights AS BIGINT) AS num_flights, passengers_arrived, planes_in_air"""
ON_CHOSEN = "WHERE day = (SELECT day FROM chosen)"
HI_LO = suffixed("hi") + suffixed("lo")

SELECTS = {
    "landing_scan": "SELECT * FROM raw",
    "landing_json_scan": "SELECT * FROM raw",
    "sink_csv_roundtrip": "SELECT * FROM raw",
    "aircraft_map_scan": "SELECT * FROM register",
    "curve_load": f"SELECT typecode, aircraft_id, phase, ref_s, {masses()} FROM curve",
    "airports_load": f"""
        SELECT name, airport, {masses(('latitude', 'longitude'), DEGREES)}, {rounded(X, 'x', 3)}, {rounded(Y, 'y', 3)},
            (SELECT count(*) FROM clean WHERE dep_airport = airport) AS departures,
            (SELECT count(*) FROM clean WHERE arr_airport = airport) AS arrivals
        FROM airports""",
    "overlap_windows": """
        SELECT CAST(window_start AS VARCHAR) AS window_start, dep_airport, count(*) AS flights
        FROM windows JOIN utc_departures ON utc_date BETWEEN window_start AND window_start + 1
        GROUP BY window_start, dep_airport""",
    "flights_clean": f"SELECT {CLEAN_COLUMNS} FROM clean",
    "hourly_coverage": f"SELECT {DAY}, CAST(hour AS INT) AS hour, flights FROM midday",
    "coverage_pivot": """
        SELECT CAST(h.hour AS INT) AS hour, CAST(d.day AS VARCHAR) AS day, m.flights
        FROM (SELECT DISTINCT hour FROM midday) h CROSS JOIN (SELECT DISTINCT day FROM midday) d
        LEFT JOIN midday m ON m.hour = h.hour AND m.day = d.day""",
    "interior_dates": f"SELECT {DAY}, CAST(hour AS INT) AS hour, flights FROM interior",
    "date_completeness": "SELECT CAST(day AS VARCHAR) AS day, bool_and(flights IS NOT NULL) AS complete"
    " FROM interior GROUP BY day",
    "choose_date": f"SELECT {DAY} FROM chosen",
    "flights_on_date": f"SELECT {CLEAN_COLUMNS} FROM clean {ON_CHOSEN}",
    "flights_on_date_landed": f"SELECT {CLEAN_COLUMNS} FROM clean {ON_CHOSEN}",
    "landing_incremental": f"""
        SELECT DISTINCT CAST(CAST({local('"lastSeen"')} AS DATE) AS VARCHAR) AS arrival_day, * FROM raw""",
    "time_extent": """
        SELECT min(arr_s) AS arr_min_s, max(arr_s) AS arr_max_s, min(dep_s) AS dep_min_s, max(dep_s) AS dep_max_s,
            CAST(min(arr_local) AS VARCHAR) AS arr_min, CAST(max(arr_local) AS VARCHAR) AS arr_max,
            CAST(min(dep_local) AS VARCHAR) AS dep_min, CAST(max(dep_local) AS VARCHAR) AS dep_max
        FROM clean""",
    "grid_extent": "SELECT CAST(day AS VARCHAR) AS day, min(t_s) AS start_s, max(t_s) AS end_s FROM totals GROUP BY day",
    "route_filter": f"SELECT {CLEAN_COLUMNS} FROM route",
    "route_list": "SELECT DISTINCT dep_airport, arr_airport FROM route",
    "first_departures": """
        SELECT CAST(day AS VARCHAR) AS day, dep_airport, min(dep_s) AS dep_s,
            CAST(min(dep_local) AS VARCHAR) AS dep_local
        FROM (SELECT *, min(CAST(dep_local AS DATE)) OVER (PARTITION BY day) AS lowest FROM route)
        WHERE CAST(dep_local AS DATE) > lowest GROUP BY day, dep_airport""",
    "aircraft_type_join": f"SELECT {FLIGHT}, typecode FROM typed",
    "aircraft_id_join": f"SELECT {FLIGHT}, typecode, aircraft_id FROM named",
    "lto_join": f"SELECT {FLIGHT}, typecode, aircraft_id, {masses(suffixed('lto'))} FROM with_lto",
    "curve_candidates": f"""
        SELECT {FLIGHT}, n.aircraft_id, duration_s, c.phase AS ref_phase, ref_s,
            {', '.join(rounded(p, p + '_ref') for p in POLLUTANTS)}
        FROM named n LEFT JOIN curve c ON c.aircraft_id = n.aircraft_id""",
    "ccd_bracket": f"""
        SELECT {FLIGHT}, n.aircraft_id, n.duration_s, ref_hi_s, ref_lo_s, {masses(HI_LO)} FROM named n
        LEFT JOIN brackets b ON b.aircraft_id = n.aircraft_id AND b.duration_s = n.duration_s""",
    "ccd_bracket_groupfirst": f"""
        SELECT aircraft_id, duration_s, ref_hi_s, ref_lo_s, {masses(HI_LO)} FROM brackets""",
    "ccd_interpolate": f"""
        SELECT {FLIGHT}, n.aircraft_id, n.duration_s, ref_hi_s, ref_lo_s, {rounded('factor', 'factor', 6)},
            {masses(suffixed('ccd'))}
        FROM named n LEFT JOIN ccd c ON c.aircraft_id = n.aircraft_id AND c.duration_s = n.duration_s""",
    "fill_with_mean": f"SELECT {FLIGHT}, aircraft_id, {masses(BOTH_SUFFIXES)} FROM emitted",
    "flight_emissions": f"""
        SELECT {CLEAN_COLUMNS}, typecode, aircraft_id, ref_hi_s, ref_lo_s, {rounded('factor', 'factor', 6)},
            {masses(BOTH_SUFFIXES)} FROM emitted""",
    "daily_totals": f"""
        SELECT CAST(day AS VARCHAR) AS day, CAST(CAST(dep_local AS DATE) AS VARCHAR) AS dep_date,
            {', '.join(rounded(f'coalesce(sum({p}_lto), 0) + coalesce(sum({p}_ccd), 0)', p, SUM) for p in POLLUTANTS)}
        FROM emitted GROUP BY day, CAST(dep_local AS DATE)""",
    "airport_join": f"SELECT {FLIGHT}, {masses(('dep_lat', 'dep_lon', 'arr_lat', 'arr_lon'), 6)} FROM placed",
    "route_bearing": f"SELECT {FLIGHT}, {masses(('delta_lat', 'delta_lon', 'bearing'), 6)} FROM placed",
    "jittered_endpoints": f"""
        SELECT {FLIGHT},
            {masses(('dep_lat', 'dep_lon', 'arr_lat', 'arr_lon', 'mid_lat_jitter', 'mid_lon_jitter'), 6)}
        FROM moved""",
    "time_grid": f"SELECT {DAY}, t_s, CAST({local('t_s')} AS VARCHAR) AS t_local FROM grid",
    "timeline_expand_on_date": f"SELECT icao24, dep_s, arr_s, aircraft_id, t_s FROM emitted_states {ON_CHOSEN}",
    "flight_states_on_date": f"""
        SELECT icao24, dep_s, arr_s, t_s, {FLAGS}, {rounded('progress', 'progress', 6)}
        FROM route_states {ON_CHOSEN}""",
    "cumulative_emissions_on_date": f"SELECT icao24, dep_s, arr_s, t_s, {masses()} FROM cumulative {ON_CHOSEN}",
    "positions_on_date": f"""
        SELECT {DAY}, t_s, {masses(('latitude', 'longitude', 'bearing'), DEGREES)}, in_air, taxiing_arrival,
            taxiing_departure
        FROM located_states {ON_CHOSEN}""",
    "timeline_on_date": f"""
        SELECT e.icao24, e.dep_s, e.arr_s, aircraft_id, e.t_s, CAST({local('e.t_s')} AS VARCHAR) AS t_local,
            {', '.join('e.' + f for f in FLAGS.split(', '))}, {rounded('e.progress', 'progress', 6)},
            {', '.join(rounded(f'e.progress * {p}_ccd + e.has_departed::INT * {p}_lto', p) for p in POLLUTANTS)},
            {rounded('dep_lon + e.progress * (arr_lon - dep_lon) + mid_lat_jitter * e.progress * (1 - e.progress)',
                     'longitude', DEGREES)},
            {rounded('dep_lat + e.progress * (arr_lat - dep_lat) + mid_lon_jitter * e.progress * (1 - e.progress)',
                     'latitude', DEGREES)},
            {rounded('bearing', 'bearing', DEGREES)}
        FROM emitted_states e JOIN moved m ON m.day = e.day AND m.icao24 = e.icao24 AND m.dep_s = e.dep_s
            AND m.arr_s = e.arr_s AND m.dep_airport = e.dep_airport AND m.arr_airport = e.arr_airport
        WHERE e.day = (SELECT day FROM chosen)""",
    "passengers_per_flight": f"""
        SELECT {DAY}, passenger_flights, {rounded('passengers_per_flight', 'passengers_per_flight', 6)} FROM shares""",
    "emissions_timeline": f"SELECT {TOTALS_COLUMNS} FROM totals",
    "emissions_timeline_exploded": f"SELECT {TOTALS_COLUMNS} FROM totals",
    "sink_parquet_roundtrip": f"SELECT {TOTALS_COLUMNS} FROM totals",
    "sampled_times": f"SELECT {DAY}, t_s, CAST({local('t_s')} AS VARCHAR) AS t_local FROM times",
    "sampled_positions_on_date": f"""
        SELECT icao24, dep_s, {DAY}, t_s, {masses(('latitude', 'longitude', 'bearing'), DEGREES)}, in_air,
            taxiing_arrival, taxiing_departure
        FROM located_states SEMI JOIN times USING (day, t_s) {ON_CHOSEN}""",
    "project_positions_on_date": f"""
        SELECT icao24, dep_s, t_s, {rounded(X, 'x', METRES)}, {rounded(Y, 'y', METRES)}
        FROM located_states SEMI JOIN times USING (day, t_s) {ON_CHOSEN}""",
    "damages": f"SELECT {DAY}, t_s, {masses(DAMAGES, MONEY)} FROM priced",
    "damages_by_scenario": " UNION ALL ".join(
        f"""SELECT '{s}' AS scenario, {DAY}, t_s, {masses(DAMAGES, MONEY)}
        FROM (SELECT *, {' + '.join(DAMAGES[:-1])} AS total_damage FROM (SELECT *, {_costs(s)} FROM sampled))"""
        for s in SCENARIOS
    ),
    "flight_count_total": "SELECT CAST(day AS VARCHAR) AS day, max(num_flights) AS num_flights FROM sampled GROUP BY day",
    "final_totals": " UNION ALL ".join(
        f"SELECT {DAY}, '{p}' AS pollutant, {rounded(mass, 'kg', SUM)}, {rounded(p + '_damage', 'cost', MONEY)}"
        " FROM last_rows"
        for p, mass in PRICED.items()
    )
    + f" UNION ALL SELECT {DAY}, 'total', CAST(NULL AS DOUBLE), {rounded('total_damage', 'cost', MONEY)} FROM last_rows",
    "rates_records": " UNION ALL ".join(
        f"SELECT {DAY}, '{s}' AS scenario, '{p}' AS pollutant, {rounded(_rates(s)[p], 'rate', 6)},"
        f" {rounded(f'{mass} * {_rates(s)[p]}', 'cost', MONEY)} FROM last_rows"
        for s in SCENARIOS
        for p, mass in PRICED.items()
    ),
    "sink_json_roundtrip": f"SELECT {TOTALS_COLUMNS}, {masses(DAMAGES, MONEY)} FROM last_rows",
    "planes_in_air": f"SELECT {DAY}, t_s, planes_in_air FROM sampled WHERE planes_in_air > 0",
    "peak_positions": f"""
        SELECT {DAY}, t_s, icao24, dep_s, in_air, {rounded('bearing', 'bearing', DEGREES)},
            {rounded(X, 'x', METRES)}, {rounded(Y, 'y', METRES)}
        FROM located_states SEMI JOIN peaks USING (day, t_s)""",
    "minute_snapshots": f"""
        SELECT CAST(p.day AS VARCHAR) AS day, p.t_s, icao24, dep_s, {rounded(X, 'x', METRES)},
            {rounded(Y, 'y', METRES)}, {rounded('bearing', 'bearing', DEGREES)}, num_flights, passengers_arrived,
            {masses(PRICED.values(), SUM)}, {rounded('total_damage', 'total_damage', MONEY)}
        FROM priced p LEFT JOIN (SELECT * FROM located_states WHERE in_air) s ON s.day = p.day AND s.t_s = p.t_s""",
}


def summed(rows: str, keys: str, flags: str = "", sums=(), digits: int = MASS) -> str:
    """A panel per key: rows, first and last time, rows with each flag, sums in whole millionths."""
    shown_keys = keys.replace("day", DAY, 1)
    parts = [shown_keys, "count(*) AS n, min(t_s) AS first_s, max(t_s) AS last_s"]
    parts += [f"count(*) FILTER (WHERE {f}) AS {f}" for f in flags.split(", ") if f]
    parts += [rounded(f"sum(CAST(floor({c} * 1e6 + 0.5) AS BIGINT)) / 1e6", c, digits) for c in sums]
    return f"SELECT {', '.join(parts)} FROM ({rows}) GROUP BY {keys}"


COPY = "day, icao24, dep_s, arr_s, aircraft_id"
SEEN = "in_air, taxiing_departure, taxiing_arrival"
PLACE = ("latitude", "longitude", "bearing")
SAMPLED = "SELECT * FROM located_states SEMI JOIN times USING (day, t_s)"
SELECTS |= {
    "timeline_expand": summed("SELECT * FROM emitted_states", COPY),
    "flight_states": summed("SELECT * FROM route_states", "day, icao24, dep_s, arr_s", FLAGS, ["progress"]),
    "cumulative_emissions": summed("SELECT * FROM cumulative", COPY, sums=POLLUTANTS),
    "positions": summed("SELECT * FROM located_states", "day, t_s", SEEN, PLACE),
    "timeline": summed(
        f"""
        SELECT e.day, e.icao24, e.dep_s, e.arr_s, aircraft_id, e.t_s, e.progress, bearing,
            {', '.join('e.' + f for f in FLAGS.split(', '))},
            {', '.join(f'e.progress * {p}_ccd + e.has_departed::INT * {p}_lto AS {p}' for p in POLLUTANTS)},
            dep_lon + e.progress * (arr_lon - dep_lon) + mid_lat_jitter * e.progress * (1 - e.progress) AS longitude,
            dep_lat + e.progress * (arr_lat - dep_lat) + mid_lon_jitter * e.progress * (1 - e.progress) AS latitude
        FROM emitted_states e JOIN moved m ON m.day = e.day AND m.icao24 = e.icao24 AND m.dep_s = e.dep_s
            AND m.arr_s = e.arr_s AND m.dep_airport = e.dep_airport AND m.arr_airport = e.arr_airport""",
        COPY,
        FLAGS,
        ("progress", *POLLUTANTS, "longitude", "latitude", "bearing"),
    ),
    "sampled_positions": summed(SAMPLED, "day, icao24, dep_s", SEEN, PLACE),
    "project_positions": summed(
        f"SELECT day, icao24, dep_s, t_s, {X} AS x, {Y} AS y FROM ({SAMPLED})",
        "day, icao24, dep_s",
        sums=("x", "y"),
        digits=1,
    ),
}


@cache
def _needed(sql: str) -> set[str]:
    names = set(re.findall(r"\b\w+\b", sql)) & TABLES.keys()
    return names.union(*[_needed(TABLES[n]) for n in names])


def oracle_sql() -> dict[str, str]:
    """One standalone SQL text per query: the tables it needs as CTEs, then its select."""
    queries = {}
    for name, select in SELECTS.items():
        needed = _needed(select)
        order = sorted(needed, key=lambda n: (len(_needed(TABLES[n])), n))
        ctes = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in order)
        queries[name] = f"WITH {ctes}\n{select.strip()}"
    return queries
