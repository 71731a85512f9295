"""SQL oracle: the same lakehouse and queries in plain SQL (DuckDB dialect).

The prelude rebuilds the ride binding, lookups, OBT and star schema as CTEs over the raw
test tables; each query then reads those CTEs.  Measures are summed as exact decimals and
rounded once, half-up (``FLOOR(x*10^n+0.5)``), after the aggregate.  Lookup rows, layouts
and rules are stated in ``oracle_values``, not taken from the library.
"""

from __future__ import annotations

from ridepulse.plans import oracle_values as V


def D(v) -> str:
    return f"CAST({v} AS DOUBLE)"


def H(x: str) -> str:
    """Hundredths of a two-decimal measure."""
    return f"FLOOR(({x}) * {D(100)} + {D(0.5)})"


def RND(x: str, n: int = 2) -> str:
    s = 10 ** n
    return f"(FLOOR(({x}) * {D(s)} + {D(0.5)}) / {D(s)})"


def SUM2(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18, 6))) AS DOUBLE)"


def AVG2(x: str) -> str:
    return f"({SUM2(x)} / COUNT({x}))"


def CNT_IF(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def PCT(part: str, whole: str, n: int = 1) -> str:
    return RND(f"{D(100)} * {part} / {whole}", n)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _values(name: str, cols: list[tuple[str, str]], rows) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    sel = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in cols)
    return f"{name} AS (SELECT {sel} FROM (VALUES {body}) AS t({', '.join(c for c, _ in cols)}))"


def first_sql(src: str, keys: list[str], cols: list[str]) -> str:
    """First row per key by ascending non-key columns, NULLs first (the library's rule)."""
    vals = [c for c in cols if c not in keys]
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in vals) or "1"
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (f"SELECT {', '.join(cols)} FROM (SELECT {', '.join(cols)}, ROW_NUMBER() OVER "
            f"(PARTITION BY {', '.join(keys)} ORDER BY {order}) AS rn__ FROM {src} WHERE {nn}) "
            f"WHERE rn__ = 1")


def _ride_select() -> str:
    k = "k"
    dist_h = f"(qty * 10 + {k} % 10)"
    dur = f"(4 + {k} % 60)"
    surge_pct = "(100 + disc * 10)"
    dfare_c = f"FLOOR(({dist_h} * mile_c + 50) / {D(100)})"
    tfare_c = f"({dur} * min_c)"
    sub_c = f"FLOOR(((base_c + {dfare_c} + {tfare_c}) * {surge_pct} + 50) / {D(100)})"
    tip_c = f"(CASE WHEN {k} % 29 = 0 THEN NULL WHEN {k} % 2 = 0 THEN 0 ELSE ({k} * 37) % 1200 END)"
    total_c = f"({sub_c} + COALESCE({tip_c}, 0) + CASE WHEN {k} % 41 = 0 THEN 7 ELSE 0 END)"
    booking = f"(o_orderdate + to_seconds(({k} * 7919) % 86400))"
    pickup = f"({booking} + to_minutes(1 + {k} % 5))"
    dropoff = f"({pickup} + to_minutes({dur}))"
    s = lambda x: f"CAST({x} AS VARCHAR)"
    iso = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"
    exprs = {
        "ride_id": s(k),
        "confirmation_number": f"'CN' || {s(k)}",
        "passenger_id": s("o_custkey"),
        "driver_id": s("drv"),
        "vehicle_id": s("veh"),
        "pickup_location_id": f"'PL' || {s(k)}",
        "dropoff_location_id": f"'DL' || {s(k)}",
        "vehicle_type_id": "CAST(vtype AS BIGINT)",
        "vehicle_make_id": "CAST(1 + veh % 8 AS BIGINT)",
        "payment_method_id": f"CAST(1 + {k} % 5 AS BIGINT)",
        "ride_status_id": "CAST(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS BIGINT)",
        "pickup_city_id": "CAST(c_nationkey AS BIGINT)",
        "dropoff_city_id": "CAST(s_nationkey AS BIGINT)",
        "cancellation_reason_id": f"CAST(CASE WHEN o_orderstatus = 'P' THEN 1 + {k} % 3 ELSE 4 END AS BIGINT)",
        "passenger_name": "c_name",
        "passenger_email": f"'c' || {s('o_custkey')} || '@example.com'",
        "passenger_phone": f"'555-' || {s('o_custkey')}",
        "driver_name": "s_name",
        "driver_rating": f"{D('420 + drv % 81')} / {D(100)}",
        "driver_phone": f"'556-' || {s('drv')}",
        "driver_license": f"'LIC' || {s('drv')}",
        "vehicle_model": "p_name",
        "vehicle_color": ("CASE WHEN veh % 3 = 0 THEN 'Black' WHEN veh % 3 = 1 THEN 'White' "
                          "WHEN veh IS NOT NULL THEN 'Silver' END"),
        "license_plate": f"'PLT' || {s('veh')}",
        "pickup_address": f"{s(f'100 + {k} % 900')} || ' Pickup Rd'",
        "pickup_latitude": (f"CASE WHEN {k} % 97 = 0 THEN {D(91)} WHEN {k} % 89 = 0 THEN NULL "
                            f"WHEN {k} % 83 = 0 THEN {D('20 + c_nationkey')} + {D(0.75)} "
                            f"ELSE {D('20 + c_nationkey')} + {D(f'{k} % 500')} / {D(1000)} END"),
        "pickup_longitude": (f"CASE WHEN {k} % 101 = 0 THEN {D(-181)} "
                             f"ELSE {D('-100 - c_nationkey')} + {D(f'({k} * 7) % 500')} / {D(1000)} END"),
        "dropoff_address": f"{s(f'100 + ({k} * 3) % 900')} || ' Dropoff Ave'",
        "dropoff_latitude": f"{D('20 + s_nationkey')} + {D(f'({k} * 3) % 500')} / {D(1000)}",
        "dropoff_longitude": f"{D('-100 - s_nationkey')} + {D(f'({k} * 11) % 500')} / {D(1000)}",
        "distance_miles": f"{D(dist_h)} / {D(100)}",
        "duration_minutes": f"CAST({dur} AS BIGINT)",
        "booking_timestamp": booking,
        "pickup_timestamp": iso(pickup),
        "dropoff_timestamp": iso(dropoff),
        "base_fare": f"{D('base_c')} / {D(100)}",
        "distance_fare": f"{D(dfare_c)} / {D(100)}",
        "time_fare": f"{D(tfare_c)} / {D(100)}",
        "surge_multiplier": f"{D(surge_pct)} / {D(100)}",
        "subtotal": f"{D(sub_c)} / {D(100)}",
        "tip_amount": f"{D(tip_c)} / {D(100)}",
        "total_fare": f"CASE WHEN {k} % 53 = 0 THEN NULL ELSE {D(total_c)} / {D(100)} END",
        "rating": f"CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {D(f'10 + {k} % 41')} / {D(10)} END",
    }
    return ",\n  ".join(f"{e} AS {c}" for c, e in exprs.items())


def _obt_select(src: str, city_on: str = """r.pickup_city_id = cv.city_id AND (CASE
  WHEN r.booking_timestamp IS NULL THEN cv.valid_to IS NULL
  ELSE (cv.valid_to IS NULL OR r.booking_timestamp < cv.valid_to)
   AND (cv.is_first OR r.booking_timestamp >= cv.updated_at) END)""") -> str:
    return f"""SELECT r.*, mk.vehicle_make, vt.vehicle_type, vt.description, vt.base_rate, vt.per_mile,
  vt.per_minute, rs.ride_status, pm.payment_method, pm.is_card, pm.requires_auth,
  cv.city AS pickup_city, cv.state, cv.region, cv.updated_at AS city_updated_at,
  cr.cancellation_reason
FROM {src} r
LEFT JOIN map_vehicle_makes mk ON r.vehicle_make_id = mk.vehicle_make_id
LEFT JOIN map_vehicle_types vt ON r.vehicle_type_id = vt.vehicle_type_id
LEFT JOIN map_ride_statuses rs ON r.ride_status_id = rs.ride_status_id
LEFT JOIN map_payment_methods pm ON r.payment_method_id = pm.payment_method_id
LEFT JOIN city_versions cv ON {city_on}
LEFT JOIN map_cancellation_reasons cr ON r.cancellation_reason_id = cr.cancellation_reason_id"""


def prelude() -> str:
    """CTEs: lookups, rides, city map, OBT, gold base, fact and dimensions."""
    B, S_, Dd, Bo = "BIGINT", "VARCHAR", "DOUBLE", "BOOLEAN"
    ctes = [
        _values("map_vehicle_types", [("vehicle_type_id", B), ("vehicle_type", S_),
                                      ("description", S_), ("base_rate", Dd),
                                      ("per_mile", Dd), ("per_minute", Dd)], V.VEHICLE_TYPES),
        _values("map_vehicle_makes", [("vehicle_make_id", B), ("vehicle_make", S_)], V.VEHICLE_MAKES),
        _values("map_payment_methods", [("payment_method_id", B), ("payment_method", S_),
                                        ("is_card", Bo), ("requires_auth", Bo)], V.PAYMENT_METHODS),
        _values("map_ride_statuses", [("ride_status_id", B), ("ride_status", S_),
                                      ("is_completed", Bo)], V.RIDE_STATUSES),
        _values("map_cancellation_reasons", [("cancellation_reason_id", B),
                                             ("cancellation_reason", S_)], V.CANCELLATION_REASONS),
        f"""li AS (SELECT l_orderkey, MIN(l_suppkey) AS drv, MIN(l_partkey) AS veh,
  CAST(SUM(l_quantity) AS BIGINT) AS qty,
  MAX(FLOOR(l_discount * {D(100)} + {D(0.5)})) AS disc FROM lineitem GROUP BY l_orderkey)""",
        f"""rates AS (SELECT vehicle_type_id AS rt_id, FLOOR(base_rate * {D(100)} + {D(0.5)}) AS base_c,
  FLOOR(per_mile * {D(100)} + {D(0.5)}) AS mile_c, FLOOR(per_minute * {D(100)} + {D(0.5)}) AS min_c
  FROM map_vehicle_types)""",
        """bound AS (SELECT o.*, li.drv, li.veh, li.qty, li.disc, c.c_name, c.c_nationkey,
  s.s_name, s.s_nationkey, p.p_name, p.p_size, o.o_orderkey AS k, 1 + p.p_size % 6 AS vtype
  FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN supplier s ON li.drv = s.s_suppkey
  LEFT JOIN part p ON li.veh = p.p_partkey)""",
        "bound_rates AS (SELECT b.*, r.base_c, r.mile_c, r.min_c FROM bound b LEFT JOIN rates r ON b.vtype = r.rt_id)",
        f"rides AS (SELECT\n  {_ride_select()}\nFROM bound_rates)",
        f"""map_cities AS (
  SELECT CAST(n_nationkey AS BIGINT) AS city_id,
    CASE WHEN n_nationkey = {V.RENAMED_NATION} THEN 'NATION_{V.RENAMED_TO_NATION}' ELSE n_name END AS city,
    'ST' || CAST(n_nationkey AS VARCHAR) AS state, r_name AS region,
    TIMESTAMP '{V.FIRST_VERSION_FROM}' AS updated_at
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT), n_name || ' METRO', 'ST' || CAST(n_nationkey AS VARCHAR),
    r_name, TIMESTAMP '{V.SECOND_VERSION_FROM}'
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey IN ({', '.join(str(n) for n in V.SECOND_VERSION_NATIONS)}))""",
        """city_versions AS (SELECT *, LEAD(updated_at) OVER (PARTITION BY city_id ORDER BY updated_at) AS valid_to,
  ROW_NUMBER() OVER (PARTITION BY city_id ORDER BY updated_at) = 1 AS is_first FROM map_cities)""",
        "cur_cities AS (SELECT city_id, city, state, region, updated_at FROM city_versions WHERE valid_to IS NULL)",
        f"obt AS ({_obt_select('rides')})",
        "base AS (SELECT * FROM obt)",
        f"fact AS (SELECT {', '.join(V.FACT)} FROM base)",
    ]
    for name, (key, columns) in V.DIMENSIONS.items():
        ctes.append(f"{name} AS ({first_sql('base', [key], columns)})")
    ctes.append(f"dim_booking AS (SELECT {', '.join(V.BOOKING)} FROM base WHERE ride_id IS NOT NULL)")
    ctes.append(f"""loc_versions AS ({first_sql(
        "(SELECT * FROM base WHERE pickup_city_id IS NOT NULL AND city_updated_at IS NOT NULL)",
        ['pickup_city_id', 'city_updated_at'], V.LOCATION)})""")
    ctes.append("""dim_location AS (SELECT *, city_updated_at AS __START_AT,
  LEAD(city_updated_at) OVER (PARTITION BY pickup_city_id ORDER BY city_updated_at) AS __END_AT
  FROM loc_versions)""")
    ctes.append("loc_cur AS (SELECT * FROM dim_location WHERE __END_AT IS NULL)")
    return "WITH " + ",\n".join(ctes) + "\n"


def _q(body: str) -> str:
    return prelude() + body
