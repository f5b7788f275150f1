"""The registered queries as SQL for the checking engine.

Doubles leave both engines through the same quantisation (see ``steady``), as
sums depend on the order of the rows. The threshold is off the middle so that
exact ties, common among means of values with three decimals, do not flip.
"""

from wattspan.functions.energy import WEEKDAY_LOAD, WEEKEND_LOAD

METRICS = [
    "global_active_power_kw", "global_reactive_power_kw", "voltage_v", "global_intensity_a",
    "sub_metering_1_wh", "sub_metering_2_wh", "sub_metering_3_wh",
]
READINGS_SQL = """
SELECT id, timestamp, site_id, 'meter-main' AS device_id, p AS global_active_power_kw,
  floor(p * 100 + 0.5) / 1000 AS global_reactive_power_kw, v AS voltage_v, floor(p * 10000 / v + 0.5) / 10 AS global_intensity_a,
  CASE WHEN id % 11 = 0 THEN 0.0 ELSE floor(p * (id % 5) * 10 + 0.5) / 10 END AS sub_metering_1_wh,
  CASE WHEN id % 11 = 0 THEN 0.0 ELSE floor(p * (id % 3) * 10 + 0.5) / 10 END AS sub_metering_2_wh,
  CASE WHEN id % 11 = 0 THEN 0.0 ELSE floor(p * (id % 7) * 10 + 0.5) / 10 END AS sub_metering_3_wh
FROM (SELECT event_id AS id, ts AS timestamp, CASE WHEN user_id % 10 < 8 THEN 'home-01' ELSE 'home-synth' END AS site_id,
        CASE WHEN event_id % 131 = 0 THEN CAST(0 AS DOUBLE) ELSE floor(value * 20 + 0.5) / 1000 END AS p,
        CAST(230 AS DOUBLE) + ((event_id * 7919) % 2001 - 1000) / CAST(100 AS DOUBLE) AS v
      FROM {events}) e
"""
POWER = METRICS[0]
VOLT = METRICS[2]
SCALE, SHIFT = 1e6, 0.31415926
HU = lambda x, d: f"floor(({x}) * 1e{d} + 0.5) / 1e{d}"

READINGS = READINGS_SQL.format(events="events").strip()
CTE = f"readings AS ({READINGS})"
ALL = ["id", "timestamp", "site_id", "device_id"]
PLAIN = {"id", "timestamp", "site_id", "device_id"}

FEATURES = [
    *METRICS, "hour", "day_of_week", "month", "is_weekend",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
    *[f"{POWER}_lag_{k}m" for k in (1, 5, 15, 60)],
    *[f"{POWER}_roll_{s}_{w}h" for w in (1, 6, 24) for s in ("mean", "std", "min", "max")],
    f"{POWER}_diff_1m", f"{POWER}_diff_5m", f"{POWER}_pct_change_1m",
    "sub_total_wh", "total_wh_per_min", "metered_ratio", "sub_1_share", "sub_2_share", "sub_3_share",
]


def steady(body: str, plain, doubles, cte: str = CTE) -> str:
    """``body`` with its double columns quantised."""
    cols = [*plain, *[f"floor({c} * {SCALE:.0f}.0::DOUBLE + {SHIFT}::DOUBLE) / {SCALE:.0f}.0::DOUBLE AS {c}" for c in doubles]]
    return f"WITH {cte} SELECT {', '.join(cols)} FROM ({body}) q"


TOU = """CASE WHEN hour(timestamp) < 6 THEN 'off_peak' WHEN hour(timestamp) < 9 THEN 'morning_peak'
 WHEN hour(timestamp) < 17 THEN 'daytime' WHEN hour(timestamp) < 21 THEN 'evening_peak' ELSE 'late_evening' END"""
PARTS = {
    "hour": "hour(timestamp)",
    "day_of_week": "isodow(timestamp) - 1",
    "month": "month(timestamp)",
    "is_weekend": "CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END",
}
CYC = {
    f"{n}_{f}": f"{f}(2 * pi() * ({PARTS[p]}) / {k}.0::DOUBLE)"
    for n, p, k in (("hour", "hour", 24), ("dow", "day_of_week", 7), ("month", "month", 12))
    for f in ("sin", "cos")
}
SUBS = "(sub_metering_1_wh + sub_metering_2_wh + sub_metering_3_wh)"
TOTAL = f"({POWER} * 1000 / 60)"
RATIOS = {
    "sub_total_wh": SUBS,
    "total_wh_per_min": TOTAL,
    "metered_ratio": f"CASE WHEN {TOTAL} <> 0 THEN least(greatest({SUBS} / {TOTAL}, 0.0), 1.5) END",
    **{f"sub_{i}_share": f"coalesce(sub_metering_{i}_wh / nullif({SUBS}, 0.0), 0.0)" for i in (1, 2, 3)},
}


def named(parts) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in parts.items())


def bigints(parts):
    return {k: f"CAST({v} AS BIGINT)" for k, v in parts.items()}


LAGS = {f"{POWER}_lag_{k}m": f"lag({POWER}, {k}) OVER o" for k in (1, 5, 15, 60)}
RATES = {
    f"{POWER}_diff_1m": f"{POWER} - lag({POWER}, 1) OVER o",
    f"{POWER}_diff_5m": f"{POWER} - lag({POWER}, 5) OVER o",
    f"{POWER}_pct_change_1m": f"({POWER} - lag({POWER}, 1) OVER o) / nullif(lag({POWER}, 1) OVER o, 0.0)",
}
ORDERED = "WINDOW o AS (PARTITION BY site_id ORDER BY timestamp, id)"


def label(w):
    return f"{w // 60}h" if w >= 60 else f"{w}m"


def rolls(widths):
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return {
        f"{POWER}_roll_{s}_{label(w)}": f"CASE WHEN count({POWER}) OVER w{w} >= {w // 2} THEN {f}({POWER}) OVER w{w} END"
        for w in widths
        for s, f in fn.items()
    }


def frames(widths):
    return "".join(
        f", w{w} AS (PARTITION BY site_id ORDER BY timestamp, id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for w in widths
    )


WIDTHS = (60, 360, 1440)
FULL = (
    f"full_matrix AS (SELECT *, {TOU} AS time_of_use, {named(bigints(PARTS))}, {named(CYC)}, {named(LAGS)}, "
    f"{named(rolls(WIDTHS))}, {named(RATES)}, {named(RATIOS)} FROM readings {ORDERED}{frames(WIDTHS)})"
)
MATRIX = (
    f"matrix AS (SELECT * FROM full_matrix WHERE {POWER}_lag_60m IS NOT NULL AND {POWER}_roll_mean_24h IS NOT NULL "
    f"AND {POWER}_pct_change_1m IS NOT NULL AND metered_ratio IS NOT NULL)"
)
CTE_FULL = f"{CTE}, {FULL}"
CTE_MATRIX = f"{CTE_FULL}, {MATRIX}"
INT_FEATURES = list(PARTS)
DBL_FEATURES = [c for c in FEATURES if c not in INT_FEATURES]

# the checking side's own copy of the limits
LIMITS_OF = {
    "global_active_power": (0.0, 15.0), "global_reactive_power": (0.0, 5.0), "voltage": (100.0, 300.0), "global_intensity": (0.0, 80.0),
    "sub_metering_1": (0.0, 100.0), "sub_metering_2": (0.0, 100.0), "sub_metering_3": (0.0, 100.0),
}
RAW_METRICS = list(LIMITS_OF)
_FIELDS = [
    f"CASE {'WHEN id % 350 = 11 THEN ' + repr('abc') if k == 2 else ''} WHEN id % 400 = {20 + k} THEN '{LIMITS_OF[RAW_METRICS[k]][0] - 1:.3f}'"
    f" WHEN id % 400 = {40 + k} THEN '{LIMITS_OF[RAW_METRICS[k]][1] + 1:.3f}' ELSE CAST(CAST({m} AS DECIMAL(9,3)) AS VARCHAR) END"
    for k, m in enumerate(METRICS)
]
RAW = f"""raw_lines AS (SELECT id, CASE WHEN id % 500 = 3 THEN 'bad;line'
  WHEN id % 80 = 0 THEN concat(strftime(timestamp, '%d/%m/%Y;%H:%M:%S'), ';?;?;?;?;?;?;?')
  ELSE concat_ws(';', CASE WHEN id % 333 = 7 THEN '31/02/2024' ELSE strftime(timestamp, '%d/%m/%Y') END, strftime(timestamp, '%H:%M:%S'),
    {', '.join(_FIELDS)}) END AS value FROM readings)"""
_NUM = [f"TRY_CAST(f[{i + 3}] AS DOUBLE)" for i in range(7)]
_ALLNUM = " AND ".join(f"{n} IS NOT NULL" for n in _NUM)
_WARN = [
    f"CASE WHEN {m} < {lo} OR {m} > {hi} THEN concat('{m}=', CAST({m} AS VARCHAR), ' out of bounds [{lo}, {hi}]') END"
    for m, (lo, hi) in LIMITS_OF.items()
]
PARSED = f"""fields AS (SELECT id, value, string_split(trim(value), ';') AS f FROM raw_lines),
typed AS (SELECT *, try_strptime(concat_ws(' ', f[1], f[2]), '%d/%m/%Y %H:%M:%S') AS t FROM fields),
judged AS (SELECT *, CASE WHEN len(f) <> 9 THEN 'invalid' WHEN list_contains(f, '?') THEN 'missing'
  WHEN t IS NULL OR NOT ({_ALLNUM}) THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN len(f) <> 9 THEN concat('Expected 9 fields, got ', len(f)) WHEN list_contains(f, '?') THEN NULL
  WHEN t IS NULL THEN concat('Invalid date/time: ', concat_ws(' ', f[1], f[2]))
  WHEN NOT ({_ALLNUM}) THEN concat('Non-numeric metric value: ', chr(39), list_filter(f[3:], lambda x: TRY_CAST(x AS DOUBLE) IS NULL)[1], chr(39)) END AS reason FROM typed),
parsed AS (SELECT id, value, status, reason, CASE WHEN status = 'ok' THEN t END AS timestamp,
  {', '.join(f"CASE WHEN status = 'ok' THEN {n} END AS {m}" for n, m in zip(_NUM, RAW_METRICS))} FROM judged),
validated AS (SELECT *, list_filter([{', '.join(_WARN)}], lambda x: x IS NOT NULL) AS warning_list FROM parsed)"""
CTE_RAW = f"{CTE}, {RAW}"
CTE_PARSED = f"{CTE_RAW}, {PARSED}"
COUNTERS = """SELECT count(*) AS total_lines, count(*) FILTER (status = 'ok') AS inserted,
 count(*) FILTER (status = 'missing') AS skipped_missing, count(*) FILTER (status = 'invalid') AS skipped_invalid,
 CAST(sum(len(warning_list)) AS BIGINT) AS warnings FROM validated"""
COUNTER_COLS = ["total_lines", "inserted", "skipped_missing", "skipped_invalid", "warnings"]
LOADED = f"SELECT timestamp, {', '.join(f'{r} AS {m}' for r, m in zip(RAW_METRICS, METRICS))} FROM validated WHERE status = 'ok'"

MESSAGES = """messages AS (SELECT id, concat(
  '{"schema_version":', CASE WHEN id % 60 = 5 THEN '"2.0"' WHEN id % 60 = 6 THEN '1.0' ELSE '"1.0"' END, ',',
  '"site_id":"', CASE WHEN id % 50 = 9 THEN 'Home 01' ELSE site_id END, '",',
  CASE WHEN id % 40 = 3 THEN '' ELSE '"device_id":"meter-main",' END,
  CASE WHEN id % 110 = 2 THEN '"note":"x",' ELSE '' END,
  '"timestamp":"', CASE WHEN id % 130 = 6 THEN 'yesterday' ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S') END,
  '","metrics":{',
  CASE WHEN id % 70 = 7 THEN '' ELSE concat('"global_active_power_kw":', CASE WHEN id % 90 = 1 THEN '-1.5' WHEN id % 80 = 12 THEN '"1.5"' WHEN id % 80 = 13 THEN 'null' ELSE '1.5' END, ',') END,
  CASE WHEN id % 120 = 4 THEN '"phase":1,' ELSE '' END,
  '"voltage_v":', CAST(CAST(voltage_v AS DECIMAL(9,2)) AS VARCHAR), '}}') AS value FROM readings)"""
_J = lambda k: f"json_extract_string(value, '$.{k}')"
_KEYS = ["schema_version", "site_id", "device_id", "timestamp", "metrics"]
_RULES = [
    *[f"CASE WHEN NOT list_contains(json_keys(value), '{k}') THEN 'missing {k}' END" for k in _KEYS],
    f"CASE WHEN NOT list_contains(json_keys(value, '$.metrics'), '{POWER}') THEN 'missing metrics.{POWER}' END",
    "CASE WHEN json_type(value, '$.schema_version') <> 'VARCHAR' THEN 'schema_version is not a string' END",
    f"CASE WHEN json_type(value, '$.metrics.{POWER}') NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'metrics.{POWER} is not a number' END",
    f"CASE WHEN {_J('schema_version')} <> '1.0' THEN 'schema_version is not 1.0' END",
    *[f"CASE WHEN NOT regexp_matches({_J(k)}, '^[a-z0-9-]+$') THEN '{k} is not a valid name' END" for k in ("site_id", "device_id")],
    f"CASE WHEN try_strptime({_J('timestamp')}, '%Y-%m-%dT%H:%M:%S') IS NULL THEN 'timestamp is not a date-time' END",
    *[f"CASE WHEN CAST({_J('metrics.' + m)} AS DOUBLE) < 0 THEN 'metrics.{m} is below 0' END" for m in METRICS],
    "CASE WHEN list_contains(json_keys(value), 'note') THEN 'unknown key note' END",
    "CASE WHEN list_contains(json_keys(value, '$.metrics'), 'phase') THEN 'unknown key metrics.phase' END",
]

BUCKET = lambda step: f"time_bucket(INTERVAL '{step}', timestamp, TIMESTAMP '2000-01-03 00:00:00')"
AVGS = lambda cols=METRICS: ", ".join(f"avg({c}) AS {c}" for c in cols)
SPINE = lambda step: (
    f"(SELECT site_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL '{step}')) AS bucket "
    "FROM filled GROUP BY site_id)"
)
FILLED = lambda step, aggs: f"filled AS (SELECT site_id, {BUCKET(step)} AS bucket, {aggs} FROM readings GROUP BY ALL)"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT site_id, '{m}' AS metric, {m} AS value FROM readings" for m in METRICS) + ")"
LIMITS = f"limits AS (SELECT site_id, quantile_cont({POWER}, 0.01) AS p01, quantile_cont({POWER}, 0.99) AS p99 FROM readings GROUP BY site_id)"
STEPS = (
    "steps AS (SELECT site_id, id, timestamp, "
    "date_diff('microsecond', lag(timestamp) OVER o, timestamp) / 1000000.0::DOUBLE AS step_seconds "
    f"FROM readings {ORDERED})"
)
DIFFS = f"diffs AS (SELECT id, site_id, {POWER} - lag({POWER}, 1) OVER o AS d FROM readings {ORDERED})"
STATS = f"""SELECT site_id, *, {HU('avg_power * readings / 60', 2)} AS estimated_total_kwh FROM (SELECT site_id AS site_id_, count(*) AS readings,
 {HU(f'avg({POWER})', 3)} AS avg_power, {HU(f'max({POWER})', 3)} AS max_power, {HU(f'min({POWER})', 3)} AS min_power,
 {HU(f'avg({VOLT})', 1)} AS avg_voltage, {HU(f'min({VOLT})', 1)} AS min_voltage, {HU(f'max({VOLT})', 1)} AS max_voltage,
 {HU('avg(global_intensity_a)', 1)} AS avg_current FROM readings GROUP BY site_id) s"""
STATS = STATS.replace("SELECT site_id, *,", "SELECT site_id_ AS site_id, *,", 1)
STAT_COLS = ["avg_power", "max_power", "min_power", "avg_voltage", "min_voltage", "max_voltage", "avg_current", "estimated_total_kwh"]


def uniform(seq: str, seed: int, i: int) -> str:
    block, part = divmod(i, 4)
    digest = f"md5(concat_ws(':', {seq}, {block}, {seed}))"
    return f"((('0x' || substr({digest}, {8 * part + 1}, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE"


def generated(seq: str, seed: int, source: str, keep: str) -> str:
    u = [f"u{i}" for i in range(17)]
    draws = ", ".join(f"{uniform(seq, seed, i)} AS u{i}" for i in range(17))
    normal = lambda a, b: f"(sqrt(-2 * ln({u[a]})) * cos(2 * pi() * {u[b]}))"
    between = lambda i, lo, hi: f"({lo} + ({hi}::DOUBLE - {lo}::DOUBLE) * {u[i]})"
    profile = lambda values: f"{list(values)}::DOUBLE[]"
    at = lambda v: (
        f"(({profile(v)})[hour(timestamp) + 1] + (({profile(v)})[(hour(timestamp) + 1) % 24 + 1] - ({profile(v)})[hour(timestamp) + 1])"
        " * (minute(timestamp) / 60.0::DOUBLE))"
    )
    load = f"CASE WHEN isodow(timestamp) >= 6 THEN {at(WEEKEND_LOAD)} ELSE {at(WEEKDAY_LOAD)} END"
    subs = [
        (f"greatest(power * 1000 / 60 * {between(8 + i, lo, hi)} + 0.5 * {normal(11 + 2 * i, 12 + 2 * i)}, 0.0)")
        for i, (lo, hi) in enumerate([(0.05, 0.25), (0.05, 0.20), (0.10, 0.35)])
    ]
    values = ["power", f"power * {between(7, 0.05, 0.15)}", "volt", "CASE WHEN volt > 0 THEN power * 1000 / volt ELSE 0.0 END", *subs]
    rounded = ", ".join(f"{HU(v, d)} AS {m}" for v, d, m in zip(values, [3, 3, 2, 1, 1, 1, 1], METRICS))
    return f"""SELECT {keep}, {rounded}, injected FROM (
 SELECT *, greatest(4.5 * load * factor + 0.15 * {normal(3, 4)}, 0.0) AS power, 230.0 + 3.0 * {normal(5, 6)} AS volt FROM (
 SELECT *, {load} AS load, CASE injected WHEN 'spike' THEN {between(2, 2.0, 5.0)} WHEN 'dropout' THEN {between(2, 0.0, 0.05)} ELSE 1.0 END AS factor FROM (
 SELECT *, CASE WHEN u0 >= 0.01 THEN 'none' WHEN u1 < 0.7 THEN 'spike' ELSE 'dropout' END AS injected FROM (
 SELECT *, {draws} FROM {source}) a) b) c) d"""


DAYS = "(SELECT site_id, unnest(generate_series(day::TIMESTAMP, day::TIMESTAMP + INTERVAL 1439 MINUTE, INTERVAL 1 MINUTE)) AS timestamp FROM (SELECT DISTINCT site_id, CAST(timestamp AS DATE) AS day FROM readings) x)"
DAY_SEQ = "concat_ws('/', site_id, strftime(timestamp, '%Y%m%d%H%M'))"

VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
PAIRS = "pairs AS (SELECT a.id AS query, b.id AS neighbour, list_distance(a.e, b.e) AS distance FROM v a, v b WHERE a.id <> b.id)"


def nearest(k, pairs="pairs", name="found"):
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM {pairs}) r WHERE rank <= {k})"


LOF_FIT = f"""{VEC}, {PAIRS}, {nearest(20)},
kd AS (SELECT query AS id, max(distance) AS k_distance FROM found GROUP BY query),
dens AS (SELECT f.query AS id, 1 / (avg(greatest(f.distance, kd.k_distance)) + 1e-10) AS density FROM found f JOIN kd ON kd.id = f.neighbour GROUP BY f.query)"""
LOF = """SELECT f.query AS id, avg(n.density) / any_value(o.density) AS lof FROM {found} f JOIN dens n ON n.id = f.neighbour
 JOIN {own} o ON o.id = f.query GROUP BY f.query"""
LOF_SELF = f"""{LOF_FIT}, every AS (SELECT a.id AS query, b.id AS neighbour, list_distance(a.e, b.e) AS distance FROM v a, v b),
{nearest(20, 'every', 'found_self')},
own AS (SELECT f.query AS id, 1 / (avg(greatest(f.distance, kd.k_distance)) + 1e-10) AS density FROM found_self f JOIN kd ON kd.id = f.neighbour GROUP BY f.query)"""

ENTRIES = """entries AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY day) AS seq,
 concat(row_number() OVER (PARTITION BY site_id ORDER BY day), '.0') AS version,
 CASE WHEN dayofmonth(day) % 2 = 0 THEN 'lof' ELSE 'isolation_forest' END AS model_name,
 CAST(day AS VARCHAR) AS training_date, n AS n_training_samples, spikes / n::DOUBLE AS anomaly_rate
 FROM (SELECT r.site_id, CAST(r.timestamp AS DATE) AS day, count(*) AS n, count(*) FILTER (r.global_active_power_kw > 4) AS spikes
   FROM readings r GROUP BY ALL) d)"""

# a forest of three trees over three scaled features, written out
_X = [f"(({POWER} - 1.0) / 2.0)", f"(({VOLT} - 230.0) / 8.0)", f"(({POWER}_lag_60m - 1.0) / 2.0)"]
_PATHS = [
    f"CASE WHEN {_X[0]} <= -0.25 THEN 11.5 WHEN {_X[1]} <= 0.5 THEN 9.0 ELSE 3.25 END",
    f"CASE WHEN {_X[1]} <= -0.9375 THEN 4.5 WHEN {_X[2]} <= 0.0 THEN 10.25 ELSE 6.0 END",
    f"CASE WHEN {_X[2]} > -0.25 THEN 7.5 WHEN {_X[0]} <= -0.375 THEN 12.0 ELSE 4.0 END",
]
_NORM = "(2 * (ln(255.0::DOUBLE) + 0.5772156649::DOUBLE) - 2 * 255.0::DOUBLE / 256)"
SCORED = (
    f"raw AS (SELECT *, -pow(2.0::DOUBLE, -({' + '.join(_PATHS)})::DOUBLE / 3 / {_NORM}) AS raw_score FROM matrix), "
    "scored AS (SELECT *, raw_score + 0.68::DOUBLE AS anomaly_score, raw_score + 0.68::DOUBLE < 0 AS is_anomaly, "
    "CASE WHEN raw_score + 0.68::DOUBLE < 0 THEN -1 ELSE 1 END::BIGINT AS prediction FROM raw)"
)


def oracle_sql() -> dict[str, str]:
    every = ", ".join([*ALL, *METRICS])
    everything = lambda body, cte=CTE: steady(body, ALL, METRICS, cte)
    out: dict[str, str] = {}

    # sources and sinks
    out["src_raw"] = f"WITH {CTE_RAW} SELECT value FROM raw_lines"
    out["src_parse"] = steady("SELECT * FROM parsed", ["id", "status", "reason", "timestamp"], RAW_METRICS, CTE_PARSED)
    out["src_validate"] = steady(
        "SELECT *, array_to_string(warning_list, '|') AS warnings FROM validated",
        ["id", "status", "timestamp", "warnings"], RAW_METRICS, CTE_PARSED)
    out["src_bulk"] = steady(COUNTERS, COUNTER_COLS, [], CTE_PARSED)
    out["src_scan"] = steady("SELECT * FROM readings WHERE site_id = 'home-01'", ["timestamp"], METRICS)
    out["src_json"] = f"""WITH {CTE}, {MESSAGES} SELECT id, {_J('site_id')} AS site_id, {_J('device_id')} AS device_id,
 CAST({_J('metrics.voltage_v')} AS DOUBLE) AS voltage_v,
 array_to_string(list_filter([{', '.join(_RULES)}], lambda x: x IS NOT NULL), '|') AS violations FROM messages"""
    out["src_synth"] = steady(generated(DAY_SEQ, 7, DAYS, "site_id, timestamp"), ["site_id", "timestamp", "injected"], METRICS)
    out["snk_readings"] = everything("SELECT * FROM readings")

    # filters
    out["flt_site"] = everything("SELECT * FROM readings WHERE site_id = 'home-01'")
    out["flt_range"] = everything("SELECT * FROM readings WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
    out["flt_days"] = everything("SELECT * FROM readings WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-16'")
    out["flt_last_n"] = everything("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp DESC, id DESC) AS k FROM readings) x WHERE k <= 1440")
    presets = " UNION ALL ".join(
        f"SELECT '{name}' AS preset, r.site_id, count(*) AS readings, min(r.timestamp) AS first, max(r.timestamp) AS last FROM readings r JOIN ends e ON r.site_id = e.site_id WHERE r.timestamp >= time_bucket(INTERVAL '1 day', {start}) AND r.timestamp < time_bucket(INTERVAL '1 day', e.b) + INTERVAL 1 DAY GROUP BY r.site_id"
        for name, start in (("24h", "e.b - INTERVAL 1 DAY"), ("7d", "e.b - INTERVAL 7 DAY"), ("30d", "e.b - INTERVAL 30 DAY"), ("all", "e.a")))
    out["flt_quick"] = f"WITH {CTE}, ends AS (SELECT site_id, min(timestamp) AS a, max(timestamp) AS b FROM readings GROUP BY site_id) {presets}"
    out["flt_bounds"] = f"WITH {CTE_PARSED} SELECT id, timestamp, array_to_string(warning_list, '|') AS warnings FROM validated WHERE len(warning_list) > 0"
    negative = ", ".join(f"CASE WHEN {raw} < 0 THEN '{m} must be at least 0' END" for raw, m in zip(RAW_METRICS, METRICS) if m != VOLT)
    out["flt_input"] = f"WITH {CTE_PARSED} SELECT id, array_to_string(list_filter([{negative}], lambda x: x IS NOT NULL), '|') AS violations FROM validated WHERE status = 'ok'"
    out["flt_dropna"] = f"WITH {CTE_MATRIX} SELECT id, site_id, timestamp FROM matrix"
    out["flt_sample"] = everything("SELECT * FROM readings ORDER BY md5(concat_ws(':', id, 42)), id LIMIT (SELECT CAST(round(0.1 * count(*)) AS BIGINT) FROM readings)")
    out["flt_spike"] = steady(f"SELECT r.* FROM readings r JOIN limits l ON r.site_id = l.site_id WHERE {POWER} > p99", ALL, METRICS, f"{CTE}, {LIMITS}")
    out["flt_dropout"] = steady(f"SELECT r.* FROM readings r JOIN limits l ON r.site_id = l.site_id WHERE {POWER} < p01 AND hour(timestamp) BETWEEN 8 AND 22", ALL, METRICS, f"{CTE}, {LIMITS}")
    out["flt_week"] = steady(
        f"SELECT r.*, {POWER} > p99 AS is_spike FROM readings r JOIN limits l ON r.site_id = l.site_id JOIN (SELECT site_id, min(timestamp) AS a FROM readings GROUP BY site_id) m ON m.site_id = r.site_id WHERE timestamp BETWEEN a + INTERVAL 10 DAY AND a + INTERVAL 17 DAY",
        ["id", "site_id", "timestamp", "is_spike"], [POWER], f"{CTE}, {LIMITS}")
    out["flt_pos"] = everything("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY timestamp, id) AS k FROM readings) x WHERE k > 1000 AND k <= 2000")

    # functions
    out["fn_cal"] = f"WITH {CTE} SELECT id, {named(bigints(PARTS))} FROM readings"
    out["fn_tou"] = f"WITH {CTE} SELECT id, {TOU} AS time_of_use FROM readings"
    out["fn_cyc"] = steady(f"SELECT id, {named(CYC)} FROM readings", ["id"], list(CYC))
    out["fn_temporal"] = steady(f"SELECT id, {TOU} AS time_of_use, {named(bigints(PARTS))}, {named(CYC)} FROM readings", ["id", "time_of_use", *PARTS], list(CYC))
    out["fn_ratio"] = steady(f"SELECT id, {named(RATIOS)} FROM readings", ["id"], list(RATIOS))
    out["fn_unmetered"] = steady(f"SELECT id, greatest({TOTAL} - sub_metering_1_wh - sub_metering_2_wh - sub_metering_3_wh, 0.0) AS unmetered_wh FROM readings", ["id"], ["unmetered_wh"])
    load = lambda v: f"(({list(v)}::DOUBLE[])[hour(timestamp) + 1] + (({list(v)}::DOUBLE[])[(hour(timestamp) + 1) % 24 + 1] - ({list(v)}::DOUBLE[])[hour(timestamp) + 1]) * (minute(timestamp) / 60.0::DOUBLE))"
    out["fn_load"] = steady(f"SELECT id, CASE WHEN isodow(timestamp) >= 6 THEN {load(WEEKEND_LOAD)} ELSE {load(WEEKDAY_LOAD)} END AS load_multiplier FROM readings", ["id"], ["load_multiplier"])
    out["fn_round"] = steady(f"SELECT id, {HU(TOTAL, 3)} AS wh_3, {HU(VOLT, 1)} AS voltage_1, {HU(VOLT, 2)} AS voltage_2 FROM readings", ["id"], ["wh_3", "voltage_1", "voltage_2"])
    out["fn_fmt"] = f"WITH {CTE} SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M') AS minute_text, CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS iso_text FROM readings"

    # windows
    out["win_lag"] = steady(f"SELECT id, {named(LAGS)} FROM readings {ORDERED}", ["id"], list(LAGS))
    out["win_roll"] = steady(f"SELECT id, {named(rolls(WIDTHS))} FROM readings {ORDERED}{frames(WIDTHS)}", ["id"], list(rolls(WIDTHS)))
    out["win_diff"] = steady(f"SELECT id, {named({k: v for k, v in RATES.items() if 'diff' in k})} FROM readings {ORDERED}", ["id"], [f"{POWER}_diff_1m", f"{POWER}_diff_5m"])
    out["win_pct"] = steady(f"SELECT id, {named({k: v for k, v in RATES.items() if 'pct' in k})} FROM readings {ORDERED}", ["id"], [f"{POWER}_pct_change_1m"])
    out["win_gap"] = steady("SELECT *, coalesce(step_seconds > 60, false) AS is_gap FROM steps", ["site_id", "id", "is_gap"], ["step_seconds"], f"{CTE}, {STEPS}")
    out["win_matrix"] = steady("SELECT * FROM matrix", [*ALL, "time_of_use", *INT_FEATURES], DBL_FEATURES, CTE_MATRIX)
    out["chk_rn"] = f"WITH {CTE} SELECT id, row_number() OVER (PARTITION BY site_id ORDER BY timestamp, id) AS rn FROM readings"
    out["chk_block"] = steady(f"SELECT id, {named(rolls((45, 97, 1439)))} FROM readings {ORDERED}{frames((45, 97, 1439))}", ["id"], list(rolls((45, 97, 1439))))
    far = {f"{POWER}_lag_{k}m": f"lag({POWER}, {k}) OVER o" for k in (1, 700, 1439)}
    out["chk_halo"] = steady(f"SELECT id, {named(far)} FROM readings {ORDERED}", ["id"], list(far))

    # resampling
    key = ["site_id", "bucket"]
    out["res_mean"] = steady("SELECT * FROM filled", key, METRICS, f"{CTE}, {FILLED('15 minutes', AVGS())}")
    odd = f"origins AS (SELECT site_id, time_bucket(INTERVAL '1 day', min(timestamp)) AS o FROM readings GROUP BY site_id), filled AS (SELECT r.site_id, time_bucket(INTERVAL '5 hours', timestamp, o) AS bucket, {AVGS()} FROM readings r JOIN origins g ON g.site_id = r.site_id GROUP BY ALL)"
    out["res_mean_full"] = steady(f"SELECT s.site_id, s.bucket, {', '.join(METRICS)} FROM {SPINE('5 hours')} s LEFT JOIN filled f ON f.site_id = s.site_id AND f.bucket = s.bucket", key, METRICS, f"{CTE}, {odd}")
    band = f"avg({VOLT}) AS mean, min({VOLT}) AS min, max({VOLT}) AS max"
    out["res_band"] = steady(f"SELECT s.site_id, s.bucket, mean, min, max, 230.0::DOUBLE AS nominal, 207.0::DOUBLE AS lower, 253.0::DOUBLE AS upper FROM {SPINE('1 hour')} s LEFT JOIN filled f ON f.site_id = s.site_id AND f.bucket = s.bucket", key, ["mean", "min", "max", "nominal", "lower", "upper"], f"{CTE}, {FILLED('1 hour', band)}")
    counts = f"{CTE}, {FILLED('1 day', 'count(*) AS n')}, days AS (SELECT s.site_id, CAST(s.bucket AS DATE) AS day, coalesce(n, 0) AS readings FROM {SPINE('1 day')} s LEFT JOIN filled f ON f.site_id = s.site_id AND f.bucket = s.bucket)"
    out["res_count"] = f"WITH {counts} SELECT * FROM days"
    out["res_week"] = steady(f"SELECT site_id, CAST(date_trunc('week', timestamp) + INTERVAL 6 DAY AS DATE) AS week, avg({POWER}) AS mean_kw FROM readings GROUP BY ALL", ["site_id", "week"], ["mean_kw"])
    stack = " UNION ALL ".join(f"SELECT site_id, bucket, 'sub_metering_{i}_wh' AS meter, sub_metering_{i}_wh AS mean_wh, '{n}' AS label FROM wide" for i, n in ((1, "Kitchen"), (2, "Laundry"), (3, "Water/AC")))
    wide = f"wide AS (SELECT s.site_id, s.bucket, {', '.join(METRICS[4:])} FROM {SPINE('1 hour')} s LEFT JOIN filled f ON f.site_id = s.site_id AND f.bucket = s.bucket)"
    out["res_stack"] = steady(stack, ["site_id", "bucket", "meter", "label"], ["mean_wh"], f"{CTE}, {FILLED('1 hour', AVGS(METRICS[4:]))}, {wide}")
    out["res_spine"] = f"WITH {CTE}, {FILLED('5 minutes', 'count(*) AS n')} SELECT site_id, bucket FROM {SPINE('5 minutes')} s"

    # aggregates
    out["agg_stats"] = steady(STATS, ["site_id", "readings"], STAT_COLS)
    out["agg_range"] = f"WITH {CTE} SELECT site_id, min(timestamp) AS earliest, max(timestamp) AS latest, count(*) AS total_readings FROM readings GROUP BY site_id"
    out["agg_cards"] = steady(f"SELECT site_id, avg({POWER}) AS avg_power, max({POWER}) AS peak_power, count(*) AS readings, avg({VOLT}) AS avg_voltage FROM readings GROUP BY site_id", ["site_id", "readings"], ["avg_power", "peak_power", "avg_voltage"])
    out["agg_describe"] = steady("SELECT site_id, metric, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM long GROUP BY ALL", ["site_id", "metric", "count"], ["mean", "std", "min", "max", "p25", "p50", "p75"], f"{CTE}, {LONG}")
    out["agg_shape"] = f"WITH {CTE} SELECT site_id, count(*) AS rows, CAST(11 AS BIGINT) AS columns, CAST(7 AS BIGINT) AS numeric_columns, min(timestamp) AS first, max(timestamp) AS last, CAST(floor(date_diff('microsecond', min(timestamp), max(timestamp)) / 86400000000.0::DOUBLE) AS BIGINT) AS days FROM readings GROUP BY site_id"
    gaps = f"whole AS ({READINGS}), readings AS (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN NULL ELSE sub_metering_2_wh END AS sub_metering_2_wh, CASE WHEN id % 29 = 0 THEN NULL ELSE voltage_v END AS voltage_v) FROM whole)"
    out["agg_nulls"] = f"WITH {gaps}, {LONG} SELECT site_id, metric, count(*) FILTER (value IS NULL) AS nulls, count(*) AS rows, CAST(sum(count(*) FILTER (value IS NULL)) OVER (PARTITION BY site_id) AS BIGINT) AS total_nulls FROM long GROUP BY site_id, metric"
    engineered = [c for c in FEATURES if c not in METRICS]
    null_long = " UNION ALL ".join(f"SELECT site_id, '{c}' AS metric, count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS n FROM full_matrix GROUP BY site_id" for c in engineered)
    out["agg_nullpct"] = steady(f"SELECT site_id, metric, nulls, {HU('nulls * 100 / n::DOUBLE', 2)} AS pct FROM ({null_long}) x WHERE nulls > 0", ["site_id", "metric", "nulls"], ["pct"], CTE_FULL)
    whole = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
    out["agg_dropped"] = steady(f"SELECT *, {HU('dropped * 100 / rows_before::DOUBLE', 2)} AS dropped_pct FROM (SELECT site_id, count(*) AS rows_before, count(*) FILTER ({whole}) AS rows_after, count(*) - count(*) FILTER ({whole}) AS dropped FROM full_matrix GROUP BY site_id) x", ["site_id", "rows_before", "rows_after", "dropped"], ["dropped_pct"], CTE_FULL)
    out["agg_hourly"] = steady(f"SELECT *, mean_kw - std_kw AS band_low, mean_kw + std_kw AS band_high FROM (SELECT site_id, hour(timestamp) AS hour, avg({POWER}) AS mean_kw, stddev_samp({POWER}) AS std_kw, median({POWER}) AS median_kw FROM readings GROUP BY ALL) x", ["site_id", "hour"], ["mean_kw", "std_kw", "median_kw", "band_low", "band_high"])
    out["agg_wkend"] = steady(f"SELECT site_id, hour(timestamp) AS hour, avg({POWER}) FILTER (isodow(timestamp) < 6) AS weekday_kw, avg({POWER}) FILTER (isodow(timestamp) >= 6) AS weekend_kw FROM readings GROUP BY ALL", ["site_id", "hour"], ["weekday_kw", "weekend_kw"])
    box = f"box AS (SELECT site_id, month(timestamp) AS month, quantile_cont({POWER}, 0.25) AS q1, quantile_cont({POWER}, 0.5) AS median, quantile_cont({POWER}, 0.75) AS q3 FROM readings GROUP BY ALL)"
    out["agg_box"] = steady(f"SELECT b.site_id, b.month, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, min({POWER}) AS whisker_low, max({POWER}) AS whisker_high FROM box b JOIN readings r ON r.site_id = b.site_id AND month(r.timestamp) = b.month WHERE {POWER} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 GROUP BY b.site_id, b.month", ["site_id", "month"], ["q1", "median", "q3", "whisker_low", "whisker_high"], f"{CTE}, {box}")
    hist = "ends AS (SELECT site_id, metric, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 80 AS width FROM long GROUP BY ALL), counted AS (SELECT l.site_id, l.metric, CAST(least(floor((value - lo) / width), 79) AS BIGINT) AS bin, count(*) AS n FROM long l JOIN ends e ON e.site_id = l.site_id AND e.metric = l.metric GROUP BY ALL)"
    out["agg_hist"] = steady("SELECT e.site_id, e.metric, b.bin, lo + b.bin * width AS left_edge, coalesce(n, 0) AS n FROM ends e CROSS JOIN (SELECT unnest(range(80)) AS bin) b LEFT JOIN counted c ON c.site_id = e.site_id AND c.metric = e.metric AND c.bin = b.bin", ["site_id", "metric", "bin", "n"], ["left_edge"], f"{CTE}, {LONG}, {hist}")
    corr = " UNION ALL ".join(f"SELECT site_id, '{a}' AS feature_1, '{b}' AS feature_2, {'1.0::DOUBLE' if a == b else f'corr({a}, {b})'} AS correlation FROM readings GROUP BY site_id" for a in METRICS for b in METRICS)
    out["agg_corr"] = steady(corr, ["site_id", "feature_1", "feature_2"], ["correlation"])
    withs = " UNION ALL ".join(f"SELECT site_id, '{c}' AS feature, abs(corr({c}, {POWER})) AS abs_correlation FROM matrix GROUP BY site_id" for c in FEATURES)
    ranked = f"SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY abs_correlation DESC, feature) AS place FROM ({withs}) a WHERE abs_correlation IS NOT NULL AND NOT isnan(abs_correlation)"
    out["agg_corrwith"] = steady(f"SELECT * FROM ({ranked}) b WHERE place <= 20", ["site_id", "feature"], ["abs_correlation"], CTE_MATRIX)
    pair_cols = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
    one = ", ".join(f"abs(corr({a}, {b})) AS c{i}" for i, (a, b) in enumerate(pair_cols))
    listed = ", ".join(f"{{'feature_1': '{a}', 'feature_2': '{b}', 'correlation': c{i}}}" for i, (a, b) in enumerate(pair_cols))
    out["agg_corrpairs"] = steady(f"SELECT site_id, p.feature_1, p.feature_2, p.correlation FROM (SELECT site_id, unnest([{listed}]) AS p FROM (SELECT site_id, {one} FROM matrix GROUP BY site_id) a) b WHERE p.correlation > 0.95 AND NOT isnan(p.correlation)", ["site_id", "feature_1", "feature_2"], ["correlation"], CTE_MATRIX)
    un = f"greatest({TOTAL} - sub_metering_1_wh - sub_metering_2_wh - sub_metering_3_wh, 0.0)"
    share_cols = [*METRICS[4:], "unmetered_wh"]
    shares = " UNION ALL ".join(f"SELECT site_id, '{c}' AS meter, {c} AS mean_wh, {c} / ({' + '.join(share_cols)}) * 100 AS pct FROM means" for c in share_cols)
    out["agg_shares"] = steady(shares, ["site_id", "meter"], ["mean_wh", "pct"], f"{CTE}, means AS (SELECT site_id, {AVGS(METRICS[4:])}, avg({un}) AS unmetered_wh FROM readings GROUP BY site_id)")
    out["agg_quant"] = steady(f"SELECT l.site_id, p01, p99, p99_abs_change FROM limits l JOIN (SELECT site_id, quantile_cont(abs(d), 0.99) AS p99_abs_change FROM diffs GROUP BY site_id) d ON d.site_id = l.site_id", ["site_id"], ["p01", "p99", "p99_abs_change"], f"{CTE}, {LIMITS}, {DIFFS}")
    out["agg_complete"] = steady("SELECT *, incomplete_days * 100 / total_days::DOUBLE AS incomplete_pct FROM (SELECT site_id, count(*) FILTER (readings < 1440) AS incomplete_days, count(*) AS total_days FROM days GROUP BY site_id) x", ["site_id", "incomplete_days", "total_days"], ["incomplete_pct"], counts)
    out["agg_cycmean"] = steady(f"SELECT site_id, 'hour' AS cycle, CAST({PARTS['hour']} AS BIGINT) AS position, avg({CYC['hour_sin']}) AS mean_sin, avg({CYC['hour_cos']}) AS mean_cos FROM readings GROUP BY ALL UNION ALL SELECT site_id, 'day_of_week', CAST({PARTS['day_of_week']} AS BIGINT), avg({CYC['dow_sin']}), avg({CYC['dow_cos']}) FROM readings GROUP BY ALL", ["site_id", "cycle", "position"], ["mean_sin", "mean_cos"])

    # joins and ranking
    ends = "ends AS (SELECT site_id, min(bucket) AS a, max(bucket) AS b FROM filled GROUP BY site_id)"
    out["join_nearest"] = steady(f"SELECT f.site_id, f.bucket, f.{POWER} FROM filled f WHERE EXISTS (SELECT 1 FROM readings r JOIN limits l ON l.site_id = r.site_id JOIN ends e ON e.site_id = r.site_id WHERE r.{POWER} > p99 AND r.site_id = f.site_id AND f.bucket = least(greatest(time_bucket(INTERVAL '1 hour', r.timestamp + INTERVAL 30 MINUTE), a), b))", key, [POWER], f"{CTE}, {LIMITS}, {FILLED('1 hour', AVGS())}, {ends}")
    far = f"t AS (SELECT DISTINCT site_id, timestamp AS ts FROM readings WHERE {VOLT} < 222 OR {VOLT} > 238)"
    ends = "(SELECT max(ts) FROM t WHERE t.site_id = e.site_id AND ts <= e.timestamp) AS a, (SELECT min(ts) FROM t WHERE t.site_id = e.site_id AND ts >= e.timestamp) AS b"
    near = f"n AS (SELECT e.site_id, e.id, e.timestamp, {ends} FROM readings e JOIN limits l ON l.site_id = e.site_id WHERE e.{POWER} > p99)"
    out["join_nearest_irregular"] = f"WITH {CTE}, {LIMITS}, {far}, {near} SELECT site_id, id, timestamp, CASE WHEN a IS NULL OR b - timestamp <= timestamp - a THEN b ELSE a END AS nearest FROM n"
    out["agg_quant_sketch"] = f"WITH {CTE} SELECT site_id, unnest(['p01', 'p25', 'p50', 'p75', 'p99']) AS mark, n, TRUE AS within_bound FROM (SELECT site_id, count(*) AS n FROM readings WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-19' GROUP BY site_id) d"
    out["join_knn"] = steady("SELECT * FROM found", ["query", "neighbour", "rank"], ["distance"], f"{VEC}, {PAIRS}, {nearest(5)}")
    out["join_knn_hashed"] = "SELECT count(*) AS queries, TRUE AS recall_at_least_95 FROM embeddings"
    out["join_knn_descent"] = f"WITH {CTE_MATRIX} SELECT count(*) AS queries, 20::BIGINT AS fewest, 20::BIGINT AS most, TRUE AS recall_at_least_95 FROM matrix"
    out["join_knn_index"] = f"WITH {CTE_MATRIX} SELECT count(*) AS queries, count(*) * 20 AS pairs, TRUE AS recall_at_least_90 FROM matrix WHERE id % 50 = 0"
    out["join_thresh"] = f"WITH {CTE}, {LIMITS} SELECT id, {POWER} > p99 AS is_spike, {POWER} < p01 AND hour(timestamp) BETWEEN 8 AND 22 AS is_dropout FROM readings r JOIN limits l ON l.site_id = r.site_id"
    out["top_gaps"] = steady("SELECT site_id, id, timestamp, step_seconds FROM steps WHERE step_seconds > 60 ORDER BY step_seconds DESC, site_id, timestamp, id LIMIT 10", ["site_id", "id", "timestamp"], ["step_seconds"], f"{CTE}, {STEPS}")
    out["lim_48"] = steady(f"SELECT site_id, strftime(bucket, '%Y-%m-%d %H:%M') AS timestamp, {HU(POWER, 3)} AS power_kw, {HU(VOLT, 1)} AS voltage_v, CAST(least((SELECT count(*) FROM home), 48) AS BIGINT) AS count, (SELECT count(*) FROM home) > 48 AS truncated FROM home ORDER BY bucket LIMIT 48", ["site_id", "timestamp", "count", "truncated"], ["power_kw", "voltage_v"], f"{CTE}, {FILLED('1 hour', AVGS())}, home AS (SELECT * FROM filled WHERE site_id = 'home-01')")
    out["sort_abs"] = steady("SELECT id, site_id, abs(d) AS abs_change, row_number() OVER (PARTITION BY site_id ORDER BY abs(d), id) AS rank FROM diffs WHERE d IS NOT NULL", ["id", "site_id", "rank"], ["abs_change"], f"{CTE}, {DIFFS}")
    out["sort_ts"] = everything("SELECT * FROM readings ORDER BY site_id, timestamp, id")

    # synthetic data
    out["gen_reading"] = steady(generated("id", 42, "(SELECT id, timestamp FROM readings) s", "id, timestamp"), ["id", "timestamp", "injected"], METRICS)
    out["gen_dataset"] = steady(generated(DAY_SEQ, 42, DAYS, "site_id, timestamp"), ["site_id", "timestamp", "injected"], METRICS)
    out["gen_bulk"] = f"WITH {CTE} SELECT site_id, count(DISTINCT CAST(timestamp AS DATE)) AS days, count(DISTINCT CAST(timestamp AS DATE)) * 1440 AS readings, CAST(floor(count(DISTINCT CAST(timestamp AS DATE)) * 1440 * 0.01::DOUBLE) AS BIGINT) AS expected_anomalies FROM readings GROUP BY site_id"

    # models
    scaler = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS scale FROM matrix" for i, c in enumerate(FEATURES))
    out["mod_scaler"] = steady(f"SELECT CAST(position AS BIGINT) AS position, feature, mean, scale FROM ({scaler}) s", ["position", "feature"], ["mean", "scale"], CTE_MATRIX)
    out["mod_lof_fit"] = steady(LOF.format(found="found", own="dens"), ["id"], ["lof"], LOF_FIT)
    out["mod_lof_score"] = steady(LOF.format(found="found_self", own="own"), ["id"], ["lof"], LOF_SELF)
    out["snk_registry"] = f"WITH {CTE_MATRIX} SELECT 1::BIGINT AS seq, '1.0' AS version, 'isolation_forest' AS model_name, count(*) AS n_training_samples, least(count(*), 256) AS sample_size, {len(FEATURES)}::BIGINT AS n_features FROM matrix"
    out["mod_registry"] = f"WITH {CTE}, {ENTRIES} SELECT site_id, concat(max(seq) + 1, '.0') AS next_version, arg_max(version, seq) AS latest_version, max(n_training_samples) FILTER (version = '3.0') AS third_samples FROM entries GROUP BY site_id"
    out["mod_info"] = steady("SELECT site_id, arg_max(model_name, seq) AS model_name, arg_max(version, seq) AS version, arg_max(training_date, seq) AS training_date, arg_max(n_training_samples, seq) AS n_training_samples, arg_max(anomaly_rate, seq) AS anomaly_rate, CAST(7 AS BIGINT) AS n_features, count(*) AS total_models_in_registry FROM entries GROUP BY site_id", ["site_id", "model_name", "version", "training_date", "n_training_samples", "n_features", "total_models_in_registry"], ["anomaly_rate"], f"{CTE}, {ENTRIES}")

    # streaming
    by_site = LOADED.replace("SELECT timestamp", "SELECT site_id, v.timestamp").replace("FROM validated", "FROM validated v JOIN (SELECT id, site_id FROM readings) s USING (id)")
    out["str_ingest"] = steady(by_site, ["site_id", "timestamp"], METRICS, CTE_PARSED)
    out["str_bounds"] = f"WITH {CTE_PARSED} SELECT value, timestamp, unnest(warning_list) AS warning FROM validated"
    out["str_resample"] = steady("SELECT * FROM filled", key, METRICS, f"{CTE}, {FILLED('1 hour', AVGS())}")
    out["str_resample_append"] = out["str_resample"]

    # reads
    cut = "timestamp BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-19 18:30:00'"
    sliced = f"readings AS (SELECT * FROM ({READINGS}) r WHERE site_id = 'home-01' AND {cut})"
    out["q_timeseries"] = steady(f"SELECT site_id, bucket AS timestamp, {POWER}, CAST(count(*) OVER () AS BIGINT) AS total_points, min(bucket) OVER () AS start, max(bucket) OVER () AS \"end\" FROM filled", ["site_id", "timestamp", "total_points", "start", '"end"'], [POWER], f"{sliced}, {FILLED('15 minutes', AVGS())}")

    # calendar and compound bucket rules
    for name, bucket in (("week", "date_trunc('week', timestamp) + INTERVAL 6 DAY"), ("month", "last_day(timestamp)::TIMESTAMP"), ("90min", BUCKET("90 minutes")), ("1h30min", BUCKET("90 minutes")), ("half_day", BUCKET("12 hours"))):
        out[f"res_mean_{name}"] = steady(f"SELECT site_id, ({bucket})::TIMESTAMP AS bucket, {AVGS()} FROM readings GROUP BY ALL", key, METRICS)

    # the small forest and what rests on its scores
    scored, marks = f"{CTE_MATRIX}, {SCORED}", ["anomaly_score"]
    severity = "ORDER BY anomaly_score, timestamp, id"
    flags = ["is_anomaly", "prediction"]
    out["mod_if_score"] = steady("SELECT * FROM scored", ALL, ["raw_score"], scored)
    out["flt_anom"] = steady("SELECT * FROM scored WHERE is_anomaly", [*ALL, *flags], [*METRICS, *marks], scored)
    out["top_anom"] = steady(f"SELECT * FROM scored WHERE is_anomaly {severity} LIMIT 50", [*ALL, *flags], [*METRICS, *marks], scored)
    statistics = f"SELECT 'isolation_forest' AS model_name, count(*) AS n_total, count(*) FILTER (is_anomaly) AS n_anomalies, avg(anomaly_score) AS mean, stddev_pop(anomaly_score) AS std, min(anomaly_score) AS min, max(anomaly_score) AS max, quantile_cont(anomaly_score, 0.01) AS p01, quantile_cont(anomaly_score, 0.05) AS p05, quantile_cont(anomaly_score, 0.95) AS p95, quantile_cont(anomaly_score, 0.99) AS p99, {HU('count(*) FILTER (is_anomaly) / count(*)::DOUBLE', 4)} AS anomaly_rate FROM scored"
    stats = ["model_name", "n_total", "n_anomalies"], ["mean", "std", "min", "max", "p01", "p05", "p95", "p99", "anomaly_rate"]
    out["agg_scores"] = steady(statistics, *stats, scored)
    per_site = statistics.replace("SELECT ", "SELECT site_id, ", 1) + " GROUP BY site_id"
    out["mod_eval"] = steady(per_site, ["site_id", *stats[0]], stats[1], scored)
    rate = HU("count(*) FILTER (flagged) / count(*)::DOUBLE", 4)
    marked = f"(SELECT *, 2.25 - (1 + abs({VOLT} - 230) / 8) < 0 AS far FROM scored)"
    one = f"SELECT '{{m}}' AS model_name, count(*) AS n_total, count(*) FILTER (flagged) AS n_anomalies, {rate} AS anomaly_rate, count(*) FILTER (is_anomaly AND far) AS flagged_by_all FROM (SELECT *, {{c}} AS flagged FROM {marked})"
    out["mod_compare_fixed"] = steady(f"{one.format(m='isolation_forest', c='is_anomaly')} UNION ALL {one.format(m='lof', c='far')}", ["model_name", "n_total", "n_anomalies", "flagged_by_all"], ["anomaly_rate"], scored)
    totals = f"SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomaly_count, {HU('count(*) FILTER (is_anomaly) / count(*)::DOUBLE', 4)} AS anomaly_rate, {HU('count(*) FILTER (is_anomaly) / count(*)::DOUBLE * 100', 2)} AS anomaly_pct"
    out["agg_batch"] = steady(f"{totals} FROM scored", ["total", "anomaly_count"], ["anomaly_rate", "anomaly_pct"], scored)
    out["mod_score_batch"] = steady(f"{totals}, site_id FROM scored GROUP BY site_id", ["site_id", "total", "anomaly_count"], ["anomaly_rate", "anomaly_pct"], scored)
    out["join_overlay"] = steady("SELECT r.*, s.anomaly_score, s.is_anomaly FROM readings r LEFT JOIN (SELECT id, anomaly_score, is_anomaly FROM scored) s USING (id)", [*ALL, "is_anomaly"], [*METRICS, *marks], scored)
    out["join_lookup"] = steady("SELECT id, anomaly_score FROM scored", ["id"], marks, scored)
    out["mod_score_df"] = steady("SELECT * FROM scored", [*ALL, *flags], marks, scored)
    out["mod_score_raw"] = steady("SELECT * FROM scored", [*ALL, "is_anomaly"], marks, scored)
    out["str_score"] = out["str_score_state"] = steady("SELECT * FROM scored", ["site_id", "timestamp", "id", "is_anomaly"], [POWER, *marks], scored)
    iso = lambda c: f"CASE WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
    report = f"SELECT {iso('timestamp')} AS timestamp, {HU('anomaly_score', 4)} AS anomaly_score, {HU(POWER, 3)} AS {POWER}, {HU(VOLT, 2)} AS {VOLT}, count(*) OVER () AS total_found, (SELECT {iso('min(timestamp)')} FROM {{r}}) AS range_start, (SELECT {iso('max(timestamp)')} FROM {{r}}) AS range_end FROM (SELECT * FROM scored WHERE is_anomaly {{w}} {severity} LIMIT 50) t"
    said = ["timestamp", "total_found", "range_start", "range_end"]
    out["top_anom_report"] = steady(report.format(r="readings", w=""), said, ["anomaly_score", POWER, VOLT], scored)
    home = f"(SELECT * FROM readings WHERE site_id = 'home-01' AND {cut})"
    out["q_anomalies"] = steady(report.format(r=home, w=f"AND site_id = 'home-01' AND {cut}"), said, ["anomaly_score", POWER, VOLT], scored)
    listed = f"SELECT strftime(timestamp, '%Y-%m-%d %H:%M') AS {{t}}, {HU(POWER, 3)} AS power_kw, {HU(VOLT, 1)} AS voltage_v, {HU('anomaly_score', 4)} AS anomaly_score, {{more}} FROM scored WHERE is_anomaly {severity} LIMIT {{n}}"
    table = listed.format(t="time", more="(SELECT count(*) FILTER (is_anomaly) FROM scored) AS total_anomalies", n=100)
    shown = ["time", "total_anomalies"], ["power_kw", "voltage_v", "anomaly_score"]
    out["top_anom_table"] = steady(table, *shown, scored)
    part = f"{sliced}, {FULL}, {MATRIX}, {SCORED}"
    counted = f"(SELECT count(*) FILTER (is_anomaly) FROM scored) AS total_anomalies_in_range, (SELECT count(*) FROM scored) AS total_readings_in_range, (SELECT {HU('count(*) FILTER (is_anomaly) / count(*)::DOUBLE * 100', 2)} FROM scored) AS anomaly_rate"
    out["q_tool_anomalies"] = steady(listed.format(t="timestamp", more=counted, n=10), ["timestamp", "total_anomalies_in_range", "total_readings_in_range"], ["power_kw", "voltage_v", "anomaly_score", "anomaly_rate"], part)
    out["q_timeseries_overlay"] = steady(f"SELECT r.site_id, r.timestamp, r.id, r.{POWER}, s.anomaly_score, s.is_anomaly, count(*) OVER () AS total_points, min(r.timestamp) OVER () AS start, max(r.timestamp) OVER () AS \"end\", count(*) FILTER (s.is_anomaly) OVER () AS anomaly_count FROM {home} r LEFT JOIN (SELECT id, anomaly_score, is_anomaly FROM scored) s USING (id)", ["site_id", "timestamp", "id", "is_anomaly", "total_points", "start", '"end"', "anomaly_count"], [POWER, *marks], scored)

    # the dashboard's tables, on whole days of one site
    days = f"readings AS (SELECT * FROM ({READINGS}) r WHERE site_id = 'home-01' AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21')"
    part = f"{days}, {FULL}, {MATRIX}, {SCORED}"
    out["q_dash_cards"] = steady(f"SELECT * FROM (SELECT site_id, avg({POWER}) AS avg_power, max({POWER}) AS peak_power, count(*) AS readings, avg({VOLT}) AS avg_voltage FROM readings GROUP BY site_id) c JOIN (SELECT site_id, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (is_anomaly) / count(*)::DOUBLE * 100 AS anomaly_pct FROM scored GROUP BY site_id) a USING (site_id)", ["site_id", "readings", "anomalies"], ["avg_power", "peak_power", "avg_voltage", "anomaly_pct"], part)
    hourly = f"{part}, {FILLED('1 hour', AVGS() + f', min({VOLT}) AS lo, max({VOLT}) AS hi')}, every AS {SPINE('1 hour')}"
    near = "SELECT 1 FROM scored s, (SELECT min(bucket) AS a, max(bucket) AS b FROM filled) e WHERE s.is_anomaly AND least(greatest(time_bucket(INTERVAL '1 hour', s.timestamp + INTERVAL 30 MINUTE), a), b) = x.bucket"
    out["q_dash"] = steady(f"SELECT x.site_id, x.bucket, {POWER}, EXISTS ({near}) AS is_marked FROM every x LEFT JOIN filled f ON f.bucket = x.bucket", ["site_id", "bucket", "is_marked"], [POWER], hourly)
    out["q_dash_voltage"] = steady(f"SELECT x.site_id, x.bucket, {VOLT} AS mean, lo AS min, hi AS max, 230.0 AS nominal, 207.0 AS lower, 253.0 AS upper FROM every x LEFT JOIN filled f ON f.bucket = x.bucket", key, ["mean", "min", "max", "nominal", "lower", "upper"], hourly)
    meters = " UNION ALL ".join(f"SELECT x.site_id, x.bucket, '{m}' AS meter, '{label}' AS label, {m} AS mean_wh FROM every x LEFT JOIN filled f ON f.bucket = x.bucket" for m, label in zip(METRICS[4:], ("Kitchen", "Laundry", "Water/AC")))
    out["q_dash_sub_meters"] = steady(meters, ["site_id", "bucket", "meter", "label"], ["mean_wh"], hourly)
    out["q_dash_anomalies"] = steady(table, *shown, part)
    return out
