"""The registered queries in DuckDB SQL, written apart from the Spark operators."""

from __future__ import annotations


def rounded(sql: str, digits: int) -> str:
    """Doubles of a query rounded; the columns that are doubles are declared in a first line `-- doubles: a, b`."""
    head, _, body = sql.partition("\n")
    if not head.startswith("-- doubles:"):
        return sql
    names = [n.strip() for n in head.removeprefix("-- doubles:").split(",") if n.strip()]
    swap = ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
    return f"SELECT * REPLACE ({swap}) FROM (\n{body}\n)" if names else body


def bars(minutes: int, name: str) -> str:
    return f"""{name} AS (
  SELECT 'SYN' AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS t, time_bucket(INTERVAL '{minutes} minutes', ts) - INTERVAL 5 HOUR AS lt,
         first(100.0 + value ORDER BY ts, event_id) AS open, max(100.0 + value) AS high, min(100.0 + value) AS low, last(100.0 + value ORDER BY ts, event_id) AS close,
         count(*) AS volume, 20::INT AS spread, sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT))::BIGINT AS real_volume
  FROM events GROUP BY ALL)"""


B1, B15, B60 = bars(1, "b1"), bars(15, "b15"), bars(60, "b60")
MINUTE = "(hour({0}) * 60 + minute({0}))"
LM = MINUTE.format("lt")
NY = f"{LM} >= 420 AND {LM} < 600"


def full(name: str) -> str:
    return f"SELECT symbol, t AS timestamp_utc, lt AS timestamp_cot, open, high, low, close, volume, spread, real_volume FROM {name}"


BARS_M15 = f"-- doubles: open, high, low, close\nWITH {B15} {full('b15')}"
BARS_H1 = f"-- doubles: open, high, low, close\nWITH {B60} {full('b60')}"
SCAN_DAY = "-- doubles: value\nSELECT event_id, ts, ts - INTERVAL 5 HOUR AS timestamp_cot, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-11 05:00:00'"
WEEKDAYS = f"-- doubles: close\nWITH {B15} SELECT t AS timestamp_utc, lt AS timestamp_cot, close FROM b15 WHERE isodow(lt) <= 5"
SESSION_NEW_YORK = f"-- doubles: session_progress\nWITH {B15} SELECT lt AS timestamp_cot, 'new_york' AS session_code, lt::DATE AS session_date, ({LM} - 420)::INT AS minute_of_session, ({LM} - 420) / 180.0::DOUBLE AS session_progress FROM b15 WHERE {NY}"
SESSION_OVERNIGHT = f"""-- doubles: session_progress
WITH {B15} SELECT lt AS timestamp_cot, 'overnight' AS session_code, CASE WHEN {LM} < 120 THEN lt::DATE - 1 ELSE lt::DATE END AS session_date,
  (({LM} - 1320 + 1440) % 1440)::INT AS minute_of_session, (({LM} - 1320 + 1440) % 1440) / 240.0::DOUBLE AS session_progress FROM b15 WHERE {LM} >= 1320 OR {LM} < 120"""
SESSION_COLUMNS = f"""-- doubles: session_progress
WITH {B15}, c AS (SELECT lt, lt + INTERVAL 15 MINUTE AS ot FROM b15)
SELECT lt AS timestamp_cot, ot AS observation_time_cot, lt::DATE AS session_date, {MINUTE.format('ot')}::INT AS minute_of_session, {MINUTE.format('ot')} / 1440.0::DOUBLE AS session_progress FROM c"""
PERIOD_MONTHS = f"WITH {B60} SELECT lt::DATE AS date, count(*) AS bars FROM b60 WHERE t >= TIMESTAMP '2024-01-01 05:00:00' AND t < TIMESTAMP '2024-02-01 05:00:00' GROUP BY 1"
TIME_FEATURES = f"""-- doubles: time_sin, time_cos
WITH {B15} SELECT t AS timestamp_utc, {LM}::INT AS minute_of_day, isodow(lt)::INT AS iso_weekday, sin({LM} * 2 * pi() / 1440) AS time_sin, cos({LM} * 2 * pi() / 1440) AS time_cos,
  dayofyear(lt)::INT AS day_of_year, month(lt)::INT AS month FROM b15"""
ZONES = f"""-- doubles: offset_hours
WITH {B60}, days AS (SELECT DISTINCT t::DATE AS date FROM b60)
SELECT date, 'America/Bogota' AS zone, -5.0::DOUBLE AS offset_hours, false AS summer_time FROM days UNION ALL SELECT date, 'Europe/Athens', 2.0::DOUBLE, false FROM days"""
DEDUP = f"-- doubles: open, close\nWITH {B60} SELECT t AS timestamp_utc, open, close, volume FROM b60"
QUALITY = f"""WITH {B15}, x AS (
  SELECT open, CASE WHEN minute(t) = 15 THEN open - 1 ELSE high END AS high, CASE WHEN minute(t) = 30 THEN NULL ELSE low END AS low, close, volume, spread, real_volume FROM b15)
SELECT count(*) AS rows, count(*) FILTER (WHERE low IS NULL) AS nulls, count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS non_positive,
  count(*) FILTER (WHERE high < greatest(open, close)) AS high_below, count(*) FILTER (WHERE low > least(open, close)) AS low_above, count(*) FILTER (WHERE high < low) AS high_below_low,
  count(*) FILTER (WHERE least(volume, spread, real_volume) < 0) AS negative_volume, 0::BIGINT AS repeated_times FROM x"""

TICKS = """tk AS (
  SELECT ts, ts - INTERVAL 5 HOUR AS lt, event_id AS seq, 100.0 + value AS bid, 100.0 + value + 0.5 AS ask,
         CASE event_type WHEN 'purchase' THEN 100.0 + value + 0.5 WHEN 'error' THEN 100.0 + value ELSE 0.0 END AS last,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS volume, CASE WHEN event_type = 'signup' THEN value ELSE 0.0 END AS volume_real
  FROM events), pr AS (
  SELECT *, CASE WHEN last > 0 THEN last ELSE (bid + ask) / 2 END AS price, CASE WHEN volume_real > 0 THEN volume_real WHEN volume > 0 THEN volume ELSE 1.0 END AS weight FROM tk), sd AS (
  SELECT *, CASE WHEN last > 0 AND last >= ask THEN 1.0 WHEN last > 0 AND last <= bid THEN -1.0 ELSE coalesce(sign(price - lag(price) OVER (ORDER BY ts, seq)), 0.0) END::DOUBLE AS side FROM pr), sg AS (
  SELECT *, side * weight AS delta, sum(side * weight) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS cvd FROM sd)"""
CUM = "ROWS UNBOUNDED PRECEDING"
VWAP_CTE = """vw AS (SELECT *, sum((high + low + close) / 3.0 * volume) OVER w / sum(volume) OVER w AS vwap, sum(pow((high + low + close) / 3.0, 2) * volume) OVER w / sum(volume) OVER w AS q
  FROM {0} WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING))"""
VWAP = f"-- doubles: vwap, sigma\nWITH {B15}, {VWAP_CTE.format('b15')} SELECT t AS timestamp_utc, vwap, sqrt(greatest(q - vwap * vwap, 0.0)) AS sigma FROM vw"
SIGNED = f"-- doubles: price, weight, side, delta, cvd\nWITH {TICKS} SELECT seq, price, weight, side, delta, cvd FROM sg"
ASOF_CVD = f"-- doubles: cvd\nWITH {B15}, {TICKS} SELECT b.t AS timestamp_utc, coalesce(s.cvd, 0.0) AS cvd FROM b15 b ASOF LEFT JOIN sg s ON b.t >= s.ts"
DIRECTIONS = f"""WITH {B1}, {B15}, {B60} SELECT a.t AS timestamp_utc, sign(a.close - a.open)::INT AS m1, coalesce(sign(b.close - b.open), 0)::INT AS m15, coalesce(sign(c.close - c.open), 0)::INT AS h1
FROM b1 a ASOF LEFT JOIN b15 b ON a.t >= b.t ASOF LEFT JOIN b60 c ON a.t >= c.t"""
CLUSTERS = f"""-- doubles: level, volume, net_delta
WITH {TICKS}, m AS (
  SELECT round_even(price / 0.5, 0)::BIGINT AS level_index, date_trunc('minute', lt) AS minute, sum(weight) AS w, sum(delta) AS d FROM sg WHERE {NY} GROUP BY ALL), l AS (
  SELECT level_index, sum(w) AS volume, sum(d) AS net_delta, first(minute ORDER BY w DESC, minute) AS minute FROM m GROUP BY ALL), r AS (
  SELECT *, row_number() OVER (ORDER BY volume DESC, level_index) AS down FROM l), u AS (
  SELECT *, row_number() OVER (PARTITION BY down > 3 ORDER BY volume, level_index) AS up FROM r)
SELECT level_index, level_index * 0.5::DOUBLE AS level, volume, net_delta, minute, CASE WHEN down <= 3 THEN 'HVN' WHEN up <= 2 THEN 'LVN' ELSE 'Neutral' END AS kind FROM u"""
DELTA_MINUTES = f"-- doubles: bar_delta\nWITH {TICKS} SELECT date_trunc('minute', ts) AS minute_utc, sum(delta) AS bar_delta FROM sg GROUP BY 1"
OPENING = f"""-- doubles: high, low, expansion, volume_z, vwap_deviation
WITH {B1}, {VWAP_CTE.format('b1')}, s AS (SELECT * FROM vw WHERE {NY}), base AS (
  SELECT min(lt)::DATE + INTERVAL 7 HOUR AS st, avg(volume) AS mean_v, stddev_pop(volume) AS sd FROM s), r AS (
  SELECT s.*, base.*, q.minutes, st + q.minutes * INTERVAL 1 MINUTE AS en FROM s, base, (VALUES (15), (30)) q(minutes)), i AS (
  SELECT minutes, max(high) AS high, first(lt ORDER BY high DESC, lt) AS high_at, min(low) AS low, first(lt ORDER BY low, lt) AS low_at, avg(volume) AS v, coalesce(stddev_samp(close - vwap), 0.0) AS vwap_deviation, any_value(mean_v) AS mean_v, any_value(sd) AS sd
  FROM r WHERE lt >= st AND lt < en GROUP BY minutes), o AS (SELECT minutes, max(high) AS hi, min(low) AS lo FROM r WHERE lt >= en GROUP BY minutes)
SELECT i.minutes, high, high_at, low, low_at, greatest(hi - high, low - lo, 0.0) AS expansion, CASE WHEN sd > 0 THEN (v - mean_v) / sd ELSE 0.0 END AS volume_z, vwap_deviation FROM i LEFT JOIN o USING (minutes)"""
SWEEPS = f"""-- doubles: price, divergence
WITH {B1}, {TICKS}, dm AS (SELECT date_trunc('minute', ts) AS mt, sum(delta) AS bd FROM sg GROUP BY 1), s AS (
  SELECT *, CASE WHEN count(high) OVER p >= 5 THEN max(high) OVER p END AS ph, CASE WHEN count(low) OVER p >= 5 THEN min(low) OVER p END AS pl FROM b1 WHERE {NY} WINDOW p AS (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), j AS (
  SELECT s.*, coalesce(dm.bd, 0.0) AS bd FROM s ASOF LEFT JOIN dm ON s.t >= dm.mt)
SELECT lt AS timestamp_cot, CASE WHEN high > ph THEN 'high' ELSE 'low' END AS kind, CASE WHEN high > ph THEN high ELSE low END AS price, abs(bd) AS divergence FROM j
WHERE (high > ph AND close < ph AND bd < 0) OR (low < pl AND close > pl AND bd > 0)"""

ANCHORED_CTE = """an AS (SELECT *, sum((high + low + close) / 3.0 * volume) OVER w / sum(volume) OVER w AS avwap, sum(sign(close - open)::DOUBLE * volume) OVER w AS cvd_proxy FROM b15 WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING))"""
ANCHORED = f"-- doubles: avwap, cvd_proxy\nWITH {B15}, {ANCHORED_CTE} SELECT t AS timestamp_utc, avwap, cvd_proxy FROM an"
PROFILE_CTE = """st AS (SELECT greatest((max(high) - min(low)) / 120, 0.01) AS step FROM b15), pf AS (
  SELECT round_even((high + low + close) / 3.0 / step, 0)::BIGINT AS level_index, any_value(step) AS step, sum(volume)::DOUBLE AS volume FROM b15, st GROUP BY 1)"""
PROFILE = f"-- doubles: level, volume\nWITH {B15}, {PROFILE_CTE} SELECT level_index, level_index * step AS level, volume, row_number() OVER (ORDER BY volume DESC, level_index) = 1 AS is_poc FROM pf"
DAILY_CTE = """dy AS (SELECT lt::DATE AS date, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume)::DOUBLE AS volume, count(*) AS bars FROM b15 GROUP BY 1), tr AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER (ORDER BY date)), abs(low - lag(close) OVER (ORDER BY date))) AS true_range FROM dy), da AS (
  SELECT *, avg(true_range) OVER (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr14 FROM tr)"""
DAILY = f"-- doubles: open, high, low, close, volume, true_range, atr14, expansion_atr\nWITH {B15}, {DAILY_CTE} SELECT date, open, high, low, close, volume, bars, true_range, atr14, CASE WHEN atr14 > 0 THEN (high - low) / atr14 ELSE 0.0 END AS expansion_atr FROM da"
LEVELS = f"""-- doubles: price
WITH {B15}, {ANCHORED_CTE}, {PROFILE_CTE}, x AS (
  SELECT first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, last(avwap ORDER BY t) AS avwap, (SELECT level_index * step FROM pf ORDER BY volume DESC, level_index LIMIT 1) AS poc FROM an)
SELECT 'open' AS level, open AS price FROM x UNION ALL SELECT 'high', high FROM x UNION ALL SELECT 'low', low FROM x UNION ALL SELECT 'close', close FROM x UNION ALL SELECT 'poc', poc FROM x UNION ALL SELECT 'avwap', avwap FROM x"""
DAILY_SWEEPS = f"""-- doubles: price, close
WITH {B15}, {DAILY_CTE}, p AS (SELECT *, max(high) OVER q AS ph, min(low) OVER q AS pl FROM da WINDOW q AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT date, CASE WHEN high > ph THEN 'high' ELSE 'low' END AS kind, CASE WHEN high > ph THEN high ELSE low END AS price, close FROM p WHERE (high > ph AND close < ph) OR (low < pl AND close > pl)"""
COVERAGE = f"-- doubles: share\nWITH {B15} SELECT count(DISTINCT lt::DATE) AS days, count(*) AS rows, min(lt) AS first, max(lt) AS last, 100.0 * count(DISTINCT lt::DATE) / 23 AS share FROM b15 WHERE lt::DATE >= DATE '2024-01-01' AND lt::DATE < DATE '2024-02-01' AND isodow(lt) <= 5"


def _roll(agg: str, col: str, n: int, prior: bool = False) -> str:
    frame = f"OVER (ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" if prior else f"OVER (ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} >= {n} THEN {agg}({col}) {frame} END"


EPS = "1e-12"
F1 = f"""f1 AS (SELECT *, close - open AS body, high - low AS bar_range, (high + low + close) / 3.0 AS tp, lt::DATE AS cd, t + INTERVAL 15 MINUTE AS ot, lt + INTERVAL 15 MINUTE AS olt,
  close / lag(close) OVER w - 1.0 AS return_15m, close / lag(close, 2) OVER w - 1.0 AS return_30m, close / lag(close, 4) OVER w - 1.0 AS return_60m, sign(close - lag(close) OVER w)::INT AS stp,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range FROM b15 WINDOW w AS (ORDER BY t)), f2 AS (
  SELECT *, {_roll('stddev_samp', 'return_15m', 4)} AS realized_vol_60m, {_roll('stddev_samp', 'return_15m', 16)} AS realized_vol_4h, ({_roll('sum', 'stp', 4)})::INT AS direction_balance_60m, {_roll('avg', 'true_range', 14)} AS atr,
    ({_roll('sum', 'volume', 4)})::BIGINT AS volume_sum_short, {_roll('avg', 'volume', 32, True)} AS volume_mean_prior, {_roll('stddev_samp', 'volume', 32, True)} AS volume_std_prior, {_roll('max', 'high', 16, True)} AS prior_high, {_roll('min', 'low', 16, True)} AS prior_low,
    sum(tp * volume) OVER (PARTITION BY cd ORDER BY t {CUM}) / sum(volume) OVER (PARTITION BY cd ORDER BY t {CUM}) AS daily_vwap FROM f1), f3 AS (
  SELECT *, daily_vwap - lag(daily_vwap) OVER (PARTITION BY cd ORDER BY t) AS daily_vwap_slope,
    CASE WHEN bar_range > {EPS} THEN body / bar_range ELSE 0.0 END AS body_to_range, CASE WHEN bar_range > {EPS} THEN (close - low) / bar_range ELSE 0.5 END AS close_location, sign(body)::INT AS candle_direction,
    CASE WHEN atr > {EPS} THEN bar_range / atr END AS range_atr, CASE WHEN atr > {EPS} THEN body / atr END AS body_atr,
    CASE WHEN volume_mean_prior > 0 THEN volume / volume_mean_prior END AS volume_ratio, CASE WHEN volume_std_prior > {EPS} THEN (volume - volume_mean_prior) / volume_std_prior END AS volume_zscore,
    CASE WHEN volume > 0 THEN real_volume / volume ELSE 0.0 END AS real_to_tick_volume, CASE WHEN atr > {EPS} THEN (close - daily_vwap) / atr END AS distance_daily_vwap_atr,
    CASE WHEN atr > {EPS} THEN (prior_high - close) / atr END AS distance_prior_high_atr, CASE WHEN atr > {EPS} THEN (close - prior_low) / atr END AS distance_prior_low_atr,
    (high > prior_high AND close < prior_high)::INT AS sweep_prior_high, (low < prior_low AND close > prior_low)::INT AS sweep_prior_low FROM f2)"""
FEAT = f"{B15}, {F1}"
GEOMETRY = f"""-- doubles: body, body_abs, bar_range, upper_wick, lower_wick, body_to_range, close_location
WITH {FEAT} SELECT t AS timestamp_utc, body, abs(body) AS body_abs, bar_range, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, body_to_range, close_location, candle_direction FROM f3"""
RETURNS = f"-- doubles: return_15m, return_30m, return_60m, realized_vol_60m, realized_vol_4h\nWITH {FEAT} SELECT t AS timestamp_utc, return_15m, return_30m, return_60m, realized_vol_60m, realized_vol_4h, direction_balance_60m FROM f3"
ATR = f"-- doubles: true_range, atr, range_atr, body_atr\nWITH {FEAT} SELECT t AS timestamp_utc, true_range, atr, range_atr, body_atr FROM f3"
VOLUME = f"-- doubles: volume_mean_prior, volume_std_prior, volume_ratio, volume_zscore, real_to_tick_volume\nWITH {FEAT} SELECT t AS timestamp_utc, volume_sum_short, volume_mean_prior, volume_std_prior, volume_ratio, volume_zscore, real_to_tick_volume FROM f3"
DAILY_VWAP = f"-- doubles: daily_vwap, distance_daily_vwap, distance_daily_vwap_atr, daily_vwap_slope\nWITH {FEAT} SELECT t AS timestamp_utc, cd AS calendar_date, daily_vwap, close - daily_vwap AS distance_daily_vwap, distance_daily_vwap_atr, daily_vwap_slope FROM f3"
EXTREMES = f"-- doubles: prior_high, prior_low, distance_prior_high_atr, distance_prior_low_atr\nWITH {FEAT} SELECT t AS timestamp_utc, prior_high, prior_low, distance_prior_high_atr, distance_prior_low_atr, sweep_prior_high, sweep_prior_low FROM f3"
CONTEXT = "hc AS (SELECT t + INTERVAL 60 MINUTE AS ha, close - open AS h1_body, sign(close - open)::INT AS h1_direction, close / lag(close) OVER (ORDER BY t) - 1.0 AS h1_return_1 FROM b60)"
H1_CONTEXT = f"-- doubles: h1_body, h1_return_1\nWITH {B15}, {B60}, {CONTEXT} SELECT b.t AS timestamp_utc, ha AS h1_available_at_utc, h1_body, h1_direction, h1_return_1 FROM b15 b ASOF LEFT JOIN hc ON b.t + INTERVAL 15 MINUTE >= hc.ha"


def _session(where: str, start: int, length: int) -> str:
    """ff: features of a session; minute_of_session by the close."""
    m = f"(({MINUTE.format('olt')} - {start} + 1440) % 1440)"
    return f"""sx AS (SELECT f3.*, hc.*, {m}::INT AS minute_of_session, {m} / {length}.0::DOUBLE AS session_progress, isodow(lt)::INT AS iso_weekday, sin({LM} * 2 * pi() / 1440) AS time_sin, cos({LM} * 2 * pi() / 1440) AS time_cos, month(lt)::INT AS month
  FROM f3 ASOF LEFT JOIN hc ON f3.ot >= hc.ha WHERE {where}), sv AS (
  SELECT *, sum(tp * volume) OVER (PARTITION BY cd ORDER BY t {CUM}) / sum(volume) OVER (PARTITION BY cd ORDER BY t {CUM}) AS session_vwap FROM sx), sw AS (
  SELECT *, CASE WHEN atr > {EPS} THEN (close - session_vwap) / atr END AS distance_session_vwap_atr, coalesce(session_vwap - lag(session_vwap) OVER (PARTITION BY cd ORDER BY t), 0.0) AS session_vwap_slope FROM sv), ff AS (
  SELECT * FROM sw WHERE realized_vol_4h IS NOT NULL AND direction_balance_60m IS NOT NULL AND range_atr IS NOT NULL AND volume_ratio IS NOT NULL AND volume_zscore IS NOT NULL AND daily_vwap_slope IS NOT NULL
    AND distance_prior_high_atr IS NOT NULL AND return_60m IS NOT NULL AND h1_body IS NOT NULL AND h1_return_1 IS NOT NULL)"""


def frames(where: str = NY, start: int = 420, length: int = 180) -> str:
    return f"{FEAT}, {B60}, {CONTEXT}, {_session(where, start, length)}"


SESSION_VWAP = f"""-- doubles: session_vwap, distance_session_vwap, distance_session_vwap_atr, session_vwap_slope
WITH {frames()} SELECT t AS timestamp_utc, cd AS session_date, session_vwap, close - session_vwap AS distance_session_vwap, distance_session_vwap_atr, session_vwap_slope FROM sw"""
FEATURE_FRAME = f"""-- doubles: body_to_range, close_location, return_15m, return_30m, return_60m, realized_vol_60m, realized_vol_4h, atr, range_atr, body_atr, volume_ratio, volume_zscore, real_to_tick_volume, distance_daily_vwap_atr, daily_vwap_slope, distance_session_vwap_atr, session_vwap_slope, distance_prior_high_atr, distance_prior_low_atr, time_sin, time_cos, session_progress, h1_body, h1_return_1
WITH {frames()} SELECT t AS timestamp_utc, cd AS session_date, body_to_range, close_location, candle_direction, return_15m, return_30m, return_60m, realized_vol_60m, realized_vol_4h, direction_balance_60m, atr, range_atr, body_atr,
  volume_ratio, volume_zscore, real_to_tick_volume, distance_daily_vwap_atr, daily_vwap_slope, distance_session_vwap_atr, session_vwap_slope, distance_prior_high_atr, distance_prior_low_atr, sweep_prior_high, sweep_prior_low,
  iso_weekday, time_sin, time_cos, month, minute_of_session, session_progress, h1_body, h1_direction, h1_return_1 FROM ff"""


def _targets(start: int, length: int, path: str = "b15", step: int = 15) -> str:
    """tt: targets of ff with paths of bars of `step` minutes."""
    return f"""ob AS (SELECT *, ot + INTERVAL 60 MINUTE AS he, cd + INTERVAL {start + 300} MINUTE AS ss, cd + INTERVAL {start + 300 + length} MINUTE AS se FROM ff), pa AS (
  SELECT o.ot AS pot, count(*) AS n, count(DISTINCT b.t) AS nd, min(b.t) AS t0, max(b.t) AS t1, max(b.high) AS future_high, min(b.low) AS future_low FROM ob o JOIN {path} b ON b.t >= o.ot AND b.t < o.he GROUP BY 1), ra AS (
  SELECT ob.*, pa.*, CASE WHEN ot < ss OR he > se THEN 'horizon_outside_session' WHEN NOT (atr > 0) THEN 'invalid_atr' WHEN coalesce(n, 0) <> {60 // step} THEN 'incomplete_horizon' WHEN t0 <> ot OR t1 <> he - INTERVAL {step} MINUTE THEN 'm1_gap' END AS reason
  FROM ob LEFT JOIN pa ON ob.ot = pa.pot), pk AS (
  SELECT r.ot AS kot, min(CASE WHEN b.high = r.future_high THEN b.t END) AS peak_t, min(CASE WHEN b.low = r.future_low THEN b.t END) AS trough_t,
    min(CASE WHEN b.high >= r.close + 0.75 * r.atr THEN b.t END) AS up_t, min(CASE WHEN b.low <= r.close - 0.5 * r.atr THEN b.t END) AS down_t
  FROM ra r JOIN {path} b ON b.t >= r.ot AND b.t < r.he WHERE r.reason IS NULL GROUP BY 1), ad AS (
  SELECT r.ot AS aot, min(b.low) AS worst FROM ra r JOIN pk ON pk.kot = r.ot JOIN {path} b ON b.t >= r.ot AND b.t <= pk.peak_t GROUP BY 1), tg AS (
  SELECT ra.*, pk.*, CASE WHEN reason IS NULL THEN greatest(future_high - close, 0.0) END AS mfe_points, CASE WHEN reason IS NULL THEN greatest(close - future_low, 0.0) END AS mae_points, CASE WHEN reason IS NULL THEN greatest(close - worst, 0.0) END AS adverse_before_peak_points,
    (epoch(peak_t - ot) / 60 + {step})::INT AS time_to_peak_minutes, (epoch(trough_t - ot) / 60 + {step})::INT AS time_to_trough_minutes, coalesce(up_t = down_t, false) AS ambiguous
  FROM ra LEFT JOIN pk ON pk.kot = ra.ot LEFT JOIN ad ON ad.aot = ra.ot), tt AS (
  SELECT *, mfe_points / atr AS mfe_atr, mae_points / atr AS mae_atr, adverse_before_peak_points / atr AS adverse_before_peak_atr, (mfe_points / atr >= 0.5)::INT AS target_peak_050_atr, (mfe_points / atr >= 0.75)::INT AS target_peak_075_atr, (mfe_points / atr >= 1.0)::INT AS target_peak_100_atr,
    reason IS NULL AND NOT ambiguous AS valid FROM tg)"""


MINUTES = f"""{B1}, dm AS (
  SELECT g.t, g.t - INTERVAL 5 HOUR AS lt, CASE WHEN b.t = g.t THEN b.open ELSE b.close END AS open, CASE WHEN b.t = g.t THEN b.high ELSE b.close END AS high,
    CASE WHEN b.t = g.t THEN b.low ELSE b.close END AS low, b.close, CASE WHEN b.t = g.t THEN b.volume ELSE 0 END AS volume
  FROM (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 MINUTE)) AS t FROM b1) g ASOF JOIN b1 b ON g.t >= b.t)"""
FILLED = f"-- doubles: open, high, low, close\nWITH {MINUTES} SELECT t AS timestamp_utc, lt AS timestamp_cot, open, high, low, close, volume FROM dm"
TARGETS_NY = f"{frames()}, {_targets(420, 180)}"
TARGETS_DAY = f"{frames('true', 0, 1440)}, {_targets(0, 1440)}"
TARGETS_LONDON = f"{frames(f'{LM} >= 120 AND {LM} < 300', 120, 180)}, {_targets(120, 180)}"
TARGET_CONTRACT = f"""SELECT a.n + 2 * b.n AS rows, 0::BIGINT AS no_key, 2 * b.n AS other_session, b.n AS repeated
FROM (WITH {frames()} SELECT count(*) AS n FROM ff) a, (WITH {frames(f'{LM} >= 120 AND {LM} < 300', 120, 180)} SELECT count(*) AS n FROM ff) b"""
EXCURSIONS = f"""-- doubles: future_high, future_low, mfe_points, mae_points, adverse_before_peak_points, mfe_atr, mae_atr, adverse_before_peak_atr
WITH {TARGETS_NY} SELECT ot AS observation_time_utc, CASE WHEN reason IS NULL THEN future_high END AS future_high, CASE WHEN reason IS NULL THEN future_low END AS future_low, mfe_points, mae_points, adverse_before_peak_points,
  mfe_atr, mae_atr, adverse_before_peak_atr, time_to_peak_minutes, time_to_trough_minutes, peak_t AS peak_timestamp_utc, trough_t AS trough_timestamp_utc FROM tt"""
M1_PATHS = f"""-- doubles: future_high, future_low, mfe_atr, mae_atr, adverse_before_peak_atr
WITH {MINUTES}, {frames()}, {_targets(420, 180, 'dm', 1)} SELECT ot AS observation_time_utc, CASE WHEN reason IS NULL THEN future_high END AS future_high, CASE WHEN reason IS NULL THEN future_low END AS future_low,
  mfe_atr, mae_atr, adverse_before_peak_atr, time_to_peak_minutes, time_to_trough_minutes, (epoch(least(up_t, down_t) - ot) / 60 + 1)::INT AS first_barrier_touch_minutes,
  CASE WHEN reason IS NOT NULL OR ambiguous THEN NULL WHEN up_t IS NULL AND down_t IS NULL THEN 0 WHEN down_t IS NULL OR up_t < down_t THEN 1 ELSE -1 END::INT AS triple_barrier_label,
  CASE WHEN reason IS NULL AND ambiguous THEN 'ambiguous_barrier' ELSE reason END AS target_exclusion_reason FROM tt"""
THRESHOLDS = f"WITH {TARGETS_NY} SELECT ot AS observation_time_utc, target_peak_050_atr, target_peak_075_atr, target_peak_100_atr FROM tt WHERE valid"
BARRIER = f"""WITH {TARGETS_NY} SELECT ot AS observation_time_utc, CASE WHEN reason IS NOT NULL OR ambiguous THEN NULL WHEN up_t IS NULL AND down_t IS NULL THEN 0 WHEN down_t IS NULL OR up_t < down_t THEN 1 ELSE -1 END::INT AS triple_barrier_label,
  (epoch(least(up_t, down_t) - ot) / 60 + 15)::INT AS first_barrier_touch_minutes, ambiguous AS target_ambiguous, valid AS target_valid FROM tt"""
EXCLUSIONS = f"WITH {TARGETS_NY} SELECT CASE WHEN valid THEN 'valid' WHEN reason IS NULL THEN 'ambiguous_barrier' ELSE reason END AS reason, count(*) AS rows, count(*) FILTER (WHERE ambiguous) AS ambiguous FROM tt GROUP BY 1"
DATASET_IDS = f"""WITH {TARGETS_NY} SELECT 'SYN|new_york|' || strftime(ot, '%Y%m%dT%H%M%S') || '+0000|e1' AS observation_id, 'new_york' AS session_code, cd AS session_date, target_peak_075_atr, 'd1' AS dataset_version FROM tt WHERE valid"""
COMBINED = f"""SELECT * FROM (WITH {TARGETS_NY} SELECT 'new_york' AS session_code, count(*) AS rows, sum(target_peak_050_atr)::BIGINT AS positives FROM tt WHERE valid)
WHERE rows > 0 UNION ALL SELECT * FROM (WITH {TARGETS_LONDON} SELECT 'london' AS session_code, count(*) AS rows, sum(target_peak_050_atr)::BIGINT AS positives FROM tt WHERE valid) WHERE rows > 0"""

_T = ("target_peak_050_atr", "target_peak_075_atr", "target_peak_100_atr")
_RATES = ", ".join(f"avg({t}) AS rate_{t}" for t in _T)
_POSITIVE = ", ".join(f"sum({t})::BIGINT AS positive_{t}" for t in _T)
_RATE_NAMES = ", ".join(f"rate_{t}" for t in _T)
_MED = "median(mfe_atr) AS median_mfe_atr, median(mae_atr) AS median_mae_atr"
RESEARCH = f"WITH {TARGETS_DAY}, rs AS (SELECT *, 'full_day' AS session_code FROM tt WHERE valid)"
BASE_GLOBAL = f"-- doubles: {_RATE_NAMES}, median_mfe_atr, median_mae_atr, median_time_to_peak_minutes\n{RESEARCH} SELECT count(*) AS observations, {_POSITIVE}, {_RATES}, {_MED}, median(time_to_peak_minutes) AS median_time_to_peak_minutes FROM rs"
BASE_SESSION = f"-- doubles: {_RATE_NAMES}, median_mfe_atr, median_mae_atr, median_time_to_peak_minutes\n{RESEARCH} SELECT session_code, count(*) AS observations, {_POSITIVE}, {_RATES}, {_MED}, median(time_to_peak_minutes) AS median_time_to_peak_minutes FROM rs GROUP BY 1"
BASE_MINUTE = f"-- doubles: {_RATE_NAMES}, median_mfe_atr, median_mae_atr\n{RESEARCH} SELECT session_code, minute_of_session, count(*) AS observations, {_RATES}, {_MED} FROM rs GROUP BY 1, 2 HAVING count(*) >= 5"
BASE_WEEKDAY = f"""-- doubles: {_RATE_NAMES}, median_mfe_atr, median_mae_atr
{RESEARCH} SELECT session_code, iso_weekday, count(*) AS observations, {_RATES}, {_MED}, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][iso_weekday] AS weekday FROM rs GROUP BY 1, 2"""
TERCILES = f"-- doubles: q33, q67\n{RESEARCH} SELECT quantile_cont(atr, 1 / 3::DOUBLE) AS q33, quantile_cont(atr, 2 / 3::DOUBLE) AS q67 FROM rs"
BASE_REGIME = f"""-- doubles: {_RATE_NAMES}, median_mfe_atr, median_mae_atr, q33, q67
{RESEARCH}, qs AS (SELECT quantile_cont(atr, 1 / 3::DOUBLE) AS q33, quantile_cont(atr, 2 / 3::DOUBLE) AS q67 FROM rs)
SELECT session_code, CASE WHEN atr <= q33 THEN 'low' WHEN atr <= q67 THEN 'medium' ELSE 'high' END AS volatility_regime, count(*) AS observations, {_RATES}, {_MED}, any_value(q33) AS q33, any_value(q67) AS q67 FROM rs, qs GROUP BY 1, 2"""

OBS = """ob AS (SELECT 'o' || o_orderkey AS observation_id, o_orderdate::TIMESTAMP AS a, o_orderdate::TIMESTAMP + INTERVAL 60 MINUTE AS e, o_orderdate::DATE AS session_date, substr(o_orderpriority, 1, 1) AS session_code, (o_custkey % 12) * 15 AS minute_of_session,
  (o_totalprice >= 250000)::INT AS y, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS pm, (o_custkey * 104729 % 1000) / 1000.0::DOUBLE AS pb FROM orders)"""
CONSTANT = f"""-- doubles: baseline_group_probability, baseline_probability
WITH {OBS}, tr AS (SELECT * FROM ob WHERE session_date < DATE '1999-01-01'), g AS (SELECT session_code, minute_of_session, count(*) AS n, avg(y) AS p FROM tr GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT observation_id, o.session_code, o.minute_of_session, n AS baseline_group_observations, p AS baseline_group_probability, coalesce(p, (SELECT avg(y) FROM tr)) AS baseline_probability, CASE WHEN p IS NULL THEN 'global_fallback' ELSE 'group' END AS baseline_source, 'target_peak_075_atr' AS baseline_target
FROM ob o LEFT JOIN g USING (session_code, minute_of_session) WHERE session_date >= DATE '1999-01-01'"""
CONSTANT_GLOBAL = f"""-- doubles: baseline_probability
WITH {OBS} SELECT observation_id, (SELECT avg(y) FROM ob WHERE session_date < DATE '1999-01-01') AS baseline_probability, 'global' AS baseline_source, 'target_peak_075_atr' AS baseline_target FROM ob WHERE session_date >= DATE '1999-01-01'"""
MONTHS = "SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders"


def _folds(expanding: bool) -> str:
    least = "" if expanding else "AND m.i > f.number - 1"
    return f"""mo AS (SELECT strftime(d, '%Y-%m') AS month, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders)), fo AS (
  SELECT f.number::INT AS fold, CASE WHEN m.i < f.number + 6 THEN 'train' WHEN m.i = f.number + 6 THEN 'validation' ELSE 'test' END AS part, m.month
  FROM (SELECT i AS number FROM mo WHERE i <= n - 7) f JOIN mo m ON m.i <= f.number + 7 {least})"""


FOLDS = f"WITH {_folds(True)} SELECT fold, part, month FROM fo"
FOLDS_ROLLING = f"WITH {_folds(False)} SELECT fold, part, month FROM fo"
_SPLIT_COUNTS = ", ".join([f"count(*) FILTER (WHERE kept AND part = '{p}') AS {p}_rows" for p in ("train", "validation", "test")] + [f"count(*) FILTER (WHERE NOT kept AND part = '{p}') AS {p}_lost" for p in ("train", "validation", "test")])
_KEPT = """bo AS (SELECT fold, min(a) FILTER (WHERE part = 'validation') AS v, min(a) FILTER (WHERE part = 'test') AS te FROM asg GROUP BY 1), kp AS (
  SELECT asg.*, CASE part WHEN 'train' THEN e <= v - INTERVAL 60 MINUTE WHEN 'validation' THEN a >= v + INTERVAL 60 MINUTE AND e <= te - INTERVAL 60 MINUTE ELSE a >= te + INTERVAL 60 MINUTE END AS kept FROM asg JOIN bo USING (fold))"""
PURGED = f"WITH {OBS}, {_folds(True)}, asg AS (SELECT ob.*, fo.fold, fo.part FROM ob JOIN fo ON strftime(session_date, '%Y-%m') = fo.month), {_KEPT} SELECT fold, {_SPLIT_COUNTS} FROM kp GROUP BY fold"
SINGLE_MONTH = f"""{RESEARCH}, dd AS (SELECT cd, row_number() OVER (ORDER BY cd) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT cd FROM rs)), cu AS (
  SELECT cd, i, greatest(1, floor(n * 0.6)) AS a1, least(greatest(greatest(1, floor(n * 0.6)) + 1, floor(n * (0.6 + 0.2))), n - 1) AS b1 FROM dd), asg AS (
  SELECT 0::INT AS fold, CASE WHEN i <= a1 THEN 'train' WHEN i <= b1 THEN 'validation' ELSE 'test' END AS part, ot AS a, he AS e FROM rs JOIN cu USING (cd)), {_KEPT} SELECT fold, {_SPLIT_COUNTS} FROM kp GROUP BY fold"""

LONG = f"{OBS}, lf AS (SELECT session_code, 'model_probability' AS source, y, pm AS p FROM ob UNION ALL SELECT session_code, 'baseline_probability', y, pb FROM ob)"
_CELLS = "count(*) FILTER (WHERE p < {0} AND y = 0) AS tn, count(*) FILTER (WHERE p >= {0} AND y = 0) AS fp, count(*) FILTER (WHERE p < {0} AND y = 1) AS fn, count(*) FILTER (WHERE p >= {0} AND y = 1) AS tp"
_SCORES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1"
METRICS = f"""-- doubles: positive_rate, mean_probability, brier, log_loss, precision, recall, f1
WITH {LONG}, m AS (SELECT source, count(*) AS rows, sum(y)::BIGINT AS positives, avg(y) AS positive_rate, avg(p) AS mean_probability, avg(pow(p - y, 2)) AS brier,
  avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 2.2e-16), 1 - 2.2e-16)) ELSE ln(1 - least(greatest(p, 2.2e-16), 1 - 2.2e-16)) END) AS log_loss, {_CELLS.format('0.5')} FROM lf GROUP BY 1) SELECT *, {_SCORES} FROM m"""


def _ranking(by: str) -> str:
    """rk: ranking metrics by key, by mid-ranks and by distinct probabilities."""
    return f"""ti AS (SELECT {by}, p, sum(y) AS pos, count(*) AS n FROM lf GROUP BY ALL), cm AS (
  SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS al, sum(n) OVER (PARTITION BY {by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM ti WINDOW w AS (PARTITION BY {by} ORDER BY p DESC {CUM})), rk AS (
  SELECT {by}, sum(pos * tp / al) / sum(pos) AS average_precision, (sum(pos * (coalesce(below, 0) + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))) AS roc_auc FROM cm GROUP BY {by})"""


RANKING = f"-- doubles: average_precision, roc_auc\nWITH {LONG}, {_ranking('source')} SELECT source, average_precision, roc_auc FROM rk"
CALIBRATION = f"""-- doubles: mean_predicted, observed, bin_lower, bin_upper, gap
WITH {LONG}, c AS (SELECT source, least(floor(p * 10), 9)::INT AS bin, count(*) AS observations, avg(p) AS mean_predicted, avg(y) AS observed FROM lf GROUP BY 1, 2) SELECT *, bin / 10.0::DOUBLE AS bin_lower, (bin + 1) / 10.0::DOUBLE AS bin_upper, abs(mean_predicted - observed) AS gap FROM c"""
THRESHOLD_ANALYSIS = f"""-- doubles: threshold, predicted_positive_rate, precision, recall, f1
WITH {LONG}, m AS (SELECT source, h.threshold, {_CELLS.format('h.threshold')} FROM lf, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold) h GROUP BY 1, 2) SELECT *, (fp + tp) / (tn + fp + fn + tp) AS predicted_positive_rate, {_SCORES} FROM m"""
SESSION_EVALUATION = f"""-- doubles: brier, precision, recall, f1, roc_auc, average_precision
WITH {LONG}, {_ranking('session_code, source')}, m AS (SELECT session_code, source, count(*) AS rows, sum(y)::BIGINT AS positives, avg(pow(p - y, 2)) AS brier, {_CELLS.format('0.5')} FROM lf GROUP BY 1, 2) SELECT m.*, {_SCORES}, roc_auc, average_precision FROM m JOIN rk USING (session_code, source)"""
COMPARISON = f"""-- doubles: delta_brier, delta_log_loss, delta_average_precision, delta_roc_auc
WITH {LONG}, {_ranking('source')}, m AS (SELECT source, avg(pow(p - y, 2)) AS brier, avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 2.2e-16), 1 - 2.2e-16)) ELSE ln(1 - least(greatest(p, 2.2e-16), 1 - 2.2e-16)) END) AS log_loss FROM lf GROUP BY 1), j AS (SELECT * FROM m JOIN rk USING (source))
SELECT x.brier - z.brier AS delta_brier, x.log_loss - z.log_loss AS delta_log_loss, x.average_precision - z.average_precision AS delta_average_precision, x.roc_auc - z.roc_auc AS delta_roc_auc
FROM (SELECT * FROM j WHERE source = 'model_probability') x, (SELECT * FROM j WHERE source = 'baseline_probability') z"""


def _sizes(parts: dict[str, str]) -> str:
    """(part, rows) of other queries."""
    return "\nUNION ALL ".join(f"SELECT '{name}' AS part, count(*) AS rows FROM (\n{sql.partition(chr(10))[2] if sql.startswith('-- doubles') else sql}\n)" for name, sql in parts.items())


DASHBOARD = _sizes({"vwap": f"WITH {B1} SELECT * FROM b1", "cvd": f"WITH {B1} SELECT * FROM b1", "directions": f"WITH {B1} SELECT * FROM b1", "clusters": CLUSTERS, "opening_ranges": OPENING, "sweeps": SWEEPS})
MONTH_REPORT = _sizes({"bars": ANCHORED, "profile": PROFILE, "days": DAILY, "levels": LEVELS, "coverage": COVERAGE})
LAST_SWEEPS = f"-- doubles: price, close\nSELECT * FROM ({DAILY_SWEEPS.partition(chr(10))[2]}) ORDER BY date DESC LIMIT 10"
LAKE_AUDIT = f"WITH {B60} SELECT count(*) AS rows, 0::BIGINT AS another_codec, 0::BIGINT AS without_statistics, 0::BIGINT AS another_type, 0::BIGINT AS absent FROM b60"
LAKE_CONTEXT = f"""WITH {B60} SELECT 'h1' AS timeframe, count(*) AS rows, min(t) AS first_utc, max(t) AS last_utc FROM b60
WHERE t >= TIMESTAMP '2024-01-01 05:00:00' AND t < TIMESTAMP '2024-02-01 05:00:00' AND isodow(lt) <= 5"""
LAKE_FILES = f"WITH {B60} SELECT day(lt)::INT AS day, count(*) AS rows, min(t) AS first_utc, max(t) AS last_utc FROM b60 WHERE lt >= TIMESTAMP '2024-01-05' AND lt < TIMESTAMP '2024-01-20' GROUP BY 1"
BASE_REPORT = _sizes({"global": BASE_GLOBAL, "session": BASE_SESSION, "session_minute": BASE_MINUTE.replace("HAVING count(*) >= 5", ""), "weekday": BASE_WEEKDAY, "regime": BASE_REGIME})
GIVEN_MODEL = f"""-- doubles: model_probability, model_c
WITH {OBS} SELECT observation_id, session_code, 1 / (1 + exp(-(-0.4 + 0.35 * (minute_of_session - 80.0) / 50.0 - 0.8 * (session_code::DOUBLE - 3.0) / 1.4 + 0.05 * (month(session_date) - 6.5) / 3.4))) AS model_probability,
  'target_peak_075_atr' AS model_target, 1.0::DOUBLE AS model_c, y AS actual_target FROM ob"""
