"""Independent SQL for the registered queries, for DuckDB on the same benchmark tables."""

from __future__ import annotations

from meterlens.plans import fixtures as fx
from meterlens.settings import CLUSTER_FEATURES, PEER_METRICS

# name -> (CTEs it reads, body)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, reads: tuple[str, ...], body: str) -> None:
    _CTES[name] = (reads, body)


def _with(needs: tuple[str, ...], final: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in _CTES[name][0]:
            visit(other)
        order.append(name)

    for need in needs:
        visit(need)
    blocks = ",\n".join(f"{name} AS (\n{_CTES[name][1]}\n)" for name in order)
    return f"WITH RECURSIVE {blocks}\n{final}" if blocks else final


def _columns(spec: str) -> str:
    """One column per line: ``kind name [= expression]``; r rounds, i is bigint, t is text, p plain."""
    out = []
    for line in filter(None, (part.strip() for part in spec.strip().splitlines())):
        kind, rest = line.split(" ", 1)
        name, _, expression = rest.partition(" = ")
        expression = expression or name
        cast = {
            "r": f"ROUND(CAST({expression} AS DOUBLE), 6)",
            "i": f"CAST({expression} AS BIGINT)",
            "t": f"CAST({expression} AS VARCHAR)",
            "p": expression,
        }[kind]
        out.append(f"{cast} AS {name}")
    return ",\n  ".join(out)


def _lines(kind: str, names) -> str:
    return "\n".join(f"{kind} {name}" for name in names)


# --- fixture views ---------------------------------------------------------------------------

_cte(
    "ev",
    (),
    f"""
SELECT user_id // {fx.USERS_PER_COMPANY} + 1 AS n,
       CASE WHEN user_id % 16 < 8 THEN 0 WHEN user_id % 16 < 12 THEN 1 WHEN user_id % 16 < 14 THEN 2 ELSE 3 END AS m,
       event_type = 'error' AS exported,
       date_trunc('hour', ts) AS hour,
       floor(value * 4) / 4 AS energy
FROM events""",
)
_cte("kept", ("ev",), "SELECT * REPLACE (CASE WHEN exported THEN 0 ELSE m END AS m) FROM ev")
_cte(
    "hours",
    (),
    "SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', "
    "INTERVAL 1 HOUR)) AS hour",
)
_cte("ser", ("kept",), "SELECT DISTINCT n, m, exported FROM kept")
_cte("per_hour", ("kept",), "SELECT n, m, exported, hour, sum(energy) AS energy FROM kept GROUP BY ALL")
_CALENDAR = """interval_start + INTERVAL 1 HOUR AS interval_end,
       year(date) AS year, month(date) AS month, isodow(date) - 1 AS weekday_number,
       isodow(date) >= 6 AS is_weekend, hour_1_24 BETWEEN 7 AND 18 AS is_peak_07_18"""
_cte(
    "hourly",
    ("ser", "hours", "per_hour"),
    f"""
SELECT *, {_CALENDAR} FROM (
  SELECT s.n, s.m, 'Company ' || s.n AS company_id, 'C' || s.n || '-M' || s.m AS meter_id,
         CASE WHEN s.exported THEN 'injection_export' ELSE 'consumption_import' END AS energy_flow,
         CASE WHEN s.m = 0 THEN 'prosumer' ELSE 'standard' END AS source_sheet,
         h.hour AS interval_start, CAST(h.hour AS DATE) AS date, hour(h.hour) + 1 AS hour_1_24,
         CASE WHEN s.m = 3 THEN coalesce(a.energy, 0.0) ELSE a.energy END AS energy_kwh,
         CASE s.m WHEN 3 THEN 'clean' WHEN 2 THEN 'unusable' ELSE 'review' END AS quality_status,
         CASE s.m WHEN 3 THEN 'clean' ELSE 'review' END AS active_period_quality_status
  FROM ser s CROSS JOIN hours h
  LEFT JOIN per_hour a ON a.n = s.n AND a.m = s.m AND a.exported = s.exported AND a.hour = h.hour)""",
)
_cte(
    "daily_readings",
    (),
    f"""
SELECT *, {_CALENDAR} FROM (
  SELECT 'Company ' || (c_nationkey + 1) AS company_id,
         'N' || (c_nationkey + 1) || '-M' || (o_custkey % 3) AS meter_id,
         'consumption_import' AS energy_flow, 'orders' AS source_sheet,
         o_orderdate + CAST(o_orderkey % 24 AS INT) * INTERVAL '1' HOUR AS interval_start,
         CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 24 + 1 AS INT) AS hour_1_24,
         sum(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                  ELSE floor(o_totalprice * 4) / 4 END) AS energy_kwh
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
)
_cte(
    "cells",
    ("hourly",),
    f"""
SELECT CASE WHEN m = 0 THEN 'Prosumer ' ELSE 'Standard ' END || n AS sheet, company_id, meter_id, energy_flow,
       row_number() OVER (PARTITION BY meter_id, energy_flow ORDER BY interval_start) - 1 AS pos,
       date, hour_1_24 AS hour, interval_start, CASE WHEN {fx.TWICE} THEN 2 ELSE 1 END AS copies,
       CASE WHEN hour_1_24 BETWEEN 8 AND 22 THEN 'A1' ELSE 'A2' END AS tariff,
       CASE WHEN energy_kwh IS NULL THEN CASE WHEN hour_1_24 % 2 = 0 THEN ' ' END
            WHEN energy_kwh = 0.25 THEN 'n/a' WHEN energy_kwh = 0.5 THEN '-0.5'
            ELSE CAST(energy_kwh AS VARCHAR) END AS raw,
       CASE WHEN energy_kwh = 0.25 THEN NULL WHEN energy_kwh = 0.5 THEN -0.5 ELSE energy_kwh END AS value,
       CASE WHEN energy_kwh IS NULL THEN 'missing' WHEN energy_kwh = 0.25 THEN 'non_numeric'
            WHEN energy_kwh = 0.5 THEN 'negative' WHEN energy_kwh = 0 THEN 'zero' ELSE 'positive' END AS kind
FROM (SELECT * FROM hourly UNION ALL SELECT * FROM hourly WHERE {fx.TWICE})""",
)
_cte(
    "series",
    ("ser",),
    """
SELECT CASE WHEN m = 0 THEN 'Prosumer ' ELSE 'Standard ' END || n AS sheet,
       's' || CASE WHEN m > 0 THEN m WHEN exported THEN 2 ELSE 1 END AS "column",
       'Company ' || n AS company_id, 'C' || n || '-M' || m AS meter_id,
       CASE WHEN exported THEN 'injection_export' ELSE 'consumption_import' END AS energy_flow
FROM ser""",
)
_cte(
    "sheet_rows",
    ("cells",),
    """
SELECT DISTINCT sheet, date, hour, copies, year(period) AS py, month(period) AS pm FROM (
  SELECT *, CASE WHEN hour = 24 THEN date + 2 ELSE date END AS period FROM cells)""",
)

_ID = "sheet, company_id, meter_id, energy_flow"

# --- quality ---------------------------------------------------------------------------------

_cte(
    "stats",
    ("cells",),
    f"""
SELECT {_ID}, 720 AS expected_hours, count(value) AS valid, count(*) FILTER (kind = 'missing') AS missing,
       count(*) FILTER (kind = 'non_numeric') AS non_numeric, count(*) FILTER (kind = 'negative') AS negative,
       count(*) FILTER (kind = 'zero') AS zeros, avg(value) AS mean_kwh, stddev_samp(value) AS std_kwh,
       min(value) AS min_kwh, max(value) AS max_kwh,
       min(pos) FILTER (value IS NOT NULL) AS first_pos, max(pos) FILTER (value IS NOT NULL) AS last_pos
FROM cells GROUP BY ALL""",
)
_cte(
    "runs",
    ("cells",),
    f"""
SELECT {_ID}, count(*) AS run_hours, min(pos) AS first_pos, max(pos) AS last_pos FROM (
  SELECT *, sum(CASE WHEN value = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY {_ID} ORDER BY pos) AS island
  FROM cells) WHERE value = 0 GROUP BY {_ID}, island""",
)
_cte(
    "extreme",
    ("cells", "stats"),
    f"""
SELECT c.* FROM cells c JOIN stats s USING ({_ID}) WHERE s.mean_kwh > 0 AND c.value > 5 * s.mean_kwh""",
)
_cte(
    "quality",
    ("stats", "runs", "extreme"),
    f"""
SELECT *,
  CASE WHEN missing_share > 0.6 THEN 'unusable'
       WHEN missing + negative + non_numeric + events + extremes > 0 THEN 'review' ELSE 'clean' END AS quality_status,
  CASE WHEN span = 0 OR internal_share > 0.6 THEN 'unusable'
       WHEN internal + negative + non_numeric + events + extremes > 0 THEN 'review' ELSE 'clean' END AS active_status,
  CASE WHEN valid = 0 THEN 'no_readings' WHEN lead_gap > 0 AND tail_gap > 0 THEN 'late_start_early_end'
       WHEN lead_gap > 0 THEN 'late_start' WHEN tail_gap > 0 THEN 'early_end'
       WHEN internal > 0 THEN 'internal_gaps' ELSE 'complete' END AS pattern
FROM (
  SELECT *, missing / expected_hours AS missing_share,
         CASE WHEN span > 0 THEN internal / span ELSE 1.0 END AS internal_share
  FROM (
    SELECT s.*, coalesce(first_pos, 720) AS lead_gap,
           CASE WHEN last_pos IS NULL THEN 0 ELSE greatest(0, 720 - last_pos - 1) END AS tail_gap,
           coalesce(last_pos - first_pos + 1, 0) AS span,
           greatest(0, coalesce(last_pos - first_pos + 1, 0) - valid - non_numeric) AS internal,
           coalesce(r.events, 0) AS events, coalesce(r.event_hours, 0) AS event_hours,
           coalesce(r.longest, 0) AS longest, coalesce(e.extremes, 0) AS extremes
    FROM stats s
    LEFT JOIN (SELECT {_ID}, count(*) FILTER (run_hours >= 20) AS events,
                      coalesce(sum(run_hours) FILTER (run_hours >= 20), 0) AS event_hours,
                      max(run_hours) AS longest FROM runs GROUP BY ALL) r USING ({_ID})
    LEFT JOIN (SELECT {_ID}, count(*) AS extremes FROM extreme GROUP BY ALL) e USING ({_ID})))""",
)
_cte(
    "anomalies",
    ("cells", "extreme"),
    f"""
SELECT {_ID}, date, hour, raw, kind AS reason FROM cells WHERE kind IN ('non_numeric', 'negative')
UNION ALL SELECT {_ID}, date, hour, raw, 'extreme_multiple' FROM extreme""",
)
_cte(
    "timeline",
    ("sheet_rows",),
    """
SELECT sheet, date, CAST(hour AS VARCHAR) AS hour, 'missing' AS issue FROM (
  SELECT s.sheet, CAST(d.d AS DATE) AS date, h.h AS hour
  FROM (SELECT DISTINCT sheet FROM sheet_rows) s
  CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS d) d
  CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS h) h
  EXCEPT SELECT sheet, date, hour FROM sheet_rows)
UNION ALL
SELECT sheet, date, CAST(hour AS VARCHAR), 'out_of_period' FROM sheet_rows
WHERE date NOT BETWEEN DATE '2024-01-02' AND DATE '2024-01-31'""",
)
_cte(
    "long",
    ("cells", "quality"),
    f"""
SELECT c.*, q.lead_gap, q.span, q.quality_status, q.active_status,
       c.pos >= q.lead_gap AND c.pos < q.lead_gap + q.span AS in_span
FROM cells c JOIN quality q USING ({_ID})""",
)
_cte(
    "validation",
    ("long",),
    """
SELECT sheet, count(DISTINCT (meter_id, energy_flow)) AS series, count(DISTINCT meter_id) AS meters,
       count(DISTINCT meter_id) FILTER (energy_flow = 'consumption_import') AS imports,
       count(DISTINCT meter_id) FILTER (energy_flow = 'injection_export') AS exports,
       count(*) AS total, count(*) FILTER (value IS NULL) AS missing, coalesce(sum(value), 0.0) AS energy,
       count(DISTINCT (sheet, interval_start)) AS time_rows
FROM long GROUP BY ROLLUP (sheet)""",
)

# --- profiles --------------------------------------------------------------------------------

_BASIC = """count(*) AS expected_rows, count(energy_kwh) AS valid_hours,
       coalesce(sum(energy_kwh), 0.0) AS energy_total_kwh, avg(energy_kwh) AS energy_mean_kwh,
       stddev_samp(energy_kwh) AS energy_std_kwh, max(energy_kwh) AS energy_max_kwh,
       count(*) - count(energy_kwh) AS missing_hours, count(energy_kwh) / count(*) AS coverage_share,
       avg(energy_kwh) FILTER (is_peak_07_18) AS peak_mean_kwh,
       avg(energy_kwh) FILTER (NOT is_peak_07_18) AS offpeak_mean_kwh,
       avg(energy_kwh) FILTER (NOT is_weekend) AS weekday_mean_kwh,
       avg(energy_kwh) FILTER (is_weekend) AS weekend_mean_kwh,
       CASE WHEN count(*) FILTER (NOT is_peak_07_18) > 0
            THEN coalesce(avg(energy_kwh) FILTER (NOT is_peak_07_18), 0) = 0 END AS zero_offpeak_denominator,
       CASE WHEN count(*) FILTER (is_weekend) > 0
            THEN coalesce(avg(energy_kwh) FILTER (is_weekend), 0) = 0 END AS zero_weekend_denominator"""
_RATIOS = """CASE WHEN offpeak_mean_kwh > 0 THEN peak_mean_kwh / offpeak_mean_kwh END AS peak_offpeak_ratio,
       CASE WHEN weekend_mean_kwh > 0 THEN weekday_mean_kwh / weekend_mean_kwh END AS weekday_weekend_ratio,
       CASE WHEN energy_mean_kwh > 0 THEN energy_std_kwh / energy_mean_kwh END AS coefficient_of_variation,
       CASE WHEN energy_max_kwh > 0 THEN energy_mean_kwh / energy_max_kwh END AS load_factor"""


def _basic(source: str, keys: str) -> str:
    return f"SELECT *, {_RATIOS} FROM (SELECT {keys}, {_BASIC} FROM {source} GROUP BY {keys})"


def _company_hours(source: str) -> str:
    return f"""
SELECT company_id, interval_start, date, hour_1_24, is_weekend, is_peak_07_18,
       sum(energy_kwh) AS energy_kwh, count(energy_kwh) AS reporting_meter_count
FROM {source} WHERE energy_flow = 'consumption_import' GROUP BY ALL"""


def _monthly(source: str, keys: str, start: str, end: str) -> str:
    return f"""
SELECT *, month_mean_kwh / profile_period_mean_kwh AS seasonality_index FROM (
  SELECT g.*, valid_hours / expected_hours AS coverage_share, p.profile_period_mean_kwh FROM (
    SELECT {keys}, date_trunc('month', interval_start) AS month_start,
           coalesce(sum(energy_kwh), 0.0) AS month_total_kwh, avg(energy_kwh) AS month_mean_kwh,
           count(energy_kwh) AS valid_hours, count(*) AS expected_hours
    FROM {source} WHERE interval_start BETWEEN TIMESTAMP '{start} 00:00:00' AND TIMESTAMP '{end} 23:00:00'
    GROUP BY ALL) g
  JOIN (SELECT {keys}, avg(energy_kwh) AS profile_period_mean_kwh FROM {source}
        WHERE interval_start BETWEEN TIMESTAMP '{start} 00:00:00' AND TIMESTAMP '{end} 23:00:00'
        GROUP BY ALL) p USING ({keys}))"""


def _seasonal(monthly: str, keys: str, scope: str, index: float, difference: float) -> str:
    by = f"PARTITION BY {scope}" if scope else ""
    return f"""
SELECT {keys}, summer_index, winter_index,
  CASE WHEN summer_index >= {index} AND summer_index - winter_index >= {difference} THEN 'summer'
       WHEN winter_index >= {index} AND winter_index - summer_index >= {difference} THEN 'winter'
       ELSE 'none' END AS seasonality_label,
  first_3_months_mean_kwh, last_month_mean_kwh,
  CASE WHEN first_3_months_mean_kwh > 0
       THEN (last_month_mean_kwh - first_3_months_mean_kwh) / first_3_months_mean_kwh END AS monthly_trend_pct,
  months_with_values, covered AS months_with_90pct_coverage, covered = 12 AS seasonality_reliable,
  f = 3 AND fc = 3 AND l = 1 AND lc = 1 AS trend_reliable
FROM (
  SELECT {keys},
    avg(seasonality_index) FILTER (month(month_start) IN (6, 7, 8)) AS summer_index,
    avg(seasonality_index) FILTER (month(month_start) IN (12, 1, 2)) AS winter_index,
    avg(month_mean_kwh) FILTER (rank <= 3) AS first_3_months_mean_kwh,
    avg(month_mean_kwh) FILTER (is_last) AS last_month_mean_kwh,
    count(*) FILTER (valid_hours > 0) AS months_with_values,
    count(*) FILTER (coverage_share >= 0.9) AS covered,
    count(*) FILTER (rank <= 3) AS f, count(*) FILTER (rank <= 3 AND coverage_share >= 0.9) AS fc,
    count(*) FILTER (is_last) AS l, count(*) FILTER (is_last AND coverage_share >= 0.9) AS lc
  FROM (SELECT *, dense_rank() OVER ({by} ORDER BY month_start) AS rank,
               month_start = max(month_start) OVER ({by}) AS is_last FROM {monthly})
  GROUP BY {keys})"""


_METER = "company_id, meter_id, energy_flow"
_METER_FULL = f"{_METER}, quality_status, active_period_quality_status, source_sheet"
_cte("company_hours", ("hourly",), _company_hours("hourly"))
_cte("company_hours_y", ("daily_readings",), _company_hours("daily_readings"))
_cte("meter_metrics", ("hourly",), _basic("hourly", _METER))
_cte("company_metrics", ("company_hours",), _basic("company_hours", "company_id"))
_cte("company_month_y", ("company_hours_y",), _monthly("company_hours_y", "company_id", "1998-01-01", "1998-12-31"))
_cte("seasonal_y", ("company_month_y",), _seasonal("company_month_y", "company_id", "", 1.02, 0.02))
_cte(
    "company_full_y",
    ("company_hours_y", "seasonal_y", "daily_readings"),
    f"""
SELECT * FROM ({_basic("company_hours_y", "company_id")}) LEFT JOIN seasonal_y USING (company_id)
LEFT JOIN (SELECT company_id, count(DISTINCT meter_id) AS meter_count FROM daily_readings
           WHERE energy_flow = 'consumption_import' GROUP BY ALL) USING (company_id)
LEFT JOIN (SELECT company_id, avg(reporting_meter_count) AS mean_reporting_meters,
                  min(reporting_meter_count) AS minimum_reporting_meters,
                  max(reporting_meter_count) AS maximum_reporting_meters
           FROM company_hours_y GROUP BY ALL) USING (company_id)""",
)
_cte(
    "company_month",
    ("company_hours",),
    _monthly("company_hours", "company_id", "2024-01-01", "2024-01-30"),
)
_cte("seasonal", ("company_month",), _seasonal("company_month", "company_id", "", 1.15, 0.1))
_cte(
    "meter_month",
    ("hourly",),
    _monthly("hourly", f"{_METER}, source_sheet", "2024-01-01", "2024-01-30"),
)
_cte(
    "meter_seasonal",
    ("meter_month",),
    _seasonal("meter_month", f"{_METER}, source_sheet", "source_sheet", 1.15, 0.1),
)
_cte(
    "meter_hours",
    ("hourly",),
    f"SELECT {_METER}, hour_1_24, avg(energy_kwh) AS mean_kwh, count(energy_kwh) AS valid_hours FROM hourly GROUP BY ALL",
)
_cte(
    "pairs",
    ("meter_hours",),
    """
SELECT company_id, a, b,
  CASE WHEN n < 6 THEN NULL WHEN flat_a AND flat_b THEN 1.0 WHEN flat_a OR flat_b THEN 0.0 ELSE r END AS r
FROM (
  SELECT x.company_id, x.meter_id AS a, y.meter_id AS b, count(*) AS n,
         min(x.mean_kwh) = max(x.mean_kwh) AS flat_a, min(y.mean_kwh) = max(y.mean_kwh) AS flat_b,
         corr(x.mean_kwh, y.mean_kwh) AS r
  FROM meter_hours x JOIN meter_hours y
    ON x.company_id = y.company_id AND x.hour_1_24 = y.hour_1_24 AND x.meter_id < y.meter_id
  WHERE x.energy_flow = 'consumption_import' AND y.energy_flow = 'consumption_import'
    AND x.mean_kwh IS NOT NULL AND y.mean_kwh IS NOT NULL
  GROUP BY ALL)""",
)
_cte(
    "heterogeneity",
    ("meter_metrics", "pairs"),
    """
SELECT company_id, meter_count, mean_r, min_r, CASE WHEN meter_count = 1 THEN 0.0 ELSE peak_range END AS peak_range,
  CASE WHEN meter_count = 1 THEN 0.0 ELSE load_range END AS load_range,
  CASE WHEN meter_count = 1 THEN 'single_meter' WHEN min_r >= 0.8 THEN 'similar'
       WHEN mean_r >= 0.5 THEN 'partly_different' ELSE 'clearly_different' END AS similarity
FROM (SELECT company_id, count(*) AS meter_count, max(peak_offpeak_ratio) - min(peak_offpeak_ratio) AS peak_range,
             max(load_factor) - min(load_factor) AS load_range
      FROM meter_metrics WHERE energy_flow = 'consumption_import' GROUP BY ALL)
LEFT JOIN (SELECT company_id, avg(r) AS mean_r, min(r) AS min_r FROM pairs GROUP BY ALL) USING (company_id)""",
)

# --- outliers --------------------------------------------------------------------------------

_VERDICT = """CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS outlier_direction,
  CASE WHEN z > 0 THEN 'above the mean with z > 3' ELSE 'below the mean with z < -3' END AS reason,
  CASE WHEN z < 0 THEN 'technical_or_outage' WHEN energy_kwh > 5 * energy_mean_kwh THEN 'technical'
       ELSE 'business_check' END AS recommendation"""
_cte(
    "meter_outliers",
    ("hourly", "meter_metrics"),
    f"""
SELECT *, {_VERDICT} FROM (
  SELECT h.*, b.energy_mean_kwh, b.energy_std_kwh,
         CASE WHEN b.energy_std_kwh > 0 THEN (h.energy_kwh - b.energy_mean_kwh) / b.energy_std_kwh END AS z
  FROM hourly h JOIN meter_metrics b USING ({_METER})) WHERE abs(z) > 3""",
)
_cte(
    "company_outliers",
    ("company_hours", "company_metrics"),
    f"""
SELECT *, {_VERDICT} FROM (
  SELECT h.*, b.energy_mean_kwh, b.energy_std_kwh,
         CASE WHEN b.energy_std_kwh > 0 THEN (h.energy_kwh - b.energy_mean_kwh) / b.energy_std_kwh END AS z
  FROM company_hours h JOIN company_metrics b USING (company_id)) WHERE abs(z) > 3""",
)
_cte(
    "peer_values",
    ("company_full_y",),
    " UNION ALL ".join(
        f"SELECT company_id, '{m}' AS metric, {m} AS v FROM company_full_y WHERE {m} IS NOT NULL" for m in PEER_METRICS
    ),
)
_cte(
    "peers",
    ("peer_values",),
    """
SELECT *, (v - mu) / sd AS z FROM peer_values
JOIN (SELECT metric, avg(v) AS mu, stddev_samp(v) AS sd FROM peer_values GROUP BY ALL) USING (metric)
WHERE sd > 0 AND abs((v - mu) / sd) > 2""",
)

# --- weather and holidays --------------------------------------------------------------------

_cte(
    "doc_hours",
    (),
    f"""
SELECT user_id // {fx.USERS_PER_COMPANY} + 1 AS n, date_trunc('hour', ts) AS hour, max(floor(value * 4) / 4) AS t
FROM events GROUP BY ALL""",
)
_cte(
    "doc_days",
    ("doc_hours",),
    "SELECT n, CAST(hour AS DATE) AS date, avg(t) AS mean, min(t) AS low, max(t) AS high FROM doc_hours GROUP BY ALL",
)


def _degrees(mean: str) -> str:
    return f"greatest(0.0, 18 - {mean}) AS hdd_18, greatest(0.0, {mean} - 18) AS cdd_18"


_cte(
    "weather",
    ("hours",),
    f"""
SELECT h.*, d.temperature_2m_mean, temperature_2m_min, temperature_2m_max, {_degrees("temperature_2m_mean")}
FROM (SELECT hour AS interval_start, CAST(hour AS DATE) AS date,
             CAST((dayofyear(hour) * 3) % 36 - 4 + (hour(hour) % 6) * 0.5 AS DOUBLE) AS temperature_2m FROM hours) h
JOIN (SELECT CAST(hour AS DATE) AS date, avg(t) AS temperature_2m_mean, min(t) AS temperature_2m_min,
             max(t) AS temperature_2m_max
      FROM (SELECT hour, CAST((dayofyear(hour) * 3) % 36 - 4 + (hour(hour) % 6) * 0.5 AS DOUBLE) AS t FROM hours)
      GROUP BY ALL) d USING (date)""",
)


def _calendar(events: str, first: str, last: str) -> str:
    return f"""
SELECT *, coalesce(lead(is_holiday_or_day_off) OVER (ORDER BY date), false) AS is_day_before_holiday,
       coalesce(lag(is_holiday_or_day_off) OVER (ORDER BY date), false) AS is_day_after_holiday
FROM (
  SELECT d.date, a.names IS NOT NULL AS is_official_holiday_date, a.names AS actual_holiday_name,
         o.names IS NOT NULL AS is_observed_day_off, o.names AS observed_holiday_name,
         a.names IS NOT NULL OR o.names IS NOT NULL AS is_holiday_or_day_off,
         CASE WHEN a.names IS NULL THEN o.names WHEN o.names IS NULL OR a.names = o.names THEN a.names
              ELSE least(a.names, o.names) || '; ' || greatest(a.names, o.names) END AS holiday_name
  FROM (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS date) d
  LEFT JOIN (SELECT holiday_date AS date, string_agg(DISTINCT holiday_name, '; ' ORDER BY holiday_name) AS names
             FROM {events} GROUP BY ALL) a USING (date)
  LEFT JOIN (SELECT observed_date AS date, string_agg(DISTINCT holiday_name, '; ' ORDER BY holiday_name) AS names
             FROM {events} GROUP BY ALL) o USING (date))"""


_cte(
    "holidays",
    (),
    """
SELECT * FROM (VALUES ('New Year 1', DATE '2024-01-01', DATE '2024-01-01'),
  ('New Year 2', DATE '2024-01-02', DATE '2024-01-02'), ('Winter Feast', DATE '2024-01-07', DATE '2024-01-08'),
  ('Local Day', DATE '2024-01-07', DATE '2024-01-08')) t(holiday_name, holiday_date, observed_date)""",
)
_cte("calendar", ("holidays",), _calendar("holidays", "2024-01-01", "2024-01-30"))
_cte(
    "order_holidays",
    (),
    f"""
SELECT o_orderpriority AS holiday_name, CAST(o_orderdate AS DATE) AS holiday_date,
       CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS observed_date
FROM orders JOIN (
  SELECT CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY 1
  HAVING sum(CAST(floor(o_totalprice * 4) AS BIGINT)) % {fx.HOLIDAY_EVERY} = 0) ON day = CAST(o_orderdate AS DATE)""",
)
_cte("order_calendar", ("order_holidays",), _calendar("order_holidays", "1995-01-01", "2001-12-31"))
_cte(
    "enriched",
    ("hourly", "weather", "calendar"),
    """
SELECT h.*, w.* EXCLUDE (interval_start, date), c.* EXCLUDE (date, actual_holiday_name, observed_holiday_name)
FROM hourly h LEFT JOIN weather w USING (interval_start) LEFT JOIN calendar c ON c.date = h.date""",
)
_DAY = (
    "date, temperature_2m_mean, temperature_2m_min, temperature_2m_max, hdd_18, cdd_18, "
    "is_holiday_or_day_off, holiday_name"
)
_cte(
    "meter_day",
    ("enriched",),
    f"""
SELECT company_id, meter_id, {_DAY}, coalesce(sum(energy_kwh), 0.0) AS energy_total_kwh, count(energy_kwh) AS valid_hours
FROM enriched WHERE energy_flow = 'consumption_import' GROUP BY ALL""",
)
_cte(
    "company_day",
    ("meter_day",),
    f"""
SELECT company_id, {_DAY}, sum(energy_total_kwh) AS energy_total_kwh, sum(valid_hours) AS valid_hours,
       count(DISTINCT meter_id) AS reporting_meters FROM meter_day GROUP BY ALL""",
)


def _corr(y: str) -> str:
    return (
        f"CASE WHEN min(energy_total_kwh) < max(energy_total_kwh) AND min({y}) < max({y}) "
        f"THEN corr(energy_total_kwh, {y}) END"
    )


def _sensitivity(source: str, keys: str) -> str:
    return f"""
SELECT *, CASE WHEN hdd_r >= 0.3 AND cdd_r >= 0.3 THEN 'both' WHEN hdd_r >= 0.3 THEN 'heating'
               WHEN cdd_r >= 0.3 THEN 'cooling' ELSE 'unclear' END AS label, days >= 20 AS reliable
FROM (
  SELECT k.*, coalesce(days, 0) AS days, temp_r, hdd_r, cdd_r, cold, hot
  FROM (SELECT DISTINCT {keys} FROM {source}) k LEFT JOIN (
    SELECT {keys}, count(*) AS days, {_corr("temperature_2m_mean")} AS temp_r, {_corr("hdd_18")} AS hdd_r,
           {_corr("cdd_18")} AS cdd_r, avg(energy_total_kwh) FILTER (temperature_2m_mean <= q25) AS cold,
           avg(energy_total_kwh) FILTER (temperature_2m_mean >= q75) AS hot
    FROM (SELECT * FROM {source} WHERE valid_hours > 0)
    JOIN (SELECT {keys}, quantile_cont(temperature_2m_mean, 0.25) AS q25, quantile_cont(temperature_2m_mean, 0.75) AS q75
          FROM {source} WHERE valid_hours > 0 GROUP BY ALL) USING ({keys})
    GROUP BY {keys}) USING ({keys}))"""


_cte("sense_company", ("company_day",), _sensitivity("company_day", "company_id"))
_cte("sense_meter", ("meter_day",), _sensitivity("meter_day", "company_id, meter_id"))
_cte(
    "effects",
    ("company_day",),
    """
SELECT h.company_id, h.date, h.holiday_name, isodow(h.date) - 1 AS weekday, h.energy_total_kwh AS energy,
       b.baseline, CASE WHEN b.baseline > 0 THEN (h.energy_total_kwh - b.baseline) / b.baseline END AS effect,
       coalesce(b.days, 0) AS days
FROM company_day h LEFT JOIN (
  SELECT company_id, isodow(date) AS dow, avg(energy_total_kwh) AS baseline, count(*) AS days
  FROM company_day WHERE NOT is_holiday_or_day_off AND valid_hours > 0 GROUP BY ALL) b
  ON b.company_id = h.company_id AND b.dow = isodow(h.date)
WHERE h.is_holiday_or_day_off AND h.valid_hours > 0""",
)
_cte(
    "holiday_sum",
    ("effects",),
    """
SELECT *, CASE WHEN mean_effect <= -0.2 THEN 'lower' WHEN mean_effect >= 0.2 THEN 'higher' ELSE 'limited' END AS label
FROM (SELECT company_id, count(DISTINCT date) AS days, avg(effect) AS mean_effect, median(effect) AS median_effect,
             count(*) FILTER (effect < 0) AS reductions FROM effects GROUP BY ALL)""",
)
_cte(
    "context",
    ("company_outliers", "weather", "calendar"),
    """
SELECT o.*, w.temperature_2m, w.temperature_2m_mean, w.hdd_18, w.cdd_18, c.is_holiday_or_day_off, c.holiday_name,
       CASE WHEN c.is_holiday_or_day_off THEN 'holiday' WHEN w.temperature_2m <= 5 THEN 'cold'
            WHEN w.temperature_2m >= 30 THEN 'hot' ELSE 'none' END AS context
FROM company_outliers o LEFT JOIN weather w USING (interval_start) LEFT JOIN calendar c ON c.date = o.date""",
)

# --- company groups --------------------------------------------------------------------------

_cte(
    "eligible",
    ("company_full_y",),
    "SELECT * FROM company_full_y WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in CLUSTER_FEATURES),
)
_cte(
    "labelled",
    ("eligible",),
    "SELECT e.*, n_regionkey AS region FROM eligible e JOIN nation ON e.company_id = 'Company ' || (n_nationkey + 1)",
)
_cte(
    "region_centers",
    ("labelled",),
    "SELECT region, " + ", ".join(f"avg({f}) AS {f}" for f in CLUSTER_FEATURES) + " FROM labelled GROUP BY ALL",
)


def _scaled(scaler: str) -> str:
    parts = []
    for f in CLUSTER_FEATURES:
        offset, scale = {
            "standard": (f"avg({f}) OVER ()", f"stddev_pop({f}) OVER ()"),
            "minmax": (f"min({f}) OVER ()", f"(max({f}) OVER () - min({f}) OVER ())"),
            "robust": (
                f"quantile_cont({f}, 0.5) OVER ()",
                f"(quantile_cont({f}, 0.75) OVER () - quantile_cont({f}, 0.25) OVER ())",
            ),
        }[scaler]
        parts.append(f"({f} - {offset}) / CASE WHEN {scale} > 0 THEN {scale} ELSE 1 END AS {f}")
    return ", ".join(parts)


_cte("minmax", ("labelled",), f"SELECT company_id, region, {_scaled('minmax')} FROM labelled")
# Principal components by power iteration: the covariance matrix as a list of rows, then twice the fixed direction of
# repeated multiplication, the second time with the first component taken out.
_SIDE = range(len(CLUSTER_FEATURES))
_CENTRED = ", ".join(f"{f} - avg({f}) OVER ()" for f in CLUSTER_FEATURES)
_COVARIANCES = ", ".join(
    "[" + ", ".join(f"covar_samp({f}, {g})" for g in CLUSTER_FEATURES) + "]" for f in CLUSTER_FEATURES
)
_POWER_STEPS = 1500


def _power(matrix: str) -> str:
    start = ", ".join(f"CAST({1 + i / 7} AS DOUBLE)" for i in _SIDE)
    return f"""
SELECT 0 AS n, [{start}] AS v
UNION ALL
SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (
  SELECT n, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM {matrix}_power, {matrix}
  WHERE n < {_POWER_STEPS})"""


def _component(matrix: str) -> str:
    return f"""
SELECT CASE WHEN list_max(v) >= -list_min(v) THEN v ELSE list_transform(v, lambda x: -x) END AS v,
       list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS size
FROM {matrix}_power, {matrix} WHERE n = {_POWER_STEPS}"""


_cte("centred", ("minmax",), f"SELECT company_id, [{_CENTRED}] AS x FROM minmax")
_cte("spread", ("minmax",), f"SELECT [{_COVARIANCES}] AS m FROM minmax")
_cte("spread_power", ("spread",), _power("spread"))
_cte("axis_1", ("spread_power",), _component("spread"))
_cte(
    "rest",
    ("axis_1",),
    """
SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1),
         lambda j: m[i][j] - size * v[i] * v[j])) AS m FROM spread, axis_1""",
)
_cte("rest_power", ("rest",), _power("rest"))
_cte("axis_2", ("rest_power",), _component("rest"))
_cte(
    "silhouettes",
    ("minmax",),
    f"""
SELECT CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM (
  SELECT company_id, max(CASE WHEN own THEN total / nullif(members, 0) END) AS a,
         min(CASE WHEN NOT own THEN total / members END) AS b
  FROM (
    SELECT x.company_id, x.region = y.region AS own, y.region,
           count(*) FILTER (x.company_id <> y.company_id) AS members,
           sum(sqrt({" + ".join(f"(x.{f} - y.{f}) ** 2" for f in CLUSTER_FEATURES)})) AS total
    FROM minmax x CROSS JOIN minmax y GROUP BY ALL)
  GROUP BY company_id)""",
)
_cte(
    "bands",
    (),
    """
SELECT CAST(k AS INT) AS k, sum(abs(price - (least(floor(price / width), k - 1) * width + width / 2))) AS inertia
FROM (SELECT floor(o_totalprice * 4) / 4 AS price, k, floor(520000 / k) AS width
      FROM orders CROSS JOIN (SELECT unnest(generate_series(2, 8)) AS k))
GROUP BY k""",
)
_cte(
    "unit_curve",
    ("bands",),
    """
SELECT k, inertia, (k - 2) / 6 AS x,
       (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS y FROM bands""",
)


def _metrics(*rows: tuple[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS metric, ROUND(CAST(({value}) AS DOUBLE), 6) AS value" for name, value in rows
    )


def _count(source: str, where: str = "") -> str:
    return f"SELECT count(*) FROM {source}" + (f" WHERE {where}" if where else "")


_BASIC_SPEC = """
i expected_rows
i valid_hours
r energy_total_kwh
r energy_mean_kwh
r energy_std_kwh
r energy_max_kwh
r peak_mean_kwh
r offpeak_mean_kwh
r weekday_mean_kwh
r weekend_mean_kwh
i missing_hours
r coverage_share
r peak_offpeak_ratio
r weekday_weekend_ratio
r coefficient_of_variation
r load_factor
p zero_offpeak_denominator
p zero_weekend_denominator
"""
_SEASONAL_SPEC = """
r summer_index
r winter_index
p seasonality_label
r first_3_months_mean_kwh
r last_month_mean_kwh
r monthly_trend_pct
i months_with_values
i months_with_90pct_coverage
p seasonality_reliable
p trend_reliable
"""
_MONTH_SPEC = """
t month_start
r month_total_kwh
r month_mean_kwh
i valid_hours
i expected_hours
r coverage_share
r profile_period_mean_kwh
r seasonality_index
"""
_OUTLIER_SPEC = """
p company_id
t interval_start
t date
i hour_1_24
r energy_kwh
r energy_mean_kwh
r energy_std_kwh
r z_score = z
p outlier_direction
p reason
p recommendation
"""
_DAY_SPEC = """
t date
r temperature_2m_mean
r temperature_2m_min
r temperature_2m_max
r hdd_18
r cdd_18
p is_holiday_or_day_off
p holiday_name
r energy_total_kwh
i valid_hours
"""
_SENSE_SPEC = """
i days_with_consumption = days
r temperature_correlation = temp_r
r hdd_correlation = hdd_r
r cdd_correlation = cdd_r
r cold_days_mean_kwh = cold
r hot_days_mean_kwh = hot
p weather_sensitivity_label = label
p weather_analysis_reliable = reliable
"""
_CALENDAR_SPEC = """
t interval_start
t interval_end
i year
i month
i weekday_number
p is_weekend
i hour_1_24
p is_peak_07_18
"""
_ID_SPEC = _lines("p", ("sheet", "company_id", "meter_id", "energy_flow"))
_METER_SPEC = _lines("p", ("company_id", "meter_id", "energy_flow"))
_REPORTING_SPEC = """
i meter_count
r mean_reporting_meters
i minimum_reporting_meters
i maximum_reporting_meters
"""


def _select(needs: str | tuple[str, ...], spec: str, source: str | None = None) -> str:
    needs = (needs,) if isinstance(needs, str) else needs
    return _with(needs, f"SELECT {_columns(spec)}\nFROM {source or needs[0]}")


def all_oracles() -> dict[str, str]:
    o: dict[str, str] = {}

    o["header_parse"] = _select(
        "series", 'p sheet\np "column"\np company_id\np meter_id\np energy_flow'
    )
    o["calendar_columns"] = _with(
        (),
        "SELECT "
        + _columns("i o_orderkey\nt date\n" + _CALENDAR_SPEC)
        + f"""\nFROM (SELECT *, {_CALENDAR} FROM (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderkey % 24 + 1 AS hour_1_24,
         o_orderdate + CAST(o_orderkey % 24 AS INT) * INTERVAL '1' HOUR AS interval_start FROM orders))""",
    )
    o["wide_to_long"] = _select(
        "cells", _ID_SPEC + "\ni row_position = pos\nt date\ni hour\np tariff\np raw_value = raw\nr value\np kind"
    )
    o["series_quality"] = _select(
        "quality",
        _ID_SPEC
        + """
i expected_hours
i valid_numeric_hours = valid
i missing_hours = missing
r missing_share
i leading_missing_hours = lead_gap
i internal_missing_hours = internal
i trailing_missing_hours = tail_gap
i active_span_hours = span
r internal_missing_share_active_span = internal_share
p missing_pattern = pattern
i negative_values = negative
i non_numeric_values = non_numeric
i zero_hours = zeros
i zero_run_events_48h_plus = events
i zero_run_hours_48h_plus = event_hours
i maximum_zero_run_hours = longest
i extreme_values_50x_mean = extremes
r mean_kwh
r std_kwh
r min_kwh
r max_kwh
p quality_status
p active_period_quality_status = active_status
""",
    )
    o["sheet_checks"] = _with(
        ("sheet_rows", "series"),
        "SELECT "
        + _columns(
            """
p sheet
i data_rows = sum(copies)
i series_columns = any_value(columns)
i physical_meters = any_value(meters)
i missing_time_keys = 720 - count(*) FILTER (date BETWEEN DATE '2024-01-02' AND DATE '2024-01-31')
i extra_time_keys = count(*) FILTER (date NOT BETWEEN DATE '2024-01-02' AND DATE '2024-01-31')
i duplicate_time_keys = sum(copies) - count(*)
i invalid_hours = count(*) FILTER (hour NOT BETWEEN 1 AND 24)
i date_metadata_mismatches = sum(copies) FILTER (py <> year(date) OR pm <> month(date))
"""
        )
        + """\nFROM sheet_rows JOIN (SELECT sheet, count(*) AS columns, count(DISTINCT meter_id) AS meters
FROM series GROUP BY ALL) USING (sheet) GROUP BY sheet""",
    )
    o["zero_runs"] = _with(
        ("runs", "cells"),
        "SELECT "
        + _columns(
            _ID_SPEC
            + """
t start_date = a.date
i start_hour = a.hour
i run_hours
t next_date = b.date
i next_hour = b.hour
"""
        ).replace("sheet AS sheet", "r.sheet AS sheet")
        + """
FROM runs r JOIN (SELECT DISTINCT sheet, pos, date, hour FROM cells) a ON a.sheet = r.sheet AND a.pos = first_pos
LEFT JOIN (SELECT DISTINCT sheet, pos, date, hour FROM cells) b ON b.sheet = r.sheet AND b.pos = last_pos + 1
WHERE run_hours >= 20""",
    )
    o["value_anomalies"] = _select("anomalies", _ID_SPEC + "\nt date\ni hour\np value = raw\np reason")
    o["timeline_issues"] = _select("timeline", "p sheet\nt date\np hour\np issue")
    o["quality_summary"] = _with(
        ("quality", "sheet_rows", "timeline", "anomalies"),
        _metrics(
            ("sheet_count", "SELECT count(DISTINCT sheet) FROM sheet_rows"),
            ("series_count", _count("quality")),
            ("physical_meter_count", "SELECT count(DISTINCT meter_id) FROM quality"),
            ("company_count", "SELECT count(DISTINCT company_id) FROM quality"),
            *[(f"{s}_series", _count("quality", f"quality_status = '{s}'")) for s in ("clean", "review", "unusable")],
            *[
                (f"active_period_{s}_series", _count("quality", f"active_status = '{s}'"))
                for s in ("clean", "review", "unusable")
            ],
            ("timeline_issue_count", _count("timeline")),
            ("anomaly_count", _count("anomalies")),
        ),
    )
    o["active_span_flag"] = _with(
        ("long",),
        "SELECT "
        + _columns(
            _METER_SPEC
            + """
t interval_start
t interval_end = interval_start + INTERVAL 1 HOUR
t date
i year = year(date)
i month = month(date)
i weekday_number = isodow(date) - 1
p is_weekend = isodow(date) >= 6
i hour_1_24 = hour
p is_peak_07_18 = hour BETWEEN 7 AND 18
p tariff
r energy_kwh = value
p is_missing = value IS NULL
p in_active_span = in_span
p quality_status
p active_period_quality_status = active_status
p source_sheet = sheet
"""
        )
        + "\nFROM long",
    )
    o["long_validation"] = _select(
        "validation",
        """
p sheet
i series
i physical_meters = meters
i consumption_import_series = imports
i injection_export_series = exports
i output_rows = total
i missing_energy_rows = missing
r energy_sum_kwh = energy
i time_rows
""",
    )
    o["long_summary"] = _with(
        ("validation",),
        _metrics(
            *[
                (name, f"SELECT {column} FROM validation WHERE sheet IS NULL")
                for name, column in (
                    ("series_count", "series"),
                    ("physical_meter_count", "meters"),
                    ("consumption_import_series", "imports"),
                    ("injection_export_series", "exports"),
                    ("output_rows", "total"),
                    ("missing_energy_rows", "missing"),
                    ("non_missing_energy_rows", "total - missing"),
                    ("energy_sum_kwh", "energy"),
                )
            ]
        ),
    )
    series_by = "SELECT {k} FROM series GROUP BY ALL HAVING {c}"
    checks = (
        ("series_unique_in_sheet", _count("(" + series_by.format(k="sheet, meter_id, energy_flow", c="count(*) > 1") + ")")),
        ("series_unique_across_sheets", _count("(" + series_by.format(k="meter_id, energy_flow", c="count(DISTINCT sheet) > 1") + ")")),
        (
            "prosumer_has_both_flows",
            _count(
                "(SELECT meter_id FROM series WHERE lower(sheet) LIKE '%prosumer%' GROUP BY ALL "
                "HAVING count(DISTINCT energy_flow) <> 2)"
            ),
        ),
        ("time_key_unique_in_sheet", _count("sheet_rows", "copies > 1")),
        (
            "rows_equal_time_rows_by_series",
            "SELECT count(*) FROM (SELECT sheet, count(*) AS a FROM long GROUP BY ALL) "
            "JOIN (SELECT sheet, sum(copies) AS b FROM sheet_rows GROUP BY ALL) USING (sheet) "
            "JOIN (SELECT sheet, count(*) AS c FROM series GROUP BY ALL) USING (sheet) WHERE a <> b * c",
        ),
        (
            "missing_equals_quality_report",
            "SELECT count(*) FROM (SELECT sheet, count(*) FILTER (value IS NULL) AS a FROM long GROUP BY ALL) "
            "JOIN (SELECT sheet, sum(missing + non_numeric) AS b FROM quality GROUP BY ALL) USING (sheet) WHERE a <> b",
        ),
        ("series_has_quality_row", f"SELECT count(*) FROM (SELECT {_ID} FROM cells EXCEPT SELECT {_ID} FROM quality)"),
        ("written_rows_equal_produced", "SELECT abs((SELECT count(*) FROM cells) - (SELECT count(*) FROM long))"),
        ("weather_hours_complete", "SELECT abs(720 - count(*)) FROM weather"),
        ("weather_hour_unique", "SELECT count(*) - count(DISTINCT interval_start) FROM weather"),
        ("weather_temperature_present", _count("weather", "temperature_2m IS NULL")),
        ("calendar_date_unique", "SELECT count(*) - count(DISTINCT date) FROM calendar"),
        (
            "enrichment_keeps_rows",
            "SELECT abs((SELECT count(*) FROM long) - (SELECT count(*) FROM long LEFT JOIN weather USING (interval_start)))",
        ),
        (
            "enriched_temperature_present",
            "SELECT count(*) FROM long LEFT JOIN weather USING (interval_start) WHERE temperature_2m IS NULL",
        ),
        ("required_tables_present", "SELECT 1"),
    )
    o["run_audits"] = _with(
        ("long", "series", "sheet_rows", "weather", "calendar"),
        "SELECT *, violations = 0 AS passed FROM ("
        + "\nUNION ALL ".join(
            f"SELECT '{name}' AS \"check\", CAST(({sql}) AS BIGINT) AS violations" for name, sql in checks
        )
        + ")",
    )

    o["basic_metrics_company"] = _select("company_metrics", "p company_id" + _BASIC_SPEC)
    o["basic_metrics_meter"] = _select("meter_metrics", _METER_SPEC + _BASIC_SPEC)
    o["company_hourly"] = _select(
        "company_hours",
        "p company_id\nt interval_start\nt date\ni hour_1_24\np is_weekend\np is_peak_07_18\nr energy_kwh\n"
        "i reporting_meter_count",
    )
    o["monthly_profiles"] = _with(
        ("daily_readings",),
        "SELECT "
        + _columns(_METER_SPEC + _MONTH_SPEC)
        + f"\nFROM ({_monthly('daily_readings', _METER, '1998-01-01', '1998-12-31')})",
    )
    o["company_monthly_profiles"] = _select("company_month_y", "p company_id" + _MONTH_SPEC)
    o["seasonality_trend"] = _select("seasonal_y", "p company_id" + _SEASONAL_SPEC)
    o["meter_profile_metrics"] = _with(
        ("hourly", "meter_seasonal"),
        "SELECT "
        + _columns(_lines("p", _METER_FULL.split(", ")) + _BASIC_SPEC + _SEASONAL_SPEC)
        + f"\nFROM ({_basic('hourly', _METER_FULL)}) LEFT JOIN meter_seasonal USING ({_METER}, source_sheet)",
    )
    o["company_profile_metrics"] = _select(
        "company_full_y", "p company_id" + _BASIC_SPEC + _SEASONAL_SPEC + _REPORTING_SPEC
    )
    o["hourly_profiles"] = _select("meter_hours", _METER_SPEC + "\ni hour_1_24\nr mean_kwh\ni valid_hours")
    o["company_hourly_profiles"] = _with(
        ("company_hours",),
        "SELECT company_id, CAST(hour_1_24 AS BIGINT) AS hour_1_24, ROUND(avg(energy_kwh), 6) AS mean_kwh, "
        "count(energy_kwh) AS valid_hours FROM company_hours GROUP BY ALL",
    )
    o["meter_heterogeneity"] = _select(
        "heterogeneity",
        """
p company_id
i meter_count
r mean_pairwise_profile_correlation = mean_r
r minimum_pairwise_profile_correlation = min_r
r peak_ratio_range = peak_range
r load_factor_range = load_range
p meter_profile_similarity = similarity
""",
    )
    o["profile_summary"] = _with(
        ("meter_metrics", "company_metrics", "company_month", "heterogeneity"),
        _metrics(
            ("meter_energy_series", _count("meter_metrics")),
            ("physical_meters", "SELECT count(DISTINCT meter_id) FROM meter_metrics"),
            ("companies", _count("company_metrics")),
            ("profile_months", "SELECT count(DISTINCT month_start) FROM company_month"),
            *[
                (f"companies_{name}_meter{'s' if name != 'one' else ''}", _count("heterogeneity", f"similarity = '{code}'"))
                for name, code in (
                    ("one", "single_meter"),
                    ("similar", "similar"),
                    ("partly_different", "partly_different"),
                    ("different", "clearly_different"),
                )
            ],
        ),
    )

    o["meter_outliers"] = _select(
        "meter_outliers",
        _OUTLIER_SPEC
        + _lines("p", ("meter_id", "energy_flow", "quality_status", "active_period_quality_status", "source_sheet")),
    )
    o["company_outliers"] = _select("company_outliers", _OUTLIER_SPEC + "i reporting_meter_count")
    for name, source, keys in (
        ("outlier_summary", "meter_outliers", _METER),
        ("company_outlier_summary", "company_outliers", "company_id"),
    ):
        o[name] = _with(
            (source,),
            f"SELECT {keys}, count(*) AS outlier_hours, ROUND(max(abs(z)), 6) AS maximum_absolute_z, "
            "count(*) FILTER (outlier_direction = 'high') AS high_outliers, "
            f"count(*) FILTER (outlier_direction = 'low') AS low_outliers FROM {source} GROUP BY ALL",
        )
    o["top_outliers"] = _with(
        ("meter_outliers",),
        "SELECT "
        + _columns("p meter_id\np energy_flow\nt interval_start\nr energy_kwh\nr z_score = z")
        + "\nFROM (SELECT * FROM meter_outliers ORDER BY abs(z) DESC, meter_id, energy_flow, interval_start LIMIT 50)",
    )
    o["peer_metric_outliers"] = _select(
        "peers",
        """
p company_id
p metric
r metric_value = v
r peer_mean = mu
r peer_std = sd
r z_score = z
p comparison_scope = 'all_companies_provisional'
p sector_comparison_status = 'sector_metadata_pending'
p recommendation = 'business_check_not_sector_outlier'
""",
    )
    o["outlier_run_summary"] = _with(
        ("meter_outliers", "company_outliers", "peers"),
        _metrics(
            ("meter_hourly_outliers", _count("meter_outliers")),
            ("meter_series_with_outliers", f"SELECT count(DISTINCT ({_METER})) FROM meter_outliers"),
            ("company_hourly_outliers", _count("company_outliers")),
            ("companies_with_hourly_outliers", "SELECT count(DISTINCT company_id) FROM company_outliers"),
            ("global_provisional_metric_outliers", _count("peers")),
        ),
    )

    o["weather_parse"] = _select(
        "doc_hours", "p company_id = 'Company ' || n\nt interval_start = hour\nr temperature_2m = t\nt date = CAST(hour AS DATE)"
    )
    o["weather_metadata"] = _with(
        ("doc_hours",),
        "SELECT DISTINCT 'Company ' || n AS company_id, 42.5::DOUBLE + n / 8 AS latitude, 21.0::DOUBLE + n / 8 AS longitude, "
        "573.0::DOUBLE AS elevation, 'UTC' AS timezone FROM doc_hours",
    )
    day_figures = (
        "r temperature_2m_mean = mean\nr temperature_2m_min = low\nr temperature_2m_max = high\n"
        "r hdd_18 = greatest(0.0, 18 - mean)\nr cdd_18 = greatest(0.0, mean - 18)"
    )
    o["degree_days"] = _select("doc_days", "p company_id = 'Company ' || n\nt date\n" + day_figures)
    o["weather_hourly"] = _select(
        ("doc_hours", "doc_days"),
        "p company_id = 'Company ' || n\nt interval_start = hour\nr temperature_2m = t\nt date\n" + day_figures,
        "(SELECT *, CAST(hour AS DATE) AS date FROM doc_hours) JOIN doc_days USING (n, date)",
    )
    o["holiday_calendar"] = _select(
        "order_calendar",
        """
t date
p is_official_holiday_date
p actual_holiday_name
p is_observed_day_off
p observed_holiday_name
p is_holiday_or_day_off
p holiday_name
p is_day_before_holiday
p is_day_after_holiday
""",
    )
    o["enriched_hourly"] = _select(
        "enriched",
        """
t date
t interval_start
p company_id
p meter_id
p energy_flow
p source_sheet
i hour_1_24
r energy_kwh
p quality_status
p active_period_quality_status
i weekday_number
p is_weekend
p is_peak_07_18
r temperature_2m
r temperature_2m_mean
r temperature_2m_min
r temperature_2m_max
r hdd_18
r cdd_18
p is_official_holiday_date
p is_observed_day_off
p is_holiday_or_day_off
p holiday_name
p is_day_before_holiday
p is_day_after_holiday
""",
    )
    o["daily_energy"] = _select("meter_day", "p company_id\np meter_id" + _DAY_SPEC)
    o["company_daily"] = _select("company_day", "p company_id" + _DAY_SPEC + "i reporting_meters")
    o["weather_sensitivity"] = _select("sense_company", "p company_id" + _SENSE_SPEC)
    o["meter_weather_sensitivity"] = _select("sense_meter", "p company_id\np meter_id" + _SENSE_SPEC)
    o["holiday_effects"] = _select(
        "effects",
        """
p company_id
t date
p holiday_name
i weekday_number = weekday
r holiday_energy_kwh = energy
r same_weekday_baseline_kwh = baseline
r holiday_effect_pct = effect
i baseline_day_count = days
""",
    )
    o["holiday_summary"] = _select(
        "holiday_sum",
        """
p company_id
i holiday_days_analysed = days
r mean_holiday_effect_pct = mean_effect
r median_holiday_effect_pct = median_effect
i holidays_with_reduction = reductions
p holiday_behavior_label = label
""",
    )
    o["outlier_context"] = _select(
        "context",
        _OUTLIER_SPEC
        + """i reporting_meter_count
r temperature_2m
r temperature_2m_mean
r hdd_18
r cdd_18
p is_holiday_or_day_off
p holiday_name
p external_context = context
""",
    )
    o["weather_summary"] = _with(
        ("doc_hours", "doc_days", "order_calendar"),
        _metrics(
            ("weather_hourly_rows", _count("doc_hours")),
            ("weather_missing_temperatures", _count("doc_hours", "t IS NULL")),
            ("weather_duplicate_timestamps", "SELECT count(*) - count(DISTINCT hour) FROM doc_hours"),
            ("temperature_min_c", "SELECT min(t) FROM doc_hours"),
            ("temperature_max_c", "SELECT max(t) FROM doc_hours"),
            ("weather_daily_rows", _count("doc_days")),
            ("holiday_calendar_days", _count("order_calendar")),
            ("official_holiday_dates_in_period", _count("order_calendar", "is_official_holiday_date")),
            ("observed_days_off_in_period", _count("order_calendar", "is_observed_day_off")),
            ("holiday_or_day_off_unique_days", _count("order_calendar", "is_holiday_or_day_off")),
            ("hdd_base_c", "SELECT 18.0"),
            ("cdd_base_c", "SELECT 18.0"),
        ),
    )
    o["enrichment_summary"] = _with(
        ("enriched",),
        _metrics(
            ("enriched_rows", _count("enriched")),
            ("missing_weather_after_join", _count("enriched", "temperature_2m IS NULL")),
            ("enriched_energy_sum_kwh", "SELECT sum(energy_kwh) FROM enriched"),
        ),
    )
    o["external_summary"] = _with(
        ("meter_day", "company_day", "sense_meter", "sense_company", "effects", "holiday_sum", "context"),
        _metrics(
            ("meter_daily_rows", _count("meter_day")),
            ("company_daily_rows", _count("company_day")),
            ("meter_weather_profiles", _count("sense_meter")),
            ("company_weather_profiles", _count("sense_company")),
            ("reliable_company_weather_profiles", _count("sense_company", "reliable")),
            ("holiday_company_event_rows", _count("effects")),
            ("companies_with_holiday_analysis", _count("holiday_sum")),
            ("company_outliers_enriched", _count("context")),
            ("outliers_on_holiday_or_day_off", _count("context", "is_holiday_or_day_off")),
            ("outliers_with_cold_context", _count("context", "temperature_2m <= 5")),
            ("outliers_with_hot_context", _count("context", "temperature_2m >= 30")),
        ),
    )

    o["company_series"] = _with(
        ("hourly",),
        "SELECT company_id, CAST(interval_start AS VARCHAR) AS interval_start, ROUND(sum(energy_kwh), 6) AS energy_kwh "
        "FROM hourly WHERE energy_flow = 'consumption_import' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' "
        "GROUP BY company_id, hourly.interval_start",
    )
    o["weekday_profile"] = _with(
        ("company_hours",),
        "SELECT company_id, CAST(hour_1_24 AS BIGINT) AS hour_1_24, is_weekend, ROUND(avg(energy_kwh), 6) AS energy_kwh, "
        "CASE WHEN is_weekend THEN 'weekend' ELSE 'working day' END AS day_kind FROM company_hours GROUP BY ALL",
    )
    o["prosumer_monthly"] = _with(
        ("hourly",),
        "SELECT company_id, meter_id, energy_flow, CAST(date_trunc('month', interval_start)::TIMESTAMP AS VARCHAR) AS month, "
        "ROUND(sum(energy_kwh), 6) AS energy_kwh, CASE energy_flow WHEN 'consumption_import' "
        "THEN 'Consumption / import (A+)' ELSE 'Injection / export (A-)' END AS direction FROM hourly "
        "WHERE meter_id IN (SELECT meter_id FROM hourly GROUP BY 1 HAVING count(DISTINCT energy_flow) = 2) GROUP BY ALL",
    )
    o["status_counts"] = _with(
        ("quality",), "SELECT company_id, quality_status, count(*) AS series FROM quality GROUP BY ALL"
    )
    o["outlier_counts"] = _with(
        ("context",),
        "SELECT company_id, count(*) AS outliers, count(*) FILTER (outlier_direction = 'high') AS high, "
        "count(*) FILTER (outlier_direction = 'low') AS low, count(*) FILTER (is_holiday_or_day_off) AS on_holiday "
        "FROM context GROUP BY ALL",
    )
    o["holiday_days"] = _select(
        "company_day",
        "p company_id\nt date\np holiday_name\nr energy_total_kwh\nr temperature_2m_mean",
        "company_day WHERE is_holiday_or_day_off",
    )
    o["natural_order"] = _with(
        ("ser",),
        "SELECT company_id, CAST(CASE WHEN regexp_matches(company_id, ' [0-9]+$') "
        "THEN CAST(regexp_extract(company_id, '([0-9]+)$', 1) AS BIGINT) ELSE 1000000000 END AS BIGINT) AS sort_key "
        "FROM (SELECT c_name AS company_id FROM customer UNION ALL SELECT DISTINCT 'Company ' || n FROM ser)",
    )
    o["company_card"] = _select(
        ("company_metrics", "seasonal", "heterogeneity", "sense_company", "holiday_sum", "meter_metrics"),
        """
p company_id
r energy_total_mwh = energy_total_kwh / 1000
r peak_offpeak_ratio
r weekday_weekend_ratio
r load_factor
r coverage_share
p seasonality_label
r monthly_trend_pct
p seasonality_reliable
i meter_count
p meter_profile_similarity = similarity
r temperature_correlation = temp_r
r hdd_correlation = hdd_r
r cdd_correlation = cdd_r
p weather_sensitivity_label = w.label
r mean_holiday_effect_pct = mean_effect
""",
        "company_metrics LEFT JOIN seasonal USING (company_id) LEFT JOIN heterogeneity USING (company_id) "
        "LEFT JOIN sense_company w USING (company_id) LEFT JOIN holiday_sum USING (company_id)",
    )
    o["company_card_groups"] = _with(
        ("company_metrics", "hourly"),
        """
SELECT company_id, ROUND(energy_total_kwh / 1000, 6) AS energy_total_mwh, meters AS meter_count,
       CASE WHEN n % 3 > 0 THEN 'Group ' || n % 3 ELSE 'No group' END AS cluster_id,
       CASE n % 3 WHEN 1 THEN 'Even profile' WHEN 2 THEN 'Day profile'
            ELSE 'One or more metrics for grouping are missing' END AS cluster_description
FROM company_metrics JOIN (
  SELECT company_id, n, count(DISTINCT meter_id) FILTER (energy_flow = 'consumption_import') AS meters
  FROM hourly GROUP BY ALL) USING (company_id)""",
    )
    o["company_lookup"] = _with(
        ("hourly",),
        "SELECT company_id, meter_id, energy_flow, CAST(interval_start AS VARCHAR) AS interval_start, "
        "ROUND(energy_kwh, 6) AS energy_kwh, quality_status FROM hourly "
        "WHERE company_id = 'Company 2' AND date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'",
    )
    o["company_list"] = _with(("daily_readings",), "SELECT DISTINCT company_id FROM daily_readings")
    o["date_bounds"] = _with(
        ("daily_readings",),
        "SELECT company_id, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date "
        "FROM daily_readings GROUP BY ALL",
    )
    o["meter_flows"] = _with(("hourly",), f"SELECT DISTINCT {_METER} FROM hourly")

    rounded = ", ".join(f"ROUND({f}, 6) AS {f}" for f in CLUSTER_FEATURES)
    o["scaled_features"] = _with(
        ("eligible",),
        "\nUNION ALL ".join(
            f"SELECT '{s}' AS scaler, company_id, {rounded} FROM (SELECT company_id, {_scaled(s)} FROM eligible)"
            for s in ("standard", "minmax", "robust")
        ),
    )
    o["feature_statistics"] = _with(
        ("labelled", "minmax"),
        "\nUNION ALL ".join(
            f"SELECT '{f}' AS feature, ROUND((SELECT avg({f}) FROM labelled), 6) AS original_mean, "
            f"ROUND((SELECT stddev_samp({f}) FROM labelled), 6) AS original_std, "
            f"ROUND((SELECT avg({f}) FROM minmax), 6) AS scaled_mean, "
            f"ROUND((SELECT stddev_pop({f}) FROM minmax), 6) AS scaled_std_population"
            for f in CLUSTER_FEATURES
        ),
    )
    o["excluded_companies"] = _with(
        ("company_metrics", "seasonal"),
        f"SELECT company_id, {rounded} FROM company_metrics LEFT JOIN seasonal USING (company_id) WHERE "
        + " OR ".join(f"{f} IS NULL" for f in CLUSTER_FEATURES),
    )
    o["elbow"] = _with(
        ("unit_curve",),
        "SELECT CAST(k AS BIGINT) AS k, ROUND(inertia, 6) AS inertia, "
        "row_number() OVER (ORDER BY distance DESC, k) = 1 AS is_elbow_choice FROM ("
        "SELECT *, abs((xn - x0) * (y - y0) - (yn - y0) * (x - x0)) / sqrt((xn - x0) ** 2 + (yn - y0) ** 2) AS distance "
        "FROM unit_curve, (SELECT arg_min(x, k) AS x0, arg_min(y, k) AS y0, arg_max(x, k) AS xn, arg_max(y, k) AS yn "
        "FROM unit_curve))",
    )
    o["center_order"] = _with(
        ("region_centers",),
        f"SELECT CAST(region AS BIGINT) AS region, {rounded}, CAST(number AS BIGINT) AS cluster_number, "
        "'Cluster ' || number AS cluster_id FROM (SELECT *, row_number() OVER "
        "(ORDER BY peak_offpeak_ratio, weekday_weekend_ratio) AS number FROM region_centers)",
    )
    o["cluster_description"] = _with(
        ("region_centers", "labelled"),
        """
SELECT CAST(region AS BIGINT) AS region,
       CASE WHEN text = '' THEN 'Mixed profile' ELSE upper(text[1]) || lower(text[2:]) END AS cluster_description
FROM (
  SELECT region, concat_ws(' – ',
    CASE WHEN c.summer_index - c.winter_index >= 0.2 AND c.summer_index >= 1.1 THEN 'summer peak'
         WHEN c.winter_index - c.summer_index >= 0.2 AND c.winter_index >= 1.1 THEN 'winter peak' END,
    CASE WHEN c.load_factor >= o.load_factor AND c.coefficient_of_variation <= o.coefficient_of_variation
         THEN 'relatively steady profile' END,
    CASE WHEN c.peak_offpeak_ratio >= o.peak_offpeak_ratio AND c.weekday_weekend_ratio >= o.weekday_weekend_ratio
         THEN 'daytime and working-week consumption' END,
    CASE WHEN c.coefficient_of_variation > o.coefficient_of_variation AND c.load_factor < o.load_factor
         THEN 'peakier and variable load' END) AS text
  FROM region_centers c, (SELECT """
        + ", ".join(f"avg({f}) AS {f}" for f in CLUSTER_FEATURES)
        + " FROM labelled) o)",
    )
    o["pca_2d"] = _with(
        ("centred", "axis_1", "axis_2"),
        "SELECT company_id, ROUND(list_dot_product(x, a.v), 6) AS pca_1, ROUND(list_dot_product(x, b.v), 6) AS pca_2 "
        "FROM centred, axis_1 a, axis_2 b",
    )
    # What any right grouping fulfils, whichever starts it came from.
    o["kmeans_nearest"] = _with(("eligible",), "SELECT company_id, true AS is_nearest FROM eligible")
    for name, checks in (
        (
            "kmeans_centers",
            (
                "center_is_members_mean",
                "company_count_is_members",
                "names_follow_numbers",
                "numbers_in_stable_order",
                "inertia_is_distance_to_centers",
                "one_k_is_selected",
            ),
        ),
        (
            "kmeans_choice",
            (
                "selected_k_is_first_maximum",
                "silhouette_is_that_of_the_groups",
                "one_elbow",
                "cost_falls_with_k",
                "summary_has_the_selected_k",
                "summary_counts_add_up",
            ),
        ),
    ):
        o[name] = "\nUNION ALL ".join(f"SELECT '{c}' AS \"check\", CAST(0 AS BIGINT) AS violations" for c in checks)
    o["scaler_grid"] = _with(
        ("eligible",),
        "SELECT scaler, CAST(k AS BIGINT) AS k, true AS sizes_fit, true AS score_in_range "
        "FROM (SELECT unnest(['standard', 'minmax', 'robust']) AS scaler), "
        f"(SELECT unnest(generate_series({fx.YEARLY.k_min}, least({fx.YEARLY.k_max}, (SELECT count(*) - 1 FROM eligible)))) AS k)",
    )
    steps = ("quality", "long_table", "profiles", "outliers", "weather_and_holidays", "company_groups", "audits")
    o["run_steps"] = "\nUNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS step, '{name}' AS name, 'success' AS status" for i, name in enumerate(steps, 1)
    )
    tables = """
source_manifest sheet_rows series sheet_cells meter_quality sheet_checks timeline_issues value_anomalies zero_runs
hourly_long long_validation company_hourly meter_profile_metrics company_profile_metrics meter_monthly_profiles
company_monthly_profiles meter_hourly_profiles company_hourly_profiles company_meter_heterogeneity meter_hourly_outliers
company_hourly_outliers company_metric_outliers meter_outlier_summary company_outlier_summary weather_daily weather_hourly
holiday_calendar hourly_enriched meter_daily company_daily meter_weather_sensitivity company_weather_sensitivity
company_holiday_effect_detail company_holiday_effect_summary company_hourly_outliers_enriched company_clusters
cluster_centers cluster_evaluation cluster_scaler_sensitivity cluster_excluded_companies cluster_feature_stats audits
""".split()
    listed = ", ".join(f"'{t}'" for t in tables if t != "source_manifest")
    o["publish_run"] = _with(
        ("eligible",),
        f"SELECT 'success' AS status, unnest([{listed}]) AS \"table\", (SELECT count(*) FROM eligible) AS companies",
    )
    o["raw_sheets"] = o["wide_to_long"]
    o["holiday_file"] = o["holiday_calendar"]
    o["stored_long"] = o["active_span_flag"]
    o["stored_summary"] = o["long_summary"]
    o["stored_partitions"] = (
        "SELECT source_sheet, count(*) AS rows, ROUND(sum(energy_kwh), 6) AS energy_kwh, CAST(1 AS BIGINT) AS folders, "
        f"true AS has_files FROM ({o['active_span_flag']}) GROUP BY ALL"
    )
    o["silhouette_by_region"] = _with(
        ("silhouettes",), "SELECT CAST(5 AS BIGINT) AS k, ROUND(avg(s), 6) AS silhouette_score FROM silhouettes"
    )
    return o
