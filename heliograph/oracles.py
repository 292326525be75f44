"""DuckDB SQL for the registered queries, written apart from the DataFrame code."""

from __future__ import annotations

# Words that carry no meaning in queries, written out here so that SQL doesn't take them from the engine.
STOP = (
    "a an and are as at be been but by can could do does for from had has have if in into is it its may more most no not of on or "
    "that the their then there these they this to was were what when which while who will with would"
)


def _panel(days: int = 14) -> str:
    of = lambda kind: f"sum(CASE WHEN event_type = '{kind}' THEN value::DECIMAL(18,4) END)::DOUBLE"
    n = lambda kind: f"nullif(count(CASE WHEN event_type = '{kind}' THEN value END), 0)"
    return f"""p0 AS (SELECT 1 AS system_id, date_trunc('hour', ts) AS ts, {of("view")} AS poa, {of("purchase")} AS ac, {of("signup")} AS dc,
  {of("error")} / {n("error")} / 10 AS module, 20.0::DOUBLE AS ambient, {of("click")} / {n("click")} / 100 AS wind FROM events GROUP BY 2),
p AS (SELECT *, ts::DATE AS on_day, (date_diff('day', (SELECT min(ts)::DATE FROM p0), ts::DATE) // {days})::INTEGER AS window_id FROM p0)"""


FAIMAN = "(coalesce(ambient, 25) + poa / (25 + 6.84 * greatest(coalesce(wind, 1), 0)))"
EXPECTED = """e AS (SELECT *, coalesce(module, coalesce(ambient, 25) + coalesce(poa, 0) / (25 + 6.84 * greatest(coalesce(wind, 1), 0))) AS cell FROM p),
x AS (SELECT *, greatest(100 * coalesce(poa, 0) / 1000 * (1 - 0.004 * (cell - 25)), 0) * 0.86 * 0.96 AS expected FROM e)"""


def _step_hours(keys: str) -> str:
    """The most frequent step, the smallest on ties."""
    return f"""st AS (SELECT {keys}, date_diff('second', lag(ts) OVER (PARTITION BY {keys} ORDER BY ts), ts) AS step FROM p),
sc AS (SELECT {keys}, step, count(*) AS c FROM st WHERE step IS NOT NULL GROUP BY ALL),
h AS (SELECT {keys}, arg_min(step, (-c) * 100000000 + step) / 3600.0 AS h FROM sc GROUP BY {keys})"""


def _pr(keys: str, days: int = 14) -> str:
    return f"""WITH {_panel(days)}, {_step_hours(keys)},
f AS (SELECT *, coalesce(poa >= 200, false) AS lit, coalesce(poa >= 200, false) AND ac IS NOT NULL AS used FROM p),
g AS (SELECT *, bool_or(used AND module IS NOT NULL) OVER (PARTITION BY {keys}) AS has FROM f),
c AS (SELECT *, CASE WHEN has THEN module ELSE {FAIMAN} END AS cell FROM g),
s AS (SELECT {keys}, sum(ac) FILTER (used) AS pw, sum(CASE WHEN used AND cell IS NOT NULL THEN ac / greatest(1 - 0.004 * (cell - 25), 0.3) END) AS pc, sum(poa) FILTER (used) AS gg,
  avg(cell) FILTER (used) AS cell, count(*) FILTER (used) AS samples_used, count(*) FILTER (lit AND ac IS NULL) AS samples_missing_power FROM c GROUP BY {keys})
SELECT {keys}, round(pw / nullif(100.0 * gg / 1000, 0), 6) AS pr, round(pc / nullif(100.0 * gg / 1000, 0), 6) AS pr_temperature_corrected, round(1 - pw / nullif(pc, 0), 6) AS temperature_loss_fraction,
  round(pw * coalesce(h, 0), 3) AS energy_kwh, round(gg * coalesce(h, 0) / 1000, 6) AS insolation_kwh_m2, round(cell, 4) AS mean_cell_temp_c,
  round(samples_used / nullif(samples_used + samples_missing_power, 0), 6) AS data_completeness, samples_used, samples_missing_power
FROM s LEFT JOIN h USING ({keys}) WHERE samples_used > 0"""


DAILY = """d AS (SELECT 1 AS system_id, l_shipdate::DATE AS day, year(l_shipdate)::INTEGER AS window_id, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS poa,
  sum((l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(6,4)))::DECIMAL(18,4))::DOUBLE AS ac FROM lineitem GROUP BY 1, 2, 3)"""
STRINGS = """s AS (SELECT 1 AS system_id, l_shipdate::DATE AS day, year(l_shipdate)::INTEGER AS window_id, (l_suppkey % 7 + 1)::INTEGER AS string_idx, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS current_a FROM lineitem GROUP BY 1, 2, 3, 4)"""
SHARES = f"""{STRINGS}, t AS (SELECT *, sum(current_a) OVER (PARTITION BY window_id, day) AS total FROM s),
m AS (SELECT window_id, median(total) AS middle FROM (SELECT DISTINCT window_id, day, total FROM t) GROUP BY 1),
sh AS (SELECT t.*, current_a / total AS share FROM t JOIN m USING (window_id) WHERE total > greatest(0.2 * middle, 1e-6))"""


def _change_point(source: str, keys: str, value: str) -> str:
    return f"""k AS (SELECT {keys}, day, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY {keys}) AS n, abs({value} - lag({value}) OVER w) AS step,
  avg({value}) OVER (PARTITION BY {keys} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, avg({value}) OVER (PARTITION BY {keys} ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY day)),
sca AS (SELECT {keys}, median(step) AS sc FROM k GROUP BY {keys}),
best AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(abs(a - b), 9) DESC, k) AS r FROM k WHERE k BETWEEN 2 AND n - 2 AND n >= 6)
SELECT {keys}, day AS onset_day, round(b, 4) AS level_before, round(a, 4) AS level_after, round(a - b, 4) AS absolute_change, k::BIGINT AS days_before, (n - k)::BIGINT AS days_after, sc AS day_to_day_scatter,
  round(CASE WHEN a = b THEN 0 WHEN sc <= 0 THEN 999 ELSE least(abs(a - b) / sc, 999) END, 6) AS change_over_scatter FROM best JOIN sca USING ({keys}) WHERE r = 1"""


def _islands(rows: str, keys: str, starts: str) -> str:
    return f"(SELECT *, sum(CASE WHEN {starts} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts) AS island FROM {rows})"


def _injected(change: str, before: str = "") -> str:
    return f"WITH {_panel()}{before}, i AS ({change}) SELECT ts::DATE AS day, round(sum(poa), 4) AS poa, round(sum(ac), 4) AS ac, round(sum(dc), 4) AS dc FROM i GROUP BY 1"


INSIDE = "(ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-20')"


def _scaled(factor: str, where: str = INSIDE, source: str = "p") -> str:
    return f"SELECT ts, poa, CASE WHEN {where} THEN ac * ({factor}) ELSE ac END AS ac, CASE WHEN {where} THEN dc * ({factor}) ELSE dc END AS dc FROM {source}"


QUALITY = f"""WITH {_panel()}, {_step_hours("system_id, window_id")},
s AS (SELECT system_id, window_id, count(*) AS actual_samples, date_diff('second', min(ts), max(ts)) AS span, count(*) FILTER (poa >= 200) AS lit_intervals, count(*) FILTER (poa >= 200 AND ac IS NULL) AS lit_intervals_without_power,
  count(*) FILTER (poa IS NULL) AS missing_poa, count(*) FILTER (ac IS NULL) AS missing_ac_power, count(*) FILTER (poa < 5 AND ac > 0.5) AS night_generation, count(*) FILTER (ac > 120) AS out_of_range FROM p GROUP BY 1, 2),
q AS (SELECT *, (floor(span / (h * 3600)) + 1)::BIGINT AS expected_samples FROM s LEFT JOIN h USING (system_id, window_id))
SELECT system_id, window_id, expected_samples, actual_samples, round(actual_samples / expected_samples, 6) AS coverage, lit_intervals, lit_intervals_without_power,
  round(1 - lit_intervals_without_power / nullif(lit_intervals, 0), 6) AS lit_interval_completeness, missing_poa, missing_ac_power, night_generation, out_of_range FROM q"""

BM25 = """WITH stop AS (SELECT unnest(string_split('{stop}', ' ')) AS word),
dt AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
dk AS (SELECT * FROM dt WHERE term NOT IN (SELECT word FROM stop)),
len AS (SELECT d.doc_id AS id, count(dk.term) AS raw, greatest(count(dk.term), 1) AS length FROM documents d LEFT JOIN dk ON dk.id = d.doc_id GROUP BY 1),
whole AS (SELECT count(*) AS n, CASE WHEN avg(raw) > 0 THEN avg(raw) ELSE 1 END AS mean FROM len),
q AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark),
qk AS (SELECT qid, term, count(*) AS qf FROM q WHERE term NOT IN (SELECT word FROM stop) GROUP BY 1, 2),
tf AS (SELECT id, term, count(*) AS tf FROM dk WHERE term IN (SELECT term FROM qk) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT qid, id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score
  FROM tf JOIN df USING (term) JOIN len USING (id) JOIN qk USING (term), whole GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc)
SELECT qid, id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10"""

CASES = "c AS (SELECT quality AS truth, (n_chars > 1500)::INTEGER AS predicted FROM labels JOIN documents USING (doc_id))"
DAY_SWEEPS = "(date_diff('day', DATE '2024-01-01', ts::DATE))"


def _sky(source: str) -> str:
    """CTEs that give the rows of ``source`` (with ``ts``) the sun's zenith and azimuth and the clear sky's ``sky``."""
    import math

    from heliograph.functions.solar import PEREZ, PEREZ_BINS, Site

    site = Site()
    lat, tilt = f"radians({site.latitude})", f"radians({site.tilt_deg})"
    f1, f2 = f"exp(-{site.altitude_m} / 8000)", f"exp(-{site.altitude_m} / 1250)"
    pressure = (1 - 0.0000225577 * site.altitude_m) ** 5.25588
    c = lambda k: f"([{', '.join(map(repr, PEREZ[k]))}]::DOUBLE[])[bin]"
    number = " + ".join(f"(clearness >= {b})::INTEGER" for b in PEREZ_BINS)
    return f"""u1 AS (SELECT *, epoch(ts)::DOUBLE AS s, epoch(ts)::DOUBLE / 86400 - 10957.5 AS n FROM {source}),
u2 AS (SELECT *, radians(357.528 + 0.9856003 * n) AS g, radians(23.439::DOUBLE - 0.0000004 * n) AS ob FROM u1),
u3 AS (SELECT *, radians(280.460 + 0.9856474 * n + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS lam FROM u2),
u4 AS (SELECT *, degrees(atan2(cos(ob) * sin(lam), cos(lam))) AS ra, asin(sin(ob) * sin(lam)) AS de FROM u3),
u5 AS (SELECT *, radians(15 * (6.697375 + 0.0657098242 * n + (s % 86400) / 3600) + {site.longitude} - ra) AS ha FROM u4),
u6 AS (SELECT *, degrees(asin(sin(de) * sin({lat}) + cos(de) * cos({lat}) * cos(ha))) AS el FROM u5),
u7 AS (SELECT *, 90 - (el + CASE WHEN el > -0.56 THEN 3.51561 * (0.1594 + 0.0196 * el + 0.00002 * el * el) / (1 + 0.505 * el + 0.0845 * el * el) ELSE 0 END) AS zen,
  degrees(atan2(-cos(de) * sin(ha), sin(de) * cos({lat}) - cos(de) * sin({lat}) * cos(ha))) AS az FROM u6),
u8 AS (SELECT *, radians(zen) AS z, greatest(cos(radians(zen)), 0) AS cz, ({list(site.turbidity)}::DOUBLE[])[month(ts)] AS tl, 2 * pi() * (dayofyear(ts) - 1) / 365 AS dd FROM u7),
u9 AS (SELECT *, 1366.1 * (1.00011 + 0.034221 * cos(dd) + 0.00128 * sin(dd) + 0.000719 * cos(2 * dd) + 0.000077 * sin(2 * dd)) AS i0,
  CASE WHEN zen < 90 THEN 1 / (cz + 0.50572 * pow(96.07995 - zen, -1.6364)) END AS air FROM u8),
v1 AS (SELECT *, {0.0000509 * site.altitude_m + 0.868} * i0 * cz * exp(-{0.0000392 * site.altitude_m + 0.0387} * air * {pressure} * ({f1} + {f2} * (tl - 1))) AS ghi FROM u9),
v2 AS (SELECT *, CASE WHEN ghi IS NOT NULL THEN least((0.664 + 0.163 / {f1}) * exp(-0.09 * air * {pressure} * (tl - 1)) * i0, greatest(ghi * (1 - (0.1 - 0.2 * exp(-tl)) / (0.1 + 0.882 / {f1})) / nullif(cz, 0), 0)) END AS dni FROM v1),
v3 AS (SELECT *, ghi - dni * cz AS dhi FROM v2),
v4 AS (SELECT *, ((dhi + dni) / nullif(dhi, 0) + 1.041 * z * z * z) / (1 + 1.041 * z * z * z) AS clearness, dhi * air / i0 AS delta, greatest(cos(z) * cos({tilt}) + sin(z) * sin({tilt}) * cos(radians(az - {site.azimuth_deg})), 0) AS aoi FROM v3),
v5 AS (SELECT *, (1 + {number})::INTEGER AS bin FROM v4),
v6 AS (SELECT *, greatest({c("f11")} + {c("f12")} * delta + {c("f13")} * z, 0) AS near, {c("f21")} + {c("f22")} * delta + {c("f23")} * z AS horizon FROM v5),
v7 AS (SELECT *, dhi * (0.5 * (1 - near) * (1 + cos({tilt})) + near * aoi / greatest(cz, {math.cos(math.radians(85))}) + horizon * sin({tilt})) AS diffuse FROM v6),
v AS (SELECT *, coalesce(dni * aoi + CASE WHEN diffuse IS NOT NULL THEN greatest(diffuse, 0) END + ghi * {site.albedo} * (1 - cos({tilt})) / 2, 0) AS sky FROM v7)"""


def _history(measure: str, value: str) -> str:
    """``measure`` of the windows of 60 days beside that of the record before each; {0} is the source, {1} its prefix."""
    strings = "s0 AS (SELECT 1 AS system_id, l_shipdate::DATE AS day, (l_suppkey % 7 + 1)::INTEGER AS string_idx, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS current_a FROM lineitem GROUP BY 1, 2, 3)"
    return f"""WITH {strings}, w0 AS (SELECT min(day) AS lo, max(day) AS hi FROM s0),
w AS (SELECT k::INTEGER AS window_id, lo + (60 * k)::INTEGER AS start_day, lo + (60 * k + 59)::INTEGER AS end_day FROM w0, unnest(range(0, date_diff('day', lo, hi) // 60 + 1)) AS t(k)),
now AS (SELECT window_id, s0.* FROM s0 JOIN w ON day BETWEEN start_day AND end_day), all_past AS (SELECT window_id, s0.* FROM s0 JOIN w ON day < start_day),
ok AS (SELECT p.window_id FROM (SELECT window_id, count(DISTINCT day) AS n FROM all_past GROUP BY 1) p JOIN (SELECT window_id, count(DISTINCT day) AS n FROM now GROUP BY 1) i USING (window_id) WHERE p.n >= i.n AND p.n >= 100),
past AS (SELECT * FROM all_past WHERE window_id IN (SELECT window_id FROM ok)),
{measure.format("now", "n")}, {measure.format("past", "p")}
SELECT nr.system_id, nr.window_id, nr.string_idx, nr.{value}, pr.{value} AS baseline, round(nr.{value} - pr.{value}, 6) AS change FROM nr LEFT JOIN pr USING (window_id, string_idx)"""


SHARE_MEASURE = """{1}t AS (SELECT *, sum(current_a) OVER (PARTITION BY window_id, day) AS total FROM {0}),
{1}m AS (SELECT window_id, median(total) AS middle FROM (SELECT DISTINCT window_id, day, total FROM {1}t) GROUP BY 1),
{1}x AS (SELECT system_id, window_id, string_idx, avg(current_a / total) AS share, count(*) OVER (PARTITION BY window_id) AS strings FROM {1}t JOIN {1}m USING (window_id) WHERE total > greatest(0.2 * middle, 1e-6) GROUP BY 1, 2, 3),
{1}r AS (SELECT system_id, window_id, string_idx, round(share, 6) AS mean_share FROM {1}x WHERE strings >= 2)"""
LEVEL_MEASURE = """{1}m AS (SELECT window_id, day, median(current_a) AS reference FROM {0} GROUP BY 1, 2),
{1}r AS (SELECT system_id, window_id, string_idx, round(CASE WHEN min(current_a) = max(current_a) THEN 0 ELSE regr_slope(current_a, reference) END, 6) AS level FROM {0} JOIN {1}m USING (window_id, day) GROUP BY 1, 2, 3)"""


def _judged(longest: int) -> str:
    side = lambda c: f"CASE {c} % 3 WHEN 0 THEN 'fault' WHEN 1 THEN 'by_design' ELSE 'recoverable' END"
    return f"""(SELECT *, (NOT truth_settled AND NOT settled) AS neither, (truth_settled AND settled AND category = truth_category) OR (NOT truth_settled AND NOT settled) AS category_correct,
  (truth_settled AND settled AND cause = truth_cause) OR (NOT truth_settled AND NOT settled) AS cause_correct, truth_category = 'by_design' AS is_lookalike, settled AND category IN ('fault', 'recoverable') AS alarm
  FROM (SELECT doc_id AS case_id, doc_id % 2 AS split, {side("doc_id")} AS truth_category, quality::VARCHAR AS truth_cause, toxic = 0 AS truth_settled, {side(f"(n_chars + {longest})")} AS category,
    (n_chars > {longest})::INTEGER::VARCHAR AS cause, n_chars % 7 <> 0 AS settled FROM labels JOIN (SELECT doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1) USING (doc_id)))"""


def _channels() -> str:
    raw = "poa AS irradiance_poa_o_1, poa / 100 AS irradiance_poa_o_2, ambient AS temperature_ambient_o_1, module AS temperature_module_o_1, 292.0::DOUBLE AS wind_speed_o_1, wind AS wind_speed_o_2, ac AS ac_power_inv_1, dc AS dc_power_inv_1, NULL::DOUBLE AS dc_power_inv_2"
    pairs = [("poa_wm2", "irradiance_poa_o_1", 300, 1500), ("poa_wm2", "irradiance_poa_o_2", 300, 1500), ("temp_ambient_c", "temperature_ambient_o_1", 5, 60), ("temp_module_c", "temperature_module_o_1", 20, 95), ("wind_speed_ms", "wind_speed_o_1", 1, 45),
             ("wind_speed_ms", "wind_speed_o_2", 1, 45), ("ac_power_kw", "ac_power_inv_1", 1, 100000), ("dc_power_kw", "dc_power_inv_1", 1, 100000), ("dc_power_kw", "dc_power_inv_2", 1, 100000)]
    one = " UNION ALL ".join(f"SELECT '{q}' AS quantity, '{c}' AS \"column\", count({c}) AS non_null, max({c})::DOUBLE AS highest, {lo} AS low, {hi} AS high FROM raw" for q, c, lo, hi in pairs)
    return f"""WITH {_panel()}, raw AS (SELECT {raw} FROM p), c AS ({one}),
j AS (SELECT *, CASE WHEN non_null = 0 THEN 'no values' WHEN highest < low THEN 'wrong units: maximum below the band' WHEN highest > high THEN 'wrong units: maximum above the band' END AS reason FROM c)
SELECT quantity, "column", non_null, round(highest, 6) AS highest, reason, reason IS NULL AND row_number() OVER (PARTITION BY quantity ORDER BY reason IS NOT NULL, non_null DESC, "column") = 1 AS chosen FROM j"""


def _sun_sql() -> dict[str, str]:
    kw = "system_id, window_id"
    return {
        "night_offset": f"""WITH {_panel()}, {_sky("p")} SELECT {kw}, count(*) AS night_intervals, round(median(poa), 4) AS median_night_irradiance_wm2, round(max(poa), 4) AS max_night_irradiance_wm2, round(median(ac), 4) AS median_night_ac_kw,
  round(max(ac), 4) AS max_night_ac_kw, count(*) FILTER (ac > 1.0) AS night_generation_intervals FROM v WHERE zen > 100 GROUP BY {kw}""",
        "clearsky_consistency": f"""WITH {_panel()}, {_sky("p")}, d AS (SELECT {kw}, on_day, median(poa / sky) AS ratio, count(*) AS samples FROM v WHERE sky > 300 AND poa IS NOT NULL GROUP BY ALL),
hh AS (SELECT *, row_number() OVER (PARTITION BY {kw} ORDER BY on_day) <= count(*) OVER (PARTITION BY {kw}) // 2 AS first FROM d),
q AS (SELECT {kw}, quantile_cont(ratio, 0.9) AS c, coalesce(quantile_cont(ratio, 0.9) FILTER (first), quantile_cont(ratio, 0.9)) AS a, quantile_cont(ratio, 0.9) FILTER (NOT first) AS b, count(*) AS days_compared, sum(samples)::BIGINT AS samples_used,
  count(*) FILTER (first AND ratio >= 0.85) AS clear_days_first_half, count(*) FILTER (NOT first AND ratio >= 0.85) AS clear_days_second_half FROM hh GROUP BY {kw})
SELECT {kw}, round(c, 6) AS clearest_day_ratio, round(greatest(1 - c, 0), 6) AS shortfall_vs_clearsky, round(a, 6) AS ratio_first_half, round(b, 6) AS ratio_second_half, round(b - a, 6) AS ratio_change_across_window,
  round((b - a) / days_compared, 6) AS ratio_change_per_day, days_compared, samples_used, clear_days_first_half, clear_days_second_half FROM q""",
        "utc_offset_curve": f"""WITH {_panel()}, o AS (SELECT system_id, poa, half, ts - to_seconds(half * 1800) AS ts FROM p, unnest(range(-24, 29)) AS t(half) WHERE poa IS NOT NULL), {_sky("o")}
SELECT system_id, half / 2 AS offset_hours, round(covar_pop(poa, sky) / (stddev_pop(poa) * stddev_pop(sky)), 6) AS correlation FROM v GROUP BY system_id, half""",
        "flatline": f"""WITH {_panel()}, l AS (SELECT {kw}, ts, unnest(['poa_wm2', 'temp_module_c', 'wind_speed_ms']) AS channel, unnest([CASE WHEN poa > 50 THEN poa END, round(module, -1), round(wind, 0)]) AS value FROM p),
f AS (SELECT *, coalesce(value = lag(value) OVER (PARTITION BY {kw}, channel ORDER BY ts), false) AS same FROM l), i AS (SELECT * FROM {_islands("f", kw + ", channel", "NOT same")}),
r AS (SELECT *, count(value) OVER (PARTITION BY {kw}, channel, island) AS length FROM i) SELECT {kw}, channel, round(count(*) FILTER (length >= 3) / count(*), 6) AS flat_share, max(length) AS longest_run FROM r GROUP BY ALL""",
        "string_balance_history": _history(SHARE_MEASURE, "mean_share"),
        "string_profiles_history": _history(LEVEL_MEASURE, "level"),
        "channel_resolution": _channels(),
        "ingest_normalised": """WITH r AS (SELECT date_trunc('minute', ts) AS t, value, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY event_id) AS k FROM events),
m AS (SELECT floor(epoch(t) / 900)::BIGINT * 900 AS s, CASE WHEN value - 30 >= -20 THEN greatest(value - 30, 0) END AS poa, CASE WHEN value - 10 >= -5 THEN value - 10 END AS ac FROM r WHERE k = 1),
b AS (SELECT s, avg(poa) AS poa, avg(ac) AS ac FROM m GROUP BY 1), spine AS (SELECT unnest(range((SELECT min(s) FROM b), (SELECT max(s) FROM b) + 1, 900)) AS s)
SELECT 1 AS system_id, s + 18000 AS second, round(poa, 6) AS poa_wm2, round(ac, 6) AS ac_power_kw FROM spine LEFT JOIN b USING (s)""",
        "case_report": f"""SELECT split, count(*) AS cases, round(count(*) FILTER (category_correct) / count(*), 4) AS category_accuracy, round(count(*) FILTER (cause_correct) / count(*), 4) AS cause_accuracy,
  round(count(*) FILTER (is_lookalike AND alarm) / nullif(count(*) FILTER (is_lookalike), 0), 4) AS false_alarm_rate, count(*) FILTER (is_lookalike) AS look_alike_cases,
  round(count(*) FILTER (truth_category = 'fault' AND NOT alarm) / nullif(count(*) FILTER (truth_category = 'fault'), 0), 4) AS missed_fault_rate, round(count(*) FILTER (neither) / nullif(count(*) FILTER (NOT truth_settled), 0), 4) AS correct_abstention_rate,
  count(*) FILTER (NOT truth_settled) AS unresolvable_cases, count(*) FILTER (truth_settled AND NOT settled) AS wrong_abstentions FROM {_judged(1500)} GROUP BY split""",
        "disagreements": f"""SELECT a.case_id, a.cause AS cause_a, a.cause_correct AS correct_a, b.cause AS cause_b, b.cause_correct AS correct_b,
  CASE WHEN a.cause_correct = b.cause_correct THEN 'neither' WHEN a.cause_correct THEN 'a' ELSE 'b' END AS winner FROM {_judged(1500)} a JOIN {_judged(400)} b USING (case_id) WHERE a.cause <> b.cause""",
        "repeated_runs": """WITH r AS (SELECT event_type, user_id % 5 AS run, sum(value::DECIMAL(18,4))::DOUBLE / count(*) AS score FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS runs, round(avg(score), 4) AS mean, round(coalesce(stddev_samp(score), 0), 4) AS deviation FROM r GROUP BY 1""",
        "trace_profile": """WITH b AS (SELECT conv_id % 2 AS part, role AS node, count(*) AS calls, sum(length(coalesce(text, '')))::BIGINT AS ms FROM conversations GROUP BY 1, 2)
SELECT part, node, calls, round(ms / 1000, 3) AS seconds, round(ms / sum(ms) OVER (PARTITION BY part), 4) AS share, round(calls * 0.001::DOUBLE, 6) AS cost_usd, calls AS tokens FROM b""",
    }


def _sql() -> dict[str, str]:
    kw = "system_id, window_id"
    lag_ac = f"abs(ac - lag(ac) OVER (PARTITION BY {kw} ORDER BY ts))"
    return {
        "pr_window": _pr(kw),
        "pr_daily": _pr("system_id, on_day"),
        "expected_output": f"""WITH {_panel()}, {EXPECTED}, dd AS (SELECT {kw}, on_day, sum(expected) AS e, sum(coalesce(ac, 0)) AS m FROM x WHERE expected >= 1 GROUP BY ALL),
hh AS (SELECT *, row_number() OVER (PARTITION BY {kw} ORDER BY on_day) <= count(*) OVER (PARTITION BY {kw}) // 2 AS first FROM dd)
SELECT {kw}, round(sum(e), 3) AS expected_kwh, round(sum(m), 3) AS measured_kwh, round(1 - sum(m) / sum(e), 6) AS deficit_fraction, round(1 - sum(m) FILTER (first) / sum(e) FILTER (first), 6) AS deficit_first_half,
  round(1 - sum(m) FILTER (NOT first) / sum(e) FILTER (NOT first), 6) AS deficit_second_half, arg_min(on_day, m - e) AS worst_day, count(*) AS days_compared FROM hh GROUP BY {kw}""",
        "time_of_day_profile": f"""WITH {_panel()}, {EXPECTED}, hr AS (SELECT {kw}, hour(ts)::INTEGER AS hour, sum(coalesce(ac, 0)) / sum(expected) AS ratio FROM x WHERE expected >= 5 GROUP BY ALL)
SELECT {kw}, hour, round(ratio, 6) AS ratio, round(ratio / nullif(median(ratio) OVER (PARTITION BY {kw}), 0), 6) AS shape FROM hr""",
        "dc_to_ac_conversion": f"""WITH {_panel()}, l AS (SELECT *, ac / dc AS ratio FROM p WHERE dc >= 5 AND ac IS NOT NULL), dd AS (SELECT {kw}, on_day, median(ratio) AS daily FROM l GROUP BY ALL),
hh AS (SELECT *, row_number() OVER (PARTITION BY {kw} ORDER BY on_day) <= count(*) OVER (PARTITION BY {kw}) // 2 AS first FROM dd),
hv AS (SELECT {kw}, round(median(daily) FILTER (first), 6) AS conversion_first_half, round(median(daily) FILTER (NOT first), 6) AS conversion_second_half, count(*) AS days_compared FROM hh GROUP BY {kw})
SELECT {kw}, round(median(ratio), 6) AS median_conversion, round(quantile_cont(ratio, 0.05), 6) AS conversion_5th_percentile, round(quantile_cont(ratio, 0.95), 6) AS conversion_95th_percentile, count(*) AS intervals_scored,
  any_value(conversion_first_half) AS conversion_first_half, any_value(conversion_second_half) AS conversion_second_half, any_value(days_compared) AS days_compared FROM l JOIN hv USING ({kw}) GROUP BY {kw}""",
        "temperature_sensor": f"""WITH {_panel()}, b AS (SELECT *, module - {FAIMAN} AS off FROM p WHERE poa >= 300 AND module IS NOT NULL)
SELECT {kw}, round(median(off), 4) AS median_offset_from_model_c, round(quantile_cont(off, 0.05), 4) AS offset_5th_percentile_c, round(quantile_cont(off, 0.95), 4) AS offset_95th_percentile_c,
  round(median(module - ambient), 4) AS median_rise_above_ambient_c, count(*) AS intervals_scored FROM b GROUP BY {kw} HAVING count(*) >= 20""",
        "ac_ceiling": f"""WITH {_panel()}, a AS (SELECT *, max(ac) OVER (PARTITION BY {kw}) AS peak FROM p WHERE ac IS NOT NULL), dl AS (SELECT * FROM a WHERE peak > 0 AND ac > 0.15 * peak),
fl AS (SELECT *, ac >= 0.98 * peak AND coalesce({lag_ac} <= 0.05 * peak, false) AS flat FROM dl), ru AS {_islands("fl", kw, "NOT flat")},
le AS (SELECT *, count(*) FILTER (flat) OVER (PARTITION BY {kw}, island) AS length FROM ru)
SELECT {kw}, round(max(peak), 4) AS peak_ac_kw, round(count(*) FILTER (flat AND length >= 1) / count(*), 6) AS flat_ceiling_share, max(length) AS longest_flat_run_intervals,
  count(DISTINCT CASE WHEN flat AND length >= 1 THEN on_day END) AS days_with_a_plateau, count(*) AS generating_intervals FROM le GROUP BY {kw}""",
        "stuck_channels": f"""WITH {_panel()}, lo AS (SELECT {kw}, ts, 'poa_wm2' AS channel, poa AS v FROM p WHERE poa >= 50 UNION ALL SELECT {kw}, ts, 'temp_module_c', module FROM p WHERE poa >= 50 UNION ALL SELECT {kw}, ts, 'wind_speed_ms', wind FROM p WHERE poa >= 50),
sa AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY {kw}, channel ORDER BY ts)) < 0.5, false) AS same FROM lo WHERE v IS NOT NULL), ru AS {_islands("sa", kw + ", channel", "NOT same")},
le AS (SELECT *, count(*) FILTER (same) OVER (PARTITION BY {kw}, channel, island) AS length FROM ru)
SELECT {kw}, channel, round(count(*) FILTER (length >= 1) / count(*), 6) AS stuck_share, count(*) AS samples FROM le GROUP BY ALL""",
        "data_quality": QUALITY,
        "daily_completeness": f"WITH {_panel()} SELECT system_id, on_day AS day, round(count(ac) / count(*), 6) AS completeness, count(ac) = 0 AS missing FROM p GROUP BY ALL",
        "onset_changepoint": f"WITH {DAILY}, {_change_point('d', kw, 'ac')}",
        "performance_trend": f"""WITH {DAILY}, y AS (SELECT {kw}, day, ac / nullif(poa, 0) AS y FROM d), z AS (SELECT *, (row_number() OVER w - 1)::DOUBLE AS x, y - lag(y) OVER w AS step FROM y WHERE y IS NOT NULL WINDOW w AS (PARTITION BY {kw} ORDER BY day))
SELECT {kw}, round(regr_slope(y, x), 9) AS slope_per_day, round(regr_slope(y, x) * count(*), 6) AS change_across_window, round(CASE WHEN min(y) = max(y) THEN 0 ELSE regr_r2(y, x) END, 6) AS r_squared, count(*) AS days,
  count(*) FILTER (round(step, 9) >= 0.01) AS recovery_count, round(max(step), 6) AS largest_step FROM z GROUP BY {kw} HAVING count(*) >= 5""",
        "soiling_recovery": f"""WITH {DAILY}, y AS (SELECT {kw}, day, day AS ts, poa, ac / nullif(poa, 0) AS pr FROM d), mi AS (SELECT {kw}, median(poa) AS middle FROM y GROUP BY {kw} HAVING count(*) >= 10),
r AS (SELECT y.*, poa < middle * 0.7 AS wet FROM y JOIN mi USING ({kw})), ar AS (SELECT *, avg(pr) OVER (PARTITION BY {kw} ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) - avg(pr) OVER (PARTITION BY {kw} ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS jump FROM r),
ru AS (SELECT *, row_number() OVER (PARTITION BY {kw}, island ORDER BY day)::DOUBLE AS x FROM {_islands("ar", kw, "wet")} WHERE NOT wet),
sl AS (SELECT {kw}, island, regr_slope(pr, x) AS slope FROM ru GROUP BY ALL HAVING count(*) >= 3),
dr AS (SELECT {kw}, count(*) AS dry_stretches, round(avg(slope), 8) AS mean_dry_slope_per_day, round(min(slope), 8) AS steepest_dry_slope_per_day FROM sl GROUP BY {kw}),
we AS (SELECT {kw}, count(*) FILTER (wet) AS candidate_wash_days, round(avg(jump) FILTER (wet), 8) AS mean_change_after_a_wash, count(*) AS days_scored FROM ar GROUP BY {kw})
SELECT {kw}, candidate_wash_days, mean_change_after_a_wash, days_scored, coalesce(dry_stretches, 0) AS dry_stretches, mean_dry_slope_per_day, steepest_dry_slope_per_day FROM we LEFT JOIN dr USING ({kw})""",
        "string_balance": f"""WITH {SHARES}, a AS (SELECT {kw}, string_idx, avg(share) AS share FROM sh GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY {kw}) AS n FROM a)
SELECT {kw}, string_idx, round(share, 6) AS mean_share, round(1 / n, 6) AS even_share, round(1 - share * n, 6) AS below_even, round(1 - share * n, 9) > 0.10 AS over_10pct_below, round(1 - share * n, 9) > 0.25 AS over_25pct_below FROM n WHERE n >= 2""",
        "string_profiles": f"""WITH {STRINGS}, m AS (SELECT {kw}, day, median(current_a) AS ref FROM s GROUP BY ALL)
SELECT {kw}, string_idx, round(CASE WHEN min(current_a) = max(current_a) THEN 0 ELSE corr(current_a, ref) END, 6) AS shape_match, round(CASE WHEN min(current_a) = max(current_a) THEN 0 ELSE regr_slope(current_a, ref) END, 6) AS level, count(*) AS samples
FROM s JOIN m USING ({kw}, day) GROUP BY ALL""",
        "string_onset": f"""WITH {SHARES}, cn AS (SELECT window_id, count(DISTINCT string_idx) AS strings FROM sh GROUP BY 1), wh AS (SELECT * FROM (SELECT sh.*, count(*) OVER (PARTITION BY window_id, day) AS here FROM sh) JOIN cn USING (window_id) WHERE here = strings AND strings >= 2),
{_change_point('wh', kw + ', string_idx', 'share')}""",
        "trailing_baseline": f"""WITH {DAILY}, b AS (SELECT min(day) AS lo, max(day) AS hi FROM d), w AS (SELECT unnest(range(0, date_diff('day', lo, hi) // 60 + 1))::INTEGER AS window_id, lo FROM b),
v AS (SELECT window_id, (lo + (window_id * 60)::INTEGER)::DATE AS a, (lo + (window_id * 60 + 59)::INTEGER)::DATE AS z FROM w),
j AS (SELECT v.window_id, d.day >= a AS now, ac, poa, CASE WHEN d.day < a AND poa > 0 THEN ac / poa END AS daily FROM d JOIN v ON d.day BETWEEN a - 30 AND z),
o AS (SELECT window_id, sum(ac) FILTER (now) / nullif(sum(poa) FILTER (now), 0) AS n, sum(ac) FILTER (NOT now) / nullif(sum(poa) FILTER (NOT now), 0) AS p, count(daily) AS c, stddev_samp(daily) AS s FROM j GROUP BY 1)
SELECT 1 AS system_id, window_id, round(n, 6) AS ratio_window, round(p, 6) AS ratio_baseline, round(n - p, 6) AS change, round(CASE WHEN c > 2 THEN s ELSE 0 END, 6) AS baseline_day_to_day_spread, c AS baseline_days_used FROM o WHERE n IS NOT NULL AND p IS NOT NULL""",
        "weather_context": f"""WITH {DAILY}, b AS (SELECT min(day) AS lo, max(day) AS hi FROM d), w AS (SELECT unnest(range(0, date_diff('day', lo, hi) // 60 + 1))::INTEGER AS window_id, lo FROM b),
v AS (SELECT window_id, (lo + (window_id * 60)::INTEGER)::DATE AS a, (lo + (window_id * 60 + 59)::INTEGER)::DATE AS z FROM w),
s AS (SELECT v.window_id, a, z, min(dayofyear(day)) AS l, max(dayofyear(day)) AS h, avg(poa) AS mean, count(*) AS n FROM d JOIN v ON day BETWEEN a AND z GROUP BY ALL)
SELECT 1 AS system_id, s.window_id, round(any_value(mean), 3) AS mean_daily_insolation, round(avg(poa), 3) AS seasonal_norm, round(any_value(mean) / avg(poa), 6) AS relative_to_norm, any_value(n) AS days_in_window, count(*) AS seasonal_days_compared
FROM s JOIN d ON dayofyear(day) BETWEEN l AND h AND NOT day BETWEEN a AND z GROUP BY s.window_id""",
        "inject_outage": _injected(_scaled("1 - 0.8 * (1.0 / 7)")),
        "inject_shading": _injected(_scaled("1 - 0.5 * 2 / 7", INSIDE + " AND hour(ts) >= 6 AND hour(ts) < 10")),
        "inject_soiling": _injected(
            _scaled("1 - coalesce(loss, 0)", source="(SELECT p.*, loss FROM p LEFT JOIN ls ON p.on_day = ls.on_day)"),
            f""", dg AS (SELECT on_day, avg(poa) AS g FROM p WHERE {INSIDE} GROUP BY 1), dw AS (SELECT on_day, coalesce(g < 0.35 * (SELECT median(g) FROM dg), false) AS wet FROM dg),
sp AS (SELECT *, sum(wet::INTEGER) OVER (ORDER BY on_day) AS spell FROM dw), ls AS (SELECT on_day, least(0.01 * count(*) FILTER (NOT wet) OVER (PARTITION BY spell ORDER BY on_day), 0.05)::DOUBLE AS loss FROM sp)""",
        ),
        "inject_cap": _injected(_scaled("500 / ac", INSIDE + " AND coalesce(ac > 500, false)")),
        "inject_drift": _injected(f"SELECT ts, CASE WHEN {INSIDE} THEN poa * (1 + greatest(least(n * -0.004, 0.1), 0)) ELSE poa END AS poa, ac, dc FROM (SELECT *, dense_rank() OVER (PARTITION BY {INSIDE} ORDER BY on_day) - 1 AS n FROM p)"),
        "inject_gap": _injected(f"SELECT ts, poa, CASE WHEN NOT {INSIDE} THEN ac END AS ac, dc FROM p"),
        "findings_lifecycle": """WITH e AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS sweep, * FROM events), al AS (SELECT DISTINCT sweep FROM e), h AS (SELECT DISTINCT 'user' || (user_id % 50) AS identity, sweep FROM e WHERE event_type = 'purchase' AND value >= 150),
l AS (SELECT identity, max(sweep) AS last_hit, count(*) AS hits FROM h GROUP BY 1), g AS (SELECT l.*, (SELECT count(*) FROM al WHERE sweep > last_hit) AS after FROM l)
SELECT identity, CASE WHEN after >= 3 THEN 'resolved' WHEN hits = 1 THEN 'new' ELSE 'ongoing' END AS lifecycle, least(after, 3)::INTEGER AS misses,
  (SELECT max(sweep) FROM (SELECT sweep FROM al WHERE sweep >= last_hit ORDER BY sweep LIMIT 4))::BIGINT AS last FROM g""",
        "bm25_search": BM25.replace("{stop}", STOP),
        "macro_f1": f"""WITH {CASES}, l AS (SELECT DISTINCT truth AS label FROM c WHERE truth IS NOT NULL), s AS (SELECT label, count(*) FILTER (truth = label AND predicted = label) AS tp, count(*) FILTER (truth = label) AS actual, count(*) FILTER (predicted = label) AS named FROM l, c GROUP BY label),
r AS (SELECT *, coalesce(tp / nullif(named, 0), 0) AS pr, tp / actual AS re FROM s) SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, actual::BIGINT AS support FROM r""",
        "confusion": f"WITH {CASES} SELECT truth, count(*) FILTER (predicted = 0) AS predicted_0, count(*) FILTER (predicted = 1) AS predicted_1 FROM c GROUP BY truth",
        "split_attempts": "WITH s AS (SELECT *, turn % 3 AS step FROM conversations), b AS (SELECT conv_id, coalesce(step <= lag(step) OVER (PARTITION BY conv_id ORDER BY turn), false)::INTEGER AS back FROM s) SELECT conv_id, (sum(back) + 1)::BIGINT AS attempts, count(*) AS steps FROM b GROUP BY 1",
    }


def _ledger(days: int = 7) -> str:
    """One row of measures a window, put together from the SQL of the measures."""
    kw = "system_id, window_id"
    base = _sql() | _sun_sql()
    of = lambda name: "(" + base[name].replace("// 14)", f"// {days})") + ")"
    daily = f"""(WITH {_panel(days)}, d AS (SELECT on_day AS day, any_value(window_id) AS window_id, sum(poa) AS poa, sum(ac) AS ac FROM p GROUP BY 1), v AS (SELECT window_id, min(day) AS lo FROM d GROUP BY 1),
  b AS (SELECT min(day) AS first FROM d), w AS (SELECT window_id, first + (window_id * {days})::INTEGER AS a, first + (window_id * {days} + {days - 1})::INTEGER AS z FROM v, b),
  j AS (SELECT w.window_id, d.day >= a AS now, d.ac, d.poa FROM d JOIN w ON d.day BETWEEN a - 30 AND z),
  o AS (SELECT window_id, sum(ac) FILTER (now) / nullif(sum(poa) FILTER (now), 0) AS n, sum(ac) FILTER (NOT now) / nullif(sum(poa) FILTER (NOT now), 0) AS q FROM j GROUP BY 1)
  SELECT 1 AS system_id, window_id, round(n - q, 6) AS change FROM o WHERE n IS NOT NULL AND q IS NOT NULL)"""
    trend = f"""(WITH r AS ({_pr(kw + ", on_day", days)}), y AS (SELECT *, (row_number() OVER (PARTITION BY {kw} ORDER BY on_day) - 1)::DOUBLE AS x FROM r WHERE pr_temperature_corrected IS NOT NULL)
  SELECT {kw}, round(regr_slope(pr_temperature_corrected, x), 9) AS slope_per_day FROM y GROUP BY {kw} HAVING count(*) >= 5)"""
    strings = f"""(WITH s AS (SELECT 1 AS system_id, ts::DATE AS day, (user_id % 7 + 1)::INTEGER AS string_idx, sum(value::DECIMAL(18,4))::DOUBLE AS current_a,
  (date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // {days})::INTEGER AS window_id FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL GROUP BY ALL),
  {SHARES.split(",", 1)[1].partition("GROUP BY 1, 2, 3, 4), ")[2]}, a AS (SELECT {kw}, string_idx, avg(share) AS share FROM sh GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY {kw}) AS n FROM a)
  SELECT {kw}, max(round(1 - share * n, 6)) AS string_deficit FROM n WHERE n >= 2 GROUP BY {kw})"""
    join = lambda source, alias: f"LEFT JOIN {source} {alias} USING ({kw})"
    return f"""(SELECT {kw}, lit_interval_completeness, coverage, pr, data_completeness, deficit_fraction, deficit_second_half - deficit_first_half AS deficit_change, flat_ceiling_share, shape_spread,
  least(clear_days_first_half, clear_days_second_half) AS clear_days, ratio_change_per_day, shortfall_vs_clearsky, slope_per_day, change, string_deficit
  FROM {of("data_quality")} a0 {join(of("pr_window"), "a1")} {join(of("expected_output"), "a2")} {join(of("ac_ceiling"), "a3")}
  {join(f"(SELECT {kw}, max(shape) - min(shape) AS shape_spread FROM {of('time_of_day_profile')} GROUP BY {kw})", "a4")} {join(of("clearsky_consistency"), "a5")} {join(trend, "a6")} {join(daily, "a7")} {join(strings, "a8")})"""


def _views_sql() -> dict[str, str]:
    kw = "system_id, window_id"
    ledger = _ledger()
    shown = "lit_interval_completeness coverage pr data_completeness deficit_fraction deficit_change flat_ceiling_share shape_spread clear_days slope_per_day change string_deficit".split()
    fires = [("data_completeness", "lit_interval_completeness", 0.80, "<"), ("performance_ratio_drop", "change", -0.05, "<"), ("string_imbalance", "string_deficit", 0.22, ">"), ("flat_ceiling", "flat_ceiling_share", 0.02, ">")]
    signals = " UNION ALL ".join(f"SELECT {kw}, '{n}' AS detector, round({k}, 6) AS value, {t}::DOUBLE AS threshold, round(abs({k} / {t}), 6) AS severity FROM l WHERE {k} {side} {t}" for n, k, t, side in fires)
    cause = """CASE WHEN coalesce(lit_interval_completeness, 1) < 0.80 OR coalesce(coverage, 1) < 0.80 OR pr IS NULL OR coalesce(data_completeness, 1) < 0.80 THEN 'telemetry_gap'
  WHEN clear_days >= 3 AND (ratio_change_per_day < -0.004 OR shortfall_vs_clearsky > 0.12) THEN 'sensor_drift' WHEN flat_ceiling_share > 0.02 THEN 'clipping'
  WHEN string_deficit > 0.22 THEN CASE WHEN shape_spread > 0.25 THEN 'shading' ELSE 'string_outage' END WHEN slope_per_day < -0.0015 OR deficit_change > 0.04 OR deficit_fraction > 0.05 THEN 'soiling' ELSE 'seasonal_temperature_derating' END"""
    category = "CASE cause WHEN 'telemetry_gap' THEN 'not_the_plant' WHEN 'sensor_drift' THEN 'not_the_plant' WHEN 'shading' THEN 'fault' WHEN 'string_outage' THEN 'fault' WHEN 'soiling' THEN 'recoverable' ELSE 'by_design' END"
    verdicts = f"SELECT *, {category} AS category FROM (SELECT {kw}, {cause} AS cause FROM {ledger})"
    actions = "CASE category WHEN 'fault' THEN 'Send someone.' WHEN 'recoverable' THEN 'Schedule maintenance.' WHEN 'by_design' THEN 'Do nothing; the plant works as it was built.' ELSE 'Do nothing to the plant.' END"
    weekly = _pr("system_id, period").replace("AS window_id FROM p0)", "AS window_id, (date_trunc('week', ts)::DATE + 6)::DATE AS period FROM p0)")
    words = lambda c: f"unnest(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda x: length(x) > 3)))"
    return {
        "measure_ledger": f"SELECT {kw}, {', '.join(f'round({c}, 5) AS {c}' for c in shown)} FROM {ledger}",
        "sweep_signals": f"WITH l AS MATERIALIZED (SELECT * FROM {ledger}) {signals}",
        "rules_verdict": verdicts,
        "sweep_findings": f"WITH l AS MATERIALIZED (SELECT * FROM {ledger}), g AS ({signals}) SELECT {kw}, detector, 'plant::' || cause AS identity, category, cause, severity, {actions} AS recommended_action FROM g JOIN ({verdicts}) USING ({kw})",
        "recent_rows": f"WITH {_panel()} SELECT system_id, ts, round(ac, 4) AS ac_power_kw, round(poa, 4) AS poa_wm2 FROM p QUALIFY row_number() OVER (PARTITION BY system_id ORDER BY ts DESC) <= 400",
        "pr_weekly": f"SELECT system_id, period, pr, pr_temperature_corrected, energy_kwh, data_completeness, data_completeness < 0.5 AS shaded FROM ({weekly})",
        "string_map": f"WITH {STRINGS}, t AS (SELECT *, sum(current_a) OVER (PARTITION BY day) AS total FROM s), m AS (SELECT median(total) AS middle FROM (SELECT DISTINCT day, total FROM t)) SELECT system_id, day, string_idx, round(current_a / total, 6) AS share FROM t, m WHERE total > greatest(0.2 * middle, 1e-6)",
        "expected_scatter": f"WITH {_panel()}, {EXPECTED}, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS k, greatest(count(*) OVER () // 4000, 1) AS stride FROM x WHERE expected > 1 AND ac IS NOT NULL) SELECT system_id, ts, round(expected, 4) AS expected_kw, round(ac, 4) AS ac_power_kw FROM n WHERE k % stride = 0",
        "gap_calendar": f"WITH {_panel()}, c AS (SELECT system_id, on_day AS day, round(count(ac) / count(*), 6) AS completeness FROM p GROUP BY ALL) SELECT *, CASE WHEN completeness <= 0 THEN 'missing' WHEN completeness < 0.5 THEN 'poor' WHEN completeness < 0.95 THEN 'partial' ELSE 'complete' END AS band FROM c",
        "plant_summary": f"WITH {_panel()} SELECT system_id, epoch(min(ts))::BIGINT AS first_second, epoch(max(ts))::BIGINT AS last_second, count(*) AS intervals, round(max(ac), 4) AS peak_ac_kw FROM p GROUP BY 1",
        "latest_plan": "SELECT conv_id, max(turn) AS step_index, arg_max(text, turn) AS plan FROM conversations WHERE role = 'assistant' GROUP BY 1",
        "knowledge_match": f"""WITH a AS (SELECT item_id AS qid, {words("text")} AS word FROM benchmark), k AS (SELECT conv_id * 1000 + turn AS key, {words("concat_ws(' ', conv_id * 1000 + turn, text)")} AS word FROM conversations),
o AS (SELECT qid, key, count(*) AS overlap FROM a JOIN k USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, key) AS rank FROM o) SELECT qid, key, overlap, rank::INTEGER AS rank FROM r WHERE rank <= 6""",
    }


def _hybrid_sql() -> str:
    """BM25 and 4-gram cosine over the conversations, the best 30 of each fused by rank, then reranked."""
    stop = f"string_split('{STOP}', ' ')"
    terms = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: NOT list_contains({stop}, x))"
    grams = lambda source, key: f"(SELECT {key}, g, count(*) AS c FROM (SELECT {key}, unnest(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))) AS g FROM (SELECT {key}, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM {source})) GROUP BY ALL)"
    best = lambda name: f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM {name} QUALIFY rank <= 30"
    return f"""WITH d AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS text FROM conversations), q AS (SELECT item_id AS qid, coalesce(text, '') AS text FROM benchmark),
dt AS (SELECT id, {terms("text")} AS t FROM d), qt AS (SELECT qid, {terms("text")} AS t FROM q), ln AS (SELECT id, len(t) AS raw, greatest(len(t), 1) AS length FROM dt), wh AS (SELECT count(*) AS n, CASE WHEN avg(raw) > 0 THEN avg(raw) ELSE 1 END AS mean FROM ln),
qk AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest(t) AS term FROM qt) GROUP BY ALL), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM qk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT qid, id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (term) JOIN ln USING (id) JOIN qk USING (term), wh GROUP BY ALL),
dg AS {grams("d", "id")}, qg AS {grams("q", "qid")}, dn AS (SELECT id, sqrt(sum(c * c)) AS dn FROM dg GROUP BY 1), qn AS (SELECT qid, sqrt(sum(c * c)) AS qn FROM qg GROUP BY 1),
dot AS (SELECT qid, id, sum(dg.c * qg.c) AS dot FROM dg JOIN qg USING (g) GROUP BY ALL), co AS (SELECT qid, id, dot / (dn * qn) AS score FROM dot JOIN dn USING (id) JOIN qn USING (qid)),
fu AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ({best("bm")} UNION ALL {best("co")}) GROUP BY ALL), fr AS ({best("fu").replace(" QUALIFY rank <= 30", "")}),
sc AS (SELECT fr.qid, fr.id, 2 * coalesce(len(list_intersect(list_distinct(qt.t), dt.t)) / nullif(len(list_distinct(qt.t)), 0), 0) + CASE WHEN trim(lower(q.text), E' \\t\\n\\r') <> '' AND contains(lower(d.text), trim(lower(q.text), E' \\t\\n\\r')) THEN 1.5 ELSE 0 END + 1.0::DOUBLE / rank AS score
  FROM fr JOIN d USING (id) JOIN dt USING (id) JOIN q USING (qid) JOIN qt USING (qid)),
re AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc) SELECT qid, id, round(score, 6) AS score, rank::INTEGER AS rank FROM re WHERE rank <= 10"""


def _prose_sql() -> dict[str, str]:
    """Numerals beside what stands behind them, and sentences that read as rules."""
    return {
        "numeric_grounding": """WITH e AS (SELECT event_id AS id, value AS k, round(value * 100)::BIGINT AS n FROM events WHERE value IS NOT NULL),
c AS (SELECT id, k, (n // 100) || '.' || lpad((n % 100)::VARCHAR, 2, '0') AS literal, 2 AS d FROM e UNION ALL SELECT id, k, ((n // 10 + id % 3) // 10) || '.' || ((n // 10 + id % 3) % 10), 1 FROM e UNION ALL SELECT id, k, id::VARCHAR, 0 FROM e WHERE id > 24),
v AS (SELECT *, literal::DOUBLE AS value FROM c)
SELECT id, literal, value, least(abs(value - k), abs(value - k * 100), abs(value - k * 0.01)) <= 0.5 * pow(10.0, -d) + 1e-9 + value * 1e-9 AS grounded FROM v""",
        "rule_lint": """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '> ' || n[1] WHEN 1 THEN 'less than ' || n[1] ELSE 'above ' || n || ' %' END AS found
FROM (SELECT event_id, floor(value)::BIGINT::VARCHAR AS n FROM events WHERE value IS NOT NULL) WHERE event_id % 4 < 3""",
    }


SQL = _sql() | _sun_sql() | _views_sql() | _prose_sql() | {"hybrid_search": _hybrid_sql()}
