"""DuckDB SQL for the queries of ``fleet``, written apart from the DataFrame code."""

from __future__ import annotations

from heliograph.oracles import DAILY, EXPECTED, INSIDE, SHARES, STOP, STRINGS, _change_point, _injected, _islands, _judged, _panel, _pr, _step_hours, _views_sql
from heliograph.oracles import SQL as BASE

KW = "system_id, window_id"
PLANTS = """pl AS (SELECT n_nationkey AS system_id, n_name AS name, r_name AS module, n_nationkey * 5 + 60.0::DOUBLE AS cap, round(CASE WHEN n_regionkey < 3 THEN (-0.3 - n_regionkey * 0.02) / 100 ELSE -0.004 END, 8)::DOUBLE AS gamma, (n_regionkey - 2)::DOUBLE AS utc
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _fleet_panel(days: int = 14, unit: str = "hour") -> str:
    panel = _panel(days).split("p AS (")[0].replace("1 AS system_id", "(user_id % 25)::INTEGER AS system_id").replace("GROUP BY 2", "GROUP BY 1, 2").replace("date_trunc('hour'", f"date_trunc('{unit}'")
    return f"""{PLANTS}, {panel}
p AS (SELECT p0.*, ts::DATE AS on_day, (date_diff('day', min(ts::DATE) OVER (PARTITION BY p0.system_id), ts::DATE) // {days})::INTEGER AS window_id, cap, gamma, utc FROM p0 JOIN pl USING (system_id))"""


def _fleet(sql: str) -> str:
    """The SQL of one plant's measure, over many plants."""
    head, rest = sql.split(_panel(), 1)
    rest = rest.replace(KW, f"{KW}, cap, gamma")
    for one, many in (("100.0 * gg", "cap * gg"), ("1 - 0.004 *", "1 + gamma *"), ("100 * coalesce(poa, 0)", "cap * coalesce(poa, 0)"), ("expected >= 5", "expected >= 0.05 * cap"), ("dc >= 5", "dc >= 0.05 * cap"), ("ac > 120", "ac > 1.2 * cap"), ("hour(ts)", "hour(to_timestamp(epoch(ts) + utc * 3600) AT TIME ZONE 'UTC')")):
        rest = rest.replace(one, many)
    return f"SELECT * EXCLUDE (cap, gamma) FROM ({head}{_fleet_panel()}{rest})"


def _fleet_sql() -> dict[str, str]:
    quality = _fleet(BASE["data_quality"]).replace("FROM p GROUP BY 1, 2)", "FROM p GROUP BY 1, 2, 3, 4)")
    ceiling = f"""a AS (SELECT *, max(ac) OVER (PARTITION BY {KW}) AS peak FROM p WHERE ac IS NOT NULL), dl AS (SELECT * FROM a WHERE peak > 0 AND ac > 0.15 * peak),
fl AS (SELECT *, ac >= 0.98 * peak AND coalesce(abs(ac - lag(ac) OVER (PARTITION BY {KW} ORDER BY ts)) <= 0.005 * peak, false) AS flat FROM dl), ru AS {_islands("fl", KW, "NOT flat")},
le AS (SELECT *, count(*) FILTER (flat) OVER (PARTITION BY {KW}, island) AS length FROM ru)
SELECT {KW}, round(max(peak), 4) AS peak_ac_kw, round(count(*) FILTER (flat AND length >= 3) / count(*), 6) AS flat_ceiling_share, max(length) AS longest_flat_run_intervals,
  count(DISTINCT CASE WHEN flat AND length >= 3 THEN on_day END) AS days_with_a_plateau, count(*) AS generating_intervals FROM le GROUP BY {KW}"""
    stuck = f"""lo AS (SELECT {KW}, ts, unnest(['poa_wm2', 'temp_ambient_c', 'wind_speed_ms']) AS channel, unnest([poa, ambient, wind]) AS v FROM p WHERE poa >= 50),
sa AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY {KW}, channel ORDER BY ts)) < 1e-9, false) AS same FROM lo WHERE v IS NOT NULL), ru AS {_islands("sa", KW + ", channel", "NOT same")},
le AS (SELECT *, count(*) FILTER (same) OVER (PARTITION BY {KW}, channel, island) AS length FROM ru) SELECT {KW}, channel, round(count(*) FILTER (length >= 7) / count(*), 6) AS stuck_share, count(*) AS samples FROM le GROUP BY ALL"""
    issues = lambda run: f"""c AS (SELECT {KW}, cap, ts, poa, ac, unnest([0, 1, 2, 3, 4]) AS od, unnest(['poa_wm2', 'ac_power_kw', 'temp_ambient_c', 'temp_module_c', 'wind_speed_ms']) AS channel, unnest([poa, ac, ambient, module, wind]) AS raw,
  unnest([CASE WHEN poa > 50 THEN poa END, CASE WHEN poa > 50 THEN ac END, ambient, module, wind]) AS v FROM p),
f AS (SELECT *, coalesce(v = lag(v) OVER (PARTITION BY {KW}, channel ORDER BY ts), false) AS same FROM c), i AS (SELECT * FROM {_islands("f", KW + ", channel", "NOT same")}),
r AS (SELECT *, count(v) OVER (PARTITION BY {KW}, channel, island) AS length FROM i), tot AS (SELECT {KW}, count(*) AS total FROM p GROUP BY ALL),
u AS (SELECT {KW}, channel, od, ts, 0 AS o, 'missing' AS kind FROM r WHERE raw IS NULL UNION ALL SELECT {KW}, channel, od, ts, 1, 'night_generation' FROM r WHERE od = 1 AND poa < 5 AND ac > 0.5
  UNION ALL SELECT {KW}, channel, od, ts, 2, 'flatline' FROM r WHERE v IS NOT NULL AND length >= {run} UNION ALL SELECT {KW}, channel, od, ts, 3, 'out_of_range' FROM r WHERE od = 1 AND ac > 1.2 * cap),
g AS (SELECT {KW}, kind, o, od, channel, count(*) AS count, any_value(total) AS total, min(ts) AS a, max(ts) AS b FROM u JOIN tot USING ({KW}) GROUP BY ALL),
iss AS (SELECT {KW}, kind, channel, count, round(count / total, 5) AS fraction, epoch(a)::BIGINT AS first_seen, epoch(b)::BIGINT AS last_seen, row_number() OVER (PARTITION BY {KW} ORDER BY count / total DESC, o, od)::INTEGER AS rank FROM g)"""  # noqa: E731
    profile = f"""dy AS (SELECT {KW}, on_day FROM p GROUP BY ALL HAVING count(ac) = 0), md AS (SELECT {KW}, count(*) AS md, min(on_day) AS f, max(on_day) AS l FROM dy GROUP BY ALL),
s AS (SELECT {KW}, count(*) AS actual_samples, date_diff('second', min(ts), max(ts)) AS span, count(*) FILTER (poa >= 200) AS lit_intervals, count(*) FILTER (poa >= 200 AND ac IS NULL) AS lw FROM p GROUP BY ALL),
w AS (SELECT {KW}, count(*) AS issue_count, max(fraction) FILTER (rank = 1) AS share, max(kind) FILTER (rank = 1) AS kind, max(channel) FILTER (rank = 1) AS channel FROM iss GROUP BY ALL),
q AS (SELECT *, coalesce((floor(span / (h * 3600)) + 1)::BIGINT, 1) AS expected_samples FROM s LEFT JOIN h USING ({KW}) LEFT JOIN md USING ({KW}) LEFT JOIN w USING ({KW}))
SELECT {KW}, expected_samples, actual_samples, round(actual_samples / expected_samples, 6) AS coverage, lit_intervals, lw AS lit_intervals_without_power, round(coalesce(1 - lw / nullif(lit_intervals, 0), 1), 6) AS lit_interval_completeness,
  coalesce(md, 0)::BIGINT AS missing_days, f AS first_missing_day, l AS last_missing_day, coalesce(issue_count, 0)::BIGINT AS issue_count, share AS worst_issue_share, kind AS worst_issue, channel AS worst_issue_channel FROM q"""
    series = lambda panel: f"""SELECT system_id, period, pr, pr_temperature_corrected, energy_kwh, data_completeness, data_completeness < 0.5 AS shaded FROM ({_pr("system_id, period").replace(_panel(), panel)})"""
    many = "p AS (SELECT * FROM p1 QUALIFY count(*) OVER (PARTITION BY system_id, period) >= 2)"
    monthly = _fleet_panel().replace("\np AS (SELECT p0.*,", "\np1 AS (SELECT p0.*, last_day(ts::DATE) AS period,") + ", " + many
    hourly = f"""p0 AS (SELECT 1 AS system_id, date_trunc('minute', ts) AS ts, sum(value::DECIMAL(18,4))::DOUBLE AS poa, sum(CASE WHEN event_type = 'purchase' THEN value::DECIMAL(18,4) END)::DOUBLE AS ac, NULL::DOUBLE AS module, 20.0::DOUBLE AS ambient, 1.0::DOUBLE AS wind FROM events GROUP BY 2),
p1 AS (SELECT *, date_trunc('hour', ts) AS period FROM p0), {many}"""
    return {
        "plant_dimension": f"WITH {PLANTS} SELECT system_id, name, module, cap AS capacity_kw, round(gamma, 6) AS gamma, utc AS utc_offset_hours FROM pl",
        "plant_metadata": """SELECT n_nationkey AS system_id, n_name AS name, 40.5::DOUBLE AS latitude, 0.0::DOUBLE AS longitude, 'Site ' || n_nationkey AS location, CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE n_nationkey * 10 END::DOUBLE AS dc_capacity_kw, 25.0::DOUBLE AS tilt_deg,
  CASE WHEN n_nationkey % 2 = 0 THEN 170 ELSE 180 END::DOUBLE AS azimuth_deg, n_nationkey % 2 = 0 AS tracking, 0::INTEGER AS module_quantity, 7::INTEGER AS strings, 'PVP ' || (n_nationkey * 10) || 'kW' AS inverter_model, (n_nationkey * 10)::DOUBLE AS ac_capacity_kw_hint FROM nation""",
        "fleet_pr": _fleet(BASE["pr_window"]),
        "fleet_expected_output": _fleet(BASE["expected_output"]),
        "fleet_time_of_day": _fleet(BASE["time_of_day_profile"]),
        "fleet_dc_to_ac": _fleet(BASE["dc_to_ac_conversion"]),
        "fleet_data_quality": quality,
        "fleet_residual": f"WITH {_fleet_panel()}, {EXPECTED.replace('100 * coalesce', 'cap * coalesce').replace('1 - 0.004 *', '1 + gamma *')} SELECT system_id, on_day, round(sum(ac - expected), 4) AS residual_kw, count(*) AS intervals FROM x GROUP BY 1, 2",
        "ac_ceiling_default": f"WITH {_fleet_panel()}, {ceiling}",
        "stuck_channels_default": f"WITH {_fleet_panel()}, {stuck}",
        "pr_monthly": series(monthly),
        "pr_hourly": series(hourly),
        "quality_issues": f"WITH {_fleet_panel()}, {issues(3)} SELECT * FROM iss",
        "quality_profile": f"WITH {_fleet_panel()}, {_step_hours(KW)}, {issues(12)}, {profile}",
    }


def _diagnosis_sql() -> dict[str, str]:
    weather = f"""WITH {DAILY}, b AS (SELECT min(day) AS lo, max(day) AS hi FROM d), w AS (SELECT unnest(range(0, date_diff('day', lo, hi) // 60 + 1))::INTEGER AS window_id, lo FROM b),
v AS (SELECT window_id, (lo + (window_id * 60)::INTEGER)::DATE AS a, (lo + (window_id * 60 + 59)::INTEGER)::DATE AS z FROM w), i AS (SELECT v.window_id, a, z, day, poa FROM d JOIN v ON day BETWEEN a AND z),
s AS (SELECT window_id, a, z, min(dayofyear(day)) AS l, max(dayofyear(day)) AS h FROM i GROUP BY ALL), n AS (SELECT s.window_id, avg(poa) AS norm, count(*) AS c FROM s JOIN d ON dayofyear(day) BETWEEN l AND h AND NOT day BETWEEN a AND z GROUP BY 1)
SELECT 1 AS system_id, window_id, round(any_value(norm), 3) AS seasonal_norm, round(avg(poa) / any_value(norm), 6) AS relative_to_norm, round(100 * (avg(poa) / any_value(norm) - 1), 4) AS percent_vs_norm, count(*) FILTER (poa < 0.6 * norm) AS dim_days, count(*) AS days_in_window,
  round(max(poa), 3) AS brightest_day, round(min(poa), 3) AS dimmest_day, CASE WHEN count(*) > 1 THEN round(stddev_samp(poa), 3) END AS day_to_day_spread, 60.0::DOUBLE AS dim_day_threshold_pct_of_norm, any_value(c) AS seasonal_days_compared FROM i JOIN n USING (window_id) GROUP BY window_id"""
    onset = BASE["onset_changepoint"]
    full = f"""WITH {DAILY}, o AS ({onset}), {_change_point("d", KW, "ac").split(" SELECT ")[0] if False else _change_point("d", KW, "ac").rsplit(chr(10) + "SELECT", 1)[0]},
l AS (SELECT {KW}, a, b FROM best WHERE r = 1), t AS (SELECT {KW}, any_value(a) AS a, any_value(b) AS b, count(*) FILTER (abs(a - b) > 1e-9 AND ac > least(a, b) + 0.15 * abs(a - b) AND ac < greatest(a, b) - 0.15 * abs(a - b)) AS c FROM d JOIN l USING ({KW}) GROUP BY {KW})
SELECT o.*, round(coalesce((t.a - t.b) / nullif(t.b, 0), 0), 6) AS relative_change, round(abs(t.a - t.b), 4) AS change_magnitude, c AS days_in_transition FROM o JOIN t USING ({KW})"""
    baseline = f"""WITH {_panel()}, sp AS (SELECT min(on_day) AS lo, max(on_day) AS hi FROM p0x), w AS (SELECT k::INTEGER AS window_id, (lo + 7 + (3 * k)::INTEGER)::DATE AS now FROM sp, unnest(range(0, 400)) AS t(k) WHERE lo + 7 + (3 * k)::INTEGER <= greatest(hi + 1, lo + 7)),
rl AS (SELECT window_id, 'now' AS role, (now - 7)::DATE AS a, (now - 1)::DATE AS z FROM w UNION ALL SELECT window_id, 'prior', (now - 21)::DATE, (now - 8)::DATE FROM w)"""
    rows = f"WITH {_panel().split('p AS (')[0]} pp AS (SELECT *, ts::DATE AS on_day FROM p0), {baseline.split('sp AS', 1)[1].join(['sp AS', '']).replace('p0x', 'pp')}"
    rows += ", p AS (SELECT pp.*, rl.window_id, rl.role FROM pp JOIN rl ON on_day BETWEEN a AND z)"
    pr = lambda keys, where="": _pr(keys).split(_panel(), 1)[1].replace("FROM p)", f"FROM p{where})", 1).replace("FROM p),\ng AS", f"FROM p{where}),\ng AS")
    trailing = f"""WITH whole AS ({rows}{pr(KW + ", role")}), daily AS ({rows}{pr(KW + ", on_day", " WHERE role = 'prior'")}), bf AS (SELECT window_id FROM ({rows} SELECT window_id, count(*) AS n FROM p WHERE role = 'prior' GROUP BY 1) WHERE n >= 96),
sc AS (SELECT window_id, stddev_samp(pr_temperature_corrected) AS s, count(pr_temperature_corrected) AS n FROM daily GROUP BY 1),
j AS (SELECT window_id, max(pr_temperature_corrected) FILTER (role = 'now') AS cw, max(pr_temperature_corrected) FILTER (role = 'prior') AS cb, max(pr) FILTER (role = 'now') AS rw, max(pr) FILTER (role = 'prior') AS rb, max(samples_used) FILTER (role = 'prior') AS u, max(data_completeness) FILTER (role = 'prior') AS dc FROM whole GROUP BY 1),
k AS (SELECT *, round(cw - cb, 6) AS change, CASE WHEN n > 2 THEN round(s, 6) ELSE 0 END AS spread FROM j JOIN bf USING (window_id) LEFT JOIN sc USING (window_id) WHERE cw IS NOT NULL AND cb IS NOT NULL)
SELECT 1 AS system_id, window_id, cw AS pr_corrected_window, cb AS pr_corrected_baseline, change, rw AS pr_raw_window, rb AS pr_raw_baseline, spread AS baseline_day_to_day_spread,
  round(CASE WHEN change = 0 THEN 0 WHEN spread <= 0 THEN 999 ELSE least(abs(change) / spread, 999) END, 4) AS change_over_spread, 14 AS baseline_days_requested, u AS baseline_intervals_used, dc AS baseline_completeness FROM k"""
    hs = "hs AS (SELECT date_trunc('hour', ts) AS ts, (user_id % 7 + 1)::INTEGER AS string_idx, sum(value::DECIMAL(18,4))::DOUBLE AS current_a FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL GROUP BY 1, 2)"
    soil = BASE["inject_soiling"].split("i AS (")[0].rstrip(", ")
    return {
        "string_balance_summary": f"""WITH {SHARES}, a AS (SELECT {KW}, string_idx, avg(share) AS m, stddev_samp(share) AS s, count(*) AS samples FROM sh GROUP BY ALL)
SELECT {KW}, string_idx, round(m, 6) AS mean_share, round(s, 6) AS share_deviation, samples, round(1 / count(*) OVER (PARTITION BY {KW}), 6) AS expected_share FROM a""",
        "trailing_windows": """WITH s AS (SELECT (user_id % 25)::INTEGER AS system_id, min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events GROUP BY 1),
w AS (SELECT system_id, k::INTEGER AS window_id, (lo + 14 + (7 * k)::INTEGER)::DATE AS now, lo, hi FROM s, unnest(range(0, 1000)) AS t(k))
SELECT system_id, window_id, now, (now - 14)::DATE AS start_day, (now - 1)::DATE AS end_day FROM w WHERE now <= greatest(hi + 1, lo + 14)""",
        "trailing_baseline_corrected": trailing,
        "onset_in_full": full,
        "trend_ends": f"""WITH {DAILY}, y AS (SELECT {KW}, day, ac / nullif(poa, 0) AS y FROM d), z AS (SELECT *, y - lag(y) OVER (PARTITION BY {KW} ORDER BY day) AS step FROM y WHERE y IS NOT NULL)
SELECT {KW}, count(*) AS days, round(arg_min(y, day), 6) AS first_day_value, round(arg_max(y, day), 6) AS last_day_value, round(coalesce(max(step) FILTER (round(step, 9) >= 0.01), 0), 6) AS largest_recovery, 0.01::DOUBLE AS recovery_threshold FROM z GROUP BY {KW} HAVING count(*) >= 5""",
        "weather_in_full": weather,
        "string_onset_scan": f"""WITH o AS ({BASE["string_onset"]}), r AS (SELECT *, row_number() OVER (PARTITION BY {KW} ORDER BY change_over_scatter DESC, abs(absolute_change) DESC, string_idx) AS k FROM o),
c AS (WITH {SHARES}, cn AS (SELECT window_id, count(DISTINCT string_idx) AS n FROM sh GROUP BY 1), dy AS (SELECT window_id, day, count(*) AS here FROM sh GROUP BY ALL) SELECT window_id, n, count(*) AS days FROM dy JOIN cn USING (window_id) WHERE here = n GROUP BY ALL)
SELECT {KW}, string_idx AS most_changed_string, absolute_change AS its_share_change, change_over_scatter AS its_change_over_scatter, onset_day, c.days AS days_scored, c.n AS strings_compared FROM r JOIN c USING (window_id) WHERE k = 1""",
        "inject_string_outage": f"""WITH {_panel()}, {hs}, tt AS (SELECT ts, max(current_a) FILTER (string_idx = 3) AS own, sum(CASE WHEN string_idx = 3 THEN current_a * 0 ELSE current_a END) AS total FROM hs WHERE {INSIDE} GROUP BY 1),
sv AS (SELECT coalesce(median(own / total) FILTER (total <> 0), (SELECT 1 / count(DISTINCT string_idx) FROM hs)) AS share FROM tt)
SELECT on_day AS day, round(sum(CASE WHEN {INSIDE} THEN ac * (1 - share) ELSE ac END), 4) AS ac, round(sum(CASE WHEN {INSIDE} THEN dc * (1 - share) ELSE dc END), 4) AS dc FROM p, sv GROUP BY 1""",
        "inject_string_shading": f"WITH {hs} SELECT ts::DATE AS day, string_idx, round(sum(CASE WHEN {INSIDE} AND string_idx IN (6, 7, 1) AND hour(ts) >= 6 AND hour(ts) < 10 THEN current_a * 0.5 ELSE current_a END), 4) AS current_a FROM hs GROUP BY 1, 2",
        "inject_string_soiling": f"{soil}, {hs} SELECT ts::DATE AS day, string_idx, round(sum(CASE WHEN {INSIDE} THEN current_a * (1 - coalesce(loss, 0)) ELSE current_a END), 4) AS current_a FROM hs LEFT JOIN ls ON ts::DATE = ls.on_day GROUP BY 1, 2",
        "energy_removed": f"WITH {_panel()} SELECT system_id, on_day AS day, round(sum(ac - CASE WHEN {INSIDE} AND coalesce(ac > 500, false) THEN ac * (500 / ac) ELSE ac END), 3) AS energy_removed_kwh FROM p GROUP BY 1, 2",
    }


LOG = """ev AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS sweep, * FROM events), al AS (SELECT DISTINCT sweep FROM ev), ht AS (SELECT DISTINCT 'user' || (user_id % 50) AS identity, sweep FROM ev WHERE event_type = 'purchase' AND value >= 150),
gr AS (SELECT i.identity, al.sweep, ht.sweep IS NOT NULL AS hit FROM (SELECT DISTINCT identity FROM ht) i CROSS JOIN al LEFT JOIN ht ON ht.identity = i.identity AND ht.sweep = al.sweep),
nh AS (SELECT *, sum(hit::INTEGER) OVER w AS hits, row_number() OVER w AS pos FROM gr WINDOW w AS (PARTITION BY identity ORDER BY sweep)),
ms AS (SELECT *, pos - max(CASE WHEN hit THEN pos END) OVER (PARTITION BY identity ORDER BY sweep) AS misses FROM nh WHERE hits > 0),
lg AS (SELECT identity, sweep::BIGINT AS sweep, misses::INTEGER AS misses, CASE WHEN misses >= 3 THEN 'resolved' WHEN hits = 1 THEN 'new' ELSE 'ongoing' END AS lifecycle FROM ms WHERE misses <= 3),
cu AS (SELECT identity, arg_max(lifecycle, sweep) AS lifecycle, arg_max(misses, sweep) AS misses, max(sweep) AS last FROM lg GROUP BY 1)"""
TRACE = """tr AS (SELECT conv_id, turn AS step_index, text, CASE WHEN turn = 0 THEN 'plan' WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'tool' ELSE 'answer' END WHEN turn % 4 = 2 THEN 'adaptive' ELSE 'critic' END AS kind,
  CASE WHEN turn > 0 THEN turn // 3 ELSE 0 END::INTEGER AS cycle, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE length(coalesce(text, '')) END::BIGINT AS ms FROM conversations)"""


def _evaluation_sql() -> dict[str, str]:
    ledger = _views_sql()["rules_verdict"]
    classes = f"""SELECT split, CASE WHEN truth_settled THEN truth_category ELSE 'not_enough_evidence' END AS t, CASE WHEN settled THEN category ELSE 'not_enough_evidence' END AS p FROM {_judged(1500)}"""
    f1 = f"""cl AS ({classes}), lb AS (SELECT DISTINCT split, t AS label FROM cl), sc AS (SELECT lb.split, label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label) AS actual, count(*) FILTER (p = label) AS named FROM lb JOIN cl USING (split) GROUP BY 1, 2),
mf AS (SELECT split, round(avg(2 * tp / (actual + named)), 4) AS macro_f1, count(*) AS classes FROM sc GROUP BY 1)"""
    split = "CASE WHEN split = 0 THEN 'tuning' ELSE 'heldback' END"
    kinds = f"(SELECT {split} AS split, truth_category, truth_settled, CASE WHEN case_id % 3 <> 0 THEN 'x' END AS injection FROM {_judged(1500)})"
    runs = f"""{TRACE}, rn AS (SELECT conv_id, max(cycle) + 1 AS cycles, count(*) FILTER (kind IN ('tool', 'adaptive')) AS measurements, round(sum(ms) / 1000, 3) AS seconds, round(count(*) * 0.001::DOUBLE, 6) AS cost_usd, round(sum(CASE WHEN cycle > 0 THEN ms ELSE 0 END) / 1000, 3) AS seconds_after_first_cycle,
  round(count(*) FILTER (cycle > 0) * 0.001::DOUBLE, 6) AS cost_after_first_cycle, count(*) FILTER (kind = 'critic') > 0 AND count(*) FILTER (kind = 'critic' AND ms > 0) = 0 AS review_cost_missing FROM tr GROUP BY 1)"""
    of = lambda c, d: f"round(coalesce(sum({c}) FILTER (seconds > 0), 0), {d}) AS {c}"
    hybrid = BASE["hybrid_search"]
    alone = lambda name, source: f"SELECT '{name}' AS configuration, qid, id, round(1.0::DOUBLE / 61, 6) AS score FROM ({source}) WHERE rank = 1"
    ctes, last = hybrid.rsplit(" SELECT qid, id, round(score, 6) AS score, rank::INTEGER AS rank FROM re", 1)
    ranked = lambda name: f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM {name}"
    return {
        "findings_in_full": f"""WITH v AS (SELECT *, cause <> 'telemetry_gap' AS settled FROM ({ledger}))
SELECT system_id, window_id, 'plant::' || CASE WHEN settled THEN cause ELSE 'real_loss|telemetry_gap' END AS identity, CASE WHEN settled THEN array_to_string(list_transform(string_split(cause, '_'), lambda x: upper(x[1]) || x[2:]), ' ') ELSE 'Undecided: real_loss or telemetry_gap' END AS title, category,
  'new' AS lifecycle, settled, CASE WHEN settled THEN cause END AS cause, CASE WHEN settled THEN 0.5::DOUBLE END AS confidence, CASE WHEN settled THEN '' ELSE 'real_loss|telemetry_gap' END AS candidates, CASE WHEN NOT settled THEN 'profile_data_quality' END AS resolving_measurement,
  CASE WHEN window_id * 10.0 - 10 > 0 THEN round(window_id * 10.0::DOUBLE - 10, 3) ELSE 5.0 END::DOUBLE AS energy_at_stake_kwh, settled AS energy_verified,
  CASE category WHEN 'fault' THEN 'Send someone.' WHEN 'recoverable' THEN 'Schedule maintenance.' WHEN 'by_design' THEN 'Do nothing; the plant works as it was built.' ELSE 'Do nothing to the plant.' END AS recommended_action, NULL::VARCHAR AS refused FROM v""",
        "open_findings": f"""WITH {LOG}, st AS (SELECT identity, count(*) % 2 = 0 AS energy_verified, count(*)::DOUBLE AS energy_at_stake_kwh FROM (SELECT 'user' || (user_id % 50) AS identity FROM ev WHERE event_type = 'purchase' AND value >= 150) GROUP BY 1)
SELECT identity, lifecycle, misses, last, energy_verified, energy_at_stake_kwh, row_number() OVER (ORDER BY energy_verified DESC, energy_at_stake_kwh DESC, identity)::INTEGER AS rank FROM cu JOIN st USING (identity) WHERE lifecycle IN ('new', 'ongoing')""",
        "findings_since": f"WITH {LOG} SELECT identity, sweep, lifecycle, misses FROM lg WHERE sweep > 20 AND NOT (misses > 0 AND lifecycle <> 'resolved')",
        "lifecycle_counts": f"WITH {LOG} SELECT lifecycle, count(*) AS findings FROM cu GROUP BY 1",
        "sweep_clock": f"""WITH {LOG}, ch AS (SELECT sweep, count(*) FILTER (lifecycle = 'new') AS o, count(*) FILTER (lifecycle = 'resolved') AS r, count(*) AS n FROM lg WHERE NOT (misses > 0 AND lifecycle <> 'resolved') GROUP BY 1)
SELECT al.sweep::BIGINT AS sweep, coalesce(o, 0)::BIGINT AS opened, coalesce(r, 0)::BIGINT AS resolved, coalesce(n, 0)::BIGINT AS records FROM al LEFT JOIN ch ON ch.sweep = al.sweep""",
        "macro_f1_overall": f"WITH {f1} SELECT * FROM mf",
        "evaluation_targets": f"""WITH {f1}, rp AS ({BASE["case_report"]}), x AS (SELECT max(macro_f1) FILTER (split = 0) AS t, max(macro_f1) FILTER (split = 1) AS h FROM mf), y AS (SELECT max(false_alarm_rate) AS a, max(correct_abstention_rate) AS b, count(*) AS n FROM rp WHERE split = 1)
SELECT unnest(['macro_f1_at_least_0.75', 'false_alarm_rate_at_most_0.15', 'correct_abstention_at_least_0.70', 'overfitting_gap_at_most_0.10']) AS target,
  unnest(CASE WHEN n > 0 THEN [coalesce(h, 0) >= 0.75, coalesce(a <= 0.15, false), coalesce(b >= 0.70, false), abs(round(t - h, 4)) <= 0.10] ELSE [NULL, NULL, NULL, NULL] END) AS met, round(t - h, 4) AS overfitting_gap FROM x, y""",
        "case_composition": f"""SELECT split, count(*) AS cases, count(*) FILTER (truth_category = 'fault') AS faults, count(*) FILTER (truth_category = 'recoverable') AS recoverable, count(*) FILTER (truth_category = 'by_design') AS look_alikes,
  round(count(*) FILTER (truth_category = 'by_design') / count(*), 3) AS look_alike_share, count(*) FILTER (NOT truth_settled) AS unresolvable, count(*) FILTER (injection IS NULL) AS real_data_no_injection FROM {kinds} GROUP BY 1""",
        "subset_warnings": f"""WITH c AS (SELECT * FROM {kinds}), a AS (SELECT count(*) FILTER (truth_category = 'fault' AND truth_settled) AS s, count(*) AS n FROM c)
SELECT unnest(['subset: ' || s || ' of ' || n || ' cases', 'no unresolvable cases', 'no look-alikes', 'no cases of ' || (SELECT string_agg(DISTINCT truth_category, ', ' ORDER BY truth_category) FROM c WHERE truth_category <> 'fault')]) AS warning FROM a""",
        "record_coverage": """WITH c AS (SELECT (doc_id % 25)::INTEGER AS system_id, (DATE '2023-12-28' + (doc_id % 20)::INTEGER)::DATE AS a FROM labels), r AS (SELECT (user_id % 25)::INTEGER AS system_id, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events GROUP BY 1)
SELECT system_id, count(*) FILTER (a < lo OR (a + 20)::DATE > hi OR lo IS NULL) AS outside, count(*) AS cases, min(lo)::DATE AS first_day, max(hi)::DATE AS last_day FROM c LEFT JOIN r USING (system_id) GROUP BY 1 HAVING count(*) FILTER (a < lo OR (a + 20)::DATE > hi OR lo IS NULL) > 0""",
        "resume_cases": "SELECT doc_id AS case_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IS NOT NULL)",
        "derived_seeds": "SELECT n_nationkey, sha256(n_name || chr(0) || n_nationkey) AS hash, (('0x' || sha256(n_name || chr(0) || n_nationkey)[1:16])::UBIGINT % 2147483647)::BIGINT AS seed FROM nation",
        "cycle_profile": f"WITH {TRACE} SELECT conv_id, cycle, count(*) AS calls, round(sum(ms) / 1000, 3) AS seconds, round(count(*) * 0.001::DOUBLE, 6) AS cost_usd FROM tr GROUP BY 1, 2",
        "run_profiles": f"WITH {runs} SELECT * FROM rn",
        "run_summary": f"WITH {runs} SELECT count(*) AS runs, count(*) FILTER (seconds > 0) AS timed_runs, {of('seconds', 1)}, {of('cost_usd', 4)}, {of('seconds_after_first_cycle', 1)}, {of('cost_after_first_cycle', 4)} FROM rn",
        "investigation_list": f"""WITH {TRACE} SELECT conv_id, count(*) FILTER (kind IN ('tool', 'adaptive')) AS measurements, count(*) FILTER (kind = 'adaptive') AS unplanned, count(*) FILTER (kind = 'critic') AS review_cycles, round(count(*) * 0.001::DOUBLE, 4) AS cost_usd,
  count(*) AS tokens, round(sum(ms) / 1000, 1) AS seconds, count(*) AS steps, arg_max(text, step_index) FILTER (kind = 'answer') AS answer FROM tr GROUP BY 1""",
        "retrieval_ablation": f"""{ctes}, ab AS ({alone("bm25 only", ranked("bm"))} UNION ALL {alone("vectors only", ranked("co"))}
  UNION ALL SELECT 'hybrid, no rerank', qid, id, round(score, 6) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM fu) WHERE rank = 1 UNION ALL SELECT 'hybrid + rerank', qid, id, round(score, 6) FROM re WHERE rank = 1) SELECT * FROM ab""",
        "corpus_statistics": f"""WITH t AS (SELECT source, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: NOT list_contains(string_split('{STOP}', ' '), x))) AS n FROM documents)
SELECT source, 0::TINYINT AS all_sources, count(*) AS chunks, sum(n)::BIGINT AS tokens FROM t GROUP BY 1 UNION ALL SELECT NULL, 1::TINYINT, count(*), sum(n)::BIGINT FROM t""",
        "knowledge_corpus": "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'signature' ELSE 'test' END || ':' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'signature' ELSE 'test' END AS source, p_partkey || ' - ' || p_name || chr(10) || p_type AS text FROM part",
        "unrun_tools": """WITH a AS (SELECT DISTINCT conv_id, tool FROM conversations, unnest(['a', 'user', 'assistant', 'system', 'the']) AS t(tool) WHERE role = 'assistant' AND contains(lower(text), tool))
SELECT conv_id, tool FROM a WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = a.conv_id AND c.role = a.tool)""",
        "measurement_ledger": """WITH v AS (SELECT conv_id, turn, role, 'length' AS name, length(coalesce(text, ''))::DOUBLE AS value FROM conversations UNION ALL SELECT conv_id, turn, role, role, turn::DOUBLE FROM conversations)
SELECT conv_id, name, arg_max(role, turn) AS tool, arg_max(value, turn) AS value FROM v GROUP BY 1, 2""",
        "planned_calls": """SELECT conv_id, turn AS step_index, role AS tool, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = 0 AND p.role = c.role) AS was_planned FROM conversations c""",
        "excluded_hypotheses": """SELECT conv_id, 'H' || turn AS hypothesis_id, role AS cause, CASE WHEN EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = 2) AND (CASE WHEN conv_id % 2 = 0 THEN turn = 1 ELSE role = 'user' END) THEN 'excluded' ELSE 'open' END AS status FROM conversations c""",
        "narrowed_arguments": "SELECT conv_id, turn, role AS tool, CASE WHEN role = 'user' THEN 'start' ELSE 'metric,start' END AS kept FROM conversations",
        "describe_lineitem": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 2) AS mean, round(min({c})::DOUBLE, 2) AS min, round(max({c})::DOUBLE, 2) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    }


SQL = _fleet_sql() | _diagnosis_sql() | _evaluation_sql()
