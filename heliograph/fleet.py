"""Registered queries over many plants, investigations and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import detect, diagnosis, evaluate, findings, inject, investigation, measures, quality, retrieval, views
from heliograph.queries import KEYS, _cases, _daily, _inside, _judged, _ledger, _strings, _texts
from heliograph.sources import files, panels, plants
from heliograph.sources.panels import in_windows, read, windows_of

CHANNELS = ["poa_wm2", "ac_power_kw", "temp_ambient_c", "temp_module_c", "wind_speed_ms"]


def _fleet(spark: SparkSession, sf_dir: str, days: int = 14) -> DataFrame:
    panel = plants.events_by_system(spark, sf_dir)
    return plants.with_plant(in_windows(panel, windows_of(panel, days)), plants.stored_plants(spark, sf_dir))


def plant_dimension(spark, sf_dir):
    return plants.stored_plants(spark, sf_dir).withColumn("gamma", F.round("gamma", 6))


def plant_metadata(spark, sf_dir):
    """Nations' records as metadata JSON, some with fields that are absent or no numbers."""
    nation = read(spark, sf_dir, "nation")
    text = F.concat(
        F.lit('{"System": {"public_name": "'), "n_name", F.lit('", "power": "'), F.when(F.col("n_nationkey") % 4 == 3, "unknown").otherwise((F.col("n_nationkey") * 10).cast("string")),
        F.lit('"}, "Site": {"latitude": "40.5", "location": " Site '), F.col("n_nationkey").cast("string"), F.lit(' "}, "Mount": {"Mount 0": {"tilt": "25"'), F.when(F.col("n_nationkey") % 2 == 0, ', "azimuth": "170", "tracking": "true"').otherwise(""),
        F.lit('}, "Mount 1": {"tilt": "99"}}, "Inverters": {"Inverter 0": {"model": "PVP '), (F.col("n_nationkey") * 10).cast("string"), F.lit('kW", "num_strings": "7"}}, "Modules": {}}'),
    )
    out = plants.metadata(nation.select(F.col("n_nationkey").alias("system_id"), text.alias("record")))
    return out.select("system_id", "name", "latitude", "longitude", "location", "dc_capacity_kw", "tilt_deg", "azimuth_deg", "tracking", "module_quantity", "strings", "inverter_model", "ac_capacity_kw_hint")


def fleet_pr(spark, sf_dir):
    return plants.measured(measures.performance_ratio, _fleet(spark, sf_dir), KEYS)


def fleet_expected_output(spark, sf_dir):
    return plants.measured(measures.expected_output, _fleet(spark, sf_dir), KEYS)


def fleet_time_of_day(spark, sf_dir):
    return plants.measured(measures.time_of_day_profile, _fleet(spark, sf_dir), KEYS)


def fleet_dc_to_ac(spark, sf_dir):
    return plants.measured(measures.dc_to_ac, _fleet(spark, sf_dir), KEYS)


def fleet_data_quality(spark, sf_dir):
    return plants.measured(measures.data_quality, _fleet(spark, sf_dir), KEYS)


def fleet_residual(spark, sf_dir):
    """Measured less expected energy by system and day."""
    rows = plants.measured(lambda r, plant, keys: measures.with_expectation(r, plant), _fleet(spark, sf_dir), KEYS)
    return rows.groupBy("system_id", "on_day").agg(F.round(F.sum(F.col("ac_power_kw") - F.col("expected_kw")), 4).alias("residual_kw"), F.count("*").alias("intervals"))


def ac_ceiling_default(spark, sf_dir):
    return measures.ac_ceiling(_fleet(spark, sf_dir).drop(*plants.PLANT_COLUMNS))


def stuck_channels_default(spark, sf_dir):
    return measures.stuck_channels(_fleet(spark, sf_dir), ["poa_wm2", "temp_ambient_c", "wind_speed_ms"])


def _series(spark, sf_dir, freq, unit):
    return views.pr_series(plants.events_by_system(spark, sf_dir, unit), freq)


def pr_monthly(spark, sf_dir):
    return _series(spark, sf_dir, "1ME", "hour")


def pr_hourly(spark, sf_dir):
    from heliograph.queries import read as table

    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    rows = table(spark, sf_dir, "events").groupBy(F.lit(1).alias("system_id"), F.date_trunc("minute", "ts").cast("timestamp").alias("ts"))
    panel = rows.agg(
        panels.exact_sum(F.col("value")).alias("poa_wm2"), panels.exact_sum(of("purchase")).alias("ac_power_kw"), F.lit(None).cast("double").alias("temp_module_c"), F.lit(20.0).alias("temp_ambient_c"), F.lit(1.0).alias("wind_speed_ms"),
    )
    return views.pr_series(panel, "1H")


def quality_issues(spark, sf_dir):
    rows = _fleet(spark, sf_dir)
    return quality.issues(rows, CHANNELS, F.col("capacity_kw"), min_run=3)


def quality_profile(spark, sf_dir):
    rows = _fleet(spark, sf_dir)
    return quality.profile(rows, quality.issues(rows, CHANNELS, F.col("capacity_kw")))


def string_balance_summary(spark, sf_dir):
    return quality.balance_summary(_strings(spark, sf_dir), KEYS)


def trailing_windows(spark, sf_dir):
    return diagnosis.trailing_windows(plants.events_by_system(spark, sf_dir))


def trailing_baseline_corrected(spark, sf_dir):
    """Sweeps every seven days look at the fourteen days before them, against the thirty days before those."""
    panel = panels.events_hourly(spark, sf_dir)
    return diagnosis.baseline(panel, diagnosis.trailing_windows(panel, days=7, step=3), baseline_days=14)


def onset_in_full(spark, sf_dir):
    return diagnosis.onset_in_full(_daily(spark, sf_dir), "ac_power_kw", KEYS)


def trend_ends(spark, sf_dir):
    return diagnosis.trend_ends(_daily(spark, sf_dir), "pr", KEYS, recovery_step=0.01)


def weather_in_full(spark, sf_dir):
    days = panels.lineitem_daily(spark, sf_dir)
    return diagnosis.weather(days, windows_of(days, 60, "day"))


def string_onset_scan(spark, sf_dir):
    strings = _strings(spark, sf_dir)
    return diagnosis.most_changed(measures.string_onset(strings, KEYS), strings, KEYS)


def _hourly_strings(spark, sf_dir):
    index = (F.col("user_id") % 7 + 1).cast("int").alias("string_idx")
    rows = read(spark, sf_dir, "events").where("event_type = 'signup' and user_id is not null")
    return rows.groupBy(F.lit(1).alias("system_id"), F.date_trunc("hour", "ts").cast("timestamp").alias("ts"), index).agg(panels.exact_sum(F.col("value")).alias("current_a"))


def inject_string_outage(spark, sf_dir):
    """The plant loses what the strings say one of them is worth."""
    plant, _ = inject.outage_of_string(panels.events_hourly(spark, sf_dir), _hourly_strings(spark, sf_dir), _inside(), 3)
    return plant.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("ac_power_kw"), 4).alias("ac"), F.round(F.sum("dc_power_kw"), 4).alias("dc"))


def _by_string(frame):
    return frame.groupBy(F.to_date("ts").alias("day"), "string_idx").agg(F.round(F.sum("current_a"), 4).alias("current_a"))


def inject_string_shading(spark, sf_dir):
    return _by_string(inject.shaded_strings(_hourly_strings(spark, sf_dir), _inside(), 6, 10, 0.5, 6, 3))


def inject_string_soiling(spark, sf_dir):
    return _by_string(inject.soiled_strings(_hourly_strings(spark, sf_dir), panels.events_hourly(spark, sf_dir), _inside(), 0.01, 0.05))


def energy_removed(spark, sf_dir):
    panel = panels.events_hourly(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return diagnosis.energy_removed(panel, inject.power_cap(panel, _inside(), 500.0), 1.0, ["system_id", "day"])


def findings_in_full(spark, sf_dir):
    """Rule verdicts as findings; a window told by telemetry alone is left undecided between two causes."""
    v = detect.verdicts(_ledger(spark, sf_dir)).withColumn("settled", F.col("cause") != "telemetry_gap")
    pair = F.array(F.lit("telemetry_gap"), F.lit("real_loss"))
    v = v.withColumn("candidate_causes", F.when(~F.col("settled"), pair)).withColumn("resolving_measurement", F.when(~F.col("settled"), "profile_data_quality")).withColumn("confidence", F.lit(None).cast("double"))
    return findings.build(v.withColumn("deficit_kwh", F.col("window_id") * 10.0 - 10).withColumn("shortfall_kwh", F.lit(5.0)), F.lit("plant"))


def _log(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("sweep"), "user_id", "event_type", "value")
    seen = events.where("event_type = 'purchase' and value >= 150").select(F.concat(F.lit("user"), (F.col("user_id") % 50).cast("string")).alias("identity"), "sweep")
    return findings.lifecycle(seen, events.select("sweep").distinct()), seen, events


def open_findings(spark, sf_dir):
    log, seen, _ = _log(spark, sf_dir)
    stakes = seen.groupBy("identity").agg((F.count("*") % 2 == 0).alias("energy_verified"), F.count("*").cast("double").alias("energy_at_stake_kwh"))
    return findings.open_findings(log, stakes)


def findings_since(spark, sf_dir):
    return findings.since(_log(spark, sf_dir)[0], 20)


def lifecycle_counts(spark, sf_dir):
    return findings.counts(_log(spark, sf_dir)[0])


def sweep_clock(spark, sf_dir):
    log, _, events = _log(spark, sf_dir)
    return findings.clock(events.select("sweep"), log)


def macro_f1_overall(spark, sf_dir):
    return evaluate.macro_f1_overall(_judged(spark, sf_dir), ["split"])


def _splits(spark, sf_dir):
    return _judged(spark, sf_dir).withColumn("split", F.when(F.col("split") == 0, "tuning").otherwise("heldback")).withColumn("injection", F.when(F.col("case_id") % 3 != 0, "x"))


def evaluation_targets(spark, sf_dir):
    rows = _splits(spark, sf_dir)
    report = evaluate.report(evaluate.scored(rows), ["split"]).join(evaluate.macro_f1_overall(rows, ["split"]), "split")
    return evaluate.targets(report)


def case_composition(spark, sf_dir):
    return evaluate.composition(_splits(spark, sf_dir))


def subset_warnings(spark, sf_dir):
    rows = _splits(spark, sf_dir)
    return evaluate.subset_warnings(rows.where("truth_category = 'fault' and truth_settled"), rows)


def record_coverage(spark, sf_dir):
    """Cases of 20 days from various days on, against each system's record."""
    start = F.date_add(F.lit("2023-12-28").cast("date"), (F.col("doc_id") % 20).cast("int"))
    cases = read(spark, sf_dir, "labels").select((F.col("doc_id") % 25).cast("int").alias("system_id"), start.alias("start_day"), F.date_add(start, 20).alias("end_day"))
    return evaluate.outside_record(cases, plants.events_by_system(spark, sf_dir))


def resume_cases(spark, sf_dir):
    cases = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), "quality")
    journal = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("case_id"))
    return evaluate.remaining(cases, journal)


def derived_seeds(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    return read(spark, sf_dir, "nation").select("n_nationkey", evaluate.stable_hash(F.col("n_name"), key).alias("hash"), evaluate.derived_seed(F.col("n_name"), key).alias("seed"))


def _trace(spark, sf_dir):
    kind = F.when(F.col("turn") == 0, "plan").when(F.col("role") == "assistant", F.when(F.col("turn") % 4 == 1, "tool").otherwise("answer")).when(F.col("turn") % 4 == 2, "adaptive").otherwise("critic")
    latency = F.when(F.col("conv_id") % 5 == 0, 0).otherwise(F.length(F.coalesce("text", F.lit("")))).cast("long")
    cost = F.lit(0.001).cast("decimal(10,3)")
    return read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("step_index"), kind.alias("kind"), "text", F.when(F.col("turn") > 0, F.floor(F.col("turn") / 3).cast("int")).alias("cycle"), latency.alias("latency_ms"), cost.alias("cost_usd"), F.lit(1).cast("long").alias("tokens"))


def cycle_profile(spark, sf_dir):
    return evaluate.by_cycle(_trace(spark, sf_dir), ["conv_id"]).withColumn("cost_usd", F.col("cost_usd").cast("double"))


def run_profiles(spark, sf_dir):
    return evaluate.runs(_trace(spark, sf_dir), ["conv_id"]).withColumns({c: F.col(c).cast("double") for c in ("cost_usd", "cost_after_first_cycle")})


def run_summary(spark, sf_dir):
    return evaluate.run_summary(run_profiles(spark, sf_dir))


def investigation_list(spark, sf_dir):
    return evaluate.investigations(_trace(spark, sf_dir), "conv_id").withColumn("cost_usd", F.col("cost_usd").cast("double"))


def retrieval_ablation(spark, sf_dir):
    """Every configuration of the search over the conversations; by configuration, queries answered and their first hits."""
    chunks = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    found = retrieval.ablation(chunks, asked)
    return found.where("rank = 1").select("configuration", "qid", "id", F.round("score", 6).alias("score"))


def corpus_statistics(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.corpus_stats(chunks, "source")


def knowledge_corpus(spark, sf_dir):
    entries = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "signature").otherwise("test").alias("kind"), F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("plain_name"), F.col("p_type").alias("body"))
    return retrieval.knowledge_chunks(entries)


def unrun_tools(spark, sf_dir):
    """Words that answers name and their conversation's other turns never call."""
    turns = read(spark, sf_dir, "conversations")
    calls = turns.select("conv_id", F.col("role").alias("tool"))
    return investigation.unrun(turns.where("role = 'assistant'").select("conv_id", F.lower("text").alias("text")), ["a", "user", "assistant", "system", "the"], calls, "conv_id")


def measurement_ledger(spark, sf_dir):
    values = F.create_map(F.lit("length"), F.length(F.coalesce("text", F.lit(""))).cast("double"), F.col("role"), F.col("turn").cast("double"))
    return investigation.ledger(read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("step_index"), F.col("role").alias("tool"), values.alias("values")), "conv_id")


def planned_calls(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return investigation.was_planned(turns.select("conv_id", F.col("turn").alias("step_index"), F.col("role").alias("tool")), turns.where("turn = 0").select("conv_id", F.col("role").alias("tool")), "conv_id")


def excluded_hypotheses(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    causes = turns.select("conv_id", F.concat(F.lit("H"), F.col("turn").cast("string")).alias("hypothesis_id"), F.col("role").alias("cause"), F.lit("open").alias("status"))
    out = turns.where("turn = 2").select("conv_id", F.when(F.col("conv_id") % 2 == 0, "H1").otherwise("user").alias("excluded"))
    return investigation.excluded(causes, out, "conv_id")


def narrowed_arguments(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("tool"), F.create_map(F.lit("start"), F.col("turn").cast("string"), F.lit("metric"), F.col("role")).alias("args"))
    accepted = spark.sql("SELECT 'user' AS tool, array('start') AS fields")
    return investigation.narrowed(turns, accepted).select("conv_id", "turn", "tool", F.array_join(F.array_sort(F.map_keys("args")), ",").alias("kept"))


def describe_lineitem(spark, sf_dir):
    return files.describe(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


NAMES = (
    plant_dimension, plant_metadata, fleet_pr, fleet_expected_output, fleet_time_of_day, fleet_dc_to_ac, fleet_data_quality, fleet_residual, ac_ceiling_default, stuck_channels_default, pr_monthly, pr_hourly, quality_issues, quality_profile,
    string_balance_summary, trailing_windows, trailing_baseline_corrected, onset_in_full, trend_ends, weather_in_full, string_onset_scan, inject_string_outage, inject_string_shading, inject_string_soiling, energy_removed, findings_in_full,
    open_findings, findings_since, lifecycle_counts, sweep_clock, macro_f1_overall, evaluation_targets, case_composition, subset_warnings, record_coverage, resume_cases, derived_seeds, cycle_profile, run_profiles, run_summary,
    investigation_list, retrieval_ablation, corpus_statistics, knowledge_corpus, unrun_tools, measurement_ledger, planned_calls, excluded_hypotheses, narrowed_arguments, describe_lineitem,
)
