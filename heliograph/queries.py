"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import detect, evaluate, findings, inject, knowledge, measures, prose, retrieval, scores, sun, views
from heliograph.sources import ingest, panels
from heliograph.sources.panels import in_windows, read, windows_of

KEYS = measures.KEYS
SPAN_DAYS = 14


def _windowed(spark: SparkSession, sf_dir: str, days: int = SPAN_DAYS) -> DataFrame:
    panel = panels.events_hourly(spark, sf_dir)
    return in_windows(panel, windows_of(panel, days))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole record of the daily panel with its year as the window."""
    return panels.lineitem_daily(spark, sf_dir).withColumn("window_id", F.year("day")).withColumn("pr", F.try_divide("ac_power_kw", "poa_wm2"))


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.lineitem_strings(spark, sf_dir).withColumn("window_id", F.year("day"))


def pr_window(spark, sf_dir):
    return measures.performance_ratio(_windowed(spark, sf_dir))


def pr_daily(spark, sf_dir):
    return measures.performance_ratio(_windowed(spark, sf_dir), keys=["system_id", "on_day"])


def expected_output(spark, sf_dir):
    return measures.expected_output(_windowed(spark, sf_dir))


def time_of_day_profile(spark, sf_dir):
    return measures.time_of_day_profile(_windowed(spark, sf_dir))


def dc_to_ac_conversion(spark, sf_dir):
    return measures.dc_to_ac(_windowed(spark, sf_dir))


def temperature_sensor(spark, sf_dir):
    return measures.temperature_sensor(_windowed(spark, sf_dir))


def ac_ceiling(spark, sf_dir):
    return measures.ac_ceiling(_windowed(spark, sf_dir), flatness=0.05, min_run=1)


def stuck_channels(spark, sf_dir):
    return measures.stuck_channels(_windowed(spark, sf_dir), ["poa_wm2", "temp_module_c", "wind_speed_ms"], min_run=2, tolerance=0.5)


def data_quality(spark, sf_dir):
    return measures.data_quality(_windowed(spark, sf_dir))


def daily_completeness(spark, sf_dir):
    return measures.daily_completeness(panels.events_hourly(spark, sf_dir))


def onset_changepoint(spark, sf_dir):
    return measures.onset(_daily(spark, sf_dir), "ac_power_kw", KEYS)


def performance_trend(spark, sf_dir):
    return measures.trend(_daily(spark, sf_dir), "pr", KEYS, recovery_step=0.01)


def soiling_recovery(spark, sf_dir):
    return measures.soiling_recovery(_daily(spark, sf_dir).withColumn("insolation", F.col("poa_wm2")), KEYS, wash_quantile=0.7)


def string_balance(spark, sf_dir):
    return measures.string_balance(_strings(spark, sf_dir), KEYS)


def string_profiles(spark, sf_dir):
    return measures.string_profiles(_strings(spark, sf_dir), KEYS)


def string_onset(spark, sf_dir):
    return measures.string_onset(_strings(spark, sf_dir), KEYS)


def trailing_baseline(spark, sf_dir):
    days = panels.lineitem_daily(spark, sf_dir)
    return measures.trailing_baseline(days, windows_of(days, 60, "day"))


def weather_context(spark, sf_dir):
    days = panels.lineitem_daily(spark, sf_dir)
    return measures.weather_context(days, windows_of(days, 60, "day"))


def _inside(lo: str = "2024-01-08", hi: str = "2024-01-20"):
    return (F.col("ts") >= F.lit(lo).cast("timestamp")) & (F.col("ts") <= F.lit(hi).cast("timestamp"))


def _injected(frame: DataFrame) -> DataFrame:
    return frame.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("poa_wm2"), 4).alias("poa"), F.round(F.sum("ac_power_kw"), 4).alias("ac"), F.round(F.sum("dc_power_kw"), 4).alias("dc"))


def inject_outage(spark, sf_dir):
    return _injected(inject.outage(panels.events_hourly(spark, sf_dir), _inside(), 1 / 7, 0.8))


def inject_shading(spark, sf_dir):
    return _injected(inject.shading(panels.events_hourly(spark, sf_dir), _inside(), 6, 10, 0.5, 2))


def inject_soiling(spark, sf_dir):
    return _injected(inject.soiling(panels.events_hourly(spark, sf_dir), _inside(), 0.01, 0.05))


def inject_cap(spark, sf_dir):
    return _injected(inject.power_cap(panels.events_hourly(spark, sf_dir), _inside(), 500.0))


def inject_drift(spark, sf_dir):
    return _injected(inject.sensor_drift(panels.events_hourly(spark, sf_dir), _inside(), -0.004, 0.1))


def inject_gap(spark, sf_dir):
    return _injected(inject.telemetry_gap(panels.events_hourly(spark, sf_dir), _inside()))


def _ledger(spark, sf_dir, days: int = 7) -> DataFrame:
    """One wide row of measures for each window: all that the detectors and rules ask for."""
    # one scan: the hourly panel is far smaller than the events, and kept; a lost part is computed anew
    panel = panels.events_hourly(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    windows = windows_of(panel, days)
    rows = in_windows(panel, windows)
    by_day = panel.groupBy("system_id", F.to_date("ts").alias("day")).agg(F.sum("poa_wm2").alias("poa_wm2"), F.sum("ac_power_kw").alias("ac_power_kw"))
    daily_pr = measures.performance_ratio(rows, keys=[*KEYS, "on_day"])
    balance = measures.string_balance(measures.in_windows_days(panels.events_strings(spark, sf_dir), windows), KEYS)
    sky = sun.clearsky_consistency(rows)
    parts = (
        measures.performance_ratio(rows).select(*KEYS, "pr", "data_completeness"),
        measures.expected_output(rows).select(*KEYS, "deficit_fraction", (F.col("deficit_second_half") - F.col("deficit_first_half")).alias("deficit_change")),
        measures.ac_ceiling(rows, flatness=0.05, min_run=1).select(*KEYS, "flat_ceiling_share"),
        measures.time_of_day_profile(rows).groupBy(*KEYS).agg((F.max("shape") - F.min("shape")).alias("shape_spread")),
        sky.select(*KEYS, F.least("clear_days_first_half", "clear_days_second_half").alias("clear_days"), "ratio_change_per_day", "shortfall_vs_clearsky"),
        measures.trend(daily_pr, "pr_temperature_corrected", KEYS, order="on_day").select(*KEYS, "slope_per_day"),
        measures.trailing_baseline(by_day, windows).select(*KEYS, "change"), measures.weather_context(by_day, windows).select(*KEYS, "relative_to_norm"),
        balance.groupBy(*KEYS).agg(F.max("below_even").alias("string_deficit")),
    )
    ledger = measures.data_quality(rows)
    for part in parts:
        ledger = ledger.join(part, KEYS, "left")
    return ledger


def measure_ledger(spark, sf_dir):
    wanted = "lit_interval_completeness coverage pr data_completeness deficit_fraction deficit_change flat_ceiling_share shape_spread clear_days slope_per_day change string_deficit"
    return _ledger(spark, sf_dir).select(*KEYS, *(F.round(c, 5).alias(c) for c in wanted.split()))


def sweep_signals(spark, sf_dir):
    return detect.signals(_ledger(spark, sf_dir))


def rules_verdict(spark, sf_dir):
    return detect.verdicts(_ledger(spark, sf_dir))


def findings_lifecycle(spark, sf_dir):
    """Sweeps are days; a user with a purchase of 150 or more that day, in one of 50 groups, is a finding."""
    events = read(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("sweep"), "user_id", "event_type", "value")
    seen = events.where("event_type = 'purchase' and value >= 150").select(F.concat(F.lit("user"), (F.col("user_id") % 50).cast("string")).alias("identity"), "sweep")
    return findings.current(findings.lifecycle(seen, events.select("sweep").distinct()))


def _texts(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return chunks, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


def bm25_search(spark, sf_dir):
    chunks, queries_ = _texts(spark, sf_dir)
    return retrieval.bm25(chunks, queries_, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def hybrid_search(spark, sf_dir):
    """BM25 and n-gram rankings of the conversations for the benchmark items, fused and reranked."""
    chunks = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    queries_ = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    rankings = [retrieval.bm25(chunks, queries_, 30), retrieval.ngram_cosine(chunks, queries_, 30)]
    return retrieval.rerank(retrieval.fuse(rankings), chunks, queries_, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _cases(spark, sf_dir):
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") > 1500).cast("int").alias("predicted"))


def macro_f1(spark, sf_dir):
    return evaluate.macro_f1(_cases(spark, sf_dir))


def confusion(spark, sf_dir):
    return evaluate.confusion(_cases(spark, sf_dir), [0, 1]).withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})


def split_attempts(spark, sf_dir):
    trace = read(spark, sf_dir, "conversations").withColumn("step", F.col("turn") % 3)
    return evaluate.attempts(trace, "conv_id", "turn", "step").groupBy("conv_id").agg((F.max("attempt") + 1).alias("attempts"), F.count("*").alias("steps"))


def clearsky_consistency(spark, sf_dir):
    return sun.clearsky_consistency(_windowed(spark, sf_dir))


def night_offset(spark, sf_dir):
    return sun.night_offset(_windowed(spark, sf_dir))


def utc_offset_curve(spark, sf_dir):
    return sun.offset_curve(panels.events_hourly(spark, sf_dir).where("poa_wm2 is not null"))


def utc_offset(spark, sf_dir):
    return sun.utc_offset(panels.events_hourly(spark, sf_dir))


def flatline(spark, sf_dir):
    rounded = _windowed(spark, sf_dir).withColumn("temp_module_c", F.round("temp_module_c", -1)).withColumn("wind_speed_ms", F.round("wind_speed_ms", 0))
    return measures.flatline(rounded, ["poa_wm2", "temp_module_c", "wind_speed_ms"], min_run=3)


def string_balance_history(spark, sf_dir):
    """Each string's mean share in windows of 60 days beside its share over the record before them."""
    strings = panels.lineitem_strings(spark, sf_dir)
    now, before = measures.string_history(strings, windows_of(strings, 60, "day"))
    return measures.against_history(measures.string_balance(now, KEYS), measures.string_balance(before, KEYS), "mean_share", KEYS)


def string_profiles_history(spark, sf_dir):
    strings = panels.lineitem_strings(spark, sf_dir)
    now, before = measures.string_history(strings, windows_of(strings, 60, "day"))
    return measures.against_history(measures.string_profiles(now, KEYS), measures.string_profiles(before, KEYS), "level", KEYS)


def _raw(spark, sf_dir):
    """The hourly panel under the names of a raw logger, with rivals in wrong units."""
    panel = panels.events_hourly(spark, sf_dir)
    return panel.select(
        "system_id", "ts", F.col("poa_wm2").alias("irradiance_poa_o_1"), (F.col("poa_wm2") / 100).alias("irradiance_poa_o_2"), F.col("temp_ambient_c").alias("temperature_ambient_o_1"), F.col("temp_module_c").alias("temperature_module_o_1"),
        (F.lit(292.0)).alias("wind_speed_o_1"), F.col("wind_speed_ms").alias("wind_speed_o_2"), F.col("ac_power_kw").alias("ac_power_inv_1"), F.col("dc_power_kw").alias("dc_power_inv_1"), F.lit(None).cast("double").alias("dc_power_inv_2"),
    )


def channel_resolution(spark, sf_dir):
    return ingest.resolve(_raw(spark, sf_dir)).withColumn("highest", F.round("highest", 6))


def ingest_normalised(spark, sf_dir):
    """Raw events as logger rows five hours behind UTC: first per instant, masked, in 15-minute means, in UTC."""
    raw = read(spark, sf_dir, "events").select(F.lit(1).alias("system_id"), "event_id", F.date_trunc("minute", "ts").cast("timestamp").alias("ts"), (F.col("value") - 30).alias("poa_wm2"), (F.col("value") - 10).alias("ac_power_kw"))
    rows = ingest.resampled(ingest.masked(ingest.first_per_instant(raw, "event_id"), 100.0), ["poa_wm2", "ac_power_kw"])
    return ingest.to_utc(rows, -5.0).select("system_id", F.unix_timestamp("ts").alias("second"), F.round("poa_wm2", 6).alias("poa_wm2"), F.round("ac_power_kw", 6).alias("ac_power_kw"))


def document_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return prose.chunks(docs, "doc_id").select("id", "chunk_no", "chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def numeric_grounding(spark, sf_dir):
    """Every event as an answer: its value in full, a value in tenths that is off for two of three, and its id."""
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("n"))
    tenths = F.expr("n div 10 + id % 3")
    full = F.concat(F.expr("n div 100").cast("string"), F.lit("."), F.lpad(F.expr("n % 100").cast("string"), 2, "0"))
    near = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    text = F.concat_ws(" ", F.lit("In step 30"), "event_type", F.col("id").cast("string"), F.lit("read"), full, F.lit("units, about"), near)
    return prose.grounding(events.where("value is not null").withColumn("text", text), events.select("id", "value"), "id")


def retrieval_quality(spark, sf_dir):
    """BM25 against the documents that hold an item's first eight words in a row, whether it found them or not."""
    chunks, queries_ = _texts(spark, sf_dir)
    hits = retrieval.bm25(chunks, queries_, 10).select("qid", "id", "rank")
    relevant = scores.holding(chunks, queries_, 8).select("qid", "id", (F.col("qid") % 3).cast("string").alias("kind"))
    return prose.retrieval_quality(hits, relevant)


def _judged(spark, sf_dir, longest: int = 1500):
    """Labels as cases: quality is the category's side, toxic cases are unresolvable; the length of the text predicts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    cases = read(spark, sf_dir, "labels").join(docs, "doc_id")
    category = lambda c: F.when(c % 3 == 0, "fault").when(c % 3 == 1, "by_design").otherwise("recoverable")
    return cases.select(
        F.col("doc_id").alias("case_id"), (F.col("doc_id") % 2).alias("split"), category(F.col("doc_id")).alias("truth_category"), F.col("quality").cast("string").alias("truth_cause"), (F.col("toxic") == 0).alias("truth_settled"),
        category(F.col("n_chars") + longest).alias("category"), (F.col("n_chars") > longest).cast("int").cast("string").alias("cause"), (F.col("n_chars") % 7 != 0).alias("settled"),
    )


def case_report(spark, sf_dir):
    return evaluate.report(evaluate.scored(_judged(spark, sf_dir)), ["split"])


def disagreements(spark, sf_dir):
    a, b = (evaluate.scored(_judged(spark, sf_dir, n)) for n in (1500, 400))
    return evaluate.disagreements(a, b)


def repeated_runs(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("run"), F.col("value").cast("decimal(18,4)").alias("value"))
    means = runs.groupBy("event_type", "run").agg((F.sum("value").cast("double") / F.count("*")).alias("score"))
    return evaluate.repeats(means, ["event_type"], "score")


def stratified_subset(spark, sf_dir):
    return evaluate.stratified(read(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id", 60)


def trace_profile(spark, sf_dir):
    trace = read(spark, sf_dir, "conversations").select((F.col("conv_id") % 2).alias("part"), F.col("role").alias("node"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("latency_ms"), F.lit(0.001).cast("decimal(10,3)").alias("cost_usd"), F.lit(1).cast("long").alias("tokens"))
    return evaluate.profile(trace, ["part"]).withColumn("cost_usd", F.col("cost_usd").cast("double"))


def sweep_findings(spark, sf_dir):
    ledger = _ledger(spark, sf_dir)
    return findings.from_verdicts(detect.signals(ledger), detect.verdicts(ledger), F.lit("plant"))


def recent_rows(spark, sf_dir):
    return views.recent(panels.events_hourly(spark, sf_dir))


def pr_weekly(spark, sf_dir):
    return views.pr_series(panels.events_hourly(spark, sf_dir), "1W")


def string_map(spark, sf_dir):
    return views.string_map(panels.lineitem_strings(spark, sf_dir))


def expected_scatter(spark, sf_dir):
    return views.scatter(panels.events_hourly(spark, sf_dir))


def gap_calendar(spark, sf_dir):
    return views.gap_calendar(panels.events_hourly(spark, sf_dir))


def plant_summary(spark, sf_dir):
    return views.plant_summary(panels.events_hourly(spark, sf_dir))


def latest_plan(spark, sf_dir):
    return views.latest_plan(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role = 'assistant'")


def knowledge_match(spark, sf_dir):
    """Benchmark items as free-text causes, conversation turns as the signatures they may name."""
    phrases = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lit(0).alias("phrase_no"), F.col("text").alias("phrase"))
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    return knowledge.match(phrases, turns.select("key", F.col("key").alias("position"), F.col("text").alias("plain_name")))


def rule_lint(spark, sf_dir):
    """Events as sentences: three of four read as a rule, the others state a value."""
    events = read(spark, sf_dir, "events").where("value is not null").select("event_id", "event_type", F.floor("value").cast("string").alias("n"))
    kind = F.col("event_id") % 4
    words = F.when(kind == 0, F.concat(F.lit("> "), "n")).when(kind == 1, F.concat(F.lit("less than "), "n")).when(kind == 2, F.concat(F.lit("above "), "n", F.lit(" %"))).otherwise(F.concat(F.lit("read "), "n"))
    return knowledge.rule_like(events.withColumn("text", F.concat_ws(" ", "event_type", words)), "event_id")


NAMES = (
    pr_window, pr_daily, expected_output, time_of_day_profile, dc_to_ac_conversion, temperature_sensor, ac_ceiling, stuck_channels, data_quality, daily_completeness, onset_changepoint, performance_trend,
    soiling_recovery, string_balance, string_profiles, string_onset, trailing_baseline, weather_context, inject_outage, inject_shading, inject_soiling, inject_cap, inject_drift, inject_gap, sweep_signals,
    rules_verdict, findings_lifecycle, bm25_search, hybrid_search, macro_f1, confusion, split_attempts, clearsky_consistency, night_offset, utc_offset_curve, utc_offset, flatline,
    string_balance_history, string_profiles_history, channel_resolution, ingest_normalised, document_chunks, numeric_grounding, retrieval_quality, case_report, disagreements, repeated_runs,
    stratified_subset, trace_profile, sweep_findings, measure_ledger, recent_rows, pr_weekly, string_map, expected_scatter, gap_calendar, plant_summary, latest_plan, knowledge_match, rule_lint,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from heliograph import fleet

    return {f.__name__: f for f in (*NAMES, *fleet.NAMES)}


def oracle_sql() -> dict[str, str]:
    from heliograph import fleet_sql
    from heliograph.oracles import SQL

    return dict(SQL) | fleet_sql.SQL
