"""The rule cascade, the knowledge base and the lifecycle in the stream, against plain Python."""

import itertools
import re

import pytest

from heliograph.operators import detect, findings, knowledge, views


def cascade(m):
    d = lambda k, v=0.0: v if m.get(k) is None else m[k]
    if min(d("lit_interval_completeness", 1.0), d("coverage", 1.0), d("data_completeness", 1.0)) < 0.8 or m["pr"] is None:
        return "telemetry_gap"
    if d("clear_days") >= 3 and (d("ratio_change_per_day") < -0.004 or d("shortfall_vs_clearsky") > 0.12):
        return "sensor_drift"
    if d("flat_ceiling_share") > 0.02:
        return "clipping"
    if d("string_deficit") > 0.22:
        return "shading" if d("shape_spread") > 0.25 else "string_outage"
    if d("relative_to_norm", 1.0) < 0.85:
        return "weather"
    return "soiling" if d("slope_per_day") < -0.0015 or d("deficit_change") > 0.04 or d("deficit_fraction") > 0.05 else "seasonal_temperature_derating"


def test_cascade(spark):
    values = {"coverage": (None, 0.7), "pr": (None, 0.8), "clear_days": (2.0, 3.0), "shortfall_vs_clearsky": (None, 0.2), "flat_ceiling_share": (None, 0.03), "string_deficit": (0.22, 0.3), "shape_spread": (None, 0.3), "relative_to_norm": (None, 0.8), "deficit_change": (0.04, 0.05)}
    rows = [(1, i, *v) for i, v in enumerate(itertools.product(*values.values()))]
    ledger = spark.createDataFrame(rows, "system_id int, window_id int, " + ", ".join(f"{k} double" for k in values))
    got = {r["window_id"]: r["cause"] for r in detect.verdicts(ledger).collect()}
    assert got == {r[1]: cascade(dict(zip(values, r[2:], strict=True))) for r in rows} and len(set(got.values())) == 8


def test_users_marks_stick(spark):
    state = spark.createDataFrame([("ack", "acknowledged", 0), ("quiet", "suppressed", 0), ("gone", "resolved", 3), ("old", "ongoing", 2)], "identity string, lifecycle string, misses int")
    seen = spark.createDataFrame([("ack", 10), ("quiet", 10), ("gone", 10), (None, 11), ("fresh", 11)], "identity string, sweep long")
    after = {r["identity"]: (r["lifecycle"], r["misses"]) for r in findings.state_after(seen, seen.select("sweep").distinct(), state).collect()}
    assert after == {"ack": ("acknowledged", 1), "quiet": ("suppressed", 0), "gone": ("ongoing", 1), "old": ("resolved", 3), "fresh": ("new", 0)}
    assert findings.marked(state, ["old"], "suppressed").where("identity = 'old'").first()["lifecycle"] == "suppressed"
    with pytest.raises(ValueError):
        findings.marked(state, ["old"], "resolved")


def test_watch_equals_batch(spark, tmp_path):
    from heliograph.streaming import sweep

    rows = [("a", 0), ("b", 0), ("a", 1), (None, 2), ("b", 3), (None, 4), (None, 5), (None, 6), ("b", 7)]
    frame = lambda part: spark.createDataFrame(part, "identity string, sweep long").coalesce(1)
    for k in range(3):
        frame([r for r in rows if r[1] // 3 == k]).write.mode("append").parquet(str(tmp_path / "in"))
        query = sweep.watch(spark.readStream.schema("identity string, sweep long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
    streamed = spark.read.parquet(str(tmp_path / "out" / "log")).select("identity", "sweep", "lifecycle", "misses")
    batch = findings.lifecycle(frame(rows), spark.range(8).withColumnRenamed("id", "sweep"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def long_words(text):
    return {w for w in re.split("[^a-z]+", (text or "").lower()) if len(w) > 3}


def test_match_and_brief(spark):
    base = [("soiling", 0, "Dust and soiling on modules", "dirt"), ("shading", 1, "Shade from objects on strings", "shade"), ("string_outage", 2, "A string lost", "lost"), ("weather", 3, None, "cloud")]
    signatures = spark.createDataFrame(base, "key string, position int, plain_name string, body string")
    asked = [(1, 0, "a lost string, or dust"), (1, 1, "SHADE on modules and objects"), (2, 0, "no"), (3, 0, None)]
    got = knowledge.match(spark.createDataFrame(asked, "qid long, phrase_no int, phrase string"), signatures)
    order = {}
    for q, _, phrase in asked:
        for key, position, name, _ in base:
            if n := len(long_words(phrase) & long_words(f"{key} {name or ''}")):
                old = order.get((q, key), (0, 0))
                order[q, key] = (max(old[0], n), position)
    assert {(r["qid"], r["key"]): r["overlap"] for r in got.collect()} == {k: v[0] for k, v in order.items()}
    assert [r["key"] for r in got.where("qid = 1").orderBy("rank").collect()][0] == "string_outage"
    causes = spark.createDataFrame([(1, 0, "soiling"), (1, 1, "shading"), (1, 2, "unknown"), (1, 3, "string_outage")], "qid long, rank int, key string")
    tests = spark.createDataFrame([("t2", "string_outage", "shading", "hours"), ("t1", "soiling", "weather", "rain"), ("t3", "soiling", "shading", "rain too")], "test_key string, first string, second string, body string")
    blocks = [(r["key"], r["body"]) for r in knowledge.brief(causes, signatures, tests).orderBy("block_no").collect()]
    assert blocks[:3] == [("soiling", "dirt"), ("shading", "shade"), ("string_outage", "lost")] and sorted(b[0] for b in blocks[3:]) == ["t2", "t3"]


def test_lint(spark):
    texts = ["falls by roughly 0.4% per degree", "if pr < 0.8", "more than 5 days", "above 10 %", "a Threshold", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert {r["id"] for r in knowledge.rule_like(rows, "id").collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize(("freq", "label"), [("15min", "2017-05-10 13:30:00"), ("1H", "2017-05-10 13:00:00"), ("1D", "2017-05-10"), ("1W", "2017-05-14"), ("1ME", "2017-05-31")])
def test_period_labels(spark, freq, label):
    row = spark.sql("SELECT timestamp'2017-05-10 13:37:00' AS ts").select(views.period_of(freq).cast("string").alias("p"))
    assert row.first()["p"] == label


def test_views_of_an_empty_panel(spark):
    empty = spark.createDataFrame([], "system_id int, ts timestamp, poa_wm2 double, ac_power_kw double, temp_module_c double, temp_ambient_c double, wind_speed_ms double")
    assert all(f(empty).count() == 0 for f in (views.recent, views.scatter, views.gap_calendar, views.plant_summary, lambda p: views.pr_series(p, "1ME")))
