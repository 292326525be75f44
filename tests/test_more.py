"""Operators that SQL can't express, or only in part, against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from heliograph.functions.solar import Site, with_clearsky, with_sun
from heliograph.operators import evaluate, findings, prose, retrieval, sun
from heliograph.sources import ingest


def chunks_by_hand(text, target, overlap):
    out, held, count = [], [], 0
    for p in (q.strip() for q in re.split(r"\n\s*\n", text or "")):
        if not p:
            continue
        n = len(p.split())
        if count and count + n > target:
            out.append("\n\n".join(held))
            held = [" ".join(out[-1].split()[-overlap:])]
            count = len(held[0].split())
        held, count = [*held, p], count + n
    return [*out, "\n\n".join(held)] if held else out


def test_chunks(spark):
    texts = [None, "", " \n\n ", "one", "a b c\n\nd e f\n \t\ng h i j k l", "w " * 50 + "\n\n" + "x " * 9, "\n\n".join(f"p{i} q r s" for i in range(40))]
    rows = prose.chunks(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", target=8, overlap=3).collect()
    got = {i: [r["text"] for r in sorted(rows, key=lambda r: r["chunk_no"]) if r["id"] == i] for i in range(len(texts))}
    assert got == {i: chunks_by_hand(t, 8, 3) for i, t in enumerate(texts)}
    assert {r["chunk_id"] for r in rows if r["id"] == 4} == {f"4:{k:03d}" for k in range(len(got[4]))}


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "PR fell to 0.86 (86%) on 2017-05-01 at 12:30, string_3 lost 12.5 of 1,250 kW; 20 days, step 99, H7; 0.40-0.98"), (2, None)], "id long, text string")
    ledger = spark.createDataFrame([(1, 0.8612), (1, -12.5), (1, 0.98), (1, None)], "id long, value double")
    got = {r["literal"]: r["grounded"] for r in prose.grounding(answers, ledger).collect()}
    assert got == {"0.86": True, "86%": True, "12.5": True, "1,250": True, "0.40": False, "0.98": True}


def test_sun_at_noon_and_night(spark):
    rows = spark.createDataFrame([("2017-06-21 12:00:00",), ("2017-12-21 12:00:00",), ("2017-06-21 00:00:00",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    got = with_clearsky(with_sun(rows), Site()).collect()
    assert math.isclose(got[0]["sun_zenith"], 39.13 - 23.44, abs_tol=0.3) and math.isclose(got[1]["sun_zenith"], 39.13 + 23.44, abs_tol=0.3)
    assert math.isclose(got[0]["sun_azimuth"], 180, abs_tol=3) and 900 < got[0]["clearsky_poa"] < 1150 and got[2]["clearsky_poa"] == 0 and got[3]["clearsky_poa"] == 0
    assert with_sun(rows.limit(1)).columns == ["ts", "sun_zenith", "sun_azimuth"]


@pytest.mark.parametrize("hours", [-5.0, 5.5])
def test_utc_offset_is_found(spark, hours):
    start, n = 1491004800, 96 * 20
    utc = spark.range(n).select(F.lit(1).alias("system_id"), F.timestamp_seconds(F.col("id") * 900 + start).alias("ts"))
    local = with_clearsky(utc, Site()).select("system_id", F.timestamp_seconds(F.unix_timestamp("ts") + int(hours * 3600)).alias("ts"), (F.col("clearsky_poa") * 0.9).alias("poa_wm2"))
    found = sun.utc_offset(local).first()
    assert found["offset_hours"] == hours and found["trustworthy"]


def test_clearest_days(spark):
    rows = [(1, f"2017-05-{d:02d} {h:02d}:{m:02d}:00", 800 * math.sin(math.pi * (h + m / 60) / 24) + (150 if d == 2 and h % 2 else 0)) for d in (1, 2, 3) for h in range(24) for m in (0, 30)]
    rows += [(2, "2017-05-01 10:00:00", 5.0)]
    frame = spark.createDataFrame(rows, "system_id int, ts string, poa_wm2 double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["system_id"], r["d"]) for r in sun.clearest_days(frame, keep=2).select("system_id", F.dayofmonth("ts").alias("d")).distinct().collect()}
    assert got == {(1, 1), (1, 3), (2, 1)}


def test_resolver_and_canonical(spark):
    wide = spark.createDataFrame([(1, "2017-01-01 00:00:00", "900", "9", 20.0, 50.0, 292.0, 4.0, 1.0, 2.0), (1, "2017-01-01 00:15:00", "x", "10", 21.0, 60.0, 292.0, 5.0, 1.0, 2.0)],
        "system_id int, ts string, irradiance_poa_o_2204 string, irradiance_poa_o_2203 string, temperature_ambient_o_2205 double, ac_power_inv_14538 double, wind_speed_o_1 double, wind_speed_o_2 double, shuntcurrent_a_avg_10__7 double, shuntcurrent_a_avg_2__6 double")
    found = ingest.resolve(wide)
    assert {r["quantity"]: r["column"] for r in found.where("chosen").collect()} == {"poa_wm2": "irradiance_poa_o_2204", "temp_ambient_c": "temperature_ambient_o_2205", "ac_power_kw": "ac_power_inv_14538", "wind_speed_ms": "wind_speed_o_2"}
    panel = ingest.canonical(wide, found)
    assert [r["poa_wm2"] for r in panel.collect()] == [900.0, None] and {"ghi_wm2", "string_current_a_2"} <= set(panel.columns)
    assert ingest.strings_long(panel).count() == 4
    with pytest.raises(ValueError, match="poa_wm2"):
        ingest.canonical(wide.drop("irradiance_poa_o_2204"), ingest.resolve(wide.drop("irradiance_poa_o_2204")))


def test_resample_keeps_gaps_and_masks(spark):
    rows = spark.createDataFrame([(1, 0, 10.0), (1, 60, 20.0), (1, 2700, -5.0), (1, 2760, -50.0)], "system_id int, s long, poa_wm2 double").select("system_id", F.timestamp_seconds("s").alias("ts"), "poa_wm2")
    got = [r["poa_wm2"] for r in ingest.resampled(ingest.masked(rows, 100.0), ["poa_wm2"]).orderBy("ts").collect()]
    assert got == [15.0, None, None, 0.0]


def test_names_and_paths(spark):
    names = spark.createDataFrame([("PVP 260kW",), ("PVP-260-KW",), ("Test Inverter 95kW",), ("none",), (None,)], "m string")
    assert [r[0] for r in names.select(ingest.ac_rating(F.col("m"))).collect()] == [260.0, 260.0, 95.0, None, None]
    assert [r["folder"] for r in ingest.day_paths(spark, 4902, "2017-01-31", "2017-02-01").orderBy("day").collect()] == ["system_id=4902/year=2017/month=1/day=31", "system_id=4902/year=2017/month=2/day=1"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("measured_on,ac_power_inv_1\n2017-01-01 00:00:00,5\nnonsense,6\n")
    rows = ingest.read_csv(spark, [str(tmp_path / "a.csv")]).collect()
    assert [r["ac_power_inv_1"] for r in rows] == ["5"]


def test_quotas_and_subset(spark):
    assert evaluate.quotas({"a": 40, "b": 2, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert evaluate.quotas({"a": 3, "b": 3}, 9) == {"a": 3, "b": 3} and sum(evaluate.quotas({"a": 5, "b": 5, "c": 5}, 7).values()) == 7
    cases = spark.createDataFrame([(i, "x" if i % 10 else None) for i in range(50)], "id long, kind string")
    drawn = evaluate.stratified(cases, ["kind"], "id", 10, seed=3).collect()
    assert len(drawn) == 10 and sum(r["kind"] is None for r in drawn) == 1
    assert sorted(drawn) == sorted(evaluate.stratified(cases.repartition(7), ["kind"], "id", 10, seed=3).collect())
    assert evaluate.stratified(cases.limit(0), ["kind"], "id", 10).count() == 0


def test_finding_contract(spark):
    schema = "identity string, settled boolean, cause string, confidence double, candidate_causes array<string>, resolving_measurement string, energy_verified boolean, energy_at_stake_kwh double"
    rows = [("good", True, "soiling", 0.8, [], None, True, 5.0), ("open", False, None, None, ["a", "b"], "measure", False, 9.0), ("bad", True, None, 0.5, None, None, False, 0.0), ("thin", False, None, None, ["a"], None, True, 1.0)]
    found = spark.createDataFrame(rows, schema)
    assert {r["identity"]: len(r["broken"]) for r in findings.violations(found).collect()} == {"bad": 1, "thin": 3}
    assert [r["identity"] for r in findings.ranked(found, 3).collect()] == ["good", "thin", "open"]
    energy = spark.createDataFrame([(None, 2.0), (-1.0, 3.0), (None, None)], "a double, b double").select(findings.energy_at_stake(F.col("a"), F.col("b")))
    assert [r[0] for r in energy.collect()] == [2.0, 3.0, 0.0]


def test_uncovered_and_retrieval(spark):
    run = spark.createDataFrame([(1, "pr"), (1, "trend"), (2, "pr")], "id long, tool string")
    speaks = spark.createDataFrame([("pr", "weather"), ("trend", "sensor_drift")], "tool string, cause string")
    left = findings.uncovered(run, speaks, spark.createDataFrame([("weather",), ("sensor_drift",)], "cause string"))
    assert [tuple(r) for r in left.select("id", "cause").collect()] == [(2, "sensor_drift")]
    hits = spark.createDataFrame([(1, 5, 1), (2, 5, 4), (3, 9, 1)], "qid long, id long, rank int")
    wanted = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 8)], "qid long, kind string, id long")
    got = {r["kind"]: (r["queries"], r["hit_at_1"], r["hit_at_10"], r["reciprocal_rank"]) for r in prose.retrieval_quality(hits, wanted).collect()}
    assert got == {"a": (2, 0.5, 1.0, 0.625), "b": (1, 0.0, 0.0, 0.0), None: (3, 0.3333, 0.6667, 0.4167)}


def test_agency(spark):
    schema = "split string, failed_with string, tools_called array<string>, unplanned_tools array<string>, llm_calls long, cached_calls long, cost_usd double, latency_ms long"
    rows = [("s", None, ["a", "b"], [], 2, 0, 1.0, 10), ("s", None, ["a", "b"], ["b"], 2, 1, 2.0, 30), ("s", None, ["a"], [], 3, 3, 9.0, 99), ("s", "error", ["x"], [], 1, 0, 7.0, 70)]
    got = evaluate.agency(spark.createDataFrame(rows, schema), ["split"]).first()
    assert (got["runs"], got["trajectories"], got["unplanned_rate"], got["median_cost_usd"], got["median_latency_ms"]) == (3, 2, 0.2, 2.0, 30)


def test_stop_words(spark):
    """The 52 words of the survey's R1 (src/rag/index.py of the reference), written out on their own."""
    listed = """a an and are as at be been but by can could do does for from had has have if in into is it its may more
    most no not of on or that the their then there these they this to was were what when which while who will with would""".split()
    assert len(listed) == 52 and sorted(retrieval.STOP_WORDS) == listed
    row = spark.createDataFrame([("Can they do more while it MAY rain, or does no one know who could?",)], "text string").select(retrieval.tokens(F.col("text")).alias("t")).first()
    assert row["t"] == ["rain", "one", "know"]
