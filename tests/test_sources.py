"""Files, plants and the day-by-day ingest, on small folders of the tests' own."""

import json

import pytest
from pyspark.sql import functions as F

from heliograph.operators import diagnosis, evaluate, findings, inject, retrieval
from heliograph.sources import files, ingest, plants


@pytest.fixture
def archive(tmp_path):
    """Three days of a logger, the second missing from the archive."""
    for day in (1, 3):
        folder = tmp_path / "raw" / f"system_id=4/year=2020/month=5/day={day}"
        folder.mkdir(parents=True)
        lines = ["measured_on,poa_irradiance,ambient_temp,ac_power,inv1_dc_current"]
        lines += [f"2020-05-{day:02d} {h:02d}:{m:02d}:00,{400 + 20 * h},15,{3 * h},1" for h in range(24) for m in (0, 5, 15, 30, 45)]
        (folder / f"system_4__date_2020_05_{day:02d}.csv").write_text("\n".join(lines) + "\nbroken,1,1,1,1\n")
    return tmp_path


def test_listing(spark, archive):
    found = files.listing(spark, str(archive / "raw"), "*.csv").collect()
    assert len(found) == 2 and all(len(r["sha256"]) == 64 and r["length"] > 0 for r in found)
    below = files.prefixes(files.listing(spark, str(archive / "raw")), f"{archive}/raw/system_id=4/year=2020/month=5").collect()
    assert sorted(r["prefix"] for r in below) == ["day=1", "day=3"]


def test_ingest_days(spark, archive):
    root, target = str(archive / "raw"), str(archive / "out")
    lost = ingest.day_paths(spark, 4, "2020-05-02", "2020-05-02").select("folder")
    with pytest.raises(files.IncompleteRecord):
        files.ingest_days(spark, root, 4, "2020-05-01", "2020-05-03", target, 100.0, failed=lost)
    assert not (archive / "out").exists()  # nothing is written where days failed
    manifest = files.ingest_days(spark, root, 4, "2020-05-01", "2020-05-03", target, 100.0, offset_hours=-5.0)
    assert manifest["gaps"] == ["2020-05-02"] and manifest["channels"]["poa_wm2"] == "poa_irradiance"
    assert json.loads(spark.read.text(f"{target}/manifest").first()[0]) == manifest
    panel = spark.read.parquet(f"{target}/panel")
    assert panel.where("ac_power_kw is not null").count() == 2 * 24 * 4 and panel.count() == (2 * 24 + 24) * 4
    assert str(panel.agg(F.min("ts")).first()[0]) == "2020-05-01 05:00:00"
    partial = files.ingest_days(spark, root, 4, "2020-05-01", "2020-05-03", target, 100.0, failed=lost, allow_partial=True)
    assert partial["failed"] == ["2020-05-02"] and partial["gaps"] == []
    with pytest.raises(LookupError):
        files.ingest_days(spark, root, 5, "2020-05-01", "2020-05-03", target, 100.0)


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_jsonl(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), path)
    files.append_jsonl(spark.createDataFrame([("c", 3)], "id string, n int"), path)
    assert sorted(map(tuple, files.read_jsonl(spark, path, "id string, n int").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    (tmp_path / "log" / "half.json").write_text('{"id": "d", "n": 4}\n{"id": "e", "n"')
    assert {r["id"] for r in files.read_jsonl(spark, path, "id string, n int", skip_bad=True).collect()} == {"a", "b", "c", "d"}
    with pytest.raises(Exception, match="half.json"):
        files.read_jsonl(spark, path, "id string, n int").collect()


def test_text_corpus(spark, tmp_path):
    for name in ("b.txt", "a.md", "README.md", "a.txt", "c.csv"):
        (tmp_path / name).write_text(f"text of {name}")
    got = [r["name"] for r in files.text_corpus(spark, str(tmp_path)).orderBy("position").collect()]
    assert got == ["a.txt", "b.txt", "a.md"]


def test_module_gamma(spark):
    table = spark.createDataFrame([("Sharp_NU_U235F2", -0.48), ("A_X_1", -0.3), ("B_X_1", -0.4), ("Plain", -0.5)], "module string, gamma_percent double")
    names = spark.createDataFrame([("NU-U235F2",), ("x 1",), ("PLAIN",), ("none",), ("",)], "name string")
    got = {r["name"]: r["gamma"] for r in plants.module_gamma(names, table).collect()}
    assert got["NU-U235F2"] == pytest.approx(-0.0048) and got["PLAIN"] == -0.005 and got["x 1"] is None and got["none"] is None and got[""] is None


def test_string_share(spark):
    rows = [(1, f"2024-01-01 {h:02d}:00:00", s, 2.0) for h in range(3) for s in range(1, 8)]
    strings = spark.createDataFrame(rows, "system_id int, ts string, string_idx int, current_a double").withColumn("ts", F.col("ts").cast("timestamp"))
    share = lambda inside, lost=1.0: inject.string_share(strings, inside, 3, lost).first()["share"]
    assert share(F.lit(True)) == pytest.approx(1 / 6) and share(F.lit(False)) == pytest.approx(1 / 7)  # against the total after the outage; an even split where nothing tells


def test_trailing_windows(spark):
    panel = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (1, "2024-01-30 05:00:00"), (2, "2024-01-01 00:00:00")], "system_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r["system_id"], str(r["now"]), str(r["start_day"]), str(r["end_day"])) for r in diagnosis.trailing_windows(panel).orderBy("system_id", "now").collect()]
    assert got == [(1, "2024-01-15", "2024-01-01", "2024-01-14"), (1, "2024-01-22", "2024-01-08", "2024-01-21"), (1, "2024-01-29", "2024-01-15", "2024-01-28"), (2, "2024-01-15", "2024-01-01", "2024-01-14")]


def test_targets_are_three_valued(spark):
    rows = spark.createDataFrame([("tuning", 0.9, 0.0, 1.0)], "split string, macro_f1 double, false_alarm_rate double, correct_abstention_rate double")
    assert {r["met"] for r in evaluate.targets(rows).collect()} == {None}  # the held-back split never ran
    both = rows.unionByName(spark.createDataFrame([("heldback", 0.85, None, 0.8)], rows.schema))
    got = {r["target"]: r["met"] for r in evaluate.targets(both).collect()}
    assert got == {"macro_f1_at_least_0.75": True, "false_alarm_rate_at_most_0.15": False, "correct_abstention_at_least_0.70": True, "overfitting_gap_at_most_0.10": True}


def test_findings_refused(spark):
    rows = [(1, 0, "soiling", "recoverable", True, None, None, None, 3.0, None), (1, 1, None, None, False, ["a", "b"], "look", None, None, 2.0), (1, 2, None, None, False, ["a"], "look", None, 0.0, 0.0), (1, 3, None, "fault", False, ["a", "b"], None, None, -1.0, 4.0)]
    verdicts = spark.createDataFrame(rows, "system_id int, window_id int, cause string, category string, settled boolean, candidate_causes array<string>, resolving_measurement string, confidence double, deficit_kwh double, shortfall_kwh double")
    got = {r["window_id"]: r for r in findings.build(verdicts, F.lit("p")).collect()}
    assert (got[0]["confidence"], got[0]["energy_at_stake_kwh"], got[0]["title"], got[0]["refused"]) == (0.5, 3.0, "Soiling", None)
    assert (got[1]["category"], got[1]["candidates"], got[1]["confidence"], got[1]["refused"]) == ("not_the_plant", "a|b", None, None)
    assert got[2]["refused"] == "fewer than two candidates" and got[3]["refused"] == "no resolving measurement" and got[3]["energy_at_stake_kwh"] == 4.0


def test_rerank_of_a_blank_query(spark):
    chunks = spark.createDataFrame([(1, "Solar Panel"), (2, "other")], "id long, text string")
    asked = spark.createDataFrame([(1, "  "), (2, " solar panel ")], "qid long, text string")
    fused = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2)], "qid long, id long, rank int")
    got = {(r["qid"], r["id"]): r["score"] for r in retrieval.rerank(fused, chunks, asked, 10).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.5, (2, 2): 1.0, (2, 1): 2 + 1.5 + 0.5}


def test_stop_words_and_hash(spark):
    assert len(set(retrieval.STOP_WORDS)) == 52
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "id long, text string")
    assert retrieval.corpus_hash(rows).first() == retrieval.corpus_hash(rows.repartition(7)).first() != retrieval.corpus_hash(rows.limit(49)).first()
