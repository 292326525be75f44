"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from heliograph import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation part lineitem events documents benchmark labels conversations".split()


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert rows(queries.queries()[name](spark, DIR).toPandas()) == rows(con.execute(queries.oracle_sql()[name]).df())


def test_entry_imports():
    import __spark_entry__ as entry

    assert "pr_daily" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_change_point_is_the_step(spark):
    from heliograph.operators import measures

    data = [(1, 0, d, 1.0 if d < 7 else 3.0) for d in range(12)]
    row = measures.onset(spark.createDataFrame(data, "system_id int, window_id int, day int, y double"), "y", ["system_id", "window_id"]).first()
    assert (row["onset_day"], row["absolute_change"], row["change_over_scatter"]) == (7, 2.0, 999.0)


def test_physics_keeps_null(spark):
    from pyspark.sql import functions as F

    from heliograph.functions.physics import correction_factor

    got = [r[0] for r in spark.createDataFrame([(25.0,), (45.0,), (None,)], "t double").select(correction_factor(F.col("t"), -0.004)).collect()]
    assert got[0] == 1.0 and math.isclose(got[1], 0.92) and got[2] is None


def test_lifecycle(spark):
    from heliograph.operators import findings

    seen = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 5)], "identity string, sweep long")
    log = findings.lifecycle(seen, spark.range(7).withColumnRenamed("id", "sweep"))
    b = [(r["sweep"], r["lifecycle"]) for r in log.where("identity = 'b'").orderBy("sweep").collect()]
    assert b == [(0, "new"), (1, "new"), (2, "new"), (3, "resolved"), (5, "ongoing"), (6, "ongoing")]
    assert {r["identity"]: r["lifecycle"] for r in findings.current(log).collect()} == {"a": "resolved", "b": "ongoing"}


def test_stream_equals_batch(spark, tmp_path):
    from heliograph.sources import panels
    from heliograph.streaming import sweep

    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    query = sweep.start(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "panel"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    streamed = spark.read.parquet(str(tmp_path / "panel")).select("ts", "poa_wm2", "ac_power_kw")
    batch = panels.events_hourly(spark, DIR).select("ts", "poa_wm2", "ac_power_kw")
    # the hours after the watermark are still open
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() >= batch.count() - 4
