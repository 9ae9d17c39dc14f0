"""Equal times, equal creation times and gaps of exactly the limit, as the SQL has them."""

import datetime

from pyspark.sql import functions as F

from framesleuth.operators import ledger, timeline
from framesleuth.plans import live
from framesleuth.plans.catalog import oracle_sql, queries
from framesleuth.sources import sinks
from oracle_check import compare, connect


def test_readings_within_a_second_count_when_asked(spark):
    rows = [(1, 1, 0, 0), (1, 2, 500_000, 10), (1, 3, 500_000, 30), (1, 4, 1_500_000, 50)]
    frame = spark.createDataFrame(rows, "g long, ordinal long, at_us long, counter long")
    got = {r.ordinal: r.rate for r in timeline.taken_rates(frame, ["g"], least_us=0).collect()}
    assert got == {2: 20.0, 4: 20.0}


def test_latest_attempt_takes_the_given_end_for_ties(spark):
    rows = [(1, "/a", None, 5, 9, 0), (2, "/a", None, 5, None, 20)]
    frame = spark.createDataFrame(rows, "id long, source string, published_path string, created_us long, finished_us long, started_us long")
    assert ledger.latest_attempts(frame).first().id == 2
    assert ledger.latest_attempts(frame, F.coalesce("finished_us", F.lit(0))).first().id == 1


def test_repeated_times_are_written_when_asked(spark):
    frame = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1000), (1, 3, 1000, 1000)], "track long, ordinal long, pts long, dur long")
    lines = lambda **kw: sinks.timestamp_lines(frame, ["track"], **kw).where(F.col("reason").isNull()).count()
    assert lines() == 2 and lines(repeats=True) == 3


def test_packets_of_one_time_come_back_once_each_in_order(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 1)
    rows = [(k, at + datetime.timedelta(seconds=k // 3), 7 + 40 * (k % 2), "view", float(k), '{"k": 1}') for k in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = queries()["evidence_text_roundtrip"](spark, str(tmp_path)).toPandas()
    con = connect(tmp_path / "none")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(got, con.execute(oracle_sql()["evidence_text_roundtrip"]).df()) is None


def test_samples_exactly_the_gap_apart_are_two_sessions(spark):
    frame = spark.createDataFrame([(1, 0), (1, 15_000_000), (2, 0), (2, 14_999_999)], "k long, t long").withColumn("ts", F.timestamp_micros("t"))
    sizes = [(r.k, r["count"]) for r in frame.groupBy("k", F.session_window("ts", live.SESSION_GAP)).count().collect()]
    assert sorted(sizes) == [(1, 1), (1, 1), (2, 2)]
