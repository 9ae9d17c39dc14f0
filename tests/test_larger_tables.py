"""Work that must be dealt to tasks as tables grow."""

from pyspark.sql import functions as F

from framesleuth.operators import timeline
from framesleuth.plans import libraries


def test_groups_of_readings_are_walked_one_after_the_other_in_a_task(spark):
    frame = spark.createDataFrame([(g, k, k * 600_000 if k != 3 else None, float(k)) for g in (None, 1, 2) for k in range(1, 8)], "g long, ordinal long, at_us long, counter double")
    for block_rows in (65536, 2):
        rates = timeline.taken_rates(frame, ["g"], block_rows=block_rows)
        assert "FlatMapGroupsInPandas" not in rates._jdf.queryExecution().toString()
        # The reading without a time is ignored.
        assert {tuple(r) for r in rates.collect()} == {(g, k, (k - last) * 1e6 / ((k - last) * 600_000)) for g in (None, 1, 2) for k, last in ((4, 1), (6, 4))}


def test_streams_of_one_small_file_are_compared_in_many_tasks(spark, tmp_path):
    parts = spark.range(50_000).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("x").alias("p_brand"), F.lit("LARGE").alias("p_type"), F.lit(5).alias("p_size"), F.lit(1.5).alias("p_retailprice"))
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    changed = libraries.stream_changes(spark, str(tmp_path))
    assert changed.rdd.getNumPartitions() == 3
    assert changed.where("changed LIKE '%channels%'").count() == sum(k % 67 == 0 and k % 2 == 1 for k in range(50_000))


def test_written_files_are_dealt_to_as_many_tasks_as_there_are_rows(spark, tmp_path, monkeypatch):
    from framesleuth.plans import scores

    rows = spark.range(600_000).select((F.col("id") % 40).alias("track"), (F.col("id") / 40).cast("long").alias("ordinal"), F.when(F.col("id") < 599_960, 1).alias("dur"))
    monkeypatch.setattr(scores, "file_packets", lambda *_: rows)
    monkeypatch.setattr(scores, "_fresh", lambda *_: str(tmp_path / "out"))
    path = scores._documents(spark, "", "x", "frames", F.lit("{}"))
    written = [f.name for f in (tmp_path / "out").glob("track=*/*.txt")]
    # One file a track; no task wrote more than a few of the forty (eight tasks wrote five or more each).
    assert path and len(written) == 40
    assert max(written.count(n) for n in written) <= 4 and len({n[:10] for n in written}) > 8
