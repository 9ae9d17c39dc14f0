"""Live policies step by step against batch forms, late rows, restarts and upserts."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framesleuth.operators import telemetry
from framesleuth.streaming import jobs, processors

ORIGIN = 1704067200000000
SECOND = 1_000_000


def stepped(policy, rows, slot_us):
    """Run a policy over rows slot by slot, as the replay does."""
    carried, out = policy.start, []
    rows = rows.sort_values(["at_us", *policy.order], ignore_index=True)
    for _, some in rows.groupby(rows["at_us"] // slot_us):
        found, carried = policy.step(some.reset_index(drop=True), carried)
        out.append(pd.DataFrame(found))
    return pd.concat(out, ignore_index=True)


def samples(n=900, seed=2):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 1, 2, 3, 9, 16]) * SECOND
        rows.append((1, i, at, rng.random() < 0.9, rng.random() < 0.7, rng.random() < 0.8, rng.choice([30.0, 60.0, 90.0, 90.0])))
    return pd.DataFrame(rows, columns=["track", "ordinal", "at_us", "usable", "external", "healthy", "cpu_percent"])


@pytest.mark.parametrize("slot_us", [SECOND, 40 * SECOND, 10**12])
def test_policies_equal_batch_forms_for_any_slot(spark, slot_us):
    rows = samples()
    table = spark.createDataFrame(rows).withColumns({"scoped": F.col("usable"), "host_cpus": F.lit(16), "cpus": F.lit(8), "container_cpu_percent": F.lit(20.0)})

    def equal(live, batch, columns):
        want = batch.orderBy("ordinal").select(*columns).toPandas()
        assert len(want) == len(rows) and [tuple(r) for r in live[columns].to_numpy().tolist()] == [tuple(r) for r in want.to_numpy().tolist()]

    equal(stepped(processors.gpu_yield(), rows, slot_us), telemetry.gpu_yield(table, ["track"], block_rows=7), ["at_us", "state", "pause"])
    gate = {"hold_us": 20 * SECOND, "gap_us": 9 * SECOND, "cooldown_us": 15 * SECOND}
    equal(stepped(processors.sustained_gate(**gate), rows, slot_us), telemetry.sustained_gate(table, ["track"], block_rows=7, **gate), ["at_us", "open"])
    loads = rows.assign(sane=rows["usable"], busy=rows["usable"] & (rows["cpu_percent"] == 90), quiet=rows["usable"] & (rows["cpu_percent"] < 65))
    equal(stepped(processors.cpu_yield(), loads, slot_us), telemetry.cpu_yield(table, ["track"], block_rows=7), ["at_us", "state"])


def test_small_policies_for_any_slot():
    rng = random.Random(5)
    rows = pd.DataFrame([(i, rng.randrange(400) * SECOND, rng.choice("abc"), rng.randrange(90), rng.choice(["preview", "confirm", "other"])) for i in range(300)], columns=["ordinal", "at_us", "category", "value", "action"])
    in_order = rows.sort_values(["at_us", "ordinal"], ignore_index=True)
    for slot_us in (SECOND, 30 * SECOND, 10**12):
        spent = stepped(processors.stage_seconds(), rows, slot_us)
        want = list(zip(in_order["category"], np.diff(in_order["at_us"])))
        assert list(zip(spent["category"], spent["us"])) == want
        top, highs = 0, []
        for v in in_order["value"]:
            if v > top:
                top = v
                highs.append(v)
        assert stepped(processors.activity(), rows, slot_us)["value"].tolist() == highs
        shown, accepted = None, []
        for at, action in zip(in_order["at_us"], in_order["action"]):
            if action == "preview":
                shown = at
            elif action == "confirm":
                accepted.append(shown is not None and at - shown < 4 * SECOND)
                shown = None
        assert stepped(processors.confirmations(4 * SECOND), rows, slot_us)["accepted"].tolist() == accepted


def test_progress_chunks_split_anywhere():
    text = "PROGRESS=10.5\nnoise PROGRESS=99\nAPP_PROGRESS=9\r\n  PROGRESS=40 \nxPROGRESS=70\nPROGRESS=150\nPROGRESS=7"
    for size in (1, 3, 7, 200):
        rows = pd.DataFrame([(i, i, text[k : k + size]) for i, k in enumerate(range(0, len(text), size))], columns=["at_us", "ordinal", "chunk"])
        for slot_us in (1, 5, 1000):
            got = stepped(processors.progress(), rows, slot_us)
            assert list(zip(got["percent"], got["increment"])) == [(10.5, 10.5), (9.0, 0.0), (40.0, 29.5), (100.0, 60.0)]


def test_throughput_needs_three_of_each():
    rows = pd.DataFrame([(i, i, 100.0 * (1 + i), 2.0, [0.0, 0.9, 0.5][i % 3]) for i in range(8)], columns=["at_us", "ordinal", "work", "elapsed", "overlap"])
    got = stepped(processors.throughput(), rows, 1)
    assert got[["paired", "single"]].iloc[-1].tolist() == [3, 3] and np.isnan(got["gain"].iloc[4]) and got["gain"].iloc[-1] == pytest.approx(2 * 250 / 200)


def stamp(seconds):
    return datetime.datetime.fromtimestamp(ORIGIN / SECOND + seconds, datetime.timezone.utc)


def feed(spark, path, rows, schema):
    """One more file of ``(..., seconds)`` rows."""
    held = [(*r[:-1], stamp(r[-1]), ORIGIN + int(r[-1] * SECOND)) for r in rows]
    spark.createDataFrame(held, f"{schema}, ts timestamp, at_us long").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(f"{schema}, ts timestamp, at_us long").option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_are_dropped_and_a_restart_goes_on(spark, tmp_path):
    """Shuffled rows over several batches; a late one moves no mark; the second run continues from state."""
    schema, path = "track long, ordinal long, phase string", str(tmp_path / "in")
    beats = [(1, k, ["full-encode", "idle"][k % 2], k) for k in range(0, 100)]
    random.Random(1).shuffle(part := beats[:30])
    feed(spark, path, part, schema)
    feed(spark, path, beats[30:60], schema)
    stream = feed(spark, path, [(1, 500, "late", 3.5)], schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    rows = jobs.stage_seconds(stream, "2 seconds", SECOND)
    # The watermark of the batch before decides what is late, so one more batch comes between.
    assert jobs.run_once(rows, out, checkpoint) == 1
    first = spark.read.schema(rows.schema).parquet(out).count()
    feed(spark, path, beats[60:], schema)
    assert jobs.run_once(rows, out, checkpoint) == 0
    got = spark.read.schema(rows.schema).parquet(out)
    # The watermark stands at 97 s: intervals up to second 96 are out, each once.
    assert 0 < first < got.count() == 96
    assert {r["category"]: r["us"] for r in got.groupBy("category").agg(F.sum("us").alias("us")).collect()} == {"encoding": 48 * SECOND, "other": 48 * SECOND}
    assert jobs.run_once(rows, out, checkpoint) == 0 and spark.read.schema(rows.schema).parquet(out).count() == 96


def test_an_empty_input_ends_at_once(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("track long, ordinal long, healthy boolean, ts timestamp, at_us long").parquet(str(tmp_path / "none"))
    assert jobs.drained(jobs.sustained_gate(stream), "t-none").rows.count() == 0


def test_heartbeats_go_stale_by_event_time(spark, tmp_path):
    schema, path = "job long, state string", str(tmp_path / "in")
    feed(spark, path, [(1, "running", 0), (2, "done", 0), (4, "running", 0)], schema)
    feed(spark, path, [(3, "running", 300), (4, "running", 290)], schema)
    stream = feed(spark, path, [(3, "running", 305)], schema)
    out = jobs.drained(jobs.heartbeats(stream), "t-beat").rows
    states = {(r.job, r.state) for r in out.collect()}
    assert (1, "stale") in states and (2, "stale") not in states and (3, "stale") not in states
    newest = {r.job: r.r.state for r in out.groupBy("job").agg(F.max(F.struct("updated_us", "state")).alias("r")).collect()}
    assert newest == {1: "stale", 2: "done", 3: "running", 4: "running"}


def test_upsert_keeps_the_newest_row_and_few_files(spark, tmp_path):
    schema = "track long, at_us long, note string"
    sink = jobs.KeyedUpsert(spark, str(tmp_path / "state"), "track", "at_us", buckets=4)
    assert sink.read(spark.createDataFrame([], schema).schema).count() == 0
    want = {}
    for number in range(4):
        rows = [(k, 10 * number + k % 3, f"n{number}") for k in range(number, 40, number + 1)] + [(1, -5, "old")]
        batch = spark.createDataFrame(rows, schema)
        sink(batch, number)
        sink(batch, number)  # a repeated batch changes nothing
        for k, at, note in rows:
            want[k] = max(want.get(k, (-(10**9), "")), (at, note))
        again = jobs.KeyedUpsert(spark, str(tmp_path / "state"), "track", "at_us", buckets=4)
        assert {r.track: (r.at_us, r.note) for r in again.read(batch.schema).collect()} == want
    assert sorted(p.name for p in (tmp_path / "state" / "manifests").iterdir() if not p.name.startswith(".")) == ["2", "3"]
    assert len(list((tmp_path / "state" / "data").glob("batch=*/bucket=*"))) <= 8
    # A batch that died before its manifest leaves the version before it in place.
    spark.createDataFrame([(1, 10**6, "torn")], schema).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "state" / "data" / "batch=4"))
    assert {r.track: (r.at_us, r.note) for r in sink.read(batch.schema).collect()} == want


def test_a_step_over_many_groups_equals_each_alone():
    rng = random.Random(8)
    names = ["_group", "ordinal", "at_us", "category", "value", "action", "usable", "external", "work", "elapsed", "overlap", "chunk"]
    rows = pd.DataFrame([(rng.randrange(6), i, i * SECOND, rng.choice("abc"), rng.randrange(90), rng.choice(["preview", "confirm"]), rng.random() < 0.9, rng.random() < 0.7, 100.0 + i, 2.0, rng.choice([0.0, 0.9]), f"PROGRESS={i % 90}\nPROG") for i in range(300)], columns=names)
    for make in (processors.gpu_yield, processors.stage_seconds, processors.activity, processors.confirmations, processors.throughput, processors.progress):
        policy, alone, together = make(), [], []
        for part in (rows[:150], rows[150:]):
            some = part.sort_values(["_group", "ordinal"], ignore_index=True)
            start = tuple(processors._column([s] * 6) for s in policy.start) if part is rows or part["ordinal"].iloc[0] == 0 else carried
            out, carried = policy.step(some, tuple(processors._column(c) for c in start))
            places = out.pop("_row")
            together.append(pd.DataFrame(out).assign(g=some["_group"].to_numpy()[places]))
        for g in range(6):
            held = policy.start
            for part in (rows[:150], rows[150:]):
                out, held = policy.step(part[part["_group"] == g].drop(columns="_group").reset_index(drop=True), held)
                out.pop("_row")
                alone.append(pd.DataFrame(out).assign(g=g))
        order = ["g", "at_us"]
        got, want = (pd.concat(x).sort_values(order, kind="mergesort", ignore_index=True) for x in (together, alone))
        pd.testing.assert_frame_equal(got, want)


def test_keys_share_a_bucket_and_null_keys_have_their_own(spark, tmp_path):
    schema, path = "track long, counter string, ordinal long, value long", str(tmp_path / "in")
    big = (1 << 53) + 1
    rows = [(key, name, k, 10 * k, k) for key in (big, big + 1, None) for name in ("a", None) for k in range(1, 30)]
    feed(spark, path, rows[::2], schema)
    stream = feed(spark, path, rows[1::2], schema)
    live = jobs.replay(stream, ("track", "counter"), processors.activity(), "60 seconds", SECOND, buckets=1)
    feed(spark, path, [(7, "z", 0, 1, 500)], schema)
    got = {}
    for r in jobs.drained(live, "t-shared").rows.collect():
        got.setdefault((r.track, r.counter), []).append(r.value)
    assert {k: sorted(v) for k, v in got.items()} == {(key, name): [10 * k for k in range(1, 30)] for key in (big, big + 1, None) for name in ("a", None)}


def test_state_of_policies_is_dealt_to_no_more_partitions_than_buckets(spark, monkeypatch):
    from framesleuth.plans import live as plans

    seen, run = [], jobs.run_once

    def watched(rows, path, checkpoint):
        own = rows.sparkSession.conf
        seen.append((own.get("spark.sql.shuffle.partitions"), own.get("spark.sql.session.timeZone"), own.get("spark.sql.caseSensitive")))
        return run(rows, path, checkpoint)

    monkeypatch.setattr(jobs, "run_once", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        got = plans.confirmations_live(spark, "/root/testdata/sf0.001")
        assert seen == [(str(jobs.BUCKETS), "UTC", "true")]
        assert got.sparkSession is spark and spark.conf.get("spark.sql.shuffle.partitions") == "200" and got.count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.caseSensitive")
