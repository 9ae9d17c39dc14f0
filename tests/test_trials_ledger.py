import math
import random

import pytest

from pyspark.sql import functions as F

from framesleuth.operators import ledger, timeline, trials


def test_pooling_is_exact_nearest_rank(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for g, n in enumerate([1, 2, 19, 20, 21, 40, 41, 100, 333]):
        values = [rnd.randrange(7000, 10001) for _ in range(n)]
        rows += [(g, v) for v in values]
        want[g] = (n, sum(values), sorted(values)[max(0, math.ceil(0.05 * n) - 1)])
    got = trials.pool_scores(spark.createDataFrame(rows, "g long, score long"), ["g"], F.lit(9000), F.lit(8000), bin_width=37).collect()
    for r in got:
        n, total, p5 = want[r.g]
        assert (r.frames, r.score_sum, r.p5) == (n, total, p5)
        assert r.passed == (total >= 9000 * n and p5 >= 8000)
    assert len(got) == len(want)


def test_missing_scores_fail_closed(spark):
    scores = spark.createDataFrame([(1, 9900), (1, None), (2, 9900)], "g long, score long")
    expected = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "g long, expected_frames long")
    got = {r.g: r.passed for r in trials.pool_scores(scores, ["g"], F.lit(1), F.lit(1), expected).collect()}
    assert got == {1: False, 2: False, 3: False}


def test_components_match_union_find(spark):
    rnd = random.Random(8)
    names = [f"n{i:02d}" for i in range(60)]
    edges = [(rnd.choice(names), rnd.choice(names)) for _ in range(45)] + [("hub", n) for n in names[:9]] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for n in parent:
        groups.setdefault(find(n), []).append(n)
    want = {n: min(g) for g in groups.values() for n in g}
    got = {r.u: r.root for r in ledger.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_requeue_matches_sequential_walk(spark):
    rnd = random.Random(9)
    jobs = [
        (i, i, f"s{rnd.randrange(40)}", rnd.choice(["pending", "running", "running", "interrupted", "failed", "cancelled"]), rnd.random() < 0.7, rnd.random() < 0.1, rnd.random() < 0.1)
        for i in range(160)
    ]
    state = {j[0]: [j[2], j[3]] for j in jobs}
    extra, want = [], {}
    for i, _, source, _, asked, cancel, publishing in jobs:
        if not asked:
            continue
        now = state[i][1]
        if cancel or now == "cancelled":
            want[i] = "cancelled"
        elif now not in ("running", "interrupted"):
            want[i] = "finished-before-restart"
        elif publishing:
            want[i], state[i][1] = "blocked: publication must be reconciled", "interrupted"
        elif any(k != i and s == source and st in ("pending", "running") for k, (s, st) in state.items()) or source in extra:
            want[i], state[i][1] = "blocked: another request owns this source", "interrupted"
        else:
            want[i], state[i][1] = "requeued", "interrupted"
            extra.append(source)
    df = spark.createDataFrame(jobs, "id long, seq long, source string, state string, restart_requested boolean, cancel_requested boolean, publishing boolean")
    assert {r.id: r.decision for r in ledger.requeue_interrupted(df).collect()} == want
    after = ledger.requeued_jobs(df)
    assert after.where("retry_of is not null").count() == sum(v == "requeued" for v in want.values())


def test_decode_clock_matches_recursion(spark):
    rnd = random.Random(10)
    rows, want = [], {}
    for t in range(6):
        last, delay = None, 0
        for i in range(50):
            pts, dts = rnd.randrange(0, 400), rnd.randrange(0, 300)
            last = dts if last is None else max(dts, last + 1)
            delay = max(delay, last - pts)
            rows.append((t, i + 1, pts, dts))
        want[t] = delay + 1
    df = spark.createDataFrame(rows, "track long, ordinal long, pts long, dts long")
    assert {r.track: r.delay for r in timeline.decode_clock_delay(df, ["track"], 8).collect()} == want


def test_fingerprint_depends_on_order_and_not_on_blocks(spark):
    rows = [("a", i + 1, f"h{i}") for i in range(40)]
    swapped = [("a", o, h) for (_, o, _), (_, _, h) in zip(rows, [rows[1], rows[0], *rows[2:]])]
    digest = lambda r: timeline.track_fingerprints(spark.createDataFrame(r, "track string, ordinal long, hash string"), ["track"], ["hash"], 4).first()
    assert digest(rows).packets == 40 and digest(rows).fingerprint == digest(rows).fingerprint != digest(swapped).fingerprint


def test_components_of_a_long_path_are_finished(spark):
    from framesleuth.operators import ledger

    edges = spark.createDataFrame([(f"n{k:04}", f"n{k + 1:04}") for k in range(300)], "u string, v string")
    roots = {r["u"]: r["root"] for r in ledger.components(edges).collect()}
    assert set(roots.values()) == {"n0000"} and len(roots) == 300
    with pytest.raises(RuntimeError):
        ledger.components(edges, rounds=1)


def test_every_row_changes_the_fingerprint(spark):
    from framesleuth.operators import timeline

    rows = [(0, k, f"h{k}") for k in range(1, 41)]

    def print_of(held):
        return timeline.track_fingerprints(spark.createDataFrame(held, "track int, ordinal long, hash string"), ["track"], ["hash"], 2).first()["fingerprint"]

    whole = print_of(rows)
    assert all(print_of([(t, o, h + "!" * (o == k)) for t, o, h in rows]) != whole for k in (1, 8, 9, 33, 40))


def test_real_scores_equal_sorting(spark):
    import math
    import random

    rng = random.Random(9)
    rows, want = [], {}
    for g in range(30):
        n = rng.choice([1, 2, 19, 20, 21, 40, 333])
        values = [rng.choice([rng.uniform(80, 99), 95.123456, rng.uniform(95.12345, 95.12346), -3.5, 1e9]) for _ in range(n)]
        if g % 7 == 1:
            values[rng.randrange(n)] = rng.choice([float("nan"), float("inf"), float("-inf"), None])
        rows += [(g, v) for v in values]
        whole = all(v is not None and math.isfinite(v) for v in values) and g % 9 != 0
        p5 = sorted(values)[max(0, math.ceil(0.05 * n) - 1)] if whole else None
        want[g] = (n, p5, whole, whole and math.fsum(values) / n >= 90 and p5 >= 80)
    scores = spark.createDataFrame(rows, "g long, score double")
    expected = spark.createDataFrame([(g, w[0] + (g % 9 == 0)) for g, w in want.items()] + [(99, 3)], "g long, expected_frames long")
    got = {r.g: (r.frames, r.p5, r.complete, r.passed) for r in trials.pool_real_scores(scores, ["g"], "90", 80.0, expected).collect()}
    assert got == {**want, 99: (0, None, False, False)}
    assert trials.pool_real_scores(scores.limit(0), ["g"], "90", 80.0).count() == 0


def test_latest_before_spreads_over_blocks(spark):
    import random

    from framesleuth.operators import telemetry

    rng = random.Random(4)
    points = [(k % 3, rng.randrange(1000), f"p{k}") for k in range(300)]
    marks = [(k, t) for k in range(2) for t in rng.sample(range(50, 1000), 40)]
    got = telemetry.latest_before(spark.createDataFrame(points, "k long, at long, name string"), spark.createDataFrame(marks, "k long, seen long"), ["k"], "at", "seen", block_rows=9)
    want = {(k, at, n): max((t for g, t in marks if g == k and t <= at), default=None) for k, at, n in points}
    assert {(r.k, r.at, r.name): r.seen for r in got.collect()} == want


def test_readings_that_count_do_not_depend_on_blocks(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for g in range(4):
        at = counter = 0
        last = None
        for k in range(1, 400):
            at += rng.choice([0, 200_000, 300_000, 900_000, 1_500_000])
            counter += rng.randrange(9) - 2
            rows.append((g, k, at, counter))
            if last is None or at - last[0] >= 1_000_000 and counter >= last[1]:
                if last is not None:
                    want.add((g, k, (counter - last[1]) * 1e6 / (at - last[0])))
                last = (at, counter)
    frame = spark.createDataFrame(rows, "g long, ordinal long, at_us long, counter long")
    for block_rows in (13, 1000):
        assert {tuple(r) for r in timeline.taken_rates(frame, ["g"], block_rows=block_rows).collect()} == want
    assert timeline.taken_rates(frame.limit(0), ["g"]).count() == 0


def test_counted_scores_pool_as_their_frames_do(spark):
    rows = [(g, 9000 + (g * 37 + i * 101) % 800 if i % 50 or g != 3 else None, 1 + (i * g) % 4) for g in range(1, 5) for i in range(100)]
    counted = spark.createDataFrame(rows, "g long, score long, weight long")
    frames = counted.select("g", "score", F.explode(F.sequence(F.lit(1), F.col("weight")))).select("g", "score")
    pool = lambda df: sorted(tuple(r) for r in trials.pool_scores(df, ["g"], F.lit(9000), F.lit(8000)).collect())
    assert pool(counted) == pool(frames) and len(pool(counted)) == 4


def test_scores_of_a_null_rank_have_no_percentile(spark):
    counted = spark.createDataFrame([(1, None, 3), (1, 9000, 5), (2, 9100, 40), (2, None, 1)], "g long, score long, weight long")
    got = {r.g: (r.p5, r.frames, r.complete) for r in trials.pool_scores(counted, ["g"], F.lit(1), F.lit(1)).collect()}
    assert got == {1: (None, 8, False), 2: (9100, 41, False)}


def test_placed_scores_are_pooled_without_a_shuffle(spark):
    from framesleuth.session import materialise_placed

    rows = [(r, k, 9000 + i, 1 + i % 3) for r in range(20) for k in range(3) for i in range(30)]
    placed = materialise_placed(spark.createDataFrame(rows, "report long, k long, score long, weight long"), "placed-scores", 4, "report")
    pooled = trials.pool_scores(placed, ["report", "k"], F.lit(9000), F.lit(8000))
    assert pooled.count() == 60
    assert "Exchange" not in pooled._jdf.queryExecution().executedPlan().toString()
