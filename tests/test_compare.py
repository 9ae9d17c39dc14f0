import random

from framesleuth.functions.checks import with_empty_groups
from framesleuth.operators import compare

SCHEMA = "track string, ordinal long, hash string, pts long, dts long, dur long"


def packets(n, track="t", seed=0):
    rnd, at, rows = random.Random(seed), 0, []
    for i in range(n):
        rows.append([track, i + 1, f"h{rnd.randrange(10**6)}", at, at - 5, 20_000])
        at += 20_000
    return rows


def verdict(spark, a, b, **kw):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    return {r.track: r for r in compare.compare_packets(left, right, ["track"], **kw).collect()}


def test_damage_is_named_at_smallest_ordinal(spark):
    rnd = random.Random(4)
    for seed in range(6):
        a = packets(40, seed=seed)
        b = [list(r) for r in a]
        hurt = sorted(rnd.sample(range(40), 3))
        for i in hurt:
            kind = rnd.choice(["hash", "pts", "dur", "null"])
            if kind == "hash":
                b[i][2] = "x"
            elif kind == "pts":
                b[i][3] += 2001
            elif kind == "dur":
                b[i][5] -= 2001
            else:
                b[i][4] = None
        r = verdict(spark, a, b)["t"]
        assert (r.status, r.first_bad_ordinal, r.failures) == ("fail", hurt[0] + 1, len(hurt))


def test_identical_dropped_tail_reordered_and_tolerance(spark):
    a = packets(12)
    assert verdict(spark, a, a)["t"].status == "pass"
    short = verdict(spark, a, a[:-1])["t"]
    assert (short.status, short.first_bad_ordinal, short.reason) == ("fail", 12, "payload or count changed")
    near = [[*r[:3], r[3] + 2000, *r[4:]] for r in a]
    assert verdict(spark, a, near)["t"].status == "pass"
    swapped = [list(r) for r in a]
    swapped[4][2], swapped[5][2] = swapped[5][2], swapped[4][2]
    assert verdict(spark, a, swapped)["t"].first_bad_ordinal == 5


def test_allowances_exempt_only_their_case(spark):
    a = packets(5)
    b = [list(r) for r in a]
    b[4][5] = 5_000
    assert verdict(spark, a, b)["t"].status == "fail"
    assert verdict(spark, a, b, terminal_duration=True)["t"].status == "pass"
    b[2][5] = 5_000
    assert verdict(spark, a, b, terminal_duration=True)["t"].status == "fail"
    c = [list(r) for r in a]
    c[1][5] = None
    assert verdict(spark, a, c, durations_dropped=True)["t"].status == "pass"
    assert verdict(spark, c, a, durations_dropped=True)["t"].status == "fail"
    assert verdict(spark, c, a, durations_filled=True)["t"].status == "pass"
    one = packets(1)
    assert verdict(spark, one, one, cover=True)["t"].status == "pass"
    assert verdict(spark, a, a, cover=True)["t"].status == "fail"


def test_listed_track_without_packets_fails(spark):
    a = packets(3)
    df = spark.createDataFrame(a, SCHEMA)
    listed = spark.createDataFrame([("t",), ("empty",)], "track string")
    rows = {r.track: r for r in with_empty_groups(compare.compare_packets(df, df, ["track"]), listed, ["track"], "no packets").collect()}
    assert rows["t"].status == "pass" and (rows["empty"].status, rows["empty"].reason) == ("fail", "no packets")


def test_hidden_unknown_evidence_never_passes(spark):
    a = packets(3)
    b = [list(r) for r in a]
    a[1][2] = b[1][2] = None
    assert verdict(spark, a, b)["t"].status == "fail"
