import random

import pandas as pd
from pyspark.sql import functions as F

from framesleuth.operators import ordered


def _rows(seed=1, n=300):
    rnd = random.Random(seed)
    rows, seen = [], set()
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}"
        at = rnd.randrange(10_000)
        rows.append((key, at, i, rnd.choice([None, rnd.randrange(50)])))
    return rows


def test_number_rows_matches_sorting(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, at long, tie long, v long").repartition(5)
    got = {(r.k, r.tie): r.ordinal for r in ordered.number_rows(df, ["k"], ["at", "tie"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for pos, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[(key, r[2])] = pos
    assert got == want


def test_scans_match_brute_force(spark):
    rows = _rows(2)
    df = ordered.number_rows(spark.createDataFrame(rows, "k string, at long, tie long, v long"), ["k"], ["at", "tie"])
    v = F.col("v")
    out = ordered.scan(
        df, ["k"], "ordinal", 4,
        prev=ordered.lag(v), nxt=ordered.lead(v), last=ordered.last_known(v), before=ordered.last_known(v, False),
        after=ordered.next_known(v, False), top=ordered.running_max(v), low=ordered.running_min(v, False),
        total=ordered.running_sum(v),
    ).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.k, []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: r.ordinal)
        vals = [r.v for r in members]
        for i, r in enumerate(members):
            known = lambda xs: [x for x in xs if x is not None]
            assert r.prev == (vals[i - 1] if i else None)
            assert r.nxt == (vals[i + 1] if i + 1 < len(vals) else None)
            assert r["last"] == (known(vals[: i + 1]) or [None])[-1]
            assert r.before == (known(vals[:i]) or [None])[-1]
            assert r.after == (known(vals[i + 1:]) or [None])[0]
            assert r.top == max(known(vals[: i + 1]), default=None)
            assert r.low == min(known(vals[:i]), default=None)
            assert r.total == sum(known(vals[: i + 1]))


def test_range_totals_match_brute_force(spark):
    rnd = random.Random(3)
    pts = [("a" if rnd.random() < 0.7 else "b", rnd.randrange(100), rnd.randrange(1, 9)) for _ in range(200)]
    rngs = [(rnd.choice("ab"), f"r{i}", *(lambda s: (s, s + rnd.randrange(0, 30)))(rnd.randrange(100))) for i in range(30)]
    points = spark.createDataFrame(pts, "k string, at long, size long")
    ranges = spark.createDataFrame(rngs, "k string, rid string, lo long, hi long")
    for closed in (True, False):
        got = {r.rid: (r.points, r.total) for r in
               ordered.range_totals(points, ranges, ["k"], "at", "size", "lo", "hi", "rid", closed, 8).collect()}
        for k, rid, lo, hi in rngs:
            inside = [s for kk, a, s in pts if kk == k and lo <= a and (a <= hi if closed else a < hi)]
            assert got[rid] == (len(inside), sum(inside)), (closed, rid)
