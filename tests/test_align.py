import random

from framesleuth.operators import align

P = "track string, ordinal long, hash string, pts long, dts long, dur long"
S = "sample_id string, " + P


def brute(source, sample):
    n = len(sample)
    return [i + 1 for i in range(len(source) - n + 1) if all(source[i + j][2] == sample[j][2] for j in range(n))]


def test_slices_match_brute_force_even_with_repeated_payloads(spark):
    rnd = random.Random(5)
    source, samples, want = [], [], {}
    for t in range(8):
        alphabet = "ab" if t % 2 else "a" * 9 + "b"
        track = [(f"t{t}", i + 1, rnd.choice(alphabet), i * 100, i * 100 - 7, 100) for i in range(60)]
        source += track
        for k in range(4):
            start, n = rnd.randrange(0, 40), rnd.randrange(3, 18)
            cut = [(f"s{t}.{k}", r[0], j + 1, r[2], r[3] - 5000, r[4] - 5000, r[5]) for j, r in enumerate(track[start:start + n])]
            if k == 3:
                cut[1] = (*cut[1][:3], "z", *cut[1][4:])
            samples += cut
            want[f"s{t}.{k}"] = brute(track, [c[1:] for c in cut])
    found = align.align_slices(spark.createDataFrame(source, P), spark.createDataFrame(samples, S), ["track"], block_rows=7).collect()
    assert len(found) == len(want)
    for r in found:
        hits = want[r.sample_id]
        assert r.payload_matches == len(hits), r
        assert r.start == (hits[0] if len(hits) == 1 else None)
        assert (r.status == "pass") == (len(hits) == 1)
        if r.status == "pass":
            assert r["shift"] == -5000


def brute_keyframes(keys, req, sec, span, end, tick=1):
    starts = [(p, d) for p, d in keys if max(0, req - 2 * span) <= p <= req + span and p + sec <= end and d >= tick]
    pairs = [(p, d, q, e) for p, d in starts for q, e in keys if max(p, req) + sec <= q <= min(end, p + 2 * span) and e > d]
    return min(pairs, key=lambda x: (x[0] < req, abs(x[0] - req), x[2], x[1]), default=None)


def test_keyframes_match_brute_force_with_backward_decode_clocks(spark):
    rnd = random.Random(6)
    packets, requests, want = [], [], {}
    for t in range(12):
        keys = []
        at = 0
        for _ in range(50):
            at += rnd.randrange(1, 40)
            dts = at - rnd.choice([0, 3, 30]) + rnd.choice([0, 0, 60])
            keys.append((at, dts))
            packets.append((f"t{t}", at, dts, "K__"))
            packets.append((f"t{t}", at + 1, dts, "___"))
            packets.append((f"t{t}", at, dts, "KD_"))
        for i in range(3):
            req, sec = rnd.randrange(0, at), rnd.randrange(5, 40)
            span = sec + rnd.randrange(0, 40)
            requests.append((f"t{t}", i, req, sec, span, at))
            want[(f"t{t}", i)] = brute_keyframes(keys, req, sec, span, at) if at > req else None
    got = align.plan_keyframes(
        spark.createDataFrame(packets, "track string, pts long, dts long, flags string"),
        spark.createDataFrame(requests, "track string, request_id long, requested long, seconds long, span long, source_end long"), ["track"], block_rows=8,
    ).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[(r.track, r.request_id)]
        assert (None if r.keyframe_pts is None else (r.keyframe_pts, r.keyframe_dts, r.end_keyframe_pts)) == (w[:3] if w else None), (r, w)


def test_unique_in_band(spark):
    records = spark.createDataFrame([("a", x) for x in (10, 20, 21, 40)], "track string, at long")
    values = spark.createDataFrame([("a", 1, 11), ("a", 2, 20), ("a", 3, 30), ("a", 4, 42)], "track string, value_id long, value long")
    got = {r.value_id: (r.candidates, r.matched_at) for r in align.unique_in_band(records, values, ["track"], 2, 2).collect()}
    assert got == {"1": (1, 10), "2": (2, None), "3": (0, None), "4": (1, 40)}
