"""Records of JSON arrays in any layout, cut at any byte, against the json module."""

import json
import random

import pytest

from framesleuth.sources import json_arrays


def documents():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(['a', '}', '{', '[', ']', '"', "\\", ",", ":", "\n", "é", '"frames": [{']) for _ in range(rng.randrange(6)))
    value = lambda d: rng.choice([1, None, True, 2.5, word()]) if d == 0 or rng.random() < 0.5 else rng.choice([{word(): value(d - 1) for _ in range(rng.randrange(3))}, [value(d - 1) for _ in range(rng.randrange(3))]])
    for k in range(24):
        records = [{f"k{j}": value(3) for j in range(rng.randrange(4))} for _ in range(rng.randrange(1, 30))]
        before = rng.choice([{}, {"meta": {"frames": [{"not": "these"}], "x": [1, 2]}}, {"sizes": [1, 2]}, {"other": [{"a": 1}, {"b": {}}]}])
        after = rng.choice([{}, {"more": [{"z": 1}]}, {"end": "}"}])
        yield f"d{k}.json", json.dumps({**before, "frames": records, **after}, indent=rng.choice([None, 1, 4]), ensure_ascii=rng.random() < 0.5), records


@pytest.mark.parametrize("bytes_at_once", ["64m", "1k"])
def test_records_equal_the_json_module(spark, tmp_path, bytes_at_once):
    want = {}
    for name, body, records in documents():
        (tmp_path / name).write_text(body, encoding="utf-8")
        want[name] = records
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_at_once)
    try:
        pieces = json_arrays.array_pieces(spark, str(tmp_path), "frames", block_rows=7)
        got = {}
        for r in json_arrays.array_records(spark, str(tmp_path), "frames").collect():
            assert r["closed"]
            got.setdefault(r["file"].rpartition("/")[2], {})[r["ordinal"]] = json.loads(r["record"])
        assert {n: [held[k] for k in sorted(held)] for n, held in got.items()} == want and all(sorted(h) == list(range(1, len(h) + 1)) for h in got.values())
        assert all(r["reason"] is None and r["records"] == len(want[r["file"].rpartition("/")[2]]) for r in json_arrays.array_status(pieces, "frames").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_root_arrays_and_broken_files(spark, tmp_path):
    files = {
        "whole": '[ {"a":1},\n {"b":{}} ]\n', "cut": '[{"a":1},{"b":', "open": '[{"a":1},{"b":2}', "comma": '[{"a":1},{"b":2},]', "gap": '[{"a":1} {"b":2}]', "none": '{"a":1}', "commas": '[{"a":1},,{"b":2}]',
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    status = {r["file"].rpartition("/")[2]: r["reason"] for r in json_arrays.array_status(json_arrays.array_pieces(spark, str(tmp_path), None), None).collect()}
    assert status == {"whole": None, "cut": "truncated", "open": "truncated", "comma": "trailing comma", "gap": "invalid separator", "none": "invalid header", "commas": "invalid separator"}
    got = sorted((r["file"].rpartition("/")[2], r["ordinal"], r["record"], r["closed"]) for r in json_arrays.array_records(spark, str(tmp_path)).collect())
    assert [g for g in got if g[0] in ("cut", "whole")] == [("cut", 1, '{"a":1}', True), ("cut", 2, '{"b":', False), ("whole", 1, '{"a":1}', True), ("whole", 2, '{"b":{}}', True)]


def test_one_large_file_is_many_tasks(spark, tmp_path):
    body = json.dumps({"frames": [{"pts": k, "side": [{"x": k}, {"y": "}"}]} for k in range(20_000)]})
    (tmp_path / "large.json").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = json_arrays.array_records(spark, str(tmp_path), "frames").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [json.loads(r["record"])["pts"] for r in sorted(rows, key=lambda r: r["ordinal"])] == list(range(20_000))
