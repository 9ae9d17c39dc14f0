"""Operators on whole document texts against plain versions and hostile rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from framesleuth.llm import katz, minhash, packing, scratch, tokens
from framesleuth.llm.encoding import WordEncoder

SCHEMA = "doc_id long, text string, label int, kept string, row_key string, component string, toxic string, bands int, key int"
LONG = " ".join(f"w{k % 9973}" for k in range(60_000))
#: Null and empty texts, white space only, one word, ties, repeats, a very long text and a null id.
ROWS = [(i, t, 1, "x", "y", "z", "t", 0, 1) for i, t in [
    (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "ONE"), (10, "a b c d e f g h"), (11, "a b c d e f g h"), (11, "a b c d e f g h"), (3, LONG), (4, LONG + " end"), (12, "naïve Été, don't <|endoftext|> 日本"),
]]


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def texts(n=250, seed=3):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    out = []
    for i in range(n):
        if out and random.random() < 0.6:
            w = random.choice(out)[1].split()
            for _ in range(random.randrange(3)):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            out.append((i, " ".join(w)))
        else:
            out.append((i, " ".join(random.choices(vocabulary, k=random.randrange(1, 90)))))
    return out


def test_encoder_equals_library():
    random.seed(1)
    parts = ["a", "don't", "It's", "été", " ", "  ", "\n", "\t", "\r\n", "\xa0", "x1", "½", "...", ".", ",", "|", "<|endoftext|>", "日本", "é", "İ", "ΑΣ", "a\x1cb", "\0", "'s", "😀", "İ|"]
    held = ["".join(random.choice(parts) + random.choice(["", " ", "\n"]) for _ in range(random.randrange(12))) for _ in range(4000)] + [None, "", " "]
    for name, kept, width in (("word_bpe_49k.json", False, 4), ("byte_bpe_50k.json", True, 2)):
        mine, plain = WordEncoder(public_tokenizers.path(name), kept, width), Tokenizer.from_file(public_tokenizers.path(name))
        plain.encode_special_tokens = True
        got = [x for k in range(0, len(held), 500) for x in mine.encode(held[k : k + 500])]
        want = plain.encode_batch([t or "" for t in held], add_special_tokens=False)
        assert [np.frombuffer(g, f"<u{width}").tolist() for g in got] == [w.ids for w in want]


def test_token_files(spark, hostile, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    folder = str(tmp_path / "ids")
    tokens.write_token_files(hostile, folder, path, 1)
    got = sorted(tokens.token_digests(spark, folder).collect(), key=lambda r: (r["doc_id"], r["start"]))
    start = 0
    for r, (i, text, *_) in zip(got, sorted(ROWS, key=lambda r: r[0]), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = tokens.lookup(spark, folder, [12])
    assert "EqualTo(doc_id,12)]" in found._jdf.queryExecution().toString()
    assert [r["doc_id"] for r in found.collect()] == [12]
    empty = str(tmp_path / "empty")
    tokens.write_token_files(hostile.limit(0), empty, path, 1)
    assert tokens.token_digests(spark, empty).count() == 0


def test_packing(spark, hostile):
    path, capacity = public_tokenizers.path("byte_bpe_50k.json"), 64
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    got = packing.pack_documents(hostile, path, 0, capacity).collect()
    by_document, by_sequence = {}, {}
    for r in got:
        by_document.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_document[i], key=lambda r: r["piece"])
        if i != 11:  # two equal rows
            assert [x for r in mine for x in np.frombuffer(r["ids"], "<u2")] == ids and all(r["length"] == capacity for r in mine[1:])
            assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1]]
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [0, *np.cumsum([r["length"] for r in held])[:-1]] and sum(r["length"] for r in held) <= capacity
    assert packing.pack_documents(hostile.limit(0), path, 0, capacity).count() == 0


def test_encoder_equals_untouched_library():
    random.seed(6)
    parts = ["a", "It's", "été", " ", "\n", "\xa0", "x1", ".", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "日本", "İ"]
    held = ["".join(random.choice(parts) + random.choice(["", " ", "\n"]) for _ in range(random.randrange(12))) for _ in range(3000)] + [None, ""]
    for name, kept, width in (("word_bpe_49k.json", False, 4), ("byte_bpe_50k.json", True, 2)):
        mine, plain = WordEncoder(public_tokenizers.path(name), kept, width, encode_special_tokens=False), Tokenizer.from_file(public_tokenizers.path(name))
        got = [x for k in range(0, len(held), 500) for x in mine.encode(held[k : k + 500])]
        want = plain.encode_batch([t or "" for t in held], add_special_tokens=False)
        assert [np.frombuffer(g, f"<u{width}").tolist() for g in got] == [w.ids for w in want]


def test_queries_encode_as_the_untouched_library(spark, tmp_path):
    held = ["the end <|endoftext|> next", "plain text", "<|startoftext|>a<|endoftext|>b"]
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    start, want = 0, []
    for i, text in enumerate(held):
        ids = np.array([*word.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.op4_token_orc(spark, str(tmp_path)).collect())) == want
    crc = {i: zlib.crc32(np.array([*byte.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, text in enumerate(held)}
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.op9_best_fit_packing(spark, str(tmp_path)).collect()} == crc
    assert {r["doc_id"]: r["ids_crc32"] for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()} == crc


def test_packing_groups_exchange(spark):
    random.seed(2)
    lengths = [random.choice([900, 1100, 700, 300, 1347, 2047, 2048, 5]) for _ in range(3000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "piece_key long, length long")
    many = packing.pack(pieces, 2048, group_pieces=100).collect()
    assert len(many) == len(lengths)
    bound = packing.lower_bound(np.bincount(lengths, minlength=2049), 2048)
    alone = len(packing.best_fit(lengths, 2048)[2])
    bins = len({r["sequence_id"] for r in many})
    assert bound <= alone <= bins <= alone + 12


@pytest.mark.parametrize("capacity", [10, 37])
def test_lower_bound_is_one(capacity):
    random.seed(capacity)
    for _ in range(200):
        fills = []
        lengths = []
        for _ in range(random.randrange(1, 6)):  # cut whole bins, so their number is best
            cuts = sorted({0, capacity, *random.sample(range(1, capacity), random.randrange(0, 4))})
            lengths += np.diff(cuts).tolist()
            fills.append(capacity)
        assert packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity) == len(fills)


def test_near_duplicates_equal_brute_force(spark):
    rows = texts()
    want, sizes = brute.near_documents(rows)
    assert 20 < len(set(want.values())) < len(rows) - 20
    for tiny in (minhash.TINY, 1):  # 1: all buckets go through centres and blocks
        held, minhash.TINY = minhash.TINY, tiny
        try:
            got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        finally:
            minhash.TINY = held
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(got[i]["n_shingles"] == n and got[i]["kept"] == (want[i] == i) for i, n in sizes.items())


def test_near_duplicates_hostile(spark, hostile):
    with_null = hostile.unionByName(spark.createDataFrame([(None, "a b c d e f g h", 1, "x", "y", "z", "t", 0, 1)], SCHEMA))
    got = minhash.near_duplicates(with_null).collect()
    assert len(got) == len(ROWS) + 1
    want = {5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 10, 3: 3, 4: 3, 12: 12, None: None}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(hostile.limit(0)).count() == 0


@pytest.mark.parametrize("lot_bytes", [8_000_000, 3_000])
def test_katz_equals_brute_force(spark, lot_bytes):
    rows = [*texts(120, 7), (500, None), (501, ""), (502, "never seen before"), (503, LONG[:2000])]
    want, probability, single = brute.katz(rows, katz.discounts, katz.SPARE)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = katz.score_documents(docs, "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 = 2", lot_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4]) and r["score"] == pytest.approx(w[5])
    for history in ("w1", "w7", "\0start", "never"):
        assert sum(probability(history, w) for w in single) + probability(history, "unknown word") == pytest.approx(1)


def test_katz_hostile(spark, hostile):
    got = {r["doc_id"]: r for r in katz.score_documents(hostile, "doc_id = 12").collect()}
    assert got[5]["n_tokens"] == got[6]["n_tokens"] == got[7]["n_tokens"] == 1 and got[12]["held_out"] and got[12]["n_known"] < got[12]["n_tokens"]
    none = katz.score_documents(hostile, "true").collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in none)
    assert katz.score_documents(hostile.limit(0), "false").count() == 0


def test_discounts_lie_between_zero_and_one():
    assert katz.discounts([0, 100, 40, 20, 12, 8, 6])[1:] == pytest.approx([d for d in katz.discounts([0, 100, 40, 20, 12, 8, 6])[1:] if 0 < d < 1])
    assert katz.discounts([0, 0, 0, 0, 0, 0, 0]) == [0.0, 0.5, 0.75]


def test_temporary_tables_go(spark):
    with scratch.temporary(spark):
        gone = scratch.write(spark.range(3), "gone")[1]
        left = scratch.keep(spark.range(4), "left")
    assert left.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(gone).count()
