import pytest
from pyspark.sql import functions as F

from framesleuth.functions import labels, metadata, names, rational

TITLES = {
    "The.Big.Film.2003.1080p.WEB-DL.x264": "The Big Film (2003).mkv",
    "show_name.s01e02e03.The.End.720p": "show name - S01E02E03 - The End.mkv",
    "Movie (1999) [1080p]": "Movie (1999).mkv",
    "2012": "2012.mkv",
    "Blade.2049": "Blade 2049.mkv",
    "What: Is/This?": "What Is This.mkv",
    "HDTVision": "HDTVision.mkv",
    "con": None,
    "1080p.x265": None,
}


def test_clean_titles(spark):
    df = spark.createDataFrame([(k,) for k in TITLES], "stem string")
    got = {r.stem: r.t for r in df.select("stem", names.clean_title(F.col("stem"), 2026).alias("t")).collect()}
    assert got == TITLES


@pytest.mark.parametrize("num,den,want", [(5, 2, 3), (-5, 2, -3), (7, 5, 1), (-7, 5, -1), (0, 3, 0), (-1, 2, -1)])
def test_nearest_tick_rounds_halves_away_from_zero(spark, num, den, want):
    assert spark.range(1).select(rational.nearest_tick(F.lit(num), F.lit(den)).alias("x")).first().x == want


def test_ratios(spark):
    rows = [("16:9", "32/18", True), ("1:1", None, False), (None, None, True), ("a", "a", True), ("0:1", "0/1", False), ("4:3", "3:4", False), ("2", "4/2", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", rational.equivalent_ratio(F.col("a"), F.col("b")).alias("got")).collect())


def test_packet_ticks_refuse_disagreement_and_coarse_text(spark):
    f = lambda raw, num, den, us: spark.range(1).select(rational.packet_ticks(F.lit(raw).cast("long"), F.lit(num), F.lit(den), F.lit(us)).alias("x")).first().x
    assert f(90, 1, 90000, 1000) == 90
    assert f(91, 1, 90000, 1000) is None
    assert f(None, 1, 90000, 1000) == 90
    assert f(None, 1, 10_000_000, 1000) is None


def test_metadata_forms(spark):
    matrix = "00000000: 0 65536 0\n00000001: -65536 0 0\n00000002: 0 0 1073741824\n"
    one = spark.range(1).select(
        metadata.display_matrix(F.lit(matrix)).alias("m"), metadata.display_matrix(F.lit("x")).alias("bad"), metadata.lowest_terms(F.lit("35400/50000")).alias("low"),
        labels.human_size(F.lit(1152)).alias("s"), labels.natural_key(F.lit("a10")).alias("n10"), labels.natural_key(F.lit("a9")).alias("n9"),
        labels.csv_cell(F.lit(' =x"')).alias("c"), labels.phase_category(F.lit("Waiting for validation resources (2)")).alias("p"),
    ).first()
    assert one.m == [0, 65536, 0, -65536, 0, 0, 0, 0, 1073741824] and one.bad is None and one.low == "177/250"
    assert one.s == "1.12 KiB" and one.n9 < one.n10 and one.c == '"\' =x"""' and one.p == "validation_wait"


def test_natural_key_orders_numbers_of_any_length(spark):
    texts = ["a5", "a10", "a007", "a100000000000000000000", "a99999999999999999999", "A6", "b", "a"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["t"] for r in frame.orderBy(labels.natural_key(F.col("t"))).collect()]
    assert got == ["a", "a5", "A6", "a007", "a10", "a99999999999999999999", "a100000000000000000000", "b"]


def test_natural_key_of_very_long_numbers(spark):
    from framesleuth.functions.labels import natural_key

    texts = ["a" + "9" * 9_999, "a1" + "0" * 9_999, "a2" + "0" * 9_999, "a" + "9" * 12_000 + "b", "ab", "a" + "0" * 20_000 + "7", "a10"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", natural_key(F.col("t")).alias("k")).collect()
    got = [r["t"] for r in sorted(rows, key=lambda r: r["k"])]
    digits = lambda t: t[1:].rstrip("b").lstrip("0")
    assert got == sorted(texts, key=lambda t: (t == "ab", len(digits(t)), digits(t), t)) and len({r["k"] for r in rows}) == len(texts)
