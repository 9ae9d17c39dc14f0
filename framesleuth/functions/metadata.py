"""Canonical forms of tags, chapters, side data and other nested metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesleuth.functions.rational import let, ratio

# The ten mastering-display fields in payload order.
MASTERING_FIELDS = (
    "green_x", "green_y", "blue_x", "blue_y", "red_x", "red_y", "white_point_x", "white_point_y", "max_luminance", "min_luminance",
)
MASTERING = "Mastering display metadata"
CONTENT_LIGHT = "Content light level metadata"
SIDE_TYPE = "side_data_type"


def side_names(side: Column) -> Column:
    return F.transform(F.coalesce(side, F.array()), lambda m: F.coalesce(F.element_at(m, F.lit(SIDE_TYPE)), F.lit("")))


def gcd(a: Column, b: Column, steps: int = 45) -> Column:
    """Greatest common divisor by Euclid's remainder chain, a fixed number of
    steps: 45 suffice below 2^31, 90 below 2^62."""
    start = F.struct(F.abs(a).cast("long").alias("a"), b.cast("long").alias("b"))

    def step(pair: Column, _: Column) -> Column:
        return F.when(pair["b"] == 0, pair).otherwise(
            F.struct(pair["b"].alias("a"), (pair["a"] % F.nullif(pair["b"], F.lit(0))).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["a"]


def lowest_terms(text: Column) -> Column:
    """``n/d`` in lowest terms for an exact fraction; other text unchanged."""

    def reduce(x: Column) -> Column:
        divide = lambda v: F.call_function("div", v.cast("long"), F.nullif(x["g"], F.lit(0))).cast("string")
        return F.concat(divide(x["r"]["num"]), F.lit("/"), divide(x["r"]["den"]))

    with_gcd = lambda r: F.struct(r.alias("r"), gcd(r["num"], r["den"]).alias("g"))
    return F.coalesce(let(ratio(text), lambda r: F.when(r.isNotNull(), let(with_gcd(r), reduce))), text)


def canonical_side_data(side: Column) -> Column:
    """Side data with mastering fractions in lowest terms and keys in order."""

    def one(entry: Column) -> Column:
        mastering = F.element_at(entry, F.lit(SIDE_TYPE)) == MASTERING
        exact = F.when(
            mastering,
            F.transform_values(entry, lambda k, v: F.when(k.isin(*MASTERING_FIELDS), lowest_terms(v)).otherwise(v)),
        ).otherwise(entry)
        return F.array_sort(F.map_entries(exact))

    return F.transform(F.coalesce(side, F.array()), one)


def same_side_data(left: Column, right: Column) -> Column:
    """Equal side data in the same order; mastering values may be written as
    different fractions of the same number."""

    def same_value(key: Column, a: Column, b: Column, mastering: Column) -> Column:
        return (a == b) | (mastering & key.isin(*MASTERING_FIELDS) & numeric_equal(a, b))

    def same_entry(pair: Column) -> Column:
        l, r = pair["l"], pair["r"]
        mastering = F.element_at(l, F.lit(SIDE_TYPE)) == MASTERING
        values = F.forall(F.map_entries(l), lambda e: F.coalesce(same_value(e["key"], e["value"], F.element_at(r, e["key"]), mastering), F.lit(False)))
        return F.coalesce((F.size(l) == F.size(r)) & values, F.lit(False))

    a, b = F.coalesce(left, F.array()), F.coalesce(right, F.array())
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("l"), b.alias("r")), same_entry)


def quantise_for_av1(entry: Column) -> Column:
    """Mastering values at AV1 precision, as ``n/scale`` with n rounded half up."""

    def value(key: Column, text: Column) -> Column:
        scale = F.when(key == "max_luminance", 256).when(key == "min_luminance", 16384).otherwise(65536)
        n = let(ratio(text), lambda r: F.call_function("div", 2 * r["num"] * scale + r["den"], 2 * r["den"]))
        return F.when(key == SIDE_TYPE, text).otherwise(F.concat(n.cast("string"), F.lit("/"), scale.cast("string")))

    return F.when(F.element_at(entry, F.lit(SIDE_TYPE)) == MASTERING, F.transform_values(entry, value)).otherwise(entry)


def _packed(value: Column, scale: int, digits: int, limit: int) -> Column:
    """Hex of value * scale when that is a whole number inside [0, limit)."""
    scaled = let(value, lambda r: F.when((r["num"] * scale) % r["den"] == 0, F.call_function("div", r["num"] * scale, r["den"])))
    return let(scaled, lambda n: F.when((n >= 0) & (n < limit), F.lpad(F.lower(F.hex(n.cast("long"))), digits, "0")))


def mastering_payload(side: Column) -> Column:
    """Big-endian hex of the ten scaled mastering values.

    NULL when there is no mastering entry.  ``'ambiguous'`` for several entries
    and ``'inexact'`` when a field is missing or not representable.
    """
    rows = F.filter(F.coalesce(side, F.array()), lambda m: F.element_at(m, F.lit(SIDE_TYPE)) == MASTERING)
    entry = F.get(rows, F.lit(0))
    parts = []
    for position, key in enumerate(MASTERING_FIELDS):
        scale, digits, limit = (50_000, 4, 2**16) if position < 8 else (10_000, 8, 2**32)

        parts.append(_packed(ratio(F.element_at(entry, F.lit(key))), scale, digits, limit))
    text = F.concat(*parts)
    return F.when(F.size(rows) == 0, None).when(F.size(rows) > 1, "ambiguous").otherwise(F.coalesce(text, F.lit("inexact")))


def picture_signature() -> Column:
    """Text of width, height, format, aspect and colour; NULL if incomplete.

    Reads the frame columns by name; unknown colour becomes ``unknown`` and an
    undeclared aspect is empty.
    """
    sar = F.col("sar")
    undeclared = sar.isNull() | sar.isin("", "N/A", "0:1")
    aspect = F.when(undeclared, "").when(sar == "1:1", "1/1").when(ratio(sar)["num"] > 0, lowest_terms(sar))
    colors = [
        F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
        for c in ("color_range", "color_space", "color_transfer", "color_primaries", "chroma_location")
    ]
    ok = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("pix_fmt") != "") & aspect.isNotNull()
    return F.when(ok, F.concat_ws("|", F.col("width").cast("string"), F.col("height").cast("string"), "pix_fmt", aspect, *colors))


def canonical_tags(tags: Column) -> Column:
    """Tags with lower-cased names; NULL when two spellings disagree."""
    entries = F.transform(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def whole(distinct: Column) -> Column:
        names = F.array_distinct(F.transform(distinct, lambda e: e["key"]))
        return F.when(F.size(names) == F.size(distinct), F.map_from_entries(F.array_sort(distinct)))

    return let(F.array_distinct(entries), whole)


def tags_text(tags: Column) -> Column:
    """Canonical tags as ordered text, for equality and grouping."""
    return F.to_json(F.array_sort(F.map_entries(canonical_tags(tags))))


def equivalent_language(left: Column, right: Column) -> Column:
    """Equal, or both unknown: absent and ``und`` mean the same."""
    unknown = lambda c: c.isNull() | (c == "und")
    return left.eqNullSafe(right) | (unknown(left) & unknown(right))


def canonical_chapter(start: Column, end: Column, tags: Column) -> Column:
    """Chapter as (start, end, tags text); NULL for an invalid interval or tags."""
    text = tags_text(tags)
    valid = (start >= 0) & (end >= start) & canonical_tags(tags).isNotNull()
    return F.when(valid, F.struct(start.alias("start"), end.alias("end"), text.alias("tags")))


def canonical_metadata(document: Column, schema: str) -> Column:
    """Layered-HDR record text that ignores its checksum and the order of the
    extension blocks, nothing else.

    ``schema`` describes the record; a top-level ``rpu_data_crc32`` is dropped
    and ``ext_metadata_blocks`` (array of struct) is sorted.
    """
    record = F.from_json(document, schema)
    fields = [c.strip().split(" ")[0].split(":")[0] for c in _top_level(schema)]
    kept = []
    for name in fields:
        if name == "rpu_data_crc32":
            continue
        value = record[name]
        if name == "ext_metadata_blocks":
            value = F.array_sort(F.transform(value, lambda b: F.to_json(b)))
        kept.append(value.alias(name))
    return F.to_json(F.struct(*kept))


def _top_level(schema: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in schema:
        depth += (char in "<(") - (char in ">)")
        if char == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [*parts, current]


def display_matrix(text: Column) -> Column:
    """Nine integer coefficients of a three-line matrix dump; NULL if malformed."""
    def read(lines: Column) -> Column:
        cells = F.flatten(F.transform(lines, lambda row: F.split(F.trim(F.regexp_extract(row, r"^[^:]*:(.*)$", 1)), r"\s+")))
        three = F.forall(lines, lambda row: row.rlike(r"^[^:]*:\s*-?\d+\s+-?\d+\s+-?\d+\s*$"))
        whole = lambda numbers: F.when(F.forall(numbers, lambda n: n.isNotNull()), numbers)
        return F.when((F.size(lines) == 3) & three, let(F.transform(cells, lambda c: c.try_cast("int")), whole))

    return let(F.split(F.btrim(text, F.lit(" \t\r\n")), r"\r?\n"), read)


def family_key(options: Column, seconds: Column, video: Column) -> Column:
    """Work-family key: options with log paths scrubbed, video format and a
    power-of-two length bucket, hashed."""
    scrubbed = F.transform(options, lambda o: F.regexp_replace(o, r"log_path=[^:]*", "log_path=*"))
    bucket = F.floor(F.log2(F.greatest(seconds, F.lit(1.0)))).cast("long")
    return F.sha2(F.to_json(F.struct(scrubbed.alias("options"), video.alias("video"), bucket.alias("length"))), 256)


def numeric_equal(left: Column, right: Column) -> Column:
    """Equal text or equal exact number."""
    wide = lambda v: v.cast("decimal(19,0)")
    pair = F.struct(ratio(left).alias("a"), ratio(right).alias("b"))
    same = let(pair, lambda x: wide(x["a"]["num"]) * wide(x["b"]["den"]) == wide(x["b"]["num"]) * wide(x["a"]["den"]))
    return left.eqNullSafe(right) | F.coalesce(same, F.lit(False))


def metadata_equal(left: Column, right: Column) -> Column:
    """Two field maps hold the same keys and numerically equal values."""
    keys = F.map_keys(left)
    same_keys = (F.size(F.array_except(keys, F.map_keys(right))) == 0) & (F.size(left) == F.size(right))
    return same_keys & F.forall(keys, lambda k: numeric_equal(F.element_at(left, k), F.element_at(right, k)))
