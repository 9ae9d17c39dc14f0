"""Records of large JSON documents in any layout, read in parallel.

A document is ``{..., "name": [{...}, {...}], ...}`` or ``[{...}, {...}]``, pretty-printed,
on one line or anything between.  The text reader cuts a file at every closing
brace, so one file is split over many tasks and no document is held in a row.
Whether a piece begins inside a string, and how deep in brackets, follows from
running sums of quotes and brackets over the pieces in order; with these each
piece knows if it begins, continues or ends a record, and only the pieces of one
record are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.functions.checks import holds
from framesleuth.operators import ordered
from framesleuth.session import materialise

_BRACE = "}"
#: A key and the bracket that opens its array of objects; or that of the document itself.
_NAMED = r'(?s)^.*?"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*(?=\{)'
_UNNAMED = r"(?s)^(\s*)\[\s*(?=\{)"


def _depth_change(outside: Column) -> Column:
    """Brackets opened less brackets closed in text without strings."""
    return F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))


def _without_strings(text: Column, inside: Column) -> Column:
    """Text outside strings; ``inside`` says that a string is open where it begins."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    return F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), plain), '(?s)"[^"]*("|$)', "")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, ordinal, text``: a file's text in order, cut after every closing brace."""
    rows = spark.read.option("lineSep", _BRACE).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))
    placed = ordered.number_rows(rows.withColumn("place", F.monotonically_increasing_id()), ["file"], ["block", "place"])
    # The last piece had a brace too if all pieces with braces make up the whole file.
    held = placed.groupBy("file").agg(F.sum(F.octet_length("text") + 1).alias("held"), F.max("ordinal").alias("last"))
    cut = placed.join(held, "file")
    bare = (F.col("ordinal") == F.col("last")) & (F.col("held") > F.col("bytes"))
    return cut.select("file", "ordinal", F.when(bare, F.col("text")).otherwise(F.concat("text", F.lit(_BRACE))).alias("text"))


def array_pieces(spark: SparkSession, path: str, array: str | None, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Pieces of all files of ``path`` with their part in the records of ``array``.

    ``file, ordinal, record`` (records begun so far), ``begins``, ``within`` (part of
    a record), ``ends``, ``name`` (array of the record), ``lead`` (text between the
    record before and this one), ``body`` and ``depth`` (where the piece ends).
    """
    level = 2 if array is not None else 1
    quotes = F.length(F.regexp_replace(F.regexp_replace("text", r"(?s)\\.", ""), '[^"]', ""))
    rows = ordered.scan(_pieces(spark, path).withColumn("quotes", quotes), ["file"], "ordinal", block_rows, quoted=ordered.running_sum(F.col("quotes"), inclusive=False))
    inside = F.coalesce("quoted", F.lit(0)) % 2 == 1
    opening = _NAMED if array is not None else _UNNAMED
    rows = rows.withColumn("inside", inside).withColumn("outside", _without_strings(F.col("text"), F.col("inside"))).select(
        "file", "ordinal", "text", "inside", _depth_change(F.col("outside")).alias("change"), F.col("outside").endswith(_BRACE).alias("closes"),
        # Few pieces hold an opening; the longer search is for those alone.
        F.when(F.col("text").rlike(r"\[\s*\{"), F.regexp_extract("text", opening, 0)).otherwise("").alias("head"),
    )
    rows = ordered.scan(materialise(rows, "json-pieces"), ["file"], "ordinal", block_rows, above=ordered.running_sum(F.col("change"), inclusive=False))
    depth, head = F.coalesce("above", F.lit(0)), F.col("head")
    follows = ~F.col("inside") & (depth == level) & F.col("text").rlike(r"(?s)^[\s,]*\{")
    opens = (head != "") & ~F.col("inside") & ~follows & (depth <= level) & (depth + _depth_change(_without_strings(head, F.lit(False))) == level)
    rows = rows.select(
        "file", "ordinal", depth.alias("above"), (depth + F.col("change")).alias("depth"), (follows | opens).alias("begins"),
        F.when(follows, F.regexp_extract("text", r"(?s)^([\s,]*)", 1)).when(opens, head).otherwise("").alias("lead"),
        F.when(follows, F.regexp_replace("text", r"(?s)^[\s,]*", "")).when(opens, F.col("text").substr(F.length(head) + 1, F.length("text"))).otherwise(F.col("text")).alias("body"),
        F.when(opens, F.regexp_extract("text", opening, 1) if array is not None else F.lit("")).alias("opened"), "closes",
    )
    rows = ordered.scan(materialise(rows, "json-pieces"), ["file"], "ordinal", block_rows, record=ordered.running_sum(F.col("begins").cast("int")), name=ordered.last_known(F.col("opened")))
    mine = F.col("name") == F.lit(array if array is not None else "")
    return rows.select("file", "ordinal", "record", "begins", (holds(mine) & (F.col("begins") | (F.col("above") > level))).alias("within"), (F.col("closes") & (F.col("depth") == level)).alias("ends"), "name", "lead", "body", "depth", "opened")


def records_of(pieces: DataFrame) -> DataFrame:
    """``array_records`` from pieces at hand."""
    parts = pieces.where("within").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("ordinal", "body"))).alias("parts"), F.max("ends").alias("closed"))
    first = parts.groupBy("file").agg(F.min("record").alias("first"))
    text = F.array_join(F.transform("parts", lambda p: p["body"]), "")
    return parts.join(first, "file").select("file", (F.col("record") - F.col("first") + 1).alias("ordinal"), text.alias("record"), "closed")


def array_records(spark: SparkSession, path: str, array: str | None = None, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """``file, ordinal, record, closed``: the text of every object of ``array``, whatever the layout.

    ``array`` is a key of the document, or null where the document itself is the
    array.  Repeated keys stay in the text.  A record that its file does not
    close is given as far as it goes, with ``closed`` false; files without the
    array give no rows.
    """
    return records_of(array_pieces(spark, path, array, block_rows))


def array_status(pieces: DataFrame, array: str | None) -> DataFrame:
    """``file, records, reason``: whether each file is one whole array, from ``array_pieces``.

    ``invalid header`` (no such array), ``truncated`` (a record or the document
    is not closed), ``trailing comma`` or ``invalid separator``; else null.
    """
    last = pieces.groupBy("file").agg(F.max(F.when(F.col("within"), F.col("ordinal"))).alias("last"))
    named = F.col("name") == F.lit(array if array is not None else "")
    after = pieces.join(last, "file").withColumn("after", F.col("ordinal") > F.col("last"))
    wrong = F.col("begins") & F.col("opened").isNull() & holds(named) & ~F.col("lead").rlike(r"^\s*,\s*$")
    facts = after.groupBy("file").agg(
        F.count_if(F.col("begins") & F.col("within")).alias("records"), F.count_if(F.col("ends") & F.col("within")).alias("closed"), F.count_if(wrong).alias("wrong"),
        F.min_by(F.concat("lead", "body"), F.when(F.col("after"), F.col("ordinal"))).alias("trailer"), F.max_by("depth", "ordinal").alias("depth"),
    )
    reason = (
        F.when(F.col("records") == 0, "invalid header").when(holds(F.col("trailer").rlike(r"^\s*,\s*\]")), "trailing comma")
        .when((F.col("closed") < F.col("records")) | (F.col("depth") != 0) | ~holds(F.col("trailer").rlike(r"^\s*\]")), "truncated").when(F.col("wrong") > 0, "invalid separator")
    )
    return facts.select("file", "records", reason.alias("reason"))
