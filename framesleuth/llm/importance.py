"""Importance resampling of documents towards a target set, by hashed word n-grams.

All texts of a batch are joined with a sentinel byte between them, one pass of a
regular expression finds the words of all of them, the offsets of the documents
in the joined bytes tell which word belongs to which document, and n-grams that
would cross documents are masked before they are counted.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.encoding import slices, with_scores
from framesleuth.llm.registry import query, table

#: The sentinel is no word byte, so it parts words even where a text holds it.
SENTINEL = b"\0"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ORDERS, BUCKETS = 2, 10_000
SLICE_BYTES = 1_000_000
# monotonically_increasing_id counts the rows of a partition in so many low bits.
_ROW_BITS = 33


def batch_grams(column, orders: int = ORDERS, buckets: int = BUCKETS):
    """Of an Arrow text column: number of words of each row, and row and bucket of every n-gram.

    Words are runs of digits, letters a-z and bytes from 128; A-Z count as a-z.
    An n-gram of 1 to ``orders`` consecutive words of one row falls into the
    crc32 of its words, joined by one space, modulo ``buckets``.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(column.cast(pa.string()), "").cast(pa.binary())
    sizes = pc.binary_length(texts).to_numpy().astype("i8") + len(SENTINEL)
    starts = np.cumsum(sizes) - sizes
    found = list(WORD.finditer(SENTINEL.join(texts.to_pylist()).lower()))
    words = [m[0] for m in found]
    at = np.fromiter((m.start() for m in found), "i8", len(found))
    del found
    row = np.searchsorted(starts, at, "right") - 1
    held = list(map(zlib.crc32, words))
    rows, sums = [row], [np.array(held, "i8")]
    for n in range(2, orders + 1):
        # The sum of a run goes on from that of the run without its last word, a space between.
        held = list(map(zlib.crc32, words[n - 1 :], map(zlib.crc32, repeat(b" "), held[:-1])))
        inside = row[: len(held)] == row[n - 1 :]
        rows.append(row[: len(held)][inside])
        sums.append(np.array(held, "i8")[inside])
    return np.bincount(row, minlength=len(texts)), np.concatenate(rows), np.concatenate(sums) % buckets


def gram_counts(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS):
    """Number of n-grams of all texts in each bucket; ``texts`` has the one column ``text``."""
    import numpy as np

    def task(batches):
        import pyarrow as pa

        counts = np.zeros(buckets, "i8")
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                counts += np.bincount(batch_grams(some.column(0), orders, buckets)[2], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    counts = np.zeros(buckets, "i8")
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in rows.collect():  # one row for each bucket
        counts[row["bucket"]] = row["n"]
    return counts


def gains(raw, target):
    """Floored thousandths of the log ratio of the two smoothed bucket models."""
    import numpy as np

    held, wanted, buckets = float(raw.sum()), float(target.sum()), len(raw)
    return np.floor(1000 * np.log((target + 1.0) * (held + buckets) / ((raw + 1.0) * (wanted + buckets)))).astype("i8")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in floored thousandths, fixed by the id and ``seed``; a null id counts as an empty one."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, seed: int = 7, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_features``, ``weight`` and ``score``.

    Counts of all texts of ``docs`` and ``target`` give each bucket its gain; a
    text's weight is the floored mean of the gains of its n-grams, and its score
    the weight plus Gumbel noise.  Null, empty or wordless texts have no n-grams
    and weight 0.  Repeated rows count each on its own and get equal scores.
    Empty tables are allowed; columns named as new ones are replaced.
    """
    import numpy as np

    gain = gains(gram_counts(docs.select("text"), orders, buckets), gram_counts(target.select("text"), orders, buckets))

    def score(column):
        words, rows, found = batch_grams(column, orders, buckets)
        n = np.bincount(rows, minlength=len(words))
        # Sums of integers below 2^53 are exact in doubles.
        total = np.bincount(rows, gain[found], len(words)).astype("i8")
        return [words, n, total // np.maximum(n, 1)]

    weighed = with_scores(docs, "text", {"n_words": "long", "n_features": "long", "weight": "long"}, score)
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(weighed: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: rank 1, 2, ... by score for the share drawn, else null.

    Drawn are the ``percent`` hundredths, rounded down, of the rows of at least
    ``min_words`` words that have the highest scores; ties go to smaller ids, a
    null id last, and rows equal in both are interchangeable.  The last score
    drawn is found from counts per score (scores are whole thousandths of logs,
    so there are few different ones however many rows); only rows from it on
    are ordered, over as many tasks as they need.
    """
    with scratch.temporary(weighed.sparkSession):
        return scratch.keep(_draw(weighed, percent, min_words), "drawn")


def _draw(weighed: DataFrame, percent: int, min_words: int) -> DataFrame:
    # Written, so the number that parts equal rows is fixed.
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rows, _ = scratch.write(weighed.select(*names, F.monotonically_increasing_id().alias("row")), "weighed")
    able = F.col("n_words") >= min_words
    counts = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    goal = F.floor(percent * F.sum("n").over(Window.partitionBy()) / 100)
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))
    last = counts.select("score", "n", goal.alias("goal"), upto.alias("upto")).where((F.col("upto") - F.col("n") < F.col("goal"))).agg(F.min("score").alias("last"), F.max("goal").alias("goal")).first()
    never = F.lit(None).cast("long").alias("rank")
    if last["last"] is None:
        return rows.select(*names, never)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    chosen = able & (F.col("score") >= last["last"])
    placed, _ = scratch.write(rows.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order).select(*names, F.monotonically_increasing_id().alias("place")), "placed")
    part = F.shiftright("place", _ROW_BITS)
    # One row for each partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("place").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    ranked = placed.withColumn("part", part).join(parts, "part").select(*names, F.when(rank <= last["goal"], rank).alias("rank"))
    return ranked.unionByName(rows.where(~chosen).select(*names, never))


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document; a quarter of those with 20 words is drawn towards the benchmark."""
    docs, target = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    drawn = draw(weigh(docs.select("doc_id", "text"), target).drop("text"), 25, 20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
