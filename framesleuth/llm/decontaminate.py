"""Benchmark passages in documents, by SimHash of windows of the items' sizes.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.registry import query, table

WIDTH = 5
PERCENT = 80
#: Eight blocks of eight bits, each searched within two bits: of two fingerprints
#: at most 23 bits apart, some block is at most two bits apart.  A window of
#: similarity 0.8 lies on average ten bits away, more than 23 with probability 2e-6.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Shingles of the benchmark up to which they are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000

_WORDS = r"transform(filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> w <> ''), w -> xxhash64(w))"


def _shingles(words: str, size: str) -> str:
    """Hashes of the ``size``-word shingles of an array of word hashes, in order; ``size`` is 1 to 5."""
    parts = ", ".join(f"CASE WHEN {k} < {size} THEN get({words}, i + {k}) END" for k in range(WIDTH))
    return f"CASE WHEN size({words}) < {size} THEN array() ELSE transform(sequence(0, size({words}) - {size}), i -> xxhash64({size}, {parts})) END"


#: Sign of each bit's weighted sum over the shingles; a shingle weighs as often as it occurs.
_SIMHASH = "aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN 2 * aggregate(shingles, 0, (n, h) -> n + CAST(shiftright(h, b) & 1 AS INT)) > size(shingles) THEN shiftleft(1L, b) ELSE 0L END)"
#: The shingles with their occurrence numbers: as sets, their overlap is the overlap of the weighted sets.
_NUMBERED = "transform(shingles, (h, i) -> xxhash64(h, size(filter(slice(shingles, 1, i), x -> x = h))))"


def _items(benchmark: DataFrame) -> DataFrame:
    words = benchmark.where("item_id IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text")).select("item_id", F.expr(_WORDS).alias("words")).where("size(words) > 0")
    sized = words.withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(WIDTH)))
    return sized.withColumn("shingles", F.expr(_shingles("words", "k"))).select("item_id", "n", "k", "shingles", F.expr(_SIMHASH).alias("print"), F.expr(_NUMBERED).alias("numbered"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Passages of ``benchmark (item_id, text)`` in ``docs (doc_id, text)``.

    ``row_key, doc_id, item_id, n_windows, similarity``: the windows of the
    item's size whose weighted shingle similarity to the item reaches
    ``percent``, and the largest similarity.  ``row_key`` is a hash of id and
    text, so repeated rows are one, and rows with a null id are found too.

    Words are lower-case runs of letters and digits.  Every window that holds a
    shingle of an item of its size is fingerprinted, at every start, wherever the
    shingle lies in the item; a window without any has similarity 0.  (A document
    shorter than the item is one window.)  Fingerprints meet those of items within
    the radius by blocks; the similarity is then exact.
    Items with fewer than five words are one shingle; null and empty texts, and
    items without words or id, match nothing; empty tables give no rows.
    """
    with scratch.temporary(docs.sparkSession):
        return scratch.keep(_find_leaks(docs, benchmark, percent), "leaks")


def _find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    items, _ = scratch.write(_items(benchmark), "items")
    parts = items.select("n", "k", F.explode("shingles").alias("h")).distinct()
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most five numbers
    if parts.count() <= BROADCAST_SHINGLES:
        parts = F.broadcast(parts)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    worded = keyed.select("row_key", F.expr(_WORDS).alias("words")).withColumn("length", F.size("words"))
    hits = None
    for k in sizes:
        every = worded.select("row_key", "length", F.posexplode(F.expr(_shingles("words", str(k)))).alias("pos", "h"))
        # All windows that hold the shingle; those of one row are made in one task, which also drops repeats.
        first, last = F.least(F.col("pos") + k - F.col("n"), F.col("length") - F.col("n")), F.least(F.col("pos"), F.col("length") - F.col("n"))
        starts = F.explode(F.sequence(F.greatest(F.lit(0), first), F.greatest(F.lit(0), last))).alias("start")
        found = every.join(parts.where(F.col("k") == k).drop("k"), "h").select("row_key", F.lit(k).alias("k"), "n", starts)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "row_key long, doc_id long, item_id long, n_windows long, similarity double")
    hits, _ = scratch.write(hits.distinct(), "hits")

    keys = scratch.few(hits.select("row_key").distinct(), "keys")
    texts = keyed.join(keys, "row_key").dropDuplicates(["row_key"]).select("row_key", "doc_id", F.expr(_WORDS).alias("words"))
    texts, _ = scratch.write(texts, "texts")
    cut = hits.join(texts, "row_key").select("row_key", "doc_id", "k", "n", "start", F.expr("slice(words, start + 1, n)").alias("words"))
    cut = cut.withColumn("shingles", F.expr(_shingles("words", "k"))).drop("words")
    windows, _ = scratch.write(cut.withColumn("print", F.expr(_SIMHASH)).withColumn("content", F.xxhash64("shingles")), "windows")

    # Equal windows are searched once.
    kinds = windows.groupBy("k", "n", "print", "content").agg(F.first("shingles").alias("shingles")).withColumn("numbered", F.expr(_NUMBERED)).drop("shingles")
    kinds, _ = scratch.write(kinds, "kinds")
    block = f"(shiftright(print, {BLOCK_BITS} * block) & {(1 << BLOCK_BITS) - 1})"
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    near = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]
    probes = items.select("item_id", "k", "n", F.col("print").alias("item_print"), F.col("print"), blocks)
    probes = probes.select("item_id", "k", "n", "item_print", "block", F.expr(block).alias("own"), F.explode(F.array(*map(F.lit, near))).alias("flip"))
    probes = probes.select("item_id", "k", "n", "item_print", "block", F.expr("own ^ flip").alias("value"))
    cells = kinds.select("k", "n", "print", "content", blocks).withColumn("value", F.expr(block))
    pairs = cells.join(probes, ["k", "n", "block", "value"]).where(F.expr(f"bit_count(print ^ item_print) <= {RADIUS}")).select("k", "n", "print", "content", "item_id").distinct()
    both = F.size(F.array_intersect("numbered", "item_numbered"))
    exact = pairs.join(kinds, ["k", "n", "print", "content"]).join(items.select("item_id", F.col("numbered").alias("item_numbered")), "item_id")
    exact = exact.withColumn("both", both).withColumn("either", F.size("numbered") + F.size("item_numbered") - F.col("both")).where(f"100 * both >= {percent} * either")
    exact, _ = scratch.write(exact.select("k", "n", "print", "content", "item_id", (F.col("both") / F.col("either")).alias("similarity")), "exact")
    return windows.join(exact, ["k", "n", "print", "content"]).groupBy("row_key", "doc_id", "item_id").agg(F.count_distinct("start").alias("n_windows"), F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage."""
    leaks = scratch.few(find_leaks(docs, benchmark, percent).select("row_key").distinct(), "leaks")
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return docs.join(leaks, key == leaks["row_key"], "left_anti")


ORACLE = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
     items AS (SELECT item_id, words, len(words) AS n, least(len(words), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM benchmark) WHERE len(words) > 0),
     item_shingles AS (SELECT item_id, n, k, spot, array_to_string(words[spot + 1 : spot + k], ' ') AS h FROM (SELECT *, unnest(range(n - k + 1)) AS spot FROM items)),
     doc_shingles AS (SELECT doc_id, len(words) AS length, k, pos, array_to_string(words[pos + 1 : pos + k], ' ') AS h FROM (SELECT d.*, s.k, unnest(range(greatest(0, len(words) - s.k + 1))) AS pos FROM worded d, (SELECT DISTINCT k FROM items) s)),
     touched AS (SELECT DISTINCT doc_id, length, n, d.k, pos FROM doc_shingles d JOIN item_shingles i ON d.h = i.h AND d.k = i.k),
     windows AS (SELECT DISTINCT doc_id, n, k, unnest(range(greatest(0, least(pos + k - n, length - n)), greatest(0, least(pos, length - n)) + 1)) AS start FROM touched),
     cut AS (SELECT w.*, words[start + 1 : start + n] AS inside FROM windows w JOIN worded USING (doc_id)),
     inside AS (SELECT doc_id, n, k, start, h, count(*) AS c FROM (SELECT doc_id, n, k, start, array_to_string(inside[p + 1 : p + k], ' ') AS h FROM (SELECT *, unnest(range(greatest(0, len(inside) - k + 1))) AS p FROM cut)) GROUP BY ALL),
     weighed AS (SELECT item_id, n, k, h, count(*) AS c FROM item_shingles GROUP BY ALL),
     sizes AS (SELECT doc_id, n, k, start, sum(c) AS c FROM inside GROUP BY ALL),
     item_sizes AS (SELECT item_id, sum(c) AS c FROM weighed GROUP BY ALL),
     met AS (SELECT doc_id, item_id, start, n, k, sum(least(a.c, b.c)) AS both_c FROM inside a JOIN weighed b USING (n, k, h) GROUP BY ALL),
     exact AS (SELECT doc_id, item_id, start, both_c, s.c + t.c - both_c AS either_c FROM met JOIN sizes s USING (doc_id, n, k, start) JOIN item_sizes t USING (item_id))
SELECT doc_id, item_id, count(DISTINCT start) AS n_windows, max(both_c::DOUBLE / either_c::DOUBLE) AS similarity
FROM exact WHERE 100 * both_c >= 80 * either_c GROUP BY doc_id, item_id
"""


@query("op7_simhash_windows", ORACLE)
def op7_simhash_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a document and a benchmark item of which it holds a passage."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_key")
