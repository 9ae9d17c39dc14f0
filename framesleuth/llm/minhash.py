"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.components import components
from framesleuth.llm.encoding import slices
from framesleuth.llm.registry import query, table
from framesleuth.llm.shingles import WIDTH

#: A pair at similarity 0.85 shares no band of 8 coordinates with probability 3e-7.
BANDS, ROWS = 48, 8
PERCENT = 85


class Circulant:
    """Signature coordinates from two permutations of the 32-bit numbers.

    The first permutes the shingles once; coordinate ``k`` is the least value
    of the second, shifted circularly by ``k``.
    """

    def __init__(self, size: int):
        import numpy as np

        self.shifts = np.arange(size, dtype="u4")[:, None]

    @staticmethod
    def second(x):
        import numpy as np

        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        return x

    def signature(self, hashes, at_once: int = 512):
        import numpy as np

        first = (hashes >> np.uint64(32)).astype("u4")  # shingle hashes are mixed already
        least = np.full(len(self.shifts), 0xFFFFFFFF, "u4")
        for k in range(0, len(first), at_once):
            np.minimum(least, self.second(first[None, k : k + at_once] - self.shifts).min(axis=1), out=least)
        return least


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: set size, a 128-bit digest of the set and one key for each band; ``row_key`` is a hash of id and text."""
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")

    def task(batches):
        import numpy as np
        import pyarrow as pa

        from framesleuth.llm.shingles import mix, shingle_sets

        circulant = Circulant(bands * rows)
        salts = mix(np.arange(1, rows + 1, dtype="u8")) | np.uint64(1)
        number = mix(np.arange(1, bands + 1, dtype="u8") << np.uint64(20))
        for batch in batches:
            for some in slices(batch, 2_000_000):
                sets = shingle_sets(some.column(2), width)
                keys = np.zeros((len(sets), bands), "u8")
                for i, held in enumerate(sets):
                    if len(held):
                        signature = circulant.signature(held).reshape(bands, rows).astype("u8")
                        keys[i] = mix((signature * salts).sum(axis=1, dtype="u8") + number)
                one = np.array([x.sum(dtype="u8") for x in sets], "u8")
                two = np.array([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype="u8") for x in sets], "u8")
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(one.view("i8")), pa.array(two.view("i8")),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, "i4")), pa.array(keys.ravel().view("i8"))),
                ], ["doc_id", "row_key", "n_shingles", "one", "two", "bands"])

    return held.mapInArrow(task, "doc_id long, row_key long, n_shingles long, one long, two long, bands array<long>")


def sets_of(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, shingles)``: the whole set of hashed shingles of each row of ``(doc_id, text)``."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        from framesleuth.llm.shingles import shingle_sets

        for batch in batches:
            for some in slices(batch, 2_000_000):
                sets = shingle_sets(some.column(1), width)
                ends = np.cumsum([0, *map(len, sets)])
                values = np.concatenate(sets) if sets else np.zeros(0, "u8")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(values.view("i8")))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose whole sets are similar enough."""
    wanted = scratch.few(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets, _ = scratch.write(sets_of(texts.join(wanted, "doc_id"), width), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


#: Buckets of at most so many sets have all their pairs compared at once.
TINY = 8
#: Sets, and hashes in them, that one side of a compared block holds, about.
BLOCK_SETS, BLOCK_HASHES = 256, 400_000


def _shared(left: list, right: list, columns: int = 8192):
    """Number of common hashes of each set of the one and of the other list."""
    import numpy as np

    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), "i8")
    where_a, where_b = np.searchsorted(both, a), np.searchsorted(both, b)
    hit_a, hit_b = np.isin(a, both), np.isin(b, both)
    row_a, row_b = np.repeat(np.arange(len(left)), [len(x) for x in left])[hit_a], np.repeat(np.arange(len(right)), [len(x) for x in right])[hit_b]
    where_a, where_b = where_a[hit_a], where_b[hit_b]
    for k in range(0, len(both), columns):
        x, y = np.zeros((len(left), columns), "f4"), np.zeros((len(right), columns), "f4")
        inside = (where_a >= k) & (where_a < k + columns)
        x[row_a[inside], where_a[inside] - k] = 1
        inside = (where_b >= k) & (where_b < k + columns)
        y[row_b[inside], where_b[inside] - k] = 1
        out += (x @ y.T).astype("i8")
    return out


def _across(open_rows: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside the buckets of ``open_rows``.

    Rows are ``(key, doc_id, component, n, shingles)``.  Rows outside their
    bucket's largest component are compared with all others, in blocks of
    bounded size, and a block gives one link for each pair of components.
    """
    counts = open_rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("h"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("c", -F.col("component"))).alias("top"), F.sum("c").alias("all_c"), F.sum("h").alias("all_h"))
    blocks = F.ceil(F.greatest(F.col("all_c") / BLOCK_SETS, F.col("all_h") / BLOCK_HASHES))
    sizes, _ = scratch.write(sizes.select("key", (-F.col("top.col2")).alias("main"), blocks.cast("int").alias("blocks")), "sizes")
    rows = open_rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.where("component <> main").select("key", F.col("own").alias("i"), every.alias("j"), "doc_id", "component", "shingles")
    right = rows.select(F.col("key").alias("key"), every.alias("i"), F.col("own").alias("j"), *(F.col(c).alias(c) for c in ("doc_id", "component", "shingles")))

    def block(x, y):
        import numpy as np
        import pandas as pd

        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series(dtype="i8"), "b": pd.Series(dtype="i8")})
        x_sets, y_sets = [np.asarray(s) for s in x["shingles"]], [np.asarray(s) for s in y["shingles"]]
        both = _shared(x_sets, y_sets)
        total = np.array([len(s) for s in x_sets])[:, None] + np.array([len(s) for s in y_sets]) - both
        one, two = x["component"].to_numpy(), y["component"].to_numpy()
        at_x, at_y = np.nonzero((100 * both >= percent * total) & (one[:, None] != two))
        found = pd.DataFrame({"a": x["doc_id"].to_numpy()[at_x], "b": y["doc_id"].to_numpy()[at_y], "p": np.minimum(one[at_x], two[at_y]), "q": np.maximum(one[at_x], two[at_y])})
        return found.drop_duplicates(["p", "q"])[["a", "b"]]

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInPandas(block, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of at least ``percent`` in a hundred.

    Per row of ``(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``, and
    ``row_key`` (a hash of id and text) and ``group_key``, which differs between
    groups even where one id stands on rows of both; null for rows linked with
    nothing.
    Equal sets become one class first.  Classes that share a band are
    candidates: a bucket's most connected class is compared with all others (in
    tiny buckets all are compared), links are closed to components, and classes
    of a bucket still in different components are compared in blocks.  Every
    candidate pair is thus either compared on whole sets or already connected.
    Documents without words, null texts and null ids are linked with nothing
    and kept; repeated rows are linked as equal sets; rows of one id with
    different texts are documents of their own; an empty table gives no rows.
    """
    with scratch.temporary(docs.sparkSession):
        return scratch.keep(_near_duplicates(docs, percent, width, bands, rows), "groups")


def _near_duplicates(docs: DataFrame, percent: int, width: int, bands: int, rows: int) -> DataFrame:
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch, _ = scratch.write(sketches(held, width=width, bands=bands, rows=rows), "sketch")
    digest = ["n_shingles", "one", "two"]
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Row keys stand for documents from here on, so an id on several texts does no harm.
    classes, _ = scratch.write(some.groupBy(*digest).agg(F.min("row_key").alias("class_id"), F.min("doc_id").alias("least_id")), "classes")
    texts = held.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    banded = sketch.join(classes.select("class_id", *digest), (sketch["row_key"] == classes["class_id"]) & (sketch["one"] == classes["one"]) & (sketch["two"] == classes["two"])).select("class_id", sketch["n_shingles"].alias("n"), "bands")
    rows_of = banded.dropDuplicates(["class_id"]).select(F.col("class_id").alias("doc_id"), "n", F.explode("bands").alias("key"))
    sizes = rows_of.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets, _ = scratch.write(rows_of.join(sizes, "key"), "buckets")

    popular = buckets.groupBy("doc_id").agg(F.sum("size").alias("popular"))
    centres = buckets.join(popular, "doc_id").groupBy("key").agg(F.max(F.struct("popular", -F.col("doc_id"), "n")).alias("c"))
    centres, _ = scratch.write(centres.select("key", (-F.col("c.col2")).alias("b"), F.col("c.n").alias("bn")), "centres")
    alike = f"100 * least(n, bn) >= {percent} * greatest(n, bn)"
    pair = (F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b"))
    starry = buckets.where(F.col("size") > TINY).join(centres, "key").where("doc_id <> b").where(alike).select(*pair)
    tiny = buckets.where(F.col("size") <= TINY)
    other = tiny.select("key", F.col("doc_id").alias("b"), F.col("n").alias("bn"))
    pairs, _ = scratch.write(starry.unionByName(tiny.join(other, "key").where("doc_id > b").where(alike).select(*pair)).distinct(), "pairs")
    links, _ = scratch.write(_confirmed(pairs, texts, percent, width), "links")
    joined, _ = scratch.write(components(links), "components")

    rest = buckets.where(F.col("size") > TINY).join(centres.select("key", F.col("b").alias("centre")), "key").where("doc_id <> centre")
    rest = rest.join(joined, rest["doc_id"] == joined["node"], "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    rest, _ = scratch.write(rest, "rest")
    open_keys = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_rows, _ = scratch.write(rest.join(open_keys, "key"), "open")
    sets, _ = scratch.write(sets_of(texts.join(scratch.few(open_rows.select("doc_id").distinct(), "wanted"), "doc_id"), width).dropDuplicates(["doc_id"]), "sets")
    more, _ = scratch.write(_across(open_rows.join(sets, "doc_id"), percent), "links")
    final, _ = scratch.write(components(links.unionByName(more)), "components")

    named = classes.join(final, classes["class_id"] == final["node"], "left").select(*digest, "least_id", F.coalesce("component", "class_id").alias("group_key"))
    named, _ = scratch.write(named, "named")
    least = named.groupBy("group_key").agg(F.min("least_id").alias("component"))
    named, _ = scratch.write(named.drop("least_id").join(least, "group_key"), "named")
    linked = F.col("doc_id").isNotNull()
    out = sketch.join(named, digest, "left").select("doc_id", "n_shingles", F.when(linked, F.coalesce("component", "doc_id")).alias("component_id"), "row_key", F.when(linked, F.col("group_key")).alias("group_key"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query("op10_circulant_minhash")
def op10_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents at similarity 0.85."""
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
