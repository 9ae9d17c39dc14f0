"""Near-duplicate vectors by an inverted multi-index over the two halves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.components import components
from framesleuth.llm.registry import query, table

#: Vectors that the codebooks are fitted on, at most; all vectors are indexed.
SAMPLE_ROWS = 8192
LEAST_WORDS, MOST_WORDS, CELL_ROWS = 8, 256, 256
#: Members and visitors of a cell that meet in one task, at most about.
BLOCK_ROWS = 1024


def codebook_size(vectors: int) -> int:
    """Words of each half's codebook, so the product grid has about one cell for ``CELL_ROWS`` vectors."""
    return max(LEAST_WORDS, min(MOST_WORDS, math.ceil(math.sqrt(vectors / CELL_ROWS))))


def unit(vectors):
    import numpy as np

    x = np.asarray(vectors, "f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that tiny and huge components do not leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_codebook(half, words: int, rounds: int = 12):
    """Centroids of a sample by Lloyd's rounds, from evenly spaced rows."""
    import numpy as np

    centroids = half[np.unique(np.linspace(0, len(half) - 1, min(words, len(half))).astype(int))].copy()
    for _ in range(rounds):
        own = _distances(half, centroids).argmin(axis=1)
        for k in range(len(centroids)):
            if (own == k).any():
                centroids[k] = half[own == k].mean(axis=0)
    return np.unique(centroids, axis=0)


def _distances(x, centroids):
    import numpy as np

    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1), 0)


def _bounds(half, centroids):
    """Nearest word, and the least squared distance to any vector of each word's cell.

    A vector of another cell lies beyond the plane between the two centroids.
    """
    import numpy as np

    d = _distances(half, centroids)
    own = d.argmin(axis=1)
    apart = np.sqrt(_distances(centroids, centroids))[own]
    gap = np.divide(d - d.min(axis=1, keepdims=True), 2 * apart, out=np.zeros_like(d), where=apart > 0)
    return own, gap**2


def traverse(vectors, first, second, radius2: float):
    """Own cell of each vector, and the cells that can hold one within the radius.

    The two halves' words are put in order of their bounds and the product grid
    is walked from the nearest cell on, until the sum of both bounds passes the
    radius: every vector within it lies in a visited cell, so recall is whole.
    """
    import numpy as np

    x = unit(vectors)
    cut = (x.shape[1] + 1) // 2
    own1, bound1 = _bounds(x[:, :cut], first)
    own2, bound2 = _bounds(x[:, cut:], second)
    order1, order2 = bound1.argsort(axis=1), bound2.argsort(axis=1)
    sorted1, sorted2 = np.take_along_axis(bound1, order1, 1), np.take_along_axis(bound2, order2, 1)
    cells = []
    for i in range(len(x)):
        near = []
        for k, b in enumerate(sorted1[i]):
            reach = int(np.searchsorted(sorted2[i], radius2 - b, "right"))
            if not reach:
                break
            near.append(order1[i, k] * len(second) + order2[i, :reach])
        cells.append(np.concatenate(near))
    return own1 * len(second) + own2, cells


def _grouped(linked):
    """Component of each row and column of a boolean matrix of links, -1 without links."""
    import numpy as np

    rows = np.where(linked.any(axis=1), np.arange(linked.shape[0]), -1)
    columns = np.full(linked.shape[1], -1)
    far = linked.shape[0]
    while True:
        new_columns = np.where(linked, rows[:, None], far).min(axis=0, initial=far)
        new_columns = np.where(new_columns == far, -1, new_columns)
        new_rows = np.where(linked, new_columns[None, :], far).min(axis=1, initial=far)
        new_rows = np.where(new_rows == far, -1, new_rows)
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def near_vectors(vectors: DataFrame, cosine: float = 0.98, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Links and groups of ``(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Vectors with equal labels and a cosine of at least ``cosine`` in double
    precision are linked.  Those that are null, empty, zero, or hold a null or
    non-finite component, and those with a null label or id, are linked with
    nothing and kept; vectors of different lengths are not compared.  Equal
    vectors are one class; they count as links of each other.  Repeated ids are
    rows of their own; an empty table gives no rows.

    Links are counted in blocks of a cell's members and visitors; a block gives
    counts and a star for each of its components, never pairs.
    """
    with scratch.temporary(vectors.sparkSession):
        return scratch.keep(_near_vectors(vectors, cosine, sample_rows), "groups")


def _near_vectors(vectors: DataFrame, cosine: float, sample_rows: int) -> DataFrame:
    import numpy as np

    spark = vectors.sparkSession
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.expr(
        "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    )
    held = held.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("one", F.xxhash64("embedding")).withColumn("two", F.xxhash64(F.lit(7), "embedding"))
    held, _ = scratch.write(held, "vectors")
    same = ["label", "one", "two"]
    # Classes are named by a hash of what their vectors share, so an id on several vectors does no harm.
    key = F.xxhash64("label", "one", "two").alias("class_id")
    classes = held.where("good").groupBy(*same).agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes, _ = scratch.write(classes.select("*", key), "classes")
    mine = held.where("good").join(classes, same).where("vec_id = least_id").dropDuplicates(["class_id"])
    mine = mine.select("class_id", "copies", "label", F.size("embedding").alias("dim"), "embedding")

    sizes = [r["dim"] for r in mine.select("dim").distinct().collect()]  # lengths that occur
    radius2 = 2 - 2 * cosine + 1e-9
    books = {}
    for dim in sizes:
        same_size = mine.where(F.col("dim") == dim)
        sample = unit(np.array([r[0] for r in same_size.orderBy(F.xxhash64("class_id")).limit(sample_rows).select("embedding").collect()]))
        words, cut = codebook_size(same_size.count()), (dim + 1) // 2
        second = sample[:, cut:] if dim > 1 else np.zeros((len(sample), 1))
        books[dim] = (fit_codebook(sample[:, :cut], words), fit_codebook(second, words) if dim > 1 else np.zeros((1, 0)))

    def assign(batches):
        import pandas as pd

        for batch in batches:
            for dim, some in batch.groupby("dim"):
                own, cells = traverse(np.stack(some["embedding"].to_numpy()), *books[dim], radius2)
                # A pair of cells is visited from the lower one; its links count for both sides.
                visits = [c[c >= o].tolist() for o, c in zip(own, cells)]
                yield pd.DataFrame({**{n: some[n] for n in ("class_id", "copies", "label", "dim", "embedding")}, "own": own, "visits": pd.Series(visits, index=some.index, dtype=object)})

    label = dict(mine.dtypes)["label"]
    index = mine.mapInPandas(assign, f"class_id long, copies long, label {label}, dim int, embedding array<double>, own long, visits array<long>")
    index, _ = scratch.write(index, "index")
    cell = ["label", "dim", "cell"]
    members = index.select("class_id", "copies", "label", "dim", "embedding", F.col("own").alias("cell"))
    visitors = index.select("class_id", "copies", "label", "dim", "embedding", "own", F.explode("visits").alias("cell")).withColumn("home", F.col("own") == F.col("cell"))
    counts = members.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("m_blocks")).join(
        visitors.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("v_blocks")), cell
    )
    counts, _ = scratch.write(counts, "cells")
    deal = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("class_id", "copies", "embedding")
    left = members.join(counts, cell).select(*cell, deal("m_blocks").alias("m"), every("v_blocks").alias("v"), *columns)
    right = visitors.join(counts, cell).select(*(F.col(c).alias(c) for c in cell), every("m_blocks").alias("m"), deal("v_blocks").alias("v"), "home", *(F.col(c).alias(c) for c in columns))

    def block(x, y):
        import pandas as pd

        if not len(x) or not len(y):
            return pd.DataFrame({"class_id": pd.Series(dtype="i8"), "links": pd.Series(dtype="i8"), "tie": pd.Series(dtype="i8")})
        one, two = x["class_id"].to_numpy(), y["class_id"].to_numpy()
        linked = unit(np.stack(x["embedding"].to_numpy())) @ unit(np.stack(y["embedding"].to_numpy())).T >= cosine
        # Inside its own cell each vector meets every other both as member and as visitor.
        home = y["home"].to_numpy(dtype=bool)
        to_members = (linked & ~home[None, :]).astype("i8") @ y["copies"].to_numpy()
        to_visitors = linked.T.astype("i8") @ x["copies"].to_numpy()
        row, column = _grouped(linked)
        least = np.full(len(one), np.iinfo("i8").max)
        np.minimum.at(least, row[row >= 0], one[row >= 0])
        np.minimum.at(least, column[column >= 0], two[column >= 0])
        return pd.DataFrame({
            "class_id": np.concatenate([one, two]), "links": np.concatenate([to_members, to_visitors]),
            "tie": np.concatenate([np.where(row >= 0, least[row], one), np.where(column >= 0, least[column], two)]),
        })

    keys = [*cell, "m", "v"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "class_id long, links long, tie long")
    parts, _ = scratch.write(parts.where("links > 0 OR tie <> class_id"), "parts")
    links = parts.groupBy("class_id").agg(F.sum("links").alias("links"))
    tied = components(parts.select(F.col("class_id").alias("a"), F.col("tie").alias("b")))
    named = classes.join(links, "class_id", "left").join(tied, classes["class_id"] == tied["node"], "left")
    named, _ = scratch.write(named.select(*same, "least_id", F.coalesce("links", "copies").alias("links"), F.coalesce("component", "class_id").alias("group_key")), "named")
    least = named.groupBy("group_key").agg(F.min("least_id").alias("component"))
    named = named.drop("least_id").join(least, "group_key").drop("group_key")
    out = held.withColumn("key", F.when(F.col("good"), F.col("label"))).join(named.withColumnRenamed("label", "key"), ["key", "one", "two"], "left")
    out = out.select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query("op3_inverted_multi_index")
def op3_inverted_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all vectors at cosine 0.98."""
    return near_vectors(table(spark, folder, "embeddings"))
