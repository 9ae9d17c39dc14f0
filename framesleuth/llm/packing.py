"""Best-fit packing of token pieces into sequences, with certified lower bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.encoding import encoder, slices, with_end
from framesleuth.llm.registry import query, table

PIECE_SCHEMA = "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "piece_key long, length long, grp long, bin long, offset long, fill long, bins long, bound long"
#: Pieces in one group of the packing, at most about: a task holds two numbers for each.
GROUP_PIECES = 250_000
ROUNDS = 6


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, width: int = 2, encode_special_tokens: bool = True, ids_kept: bool = True) -> DataFrame:
    """Token pieces of at most ``capacity`` ids of every document.

    A null text counts as empty and gives one piece holding ``end_id``; so does
    one with a null id, whose pieces keep the null.  A longer document is cut into
    full pieces; only its first may be shorter.  ``ids_crc32`` is that of the
    piece's ids as little-endian 32-bit integers; ``ids``, with ``ids_kept`` only,
    holds them in ``width`` bytes each.  Added tokens in a text are plain text
    with ``encode_special_tokens``, else (as the library does by default) they
    become their ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"{PIECE_SCHEMA}, ids binary" if ids_kept else PIECE_SCHEMA

    def task(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, next_key = encoder(tokenizer, True, width, encode_special_tokens), TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in slices(batch):
                ids, ends = with_end(*words.encode_column(some.column(1)), end_id)
                sizes = np.diff(ends)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                # The first piece takes what full ones leave.
                first = sizes - (pieces - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                edges = np.append(ends[row] + start, ends[-1])
                wide = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                cuts = (4 * edges).tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:])]
                columns = [pa.array(next_key + np.arange(len(row))), some.column(0).take(pa.array(row)), pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if ids_kept:
                    columns.append(pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((edges * width).astype("i4")), pa.py_buffer(ids.tobytes())]))
                next_key += len(row)
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(task, schema)


def lower_bound(counts, capacity: int, splits: int = 64) -> int:
    """Fewest bins that pieces can need; ``counts[n]`` is the number of length ``n``.

    Each dual feasible function maps lengths so that the mapped lengths of any
    full bin sum to one bin at most; the best of two families is taken.
    """
    import numpy as np

    counts = np.asarray(counts, "i8")
    sizes = np.arange(len(counts), dtype="i8")
    if not counts.any():
        return 0
    best = -(-int((counts * sizes).sum()) // capacity)
    # Lengths under t vanish and those over capacity - t fill a bin.
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    for t in range(1, capacity // 2 + 1):
        whole = int(number[-1] - number[capacity - t])
        kept = int(total[capacity - t] - total[t - 1])
        best = max(best, whole + -(-kept // capacity))
    # Rounded to multiples of 1/k, unless (k + 1) times the length is a whole number of bins.
    for k in range(1, splits + 1):
        scaled = (k + 1) * sizes
        mapped = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


def best_fit(lengths, capacity: int):
    """Bin and offset of each piece by best-fit decreasing, and the fill of each bin."""
    import numpy as np

    lengths = np.asarray(lengths, "i8")
    bins, offsets, fills = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8"), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    free = 0  # bit r: some bin has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = free >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            chosen = room[space].pop()
            if not room[space]:
                free ^= 1 << space
        else:
            space, chosen = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = chosen, fills[chosen]
        fills[chosen] += n
        if space > n:
            if not room[space - n]:
                free |= 1 << (space - n)
            room[space - n].append(chosen)
    return bins, offsets, np.array(fills, "i8")


def _packed(pieces: DataFrame, capacity: int) -> DataFrame:
    def group(held):
        import numpy as np
        import pandas as pd

        held = held.sort_values("piece_key", ignore_index=True)
        bins, offsets, fills = best_fit(held["length"], capacity)
        bound = lower_bound(np.bincount(held["length"], minlength=capacity + 1), capacity)
        return pd.DataFrame({
            "piece_key": held["piece_key"], "length": held["length"], "grp": held["grp"], "bin": bins, "offset": offsets,
            "fill": fills[bins], "bins": len(fills), "bound": bound,
        })

    return pieces.groupBy("grp").applyInPandas(group, PLACED)


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Sequence and offset of every ``(piece_key, length)``; lengths lie in 1..capacity.

    Groups of about ``group_pieces`` pieces are packed apart.  A dual feasible
    bound certifies each group's number of bins.  While the total exceeds the
    bound of all lengths together, every group gives its emptiest bins, a group
    with a gap more of them, to groups that are dealt anew and packed again; the
    result is taken if it has fewer bins.  An empty table gives no rows.
    """
    with scratch.temporary(pieces.sparkSession):
        return scratch.keep(_pack(pieces, capacity, group_pieces, rounds), "packing")


def _pack(pieces: DataFrame, capacity: int, group_pieces: int, rounds: int) -> DataFrame:
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == capacity).select("piece_key", F.col("piece_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("piece_key", "length")
    # At most one row for each length below the capacity reaches the driver.
    counts = [0] * (capacity + 1)
    for row in rest.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    number, goal = sum(counts), lower_bound(counts, capacity)
    groups = max(1, -(-number // group_pieces))
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("piece_key"), F.lit(groups)))
    now, path = scratch.write(_packed(dealt, capacity), "packed")
    for turn in range(rounds):
        # One row for each group.
        state = now.groupBy("grp").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        totals = state.agg(F.sum("bins").alias("bins"), F.sum(F.col("bins") - F.col("bound")).alias("gap"), F.count(F.lit(1)).alias("groups")).first()
        if totals["groups"] <= 1 or totals["bins"] <= goal:
            break
        # The emptiest bins first: as many from each group as make one new group of usual size, twice as many with a gap.
        each = now.groupBy("grp", "bin").agg(F.max("fill").alias("fill"), F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        cut = each.groupBy("grp").agg(F.percentile_approx("fill", F.lit(1.0 / totals["groups"]), 1000).alias("low"), F.percentile_approx("fill", F.lit(min(1.0, 2.0 / totals["groups"])), 1000).alias("low_gap"), F.max("bins").alias("all_bins"), F.max("bound").alias("all_bound"))
        marked = now.join(cut, "grp").withColumn("leaves", F.col("fill") <= F.when(F.col("all_bins") > F.col("all_bound"), F.col("low_gap")).otherwise(F.col("low")))
        marked, marked_path = scratch.write(marked.select(*now.columns, "leaves"), "marked")
        leaving = marked.where("leaves")
        before = leaving.select("grp", "bin").distinct().count()
        renewed = max(1, -(-leaving.count() // group_pieces))
        moved = leaving.select("piece_key", "length", (F.lit((turn + 1) << 32) + F.pmod(F.xxhash64("piece_key", F.lit(turn)), F.lit(renewed))).alias("grp"))
        moved, moved_path = scratch.write(_packed(moved, capacity), "packed")
        after = moved.select("grp", "bin").distinct().count()
        scratch.drop(spark, path)
        if after >= before:
            scratch.drop(spark, moved_path)
            now, path = marked.drop("leaves"), marked_path
            break
        now, path = scratch.write(marked.where("NOT leaves").drop("leaves").unionByName(moved), "packed")
        scratch.drop(spark, marked_path, moved_path)
    # Bins are numbered inside groups; a bin keeps the smallest key in it as its number.
    named = now.groupBy("grp", "bin").agg(F.min("piece_key").alias("sequence_id"))
    return now.join(named, ["grp", "bin"]).select("piece_key", "sequence_id", "offset").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, width: int = 2, encode_special_tokens: bool = True, ids_kept: bool = True) -> DataFrame:
    """Pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with ``ids_kept``, ids.

    Null texts count as empty and null ids stay null; equal rows are packed each
    on its own; an empty table gives no rows; extra columns are left out.  The
    table of pieces is read by the result, so it stays in the shared folder.
    """
    pieces, _ = scratch.write(cut_pieces(docs, tokenizer, end_id, capacity, width, encode_special_tokens, ids_kept), "pieces")
    packed = pieces.join(pack(pieces.select("piece_key", "length"), capacity), "piece_key")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids_kept)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pack all documents, tokenized with the byte vocabulary as the library does by default, into sequences of 2048."""
    import public_tokenizers

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, 2048, encode_special_tokens=False, ids_kept=False)
