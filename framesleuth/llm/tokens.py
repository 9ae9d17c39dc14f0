"""Token-id files: ORC with run-length coded ids, row indexes and Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.encoding import encoder, slices, with_end
from framesleuth.llm.registry import query, table

FILE_SCHEMA = "part int, doc_id long, n_tokens long, start_in_part long, ids array<int>"


def encode_in_order(docs: DataFrame, tokenizer: str, end_id: int, encode_special_tokens: bool = True) -> DataFrame:
    """Token ids of every document in ascending ``doc_id`` order, one range of ids per task.

    A null text is encoded as an empty one and holds only ``end_id``.  Rows with
    the same id stay next to each other, ordered by a hash of their text; equal
    rows are interchangeable.  Rows with a null id come first.  Added tokens in a
    text are plain text with ``encode_special_tokens``, else (as the library does
    by default) they become their ids.
    """
    order = ["doc_id", "tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))

    def task(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        words = encoder(tokenizer, False, 4, encode_special_tokens)
        for batch in batches:
            for some in slices(batch):
                ids, ends = with_end(*words.encode_column(some.column(2)), end_id)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ends) - 1, part, "i4")), some.column(0), pa.array(np.diff(ends)), pa.array(total + ends[:-1]),
                    pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(ids.view("i4"))),
                ], ["part", "doc_id", "n_tokens", "start_in_part", "ids"])
                total += int(ends[-1])

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task, FILE_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, stride: int = 1000, stripe_bytes: int = 16 << 20, encode_special_tokens: bool = True) -> None:
    """Write the ids as ORC.

    Each file holds one range of document ids.  A reader can take stripes in
    parallel; row indexes every ``stride`` rows and the Bloom filter on
    ``doc_id`` let a lookup skip stripes and row groups.  An empty table gives
    an empty folder of the same schema.
    """
    (
        encode_in_order(docs, tokenizer, end_id, encode_special_tokens)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", stride).option("orc.stripe.size", stripe_bytes).option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents; the filter reaches the ORC metadata."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(doc_ids))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: place in the whole stream, number of ids and their crc32."""
    files = read_token_files(spark, path)
    # One row for each file, so a window without partitions sorts few rows.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))

    def task(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, ends = batch.column(3), batch.column(3).offsets.to_numpy()
            held = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
            crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype("i8")), pa.array(crc, pa.int64())], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    rows = files.select("part", "doc_id", "start_in_part", "ids").mapInArrow(task, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


@query("op4_token_orc")
def op4_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents with the word vocabulary, as the library encodes by default, and read the files back."""
    import public_tokenizers

    path = scratch.new_path(spark, "token-orc")
    write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1, encode_special_tokens=False)
    return token_digests(spark, path)
