"""Document quality by importance resampling of hashed n-gram models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.encoding import slices, with_scores
from framesleuth.llm.registry import query, table

BUCKETS = 1 << 12
ORDERS = (1, 2)
#: Labelled rows that set the sampled share, at most.
SAMPLE_ROWS = 20_000


def _bytes_classes():
    import numpy as np

    kind = np.full(256, 4, "u1")  # symbols
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[128:] = 3
    for k, c in enumerate(b".,;:|!?'\"()-#$%&*", 5):
        kind[c] = k
    return kind


def form_grams(column, buckets: int = BUCKETS, orders=ORDERS):
    """Of an Arrow text column: row and bucket of every n-gram of word forms.

    A word's form holds its first and last kind of byte, its length class, its
    numbers of digits and symbols, and whether it repeats the word before or the
    one before that.  Forms, unlike words, are shared by all languages and by
    words never seen.  N-grams do not cross rows.
    """
    import numpy as np

    from framesleuth.llm.shingles import mix, word_hashes

    words, rows, begin, end, data = word_hashes(column)
    kinds = _bytes_classes()[data]
    where = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    if not len(words):
        return where, np.zeros(0, "i8")
    symbols, digits = (np.concatenate([np.zeros(1, "i4"), np.cumsum(x, dtype="i4")]) for x in (kinds >= 4, kinds == 2))
    again, again2 = np.zeros(len(words), "i8"), np.zeros(len(words), "i8")
    again[1:] = (words[1:] == words[:-1]) & (where[1:] == where[:-1])
    again2[2:] = (words[2:] == words[:-2]) & (where[2:] == where[:-2])
    form = np.searchsorted([2, 3, 4, 6, 9, 13, 21], end - begin, "right")
    for part, size in ((kinds[begin], 32), (kinds[end - 1], 32), (np.minimum(symbols[end] - symbols[begin], 4), 8), (np.minimum(digits[end] - digits[begin], 3), 4), (again, 2), (again2, 2)):
        form = form * size + part
    form = mix(form.astype("u8") + np.uint64(1))
    found = [(where, form)]
    for n in orders:
        if n > 1 and len(form) >= n:
            last = len(form) - n + 1
            inside = where[:last] == where[n - 1 :]
            gram = np.zeros(last, "u8")
            for k in range(n):
                gram = mix(gram + form[k : k + last])
            found.append((where[:last][inside], gram[inside]))
    return np.concatenate([a for a, _ in found]), (np.concatenate([mix(b) for _, b in found]) % np.uint64(buckets)).astype("i8")


def labelled_sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, the same at every run: those whose ids hash lowest."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def gram_counts(docs: DataFrame, buckets: int = BUCKETS):
    """Counts of the hashed n-grams of all texts, and of those labelled 1."""
    import numpy as np

    def task(batches):
        import pyarrow as pa

        raw, target = np.zeros(buckets, "i8"), np.zeros(buckets, "i8")
        for batch in batches:
            for some in slices(batch, 1_000_000):
                where, found = form_grams(some.column(1), buckets)
                raw += np.bincount(found, minlength=buckets)
                good = some.column(0).fill_null(0).to_numpy(zero_copy_only=False) == 1
                target += np.bincount(found[good[where]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype="i8")), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    counts = docs.select("label", "text").mapInArrow(task, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # one row for each bucket
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    return raw, target


def best_cut(weights, labels) -> float | None:
    """Middle of the widest gap among the cuts with fewest wrong labels; None without both labels."""
    import numpy as np

    weights, labels = np.asarray(weights, "f8"), np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return None
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], labels[order] == 1
    wrong = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    edges = np.concatenate([[weights[0] - 1], weights, [weights[-1] + 1]])
    gaps = np.where(wrong == wrong.min(), np.diff(edges), -1)
    at = int(gaps.argmax())
    return float((edges[at] + edges[at + 1]) / 2)


def kth_largest(df: DataFrame, column: str, k: int, at_once: int = 10_000) -> float:
    """Exact k-th largest value of a column, by counts between pivots until few values are left."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if k <= 0:
        return float("inf")
    above, value = 0, F.col(column)
    while True:
        inside = df.where((value >= low) & (value <= high))
        step = (high - low) / 64
        bins = {} if low + step == low else {r[0]: r[1] for r in inside.groupBy(F.least(F.floor((value - low) / step), F.lit(63)).alias("bin")).count().collect()}
        if bins and sum(bins.values()) <= at_once:
            values = sorted((r[0] for r in inside.select(column).collect()), reverse=True)
            return values[k - above - 1]
        seen, b = above, 64
        while bins and seen < k:
            b -= 1
            seen += bins.get(b, 0)
        # One step wider on either side, so rounding at the pivots cannot lose the value.
        new_low, new_high = max(low, low + (b - 1) * step), min(high, low + (b + 2) * step)
        if not bins or (new_low, new_high) == (low, high):
            # Few different values are left, each many times: walk down their counts.
            for row in inside.groupBy(column).count().orderBy(F.desc(column)).toLocalIterator():
                above += row["count"]
                if above >= k:
                    return row[column]
        low, high = new_low, new_high
        above = df.where(value > high).count()


def resample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, seed: int = 17, temperature: float = 0.25) -> DataFrame:
    """All columns of ``docs`` with ``log_weight``, ``tempered_weight``, ``sample_key`` and ``kept``.

    Two generative models of hashed n-grams are counted: one of all texts, one of
    the texts labelled 1 among at most ``sample_rows`` labelled rows.  A text's
    log weight is the log ratio of the models, tempered by the square root of its
    number of n-grams, so that the chance errors of long texts weigh as those of
    short ones.  The sample's size k is the number of texts beyond the cut that
    parts the labelled rows best; the k texts with the largest tempered weight
    plus Gumbel noise times ``temperature`` are kept.  The noise depends on
    ``doc_id`` and ``seed`` alone, so runs agree and copies of a row stay together.

    A text without words, or null, has log weight 0.  Without labels of both
    kinds all rows are kept.  An empty table gives no rows.  Columns with the
    names of new ones are replaced.  Texts are weighed twice, for the cut and for
    the result, rather than written with their weights.
    """
    import numpy as np

    # At most sample_rows pairs of numbers are broadcast.
    sample = F.broadcast(labelled_sample(labels, "quality", sample_rows).withColumnRenamed("doc_id", "_id"))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = held.join(sample, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    raw, target = gram_counts(marked.select("label", "text"), buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))

    def weigh(column):
        where, found = form_grams(column, buckets)
        weight = np.bincount(where, ratio[found], minlength=len(column)).astype("f8")
        return [weight, weight / np.sqrt(np.maximum(np.bincount(where, minlength=len(column)), 1))]

    def keyed(df):
        uniform = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return with_scores(df, "text", {"log_weight": "double", "tempered_weight": "double"}, weigh).withColumn("sample_key", F.col("tempered_weight") - temperature * F.log(-F.log(uniform)))

    with scratch.temporary(docs.sparkSession):
        weights, _ = scratch.write(keyed(marked).drop("text"), "weights")
        known = weights.where("label IS NOT NULL").select("tempered_weight", "label").limit(4 * sample_rows).toPandas()  # repeated ids may add rows
        # The cut is made where texts far below it do not draw it down.
        cut = best_cut(np.arcsinh(known["tempered_weight"]), known["label"])
        cut = None if cut is None else float(np.sinh(cut))
        least = None if cut is None else kth_largest(weights, "sample_key", weights.where(F.col("tempered_weight") >= cut).count())
    return keyed(docs).withColumn("kept", F.lit(True) if least is None else F.col("sample_key") >= least)


@query("op6_importance_resampling")
def op6_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Log weight, sampling key and decision of every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return resample(docs.select("doc_id", "text"), labels).drop("text")
