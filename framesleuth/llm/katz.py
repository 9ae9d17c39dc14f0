"""Language-model scores of documents by a Katz back-off model over words.

Words are counted in lots: the documents of one task up to some megabytes.  A
lot's distinct words, and then its distinct pairs of words, go to buckets that
count them over all lots and answer each lot with the counts of its own.  So a
word or pair crosses the network once for each lot that holds it, packed in
arrays, and no table is broadcast or gathered.  Buckets are parts of the stored
tables of the model: words with counts, and pairs with counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.encoding import slices
from framesleuth.llm.registry import query, table

LOT_BYTES = 8_000_000
#: Distinct words and pairs that a bucket receives, about.
WORD_ENTRIES, PAIR_ENTRIES = 500_000, 1_500_000
#: Counts up to here are discounted by Good-Turing.
CUTOFF = 5
#: Part of a count that every history keeps for words not seen after it, and the words for unknown ones.
SPARE = 0.1
START, END, FIRST = 0, 1, 2
#: Ids have 32 bits, so that a pair is one number.
MOST_WORDS = (1 << 32) - FIRST


def discounts(counts, cutoff: int = CUTOFF) -> list[float]:
    """Factors for counts 0..k from ``counts[r]``, the number of items seen ``r`` times.

    Katz's factors for the largest ``k`` up to the cutoff at which all lie
    between 0 and 1.  Where none do, as in very small or very repetitive texts,
    counts of one and two lose half of one.
    """
    for k in range(min(cutoff, len(counts) - 2), 0, -1):
        if all(counts[r] > 0 for r in range(1, k + 2)):
            common = (k + 1) * counts[k + 1] / counts[1]
            found = [((r + 1) * counts[r + 1] / counts[r] / r - common) / (1 - common) if common < 1 else 0.0 for r in range(1, k + 1)]
            if all(0 < d < 1 for d in found):
                return [0.0, *found]
    return [0.0, 0.5, 0.75]


class Model:
    """Numbers that fix all probabilities, given the counts of words and pairs."""

    def __init__(self, tokens: int, ends: int, words: int, word_factors: list[float], word_mass: float, pair_factors: list[float]):
        self.tokens, self.ends, self.words = tokens, ends, words
        self.word_factors, self.word_mass, self.pair_factors = word_factors, word_mass, pair_factors

    @staticmethod
    def _discounted(counts, factors):
        import numpy as np

        held = np.asarray(factors)
        return counts * np.where(counts < len(held), held[np.minimum(counts, len(held) - 1)], 1.0)

    def word(self, counts):
        """Probability of words by their counts; all words never seen share the mass left."""
        import numpy as np

        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, self._discounted(counts, self.word_factors) / (self.tokens + SPARE), 1 - self.word_mass)

    def pair(self, counts, history):
        """Probability of words seen after a history."""
        return self._discounted(counts, self.pair_factors) / (history + SPARE)


def _ints(data: bytes, kind: str = "<u4"):
    import numpy as np

    return np.frombuffer(data, kind)


def _squeeze(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def _unsqueeze(data: bytes):
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _squeeze_planes(values) -> bytes:
    """Numbers of 32 bits, their first bytes, then their second ones and so on."""
    import numpy as np

    return _squeeze(np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T))


def _unsqueeze_planes(data: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(_unsqueeze(data), "u1").reshape(4, -1).T).view("<u4").ravel()


LOT_SCHEMA = "lot long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, counts binary, places binary, kind string"


def make_lots(docs: DataFrame, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Lots of ``docs (doc_id, held, text)``: a row with distinct words and training counts, and one with each text as places among them."""

    def task(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from framesleuth.llm.shingles import word_hashes

        lot = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, lot_bytes):
                hashes, rows, *_ = word_hashes(some.column(2))
                words, places = np.unique(hashes, return_inverse=True)
                held = some.column(1).to_numpy(zero_copy_only=False)
                training = ~np.repeat(held, np.diff(rows))
                counts = np.bincount(places[training], minlength=len(words))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lot, lot]), pa.array([None, some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([None, held.tolist()], pa.list_(pa.bool_())), pa.array([None, np.diff(rows)], pa.list_(pa.int32())),
                    pa.array([words.astype("<u8").tobytes(), None], pa.binary()), pa.array([counts.astype("<u4").tobytes(), None], pa.binary()), pa.array([None, _squeeze_planes(places)], pa.binary()), pa.array(["words", "texts"]),
                ], ["lot", "doc_ids", "held", "sizes", "words", "counts", "places", "kind"])
                lot += 1

    return docs.select("doc_id", "held", "text").mapInArrow(task, LOT_SCHEMA)


def _word_bucket(words, buckets: int):
    import numpy as np

    return ((words >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype("i8")


WORD_SCHEMA = "lot long, bucket long, ids binary, counts binary, known long, tokens long, seen array<long>, size long"


def count_words(lots: DataFrame, buckets: int) -> DataFrame:
    """The word table and the answers to the lots, by bucket.

    A row with a lot gives ranks in the bucket and counts of that lot's words;
    the row without one is the bucket's part of the table, with the words' hashes
    and their number.  A word's id is its rank behind all earlier buckets.
    """

    def send(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lot, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = _ints(words, "<u8"), _ints(counts)
                edges = np.searchsorted(_word_bucket(words, buckets), np.arange(buckets + 1)).tolist()
                some = [(b, a, z) for b, (a, z) in enumerate(zip(edges[:-1], edges[1:])) if z > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, *_ in some], pa.int64()), pa.array([lot] * len(some), pa.int64()),
                    pa.array([words[a:z].tobytes() for _, a, z in some], pa.binary()), pa.array([counts[a:z].tobytes() for _, a, z in some], pa.binary()),
                ], ["bucket", "lot", "words", "counts"])

    def count(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("lot")
        held = [_ints(x, "<u8") for x in rows["words"]]
        words, places = np.unique(np.concatenate(held), return_inverse=True)
        total = np.bincount(places, weights=np.concatenate([_ints(x) for x in rows["counts"]]), minlength=len(words)).astype("u8")
        ids = np.arange(len(words)).astype("<u4")
        out, at = [], 0
        for lot, x in zip(rows["lot"], held):
            mine = places[at : at + len(x)]
            at += len(x)
            # A lot's words are in the order of their hashes, and so are the ids.
            out.append((lot, key[0], _squeeze(np.diff(ids[mine], prepend=np.uint32(0))), _squeeze(total[mine].astype("<u4")), None, None, None, None))
        seen = np.bincount(np.minimum(total, CUTOFF + 2).astype("i8"), minlength=CUTOFF + 3)[: CUTOFF + 2]
        out.append((None, key[0], _squeeze(words), _squeeze(total.astype("<u4")), int((total > 0).sum()), int(total.sum()), seen.tolist(), len(words)))
        return pd.DataFrame(out, columns=["lot", "bucket", "ids", "counts", "known", "tokens", "seen", "size"]).astype({"lot": "Int64", "known": "Int64", "tokens": "Int64", "size": "Int64"})

    sent = lots.select("lot", "words", "counts").mapInArrow(send, "bucket long, lot long, words binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(count, WORD_SCHEMA)


class Lot:
    """A lot with the ids and counts of its words, and its distinct pairs in bucket order."""

    def __init__(self, row, answers, ends: int, buckets: int, share: float, before):
        import numpy as np

        from framesleuth.llm.shingles import mix

        answers = answers.sort_values("bucket")  # buckets are ranges of the words' hashes, so this is the words' order
        ranks = [np.cumsum(_ints(_unsqueeze(x))).astype("i8") + before[b] for b, x in zip(answers["bucket"].astype("i8"), answers["ids"])]
        counts = [_ints(_unsqueeze(x)) for x in answers["counts"]]
        both = [np.concatenate(x) if len(answers) else np.zeros(0, "u4") for x in (ranks, counts)]
        n = len(both[0])
        ids, self.counts = np.concatenate([both[0], [START, END]]).astype("u8"), np.concatenate([both[1], [ends, ends]]).astype("i8")
        sizes = np.asarray(row["sizes"]).astype("i8")
        self.sizes, self.doc_ids, self.held = sizes, row["doc_ids"], np.asarray(row["held"]).astype(bool)
        self.rows = np.repeat(np.arange(len(sizes)), sizes + 1)
        first = np.cumsum(sizes + 1) - sizes - 1
        words = np.insert(_unsqueeze_planes(row["places"]).astype("i8"), np.cumsum(sizes), n + 1)
        history = np.empty_like(words)
        history[1:], history[first] = words[:-1], n
        self.words = words
        pairs, self.places = np.unique(history * (n + 2) + words, return_inverse=True)
        # Training counts of each pair; pairs of no training text are asked for only.
        self.training = np.bincount(self.places[~self.held[self.rows]], minlength=len(pairs))
        self.history, self.word = pairs // (n + 2), pairs % (n + 2)
        h, w = ids[self.history], ids[self.word]
        # A frequent history is split by the word after it.
        parts = (self.counts[self.history] * share).astype("u8") + np.uint64(1)
        self.split = parts > 1
        bucket = (mix(mix(h) + mix(w + np.uint64(1 << 40)) % parts) % np.uint64(buckets)).astype("i8")
        self.order = np.lexsort((h << np.uint64(32) | w, bucket))
        self.keys = (h << np.uint64(32) | w)[self.order]
        self.edges = np.searchsorted(bucket[self.order], np.arange(buckets + 1)).tolist()

    def cuts(self):
        return [(b, a, z) for b, (a, z) in enumerate(zip(self.edges[:-1], self.edges[1:])) if z > a]


def _pack(keys, training, counts, history_counts, split) -> bytes:
    """Pairs sorted by key, their training counts, and the counts of both words, in few bytes."""
    import numpy as np

    h = (keys >> np.uint64(32)).astype("<u4")
    steps = np.diff(h, prepend=h[:1] * 0)
    return _squeeze(steps.astype("<u4"), keys.astype("<u4"), training.astype("<u4"), counts.astype("<u4"), history_counts.astype("<u4"), split.astype("<u4"))


def _unpack(data: bytes):
    import numpy as np

    held = _ints(_unsqueeze(data)).reshape(6, -1)
    return np.cumsum(held[0].astype("u8")) << np.uint64(32) | held[1], *(x.astype("i8") for x in held[2:5]), held[5] > 0


PAIR_SCHEMA = "lot long, bucket long, found binary, asked binary, part binary, seen array<long>"


def count_pairs(lots: DataFrame, words: DataFrame, buckets: int, ends: int, share: float, before) -> DataFrame:
    """The pair table and the answers to the lots, by bucket, as for words."""

    def send(key, rows, answers):
        import pandas as pd

        if not len(rows):
            return pd.DataFrame({"bucket": [], "lot": [], "pairs": []})
        lot = Lot(rows.iloc[0], answers, ends, buckets, share, before)
        word, history, split = lot.counts[lot.word][lot.order], lot.counts[lot.history][lot.order], lot.split[lot.order]
        training = lot.training[lot.order]
        out = [(b, key[0], _pack(lot.keys[a:z], training[a:z], word[a:z], history[a:z], split[a:z])) for b, a, z in lot.cuts()]
        return pd.DataFrame(out, columns=["bucket", "lot", "pairs"])

    def count(key, rows):
        import numpy as np
        import pandas as pd

        held = [_unpack(x) for x in rows["pairs"]]
        keys, first, places = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
        total = np.bincount(places, weights=np.concatenate([x[1] for x in held]), minlength=len(keys)).astype("i8")
        out, at = [], 0
        for lot, x in zip(rows["lot"], held):
            mine = total[places[at : at + len(x[0])]]
            at += len(x[0])
            asked = np.unique(x[0][(mine == 0) & (x[3] > 0)] >> np.uint64(32)).astype("<u4")
            out.append((lot, key[0], _squeeze(mine.astype("<u4")), _squeeze(asked) if len(asked) else None, None, None))
        known = total > 0
        word, history, split = (np.concatenate([x[k] for x in held])[first] for k in (2, 3, 4))
        seen = np.bincount(np.minimum(total, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2]
        out.append((None, key[0], None, None, _pack(keys[known], total[known], word[known], history[known], split[known]), seen.tolist()))
        return pd.DataFrame(out, columns=["lot", "bucket", "found", "asked", "part", "seen"]).astype({"lot": "Int64"})

    asked = lots.groupBy("lot").cogroup(words.select("lot", "bucket", "ids", "counts").groupBy("lot")).applyInPandas(send, "bucket long, lot long, pairs binary")
    return asked.groupBy("bucket").applyInPandas(count, PAIR_SCHEMA)


def _sums(part: bytes, model: Model):
    """Of a part of the pair table, per history: itself, mass of its seen words, their mass as single words, and whether it is split."""
    import numpy as np

    keys, counts, words, history, split = _unpack(part)
    h, first = np.unique(keys >> np.uint64(32), return_index=True)
    at = np.cumsum(np.bincount(first, minlength=len(keys))) - 1 if len(keys) else np.zeros(0, "i8")
    seen = np.bincount(at, weights=model.pair(counts, history), minlength=len(h))
    single = np.bincount(at, weights=model.word(words), minlength=len(h))
    return h.astype("i8"), seen, single, split[first]


def back_off_weights(pairs: DataFrame, model: Model) -> DataFrame:
    """``(history, weight)``: what makes the probabilities after each history sum to one.

    Only the sums of split histories are added up across buckets.
    """

    def sums(batches):
        import pandas as pd

        for batch in batches:
            for part in batch["part"]:
                h, seen, single, split = _sums(part, model)
                yield pd.DataFrame({"history": h, "seen": seen, "single": single, "split": split})

    parts = pairs.where("part IS NOT NULL").select("part").mapInPandas(sums, "history long, seen double, single double, split boolean")
    whole = parts.where("NOT split").select("history", "seen", "single")
    added = parts.where("split").groupBy("history").agg(F.sum("seen").alias("seen"), F.sum("single").alias("single"))
    weight = (1 - F.col("seen")) / F.greatest(1 - F.col("single"), F.lit(1e-12))
    return whole.unionByName(added).select("history", weight.alias("weight"))


def _asked(pairs: DataFrame) -> DataFrame:
    """``(lot, history)`` of the histories that stand before a pair never seen in training."""

    def task(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for lot, data in zip(batch["lot"], batch["asked"]):
                yield pd.DataFrame({"lot": lot, "history": _ints(_unsqueeze(data)).astype(np.int64)})

    return pairs.where("asked IS NOT NULL").select("lot", "asked").mapInPandas(task, "lot long, history long").distinct()


def _scored(lots: DataFrame, words: DataFrame, pairs: DataFrame, weights: DataFrame, model: Model, buckets: int, share: float, before) -> DataFrame:
    """Scores of every document, lot by lot."""
    none = F.lit(None)
    sides = [
        words.select("lot", "bucket", "ids", "counts", none.cast("binary").alias("found"), none.cast("array<long>").alias("histories"), none.cast("array<double>").alias("weights")),
        pairs.where("lot IS NOT NULL").select("lot", "bucket", none.cast("binary").alias("ids"), none.cast("binary").alias("counts"), "found", none.cast("array<long>").alias("histories"), none.cast("array<double>").alias("weights")),
        weights.select("lot", none.cast("long").alias("bucket"), *(none.cast("binary").alias(c) for c in ("ids", "counts", "found")), "histories", "weights"),
    ]
    answers = sides[0].unionByName(sides[1]).unionByName(sides[2])

    def score(key, rows, answers):
        import numpy as np
        import pandas as pd

        if not len(rows):
            return pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")})
        lot = Lot(rows.iloc[0], answers[answers["ids"].notna()], model.ends, buckets, share, before)
        found = answers[answers["found"].notna()].sort_values("bucket")["found"]
        counts = np.empty(len(lot.order), "i8")
        counts[lot.order] = np.concatenate([_ints(_unsqueeze(x)) for x in found])
        history = lot.counts[lot.history]
        weight = np.ones(len(counts))
        given = answers[answers["histories"].notna()]
        if len(given):
            h, w = np.asarray(given.iloc[0]["histories"]), np.asarray(given.iloc[0]["weights"])
            order = np.argsort(h)
            mine = np.empty(len(counts), "i8")
            mine[lot.order] = (lot.keys >> np.uint64(32)).astype("i8")
            need = (counts == 0) & (history > 0)
            weight[need] = w[order][np.searchsorted(h[order], mine[need])]
        # A pair seen in training has its own probability; another goes back to its word.
        single = model.word(lot.counts)
        log = np.log10(np.where(counts > 0, model.pair(counts, np.maximum(history, 1)), weight * single[lot.word]))
        base = np.log10((lot.counts + 1) / (model.tokens + model.words + 1))
        n = len(lot.sizes)
        return pd.DataFrame({
            "doc_id": pd.Series(list(lot.doc_ids), dtype="Int64"), "held_out": lot.held, "n_tokens": lot.sizes + 1,
            "n_known": np.bincount(lot.rows, weights=lot.counts[lot.words] > 0, minlength=n).astype("i8"),
            "base_score": np.bincount(lot.rows, weights=base[lot.words], minlength=n), "score": np.bincount(lot.rows, weights=log[lot.places], minlength=n),
        })

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return lots.groupBy("lot").cogroup(answers.groupBy("lot")).applyInPandas(score, kinds)


def score_documents(docs: DataFrame, held: str, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Fit on the documents where ``held`` is not true and score all of ``docs (doc_id, text)``.

    Tokens are lower-case words and one end for each document; the end counts as
    a word.  The probability of a word after a word seen before it in training
    is its Good-Turing discounted share; other words share what is left in
    proportion to their own discounted probabilities, and words never seen have
    what is left there.  Each history's probabilities sum to one.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``.  A null or empty text has its end only.  A document without id
    trains.  Repeated rows are scored and counted each; an empty table gives no
    rows; without training rows every word has probability one.
    """
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(held), F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    # The words are dropped before the texts are needed, so both kinds have a folder of their own.
    lots_path = scratch.new_path(spark, "lots")
    make_lots(rows, lot_bytes).write.partitionBy("kind").option("compression", "zstd").parquet(lots_path)
    lots = spark.read.schema(LOT_SCHEMA).parquet(lots_path)
    sums = lots.agg(F.sum(F.length("words") / 8).alias("words"), F.sum(F.expr("aggregate(sizes, 0L, (n, x) -> n + x)")).alias("tokens"), F.sum(F.expr("size(filter(held, x -> NOT x))")).alias("ends")).first()
    if sums["ends"] is None:
        return rows.sparkSession.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    word_buckets, buckets = max(8, -int(-sums["words"] // WORD_ENTRIES)), max(8, -int(-sums["tokens"] // PAIR_ENTRIES))
    ends = sums["ends"]

    words, words_path = scratch.write(count_words(lots.where("kind = 'words'"), word_buckets), "words")
    scratch.drop(spark, f"{lots_path}/kind=words")
    scratch.release(spark)
    # A few numbers for each bucket reach the driver.
    table_rows = words.where("lot IS NULL").select("bucket", "size", "known", "tokens", "seen").collect()
    before = np.full(word_buckets, FIRST, "i8")
    held_words = np.zeros(word_buckets, "i8")
    for r in table_rows:
        held_words[r["bucket"]] = r["size"]
    before[1:] += np.cumsum(held_words)[:-1]
    if held_words.sum() > MOST_WORDS:
        raise ValueError("more distinct words than 32-bit ids")
    seen = [sum(r["seen"][k] for r in table_rows) for k in range(CUTOFF + 2)]
    if 0 < ends < len(seen):
        seen[ends] += 1
    tokens, known = sum(r["tokens"] for r in table_rows) + ends, sum(r["known"] for r in table_rows) + (ends > 0)
    factors = discounts(seen)
    kept = tokens - sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(seen, factors)) if r)
    share = 4 * buckets / max(1, tokens)

    answers = words.where("lot IS NOT NULL").select("lot", "bucket", "ids", "counts")
    light = lots.where("kind = 'texts'").select("lot", "doc_ids", "held", "sizes", "places")
    pairs, pairs_path = scratch.write(count_pairs(light, answers, buckets, ends, share, before), "pairs")
    scratch.release(spark)
    pair_seen = pairs.where("lot IS NULL").agg(*(F.sum(F.col("seen")[k]).alias(str(k)) for k in range(CUTOFF + 2))).first()
    model = Model(tokens, ends, known, factors, kept / (tokens + SPARE), discounts([x or 0 for x in pair_seen]))
    weights, weights_path = scratch.write(back_off_weights(pairs, model), "weights")
    given = _asked(pairs).join(weights, "history").groupBy("lot").agg(F.collect_list(F.struct("history", "weight")).alias("h"))  # one lot's histories
    given = given.select("lot", F.col("h.history").alias("histories"), F.col("h.weight").alias("weights"))
    scores, _ = scratch.write(_scored(light, answers, pairs, given, model, buckets, share, before), "scores")
    scratch.drop(spark, lots_path, words_path, pairs_path, weights_path)
    return scores.withColumn("train_tokens", F.lit(tokens).cast("long"))


@query("op8_katz_backoff")
def op8_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Score all documents; one in seven, by a hash of the id, is held out."""
    return score_documents(table(spark, folder, "documents"), "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 = 2")
