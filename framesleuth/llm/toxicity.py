"""Toxicity by a chain of linear classifiers over words and their beginnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesleuth.llm import scratch
from framesleuth.llm.encoding import slices, with_scores
from framesleuth.llm.quality import best_cut, labelled_sample
from framesleuth.llm.registry import query, table

#: Labelled rows that the chain is fitted on, at most, and features that it looks at.
SAMPLE_ROWS = 12_000
FEATURES = 1024
LEAST_ROWS = 3
PREFIXES = (4, 5, 6)
FOLDS = 5
#: Categories before the last, as words that mark a toxic row as belonging to them.
#: Rows in other words belong to the last category alone.
CATEGORIES = {
    "insult": ("idiot", "moron", "loser", "clown", "scum"),
    "contempt": ("trash", "disgusting", "pathetic", "worthless", "stupid"),
}


def text_features(column):
    """Of an Arrow text column: row and hash of its distinct words of letters and of their first 4, 5 and 6 bytes."""
    import numpy as np

    from framesleuth.llm.shingles import word_hashes

    words, rows, *_ = word_hashes(column, True, PREFIXES)
    where = np.tile(np.repeat(np.arange(len(rows) - 1), np.diff(rows)), len(words))
    found = words.ravel()
    order = np.lexsort((found, where))
    where, found = where[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (where[1:] != where[:-1]) | (found[1:] != found[:-1])
    new &= found != 0
    return where[new], found[new]


def _whole(word: str):
    """Hash of a single word."""
    import pyarrow as pa

    from framesleuth.llm.shingles import word_hashes

    return word_hashes(pa.array([word]), True)[0]


class Features:
    """Rows of 0/1 features in coordinate form, with some dense columns and a constant."""

    def __init__(self, rows, columns, n_rows: int, n_columns: int, dense):
        import numpy as np

        self.rows, self.columns, self.n, self.m = rows, columns, n_rows, n_columns
        self.dense = np.column_stack([*dense, np.ones(n_rows)])

    def times(self, w):
        import numpy as np

        return np.bincount(self.rows, w[self.columns], minlength=self.n) + self.dense @ w[self.m :]

    def back(self, v):
        import numpy as np

        return np.concatenate([np.bincount(self.columns, v[self.rows], minlength=self.m), self.dense.T @ v])


def fit_logistic(x: Features, y, weight, ridge: float = 1.0, rounds: int = 25):
    """Coefficients by Newton steps, each solved by conjugate gradients; ``weight`` 0 leaves a row out."""
    import numpy as np

    w = np.zeros(x.m + x.dense.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        gradient = x.back(weight * (p - y)) + ridge * w
        if np.abs(gradient).max() < 1e-4 * max(1.0, weight.sum()) ** 0.5:
            break
        curve = weight * p * (1 - p)
        step, rest = np.zeros_like(w), -gradient
        line, size = rest.copy(), rest @ rest
        for _ in range(60):
            held = x.back(curve * x.times(line)) + ridge * line
            a = size / (line @ held)
            step, rest = step + a * line, rest - a * held
            new = rest @ rest
            if new < 1e-8 * (gradient @ gradient):
                break
            line, size = rest + new / size * line, new
        w = w + step
    return w


def predict(x: Features, w):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))


class Chain:
    """One linear model for each category; each sees the earlier ones' probabilities.

    Earlier probabilities enter as log odds.  For fitting they are predicted out
    of fold, so a later model does not see probabilities fitted on its own rows.
    """

    def __init__(self, categories: list[str], vocabulary):
        self.categories, self.vocabulary, self.models, self.threshold = categories, vocabulary, [], 0.5

    @staticmethod
    def _odds(p):
        import numpy as np

        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def fit(self, rows, columns, labels, folds) -> Chain:
        import numpy as np

        n, dense = len(labels), []
        for k in range(len(self.categories)):
            y = labels[:, k].astype("f8")
            x = Features(rows, columns, n, len(self.vocabulary), dense)
            apart = np.zeros(n)
            for fold in np.unique(folds):
                out = folds == fold
                apart[out] = predict(x, fit_logistic(x, y, (~out).astype("f8")))[out]
            self.models.append(fit_logistic(x, y, np.ones(n)))
            dense.append(self._odds(apart))
        # Where out-of-fold log odds of the last category part the labels best.
        cut = best_cut(dense[-1], labels[:, -1])
        self.threshold = 0.5 if cut is None else float(1 / (1 + np.exp(-cut)))
        return self

    def score(self, column) -> list:
        """Probability of each category for an Arrow text column."""
        import numpy as np

        n = len(column)
        where, found = text_features(column)
        at = np.minimum(np.searchsorted(self.vocabulary, found), max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[at] == found if len(self.vocabulary) else np.zeros(len(found), bool)
        out, dense = [], []
        for w in self.models:
            out.append(predict(Features(where[hit], at[hit], n, len(self.vocabulary), dense), w))
            dense.append(self._odds(out[-1]))
        return out


def _feature_rows(sample: DataFrame) -> DataFrame:
    """Features of the few labelled rows, one row for each."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for some in slices(batch, 2_000_000):
                where, found = text_features(some.column(2))
                ends = np.searchsorted(where, np.arange(some.num_rows + 1)).astype("i4")
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view("i8")))], ["doc_id", "label", "features"])

    return sample.mapInArrow(task, "doc_id long, label int, features array<long>")


def fit_chain(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, categories: dict[str, tuple[str, ...]] | None = None) -> Chain:
    """Fit on at most ``sample_rows`` labelled rows of ``labels (doc_id, toxic)``.

    Spark counts in how many toxic and other rows each feature stands; the
    ``features`` with the largest log-likelihood ratio are looked at.  What the
    driver holds is bounded by these two parameters.
    """
    import numpy as np

    categories = CATEGORIES if categories is None else categories
    sample = F.broadcast(labelled_sample(labels, "toxic", sample_rows).withColumnRenamed("doc_id", "_id"))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = held.join(sample, F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    rows, path = scratch.write(_feature_rows(chosen), "features")
    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    names, toxic, other = [*categories, "toxic"], float(total.get(1, 0)), float(total.get(0, 0))
    if not toxic or not other:
        # One kind of label: a constant share, or 0 without labels.
        chain = Chain(names, np.zeros(0, "u8"))
        chain.models = [np.array([*[0.0] * k, 30.0 if toxic else -30.0]) for k in range(len(names))]
        return chain
    counts = rows.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n")).where(F.col("n") >= LEAST_ROWS)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    t, o, share = F.col("t"), F.col("n") - F.col("t"), F.col("n") / (toxic + other)
    gain = part(t, toxic * share) + part(o, other * share) + part(toxic - t, toxic * (1 - share)) + part(other - o, other * (1 - share))
    best = counts.withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(features)
    vocabulary = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], "i8").view("u8"))
    seeds = [np.array(sorted(int(x) for w in words for x in _whole(w)), "u8").view("i8").tolist() for words in categories.values()]
    wanted = F.array(*[F.lit(int(x)) for x in vocabulary.view("i8")])
    marks = [F.arrays_overlap("features", F.array(*[F.lit(int(x)) for x in held])).alias(f"mark{k}") for k, held in enumerate(seeds)]
    held = rows.select("label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), F.array_intersect("features", wanted).alias("features"), *marks).toPandas()
    scratch.drop(docs.sparkSession, path)
    columns = np.concatenate([np.asarray(x, "i8") for x in held["features"]]).view("u8")
    where = np.repeat(np.arange(len(held)), [len(x) for x in held["features"]])
    label = held["label"].to_numpy()
    marked = [label * held[f"mark{k}"].to_numpy(dtype=bool) for k in range(len(seeds))]
    return Chain(names, vocabulary).fit(where, np.searchsorted(vocabulary, columns), np.column_stack([*marked, label]), held["fold"].to_numpy())


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None, **fit) -> DataFrame:
    """All columns of ``docs``, the probability of each category (``p_...``) and ``toxic``.

    The threshold, unless given, is the cut of the out-of-fold probabilities
    with fewest wrong labels.  A null or empty text has no features and gets each model's base rate.
    Without labels of both kinds the probabilities are constant.  Repeated rows
    score alike; an empty table gives no rows; columns with the names of new
    ones are replaced.
    """
    chain = fit_chain(docs, labels, **fit)
    scored = with_scores(docs, "text", {f"p_{n}": "double" for n in chain.categories}, chain.score)
    return scored.withColumn("toxic", F.col("p_toxic") >= (chain.threshold if threshold is None else threshold))


@query("op2_classifier_chain")
def op2_classifier_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Category probabilities and the decision for every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return score_toxicity(docs.select("doc_id", "text"), labels).drop("text")
