"""Quality classifier: logistic regression on hashed word n-grams, learnt by FTRL updates.

A text's features are its word unigrams and bigrams, of the words in lower case and of their shapes
(runs of small letters, capitals and digits become one sign each; other characters stay), hashed into
2**18 dimensions. A word equal to the one before it counts as the token "same", so that repetition
looks alike whatever the word. A feature's value is the root of its share of the words; the score is
the logistic function of one sparse dot product.

Learning takes at most `max_labels` labelled documents (those whose ids have the least hash; of an id's
several texts or labels one). They are gathered first, by many tasks, and written; one task reads them. Scoring reads every whole text once, where it lies, with the non-zero weights (at most 2**18 pairs,
a fixed bound) sent to each executor. No text is shuffled but for the labelled ones.

Null and empty texts have the intercept alone. Rows without a label, or with a label other than 0 and
1, teach nothing. Without any labelled row every score is 0.5. Repeated rows score alike. Columns of
the input beside doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.llm.ftrl import Ftrl, sigmoid
from twinspan.llm.words import hashed_words, tidy
from twinspan.plans.scratch import bounded_batches, free, save
from twinspan.sources.tables import table

BITS = 18
MAX_LABELS = 8000
THRESHOLD = 0.3

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(a: np.ndarray, salt: int) -> np.ndarray:
    return ((a ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * _ODD) >> np.uint64(64 - BITS)


def features(word: np.ndarray, shape: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers with their values, from the hashes of words and shapes; 0 is the intercept.

    known: which features have a weight; the others are left out, as they add nothing to a score.
    """
    if not len(word):
        return np.zeros(1, np.int64), np.ones(1)
    word = np.concatenate((word[:1], np.where(word[1:] == word[:-1], np.uint64(1), word[1:])))
    grams = [_bucket(word, 1), _bucket(shape, 2)]
    for x, salt in ((word, 3), (shape, 4)):
        grams.append(_bucket((x[:-1] * _ODD) ^ x[1:], salt))
    found = np.concatenate(grams)
    idx, n = np.unique(found if known is None else found[known[found]], return_counts=True)
    idx, n = (idx[1:], n[1:]) if len(idx) and idx[0] == 0 else (idx, n)
    return np.concatenate(([0], idx.astype(np.int64))), np.concatenate(([1.0], np.sqrt(n / len(word))))


def featured(texts: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return (features(*x, known) for x in zip(*hashed_words(texts, shapes=True), strict=True))


def fit(labelled: DataFrame, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero weights, learnt from rows (text, label) in one task on an executor."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            rows += featured(batch.column("text"))
            labels += batch.column("label").to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (labels[i], len(rows[i][0]), rows[i][0].tobytes()))
        idx, w = Ftrl(alpha=1.0, beta=0.3, l1=0.3, l2=0.02).fit([rows[i] for i in order], np.array([labels[i] for i in order]), epochs)
        at = np.flatnonzero(w[:, 0])
        yield pa.RecordBatch.from_pydict({"idx": pa.array(idx[at], pa.int64()), "weight": pa.array(w[at, 0])})

    gathered = save(labelled, "labelled")
    found = gathered.coalesce(1).mapInArrow(tidy(learn), "idx long, weight double").toPandas()
    free(gathered)
    return found["idx"].to_numpy(np.int64), found["weight"].to_numpy(float)


def labelled_ids(labels: DataFrame, label: str, max_labels: int) -> DataFrame:
    """(doc_id, label) of the `max_labels` labelled ids of least hash; an id with both labels counts as 0. Of the label table alone."""
    ids = labels.where(f"{label} in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min(F.col(label)).cast("double").alias("label"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)


def with_texts(docs: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """(text, label, *columns) of each of the labelled ids that a document has; of an id's rows, however many, one."""
    row = F.struct(*(F.col(c) for c in ("text", *columns)))
    found = docs.select("doc_id", row.alias("row")).join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"), F.first("label").alias("label"))
    return found.select("row.*", "label")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_labels: int = MAX_LABELS) -> DataFrame:
    """(text, label) of at most `max_labels` labelled documents outside the held-out fifth."""
    taught = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return with_texts(docs, labelled_ids(taught, label, max_labels))


class Scorer:
    """Scores the texts of batches. The weights are sent to each executor once, and laid out once a task."""

    def __init__(self, spark: SparkSession, weights: tuple[np.ndarray, np.ndarray]):
        bounded_batches(spark)
        self.sent, self.dense = spark.sparkContext.broadcast(weights), None

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(1 << BITS)
            self.dense[self.sent.value[0]] = self.sent.value[1]
            self.known = self.dense != 0
        return np.array([sigmoid(float(self.dense[idx] @ val)) for idx, val in featured(batch.column("text"), self.known)])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row of `docs`."""
    scores = Scorer(docs.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores(batch), pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; learns from labels.quality."""
    bounded_batches(docs.sparkSession)
    scored = score(docs, fit(labelled_rows(docs, labels, "quality", max_labels)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that the classifier doesn't reject; no join, one pass."""
    scores = Scorer(docs.sparkSession, fit(labelled_rows(docs, labels, "quality")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) >= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)
