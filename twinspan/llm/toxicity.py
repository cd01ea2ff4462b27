"""Toxicity by a chain of linear classifiers.

The categories are predicted in turn. Each model is logistic regression (FTRL updates, so sparse) on
the presence of hashed words and word beginnings, and takes the probabilities of the categories before
it as features of their own. In training these are out-of-fold predictions, so that a later model
sees them as wrong as they will be on new texts.

The labelled table has one mark, `toxic`. The chain's categories are that mark within each of the
languages, for abuse has words of its own in each, and last the mark itself, which takes all of them
into account and gives the verdict. The language of a row is part of training labels only and never
an input of a score; where documents have no column `lang`, only the last link learns.

Learning takes at most `max_labels` labelled documents (those whose ids have the least hash; of an id's several
texts or marks one). They are gathered first, by many tasks, and written; one task learns from them, the models of all folds and
the final one of a category side by side in the same runs. Features of fewer than `LEAST_ROWS` labelled rows teach nothing. The
weights, at most 2**18 pairs a category, are sent to each executor; every whole text is read once,
where it lies. Null and empty texts have the intercept alone. Rows without a mark of 0 or 1 teach nothing;
without any labelled row every probability is 0.5, which is not a verdict. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.llm.ftrl import Ftrl, sigmoids
from twinspan.llm.quality_classifier import labelled_ids, with_texts
from twinspan.llm.words import hashed_words, mixed, tidy
from twinspan.plans.scratch import bounded_batches, free, save
from twinspan.sources.tables import table

BITS = 18
LANGUAGES = ("de", "en", "es", "fr")
CATEGORIES = (*(f"toxic_{x}" for x in LANGUAGES), "toxic")
MAX_LABELS = 8000
FOLDS = 3
EPOCHS = 8
LEAST_ROWS = 2
#: Share of a row's features that an update sees: one abusive word must be enough, with no other beside it.
KEPT = 0.7
THRESHOLD = 0.5
#: Lengths in bytes of the word beginnings that are features beside the whole words.
STEMS = (4, 6)

Weights = list[tuple[np.ndarray, np.ndarray]]


def features(texts: pa.Array, known: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Of each text the distinct features present, after 0, the intercept. Below 64 is room for the chain."""
    for parts in zip(*hashed_words(texts, stems=STEMS), strict=True):
        found = mixed(np.concatenate(parts)) >> np.uint64(64 - BITS)
        found = np.unique(found if known is None else found[known[found]]).astype(np.int64)
        yield np.concatenate(([0], found[found >= 64]))


def train_chain(rows: list[np.ndarray], marks: np.ndarray, folds: int = FOLDS, epochs: int = EPOCHS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(idx, weights) of each category's model; `marks` has a column for each category, in the chain's order.

    Of a category, one model a fold, which learns from the other folds, and one of all rows see each example at the same time.
    A row's probabilities of earlier categories are its features 1, 2 and so on; they come from the models that haven't learnt from it.
    """
    idx, n = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_counts=True)
    often = idx[n >= LEAST_ROWS]
    known = np.zeros(1 << BITS, bool)
    known[often] = True
    rows = [x[known[x] | (x == 0)] for x in rows]
    fold = np.arange(len(rows)) % folds
    taught = np.column_stack([*(fold != f for f in range(folds)), np.ones(len(rows), bool)])
    earlier = np.zeros((len(rows), marks.shape[1]))
    out = []
    for c in range(marks.shape[1]):
        chain = np.arange(1, c + 1)
        full = [(np.concatenate((x[:1], chain, x[1:])), np.concatenate(([1.0], earlier[i, :c], np.ones(len(x) - 1)))) for i, x in enumerate(rows)]
        last = c == marks.shape[1] - 1  # nothing comes after it that takes its probabilities
        seen, w = Ftrl(alpha=1.0, beta=0.1, l1=4.0, l2=0.0).fit(full, marks[:, c], epochs, taught[:, folds:] if last else taught, KEPT)
        for i, (at, val) in enumerate(full if not last else ()):
            earlier[i, c] = sigmoids(val @ w[np.searchsorted(seen, at), fold[i]])
        out.append((seen, w[:, -1]))
    return out


def fit(labelled: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> Weights:
    """The non-zero weights of the chain, learnt in one task from rows of `text` and a column for each category."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = [], []
        for batch in batches:
            rows += features(batch.column("text"))
            marks += zip(*(batch.column(c).to_pylist() for c in categories), strict=True)
        order = sorted(range(len(rows)), key=lambda i: (mixed(rows[i].astype(np.uint64)).sum(), rows[i].tobytes(), marks[i]))
        for c, (idx, w) in enumerate(train_chain([rows[i] for i in order], np.array([marks[i] for i in order], float).reshape(len(order), len(categories)))):
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_pydict({"category": pa.array([c] * len(at), pa.int64()), "idx": pa.array(idx[at], pa.int64()), "weight": pa.array(w[at])})

    bounded_batches(labelled.sparkSession)
    gathered = save(labelled.select("text", *categories), "labelled")
    found = gathered.coalesce(1).mapInArrow(tidy(learn), "category long, idx long, weight double").toPandas()
    free(gathered)
    return [(g["idx"].to_numpy(np.int64), g["weight"].to_numpy(float)) for g in (found[found["category"] == c] for c in range(len(categories)))]


class Scorer:
    """From a batch with `text` to its rows' probabilities, one column for each category. Weights are laid out once a task."""

    def __init__(self, spark: SparkSession, weights: Weights):
        bounded_batches(spark)
        self.sent, self.dense = spark.sparkContext.broadcast(weights), None

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros((len(self.sent.value), 1 << BITS))
            for c, (idx, w) in enumerate(self.sent.value):
                self.dense[c, idx] = w
            self.known = self.dense.any(0)
        out = np.zeros((batch.num_rows, len(self.dense)))
        for i, idx in enumerate(features(batch.column("text"), self.known)):
            sums = self.dense[:, idx].sum(1)
            for c in range(len(self.dense)):
                out[i, c] = sigmoids(sums[c] + self.dense[c, 1 : c + 1] @ out[i, :c])
        return out


def _trained(docs: DataFrame, labels: DataFrame, max_labels: int) -> Weights:
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    rows = with_texts(docs, labelled_ids(labels, "toxic", max_labels), "lang")
    within = [F.when(F.col("lang") == x, F.col("label")).otherwise(0.0).alias(f"toxic_{x}") for x in LANGUAGES]
    return fit(rows.select("text", *within, F.col("label").alias("toxic")))


def toxicity(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, toxic 0 or 1, score, and p_<category> for each link of the chain) for every document."""
    scores = Scorer(docs.sparkSession, _trained(docs, labels, max_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(batch)
            columns = {"doc_id": batch.column("doc_id"), "toxic": pa.array((p[:, -1] > THRESHOLD).astype(np.int32)), "score": pa.array(p[:, -1])}
            yield pa.RecordBatch.from_pydict(columns | {f"p_{c}": pa.array(p[:, i]) for i, c in enumerate(CATEGORIES)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, toxic int, score double, " + ", ".join(f"p_{c} double" for c in CATEGORIES))


def keep(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of `docs`, with all their columns, that aren't found toxic; no join, one pass."""
    scores = Scorer(docs.sparkSession, _trained(docs, labels, max_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch)[:, -1] <= THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
