"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seqcast.llm.labelled import held_out, training_labels
from seqcast.llm.sampling import smallest_hashes
from seqcast.llm.text_arrays import runs_of_words, slices, texts_of, word_hashes
from seqcast.sources.ship import ship_package

BITS = 20
# Labelled documents to learn from, at most; those with the smallest hashes of their ids.
MOST_LABELLED = 16_000
# Features of all these documents together, and those of one of them, at most; a document that has more or comes after is not learned from.
MOST_FEATURES = 12_000_000
MOST_OF_ONE = 200_000


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner; ``l1`` decides how many weights are not zero."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 30.0
    l2: float = 1.0
    passes: int = 3
    positive_weight: float = 6.0


def features(hashes: np.ndarray, first: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """Each text's distinct feature numbers: words, pairs of neighbours, and pairs with one word between."""
    shift = np.uint64(64 - bits)
    kinds = [(k, (runs_of_words(hashes, n, gap) >> shift).astype(np.int32)) for k, n, gap in ((0, 1, 1), (1, 2, 1), (2, 2, 2))]
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(np.concatenate([runs[a: max(a, b - reach)] for reach, runs in kinds]))


def _featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            each = list(features(*word_hashes(*texts_of(part.column("text")), lower=True)))
            ends = np.cumsum([0, *map(len, each)])
            values = pa.array(np.concatenate(each)) if each else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                ["doc_id", "label", "features"])


def fit(rows: list[np.ndarray], labels: np.ndarray, settings: Ftrl, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the weights that are not zero; number ``2**bits`` is the bias.

    One row at a time in the order given. Every coordinate has its own rate, which falls with
    the squares of its gradients, and stays at zero until its sum of gradients passes ``l1``. The rarer
    label 1 counts ``positive_weight`` times.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(at: np.ndarray) -> np.ndarray:
        over = np.abs(z[at]) - np.where(at == bias, 0.0, settings.l1)
        return np.where(over > 0, -np.sign(z[at]) * over / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2), 0.0)

    for _ in range(settings.passes):
        for row, label in zip(rows, labels, strict=True):
            at = np.append(row, bias)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            g *= settings.positive_weight if label else 1.0
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - rate * w
            n[at] += g * g
    every = weights(np.arange(bias + 1))
    kept = np.flatnonzero(every)
    return kept, every[kept]


def _fit_task(settings: Ftrl, bits: int):
    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"doc_id": [], "label": [], "features": []})])
        rows = rows.assign(draw=_spread(rows["doc_id"])).sort_values(["draw", "doc_id"])
        at, weights = fit(list(rows["features"]), rows["label"].to_numpy(float), settings, bits)
        yield pd.DataFrame({"at": at.astype(np.int64), "weight": weights})

    return task


def _spread(ids: pd.Series) -> np.ndarray:
    """An order of ids that follows nothing in the table."""
    return pd.util.hash_array(ids.astype(str).to_numpy(object), categorize=False)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED,
                   settings: Ftrl = Ftrl(), bits: int = BITS, most_features: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights learned from at most ``most`` labelled documents outside the held-out fold, with at most ``most_features`` features.

    The learner is sequential, so it runs in one task; the two bound what that task gets, whatever the
    table's size and the texts' lengths. Features are made where the documents are. Of rows that repeat an id one is learned from.
    """
    ship_package(docs.sparkSession.sparkContext)
    chosen = smallest_hashes(training_labels(labels, label), "doc_id", most)
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "label", "text").mapInArrow(_featurise, "doc_id long, label int, features array<int>")
            .filter(F.size("features") <= MOST_OF_ONE)
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.min("features").alias("features")))
    # At most ``most`` rows, in the order of a hash; Spark sorts them on disk where memory does not do.
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("held", F.sum(F.size("features")).over(so_far)).filter(F.col("held") <= most_features).drop("held")
    learned = rows.repartition(1).mapInPandas(_fit_task(settings, bits), "at long, weight double").toPandas()
    return learned["at"].to_numpy(np.int64), learned["weight"].to_numpy(float)


def _score_task(model, bits: int, carry: list[str]):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = model.value
        weights = np.zeros((1 << bits) + 1)
        weights[at] = values
        for batch in batches:
            for part in slices(batch, "text"):
                each = features(*word_hashes(*texts_of(part.column("text")), lower=True), bits)
                margin = np.array([weights[x].sum() for x in each]) + weights[-1]
                score = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(score, pa.float64())], [*carry, "_score"])

    return task


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns named in ``carry`` and ``_score``, from 0 to 1, for every row.

    The weights that are not zero are broadcast: at most ``2**bits`` numbers, in practice some thousands.
    Null and empty texts get the bias's score. Labels are not looked at.
    """
    ship_package(docs.sparkSession.sparkContext)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [docs.schema[c] for c in carry]
    return docs.select(*carry, *(() if "text" in carry else ("text",))).mapInArrow(
        _score_task(shared, bits, list(carry)), StructType([*kept, StructField("_score", DoubleType())]))


def reject_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``, with all columns."""
    names = {c: c if c == "text" else f"_kept_{i}" for i, c in enumerate(docs.columns)}
    scored = score_toxicity(docs.select(*(F.col(c).alias(n) for c, n in names.items())), model, carry=list(names.values()))
    return scored.filter(F.col("_score") < threshold).select(*(F.col(n).alias(c) for c, n in names.items()))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED,
             settings: Ftrl = Ftrl()) -> DataFrame:
    """Learn from the labelled documents and score all: ``doc_id, held_out, score, predicted`` (1 from 0.5 on).

    Without a single label every score is 0.5 and every row is predicted 1 by the threshold's rule.
    Other columns of the inputs are ignored; an empty table gives no rows.
    """
    scored = score_toxicity(docs, train_toxicity(docs, labels, label, most, settings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= 0.5).cast("int").alias("predicted"))
