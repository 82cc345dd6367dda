"""Quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.llm.labelled import held_out, training_labels
from seqcast.llm.text_arrays import SPACE, slices, texts_of, word_hashes
from seqcast.sources.shared import written
from seqcast.sources.ship import ship_package

STATISTICS = ("words", "word_length", "word_spread", "upper", "marks", "stops", "odd_words", "digits", "lines", "repeats",
              "line_repeats", "pipes", "worst_marks", "worst_upper")
SHRINK = 0.05
ACCEPT = 0.3

_BYTE = np.arange(256)
_ASCII_LETTER = ((_BYTE | 0x20) >= ord("a")) & ((_BYTE | 0x20) <= ord("z")) & (_BYTE < 128)
_LETTER = _ASCII_LETTER | (_BYTE >= 0xC2)  # a letter outside ASCII counts at its first byte
_UPPER = (_BYTE >= ord("A")) & (_BYTE <= ord("Z"))
_DIGIT = (_BYTE >= ord("0")) & (_BYTE <= ord("9"))
_STOP = np.isin(_BYTE, [ord(c) for c in ".,;:?"])
_MARK = (_BYTE > 0x20) & (_BYTE < 0x7F) & ~_ASCII_LETTER & ~_DIGIT & ~_STOP & ~np.isin(_BYTE, [ord(c) for c in "'\"-()"])
_CHARACTER = (_BYTE & 0xC0) != 0x80


def _share(part: float, whole: float) -> float:
    return float(np.sqrt(part / whole)) if whole else 0.0


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; all zeros for one without words.

    Shares are square-rooted and counts logged, which brings both nearer to a normal law. The
    last two are the largest shares in a line, as bad passages sit among good ones.
    """
    hashes, first = word_hashes(data, offsets, lower=True)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        words = hashes[first[i]: first[i + 1]]
        n = len(words)
        if not n:
            continue
        text = data[a:b]
        space, letter, mark = SPACE[text], _LETTER[text], _MARK[text]
        upper = _UPPER[text]
        upper[1:] |= (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E)
        begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        lengths = np.add.reduceat((_CHARACTER[text] & ~space).astype(np.int32), begins)
        letters = np.add.reduceat(letter.astype(np.int32), begins)
        marks = np.add.reduceat(mark.astype(np.int32), begins)
        chars, all_letters = int(lengths.sum()), int(letters.sum())
        edges = np.concatenate([[0], np.flatnonzero(text == 0x0A) + 1])
        edges = edges[edges < len(text)]
        # First word of each line that has one, and the lines' sums over words.
        line_of = np.searchsorted(edges, begins, "right")
        starts = np.concatenate([[0], np.flatnonzero(np.diff(line_of)) + 1])
        uppers = np.add.reduceat(upper.astype(np.int32), begins)
        line_words = np.diff(np.append(starts, n))
        long = line_words >= 4
        line_letters, line_chars = np.add.reduceat(letters, starts), np.add.reduceat(lengths, starts)
        line_uppers = np.add.reduceat(uppers, starts) / np.maximum(1, line_letters)
        line_odd = np.add.reduceat((marks > 0).astype(np.int32), starts) / line_words
        line_sums = np.add.reduceat(words, starts) + line_chars.astype(np.uint64)
        distinct = len(np.unique(words))
        out[i] = (np.log1p(n), np.log1p(chars / n), np.log1p(lengths.std()), _share(upper.sum(), all_letters), _share(mark.sum(), chars),
                  _share(_STOP[text].sum(), n), _share((marks > 0).sum(), n), _share(_DIGIT[text].sum(), chars),
                  np.log1p(n / len(starts)), np.log1p(n) - np.log1p(distinct), 1 - len(np.unique(line_sums)) / len(starts),
                  _share(((lengths == 1) & (letters == 0)).sum(), n),
                  np.sqrt(line_odd[long].max()) if long.any() else _share((marks > 0).sum(), n),
                  np.sqrt(line_uppers[long].max()) if long.any() else _share(upper.sum(), all_letters))
    return out


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = statistics(*texts_of(part.column("text")))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every row's whole text. Null text counts as empty."""
    ship_package(docs.sparkSession.sparkContext)
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .mapInArrow(_measure, "doc_id long, x array<double>"))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverted Cholesky factors and log weights of the classes 0 and 1."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]

    def log_density(self, x: np.ndarray, c: int) -> np.ndarray:
        """Up to a constant: minus half the squared Mahalanobis distance, minus half the log determinant, plus the log prior."""
        return self.offsets[c] - 0.5 * np.square((x - self.means[c]) @ self.factors[c].T).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1 and at one half where both classes are as likely; slow to reach its ends, so that order is kept."""
        z = self.log_density(x, 1) - self.log_density(x, 0)
        return 0.5 + 0.5 * z / (1 + np.abs(z))


def fit_discriminant(count: np.ndarray, total: np.ndarray, products: np.ndarray, shrink: float = SHRINK) -> Discriminant:
    """From each class's number of rows, sums and sums of products.

    A class's covariance is shrunk toward the diagonal of the pooled one, by ``shrink`` and by more for
    a class with few rows. A class without rows takes the pooled mean, and its prior is that of one row.
    """
    d = total.shape[1]
    n = max(1.0, float(count.sum()))
    pooled_mean = total.sum(axis=0) / n
    pooled = np.diag(np.maximum(np.diag(products.sum(axis=0)) / n - pooled_mean**2, 1e-4))
    means, factors, offsets = [], [], []
    for c in (0, 1):
        mean = total[c] / count[c] if count[c] else pooled_mean
        own = products[c] / count[c] - np.outer(mean, mean) if count[c] else pooled
        part = min(1.0, max(shrink, (d + 1) / (count[c] + 1)))
        lower = np.linalg.cholesky((1 - part) * own + part * pooled)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(max(1.0, count[c]) / n) - np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(means), tuple(factors), tuple(offsets))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's share of each class: rows, sums and products in one list."""
    d = len(STATISTICS)
    held = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
        y = np.asarray(batch.column("label"))
        for c in (0, 1):
            rows = x[y == c]
            held[c] += np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], ["label", "sums"])


def train_quality(measured: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = SHRINK) -> Discriminant:
    """Fit on all labelled rows outside the held-out fold. A task returns a few hundred numbers, added up by Spark."""
    d = len(STATISTICS)
    rows = measured.join(training_labels(labels, label), "doc_id").select("label", "x")
    sums = rows.mapInArrow(_sums, "label int, sums array<double>").select("label", F.posexplode("sums").alias("at", "value"))
    # At most 2 * (1 + d + d * d) rows.
    flat = sums.groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    held = np.zeros((2, 1 + d + d * d))
    for r in flat:
        held[r["label"], r["at"]] = r["value"]
    return fit_discriminant(held[:, 0], held[:, 1: 1 + d], held[:, 1 + d:].reshape(2, d, d), shrink)


def _score_task(model: Discriminant):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return task


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = SHRINK, accept: float = ACCEPT) -> DataFrame:
    """Learn from the labelled documents and score all: ``doc_id, held_out, score, predicted`` (1 from ``accept`` on).

    Texts are read once: their statistics are written to the shared folder, then both the fit and the
    scores come from those. Null and empty texts have statistics of zero and a score like any other.
    Repeated rows each get a row; in training each counts. Without labels both classes are alike and every score
    is 0.5. An empty table gives no rows; other columns are ignored.
    """
    measured = written(document_statistics(docs), "statistics")
    model = train_quality(measured, labels, label, shrink)
    return (measured.mapInArrow(_score_task(model), "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= accept).cast("int").alias("predicted")))
