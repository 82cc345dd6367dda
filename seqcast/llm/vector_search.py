"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqcast.llm.sampling import smallest_hashes
from seqcast.sources.shared import written
from seqcast.sources.ship import ship_package

# Vectors that the codebooks are learned from, at most; those with the smallest hashes of their ids.
MOST_SAMPLED = 20_000
CENTROIDS = 64
# Candidates per query: this share of all rows and this many more.
PROBE_SHARE = 0.5
PROBE_ROWS = 1000
# Rows and queries that meet in one task, at most on average.
BLOCK_ROWS = 50_000
BLOCK_QUERIES = 2_000


@dataclass(frozen=True)
class MultiIndex:
    """A codebook for each half of the unit vectors, and how many rows each pair of centroids has."""

    books: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.books[0].shape[1]
        return tuple(np.square(book).sum(axis=1) - 2 * half @ book.T for book, half in zip(self.books, (x[:, :d], x[:, d:]), strict=True))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(d.argmin(axis=1) for d in self.halves(x))

    def cells(self, far: tuple[np.ndarray, np.ndarray], wanted: int) -> list[tuple[int, int]]:
        """Centroid pairs in order of summed distance until they hold ``wanted`` rows: the multi-sequence walk with a heap."""
        order = [np.argsort(f, kind="stable") for f in far]
        sorted_far = [f[o] for f, o in zip(far, order, strict=True)]
        heap, out, held = [(sorted_far[0][0] + sorted_far[1][0], 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            a, b = int(order[0][i]), int(order[1][j])
            if self.counts[a, b]:
                out.append((a, b))
                held += int(self.counts[a, b])
            # Each pair is pushed once: along the second half always, along the first from its first column.
            if j + 1 < len(order[1]):
                heapq.heappush(heap, (sorted_far[0][i] + sorted_far[1][j + 1], i, j + 1))
            if j == 0 and i + 1 < len(order[0]):
                heapq.heappush(heap, (sorted_far[0][i + 1] + sorted_far[1][0], i + 1, 0))
        return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster keeps its centroid."""
    k = min(k, len(x))
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (np.square(centroids).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, unit``: rows with an id and a vector of finite components that are not all zero.

    ``embedding`` is in double precision, ``unit`` the same at length one. All vectors kept have the most common number of
    components (of equals the larger); others cannot be compared with them.
    """
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("embedding") == (size["d"] if size else 0))
    # Scaled by the largest component first: squares neither overflow nor vanish.
    largest = F.array_max(F.transform("embedding", F.abs))
    scaled = F.transform("embedding", lambda v: v / F.col("largest"))
    length = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, v: s + v * v))
    return (rows.withColumn("largest", largest).withColumn("scaled", scaled).withColumn("length", length)
            .select("vec_id", "embedding", F.transform("scaled", lambda v: v / F.col("length")).alias("unit")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _assign(books):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(books, np.zeros((0, 0)))
        for batch in batches:
            if len(batch):
                a, b = index.assign(_matrix(batch.column("unit")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("unit"), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                                                 ["vec_id", "unit", "a", "b"])

    return task


def _plan(index: MultiIndex, wanted: int):
    """A row per query and first-half centroid that it visits, with the second-half centroids there. A query is known by its id and ``key``."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            first, visits, places = [], [], []
            far = index.halves(_matrix(batch.column("unit")))
            for i in range(len(batch)):
                by_first: dict[int, list[int]] = {}
                for a, b in index.cells((far[0][i], far[1][i]), wanted):
                    by_first.setdefault(a, []).append(b)
                for a, bs in by_first.items():
                    first.append(a)
                    visits.append(bs)
                    places.append(i)
            of = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(of), batch.column("key").take(of), pa.array(first, pa.int32()), pa.array(visits, pa.list_(pa.int32())),
                 batch.column("unit").take(of)], ["query_id", "key", "a", "visits", "unit"])

    return task


def _best(nearest: int, centroids: int):
    def task(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "key": [], "vec_id": [], "score": []})
        rows = rows.sort_values("vec_id", ignore_index=True)
        x, ids, cells = np.stack(rows["unit"]), rows["vec_id"].to_numpy(), rows["b"].to_numpy()
        out = []
        for start in range(0, len(queries), 256):
            part = queries.iloc[start: start + 256]
            visits = np.zeros((len(part), centroids), bool)
            for i, v in enumerate(part["visits"]):
                visits[i, v] = True
            q = np.stack(part["unit"])
            score = q @ x.T
            score[~visits[:, cells] | (part["query_id"].to_numpy()[:, None] == ids)] = -np.inf
            for i, query in enumerate(zip(part["query_id"], part["key"], strict=True)):
                s = score[i]
                if len(s) > nearest:
                    # Ties with the last place, up to rounding, stay for the exact order.
                    at = np.flatnonzero(s >= np.partition(s, -nearest)[-nearest] - 1e-12)
                else:
                    at = np.arange(len(s))
                at = at[np.isfinite(s[at])]
                exact = (x[at] * q[i]).sum(axis=1)
                for j in np.lexsort((ids[at], -exact))[:nearest]:
                    out.append((*query, ids[at[j]], exact[j]))
        return pd.DataFrame(out, columns=["query_id", "key", "vec_id", "score"])

    return task


def nearest_neighbours(vectors: DataFrame, query_every: int = 50, nearest: int = 5, centroids: int = CENTROIDS,
                       probe_share: float = PROBE_SHARE, probe_rows: int = PROBE_ROWS, most_sampled: int = MOST_SAMPLED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found of each row whose id divides by ``query_every``.

    Vectors are brought to length one and cut in two halves, each quantised by ``centroids`` learned from a
    sample of at most ``most_sampled`` rows. Every row is indexed under its pair of centroids. A
    query walks the pairs in order of summed distance until they hold ``probe_share`` of all rows and ``probe_rows`` more; the rows of
    these pairs are ranked by exact cosine. Vectors without structure need a large share for a recall of 0.9.

    Rows and queries meet by first-half centroid, in blocks bounded on both sides, so that a pair of centroids with a third of
    all rows is spread; each block returns its best few of each query. What the driver and tasks share are
    the codebooks and a count per pair.

    Ties go to the smaller id; equal vectors have equal scores. Rows that repeat an id are candidates each, and
    an id never finds itself. Query rows with one id and one vector are one query; those with one id and several vectors are as many, each with its own ranks. Null ids and vectors that are null, zero, not finite or of another length than most take no part.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark.sparkContext)
    units = written(usable(vectors).select("vec_id", "unit"), "units")
    sample = smallest_hashes(units, "vec_id", most_sampled).toPandas()
    if sample.empty:
        return units.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    x = np.stack(sample["unit"])
    half = x.shape[1] // 2
    books = (kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids, seed=1))
    indexed = written(units.mapInArrow(_assign(books), "vec_id long, unit array<double>, a int, b int"), "indexed")
    # At most a row per pair of centroids.
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in indexed.groupBy("a", "b").count().collect():
        counts[r["a"], r["b"]] = r["count"]
    index, total = MultiIndex(books, counts), int(counts.sum())

    queries = (indexed.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id", "unit").agg(F.count(F.lit(1)).alias("copies"))
               .select("vec_id", F.xxhash64("unit").alias("key"), "unit"))
    visits = queries.mapInArrow(_plan(index, int(probe_share * total) + probe_rows),
                                "query_id long, key long, a int, visits array<int>, unit array<double>")
    n_queries = queries.count()
    row_blocks = F.element_at(F.array(*(F.lit(int(-(-n // BLOCK_ROWS)) or 1) for n in counts.sum(axis=1))), F.col("a") + 1)
    query_blocks = -(-n_queries // BLOCK_QUERIES) or 1
    dealt_rows = (indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), row_blocks).cast("int"))
                  .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    dealt_queries = (visits.withColumn("block", F.explode(F.sequence(F.lit(0), row_blocks - 1)))
                     .withColumn("group", F.pmod(F.xxhash64("query_id", "key"), F.lit(query_blocks)).cast("int")))
    keys = ["a", "block", "group"]
    found = (dealt_queries.groupBy(*keys).cogroup(dealt_rows.groupBy(*keys))
             .applyInPandas(_best(nearest, len(books[1])), "query_id long, key long, vec_id long, score double"))
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
            .select("query_id", "rank", "vec_id", "score"))
