"""Ranked lexical search: the exact best documents of each item by buckets of impact vectors of like length."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqcast.llm.text_arrays import NO_TERM, slices, texts_of, word_hashes
from seqcast.sources.shared import discard_table, written
from seqcast.sources.ship import ship_package

# Terms of items that are looked for in one pass and sent to every task, on average; more items take more passes.
MOST_ITEM_TERMS = 400_000
# A bucket's longest vector is at most so many times as long as its shortest.
RATIO = 1.25
# Vectors that are compared with the items together.
BLOCK_ROWS = 2048
# The longest vectors, at least so many for each place of the ranking, give each item a first score to beat.
SEED = 100
# Room for rounding in lengths, which only prune.
SLACK = 1 + 1e-9

FOUND = "item int, doc_id long, score long"


def _lookup(known: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Where hashes stand among the sorted ``known`` ones: places in the input, and numbers of the known."""
    marked = np.zeros(1 << 20, bool)
    marked[known >> np.uint64(44)] = True

    def find(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(marked[hashes >> np.uint64(44)])
        number = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        same = known[number] == hashes[at]
        return at[same], number[same]

    return find


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms as hashes."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, first = word_hashes(*texts_of(part.column("text")), lower=True, apart=NO_TERM)
            sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            ends = np.cumsum([0, *map(len, sets)])
            terms = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms))],
                                             ["item_id", "terms"])


def _vectors(known):
    """Each document's number of terms, and those of its terms that items have, with their occurrences."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, size = _lookup(known.value), len(known.value)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = word_hashes(*texts_of(part.column("text")), lower=True, apart=NO_TERM)
                n = np.diff(first)
                at, term = find(hashes)
                pairs, times = np.unique(np.repeat(np.arange(len(n)), n)[at] * size + term, return_counts=True)
                doc, term = np.divmod(pairs, size)
                ends = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], ["doc_id", "n", "terms", "times"])

    return task


def _held_by(size: int):
    """How many documents of a task hold each term."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["term", "held"])

    return task


def _impacts(weights, documents: int, total: int):
    """Vectors of what each term adds to a score, all in integers, with their length and bucket."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            n, terms, times = batch.column("n").to_numpy(), batch.column("terms").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            doc = np.repeat(np.arange(len(n)), batch.column("terms").value_lengths().to_numpy())
            m = 50 + (50 * n * documents) // max(1, total)
            impact = w[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m[doc]))
            doc, terms, impact = doc[impact > 0], terms[impact > 0], impact[impact > 0]
            length = np.sqrt(np.bincount(doc, np.square(impact.astype(np.float64)), len(n)))
            some = np.flatnonzero(length)
            ends = pa.array(np.append(np.searchsorted(doc, some), len(doc)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(some)), pa.array(length[some]),
                 pa.array(np.floor(np.log(length[some]) / math.log(RATIO)), pa.int32()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(impact, pa.int64()))],
                ["doc_id", "length", "bucket", "terms", "impacts"])

    return task


class Ranking:
    """The best documents of one item met so far: highest score, then smallest id, those without an id last."""

    def __init__(self, most: int, floor: int) -> None:
        self.most, self.floor = most, floor
        self.scores, self.ids, self.unnamed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids, unnamed = (np.concatenate(p) for p in ((self.scores, scores), (self.ids, ids), (self.unnamed, unnamed)))
        order = np.lexsort((ids, unnamed, -scores))[: self.most]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]
        if len(self.scores) == self.most:
            self.floor = max(self.floor, int(self.scores[-1]))


class Block:
    """Vectors of like length, by coordinate: for each term the rows that have it, what it adds there, and the most that it adds."""

    def __init__(self, table: pa.Table, size: int) -> None:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        self.unnamed = column["doc_id"].is_null().to_numpy(zero_copy_only=False)
        self.ids = column["doc_id"].fill_null(0).to_numpy()
        self.length = column["length"].to_numpy()
        terms, impacts = column["terms"].flatten().to_numpy(), column["impacts"].flatten().to_numpy()
        rows = np.repeat(np.arange(len(table)), column["terms"].value_lengths().to_numpy())
        order = np.argsort(terms, kind="stable")
        self.rows, self.impacts = rows[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, terms, impacts)

    def best(self, terms: np.ndarray, found: Ranking) -> None:
        """Rank the rows that can still reach ``found``. Any row may be left out only if it cannot reach the floor."""
        longest = float(self.length.max())
        # Cauchy and Schwarz: an item's vector has a one for each of its terms.
        if longest * math.sqrt(len(terms)) * SLACK < found.floor:
            return
        most = self.most[terms]
        order = np.argsort(-most, kind="stable")
        terms, most = terms[order], most[order]
        terms = terms[most > 0]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)[: len(terms) + 1]
        rest[len(terms):] = 0
        if not len(terms) or rest[0] < found.floor:
            return
        # A row without any of the first terms cannot reach the floor by the others.
        focus = max(1, int(np.count_nonzero(rest >= max(1, found.floor))))
        focus = min(focus, len(terms))
        score, square = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for t in terms[:focus]:
            at = slice(self.starts[t], self.starts[t + 1])
            score[self.rows[at]] += self.impacts[at]
            square[self.rows[at]] += np.square(self.impacts[at].astype(np.float64))
        left = len(terms) - focus
        beyond = np.sqrt(np.maximum(0, np.square(self.length * SLACK) - square)) * math.sqrt(left) * SLACK
        able = np.flatnonzero((score > 0) & (score + rest[focus] >= found.floor) & (score + beyond >= found.floor))
        if not len(able):
            return
        place = np.full(len(self.ids), -1)
        place[able] = np.arange(len(able))
        exact = score[able]
        for t in terms[focus:]:
            at = slice(self.starts[t], self.starts[t + 1])
            to = place[self.rows[at]]
            exact[to[to >= 0]] += self.impacts[at][to >= 0]
        reach = exact >= max(1, found.floor)
        if reach.any():
            found.add(exact[reach], self.ids[able[reach]], self.unnamed[able[reach]])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one bucket, at most ``BLOCK_ROWS`` of them; rows come bucket by bucket."""
    held: list[pa.RecordBatch] = []
    rows, now = 0, None
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            while a < b:
                if held and (bucket[a] != now or rows == BLOCK_ROWS):
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                take = min(b - a, BLOCK_ROWS - rows)
                held.append(batch.slice(a, take))
                now, rows, a = bucket[a], rows + take, a + take
    if held:
        yield pa.Table.from_batches(held)


def _ranked(items, floors: list[int], most: int, size: int):
    """The best documents of a task for each item."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Ranking(most, floor) for floor in floors]
        for table in _blocks(batches):
            block = Block(table, size)
            for terms, ranking in zip(items.value, found, strict=True):
                if len(terms):
                    block.best(terms, ranking)
        item = np.repeat(np.arange(len(found)), [len(r.scores) for r in found])
        scores, ids, unnamed = (np.concatenate([getattr(r, c) for r in found]) for c in ("scores", "ids", "unnamed"))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=unnamed), pa.array(scores, pa.int64())],
                                         ["item", "doc_id", "score"])

    return task


def _order() -> Window:
    return Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())


def _search(items: list[np.ndarray], docs: DataFrame, most: int) -> DataFrame:
    """``item, rank, doc_id, score`` of items given by their terms."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    known = np.unique(np.concatenate(items))
    vectors = written(docs.mapInArrow(_vectors(sc.broadcast(known)), "doc_id long, n long, terms array<int>, times array<long>").filter("n > 0"), "vectors")
    counted = vectors.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = np.zeros(len(known), np.int64)
    for r in vectors.select("terms").mapInArrow(_held_by(len(known)), "term int, held long").groupBy("term").agg(F.sum("held").alias("held")).collect():
        held[r["term"]] = r["held"]
    weights = np.array([math.floor(1000 * math.log((2 * counted["documents"] + 2) / (2 * int(df) + 1))) if df else 0 for df in held], np.int64)
    numbers = sc.broadcast([t[weights[t] > 0] for t in (np.searchsorted(known, i) for i in items)])
    impacts = (vectors.filter(F.size("terms") > 0)
               .mapInArrow(_impacts(sc.broadcast(weights), counted["documents"], counted["total"]),
                           "doc_id long, length double, bucket int, terms array<int>, impacts array<long>"))

    # A row per bucket, of which there are some hundred at most: lengths are 64-bit numbers.
    sizes = {r["bucket"]: r["count"] for r in impacts.groupBy("bucket").count().collect()}
    floors, wanted, seeds = [0] * len(items), SEED * most, []
    for bucket in sorted(sizes, reverse=True):
        if wanted > 0:
            seeds.append(bucket)
            wanted -= sizes[bucket]
    chunks = F.create_map(*(F.lit(int(x)) for b, n in sizes.items() for x in (b, -(-n // BLOCK_ROWS)))) if sizes else F.create_map(F.lit(0), F.lit(1))
    # A bucket may hold a third of all documents, many of them alike: its rows are dealt by their place.
    dealt = impacts.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), chunks[F.col("bucket")].cast("long")))

    def ranked(rows: DataFrame) -> DataFrame:
        return (rows.repartition("bucket", "chunk").sortWithinPartitions(F.desc("bucket"), "chunk").drop("chunk")
                .mapInArrow(_ranked(numbers, floors, most, len(known)), FOUND))

    first = written(ranked(dealt.filter(F.col("bucket").isin(seeds))).withColumn("rank", F.row_number().over(_order()))
                    .filter(F.col("rank") <= most).drop("rank"), "first")
    for r in first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == most).collect():
        floors[r["item"]] = r["least"]
    rest = written(ranked(dealt.filter(~F.col("bucket").isin(seeds))), "rest")
    discard_table(vectors)
    return first.union(rest).withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= most)


def ranked_search(items: DataFrame, docs: DataFrame, most: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` best documents of each item, exactly.

    Terms are runs of ASCII letters and digits and of all else beyond ASCII; only A-Z are lower-cased. A term's weight falls with the number of
    documents that hold it, and what an occurrence adds falls with their number and the document's length; see ``_impacts``, all of
    it in 64-bit integers, and ``_search`` for the weight. A score is the sum over an item's terms, once each. Only scores above 0 count;
    equal ones are ranked by id, smallest first.

    A document is a vector of what each term adds, over the terms that some item has, and an item is a vector of ones. Vectors are
    put in buckets by length. The buckets of the longest vectors are searched first and give each item a score that its last place has
    at least. The others are searched with that floor, which rises in each task as it goes from long vectors to
    short ones: by the inequality of Cauchy and Schwarz a whole block is skipped if its longest vector cannot reach it; in a
    block only documents are looked at that have one of the terms that alone can lift a score over the floor, and of these only those are summed up in
    full whose sum so far reaches it with the most that the other terms add in the block, and with the rest of their length.

    Tasks send on no more than ``most`` documents an item. Items are the stated queries: their terms are sent to every task, in blocks of
    ``MOST_ITEM_TERMS`` or so; each block is a pass over the documents. Terms are told apart by 64-bit hashes.

    Null text has no terms. Documents without an id count and are ranked after others of their score; repeated rows are documents each, and rows that
    repeat an item's id are items each. Very long texts are split into terms a window at a time. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark.sparkContext)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    split = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
                    .mapInArrow(_terms, "item_id long, terms array<long>").filter(F.size("terms") > 0), "items")
    blocks = math.ceil((split.agg(F.sum(F.size("terms"))).first()[0] or 0) / MOST_ITEM_TERMS)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = split.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()
        if rows:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
            ranks = _search([np.array(r["terms"], np.int64).view(np.uint64) for r in rows], docs, most)
            found = found.union(ranks.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return found
