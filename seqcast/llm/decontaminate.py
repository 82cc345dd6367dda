"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of items."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seqcast.llm.text_arrays import NO_TERM, runs_of_words, slices, texts_of, word_hashes
from seqcast.sources.shared import written
from seqcast.sources.ship import ship_package

WINDOW = 10
SHINGLE = 3
# Words of items that are looked for in one pass and sent to every task, on average; more items take more passes.
MOST_ITEM_WORDS = 1_000_000
# Candidates that are verified together.
TILE = 500_000

ROW = "doc_id long, digest binary, n_words long, n_hit long, spans binary, items array<long>"


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's words as hashes, in order."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, first = word_hashes(*texts_of(part.column("text")), lower=True, apart=NO_TERM)
            words = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), words], ["item_id", "words"])


@dataclass(frozen=True)
class Windows:
    """Distinct windows of items: their words, padded with zeros, their lengths, and the ids of the items of each."""

    words: np.ndarray
    lengths: np.ndarray
    items: list[list[int]]

    def shingles(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, window and place of every shingle of the windows whose shingles have this length."""
        of = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == length)
        hashes, window, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(int(self.lengths[of].max(initial=0)) - length + 1):
            here = of[self.lengths[of] >= at + length]
            run = np.ascontiguousarray(self.words[here, at: at + length]).ravel()
            hashes.append(runs_of_words(run, length)[::length])
            window.append(here)
            place.append(np.full(len(here), at))
        return np.concatenate(hashes), np.concatenate(window), np.concatenate(place)


def windows_of(items: list[tuple[int | None, np.ndarray]]) -> Windows:
    """All runs of ``WINDOW`` words of the items; an item of fewer words is one window."""
    found: dict[bytes, set[int]] = {}
    for item, words in items:
        for at in range(max(1, len(words) - WINDOW + 1) if len(words) else 0):
            found.setdefault(words[at: at + WINDOW].tobytes(), set()).update([] if item is None else [item])
    words = np.zeros((len(found), WINDOW), np.uint64)
    lengths = np.array([len(k) // 8 for k in found], np.int64)
    for row, key in zip(words, found, strict=True):
        row[: len(key) // 8] = np.frombuffer(key, np.uint64)
    return Windows(words, lengths, [sorted(i) for i in found.values()])


def _numbered(known: np.ndarray, hashes: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are known, and which of the known each is."""
    at = np.flatnonzero(marked[hashes >> np.uint64(44)])
    number = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
    same = known[number] == hashes[at]
    return at[same], number[same]


def _marked(known: np.ndarray) -> np.ndarray:
    marked = np.zeros(1 << 20, bool)
    marked[known >> np.uint64(44)] = True
    return marked


def _crossing(first: np.ndarray, words: int, length: int) -> np.ndarray:
    """Whether a run of words from each place goes over its text's end."""
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(words) + length > end


def _occurrences(known):
    """How often a task's documents have each shingle of items, of ``known`` by the shingles' length."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = known.value
        marked = {k: _marked(v) for k, v in shingles.items()}
        times = {k: np.zeros(len(v), np.int64) for k, v in shingles.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = word_hashes(*texts_of(part.column("text")), lower=True, apart=NO_TERM)
                for length, every in shingles.items():
                    runs = runs_of_words(hashes, length)
                    at, number = _numbered(every, runs, marked[length])
                    whole = ~_crossing(first, len(hashes), length)[at]
                    times[length] += np.bincount(number[whole], minlength=len(every))
        length = np.concatenate([np.full(np.count_nonzero(t), k) for k, t in times.items()])
        number = np.concatenate([np.flatnonzero(t) for t in times.values()])
        count = np.concatenate([t[t > 0] for t in times.values()])
        yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(number, pa.int32()), pa.array(count, pa.int64())],
                                         ["length", "number", "times"])

    return task


@dataclass(frozen=True)
class Prefixes:
    """For shingles of one length: those that stand for windows, sorted, and the windows of each with the shingle's place in them."""

    known: np.ndarray
    starts: np.ndarray
    window: np.ndarray
    place: np.ndarray


def prefixes(windows: Windows, known: dict[int, np.ndarray], times: dict[int, np.ndarray]) -> dict[int, Prefixes]:
    """The rarest shingle of each window, which is all of its prefix: a text that contains a window has every shingle of it.

    Windows with a shingle that no document has are left out.
    """
    out = {}
    for length, every in known.items():
        hashes, window, place = windows.shingles(length)
        seen = times[length][np.searchsorted(every, hashes)]
        order = np.lexsort((place, hashes, seen, window))
        rarest = order[np.unique(window[order], return_index=True)[1]]
        rarest = rarest[seen[rarest] > 0]
        rarest = rarest[np.argsort(hashes[rarest], kind="stable")]
        own, starts = np.unique(hashes[rarest], return_index=True)
        if len(own):
            out[length] = Prefixes(own, np.append(starts, len(rarest)), window[rarest], place[rarest])
    return out


def _contained(hashes: np.ndarray, first: np.ndarray, windows: Windows, index: dict[int, Prefixes],
               marked: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where windows occur in texts: the place of the first word, and which window."""
    places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, prefix in index.items():
        at, number = _numbered(prefix.known, runs_of_words(hashes, length), marked[length])
        many = np.diff(prefix.starts)[number]
        # Candidates are laid out a tile at a time.
        cuts = np.flatnonzero(np.diff((np.cumsum(many) - many) // TILE)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            times = many[a:b]
            entry = np.repeat(prefix.starts[number[a:b]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            window = prefix.window[entry]
            # The shingle's place in the window says where the window has to lie, and that must be within the text.
            hit = np.repeat(at[a:b], times)
            start, size = hit - prefix.place[entry], windows.lengths[window]
            text = np.searchsorted(first, hit, "right") - 1
            fits = (start >= first[text]) & (start + size <= first[text + 1])
            start, window, size = start[fits], window[fits], size[fits]
            for word in range(WINDOW):
                if len(start):
                    same = (word >= size) | (hashes[np.minimum(start + word, len(hashes) - 1)] == windows.words[window, word])
                    start, window, size = start[same], window[same], size[same]
            places.append(start)
            which.append(window)
    return np.concatenate(places), np.concatenate(which)


def _spans(hit: np.ndarray) -> np.ndarray:
    """First and last-but-one places of the runs of hit words, as rows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _matched(windows, index, digested: bool):
    """Each document's words, hit words and items. A digest of the text and the hit spans come along if passes are to be put together."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, known = windows.value, index.value
        marked = {k: _marked(p.known) for k, p in known.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = texts_of(part.column("text"))
                hashes, first = word_hashes(data, offsets, lower=True, apart=NO_TERM)
                start, window = _contained(hashes, first, every, known, marked)
                edges = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + every.lengths[window], -1)
                hit = np.cumsum(edges[:-1]) > 0
                n_hit = np.diff(np.append(0, np.cumsum(hit))[first])
                items: list[list[int]] = [[]] * (len(first) - 1)
                spans = [b""] * len(items)
                pairs = np.unique(np.stack([np.searchsorted(first, start, "right") - 1, window], axis=1), axis=0)
                docs, at = np.unique(pairs[:, 0], return_index=True)
                for doc, a, b in zip(docs, at, np.append(at, len(pairs))[1:], strict=True):
                    items[doc] = sorted({i for w in pairs[a:b, 1] for i in every.items[w]})
                    if digested:
                        spans[doc] = _spans(hit[first[doc]: first[doc + 1]]).tobytes()
                digest = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] if digested else [b""] * len(items)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digest, pa.binary()), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.int64()))], [f.split()[0] for f in ROW.split(", ")])

    return task


@F.pandas_udf(LongType())
def _covered(spans: pd.Series) -> pd.Series:
    """Words that any of the spans of a document covers."""

    def one(parts: list[bytes]) -> int:
        every = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in parts] + [np.zeros((0, 2), np.int64)])
        every = every[np.argsort(every[:, 0], kind="stable")]
        before = np.maximum.accumulate(np.append(0, every[:-1, 1])) if len(every) else every[:, 1]
        return int(np.maximum(0, every[:, 1] - np.maximum(every[:, 0], before)).sum())

    return spans.map(one)


def _together(passes: list[DataFrame]) -> DataFrame:
    """One row per document from the rows of each pass. Rows of one id and text have the same results, so they are known by these."""
    rows = passes[0].withColumn("pass", F.lit(0))
    for i, other in enumerate(passes[1:], 1):
        rows = rows.union(other.withColumn("pass", F.lit(i)))
    key = ["doc_id", "digest"]
    each = rows.groupBy(*key, "pass").agg(F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"),
                                          F.first("items").alias("items"))
    whole = each.groupBy(*key).agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"),
                                   F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return (whole.withColumn("n_hit", _covered("spans")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "n_words", "n_hit", "items"))


def _search(items: list[tuple[int | None, np.ndarray]], docs: DataFrame, digested: bool) -> DataFrame:
    """``ROW`` of every document for some items."""
    sc = docs.sparkSession.sparkContext
    windows = windows_of(items)
    known = {k: np.unique(windows.shingles(k)[0]) for k in range(1, SHINGLE + 1)}
    known = {k: v for k, v in known.items() if len(v)}
    times = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
    if known:
        # A row per shingle of these items at most.
        for r in (docs.select("text").mapInArrow(_occurrences(sc.broadcast(known)), "length int, number int, times long")
                  .groupBy("length", "number").agg(F.sum("times").alias("times")).collect()):
            times[r["length"]][r["number"]] = r["times"]
    return docs.mapInArrow(_matched(sc.broadcast(windows), sc.broadcast(prefixes(windows, known, times)), digested), ROW)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` for every row of ``docs``: the words that lie in an occurrence of an item's window, and those items' ids.

    Words are runs of ASCII letters and digits and of all else beyond ASCII; only A-Z are lower-cased. A window is ``WINDOW`` consecutive words of
    an item; an item of fewer words is one window. A window is a set of shingles, each ``SHINGLE`` words long and known by its place, and a text contains it
    if it has all of them in a row. For full containment the necessary prefix of a set ordered by rarity is its first element. So:

    1. The shingles of all items are counted in all documents, in tasks, before the counts move.
    2. Each window is looked for by its rarest shingle; one with a shingle that no document has is not looked for.
    3. Where a document has that shingle, its place in the window says where the window begins; it must lie within the text.
    4. What is left is compared word by word, over as many words as the window has.

    Documents are not shuffled. Items are the stated queries: their windows are sent to every task, in blocks of about
    ``MOST_ITEM_WORDS`` words; each block is a pass over the documents, and passes are put together by id and digest of the text. Words are told
    apart by 64-bit hashes; all words of a window have to be the same.

    Null and empty texts have no words; null ids and repeated rows give a row each. An item without words has no window; one without an id
    marks words but is in no list. Very long texts are worked off whole. An empty table of documents gives no rows, without items nothing
    is hit; other columns are ignored.
    """
    ship_package(docs.sparkSession.sparkContext)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    split = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
                    .mapInArrow(_hashed, "item_id long, words array<long>"), "items")
    blocks = math.ceil((split.agg(F.sum(F.size("words"))).first()[0] or 0) / MOST_ITEM_WORDS) or 1
    passes = []
    for block in range(blocks):
        rows = split.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block).collect()
        passes.append(_search([(r["item_id"], np.array(r["words"], np.int64).view(np.uint64)) for r in rows], docs, blocks > 1))
    return _together(passes) if blocks > 1 else passes[0].select("doc_id", "n_words", "n_hit", "items")


def item_list(items: Column) -> Column:
    """Ids sorted as strings, with commas between."""
    return F.array_join(F.sort_array(F.transform(items, lambda i: i.cast("string"))), ",")
