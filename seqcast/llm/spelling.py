"""Spelling variants: words one edit apart, found by dense tiles of common prefixes and suffixes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.sources.shared import discard_table, written
from seqcast.sources.ship import ship_package

LEAST_LENGTH = 5
LEAST_COUNT = 3
# One run in so many, by the checksum of its document and itself, loses a code point.
MUTATED = 97
# Words of a side of a tile, at most, and code points of such a side.
TILE_WORDS = 1024
TILE_CODES = 2_000_000
# Small blocks are put side by side until a tile has so many words.
FILL = 384
# Bytes of a text that are split into runs at a time, and words that a task counts before it hands the counts on.
WINDOW = 1 << 20
COUNTED = 200_000

# Letters in UTF-8, A-Z lower-cased: a-z, and U+00C0 to U+00FF, whose lead byte is C3.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")

TILE = "word string, near long, best_n long, best string"


def _windows(text: bytes) -> Iterator[bytes]:
    """The text in parts that cut no run; a longer run is a part by itself."""
    start = 0
    while start < len(text):
        cut = BREAK.search(text, start + WINDOW)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def mutated(run: bytes, checksum: int) -> bytes:
    """The run without one code point, if the checksum says so."""
    if checksum % MUTATED:
        return run
    letters = run.decode()
    at = checksum % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they were met since the last batch."""
    counts: Counter[bytes] = Counter()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for rows in batches:
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
            before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for part in _windows((text.as_py() or b"").lower()):
                # A run's checksum is the same all over a document.
                for run, times in Counter(RUN.findall(part)).items():
                    if len(run) >= LEAST_LENGTH:
                        word = mutated(run, zlib.crc32(run, before))
                        if len(word) - word.count(b"\xc3") >= LEAST_LENGTH:
                            counts[word] += times
                if len(counts) >= COUNTED:
                    yield batch()
    yield batch()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word that occurs often enough."""
    return (docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT))


def _codes(words: list[str], longest: int, right: bool) -> np.ndarray:
    """A row of code points per word, padded with zeros to ``longest``; from the word's end if ``right``."""
    padded = "".join(w.rjust(longest, "\0") if right else w.ljust(longest, "\0") for w in words)
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32).reshape(len(words), longest)
    return codes[:, ::-1] if right else codes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of ``a`` with each of ``b``."""
    alike = np.ones((len(a), len(b)), bool)
    length = np.zeros(alike.shape, np.int32)
    for t in range(a.shape[1]):
        alike &= a[:, t, None] == b[None, :, t]
        if not alike.any():
            break
        length += alike
    return length


def near_pairs(rows: list[str], columns: list[str], longest: int, side: int) -> np.ndarray:
    """Which words are one edit apart, of pairs whose longer word has ``longest`` code points.

    Such a pair has a common prefix and a common suffix that together reach ``longest - 1``. So the prefix or the suffix
    has half of that. Side 0 names the pairs whose prefix has, side 1 the others.
    """
    prefix = _common(_codes(rows, longest, False), _codes(columns, longest, False))
    suffix = _common(_codes(rows, longest, True), _codes(columns, longest, True))
    sizes = [np.fromiter(map(len, w), np.int64, len(w)) for w in (rows, columns)]
    near = (prefix + suffix >= longest - 1) & (np.maximum(sizes[0][:, None], sizes[1]) == longest)
    # A word with itself has a prefix of its whole length, in whichever length it is looked for.
    near &= (sizes[0][:, None] != sizes[1]) | (prefix < longest)
    return near & ((prefix >= longest // 2) == (side == 0))


def _ranked(n: np.ndarray, words: list[str]) -> np.ndarray:
    """Each word's place by falling ``n``, then by code points."""
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return place


def _tile(words: list[str], n: np.ndarray, group: np.ndarray, first: np.ndarray, second: np.ndarray, longest: int, side: int) -> list[tuple]:
    """For each word with near ones: the word, how many, and the best of them. ``first`` and ``second`` say on which sides of its group's tile it is."""
    place = _ranked(n, words)
    by_place = np.argsort(place)
    rows, columns = np.flatnonzero(first), np.flatnonzero(second)
    near = near_pairs([words[i] for i in rows], [words[i] for i in columns], longest, side) & (group[rows][:, None] == group[columns])
    found: list[tuple] = []
    # Where the sides differ, each learns of the other; a tile of one side has every pair twice.
    for own, other, table in ((rows, columns, near), (columns, rows, near.T)):
        count = table.sum(axis=1)
        best = np.where(table, place[other][None, :], len(words)).min(axis=1, initial=len(words))
        found += [(words[own[k]], int(count[k]), int(n[by_place[best[k]]]), words[by_place[best[k]]]) for k in np.flatnonzero(count)]
        if np.array_equal(rows, columns):
            break
    return found


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the words of each tile; rows come tile by tile. Tiles of one side that are small are laid out as one."""
    words, ns, groups, firsts, seconds = [], [], [], [], []
    now, kind, number = None, None, 0

    def compared() -> pa.RecordBatch:
        found = _tile(words, np.array(ns, np.int64), np.array(groups), np.array(firsts, bool), np.array(seconds, bool), *kind) if len(words) > 1 else []
        for held in (words, ns, groups, firsts, seconds):
            held.clear()
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                          ["word", "near", "best_n", "best"])

    for batch in batches:
        names = ("longest", "side", "key", "i", "j", "own", "word", "n")
        for longest, side, key, i, j, own, word, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if (longest, side, key, i, j) != now:
                # A tile of two sides is compared by itself.
                if now and ((longest, side) != kind or len(words) >= FILL or now[3] != now[4] or i != j):
                    yield compared()
                now, kind, number = (longest, side, key, i, j), (longest, side), number + 1
            words.append(word)
            ns.append(n)
            groups.append(number)
            firsts.append(own == i)
            seconds.append(own == j)
    if now:
        yield compared()


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of every word that has near ones, of ``words(word, n)``.

    A pair whose longer word has m code points has a common prefix or a common suffix of at least m // 2 (see
    ``near_pairs``), so each word is looked for under both of these ends, as the longer or an equal one and as the shorter one. Words under
    one end are a block; a block with more words than a tile's side is cut into chunks by a hash, and every pair of chunks is a tile of its own. A
    tile sends on a count and the best near word of each of its words, never pairs.
    """
    length = F.char_length("word")
    ends = F.explode(F.array(*(F.struct((length + more).alias("longest"), F.lit(side).alias("side")) for more in (0, 1) for side in (0, 1)))).alias("end")
    half = F.floor(F.col("longest") / 2).cast("int")
    keyed = (words.select("word", "n", ends).select("word", "n", "end.*")
             .withColumn("key", F.xxhash64(F.when(F.col("side") == 0, F.expr("left(word, cast(longest div 2 as int))"))
                                           .otherwise(F.expr("right(word, cast(longest div 2 as int))")), half)))
    block = ["longest", "side", "key"]
    most = F.greatest(F.lit(1), F.least(F.lit(TILE_WORDS), F.floor(F.lit(TILE_CODES) / F.col("longest"))))
    # A block of two words or more, one of them of the full length.
    blocks = (keyed.groupBy(*block).agg(F.count(F.lit(1)).alias("size"), F.max(F.char_length("word")).alias("reached"))
              .filter("size > 1 and reached = longest").select(*block, _ceil_div(F.col("size"), most).alias("chunks")))
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("chunks"))
    tiles = (keyed.join(blocks, block).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .select(*block, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n"))
    key = [*block, "i", "j"]
    # A number of partitions, for what a tile costs is not seen in its bytes, by which they would be put together.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tiles.repartition(parts, *key).sortWithinPartitions(*key, "word").mapInArrow(_tiles, TILE)
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top"))
            .select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word of ``forms(word, form)``: its form's form and so on to the last.

    Pointer jumping: a round doubles the steps that a pointer has taken. A form is at least twice as frequent as its word, so a chain is no longer
    than the logarithm of the largest count, and the rounds are as many as the logarithm of that.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        onto = written(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard_table(now)
        now = onto
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``documents``.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. Where ``MUTATED`` divides the
    checksum of ``<doc_id>:<run>``, the run loses one code point. Words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT``
    occurrences in all documents count. Two are near if one inserted, deleted or replaced code point tells them apart. A word's form is its near
    word with most occurrences (ties: the smallest by code points), if it has at least twice the word's; its root is where forms lead in the end.

    Words are counted in tasks before they move; texts and runs of any length are counted whole, a window at a time. All pairs of the
    words that share an end are compared in tiles of bounded size, see ``near_words``.

    Null text has no words; a null id is written as nothing before the colon. Repeated rows count each. An empty table gives
    no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession.sparkContext)
    words = written(word_counts(docs), "words")
    near = written(words.join(near_words(words), "word", "left")
                   .withColumn("form", F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best"))), "near")
    discard_table(words)
    ends = roots(near.filter("form is not null"))
    return (near.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")))
