"""Near duplicates by word shingles: an exact Jaccard join over PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.llm.components import connected_components
from seqcast.llm.sampling import smallest_hashes
from seqcast.llm.text_arrays import mix, shingle_sets, slices, texts_of, word_hashes
from seqcast.sources.shared import discard_table, written
from seqcast.sources.ship import ship_package

# Ratio of the largest to the smallest set of a band.
BAND = 1.5
# Shingles and sets of a chunk; a group with more is cut into chunks.
MOST_SHINGLES = 400_000
MOST_SETS = 10_000
# Cells of a product of sets, and of the table it is made of, that are filled at a time.
CELLS = 4_000_000
# Members of candidate groups that may be broadcast to read the texts behind them; beyond that the texts are joined by shuffle.
MOST_BROADCAST_IDS = 1_000_000
# Documents in which common shingles are looked for, and in how many of them such a one is found.
SAMPLED = 2_000
COMMON = 5

SIGNED = "doc_id long, n long, d1 long, d2 long, sigs array<long>"


@dataclass(frozen=True)
class Similarity:
    """Two sets link when ``100 * intersection >= percent * union``."""

    words: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if self.words < 1 or not 1 <= self.percent <= 100:
            raise ValueError("words is at least 1, percent from 1 to 100")

    def differences(self, sizes: int) -> int:
        """Most elements in which linked sets of so many elements together can differ."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    @cached_property
    def _edges(self) -> list[int]:
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        return edges

    def bands(self, n: int) -> list[tuple[int, int]]:
        """Number and largest size of each band that holds ``n`` or a larger partner of it."""
        first = int(np.searchsorted(self._edges, n, "right")) - 1
        last = int(np.searchsorted(self._edges, self.largest_partner(n), "right")) - 1
        return [(b, self._edges[b + 1] - 1) for b in range(first, last + 1)]


def digests(elements: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers by which a set is known."""
    return int(mix(elements).sum(dtype=np.uint64)), int(mix(elements ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64))


def _cell_sums(elements: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The partitions of the domain that hold elements, and a hash of what each holds. ``elements`` are sorted hashes."""
    if not len(elements):
        return elements.astype(np.int64), elements
    cell = ((elements >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
    return cell[starts], np.add.reduceat(mix(elements), starts)


def _band_signatures(elements: np.ndarray, n: int, like: Similarity, band: int, most: int, salt: np.uint64) -> tuple[np.ndarray, bool]:
    """Signatures of a set of ``n`` elements in one band from those of its elements that are given, and whether these are too few."""
    bound = like.differences(2 * most)
    if bound <= 3:
        parts = (0, 6, 7, 7)[bound]
        cells, sums = _cell_sums(elements, parts)
        held = dict(zip(cells.tolist(), sums.tolist(), strict=True))
        out = []
        for number, left_out in enumerate(combinations(range(parts), bound)):
            kept = [s for c, s in held.items() if c not in left_out]
            if kept:
                out.append((sum(kept) + int(salt) * (number + 11)) & 0xFFFFFFFFFFFFFFFF)
        return mix(np.array(out, np.uint64)), len(cells) <= bound
    cells, sums = _cell_sums(elements, bound + 5 + bound // 6)
    own = like.differences(n + min(most, like.largest_partner(n)))
    return mix(sums[: own + 1] + mix(cells[: own + 1].astype(np.uint64) + salt * np.uint64(97))), len(cells) <= own


def _element_signatures(rare: np.ndarray, common: np.ndarray, n: int, like: Similarity, most: int, salt: np.uint64) -> np.ndarray:
    """Signatures with every element as a partition of its own, the common ones last: the first of them, one more than may differ, or all."""
    own = like.differences(n + min(most, like.largest_partner(n)))
    return mix(np.concatenate([rare, common])[: own + 1] + mix(salt))


def signatures(elements: np.ndarray, like: Similarity, common: np.ndarray | None = None) -> np.ndarray:
    """PartEnum signatures of a set (sorted 64-bit hashes).

    Linked sets meet in the band of the larger one. There they differ in at most k elements, so
    when the domain is cut into partitions, at most k partitions tell the sets apart.

    For k up to 3 the domain has 6 or 7 partitions and every subset that leaves out k of them gives a
    signature: the subset without the differing partitions is equal in both sets. For larger k
    there are more than k partitions and each subset is a single one. A set that fills more than k partitions
    emits the first k + 1 of them, one that fills fewer all: of the first set's k + 1 at least one is the same in
    the other, which has it among its own first or among all. An empty subset gives no signature, for all sets share it.

    The argument holds in any part of the domain, as sets differ there in no more elements. So ``common`` elements
    are left out first, and a passage that many documents share brings none of them together. A set that then
    fills too few partitions is signed over the whole domain too, where two such sets meet. One that fills too few even there, which is
    rare for a percent of 60 or more and the rule for 50 or less, is also signed with every element as a partition: linked sets have
    one in common, and the first such one is among the first k + 1 of either or among all of it.
    """
    n = len(elements)
    shared = np.zeros(n, bool)
    if common is not None and len(common) and n:
        shared = common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] == elements
    rare = elements[~shared]
    out = [np.zeros(0, np.uint64)]
    for band, most in like.bands(n):
        if like.differences(2 * most) == 0:
            continue  # only equal sets
        salt = np.uint64(band * 1_000_003 + 1)
        sigs, few = _band_signatures(rare, n, like, band, most, salt)
        out.append(sigs)
        if few:
            sigs, few = _band_signatures(elements, n, like, band, most, salt + np.uint64(500_009))
            out.append(sigs)
        if few:
            out.append(_element_signatures(rare, elements[shared], n, like, most, salt + np.uint64(700_001)))
    return np.concatenate(out)


def _signed(like: Similarity, common):
    """Sets and signatures of documents; a set seen before in the task is not signed again. Rows without an id are not signed."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = len(part)
                n, d = np.zeros(rows, np.int64), np.zeros((2, rows), np.uint64)
                sigs = [np.zeros(0, np.uint64)] * rows
                named = part.column("doc_id").is_valid().to_pylist()
                for i, e in enumerate(shingle_sets(*word_hashes(*texts_of(part.column("text")), lower=True), like.words)):
                    n[i] = len(e)
                    if not len(e):
                        continue
                    d[:, i] = key = digests(e)
                    if named[i] and key not in seen:
                        seen.add(key)
                        sigs[i] = signatures(e, like, common.value)
                ends = np.cumsum([0, *map(len, sigs)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sigs, np.zeros(0, np.uint64)]).view(np.int64)))],
                    ["doc_id", "n", "d1", "d2", "sigs"])

    return task


def _shingled(like: Similarity):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for e in shingle_sets(*word_hashes(*texts_of(part.column("text")), lower=True), like.words):
                    yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64))], ["element"])

    return task


def common_shingles(docs: DataFrame, like: Similarity, sampled: int = SAMPLED, common: int = COMMON) -> np.ndarray:
    """Shingles that stand in at least ``common`` of at most ``sampled`` documents (the smallest hashes of ids), sorted.

    Which they are changes how many signatures meet in vain and nothing else: any set of shingles gives the same links.
    There are fewer than the sample's shingles divided by ``common``.
    """
    ids = smallest_hashes(docs.select("doc_id"), "doc_id", sampled).distinct()
    counted = (docs.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(_shingled(like), "element long")
               .groupBy("element").count().filter(F.col("count") >= common).select("element").toPandas())
    return np.sort(counted["element"].to_numpy(np.int64).view(np.uint64))


def group_links(sets: list[np.ndarray], like: Similarity, first: int = 0, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets that connect all that are connected by links.

    Set ``first`` is compared with all, then every set that is not connected with it yet with all others. With ``apart`` (a
    flag for each set) only sets of different flags need to be compared, and all of these are.

    Intersections are products of rows that say which elements a set has, over elements that two sets or more have. A tile of
    rows and a slice of elements are filled at a time, so the tables have no more than ``CELLS`` cells (or one row) whatever the number of sets.
    """
    links: list[tuple[int, int]] = []
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both and 100 * both >= like.percent * (sizes.sum() - both) else []
    label = np.arange(len(sets))

    def join(i: int, near: np.ndarray) -> None:
        near = near[label[near] != label[i]]
        if len(near):
            labels, at = np.unique(label[near], return_index=True)
            links.extend((i, int(j)) for j in near[at])
            label[np.isin(label, labels)] = label[i]

    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    times = np.bincount(code, minlength=len(every))
    number = np.cumsum(times > 1) - 1
    row, code = row[times[code] > 1], number[code[times[code] > 1]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]

    def held_by(rows: np.ndarray) -> np.ndarray:
        held = np.zeros(int(number[-1]) + 1 if len(number) else 0, bool)
        held[code[rows[row]]] = True
        return held

    if apart is None:
        both = np.bincount(row[held_by(np.arange(len(sets)) == first)[code]], minlength=len(sets))
        join(first, np.flatnonzero((both > 0) & (100 * both >= like.percent * (sizes + sizes[first] - both))))
        others, seek = np.ones(len(sets), bool), np.flatnonzero(label != label[first])
    else:
        others, seek = ~apart, np.flatnonzero(apart)
    while len(seek):
        tile, seek = np.split(seek, [max(1, CELLS // len(sets))])
        mine = np.zeros(len(sets), bool)
        mine[tile] = True
        held = held_by(mine)
        use = held[code] & (others | mine)[row]
        columns, at = np.unique(row[use], return_inverse=True)
        element = (np.cumsum(held) - 1)[code[use]]
        tile = np.flatnonzero(mine[columns])
        both = np.zeros((len(tile), len(columns)), np.float32)
        width = max(1, CELLS // max(1, len(columns)))
        for start in range(0, int(held.sum()), width):
            a, b = np.searchsorted(element, [start, start + width])
            has = np.zeros((len(columns), min(width, int(held.sum()) - start)), np.float32)
            has[at[a:b], element[a:b] - start] = 1
            both += has[tile] @ has.T
        both = both.astype(np.int64)
        n = sizes[columns]
        found = (both > 0) & (100 * both >= like.percent * (n[tile][:, None] + n - both))
        for i, near in zip(columns[tile], found, strict=True):
            join(int(i), columns[near])
        if apart is None:
            # These are compared with all, and what is connected with the first set is compared by those that are not.
            others &= ~mine
            seek = seek[label[seek] != label[first]]
    return links


def _reached(links: list[tuple[int, int]], starts: list[int]) -> set[int]:
    beside: dict[int, list[int]] = {}
    for i, j in links:
        beside.setdefault(i, []).append(j)
        beside.setdefault(j, []).append(i)
    reached, todo = set(starts), list(starts)
    while todo:
        more = [j for j in beside.get(todo.pop(), ()) if j not in reached]
        reached.update(more)
        todo += more
    return reached


def _compare(like: Similarity):
    """Links within the groups that a task has, whose rows come one group after the other.

    A group is a chunk ``i = j``, all of whose rows are compared, or two chunks, of which those of one are compared with those of the other
    (``own`` says which a row is of). A row with ``b`` null names an id not connected with the hub there; asked for by ``tell``.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, own, seen = None, [], [], [], set()

        def links() -> pa.RecordBatch:
            found, loose = [], []
            if len(sets) > 1:
                hub, i, j, tell = key
                hubs = [k for k, node in enumerate(nodes) if node == hub]
                found = group_links(sets, like, hubs[0] if hubs else 0, None if i == j else np.array(own) == j)
                if tell:
                    reached = _reached(found, hubs)
                    loose = sorted({node for k, node in enumerate(nodes) if k not in reached})
            a, b = [nodes[i] for i, _ in found] + loose, [nodes[j] for _, j in found] + [None] * len(loose)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a) if a else [], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                              ["hub", "a", "b"])

        for batch in batches:
            for part in slices(batch, "text"):
                each = shingle_sets(*word_hashes(*texts_of(part.column("text")), lower=True), like.words)
                columns = (part.column(c).to_pylist() for c in ("hub", "i", "j", "tell", "id", "own"))
                for *now, node, chunk, elements in zip(*columns, each, strict=True):
                    if now != key:
                        yield links()
                        key, nodes, sets, own, seen = now, [], [], [], set()
                    if not nodes or node != nodes[-1]:
                        seen = set()
                    # An id's rows of one set count once.
                    if len(elements) and (same := (len(elements), *digests(elements))) not in seen:
                        seen.add(same)
                        nodes.append(node)
                        sets.append(elements)
                        own.append(chunk)
        yield links()

    return task


def _chunks(shingles: str, sets: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(shingles) / MOST_SHINGLES), F.ceil(F.col(sets) / MOST_SETS))


def _with_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` (by ``id``) with their texts, a row for each of an id's texts.

    Members that are few are broadcast, whatever the planner thinks of their size, so that no text is moved to them.
    """
    members = written(members, "members")
    side = F.broadcast(members) if members.count() <= MOST_BROADCAST_IDS else members
    return docs.join(side, docs["doc_id"] == side["id"]).select(*members.columns, "text")


def _verified(groups: DataFrame, docs: DataFrame, like: Similarity) -> DataFrame:
    """``a, b``: links among the members of each group of ``groups(hub, node, n, sets)``, enough to connect what links connect.

    Texts are read again from the documents; the members are broadcast if there are few of them, else joined by shuffle. A
    group with many shingles or sets is cut into chunks, and each is compared in a task, together with the hub. What
    is connected with the hub there is one component, so only the rest needs to meet others: these ids are cut into chunks by themselves, and each
    of these meets each other chunk. So no task holds more than twice ``MOST_SHINGLES`` or ``MOST_SETS`` or so, and
    a text is sent twice and as often again as the rest has chunks.
    """
    # A row's chunk hangs on its text too, so that rows that repeat an id are spread.
    place = F.xxhash64("id", "text")

    def compared(rows: DataFrame) -> DataFrame:
        return (rows.select("hub", "i", "j", "tell", "id", "own", "text").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "id")
                .mapInArrow(_compare(like), "hub long, a long, b long"))

    total = groups.groupBy("hub").agg(F.sum("n").alias("n"), F.sum("sets").alias("sets")).select("hub", _chunks("n", "sets").alias("chunks"))
    own = F.pmod(place, F.col("chunks"))
    met = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own))
    chunked = (_with_texts(groups.select("hub", F.col("node").alias("id")).join(total, "hub"), docs)
               .select("hub", "id", "text", (F.col("chunks") > 1).alias("tell"), F.explode(met).alias("i")))
    found = written(compared(chunked.withColumns({"j": F.col("i"), "own": F.col("i")})).distinct(), "found")

    loose = written(found.filter("b is null").select("hub", F.col("a").alias("node"), F.lit(True).alias("loose")), "loose")
    links = found.filter("b is not null").select("a", "b")
    if loose.isEmpty():
        return links
    apart = (groups.join(loose.select("hub").distinct(), "hub").join(loose, ["hub", "node"], "left")
             .select("hub", "node", "n", "sets", F.coalesce("loose", F.lit(False)).alias("loose")))
    sums = {f"{c}_{kind}": F.sum(F.when(F.col("loose") == (kind == "loose"), F.col(c)).otherwise(0)) for c in ("n", "sets") for kind in ("tied", "loose")}
    counts = (apart.groupBy("hub").agg(*(v.alias(k) for k, v in sums.items()))
              .select("hub", _chunks("n_tied", "sets_tied").alias("tied"), _chunks("n_loose", "sets_loose").alias("rest")))
    # Chunks of connected ids come first, those of the rest after them.
    own = F.when(F.col("loose"), F.col("tied") + F.pmod(place, F.col("rest"))).otherwise(F.pmod(place, F.col("tied")))
    others = F.sequence(F.when(F.col("loose"), F.lit(0).cast("long")).otherwise(F.col("tied")), F.col("tied") + F.col("rest") - 1)
    pairs = (_with_texts(apart.select("hub", F.col("node").alias("id"), "loose").join(counts, "hub"), docs)
             .select("hub", "id", "text", own.alias("own"), F.explode(others).alias("other"))
             .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "tell": F.lit(False)}))
    return links.union(written(compared(pairs).select("a", "b").distinct(), "found"))


def near_duplicates(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    A document's set is its distinct shingles of ``like.words`` words, A-Z lower-cased; a text with fewer words is
    one shingle, one without words has none and links with nothing. ``component_id`` is the smallest id
    reachable by links, the document's own included. No link is lost and none is made up, whatever the percent; the lower it is, the
    more sets have to be compared:

    1. One pass makes each text's set and its PartEnum signatures. Equal sets are one from here on.
    2. Documents that share a signature form a bucket, and buckets with the same hub, its member with most shared
       signatures, form a group. A group has each of its members once, however many signatures they share.
    3. In a group each set is compared with the hub, and those not connected with it with all, in the tasks that hold
       them, by products of sets. What leaves a task are links enough to connect what links connect: fewer than it has members.
    4. Components come from these links.

    Buckets are found by a count combined before the shuffle and then joined, so a bucket with a
    third of all documents is spread by the adaptive planner.

    Null text counts as empty. Rows that repeat an id share one component, and each has its own ``n_shingles``. A null
    id is never linked and has a null component. An empty table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession.sparkContext)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, like))
    signed = written(docs.mapInArrow(_signed(like, shared), SIGNED), "signed")
    sets = written(signed.select("doc_id", "n", "d1", "d2"), "sets")
    members = sets.filter("n > 0 and doc_id is not null")

    # A signature is of a set, whoever signed it, and a set is known by half of its digest: two that share it are only compared in vain.
    rows = signed.select("d1", F.explode("sigs").alias("sig"))
    # Counts, nearly all of them one, move in less room than sets would.
    met = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("sig")
    hits = written(rows.join(met, "sig").select("sig", F.col("d1").alias("node")).distinct(), "hits")
    discard_table(signed)
    known = hits.groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    rank = F.struct("times", -F.col("node"))
    hubs = (hits.join(known, "node").groupBy("sig").agg(F.max_by("node", rank).alias("hub"), F.count(F.lit(1)).alias("size"))
            .filter("size > 1").drop("size"))
    grouped = written(hits.join(hubs, "sig").select("hub", "node").distinct(), "grouped")
    discard_table(hits)

    # Equal sets: all but the smallest id point at it, which stands for them in groups.
    reps = written(members.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")), "reps")
    copies = (members.select("doc_id", "n", "d1", "d2").join(reps.filter("rep <> other"), ["n", "d1", "d2"])
              .filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    # An id may have several sets; its texts are read and compared together.
    sizes = members.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sets"))
    groups = grouped
    for side in ("hub", "node"):
        groups = groups.join(reps.select(F.col("d1").alias(side), F.col("rep").alias(f"{side}_rep")), side)
    groups = groups.select(F.col("hub_rep").alias("hub"), F.col("node_rep").alias("node")).distinct().join(sizes, "node")
    found = _verified(written(groups, "groups"), docs, like)
    components = connected_components(found.union(copies))
    return (sets.join(components, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
