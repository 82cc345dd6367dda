import re
import tracemalloc

import numpy as np
import pytest
from edge_tables import documents, empty
from pyspark.sql import functions as F

from conftest import data_dir
from seqcast.llm import jaccard_join
from seqcast.llm.components import connected_components
from seqcast.llm.jaccard_join import Similarity, common_shingles, group_links, near_duplicates, signatures


def shingles(text, k):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(words[i: i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, like):
    """Component and set size by comparing all pairs."""
    sets = [shingles(t, like.words) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= like.percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(i), root(rows[y][0])))
                parent[b] = a
    return {(i, len(s), root(i)) for (i, _), s in zip(rows, sets)}


def edited(rng, words, rate):
    return " ".join(w if rng.random() > rate else f"new{rng.integers(10**6)}" for w in words)


def chains(seed):
    """Groups of copies at all distances, chains of links, common passages and short texts."""
    rng, texts = np.random.default_rng(seed), []
    passage = " ".join(f"pass{i}" for i in range(50))
    for g in range(12):
        words = [f"g{g}w{rng.integers(400)}" for _ in range(int(rng.choice([3, 6, 9, 15, 40, 200, 600])))]
        for _ in range(8):
            texts.append(edited(rng, words, rng.choice([0, 0.002, 0.01, 0.03, 0.1])))
        for _ in range(5):  # each a little further from the first
            words = words[2:] + [f"g{g}x{rng.integers(10**6)}"]
            texts.append(" ".join(words))
    texts += [" ".join([f"r{rng.integers(10**6)}" for _ in range(30)] + [passage] + [f"r{rng.integers(10**6)}" for _ in range(30)]) for _ in range(40)]
    texts += ["", "one", "One", "one two", "a b c d", "A B  C\tD", "a b c d e"]
    order = rng.permutation(len(texts))
    return [(int(i) + 1, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("like", [Similarity(4, 85), Similarity(5, 80), Similarity(2, 60)])
def test_components_equal_those_of_all_pairs(spark, like, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_SHINGLES", 900)
    rows = chains(like.words)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), like).collect()
    assert {tuple(r) for r in got} == brute(rows, like)


@pytest.mark.parametrize("like", [Similarity(4, 85), Similarity(5, 80), Similarity(4, 55), Similarity(4, 50), Similarity(4, 30)])
def test_linked_sets_share_a_signature(like):
    """Sets at the edge of similarity, over all small sizes and some larger, with and without common elements."""
    rng = np.random.default_rng(3)
    for n in [*range(1, 120), 300, 1000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64, endpoint=True))
            drop = rng.integers(0, like.differences(2 * n) + 1)
            add = rng.integers(0, like.differences(2 * n) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[: max(1, n - drop)], rng.integers(0, 2**64 - 1, add, np.uint64, endpoint=True)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < like.percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            for common in (None, np.sort(rng.choice(a, len(a) // 2, replace=False)), np.sort(a)):
                assert len(np.intersect1d(signatures(a, like, common), signatures(b, like, common)))


@pytest.mark.parametrize("percent", [55, 50, 30, 1])
def test_low_percents_end_and_lose_no_link(spark, percent):
    """Where no partitioning covers most sets."""
    rng = np.random.default_rng(percent)
    rows = []
    for g in range(8):
        words = [f"g{g}w{rng.integers(200)}" for _ in range(int(rng.choice([2, 5, 12, 40, 90])))]
        rows += [" ".join(words[int(rng.integers(0, len(words) // 2 + 1)):] + [f"x{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 10)))]) for _ in range(9)]
    rows = list(enumerate(rows))
    like = Similarity(2, percent)
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()} == brute(rows, like)


def test_percents_beyond_sense_are_refused():
    for percent in (0, -1, 101):
        with pytest.raises(ValueError):
            Similarity(4, percent)


def test_a_group_gives_fewer_links_than_members():
    base = np.arange(1000, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[: 990], np.arange(5, dtype=np.uint64) + 10_000 * (i + 1)])) for i in range(50)]
    assert len(group_links(sets, Similarity(4, 85))) == 49


def template_lines(n):
    """Sets of 13 elements of which 12 are the same."""
    base = np.arange(12, dtype=np.uint64)
    return [np.append(base, np.uint64(100 + i)) for i in range(n)]


def test_memory_of_a_group_of_many_short_sets_is_bounded():
    loners = [np.append(np.arange(12, dtype=np.uint64) + np.uint64(30 * i + 10**7), np.uint64(5)) for i in range(300)]
    tracemalloc.start()
    links = group_links(template_lines(20_000) + loners, Similarity(4, 85))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == 19_999 and peak < 300 << 20


@pytest.mark.parametrize("cells", [10, 4_000_000])
def test_group_links_equal_those_of_all_pairs(monkeypatch, cells):
    monkeypatch.setattr(jaccard_join, "CELLS", cells)
    rng, like = np.random.default_rng(4), Similarity(4, 85)
    for _ in range(10):
        bases = [np.arange(20) + 1000 * b for b in range(3)]
        sets = [np.unique(np.where(rng.random(20) < 0.07, rng.integers(10**6, size=20), bases[rng.integers(3)])).astype(np.uint64) for _ in range(60)]
        apart = rng.random(60) < 0.4
        for flags in (None, apart):
            both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
            n = np.diag(both)
            linked = 100 * both >= like.percent * (n[:, None] + n - both)
            want = connected(linked if flags is None else linked & (flags[:, None] != flags))
            got = np.zeros((60, 60), bool)
            for i, j in group_links(sets, like, int(rng.integers(60)), flags):
                assert linked[i, j]
                got[i, j] = got[j, i] = True
            labels = connected(got)
            # With flags, links within a side may be found too.
            assert all(labels[i] == labels[j] for i in range(60) for j in range(60) if want[i] == want[j])
            assert flags is not None or len(set(labels)) == len(set(want))


def connected(linked):
    label = np.arange(len(linked))
    for i, j in zip(*np.nonzero(linked), strict=True):
        label[label == label[j]] = label[i]
    return label


def test_a_large_group_in_chunks_by_sets(spark, monkeypatch):
    """Template lines that link to the hub, and others of the same group that only link among themselves."""
    monkeypatch.setattr(jaccard_join, "MOST_SETS", 7)
    words = [f"w{i}" for i in range(15)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(60)]
    rows += [(100 + i, " ".join([*words[:13], f"a{i % 5}", *words[14:], f"b{i % 7}"])) for i in range(40)]
    rows += chains(6)[:60]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    like = Similarity(4, 85)
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), like).collect()} == brute(rows, like)


def test_common_shingles_are_few(spark):
    df = spark.createDataFrame([(i, f"x{i} a b c d y{i}") for i in range(20)], "doc_id long, text string").select(
        "doc_id", F.col("text").cast("binary").alias("text"))
    assert len(common_shingles(df, Similarity(4, 85))) == 1


def test_small_documents_table(spark):
    like = Similarity(4, 85)
    df = spark.read.parquet(f"{data_dir('0.001')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {tuple(r) for r in near_duplicates(df, like).collect()} == brute(rows, like)


def test_edge_cases(spark):
    got = near_duplicates(documents(spark)).collect()
    assert len(got) == 13
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)] and by_id[3] == [(0, 3)]
    assert by_id[4] == [(2, 4)] and by_id[5] == [(2, 4), (2, 4)]
    assert [c for i in (6, 7, 10) for _, c in by_id[i]] == [6, 6, 6]
    assert sorted(c is None for _, c in by_id[None]) == [True, True] and by_id[8] == [(1, 8)]
    assert near_duplicates(empty(documents(spark))).count() == 0


def test_a_copy_without_an_id_takes_no_signatures_away(spark):
    words = [f"w{i}" for i in range(30)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, text), (7, text), (8, near), (None, near)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), Similarity(4, 85)).collect()
    assert {r.doc_id: r.component_id for r in got} == {None: None, 7: 7, 8: 7}


@pytest.mark.parametrize("parts", [1, 4])
def test_every_text_of_a_repeated_id_is_compared(spark, parts):
    a, b, c = ([f"{x}{i}" for i in range(30)] for x in "abc")
    rows = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, " ".join([*b[:-1], "other"])),  # 5 has 1's text and one of its own
            (11, " ".join(c)), (11, ""), (12, " ".join(["new", *c[1:]])), (13, "")]
    like = Similarity(4, 85)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), like).collect()
    assert {tuple(r) for r in got} == brute(rows, like)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 300), (200, 300), (5, 5)] + [(1000, i) for i in range(1001, 1300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100} | {i: 1000 for i in range(1000, 1300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_of_few_members_are_moved_once(spark, monkeypatch):
    """To the groups they are compared in, also where the planner finds the members too many to broadcast."""
    plans = []
    keep = jaccard_join.written

    def seen(df, name):
        if name == "found":
            plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return keep(df, name)

    monkeypatch.setattr(jaccard_join, "written", seen)
    monkeypatch.setattr(jaccard_join, "MOST_SETS", 3)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    like = Similarity(4, 85)
    rows = [(i, " ".join([*(f"w{k}" for k in range(30)), *(f"x{i}_{k}" for k in range(1 + i % 3))])) for i in range(1, 25)]
    rows += [(100 + i, " ".join([*(f"w{k}" for k in range(12)), *(f"y{i}_{k}" for k in range(20))])) for i in range(12)]
    try:
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert {tuple(r) for r in got} == brute(rows, like)
    assert plans and all(len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\btext#", plan)) == 1 for plan in plans)
