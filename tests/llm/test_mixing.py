import itertools

import numpy as np
import pytest
from edge_tables import documents, empty
from hypothesis import given, settings as examples
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqcast.llm.mixing import fit_budget, mix_sources


def by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= full
    return target


@examples(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.floats(0, 1))
def test_budgets_are_fitted_as_near_as_brute_force(counts, part):
    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    budget = int(part * (lengths * n).sum())
    take = fit_budget(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all() and (take * lengths).sum() <= budget
    if budget <= 2 * lengths.max() and (n * budget // (lengths * n).sum()).sum() == 0:
        sums = {0}
        for length, k in zip(lengths, n):
            sums = {s + length * i for s in sums for i in range(k + 1)}
        assert (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_large_budgets_leave_less_than_the_longest_document():
    rng = np.random.default_rng(0)
    lengths = np.unique(rng.integers(1, 30_000, 3000))
    counts = rng.integers(1, 1000, len(lengths))
    total = int((lengths * counts).sum())
    for part in (0.1, 0.5, 0.999):
        take = fit_budget(lengths, counts, int(part * total))
        assert (take <= counts).all() and int((take * lengths).sum()) == int(part * total)


def test_mix_of_random_sources(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "b", "a", "ä", "Z"][rng.integers(5)]) for i in range(600)]
    df = documents(spark, rows)
    got = mix_sources(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    target = by_hand(sizes)
    assert len(got) == 600
    taken = {}
    for r in got:
        assert r["size"] == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mix_sources(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    other = mix_sources(df, seed=8).collect()
    assert sorted((r.doc_id, r.taken) for r in got) != sorted((r.doc_id, r.taken) for r in other)


def test_targets_stop_at_twice_the_source(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (50, "b"), (3, "c"), (2, "d")])]
    got = {r.source: r for r in mix_sources(documents(spark, rows)).collect()}
    want = by_hand({"a": 1, "b": 50, "c": 3, "d": 2})
    assert {s: r.target for s, r in got.items()} == pytest.approx(want) and got["a"].taken == 2


def test_edge_cases(spark):
    out = mix_sources(documents(spark), carry=["text", "size"])
    rows = out.collect()
    assert len(rows) == 13 and out.columns[-2:] == ["text", "size"]
    sized = {r.doc_id: r for r in mix_sources(documents(spark)).collect() if r.doc_id}
    assert (sized[1]["size"], sized[1].taken, sized[3]["size"], sized[6]["size"]) == (0, 0, 0, 120_000)
    assert mix_sources(empty(documents(spark))).count() == 0
    wordless = mix_sources(documents(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.target, r.taken) for r in wordless] == [(0.0, 0), (0.0, 0)]


def test_many_documents_of_one_length(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    got = mix_sources(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 3 for r in got)


def test_many_documents_without_ids(spark):
    """They are drawn by their place and are as good as others; a run over the same files agrees."""
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source")).union(
        spark.createDataFrame([(9999, "w " * 9000, "y")], "doc_id long, text string, source string"))
    got = mix_sources(df, weights=(1, 2)).filter("source = 'x'")
    rows = got.groupBy().agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count(F.lit(1)).alias("n")).first()
    assert rows.n == 4000 and abs(rows.taken - rows.target) < 3
    assert sorted(map(str, got.collect())) == sorted(map(str, mix_sources(df, weights=(1, 2)).filter("source = 'x'").collect()))


def test_rows_that_share_an_id_are_told_apart_by_what_comes_out(spark):
    rows = [(5, f"{chr(97 + i % 26)}{i} b c", "x") for i in range(300)] + [(1, "w " * 9000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted((r.text, r.taken) for r in mix_sources(d, weights=(1, 9), carry=["text"]).collect()) for d in (df.repartition(2), df.repartition(7)))
    assert first == again and len({t for text, t in first if len(text) < 99}) == 2
