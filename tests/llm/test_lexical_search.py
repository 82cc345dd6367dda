import math
import re
from collections import Counter

import numpy as np
import pytest
from edge_tables import documents, empty

import __spark_entry__ as contract
from checks.compare import database, difference
from conftest import data_dir
from seqcast.llm import lexical_search
from seqcast.llm.lexical_search import ranked_search

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(items, docs, most=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in set(terms(text)) if t in bag)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


def run(spark, items, docs, most=50):
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search(items, docs, most).collect()), key=str)


def made(seed, n=300):
    """Documents of all lengths over few words, some alike, some of another alphabet."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(60)] + ["É", "日本", "x1y"])
    shares = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 2 + 4 ** rng.integers(1, 6))), p=shares / shares.sum())) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[0]) for i in range(40)] + [(0, texts[0]), (None, texts[1]), (None, None), (5000, "...")]
    items = [(i, " ".join(rng.choice(words, 8))) for i in range(15)] + [(3, "w1 W1 w2"), (77, "nowhere"), (78, ""), (79, None), (None, "w3 É")]
    return items, docs


@pytest.mark.parametrize("rows, seed, most", [(8192, 100, 50), (7, 1, 5), (20, 2, 1)])
def test_ranks_equal_those_of_all_scores(spark, monkeypatch, rows, seed, most):
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", rows)
    monkeypatch.setattr(lexical_search, "SEED", seed)
    items, docs = made(rows)
    assert run(spark, items, docs, most) == brute(items, docs, most)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "MOST_ITEM_TERMS", 20)
    items, docs = made(4, 60)
    assert run(spark, items, docs) == brute(items, docs)


def test_a_block_leaves_out_only_what_cannot_be_ranked():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for _ in range(60):
        dense = np.where(rng.random((50, 12)) < 0.4, rng.integers(1, 1000, (50, 12)), 0)
        dense[:, 0] += 1
        table = pa.table({"doc_id": pa.array(rng.permutation(50)), "length": np.sqrt((dense.astype(float) ** 2).sum(axis=1)),
                          "terms": [np.flatnonzero(r) for r in dense], "impacts": [r[r > 0] for r in dense]})
        own = rng.choice(12, int(rng.integers(1, 9)), replace=False)
        floor = int(rng.integers(0, 4000))
        found = lexical_search.Ranking(5, floor)
        lexical_search.Block(table, 12).best(own, found)
        scores = dense[:, own].sum(axis=1)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), table["doc_id"].to_pylist(), strict=True) if s >= max(1, floor))[:5]
        assert list(zip((-found.scores).tolist(), found.ids.tolist(), strict=True)) == want


def test_edge_cases(spark):
    docs = documents(spark)
    items = docs.withColumnRenamed("doc_id", "item_id").limit(9)
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search(items, docs).collect()), key=str)
    assert got == brute([(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    assert ranked_search(items, empty(docs)).count() == 0
    assert ranked_search(empty(items), docs).count() == 0


def test_query_equals_its_sql(spark):
    got = contract.queries()["op11_lexical_search"](spark, data_dir("0.001")).toPandas()
    assert difference(got, database(data_dir("0.001")).execute(contract.oracle_sql()["op11_lexical_search"]).df()) is None
