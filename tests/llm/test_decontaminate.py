import hashlib
import re

import numpy as np
import pytest
from edge_tables import documents, empty
from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks.compare import database, difference
from conftest import data_dir
from seqcast.llm import decontaminate
from seqcast.llm.decontaminate import contamination, item_list, prefixes, windows_of

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    windows = [(i, w[a: a + 10]) for i, t in items if (w := words(t)) for a in range(max(1, len(w) - 9))]
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for item, window in windows:
            for a in range(len(own) - len(window) + 1):
                if own[a: a + len(window)] == window:
                    hit.update(range(a, a + len(window)))
                    found |= {item} - {None}
        out.append((doc, len(own), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs, items):
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got.collect()), key=str)


def made(seed):
    """Passages whole, cut, at both ends of a text, overlapping, of words in other order; items that share windows or have few words."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate([30, 25, 12, 10, 9, 4, 2, 1, 40, 11])]
    items[9] = (9, "again and again and again and again and again and again")
    items += [(20, items[0][1] + " more"), (21, "same same same same same same same same same same same"), (5, "Été 日本"), (None, "z1 z2 z3"), (30, None), (31, " .,")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            w = words(items[int(rng.integers(len(items)))][1])
            a = int(rng.integers(0, 3)) if rng.random() < 0.4 else 0
            w = w[a: len(w) - (int(rng.integers(0, 3)) if rng.random() < 0.4 else 0)]
            parts += [", ".join(rng.permutation(w) if rng.random() < 0.2 and w else w).upper(), " ".join(rng.choice(vocabulary, int(rng.integers(0, 6))))]
        docs.append((i, " ".join(parts)))
    docs += [(100, "same " * 25), (101, "again and " * 9), (102, None), (103, ""), (None, items[0][1]), (0, docs[0][1]), (0, docs[0][1]), (0, "été 日本 z1 z2 z3"),
             (104, "été"), (105, "日本 été")]
    return docs, items


@pytest.mark.parametrize("seed, tile", [(1, 500_000), (2, 3), (3, 1)])
def test_hits_equal_those_of_all_windows(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(decontaminate, "TILE", tile)
    docs, items = made(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_ITEM_WORDS", 40)
    docs, items = made(5)
    assert run(spark, docs, items) == brute(docs, items)


def test_a_window_is_known_by_its_rarest_shingle():
    item = np.arange(1, 13, dtype=np.uint64)
    windows = windows_of([(1, item), (2, item[:10]), (3, item[:2])])
    assert sorted(zip(windows.lengths.tolist(), windows.items, strict=True)) == [(2, [3]), (10, [1]), (10, [1]), (10, [1, 2])]
    known = {k: np.unique(windows.shingles(k)[0]) for k in (1, 2, 3)}
    assert [len(v) for v in known.values()] == [0, 1, 10]
    times = {k: np.full(len(v), 5) for k, v in known.items()}
    hashes, window, place = windows.shingles(3)
    rare = hashes[(window == 0) & (place == 4)][0]
    times[3][np.searchsorted(known[3], rare)] = 1
    index = prefixes(windows, known, times)
    assert index[3].known.tolist() == [rare] and sorted(index[3].place.tolist()) == [2, 3, 4]
    times[3][:] = 0
    assert 3 not in prefixes(windows, known, times)


def test_edge_cases(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "one two three four five"), (2, "word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 word17 word18")],
                                  "item_id long, text string").withColumns({"doc_id": F.lit(3), "words": F.lit(1), "pass": F.lit(2)})
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in contamination(docs, items).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert contamination(empty(docs), items).count() == 0
    assert contamination(docs, empty(items)).filter("n_hit = 0 and size(items) = 0").count() == 13


def test_items_are_listed_as_strings(spark):
    row = spark.createDataFrame([([10, 9, 2, 100],), ([],)], "items array<long>").select(item_list(F.col("items")).alias("s")).collect()
    assert [r.s for r in row] == ["10,100,2,9", ""]


def test_query_equals_its_sql(spark):
    got = contract.queries()["op13_decontamination"](spark, data_dir("0.001")).toPandas()
    assert got.contaminated.any() and hashlib.sha256(b"").hexdigest() in set(got.items_sha256)
    assert difference(got, database(data_dir("0.001")).execute(contract.oracle_sql()["op13_decontamination"]).df()) is None
