import re
import zlib
from collections import Counter

import pytest
from edge_tables import LONG, documents, empty

from conftest import data_dir
from seqcast.llm import spelling
from seqcast.llm.spelling import near_pairs, spelling_variants

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_edit(a, b):
    """By trying every edit of the longer word."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()}


def test_one_edit_by_prefix_and_suffix():
    every = ["aaaa", "aaa", "aaab", "aab", "abab", "baba", "aba", "ab", "xaaaa", "aaaax", "aaxaa", "caaa", "ca", "abcd", "acbd", "abd", "éaaa"]
    for longest in range(2, 6):
        words = [w for w in every if len(w) in (longest - 1, longest)]
        found = near_pairs(words, words, longest, 0) | near_pairs(words, words, longest, 1)
        assert not (near_pairs(words, words, longest, 0) & near_pairs(words, words, longest, 1)).any()
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                assert found[i, j] == (max(len(a), len(b)) == longest and one_edit(a, b)), (a, b)


@pytest.mark.parametrize("side, fill", [(1024, 384), (3, 4), (2, 1)])
def test_words_and_roots_equal_brute_force(spark, monkeypatch, side, fill):
    monkeypatch.setattr(spelling, "TILE_WORDS", side)
    monkeypatch.setattr(spelling, "FILL", fill)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir('0.001')}/documents.parquet").limit(120).collect()]
    # Chains of forms, ties, words within words, and accented ones.
    chain = {"abcdefgh": 80, "abcdefgi": 40, "abcdefji": 20, "abcdekji": 10, "abcdlkji": 5, "abcdlkjim": 4, "abcdefgj": 40, "aaaaa": 9, "aaaaaa": 9, "aaaaaaa": 20,
             "éèüÿa": 6, "éèüÿ": 9, "Éèüÿa": 3, "éèüÿab": 12}
    rows += [(10_000 + i, " ".join(w for w, n in chain.items() if i < n)) for i in range(80)]
    assert run(spark, rows) == brute(rows)


def test_windows_cut_no_run():
    text = b"ab cd " + b"x" * 50 + b" ef\xc3\xa9gh, ij"
    for size in (1, 2, 7, 60):
        spelling.WINDOW, before = size, spelling.WINDOW
        try:
            assert [r for w in spelling._windows(text) for r in spelling.RUN.findall(w)] == spelling.RUN.findall(text)
        finally:
            spelling.WINDOW = before


def test_edge_cases(spark):
    got = {r.word: r for r in spelling_variants(documents(spark)).collect()}
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert {tuple(got[w][c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for w in got} == brute(rows)
    assert spelling_variants(empty(documents(spark))).count() == 0
    # A run far longer than a window, repeated rows, and no ids.
    long = "".join(w for w in LONG if w.isalpha())[:3 << 19]
    rows = [(None, long), (None, long), (None, long), (None, long[:-1]), (7, long[:-1]), (8, long[:-1]), (1, None)]
    assert run(spark, rows) == brute(rows)
