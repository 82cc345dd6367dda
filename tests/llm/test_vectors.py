import numpy as np
from pyspark.sql import functions as F

from conftest import data_dir
from seqcast.llm import vector_search
from seqcast.llm.vector_search import MultiIndex, kmeans, nearest_neighbours


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(1) for c in ("unit", "a", "b", "block", "group", "rank", "score", "query_id", "d", "count", "largest")})


def brute(rows, every=50, nearest=5):
    out = {}
    for q, x in rows:
        if q % every == 0:
            x = np.array(x, float)
            scored = [(-(np.array(y, float) @ x) / np.linalg.norm(x) / np.linalg.norm(np.array(y, float)), i) for i, y in rows if i != q]
            out[q] = sorted(scored)[:nearest]
    return out


def test_all_pairs_of_centroids_in_order():
    index = MultiIndex((np.zeros((3, 2)), np.zeros((4, 2))), np.ones((3, 4), np.int64))
    far = (np.array([3.0, 1.0, 2.0]), np.array([0.5, 4.0, 0.1, 2.0]))
    walk = index.cells(far, 12)
    sums = [far[0][a] + far[1][b] for a, b in walk]
    assert len(set(walk)) == 12 and sums == sorted(sums)
    assert len(index.cells(far, 5)) == 5


def test_kmeans_finds_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.01, (50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    assert len(kmeans(x, 200)) == 150
    means = np.array(sorted(np.round(kmeans(x, 3, seed=2)).tolist()))
    assert len(means) == 3


def test_exact_when_all_is_probed(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 30)
    monkeypatch.setattr(vector_search, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=9).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # a third of a block is one vector
    got = nearest_neighbours(vectors(spark, rows), probe_share=1.0).collect()
    want = brute(rows)
    for q, best in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert [v for _, v, _ in mine] == [i for _, i in sorted((round(s, 9), i) for s, i in best)]
        assert np.allclose([s for *_, s in mine], [-s for s, _ in best], atol=1e-12)


def test_a_query_that_repeats_is_one_query(spark):
    """A row twice loses no neighbour; an id with two vectors is two queries."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(120)]
    again, other = (50, rows[50][1]), (100, rng.normal(size=4).astype(np.float32).tolist())
    got = nearest_neighbours(vectors(spark, [*rows, again, again, other]), probe_share=1.0).collect()
    for q in (0, 50):
        best = brute([*rows, other])[q] if q == 50 else brute([*rows, again, again, other])[q]
        assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(k, i) for k, (_, i) in enumerate(best, 1)]
    for vector in (rows[100][1], other[1]):
        best = brute([*[r for r in rows if r[0] != 100], again, again, (100, vector)])[100]
        assert {(k, i, round(-s, 9)) for k, (s, i) in enumerate(best, 1)} <= {(r.rank, r.vec_id, round(r.score, 9)) for r in got if r.query_id == 100}
    assert sum(r.query_id == 100 for r in got) == 10


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{data_dir('0.01')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = nearest_neighbours(df, probe_rows=0).collect()
    want = {(q, i) for q, best in brute(rows).items() for _, i in best}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & want) / len(want) >= 0.9


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]),
            (None, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 1e-30]), (8, [0.0, 1e-30]), (9, []), (100, [0.0, 0.0]), (10, [-3e38, 0.0])]
    got = nearest_neighbours(vectors(spark, rows)).collect()
    by = {q: [(r.vec_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50)}
    assert {r.query_id for r in got} == {0, 50}
    assert by[0] == [(1, 1.0), (50, 1.0), (8, 0.0), (8, 0.0), (10, -1.0)] and by[50] == [(0, 1.0), (1, 1.0), (8, 0.0), (8, 0.0), (10, -1.0)]
    assert nearest_neighbours(vectors(spark, rows).limit(0)).count() == 0
    assert nearest_neighbours(vectors(spark, [(0, [1.0, 2.0])])).count() == 0
