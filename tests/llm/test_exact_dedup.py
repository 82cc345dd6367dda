import hashlib

import pytest
from edge_tables import documents, empty
from pyspark.sql import functions as F

from seqcast.llm.exact_dedup import _runs, drop_exact_duplicates, exact_duplicates


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_edge_cases(spark, keep):
    rows = exact_duplicates(documents(spark), keep=keep).collect()
    assert len(rows) == 13
    best = min if keep == "smallest" else max
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].keep_id for i in (4, 5)} == {best(4, 5)} and by_id[4].group_size == 3
    assert {by_id[i].keep_id for i in (6, 10)} == {best(6, 10)} and by_id[7].group_size == 1
    # Null is empty; a null id comes last.
    assert {by_id[i].keep_id for i in (1, 2)} == {best(1, 2)} and by_id[1].group_size == 3 and not by_id[3].group_size > 1
    assert by_id[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    # Exactly one row of each text stays, also of repeated rows.
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({r.text_sha256 for r in rows}) == len({r.text_sha256 for r in kept})
    assert exact_duplicates(empty(documents(spark)), keep=keep).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_a_hot_text_is_spread_and_merged(spark, keep):
    """Most rows are one text, which gets a salt, and some ids repeat."""
    df = spark.range(400).select((F.col("id") % 390).alias("doc_id"), F.when(F.col("id") % 4 > 0, "hot").otherwise(
        F.concat(F.lit("t"), F.col("id") % 16)).alias("text")).repartition(5)
    rows = exact_duplicates(df, keep=keep).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.text, []).append(r.doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    assert len(rows) == 400
    for r in rows:
        ids = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == ((min if keep == "smallest" else max)(ids), len(ids))
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)


def test_a_hot_text_on_rows_without_ids_is_spread(spark):
    """The salt comes from a row's place, so rows that are alike in all else do not come to one task."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("t"), F.col("id") % 100)).alias("text")).repartition(5)
    rows = exact_duplicates(df).collect()
    hot = [r for r in rows if r.text_sha256 == hashlib.sha256(b"hot").hexdigest()]
    assert len(rows) == 3000 and len(hot) == 2000 and {(r.keep_id, r.group_size) for r in hot} == {(None, 2000)} and sum(r.kept for r in hot) == 1
    salts = _runs(df, "doc_id", "text", "smallest", None, ()).filter("hot").groupBy("salt").count().collect()
    assert len(salts) > 1 and max(r["count"] for r in salts) <= 2000 / len(salts) + 10


def test_plan_sorts_once_and_runs_no_python(spark):
    out = exact_duplicates(documents(spark))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_normalising_and_other_columns(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "key long, body string")
    rows = exact_duplicates(df, "key", "body", normalise=lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))).collect()
    assert {r.key: r.keep_id for r in rows} == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        exact_duplicates(df, "key", "body", keep="any")


def test_dropping_keeps_whole_rows(spark):
    docs = documents(spark)
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns and out.count() == 8
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[4].text.startswith("One") and rows[4].n_chars == 28 and rows[4].hot == 7
    # The kept row of the empty texts is row 1, and its text is still null.
    assert rows[1].text is None and 2 not in rows and 5 not in rows and 10 not in rows
