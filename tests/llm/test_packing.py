import zlib

import numpy as np
import public_tokenizers
import pytest
from edge_tables import documents, empty
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import data_dir
from seqcast.llm import packing
from seqcast.llm.packing import ChunkEncoder, binary_lengths, pack, write_buckets

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's a <|endoftext|> <|ENDOFTEXT|>x don't. 'S we'Ll!! café́... é! Á b  x 1234 a1.5, --- ΣΑΣ. İ.", "", " \n", "x" * 300,
       "a\x1cb\x85c　d", "e ́", "word,word", "..a..", "A<|endoftext|>", "ﬁ ǅ ſ ẞ", "日本語。テキスト", "\U0001F600!!\U0001F600"]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(PATH)


@given(st.integers(0, 100_000), st.sampled_from([1, 8, 2048]))
def test_binary_lengths(n, longest):
    parts = binary_lengths(n, longest)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= longest for p in parts)
    assert len(parts) == n // longest + bin(n % longest).count("1")


@pytest.mark.parametrize("text", ODD)
def test_chunks_give_the_ids_of_the_whole_text(encoder, text):
    assert np.frombuffer(encoder(text.encode()), "<u4").tolist() == whole(text)


def test_chunks_on_all_small_documents(spark, encoder, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 500)
    for r in spark.read.parquet(f"{data_dir('0.001')}/documents.parquet").collect():
        assert np.frombuffer(encoder((r.text or "").encode()), "<u4").tolist() == whole(r.text or "")


def test_pieces_restore_the_documents(spark):
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(ODD)] + [(100, "word " * 5000, "b"), (101, None, None), (None, "no id", "c")])
    rows = pack(docs).withColumn("crc", F.crc32("ids")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert len(r.ids) == 4 * r.length and r.crc == zlib.crc32(r.ids) and r.offset == 0 and r.length & (r.length - 1) == 0
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    texts = dict(enumerate(ODD)) | {100: "word " * 5000, 101: "", None: "no id"}
    assert got == {i: [*whole(t), 1] for i, t in texts.items()}
    assert all(r.doc_tokens == len(got[r.doc_id]) for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows) and max(r.length for r in rows) == 2048


def test_edge_cases(spark):
    rows = pack(documents(spark)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    n = {r.doc_id: r.n for r in rows}
    assert n[1] == n[2] == n[3] == 1 and n[5] == 2 * n[4] and n[6] == n[10]
    assert pack(empty(documents(spark))).count() == 0
    with pytest.raises(ValueError):
        pack(documents(spark), longest=1000)


def test_buckets_hold_one_length(spark, tmp_path):
    write_buckets(pack(documents(spark), longest=64), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).filter("bucket <> length").isEmpty()
    assert spark.read.parquet(str(tmp_path / "b" / "bucket=64")).filter("length <> 64").isEmpty()


def test_sequences_are_numbered_by_bucket(spark):
    """Each length has a range of ids to itself, and the ids of a run are those of another."""
    docs = documents(spark).repartition(3)
    rows = pack(docs, longest=64).select("sequence_id", "length").collect()
    ranges = {}
    for r in rows:
        ranges.setdefault(r.length, []).append(r.sequence_id)
    ordered = [ranges[n] for n in sorted(ranges)]
    assert len(ordered) > 3 and all(max(a) < min(b) for a, b in zip(ordered[:-1], ordered[1:], strict=True)) and min(ordered[0]) >= 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pack(docs, longest=64).select("sequence_id", "length").collect()))


def test_a_tokenizer_that_knows_white_space_is_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    byte_level = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, merges=[]))
    byte_level.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    byte_level.save(str(tmp_path / "bytes.json"))
    with pytest.raises(ValueError, match="chunks"):
        ChunkEncoder(str(tmp_path / "bytes.json"))
