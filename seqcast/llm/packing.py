"""Pack documents into sequences without padding: each is cut into pieces of power-of-two length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.sources.ship import ship_package

LONGEST = 2048
END = 1
CACHED_CHUNKS = 300_000
LONG_CHUNK = 64
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL = b"<|"
# Texts that a tokenizer has to encode by chunks as it does whole: cases, accents, marks within and behind words, digits, other alphabets, white space.
PROBES = ("Hello, World! Don't stop-ping (now).", "Caf\u00e9 \u00dcber na\u00efve \u00e9\u00e8", "a1b2 3.14 1,000 x_y a@b.c", "\u65e5\u672c\u8a9e \u0440\u0443\u0441 \U0001F600 ok",
          "tab\tline\r\nend  two", "word word. word", "#tag $5 50% a/b \"q\" 'r' [s]")

# Ids of a bucket's sequences; the bucket's number stands above them.
BUCKET_BITS = 58

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """``n`` as a sum of powers of two, none above ``longest`` (a power of two itself), largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class ChunkEncoder:
    """Ids of a text as little-endian 32-bit bytes, encoded by chunks between ASCII white space.

    This vocabulary's pre-tokenizer drops white space, lower-cases, and parts letters from marks, and no token crosses these
    borders. So the ids of a text are those of its chunks one after the other, and a word with
    ASCII marks behind it has the word's ids and then the marks'; tests compare with whole texts.
    Ids of short chunks are kept in two generations, the older of which goes when the younger is full.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        for probe in PROBES:
            whole = np.array(self.tokenizer.encode(probe, add_special_tokens=False).ids, "<u4").tobytes()
            if self(probe.encode()) != whole:
                raise ValueError(f"{path} does not encode a text as the chunks between its white space and marks")
        self.young = {}

    def _find(self, chunk: bytes) -> bytes | None:
        ids = self.young.get(chunk)
        if ids is None and (ids := self.old.get(chunk)) is not None:
            self.young[chunk] = ids
        return ids

    def _encode(self, chunk: bytes) -> bytes:
        ids = self._find(chunk)
        if ids is None:
            # Not the batch call: its threads would take more than this task's core.
            ids = np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
            self._keep(chunk, ids)
        return ids

    def _keep(self, chunk: bytes, ids: bytes) -> None:
        if len(chunk) <= LONG_CHUNK:
            if len(self.young) >= CACHED_CHUNKS:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids

    def _fresh(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(MARKS)
        if word == chunk or not word.decode("utf-8", "replace").isalpha():
            return self._encode(chunk)
        ids = self._encode(word) + self._encode(chunk[len(word):])
        self._keep(chunk, ids)
        return ids

    def __call__(self, text: bytes) -> bytes:
        if SPECIAL in text:  # names of special tokens are told apart by case and may touch words
            return b"".join([self._encode(c) for c in text.split()])
        young, out = self.young.get, []
        for chunk in text.lower().split():
            ids = young(chunk)
            if ids is None:
                ids = self._find(chunk)
                if ids is None:
                    ids = self._fresh(chunk)
                young = self.young.get
            out.append(ids)
        return b"".join(out)


@cache
def encoder(path: str) -> ChunkEncoder:
    """One per worker process, so that later tasks find what earlier ones encoded."""
    return ChunkEncoder(path)


def _pieces(tokenizer_path: str | None, longest: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path is None:
            import public_tokenizers

            encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
        else:
            encode = encoder(tokenizer_path)
        end = np.array([END], "<u4").tobytes()
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        out: list[list] = [[] for _ in names]
        held = 0

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            for c in out:
                c.clear()
            return done

        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id"), rows.column("text"), strict=True):
                ids = encode(text.as_py() or b"") + end
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    for c, value in zip(out, (doc_id.as_py(), start, length, ids[4 * start: 4 * (start + length)], n), strict=True):
                        c.append(value)
                    start += length
                held += len(ids)
                if held > 8 << 20:
                    yield batch()
                    held = 0
        yield batch()

    return cut


def pack(docs: DataFrame, longest: int = LONGEST, tokenizer_path: str | None = None) -> DataFrame:
    """Cut every document's ids, an end id included, into sequences of power-of-two length.

    Returns a row per piece: ``doc_id, start, length, ids`` (little-endian 32-bit),
    ``doc_tokens, sequence_id, offset``. A document of n ids gives its binary digits: pieces of
    ``longest`` and then one for each set bit of the rest. A piece is a sequence of its own, so no
    sequence crosses documents and none is padded; a batch takes sequences of one ``length``, which
    is the bucket (``write_buckets``): sequences are numbered bucket by bucket, so those of a length have a range of ids to themselves.
    Nothing is shuffled: a task sees one document at a time.
    Within a bucket ``sequence_id`` follows the row's place in its task's partition, so a task that runs again gives the same.

    ``tokenizer_path`` defaults to the word vocabulary among the public tokenizers of the machine; one that does not encode a text
    chunk by chunk is refused. Very long texts are encoded whole, a chunk at a time.
    Null text is empty and gives one piece, the end id. Repeated rows and null ids are packed as they
    come. An empty table gives no rows; other columns are ignored.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest is a power of two")
    ship_package(docs.sparkSession.sparkContext)
    pieces = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_pieces(tokenizer_path, longest), PIECES)
    bucket = F.log2("length").cast("long")
    return (pieces.withColumn("sequence_id", F.shiftleft(bucket, BUCKET_BITS) + F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so that a reader of equal lengths opens nothing else."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
