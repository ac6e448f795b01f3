"""Token ids in ORC files.

Documents are dealt out by ranges of their id and sorted, so every file and every stripe holds a narrow range of ids:
ORC's integer run-length encoding packs the ids of tokens, its row indexes and Bloom filters on doc_id let a reader
skip stripes and row groups, and Spark reads stripes in parallel. Each row also holds its position within its part;
the sums by part, one number a part, turn these into positions in the whole sequence.

Null texts are empty: only the end id. Rows with equal ids follow in the order of a hash of their text, then the text;
null ids come first. An empty table gives no rows. Only doc_id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import bound_batches
from cadenza.llm.vocabulary import MEMO, SEPARATORS, Memo, WordSplitter

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Chunks that a worker remembers and the characters that they may have on average.
HELD, HELD_CHARS = 5 * MEMO // 2, 12
#: Bytes of text that are encoded at once.
PIECE = 4 << 20
#: Marks that are a pre-token by themselves behind a word.
MARKS = frozenset(".,;:!?)\"")
_SCHEMA = "doc_id {kind}, part int, local_start long, n_tokens long, ids array<int>"


class Encoder:
    """The ids that the library gives; a pre-token never reaches across white space, so they are remembered by chunk.
    Pre-tokens of chunks that hold several are remembered apart, as their letters stand for bytes."""

    def __init__(self, name: str):
        self.splitter = WordSplitter(name)
        self.words, self.chunks = Memo(self.word, MEMO // 4), Memo(self.chunk, HELD, HELD_CHARS)

    def word(self, pretoken: str) -> bytes:
        s = self.splitter
        ids = [s.special[pretoken]] if pretoken in s.special else [t.id for t in s.model.tokenize(pretoken)]
        return array("i", ids).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if chunk.isalpha():
                return array("i", [t.id for t in self.splitter.model.tokenize(chunk.lower())]).tobytes()
            if chunk[:-1].isalpha() and chunk[-1] in MARKS:
                return self.chunks[chunk[:-1].lower()] + self.words[chunk[-1]]
        found = self.splitter.pretokens(chunk)
        return self.word(found[0]) if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def text(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return self.chunk(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's with the end id, and where each text's ids stop. Each
        distinct chunk of the column is looked up once."""
        if pc.any(pc.match_substring_regex(texts, SEPARATORS.pattern)).as_py():
            end = np.array([end_id], "<i4").tobytes()
            packed = [self.text(t) + end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(packed), "<i4"), np.cumsum([len(p) // 4 for p in packed])
        split = pc.utf8_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        packed, of = list(map(self.chunks.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False))), chunks.indices.to_numpy()
        sizes = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        stops, n = np.cumsum(sizes, dtype=np.int32), sizes[of]
        ends = np.cumsum(n, dtype=np.int32)
        at = np.repeat((stops - sizes)[of] - ends + n, n)  # from an id's place to its place among the distinct chunks'
        at += np.arange(len(at), dtype=np.int32)
        bounds = np.concatenate([[0], ends])[np.cumsum(split.value_lengths().to_numpy())]
        return np.insert(np.frombuffer(b"".join(packed), "<i4")[at], bounds, end_id), bounds + np.arange(1, len(texts) + 1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about PIECE bytes of text, one row at least: what is made of a batch is many times its size."""
    for b in batches:
        if b.num_rows:
            part = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64) // PIECE
            starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            yield from (b.slice(i, j - i) for i, j in zip(starts, starts[1:]))


@lru_cache(maxsize=1)
def _encoder(name: str) -> Encoder:
    return Encoder(name)


def write(df: DataFrame, path: str, text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, stripe_bytes: int = 32 << 20, row_stride: int = 1000) -> str:
    """Encode whole texts, append the end id and write ORC files in ascending doc_id order below path."""
    bound_batches(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, encoder = TaskContext.get().partitionId(), 0, _encoder(vocabulary)
        for b in pieces(batches):
            ids, stops = encoder.column(b.column("text"), end_id)
            n = np.diff(stops, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + stops - n), pa.array(n), lists], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
            at += int(stops[-1])
            pa.default_memory_pool().release_unused()

    (
        dealt.select("doc_id", "text").mapInArrow(encoded, _SCHEMA.format(kind=kind))
        .write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_stride)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd").orc(path)
    )
    return path


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids from the files. With doc_ids, row indexes and Bloom filters prune what is read."""
    bound_batches(spark)
    spark.conf.set("spark.sql.orc.columnarReaderBatchSize", "512")  # rows hold whole documents
    files = spark.read.orc(path)
    sums = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a number a file
    offsets, at = [], 0
    for part, n in sums:
        offsets.append((part, at))
        at += n
    offsets = spark.createDataFrame(offsets, "part int, part_start long")
    if doc_ids is not None:
        files = files.where(F.col("doc_id").isin(doc_ids))
    return files.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids that were read."""

    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        values, stops = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(stops[:-1], stops[1:])], pa.int64())

    return df.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), crc.asNondeterministic()("ids").alias("ids_crc32"))
