"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is merged once; those that end as one token are proven whole. A pre-token that is
proven whole counts as one token without any merging; only the rest is merged. A pre-token never reaches across white
space, so counts are remembered for each chunk between white space.

Nulls, empty and white-space texts count 0 tokens. Repeated rows each get their row; an empty table gives no rows.
Columns of the input that clash with the result's names are replaced, others stay.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bound_batches, texts_of, without
from cadenza.llm.vocabulary import END_OF_WORD, MEMO, SEPARATORS, Memo, WordSplitter, definition, merge, merge_ranks

VOCABULARY = "word_bpe_49k.json"


@lru_cache(maxsize=2)
def prove_whole(name: str = VOCABULARY) -> frozenset[str]:
    """Pre-tokens, in the vocabulary's byte letters, that merging turns into exactly one token."""
    d = definition(name)
    ranks = merge_ranks(d)
    words = [t[: -len(END_OF_WORD)] for t in d["model"]["vocab"] if t.endswith(END_OF_WORD) and t != END_OF_WORD]
    return frozenset(w for w in words if len(merge([*w[:-1], w[-1] + END_OF_WORD], ranks)) == 1)


class Counter:
    """Counts the tokens of texts as the library does without begin, end or added special tokens."""

    def __init__(self, name: str, whole: frozenset[str]):
        self.splitter = WordSplitter(name)
        self.single = whole | self.splitter.special.keys()
        self.rest, self.chunks = Memo(lambda p: len(self.splitter.model.tokenize(p)), MEMO // 2), Memo(self.chunk)

    def chunk(self, chunk: str) -> int:
        single, rest = self.single, self.rest
        return sum([1 if p in single else rest[p] for p in self.splitter.pretokens(chunk)])

    def text(self, text: str) -> int:
        if SEPARATORS.search(text):
            return self.chunk(text)
        return sum(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=1)
def _counter(name: str, whole: frozenset[str]) -> Counter:
    return Counter(name, whole)


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """The table with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text."""
    spark = df.sparkSession
    bound_batches(spark)
    proven = spark.sparkContext.broadcast(prove_whole(vocabulary))  # at most one entry per vocabulary string

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        counter = _counter(vocabulary, proven.value)
        return pa.array([counter.text(t) for t in texts_of(texts)], pa.int64())

    source = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_n", counted.asNondeterministic()(source)).withColumn("_b", F.octet_length(source).cast("long"))
    kept = [c for c in without(out, "n_bytes", "n_tokens", "over_limit", "_n", "_b").columns]
    return out.select(*kept, F.col("_b").alias("n_bytes"), F.col("_n").alias("n_tokens"), (F.col("_n") > limit).alias("over_limit"))
