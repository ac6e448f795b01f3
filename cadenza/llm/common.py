"""What the operators of this subpackage share: reading, shared storage, bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper bounds of one Arrow batch between the JVM and a Python worker; whichever is met first ends a batch.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts do not add up in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors see.

    Only on a local master, as in tests, a local temporary folder takes its place where that setting is absent; a
    cluster's executors would write where nobody else reads, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "cadenza-shared")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result as Parquet to the shared folder and read it again: it is computed once, survives the loss of any
    executor, and later plans know its size."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cadenza_path = path
    return out


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that materialize() makes inside are deleted at the end, but for those taken off the list; what is read
    later must be written before."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that materialize() made, once nothing reads it any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of one key that a task joins: the larger of these and this share of all rows. Keys with more are spread.
PIECE, PIECES = 2_000, 4_096


def spread_join(rows: DataFrame, table: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """rows joined with a table of their keys, in which `n` tells how many rows have the key; n is dropped.

    Keys with more rows than a piece are dealt to several tasks by a hash of the whole row, their table rows to each of
    these. At most PIECES keys can be that frequent, so they are broadcast; all other keys are joined as they are.
    """
    keys = [key] if isinstance(key, str) else key
    piece = max(PIECE, total // PIECES)
    pieces = F.greatest(F.ceil(F.col("n") / piece).cast("int"), F.lit(1))
    hot = table.where(F.col("n") > piece).select(*keys, pieces.alias("_pieces")).distinct()
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_piece", F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_pieces")).cast("int")))
    spread = table.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("n")
    return dealt.join(spread, [*keys, "_piece"]).drop("_pieces", "_piece")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns of the given names in any letter case: results replace columns that clash."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def remainder(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 3 (null for a null id). Rows with 1 are held out from all training."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


#: Slices of ids from which a bounded sample takes equal numbers.
SLICES = 64


def bounded_sample(ids: DataFrame, group: str, most: int, seed: int) -> DataFrame:
    """About `most` rows (doc_id, group) of each group at most, evenly from SLICES slices of the ids' hash, with the
    rank k within a slice. Each slice is ranked by itself and limited before the shuffle, so no task holds a group."""
    h = ids.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed))).withColumn("_slice", F.pmod("h", F.lit(SLICES)))
    k = F.row_number().over(Window.partitionBy(group, "_slice").orderBy("h", "doc_id"))
    return h.withColumn("k", k).where(F.col("k") <= -(-most // SLICES)).drop("_slice")


def texts_of(column) -> list[str]:
    """The Python strings of an Arrow array; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


Query = Callable[[SparkSession, str], DataFrame]
