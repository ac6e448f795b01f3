"""The register of queries: a name, a function of (session, folder) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: How the supplied tables play the roles of signal and features, in SQL.
STREAMS = "st AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value AS x, event_type, ts FROM events)"
FRAMES = "fr AS (SELECT label AS stream, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, vec_id, embedding::DOUBLE[] AS vec FROM embeddings)"
CELLS = FRAMES + ", ce AS (SELECT stream, t, unnest(range(len(vec))) AS i, unnest(vec) AS x FROM fr)"


def register(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals: a stream per user, samples in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("value").alias("x"), "event_type", "ts")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as feature frames: a stream per label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("stream"), (F.row_number().over(w) - 1).cast("long").alias("t"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def cells(df: DataFrame, vec: str = "vec", digits: int = 6) -> DataFrame:
    """(stream, t, i, v) of the vectors."""
    return df.select("stream", "t", F.posexplode(vec).alias("i", "v")).select("stream", "t", "i", rounded("v", digits).alias("v"))
