"""Event detection, segmentation and rejection over ordered streams.

State that only depends on a bounded past or on runs is written with windows; what is truly sequential runs as a fold
over a stream's ordered array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.signal import by

#: Defaults of the triggers.
LEVEL, ZERO_CROSS_PER_S, HEAD_MS, TAIL_MS = 2000, 60, 300, 400
SMOOTH, VOICED, VAD_UP, VAD_DOWN, VAD_RING = 5, 0.5, 0.7, -0.2, 20
CM_ALPHA, MIN_POWER, MAX_SAMPLES = 0.05, 9.0, 320_000


def zero_cross_marks(df: DataFrame, level: float = LEVEL) -> DataFrame:
    """Adds mark: 1 where the sign changes and some sample since, and including, the last counted crossing was above the
    level, else 0. Positive means x > 0."""
    rows = df.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("s"))
    start = F.struct(F.lit(False).alias("armed"), F.lit(0).alias("sign"), F.array().cast("array<struct<seq:bigint,x:double,mark:int>>").alias("out"))

    def step(acc, s):
        sign = F.when(s["x"] > 0, 1).otherwise(-1)
        loud = F.abs(s["x"]) > level
        crossed = (acc["sign"] != 0) & (sign != acc["sign"]) & acc["armed"]
        armed = F.when(crossed, loud).otherwise(acc["armed"] | loud)
        row = F.struct(s["seq"].cast("bigint").alias("seq"), s["x"].cast("double").alias("x"), crossed.cast("int").alias("mark"))
        return F.struct(armed.alias("armed"), sign.alias("sign"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = rows.select("stream", F.aggregate("s", start, step)["out"].alias("s"))
    return folded.select("stream", F.inline("s"))


def zero_cross_count(df: DataFrame, length: int, level: float = LEVEL) -> DataFrame:
    """zc: crossings among the last `length` samples."""
    w = by("seq").rowsBetween(1 - length, Window.currentRow)
    return zero_cross_marks(df, level).withColumn("zc", F.sum("mark").over(w))


def endpoints(chunks: DataFrame, tail_chunks: int, head_chunks: int = 0) -> DataFrame:
    """Segments of chunks(stream, chunk, active): active chunks no more than tail_chunks idle chunks apart are one
    segment; it is extended by the tail, and by the head where no earlier segment lies. Overlaps are merged."""
    hot = chunks.where("active").withColumn("_gap", F.col("chunk") - F.lag("chunk").over(by("chunk")))
    new = F.when(F.col("_gap").isNull() | (F.col("_gap") - 1 > tail_chunks), 1).otherwise(0)
    ids = hot.withColumn("segment", F.sum(new).over(by("chunk")))
    seg = ids.groupBy("stream", "segment").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"), F.count("*").alias("active"))
    last = chunks.groupBy("stream").agg(F.max("chunk").alias("_end"), F.min("chunk").alias("_start"))
    out = seg.join(last, "stream")
    before = F.lag("last").over(by("segment"))
    first = F.greatest(F.col("first") - head_chunks, F.col("_start"), F.coalesce(before + 1, F.col("_start")))
    return out.select("stream", "segment", first.alias("first_chunk"), F.least(F.col("last") + tail_chunks, F.col("_end")).alias("last_chunk"), "active")


def smooth_decisions(df: DataFrame, decision: str = "voiced", n: int = SMOOTH, least: float = VOICED) -> DataFrame:
    """trigger: the mean of the last n decisions (0 or 1) is at least `least`."""
    return df.withColumn("trigger", F.avg(F.col(decision).cast("double")).over(by().rowsBetween(1 - n, Window.currentRow)) >= least)


def model_totals(scores: DataFrame) -> DataFrame:
    """Per-frame model scores (stream, t, model, score) summed per stream and model."""
    return scores.groupBy("stream", "model").agg(F.sum("score").alias("score"), F.count("*").alias("frames"))


def decide_model(totals: DataFrame, reject: str = "", alpha: float = CM_ALPHA) -> DataFrame:
    """Best model of each stream (ties: the name that sorts first), confidence 1 / sum 10^(alpha (s - max)), and
    accepted: a model is noise if its name is a part of the reject string."""
    top = F.max("score").over(Window.partitionBy("stream"))
    parts = totals.withColumn("_e", F.pow(F.lit(10.0), alpha * (F.col("score") - top)))
    best = parts.groupBy("stream").agg(F.min_by("model", F.struct(-F.col("score"), "model")).alias("model"), F.max("score").alias("score"), (1 / F.sum("_e")).alias("confidence"))
    return best.withColumn("accepted", ~F.contains(F.lit(reject), F.col("model")))


def hysteresis(df: DataFrame, score: str = "score", up: float = VAD_UP, down: float = VAD_DOWN, ring: int = VAD_RING) -> DataFrame:
    """state: up once the mean score of the last `ring` frames is at least `up`, down once it is at most `down`; no
    decision before the ring is full, down at the start."""
    w = by().rowsBetween(1 - ring, Window.currentRow)
    m = F.when(F.count("*").over(w) == ring, F.avg(score).over(w))
    marks = df.withColumn("ring_mean", m).withColumn("_mark", F.when(F.col("ring_mean") >= up, 1).when(F.col("ring_mean") <= down, 0))
    hold = F.last("_mark", ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marks.withColumn("state", F.coalesce(hold, F.lit(0))).drop("_mark")


def pause_segments(df: DataFrame, pause: str, least: int) -> DataFrame:
    """Cuts a stream of best units per frame (stream, t, unit) where the pause lasts at least `least` frames: (stream,
    segment, first_t, last_t, frames, last_unit), pauses of that length left out; last_unit is the context that the next
    segment starts from."""
    quiet = F.col("unit") == pause
    runs = df.withColumn("_q", quiet).withColumn("_run", F.row_number().over(by()) - F.row_number().over(Window.partitionBy("stream", "_q").orderBy("t")))
    sized = runs.withColumn("_n", F.count("*").over(Window.partitionBy("stream", "_q", "_run")))
    cut = F.col("_q") & (F.col("_n") >= least)
    starts = F.when(~cut & F.coalesce(F.lag(cut).over(by()), F.lit(True)), 1).otherwise(0)
    marked = sized.withColumn("segment", F.sum(starts).over(by())).where(~cut)
    return marked.groupBy("stream", "segment").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("frames"), F.max_by(F.when(~F.col("_q"), F.col("unit")), F.when(~F.col("_q"), F.col("t"))).alias("last_unit"))


def reject_by_length(segments: DataFrame, frames: str = "frames", shift_ms: float = 10.0, least_ms: float = 0, most_ms: float | None = None) -> DataFrame:
    """status: too_short, too_long or accepted by duration."""
    ms = F.col(frames) * shift_ms
    long_ = (ms > most_ms) if most_ms is not None else F.lit(False)
    return segments.withColumn("status", F.when(ms < least_ms, "too_short").when(long_, "too_long").otherwise("accepted"))


def reject_by_power(df: DataFrame, power: str = "power", least: float = MIN_POWER) -> DataFrame:
    """Streams whose mean power is at least `least`."""
    return df.groupBy("stream").agg(F.avg(power).alias("mean_power"), F.count("*").alias("frames")).where(F.col("mean_power") >= least)


def force_cut(df: DataFrame, most: int = MAX_SAMPLES) -> DataFrame:
    """Pieces of at most `most` samples of a segment (stream, segment, seq)."""
    at = F.row_number().over(Window.partitionBy("stream", "segment").orderBy("seq")) - 1
    return df.withColumn("piece", F.floor(at / most))


def rewind(df: DataFrame, segments: DataFrame, margin: int) -> DataFrame:
    """Frames of each segment together with up to `margin` frames before it, which are processed again."""
    same = (F.col("f.stream") == F.col("s.stream")) & F.col("f.t").between(F.col("s.first_t") - margin, F.col("s.last_t"))
    return df.alias("f").join(segments.alias("s"), same).select("f.*", "s.segment", (F.col("f.t") < F.col("s.first_t")).alias("rewound"))
