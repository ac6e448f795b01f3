"""Sample and frame operators: samples(stream, seq, x) and frames(stream, t, vec ARRAY<DOUBLE>).

Columns named `stream` and `t` or `seq` give the order; all work within a stream. Windows are partitioned by stream, so
parallelism is across streams; framing itself deals samples out by (stream, frame) and has no such limit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.arrays import LN_10, mean, squared_sum, total

#: Default feature parameters.
DEFAULTS = {"sample_period_100ns": 625, "frame": 400, "shift": 160, "preemphasis": 0.97, "cepstra": 12, "lifter": 22, "channels": 24, "delta": 2, "accel": 2, "sil_floor": 50.0, "escale": 1.0, "map_weight": 100.0, "cmn_update_frames": 500}
INVALID_RUN, INVALID_SAMPLES, DC_SAMPLES = 16, (0, -32767), 48_000


def by(order: str = "t") -> Window:
    return Window.partitionBy("stream").orderBy(order)


# --- samples ------------------------------------------------------------------------------------------------------
def scale_level(df: DataFrame, coef: float) -> DataFrame:
    """x becomes trunc(x * coef)."""
    y = F.col("x") * coef
    return df.withColumn("x", F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)).cast("double"))


def strip_runs(df: DataFrame, run: int = INVALID_RUN, invalid: tuple = INVALID_SAMPLES) -> DataFrame:
    """Removes samples of an invalid value where at least `run` invalid samples follow each other."""
    bad = F.col("x").isin(*invalid)
    marked = df.withColumn("_bad", bad).withColumn("_island", F.row_number().over(by("seq")) - F.row_number().over(Window.partitionBy("stream", "_bad").orderBy("seq")))
    sized = marked.withColumn("_n", F.count("*").over(Window.partitionBy("stream", "_bad", "_island")))
    return sized.where(~F.col("_bad") | (F.col("_n") < run)).drop("_bad", "_island", "_n")


def remove_dc(df: DataFrame, chunk: int, upto: int = DC_SAMPLES) -> DataFrame:
    """Subtracts the running mean of the first `upto` samples. A chunk is added to the mean before it is subtracted;
    afterwards the mean is frozen. Results are clipped to 16 bits and rounded half away from zero; what is a half is decided
    at nine digits, so that it does not depend on the order in which the mean was added up."""
    at = F.floor((F.row_number().over(by("seq")) - 1) / chunk)
    used = F.col("_k") < math.ceil(upto / chunk)
    w = by("_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_k", at).withColumn("_mean", F.sum(F.when(used, F.col("x"))).over(w) / F.count(F.when(used, F.col("x"))).over(w))
    y = F.round(F.col("x") - F.col("_mean"), 9)
    rounded = F.when(y < 0, F.ceil(y - 0.5)).otherwise(F.floor(y + 0.5))
    return out.withColumn("x", F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), rounded.cast("double")))).drop("_k", "_mean")


def strip_zero_vectors(df: DataFrame) -> DataFrame:
    """Frames whose vector is not all zero."""
    return df.where(F.exists("vec", lambda x: x != 0))


def swap_bytes(x: Column) -> Column:
    """A 16-bit sample with its two bytes exchanged."""
    u = F.pmod(x.cast("int"), F.lit(65536))
    v = F.shiftleft(u.bitwiseAND(255), 8).bitwiseOR(F.shiftright(u, 8))
    return F.when(v > 32767, v - 65536).otherwise(v)


def downsample_48_to_16(x: np.ndarray, taps: int = 96) -> np.ndarray:
    """Every third sample after a windowed-sinc low pass at a sixth of the rate."""
    n = np.arange(taps + 1) - taps / 2
    h = np.sinc(n / 3) / 3 * np.hamming(taps + 1)
    return np.clip(np.rint(np.convolve(x, h / h.sum(), "same")[::3]), -32768, 32767)


def frames(df: DataFrame, size: int = DEFAULTS["frame"], shift: int = DEFAULTS["shift"]) -> DataFrame:
    """Overlapping frames of `size` samples every `shift`; a frame that the stream does not fill is left out.

    seq counts from 0. Each sample goes to the frames that hold it, so a long stream is not gathered in one task.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / shift))
    to = F.floor(F.col("seq") / shift)
    dealt = df.where(first <= to).select("stream", F.explode(F.sequence(first.cast("long"), to.cast("long"))).alias("t"), "seq", "x")
    out = dealt.groupBy("stream", "t").agg(F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("s"))
    return out.where(F.size("s") == size).select("stream", "t", F.transform("s", lambda s: s["x"].cast("double")).alias("vec"))


# --- frames -------------------------------------------------------------------------------------------------------
def zero_mean(v: Column) -> Column:
    m = mean(v)
    return F.transform(v, lambda x: x - m)


def log_energy(v: Column) -> Column:
    return F.log(squared_sum(v))


def preemphasis(v: Column, a: float = DEFAULTS["preemphasis"]) -> Column:
    """x[i] - a x[i-1]; the first sample times 1 - a."""
    return F.transform(v, lambda x, i: F.when(i == 0, x * (1 - a)).otherwise(x - F.lit(a) * F.get(v, i - 1)))


def hamming(v: Column) -> Column:
    n = F.size(v)
    return F.transform(v, lambda x, i: x * (0.54 - 0.46 * F.cos(2 * math.pi * i / (n - 1))))


def lifter(v: Column, by_: int = DEFAULTS["lifter"]) -> Column:
    return F.transform(v, lambda x, i: x * (1 + by_ / 2 * F.sin((i + 1) * math.pi / by_)))


def dct(v: Column, n: int = DEFAULTS["cepstra"]) -> Column:
    """sqrt(2/M) sum f_j cos(pi i (j - .5) / M) for i = 1..n."""
    m = F.size(v)
    one = lambda i: F.sqrt(2.0 / m) * total(F.transform(v, lambda x, j: x * F.cos(math.pi * i * (j + 0.5) / m)))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: one(i))


def c0(v: Column) -> Column:
    return F.sqrt(2.0 / F.size(v)) * total(v)


def mel(f: Column | float):
    return 1127.0 * (F.log(1 + f / 700.0) if isinstance(f, Column) else math.log(1 + f / 700.0))


def filter_bank(channels: int = DEFAULTS["channels"], frame: int = DEFAULTS["frame"], rate: float = 16_000.0, low: float = 0.0, high: float | None = None, alpha: float = 1.0, warp_low: float = 0.0, warp_high: float | None = None) -> np.ndarray:
    """Triangular mel filters (channels x bins) over a frame's padded spectrum, optionally VTLN-warped."""
    size = 1 << (frame - 1).bit_length()
    high = high or rate / 2
    lo, hi = mel(low), mel(high)
    centres = np.array([lo + (hi - lo) * i / (channels + 1) for i in range(channels + 2)])
    if alpha != 1.0:
        hz = 700 * (np.exp(centres / 1127) - 1)
        centres = np.array([mel(vtln(f, alpha, low, high, warp_low or low, warp_high or high)) for f in hz])
    bins = np.array([mel(k * rate / size) for k in range(size // 2 + 1)])
    out = np.zeros((channels, len(bins)))
    for c in range(channels):
        a, b, d = centres[c : c + 3]
        out[c] = np.clip(np.minimum((bins - a) / (b - a), (d - bins) / (d - b)), 0, None)
    return out


def vtln(f: float, alpha: float, low: float, high: float, cut_low: float, cut_high: float) -> float:
    """Piecewise linear warp of a frequency: slope 1/alpha between the cuts, straight to the band's ends outside."""
    a, b = cut_low * 2 / (1 + 1 / alpha), cut_high * 2 / (1 + 1 / alpha)
    if b < f < high:
        return (high - b / alpha) / (high - b) * (f - b) + b / alpha
    if low < f < a:
        return (a / alpha - low) / (a - low) * (f - low) + low
    return f / alpha


def spectral_subtraction(power: Column, noise: Column, alpha: float = 2.0, floor: float = 0.5) -> Column:
    """Gain sqrt(P^2 - alpha N^2) / P of magnitudes; `floor` where the difference is negative."""
    d = power * power - F.lit(alpha) * noise * noise
    return F.when(d < 0, F.lit(floor)).otherwise(F.when(power == 0, F.lit(floor)).otherwise(F.sqrt(d) / power))


def noise_spectrum(df: DataFrame) -> DataFrame:
    """Mean magnitude of each bin over frames of magnitudes: (bin, magnitude)."""
    return df.select(F.posexplode("vec").alias("bin", "m")).groupBy("bin").agg(F.avg("m").alias("magnitude"))


def mfcc(df: DataFrame, rate: float = 16_000.0, channels: int = DEFAULTS["channels"], cepstra: int = DEFAULTS["cepstra"], log: bool = True, power: bool = False, noise: list | None = None, alpha: float = 2.0, floor: float = 0.5) -> DataFrame:
    """Per-frame pipeline on frames: zero mean, energy, pre-emphasis, Hamming, FFT, filter bank, DCT, lifter; `vec`
    becomes the cepstra followed by the energy. Batches of frames run in numpy."""

    def kernel(batches):
        bank = basis = weights = None
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(float)
            n = x.shape[1]
            if bank is None:
                bank = filter_bank(channels, n, rate)
                i, j = np.arange(1, cepstra + 1)[:, None], np.arange(channels)[None, :]
                basis = np.sqrt(2 / channels) * np.cos(np.pi * i * (j + 0.5) / channels)
                weights = 1 + DEFAULTS["lifter"] / 2 * np.sin(np.arange(1, cepstra + 1) * np.pi / DEFAULTS["lifter"])
            x -= x.mean(axis=1, keepdims=True)
            energy = np.log(np.maximum((x * x).sum(axis=1), 1e-300))
            y = x.copy()
            y[:, 1:] -= DEFAULTS["preemphasis"] * x[:, :-1]
            y[:, 0] *= 1 - DEFAULTS["preemphasis"]
            y *= np.hamming(n)
            m = np.abs(np.fft.rfft(y, 2 * (bank.shape[1] - 1), axis=1))
            if noise is not None:
                d = m * m - alpha * np.asarray(noise) ** 2
                m = np.where(d < 0, floor, np.sqrt(np.maximum(d, 0)) / np.maximum(m, 1e-300)) * m
            f = (m * m if power else m) @ bank.T
            if log:
                f = np.log(np.maximum(f, 1.0))
            c = f @ basis.T * weights
            pdf = pdf[["stream", "t"]].copy()
            pdf["vec"] = list(np.column_stack([c, energy]))
            yield pdf

    kind = df.schema["stream"].dataType.simpleString()
    return df.select("stream", "t", "vec").mapInPandas(kernel, f"stream {kind}, t long, vec array<double>")


def energy_normalize(df: DataFrame, energy: str = "energy", sil_floor: float = DEFAULTS["sil_floor"], escale: float = DEFAULTS["escale"]) -> DataFrame:
    """Clamps to the stream's maximum - sil_floor ln10/10, then 1 - (max - e) escale."""
    top = F.max(energy).over(Window.partitionBy("stream"))
    e = F.greatest(F.col(energy), top - sil_floor * LN_10 / 10)
    return df.withColumn(energy, 1 - (top - e) * escale)


def delta(df: DataFrame, value: str = "vec", out: str = "delta", reach: int = DEFAULTS["delta"]) -> DataFrame:
    """Regression sum_k k (c[t+k] - c[t-k]) / (2 sum k^2) over vectors; edges repeat the first and last frame."""
    w, ends = by(), by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    terms = []
    for k in range(1, reach + 1):
        ahead = F.coalesce(F.lead(value, k).over(w), F.last(value).over(ends))
        behind = F.coalesce(F.lag(value, k).over(w), F.first(value).over(ends))
        terms.append((k, ahead, behind))
    norm = 2 * sum(k * k for k in range(1, reach + 1))
    for k, a, b in terms:
        df = df.withColumns({f"_a{k}": a, f"_b{k}": b})
    acc = None
    for k, _, _ in terms:
        d = F.zip_with(f"_a{k}", f"_b{k}", _scaled(k))
        acc = d if acc is None else F.zip_with(acc, d, lambda x, y: x + y)
    return df.withColumn(out, F.transform(acc, lambda x: x / norm)).drop(*[f"_{s}{k}" for k, _, _ in terms for s in "ab"])


def _scaled(k: int):
    return lambda x, y: (x - y) * float(k)


def cmn(df: DataFrame, fixed_mean: list[float] | None = None) -> DataFrame:
    """Subtracts the stream's mean vector, or a fixed one. Means are aggregated by dimension before they are joined."""
    if fixed_mean is not None:
        return df.withColumn("vec", F.zip_with("vec", F.array(*map(F.lit, fixed_mean)), lambda x, m: x - m))
    return _joined(df, variance=False, base=None)


def mvn(df: DataFrame, base: int | None = None) -> DataFrame:
    """Subtracts the mean on the first `base` dimensions (all if None) and divides all by the population deviation."""
    return _joined(df, variance=True, base=base)


def _joined(df: DataFrame, variance: bool, base: int | None) -> DataFrame:
    d = df.select("stream", F.posexplode("vec").alias("i", "x")).groupBy("stream", "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = d.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_s"))
    apply = lambda x, s: F.when((F.lit(base if base is not None else 1 << 30) > s["i"]), x - s["m"]).otherwise(x)
    scaled = lambda x, s: apply(x, s) / F.when(s["s"] == 0, 1.0).otherwise(s["s"]) if variance else apply(x, s)
    return df.join(stats, "stream").withColumn("vec", F.zip_with("vec", "_s", scaled)).drop("_s")


def map_cmn(df: DataFrame, prior: list[float] | None = None, weight: float = DEFAULTS["map_weight"], value: str = "x") -> DataFrame:
    """Running mean with a prior: (sum up to t + weight prior) / (t + weight), subtracted; without prior a plain
    running mean. On a scalar column; explode vectors by dimension to use it on them."""
    w = by().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s, n = F.sum(value).over(w), F.count(value).over(w)
    m = s / n if prior is None else (s + weight * prior) / (n + weight)
    return df.withColumn(value, F.col(value) - m)


def cmn_prior_of_segments(df: DataFrame, frames_needed: int = DEFAULTS["cmn_update_frames"]) -> DataFrame:
    """Per segment (stream, segment, n, total): the mean of the newest segments, this one included, back to where at
    least frames_needed frames are held.

    With running sums a segment's reach is a range of frames: it goes back from its own last frame to the segment that
    holds the frame frames_needed before. Segments without frames take part like others. Frames are cut into bands of
    frames_needed, so that a segment meets only those near the one it looks for.
    """
    w = Window.partitionBy("stream").orderBy("segment")
    run = df.withColumn("_n", F.sum("n").over(w)).withColumn("_s", F.sum("total").over(w))
    run = run.withColumn("_before", F.col("_n") - F.col("n")).withColumn("_sum", F.col("_s") - F.col("total"))
    # the earliest segment whose frames reach beyond this place belongs to the reach
    ends = run.withColumn("_from", F.greatest(F.col("_n") - F.lit(frames_needed), F.lit(0)))
    band = lambda c: F.floor(c / F.lit(frames_needed))
    held = run.where("n > 0").select("stream", F.col("_before").alias("_b"), F.col("_n").alias("_e"), F.col("_sum").alias("_at"), F.explode(F.sequence(band(F.col("_before")), band(F.col("_n")))).alias("_band"))
    j = ends.withColumn("_band", band(F.col("_from"))).join(held, ["stream", "_band"], "left").where("_band is null or _b is null or (_b <= _from and _from < _e)")
    out = j.select("stream", "segment", (F.col("_s") - F.coalesce("_at", F.lit(0.0))).alias("_t"), (F.col("_n") - F.coalesce("_b", F.lit(0))).alias("frames"))
    return out.select("stream", "segment", (F.col("_t") / F.col("frames")).alias("prior"), "frames")


def splice(df: DataFrame, context: int) -> DataFrame:
    """vec becomes the concatenation of `context` frames around it; frames without full context are left out."""
    half = context // 2
    w = by().rowsBetween(-half, context - 1 - half)
    out = df.withColumn("_v", F.collect_list("vec").over(w))
    return out.where(F.size("_v") == context).withColumn("vec", F.flatten("_v")).drop("_v")


def select_dims(v: Column, keep: list[int]) -> Column:
    return F.filter(v, lambda _, i: i.isin(*keep))


def warp_grid(df: DataFrame, score, low: float = 0.8, high: float = 1.2, step: float = 0.02) -> DataFrame:
    """score(stream, alpha) over a grid of warps; the best alpha of each stream (ties: the smallest)."""
    n = round((high - low) / step) + 1
    grid = df.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(low + i * step, 6))).alias("alpha"))
    s = grid.withColumn("score", score(F.col("alpha")))
    return s.groupBy("stream").agg(F.max_by("alpha", F.struct("score", -F.col("alpha"))).alias("alpha"), F.max("score").alias("score"))


# --- parameter kinds ----------------------------------------------------------------------------------------------
#: Base kinds in order of their code, and the bits of the qualifiers.
KINDS = ["WAVEFORM", "LPC", "LPREFC", "LPCEPSTRA", "LPDELCEP", "IREFC", "MFCC", "FBANK", "MELSPEC", "USER", "DISCRETE"]
QUALIFIERS = {"E": 0o100, "N": 0o200, "D": 0o400, "A": 0o1000, "C": 0o2000, "Z": 0o4000, "K": 0o10000, "0": 0o20000}


def kind_code(name: str) -> int:
    base, *marks = name.upper().split("_")
    code = KINDS.index(base)
    for m in marks:
        code |= QUALIFIERS[m]
    return code


def kind_name(code: int) -> str:
    return "_".join([KINDS[code & 0o77], *[q for q, bit in QUALIFIERS.items() if code & bit]])
