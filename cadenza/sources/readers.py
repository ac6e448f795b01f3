"""Readers of model, signal and feature formats. Text formats are parsed by expressions over lines; binary files come
through Spark's binaryFile source, one file a row, and are parsed in Arrow batches on the executors."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


# --- audio --------------------------------------------------------------------------------------------------------
def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of a 16-bit mono PCM file, whatever chunks it has."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + n]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if form != 1 or channels != 1 or bits != 16:
                raise ValueError(f"16-bit mono PCM is needed, not format {form}, {channels} channels, {bits} bits")
        elif kind == b"data":
            if rate is None:
                raise ValueError("data before format")
            return rate, np.frombuffer(body[: len(body) // 2 * 2], "<i2")
        at += 8 + n + n % 2
    raise ValueError("no data")


def parse_raw(data: bytes) -> np.ndarray:
    """Headerless big-endian 16-bit samples."""
    return np.frombuffer(data[: len(data) // 2 * 2], ">i2").astype(np.int16)


def read_audio(spark: SparkSession, path: str, kind: str = "wav", raw_rate: int = 16_000) -> DataFrame:
    """(stream, rate, seq, x): the samples of every file; a file is a stream. Files that cannot be read are left out
    with read_audio_errors() telling why."""

    def kernel(batches):
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"]):
                try:
                    rate, x = parse_wav(content) if kind == "wav" else (raw_rate, parse_raw(content))
                except ValueError:
                    continue
                for i in range(0, len(x), 1 << 18):
                    part = x[i : i + (1 << 18)]
                    yield pd.DataFrame({"stream": path_, "rate": rate, "seq": np.arange(i, i + len(part)), "x": part.astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(kernel, "stream string, rate int, seq long, x double")


def read_audio_errors(spark: SparkSession, path: str) -> DataFrame:
    def kernel(batches):
        for pdf in batches:
            rows = []
            for path_, content in zip(pdf["path"], pdf["content"]):
                try:
                    parse_wav(content)
                except ValueError as x:
                    rows.append((path_, str(x)))
            yield pd.DataFrame(rows, columns=["stream", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(kernel, "stream string, error string")


# --- features -----------------------------------------------------------------------------------------------------
def parse_parameters(data: bytes) -> tuple[int, int, np.ndarray]:
    """Frame shift (100 ns), kind and vectors of a parameter file; byte order is tried both ways, compressed files (_C)
    are expanded, a checksum (_K) is left off."""
    for order in (">", "<"):
        n, shift, size, kind = struct.unpack(order + "IIhH", data[:12])
        if 0 < size < 4096 and 0 < shift < 10_000_000 and n < 10**8 and 12 + n * size <= len(data) + 8 * (kind & 0o2000 > 0) * size:
            break
    else:
        raise ValueError("no parameter header")
    body = data[12:]
    if kind & 0o2000:
        dim = size // 2
        a = np.frombuffer(body[: 4 * dim], order + "f4")
        b = np.frombuffer(body[4 * dim : 8 * dim], order + "f4")
        frames = n - 4
        c = np.frombuffer(body[8 * dim : 8 * dim + frames * size], order + "i2").reshape(frames, dim)
        return shift, kind, (c + b) / a
    return shift, kind, np.frombuffer(body[: n * size], order + "f4").reshape(n, size // 4)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(stream, t, shift, kind, vec) of parameter files."""

    def kernel(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                shift, kind, v = parse_parameters(content)
                yield pd.DataFrame({"stream": p, "t": np.arange(len(v)), "shift": shift, "kind": kind, "vec": list(v.astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(kernel, "stream string, t long, shift int, kind int, vec array<double>")


def parse_vector_stream(data: bytes) -> tuple[dict, list[tuple[int, int, np.ndarray]]]:
    """Header and (segment, t, vector) of a vector stream: messages with a length first; an empty one ends a segment, a
    negative length the stream."""
    length, shift, direct = struct.unpack("<iiB", data[:9])
    at, segment, t, out = 9, 0, 0, []
    while at + 4 <= len(data):
        (n,) = struct.unpack("<i", data[at : at + 4])
        at += 4
        if n < 0:
            break
        if n == 0:
            segment, t = segment + 1, 0
            continue
        out.append((segment, t, np.frombuffer(data[at : at + n], "<f4")))
        at += n
        t += 1
    return {"length": length, "shift": shift, "is_outprob": bool(direct)}, out


def read_npy(data: bytes) -> np.ndarray:
    """Little-endian float32 weights of a .npy file."""
    import io

    a = np.load(io.BytesIO(data), allow_pickle=False)
    if a.dtype != np.dtype("<f4"):
        raise ValueError(f"<f4 is needed, not {a.dtype.str}")
    return a


def read_spectrum(data: bytes) -> np.ndarray:
    """A noise spectrum: a big-endian count, then so many float32 magnitudes."""
    (n,) = struct.unpack(">i", data[:4])
    return np.frombuffer(data[4 : 4 + 4 * n], ">f4").astype(float)


def read_cmn(text: str) -> dict[str, list[float]]:
    """Means and variances of a CEPSNORM file."""
    out, name, left = {}, None, 0
    for token in text.replace(">", "> ").split():
        if token.startswith("<"):
            name = token.strip("<>").lower() if token.strip("<>") in ("MEAN", "VARIANCE") else None
            left = -1
        elif name and left == -1:
            left, out[name] = int(token), []
        elif name and left > 0:
            out[name].append(float(token))
            left -= 1
    return out


# --- language models, dictionaries, grammars ----------------------------------------------------------------------
def read_arpa(spark: SparkSession, path: str, reverse: bool = False) -> list[DataFrame]:
    """One table per order: w1..wn, logp, bow. Lines get their section from the last header before them, per file; the
    part files of one folder, in order of their names, are one text. In reverse models the words of an entry are turned
    round, and <s> takes the value of </s> where it has -99.

    Files are read in splits, line by line. A line's place is its file, where its split begins and how many lines are before it
    there, so only the headers, a few lines a file, are put in order; the others look up the section that holds their place."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(place.alias("at"), F.col("value").alias("line"))
    lines = lines.withColumn("text", F.regexp_replace("at.file", r"/part-\d{5}[^/]*$", "/"))
    order = F.regexp_extract("line", r"^\\(\d+)-grams:", 1)
    k = F.when(order != "", order).otherwise("0").cast("int")
    until = F.lead("at").over(Window.partitionBy("text").orderBy("at"))
    sections = lines.where(F.startswith("line", F.lit("\\"))).select("text", k.alias("k"), F.col("at").alias("since"), until.alias("until")).where("k > 0")
    inside = (F.col("l.text") == F.col("s.text")) & (F.col("at") > F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    marked = lines.alias("l").join(F.broadcast(sections.alias("s")), inside).select("line", "k")
    body = marked.withColumn("f", F.split(F.trim("line"), r"\s+")).where(F.size("f") > F.col("k")).select("k", "f")
    orders = sorted(r.k for r in sections.select("k").distinct().collect())
    out = []
    for k in orders:
        words = [F.get("f", F.lit(i)).alias(f"w{(k - i + 1) if reverse else i}") for i in range(1, k + 1)]
        out.append(body.where(F.col("k") == k).select(*words, F.get("f", F.lit(0)).cast("double").alias("logp"), F.get("f", F.lit(k + 1)).cast("double").alias("bow")))
    if reverse and out:
        from cadenza.operators.ngram import repair_unigrams

        out[0] = repair_unigrams(out[0])
    return out


#: Fixed value: `name [@class prob] [output] or {output} [:weight] phones`.
_ENTRY = r"^\s*(\S+)\s+(?:@(\S+)\s+)?(?:\[([^\]]*)\]|\{([^}]*)\})?\s*(?::(\S+)\s+)?(.*?)\s*$"


def parse_dictionary(lines: DataFrame, column: str = "value") -> DataFrame:
    """(wname, woutput, phones, cprob, transparent, weight) of dictionary lines; without an output the name is it."""
    part = lambda i: F.regexp_extract(column, _ENTRY, i)
    transparent = F.regexp_like(F.col(column), F.lit(r"^\s*\S+\s+(?:@\S+\s+)?\{"))
    bracket = F.regexp_like(F.col(column), F.lit(r"^\s*\S+\s+(?:@\S+\s+)?[\[{]"))
    out = F.when(bracket, F.when(transparent, part(4)).otherwise(part(3))).otherwise(part(1))
    number = lambda c: F.when(c != "", c).try_cast("double")
    return lines.where(F.trim(column) != "").select(
        part(1).alias("wname"), out.alias("woutput"), F.split(part(6), r"\s+").alias("phones"),
        F.coalesce(number(part(2)), F.lit(0.0)).alias("cprob"), transparent.alias("transparent"), F.coalesce(number(part(5)), F.lit(1.0)).alias("weight"),
    )


def with_ids(words: DataFrame, order: str = "wname") -> DataFrame:
    """wid from 0 in the order of a column."""
    w = Window.orderBy(order, "woutput", F.array_join("phones", " "))
    return words.withColumn("wid", F.row_number().over(w) - 1)


def parse_word_list(lines: DataFrame, head: str = "silB", tail: str = "silE", column: str = "value") -> DataFrame:
    """Isolated words: the dictionary line with silence before and behind."""
    return parse_dictionary(lines, column).withColumn("phones", F.concat(F.array(F.lit(head)), "phones", F.array(F.lit(tail))))


def parse_dfa_lines(lines: DataFrame, keep_zero_arcs: bool = True, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """arcs(src, label, dst) and states(id, accept) of automaton lines."""
    f = lines.select(F.split(F.trim(F.regexp_replace(column, "#.*$", "")), r"\s+").alias("f")).where(F.size("f") >= 3)
    n = f.select(F.get("f", F.lit(0)).cast("int").alias("src"), F.get("f", F.lit(1)).cast("int").alias("label"), F.get("f", F.lit(2)).cast("int").alias("dst"), F.conv(F.coalesce(F.get("f", F.lit(3)), F.lit("0")), 16, 10).cast("long").alias("status"))
    keep = ((F.col("label") >= 0) & (F.col("dst") >= 0)) if keep_zero_arcs else ((F.col("label") > 0) | (F.col("dst") > 0))
    arcs = n.where(keep & (F.col("label") >= 0) & (F.col("dst") >= 0)).select("src", "label", "dst")
    states = n.select(F.col("src").alias("id"), (F.col("status").bitwiseAND(1) == 1).alias("accept")).unionByName(arcs.select(F.col("dst").alias("id"), F.lit(False).alias("accept")))
    return arcs, states.groupBy("id").agg(F.max("accept").alias("accept"))


def parse_hmm_definitions(text: str) -> dict[str, list]:
    """Models, states, mixtures, Gaussians and transitions of HTK text definitions: rows for tables.

    ~t, ~v, ~u (mean), ~m (density) and ~s macros are resolved; stream weights (~w) and regression trees (~r) are read
    over.
    """
    import re

    tokens = re.findall(r'"[^"]*"|<[^>]*>|~\w|[^\s<>"~]+', text)
    at = [0]
    macro: dict[tuple[str, str], object] = {}
    out: dict[str, list] = {"models": [], "states": [], "mix": [], "gauss": [], "trans": []}

    def peek() -> str:
        return tokens[at[0]] if at[0] < len(tokens) else ""

    def take() -> str:
        at[0] += 1
        return tokens[at[0] - 1]

    def tag() -> str:
        return peek().strip("<>").upper() if peek().startswith("<") else ""

    def numbers(n: int) -> list[float]:
        return [float(take()) for _ in range(n)]

    def vector(kind: str, name: str) -> list[float]:
        if peek() == kind:
            take()
            return macro[kind, take().strip('"')]
        take()
        return numbers(int(take()))

    def density() -> int:
        if peek() == "~m":
            take()
            return macro["~m", take().strip('"')]
        mean = vector("~u", "MEAN")
        var = vector("~v", "VARIANCE")
        gconst = None
        if tag() == "GCONST":
            take()
            gconst = float(take())
        out["gauss"].append((len(out["gauss"]), mean, [1 / v for v in var], gconst if gconst is not None else float(len(var) * np.log(2 * np.pi) + np.sum(np.log(var)))))
        return len(out["gauss"]) - 1

    def state() -> int:
        if peek() == "~s":
            take()
            return macro["~s", take().strip('"')]
        number = len(out["states"])
        out["states"].append(number)
        count, stream, k, w = 1, 1, 1, 1.0
        if tag() == "NUMMIXES":
            take()
            count = int(take())
        while True:
            if tag() == "STREAM":
                take()
                stream = int(take())
            elif tag() == "SWEIGHTS":
                take()
                numbers(int(take()))
            elif tag() == "NUMMIXES":
                take()
                count = int(take())
            elif tag() == "MIXTURE":
                take()
                k, w = int(take()), float(take())
                out["mix"].append((number, stream, k, density(), float(np.log(w))))
            elif tag() == "MEAN" or peek() in ("~u", "~m") and count == 1:
                out["mix"].append((number, stream, 1, density(), 0.0))
            else:
                return number

    def matrix() -> list[list[float]]:
        if peek() == "~t":
            take()
            return macro["~t", take().strip('"')]
        take()
        n = int(take())
        return [numbers(n) for _ in range(n)]

    while at[0] < len(tokens):
        kind = take()
        if kind == "~o" or not kind.startswith("~"):
            continue
        name = take().strip('"')
        if kind == "~t":
            macro[kind, name] = matrix()
        elif kind in ("~u", "~v"):
            take()
            macro[kind, name] = numbers(int(take()))
        elif kind == "~m":
            macro[kind, name] = density()
        elif kind == "~s":
            macro[kind, name] = state()
        elif kind == "~h":
            states = {}
            while tag() != "ENDHMM":
                if tag() == "STATE":
                    take()
                    i = int(take())
                    states[i] = state()
                elif tag() == "TRANSP" or peek() == "~t":
                    m = matrix()
                    out["trans"] += [(name, i, j, float(np.log10(p))) for i, r in enumerate(m) for j, p in enumerate(r) if p > 0]
                else:
                    take()
            take()
            out["models"] += [(name, i, s) for i, s in sorted(states.items())]
    return out


def parse_model_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, model) of lines `logical [physical]`."""
    f = F.split(F.trim(column), r"\s+")
    return lines.where(F.trim(column) != "").select(F.get(f, F.lit(0)).alias("name"), F.coalesce(F.get(f, F.lit(1)), F.get(f, F.lit(0))).alias("model"))


# --- streams as a data source -------------------------------------------------------------------------------------
class SampleBlocks(DataSource):
    """format("sample_blocks"): a deterministic signal for tests and demonstrations; options streams, samples, block,
    rate. Blocks of a stream are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "sample_blocks"

    def schema(self) -> str:
        return "stream int, seq long, x double"

    def reader(self, schema) -> DataSourceReader:
        return _Blocks(self.options)

    def streamReader(self, schema):
        return _LiveBlocks(self.options)


class _Block(InputPartition):
    def __init__(self, stream: int, first: int, last: int):
        super().__init__((stream, first, last))


class _Blocks(DataSourceReader):
    def __init__(self, options: dict):
        self.streams, self.samples = int(options.get("streams", 2)), int(options.get("samples", 16_000))
        self.block, self.rate = int(options.get("block", 4_000)), float(options.get("rate", 16_000))

    def partitions(self):
        return [_Block(s, a, min(a + self.block, self.samples)) for s in range(self.streams) for a in range(0, self.samples, self.block)]

    def read(self, partition):
        stream, a, b = partition.value
        n = np.arange(a, b)
        x = np.rint(3000 * np.sin(2 * np.pi * (200 + 50 * stream) * n / self.rate) * (n // self.block % 2 == 0))
        yield from zip([stream] * len(n), n.tolist(), x.tolist())


class _LiveBlocks(DataSourceStreamReader):
    """The same signal as a stream: each batch brings the next block of every stream; offsets count blocks."""

    def __init__(self, options: dict):
        self.blocks = _Blocks(options)
        self.total = -(-self.blocks.samples // self.blocks.block)
        self.at = 0

    def initialOffset(self) -> dict:
        return {"block": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + 1, self.total)
        return {"block": self.at}

    def partitions(self, start: dict, end: dict):
        b = self.blocks
        return [_Block(s, k * b.block, min((k + 1) * b.block, b.samples)) for s in range(b.streams) for k in range(start["block"], end["block"])]

    def read(self, partition):
        return self.blocks.read(partition)

    def commit(self, end: dict) -> None:
        pass


def open_source(spark: SparkSession, kind: str, path: str | None = None, **options) -> DataFrame:
    """One entrance to all batch sources: wav, raw, parameters, table, sample_blocks."""
    if kind in ("wav", "raw"):
        return read_audio(spark, path, kind, **options)
    if kind == "parameters":
        return read_parameters(spark, path)
    if kind == "sample_blocks":
        spark.dataSource.register(SampleBlocks)
        return spark.read.format("sample_blocks").options(**options).load()
    if kind == "table":
        return spark.read.parquet(path)
    raise ValueError(f"no source {kind!r}")
