"""Writers of results and models; text is made by expressions, files by Spark's own writers."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def nbest_lines(nbest: DataFrame) -> DataFrame:
    """(stream, rank, line): sentence, word sequence, confidences and score lines of each sentence with columns words,
    phones (array of strings), cms, score."""
    n = F.col("rank").cast("string")
    lines = F.array(
        F.concat(F.lit("sentence"), n, F.lit(": "), F.array_join("words", " ")), F.concat(F.lit("wseq"), n, F.lit(": "), F.array_join("words", " ")),
        F.concat(F.lit("phseq"), n, F.lit(": "), F.array_join("phones", " | ")), F.concat(F.lit("cmscore"), n, F.lit(": "), F.array_join(F.transform("cms", lambda c: F.format_number(c, 3)), " ")),
        F.concat(F.lit("score"), n, F.lit(": "), F.format_string("%.6f", F.col("score").cast("double"))),
    )
    return nbest.select("stream", "rank", F.posexplode(lines).alias("k", "line")).select("stream", "rank", "k", "line")


def recognition_xml(nbest: DataFrame, attributes: tuple[str, ...] = ("word", "phone", "cm")) -> DataFrame:
    """(stream, xml): one message per stream with its sentences; attributes of words are chosen by name."""

    def word(w: Column, p: Column, c: Column) -> Column:
        parts = [F.lit("<WHYPO")]
        if "word" in attributes:
            parts.append(F.concat(F.lit(' WORD="'), escape_xml(w), F.lit('"')))
        if "phone" in attributes:
            parts.append(F.concat(F.lit(' PHONE="'), escape_xml(p), F.lit('"')))
        if "cm" in attributes:
            parts.append(F.concat(F.lit(' CM="'), F.format_string("%.3f", c), F.lit('"')))
        return F.concat(*parts, F.lit("/>"))

    rows = F.zip_with(F.arrays_zip("words", "phones", "cms"), F.col("words"), lambda z, _: word(z["words"], z["phones"], z["cms"]))
    sentence = F.concat(F.format_string('<SHYPO RANK="%d" SCORE="%.6f">', F.col("rank").cast("int"), F.col("score").cast("double")), F.array_join(rows, ""), F.lit("</SHYPO>"))
    s = nbest.withColumn("_s", sentence).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("rank", "_s"))).alias("l"))
    return s.select("stream", F.concat(F.lit("<RECOGOUT>"), F.array_join(F.transform("l", lambda x: x["_s"]), ""), F.lit("</RECOGOUT>")).alias("xml"))


def status_xml(df: DataFrame, status: str = "status") -> DataFrame:
    """(stream, xml): <INPUT STATUS=…>, <REJECTED REASON=…> or <RECOGFAIL/>."""
    c = F.col(status)
    return df.select("stream", F.when(c == "failed", "<RECOGFAIL/>").when(F.startswith(c, F.lit("too_")), F.concat(F.lit('<REJECTED REASON="'), escape_xml(c), F.lit('"/>'))).otherwise(F.concat(F.lit('<INPUT STATUS="'), escape_xml(c), F.lit('"/>'))).alias("xml"))


def graph_lines(nodes: DataFrame) -> DataFrame:
    """(stream, id, line) of lattice nodes."""
    return nodes.select("stream", "id", F.format_string("%d: [%d..%d] wid=%d amavg=%.6f cm=%.6f", F.col("id").cast("int"), F.col("left_t").cast("int"), F.col("right_t").cast("int"), F.col("wid").cast("int"), "amavg", "cm").alias("line"))


def network_lines(slots: DataFrame) -> DataFrame:
    """(stream, slot, line) of a confusion network; the empty word is -."""
    item = F.format_string("(%s:%.3f)", F.coalesce(F.col("wid").cast("string"), F.lit("-")), "pp")
    g = slots.withColumn("_i", item).groupBy("stream", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "_i"))).alias("l"))
    return g.select("stream", "slot", F.array_join(F.transform("l", lambda x: x["_i"]), " ").alias("line"))


def write_by_stream(lines: DataFrame, path: str) -> None:
    """Text files in a folder per stream."""
    lines.select("stream", F.col("line").alias("value")).write.partitionBy("stream").mode("overwrite").text(path)


def arpa_lines(tables: list[DataFrame]) -> DataFrame:
    """(section, line) of a language model in its text form; sections sort as the file does."""
    spark = tables[0].sparkSession
    counts = [t.count() for t in tables]
    head = [(0, "\\data\\")] + [(0, f"ngram {k}={n}") for k, n in enumerate(counts, 1)]
    out = spark.createDataFrame([(s, i, l) for i, (s, l) in enumerate(head)], "section int, n long, line string")
    for k, t in enumerate(tables, 1):
        bow = F.when(F.col("bow").isNull(), "").otherwise(F.format_string("\t%.6f", "bow")) if "bow" in t.columns else F.lit("")
        words = F.concat_ws(" ", *[f"w{i}" for i in range(1, k + 1)])
        body = t.select(F.lit(k).alias("section"), F.lit(1).cast("long").alias("n"), F.concat(F.format_string("%.6f\t", "logp"), words, bow).alias("line"))
        out = out.unionByName(spark.createDataFrame([(k, 0, f"\\{k}-grams:")], out.schema)).unionByName(body)
    return out.unionByName(spark.createDataFrame([(len(tables) + 1, 0, "\\end\\")], out.schema))


def write_arpa(tables: list[DataFrame], path: str, parts: int | None = None) -> None:
    """The text form in part files: one after the other, in order of their names, they are the file. No task has all lines;
    parts=1 makes a single file."""
    lines = arpa_lines(tables)
    dealt = lines.repartitionByRange(*([parts] if parts else []), "section", "n", "line")
    dealt.sortWithinPartitions("section", "n", "line").select("line").write.mode("overwrite").text(path)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    body = np.asarray(samples, "<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body)) + body


def recordings(samples: DataFrame, rate: int) -> DataFrame:
    """(stream, segment, wav BINARY) of the samples of each segment (bounded by the cut of long segments)."""
    import pandas as pd

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pd.DataFrame({"stream": [pdf["stream"].iloc[0]], "segment": [pdf["segment"].iloc[0]], "wav": [wav_bytes(pdf["x"].to_numpy(), rate)]})

    kinds = {k: samples.schema[k].dataType.simpleString() for k in ("stream", "segment")}
    return samples.select("stream", "segment", "seq", "x").groupBy("stream", "segment").applyInPandas(kernel, f"stream {kinds['stream']}, segment {kinds['segment']}, wav binary")


def parameter_bytes(vectors: np.ndarray, shift: int, kind: int) -> bytes:
    """A parameter file, big-endian."""
    v = np.asarray(vectors, ">f4")
    return struct.pack(">IIhH", len(v), shift, 4 * v.shape[1], kind) + v.tobytes()


def vector_stream_bytes(segments: list[np.ndarray], shift: int, is_outprob: bool = False) -> bytes:
    """A vector stream with its header; segments end with an empty message, the stream with -1."""
    out = [struct.pack("<iiB", segments[0].shape[1], shift, is_outprob)]
    for s in segments:
        out += [struct.pack("<i", 4 * s.shape[1]) + np.asarray(v, "<f4").tobytes() for v in s]
        out.append(struct.pack("<i", 0))
    return b"".join([*out, struct.pack("<i", -1)])


def cmn_text(mean: list[float], variance: list[float] | None = None) -> str:
    out = f"<CEPSNORM>\n<MEAN> {len(mean)}\n" + " ".join(f"{x:.6e}" for x in mean) + "\n"
    return out + (f"<VARIANCE> {len(variance)}\n" + " ".join(f"{x:.6e}" for x in variance) + "\n" if variance else "")


def convert_charset(c: Column, to: str) -> Column:
    """The bytes of a string in another character set."""
    return F.encode(c, to)


def serve(df: DataFrame, send) -> None:
    """Hands each partition's rows to send(rows): the hook for sockets and queues, also for foreachBatch."""
    df.foreachPartition(send)
