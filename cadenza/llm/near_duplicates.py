"""Near duplicates by SimHash and pigeonhole blocks.

A text's fingerprint has a bit for each of 64 positions, 1 if the bit is set in over half of the hashes of its shingles
of four words. Two fingerprints at most four bits apart agree, when cut into B blocks, on at least B - 4 of them, so
joining on every choice of B - 4 blocks finds each such pair; the Hamming distance is then verified. Equal fingerprints
are one node throughout, and a bucket gives only the edges of a spanning forest, so no group of copies is expanded into
its pairs, yet every link counts for the components.

B grows with the number of distinct fingerprints so that a fingerprint meets few others by chance; each B is exact.
Buckets above BUCKET fingerprints are cut into chunks and compared chunk by chunk in separate tasks.

A null text is empty: fingerprint zero, which links like any other. A null doc_id takes part in links but is never the
smallest of a component that holds another id. Repeated rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bound_batches, discard, materialize, spread_join, texts_of

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of a bucket that one task compares with each other.
BUCKET = 4_000
#: Fingerprints that one fingerprint may meet by chance, on average, over all choices of blocks.
CHANCE = 4


def shingle_hashes(text: str) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split()  # for bytes both mean ASCII only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *[e + 1 for e in ends[: len(words) - SHINGLE]]]
    return list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[SHINGLE - 1 :])], repeat(SEED)))


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For texts with `sizes` hashes each (none empty): the bits set in over half of a text's hashes.

    Eight counters of eight bits are summed at once in a word, over at most 255 hashes at a time.
    """
    pieces = -(-sizes // 255)
    first = np.cumsum(sizes) - sizes
    starts = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    text = np.cumsum(pieces) - pieces
    out = np.zeros(len(sizes), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(k) & np.uint64(0x0101010101010101), starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), text, axis=0)
        for byte in range(8):
            out |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprint_all(texts: list[str]) -> np.ndarray:
    out, block, sizes, at = np.zeros(len(texts), np.uint64), [], [], []

    def close():
        if block:
            out[at] = _majority(np.concatenate(block), np.array(sizes))
        block.clear(), sizes.clear(), at.clear()

    for i, t in enumerate(texts):
        if h := shingle_hashes(t):
            block.append(np.array(h, np.uint64))
            sizes.append(len(h))
            at.append(i)
            if len(block) >= 512:
                close()
    close()
    return out


def fingerprints(df: DataFrame, text: str = "text", also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `also` and fp, the fingerprint's 64 bits as a long."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprint_all(texts_of(texts)).view(np.int64))

    return df.select(*also, hashed.asNondeterministic()(text).alias("fp"))


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks, 7 at least, with which chance meetings stay below CHANCE a fingerprint."""
    for b in range(distance + 3, 33):
        if comb(b, distance) * n / 2.0 ** (64 * (b - distance) // b) <= CHANCE:
            break
    return b


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks that must agree, their bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(bits, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within a bucket of distinct fingerprints (unsigned, in ascending order)."""
    left, a, b = fps, [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [np.array([root])]
        while frontier and len(left):
            part = frontier.pop()
            hit = np.zeros(len(left), bool)
            for i in range(0, len(part), 256):
                hit |= (np.bitwise_count(part[i : i + 256, None] ^ left[None, :]) <= distance).any(axis=0)
            if hit.any():
                new, left = left[hit], left[~hit]
                a.append(np.full(len(new), root))
                b.append(new)
                frontier += [new[i : i + 256] for i in range(0, len(new), 256)]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; the last bucket of a batch waits for its end."""

    def linked(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(g)]])
        size = ends - starts
        a, b = [], []
        pairs = starts[size == 2]  # nearly all buckets
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= DISTANCE
        a.append(fp[pairs[near]])
        b.append(fp[pairs[near] + 1])
        for s, e in zip(starts[size > 2], ends[size > 2]):
            x, y = forest(np.unique(fp[s:e]))
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[keep]).view(np.int64)) for x in (a, b)], names=["a", "b"])

    g0, f0 = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.concatenate([g0, batch.column("g").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([f0, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        at = int(np.searchsorted(g, g[-1]))
        if at:
            yield linked(g[:at], fp[:at])
        g0, f0 = g[at:], fp[at:]
    if len(g0):
        yield linked(g0, f0)


def links(nodes: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) between fingerprints within DISTANCE whose components are those of all links.

    nodes: distinct fp; n: their number.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(masks(blocks_for(n)))])
    blocks = nodes.select("fp", F.explode(keys).alias("key"))
    shared = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = spread_join(blocks, shared.withColumn("chunks", F.ceil(F.col("n") / BUCKET).cast("int")), "key", n * len(masks(blocks_for(n))))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = met.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    grouped = met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp")
    return grouped.repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_edges, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge has: root is the smallest node of its component.

    Large-star and small-star rounds in turn; each round is written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, larger_only: bool, total: int) -> DataFrame:
        both = e if larger_only else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # small-star looks from each node to its smaller neighbours only
        side = both.select(F.col("b").alias("u"), F.col("a").alias("v")) if larger_only else both.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = side.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        found = spread_join(side, least, "u", total)  # a component's root has all the others as neighbours
        if larger_only:
            out = found.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        else:
            out = found.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return out.where("a < b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before, old = None, []
    while (found := state(now)) != before and found[0]:
        before = found
        old.append(now._cadenza_path)
        now = materialize(star(star(now, False, 2 * found[0]), True, found[0]), "edges")
        if len(old) > 1:
            discard(spark, old.pop(0))
    for path in old:
        if path != now._cadenza_path:
            discard(spark, path)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _rooted(df: DataFrame, text: str = "text", also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `also`, fp, root (the component's smallest fingerprint) and component_id of each row."""
    rows = materialize(fingerprints(df, text, also), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    size = nodes.agg(F.count("*").alias("nodes"), F.sum("n").alias("rows")).first()
    found = components(links(nodes.select("fp"), size["nodes"]))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.col("n").alias("copies"), F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    of = spread_join(rooted, least, "root", size["nodes"]).select("fp", "root", "component_id", F.col("copies").alias("n"))
    return spread_join(rows, of, "fp", size["rows"] or 0)  # all copies of a text, and all empty texts, have one fingerprint


def near_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id within reach) of each row."""
    return _rooted(df, text).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest doc_id, and of several rows
    with that id in the group (or all without an id) the one of the smallest text digest. Rows that share an id, or have
    none, and are no near duplicates are different documents."""
    digest = F.md5(F.col("text").cast("binary"))
    keyed = df.select("doc_id", "text", digest.alias("_t"))
    texts = _rooted(keyed, "text", ("doc_id", "_t")).groupBy("doc_id", "root", "component_id", "_t").agg(F.count("*").alias("n"))
    texts = materialize(texts, "texts")
    is_own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    own = texts.where(is_own)
    first = own.groupBy("root").agg(F.min(F.struct("_t", "n")).alias("m")).select("root", F.col("m._t").alias("_least"))
    marked = own.join(first, "root").select("doc_id", "_t", F.col("_t").eqNullSafe(F.col("_least")).alias("stays"), "n")
    marked = marked.unionByName(texts.where(~is_own).select("doc_id", "_t", F.lit(False).alias("stays"), "n"))
    found = materialize(marked.where("not stays or n > 1"), "copies")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.md5(F.col("d.text").cast("binary")).eqNullSafe(F.col("g._t"))
    out = df.alias("d").join(found.alias("g").hint("shuffle_hash"), same, "left_anti")
    twice = found.where("stays")
    if not twice.isEmpty():
        rows = df.alias("d").join(twice.alias("g"), same, "left_semi")
        # equal in id and text; of rows that differ in another column any one
        one = rows.groupBy("doc_id", digest.alias("_t")).agg(F.first(F.struct(*df.columns)).alias("r"))
        out = out.unionByName(one.select("r.*"))
    return out
