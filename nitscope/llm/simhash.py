"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, connected components.

A fingerprint has 64 bits in four blocks of 16. Two fingerprints that differ in at most two bits agree in at least two
whole blocks, so each fingerprint is filed under its six pairs of blocks and only fingerprints that share a filing are
compared. Equal fingerprints are one vertex, so copies never form pairs. A filing with more than `BUCKET` different
fingerprints is not paired either: there every fingerprint also stands under its own value and under each value one
bit away in the other two blocks. Two fingerprints meet under such a value exactly if they differ in at most two bits,
and all that meet are linked to the smallest, so the work is linear in the size of the filing and no link is lost.

Defined cases: null or empty text has fingerprint 0 and is linked like any other; a null doc_id stays a row of its own
group but never gives a component its name unless no other id is there; repeated rows come back as often as they came;
a very long text is hashed `CHUNK` shingles at a time; other columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitscope.runtime import materialize, release, unused

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 2
BLOCK_BITS, BLOCKS = 16, 4
BUCKET = 64
HOT_SHARE = 0.001
#: Most shingles whose bits are counted at once: bounds the memory for very long texts.
CHUNK = 1 << 17


def _ones(hashes) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(np.asarray(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _over_half(ones: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes, each of which counts once; 0 of none."""
    return _over_half(sum((_ones(hashes[a : a + CHUNK]) for a in range(0, len(hashes), CHUNK)), np.zeros(BITS, np.int64)), len(hashes))


def fingerprint(text: str | None) -> int:
    """Bit b is 1 if it is 1 in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops, h = ends[SHINGLE - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, CHUNK):
        ones += _ones([h(line[i:j], SEED) for i, j in zip(starts[a : a + CHUNK], stops[a : a + CHUNK])])
    return _over_half(ones, n)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long) for every row; fp holds the 64 bits, its sign is the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"key {kind}, fp long")


def filings(fps: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(t, k) and the columns of `fps`: one row for each pair of blocks of fp. Fingerprints that differ in at most
    `blocks` - 2 bits have a filing in common."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << z - a) - 1) for a, z in zip(ends, ends[1:])]
    pairs = [F.struct(F.lit(t).alias("t"), F.shiftleft(part[i], ends[j + 1] - ends[j]).bitwiseOR(part[j]).alias("k")) for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    return fps.select(*fps.columns, F.explode(F.array(*pairs)).alias("f")).select("f.t", "f.k", *fps.columns)


def apart(u, v) -> Column:
    """The number of bits in which two fingerprints differ."""
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v)))


def _flip_masks() -> Column:
    """By table: 0 and the one-bit masks of the blocks outside the table's pair, as longs."""
    rows = []
    for pair in combinations(range(BLOCKS), 2):
        bits = [b for i in range(BLOCKS) if i not in pair for b in range(i * BLOCK_BITS, (i + 1) * BLOCK_BITS)]
        rows.append(F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in bits)))
    return F.array(*rows)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v), u < v: edges between different fingerprints whose components are those of all links of at most two bits.
    `fps` must hold each fingerprint once."""
    filed = filings(fps)
    sizes = filed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(filed.join(sizes, ["t", "k"]), "simhash-met")
    few, many = met.where(F.col("n") <= bucket).drop("n"), met.where(F.col("n") > bucket)
    other = few.withColumnRenamed("fp", "v")
    near = few.withColumnRenamed("fp", "u").join(other, ["t", "k"]).where((F.col("u") < F.col("v")) & (apart("u", "v") <= DISTANCE)).select("u", "v")
    around = many.select("fp", "t", F.explode(F.get(_flip_masks(), F.col("t"))).alias("m")).select("fp", "t", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    centre = around.groupBy("t", "point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = around.join(centre, ["t", "point"]).where(F.col("fp") > F.col("u")).select("u", F.col("fp").alias("v"))
    return near.unionByName(star).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (u, v), for every node that has an edge.

    Alternating large-star and small-star rounds; each ends in a table in the shared folder. Both stars only join on
    a node's smallest neighbour, so a hub costs one row per edge. The loop ends when a round changes nothing."""
    now = materialize(edges.select("u", "v"), "cc")
    before = (0, None)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("v"), F.col("v").alias("u")).where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.where(F.col("v") != F.col("m")).select(F.col("m").alias("u"), "v")
        kept = low.select(F.col("m").alias("u"), F.col("u").alias("v"))
        after = materialize(moved.unionByName(kept).distinct(), "cc")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        release(now)
        now = after
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component) for every row of `docs`; component is the smallest key reachable over links."""
    fps = materialize(fingerprints(docs, text, key), "simhash-fp")
    vertices = materialize(fps.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")), "simhash-vertices")
    roots = components(links(vertices.select("fp")))
    rooted = vertices.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    linked = rooted.select("fp", "root").join(least, "root").select("fp", F.col("component").alias("c"))
    names = vertices.join(linked, "fp", "left").select("fp", F.coalesce("c", "first").alias("component"), "n")
    # At most 1 / HOT_SHARE fingerprints stand for that share of all rows; their rows are not shuffled by them.
    least_hot = HOT_SHARE * (vertices.agg(F.sum("n")).first()[0] or 0)
    hot = F.broadcast(materialize(names.where(F.col("n") >= least_hot), "simhash-hot"))
    many = fps.join(hot, "fp")
    rest = fps.join(hot, "fp", "left_anti").join(names.where(F.col("n") < least_hot), "fp")
    return many.unionByName(rest).select("key", "fp", "component")


def keep_one(docs: DataFrame, find=near_duplicates) -> DataFrame:
    """One row of each component of `docs`, as `find` has them by key: of the rows with the smallest doc_id, one with the
    least hash of its text, and of those the first by all columns. A row is told by its doc_id and its text, so rows
    that share an id and nothing else are judged apart. A row without doc_id counts as one with an id that is larger
    than any other and follows from its text; an empty table gives an empty table."""
    cols, k = docs.columns, unused("__key", docs.columns)
    h = F.xxhash64(F.col("text"))
    late = F.shiftrightunsigned(h, 2) + F.lit(1 << 62)
    keyed = docs.withColumn(k, F.struct(F.coalesce(F.col("doc_id").cast("long"), late).alias("id"), h.alias("h")))
    chosen = find(keyed, key=k).where(F.col("key") == F.col("component")).select(F.col("key").alias(k)).distinct()
    whole = F.min(F.struct(*(F.col(f"`{c}`") for c in cols))).alias("r")
    return keyed.join(chosen, k, "left_semi").groupBy(k).agg(whole).select("r.*")
