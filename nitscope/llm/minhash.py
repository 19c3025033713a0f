"""Near copies: SimHash fingerprints and, for what lies further apart, MinHash bands; exact Jaccard similarity of word
shingles decides; components.

Two texts are near copies if the sets of their shingles of `SHINGLE` words have a Jaccard similarity of `LEAST` or more.
Equal sets are one vertex. Every set has a SimHash fingerprint, filed as in `simhash` under its pairs of blocks, here of
`BLOCKS`: so all pairs that differ in at most `DISTANCE` bits meet, and these are candidates. At a similarity of 0.8 sets
are expected about ten bits apart, where no filing by blocks is selective; so every text also stands under `BANDS` values
of `ROWS` minima each; a pair at the least similarity shares none of them with a probability of (1 - 0.8^5)^40 = 1.3e-7.
Every candidate is decided by its whole sets. In a bucket (a filing or a value) of at most `BUCKET` vertices all pairs are
looked at.

Of the vertices of larger buckets, most pairs are far apart, and there may be thousands. They are filed a second time,
exactly: under the rarest of their shingles among these vertices, one more than a fifth of them, for sets of a similarity
of 0.8 or more have at least one of those in common; and the place of the first that they have in common bounds how many
they may share (`_may_be`). So a text of which a ninth is its own meets none of its size. Where many still stand under one
shingle, all are compared with the one whose shingles are the most common (what copies were made from has none of its
own); who is not linked to the commonest component after that is compared with those under the shingle that are not in its
component, so no link that would change a component is lost.

Defined cases: null or empty texts are equal; texts of fewer words are one shingle; repeated rows come back as often; a
very long text's shingles are one set, whose minima are taken `CHUNK` at a time; a null key is one like any other, and
names a component only if all its keys are null; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitscope.llm.simhash import HOT_SHARE, SEED, apart, components, filings, majority
from nitscope.runtime import materialize

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 40, 5
BUCKET = 32
#: Blocks of a fingerprint, of which any two make a filing of at least 25 bits; bits in which candidates may differ.
BLOCKS, DISTANCE = 5, 3
#: Slots of the table by which shingles are put in order.
SLOTS = 1 << 17
#: Below any difference of products of whole numbers and `LEAST` that counts.
ROUNDING = 1e-6
#: Most shingles whose minima are taken at once: bounds the memory for very long texts.
CHUNK = 1 << 11
#: Documents whose sets a task holds before it hands on what it makes of them.
HELD = 200
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted different hashes of the shingles of A-Z lower-cased words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    return np.unique(np.fromiter((h(line[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(stops)))


def _name(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def _bands(s: np.ndarray) -> list[int]:
    """One value for each band: its number and minima hashed; a set without shingles has none."""
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(s), CHUNK):
        np.minimum(least, (s[a : a + CHUNK, None] * _FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sets(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, id long, size int, fp long, values array<long>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, HELD) for b in batches for i in range(0, b.num_rows, HELD)):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            values = [_bands(s) for s in sets]
            ends = np.cumsum([0, *map(len, values)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed([x for v in values for x in v]))
            yield pa.RecordBatch.from_arrays([b.column(0), _signed([_name(s) for s in sets]), pa.array(map(len, sets), pa.int32()), _signed([majority(s) for s in sets]), flat], names=["key", "id", "size", "fp", "values"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"key {kind}, id long, size int, fp long, values array<long>")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """(id, s array<long>) of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, HELD) for b in batches for i in range(0, b.num_rows, HELD)):
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([_signed([_name(s) for s in sets]), pa.ListArray.from_arrays(ends, _signed(np.concatenate(sets)))], names=["id", "s"])

    return texts.mapInArrow(run, "id long, s array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (u, v) whose whole sets are similar enough; row by row in the JVM, for sets can be long."""
    left, right = sets.select(F.col("id").alias("u"), F.col("s").alias("a")), sets.select(F.col("id").alias("v"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(both / (F.size("a") + F.size("b") - both) >= LEAST).select("u", "v")


def _sizes_allow(a, b):
    return F.least(a, b) >= LEAST * F.greatest(a, b) - ROUNDING


def _shares(size, place, other):
    """True unless a set whose first shingle in common with one of size `other` has this place (from 1) shares too few with
    it: no more than that one and what follows it."""
    return size - place + 1 >= LEAST / (1 + LEAST) * (size + other) - ROUNDING


def _may_be(size_a, place_a, size_b, place_b):
    return _shares(size_a, place_a, size_b) & _shares(size_b, place_b, size_a)


def _pairs(filed: DataFrame, *by: str) -> DataFrame:
    """(u, v), u < v: all pairs under one `by` whose sizes, and places and fingerprints if they are known, allow them."""
    known = [c for c in ("place", "fp") if c in filed.columns]
    left, right = (filed.select(*by, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "size", *known))) for x in "uv")
    allowed = _may_be(F.col("size_u"), F.col("place_u"), F.col("size_v"), F.col("place_v")) if "place" in known else _sizes_allow(F.col("size_u"), F.col("size_v"))
    if "fp" in known:
        allowed &= apart("fp_u", "fp_v") <= DISTANCE
    return left.join(right, list(by)).where((F.col("id_u") < F.col("id_v")) & allowed).select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))


def by_fingerprints(vertices: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """((u, v), (id)) for `vertices` (id, size, fp): the pairs at most `DISTANCE` bits apart whose sizes allow the least
    similarity, and those that stand in a filing of more than `bucket`, whose pairs are not among them."""
    filed = filings(vertices.where("size > 0").select("id", "size", "fp"), BLOCKS)
    sizes = filed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(filed.join(sizes, ["t", "k"]), "copies-filings")
    close = materialize(_pairs(met.where(F.col("n") <= bucket), "t", "k").distinct(), "copies-close")
    return close, met.where(F.col("n") > bucket).select("id").distinct()


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """(shingle, id, size, place, score) of the rarest shingles of each of `sets` (id, s), as many as sets of the least
    similarity must have one in common, with their places in the order from rare to common. Any order that is the same for
    all sets would do: this one goes by how many shingles fall into a shingle's slot of `SLOTS`, and those counts are all
    that leaves the rows. The score is the mean log of the counts of a set's shingles."""
    slot = lambda x: F.pmod(x, F.lit(SLOTS)).cast("int")
    counts = [0] * SLOTS
    for r in sets.select(F.explode("s").alias("x")).groupBy(slot(F.col("x")).alias("slot")).agg(F.count("*").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    known = F.from_json(F.lit("[" + ",".join(map(str, counts)) + "]"), "array<bigint>")
    ordered = F.array_sort(F.transform("s", lambda x: F.struct(F.get(known, slot(x)).alias("n"), x.alias("shingle"))))
    by = sets.select("id", F.size("s").alias("size"), ordered.alias("a"))
    prefix = F.slice("a", F.lit(1), F.col("size") - F.ceil(F.col("size") * LEAST - ROUNDING).cast("int") + 1)
    score = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + F.log(x["n"].cast("double"))) / F.col("size")
    placed = F.filter(F.transform(prefix, lambda x, i: F.struct(x["shingle"].alias("shingle"), x["n"].alias("n"), (i + 1).alias("place"))), lambda x: x["n"] > 1)
    return by.select("id", "size", score.alias("score"), F.explode(placed).alias("x")).select("x.shingle", "id", "size", "x.place", "score")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """(key, component) for every row of `docs`; component is the smallest key reachable over near copies."""
    rows = materialize(_sets(docs, text, key), "copies-rows")
    vertices = materialize(rows.groupBy("id").agg(F.min("key").alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("fp").alias("fp")), "copies-vertices")
    close, crowded = by_fingerprints(vertices, bucket)
    filed = rows.select("id", "size", F.explode("values").alias("value")).distinct()
    sizes = filed.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(filed.join(sizes, "value"), "copies-met")
    # Only texts that stand in a bucket with others or have a fingerprint close to another's are read again for their sets.
    alone = F.col(f"`{key}`").alias("key")
    asked = met.select("id").unionByName(close.select(F.explode(F.array("u", "v")).alias("id"))).unionByName(crowded).distinct()
    wanted = rows.select("key", "id").join(asked, "id").select("key").distinct()
    again = docs.select(alone, F.col(f"`{text}`").alias("text"))
    again = again.join(wanted, again["key"].eqNullSafe(wanted["key"]), "left_semi").select("text").distinct()
    sets = materialize(_whole_sets(again).join(asked, "id", "left_semi").dropDuplicates(["id"]), "copies-sets")
    near = _pairs(met.where(F.col("n") <= bucket), "value")
    many = met.where(F.col("n") > bucket).select("id").unionByName(crowded).distinct()
    rare = materialize(_rare_shingles(sets.join(many, "id", "left_semi")), "copies-filed")
    best = F.max(F.struct("score", "id", "size"))
    under = rare.groupBy("shingle").agg(F.count("*").alias("n"), best.alias("hub"), F.min("size").alias("least")).where("n > 1")
    # A set that allows none as small as the smallest under its shingle meets nobody there.
    crowd = rare.join(under, "shingle").where(_shares(F.col("size"), F.col("place"), F.col("least")))
    crowd = materialize(crowd.select("shingle", "id", "size", "place", "n", F.col("hub.id").alias("hub"), F.col("hub.size").alias("hub_size")), "copies-crowd")
    large = crowd.where(F.col("n") > bucket)
    star = large.where((F.col("id") != F.col("hub")) & _sizes_allow(F.col("size"), F.col("hub_size"))).select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v"))
    candidates = materialize(close.unionByName(near).unionByName(_pairs(crowd.where(F.col("n") <= bucket), "shingle")).unionByName(star).distinct(), "copies-candidates")
    edges = materialize(_similar(candidates, sets), "copies-edges")
    roots = components(edges)
    if not large.isEmpty():
        placed = large.select("shingle", "id", "size", "place").join(roots.withColumnRenamed("node", "id"), "id", "left")
        placed = materialize(placed.withColumn("root", F.coalesce("root", "id")), "copies-placed")
        shares = placed.groupBy("shingle", "root").agg(F.count("*").alias("n"))
        main = shares.groupBy("shingle").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
        rest = placed.join(main, "shingle").where("root <> main").select("shingle", F.col("id").alias("x"), F.col("root").alias("own"), F.col("size").alias("x_size"), F.col("place").alias("x_place"))
        fits = (F.col("own") != F.col("root")) & _may_be(F.col("x_size"), F.col("x_place"), F.col("size"), F.col("place"))
        open_pairs = rest.join(placed, "shingle").where(fits).select(F.least("x", "id").alias("u"), F.greatest("x", "id").alias("v")).distinct()
        more = materialize(_similar(open_pairs.join(candidates, ["u", "v"], "left_anti"), sets), "copies-more")
        if not more.isEmpty():
            roots = components(edges.unionByName(more))
    rooted = vertices.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "first", "n", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    names = rooted.join(least, "root").select("id", "component", "n")
    # As in `simhash`: the rows of the few sets that many rows share are not shuffled by them.
    least_hot = HOT_SHARE * (vertices.agg(F.sum("n")).first()[0] or 0)
    hot = F.broadcast(materialize(names.where(F.col("n") >= least_hot), "copies-hot"))
    given = rows.select("key", "id")
    rest = given.join(hot, "id", "left_anti").join(names.where(F.col("n") < least_hot), "id")
    return given.join(hot, "id").unionByName(rest).select("key", "component")
