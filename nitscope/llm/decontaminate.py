"""Benchmark decontamination by the q-gram lemma: count shared character q-grams in diagonal bands, verify by alignment.

Texts are compared as their words of letters and digits, lower-cased, one space apart. An item is cut into overlapping
units; a unit of m characters is found in a document if some stretch of it is within k(m) edits. Such a stretch shares at
least m - q + 1 - k q of the unit's q-grams, on diagonals that lie within k of each other, so that one of the
overlapping bands of diagonals holds them all. Bands that reach that count are aligned, in a band of the same width.

The work on a document is a rolling hash over its characters and a table look-up; only hits go further. The benchmark is
handed to the tasks in blocks of at most `BLOCK_CHARS` characters, each with its own pass over the documents, so what is
broadcast has a fixed bound (an index of a full block takes less than 64 MB) and a larger benchmark takes more passes.

Defined cases: null or empty texts are in no result and in no item; an item of fewer than Q characters can't be told
from ordinary text and is never reported; equal items, and ties between them, are each reported; a row is judged as often
as it stands in the table; a text of any length is read whole, `SCAN` characters at a time, and an item of more than
`BLOCK_CHARS` in parts, each of which is reported for itself; of the columns only key and
text are looked at, and where the item's key has the name of the document's it becomes `item_` and that name; an empty
table or benchmark gives no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Q = 10
EDIT_SHARE = 0.08
UNIT, STEP, WHOLE = 72, 24, 90
BLOCK_CHARS = 1_000_000
#: Characters that are scanned together, of several documents or one, and those that parts of one share: more than any
#: unit and its edits.
SCAN, OVERLAP = 1 << 20, 256
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22

_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def normal(text: str | None) -> str:
    return " ".join(w.lower() for w in _WORDS.findall(text or ""))


def edits_allowed(m: int) -> int:
    return max(0, min(int(EDIT_SHARE * m), (m - Q) // Q))


def needed(m: int) -> int:
    """Least number of shared q-grams of a unit of m characters and a stretch within its edits."""
    return m - Q + 1 - edits_allowed(m) * Q


def units(text: str) -> list[str]:
    """The whole of a text up to WHOLE characters, else windows of UNIT characters, the last one at its end."""
    if len(text) < Q:
        return []
    if len(text) <= WHOLE:
        return [text]
    starts = [*range(0, len(text) - UNIT, STEP), len(text) - UNIT]
    return [text[a : a + UNIT] for a in starts]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of every window of Q characters."""

    def double(h, w):  # windows of twice the width
        return h[: len(h) - w] * power[w] + h[w:]

    power = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(Q + 1)]
    h = c.astype(np.uint64) + np.uint64(1)
    if len(h) < Q:
        return h[:0]
    by, width, out, done = h, 1, None, 0
    for bit in range(Q.bit_length()):
        if Q >> bit & 1:
            n = len(c) - done - width + 1
            out = by[:n].copy() if out is None else out[: n] * power[width] + by[done : done + n]
            done += width
        if Q >> (bit + 1):
            by, width = double(by, width), width * 2
    return out


class Index:
    """Units of the items and the places of their q-grams."""

    def __init__(self, items: list[tuple]):
        self.item, self.unit = [], []
        grams, owner, place = [], [], []
        for key, text in items:
            for u in units(normal(text)):
                g = gram_hashes(codes(u))
                grams.append(g)
                owner.append(np.full(len(g), len(self.unit), np.int32))
                place.append(np.arange(len(g), dtype=np.uint8))
                self.item.append(key)
                self.unit.append(u)
        if not grams:
            return
        g, o, p = map(np.concatenate, (grams, owner, place))
        order = np.argsort(g, kind="stable")
        self.owner, self.place = o[order], p[order]
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g)).astype(np.int32)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True
        self.width = np.array([edits_allowed(len(u)) + 1 for u in self.unit])
        self.need = np.array([needed(len(u)) for u in self.unit])

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, unit, start, end, edits) in normal texts, for each band of diagonals that verifies."""
        if not self.unit or not texts:
            return []
        gap = "\0" * Q  # no q-gram of a unit reaches over it
        joined = gap.join(texts)
        lens = np.array([len(t) for t in texts])
        begin = np.concatenate(([0], np.cumsum(lens[:-1] + Q)))
        h = gram_hashes(codes(joined))
        at = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[k] == h[at]
        at, k = at[same], k[same]
        found, cut = [], 1 << 18
        while len(at):  # a common q-gram may stand at many places of many units: bounded amounts at a time, whole texts
            total = np.cumsum(self.first[k + 1] - self.first[k], dtype=np.int64)
            n = max(1, int(np.searchsorted(total, cut)))
            if n < len(at):
                text_of = np.searchsorted(begin, at, side="right") - 1
                last = text_of[n - 1]
                n = int(np.searchsorted(text_of, last, side="left")) or int(np.searchsorted(text_of, last, side="right"))
            found += self._bands(joined, begin, lens, at[:n], k[:n])
            at, k = at[n:], k[n:]
        return found

    def _bands(self, joined, begin, lens, at, k):
        times = self.first[k + 1] - self.first[k]
        rows = np.repeat(np.arange(len(k)), times)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        posting = self.first[k][rows] + inner
        unit = self.owner[posting].astype(np.int64)
        diagonal = at[rows] - self.place[posting] + (1 << 20)
        band = diagonal // self.width[unit]
        both = np.concatenate((unit * (1 << 40) + band, unit * (1 << 40) + band - 1))
        key, n = np.unique(both, return_counts=True)
        out = []
        keep = n >= self.need[key >> 40]
        for u, b in zip((key[keep] >> 40).tolist(), (key[keep] & ((1 << 40) - 1)).tolist(), strict=True):
            w, text = int(self.width[u]), self.unit[u]
            low = b * w - (1 << 20)  # first diagonal of the band
            i = int(np.searchsorted(begin, max(low + len(text) // 2, 0), side="right")) - 1
            for j in {i, max(int(np.searchsorted(begin, max(low, 0), side="right")) - 1, 0), min(i + 1, len(lens) - 1)}:
                a, z = int(begin[j]), int(begin[j] + lens[j])
                s, e = max(a, low - w), min(z, low + 2 * w + len(text) + w)
                if s < e and (hit := align(text, joined[s:e], w - 1, low - s, 2 * w)):
                    out.append((j, u, s + hit[0] - a, s + hit[1] - a, hit[2]))
        return out


def align(unit: str, region: str, k: int, low: int, width: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the stretch of `region` nearest to `unit`, if within k edits, among paths on the diagonals
    low - k to low + width + k of `region` against `unit`."""
    exact = region.find(unit)
    if exact >= 0:
        return exact, exact + len(unit), 0
    first, n = low - k, width + 2 * k + 1  # column c of row i is the region's place first + c + i
    r, u = codes(region), codes(unit)
    far = len(unit) + len(region) + 1
    step = np.arange(n)
    places = first + step
    cost = np.where((places >= 0) & (places <= len(r)), 0, far).astype(np.int64)
    start = places.copy()
    for i, ch in enumerate(u.tolist()):
        p = first + step + i  # the place before row i + 1 in the same column
        ok = (p >= 0) & (p < len(r))
        same = np.zeros(n, bool)
        same[ok] = r[p[ok]] == ch
        by = np.where(ok, cost + ~same, far)
        up = np.append(cost[1:] + 1, far)  # the unit's character has no counterpart
        origin = np.where(by <= up, start, np.append(start[1:], 0))
        best = np.minimum(by, up)
        left = best - step  # characters of the region without a counterpart
        source = np.maximum.accumulate(np.where(left == np.minimum.accumulate(left), step, 0))
        cost, start = best[source] + step - source, origin[source]
        cost = np.where((p + 1 >= 0) & (p + 1 <= len(r)), cost, far)
    c = int(cost.argmin())
    return (int(start[c]), first + c + len(u), int(cost[c])) if cost[c] <= k else None


def _blocks_of(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of about `BLOCK_CHARS` characters; one block is on the driver at a time. An item that is longer
    than a block is cut into parts that share as many characters as a unit has, so that every unit lies in one of them."""
    width = F.lit(BLOCK_CHARS // 2)
    cut = F.when(F.length("t") <= BLOCK_CHARS, F.array(F.col("t"))).otherwise(F.transform(F.sequence(F.lit(1), F.length("t"), width), lambda a: F.substr("t", a, width + 4 * WHOLE)))
    parts = items.select(F.col(f"`{item_id}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").select("k", F.posexplode(cut).alias("i", "t"))
    total = parts.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for i in range(blocks):
        yield [tuple(r) for r in parts.where(F.pmod(F.xxhash64("k", "i", "t"), F.lit(blocks)) == i).select("k", "t").collect()]


def _scan(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    held, places, size = [], [], 0
    for i, t in enumerate([*texts, None]):
        s = normal(t) if i < len(texts) else ""
        for a in range(0, max(len(s) - OVERLAP, min(len(s), 1)), SCAN - OVERLAP):
            held.append(s[a : a + SCAN])
            places.append((i, a))
            size += len(held[-1])
            if size >= SCAN:
                yield from ((places[j][0], u, places[j][1] + s0, places[j][1] + e0, n) for j, u, s0, e0, n in index.search(held))
                held, places, size = [], [], 0
    yield from ((places[j][0], u, places[j][1] + s0, places[j][1] + e0, n) for j, u, s0, e0, n in index.search(held))


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """Places in the text of a stretch of its normal form, at whole words."""
    at, a, b = 0, None, 0
    for m in _WORDS.finditer(text):
        n = len(m[0].lower())
        if at + n > start and a is None:
            a = m.start()
        if at < end:
            b = m.end()
        at += n + 1
    return (a or 0), b


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits, units): one row for each document and item that it holds a unit of: the
    stretch of the document from the first to the last such unit, the fewest edits, and how many units were found."""
    item_name = item_id if item_id.lower() != key.lower() else f"item_{item_id}"
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = StructType.fromDDL(f"`{key}` {kinds[0]}, `{item_name}` {kinds[1]}, start long, end long, edits int, units int")
    target = to_arrow_schema(schema)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks_of(items, item_id, item_text):
        index = Index(block)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, names = b.column(1).to_pylist(), b.column(0)
                by: dict[tuple, list] = {}
                for i, u, s, e, n in _scan(index, texts):
                    x = by.setdefault((i, index.item[u]), [s, e, n, set()])
                    x[:3] = min(x[0], s), max(x[1], e), min(x[2], n)
                    x[3].add(u)
                if by:
                    rows = [(names[i].as_py(), item, *_original(texts[i], s, e), n, len(us)) for (i, item), (s, e, n, us) in by.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        out = out.unionByName(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` in which no unit of any item is found; nothing is shuffled."""
    for block in _blocks_of(items, item_id, item_text):
        index, at = Index(block), docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index, at: int = at) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[i for i, *_ in _scan(index, b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
