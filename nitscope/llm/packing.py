"""Best-fit packing with certificates: dual-feasible-function bounds, repacking of what has gaps.

Documents become pieces of at most `capacity` tokens. Pieces are dealt to groups of bounded size; each group runs
best-fit decreasing and compares its sequences with the largest lower bound that the dual feasible functions give.
While the total exceeds the bound of the whole table, every group gives back the pieces of its emptiest sequences, the
more the further it is over its own bound; these are dealt anew and packed again, as long as that saves sequences.

Defined cases: a null or empty text is one piece, the end id alone; a row is packed as often as it stands in the
table, whatever its doc_id; pieces of equal length take their places in the order of document, piece and checksum; a very
long text is encoded whole, as one document of the table; an empty table gives no pieces; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nitscope.llm import tokens
from nitscope.runtime import materialize, scan_tasks

CAPACITY = 2048
#: Pieces that one task packs at a time: a few MB of Python objects.
GROUP = 40_000
MAX_ROUNDS = 8


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, but for a shorter first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)] if n else []


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the tokens of every document, end id included, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, rows = b.column(0).to_pylist(), []
            for key, text in zip(names, b.column(1).to_pylist(), strict=True):
                ids = np.array([*tokens.encode(text or "", vocabulary), end_id], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + n]
                    rows.append((key, k, start, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None))
            if not rows:
                continue
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            if keep_ids:
                arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=out_names)

    out_names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def lower_bound(counts: dict[int, int] | np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing of these lengths needs, the best of three families of dual feasible functions:
    volume; u_k (k = 1..32), which rounds shares up to k-ths; and the threshold family, in which lengths over
    capacity - t count as whole and those under t as nothing, for every t up to half the capacity."""
    c = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items() if isinstance(counts, dict) else enumerate(counts):
        c[size] += n
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((c * sizes).sum()) // capacity)
    for k in range(1, 33):
        scaled = sizes * (k + 1)
        share = np.where(scaled % capacity == 0, scaled // (k + 1) * k, scaled // capacity * capacity)
        best = max(best, -(-int((c * share).sum()) // (capacity * k)))
    below_n, below_v = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * sizes)))
    t = np.arange(0, capacity // 2 + 1)
    large = below_n[-1] - below_n[capacity - t + 1]
    middle = below_v[capacity - t + 1] - below_v[t]
    return max(best, int((large + -(-middle // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, and the free tokens of each sequence. The largest piece comes first, ties in
    the given order, and goes where it leaves the least room; free rooms are one bit each of an integer."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        up = bits >> n
        if up:
            room = n + (up & -up).bit_length() - 1
            s = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            room, s = capacity, len(free)
            free.append(capacity)
        where[i], offset[i] = s, capacity - room
        left = free[s] = room - n
        if left:
            rooms[left].append(s)
            bits |= 1 << left
    return where, offset, np.array(free, np.int64)


def _pack_groups(df: DataFrame, groups: int, round_no: int, columns: list[str], capacity: int) -> DataFrame:
    """`columns` plus (grp, seq, offset, room, n_seq, bound): each group's packing and its certificate."""
    given = df.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        lengths = t.column("length").to_numpy()
        where, offset, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        n = len(t)
        for name, v in (("seq", where), ("offset", offset), ("room", free[where]), ("n_seq", np.full(n, len(free))), ("bound", np.full(n, bound))):
            t = t.append_column(name, pa.array(v, pa.int64()))
        return t

    # Dealt by the number of the row in the table that is read, so that no document or id decides where its pieces go.
    dealt = given.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_no)), F.lit(groups)))
    out = f"{schema}, grp long, seq long, offset long, room long, n_seq long, bound long"
    return dealt.groupBy("grp").applyInArrow(run, out)


def pack(df: DataFrame, capacity: int = CAPACITY, group: int = GROUP, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """`df` (doc_id, piece, start, length, ids_crc32, ...) plus sequence_id and offset.

    The driver holds only counts: one for each possible length, and a few sums of each round."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    sizes = {r[0]: r[1] for r in df.groupBy("length").agg(F.count("*")).collect()}
    groups = scan_tasks(df.sparkSession, sum(sizes.values()), group)
    bound, settled, done, todo, before = lower_bound(sizes, capacity), 0, [], df, None
    for no in range(max_rounds):
        packed = materialize(_pack_groups(todo, groups, no, columns, capacity), "packed")
        bins = packed.groupBy("grp", "seq").agg(*(F.first(c).alias(c) for c in ("room", "n_seq", "bound")))
        made = bins.count()
        number = F.shiftleft(F.lit(no).cast("long"), 56) + F.shiftleft(F.col("grp"), 24) + F.col("seq")
        packed = packed.withColumn("sequence_id", number)
        if before is not None and made >= before[0]:  # the round saved no sequence: what was there stays
            done.append(before[1])
            break
        if settled + made <= bound or groups == 1 or no == max_rounds - 1:
            done.append(packed)
            break
        # all sequences with notable room, and the emptiest until what they leave free would hold one sequence more
        # than the group has over its bound
        w = Window.partitionBy("grp").orderBy(F.desc("room"), "seq").rowsBetween(Window.unboundedPreceding, -1)
        opened = bins.where("room > 0").withColumn("passed", F.coalesce(F.sum("room").over(w), F.lit(0))).where((F.col("room") > capacity // 64) | (F.col("passed") < capacity * (F.col("n_seq") - F.col("bound") + 1))).select("grp", "seq", F.lit(True).alias("open"))
        marked = materialize(packed.join(opened, ["grp", "seq"], "left"), "marked")
        again = marked.where("open")
        n_open, n_again = again.agg(F.countDistinct("sequence_id"), F.count("*")).first()
        done.append(marked.where("open IS NULL"))
        settled, before, todo = settled + made - n_open, (n_open, again), again
        groups = scan_tasks(df.sparkSession, n_again, group)
    return reduce(DataFrame.unionByName, [d.select(*columns, "sequence_id", "offset") for d in done])


def packed_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokens of all documents, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(docs, vocabulary, end_id, capacity, keep_ids=False), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str = "byte_bpe_50k", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, offset, doc_id, ids): the token ids in the place that `packed` gives each piece. Repeated rows of
    one document have equal pieces, so any of them may stand in any of the places."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    have = pieces(docs, vocabulary, end_id, capacity).withColumn("turn", turn)
    place = packed.withColumn("turn", turn).select("sequence_id", "offset", *(F.col(c).alias(f"p_{c}") for c in (*key, "turn")))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*key, "turn")))
    return have.join(place, same).select("sequence_id", "offset", "doc_id", "ids")
