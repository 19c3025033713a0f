import random
import zlib

import numpy as np

from nitscope.llm import packing, tokens
from tests.llm.data import ROWS, clashing, documents


def test_cut():
    assert packing.cut(0) == []
    assert packing.cut(5, 10) == [(0, 5)]
    assert packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_bound_never_exceeds_packing_and_best_fit_is_valid():
    rnd = random.Random(0)
    for _ in range(60):
        n = rnd.randint(1, 60)
        sizes = np.array([rnd.choice((rnd.randint(1, 100), rnd.randint(34, 60), 51)) for _ in range(n)])
        where, offset, free = packing.best_fit_decreasing(sizes, 100)
        for s in range(len(free)):
            mine = sorted((o, n) for o, n in zip(offset[where == s], sizes[where == s]))
            assert mine[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:]))
            assert mine[-1][0] + mine[-1][1] == 100 - free[s]
        assert packing.lower_bound(np.bincount(sizes, minlength=101), 100) <= len(free)


def test_bound_sees_more_than_volume():
    assert packing.lower_bound({51: 10}, 100) == 10
    assert packing.lower_bound({34: 9}, 100) == 5
    assert packing.lower_bound({26: 7}, 100) == 3


def test_pack_covers_every_piece_once(spark):
    docs = documents(spark)
    packed = packing.packed_documents(docs).collect()
    want = []
    for key, text, *_ in ROWS:
        ids = np.array([*tokens._plain("byte_bpe_50k").encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(key), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= packing.CAPACITY


def test_repacking_over_many_groups_keeps_all(spark):
    rnd = random.Random(2)
    rows = [(i, 0, 0, rnd.choice((700, 900, 1100, 1348, rnd.randint(1, 2048))), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(df, group=300).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
    once = len(packing.best_fit_decreasing(np.array([r[3] for r in rows]))[2])
    assert len(fill) <= once * 1.02 + 1


def test_real_sequences_hold_the_ids(spark):
    docs = documents(spark)
    packed = packing.packed_documents(docs)
    rows = packing.sequences(docs, packed).collect()
    assert len(rows) == packed.count()


def test_empty_and_clashing(spark):
    assert packing.packed_documents(documents(spark, [])).count() == 0
    assert packing.packed_documents(clashing(spark)).count() >= len(ROWS)
