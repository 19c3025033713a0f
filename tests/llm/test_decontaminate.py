import random

import numpy as np

from nitscope.llm import decontaminate as dc
from tests.llm.data import WORDS, clashing, documents, prose


def test_hashes_tell_windows_apart():
    c = dc.codes("abcdefghijklmnop" * 3)
    h = dc.gram_hashes(c)
    assert len(h) == len(c) - dc.Q + 1 and h[0] == h[16] and len(set(h.tolist())) == 16
    assert len(dc.gram_hashes(dc.codes("short"))) == 0


def edits_in(unit, region):
    """Fewest edits of any stretch of the region, by the full table."""
    row = np.zeros(len(region) + 1, int)
    for i, ch in enumerate(unit, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, r in enumerate(region, 1):
            new[j] = min(row[j - 1] + (ch != r), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def damage(rnd, text, n):
    t = list(text)
    for _ in range(n):
        i, what = rnd.randrange(1, len(t) - 1), rnd.randrange(3)
        if what == 0:
            t[i] = "z"
        elif what == 1:
            t.insert(i, "z")
        else:
            del t[i]
    return "".join(t)


def test_search_agrees_with_brute_force():
    rnd = random.Random(5)
    unit = dc.normal(" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(15)))[:90].strip()
    index = dc.Index([("i", unit)])
    k = dc.edits_allowed(len(unit))
    assert k >= 7
    texts = [dc.normal("lead in " * rnd.randint(0, 9) + damage(rnd, unit, n) + " and out" * rnd.randint(0, 9)) for n in range(0, 14) for _ in range(8)]
    found = {}
    for j, _, s, e, n in index.search(texts):
        found[j] = min(n, found.get(j, 99))
    for j, t in enumerate(texts):
        best = edits_in(unit, t)
        assert (j in found) == (best <= k), (best, k)
        if j in found:
            assert found[j] == best


def test_query_finds_each_item_in_its_document(spark):
    item = " ".join(f"{w}{i}" for i, w in enumerate(WORDS))
    rows = [(1, prose(1, 300) + " " + item.upper().replace(" ", " ** ") + " " + prose(2, 50), "en", "a", 1), (2, prose(1, 400), "en", "a", 1), (3, None, "en", "a", 1), (4, item[40:160], "en", "a", 1), (4, item[40:160], "en", "a", 1)]
    items = spark.createDataFrame([(7, item), (8, None), (9, "short"), (7, item)], "item_id long, text string")
    docs = documents(spark, rows)
    got = dc.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (4, 7), (4, 7)]
    one = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][one.start : one.end].startswith("THE0 ** RIVER1") and one.edits == 0
    assert [r.doc_id for r in dc.keep_clean(docs, items).orderBy("doc_id").collect()] == [2, 3]


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, dc.find_leaks(docs, items).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, dc.find_leaks(docs, items).collect())) == want
    plain = sorted((d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if dc.normal(i.text) in dc.normal(d.text))
    assert set(plain) <= {(r[0], r[1]) for r in want}


def test_empty_and_clashing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(documents(spark), items).count() == 0
    wide = clashing(spark)
    some = spark.createDataFrame([(1, "nothing of this kind is in there at all")], "item_id long, text string")
    clean = dc.keep_clean(wide, some)
    assert clean.columns == wide.columns and clean.count() == wide.count()
    assert dc.find_leaks(documents(spark, []), some).count() == 0
