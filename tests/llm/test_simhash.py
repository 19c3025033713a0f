import random

import numpy as np
import xxhash

from nitscope.llm import simhash
from tests.llm.data import ROWS, clashing, documents


def plain(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_fingerprints():
    for _, text, *_ in ROWS:
        assert simhash.fingerprint(text) == plain(text)


def test_components_match_brute_force(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    want = groups_of({plain(r[1]) for r in ROWS})
    least = {}
    for r in ROWS:
        g = want[plain(r[1])]
        least[g] = min(x for x in (least.get(g), r[0]) if x is not None) if (least.get(g), r[0]) != (None, None) else None
    assert sorted((str(r.key), r.component) for r in got) == sorted((str(r[0]), least[want[plain(r[1])]]) for r in ROWS)


def test_links_small_and_large_filings_agree_with_brute_force(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
            fps.add(x ^ 1 << rnd.randrange(64))
    want = groups_of(fps)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bucket in (0, 8, 64):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, bucket)).collect()}
        mine = {}
        for x in signed:
            mine.setdefault(roots.get(x, x), set()).add(x % (1 << 64))
        theirs = {}
        for x in fps:
            theirs.setdefault(want[x], set()).add(x)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_keep_one(spark):
    wide = clashing(spark)
    kept = simhash.keep_one(wide)
    assert kept.columns == wide.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert "2" not in ids and ids.count("1") == 1 and "None" in ids
    assert simhash.keep_one(documents(spark, [])).count() == 0
