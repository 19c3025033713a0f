import random

import xxhash

import corpus_pipeline
from nitscope.llm import minhash, simhash
from tests.llm.data import ROWS, clashing, documents


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups_of(sets):
    sets = list(sets)
    root = {s: s for s in sets}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(a)] = find(b)
    return {s: find(s) for s in sets}


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def texts():
    rnd = random.Random(5)
    out = []
    for g, copies in ((0, 150), (1, 40), (2, 6), (3, 3)):
        base = [f"w{g}x{rnd.randrange(10**6)}" for _ in range(120)]
        out += [" ".join(base)] + [edited(rnd, base, rnd.randint(1, 5)) for _ in range(copies)]
    return out


def test_components_match_brute_force_in_small_and_large_buckets(spark):
    given = texts() + [r[1] for r in ROWS[3:6]] + ["one two", "ONE  two", "one two three"]
    want = groups_of({shingles(t) for t in given})
    theirs = {}
    for i, t in enumerate(given):
        theirs.setdefault(want[shingles(t)], set()).add(i)
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for bucket in (1, 8, 1000):
        mine = {}
        for r in minhash.near_copies(df, bucket=bucket).collect():
            mine.setdefault(r.component, set()).add(r.key)
        assert all(min(v) == k for k, v in mine.items())
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_stage_removes_copies_with_changed_words(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    other = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(200))
    rows = [(1, " ".join(base), "en", "a", 1), (2, edited(rnd, base, 3), "en", "a", 1), (3, other, "en", "a", 1), (4, edited(rnd, base, 40), "en", "a", 1)]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), None).collect()) == [1, 3, 4]
    wide = clashing(spark)
    kept = corpus_pipeline.near_dedup(spark, wide, None)
    assert kept.columns == wide.columns and sorted(str(r.doc_id) for r in kept.collect()).count("1") == 1


def test_fingerprints_propose_all_pairs_within_their_distance(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    given = [" ".join(base[i : i + 300]) for i in (0, 1, 2, 50)] + [edited(rnd, base, n) for n in (1, 1, 2, 2, 3, 40)] + ["", "one two", "one two three"]
    table = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    rows = minhash._sets(table, "text", "doc_id").collect()
    for r in rows:
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(given[r.key])]
        assert r.fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))
    want = set()
    for a in rows:
        for b in rows:
            if a.id < b.id and min(a.size, b.size) >= 0.8 * max(a.size, b.size) > 0 and ((a.fp ^ b.fp) % 2**64).bit_count() <= 3:
                want.add((a.id, b.id))
    vertices = spark.createDataFrame([(r.id, r.size, r.fp) for r in rows], "id long, size int, fp long")
    close, crowded = minhash.by_fingerprints(vertices)
    assert {tuple(r) for r in close.collect()} == want and len(want) > 3 and crowded.count() == 0
    # What stands in a larger filing is named, so that the rare shingles settle it.
    close, crowded = minhash.by_fingerprints(vertices, 1)
    assert close.count() == 0 and {r.id for r in crowded.collect()} >= {x for pair in want for x in pair}


def test_filings_of_five_blocks_meet_at_three_bits(spark):
    rnd = random.Random(10)
    one = rnd.getrandbits(64)
    others = [one ^ sum(1 << b for b in rnd.sample(range(64), 3)) for _ in range(200)]
    signed = lambda x: x - 2**64 if x >> 63 else x
    filed = {}
    for r in simhash.filings(spark.createDataFrame([(signed(x),) for x in [one, *others]], "fp long"), 5).collect():
        filed.setdefault(r.fp % 2**64, set()).add((r.t, r.k))
    assert all(len(filed[x]) == 10 and filed[x] & filed[one] for x in others)
