"""The queries without a SQL twin against plain Python, on a made table with nulls, repeated ids, ties and long texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

import corpus_pipeline
from nitscope.llm import chat, decontaminate, html, langid, maxent, minhash, packing, pii, quality, queries, simhash, tokens, urls
from tests.llm import test_decontaminate, test_html, test_maxent, test_minhash, test_pii, test_quality, test_simhash, test_urls
from tests.llm.data import ROWS, SCHEMA, WORDS, clashing, documents, prose

RND = random.Random(12)


def words(n, prefix):
    return [f"{prefix}{RND.randrange(10**5)}" for _ in range(n)]


def essay(n):
    """Words that the quality rules keep."""
    return [RND.choice(("the", "of", "and")) if RND.random() < 0.2 else "".join(RND.choice("abdeiklmnorstu") for _ in range(RND.randint(3, 8))) for _ in range(n)]


BASE = essay(150)
FRENCH = "le la une et dans pour avec sur est qui les des mais rivière maison jardin petit grand soleil".split()
ITEM = "which river runs past the old stone mill and how far from the mill is the sea if a boat takes two days"
MADE = [
    *ROWS,
    *((100 + i, test_minhash.edited(RND, BASE, n), "en", "d", 1) for i, n in enumerate((0, 0, 1, 2, 60))),
    *((200 + i, " ".join(FRENCH[(i * k) % len(FRENCH)] for k in range(1, 60)), "fr", "e", 1) for i in range(12)),
    *((300 + i, prose(20 + i, 80 + i), "en", "f", 1) for i in range(12)),
    (400, prose(5, 50) + " " + ITEM.upper() + " " + prose(6, 50), "en", "f", 1),
    (401, prose(7, 50) + " " + test_decontaminate.damage(RND, ITEM, 4) + " " + prose(8, 50), "en", "f", 1),
    (5, " ".join(essay(90)), "en", "f", 1),
    *((500 + i, " ".join(essay(60 + i)), "en", "g", 1) for i in range(10)),
    (None, " ".join(essay(70)), "en", "g", 1),
    (510, " ".join([*essay(30), "write", "to", "a.b@c-d.example.org,", "now", *essay(30), "call +1 (212) 555-0100", *essay(9)]), "en", "g", 1),
    (511, " ".join(essay(60)) + " " + ITEM + " " + " ".join(essay(40)), "en", "g", 1),
    (512, " ".join(essay(60)) + " " + test_decontaminate.damage(RND, ITEM, 4) + " " + " ".join(essay(40)), "en", "g", 1),
    (513, " ".join(essay(6000)), "en", "g", 1),
]
ITEMS = [(7, ITEM), (8, None), (9, ""), (10, "some text that nobody has written into any of the documents"), (7, ITEM)]
PAGES = [(i, c[0], None) for i, c in enumerate(test_urls.CASES)] + [(50, "https://best-casino.example.net/en/1", test_html.PAGE.format("")), (51, "https://x.net/" + "é" * 5000, "<p>a</p>"), (51, "https://x.net/" + "é" * 5000, "<p>a</p>")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("made"))
    spark.createDataFrame(MADE, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def fold(key, parts):
    return None if key is None else zlib.crc32(str(key).encode()) % parts


def test_op1_is_the_smallest_encoding(spark, folder):
    train = spark.createDataFrame([r for r in MADE if fold(r[0], 4) != 2], SCHEMA)
    dictionaries = langid.fit(train)
    assert set(dictionaries) == {"en", "fr", "xx"}

    def sizes(text):
        data = re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode()
        assert data == langid.normal(text)
        out = {}
        for k, d in dictionaries.items():
            how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(d), min_match=langid.SHORTEST_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
            coder = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            out[k] = sum(len(coder.compress(data[i : i + langid.CHUNK])) for i in range(0, len(data), langid.CHUNK))
        return out

    want = []
    for key, text, *_ in MADE:
        found = sizes(text) if text and re.search(r"[^\W\d_]", text) else {"und": 0}
        want.append((str(key), fold(key, 4) == 2, min(sorted(found), key=found.get)))
    got = queries.op1_langid(spark, folder).collect()
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred) for r in got) == sorted(want) and all(0 <= r.score <= 1 for r in got)


def test_op2_scores_are_those_of_the_model(spark, folder):
    """The sum of plain probabilities, position by position, from the weights that training gave."""
    docs = spark.createDataFrame(MADE, SCHEMA)
    fitted = maxent.train(docs.select("text"))
    m, vocab = fitted["model"], fitted["vocab"]
    named = [w for w in fitted["known"] if w not in vocab]
    counts = Counter(w for r in MADE for w in maxent.words_of(r[1]))
    context = {w: p for w, p in vocab.items()} | {w: maxent.CONTEXTS + i for i, w in enumerate(named[: fitted["names"]])}
    byte = lambda w: (w[-1] * 31 + w[0] * 7) & 511

    def softmax(z):
        e = np.exp(z.astype(np.float64) - z.max())
        return e / e.sum()

    def score(text):
        seq, total = maxent.words_of(text), 0.0
        ids = [context.get(w, maxent.VOCAB + byte(w)) for w in seq]
        outside = maxent.CONTEXTS - 1
        for i in range(len(seq) + 1):
            a, b = (ids[i - 1] if i else outside), (ids[i - 2] if i > 1 else outside)
            pair = ((a * 7919 + b * 104729) >> 3) % len(m["pair"])
            p = softmax(m["before"][a] + m["skip"][b] + m["pair"][pair] + m["bias"][0])
            if i == len(seq):
                total += math.log10(p[maxent.END_CLASS])
            elif seq[i] in vocab:
                c, slot = divmod(vocab[seq[i]], maxent.SLOTS)
                inner = softmax(m["in_before"][a % maxent.ROWS * maxent.CLASSES + c] + m["in_skip"][b % maxent.ROWS * maxent.CLASSES + c] + m["in_bias"][c])
                total += math.log10(p[c]) + math.log10(inner[slot])
            else:
                g = byte(seq[i]) % maxent.RARE
                total += math.log10(p[maxent.CLASSES + g]) + math.log10(counts[seq[i]] + maxent.ALPHA) - fitted["rare_log"][g]
        return total

    rows = [r for r in MADE if r[1] is None or len(r[1]) < 3000]
    got = maxent.score(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"), fitted).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(score(r[1]) for r in rows), rel=1e-4)


def test_op3_hexadecimal_components(spark, folder):
    want = test_simhash.groups_of({test_simhash.plain(r[1]) for r in MADE})
    least = {}
    for r in MADE:
        g = want[test_simhash.plain(r[1])]
        least[g] = min((x for x in (least.get(g), r[0]) if x is not None), default=None)
    expected = sorted((str(r[0]), f"{test_simhash.plain(r[1]):016x}", least[want[test_simhash.plain(r[1])]]) for r in MADE)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, folder).collect()) == expected


def test_op5_verdicts(spark, folder):
    model = urls.train(urls.labelled_urls(spark))
    rules = {h + p: (v, h, p) for v, h, p in urls.RULES}

    def verdict(url):
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [k for k, (_, h, p) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            best = max(fits, key=len)
            return host, path, best, rules[best][0]
        buckets = set()
        for f, (s, mark) in enumerate(((host, "^"), (path, "$"))):
            s = mark + s + mark
            for n in urls.GRAMS:
                for i in range(len(s) - n + 1):
                    h = xxhash.xxh64_intdigest(s[i : i + n].encode(), 42)
                    buckets.add((h - (1 << 64) * (h >> 63)) % urls.BUCKETS + f * urls.BUCKETS)
        z = model["bias"] + sum(model["w"][b] for b in buckets) / math.sqrt(max(len(buckets), 1))
        return host, path, None, "block" if z >= 0 else "allow"

    got = queries.op5_urls(spark, folder).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got if r.rule) == sorted(x for p, u, _ in PAGES if (x := (p, *verdict(u)))[3])
    assert sorted((r.page_id, r.host, r.path, r.verdict) for r in got if not r.rule) == sorted((x[0], x[1], x[2], x[4]) for p, u, _ in PAGES if not (x := (p, *verdict(u)))[3])


def leaks(text):
    """Items with a unit that some stretch of the text is near enough to."""
    body = decontaminate.normal(text)
    return {k for k, t in ITEMS for u in decontaminate.units(decontaminate.normal(t)) if body and test_decontaminate.edits_in(u, body) <= decontaminate.edits_allowed(len(u))}


def test_op6_finds_what_brute_force_finds(spark, folder):
    short = [r for r in MADE if r[1] is None or len(r[1]) < 5000]
    want = sorted((str(r[0]), k) for r in short for k in leaks(r[1]))
    got = queries.op6_decontaminate(spark, folder).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == want and len(want) >= 2
    whole = next(r for r in got if r.doc_id == 400)
    text = next(r[1] for r in MADE if r[0] == 400)
    assert text[whole.start : whole.end].strip() == ITEM.upper()


def test_op6_places_in_texts_whose_letters_grow(spark):
    rows = [(1, "İİİİ İİ İİİ " + ITEM.upper() + " end", "en", "a", 1)]
    r = decontaminate.find_leaks(documents(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert (r.start, r.end) == (12, 12 + len(ITEM))


def test_op6_texts_and_items_longer_than_what_is_held(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SCAN", 700)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 900)
    long_item = " ".join(words(400, "q"))
    rows = [(i, " ".join(words(n, "v")) + f" {part} " + " ".join(words(n, "v")), "en", "a", 1) for i, (n, part) in enumerate(((100, ITEM), (300, long_item[1000:1200]), (0, long_item[-150:]), (250, "nothing")))]
    items = spark.createDataFrame([(1, ITEM), (2, long_item)], "item_id long, text string")
    assert sorted({(r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents(spark, rows), items).collect()}) == [(0, 1), (1, 2), (2, 2)]
    assert [r.doc_id for r in decontaminate.keep_clean(documents(spark, rows), items).collect()] == [3]


def pieces_of(rows):
    out = []
    for key, text, *_ in rows:
        ids = np.array([*tokens._plain("byte_bpe_50k").encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(str(key), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))]
    return out


def check_packing(got):
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in rows.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert len(rows) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 1


def test_op8_pieces_and_places(spark, folder):
    got = queries.op8_packing(spark, folder).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces_of(MADE))
    check_packing(got)


def test_op8_ids_are_those_of_the_tokenizers_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rnd = random.Random(3)
    odd = ["".join(chr(rnd.choice((rnd.randrange(32, 0x250), rnd.randrange(0x300, 0xD7FF), rnd.randrange(0x10000, 0x1FFFF), 32, 10, 39))) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    odd += ["'s 'LL don't I'VE", "  \n\n \t x", "  　a", "0123456789 ²³½", "<|endoftext|> a <|endoftext|>", "é́", "\r\n\r\n"]
    plain = tokens._plain("byte_bpe_50k")
    for t in [*texts, *odd]:
        assert list(tokens.encode(t or "")) == plain.encode(t or "", add_special_tokens=False).ids, t


def test_op8_one_document_in_many_groups(spark, monkeypatch):
    """A third of all pieces of one id, or of none, is dealt as evenly as any."""
    rows = [(None if i % 2 else 7, 0, 0, 100 + i % 50, i % 3) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    dealt = packing._pack_groups(df, 10, 0, df.columns, 2048).groupBy("grp").count().collect()
    assert len(dealt) == 10 and max(r["count"] for r in dealt) < 1000


def rules_keep(text):
    n, chars, symbols, dup_lines, repeated = test_quality.plain(text)
    seq = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if n < 10 or 100 * repeated > 20 * n:
        return False
    stop = sum(w.lower() in set(quality.STOP_WORDS.split()) for w in seq)
    again = sum(a == b for a, b in zip(seq, seq[1:], strict=False))
    return 2 <= chars / n <= 15 and symbols / n <= 0.2 and (n < 40 or stop / n >= 0.06) and again / n <= 0.25 and (n < 40 or dup_lines / len(lines) <= 0.5)


def test_pipeline_is_its_stages_by_brute_force(spark, folder):
    rows = [r for r in MADE if rules_keep(r[1])]
    assert len(rows) < len(MADE)
    groups = test_minhash.groups_of({test_minhash.shingles(r[1]) for r in rows})
    first = {}
    for r in rows:
        g = groups[test_minhash.shingles(r[1])]
        if g not in first or (r[0] is None, r[0] or 0) < (first[g][0] is None, first[g][0] or 0):
            first[g] = r
    assert len(first) < len(rows)
    clean = [r for r in first.values() if len(r[1]) > 5000 or not leaks(r[1])]
    assert len(clean) == len(first) - 2 and len(clean) > 10

    def masked(text):
        out, at = "", 0
        for a, _, b, kind in test_pii.plain(text):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        return out + text[at:]

    want = pieces_of([(r[0], masked(r[1])) for r in clean])
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_packing(got)


def test_keep_one_judges_rows_and_not_ids(spark):
    a, b = prose(1, 40), " ".join(words(60, "z"))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (3, b, "fr", "s", 1), (5, a, "en", "s", 1), (None, a, "en", "s", 1), (None, None, "en", "s", 1), (None, None, "de", "s", 1)]
    for find in (simhash.near_duplicates, minhash.near_copies):
        kept = simhash.keep_one(documents(spark, rows), find).collect()
        assert sorted((str(r.doc_id), r.text is None, r.text == a) for r in kept) == [("3", False, False), ("5", False, True), ("None", True, False)]


# ---- odd tables through every operator


def wide(spark):
    """Columns with the names that operators add themselves."""
    from pyspark.sql import functions as F

    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "lang_pred", "narrow", "n_seen", "strange", "token", "main_text", "n_symbols", "item_id", "start", "end", "edits", "units", "__row", "sequence_id", "offset", "piece", "ids", "n", "id", "value", "size", "root")
    return clashing(spark).withColumns({n: F.lit(n) for n in names})


def test_names_of_added_columns_may_be_there(spark):
    docs, n = wide(spark), len(ROWS)
    scored = maxent.score(docs, maxent.train(docs))
    assert scored.count() == n and scored.columns.count("n_tokens") == 1 and "seq" in scored.columns and dict(scored.dtypes)["n_tokens"] == "bigint"
    assert langid.identify(docs, langid.fit(docs)).count() == n
    assert html.extract(docs, "text").count() == n
    assert pii.find(docs, ["x"], column="spans").count() == n and pii.mask(docs, ["x"]).columns == docs.columns
    assert quality.judge(docs).count() == n and urls.judge(docs, {"w": [0.0] * 2 * urls.BUCKETS, "bias": 0.0}, "text").count() == n
    items = spark.createDataFrame(ITEMS, "doc_id long, text string")
    assert decontaminate.find_leaks(docs, items, item_id="doc_id").columns[:2] == ["doc_id", "item_doc_id"]
    assert packing.packed_documents(docs).count() >= n
    assert simhash.near_duplicates(docs).count() == n and minhash.near_copies(docs).count() == n
    from pyspark.sql import functions as F

    turns = docs.select("*", F.lit(1).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"))
    assert chat.read_back(chat.format_chats(turns)).first().n_turns == n


def test_stages_take_odd_tables(spark, folder):
    docs = wide(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and 0 < got.count() <= len(ROWS), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(ROWS)


def test_keys_of_other_types(spark):
    rows = [("a", ITEM), ("b", None), (None, "text")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    items = spark.createDataFrame([(1.5, ITEM)], "item_id double, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()] == [("a", 1.5)]


def test_patterns_as_a_table_give_the_same(spark):
    rows = [(i, f"Some words here and Reply-To: user{i}@mail{i % 7}.example.org then more") for i in range(30)] + [(90, "é reply-to: (AB-12-99x), and Reply-To: 77-x-99."), (91, None), (90, "é reply-to: (AB-12-99x), and Reply-To: 77-x-99.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, table = pii.learn_patterns(docs), pii.learn_patterns(docs, inline=0)
    assert "reply-to:" in names and sorted(r.pattern for r in table.collect()) == names
    want = sorted((r.doc_id, str(r.spans)) for r in pii.find(docs, names).collect())
    assert sorted((r.doc_id, str(r.spans)) for r in pii.find(docs, table).collect()) == want
    found = next(r for r in pii.find(docs, names).collect() if r.doc_id == 90)
    assert [found.text[s.start : s.end] for s in found.spans] == ["AB-12-99x", "77-x-99"]


def test_phones_and_found_identifiers_lead_to_patterns(spark):
    """Telephone numbers seed `tel`; what stands behind it is believed, and leads to `ref` before the same things."""
    rows = [(i, f"please tel +1 (212) 555-01{i:02d} or ask") for i in range(40)]
    rows += [(100 + i, f"again tel QX-{i:04d}-77 for it") for i in range(12)]
    rows += [(200 + i, f"as ref QX-{i:04d}-77 in the file") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = pii.learn_patterns(docs)
    assert "tel" in names and "ref" in names and "the" not in names
    odd = spark.createDataFrame([(1, "see ref ZZ-9-zz-0 there")], "doc_id long, text string")
    r = pii.find(odd, names).first()
    assert [r.text[s.start : s.end] for s in r.spans] == ["ZZ-9-zz-0"]


def test_places_over_several_levels(spark):
    text = " ".join(f"+1 (212) 555-0{i:03d} x" for i in range(300))
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), []).first()
    assert [tuple(s) for s in r.spans] == test_pii.plain(text)


def test_counters_hand_on_within_a_batch(spark):
    """One batch with many more different tokens than a task may hold."""
    rows = [(" ".join(f"t{i}x{k}" for k in range(50)),) for i in range(400)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    counted = {flush: {r.token: r.n for r in maxent.count_tokens(df, flush=flush).collect()} for flush in (60, 10**6)}
    assert counted[60] == counted[10**6] and len(counted[60]) == 20_001 and counted[60][""] == 400
    held = []
    seen = maxent.Counter

    class Watched(Counter):
        def update(self, *a):
            super().update(*a)
            held.append(len(self))

    maxent.Counter = Watched
    try:
        import pyarrow as pa

        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows])], names=["text"])]

        class Frame:
            def select(self, *_):
                return self

            def mapInArrow(self, run, _):
                self.out = list(run(iter(batches)))
                return self

            def __getattr__(self, _):
                return lambda *a: self

        maxent.count_tokens(Frame(), flush=60)
    finally:
        maxent.Counter = seen
    assert max(held) <= 60 + 51


def test_base_scores_of_the_query(spark, folder):
    got = queries.op2_maxent(spark, folder).collect()
    train = [r[1] for r in MADE if fold(r[0], 10) != 0]
    want = test_maxent.base_scores([r[1] for r in MADE], train)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == sorted(w[:3] for w in want)
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(w[3] for w in want))
    assert WORDS
