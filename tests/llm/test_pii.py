import hashlib
import re

import pytest

from nitscope.llm import pii
from nitscope.llm.queries import op4_pii
from tests.llm.data import ROWS, clashing, documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    out = []
    for order, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return sorted(out)


TEXTS = [
    "a@b.c_d@e.f x..y@-.- %@q.r. a@b a@b.c.@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.01.1.9 1.2.3 999999999999999999999999.1.1.1",
    "4111 1111-1111 1111, 41111111111111112 4111111111111111 0000000000000000 4111  1111",
    "+1 (212) 555-0100 +12 +1-2-3-4-5-6-7-8-9-0-1 ++49 30 123456789 +1234567890123456",
    "é𝒳 a@b.cd 𝒳10.0.0.1",
    "1" * 20_000,
    "a" * 50_000 + "@",
    "1 " * 10_000,
]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *(r[1] for r in ROWS)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find(df, []).collect():
        assert [tuple(s) for s in r.spans] == plain(r.text), r.text[:80] if r.text else r.text


def test_query_on_real_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_pii(spark, sf).collect():
        want = plain(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [getattr(r, f"n_{k}") for k in PLAIN] == [sum(w[3] == k for w in want) for k in PLAIN]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, f"Some words here and Reply-To: user{i}@mail{i % 7}.example.org then the {i} more of them") for i in range(60)]
    rows += [(100 + i, f"Another account: {hashlib.md5(str(i).encode()).hexdigest()} and the end") for i in range(40)]
    rows += [(200 + i, f"plain text of the year {1900 + i} in the town") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_find_unseen_identifiers(spark, learned):
    patterns = pii.learn_patterns(learned)
    assert "reply-to:" in patterns and "account:" in patterns
    assert not any(p.split()[-1] in ("the", "year", "of", "in") for p in patterns)
    odd = spark.createDataFrame([(1, 'é account: "AB-12-99x", ok'), (2, "in the year 123456 of"), (3, "Reply-To: a@b.cd")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in pii.find(odd, patterns).collect()}
    assert got == {1: [("id", "AB-12-99x")], 2: [], 3: [("email", "a@b.cd")]}
    assert [r.text for r in pii.mask(odd, patterns).orderBy("doc_id").collect()] == ['é account: "[ID]", ok', "in the year 123456 of", "Reply-To: [EMAIL]"]


def test_empty_and_clashing(spark):
    none = documents(spark, [])
    assert pii.learn_patterns(none) == [] and pii.mask(none, []).count() == 0
    wide = clashing(spark)
    masked = pii.mask(wide, pii.learn_patterns(wide))
    assert masked.columns == wide.columns and masked.count() == len(ROWS)
    assert "[PHONE]" in masked.where("doc_id = 13").first().text
