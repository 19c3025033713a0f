import re

from nitscope.llm import quality
from tests.llm.data import ROWS, clashing, documents


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    cover = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_counts_match_brute_force(spark):
    docs = documents(spark)
    got = quality.judge(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(ROWS)
    for text, *counts, failed, kept in got:
        want = plain(text)
        assert tuple(counts) == want
        assert failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (failed and kept)


def test_keeps_prose_and_drops_symbols(spark):
    clean = "The house of the old man is in the north and it was not far from a river that is on the map . " * 1
    rows = [(1, clean, "en", "a", 1), (2, "gr@x### zut%%% wob*** " * 20, "en", "a", 1)]
    assert [r.doc_id for r in quality.keep_good(documents(spark, rows)).collect()] == [1]


def test_other_columns_and_empty_table(spark):
    wide = clashing(spark)
    assert quality.keep_good(wide).columns == wide.columns
    assert quality.keep_good(documents(spark, [])).count() == 0
