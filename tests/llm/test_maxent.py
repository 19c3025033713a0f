import math
import time
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from nitscope.llm import maxent
from nitscope.llm.queries import op2_maxent
from tests.llm.data import ROWS, clashing, documents


def base_scores(rows, training):
    tok = lambda t: maxent.words_of(t) + [b""]
    c = Counter(w for t in training for w in tok(t))
    n, v = sum(c.values()), len(c)
    return [(len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t))) for t in rows]


@pytest.mark.parametrize("counted", [500_000, 1100])
def test_base_scores_match_brute_force_and_model_is_better(spark, monkeypatch, counted):
    monkeypatch.setattr(maxent, "COUNTED", counted)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_maxent(spark, sf).collect()
    want = dict(zip(texts, base_scores(texts.values(), [texts[r.doc_id] for r in got if not r.held_out]), strict=True))
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3])
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = maxent.new_model(np.arange(50, 0, -1.0), np.arange(maxent.VOCAB), np.ones(maxent.RARE), 5)
    for k in model:
        if "bias" not in k:
            model[k] = rng.normal(0, 0.3, model[k].shape).astype(np.float32)
    codes = np.array([*range(50), *range(maxent.VOCAB + maxent.CLASSES, maxent.VOCAB + maxent.N_CLASSES)])
    for before, skip in ((3, 9), (maxent.CONTEXTS - 1, maxent.CONTEXTS - 1)):
        lp = maxent.log_probs(model, codes, np.full(len(codes), before), np.full(len(codes), skip))
        assert np.exp(lp).sum() == pytest.approx(1, abs=1e-4)


def test_steps_lower_the_loss():
    rng = np.random.default_rng(1)
    model = maxent.new_model(np.full(maxent.VOCAB, 10.0), np.arange(maxent.VOCAB), np.ones(maxent.RARE), 5)
    seen = {k: np.zeros_like(v) for k, v in model.items() if "bias" not in k}
    before = rng.integers(0, 40, 4000)
    code = (before * 13) % maxent.VOCAB
    first = -maxent.log_probs(model, code, before, before).mean()
    for _ in range(20):
        maxent.steps(model, seen, code, before, before)
    assert -maxent.log_probs(model, code, before, before).mean() < first - 1


def test_defined_cases(spark):
    docs = documents(spark)
    fitted = maxent.train(docs.select("text"))
    got = maxent.score(docs.select("doc_id", "text"), fitted).collect()
    want = base_scores([r[1] for r in ROWS], [r[1] for r in ROWS])
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == sorted(w[:3] for w in want)
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(w[3] for w in want))
    assert all(np.isfinite(r.score) for r in got)
    assert maxent.score(clashing(spark), fitted).count() == len(ROWS)
    none = maxent.train(docs.limit(0).select("text"))
    assert {r.base_score for r in maxent.score(docs, none).collect()} == {0.0}
    assert maxent.score(docs.limit(0), fitted).count() == 0


def test_every_position_of_every_text_is_learned(spark):
    words = [f"w{i}".encode() for i in range(200)]
    vocab = {w: i for i, w in enumerate(words)}
    model = maxent.new_model(np.ones(200), np.arange(maxent.VOCAB), np.ones(maxent.RARE), 5)
    rows = [(f"w{i} w{i + 100}",) for i in range(100)]
    after = maxent.train_round(spark.createDataFrame(rows, "text string").coalesce(1), model, vocab)
    assert np.abs(after["before"][:200]).max(axis=1).min() > 0


def test_neighbours_are_counted_over_all_whole_texts(spark):
    rows = [("a b",)] * 2500 + [("x " * 3000 + "b a",)]
    near = maxent.count_neighbours(spark.createDataFrame(rows, "text string"), [b"a", b"b"])
    other, after = maxent.NEAR, maxent.NEAR + 1
    assert (near[0, 1], near[1, 0], near[1, after], near[0, after + 1], near[1, after + other]) == (2500, 1, 2500, 1, 1)
    assert near.sum() == 2 * 2500 + 3


def test_every_word_is_read_as_split_by_hand(monkeypatch):
    """Odd characters beside and within words, nulls, empty texts, all string types, and cuts after any text."""
    odd = [f"{chr(i)}A{chr(i)}bÇ{chr(i)}{chr(i)}z{chr(i)}" for i in range(0x300)]
    texts = ["", None, *(r[1] for r in ROWS), " ", "😀 𝒳", "\x85a\xa0b\u2003c", *odd, None, ""]
    want, known = [maxent.words_of(t) for t in texts], [b"a", b"the", "ç".encode(), "😀".encode()]
    monkeypatch.setattr(maxent, "words_of", None)
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(["x y", *texts], kind)], names=["text"]).slice(1)
        for size, tokens in ((1, 1), (50, 7), (1 << 23, 300), (1 << 23, 1 << 20)):
            monkeypatch.setattr(maxent, "BYTES", size)
            held = list(maxent._held(iter([batch, batch.slice(0, 0)]), 0, pa.array(known, pa.binary()), tokens))
            assert [t for part, *_ in held for t in part.column(0).to_pylist()] == texts
            assert [n for *_, sizes in held for n in sizes] == [len(w) for w in want]
            assert [w for _, words, *_ in held for w in words.to_pylist()] == [w for t in want for w in t]
            assert [known[i] if i >= 0 else None for *_, found, _ in held for i in found] == [w if w in known else None for t in want for w in t]
            assert all(len(sizes) == part.num_rows and len(words) == len(found) == sizes.sum() for part, words, found, sizes in held)
    assert list(maxent._held(iter([batch]), 0, pa.array([], pa.binary()), 1 << 20))[0][2].max() == -1


def test_reading_costs_less_than_one_look_up_a_word():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").combine_chunks().slice(0, 1500)
    batch = pa.RecordBatch.from_arrays([texts if isinstance(texts, pa.Array) else texts.chunk(0)], names=["text"])
    plain = [maxent.words_of(t) for t in batch.column(0).to_pylist()]
    counts = Counter(w for t in plain for w in t)
    words = [w for w, _ in counts.most_common(maxent.COUNTED)]
    read, ids = maxent.Tokens({w: i for i, w in enumerate(words[: maxent.VOCAB])}, words[maxent.VOCAB :]), {w: i for i, w in enumerate(words)}

    def by_arrow():
        return sum(len(maxent.Positions(read, *held).code) for _, *held in maxent._held(iter([batch]), 0, read.words, 4 * maxent.STEP))

    def by_hand():
        n = 0
        for i in range(batch.num_rows):
            t = maxent.words_of(batch.column(0)[i].as_py())
            n += len(np.fromiter(map(ids.get, t, repeat(-1)), np.int64, len(t))) + 1
        return n

    def least(f):
        times = []
        for _ in range(3):
            start = time.process_time()
            assert f() == sum(map(len, plain)) + len(plain)
            times.append(time.process_time() - start)
        return min(times)

    assert least(by_arrow) < 0.8 * least(by_hand)
