"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Every token has a class, and its probability is P(class | two tokens before) * P(token | class, two tokens before).
The most frequent words (`VOCAB`) lie in `CLASSES` classes of equal size; all other words in `RARE` classes by their first
and last byte, within which their corpus counts decide; the end of a text is a class of its own. Features are the token
before (n-gram), the one before that (skip) and both hashed together. Words act as contexts by name as far as they are
among the first of the corpus, else by their hashed bytes; the number of those names and of the hashed pairs grow with the
cube root of the training tokens (`grown`), and the counts grow with the corpus itself.

Counts of tokens and of neighbours cover all training texts: per-task counters are summed in one shuffle each. Training runs
in rounds, each over its own part of the training documents: every task makes gradient steps from the round's model over
every position of its documents, and the results are averaged block by block in two steps, weighted by positions; the
weights, and so `score`, depend in their last digits on how rows are dealt to tasks. Scoring is one pass in numpy batches;
only words that are not among the `COUNTED` most frequent go through a shuffle to meet their counts, so no word that many
documents share is ever joined.

Defined cases: a null or empty text is the end token alone; a null doc_id is scored and in the training part; repeated
rows are scored, and learned from, as often as they stand there; words of equal counts are taken in the order of their
bytes; very long texts are scored whole, `STEP` positions at a time; columns with the names of the added ones are
replaced; an empty table gives an empty table, and with no training text every base score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitscope.runtime import materialize, unused

SLOTS, CLASSES, RARE = 32, 32, 8
VOCAB = SLOTS * CLASSES
#: As many of the most frequent words have their counts with every task (fewer, where words of equal counts would go beyond).
COUNTED = 200_000
BYTES_IDS = 512
CONTEXTS = VOCAB + BYTES_IDS + 1
PAIRS, ROWS = 4096, 256
END_CLASS = CLASSES + RARE
N_CLASSES = CLASSES + RARE + 1
ROUNDS, STEP, RATE = 2, 4096, 0.15
#: The most frequent words that count by name as neighbours when words are sorted into classes.
NEAR = 96
ALPHA = 0.1
#: Training tokens at which the model has its least size, and the growth beyond it.
LEAST_TOKENS, GROWTH = 1 << 22, 1 / 3
#: Different tokens that a task counts, and documents that it reads, before it hands on what it has.
FLUSH, HELD = 100_000, 500
#: Words whose neighbours are counted at a time.
CELLS = 1 << 17
#: Bytes of text whose words are looked up at a time: each time the table of the words is built anew.
BYTES = 1 << 23
BLOCK = 1 << 14
NEVER = -1e9


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then maximal runs without space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "replace").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (see `words_of`) of all texts one after the other, as bytes, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    # space before the first word, or after the last, leaves an empty one
    real = pc.binary_length(words).to_numpy() > 0
    before = np.concatenate(([0], np.cumsum(real)))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
    sizes = np.diff(before[ends], prepend=0)
    # cast now, when nothing is a slice: casts of slices of large strings read from wrong places
    return (words if real.all() else words.filter(pa.array(real))).cast(pa.binary()), sizes


def _slices(batches: Iterator[pa.RecordBatch], n: int = HELD) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, n) for b in batches for i in range(0, b.num_rows, n))


def grown(least: int, tokens: int) -> int:
    """A power of two from `least` on that grows with the cube root of the number of tokens."""
    return least << max(0, int(np.log2(max(tokens, 1) / LEAST_TOKENS) * GROWTH))


# ---- counts


def count_tokens(texts: DataFrame, text: str = "text", flush: int = FLUSH) -> DataFrame:
    """(token, n) over all rows; the end token is the empty string. A task holds at most `flush` different tokens and
    those of one text more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], names=["token", "n"])

        count: Counter[bytes] = Counter()
        for b in _slices(batches):
            for i in range(b.num_rows):
                count.update(words_of(b.column(0)[i].as_py()))
                count[b""] += 1
                if len(count) > flush:
                    yield out()
                    count.clear()
        if count:
            yield out()

    return texts.select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


# ---- classes


def count_neighbours(texts: DataFrame, vocab: list[bytes], text: str = "text") -> np.ndarray:
    """(VOCAB, 2 * (NEAR + 1)): how often each word stands before and after each of the first `NEAR`, or any other word,
    over all texts. Tasks count into one table each, whose cells are summed in one shuffle; no more cells than those of
    one table come to the driver."""
    width = 2 * (NEAR + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros(VOCAB * width, np.int64)
        for _, _, found, sizes in _held(batches, 0, pa.array(vocab, pa.binary()), CELLS):
            inner = np.ones(len(found) + len(sizes), bool)
            inner[np.cumsum(sizes + 1) - 1] = False
            seq = np.full(len(inner), -1, np.int32)
            seq[inner] = found
            edge = np.where((seq >= 0) & (seq < NEAR), seq, NEAR)
            x, y = np.flatnonzero((seq[:-1] >= 0) & inner[1:]), np.flatnonzero((seq[1:] >= 0) & inner[:-1])
            near += np.bincount(np.concatenate((seq[x] * width + edge[x + 1], seq[y + 1] * width + NEAR + 1 + edge[y])), minlength=len(near))
        at = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(near[at])], names=["cell", "n"])

    near = np.zeros(VOCAB * width)
    for r in texts.select(text).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        near[r["cell"]] = r["n"]
    return near.reshape(VOCAB, width)


def sort_into_classes(near: np.ndarray) -> np.ndarray:
    """Place (class * SLOTS + slot) of each word: words are halved again and again along the main direction of their
    neighbours' counts, so that every class has the same number of places."""
    near = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    groups = [np.arange(VOCAB)]
    while len(groups) < CLASSES:
        halves = []
        for g in groups:
            x = near[g] - near[g].mean(axis=0)
            d = np.linalg.svd(x, full_matrices=False)[2][0]
            d = d * np.sign(d[np.abs(d).argmax()] or 1)
            order = g[np.argsort(x @ d, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    place = np.empty(VOCAB, np.int64)
    for c, g in enumerate(groups):
        place[g] = c * SLOTS + np.arange(SLOTS)
    return place


# ---- model


def new_model(counts: np.ndarray, place: np.ndarray, rare_mass: np.ndarray, end: float, named: int = 0, pairs: int = PAIRS) -> dict:
    """Biases that give the unigram distribution; all other weights zero. Places without a word can't be chosen. `named`:
    words besides the vocabulary that are contexts by name."""
    inner = np.full(VOCAB, NEVER, np.float32)
    inner[place[: len(counts)]] = np.log(np.maximum(counts, 0.5))
    mass = np.zeros(N_CLASSES)
    np.add.at(mass, place[: len(counts)] // SLOTS, np.maximum(counts, 0.5))
    mass[CLASSES:END_CLASS], mass[END_CLASS] = rare_mass, max(end, 0.5)
    return {
        "bias": np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), NEVER).astype(np.float32)[None, :],
        "before": np.zeros((CONTEXTS + named, N_CLASSES), np.float32),
        "skip": np.zeros((CONTEXTS + named, N_CLASSES), np.float32),
        "pair": np.zeros((pairs, N_CLASSES), np.float32),
        "in_bias": inner.reshape(CLASSES, SLOTS),
        "in_before": np.zeros((ROWS * CLASSES, SLOTS), np.float32),
        "in_skip": np.zeros((ROWS * CLASSES, SLOTS), np.float32),
    }


class Tokens:
    """Turns texts into flat arrays of ids: place of the token (VOCAB + rare class, or the end), context ids.

    `vocab` has the places of its words; `named` are further words, of which the first `names` are contexts by name."""

    def __init__(self, vocab: dict[bytes, int], named: Sequence[bytes] = (), names: int = 0):
        self.words = pa.array([*vocab, *named], pa.binary())
        # one more, for the number -1 of unknown words, whose ids `read` puts in their places
        self.context = np.append(VOCAB + self.hashed(self.words, np.arange(len(self.words))), 0)
        self.code = self.rare_class(self.context)
        self.context[: len(vocab)] = self.code[: len(vocab)] = list(vocab.values())
        self.context[len(vocab) : len(vocab) + names] = CONTEXTS + np.arange(min(names, len(named)))

    @staticmethod
    def hashed(words: pa.Array, at: np.ndarray) -> np.ndarray:
        """A number under BYTES_IDS by the first and the last byte of the words at these places."""
        if not len(at):
            return np.zeros(0, np.int64)
        _, offsets, data = words.buffers()
        offsets, data = np.frombuffer(offsets, np.int32)[words.offset :], np.frombuffer(data, np.uint8)
        first, last = data[offsets[at]].astype(np.int64), data[offsets[at + 1] - 1].astype(np.int64)
        return (last * 31 + first * 7) & (BYTES_IDS - 1)

    @staticmethod
    def rare_class(context: np.ndarray) -> np.ndarray:
        return VOCAB + CLASSES + ((context - VOCAB) & (RARE - 1))

    def read(self, words: pa.Array, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, context) of each word, from its number among `self.words`, -1 where unknown. Codes: a place under VOCAB,
        or VOCAB + class."""
        code, context = self.code[found], self.context[found]
        at = np.flatnonzero(found < 0)
        context[at] = seen = VOCAB + self.hashed(words, at)
        code[at] = self.rare_class(seen)
        return code, context


class Positions:
    """The positions of some texts one after the other, each text's end included. `start` are the texts' first ones, `word`
    is where words stand; before a text's first word stands CONTEXTS - 1."""

    def __init__(self, read: Tokens, words: pa.Array, found: np.ndarray, sizes: np.ndarray):
        self.words, self.found, sizes = words, found, sizes + 1
        code, context = read.read(words, found)
        end = np.cumsum(sizes) - 1
        n = int(sizes.sum())
        self.start, self.sizes, self.word = end + 1 - sizes, sizes, np.ones(n, bool)
        self.word[end] = False
        self.code = np.full(n, VOCAB + END_CLASS)
        self.code[self.word] = code
        line = np.full(n + 2, CONTEXTS - 1)
        line[2:][self.word] = context
        self.before, self.skip = line[1:-1], line[:-2].copy()
        # before a text's first position stands the end of the text before, which is no context, and before that its last word
        self.skip[self.start] = CONTEXTS - 1

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        """The sum over each text of numbers that belong to words."""
        every = np.zeros(len(self.code), of_words.dtype)
        every[self.word] = of_words
        return np.add.reduceat(every, self.start)

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, len(self.code), STEP):
            yield self.code[a : a + STEP], self.before[a : a + STEP], self.skip[a : a + STEP]


def _held(batches: Iterator[pa.RecordBatch], column: int, known: pa.Array, tokens: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Slices of the batches with the words of their texts one after the other, the words' numbers among `known` (-1: not
    there) and how many each text has: few enough that a slice has about `tokens` of them, or one text."""
    for batch in batches:
        for b in _cut(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), BYTES):
            words, sizes = split(b.column(column))
            found = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            first = at = 0
            for part in _cut(b, sizes + 1, tokens):
                mine = sizes[first : first + part.num_rows]
                n = int(mine.sum())
                yield part, words.slice(at, n), found[at : at + n], mine
                first, at = first + part.num_rows, at + n


def _cut(b: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices that end with the row that brings their rows' sizes to `most`."""
    ends, first, done = np.cumsum(sizes, dtype=np.int64), 0, 0
    while first < b.num_rows:
        after = min(int(np.searchsorted(ends, done + most)) + 1, b.num_rows)
        yield b.slice(first, after - first)
        first, done = after, int(ends[after - 1])


def _parts(model, code, before, skip):
    cls = np.where(code < VOCAB, code // SLOTS, code - VOCAB)
    pair = ((before * 7919 + skip * 104729) >> 3) % len(model["pair"])
    return cls, pair, before % ROWS, skip % ROWS


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place; the largest bias is 0, so that only weights far beyond any that training gives would need the cut."""
    np.exp(np.minimum(z, 80, out=z), out=z)
    z /= np.maximum(z @ np.ones(z.shape[1], np.float32), np.float32(1e-30))[:, None]
    return z


class Scorer:
    """Log-probabilities under a model. The sums of the softmax are products of exponentials that are taken once for each
    weight, not for each position; where such a sum leaves the range of its numbers, it is taken the plain way."""

    def __init__(self, model: dict):
        bias, inner = model["bias"] - model["bias"].max(), model["in_bias"] - model["in_bias"].max()
        with_bias = {"before": model["before"] + bias, "in_before": (model["in_before"].reshape(ROWS, CLASSES, SLOTS) + inner).reshape(-1, SLOTS)}
        self.log = {k: v for k, v in model.items() if "bias" not in k} | with_bias
        with np.errstate(over="ignore"):
            self.exp = {k: np.exp(v) for k, v in self.log.items()}

    def _picked(self, rows: dict[str, np.ndarray], column: np.ndarray) -> np.ndarray:
        """The log of the softmax over the sums of these rows, at one column each."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            product = None
            for k, r in rows.items():
                e = self.exp[k].take(r, axis=0)
                product = e if product is None else np.multiply(product, e, out=product)
            total = product @ np.ones(product.shape[1], np.float32)
            norm = np.log(total, dtype=np.float64)
        bad = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
        if len(bad):
            z = sum(self.log[k][r[bad]].astype(np.float64) for k, r in rows.items())
            high = z.max(axis=1)
            norm[bad] = high + np.log(np.exp(z - high[:, None]).sum(axis=1))
        return sum(self.log[k][r, column].astype(np.float64) for k, r in rows.items()) - norm

    def log_probs(self, code: np.ndarray, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for frequent words, of P(word | class), at each position."""
        cls, pair, r1, r2 = _parts(self.log, code, before, skip)
        out = self._picked({"before": before, "skip": skip, "pair": pair}, cls)
        f = np.flatnonzero(code < VOCAB)
        if len(f):
            c = cls[f]
            out[f] += self._picked({"in_before": r1[f] * CLASSES + c, "in_skip": r2[f] * CLASSES + c}, code[f] % SLOTS)
        return out


def log_probs(self, code: np.ndarray, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for frequent words, of P(word | class), at each position."""
        m = self.model
        cls, pair, r1, r2 = _parts(m, code, before, skip)
        none = np.zeros(len(code), np.int64)
        out = (m["before"][before, cls].astype(np.float64) + m["skip"][skip, cls] + m["pair"][pair, cls] + m["bias"][0, cls]) - self._norm(["before", "skip", "pair", "bias"], [before, skip, pair, none], m["bias"])
        f = np.flatnonzero(code < VOCAB)
        if len(f):
            c, slot = cls[f], code[f] % SLOTS
            i1, i2 = r1[f] * CLASSES + c, r2[f] * CLASSES + c
            out[f] += (m["in_before"][i1, slot].astype(np.float64) + m["in_skip"][i2, slot] + m["in_bias"][c, slot]) - self._norm(["in_before", "in_skip", "in_bias"], [i1, i2, c], m["in_bias"])
        return out


def log_probs(model: dict, code: np.ndarray, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
    return Scorer(model).log_probs(code, before, skip)


def _descend(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
    """One step: the errors of equal rows are summed, each weight moves by its own rate."""
    order = np.argsort(rows.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32), kind="stable")
    r = rows[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))
    first = np.flatnonzero(new)
    r, g = r[first], error.take(order[first], axis=0)
    times = np.diff(first, append=len(order))
    several = times > 1
    if several.any():  # rows that come once are no sums
        some = order[np.repeat(several, times)]
        at = np.cumsum(times[several]) - times[several]
        g[several] = np.add.reduceat(error.take(some, axis=0), at, axis=0)
    sums, now = seen.take(r, axis=0), table.take(r, axis=0)
    sums += g * g
    seen[r] = sums
    sums += 1
    np.sqrt(sums, out=sums)
    g /= sums
    g *= RATE
    now -= g
    table[r] = now


def _sum_of_rows(model: dict, names: tuple[str, ...], rows: tuple[np.ndarray, ...]) -> np.ndarray:
    z = model[names[0]].take(rows[0], axis=0)
    for k, r in zip(names[1:], rows[1:], strict=True):
        z += model[k].take(r, axis=0)
    return z


def steps(model: dict, seen: dict, code: np.ndarray, before: np.ndarray, skip: np.ndarray) -> None:
    """A gradient step on these positions, in place."""
    cls, pair, r1, r2 = _parts(model, code, before, skip)
    n = np.arange(len(code))
    e = _sum_of_rows(model, ("before", "skip", "pair"), (before, skip, pair))
    e += model["bias"] - model["bias"].max()
    _softmax(e)[n, cls] -= 1
    f = np.flatnonzero(code < VOCAB)
    c = cls[f]
    i1, i2 = r1[f] * CLASSES + c, r2[f] * CLASSES + c
    w = _sum_of_rows(model, ("in_before", "in_skip"), (i1, i2))
    w += (model["in_bias"] - model["in_bias"].max())[c]
    _softmax(w)[np.arange(len(f)), code[f] % SLOTS] -= 1
    for name, rows, error in (("before", before, e), ("skip", skip, e), ("pair", pair, e), ("in_before", i1, w), ("in_skip", i2, w)):
        if len(rows):
            _descend(model[name], seen[name], rows, error)


# ---- distributed training


def _blocks(model: dict) -> np.ndarray:
    flat = np.concatenate([v.ravel() for k, v in model.items() if "bias" not in k])
    return np.pad(flat, (0, -len(flat) % BLOCK)).reshape(-1, BLOCK)


def _with_blocks(model: dict, blocks: np.ndarray) -> dict:
    flat, at, out = blocks.ravel(), 0, {}
    for k, v in model.items():
        if "bias" in k:
            out[k] = v
        else:
            out[k], at = flat[at : at + v.size].reshape(v.shape).astype(np.float32), at + v.size
    return out


def _mean(t: pa.Table) -> pa.Table:
    n = np.array(t.column("n").to_pylist(), np.float64)
    total = np.zeros(BLOCK)
    for k, b in zip(n, t.column("w").to_pylist(), strict=True):
        total += k * np.frombuffer(b, np.float32)
    mean = (total / max(n.sum(), 1)).astype(np.float32)
    return pa.table({"block": t.column("block")[:1], "part": t.column("part")[:1], "n": pa.array([n.sum()]), "w": pa.array([mean.tobytes()], pa.binary())})


def train_round(texts: DataFrame, model: dict, vocab: dict[bytes, int], text: str = "text", named: Sequence[bytes] = ()) -> dict:
    """Gradient steps from `model` in every task, then the weighted mean of what the tasks have, in two steps: of about
    the square root of the number of tasks in each, so that no group holds more blocks than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Tokens(vocab, named, len(model["before"]) - CONTEXTS)
        mine = {k: v.copy() for k, v in model.items()}
        seen = {k: np.zeros_like(v) for k, v in model.items() if "bias" not in k}
        used = 0
        for _, *held in _held(batches, 0, read.words, 4 * STEP):
            p = Positions(read, *held)
            for part in p.slices():
                steps(mine, seen, *part)
            used += len(p.code)
        if used:
            w = _blocks(mine)
            from pyspark import TaskContext

            part = TaskContext.get().partitionId() % width
            yield pa.RecordBatch.from_arrays([pa.array(range(len(w)), pa.int32()), pa.array([part] * len(w), pa.int32()), pa.array([float(used)] * len(w)), pa.array([x.tobytes() for x in w], pa.binary())], names=["block", "part", "n", "w"])

    width = max(1, int(texts._jdf.rdd().getNumPartitions() ** 0.5))
    schema = "block int, part int, n double, w binary"
    some = texts.select(text).mapInArrow(run, schema).groupBy("block", "part").applyInArrow(_mean, schema)
    got = {r["block"]: r["w"] for r in some.groupBy("block").applyInArrow(_mean, schema).select("block", "w").collect()}
    if not got:
        return model
    return _with_blocks(model, np.stack([np.frombuffer(got[i], np.float32) for i in range(len(got))]))


# ---- the whole


def most_frequent(counts: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """The `n` most frequent words with their counts, or fewer: words of equal counts come all or not at all, unless there
    is room for all words. One row for each different count comes to the driver beside them."""
    words = counts.where("token <> ''")
    least, room = 1, n
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(n + 1).collect():
        room -= r["words"]
        if room < 0:
            least = r["n"] + 1
            break
    return sorted(((r["token"].encode(), r["n"]) for r in words.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))


def train(texts: DataFrame, text: str = "text") -> dict:
    """Everything that scoring needs: the model, its words, the frequent words' counts, totals, and the counts table."""
    counts = materialize(count_tokens(texts, text), "lm-counts")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, COUNTED)
    end = (counts.where("token = ''").agg(F.sum("n")).first()[0]) or 0
    words, more = [w for w, _ in top[:VOCAB]], grown(VOCAB, total)
    named = [w for w, _ in top[VOCAB:more]]
    place = sort_into_classes(count_neighbours(texts, words, text))
    vocab = {w: int(place[i]) for i, w in enumerate(words)}
    # mass of the rare classes: all counted types that are no vocabulary word, and one unseen type each
    in_vocab = texts.sparkSession.createDataFrame([(w.decode("utf-8", "replace"),) for w in words] or [("",)], "token string")
    rare = counts.where("token <> ''").join(F.broadcast(in_vocab), "token", "left_anti")
    b = F.encode("token", "utf-8")
    first, last = (F.conv(F.hex(F.substring(b, at, 1)), 16, 10).cast("int") for at in (1, -1))
    groups = rare.groupBy(((last * 31 + first * 7).bitwiseAND(RARE - 1)).alias("g")).agg(F.sum(F.col("n") + ALPHA).alias("m")).collect()
    mass = np.full(RARE, ALPHA)
    for r in groups:
        mass[r["g"]] += r["m"]
    model = new_model(np.array([n for _, n in top[:VOCAB]], float), place, mass, end, len(named), grown(PAIRS, total))
    for k in range(ROUNDS):
        part = texts.where(F.pmod(F.xxhash64(text, F.lit(7)), F.lit(ROUNDS)) == k)
        model = train_round(part, model, vocab, text, [w for w, _ in top[VOCAB:]])
    return {"model": model, "vocab": vocab, "names": len(named), "known": dict(top), "end": end, "total": total, "types": types, "rare_log": np.log10(mass), "counts": counts}


ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, fitted: dict, text: str = "text") -> DataFrame:
    """`docs` without the text, plus n_tokens, n_known, train_tokens, base_score and score (log10)."""
    model, vocab, known, rare_log, names = (fitted[k] for k in ("model", "vocab", "known", "rare_log", "names"))
    end, total, types = fitted["end"], fitted["total"], fitted["types"]
    named = [w for w in known if w not in vocab]
    log_known = np.log10(np.array([known[w] for w in (*vocab, *named)] or [1], float) + ALPHA)
    keep = [c for c in docs.columns if c != text and c.lower() not in ADDED]
    own = {k: unused(f"__{k}", docs.columns) for k in ("row", "text", "tokens", "seen", "log_seen", "log_rare", "log_model", "strange", "token", "log_strange", "n_strange")}
    given = docs.select(F.monotonically_increasing_id().alias(own["row"]), *(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(own["text"]))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    new = {own["tokens"]: "long", own["seen"]: "long", own["log_seen"]: "double", own["log_rare"]: "double", own["log_model"]: "double", own["strange"]: "array<string>"}
    columns = [*(f.name for f in given.schema.fields[:-1]), *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, scorer, tenth = Tokens(vocab, named, names), Scorer(model), np.log(10)
        log_end = float(np.log10(end + ALPHA))
        for b, *held in _held(batches, len(columns) - len(new), read.words, 8 * STEP):
            p = Positions(read, *held)
            old, rare = p.found >= 0, p.code[p.word] >= VOCAB
            mine = np.where(old, log_known[p.found], 0.0)
            log = np.add.reduceat(np.concatenate([scorer.log_probs(*part) for part in p.slices()]), p.start) / tenth
            groups = np.where(rare, p.code[p.word] - VOCAB - CLASSES, 0)
            inner = p.sums(np.where(rare, mine - rare_log[groups], 0.0))
            strange = np.flatnonzero(~old)
            offsets = np.concatenate(([0], np.cumsum(p.sums((~old).astype(np.int64)))))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), p.words.take(pa.array(strange)).view(pa.string()))
            arrays = [pa.array(p.sizes), pa.array(p.sums(old.astype(np.int64)) + (end > 0)), pa.array(p.sums(mine) + log_end), pa.array(inner), pa.array(log), lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=columns)

    out = materialize(given.mapInArrow(run, kinds + ", ".join(f"`{k}` {v}" for k, v in new.items())), "lm-scored")
    asked = out.select(own["row"], F.explode(own["strange"]).alias(own["token"]))
    met = asked.join(fitted["counts"].select(F.col("token").alias(own["token"]), "n").hint("shuffle_hash"), own["token"], "left")
    sums = met.groupBy(own["row"]).agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias(own["log_strange"]), F.count("n").alias(own["n_strange"]))
    whole = out.drop(own["strange"]).join(sums, own["row"], "left")
    log_strange = F.coalesce(own["log_strange"], F.lit(0.0))
    norm = float(np.log10(total + ALPHA * (types + 1)))
    return whole.select(
        *(F.col(f"`{c}`") for c in keep),
        F.col(own["tokens"]).alias("n_tokens"),
        (F.col(own["seen"]) + F.coalesce(own["n_strange"], F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col(own["log_seen"]) + log_strange - F.col(own["tokens"]) * norm).alias("base_score"),
        (F.col(own["log_model"]) + F.col(own["log_rare"]) + log_strange).alias("score"),
    )
