"""Chat formatting by token-level assembly.

Every turn is encoded on its own and stands between reserved ids beyond the vocabulary: no text, whatever it says, can
produce them. In the text form of the template the reserved ids are the control strings of `MARKS`; control strings
inside a text are escaped, so that the text form reads back unambiguously too.

Turns are encoded where they lie, before anything is moved. Then conversations are dealt by conv_id, sorted by turn
(ties by role, then text) and read as a stream: one turn is in memory at a time, however long its conversation is, and
the result is one row a turn, with its place in the conversation's token sequence from running sums.

Defined cases: a null role or text is empty; a null turn comes first; rows with a null conv_id are one conversation;
repeated rows are repeated turns; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitscope.llm import tokens

#: Control strings, in the order of their reserved ids.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ANSWER]", "[ROLE]", "[/ROLE]")
FIRST_RESERVED = 50_257
BOS, EOS, INST, INST_END, SYS, SYS_END, ANSWER, ROLE, ROLE_END = range(FIRST_RESERVED, FIRST_RESERVED + len(MARKS))
#: Before and after the text of a turn; other roles name themselves between [ROLE] and [/ROLE].
FRAMES = {"user": (INST, INST_END), "system": (SYS, SYS_END), "assistant": (ANSWER, EOS)}
LEARNED = "assistant"

ESCAPE = "\x1b"
_CONTROL = re.compile("|".join(map(re.escape, (ESCAPE, *MARKS))))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left: each gets the escape character and a point after its first character; an escape
    character of the text is doubled."""
    return _CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{m[0][0]}{ESCAPE}.{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == ESCAPE else "", text)


def assemble(role: str, text: str, vocabulary: str = "byte_bpe_50k") -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn. Segments are encoded one by one and spliced; the mask is the running sum of +1
    where a learned segment begins and -1 where it ends."""
    body = tokens.encode_ordinary(escape(text), vocabulary)
    if role in FRAMES:
        head, tail = [FRAMES[role][0]], [FRAMES[role][1]]
    else:
        head, tail = [ROLE, *tokens.encode_ordinary(escape(role), vocabulary), ROLE_END], [EOS]
    ids = np.array(head + body + tail, np.int32)
    edges = np.zeros(len(ids) + 1, np.int8)
    if role == LEARNED:
        edges[len(head)] += 1
        edges[len(head) + len(body)] -= 1
    return ids, np.cumsum(edges[:-1]).astype(bool)


def encode_turns(convs: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(conv_id, turn, role, text, ids, mask), one row for each of `convs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [assemble(r or "", t or "", vocabulary) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.bool_()))], names=[*names, "ids", "mask"])

    names = ["conv_id", "turn", "role", "text"]
    given = convs.select(*names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(run, f"{kinds}, ids array<int>, mask array<boolean>")


def format_chats(convs: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(conv_id, place, token_start, ids, mask): the turns of a conversation follow each other in one partition, in
    order; the first begins with <s>. A conversation's token sequence is its rows' ids one after the other."""
    encoded = encode_turns(convs, vocabulary)
    dealt = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).select("conv_id", "ids", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, at = object(), 0, 0
        for b in batches:
            ids, mask = b.column(1), b.column(2)
            lengths, begins, places, starts = ids.value_lengths().to_numpy(), [], [], []
            for key, n in zip(b.column(0).to_pylist(), lengths.tolist(), strict=True):
                first = key != now
                now, place, at = (key, 0, 0) if first else (now, place, at)
                begins.append(first)
                places.append(place)
                starts.append(at)
                place, at = place + 1, at + n + first
            where = (np.cumsum(lengths) - lengths)[begins]
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths + begins))), pa.int32())
            values = (np.insert(ids.flatten().to_numpy(), where, BOS), np.insert(mask.flatten().to_numpy(zero_copy_only=False), where, False))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int64()), pa.array(starts, pa.int64()), *lists], names=["conv_id", "place", "token_start", "ids", "mask"])

    key = convs.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {key}, place long, token_start long, ids array<int>, mask array<boolean>")


def render(ids, vocabulary: str = "byte_bpe_50k") -> str:
    """The text form: reserved ids as their control strings."""
    out, start = [], 0
    for k, i in enumerate([*ids, BOS]):
        if i >= FIRST_RESERVED:
            out.append(tokens.decode(ids[start:k], vocabulary))
            if k < len(ids):
                out.append(MARKS[i - FIRST_RESERVED])
            start = k + 1
    return "".join(out)


def read_turn(ids: np.ndarray, vocabulary: str = "byte_bpe_50k") -> tuple[str, str, slice]:
    """(role, escaped text, place of the text's ids) of one row: found by the reserved ids alone."""
    head = int(ids[0] == BOS)
    end = head
    if ids[head] == ROLE:
        end = int(np.flatnonzero(ids == ROLE_END)[0])
        role = unescape(tokens.decode(ids[head + 1 : end].tolist(), vocabulary))
    else:
        role = next(r for r, f in FRAMES.items() if f[0] == ids[head])
    body = slice(end + 1, len(ids) - 1)
    return role, tokens.decode(ids[body].tolist(), vocabulary), body


def read_back(formatted: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row a conversation, from what `format_chats` gives, as a stream over its partitions: number of turns,
    SHA-256 of the turns, characters and SHA-256 of the text under the loss mask, characters of the text form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result():
            return [key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        key, n, turns, loss, loss_chars, chars = None, 0, None, None, 0, 0
        for b in batches:
            done = []
            stops = np.cumsum(b.column(3).value_lengths().to_numpy())
            every, learned_at = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy(zero_copy_only=False)
            for k, place, start, stop in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                ids, mask = every[start:stop], learned_at[start:stop]
                if place == 0:
                    if n:
                        done.append(result())
                    key, n, turns, loss, loss_chars, chars = k, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                role, escaped, body = read_turn(ids, vocabulary)
                text = unescape(escaped)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if mask.any():
                    same = mask[body].all() and int(mask.sum()) == body.stop - body.start
                    learned = text if same else unescape(tokens.decode(ids[mask].tolist(), vocabulary))
                    loss.update(learned.encode("utf-8", "surrogatepass"))
                    loss_chars += len(learned)
                outside = np.concatenate((ids[: body.start], ids[body.stop :])).tolist()
                n, chars = n + 1, chars + len(render(outside, vocabulary)) + len(escaped)
            if done:
                yield batch(done)
        if n:
            yield batch([result()])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    key_kind = formatted.schema["conv_id"].dataType.simpleString()
    kinds = [pa.int64() if key_kind == "bigint" else pa.int32() if key_kind == "int" else pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return formatted.mapInArrow(run, f"conv_id {key_kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
