"""Public byte-level BPE: ids for texts and bytes for ids. The vocabulary's place is a parameter."""

from __future__ import annotations

import base64

from functools import lru_cache

SPECIAL = "<|endoftext|>"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _fast(name: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), {i: b for b, i in ranks.items()}


@lru_cache(maxsize=4)
def _plain(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name + ".json"))


def encode(text: str, name: str = "byte_bpe_50k") -> list[int]:
    """The ids that the tokenizers library gives for this vocabulary, add_special_tokens=False. The same ranks are
    applied by the faster library; a text that holds the special token's string goes to the first, as only that
    turns it into the special id."""
    if SPECIAL in text:
        return _plain(name).encode(text, add_special_tokens=False).ids
    return _fast(name)[0].encode_ordinary(text)


def encode_ordinary(text: str, name: str = "byte_bpe_50k") -> list[int]:
    """Ids of the text as ordinary text, whatever strings it holds."""
    return _fast(name)[0].encode_ordinary(text)


def decode(ids, name: str = "byte_bpe_50k") -> str:
    table = _fast(name)[1]
    return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")


