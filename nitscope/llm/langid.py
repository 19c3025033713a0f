"""Language identification by compression: the language whose dictionary encodes a text shortest.

Each language has a zstandard raw-content dictionary of labelled text. A text is lower-cased, reduced to its letters and
encoded whole, in chunks, once with each dictionary; the smallest total wins, and a narrow margin over the second is
reported (`narrow`), or rejected as `und` with `reject=True`.

Only the dictionaries are fitted on a sample: `SAMPLE_DOCS` different texts a language, chosen by their own hash, of
each a stretch of at most `SNIPPET_CHARS` characters from a place its hash names; a dictionary is all of that sample, and
the driver holds no more than that for each of at most `MAX_LANGUAGES` languages. Defined cases: a null text or one without
any letter is `und` with score 0; without any labelled text everything is `und`; of languages with equal sizes the first by
name wins, and is narrow; very long texts are encoded whole, chunk by chunk; columns with the names of the added ones are
replaced, others passed on; repeated rows get equal results; an empty table gives an empty table; a null language is not
learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nitscope.runtime import unused

UNDEFINED = "und"
SAMPLE_DOCS, SNIPPET_CHARS = 120, 2000
MAX_LANGUAGES = 500
LEVEL, SHORTEST_MATCH, CHUNK = 6, 3, 4096
#: A lead of less than this share of the second size is narrow.
MARGIN = 0.01

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normal(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Language to dictionary content. `labelled` should hold nothing but the rows to learn from."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    parts = 1 << 30
    rate = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(parts, -(-8 * SAMPLE_DOCS * parts // n)))))
    h = F.xxhash64("text")
    chosen = rows.withColumn("h", h).where(F.pmod("h", F.lit(parts)) < F.element_at(rate, F.col("lang")))
    start = F.when(F.length("text") > SNIPPET_CHARS, F.pmod(F.shiftright("h", 30), F.length("text") - SNIPPET_CHARS)).otherwise(0)
    snippets = chosen.select("lang", "h", F.substr("text", start.cast("int") + 1, F.lit(SNIPPET_CHARS)).alias("s"))
    first = Window.partitionBy("lang").orderBy("h")
    sample = snippets.dropDuplicates(["lang", "h"]).withColumn("i", F.row_number().over(first)).where(F.col("i") <= SAMPLE_DOCS)
    texts: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sample.orderBy("lang", "i").select("lang", "s").collect():
        texts[r["lang"]].append(normal(r["s"]))
    return {k: b" ".join(v) for k, v in texts.items() if v}


class Classifier:
    """Sizes of a text under every dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.coders = []
        for k in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionaries[k]), min_match=SHORTEST_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, narrow). The score is the winner's share when each byte less doubles a language's odds,
        counted for a text of at most 64 bytes so that it stays a matter of the margin."""
        if not self.names or text is None or not _LETTER.search(text):
            return UNDEFINED, 0.0, True
        data = normal(text)
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        sizes = np.array([sum(len(c.compress(x)) for x in chunks) for c in self.coders], float)
        best = int(sizes.argmin())
        lead = (sizes - sizes[best]) * min(1.0, 64 / len(data)) * 4
        others = np.delete(sizes, best)
        narrow = len(others) > 0 and others.min() - sizes[best] < MARGIN * others.min()
        return self.names[best], float(1 / np.exp2(-lead).sum()), bool(narrow)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", reject: bool = True) -> DataFrame:
    """`docs` without the text, plus lang_pred, score and narrow. With `reject`, a narrow margin is `und`."""
    keep = [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "score", "narrow")]
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(unused("__text", docs.columns)))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for b in batches:
            found = [model.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            names = [UNDEFINED if reject and narrow else k for k, _, narrow in found]
            new = [pa.array(names, pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([n for *_, n in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*keep, "lang_pred", "score", "narrow"])

    return given.mapInArrow(run, f"{kinds}lang_pred string, score double, narrow boolean")
