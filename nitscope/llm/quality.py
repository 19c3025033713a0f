"""Quality rules: a threshold table compiled into one projection, without user functions.

`measure` adds the counts, `compile_rules` turns a table of thresholds into one boolean column, `judge` does both.
A word is a maximal run of characters other than space and U+0009 to U+000D. Null and empty texts have no words;
all their counts are 0 and they fail the rule on the number of words. Rows are judged one by one: repeated rows
get the same verdict each, an empty table gives an empty table, and columns besides the text are passed on as they are
(a column of the same name as a measure is replaced, unless another prefix is chosen). Very long texts are measured whole,
as arrays of their words in one row; a value on a threshold is within it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitscope.runtime import unused

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it with as was on are be by this from or an at "
    "le la les de des du un une et en que qui dans pour pas sur par est au avec "
    "der die das und in zu den von ein eine mit ist im nicht auf des dem sich für "
    "el los las y se del por con una su para"
)


@dataclass(frozen=True)
class Rule:
    """A document fails if `measure` is below `at_least` or above `at_most`, given at least `min_words` words."""

    name: str
    measure: str
    at_least: float | None = None
    at_most: float | None = None
    min_words: int = 0


#: Base limits, in whole numbers so that they are exact.
BASE_RULES = (
    Rule("too_few_words", "n_words", at_least=10),
    Rule("repeated_windows", "100 * n_repeat_words - 20 * n_words", at_most=0),
)
#: The method's own limits.
RULES = (
    Rule("word_length", "word_chars / n_words", at_least=2.0, at_most=15.0),
    Rule("symbols", "n_symbols / n_words", at_most=0.2),
    Rule("stop_words", "n_stop_words / n_words", at_least=0.06, min_words=40),
    Rule("same_word_again", "n_same_as_before / n_words", at_most=0.25),
    Rule("repeated_lines", "n_dup_lines / n_lines", at_most=0.5, min_words=40),
)


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_same_as_before (long)."""
    tmp = {k: unused(f"__{k}", docs.columns) for k in ("words", "lines", "windows")}
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines, windows = (F.col(tmp[k]) for k in ("words", "lines", "windows"))
    size = lambda x: F.size(x).cast("long")
    stop = sorted(set(STOP_WORDS.split()))
    out = docs.withColumns({
        tmp["words"]: F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        tmp["lines"]: F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
    })
    out = out.withColumn(tmp["windows"], F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda _, i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))))
    return out.withColumns({
        f"{prefix}n_words": size(words),
        f"{prefix}word_chars": F.length(F.regexp_replace(body, f"[{SPACE}]+", "")).cast("long"),
        f"{prefix}n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        f"{prefix}n_lines": size(lines),
        f"{prefix}n_dup_lines": size(lines) - size(F.array_distinct(lines)),
        f"{prefix}n_repeat_words": F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows)),
        f"{prefix}n_stop_words": size(F.filter(words, lambda w: F.lower(w).isin(stop))),
        f"{prefix}n_same_as_before": size(F.filter(words, lambda w, i: w == F.get(words, i - 1))),
    }).drop(*tmp.values())


def covered(windows: Column) -> Column:
    """Words that lie in a window found twice or more. Equal windows stand side by side in the order by value, then
    place; each place that has an equal neighbour covers its words up to the next such place."""
    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return _let(_let(order, places), total)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compile_rules(rules, prefix: str = "") -> Column:
    """True if none of the rules is broken. Measures are SQL expressions over the columns of `measure`."""
    ok = F.lit(True)
    for r in rules:
        value = F.expr(r.measure) if not prefix else F.expr(_prefixed(r.measure, prefix))
        fine = F.lit(True)
        if r.at_least is not None:
            fine = fine & (value >= r.at_least)
        if r.at_most is not None:
            fine = fine & (value <= r.at_most)
        n = F.col(f"{prefix}n_words")
        ok = ok & F.when((n == 0) & F.lit("/" in r.measure) | (n < r.min_words), True).otherwise(fine)
    return ok


def _prefixed(measure_sql: str, prefix: str) -> str:
    import re

    return re.sub(r"\b(n_[a-z_]+|word_chars)\b", rf"{prefix}\1", measure_sql)


def judge(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`measure`, then base_failed and kept (false if base_failed or any rule of the table is broken)."""
    out = measure(docs, text, prefix)
    failed = ~compile_rules(BASE_RULES, prefix)
    return out.withColumns({f"{prefix}base_failed": failed, f"{prefix}kept": ~failed & compile_rules(RULES, prefix)})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns they came with."""
    p = "__quality_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    # The row number keeps the optimizer from moving the filter below the projection, where it would repeat every
    # measure wherever a rule names it, and those below them in turn.
    judged = judge(docs, prefix=p).withColumn(f"{p}row", F.monotonically_increasing_id())
    kept = judged.where(F.col(f"{p}kept") & (F.col(f"{p}row") >= 0))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
