"""Personal data: base patterns with exact places, and identifiers found by bootstrapped contexts, all in Spark SQL.

Bootstrapping: base entities of every kind and long machine-made strings are the seeds. The one and the two words before
an entity, or before a token with a digit, are its lexical patterns. Patterns and the instances they stand before form a
graph; in rounds, a pattern that stands before `MIN_SEEDS` different believed instances scores the share of ALL its
occurrences, before anything, that stand before believed ones, and an instance is believed as far as its best pattern is,
seeds fully; so what one pattern finds leads to the next. Patterns that end above `CONFIDENT` find further identifiers:
tokens of any shape with a digit that stand behind them. Ordinary words, which precede everything, never get there.
The graph is tables throughout; there is no limit on the number of patterns. Up to `INLINE` of them are part of the plan
that looks for identifiers, more are joined.

Places are code points, end exclusive. They come from the gaps that `split` leaves between the matches of
`regexp_extract_all`. Regular expressions are written so that they neither recurse nor back up over long runs; places are
summed in two levels of `LEVEL` matches, so that a text with very many matches takes little more than linear time.

Defined cases: a null or empty text has no spans; base spans of different kinds may overlap, found ones never overlap a
base span; spans that begin together are in the order of the kinds; a column of the name that is given for the spans is
replaced, all others are passed on; rows are judged one by one, repeated rows alike; an empty table has no patterns and
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitscope.runtime import materialize, unused

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, with possessive repeats and looks behind that change no match but keep the work linear.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a text has no match.
GATES = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

#: A pattern needs as many different believed instances, and a letter: punctuation alone names nothing.
MIN_SEEDS, ROUNDS, CONFIDENT = 5, 3, 0.6
#: Patterns up to this number are part of the plan; more are joined.
INLINE = 20_000
#: Characters before an entity in which its pattern must stand.
CONTEXT = 200
#: Matches whose places are summed at a time.
LEVEL = 64
#: Bits of the table that says which hashes of patterns there are.
BITS = 1 << 18
#: What an entity may be surrounded by.
_OPEN, _CLOSE = r"[\"'(\[<{]", r"[\"')\]>},;.:!?]"
_SECRET = r"(?=[^\s]*[0-9])(?=[^\s]*[A-Za-z])[A-Za-z0-9_+/=-]{32,}"
#: A token with a digit, at the start of a word or behind what opens one.
_TOKEN = rf"(?<!\S){_OPEN}*+(?=[^\s\"'<>]*[0-9])[^\s\"'<>(),;|]{{6,}}+"


def _luhn(digits: Column) -> Column:
    """True if the digits pass; doubled are the second, fourth, ... from the right."""
    back = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind in ("card", "phone"):
        digits = F.regexp_replace(hit, "[^0-9]+", "")
        if kind == "phone":
            return F.length(digits).between(10, 15)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.lit(True)


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(pairs: Column) -> Column:
    """(start, end, hit) of each of the matches (gap before, hit)."""
    size = lambda x: F.length(x["gap"]) + F.length(x["hit"])
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def add(acc: Column, x: Column) -> Column:
        a, b = acc["at"] + F.length(x["gap"]), acc["at"] + size(x)
        return F.struct(b.alias("at"), F.concat(acc["found"], F.array(F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("hit")))).alias("found"))

    def within(level: Column) -> Column:
        return F.aggregate(level["part"], F.struct(level["at"].alias("at"), none.alias("found")), add, lambda acc: acc["found"])

    def begins(parts: Column) -> Column:
        def add_part(acc: Column, part: Column) -> Column:
            return F.struct((acc["at"] + F.aggregate(part, F.lit(0), lambda n, x: n + size(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add_part, lambda acc: acc["out"])

    def summed(parts: Column) -> Column:
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), begins(parts).alias("at")), within))

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / LEVEL).cast("int")), lambda i: F.slice(p, i * LEVEL + 1, F.lit(LEVEL)))
    return F.when(F.size(pairs) > 0, _let(cut(pairs), summed)).otherwise(none)


def _spans(text: Column, pattern: str, kind: str, order: int, lead: str | None = None, tail: str | None = None) -> Column:
    """All matches of `pattern` as (start, ord, end, kind), without what of them `lead` and `tail` match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    gaps = F.split(text, pattern, -1).alias("gap")
    found = _let(F.filter(F.arrays_zip(hits, gaps), lambda x: x["hit"].isNotNull()), _places)
    cut = lambda x, p: F.length(F.regexp_extract(x["hit"], p, 0)) if p else F.lit(0)
    return F.transform(F.filter(found, lambda x: _valid(kind, x["hit"])), lambda x: F.struct((x["start"] + cut(x, lead)).alias("start"), F.lit(order).alias("ord"), (x["end"] - cut(x, tail)).alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """Sorted (start, ord, end, kind) of the base kinds."""
    each = [F.when(text.rlike(GATES[k]), _spans(text, PATTERNS[k], k, i)).otherwise(_no_spans()) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def _tokens(text: Column, base: Column) -> Column:
    """Spans of the tokens with a digit that overlap no base span."""
    found = F.when(text.rlike("[0-9]"), _spans(text, _TOKEN, FOUND, len(KINDS), rf"\A{_OPEN}*+", rf"{_CLOSE}*+\z")).otherwise(_no_spans())
    return F.filter(found, lambda x: (x["end"] > x["start"]) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def _patterns_before(text: Column, start: Column) -> Column:
    """The one and the two words before a place, lower-cased; as many as there are in the `CONTEXT` characters before."""
    begin = F.greatest(start - CONTEXT, F.lit(0))
    before = F.concat(F.when(begin == 0, " ").otherwise(""), F.substr(text, begin + 1, start - begin))
    one = F.lower(F.regexp_extract(before, rf"(?<=\s)(\S++)\s++{_OPEN}*+\z", 1))
    two = F.lower(F.regexp_extract(before, rf"(?<=\s)(\S++)\s++\S++\s++{_OPEN}*+\z", 1))
    both = F.array(one, F.when(two != "", F.concat(two, F.lit(" "), one)))
    return F.filter(both, lambda p: p.isNotNull() & (p != ""))


def _entities(docs: DataFrame, text: str) -> DataFrame:
    """(patterns, instance, seed): every base entity and every token with a digit, with the words before it."""
    body = F.col(text)
    rows = docs.where(body.rlike("[0-9@]")).select(body.alias("t"), base_spans(body).alias("base"))
    rows = rows.withColumn("each", F.concat("base", _tokens(F.col("t"), F.col("base"))))
    rows = rows.select("t", F.explode("each").alias("x"))
    hit = F.substr("t", F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    found = rows.select(_patterns_before(F.col("t"), F.col("x.start")).alias("patterns"), hit.alias("instance"), (F.col("x.kind") != FOUND).alias("base"))
    return found.select("patterns", "instance", (F.col("base") | F.col("instance").rlike(rf"\A{_SECRET}\z")).alias("seed"))


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, instance, n, seed): the graph's edges between contexts and the instances behind them."""
    each = _entities(docs, text).select(F.explode("patterns").alias("pattern"), "instance", "seed")
    return each.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))


def _hash(pattern: Column) -> Column:
    return F.pmod(F.xxhash64(pattern), F.lit(BITS)).cast("int")


def _table_of(hashes: DataFrame) -> Column:
    """A constant array of `BITS` bits: those of the hashes `h` are set."""
    longs = [0] * (BITS // 64)
    for r in hashes.distinct().collect():
        longs[r["h"] // 64] |= 1 << r["h"] % 64
    return F.from_json(F.lit("[" + ",".join(str(x - (1 << 64) if x >> 63 else x) for x in longs) + "]"), "array<bigint>")


def totals(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, total): how often each of `patterns` (pattern) stands before anything, over all texts. What is not one by
    tables of the `BITS` hashes of patterns and their last words, which are all that the driver sees, is not counted."""
    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"), F.lit(0)), lambda w: F.lower(w))
    last = F.element_at(F.split("pattern", " "), -1)
    every, ends = (_table_of(patterns.select(_hash(x).alias("h"))) for x in (F.col("pattern"), last))
    there = lambda t, x: F.getbit(F.get(t, F.shiftright(_hash(x), 6)), _hash(x).bitwiseAND(63)) == 1

    def before(w: Column) -> Column:
        hits = F.transform(w, lambda x, i: F.when((i < F.size(w) - 1) & there(ends, x), F.struct(x.alias("x"), F.when(i > 0, F.get(w, i - 1)).alias("y"))))
        return _let(F.filter(hits, lambda h: h.isNotNull()), both)

    def both(hits: Column) -> Column:
        two = F.transform(hits, lambda h: F.concat(h["y"], F.lit(" "), h["x"]))
        return F.filter(F.concat(F.transform(hits, lambda h: h["x"]), two), lambda p: p.isNotNull() & there(every, p))

    counted = docs.select(F.explode(_let(words, before)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("total"))
    return counted.join(patterns.select("pattern"), "pattern", "left_semi")


def learn_patterns(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, inline: int = INLINE) -> list[str] | DataFrame:
    """The patterns that end above `CONFIDENT`: sorted, if there are at most `inline` of them, else a table (pattern)."""
    edges = materialize(occurrences(docs, text).where(F.col("pattern").rlike(r"\p{L}")), "pii-edges")
    if edges.where("seed").isEmpty():
        return []
    # what can't have enough different instances in any round is left out before the words of all texts are counted
    wide = edges.groupBy("pattern").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= MIN_SEEDS)
    wide = materialize(wide, "pii-wide")
    graph = materialize(edges.join(wide, "pattern", "left_semi").join(totals(docs, wide, text), "pattern"), "pii-graph")
    score = None
    for _ in range(rounds):
        if score is None:
            told = graph.withColumn("s", F.col("seed").cast("double"))
        else:
            best = graph.join(score, "pattern").groupBy("instance").agg(F.max("p").alias("best"))
            told = graph.join(best, "instance", "left").withColumn("s", F.greatest(F.col("seed").cast("double"), F.coalesce("best", F.lit(0.0))))
        by = told.groupBy("pattern").agg((F.sum(F.col("n") * F.col("s")) / (F.first("total") + 1)).alias("p"), F.sum(F.when(F.col("s") >= CONFIDENT, 1).otherwise(0)).alias("kinds"))
        score = materialize(by.where(F.col("kinds") >= MIN_SEEDS).select("pattern", "p"), "pii-score")
    sure = score.where(F.col("p") >= CONFIDENT).select("pattern")
    names = [r[0] for r in sure.limit(inline + 1).collect()]
    return sorted(names) if len(names) <= inline else sure


def find(docs: DataFrame, patterns: list[str] | DataFrame, text: str = "text", column: str = "spans") -> DataFrame:
    """`docs` with `column`: all spans, sorted by start and kind; base kinds first in the order of `KINDS`, then `id`."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(column, base_spans(body))
    base = F.col(column)
    if isinstance(patterns, list):
        if not patterns:
            return out
        behind = F.filter(_tokens(body, base), lambda x: F.exists(_patterns_before(body, x["start"]), lambda p: p.isin(patterns)))
        return out.withColumn(column, F.when(body.rlike("[0-9]"), F.array_sort(F.concat(base, behind))).otherwise(base))
    row, tokens, x, p = (unused(n, docs.columns) for n in ("__row", "__tokens", "__x", "__p"))
    out = materialize(out.withColumns({row: F.monotonically_increasing_id(), tokens: _tokens(body, base)}), "pii-tokens")
    asked = out.select(row, F.col(text).alias("t"), F.explode(tokens).alias(x)).select(row, x, F.explode(_patterns_before(F.col("t"), F.col(f"{x}.start"))).alias(p))
    behind = asked.join(patterns.select(F.col("pattern").alias(p)), p, "left_semi").groupBy(row).agg(F.collect_set(x).alias(x))
    whole = out.join(behind, row, "left")
    return whole.withColumn(column, F.array_sort(F.concat(base, F.coalesce(x, _no_spans())))).drop(row, tokens, x)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def mask(docs: DataFrame, patterns: list[str] | DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets; spans that overlap become one."""
    c = unused("__spans", docs.columns)
    body = F.col(text)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def add(acc: Column, s: Column) -> Column:
        more = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))))
        return F.when((F.size(acc) == 0) | (s["start"] >= F.coalesce(last["end"], F.lit(0))), F.concat(acc, more)).otherwise(longer)

    def cleaned(m: Column) -> Column:
        end = lambda i: F.coalesce(F.get(m, i)["end"], F.lit(0))
        pieces = F.transform(m, lambda x, i: F.concat(F.substr(body, end(i - 1) + 1, x["start"] - end(i - 1)), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), F.substr(body, end(F.size(m) - 1) + 1, F.length(body)))

    clean = _let(F.aggregate(F.col(c), none, add), cleaned)
    found = find(docs, patterns, text, c)
    return found.withColumn(text, F.when(F.size(c) > 0, clean).otherwise(body)).select(*(F.col(f"`{x}`") for x in docs.columns))
