"""URL filter: host and path rules, then logistic regression on hashed character n-grams, all in Spark SQL.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is judged by the model,
which scores it by its bias alone. A url of any length is judged whole; of rules that fit, the longest wins, of equally
long ones the last by host and path; a score of one half is `block`. Repeated rows get equal verdicts, an empty table gives
an empty table, and other columns are passed on; the six added columns replace columns of the same names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets for each of host and path; the model is one array of twice as many weights, whatever the input.
BUCKETS = 2048
GRAMS = (3, 4, 5)
EPOCHS, RATE, DECAY = 30, 0.5, 1e-4
#: The labelled table is meant to be small; more rows than this are refused rather than cut.
MAX_LABELLED = 20_000

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Words that name unwanted and ordinary sites, from which the small labelled table is made.
UNWANTED = (
    "casino poker roulette slots jackpot lottery betting bets gamble adult porn xxx sex escort nude cam "
    "pills pharma viagra cialis drugs steroid spam spam-farm link-farm clickbait free-money free-bets win-prize "
    "casino-win cheap-pills adult-x cheap-meds payday-loan fast-cash crack warez keygen torrent hack-tool "
    "ads-track ads-server popup-ads click-track tracker banner-ads replica-watch fake-id miracle-diet get-rich crypto-double adult-dating hot-girls cheap-viagra win-big"
)
ORDINARY = (
    "news daily times journal library museum school university college research science physics biology history "
    "archive docs wiki recipes kitchen garden travel weather health hospital clinic council city county gov "
    "blog forum support developer python spark linux maps photo music theatre cinema sport football hockey "
    "bakery market furniture books reading atlas ocean mountain river forest"
)
#: Syllables; every pair of them is one more ordinary, made-up site name.
SYLLABLES = "th er an on re he in ti at es or ha wh sh ed ou nd ble rat ing"
PATHS = ("/en/12", "/fr/34.html", "/de/index", "/es/7/", "/about", "")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, bad): each word as a site name under a few prefixes, endings and paths; unwanted
    ones under all of them, ordinary ones under two by turns, so that no prefix or ending tells the classes apart."""
    rows = []
    for bad, words in ((1, UNWANTED), (0, ORDINARY + " " + " ".join(a + b for a in SYLLABLES.split() for b in SYLLABLES.split()))):
        for i, w in enumerate(words.split()):
            for j, (front, end) in enumerate((("", "example.com"), ("www.", "example.net"), ("blog.", "example.org"), ("m.", "com"))):
                if bad or (i + j) % 2 == 0:
                    rows.append((f"https://{front}{w}.{end}{PATHS[(i + j) % len(PATHS)]}", bad))
    return spark.createDataFrame(rows, "url string, bad int")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (verdict, host + path) that fits, or null."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(best)
    return best


def _bucket(s: Column, n: int, first: int):
    return lambda i: (F.pmod(F.xxhash64(F.substr(s, i, F.lit(n))), F.lit(BUCKETS)) + F.lit(first)).cast("int")


def grams(host: Column, path: Column) -> Column:
    """Buckets of the different character n-grams of host and path, each between end marks."""
    parts = []
    for f, (value, mark) in enumerate(((host, "^"), (path, "$"))):
        s = F.concat(F.lit(mark), value, F.lit(mark))
        for n in GRAMS:
            last = F.length(s) - (n - 1)
            starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _bucket(s, n, f * BUCKETS)))
    return F.array_distinct(F.concat(*parts))


def _weights(values: list[float]) -> Column:
    """A constant array: folded by the optimizer, so it is part of the plan and not of the data."""
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")


def margin(features: Column, model: dict) -> Column:
    w = _weights(model["w"])
    total = F.aggregate(features, F.lit(0.0), lambda a, b: a + F.get(w, b))
    return F.lit(model["bias"]) + total / F.sqrt(F.greatest(F.size(features), F.lit(1)).cast("double"))


def train(labelled: DataFrame) -> dict:
    """Full-batch logistic regression with per-weight step sizes. The buckets of the labelled rows, of which there are no
    more than `MAX_LABELLED`, come to the driver once; pages are scored in SQL."""
    host, path = split_url(F.col("url"))
    rows = labelled.where("bad IS NOT NULL").select(F.col("bad").cast("double").alias("y"), grams(host, path).alias("x")).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    w, bias = np.zeros(2 * BUCKETS), 0.0
    n, seen, seen_bias = len(rows), np.full(2 * BUCKETS, 1e-8), 1e-8
    y, sizes = np.array([r["y"] for r in rows]), np.array([len(r["x"]) for r in rows], int)
    flat = np.array([b for r in rows for b in r["x"]], int)
    row, scale = np.repeat(np.arange(n), sizes), 1 / np.sqrt(np.maximum(sizes, 1))
    touched = np.zeros(2 * BUCKETS, bool)
    touched[flat] = True
    for _ in range(EPOCHS if n else 0):
        z = bias + np.bincount(row, w[flat], minlength=n) * scale
        r = 1 / (1 + np.exp(-z)) - y
        g = np.where(touched, np.bincount(flat, (r * scale)[row], minlength=2 * BUCKETS) / n + DECAY * w, 0)
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
        of_bias = r.sum() / n
        seen_bias += of_bias * of_bias
        bias -= 0.1 * RATE * of_bias / np.sqrt(seen_bias)
    return {"w": w.tolist(), "bias": float(bias)}


def judge(pages: DataFrame, model: dict, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule, verdict (the rule's, else the model's), score (probability of block) and by_model."""
    host, path = split_url(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    hit = match_rule(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-margin(grams(F.col("host"), F.col("path")), model)))
    out = out.withColumns({"rule": hit["rule"], "verdict": hit["verdict"], "score": score})
    return out.withColumns({"by_model": F.col("verdict").isNull(), "verdict": F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))})
