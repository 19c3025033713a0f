"""Relational kernels of the media pipeline as queries over the generic tables, each with its SQL twin.

Stand-ins: `events` are frames (user = track, (ts, event_id) = order, event_type = payload or kind), `lineitem` samples,
`part` look-up inputs, `orders` extents, `nation`, `customer` and `supplier` tracks and their tags.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nitscope.functions import labels, luminance
from nitscope.operators import lookups, ordered, selection, windows
from nitscope.runtime import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Level, anchor width, height and frame rate of the Dolby Vision level table.
DV_LEVELS = ((1, 1280, 720, 24), (2, 1280, 720, 30), (3, 1920, 1080, 24), (4, 1920, 1080, 30), (5, 1920, 1080, 60), (6, 3840, 2160, 24), (7, 3840, 2160, 30), (8, 3840, 2160, 48), (9, 3840, 2160, 60), (10, 3840, 2160, 120), (11, 7680, 4320, 30), (12, 7680, 4320, 60), (13, 7680, 4320, 120))

DAY = F.to_date
ORDER = ["ts", "event_id"]


def kernel(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def frames(spark, sf_dir):
    return table(spark, sf_dir, "events")


def at():
    return F.struct("ts", "event_id")


# ---- order-sensitive comparisons


@kernel("""
    WITH p AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    a AS (SELECT user_id, count(prev) AS frame_pairs, CAST(sum(CASE WHEN prev <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS changed_pairs FROM p GROUP BY user_id)
    SELECT *, CASE WHEN frame_pairs = 0 THEN NULL WHEN changed_pairs * 4 >= frame_pairs THEN 'per-frame' ELSE 'per-shot' END AS cadence FROM a""")
def cadence(spark, sf_dir):
    """WIN-01: consecutive-frame changes and the per-shot or per-frame verdict; the quarter is inclusive."""
    pairs = windows.with_previous(frames(spark, sf_dir), ["user_id"], ORDER, "event_type", chunk=DAY("ts"))
    changed = F.sum(F.when(F.col("prev") != F.col("event_type"), 1).otherwise(0)).cast("long")
    per = pairs.groupBy("user_id").agg(F.count("prev").alias("frame_pairs"), changed.alias("changed_pairs"))
    verdict = F.when(F.col("frame_pairs") == 0, None).when(F.col("changed_pairs") * 4 >= F.col("frame_pairs"), "per-frame").otherwise("per-shot")
    return per.withColumn("cadence", verdict)


@kernel("""
    WITH f AS (SELECT * FROM events WHERE event_type <> 'view'),
    p AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM f)
    SELECT user_id, count(prev) AS frame_pairs, CAST(count_if(prev <> event_type) AS BIGINT) AS changed_pairs FROM p GROUP BY user_id""")
def cadence_bridging(spark, sf_dir):
    """WIN-01: pairs bridge frames without dynamic metadata, which are filtered before the comparison."""
    with_dm = frames(spark, sf_dir).where("event_type <> 'view'")
    pairs = windows.with_previous(with_dm, ["user_id"], ORDER, "event_type", chunk=DAY("ts"))
    return pairs.groupBy("user_id").agg(F.count("prev").alias("frame_pairs"), F.count_if(F.col("prev") != F.col("event_type")).alias("changed_pairs"))


@kernel("""
    WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM m)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run""")
def run_length(spark, sf_dir):
    """WIN-02: consecutive equal payloads."""
    return windows.runs(frames(spark, sf_dir), ["user_id"], ORDER, "event_type", chunk=DAY("ts"))


@kernel("""
    WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m),
    r AS (SELECT user_id, run, min(event_type) AS event_type, count(*) AS weight FROM g GROUP BY user_id, run)
    SELECT user_id, CAST(sum(weight) AS BIGINT) AS rpu_count, count(*) AS runs, CAST(sum(weight - 1) + count(*) - 1 AS BIGINT) AS frame_pairs,
           CAST(sum(CASE WHEN event_type = 'signup' THEN weight ELSE 0 END) AS BIGINT) AS scene_cuts FROM r GROUP BY user_id""")
def weighted_fold(spark, sf_dir):
    """AGG-02, AGG-04: runs stand for their frames; a run of w has w - 1 unchanged pairs and one border pair."""
    r = windows.runs(frames(spark, sf_dir), ["user_id"], ORDER, "event_type", chunk=DAY("ts"))
    return r.groupBy("user_id").agg(
        F.sum("n").alias("rpu_count"),
        F.count("*").alias("runs"),
        (F.sum(F.col("n") - 1) + F.count("*") - 1).alias("frame_pairs"),
        F.sum(F.when(F.col("event_type") == "signup", F.col("n")).otherwise(0)).alias("scene_cuts"),
    )


@kernel("""
    WITH s AS (SELECT *, event_type IN ('click', 'purchase') AS pic, event_type IN ('click', 'purchase', 'signup') AS sig FROM events),
    l AS (SELECT *, row_number() OVER w AS n, last_value(CASE WHEN sig THEN pic END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CAST(sum(CASE WHEN n = 1 OR (sig AND coalesce(prev, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS unit FROM l""")
def access_units(spark, sf_dir):
    """WIN-03: pictures (click, purchase) and leaders (signup) grouped to access units."""
    picture, leader = F.col("event_type").isin("click", "purchase"), F.col("event_type") == "signup"
    return windows.access_units(frames(spark, sf_dir), ["user_id"], ORDER, picture, leader, chunk=DAY("ts")).select("event_id", "unit")


@kernel("""
    SELECT event_id, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM events""")
def prefix_sums(spark, sf_dir):
    """WIN-04, SRC-06: offset of each sample, the sum of the sizes before it."""
    sized = frames(spark, sf_dir).withColumn("size", F.round(F.col("value") * 100).cast("long"))
    return windows.with_prefix_sum(sized, ["user_id"], ORDER, "size", DAY("ts"), "byte_offset").select("event_id", "byte_offset")


@kernel("""
    WITH t AS (SELECT user_id, (CAST(round(value * 1000) AS BIGINT) * 40507) % 1000000 AS ticks, event_type, ts, event_id FROM events),
    a AS (SELECT user_id, arg_min(ticks, row(ts, event_id)) AS f, arg_max(ticks, row(ts, event_id)) AS l, bool_or(event_type = 'error') AS broken FROM t GROUP BY user_id),
    s AS (SELECT user_id, broken, (CASE WHEN l < f THEN l - f + 1000000 ELSE l - f END) / 90.0 AS secs FROM a)
    SELECT user_id, CASE WHEN NOT broken AND secs > 0 AND secs <= 9000 THEN CAST(secs AS DOUBLE) END AS secs FROM s""")
def clock_duration(spark, sf_dir):
    """WIN-05: first and last clock value with wrap, void if a discontinuity was seen."""
    ticks = F.pmod(F.round(F.col("value") * 1000).cast("long") * 40507, F.lit(1_000_000))
    return windows.clock_span(frames(spark, sf_dir), ["user_id"], at(), ticks, F.col("event_type") == "error", 1_000_000, 90, 9000)


@kernel("""
    WITH e AS (SELECT user_id AS k, ts, event_id, CAST(length(event_type) AS BIGINT) AS s, CAST(event_id % 3 AS BIGINT) AS c FROM events),
    f AS (SELECT *, row_number() OVER w AS n, lead(event_id) OVER w AS nx FROM e WHERE c > 0 WINDOW w AS (PARTITION BY k, date_trunc('day', ts) ORDER BY ts, event_id)),
    g AS (SELECT k, CAST(date_trunc('day', ts) AS DATE) AS d, s FROM f WHERE NOT (c = 1 AND nx IS NULL AND n > 1))
    SELECT k AS user_id, d AS day, CASE WHEN min(s) = max(s) THEN min(s) END AS step FROM g GROUP BY k, d""")
def uniform_step(spark, sf_dir):
    """WIN-06: the one step that all entries of a table share, a lone last entry aside."""
    e = frames(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return windows.uniform_step(e, ["user_id", "day"], at(), F.length("event_type").cast("long"), (F.col("event_id") % 3).cast("long"))


@kernel("""
    WITH a AS (SELECT user_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events GROUP BY user_id),
    r AS (SELECT user_id, CASE WHEN n > 1 AND span > 0 THEN 1000000.0::DOUBLE * (n - 1) / span END AS raw FROM a)
    SELECT user_id, CASE WHEN raw > 0 AND raw <= 480 THEN raw END AS fps FROM r""")
def average_rate(spark, sf_dir):
    """WIN-07: ticks * (n - 1) / (last - first), within (0, 480]."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    a = frames(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), (F.max(us) - F.min(us)).alias("span"))
    raw = F.when((F.col("n") > 1) & (F.col("span") > 0), F.lit(1e6) * (F.col("n") - 1) / F.col("span"))
    return a.select("user_id", F.when((raw > 0) & (raw <= 480), raw).alias("fps"))


@kernel("""
    SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chunk_entry FROM events""")
def as_of_entry(spark, sf_dir):
    """SRC-06: the last table entry at or before each sample."""
    entry = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return windows.as_of(frames(spark, sf_dir), ["user_id"], ORDER, entry, "chunk_entry", chunk=DAY("ts")).select("event_id", "chunk_entry")


# ---- aggregates


@kernel("""
    SELECT user_id, count(*) AS rpu_count, first(value ORDER BY ts, event_id) FILTER (WHERE event_type = 'purchase') AS first_value,
           first(event_id ORDER BY ts, event_id) FILTER (WHERE event_type = 'purchase') AS first_event, first(props ORDER BY ts, event_id) FILTER (WHERE event_type = 'error') AS first_props,
           array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id""")
def first_wins(spark, sf_dir):
    """AGG-01, AGG-07: first known value by order; fields of one row move together."""
    together = F.when(F.col("event_type") == "purchase", F.struct("value", "event_id"))
    return (
        frames(spark, sf_dir)
        .groupBy("user_id")
        .agg(F.count("*").alias("rpu_count"), ordered.first_known(together, at()).alias("p"), ordered.first_known(F.when(F.col("event_type") == "error", F.col("props")), at()).alias("first_props"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("kinds"))
        .select("user_id", "rpu_count", F.col("p.value").alias("first_value"), F.col("p.event_id").alias("first_event"), "first_props", "kinds")
    )


@kernel("""
    WITH l AS (SELECT user_id, event_type AS level, 1 AS w FROM events UNION ALL SELECT user_id, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR), 1 FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)
    SELECT user_id, level, count(*) AS rows_with FROM l GROUP BY user_id, level""")
def level_census(spark, sf_dir):
    """AGG-03: frames with at least one block of each level."""
    k = F.get_json_object("props", "$.k")
    return ordered.census(frames(spark, sf_dir), ["user_id"], F.array_compact(F.array(F.col("event_type"), F.concat(F.lit("k"), k))))


@kernel("""
    WITH f AS (SELECT user_id, event_type, min(row(ts, event_id)) AS o FROM events GROUP BY user_id, event_type)
    SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS areas FROM f GROUP BY user_id""")
def first_seen(spark, sf_dir):
    """AGG-05: different values in the order of first appearance."""
    return ordered.distinct_in_order(frames(spark, sf_dir), ["user_id"], "event_type", at()).select("user_id", F.concat_ws(",", "seen").alias("areas"))


@kernel("""
    WITH e AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, ts, event_id FROM events),
    f AS (SELECT user_id, v, min(row(ts, event_id)) AS o FROM e GROUP BY user_id, v),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS i FROM f)
    SELECT user_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS targets FROM n WHERE i <= 8 GROUP BY user_id""")
def capped_union(spark, sf_dir):
    """AGG-08: union of targets in order of appearance, the first eight."""
    e = frames(spark, sf_dir).withColumn("v", F.floor("value").cast("long"))
    return ordered.distinct_in_order(e, ["user_id"], "v", at(), 8).select("user_id", F.concat_ws(",", F.transform("seen", lambda x: x.cast("string"))).alias("targets"))


@kernel("""
    WITH s AS (SELECT s_nationkey AS k, CAST(s_suppkey % 50 AS BIGINT) AS idx, 8 AS level FROM supplier), c AS (SELECT c_nationkey AS k, CAST(c_custkey % 7 AS BIGINT) AS idx FROM customer),
    ten AS (SELECT k, idx, CAST(500 + 100 * idx AS BIGINT) AS nits FROM c WHERE idx IN (2, 5)),
    t(idx, nits) AS (VALUES (1, 100), (16, 48), (18, 48), (21, 48), (24, 300), (25, 300), (27, 600), (28, 600), (37, 2000), (38, 2000), (42, 108), (48, 1000), (49, 1000)),
    l10 AS (SELECT k, idx, max(nits) AS nits FROM ten GROUP BY k, idx),
    u AS (SELECT s.k, coalesce(l10.nits, t.nits) AS nits, '8' AS level FROM s LEFT JOIN l10 ON s.k = l10.k AND s.idx = l10.idx LEFT JOIN t ON s.idx = t.idx
          UNION ALL SELECT k, CAST(100 * (1 + idx) AS BIGINT), '2' FROM c UNION ALL SELECT k, nits, '8' FROM l10)
    SELECT k AS nation, CAST(nits AS BIGINT) AS nits, string_agg(DISTINCT level, ',' ORDER BY level) AS levels FROM u WHERE nits IS NOT NULL GROUP BY k, nits""")
def trim_targets(spark, sf_dir):
    """AGG-06, SET-01, JOIN-05: targets in nits with the levels they come from; an index is resolved by the title's own
    definitions, then the fixed table, and dropped if neither knows it."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("idx"))
    own = c.where("idx IN (2, 5)").groupBy("nation", "idx").agg(F.max(500 + 100 * F.col("idx")).alias("nits"))
    maps = own.groupBy("nation").agg(F.map_from_entries(F.collect_list(F.struct("idx", "nits"))).alias("own"))
    eight = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 50).cast("long").alias("idx")).join(maps, "nation", "left")
    fixed = {k: v for k, v in labels.TARGET_NITS.items()}
    eight = eight.select("nation", F.coalesce(F.try_element_at("own", "idx"), labels_nits(F.col("idx"), fixed)).alias("nits"), F.lit("8").alias("level"))
    two = c.select("nation", (100 * (1 + F.col("idx"))).cast("long").alias("nits"), F.lit("2").alias("level"))
    both = eight.unionByName(two).unionByName(own.select("nation", "nits", F.lit("8").alias("level"))).where("nits IS NOT NULL")
    return both.groupBy("nation", "nits").agg(F.concat_ws(",", F.array_sort(F.collect_set("level"))).alias("levels"))


def labels_nits(idx, fixed):
    return F.try_element_at(F.create_map(*(F.lit(x).cast("long") for kv in fixed.items() for x in kv)), idx)


@kernel("""
    SELECT user_id, coalesce(first(event_id ORDER BY ts, event_id) FILTER (WHERE event_type = 'purchase' AND value > 50), min(event_id) FILTER (WHERE event_type = 'click')) AS chosen FROM events GROUP BY user_id""")
def inband_first(spark, sf_dir):
    """AGG-09: in-band evidence first, else the first side payload by offset."""
    inband = ordered.first_known(F.when((F.col("event_type") == "purchase") & (F.col("value") > 50), F.col("event_id")), at())
    side = ordered.first_known(F.when(F.col("event_type") == "click", F.col("event_id")), F.col("event_id"))
    return frames(spark, sf_dir).groupBy("user_id").agg(F.coalesce(inband, side).alias("chosen"))


@kernel("""
    WITH a AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n, first(CAST(event_id % 11 AS INTEGER) ORDER BY ts, event_id) FILTER (WHERE event_type = 'error') AS profile,
               first(CASE WHEN event_id % 2 = 0 THEN 'FEL' ELSE 'MEL' END ORDER BY ts, event_id) FILTER (WHERE event_type = 'error') AS el FROM events GROUP BY user_id)
    SELECT user_id, n AS rpu_count, CASE WHEN profile = 8 THEN '8.1' WHEN profile = 7 THEN '7.6 (' || el || ')' WHEN profile = 4 THEN '4.2 (' || el || ')' ELSE CAST(profile AS VARCHAR) END AS profile,
           CASE WHEN profile = 7 THEN 'Single track, dual layer' END AS structure, CAST(greatest(3840 - CAST(n AS INTEGER) * 300, 0) AS INTEGER) AS active_width FROM a WHERE n > 0""")
def dv_section(spark, sf_dir):
    """AGG-10, AGG-11: the finished section, absent without any parsed unit; widths saturate at zero."""
    is_rpu = F.col("event_type") == "error"
    facts = ordered.first_known(F.when(is_rpu, F.struct((F.col("event_id") % 11).cast("int").alias("profile"), F.when(F.col("event_id") % 2 == 0, "FEL").otherwise("MEL").alias("el"))), at())
    a = frames(spark, sf_dir).groupBy("user_id").agg(F.count_if(is_rpu).alias("rpu_count"), facts.alias("f")).where("rpu_count > 0")
    p = F.col("f.profile")
    return a.select("user_id", "rpu_count", labels.dv_profile(p, F.lit(None).cast("int"), F.col("f.el")).alias("profile"), labels.structure(p == 7, F.lit(False)).alias("structure"), F.greatest(F.lit(3840) - F.col("rpu_count").cast("int") * 300, F.lit(0)).alias("active_width"))


@kernel("""
    WITH p AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    u AS (SELECT user_id, CAST(count(prev) AS BIGINT) AS pairs, CAST(count_if(prev <> event_type) AS BIGINT) AS changes FROM p GROUP BY user_id UNION ALL SELECT c_custkey, 10, 1 FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT user_id, CAST(sum(pairs) AS BIGINT) AS frame_pairs, CAST(sum(changes) AS BIGINT) AS changed_pairs FROM u GROUP BY user_id""")
def cadence_evidence(spark, sf_dir):
    """AGG-12: evidence counted elsewhere joins the counted pairs as rows."""
    pairs = windows.with_previous(frames(spark, sf_dir), ["user_id"], ORDER, "event_type", chunk=DAY("ts"))
    seen = pairs.groupBy("user_id").agg(F.count("prev").alias("pairs"), F.count_if(F.col("prev") != F.col("event_type")).alias("changes"))
    given = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.lit(10).cast("long").alias("pairs"), F.lit(1).cast("long").alias("changes"))
    return seen.unionByName(given).groupBy("user_id").agg(F.sum("pairs").alias("frame_pairs"), F.sum("changes").alias("changed_pairs"))


@kernel("SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) AS frames FROM lineitem GROUP BY l_suppkey")
def stream_totals(spark, sf_dir):
    """AGG-13: bytes and frames of each track."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"), F.count("*").alias("frames"))


@kernel("""
    WITH d AS (SELECT DISTINCT l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS a, CAST(l_discount * 1000 AS BIGINT) AS b FROM lineitem)
    SELECT l_suppkey, CAST(sum(greatest(b - a, 0)) AS BIGINT) / 45000.0::DOUBLE AS duration_secs FROM d GROUP BY l_suppkey""")
def playlist_duration(spark, sf_dir):
    """AGG-14: ticks of different (clip, in, out), saturating at zero, over 45 000."""
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("a"), F.round(F.col("l_discount") * 1000).cast("long").alias("b")).distinct()
    return d.groupBy("l_suppkey").agg((F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))) / F.lit(45000.0)).alias("duration_secs"))


@kernel("""
    WITH a AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, CAST(max(CAST(l_quantity AS BIGINT)) - 45 AS DOUBLE) AS secs FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, CASE WHEN bytes > 0 AND secs > 0 THEN bytes * 8 / secs END AS bits_per_sec, CASE WHEN bytes > 0 AND secs > 0 THEN 'video_stream' END AS scope FROM a""")
def bitrate(spark, sf_dir):
    """AGG-15: bits a second with its scope, absent without bytes or a positive duration."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"), (F.max(F.col("l_quantity").cast("long")) - 45).cast("double").alias("secs"))
    ok = (F.col("bytes") > 0) & (F.col("secs") > 0)
    return a.select("l_suppkey", F.when(ok, F.col("bytes") * 8 / F.col("secs")).alias("bits_per_sec"), F.when(ok, "video_stream").alias("scope"))


EXTENTS = "SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 1 + o_orderkey % 40 AS b FROM orders"


def extents(spark, sf_dir):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("a"), (day + 1 + F.col("o_orderkey") % 40).alias("b"))


@kernel(f"""
    WITH e AS ({EXTENTS}), m AS (SELECT *, lag(b) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey) AS p FROM e)
    SELECT o_custkey, CASE WHEN bool_and(p IS NULL OR p = a) THEN min(a) END AS a, CASE WHEN bool_and(p IS NULL OR p = a) THEN max(b) END AS b FROM m GROUP BY o_custkey""")
def coalesce_extents(spark, sf_dir):
    """AGG-16: one range if all extents are adjacent, else nothing."""
    return windows.coalesce_all(extents(spark, sf_dir), ["o_custkey"], ["a", "b", "o_orderkey"], "a", "b")


@kernel(f"""
    WITH e AS ({EXTENTS}), m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e),
    i AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey) AS g FROM m)
    SELECT o_custkey, min(a) AS a, max(b) AS b FROM i GROUP BY o_custkey, g""")
def merge_ranges(spark, sf_dir):
    """AGG-17: union of overlapping and adjacent ranges."""
    return windows.merge_intervals(extents(spark, sf_dir), ["o_custkey"], "a", "b")


# ---- selection


@kernel("""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events),
    r(k) AS (SELECT range FROM range(0, 12))
    SELECT event_id, i AS position FROM n WHERE c <= 16 OR i < 5 OR i IN (SELECT (k) * (c - 1) // 12 FROM r WHERE k >= 1) OR i IN ((c - 1) * 1 // 12)""")
def sample_positions(spark, sf_dir):
    """TOPK-01, TOPK-02: a head of a third and a whole-number spread over the rest, of every track."""
    return selection.select_rows(frames(spark, sf_dir), ["user_id"], ORDER, 16, chunk=DAY("ts")).select("event_id", "position")


@kernel("""
    WITH w AS (SELECT user_id, event_id, CAST(value * 100 AS BIGINT) AS width, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, min(CASE WHEN width >= 9000 THEN i END) AS stop FROM w GROUP BY user_id),
    b AS (SELECT w.*, row_number() OVER (PARTITION BY w.user_id ORDER BY width DESC, i) AS n FROM w JOIN s USING (user_id) WHERE stop IS NULL OR i <= stop)
    SELECT user_id, i, width, event_id FROM b WHERE n = 1""")
def widest_first(spark, sf_dir):
    """TOPK-03: the widest, first of equals, of those up to the first that is wide enough."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    rows = frames(spark, sf_dir).select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("width"), F.row_number().over(w).cast("long").alias("i"))
    return selection.first_widest(rows, ["user_id"], "i", "width", 9000, "event_id")


@kernel("""
    WITH c AS (SELECT c_nationkey AS nation, list({'name': c_name, 'p': c_acctbal, 's': CAST(length(c_mktsegment) AS BIGINT)} ORDER BY c_name) AS l FROM customer GROUP BY c_nationkey),
    f AS (SELECT nation, list_reduce(l, lambda a, x: CASE WHEN x.p - a.p > 250.0 OR (abs(x.p - a.p) <= 250.0 AND x.s > a.s) THEN x ELSE a END) AS b FROM c)
    SELECT nation, b.name AS c_name, b.p AS c_acctbal, b.s AS seg FROM f""")
def main_playlist(spark, sf_dir):
    """TOPK-04: fold in name order; duration decides beyond the tolerance, else size."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_name", "c_acctbal", F.length("c_mktsegment").cast("long").alias("seg"))
    return ordered.fold_with_tolerance(c, ["nation"], "c_name", "c_acctbal", "seg", 250.0)


STANDARD = ", ".join(f"({i}, {s})" for i, s in enumerate(luminance.STANDARD_NITS))


@kernel(f"""
    WITH t(i, s) AS (VALUES {STANDARD}), p AS (SELECT p_partkey, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS n FROM part),
    d AS (SELECT p_partkey, n, i, s, abs(n - s) AS d FROM p, t WHERE abs(n - s) <= CAST(floor(greatest(s * 0.04, 10)) AS BIGINT)),
    b AS (SELECT p_partkey, arg_min(s, row(d, i)) AS s FROM d GROUP BY p_partkey)
    SELECT p.p_partkey, CAST(coalesce(b.s, p.n) AS BIGINT) AS nits FROM p LEFT JOIN b USING (p_partkey)""")
def nearest_standard(spark, sf_dir):
    """TOPK-05: snap to the nearest standard target within its tolerance."""
    return table(spark, sf_dir, "part").select("p_partkey", luminance.nearest_standard(F.col("p_retailprice")).alias("nits"))


@kernel("""
    WITH s AS (SELECT *, CAST(floor(value) AS BIGINT) AS size FROM events),
    p AS (SELECT *, coalesce(sum(size) OVER w, 0) AS past, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id FROM p WHERE past < 500 AND n < 8""")
def bounded_head(spark, sf_dir):
    """TOPK-06: a head bounded by bytes and by rows."""
    sized = frames(spark, sf_dir).withColumn("size", F.floor("value").cast("long"))
    return selection.bounded_head(sized, ["user_id"], ORDER, "size", 500, 8, chunk=DAY("ts")).select("event_id")


# ---- joins


@kernel("""
    WITH t AS (SELECT c_nationkey AS file, c_custkey AS track, c_custkey % 5 = 0 AS layer, CAST(length(c_name) + c_custkey % 3 AS BIGINT) AS area, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS codec, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS rate FROM customer),
    g AS (SELECT file, arg_max(track, row(area, track)) AS track FROM t WHERE NOT layer GROUP BY file),
    e AS (SELECT file, first(codec ORDER BY track) FILTER (WHERE codec IS NOT NULL) AS codec, first(rate ORDER BY track) FILTER (WHERE rate IS NOT NULL) AS rate FROM t WHERE layer GROUP BY file)
    SELECT t.file, t.track, CASE WHEN g.track IS NOT NULL THEN coalesce(t.codec, e.codec) ELSE t.codec END AS codec, CASE WHEN g.track IS NOT NULL THEN coalesce(t.rate, e.rate) ELSE t.rate END AS rate,
           g.track IS NOT NULL AND e.file IS NOT NULL AS dual_track
    FROM t LEFT JOIN g ON t.file = g.file AND t.track = g.track LEFT JOIN e ON t.file = e.file WHERE NOT t.layer OR t.file NOT IN (SELECT file FROM g)""")
def fold_layers(spark, sf_dir):
    """JOIN-01: enhancement layers fold into the widest base, the last of equals; the base's own fields win."""
    c = table(spark, sf_dir, "customer")
    t = c.select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("track"), (F.length("c_name") + F.col("c_custkey") % 3).cast("long").alias("area"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("codec"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("rate"))
    return lookups.fold_layers(t, ["file"], F.col("track") % 5 == 0, F.col("area"), F.col("track"), ["codec", "rate"]).drop("area")


@kernel("""
    WITH b AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS bps FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
    SELECT CAST(c_custkey AS DECIMAL(20,0)) AS uid, bps FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def tags_by_uid(spark, sf_dir):
    """JOIN-02: tracks with their first usable tag; identifiers are unsigned 64-bit and so decimals."""
    uid = lambda c: F.col(c).cast("decimal(20,0)").alias("uid")
    tags = table(spark, sf_dir, "orders").select(uid("o_custkey"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("bps"))
    return lookups.first_usable(table(spark, sf_dir, "customer").select(uid("c_custkey")), tags, ["uid"], F.col("o_orderstatus") == "F", F.col("o_orderkey"), "bps")


@kernel("""
    WITH t AS (SELECT s_nationkey AS file, s_suppkey AS track, s_suppkey % 4 = 1 AS layer, s_suppkey % 6 = 0 AS has_config, CAST(floor(s_acctbal) AS BIGINT) AS area, CASE WHEN s_suppkey % 6 = 0 OR s_suppkey % 4 = 1 THEN s_name END AS config FROM supplier),
    g AS (SELECT file, coalesce(min(track) FILTER (WHERE has_config), arg_max(track, row(area, track))) AS track FROM t WHERE NOT layer GROUP BY file),
    e AS (SELECT file, first(config ORDER BY track) AS config FROM t WHERE layer GROUP BY file)
    SELECT t.file, t.track, CASE WHEN g.track IS NOT NULL THEN coalesce(t.config, e.config) ELSE t.config END AS config, g.track IS NOT NULL AND e.file IS NOT NULL AS dual_track
    FROM t LEFT JOIN g ON t.file = g.file AND t.track = g.track LEFT JOIN e ON t.file = e.file WHERE NOT t.layer OR t.file NOT IN (SELECT file FROM g)""")
def fold_by_config(spark, sf_dir):
    """JOIN-03: the first base with a configuration is the target, else the last widest; the layer's is used if the base has none."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("track"), F.floor("s_acctbal").cast("long").alias("area"), F.when((F.col("s_suppkey") % 6 == 0) | (F.col("s_suppkey") % 4 == 1), F.col("s_name")).alias("config"))
    has = F.col("track") % 6 == 0
    rank = F.struct(has.cast("int").alias("h"), F.when(has, -F.col("track")).otherwise(F.col("area")).alias("r"))
    return lookups.fold_layers(s, ["file"], F.col("track") % 4 == 1, rank, F.col("track"), ["config"]).drop("area")


@kernel("""
    WITH t AS (SELECT c_nationkey AS program, c_custkey AS pid, CASE WHEN c_custkey % 4 = 0 THEN c_custkey - 25 END AS dep, c_custkey % 4 = 0 AS layer FROM customer),
    f AS (SELECT program, min(pid) AS pid FROM t WHERE NOT layer GROUP BY program)
    SELECT l.pid AS layer_pid, coalesce(b.pid, f.pid) AS base_pid FROM t l LEFT JOIN t b ON NOT b.layer AND l.program = b.program AND l.dep = b.pid LEFT JOIN f ON l.program = f.program WHERE l.layer""")
def fold_by_dependency(spark, sf_dir):
    """JOIN-04: a layer names its base by PID within its program, else it is the program's first base."""
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("program"), F.col("c_custkey").alias("pid"))
    bases = t.where("pid % 4 <> 0")
    layers = t.where("pid % 4 = 0").select("program", F.col("pid").alias("layer_pid"), (F.col("pid") - 25).alias("dep"))
    first = bases.groupBy("program").agg(F.min("pid").alias("first"))
    named = layers.join(bases.select("program", F.col("pid").alias("dep"), F.col("pid").alias("named")), ["program", "dep"], "left").join(first, "program", "left")
    return named.select("layer_pid", F.coalesce("named", "first").alias("base_pid"))


LEVELS = ", ".join(f"({n}, {w * h * r}, {w})" for n, w, h, r in DV_LEVELS)


@kernel(f"""
    WITH t(level, rate, width) AS (VALUES {LEVELS}), p AS (SELECT p_partkey, p_size * 160 AS w, p_size * 90 AS h, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 12.0::DOUBLE * (1 + p_partkey % 5) END AS fps FROM part)
    SELECT p_partkey, CAST(min(level) AS INTEGER) AS level FROM p LEFT JOIN t ON CAST(w AS DOUBLE) * h * fps <= t.rate AND w <= t.width AND fps > 0 GROUP BY p_partkey""")
def level_table(spark, sf_dir):
    """JOIN-06: smallest level whose pixel rate and width admit the stream, null without dimensions or rate."""
    w, h = F.col("p_size") * 160, F.col("p_size") * 90
    fps = F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.lit(12.0) * (1 + F.col("p_partkey") % 5))
    return table(spark, sf_dir, "part").select("p_partkey", dv_level(w, h, fps).alias("level"))


def dv_level(width, height, fps):
    rate = width.cast("double") * height * fps
    fits = [((width > 0) & (height > 0) & (fps > 0) & (rate <= float(w * h * r)) & (width <= w), n) for n, w, h, r in DV_LEVELS]
    return lookups.smallest_admitting(fits, [n for _, n in fits])


@kernel(f"""
    WITH e AS ({EXTENTS}), q AS (SELECT DISTINCT o_custkey, a + 3 AS x FROM e)
    SELECT q.o_custkey, q.x, min(e.o_orderkey) AS o_orderkey FROM q LEFT JOIN e ON q.o_custkey = e.o_custkey AND q.x >= e.a AND q.x < e.b GROUP BY q.o_custkey, q.x""")
def containing_unit(spark, sf_dir):
    """JOIN-07: the first range that holds a point, by an equality join on bins."""
    e = extents(spark, sf_dir)
    points = e.select("o_custkey", (F.col("a") + 3).alias("x")).distinct()
    return lookups.contains_point(e, points, ["o_custkey"], "a", "b", "x", 32, "o_orderkey")


@kernel("""
    WITH i AS (SELECT l_suppkey, l_orderkey, l_partkey FROM lineitem), present AS (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0),
    w AS (SELECT l_suppkey, l_orderkey, array_to_string(list(l_partkey ORDER BY l_partkey), ',') AS items FROM i GROUP BY l_suppkey, l_orderkey HAVING bool_and(l_partkey IN (SELECT p_partkey FROM present)))
    SELECT l_suppkey, items, min(l_orderkey) AS l_orderkey FROM w GROUP BY l_suppkey, items""")
def complete_playlists(spark, sf_dir):
    """JOIN-09: playlists with all clips present; of equal item sequences the first by name."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey")
    present = table(spark, sf_dir, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    out = lookups.complete_and_first(items, ["l_suppkey"], "l_orderkey", F.col("l_partkey"), present, "l_partkey")
    return out.select("l_suppkey", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"), "l_orderkey")


@kernel("""
    WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN 'T' || c_custkey % 4 END AS transfer, CASE WHEN c_custkey % 5 > 0 THEN 'P' || c_custkey % 2 END AS primaries, CASE WHEN c_custkey % 4 = 0 THEN 'full' END AS color_range FROM customer),
    s AS (SELECT s_suppkey AS k, 'ST' AS transfer, 'SP' AS primaries, 'limited' AS color_range FROM supplier)
    SELECT c.k, CASE WHEN c.transfer IS NULL AND s.k IS NOT NULL THEN s.transfer ELSE c.transfer END AS transfer, CASE WHEN c.transfer IS NULL AND s.k IS NOT NULL THEN s.primaries ELSE c.primaries END AS primaries,
           CASE WHEN c.transfer IS NULL AND s.k IS NOT NULL THEN s.color_range ELSE coalesce(c.color_range, s.color_range) END AS color_range FROM c LEFT JOIN s ON c.k = s.k""")
def color_gap_fill(spark, sf_dir):
    """JOIN-10: the stream's whole colour where the container has no transfer, else only its range."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("k"), F.struct(F.when(k % 3 > 0, F.concat(F.lit("T"), (k % 4).cast("string"))).alias("transfer"), F.when(k % 5 > 0, F.concat(F.lit("P"), (k % 2).cast("string"))).alias("primaries"), F.when(k % 4 == 0, "full").alias("color_range")).alias("own"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.struct(F.lit("ST").alias("transfer"), F.lit("SP").alias("primaries"), F.lit("limited").alias("color_range")).alias("stream"))
    return c.join(s, "k", "left").select("k", fill_color(F.col("own"), F.col("stream")).alias("c")).select("k", "c.*")


def fill_color(own, stream):
    take = own["transfer"].isNull() & stream.isNotNull()
    return F.when(take, stream).otherwise(own.withField("color_range", F.coalesce(own["color_range"], stream["color_range"])))


MOUNTS = ["", "C", "Customer#0000", "Customer#00000", "Customer#000001", "Customer#0000012"]


@kernel(f"""
    WITH m(i, p) AS (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(MOUNTS))})
    SELECT c_custkey, arg_max(p, row(length(p), i)) AS mount FROM customer JOIN m ON starts_with(c_name, p) GROUP BY c_custkey""")
def longest_prefix(spark, sf_dir):
    """JOIN-11: the mount point with the longest matching prefix."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", lookups.longest_prefix(c, F.col("c_name"), MOUNTS).alias("mount"))


# ---- set operations


@kernel("""
    SELECT c_nationkey AS file, 0 AS src, c_custkey AS chunk FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_nationkey, 1, c_custkey FROM customer WHERE c_custkey % 5 = 0""")
def base_then_layer(spark, sf_dir):
    """SET-02: base samples, then layer samples, kept apart by an ordinal."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0).alias("src"), F.col("c_custkey").alias("chunk"))
    return c.where("src = 0").unionByName(c.where("src = 1"))



@kernel("""
    WITH c AS (SELECT DISTINCT user_id, CAST(floor(value * 41) AS BIGINT) % 8 AS i FROM events), m(i, n) AS (VALUES (0, 10), (1, 100), (2, 500), (3, 1000), (4, 2000), (5, 4000), (6, 10000), (7, 0))
    SELECT user_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS nits FROM c JOIN m USING (i) GROUP BY user_id""")
def distinct_nits(spark, sf_dir):
    """SET-03: PQ codes to their different standard nits, sorted."""
    codes = F.array(*(F.lit(x) for x in (1229, 2081, 2770, 3079, 3388, 3696, 4095, 0)))
    code = F.get(codes, (F.floor(F.col("value") * 41).cast("long") % 8).cast("int"))
    per = frames(spark, sf_dir).groupBy("user_id").agg(F.collect_set(code).alias("codes"))
    return per.select("user_id", F.concat_ws(",", F.transform(luminance.distinct_targets(F.col("codes")), lambda x: x.cast("string"))).alias("nits"))


# ---- scalar functions


def pq_sql(code):
    e = f"power({code} / 4095.0::DOUBLE, {1 / luminance.M2!r}::DOUBLE)"
    return f"10000.0::DOUBLE * power(greatest({e} - {luminance.C1!r}, 0) / ({luminance.C2!r} - {luminance.C3!r} * {e}), {1 / luminance.M1!r}::DOUBLE)"


@kernel(f"SELECT p_partkey, round({pq_sql('(p_partkey * 37 % 4096)')}, 4) AS nits FROM part")
def pq_nits(spark, sf_dir):
    """FN-01: PQ code to cd/m2, to four decimals."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(luminance.pq_nits(F.col("p_partkey") * 37 % 4096), 4).alias("nits"))


@kernel(f"""
    WITH t(i, s) AS (VALUES {STANDARD}), p AS (SELECT p_partkey, p_partkey * 53 % 4096 AS hi, p_partkey % 90 AS lo FROM part),
    n AS (SELECT p_partkey, hi, CAST(floor({pq_sql('hi')} + 0.5) AS BIGINT) AS n, floor({pq_sql('lo')} * 10000 + 0.5) / 10000 AS low FROM p),
    d AS (SELECT p_partkey, arg_min(s, row(abs(n - s), i)) AS s FROM n, t WHERE abs(n - s) <= CAST(floor(greatest(s * 0.04, 10)) AS BIGINT) GROUP BY p_partkey)
    SELECT n.p_partkey, CASE WHEN hi > 0 THEN CAST(coalesce(s, n) AS DOUBLE) END AS max_luminance, CASE WHEN hi > 0 THEN low END AS min_luminance FROM n LEFT JOIN d USING (p_partkey)""")
def source_range(spark, sf_dir):
    """FN-02: PQ range of a grade to mastering luminance."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", luminance.source_range(k % 90, k * 53 % 4096).alias("r")).select("p_partkey", "r.*")


@kernel("""
    WITH g AS (SELECT p_partkey, p_partkey % 6 AS kind FROM part)
    SELECT p_partkey, CASE kind WHEN 0 THEN 'BT.2020' WHEN 1 THEN 'DCI-P3 D65' WHEN 2 THEN 'DCI-P3' WHEN 3 THEN 'BT.709' END AS gamut FROM g""")
def gamut_match(spark, sf_dir):
    """FN-03: primaries in any slot order within the tolerance; other coordinates have no name."""
    k, xy = F.col("p_partkey"), lambda x, y, e: F.struct((F.lit(x) + e).alias("x"), (F.lit(y) - e).alias("y"))
    e = (k % 5 - 2) * F.lit(0.0001)
    rows = [(luminance.GAMUTS[i][1:] if i < 4 else ((0.64, 0.34), (0.3, 0.61), (0.15, 0.06), (0.3127, 0.329)) if i == 4 else ((0.68, 0.32), (0.265, 0.69), (0.15, 0.06), (0.32, 0.34))) for i in range(6)]
    points = [F.get(F.array(*(xy(*r[s], e) for r in rows)), (k % 6).cast("int")) for s in range(4)]
    turned = [F.when(k % 3 == 0, points[s]).when(k % 3 == 1, points[(s + 1) % 3]).otherwise(points[(s + 2) % 3]) for s in range(3)]
    return table(spark, sf_dir, "part").select("p_partkey", luminance.gamut(*turned, points[3]).alias("gamut"))


def case_sql(expr, names, otherwise="NULL"):
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {otherwise} END"


@kernel(f"SELECT p_partkey, {case_sql('p_size', labels.PRIMARIES)} AS primaries, {case_sql('p_size', labels.TRANSFER)} AS transfer, {case_sql('p_size', labels.MATRIX)} AS matrix FROM part")
def cicp_labels(spark, sf_dir):
    """FN-04: code points to names, unknown ones to null."""
    n = lambda t: labels.named(F.col("p_size"), t)
    return table(spark, sf_dir, "part").select("p_partkey", n(labels.PRIMARIES).alias("primaries"), n(labels.TRANSFER).alias("transfer"), n(labels.MATRIX).alias("matrix"))


UNKNOWN = "'unknown'"


@kernel(f"""
    SELECT p_partkey, {case_sql('p_size - 1', labels.MASTERING_INDEX, UNKNOWN)} AS mastering, {case_sql('p_size - 1', labels.CONTENT_TYPE, "'Unknown'")} AS content,
           CASE p_size - 1 WHEN 0 THEN 'D65' WHEN 8 THEN 'D93' ELSE 'code ' || CAST(p_size - 1 AS VARCHAR) END AS white_point FROM part""")
def enum_labels(spark, sf_dir):
    """FN-05: names of coded display, content and white point values."""
    c = F.col("p_size") - 1
    return table(spark, sf_dir, "part").select("p_partkey", labels.named(c, labels.MASTERING_INDEX, "unknown").alias("mastering"), labels.named(c, labels.CONTENT_TYPE, "Unknown").alias("content"), labels.white_point(c).alias("white_point"))


FORMAT_INPUT = """SELECT c_custkey AS k, c_custkey % 3 = 0 AS dv, c_custkey % 7 = 0 AS plus, CASE WHEN c_custkey % 11 = 0 THEN 1 + c_custkey % 3 END AS sl, c_custkey % 13 = 0 AS vivid,
    CASE c_custkey % 4 WHEN 0 THEN 'PQ (SMPTE ST 2084)' WHEN 1 THEN 'HLG (ARIB STD-B67)' WHEN 2 THEN 'BT.709' END AS transfer, CASE WHEN c_custkey % 5 = 0 THEN 18 WHEN c_custkey % 17 = 0 THEN 16 END AS preferred,
    CASE WHEN c_custkey % 19 = 0 THEN 'IPT-PQ-c2' END AS matrix, CASE WHEN c_custkey % 6 = 0 THEN '4.2' ELSE '8.1' END AS profile, CASE WHEN c_custkey % 8 < 7 THEN c_custkey % 8 END AS compat FROM customer"""


@kernel(f"""
    WITH i AS ({FORMAT_INPUT}), b AS (SELECT *, coalesce(transfer LIKE '%PQ%', false) OR coalesce(preferred = 16, false) AS pq, coalesce(transfer LIKE '%HLG%', false) OR coalesce(preferred = 18, false) AS hlg, coalesce(matrix = 'IPT-PQ-c2', false) AS ipt FROM i)
    SELECT k, concat_ws(' / ', CASE WHEN dv THEN 'Dolby Vision' END, CASE WHEN plus THEN 'HDR10+' END, CASE WHEN sl IS NOT NULL THEN 'SL-HDR' || CAST(sl AS VARCHAR) END, CASE WHEN vivid THEN 'HDR Vivid' END,
        CASE WHEN pq AND NOT ipt THEN CASE WHEN dv THEN 'HDR10 (fallback)' ELSE 'HDR10' END WHEN hlg AND NOT ipt THEN CASE WHEN dv THEN 'HLG (fallback)' ELSE 'HLG' END
             WHEN dv THEN CASE WHEN profile LIKE '4%' THEN 'SDR (fallback)' WHEN compat IN (1, 6) THEN 'HDR10 (fallback)' WHEN compat = 2 THEN 'SDR (fallback)' WHEN compat = 4 THEN 'HLG (fallback)' END ELSE 'SDR' END) AS format FROM b""")
def hdr_format(spark, sf_dir):
    """FN-06: the format line of dynamic kinds and base."""
    k = F.col("c_custkey")
    transfer = F.when(k % 4 == 0, "PQ (SMPTE ST 2084)").when(k % 4 == 1, "HLG (ARIB STD-B67)").when(k % 4 == 2, "BT.709")
    line = labels.hdr_format(k % 3 == 0, F.when(k % 6 == 0, "4.2").otherwise("8.1"), F.when(k % 8 < 7, k % 8), k % 7 == 0, F.when(k % 11 == 0, 1 + k % 3), k % 13 == 0, transfer, F.when(k % 5 == 0, 18).when(k % 17 == 0, 16), F.when(k % 19 == 0, "IPT-PQ-c2"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), line.alias("format"))


@kernel("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_acctbal > 0 AND 4000.0 > c_acctbal * 1.1 THEN c_acctbal END AS bl_max_nits, CASE WHEN c_custkey % 2 = 0 AND c_acctbal > 0 AND 4000.0 > c_acctbal * 1.1 THEN 4000.0::DOUBLE END AS rpu_max_nits FROM customer""")
def fel_expansion(spark, sf_dir):
    """FN-07: evidence where the grade is brighter than the base by more than a tenth."""
    kind = F.when(F.col("c_custkey") % 2 == 0, "FEL").otherwise("MEL")
    return table(spark, sf_dir, "customer").select("c_custkey", labels.fel_expansion(kind, F.col("c_acctbal"), F.lit(4000.0)).alias("x")).select("c_custkey", "x.*")


@kernel("""
    WITH i AS (SELECT c_custkey, c_mktsegment AS bl, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS rpu, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 9 END AS lvl FROM customer)
    SELECT c_custkey, CASE WHEN lvl = 9 AND bl <> rpu THEN bl END AS bl_primaries, CASE WHEN lvl = 9 AND bl <> rpu THEN rpu END AS rpu_primaries FROM i""")
def primaries_mismatch(spark, sf_dir):
    """FN-08: names that differ between the base and the grade, for recognised grades only."""
    rpu = F.when(F.col("c_custkey") % 3 == 0, "BUILDING").otherwise(F.col("c_mktsegment"))
    out = labels.primaries_mismatch(F.col("c_mktsegment"), rpu, F.when(F.col("c_custkey") % 4 == 0, 0).otherwise(9))
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("x")).select("c_custkey", "x.*")


def level_sql(expr, unit, step):
    return f"CAST({expr} // {unit} AS VARCHAR) || CASE WHEN ({expr} % {unit}) // {step} = 0 THEN '' ELSE '.' || CAST(({expr} % {unit}) // {step} AS VARCHAR) END"


OTHER = "'profile ' || CAST(p_size AS VARCHAR)"


@kernel(f"""
    SELECT p_partkey, {case_sql('p_size', labels.HEVC_PROFILES, OTHER)} || ', ' || CASE WHEN p_partkey % 2 = 0 THEN 'High tier' ELSE 'Main tier' END || ' @ L' || {level_sql('(p_partkey % 187)', 30, 3)} AS hevc,
           CASE WHEN p_size * 2 = 100 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Constrained High' WHEN p_partkey % 3 = 1 THEN 'Progressive High' ELSE 'High' END ELSE {case_sql('p_size * 2', labels.AVC_PROFILES, "'profile ' || CAST(p_size * 2 AS VARCHAR)")} END || ' @ L' || {level_sql('(p_partkey % 53)', 10, 1)} AS avc,
           {case_sql('p_size % 4', labels.AV1_PROFILES, "'?'")} || ' profile, ' || CASE WHEN p_partkey % 2 = 1 THEN 'High tier' ELSE 'Main tier' END || CASE WHEN p_partkey % 32 = 31 THEN '' ELSE ' @ L' || CAST(2 + (p_partkey % 32) // 4 AS VARCHAR) || '.' || CAST(p_partkey % 4 AS VARCHAR) END AS av1 FROM part""")
def profile_labels(spark, sf_dir):
    """FN-09: codec profile, tier and level labels."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", labels.hevc_profile(s, k % 2 == 0, k % 187).alias("hevc"), labels.avc_profile(s * 2, k % 53, k % 3 < 2, k % 3 == 0).alias("avc"), labels.av1_profile(s % 4, k % 2, k % 32).alias("av1"))


@kernel("""
    WITH i AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '5' WHEN 1 THEN '10' ELSE '8.1' END AS p, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'HEVC' END AS codec, CASE WHEN c_custkey % 2 = 0 THEN 'BT.2020' END AS pr,
               CASE c_custkey % 4 WHEN 0 THEN 'PQ (SMPTE ST 2084)' WHEN 1 THEN 'HLG (ARIB STD-B67)' WHEN 2 THEN 'BT.709' END AS tr, CASE c_custkey % 5 WHEN 0 THEN 'IPT-PQ-c2' WHEN 1 THEN 'BT.2020 NCL' END AS mx FROM customer)
    SELECT k, CASE WHEN codec = '' THEN p WHEN p = '5' THEN '5.0' WHEN p = '10' THEN CASE WHEN mx = 'IPT-PQ-c2' THEN '10.0' WHEN tr = 'BT.709' THEN '10.2' WHEN pr = 'BT.2020' AND mx IS NOT NULL AND tr LIKE 'PQ%' THEN '10.1' WHEN pr = 'BT.2020' AND mx IS NOT NULL AND tr LIKE 'HLG%' THEN '10.4' ELSE p END ELSE p END AS profile FROM i""")
def dv_profile_display(spark, sf_dir):
    """FN-10: bare profiles completed where only one minor digit is possible."""
    k = F.col("c_custkey")
    tr = F.when(k % 4 == 0, "PQ (SMPTE ST 2084)").when(k % 4 == 1, "HLG (ARIB STD-B67)").when(k % 4 == 2, "BT.709")
    shown = labels.dv_profile_display(F.when(k % 3 == 0, "5").when(k % 3 == 1, "10").otherwise("8.1"), F.when(k % 7 == 0, "").otherwise("HEVC"), F.when(k % 2 == 0, "BT.2020"), tr, F.when(k % 5 == 0, "IPT-PQ-c2").when(k % 5 == 1, "BT.2020 NCL"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), shown.alias("profile"))


@kernel("""
    WITH i AS (SELECT o_orderkey, o_orderkey * o_orderkey * 977 AS b, CAST(o_orderkey * 531 AS DOUBLE) AS r, CAST(o_orderkey * 3 AS DOUBLE) / 2 AS d FROM orders), t AS (SELECT *, CAST(floor(d + 0.5) AS BIGINT) AS s FROM i)
    SELECT o_orderkey, CASE WHEN b >= 1099511627776 THEN printf('%.2f TiB', b / 1099511627776.0::DOUBLE) WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0::DOUBLE) ELSE CAST(b AS VARCHAR) || ' B' END AS size,
           CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM t""")
def human_formats(spark, sf_dir):
    """FN-11: sizes and durations as text."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.human_size(k * k * 977).alias("size"), labels.human_duration((k * 3).cast("double") / 2).alias("duration"))


@kernel("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN true END AS zeroed FROM part")
def zeroed_light(spark, sf_dir):
    """FN-25: flag of an all-zero content light pair; a false flag is left out."""
    return table(spark, sf_dir, "part").select("p_partkey", labels.zeroed(F.col("p_partkey") % 3, F.col("p_size") % 2).alias("zeroed"))


@kernel("""
    SELECT doc_id, CASE WHEN strlen(text) >= 4 THEN CAST('0x' || substr(hex(encode(text)), 1, 4) AS INTEGER) ELSE 0 END AS u16 FROM documents""")
def fixed_width_reads(spark, sf_dir):
    """FN-26: big-endian fields of the text's bytes; out of range reads as 0, and so does a null text."""
    b = F.encode("text", "utf-8")
    field = F.conv(F.hex(F.substring(b, 1, 2)), 16, 10).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length(b) >= 4, field).otherwise(0).alias("u16"))


@kernel("SELECT p_partkey, CAST(((p_partkey % 256) >> 1) & 63 AS INTEGER) AS hevc_type, CAST((p_partkey % 256) & 31 AS INTEGER) AS avc_type, CAST(p_partkey * 7919 & 1073741823 AS BIGINT) AS ad_length, CAST((p_partkey * 7919 >> 30) & 3 AS INTEGER) AS ad_type FROM part")
def packed_fields(spark, sf_dir):
    """FN-27: unit types from header bytes, length and type of an allocation descriptor."""
    b, d = F.col("p_partkey") % 256, F.col("p_partkey") * 7919
    mask = lambda x, m: x.bitwiseAND(m)
    return table(spark, sf_dir, "part").select("p_partkey", mask(F.shiftright(b, 1), 63).cast("int").alias("hevc_type"), mask(b, 31).cast("int").alias("avc_type"), mask(d, (1 << 30) - 1).cast("long").alias("ad_length"), mask(F.shiftright(d, 30), 3).cast("int").alias("ad_type"))


# ---- projections, filters, sidecars, output


@kernel("SELECT user_id, event_id, value FROM events WHERE event_type IN ('click', 'purchase') AND value >= 10")
def unit_filter(spark, sf_dir):
    """PRJ-03: unit kinds and a gate on the payload, both pushed to the scan."""
    return frames(spark, sf_dir).where(F.col("event_type").isin("click", "purchase") & (F.col("value") >= 10)).select("user_id", "event_id", "value")


@kernel("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def section_projection(spark, sf_dir):
    """PRJ-01, PRJ-02: only the sections asked for are read."""
    wanted = {"general": ["c_name"], "hdr": ["c_mktsegment"]}
    return table(spark, sf_dir, "customer").select("c_custkey", *(c for s in ("general", "hdr") for c in wanted[s]))


@kernel("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN NULL ELSE o_totalprice END AS duration_secs, CASE WHEN o_orderstatus = 'O' AND o_orderpriority NOT LIKE '5%' THEN NULL ELSE o_totalprice * 8 END AS bits_per_sec FROM orders""")
def truncation(spark, sf_dir):
    """PRJ-04, SRC-27: facts that a cut-off input can't back are left out."""
    cut, kind = F.col("o_orderstatus") == "O", F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(cut & kind.startswith("1"), None).otherwise(F.col("o_totalprice")).alias("duration_secs"), F.when(cut & ~kind.startswith("5"), None).otherwise(F.col("o_totalprice") * 8).alias("bits_per_sec"))


@kernel("""
    WITH s AS (SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT c_custkey, coalesce(n, 0) AS n, top FROM customer LEFT JOIN s ON c_custkey = user_id""")
def empty_scans(spark, sf_dir):
    """PRJ-05: tracks of which nothing was read keep empty findings."""
    s = frames(spark, sf_dir).where("event_type = 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(s, "c_custkey", "left").fillna(0, ["n"])


@kernel("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    """SRC-26: a field of a JSON head."""
    return frames(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@kernel("""
    SELECT p_partkey, CASE WHEN lower(regexp_extract(p_name, '([^ ]*)$', 1)) IN ('red', 'blue') THEN 'by_extension' WHEN p_brand LIKE 'Brand#1%' THEN 'sniffed' WHEN p_brand LIKE 'Brand#2%' THEN 'sniffed second' END AS container FROM part""")
def dispatch(spark, sf_dir):
    """SRC-02, SRC-03, SRC-23: by extension, else the first signature that fits, else nothing."""
    ext = F.lower(F.regexp_extract("p_name", "([^ ]*)$", 1))
    sniffed = F.when(F.col("p_brand").startswith("Brand#1"), "sniffed").when(F.col("p_brand").startswith("Brand#2"), "sniffed second")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(ext.isin("red", "blue"), "by_extension"), sniffed).alias("container"))


@kernel("""
    SELECT n_nationkey AS k, '{"file":"' || n_name || '"' || CASE WHEN n_nationkey % 2 = 0 THEN ',"size_bytes":' || CAST(n_nationkey AS VARCHAR) ELSE '' END || '}' AS line FROM nation""")
def ndjson(spark, sf_dir):
    """SNK-01: one object a file, absent fields left out."""
    n = table(spark, sf_dir, "nation")
    size = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))
    return n.select(F.col("n_nationkey").alias("k"), F.to_json(F.struct(F.col("n_name").alias("file"), size.alias("size_bytes"))).alias("line"))


@kernel("""
    SELECT c_custkey AS k, concat_ws('  ', c_name, concat_ws(' · ', CASE WHEN c_custkey % 2 = 0 THEN 'DV 8.1' END, c_mktsegment, CAST(c_nationkey * 160 AS VARCHAR) || '×' || CAST(c_nationkey * 90 AS VARCHAR))) AS line FROM customer""")
def quiet_line(spark, sf_dir):
    """SNK-02, SNK-03: one summary line a track."""
    n = F.col("c_nationkey")
    size = F.concat((n * 160).cast("string"), F.lit("×"), (n * 90).cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat_ws("  ", "c_name", F.concat_ws(" · ", F.when(F.col("c_custkey") % 2 == 0, "DV 8.1"), "c_mktsegment", size)).alias("line"))
