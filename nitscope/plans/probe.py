"""The report: tracks joined with what their access units say, one nested row for each file.

Everything after the byte parsers is relational: first-wins aggregates by order, distinct sets, a lag over frames that
carry metadata, look-ups, and classification expressions. Presence rules are nulls: nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitscope.functions import labels, luminance
from nitscope.functions.rpu import CENSUS
from nitscope.operators import ordered, windows
from nitscope.plans.kernels import dv_level
from nitscope.runtime import materialize
from nitscope.sources import reader

VERSION = "2.4"
KEYS = ["file", "track_idx"]
CANVAS = (3840, 2160)
#: Steps of the order (sixteen a frame) whose frames are compared within one task.
FRAMES = 16 * 8192
SECTIONS = {"general": ("container", "duration_secs"), "hdr": ("hdr",), "dv": ("dolby_vision",), "hdr10plus": ("hdr10plus",), "slhdr": ("sl_hdr",), "hdrvivid": ("hdr_vivid",)}


def sei_facts(found: DataFrame) -> DataFrame:
    """First known value of every kind of message; HDR Vivid targets as a union in order of appearance, at most eight."""
    s = found.where("sei IS NOT NULL")
    names = ("mastering", "content_light", "preferred_transfer", "hdr10plus", "sl_hdr")
    first = s.groupBy(*KEYS).agg(*(ordered.first_known(F.col(f"sei.{n}"), F.col("ord")).alias(f"sei_{n}") for n in names), ordered.first_known(F.col("sei.hdr_vivid"), F.col("ord")).alias("vivid"))
    codes = s.where("sei.hdr_vivid IS NOT NULL").select(*KEYS, "ord", F.posexplode("sei.hdr_vivid.target_pq").alias("i", "pq"))
    seen = ordered.distinct_in_order(codes, KEYS, "pq", F.struct("ord", "i"), 8, "vivid_pq")
    return first.join(seen, KEYS, "left")


def _block(level: int):
    return F.filter("rpu.blocks", lambda x: x["level"] == level)


def rpu_facts(found: DataFrame, full: bool) -> DataFrame:
    """The title's Dolby Vision facts over its RPUs, weighted by the frames that each stands for."""
    r = found.where("rpu IS NOT NULL")
    o, dm = F.col("ord"), F.col("rpu.blocks").isNotNull()
    one = lambda level: F.get(_block(level), F.lit(0))
    first = lambda value: ordered.first_known(value, o)
    facts = r.groupBy(*KEYS).agg(
        F.sum("weight").alias("rpu_count"),
        first(F.col("rpu.profile")).alias("rpu_profile"),
        first(F.col("rpu.el_type")).alias("el_type"),
        first(F.col("rpu.vdr_bit_depth")).alias("vdr_bit_depth"),
        F.sum(F.when(F.col("rpu.scene_refresh") == 1, 1).otherwise(0)).alias("scene_cuts"),
        first(F.when(F.col("rpu.source_max_pq") > 0, F.struct("rpu.source_min_pq", "rpu.source_max_pq"))).alias("source"),
        first(one(6)).alias("l6"),
        first(one(9)).alias("l9"),
        first(one(11)).alias("l11"),
        F.bool_or(dm & (F.size(_block(254)) > 0)).alias("v40"),
        first(one(254)["version"]).alias("dm_version_index"),
    )
    blocks = r.where(dm).select(*KEYS, "ord", "weight", F.posexplode("rpu.blocks").alias("i", "b"))
    at = F.struct("ord", "i")
    areas = blocks.where("b.level = 5").withColumn("rect", F.struct("b.left", "b.right", "b.top", "b.bottom"))
    out = facts.join(ordered.distinct_in_order(areas, KEYS, "rect", at, name="rects"), KEYS, "left").join(trims(blocks, at), KEYS, "left")
    if full:
        with_dm = r.where(dm).select(*KEYS, "ord", "weight", F.col("rpu.fingerprint").alias("fp"))
        pairs = windows.with_previous(with_dm, KEYS, ["ord"], "fp", chunk=F.floor(F.col("ord") / FRAMES))
        changed = F.sum(F.when(F.col("prev") != F.col("fp"), 1).otherwise(0))
        cadence = pairs.groupBy(*KEYS).agg((F.count("prev") + F.sum(F.col("weight") - 1)).alias("frame_pairs"), changed.alias("changed_pairs"))
        levels = ordered.census(r.where(dm), KEYS, F.filter(F.transform("rpu.blocks", lambda x: x["level"]), lambda x: x.isin(*CENSUS)), F.col("weight"))
        present = levels.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("level", F.col("rows_with").alias("rpus_with")))).alias("level_presence"))
        out = out.join(cadence, KEYS, "left").join(present, KEYS, "left")
    return out


def trims(blocks: DataFrame, at) -> DataFrame:
    """Targets in nits with the levels that name them: level 2 by code, level 8 by an index that the title's own level 10
    or the fixed table resolves, level 10 as such."""
    two = blocks.where("b.level = 2").select(*KEYS, luminance.pq_target(F.col("b.target_max_pq")).alias("nits"), F.lit(2).alias("level"))
    ten = blocks.where("b.level = 10").groupBy(*KEYS, F.col("b.index").alias("index")).agg(F.min_by(luminance.pq_target(F.col("b.target_max_pq")), at).alias("own"))
    fixed = F.create_map(*(F.lit(x) for k, v in labels.TARGET_NITS.items() for x in (k, v)))
    eight = blocks.where("b.level = 8").select(*KEYS, F.col("b.index").alias("index")).distinct().join(ten, [*KEYS, "index"], "left")
    eight = eight.select(*KEYS, F.coalesce("own", F.try_element_at(fixed, "index").cast("long")).alias("nits"), F.lit(8).alias("level"))
    every = two.unionByName(eight).unionByName(ten.select(*KEYS, F.col("own").alias("nits"), F.lit(8).alias("level"))).where("nits IS NOT NULL")
    each = every.groupBy(*KEYS, "nits").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    return each.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("nits", "levels"))).alias("trim_targets"))


def _null(kind: str):
    return F.lit(None).cast(kind)


def _l9(l9):
    c = l9["custom"]
    point = lambda i: F.struct((F.get(c, F.lit(i)) / 32767.0).alias("x"), (F.get(c, F.lit(i + 1)) / 32767.0).alias("y"))
    own = F.coalesce(luminance.gamut(point(0), point(2), point(4), point(6)), F.lit("custom"))
    return F.when((l9["primary"] == 255) & c.isNotNull(), own).otherwise(labels.named(l9["primary"], labels.MASTERING_INDEX, "unknown"))


def dolby_vision(full: bool):
    """The Dolby Vision section as one struct expression; null without RPU and configuration."""
    c, av1, side = F.col("dv_config"), F.col("codec") == "AV1", F.col("sidecar").isNotNull()
    read = F.col("rpu_count").isNotNull()
    profile = F.coalesce(c["profile"], F.when(read & av1, 10), F.col("rpu_profile"))
    compat = c["bl_compatibility_id"]
    dual = F.coalesce("dual_track", F.lit(False))
    el = F.coalesce(c["el_present"] | dual, (profile == 7) | dual)
    bl = F.coalesce(c["bl_present"] | dual, F.lit(True))
    name = labels.dv_profile(profile, compat, F.col("el_type"))
    l9, source = F.col("l9_name"), F.col("source")
    known = F.when(~l9.isin("custom", "unknown"), l9)
    mastering = F.when(source.isNotNull(), F.struct(source["max_luminance"].alias("max_luminance"), source["min_luminance"].alias("min_luminance"), known.alias("primaries"), F.when(known.isNotNull(), 9).alias("primaries_level")))
    mastering = F.when(F.col("sidecar") == "xml", F.col("mastering")).otherwise(mastering)
    width, height = (F.when(side, size).otherwise(F.col(col)).cast("long") for size, col in zip(CANVAS, ("width", "height"), strict=True))
    area = lambda r: F.struct(F.greatest(width - r["left"] - r["right"], F.lit(0)).alias("width"), F.greatest(height - r["top"] - r["bottom"], F.lit(0)).alias("height"), r["left"].alias("left"), r["right"].alias("right"), r["top"].alias("top"), r["bottom"].alias("bottom"))
    level = F.coalesce(c["level"], F.when(~side & read, dv_level(F.col("width"), F.col("height"), F.col("fps"))))
    l6, l11 = F.col("l6"), F.col("l11")
    no_el = F.when(c.isNotNull(), ~el).otherwise(av1)
    declared_bl = F.coalesce(F.col("mastering"), F.col("sei_mastering"))
    flag = lambda x: F.when(x, True)
    fields = {
        "profile": name,
        "profile_compat_assumed": flag(side & compat.isNull() & profile.isin(4, 7, 8)),
        "structure": labels.structure(el, dual),
        "level": level,
        "level_derived": flag(c["level"].isNull() & level.isNotNull()),
        "bl_present": bl,
        "el_present": el,
        "rpu_present": F.coalesce(c["rpu_present"], F.lit(True)),
        "el_type": F.col("el_type"),
        "unconverted_dual_layer_rpu": flag(F.col("el_type").isNotNull() & no_el),
        "reconstructed_bit_depth": F.when(F.col("el_type") == "FEL", F.col("vdr_bit_depth")),
        "bl_compatibility_id": compat,
        "compatibility": labels.named(compat, labels.COMPATIBILITY),
        "cm_version": F.when(read, F.when(F.col("v40"), "CM v4.0").otherwise("CM v2.9")),
        "l5_active_areas": F.transform("rects", area),
        "l5_assumed_canvas": F.when(side & F.col("rects").isNotNull(), F.array(*(F.lit(x).cast("long") for x in CANVAS))),
        "mastering_display": mastering,
        "fel_brightness_expansion": labels.fel_expansion(F.col("el_type"), declared_bl["max_luminance"], mastering["max_luminance"]),
        "mastering_primaries_mismatch": labels.primaries_mismatch(declared_bl["primaries"], mastering["primaries"], mastering["primaries_level"]),
        "l6": F.when(l6.isNotNull(), F.struct(l6["max_cll"].alias("max_cll"), l6["max_fall"].alias("max_fall"), l6["max_mastering"].alias("max_mastering"), l6["min_mastering"].alias("min_mastering"), labels.zeroed(l6["max_cll"], l6["max_fall"]).alias("zeroed"))),
        "l9_mastering": l9,
        "l11_content": labels.named(l11["content"], labels.CONTENT_TYPE, "Unknown"),
        "l11_white_point": F.when(l11.isNotNull(), labels.white_point(l11["white"])),
        "l11_reference_mode": l11["reference"],
        "trim_targets": F.col("trim_targets"),
        "rpu_count": F.coalesce("rpu_count", F.lit(0).cast("long")),
        "sampled": F.when(read, F.col("sampled")).otherwise(False),
    }
    if full:
        verdict = F.when(F.col("changed_pairs") * 4 >= F.col("frame_pairs"), "per-frame").otherwise("per-shot")
        fields["metadata_cadence"] = F.when(F.col("frame_pairs") > 0, F.struct(verdict.alias("cadence"), F.col("frame_pairs"), F.col("changed_pairs")))
        fields["census"] = F.when(read, F.struct("scene_cuts", "dm_version_index", "level_presence"))
    return F.when(read | c.isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))


def track_reports(tracks: DataFrame, found: DataFrame, full: bool = False) -> DataFrame:
    """One row for each track with all its sections."""
    t = tracks.where("error IS NULL").join(sei_facts(found), KEYS, "left").join(rpu_facts(found, full), KEYS, "left")
    # A few columns for each track are written between the steps: each value is computed once, where the optimizer would
    # otherwise repeat it in every expression that names it.
    t = materialize(t, "track-facts")
    t = materialize(t.withColumns({"l9_name": _l9(F.col("l9")), "source": luminance.source_range(F.col("source.source_min_pq"), F.col("source.source_max_pq"))}), "track-source")
    t = materialize(t.withColumn("dolby_vision", dolby_vision(full)), "track-sections")
    dv, color = F.col("dolby_vision"), F.col("color")
    vivid = F.col("vivid").isNotNull() | F.col("vivid_map").isNotNull()
    line = labels.hdr_format(dv.isNotNull(), dv["profile"], dv["bl_compatibility_id"], F.col("sei_hdr10plus").isNotNull(), F.col("sei_sl_hdr.mode"), vivid, color["transfer"], F.col("sei_preferred_transfer"), color["matrix"])
    t = t.withColumn("format", line)
    base, l6 = labels.is_hdr10_base(F.col("format")), dv["l6"]
    from_l6 = F.when(base & l6.isNotNull(), F.struct(l6["max_mastering"].cast("double").alias("max_luminance"), (l6["min_mastering"] / 10000.0).alias("min_luminance"), dv["l9_mastering"].alias("primaries"), F.when(dv["l9_mastering"].isNotNull(), 9).alias("primaries_level")))
    light_l6 = F.when(base & l6.isNotNull(), F.struct("dolby_vision.l6.max_cll", "dolby_vision.l6.max_fall", "dolby_vision.l6.zeroed"))
    hdr = F.when(F.col("sidecar").isNull(), F.struct(F.col("format"), F.coalesce("mastering", "sei_mastering", from_l6).alias("mastering"), F.coalesce("content_light", "sei_content_light", light_l6).alias("content_light")))
    said = labels.named(F.col("sei_preferred_transfer"), labels.TRANSFER)
    version = F.coalesce(F.floor(F.log2(F.col("vivid_map").cast("double"))).cast("int") + 1, F.col("vivid.version"))
    nits = luminance.distinct_targets(F.coalesce("vivid_pq", F.array().cast("array<int>")))
    return t.select(
        *KEYS,
        "size_bytes",
        "container",
        "duration_secs",
        "bd_iso",
        "track_number",
        "program",
        F.when(~F.col("default"), False).alias("default"),
        "codec",
        F.col("profile").alias("codec_profile"),
        "width",
        "height",
        "fps",
        "bitrate",
        "bit_depth",
        "chroma",
        "stereo",
        F.when(said.isNotNull(), F.coalesce(color, F.from_json(F.lit("{}"), "primaries string, transfer string, matrix string, range string")).withField("transfer", said)).otherwise(color).alias("color"),
        hdr.alias("hdr"),
        "dolby_vision",
        F.col("sei_hdr10plus").alias("hdr10plus"),
        F.when(F.col("sei_sl_hdr").isNotNull(), F.struct("sei_sl_hdr.mode", "sei_sl_hdr.spec_version", F.when(F.col("sei_sl_hdr.payload_mode").isNotNull(), F.when(F.col("sei_sl_hdr.payload_mode") == 0, "parameter-based").when(F.col("sei_sl_hdr.payload_mode") == 1, "table-based")).alias("payload_mode"), labels.named(F.col("sei_sl_hdr.target_primaries"), labels.PRIMARIES).alias("target_primaries"), "sei_sl_hdr.target_max_luminance", "sei_sl_hdr.source_mastering")).alias("sl_hdr"),
        F.when(vivid, F.struct(F.concat(version.cast("string"), F.lit(".0")).alias("version"), F.col("vivid.system_start_code").alias("system_start_code"), F.when(F.size(nits) > 0, nits).alias("target_max_luminances"), (F.col("sampled") & F.col("vivid").isNotNull()).alias("sampled"))).alias("hdr_vivid"),
    )


def reports(per_track: DataFrame) -> DataFrame:
    """One nested row for each file, tracks in their order."""
    head = ("size_bytes", "container", "duration_secs", "bd_iso")
    rest = [c for c in per_track.columns if c not in (*KEYS, *head)]
    row = F.struct(F.col("track_idx"), F.struct(*rest).alias("t"))
    made = per_track.groupBy("file").agg(*(F.min_by(c, "track_idx").alias(c) for c in head), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]).alias("video_tracks"))
    return made.select(F.lit(VERSION).alias("schema_version"), "file", *head, "video_tracks")


def probe(spark: SparkSession, paths: list[str], full: bool = False, samples: int = 16, rpu: bool = True, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reports, errors) of the files as given and those in the folders given. Files may be of any size; one that can't be
    read is an error row. Without `rpu`, Dolby Vision is what the containers declare."""
    return probe_bytes(reader.inputs(spark, paths, recursive), full, samples, rpu)


def probe_stream(spark: SparkSession, stream, name: str = "-", samples: int = 16, rpu: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same for a binary stream that can't be sought, of which a bounded head is read: if there is more, the facts that
    a head can't back are left out."""
    data, cut = reader.head(stream)
    if not data:
        raise ValueError("no data in the stream")
    return probe_bytes(spark.createDataFrame([(name, data, cut)], "file string, content binary, truncated boolean"), False, samples, rpu)


def suppress_cut(tracks: DataFrame, cut: DataFrame) -> DataFrame:
    """Facts that the head of an input can't back: a transport stream's duration, and every rate but the one that an
    MP4's own tables give. `cut` is (file, truncated)."""
    t = tracks.join(cut, "file", "left").withColumn("__cut", F.coalesce("truncated", F.lit(False)))
    mp4, ts = F.col("container").startswith("MP4") | F.col("container").startswith("QuickTime"), F.col("container").startswith("MPEG-2 TS")
    return t.withColumns({
        "duration_secs": F.when(~(F.col("__cut") & ts), F.col("duration_secs")),
        "bitrate": F.when(~F.col("__cut") | mp4 & (F.col("bitrate.scope") == "video_stream"), F.col("bitrate")),
    }).drop("truncated", "__cut")


def probe_bytes(files: DataFrame, full: bool = False, samples: int = 16, rpu: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same for (file, content) rows from anywhere, such as the heads of streams; these say `truncated` beside."""
    scanned = materialize(reader.scan(files, full, samples), "scanned")  # every file is read once; what it says is small
    tracks, found = reader.parted(scanned)
    if "truncated" in files.columns:
        tracks = suppress_cut(tracks, files.select("file", "truncated"))
    errors = tracks.where("error IS NOT NULL").select("file", "error")
    return reports(track_reports(tracks, found if rpu else found.where("rpu IS NULL"), full)), errors


def quiet(report: DataFrame) -> DataFrame:
    """(file, line): one summary line for each track."""
    t = report.select("file", F.size("video_tracks").alias("n"), F.posexplode("video_tracks").alias("i", "t"))
    dv = F.when(F.col("t.dolby_vision").isNotNull(), F.concat(F.lit("DV "), labels.dv_profile_display(F.col("t.dolby_vision.profile"), F.col("t.codec"), F.col("t.color.primaries"), F.col("t.color.transfer"), F.col("t.color.matrix"))))
    size = F.when(F.col("t.width") > 0, F.concat(F.col("t.width").cast("string"), F.lit("×"), F.col("t.height").cast("string")))
    name = F.concat(F.col("file"), F.when(F.col("n") > 1, F.concat(F.lit(" ["), (F.col("i") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("]"))).otherwise(""))
    return t.select("file", F.concat_ws("  ", name, F.concat_ws(" · ", dv, "t.hdr.format", size)).alias("line"))


def to_json(report: DataFrame) -> DataFrame:
    """One JSON object for each file; absent fields are left out."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


def sections(report: DataFrame, *wanted: str) -> DataFrame:
    """Only the sections asked for, on every track: the others are not computed."""
    keep = {f for s in wanted for f in SECTIONS[s]}
    drop = [f for s, fields in SECTIONS.items() if s not in wanted for f in fields if s != "general" and f not in keep]
    return report.withColumn("video_tracks", F.transform("video_tracks", lambda t: t.dropFields(*drop) if drop else t))


def json_document(report: DataFrame, collected: int) -> str:
    """One JSON text for people's tools: the object alone if exactly one path was collected and could be read, else an
    array in the order of paths. The text is made on the driver, which must hold it; for many files write `to_json`."""
    rows = [r.value for r in to_json(report.orderBy("file")).toLocalIterator()]
    return rows[0] if collected == 1 and len(rows) == 1 else f"[{','.join(rows)}]"


def observed(report: DataFrame, observation) -> DataFrame:
    """The same rows; `observation` learns how many files and tracks went by once an action has run."""
    return report.observe(observation, F.count("*").alias("files"), F.sum(F.size("video_tracks")).alias("tracks"))
