"""Names for coded values, and the text forms of sizes, rates and durations. Unknown codes are null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ITU-T H.273 code points that have a name in reports.
PRIMARIES = {1: "BT.709", 5: "BT.601 (PAL)", 6: "BT.601 (NTSC)", 9: "BT.2020", 11: "DCI-P3", 12: "Display P3"}
TRANSFER = {1: "BT.709", 6: "BT.601", 14: "BT.2020 (10-bit)", 15: "BT.2020 (12-bit)", 16: "PQ (SMPTE ST 2084)", 18: "HLG (ARIB STD-B67)"}
MATRIX = {0: "RGB", 1: "BT.709", 9: "BT.2020 NCL", 10: "BT.2020 CL", 15: "IPT-PQ-c2"}
#: Mastering gamut, content type and compatibility codes of Dolby Vision metadata.
MASTERING_INDEX = {0: "DCI-P3 D65", 1: "BT.709", 2: "BT.2020", 3: "SMPTE-C", 4: "BT.601", 5: "DCI-P3", 6: "ACES", 7: "S-Gamut", 8: "S-Gamut-3.Cine"}
CONTENT_TYPE = {0: "Default", 1: "Movies", 2: "Game", 3: "Sport", 4: "User Generated Content"}
COMPATIBILITY = {0: "no cross-compatibility", 1: "HDR10-compatible", 2: "SDR-compatible", 4: "HLG-compatible"}
#: Minor digits that a profile implies by its definition.
IMPLIED_MINOR = {8: "8.1", 7: "7.6", 4: "4.2"}
#: Predefined target displays in nits by index.
TARGET_NITS = {1: 100, 16: 48, 18: 48, 21: 48, 24: 300, 25: 300, 27: 600, 28: 600, 37: 2000, 38: 2000, 42: 108, 48: 1000, 49: 1000}
CHROMA = {0: "monochrome", 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}
#: Profile names by profile_idc.
HEVC_PROFILES = {1: "Main", 2: "Main 10", 3: "Main Still Picture", 4: "Range Extensions"}
AVC_PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4 Predictive"}
AV1_PROFILES = {0: "Main", 1: "High", 2: "Professional"}
SDR_TRANSFERS = ("BT.709", "BT.601", "BT.2020 (10-bit)", "BT.2020 (12-bit)")


def named(code: Column, names: dict, otherwise: str | None = None) -> Column:
    """`names[code]`, else `otherwise` (null code: null)."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(otherwise)))


def white_point(code: Column) -> Column:
    return F.when(code == 0, "D65").when(code == 8, "D93").otherwise(F.concat(F.lit("code "), code.cast("string")))


def dv_profile(profile: Column, compat: Column, el_type: Column) -> Column:
    """profile.minor; the minor digit is the declared one, else what the profile implies; dual-layer kinds in brackets."""
    base = F.when(compat.isNotNull(), F.concat_ws(".", profile.cast("string"), compat.cast("string"))).otherwise(F.coalesce(named(profile, IMPLIED_MINOR), profile.cast("string")))
    return F.when(profile.isin(4, 7) & el_type.isNotNull(), F.concat(base, F.lit(" ("), el_type, F.lit(")"))).otherwise(base)


def dv_profile_display(label: Column, codec: Column, primaries: Column, transfer: Column, matrix: Column) -> Column:
    """A bare 5 or 10 completed where the definition or explicit signalling leaves one minor digit."""
    wide = (primaries == "BT.2020") & matrix.isNotNull()
    ten = F.when(matrix == "IPT-PQ-c2", 0).when(transfer.isin(*SDR_TRANSFERS), 2).when(wide & (transfer == TRANSFER[16]), 1).when(wide & (transfer == TRANSFER[18]), 4)
    ten = F.concat(F.lit("10."), ten.cast("string"))
    return F.when(codec == "", label).when(label == "5", "5.0").when((label == "10") & ten.isNotNull(), ten).otherwise(label)


def structure(el_present: Column, dual_track: Column) -> Column:
    return F.when(el_present, F.when(dual_track, "Dual track, dual layer").otherwise("Single track, dual layer"))


def human_size(size: Column) -> Column:
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1024**i, F.concat(F.format_string("%.2f", size.cast("double") / F.lit(float(1024**i))), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_bitrate(bps: Column) -> Column:
    million, thousand = F.format_string("%.2f Mb/s", bps / 1e6), F.format_string("%.0f kb/s", bps / 1e3)
    return F.when(bps >= 1e6, million).when(bps >= 1e3, thousand).otherwise(F.format_string("%.0f b/s", bps))


def human_duration(secs: Column) -> Column:
    t = F.floor(secs + 0.5).cast("long")
    h, m, s = F.floor(t / 3600).cast("long"), F.floor(F.pmod(t, F.lit(3600)) / 60).cast("long"), F.pmod(t, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def zeroed(max_cll: Column, max_fall: Column) -> Column:
    """True if both are zero, else null: a false flag is left out of reports."""
    return F.when((max_cll == 0) & (max_fall == 0), True)


def hdr_format(dv: Column, dv_profile_label: Column, compat: Column, hdr10plus: Column, sl_mode: Column, vivid: Column, transfer: Column, preferred: Column, matrix: Column) -> Column:
    """The format line: dynamic kinds in their order, then the base. PQ outranks HLG; an IPT base says nothing by its
    transfer, and is judged by the compatibility id alone."""
    text = F.coalesce(transfer, F.lit(""))
    usable = ~matrix.eqNullSafe("IPT-PQ-c2")
    pq = usable & (text.contains("PQ") | preferred.eqNullSafe(16))
    hlg = usable & (text.contains("HLG") | preferred.eqNullSafe(18))
    by_id = F.when(dv_profile_label.startswith("4"), "SDR (fallback)").when(compat.isin(1, 6), "HDR10 (fallback)").when(compat == 2, "SDR (fallback)").when(compat == 4, "HLG (fallback)")
    base = F.when(pq, F.when(dv, "HDR10 (fallback)").otherwise("HDR10")).when(hlg, F.when(dv, "HLG (fallback)").otherwise("HLG")).when(dv, by_id).otherwise("SDR")
    return F.concat_ws(" / ", F.when(dv, "Dolby Vision"), F.when(hdr10plus, "HDR10+"), F.concat(F.lit("SL-HDR"), sl_mode.cast("string")), F.when(vivid, "HDR Vivid"), base)


def is_hdr10_base(format_line: Column) -> Column:
    """True if the base, which is the last part of the line, is of the HDR10 family."""
    return F.regexp_extract(format_line, r"(?:\A| / )(HDR10(?: \(fallback\))?)\z", 1) != ""


def fel_expansion(el_type: Column, bl_max: Column, rpu_max: Column) -> Column:
    return F.when((el_type == "FEL") & (bl_max > 0) & (rpu_max > bl_max * 1.1), F.struct(bl_max.alias("bl_max_nits"), rpu_max.alias("rpu_max_nits")))


def primaries_mismatch(bl: Column, rpu: Column, rpu_level: Column) -> Column:
    return F.when((rpu_level == 9) & (bl != rpu), F.struct(bl.alias("bl_primaries"), rpu.alias("rpu_primaries")))


def _level(code: Column, unit: int, step: int) -> Column:
    """major or major.minor of a level code with `unit` to a major and `step` to a minor."""
    major, minor = F.floor(code / unit).cast("int"), F.floor(F.pmod(code, F.lit(unit)) / step).cast("int")
    return F.when(minor == 0, major.cast("string")).otherwise(F.concat_ws(".", major.cast("string"), minor.cast("string")))


def hevc_profile(profile: Column, tier_high: Column, level: Column) -> Column:
    name = F.coalesce(named(profile, HEVC_PROFILES), F.concat(F.lit("profile "), profile.cast("string")))
    return F.concat(name, F.lit(", "), F.when(tier_high, "High tier").otherwise("Main tier"), F.lit(" @ L"), _level(level, 30, 3))


def avc_profile(profile: Column, level: Column, set4: Column, set5: Column) -> Column:
    high = F.when(set4 & set5, "Constrained High").when(set4, "Progressive High").otherwise("High")
    name = F.when(profile == 100, high).otherwise(F.coalesce(named(profile, AVC_PROFILES), F.concat(F.lit("profile "), profile.cast("string"))))
    return F.concat(name, F.lit(" @ L"), _level(level, 10, 1))


def av1_profile(profile: Column, tier: Column, level: Column) -> Column:
    head = F.concat(named(profile, AV1_PROFILES, "?"), F.lit(" profile, "), F.when(tier == 1, "High tier").otherwise("Main tier"))
    level_text = F.concat(F.lit(" @ L"), (F.floor(level / 4) + 2).cast("int").cast("string"), F.lit("."), F.pmod(level, F.lit(4)).cast("string"))
    return F.when(level == 31, head).otherwise(F.concat(head, level_text))
