"""Text form of reports: sections in a fixed order, one line a fact. For people; machines take the JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitscope.functions import labels

WIDTH = 22


def _line(name: str, value):
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"  {name}".ljust(WIDTH)), value))


def _display(m):
    return F.when(m.isNotNull(), F.concat_ws(" ", F.concat(F.format_string("%s", m["min_luminance"]), F.lit(" to "), F.format_string("%s", m["max_luminance"]), F.lit(" cd/m²")), m["primaries"]))


def _section(title: str, present, *lines):
    return F.when(present, F.concat_ws("\n", F.lit(title), *lines))


def _text(x):
    return x.cast("string")


def track_text(t):
    """All sections of one track struct."""
    dv, hdr = t["dolby_vision"], t["hdr"]
    size = F.when(t["width"] > 0, F.concat(_text(t["width"]), F.lit("×"), _text(t["height"])))
    color = F.concat_ws(" / ", *(t["color"][k] for k in ("primaries", "transfer", "matrix", "range")))
    light = F.when(hdr["content_light"].isNotNull(), F.concat(F.lit("MaxCLL "), _text(hdr["content_light"]["max_cll"]), F.lit(", MaxFALL "), _text(hdr["content_light"]["max_fall"])))
    trims = F.concat_ws(", ", F.transform(dv["trim_targets"], lambda x: F.concat(_text(x["nits"]), F.lit(" [L"), F.concat_ws("/L", F.transform(x["levels"], lambda y: y.cast("string"))), F.lit("]"))))
    general = _section("General", F.lit(True), _line("Codec", F.concat_ws(" ", t["codec"], t["codec_profile"])), _line("Size", size), _line("Frame rate", F.format_string("%.3f", t["fps"])), _line("Bit rate", labels.human_bitrate(t["bitrate"]["bits_per_sec"])), _line("Depth", F.concat_ws(", ", F.concat(_text(t["bit_depth"]), F.lit(" bit")), t["chroma"])), _line("Color", color), _line("Stereo", t["stereo"]))
    static = _section("HDR", hdr.isNotNull(), _line("Format", hdr["format"]), _line("Mastering", _display(hdr["mastering"])), _line("Content light", light))
    sl = _section("SL-HDR", t["sl_hdr"].isNotNull(), _line("Mode", _text(t["sl_hdr"]["mode"])), _line("Specification", t["sl_hdr"]["spec_version"]))
    vivid = _section("HDR Vivid", t["hdr_vivid"].isNotNull(), _line("Version", t["hdr_vivid"]["version"]), _line("Targets", F.concat_ws(", ", F.transform(t["hdr_vivid"]["target_max_luminances"], lambda x: x.cast("string")))))
    shown = labels.dv_profile_display(dv["profile"], t["codec"], t["color"]["primaries"], t["color"]["transfer"], t["color"]["matrix"])
    dynamic = _section("Dolby Vision", dv.isNotNull(), _line("Profile", shown), _line("Structure", dv["structure"]), _line("Level", _text(dv["level"])), _line("Compatibility", dv["compatibility"]), _line("CM version", dv["cm_version"]), _line("Mastering", _display(dv["mastering_display"])), _line("Trim targets", trims), _line("RPUs", F.when(dv["rpu_count"] > 0, F.concat(_text(dv["rpu_count"]), F.when(dv["sampled"], " (sampled)").otherwise("")))))
    plus = _section("HDR10+", t["hdr10plus"].isNotNull(), _line("Profile", t["hdr10plus"]["profile"]), _line("Windows", _text(t["hdr10plus"]["num_windows"])))
    return F.concat_ws("\n\n", general, static, sl, vivid, dynamic, plus)


def text(report: DataFrame) -> DataFrame:
    """(file, text): the whole report of each file."""
    head = F.concat_ws("\n", F.col("file"), _line("Container", F.col("container")), _line("File size", labels.human_size(F.col("size_bytes"))), _line("Duration", labels.human_duration(F.col("duration_secs"))))
    return report.select("file", F.concat_ws("\n\n", head, F.concat_ws("\n\n", F.transform("video_tracks", track_text))).alias("text"))


#: Terminal codes of titles and names, by theme; the plain one has none.
THEMES = {"plain": ("", "", ""), "dark": ("\x1b[1;96m", "\x1b[90m", "\x1b[0m"), "light": ("\x1b[1;34m", "\x1b[37m", "\x1b[0m")}


def reflow(report_text, width: int):
    """The text with lines of at most `width` characters: a value goes on below itself, broken at spaces; a word that is
    longer than a line stays whole."""
    room = max(width - WIDTH, 1)

    def line(x):
        value = F.substr(x, F.lit(WIDTH + 1), F.length(x))
        wrapped = F.regexp_replace(value, rf"(\S{{{room + 1},}}|.{{1,{room}}})(?:\s+|\z)", "$1\n" + " " * WIDTH)
        return F.when((F.length(x) > width) & x.startswith("  "), F.concat(F.substr(x, F.lit(1), F.lit(WIDTH)), F.regexp_replace(wrapped, r"[\n ]+\z", ""))).otherwise(x)

    return F.array_join(F.transform(F.split(report_text, "\n"), line), "\n")


def styled(report: DataFrame, theme: str = "dark", width: int = 100) -> DataFrame:
    """(file, text) for a terminal: the text form reflowed, with the theme's codes around titles and names."""
    title, name, end = THEMES[theme]

    def line(x):
        named = F.concat(F.lit("  " + name), F.substr(x, F.lit(3), F.lit(WIDTH - 2)), F.lit(end), F.substr(x, F.lit(WIDTH + 1), F.length(x)))
        lead = x.startswith("  ") & ~x.startswith("   ")
        return F.when(lead, named).when((x != "") & ~x.startswith(" "), F.concat(F.lit(title), x, F.lit(end))).otherwise(x)

    shown = F.transform(F.split(reflow(F.col("text"), width), "\n"), line)
    return text(report).select("file", F.array_join(shown, "\n").alias("text"))
