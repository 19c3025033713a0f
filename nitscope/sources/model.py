"""What every container parser gives: a dict for the file and one for each logical video track."""

from __future__ import annotations

from nitscope.functions import headers, sei

#: Frame rates that a measured rate snaps to within one per cent.
STANDARD_RATES = (24000 / 1001, 24.0, 25.0, 30000 / 1001, 30.0, 48000 / 1001, 48.0, 50.0, 60000 / 1001, 60.0, 100.0, 120000 / 1001, 120.0)
HEAD_BYTES = 8 << 20


class Unreadable(Exception):
    """The input is not what the parser reads."""


def track(codec: str, **known) -> dict:
    """A track: units are (offset, size) of access units; `nal` is the width of unit lengths, 0 for start codes or none."""
    empty = dict.fromkeys(("track_number", "program", "default", "fps", "bit_depth", "chroma", "profile", "stereo", "dv_config", "mastering", "content_light", "vivid_map", "bitrate", "pinned", "stream"))
    return empty | {"codec": codec, "width": 0, "height": 0, "color": dict(headers.NO_COLOR), "dual_track": False, "nal": 0, "units": [], "t35": []} | known


def media(container: str, tracks: list[dict], duration: float | None = None) -> dict:
    return {"container": container, "duration_secs": duration, "tracks": tracks}


def from_headers(t: dict, info: dict | None) -> dict:
    """`t` with what a sequence or frame header says."""
    if info:
        t |= {k: info[k] for k in ("width", "height", "bit_depth", "chroma", "profile") if k in info}
        t["color"] = info.get("color") or t["color"]
        t["fps"] = info.get("fps") or t["fps"]
    return t


def standard_rate(f: float) -> float:
    near = min(STANDARD_RATES, key=lambda s: abs(s - f))
    return near if abs(near - f) <= 0.01 * f else f


def bits_per_second(size: int, secs: float | None, scope: str) -> dict | None:
    return {"bits_per_sec": size * 8 / secs, "scope": scope} if size and secs and secs > 0 else None


def fill_color(own: dict, stream: dict | None) -> dict:
    """The stream's whole colour where the container names no transfer, else only its range."""
    if not stream:
        return own
    return dict(stream) if own["transfer"] is None else own | {"range": own["range"] or stream["range"]}


def fold_layers(tracks: list[dict], target: int) -> list[dict]:
    """Tracks without a base layer folded into one base; see `operators.lookups.fold_layers` for the same on tables."""
    layers = [t for t in tracks if t["dv_config"] and not t["dv_config"]["bl_present"]]
    bases = [t for t in tracks if not any(t is x for x in layers)]
    if not bases or not layers:
        return tracks
    base = bases[target]
    for name in ("dv_config", "mastering", "content_light", "stereo"):
        base[name] = base[name] or next((x[name] for x in layers if x[name]), None)
    if base["color"]["transfer"] is None:
        base["color"] = next((x["color"] for x in layers if x["color"]["transfer"]), base["color"])
    base["dual_track"] = True
    for x in layers:
        if x["nal"] == base["nal"]:
            base["units"] = base["units"] + x["units"]
            base["t35"] = base["t35"] + x["t35"]
    return bases


def last_widest(tracks: list[dict]) -> int:
    area = [t["width"] * t["height"] for t in tracks]
    return max(range(len(area)), key=lambda i: (area[i], i))


def fill_from_frames(t: dict, data, parse, frames: int = 32) -> dict:
    """Depth and chroma where the container states none, colour where it states nothing, from the first frame header."""
    nothing = not any(t["color"][k] for k in ("primaries", "transfer", "matrix"))
    if t["bit_depth"] and t["chroma"] and not nothing:
        return t
    info = next((i for o, n in t["units"][:frames] if (i := parse(bytes(data[o : o + n])))), None)
    if info:
        t["bit_depth"], t["chroma"] = t["bit_depth"] or info["bit_depth"], t["chroma"] or info["chroma"]
        if nothing:
            t["color"] = info["color"] | {"range": t["color"]["range"] or info["color"]["range"]}
    return t


EMPTY_FINDINGS = sei.EMPTY
