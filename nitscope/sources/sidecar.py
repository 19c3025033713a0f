"""Metadata files beside the video: RPU dumps, Dolby Vision mastering XML, HDR10+ JSON."""

from __future__ import annotations

import json
import re
from fractions import Fraction
from itertools import groupby

from nitscope.functions import bits, sei
from nitscope.sources.model import Unreadable

HEAD = 256 << 10


def kind(path: str, head: bytes) -> str | None:
    """By extension for .rpu, by content for .bin, .xml and .json; None if it is no sidecar."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ext == "rpu" or ext == "bin" and any(head[: len(c)] == c for c in (b"\x00\x00\x00\x01\x7c\x01\x19", b"\x00\x00\x01\x7c\x01\x19", b"\x00\x00\x00\x01\x19", b"\x00\x00\x01\x19")):
        return "rpu"
    if ext == "xml" and (b"DolbyLabsMDF" in head or b"DolbyVisionMetadata" in head):
        return "xml"
    if ext == "json" and b"JSONInfo" in head and b"SceneInfo" in head:
        return "json"
    return None


def rpu_runs(data: bytes) -> list[tuple[bytes, int]]:
    """(payload, frames) of consecutive equal RPUs, so that each run is parsed once."""
    units = (data[a:z] for a, z in bits.annexb(data))
    return [(u, sum(1 for _ in same)) for u, same in groupby(units)]


def _text(xml: str, tag: str) -> str | None:
    m = re.search(rf"<{tag}\b[^>]*>\s*([^<]*?)\s*</{tag}>", xml)
    return m[1] if m else None


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in re.findall(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", text or "")]


def xml_version(xml: str) -> str | None:
    """x.y.z from the version attribute or element."""
    m = re.search(r"<DolbyLabsMDF\b[^>]*\bversion\s*=\s*[\"']([\d.]+)", xml)
    text = m[1] if m else _text(xml, "Version")
    parts = text.split(".") if text else []
    return ".".join((parts + ["0", "0"])[:3]) if parts and all(p.isdigit() for p in parts) else None


def xml_rate(xml: str) -> float | None:
    """Frames a second of a `Rate`: numerator and denominator, or one number; the usual fractions are exact."""
    inner = re.search(r"<Rate\b[^>]*>(.*?)</Rate>", xml, re.DOTALL)
    if not inner:
        return None
    n, d = _text(inner[1], "n"), _text(inner[1], "d")
    found = _numbers(n)[:1] + _numbers(d)[:1] if n and d else _numbers(inner[1])[:2]
    if not found or found[0] <= 0 or len(found) > 1 and found[1] <= 0:
        return None
    rate = found[0] / found[1] if len(found) > 1 else found[0]
    whole = round(rate * 1001 / 1000)
    return float(Fraction(whole * 1000, 1001)) if len(found) == 1 and rate != round(rate) and abs(whole * 1000 / 1001 - rate) < 0.005 else rate


def xml_mastering(xml: str) -> dict | None:
    m = re.search(r"<MasteringDisplay\b.*?</MasteringDisplay>", xml, re.DOTALL)
    if not m:
        return None
    top, low = (_numbers(_text(m[0], t)) for t in ("PeakBrightness", "MinimumBrightness"))
    if not top or not low:
        return None
    points = []
    for t in ("Red", "Green", "Blue", "WhitePoint"):
        points.append(tuple(_numbers(_text(m[0], t))[:2]))
    name = sei.gamut(*points) if all(len(p) == 2 for p in points) else None
    return {"max_luminance": top[0], "min_luminance": low[0], "primaries": name, "primaries_level": 0 if name else None}


def xml_runs(xml: str) -> list[tuple[str, int, bool]]:
    """(content, frames, begins a shot) of the runs of equal frames in the shots' structure: a shot's frames are equal but
    for its edited ones, each of which stands alone."""
    out = []
    for m in re.finditer(r"<Shot\b.*?</Shot>", xml, re.DOTALL):
        n = _numbers(_text(m[0], "Duration"))
        frames = int(n[0]) if n else 0
        own = re.sub(r"<Record\b.*?</Record>|<UniqueID>.*?</UniqueID>|<Frame\b.*?</Frame>", "", m[0], flags=re.DOTALL)
        edited = {}
        for f in re.findall(r"<Frame\b.*?</Frame>", m[0], re.DOTALL):
            at = _numbers(_text(f, "EditOffset"))
            if at and 0 <= int(at[0]) < frames:
                edited[int(at[0])] = f
        begins, at = True, 0
        for stop in [*sorted(edited), frames]:
            if stop > at:
                out.append((own, stop - at, begins))
                begins = False
            if stop < frames:
                out.append((edited[stop], 1, begins))
                begins = False
            at = stop + 1
    return out


def dv_xml(data: bytes) -> dict:
    """Head facts, and cadence evidence from the structure: frames of a shot are equal but for its edited ones."""
    xml = data.decode("utf-8-sig", "replace")
    runs, version = xml_runs(xml), xml_version(xml)
    if not runs and not version:
        raise Unreadable("not a mastering document")
    light = re.search(r"<Level6\b.*?</Level6>", xml, re.DOTALL)
    cll = [_numbers(_text(light[0], t)) for t in ("MaxCLL", "MaxFALL")] if light else []
    frames = sum(n for _, n, _ in runs)
    changed = sum(a[0] != b[0] for a, b in zip(runs, runs[1:], strict=False))
    return {"version": version, "cm_version": "CM v4.0" if version and int(version.split(".")[0]) >= 4 else "CM v2.9" if version else None, "fps": xml_rate(xml), "mastering": xml_mastering(xml), "light": [int(v[0]) for v in cll] if cll and all(cll) else None, "runs": runs, "rpu_count": frames, "scene_cuts": sum(s for *_, s in runs), "frame_pairs": max(frames - 1, 0), "changed_pairs": changed}


def _object_after(text: str, name: str) -> str | None:
    """The first {...} behind "name", by matching braces outside strings; None if it is not complete."""
    at = text.find(f'"{name}"')
    at = text.find("{", at) if at >= 0 else -1
    if at < 0:
        return None
    depth, quoted, i = 0, False, at
    for i in range(at, len(text)):
        c = text[i]
        if quoted:
            quoted = c != '"' or text[i - 1] == "\\"
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[at : i + 1]
    return None


def hdr10plus_json(head: bytes) -> dict:
    """Profile and first scene of the document's head; the rest is not read."""
    text = head[:HEAD].decode("utf-8-sig", "replace")
    info, scene = _object_after(text, "JSONInfo"), _object_after(text, "SceneInfo")
    if not info or not scene:
        raise Unreadable("no complete first scene")
    info, scene = json.loads(info), json.loads(scene)
    profile = info.get("HDR10plusProfile")
    return {"profile": profile if profile in ("A", "B") else None, "application_version": 1, "num_windows": scene.get("NumberOfWindows", 1), "target_max_luminance": scene.get("TargetedSystemDisplayMaximumLuminance", 0)}
