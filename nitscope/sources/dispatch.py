"""From a path and its bytes to tracks: by extension first, by content else; failures are rows, never a failed job."""

from __future__ import annotations

from nitscope.sources import disc, mkv, mp4, raw, ts
from nitscope.sources.model import Unreadable

#: Extensions of video files and the parser of each.
PARSERS = {e: mp4.read for e in ("mp4", "m4v", "mov")} | {e: mkv.read for e in ("mkv", "webm")} | {e: ts.read for e in ("ts", "m2ts", "mts")} | {e: raw.hevc for e in ("hevc", "h265", "265")} | {"obu": raw.obu, "av1": raw.obu, "ivf": raw.ivf}
VIDEO = frozenset((*PARSERS, "iso"))


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def part(data, start: int, end: int | None = None):
    """A range of an input without a copy."""
    if not start and end is None:
        return data
    return data.part(start, end) if hasattr(data, "part") else memoryview(data)[start:end]


def sniff(data):
    """The parser whose signature the data begins with, in a fixed order, or None."""
    head = bytes(data[:16])
    if head[4:8] == b"ftyp":
        return mp4.read
    if mkv.looks(head):
        return mkv.read
    if head[:4] == b"DKIF":
        return raw.ivf
    if raw.is_obu_stream(head):
        return raw.obu
    if ts.layout(data[: 1 << 12]):
        return ts.read
    if head[:3] == b"\x00\x00\x01" or head[:4] == b"\x00\x00\x00\x01":
        return raw.hevc
    return None


def demux(path: str, data, full: bool = False) -> dict:
    """Tracks of an input. If the extension's parser fails, one that the content asks for may succeed; if that fails
    too, the first error stands."""
    if extension(path) == "iso" or disc.is_image(data):
        feature = disc.main_feature(data)
        return ts.read(part(data, feature["start"], feature["end"]), full) | {"bd_iso": feature["bd_iso"], "shift": feature["start"]}
    first, error = PARSERS.get(extension(path)), None
    for parse in (first, sniff(data)):
        if parse is None or parse is first and error:
            continue
        try:
            return parse(data, full)
        except (Unreadable, IndexError, ValueError, OverflowError, MemoryError) as e:
            error = error or e
    raise error if isinstance(error, Unreadable) else Unreadable(str(error or "not a known format"))
