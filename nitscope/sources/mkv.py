"""Matroska and WebM: EBML elements, track entries, blocks, statistics tags."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

from nitscope.functions import headers, sei
from nitscope.functions.bits import big
from nitscope.sources.model import Unreadable, bits_per_second, fill_color, fill_from_frames, last_widest, media, track

HEAD_SPAN, HEAD_BLOCKS = 4 << 20, 8192
#: Element identifiers.
EBML, SEGMENT, SEEKHEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, SCALE, DURATION = 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, TYPE, DEFAULT, RATE, CODEC, PRIVATE, VIDEO = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x88, 0x23E383, 0x86, 0x63A2, 0xE0
WIDTH, HEIGHT, COLOUR, MATRIX, DEPTH, RANGE, TRANSFER, PRIMARIES, CLL, FALL, DISPLAY = 0xB0, 0xBA, 0x55B0, 0x55B1, 0x55B2, 0x55B9, 0x55BA, 0x55BB, 0x55BC, 0x55BD, 0x55D0
POINTS, LUM_MAX, LUM_MIN = tuple(range(0x55D1, 0x55D9)), 0x55D9, 0x55DA
MAPPING, ADD_TYPE, ADD_DATA = 0x41E4, 0x41E7, 0x41ED
CLUSTER, SIMPLE, GROUP, BLOCK, ADDITIONS, MORE, ADD_ID, ADDITIONAL = 0x1F43B675, 0xA3, 0xA0, 0xA1, 0x75A1, 0xA6, 0xEE, 0xA5
TAGS, TAG, TARGETS, TAG_UID, SIMPLE_TAG, NAME, STRING = 0x1254C367, 0x7373, 0x63C0, 0x63C5, 0x67C8, 0x45A3, 0x4487
CUES, CHAPTERS, ATTACHMENTS = 0x1C53BB6B, 0x1043A770, 0x1941A469
LEVEL_ONE = frozenset((SEEKHEAD, INFO, TRACKS, CLUSTER, TAGS, CUES, CHAPTERS, ATTACHMENTS))
#: Beginnings of codec identifiers.
CODECS = (("V_MPEGH/ISO/HEVC", "HEVC"), ("V_MPEG4/ISO/AVC", "AVC"), ("V_AV1", "AV1"), ("V_VP9", "VP9"), ("V_PRORES", "ProRes"))


def _vint(data, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """(value, next place); None for an unknown size or where there is no number."""
    head = bytes(data[at : at + 8])
    if not head or not head[0]:
        return None, -1
    n = 9 - head[0].bit_length()
    if n > 8 or len(head) < n or keep_marker and n > 4:
        return None, -1
    value = int.from_bytes(head[:n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, body, end, size known) of the children of a master element. One of unknown size reaches to `end`."""
    while at < end:
        kind, body = _vint(data, at, True)
        if kind is None:
            return
        size, body = _vint(data, body, False)
        if body < 0:
            return
        stop = end if size is None else min(body + size, end)
        yield kind, body, stop, size is not None
        at = stop


def _uint(data, at: int, end: int) -> int:
    return int.from_bytes(bytes(data[at : min(end, at + 8)]), "big")


def _float(data, at: int, end: int) -> float | None:
    raw = bytes(data[at:end])
    return struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if len(raw) in (4, 8) else None


def _display(data, at: int, end: int) -> dict | None:
    seen = {k: _float(data, a, z) for k, a, z, _ in elements(data, at, end)}
    if seen.get(LUM_MAX) is None:
        return None
    exact = lambda x: int(x * 10000 + 0.5) / 10000
    name = None
    if all(seen.get(p) is not None for p in POINTS):
        r, g, b, w = ((seen[POINTS[i]], seen[POINTS[i + 1]]) for i in range(0, 8, 2))
        name = sei.gamut(r, g, b, w)
    return {"max_luminance": exact(seen[LUM_MAX]), "min_luminance": exact(seen.get(LUM_MIN) or 0.0), "primaries": name, "primaries_level": None}


def _video(data, at: int, end: int, t: dict) -> None:
    for kind, a, z, _ in elements(data, at, end):
        if kind == WIDTH:
            t["width"] = _uint(data, a, z)
        elif kind == HEIGHT:
            t["height"] = _uint(data, a, z)
        elif kind == COLOUR:
            seen = {}
            for k, b, y, _ in elements(data, a, z):
                if k == DISPLAY:
                    t["mastering"] = _display(data, b, y) or t["mastering"]
                else:
                    seen[k] = _uint(data, b, y)
            t["color"] = headers.color(seen.get(PRIMARIES), seen.get(TRANSFER), seen.get(MATRIX), {1: False, 2: True}.get(seen.get(RANGE)))
            if CLL in seen or FALL in seen:
                cll, fall = seen.get(CLL, 0) & 0xFFFF, seen.get(FALL, 0) & 0xFFFF
                t["content_light"] = {"max_cll": cll, "max_fall": fall, "zeroed": (cll == fall == 0) or None}


def entry(data, at: int, end: int) -> dict | None:
    """A video track from its entry."""
    t, kind, name, private = track(""), 0, b"", b""
    t["default"], t["uid"], t["frame_ns"] = True, None, 0
    for k, a, z, _ in elements(data, at, end):
        if k == NUMBER:
            t["track_number"] = _uint(data, a, z)
        elif k == UID:
            t["uid"] = _uint(data, a, z)
        elif k == TYPE:
            kind = _uint(data, a, z)
        elif k == DEFAULT:
            t["default"] = _uint(data, a, z) != 0
        elif k == RATE:
            t["frame_ns"] = _uint(data, a, z) or t["frame_ns"]
        elif k == CODEC:
            name = bytes(data[a:z])
        elif k == PRIVATE:
            private = bytes(data[a:z])
        elif k == VIDEO:
            _video(data, a, z, t)
        elif k == MAPPING:
            seen = {k2: (b, y) for k2, b, y, _ in elements(data, a, z)}
            if ADD_TYPE in seen and ADD_DATA in seen and _uint(data, *seen[ADD_TYPE]).to_bytes(8, "big")[4:] in (b"dvcC", b"dvvC", b"dvwC"):
                t["dv_config"] = headers.dv_config(bytes(data[slice(*seen[ADD_DATA])])) or t["dv_config"]
    if kind != 1:
        return None
    text = name.decode("latin-1").rstrip("\x00")
    t["codec"] = next((c for prefix, c in CODECS if text.startswith(prefix)), text)
    info = {"HEVC": headers.hevc_config, "AVC": headers.avc_config, "AV1": headers.av1_config}.get(t["codec"], lambda _: None)(private)
    if info:
        t |= {k: info[k] for k in ("bit_depth", "chroma", "profile")} | {"nal": info.get("nal_length", 0)}
        t["color"] = fill_color(t["color"], (info["sps"] or {}).get("color"))
    elif t["codec"] in ("HEVC", "AVC"):
        t["nal"] = 4
    elif t["codec"] == "VP9":
        said = headers.vp9_private(private)
        t |= {"bit_depth": said["bit_depth"], "chroma": said["chroma"], "profile": None if said["profile"] is None else headers.vp9_label(said["profile"], said["level"])}
    elif t["codec"] == "ProRes":
        t["profile"], t["chroma"], t["bit_depth"] = headers.PRORES.get(private[:4].decode("latin-1"), (None, None, None))
    return t


def _block(data, at: int, end: int) -> tuple[int | None, int, int] | None:
    """(track number, offset, size) of an unlaced block's payload."""
    number, p = _vint(data, at, False)
    if number is None or p + 3 > end or bytes(data[p + 2 : p + 3])[0] & 6:
        return None
    return number, p + 3, end - p - 3


def blocks(data, at: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """("block" or "t35", track number, offset, size) in a cluster; additional payloads only where their id says T.35."""
    for kind, a, z, _ in elements(data, at, end):
        if kind == SIMPLE and (b := _block(data, a, z)):
            yield "block", *b
        elif kind == GROUP:
            parts = list(elements(data, a, z))
            owner = next((b for k, x, y, _ in parts if k == BLOCK and (b := _block(data, x, y))), None)
            if owner:
                yield "block", *owner
                for x, y in ((x, y) for k, x, y, _ in parts if k == ADDITIONS):
                    for more, m, n, _ in elements(data, x, y):
                        seen = {k: (p, q) for k, p, q, _ in elements(data, m, n)} if more == MORE else {}
                        if ADDITIONAL in seen and ADD_ID in seen and _uint(data, *seen[ADD_ID]) == 4:
                            p, q = seen[ADDITIONAL]
                            yield "t35", owner[0], p, q - p


def tags(data, at: int, end: int) -> list[dict]:
    """Statistics of each tag: the track it is about, bits a second, bytes."""
    out = []
    for kind, a, z, _ in elements(data, at, end):
        if kind != TAG:
            continue
        row = {"uid": None, "bps": None, "bytes": None}
        for k, b, y, _ in elements(data, a, z):
            if k == TARGETS:
                row["uid"] = next((_uint(data, p, q) for k2, p, q, _ in elements(data, b, y) if k2 == TAG_UID), row["uid"])
            elif k == SIMPLE_TAG:
                seen = {k2: bytes(data[p:q]).rstrip(b"\x00") for k2, p, q, _ in elements(data, b, y)}
                field = {b"BPS": "bps", b"NUMBER_OF_BYTES": "bytes"}.get(seen.get(NAME, b"").upper())
                if field and seen.get(STRING, b"").strip().isdigit():
                    row[field] = int(seen[STRING])
        out.append(row)
    return out


def _clusters_end(data, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next element of the segment's level."""
    while at < end:
        kind, _ = _vint(data, at, True)
        nxt = next(elements(data, at, end), None)
        if kind in LEVEL_ONE or not nxt:
            return at
        at = nxt[2]
    return at


def group(tracks: list[dict]) -> tuple[list[dict], dict[int, dict]]:
    """Logical tracks, and the one that each track number's blocks belong to: layers go to the first base with a
    configuration, else to the last widest."""
    layers = [t for t in tracks if t["dv_config"] and not t["dv_config"]["bl_present"]]
    bases = [t for t in tracks if not any(t is x for x in layers)]
    if not bases:
        return tracks, {t["track_number"]: t for t in tracks}
    base = next((t for t in bases if t["dv_config"]), bases[last_widest(bases)])
    for x in layers:
        base["dv_config"], base["dual_track"] = base["dv_config"] or x["dv_config"], True
    return bases, {t["track_number"]: t for t in bases} | {x["track_number"]: base for x in layers}


def read(data, full: bool = False) -> dict:
    top = next(((a, z) for k, a, z, _ in elements(data, 0, len(data)) if k == SEGMENT), None)
    if not top:
        raise Unreadable("no segment")
    start, end = top
    scale, ticks, tracks, owners, stats, tail, cut = 1_000_000, None, [], {}, [], None, False
    size, first = {}, {}
    clusters: list[tuple[int, int]] = []
    counted: dict[int, list[int]] = {}
    at = start
    while at < end and not cut:
        nxt = next(elements(data, at, end), None)
        if not nxt:
            break
        kind, a, z, known = nxt
        if kind == INFO:
            for k, b, y, _ in elements(data, a, z):
                if k == SCALE:
                    scale = _uint(data, b, y)
                elif k == DURATION:
                    ticks = _float(data, b, y)
        elif kind == TRACKS and not tracks:
            found = [t for k, b, y, _ in elements(data, a, z) if k == ENTRY and (t := entry(data, b, y))]
            tracks, owners = group(sorted(found, key=lambda t: t["track_number"] or 0))
        elif kind == SEEKHEAD and tail is None:
            for k, b, y, _ in elements(data, a, z):
                seen = {k2: (p, q) for k2, p, q, _ in elements(data, b, y)} if k == SEEK else {}
                if SEEK_ID in seen and SEEK_POSITION in seen and _uint(data, *seen[SEEK_ID]) == TAGS:
                    tail = start + _uint(data, *seen[SEEK_POSITION])
        elif kind == TAGS:
            stats += tags(data, a, z)
        elif kind == CLUSTER:
            if not known:
                z = _clusters_end(data, a, end)
            clusters.append((a, z))
            for what, number, offset, n in blocks(data, a, z):
                if (t := owners.get(number)) is None:
                    continue
                if full:  # a whole film's blocks are counted here and given out by the walk
                    seen = counted.setdefault(id(t), [0, 0])
                    seen[0] += what == "block"
                    seen[1] += n * (what == "block")
                    continue
                t["t35" if what == "t35" else "units"].append((offset, n))
                if what == "block":
                    key = id(t)
                    first.setdefault(key, offset)
                    size[key] = offset + n - first[key]
                    cut = len(t["units"]) >= HEAD_BLOCKS or size[key] >= HEAD_SPAN
                    if cut:
                        break
        elif not known:
            break
        at = z
    if not tracks:
        raise Unreadable("no video track")
    if not stats and tail is not None and tail < end:
        nxt = next(elements(data, tail, end), None)
        stats = tags(data, nxt[1], nxt[2]) if nxt and nxt[0] == TAGS else []
    secs = ticks * scale / 1e9 if ticks and ticks > 0 else None
    for t in tracks:
        n, bytes_in = counted.get(id(t), [0, 0]) if full else (len(t["units"]), sum(s for _, s in t["units"]))
        uid, step = t.pop("uid"), t.pop("frame_ns")
        if full:
            t["count"] = n
        t["fps"] = 1e9 / step if step else n / secs if secs and n and not cut else None
        said = next((s for s in stats if uid is not None and s["uid"] == uid and (s["bps"] is not None or s["bytes"] is not None)), None)
        if said and said["bps"] is not None:
            t["bitrate"] = {"bits_per_sec": float(said["bps"]), "scope": "video_stream"}
        elif said:
            t["bitrate"] = bits_per_second(said["bytes"], secs, "video_stream")
        elif not cut:
            t["bitrate"] = bits_per_second(bytes_in, secs, "video_stream")
        elif len(tracks) == 1:
            t["bitrate"] = bits_per_second(len(data), secs, "overall")

    def walk() -> Iterator[tuple[int, str, int, int]]:
        """(track, "block" or "t35", offset, size), cluster by cluster."""
        place = {id(t): i for i, t in enumerate(tracks)}
        for a, z in clusters:
            for what, number, offset, n in blocks(data, a, z):
                if (t := owners.get(number)) is not None and id(t) in place:
                    yield place[id(t)], what, offset, n

    if full:
        for t in tracks:  # headers in the first frames say what the container does not
            i = place_of(tracks, t)
            t["units"] = [(o, n) for j, what, o, n in islice(walk(), HEAD_BLOCKS) if j == i and what == "block"][:32] if t["codec"] in ("VP9", "ProRes") else []
    for t in tracks:
        if t["codec"] == "VP9":
            fill_from_frames(t, data, headers.vp9_frame)
        elif t["codec"] == "ProRes":
            fill_from_frames(t, data, headers.prores_frame)
    return media("Matroska", tracks, secs) | ({"walk": walk} if full else {})


def place_of(tracks: list[dict], t: dict) -> int:
    return next(i for i, x in enumerate(tracks) if x is t)


def looks(data) -> bool:
    return big(bytes(data[:4]), 0, 4) == EBML
