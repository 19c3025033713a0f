"""ISO base media: boxes, sample descriptions, sample tables, fragments. Offsets are into the file."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np

from nitscope.functions import bits, headers, sei
from nitscope.functions.bits import big
from nitscope.sources.model import Unreadable, bits_per_second, fill_color, fill_from_frames, fold_layers, last_widest, media, track

#: Codec of a sample entry.
CODECS = {"hvc1": "HEVC", "hev1": "HEVC", "dvh1": "HEVC", "dvhe": "HEVC", "avc1": "AVC", "avc3": "AVC", "dva1": "AVC", "dvav": "AVC", "av01": "AV1", "dav1": "AV1", "vp09": "VP9"} | dict.fromkeys(headers.PRORES, "ProRes")


class Box:
    __slots__ = ("data", "kind", "start", "body", "end")

    def __init__(self, data, kind: str, start: int, body: int, end: int):
        self.data, self.kind, self.start, self.body, self.end = data, kind, start, body, end

    def bytes(self) -> bytes:
        return bytes(self.data[self.body : self.end])

    def children(self, skip: int = 0) -> list[Box]:
        return boxes(self.data, self.body + skip, self.end)

    def find(self, *path: str) -> Box | None:
        here: Box | None = self
        for kind in path:
            here = next((b for b in here.children() if b.kind == kind), None) if here else None
        return here


def boxes(data, at: int, end: int) -> list[Box]:
    """Boxes from `at`; a size of 0 reaches to the end, 1 means a 64-bit size; a box that can't be ends the walk."""
    out = []
    while at + 8 <= end:
        head = bytes(data[at : at + 16])
        size, body = big(head, 0, 4), at + 8
        if size == 1:
            size, body = big(head, 8, 8), at + 16
        stop = end if size == 0 else at + size
        if stop < body:
            break
        out.append(Box(data, head[4:8].decode("latin-1"), at, body, min(stop, end)))
        if stop > end:
            break
        at = stop
    return out


def _table(box: Box, width: int, head: int = 8) -> tuple[bytes, int]:
    """A full box's entries and their number, never more than fit."""
    raw = box.bytes()
    n = min(big(raw, head - 4, 4), max(len(raw) - head, 0) // width)
    return raw[head : head + n * width], n


def _clock(box: Box | None) -> tuple[int, int]:
    """(timescale, duration) of mvhd or mdhd."""
    raw = box.bytes() if box else b""
    return (big(raw, 20, 4), big(raw, 24, 8)) if raw[:1] == b"\x01" else (big(raw, 12, 4), big(raw, 16, 4))


def sample_units(stbl: Box) -> list[tuple[int, int]]:
    """Byte ranges of the samples. A chunk has as many as the last stsc entry at or before it says; a sample's place is
    its chunk's plus the sizes before it in the chunk."""
    found = {b.kind: b for b in stbl.children()}
    places = found.get("stco") or found.get("co64")
    if not (places and "stsz" in found and "stsc" in found):
        raise Unreadable("no sample table")
    raw = found["stsz"].bytes()
    fixed, count = big(raw, 4, 4), big(raw, 8, 4)
    sizes = None if fixed else np.frombuffer(_table(found["stsz"], 4, 12)[0], ">u4")
    wide = 4 if places.kind == "stco" else 8
    chunks = np.frombuffer(_table(places, wide)[0], f">u{wide}").tolist()
    steps = np.frombuffer(_table(found["stsc"], 12)[0], ">u4").reshape(-1, 3)[:, :2].tolist()
    first = list(accumulate((a for a, _ in steps), max))
    left, out, i = count if fixed else len(sizes), [], 0
    for number, at in enumerate(chunks, 1):
        k = bisect_right(first, number) - 1
        if first != [a for a, _ in steps]:  # entries out of order: the last that qualifies, as they stand
            k = max((j for j, (a, _) in enumerate(steps) if a <= number), default=-1)
        for _ in range(min(steps[k][1], left - i) if k >= 0 else 0):
            n = fixed or int(sizes[i])
            out.append((at, n))
            at, i = at + n, i + 1
        if i >= left:
            break
    return out


def uniform_rate(stbl: Box, timescale: int) -> float | None:
    box = stbl.find("stts")
    if not box:
        return None
    rows = np.frombuffer(_table(box, 8)[0], ">u4").reshape(-1, 2).tolist()
    used = [(n, d) for n, d in rows if n]
    if len(used) > 1 and rows[-1][0] == 1:
        used.pop()
    steps = {d for _, d in used}
    return timescale / steps.pop() if len(steps) == 1 and timescale and min(steps) else None


def fragment_units(top: list[Box], track_id: int, defaults: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """Byte ranges of a track's samples in all fragments, and the sum of their durations. Sizes and durations come from
    the run, else the fragment header, else the track's defaults; a run that nothing sizes is left out."""
    units, ticks = [], 0
    for moof in (b for b in top if b.kind == "moof"):
        implied = moof.start
        for traf in (b for b in moof.children() if b.kind == "traf"):
            head = traf.find("tfhd")
            if not head:
                continue
            raw = head.bytes()
            flags, owner, at = big(raw, 1, 3), big(raw, 4, 4), 8
            given = {}
            for bit, width in ((1, 8), (2, 4), (8, 4), (16, 4)):
                if flags & bit:
                    given[bit], at = big(raw, at, width), at + width
            size, span = defaults.get(owner, (None, None))
            size, span = given.get(16, size), given.get(8, span)
            base = given.get(1, moof.start if flags & 0x20000 else implied)
            place = base
            for run in (b for b in traf.children() if b.kind == "trun"):
                raw = run.bytes()
                flags, count, at = big(raw, 1, 3), big(raw, 4, 4), 8
                if flags & 1:
                    place, at = max(base + int.from_bytes(raw[at : at + 4], "big", signed=True), 0), at + 4
                at += 4 * bool(flags & 4)
                fields = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
                if 0x200 not in fields and size is None:
                    continue
                # no more than the run lists or, where it lists none, than the file has room for
                room = max(len(moof.data) - place, 0) // size if size else 0
                count = min(count, max(len(raw) - at, 0) // (4 * len(fields)) if fields else room)
                for i in range(count):
                    row = {b: big(raw, at + 4 * (i * len(fields) + j), 4) for j, b in enumerate(fields)}
                    n = row.get(0x200, size or 0)
                    if owner == track_id:
                        units.append((place, n))
                        ticks += row.get(0x100, span or 0)
                    place += n
            implied = place
    return units, ticks


def _from_sidx(box: Box) -> list[int]:
    """Where the fragments begin that a segment index names: one behind the other, the first behind the box."""
    raw = box.bytes()
    wide = raw[:1] != b"\x00"
    skip, at = (big(raw, 20, 8), 32) if wide else (big(raw, 16, 4), 24)
    count = min(big(raw, at - 2, 2), max(len(raw) - at, 0) // 12)
    words = np.frombuffer(raw[at : at + 12 * count], ">u4").reshape(-1, 3)[:, 0].astype(np.int64)
    nested, sizes = words >> 31 == 1, words & 0x7FFFFFFF
    if (empty := np.flatnonzero(sizes == 0)).size:
        nested, sizes = nested[: empty[0]], sizes[: empty[0]]
    starts = box.end + skip + np.cumsum(sizes) - sizes
    return starts[~nested].tolist()


def _from_mfra(data) -> list[int]:
    """Those that the random-access index at the file's end names, for all tracks."""
    tail, out = bytes(data[max(len(data) - 16, 0) :]), set()
    if len(tail) < 16 or tail[4:8] != b"mfro" or big(tail, 0, 4) != 16:
        return []
    for mfra in boxes(data, max(len(data) - big(tail, 12, 4), 0), len(data))[:1]:
        for raw in (b.bytes() for b in mfra.children() if mfra.kind == "mfra" and b.kind == "tfra"):
            wide, widths = 8 if raw[:1] == b"\x01" else 4, big(raw, 8, 4)
            row = 2 * wide + sum((widths >> shift & 3) + 1 for shift in (4, 2, 0))
            count = min(big(raw, 12, 4), max(len(raw) - 16, 0) // row)
            out |= {big(raw, 16 + i * row + wide, wide) for i in range(count)}
    return sorted(o for o in out if 0 < o < len(data))


def fragment_heads(data, most: int = 4096) -> list[int]:
    """Where fragments are said to begin, by an index before the first of them or at the end: hints of what to read ahead,
    on which no result depends. `most` bounds what an index may ask for."""
    front = []
    at = 0
    while at + 8 <= len(data) and (b := next(iter(boxes_one(data, at)), None)) and b.kind != "moof":
        if b.kind == "sidx":
            front = _from_sidx(b)
            break
        at = b.end
    return [o for o in front or _from_mfra(data) if o < len(data)][:most]


def boxes_one(data, at: int) -> list[Box]:
    """The box at a place, without looking at those behind it."""
    head = bytes(data[at : at + 16])
    size = big(head, 8, 8) if big(head, 0, 4) == 1 else big(head, 0, 4) or len(data) - at
    return boxes(data, at, min(at + size, len(data))) if size >= 8 else []


def _colour(raw: bytes) -> dict | None:
    if raw[:4] not in (b"nclx", b"nclc") or len(raw) < 10:
        return None
    full = bool(raw[10] & 0x80) if raw[:4] == b"nclx" and len(raw) > 10 else None
    return headers.color(big(raw, 4, 2), big(raw, 6, 2), big(raw, 8, 2), full)


def _views(vexu: Box) -> str | None:
    stri = vexu.find("eyes", "stri")
    raw = stri.bytes() if stri else b""
    if len(raw) < 5:
        return None
    if raw[4] & 4:
        return "Multiview 3D (2+ views)"
    return {3: "Stereoscopic 3D (2 views)", 1: "Monoscopic (1 view)", 2: "Monoscopic (1 view)"}.get(raw[4] & 3)


def _vpc(raw: bytes) -> dict | None:
    if len(raw) < 10 or raw[0] != 1:
        return None
    chroma = {0: "4:2:0", 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}.get(raw[6] >> 1 & 7, "?")
    return {"bit_depth": raw[6] >> 4, "chroma": chroma, "profile": headers.vp9_label(raw[4], raw[5] or None), "sps": {"color": headers.color(raw[7], raw[8], raw[9], bool(raw[6] & 1))}}


CONFIGS = {"hvcC": headers.hevc_config, "avcC": headers.avc_config, "av1C": headers.av1_config, "vpcC": _vpc}


def describe(stsd: Box) -> dict:
    """A track from the first sample entry."""
    entry = next(iter(stsd.children(8)), None)
    if not entry:
        raise Unreadable("no sample entry")
    raw = bytes(entry.data[entry.start : entry.start + 36])
    t = track(CODECS.get(entry.kind, entry.kind), width=big(raw, 32, 2), height=big(raw, 34, 2), nal=4)
    if entry.kind in headers.PRORES:
        t["profile"], t["chroma"], t["bit_depth"] = headers.PRORES[entry.kind]
    stream, layered = None, False
    for box in boxes(entry.data, entry.start + 86, entry.end):
        body = box.bytes()
        if box.kind in CONFIGS:
            info = CONFIGS[box.kind](body)
            if info:
                t |= {k: info[k] for k in ("bit_depth", "chroma", "profile")} | {"nal": info.get("nal_length", t["nal"])}
                stream = (info["sps"] or {}).get("color") or stream
        elif box.kind in ("dvcC", "dvvC", "dvwC"):
            t["dv_config"] = headers.dv_config(body)
        elif box.kind == "lhvC":
            layered = True
        elif box.kind == "vexu":
            t["stereo"] = _views(box) or t["stereo"]
        elif box.kind == "cuvv":
            t["vivid_map"] = big(body, 0, 2) or None if big(body, 2, 2) == 4 else None
        elif box.kind == "colr":
            t["color"] = _colour(body) or t["color"]
        elif box.kind in ("mdcv", "SmDm"):
            t["mastering"] = sei.mastering(body) or t["mastering"]
        elif box.kind in ("clli", "CoLL"):
            t["content_light"] = sei.content_light(body) or t["content_light"]
    t["color"] = fill_color(t["color"], stream)
    if layered and t["profile"]:
        t["profile"] = f"Multiview {t['profile']}"
    return t


def _stream_colour(t: dict, data) -> dict | None:
    """Colour of the first parameter set in the first samples."""
    for o, n in t["units"][:8]:
        part = bytes(data[o : o + n])
        for a, z in bits.length_prefixed(part, t["nal"]):
            if part[a] >> 1 & 63 == 33 and (s := headers.hevc_sps(part[a:z])) and s["color"]:
                return s["color"]
    return None


def read(data, full: bool = False) -> dict:
    top = boxes(data, 0, len(data))
    moov = next((b for b in top if b.kind == "moov"), None)
    if not moov:
        raise Unreadable("no moov box")
    brand = next((bytes(data[b.body : b.body + 4]) for b in top if b.kind == "ftyp"), b"")
    movie_scale, movie_span = _clock(moov.find("mvhd"))
    mvex = moov.find("mvex")
    defaults, extended = {}, 0
    for b in mvex.children() if mvex else []:
        raw = b.bytes()
        if b.kind == "trex":
            defaults.setdefault(big(raw, 4, 4), (big(raw, 16, 4), big(raw, 12, 4)))
        elif b.kind == "mehd":
            extended = big(raw, 4, 8) if raw[:1] == b"\x01" else big(raw, 4, 4)
    tracks = []
    for trak in (b for b in moov.children() if b.kind == "trak"):
        handler, stbl = trak.find("mdia", "hdlr"), trak.find("mdia", "minf", "stbl")
        if not handler or handler.bytes()[8:12] != b"vide" or not stbl:
            continue
        stsd = stbl.find("stsd")
        if not stsd:
            raise Unreadable("no sample description")
        t = describe(stsd)
        head = trak.find("tkhd")
        raw = head.bytes() if head else b""
        t["track_number"] = big(raw, 20 if raw[:1] == b"\x01" else 12, 4)
        scale, span = _clock(trak.find("mdia", "mdhd"))
        t["units"] = sample_units(stbl)
        own = span / scale if scale and span else None
        t["secs"] = own or (movie_span / movie_scale if movie_scale and movie_span else None)
        t["fps"] = (uniform_rate(stbl, scale) if t["units"] else None) or (len(t["units"]) / t["secs"] if t["units"] and t["secs"] else None)
        if not t["units"] and any(b.kind == "moof" for b in top):
            t["units"], ticks = fragment_units(top, t["track_number"], defaults)
            if ticks and scale:
                own = ticks / scale
            t["secs"] = t["secs"] or own or (extended / movie_scale if extended and movie_scale else None)
            if not t["fps"] and t["units"]:
                t["fps"] = len(t["units"]) * scale / ticks if ticks and scale else len(t["units"]) / t["secs"] if t["secs"] else None
        t["own_secs"] = own or t["secs"]
        tracks.append(t)
    if not tracks:
        raise Unreadable("no video track")
    bases = [t for t in tracks if not (t["dv_config"] and not t["dv_config"]["bl_present"])]
    tracks = fold_layers(tracks, last_widest(bases) if bases else 0)
    for t in tracks:
        if t["color"]["transfer"] is None:
            t["color"] = _stream_colour(t, data) or t["color"]
        t["bitrate"] = bits_per_second(sum(n for _, n in t["units"]), t.pop("own_secs"), "video_stream")
        if t["codec"] == "ProRes":
            fill_from_frames(t, data, headers.prores_frame)
    spans = [s for t in tracks if (s := t.pop("secs"))]
    return media("QuickTime (MOV)" if brand == b"qt  " else "MP4 (ISOBMFF)", tracks, max(spans, default=None))
