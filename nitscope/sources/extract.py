"""From one input's bytes to rows: its tracks, and the findings of the access units that are looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from nitscope.functions import bits, rpu, sei
from nitscope.sources import dispatch, sidecar
from nitscope.sources.model import Unreadable, bits_per_second

COLOR = "struct<primaries:string,transfer:string,matrix:string,range:string>"
DISPLAY = "struct<max_luminance:double,min_luminance:double,primaries:string,primaries_level:int>"
LIGHT = "struct<max_cll:int,max_fall:int,zeroed:boolean>"
CONFIG = "struct<profile:int,level:int,bl_present:boolean,el_present:boolean,rpu_present:boolean,bl_compatibility_id:int>"
TRACK = f"""file string, size_bytes long, error string, container string, duration_secs double,
    bd_iso struct<playlist:string,playlist_duration_secs:double,clip:string,clip_index:long,clip_count:long>,
    track_idx int, track_number decimal(20,0), program int, `default` boolean, codec string, profile string, width long, height long, fps double,
    bit_depth int, chroma string, stereo string, color {COLOR}, dv_config {CONFIG}, dual_track boolean, mastering {DISPLAY}, content_light {LIGHT},
    vivid_map int, bitrate struct<bits_per_sec:double,scope:string>, units long, sidecar string, sampled boolean"""
SEI = f"""struct<mastering:{DISPLAY},content_light:{LIGHT},preferred_transfer:int,hdr10plus:struct<application_version:int,num_windows:int,profile:string,target_max_luminance:long>,
    sl_hdr:struct<mode:int,spec_version:string,payload_mode:int,target_primaries:int,target_max_luminance:long,source_mastering:{DISPLAY}>,hdr_vivid:struct<version:int,system_start_code:int,target_pq:array<int>>>"""
BLOCK = "struct<level:int,target_max_pq:int,`index`:int,left:int,right:int,top:int,bottom:int,max_cll:int,max_fall:int,max_mastering:int,min_mastering:int,primary:int,custom:array<int>,content:int,white:int,reference:boolean,version:int>"
RPU = f"struct<profile:int,el_type:string,vdr_bit_depth:int,scene_refresh:int,source_min_pq:int,source_max_pq:int,fingerprint:string,blocks:array<{BLOCK}>>"
FINDING = f"file string, track_idx int, ord long, weight long, sei {SEI}, rpu {RPU}"
BLOCK_FIELDS = ("level", "target_max_pq", "index", "left", "right", "top", "bottom", "max_cll", "max_fall", "max_mastering", "min_mastering", "primary", "custom", "content", "white", "reference", "version")


def positions(n: int, samples: int, full: bool, pinned: int | None) -> list[int]:
    """Sample positions; `operators.selection.positions` is the same as an expression."""
    if full or n <= samples:
        return list(range(n))
    head = max(1, samples // 3)
    rest = samples - head
    chosen = {*range(head), *((k + 1) * (n - 1) // (rest + 1) for k in range(rest))}
    return sorted(chosen | ({pinned} if pinned is not None and pinned < n else set()))


def rpu_row(found: dict | None) -> dict | None:
    if not found:
        return None
    dm = found["dm"]
    row = {k: found[k] for k in ("profile", "el_type", "vdr_bit_depth")} | dict.fromkeys(("scene_refresh", "source_min_pq", "source_max_pq", "fingerprint", "blocks"))
    if dm:
        row |= {k: dm[k] for k in ("scene_refresh", "source_min_pq", "source_max_pq")} | {"fingerprint": rpu.fingerprint(dm), "blocks": [{k: x.get(k) for k in BLOCK_FIELDS} for x in dm["blocks"]]}
    return row


def look(unit: bytes, codec: str, nal: int) -> tuple[dict, list[dict]]:
    """Findings and RPUs of one access unit."""
    if codec == "AV1":
        found, payloads = sei.av1_unit(unit)
        return found, [r for p in payloads if (r := rpu_row(rpu.from_av1(p)))]
    found, rpus = dict(sei.EMPTY), []
    if codec not in ("HEVC", "AVC"):
        return found, rpus
    for a, z in bits.length_prefixed(unit, nal) if nal else bits.annexb(unit):
        part = unit[a:z]
        kind = part[0] >> 1 & 63 if codec == "HEVC" else part[0] & 31
        if codec == "HEVC" and kind in (39, 40) or codec == "AVC" and kind == 6:
            found = sei.merge(found, sei.unit(part, 2 if codec == "HEVC" else 1))
        elif codec == "HEVC" and kind == 62 and (r := rpu_row(rpu.from_hevc(part))):
            rpus.append(r)
        elif codec == "AVC" and kind >= 24 and (r := rpu_row(rpu.from_avc(part))):
            rpus.append(r)
    return found, rpus


def xml_facts(kind: str, data) -> dict:
    """Rate and display that a mastering document states."""
    return {k: v for k, v in sidecar.dv_xml(bytes(data)).items() if k in ("fps", "mastering")} if kind == "xml" else {}


def xml_rpus(data: bytes) -> Iterator[dict]:
    """A mastering document's runs of equal frames, as rows like those of parsed RPUs."""
    facts = sidecar.dv_xml(data)
    blocks = [{"level": 254}] if facts["cm_version"] == "CM v4.0" else []
    if facts["light"]:
        blocks.append({"level": 6, "max_cll": facts["light"][0], "max_fall": facts["light"][1]})
    for i, (content, n, begins) in enumerate(facts["runs"]):
        row = {"profile": 8, "el_type": None, "vdr_bit_depth": None, "scene_refresh": int(begins), "source_min_pq": None, "source_max_pq": None, "fingerprint": hashlib.sha256(content.encode()).hexdigest(), "blocks": [{k: b.get(k) for k in BLOCK_FIELDS} for b in blocks]}
        yield {"ord": i, "weight": n, "sei": None, "rpu": row}


class _Said:
    """Rows of one track's units, looked at in their order."""

    def __init__(self, path: str, index: int, t: dict):
        self.path, self.index, self.t, self.t35 = path, index, t, 0
        self.found = False

    def unit(self, k: int, unit: bytes) -> Iterator[dict]:
        found, rpus = look(unit, self.t["codec"], self.t["nal"])
        if any(v is not None for v in found.values()):
            yield {"file": self.path, "track_idx": self.index, "ord": k * 16, "weight": 1, "sei": found, "rpu": None}
        for j, r in enumerate(rpus):
            yield {"file": self.path, "track_idx": self.index, "ord": k * 16 + j, "weight": 1, "sei": None, "rpu": r}

    def payload(self, data: bytes) -> Iterator[dict]:
        """The first HDR10+ payload that stands beside the frames."""
        if not self.found and (info := sei.hdr10plus(data)):
            self.found = True
            yield {"file": self.path, "track_idx": self.index, "ord": (1 << 40) + self.t35, "weight": 1, "sei": sei.EMPTY | {"hdr10plus": info}, "rpu": None}
        self.t35 += 1


def _walked(path: str, data, m: dict) -> Iterator[dict]:
    """Findings of all units of an input that gives them out one by one; counts and bytes go to the tracks."""
    said = [_Said(path, i, t) for i, t in enumerate(m["tracks"])]
    count, size = [0] * len(said), [0] * len(said)
    for i, *unit in m["walk"]():
        if len(unit) == 1:
            part = unit[0]
        else:
            part = bytes(data[unit[1] : unit[1] + unit[2]])
            if unit[0] == "t35":
                yield from said[i].payload(part)
                continue
        yield from said[i].unit(count[i], part)
        count[i], size[i] = count[i] + 1, size[i] + len(part)
    for t, n, total in zip(m["tracks"], count, size, strict=True):
        t["count"] = n
        t["bitrate"] = t["bitrate"] or bits_per_second(total, m["duration_secs"], "video_stream")


def _sidecar_findings(path: str, kind: str, data) -> Iterator[dict]:
    if kind == "rpu":
        for i, (unit, n) in enumerate(sidecar.rpu_runs(bytes(data))):
            if r := rpu_row(rpu.from_hevc(unit)):
                yield {"file": path, "track_idx": 0, "ord": i, "weight": n, "sei": None, "rpu": r}
    elif kind == "xml":
        for row in xml_rpus(bytes(data)):
            yield {"file": path, "track_idx": 0} | row
    elif kind == "json":
        yield {"file": path, "track_idx": 0, "ord": 0, "weight": 1, "sei": sei.EMPTY | {"hdr10plus": sidecar.hdr10plus_json(bytes(data[: sidecar.HEAD]))}, "rpu": None}


BROKEN = (Unreadable, ValueError, IndexError, KeyError, OSError)


def scan(path: str, data, full: bool, samples: int, look_inside: bool = True) -> Iterator[tuple[str, dict]]:
    """("finding", row) for each access unit that says something and each RPU, with `ord` as the order and `weight` the
    frames, then ("track", row) for each track, or one with the error. The input is read once. Without `look_inside` units
    are not looked at."""
    blank = {"file": path, "size_bytes": len(data), "error": None, "sampled": not full}
    try:
        if kind := sidecar.kind(path, bytes(data[: sidecar.HEAD])):
            row = blank | {"container": {"rpu": "Dolby Vision RPU", "xml": "Dolby Vision XML", "json": "HDR10+ JSON"}[kind], "track_idx": 0, "codec": "", "width": 0, "height": 0, "dual_track": False, "sidecar": kind, "sampled": False} | xml_facts(kind, data)
            try:
                yield from (("finding", r) for r in (_sidecar_findings(path, kind, data) if look_inside else ()))
            except BROKEN:
                pass
            yield "track", row
            return
        m = dispatch.demux(path, data, full)
    except BROKEN as e:
        yield "track", blank | {"error": str(e) or type(e).__name__}
        return
    if "walk" in m and look_inside:
        yield from (("finding", r) for r in _walked(path, data, m))
    for i, t in enumerate(m["tracks"] if look_inside and "walk" not in m else ()):
        raw, said = t["stream"] if t["stream"] is not None else dispatch.part(data, m.get("shift", 0)), _Said(path, i, t)
        for k in positions(len(t["units"]), samples, full, t["pinned"]):
            o, n = t["units"][k]
            yield from (("finding", r) for r in said.unit(k, bytes(raw[o : o + n])))
        for o, n in t["t35"]:
            yield from (("finding", r) for r in said.payload(bytes(raw[o : o + n])))
    for i, t in enumerate(m["tracks"]):
        row = {k: t[k] for k in ("track_number", "program", "default", "codec", "profile", "width", "height", "fps", "bit_depth", "chroma", "stereo", "color", "dv_config", "dual_track", "mastering", "content_light", "vivid_map", "bitrate")}
        yield "track", blank | row | {"container": m["container"], "duration_secs": m["duration_secs"], "bd_iso": m.get("bd_iso"), "track_idx": i, "units": t.get("count", len(t["units"]))}


def track_rows(path: str, data, full: bool) -> Iterator[dict]:
    """One row for each track, or one row with the error."""
    return (r for kind, r in scan(path, data, full, 0, look_inside=full) if kind == "track")


def finding_rows(path: str, data, full: bool, samples: int) -> Iterator[dict]:
    return (r for kind, r in scan(path, data, full, samples) if kind == "finding")
