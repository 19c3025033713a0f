"""MPEG transport streams, also with four bytes before each packet: tables, elementary streams, clock."""

from __future__ import annotations

from nitscope.functions import bits, headers
from nitscope.functions.bits import big
from nitscope.sources.model import Unreadable, bits_per_second, from_headers, media, track

PACKET, SYNC, NO_PID = 188, 0x47, 0x1FFF
HEAD, TAIL, MODULUS = 24 << 20, 4 << 20, (1 << 33) * 300
HEVC, AVC = 0x24, 0x1B
PAT_PACKETS, PMT_PACKETS = 20_000, 40_000


def layout(data) -> tuple[int, int] | None:
    """(first, stride): five sync bytes at a stride of 188, else 192."""
    for stride in (188, 192):
        head = bytes(data[: 5 * stride])
        for first in range(stride if len(data) > 4 * stride else 0):
            if len(data) > first + 4 * stride and all(bytes(data[first + k * stride : first + k * stride + 1]) == b"G" for k in range(5)) and head:
                return first, stride
    return None


def packets(data, first: int, stride: int, start: int | None = None, end: int | None = None):
    """Places of packets from `start` on; a lost sync is found again within two strides, at three in a row, or ends the walk."""
    end = len(data) if end is None else min(end, len(data))
    at = first if start is None or start <= first else first + -(-(start - first) // stride) * stride
    while at + PACKET <= end:
        if data[at] != SYNC:
            again = next((c for c in range(at, min(at + 2 * stride, len(data))) if c + 2 * stride < len(data) and data[c] == data[c + stride] == data[c + 2 * stride] == SYNC), None)
            if again is None:
                return
            at = again
            continue
        yield at
        at += stride


def payload(packet: bytes) -> tuple[int, bool, bytes] | None:
    """(pid, begins a unit, payload)."""
    at = 5 + packet[4] if packet[3] & 0x20 else 4
    if not packet[3] & 0x10 or at >= PACKET:
        return None
    return (packet[1] & 31) << 8 | packet[2], bool(packet[1] & 0x40), packet[at:]


def _section(p: bytes, table: int) -> bytes | None:
    s = p[1 + p[0] :] if p else b""
    if len(s) < 12 or s[0] != table:
        return None
    return s[: max(min(len(s), (big(s, 1, 2) & 0xFFF) - 1), 0)]


def _pat(p: bytes) -> list[tuple[int, int]]:
    s = _section(p, 0) or b""
    return [(n, big(s, i + 2, 2) & NO_PID) for i in range(8, len(s) - 3, 4) if (n := big(s, i, 2))]


def _stream(s: bytes, at: int) -> dict:
    e = {"kind": s[at], "pid": big(s, at + 1, 2) & NO_PID, "dovi": False, "config": None, "base": None}
    d = s[at + 5 : at + 5 + (big(s, at + 3, 2) & 0xFFF)]
    i = 0
    while i + 2 <= len(d):
        body = d[i + 2 : i + 2 + d[i + 1]]
        e["dovi"] |= d[i] == 5 and body[:4] == b"DOVI" or d[i] == 0xB0
        if d[i] == 0xB0 and (c := headers.dv_config(body, descriptor=True)):
            e["config"], e["base"] = c, c["dependency_pid"] or e["base"]
        i += 2 + d[i + 1]
    return e


def _pmt(p: bytes) -> dict | None:
    s = _section(p, 2)
    if s is None:
        return None
    at, streams = 12 + (big(s, 10, 2) & 0xFFF), []
    while at + 5 <= len(s):
        streams.append(_stream(s, at))
        at += 5 + (big(s, at + 3, 2) & 0xFFF)
    return {"clock": big(s, 8, 2) & NO_PID, "streams": streams}


def programs(data, first: int, stride: int) -> list[dict]:
    """The first map of each program of the first table that names any, in the table's order."""
    named: list[tuple[int, int]] = []
    for n, at in enumerate(range(first, len(data) - PACKET + 1, stride)):
        if n >= PAT_PACKETS or named:
            break
        p = data[at] == SYNC and payload(bytes(data[at : at + PACKET]))
        if p and p[0] == 0 and p[1]:
            named = _pat(p[2])
    maps: dict[int, dict] = {}
    for n, at in enumerate(range(first, len(data) - PACKET + 1, stride)):
        if n >= PMT_PACKETS or len(maps) == len(named):
            break
        p = data[at] == SYNC and payload(bytes(data[at : at + PACKET]))
        if p and p[1]:
            number = next((k for k, pid in named if pid == p[0] and k not in maps), None)
            if number is not None and (m := _pmt(p[2])):
                maps[number] = m | {"number": number}
    return [maps[k] for k, _ in named if k in maps]


def groups(maps: list[dict]) -> list[dict]:
    """Logical tracks: a layer joins the base that its descriptor names, else the program's first; several plain video
    streams of a program without any Dolby Vision sign are one dual-track group."""
    out = []
    for m in maps:
        video = [s for s in m["streams"] if s["kind"] in (HEVC, AVC) or s["dovi"]]
        made = lambda streams, dual: {"program": m["number"], "streams": streams, "dual": dual}  # noqa: B023, E731
        if not video:
            continue
        if len(video) > 1 and not any(s["dovi"] for s in video):
            out.append(made(video, True))
            continue
        layers = [s for s in video if s["config"] and not s["config"]["bl_present"] or s["dovi"] and s["kind"] not in (HEVC, AVC)]
        bases = [s for s in video if not any(s is x for x in layers)]
        mine = [made([b], False) for b in bases] or [made(layers, False)]
        for x in layers if bases else []:
            g = mine[next((i for i, b in enumerate(bases) if b["pid"] == x["base"]), 0)]
            g["streams"].append(x)
            g["dual"] = True
        out += mine
    return out


def walk(data, first: int, stride: int, pids: list[list[int]], budget: int | None = None):
    """(group, unit) of elementary streams put together, in the order in which units end. A unit is given out when the next
    one of its PID begins; the last never is. No more is held than the open unit of each PID, however long the input."""
    owner = {p: i for i, group in enumerate(pids) for p in group}
    held: dict[int, list[bytes] | None] = {}
    for n, at in enumerate(packets(data, first, stride)):
        if budget is not None and n >= budget:
            break
        p = payload(bytes(data[at : at + PACKET]))
        if not p or p[0] not in owner:
            continue
        pid, begins, body = p
        if begins:
            if done := b"".join(held.get(pid) or ()):
                yield owner[pid], done
            from_ = 9 + body[8] if len(body) >= 9 and body[:3] == b"\x00\x00\x01" else len(body)
            held[pid] = [body[from_:]] if from_ < len(body) else None
        elif held.get(pid):
            held[pid].append(body)


def streams(data, first: int, stride: int, pids: list[list[int]], budget: int | None):
    """For each group, (bytes, units) of the first `budget` packets."""
    parts: list[list[bytes]] = [[] for _ in pids]
    units: list[list[tuple[int, int]]] = [[] for _ in pids]
    length = [0] * len(pids)
    for i, unit in walk(data, first, stride, pids, budget):
        parts[i].append(unit)
        units[i].append((length[i], len(unit)))
        length[i] += len(unit)
    return [(b"".join(parts[i]), units[i]) for i in range(len(pids))]


def _clock(packet: bytes) -> tuple[int, bool, int] | None:
    if not packet[3] & 0x20 or packet[4] < 7 or not packet[5] & 0x10:
        return None
    raw = big(packet, 6, 6)
    return (packet[1] & 31) << 8 | packet[2], bool(packet[5] & 0x80), (raw >> 15) * 300 + (raw & 511)


def clock_span(data, first: int, stride: int, pid: int) -> float | None:
    """Seconds from the first clock in the head to the last in the tail, once around; void if one that counts is marked
    discontinuous."""
    start = last = None
    for at in packets(data, first, stride, end=HEAD):
        c = _clock(bytes(data[at : at + 12]))
        if c and c[0] == pid:
            if c[1]:
                return None
            start = c[2]
            break
    if start is None:
        return None
    for at in packets(data, first, stride, start=max(len(data) - TAIL, 0)):
        c = _clock(bytes(data[at : at + 12]))
        if c and c[0] == pid:
            if c[1]:
                return None
            last = c[2]
    if last is None:
        return None
    secs = ((last - start) % MODULUS) / 27e6
    return secs if 0 < secs <= 26 * 3600 else None


def widest(data: bytes, units: list[tuple[int, int]], codec: str) -> tuple[dict, int] | None:
    """(parameter set, unit) of the widest, the first of equals; the search ends with a unit that has one of 3840."""
    best = None
    for i, (o, n) in enumerate(units):
        part = data[o : o + n]
        for a, z in bits.annexb(part):
            is_set = part[a] >> 1 & 63 == 33 if codec == "HEVC" else part[a] & 31 == 7
            s = (headers.hevc_sps if codec == "HEVC" else headers.avc_sps)(part[a:z]) if is_set else None
            if s and (best is None or s["width"] > best[0]["width"]):
                best = s, i
        if best and best[0]["width"] >= 3840:
            break
    return best


def read(data, full: bool = False) -> dict:
    """Facts from the head. With `full` there is a `walk` over all units besides, which the head's lists do not hold."""
    found = layout(data)
    if not found:
        raise Unreadable("not a transport stream")
    maps = programs(data, *found)
    if not maps:
        raise Unreadable("no program map")
    tracks_of = groups(maps)
    if not tracks_of:
        raise Unreadable("no video stream in the program map")
    pids = [[s["pid"] for s in g["streams"]] for g in tracks_of]
    made = streams(data, *found, pids, HEAD // 192 * min(len(pids), 3))
    clocks = [m["clock"] for m in maps] + [p for group in pids for p in group]
    secs = next((s for pid in clocks if pid != NO_PID and (s := clock_span(data, *found, pid))), None)
    out = []
    for g, (raw, units) in zip(tracks_of, made, strict=True):
        kinds = [s["kind"] for s in g["streams"]]
        config = next((s["config"] for s in g["streams"] if s["config"]), None)
        codec = "HEVC" if HEVC in kinds else "AVC" if AVC in kinds or config and config["profile"] == 9 else "HEVC"
        main = next((s for s in g["streams"] if s["kind"] in (HEVC, AVC)), g["streams"][0])
        t = track(codec, track_number=main["pid"], program=g["program"] if len(maps) > 1 else None, dv_config=config, dual_track=g["dual"], units=units, stream=raw)
        if best := widest(raw, units, codec):
            from_headers(t, best[0])
            t["pinned"] = best[1]
        if not full and len(tracks_of) == 1:
            t["bitrate"] = bits_per_second(len(data), secs, "overall")
        out.append(t)
    whole = {"walk": lambda: walk(data, *found, pids)} if full else {}
    return media("MPEG-2 TS (M2TS/BDAV)" if found[1] == 192 else "MPEG-2 TS", out, secs) | whole
