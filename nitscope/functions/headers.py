"""Sequence and frame headers: HEVC, AVC, AV1, VP9, ProRes, and the configuration records that carry them.

Every parser gives a plain dict, or None. Colour is a dict of names with None for what is not signalled.
"""

from __future__ import annotations

from nitscope.functions import labels
from nitscope.functions.bits import Bits, Short, attempt, big, obus, rbsp

CHROMA = labels.CHROMA
#: Profiles whose AVC parameter set carries chroma and depth fields.
AVC_WITH_CHROMA = (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135)
#: ProRes sample entries: profile, chroma, depth.
PRORES = {"apco": ("422 Proxy", "4:2:2", 10), "apcs": ("422 LT", "4:2:2", 10), "apcn": ("422", "4:2:2", 10), "apch": ("422 HQ", "4:2:2", 10), "ap4h": ("4444", "4:4:4", 12), "ap4x": ("4444 XQ", "4:4:4", 12)}
#: VP9 colour spaces as H.273 matrix codes.
VP9_MATRIX = {1: 5, 2: 1, 3: 6, 4: 7, 5: 9, 7: 0}


def color(primaries: int | None, transfer: int | None, matrix: int | None, full: bool | None) -> dict:
    return {"primaries": labels.PRIMARIES.get(primaries), "transfer": labels.TRANSFER.get(transfer), "matrix": labels.MATRIX.get(matrix), "range": None if full is None else "full" if full else "limited"}


NO_COLOR = color(None, None, None, None)


def _level_text(code: int, unit: int, step: int) -> str:
    major, minor = code // unit, code % unit // step
    return f"{major}.{minor}" if minor else str(major)


def hevc_label(profile: int, high: bool, level: int) -> str:
    return f"{labels.HEVC_PROFILES.get(profile, f'profile {profile}')}, {'High' if high else 'Main'} tier @ L{_level_text(level, 30, 3)}"


def avc_label(profile: int, level: int, set4: bool, set5: bool) -> str:
    name = ("Constrained High" if set5 else "Progressive High") if profile == 100 and set4 else "High" if profile == 100 else labels.AVC_PROFILES.get(profile, f"profile {profile}")
    return f"{name} @ L{_level_text(level, 10, 1)}"


def av1_label(profile: int, tier: int, level: int) -> str:
    head = f"{labels.AV1_PROFILES.get(profile, '?')} profile, {'High' if tier == 1 else 'Main'} tier"
    return head if level == 31 else f"{head} @ L{2 + level // 4}.{level % 4}"


def vp9_label(profile: int, level: int | None) -> str:
    return f"Profile {profile}" + (f" @ L{level // 10}.{level % 10}" if level is not None else "")


def av1_chroma(mono: bool, x: int, y: int) -> str:
    return "monochrome" if mono else {(1, 1): "4:2:0", (1, 0): "4:2:2", (0, 0): "4:4:4"}.get((x, y), "?")


def _usability(b: Bits) -> dict:
    """The shared beginning of the usability information, up to the colour description."""
    out = {}
    if b.flag() and b.u(8) == 255:
        b.skip(32)
    if b.flag():
        b.skip(1)
    if b.flag():
        b.skip(3)
        full = b.flag()
        if b.flag():
            out["color"] = color(b.u(8), b.u(8), b.u(8), full)
    if b.flag():
        b.ue(), b.ue()
    return out


def _cropped(size: int, crop: int) -> int:
    return size - crop if size > crop else size


# ---- HEVC


def _hevc_tail(b: Bits, sublayers: int, out: dict) -> None:
    """From the chroma depth to the timing; fills colour and frame rate as far as the data goes."""
    b.ue()
    poc_bits = b.ue() + 4
    for _ in range(sublayers + 1 if b.flag() else 1):
        b.ue(), b.ue(), b.ue()
    for _ in range(6):
        b.ue()
    if b.flag() and b.flag():
        for size in range(4):
            for _ in range(2 if size == 3 else 6):
                if b.flag():
                    for _ in range(min(64, 16 << 2 * size) + (size > 1)):
                        b.se()
                else:
                    b.ue()
    b.skip(2)
    if b.flag():
        b.skip(8)
        b.ue(), b.ue()
        b.skip(1)
    sets = b.ue()
    if sets > 64:
        raise Short
    sizes: list[int] = []
    for i in range(sets):
        if i and b.flag():
            b.skip(1)
            b.ue()
            used = 0
            for _ in range(sizes[-1] + 1):
                used += b.flag() or b.flag()
            sizes.append(used)
        else:
            below, above = b.ue(), b.ue()
            sizes.append(below + above)
            for _ in range(below + above):
                b.ue()
                b.skip(1)
    if b.flag():
        b.skip(b.ue() * (poc_bits + 1))
    b.skip(2)
    if not b.flag():
        return
    out |= _usability(b)
    b.skip(1)
    fields = b.flag()
    b.skip(1)
    if b.flag():
        b.ue(), b.ue(), b.ue(), b.ue()
    if b.flag():
        tick, scale = b.u(32), b.u(32)
        if tick and scale:
            out["fps"] = scale / tick / (2 if fields else 1)


@attempt
def hevc_sps(nal: bytes) -> dict | None:
    """Dimensions, depth, chroma, label; colour and rate where they can be read. `nal` has its two-byte header."""
    if len(nal) < 3:
        return None
    b = Bits(rbsp(nal[2:]))
    b.skip(4)
    sublayers = b.u(3)
    b.skip(3)
    high, profile = b.flag(), b.u(5)
    b.skip(80)
    level = b.u(8)
    if sublayers:
        present = [(b.flag(), b.flag()) for _ in range(sublayers)]
        b.skip(2 * (8 - sublayers))
        for has_profile, has_level in present:
            b.skip(88 * has_profile + 8 * has_level)
    b.ue()
    chroma = b.ue()
    b.skip(chroma == 3)
    width, height = b.ue(), b.ue()
    left, right, top, bottom = (b.ue(), b.ue(), b.ue(), b.ue()) if b.flag() else (0, 0, 0, 0)
    depth = b.ue() + 8
    x, y = {1: (2, 2), 2: (2, 1)}.get(chroma, (1, 1))
    out = {"width": _cropped(width, (left + right) * x), "height": _cropped(height, (top + bottom) * y), "bit_depth": depth & 255, "chroma": CHROMA.get(chroma, "?"), "profile": hevc_label(profile, high, level), "color": None, "fps": None}
    try:
        _hevc_tail(b, sublayers, out)
    except (Short, IndexError):
        pass
    return out


def hevc_config_sps(record: bytes) -> bytes | None:
    """The first sequence parameter set that a decoder configuration record embeds."""
    at = 23
    for _ in range(record[22] if len(record) > 22 else 0):
        if at + 3 > len(record):
            return None
        kind, count = record[at] & 63, big(record, at + 1, 2)
        at += 3
        for _ in range(count):
            n = big(record, at, 2)
            unit = record[at + 2 : at + 2 + n]
            if at + 2 > len(record) or len(unit) < n:
                return None
            if kind == 33 and n:
                return unit
            at += 2 + n
    return None


@attempt
def hevc_config(record: bytes) -> dict | None:
    """Depth and chroma (the embedded set outranks the summary), length of unit lengths, label, and the set's facts."""
    if len(record) < 22:
        return None
    sps = hevc_sps(hevc_config_sps(record) or b"")
    out = {"bit_depth": (record[17] & 7) + 8, "chroma": CHROMA[record[16] & 3]}
    if sps:
        out = {k: sps[k] for k in out}
    return out | {"nal_length": (record[21] & 3) + 1, "profile": hevc_label(record[1] & 31, bool(record[1] >> 5 & 1), record[12]), "sps": sps}


# ---- AVC


@attempt
def avc_sps(nal: bytes) -> dict | None:
    if len(nal) < 2:
        return None
    b = Bits(rbsp(nal[1:]))
    profile, sets, level = b.u(8), b.u(8), b.u(8)
    b.ue()
    chroma, depth, planes = 1, 8, False
    if profile in AVC_WITH_CHROMA:
        chroma = b.ue()
        planes = chroma == 3 and b.flag()
        depth = b.ue() + 8
        b.ue()
        b.skip(1)
        if b.flag():
            for i in range(12 if chroma == 3 else 8):
                if b.flag():
                    last = following = 8
                    for _ in range(16 if i < 6 else 64):
                        if following:
                            following = (last + b.se() + 256) % 256
                        last = following or last
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.skip(1)
        b.se(), b.se()
        n = b.ue()
        if n > 256:
            return None
        for _ in range(n):
            b.se()
    b.ue()
    b.skip(1)
    across, down = b.ue() + 1, b.ue() + 1
    fields = 1 if b.flag() else 2
    b.skip(fields)  # the frame-field switch, where there is one, and direct inference
    left, right, top, bottom = (b.ue(), b.ue(), b.ue(), b.ue()) if b.flag() else (0, 0, 0, 0)
    x, y = {1: (2, 2), 2: (2, 1)}.get(0 if planes else chroma, (1, 1))
    out = {"width": _cropped(across * 16, (left + right) * x), "height": _cropped(fields * down * 16, (top + bottom) * y * fields), "bit_depth": depth & 255, "chroma": CHROMA.get(chroma, "?"), "profile": avc_label(profile, level, bool(sets & 8), bool(sets & 4)), "color": None, "fps": None}
    try:
        if b.flag():
            out |= _usability(b)
            if b.flag():
                tick, scale = b.u(32), b.u(32)
                if tick and scale:
                    out["fps"] = scale / (2 * tick)
    except Short:
        pass
    return out


def avc_config_sps(record: bytes) -> bytes | None:
    at = 6
    for _ in range(record[5] & 31 if len(record) > 5 else 0):
        n = big(record, at, 2)
        unit = record[at + 2 : at + 2 + n]
        if at + 2 > len(record) or len(unit) < n:
            return None
        if n and unit[0] & 31 == 7:
            return unit
        at += 2 + n
    return None


@attempt
def avc_config(record: bytes) -> dict | None:
    sps = avc_sps(avc_config_sps(record) or b"")
    return sps and {k: sps[k] for k in ("bit_depth", "chroma", "profile")} | {"nal_length": (record[4] & 3) + 1, "sps": sps}


# ---- AV1


def _av1_points(b: Bits, out: dict) -> None:
    """Timing and operating points of a full sequence header."""
    delay = 0
    if b.flag():
        tick, scale = b.u(32), b.u(32)
        if b.flag():
            span = tick * (b.uvlc() + 1)
            rate = scale / span if span else 0
            out["fps"] = rate if 0 < rate <= 480 else None
        if b.flag():
            delay = b.u(5) + 1
            b.skip(42)
    shown = b.flag()
    for i in range(b.u(5) + 1):
        b.skip(12)
        level = b.u(5)
        tier = b.u(1) if level > 7 else 0
        if i == 0:
            out["level"], out["tier"] = level, tier
        if delay and b.flag():
            b.skip(2 * delay + 1)
        if shown and b.flag():
            b.skip(4)


@attempt
def av1_sequence(payload: bytes) -> dict | None:
    b = Bits(payload)
    profile, _, reduced = b.u(3), b.flag(), b.flag()
    out = {"fps": None, "tier": 0}
    if reduced:
        out["level"] = b.u(5)
    else:
        _av1_points(b, out)
    across, down = b.u(4) + 1, b.u(4) + 1
    out["width"], out["height"] = b.u(across) + 1, b.u(down) + 1
    if not reduced and b.flag():
        b.skip(7)
    b.skip(3)
    if not reduced:
        b.skip(4)
        order = b.flag()
        b.skip(2 * order)
        if b.flag() or b.flag():
            b.skip(not b.flag())
        b.skip(3 * order)
    b.skip(3)
    deep = b.flag()
    depth = (12 if b.flag() else 10) if profile == 2 and deep else 10 if deep else 8
    mono = profile != 1 and b.flag()
    described = b.flag()
    cp, tc, mc = (b.u(8), b.u(8), b.u(8)) if described else (2, 2, 2)
    if mono:
        full, x, y = b.flag(), 1, 1
    elif (cp, tc, mc) == (1, 13, 0):
        full, x, y = True, 0, 0
    else:
        full = b.flag()
        x, y = {0: (1, 1), 1: (0, 0)}.get(profile, (1, 0))
        if profile > 1 and depth == 12:
            x = b.u(1)
            y = b.u(1) if x else 0
        b.skip(2 * (x and y))
    return {k: out[k] for k in ("width", "height", "fps")} | {"bit_depth": depth, "chroma": av1_chroma(mono, x, y), "profile": av1_label(profile, out["tier"], out["level"]), "color": color(cp, tc, mc, full), "described": described}


def av1_stream_sequence(data: bytes) -> dict | None:
    """The first sequence header among the units of `data`."""
    return next((s for kind, _, a, z in obus(data) if kind == 1 and (s := av1_sequence(data[a:z]))), None)


@attempt
def av1_config(record: bytes) -> dict | None:
    if len(record) < 3:
        return None
    b = Bits(record[1:3])
    profile, level, tier, deep, twelve, mono, x, y = b.u(3), b.u(5), b.u(1), b.flag(), b.flag(), b.flag(), b.u(1), b.u(1)
    seq = av1_stream_sequence(record[4:])
    return {"bit_depth": 12 if twelve else 10 if deep else 8, "chroma": av1_chroma(mono, x, y), "profile": av1_label(profile, tier, level), "sps": seq and seq | {"color": seq["color"] if seq["described"] else None}}


# ---- VP9 and ProRes


@attempt
def vp9_frame(data: bytes) -> dict | None:
    """Facts of a key frame's header; other frames carry none."""
    b = Bits(data)
    if b.u(2) != 2:
        return None
    profile = b.u(1) + 2 * b.u(1)
    if profile == 3 and b.flag() or b.flag():
        return None
    inter = b.flag()
    b.skip(2)
    if inter or b.u(24) != 0x498342:
        return None
    depth = (12 if b.flag() else 10) if profile > 1 else 8
    space = b.u(3)
    odd = profile % 2 == 1
    if space == 7:
        if not odd or b.flag():
            return None
        chroma, full = "4:4:4", True
    else:
        full = b.flag()
        chroma = av1_chroma(False, b.u(1), b.u(1)) if odd else "4:2:0"
        if odd and b.flag():
            return None
    return {"profile": vp9_label(profile, None), "bit_depth": depth, "chroma": chroma, "color": color(None, None, VP9_MATRIX.get(space), full), "width": b.u(16) + 1, "height": b.u(16) + 1}


def vp9_private(data: bytes) -> dict:
    """Features of a WebM codec-private block: profile, level, depth, chroma, each where it is stated."""
    out, at = dict.fromkeys(("profile", "level", "bit_depth", "chroma")), 0
    while at + 2 <= len(data) and at + 2 + data[at + 1] <= len(data):
        if data[at + 1] == 1:
            value = data[at + 2]
            name = {1: "profile", 2: "level", 3: "bit_depth", 4: "chroma"}.get(data[at])
            if name == "chroma":
                value = {0: "4:2:0", 1: "4:2:0", 2: "4:2:2", 3: "4:4:4"}.get(value, "?")
            if name and (name != "level" or value):
                out[name] = value
        at += 2 + data[at + 1]
    return out


@attempt
def prores_frame(data: bytes) -> dict | None:
    body = data[8:] if data[4:8] == b"icpf" else data
    if len(body) < 20 or big(body, 0, 2) < 20 or not big(body, 8, 2) or not big(body, 10, 2):
        return None
    kind = {2: ("4:2:2", 10), 3: ("4:4:4", 12)}.get(body[12] >> 6)
    if not kind:
        return None
    alpha = kind[0] == "4:4:4" and body[17] & 15 in (1, 2)
    return {"chroma": kind[0] + ":4" * alpha, "bit_depth": kind[1], "color": color(body[14], body[15], body[16], None)}


# ---- Dolby Vision configuration


@attempt
def dv_config(record: bytes, descriptor: bool = False) -> dict | None:
    """Configuration record, or with `descriptor` the transport-stream form, which names the base's PID where the stream
    has no base layer. A compact record has no compatibility id, and then there is none."""
    if len(record) < 4:
        return None
    b = Bits(record[2:])
    out = {"profile": b.u(7), "level": b.u(6), "rpu_present": b.flag(), "el_present": b.flag(), "bl_present": b.flag(), "dependency_pid": None, "bl_compatibility_id": None}
    try:
        if descriptor and not out["bl_present"]:
            out["dependency_pid"] = b.u(13)
            b.skip(3)
        out["bl_compatibility_id"] = b.u(4)
    except Short:
        pass
    return out
