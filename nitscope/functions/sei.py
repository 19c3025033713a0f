"""Static and dynamic HDR messages: HEVC and AVC SEI units, AV1 metadata units, ITU-T T.35 payloads.

Findings are a dict with the keys of `EMPTY`. Within one SEI unit a later message of a kind replaces an earlier one;
between units, and everywhere in AV1, the first wins. HDR Vivid targets are a union, capped when merged.
"""

from __future__ import annotations

from nitscope.functions import luminance
from nitscope.functions.bits import Bits, Short, attempt, big, leb128, obus, rbsp

EMPTY = dict.fromkeys(("mastering", "content_light", "preferred_transfer", "hdr10plus", "sl_hdr", "hdr_vivid"))
#: SEI payload types.
MASTERING, LIGHT, TRANSFER, T35 = 137, 144, 147, 4
VIVID_TARGETS = 8


def gamut(red, green, blue, white) -> str | None:
    """Name of the gamut of four chromaticities; the primaries may stand in any order."""
    low, *rest = sorted((red, green, blue), key=lambda p: p[1])
    r, g = sorted(rest, key=lambda p: -p[0])
    for name, tr, tg, tb, tw in luminance.GAMUTS:
        if all(abs(p - t) < luminance.TOLERANCE for have, want in ((r, tr), (g, tg), (low, tb), (white, tw)) for p, t in zip(have, want, strict=True)):
            return name
    return None


def _points(p: bytes, unit: float) -> list[tuple[float, float]]:
    return [(big(p, i, 2) / unit, big(p, i + 2, 2) / unit) for i in range(0, 16, 4)]


def _display(top: float, low: float, primaries: str | None) -> dict:
    return {"max_luminance": top, "min_luminance": low, "primaries": primaries, "primaries_level": None}


def mastering(p: bytes) -> dict | None:
    """ST 2086 message: green, blue, red, white in units of 1/50000, luminance in 1/10000."""
    if len(p) < 24:
        return None
    g, b, r, w = _points(p, 50000.0)
    return _display(big(p, 16, 4) / 10000.0, big(p, 20, 4) / 10000.0, gamut(r, g, b, w))


def _fourth(x: float) -> float:
    """Rounded to four decimals, halves up."""
    return int(x * 10000 + 0.5) / 10000


def mastering_av1(p: bytes) -> dict | None:
    """AV1's form: red, green, blue, white in 1/65536, luminance in 1/256 and 1/16384."""
    if len(p) < 24:
        return None
    r, g, b, w = _points(p, 65536.0)
    return _display(_fourth(big(p, 16, 4) / 256), _fourth(big(p, 20, 4) / 16384), gamut(r, g, b, w))


def content_light(p: bytes) -> dict | None:
    if len(p) < 4:
        return None
    cll, fall = big(p, 0, 2), big(p, 2, 2)
    return {"max_cll": cll, "max_fall": fall, "zeroed": (cll == fall == 0) or None}


def _grid(b: Bits) -> None:
    """An optional grid of 4-bit peak luminances."""
    if b.flag():
        rows, columns = b.u(5), b.u(5)
        b.skip(4 * rows * columns)


@attempt
def hdr10plus(p: bytes) -> dict | None:
    """SMPTE ST 2094-40: versions, windows, target, and the profile where curve and target agree on one."""
    if p[:5] != b"\xb5\x00\x3c\x00\x01":
        return None
    b = Bits(p[5:])
    b.skip(8)
    version, windows = b.u(8), b.u(2)
    if not 1 <= windows <= 3:
        return None
    b.skip((windows - 1) * (8 * 16 + 8 + 3 * 16 + 1 - 32))
    target = b.u(27)
    _grid(b)
    for _ in range(windows):
        b.skip(4 * 17)
        b.skip(24 * b.u(4))
        b.skip(10)
    _grid(b)
    curved = False
    for _ in range(windows):
        if b.flag():
            curved = True
            b.skip(24)
            b.skip(10 * b.u(4))
        if b.flag():
            b.skip(6)
    profile = "B" if curved and target else "A" if not curved and not target else None
    return {"application_version": version, "num_windows": windows, "profile": profile, "target_max_luminance": target}


def sl_hdr(p: bytes) -> dict | None:
    """ETSI TS 103 433: mode, versions; payload mode, target and source display as far as present."""
    if len(p) < 6 or p[:4] != b"\xb5\x00\x3a\x00" or p[4] >> 4 > 2:
        return None
    out = {"mode": (p[4] >> 4) + 1, "spec_version": f"{p[4] & 15}.{p[5] >> 1}", "payload_mode": None, "target_primaries": None, "target_max_luminance": None, "source_mastering": None}
    if p[5] & 1 or len(p) < 7:
        return out
    flags, at = p[6], 7 + 5 * bool(p[6] & 0x40)
    out["payload_mode"] = flags & 7
    if flags & 0x20:
        if at + 5 <= len(p):
            out |= {"target_primaries": p[at], "target_max_luminance": big(p, at + 1, 2)}
        at += 5
    if flags & 0x10 and at + 20 <= len(p) and big(p, at + 16, 2):
        g, b, r, w = _points(p[at:], 50000.0)
        out["source_mastering"] = _display(float(big(p, at + 16, 2)), big(p, at + 18, 2) / 10000.0, gamut(r, g, b, w))
    return out


def hdr_vivid(p: bytes) -> dict | None:
    """CUVA HDR: version, start code, and the different target codes up to where the data ends."""
    if len(p) < 6 or p[:4] != b"\x26\x00\x04\x00" or not 5 <= p[4] <= 8 or not 1 <= p[5] <= 7:
        return None
    targets: list[int] = []
    b = Bits(p[6:])
    try:
        b.skip(48)
        for _ in range(b.u(1) + 1 if b.flag() else 0):
            code = b.u(12)
            targets += [code] * (code not in targets)
            b.skip(64 * b.u(1))
            for _ in range(b.u(1) + 1 if b.flag() else 0):
                b.skip(40 + 8 * (b.u(2) in (0, 2)))
    except Short:
        pass
    return {"version": p[4] - 4, "system_start_code": p[5], "target_pq": targets}


def union_vivid(first: dict | None, other: dict | None) -> dict | None:
    if not first or not other:
        return first or other
    have = list(first["target_pq"])
    have += [t for t in dict.fromkeys(other["target_pq"]) if t not in have][: max(VIVID_TARGETS - len(have), 0)]
    return first | {"target_pq": have}


def merge(first: dict, other: dict) -> dict:
    """Findings of two units in order."""
    out = {k: first[k] if first[k] is not None else other[k] for k in EMPTY}
    return out | {"hdr_vivid": union_vivid(first["hdr_vivid"], other["hdr_vivid"])}


def _number(d: bytes, at: int) -> tuple[int, int]:
    """A sum of bytes up to and with the first that is not 255."""
    total = 0
    while True:
        if at >= len(d):
            raise Short
        total, at = total + d[at], at + 1
        if d[at - 1] != 255:
            return total, at


def unit(nal: bytes, header: int = 2) -> dict:
    """Findings of one SEI unit with a header of two bytes (HEVC) or one (AVC)."""
    out = dict(EMPTY)
    d, at = rbsp(nal[header:]), 0
    while at < len(d) and d[at] != 0x80:
        try:
            kind, at = _number(d, at)
            n, at = _number(d, at)
        except Short:
            break
        p, at = d[at : at + n], at + n
        if at > len(d):
            break
        if kind == MASTERING:
            out["mastering"] = mastering(p) or out["mastering"]
        elif kind == LIGHT:
            out["content_light"] = content_light(p) or out["content_light"]
        elif kind == TRANSFER and p:
            out["preferred_transfer"] = p[0]
        elif kind == T35:
            for name, parse in (("hdr10plus", hdr10plus), ("sl_hdr", sl_hdr), ("hdr_vivid", hdr_vivid)):
                if (info := parse(p)) is not None:
                    out[name] = union_vivid(out[name], info) if name == "hdr_vivid" else info
                    break
    return out


def av1_unit(data: bytes) -> tuple[dict, list[bytes]]:
    """Findings of the metadata units of one temporal unit, and the T.35 payloads that carry an RPU."""
    out, rpus = dict(EMPTY), []
    for kind, _, a, z in obus(data):
        if kind != 5:
            continue
        try:
            what, at = leb128(data[a:z], 0)
        except Short:
            continue
        body = data[a + at : z]
        new = dict(EMPTY)
        if what == 1:
            new["content_light"] = content_light(body)
        elif what == 2:
            new["mastering"] = mastering_av1(body)
        elif what == 4 and len(body) >= 3:
            new["hdr_vivid"] = hdr_vivid(body)
            if body[:3] == b"\xb5\x00\x3b":
                rpus.append(body)
            elif body[:3] == b"\xb5\x00\x3c":
                new["hdr10plus"] = hdr10plus(body)
        out = merge(out, new)
    return out, rpus
