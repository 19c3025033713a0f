"""Dolby Vision RPU payloads, after ETSI GS CCM 001: header, composing data, display management and its level blocks.

`parse` gives a dict, or None where the payload, its checksum or its structure is wrong: facts are correct or absent.
"""

from __future__ import annotations

import hashlib
import zlib

from nitscope.functions.bits import Bits, Short, attempt, rbsp

PREFIX = 0x19
#: Levels whose blocks make up a frame's metadata for comparison with its neighbours; scene flag and composing data do not.
COMPARED = (1, 2, 3, 5, 6, 8, 9, 10, 11, 254, 255)
CENSUS = (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 254)


#: Each byte with its bits in reverse.
MIRRORED = bytes(int(f"{n:08b}"[::-1], 2) for n in range(256))


def crc32_mpeg(data: bytes) -> int:
    """The usual CRC-32 takes bits from the other end and is inverted at its end."""
    c = zlib.crc32(data.translate(MIRRORED)) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(MIRRORED), "big")


class _Reader(Bits):
    """Coefficients come whole and fractional, or as 32 raw bits, by the header's type."""

    kind = fraction = 0

    def coefficient(self, signed: bool) -> tuple[int, int]:
        whole = (self.se() if signed else self.ue()) if self.kind == 0 else 0
        return whole, self.u(self.fraction if self.kind == 0 else 32)


def _header(b: _Reader) -> dict:
    kind, form = b.u(6), b.u(11)
    h = {"rpu_type": kind, "rpu_format": form, "rpu_profile": b.u(4), "rpu_level": b.u(4), "has_sequence": b.flag(), "plain": form & 0x700 == 0}
    if kind != 2:
        raise Short
    h |= {"full_range": False, "bl_depth": 8, "el_depth": 8, "vdr_depth": 8, "el_resampled": False, "no_residual": True}
    if h["has_sequence"]:
        b.skip(1)
        b.kind = b.u(2)
        if b.kind == 0:
            b.fraction = b.ue()
        b.skip(2)
        h["full_range"] = b.flag()
        if h["plain"]:
            h["bl_depth"], h["el_depth"], h["vdr_depth"] = b.ue() + 8, (b.ue() & 255) + 8, b.ue() + 8
            b.skip(4)
            h["el_resampled"], h["no_residual"] = b.flag(), b.flag()
    h["has_dm"], h["reuses"] = b.flag(), b.flag()
    if max(h["bl_depth"], h["el_depth"], h["vdr_depth"]) > 16 or b.fraction > 32:
        raise Short
    return h


def _composing(b: _Reader, h: dict) -> str | None:
    """Reads the mapping curves and the residual quantizer; FEL or MEL where there is one."""
    if h["reuses"]:
        b.ue()
        return None
    b.ue(), b.ue(), b.ue()
    pieces = []
    for _ in range(3):
        n = b.ue() + 2
        if n > 16:
            raise Short
        b.skip(n * h["bl_depth"])
        pieces.append(n - 1)
    quantized = h["plain"] and not h["no_residual"]
    method = 0
    if quantized:
        method = b.u(3)
        b.skip(2 * h["bl_depth"])
    b.ue(), b.ue()
    for n in pieces:
        for _ in range(n):
            if b.ue() == 0:
                order = b.ue() + 1
                if order > 2:
                    raise Short
                if order == 1 and b.flag():
                    raise Short  # linear interpolation is reserved
                for _ in range(order + 1):
                    b.coefficient(True)
            else:
                for _ in range(1 + 7 * (b.u(2) + 1)):
                    b.coefficient(True)
    if not quantized:
        return None
    empty = True
    for _ in range(3):
        offset, top = b.u(h["el_depth"]), b.coefficient(False)
        slope, threshold = (b.coefficient(False), b.coefficient(False)) if method == 0 else ((0, 0), (0, 0))
        empty &= offset == 0 and top == (1, 0) and slope == (0, 0) and threshold == (0, 0)
    return "MEL" if empty else "FEL"


def _fields(level: int, length: int, raw: bytes) -> dict:
    """Named values of the levels that reports use."""
    b, out = Bits(raw), {}
    names = {2: (("target_max_pq", 12),), 5: (("left", 13), ("right", 13), ("top", 13), ("bottom", 13)), 6: (("max_mastering", 16), ("min_mastering", 16), ("max_cll", 16), ("max_fall", 16)), 8: (("index", 8),), 9: (("primary", 8),), 10: (("index", 8), ("target_max_pq", 12)), 11: (("content", 8), ("white", 8)), 254: (("mode", 8), ("version", 8))}.get(level, ())
    for name, n in names:
        out[name] = b.u(n)
    if level == 9 and length > 1:
        out["custom"] = [b.u(16) for _ in range(8)]
    if level == 11:
        out["reference"] = out["white"] > 15
        out["white"] &= 15
    return out


def _blocks(b: Bits) -> list[dict]:
    out = []
    count = b.ue()
    if count > 254:
        raise Short
    b.skip(-b.at % 8 if count else 0)
    for _ in range(count):
        length, level = b.ue(), b.u(8)
        if length * 8 > b.end - b.at:
            raise Short
        raw = b.u(8 * length).to_bytes(length, "big") if length else b""
        out.append({"level": level, "raw": raw} | _fields(level, length, raw))
    return out


def _management(b: Bits) -> dict:
    b.ue(), b.ue()
    dm = {"scene_refresh": b.ue()}
    b.skip(9 * 16 + 3 * 32 + 9 * 16 + 3 * 16 + 32 + 5 + 2 + 2 + 2)
    dm["source_min_pq"], dm["source_max_pq"] = b.u(12), b.u(12)
    b.skip(10)
    dm["blocks"] = _blocks(b)
    b.skip(-b.at % 8)
    if b.end - b.at >= 8 and b.data[b.at // 8] != 0:
        try:
            dm["blocks"] += _blocks(b)
        except Short:
            pass
    return dm


@attempt
def parse(payload: bytes) -> dict | None:
    """From the prefix byte to the trailing byte, without emulation prevention."""
    payload = payload.rstrip(b"\x00")
    if len(payload) < 25 or payload[0] != PREFIX or payload[-1] != 0x80:
        return None
    if crc32_mpeg(payload[1:-5]) != int.from_bytes(payload[-5:-1], "big"):
        return None
    b = _Reader(payload[1:-5])
    h = _header(b)
    el = _composing(b, h)
    dm = _management(b) if h["has_dm"] else None
    if h["rpu_profile"] == 0:
        profile = 5 if h["full_range"] else 0
    elif h["el_resampled"] and not h["no_residual"]:
        profile = 7 if h["vdr_depth"] == 12 else 4
    else:
        profile = 8
    return {"profile": profile, "el_type": el, "vdr_bit_depth": h["vdr_depth"] if h["has_sequence"] else None, "dm": dm}


def from_hevc(nal: bytes) -> dict | None:
    """A type-62 unit with its two-byte header, or without it."""
    body = nal[2:] if nal[:1] != bytes([PREFIX]) else nal
    return parse(rbsp(body))


def from_avc(nal: bytes) -> dict | None:
    """An unspecified unit whose first payload byte is the prefix."""
    return parse(rbsp(nal[1:])) if len(nal) > 1 and nal[1] == PREFIX else None


@attempt
def from_av1(t35: bytes) -> dict | None:
    """The RPU of a T.35 payload: an extensible metadata container (ETSI TS 103 572, annex A) around a sized payload."""
    if t35[:7] != b"\xb5\x00\x3b\x00\x00\x08\x00":
        return None
    b = Bits(t35[7:])

    def variable(n: int) -> int:
        value = b.u(n)
        while b.flag():
            value = (value + 1 << n) + b.u(n)
        return value

    b.skip(2 + 3)  # version and key
    if b.u(5) == 31:
        variable(5)
    if b.flag():  # sample offset
        b.skip(12)
    for width in (11, 2, 8):  # duration, group, reserved codec data
        if b.flag():
            variable(width) if width < 8 or width == 11 else b.skip(8)
    b.skip(1)
    size = variable(8)
    raw = bytes(b.u(8) for _ in range(size))
    return parse(raw if raw[:1] == bytes([PREFIX]) else bytes([PREFIX]) + raw)


def fingerprint(dm: dict | None) -> str | None:
    """Digest of a frame's metadata as far as neighbours are compared; None without any."""
    if dm is None:
        return None
    h = hashlib.sha256(f"{dm['source_min_pq']},{dm['source_max_pq']}".encode())
    for level in COMPARED:
        for x in dm["blocks"]:
            if x["level"] == level:
                h.update(bytes([level]) + len(x["raw"]).to_bytes(2, "big") + x["raw"])
    return h.hexdigest()
