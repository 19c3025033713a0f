"""Raw streams: HEVC with start codes, AV1 units, IVF files with AV1 or VP9."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

from nitscope.functions import bits, headers
from nitscope.functions.bits import little
from nitscope.sources.model import HEAD_BYTES, Unreadable, from_headers, media, standard_rate, track

LEADERS = frozenset((32, 33, 34, 35, 39, 62))
#: Bytes of an input that a walk over all of it holds.
WINDOW = 16 << 20


def start_codes(data, window: int) -> Iterator[int]:
    """Places of the codes 00 00 01, found window by window; windows share two bytes."""
    at = 0
    while at < len(data):
        part = bytes(data[at : at + window + 2])
        hit = part.find(b"\x00\x00\x01")
        while hit >= 0:
            yield at + hit
            hit = part.find(b"\x00\x00\x01", hit + 3)
        at += window


def spans(data, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """`bits.annexb` over an input of any size: (start, end) of the units, holding one window at a time."""
    begin = 0 if bytes(data[:3]) not in (b"\x00\x00\x01",) and bytes(data[:4]) != b"\x00\x00\x00\x01" else None
    for code in chain(start_codes(data, window), (len(data),)):
        if begin is not None:
            end = code
            while end > begin and not (tail := bytes(data[max(begin, end - 64) : end]).rstrip(b"\x00")):
                end = max(begin, end - 64)
            if end > begin:
                yield begin, max(begin, end - 64) + len(tail)
        begin = code + 3


def with_last(items: Iterable) -> Iterator[tuple]:
    """Each item, and whether it is the last."""
    end = object()
    for item, following in pairwise(chain(items, (end,))):
        yield item, following is end


def access_units(data, units: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(offset, size) of access units: one begins at the first unit, and where a picture or a leading kind follows when
    the last such unit was a picture."""
    out: list[list[int]] = []
    picture = False
    for start, end in units:
        kind = data[start] >> 1 & 63
        vcl, leads = kind < 32, kind in LEADERS
        if not out or picture and (vcl or leads):
            out.append([start, end])
        out[-1][1] = end
        if vcl or leads:
            picture = vcl
    return [(a, z - a) for a, z in out]


def hevc(data, full: bool = False) -> dict:
    """Units of the head, or with `full` of the whole input, which is read in windows; the first parameter set that can be
    read."""
    whole = full or len(data) <= HEAD_BYTES
    sps: tuple[dict, int] | None = None

    def noted() -> Iterator[tuple[int, int]]:
        nonlocal sps
        for (start, end), last in with_last(spans(data if whole else bytes(data[:HEAD_BYTES]))):
            if last and not whole:  # cut by the edge of the head
                return
            if sps is None and data[start] >> 1 & 63 == 33 and (found := headers.hevc_sps(bytes(data[start:end]))):
                sps = found, start
            yield start, end

    t = track("HEVC", units=access_units(data, noted()))
    if sps:
        from_headers(t, sps[0])
        t["pinned"] = next((i for i, (o, n) in enumerate(t["units"]) if o <= sps[1] < o + n), None)
    return media("raw HEVC (Annex-B)", [t])


def is_obu_stream(data) -> bool:
    return len(data) > 0 and data[0] & 0x81 == 0 and bool(data[0] & 2) and data[0] >> 3 & 15 in (1, 2)


def unit_heads(data, end: int) -> Iterator[tuple[int, int]]:
    """(kind, start) of AV1 units up to `end`, of which only the heads are read; a unit that overruns ends the walk."""
    at = 0
    while at < end:
        kind, _, body, stop = next(bits.obus(bytes(data[at : at + 16])), (None, 0, 0, 0))
        head = bytes(data[at : at + 16])
        if kind is None:  # its size reaches beyond what was read, or it is none
            if not head or head[0] & 0x80:
                return
            kind, body = head[0] >> 3 & 15, 1 + bool(head[0] & 4)
            if head[0] & 2:
                try:
                    size, body = bits.leb128(head, body)
                except bits.Short:
                    return
            else:
                size = end - at - body
            stop = body + size
        elif not head[0] & 2:
            stop = end - at
        if at + stop > end:
            return
        yield kind, at
        at += stop


def temporal_units(data, end: int | None = None) -> tuple[list[tuple[int, int]], int | None]:
    """(offset, size) from delimiter to delimiter, the last to the end, and their number; without any, all is one."""
    end = len(data) if end is None else end
    starts = [a for kind, a in unit_heads(data, end) if kind == 2]
    if not starts:
        return [(0, end)], None
    return [(a, z - a) for a, z in zip(starts, [*starts[1:], end], strict=True)], len(starts)


def obu(data, full: bool = False) -> dict:
    whole = full or len(data) <= HEAD_BYTES
    units, count = temporal_units(data, len(data) if whole else HEAD_BYTES)
    t = from_headers(track("AV1", units=units), headers.av1_stream_sequence(bytes(data[:HEAD_BYTES])))
    return media("raw AV1 (OBU)", [t], count / t["fps"] if whole and count and t["fps"] else None)


def ivf(data, full: bool = False) -> dict:
    if len(data) < 32:
        raise Unreadable("truncated IVF header")
    head = bytes(data[:32])
    kind = head[8:12]
    if kind == b"VP80":
        raise Unreadable("VP8 in IVF is not supported")
    limit = len(data) if full else min(HEAD_BYTES, len(data))
    at, stamps, units = max(little(head, 6, 2), 32), [], []
    while at + 12 <= len(data) and at < limit:
        n, stamp = little(bytes(data[at : at + 12]), 0, 4), int.from_bytes(data[at + 4 : at + 12], "little")
        if at + 12 + n > len(data):
            break
        units.append((at + 12, n))
        stamps.append(stamp)
        at += 12 + n
    span = max(stamps[-1] - stamps[0], 0) if stamps else 0
    rate = little(head, 16, 4) / max(little(head, 20, 4), 1) * (len(units) - 1) / span if len(units) > 1 and span else 0
    fps = standard_rate(rate) if 0 < rate <= 480 else None
    count = len(units) if limit == len(data) else little(head, 24, 4)
    t = track("VP9" if kind == b"VP90" else "AV1", units=units, width=little(head, 12, 2), height=little(head, 14, 2), fps=fps)
    parse = headers.vp9_frame if kind == b"VP90" else headers.av1_stream_sequence
    looked = units[:32] if kind == b"VP90" else units
    info = next((i for o, n in looked if (i := parse(bytes(data[o : o + n])))), None)
    if info:
        from_headers(t, {k: v for k, v in info.items() if k != "fps" and (kind == b"VP90" or k not in ("width", "height"))})
    return media(f"raw {t['codec']} (IVF)", [t], count / fps if count and fps else None)
