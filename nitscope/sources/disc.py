"""Blu-ray images: the UDF directory, playlists, and the main feature as one range of the image.

Everything read from the image is bounded: directories, extents and chains have limits, places outside it are an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from nitscope.functions.bits import big, little
from nitscope.sources import ts
from nitscope.sources.model import Unreadable

SECTOR = 2048
MAX_EXTENTS, MAX_ENTRIES, MAX_SMALL = 65_536, 16_384, 16 << 20
CLOCK = 45_000.0
TOLERANCE = 1.0


def _tag(b: bytes) -> int:
    return little(b, 0, 2)


@dataclass
class Volume:
    """Partition starts in sectors by reference; a metadata partition has its own list of (start, sectors)."""

    data: object
    partitions: list = field(default_factory=list)
    root: tuple[int, int] = (0, 0)

    def sector(self, n: int, count: int = 1) -> bytes:
        if n < 0 or (n + count) * SECTOR > len(self.data):
            raise Unreadable("the image ends before its directory does")
        return bytes(self.data[n * SECTOR : (n + count) * SECTOR])

    def place(self, ref: int, block: int) -> int:
        """Sector in the image of a block of a partition: metadata blocks lie in the first extent that holds them."""
        if ref >= len(self.partitions):
            raise Unreadable("no such partition")
        p = self.partitions[ref]
        if isinstance(p, int):
            return p + block
        for start, n in p:
            if block < n:
                return start + block
            block -= n
        raise Unreadable("block beyond the metadata file")

    def entry(self, ref: int, block: int) -> dict:
        """Size and recorded extents (place in bytes, length) of a file entry, or its embedded bytes."""
        here = self.place(ref, block)
        b = self.sector(here)
        head = {261: (168, 176), 266: (208, 216)}.get(_tag(b))
        if not head:
            raise Unreadable("no file entry")
        at, n = head[1] + little(b, head[0], 4), little(b, head[0] + 4, 4)
        size, form = little(b, 56, 8), little(b, 34, 2) & 7
        if form == 3:
            return {"size": size, "inline": b[at : at + min(n, size)], "extents": [(here * SECTOR + at, min(n, size))]}
        width, raw, extents, seen = {0: 8, 1: 16}.get(form, 0), b[at : at + n], [], 0
        if not width:
            raise Unreadable("unknown allocation")
        i = 0
        while i + width <= len(raw) and len(extents) < MAX_EXTENTS:
            word, block = little(raw, i, 4), little(raw, i + 4, 4)
            kind, length = word >> 30, word & (1 << 30) - 1
            part = little(raw, i + 8, 2) if width == 16 else ref
            i += width
            if not length:
                break
            if kind == 3:  # the list goes on in another place
                seen += 1
                more = self.sector(self.place(part, block))
                if seen > 256 or _tag(more) != 258:
                    break
                raw, i = more[24 : 24 + little(more, 20, 4)], 0
                continue
            if kind == 0:
                extents.append((self.place(part, block) * SECTOR, length))
        left, cut = size, []
        for a, n in extents:
            cut.append((a, min(n, left)))
            left -= min(n, left)
        return {"size": size, "inline": None, "extents": [e for e in cut if e[1]]}

    def small(self, e: dict) -> bytes:
        if e["inline"] is not None:
            return e["inline"]
        if e["size"] > MAX_SMALL:
            raise Unreadable("file too large to be read whole")
        return b"".join(bytes(self.data[a : a + n]) for a, n in e["extents"])

    def listing(self, icb: tuple[int, int]) -> dict[str, tuple[bool, tuple[int, int]]]:
        """name: (is a directory, place of its entry)."""
        raw, out, at = self.small(self.entry(*icb)), {}, 0
        while at + 38 <= len(raw) and len(out) < MAX_ENTRIES and _tag(raw[at:]) == 257:
            flags, n, extra = raw[at + 18], raw[at + 19], little(raw, at + 36, 2)
            name = raw[at + 38 + extra : at + 38 + extra + n]
            if n > 1 and not flags & 0x0C:
                text = name[1:].decode("utf-16-be", "replace") if name[0] == 16 else name[1:].decode("latin-1")
                out[text] = (bool(flags & 2), (little(raw, at + 28, 2), little(raw, at + 24, 4)))
            at += (38 + extra + n + 3) // 4 * 4
        return out

    def directory(self, *path: str) -> dict:
        here = self.root
        for name in path:
            found = next((v for k, v in self.listing(here).items() if k.upper() == name and v[0]), None)
            if not found:
                raise Unreadable(f"no directory {name}")
            here = found[1]
        return self.listing(here)


def is_image(data) -> bool:
    return len(data) > 257 * SECTOR and _tag(bytes(data[256 * SECTOR : 256 * SECTOR + 16])) == 2


def open_volume(data) -> Volume:
    v = Volume(data)
    anchor = v.sector(256)
    if _tag(anchor) != 2:
        raise Unreadable("no anchor")
    starts, volume = {}, b""
    at = little(anchor, 20, 4)
    for n in range(at, at + min(little(anchor, 16, 4) // SECTOR, 64)):
        b = v.sector(n)
        if _tag(b) == 5:
            starts[little(b, 22, 2)] = little(b, 188, 4)
        elif _tag(b) == 6:
            volume = b
        elif _tag(b) == 8:
            break
    if not volume or not starts:
        raise Unreadable("no logical volume")
    i, metadata = 440, []
    for k in range(min(little(volume, 268, 4), 8)):
        kind, n = volume[i], volume[i + 1]
        number = little(volume, i + (38 if kind == 2 else 4), 2)
        if number not in starts:
            raise Unreadable("partition map without a partition")
        v.partitions.append(starts[number])
        if kind == 2 and b"*UDF Metadata Partition" in volume[i : i + n]:
            metadata.append((k, starts[number], little(volume, i + 40, 4)))
        i += max(n, 1)
    for k, start, block in metadata:
        flat = Volume(data, [start])
        v.partitions[k] = [(a // SECTOR, -(-n // SECTOR)) for a, n in flat.entry(0, block)["extents"]]
    b = v.sector(v.place(little(volume, 256, 2), little(volume, 252, 4)))
    if _tag(b) != 256:
        raise Unreadable("no file set")
    v.root = (little(b, 408, 2), little(b, 404, 4))
    return v


def playlist(raw: bytes) -> list[tuple[str, int, int]]:
    """(clip, in, out) of each item, in 45 kHz ticks; a damaged tail keeps what came before it."""
    if raw[:4] != b"MPLS" or raw[4:8] not in (b"0100", b"0200", b"0300"):
        raise Unreadable("not a playlist")
    at = big(raw, 8, 4)
    count, at, items = big(raw, at + 6, 2), at + 10, []
    for _ in range(count):
        n = big(raw, at, 2)
        if n < 20 or at + 2 + n > len(raw) or raw[at + 7 : at + 11] != b"M2TS":
            break
        items.append((raw[at + 2 : at + 7].decode("latin-1"), big(raw, at + 14, 4), big(raw, at + 18, 4)))
        at += 2 + n
    return items


def seconds(items: list[tuple[str, int, int]]) -> float:
    """Duration of the different items: a looped one counts once."""
    return sum(max(b - a, 0) for _, a, b in dict.fromkeys(items)) / CLOCK


def select(found: dict[str, list[tuple[str, int, int]]], sizes: dict[str, int]) -> tuple[str, str, int, int]:
    """(playlist, clip, its number, number of clips) of the main feature. Playlists with a missing clip or the items of
    an earlier one are out; in the order of names a later one wins by a second and more, else by bytes. Its clip is the
    largest, the first of equals."""
    best, used = None, set()
    for name in sorted(found):
        items = found[name]
        if not items or any(c not in sizes for c, _, _ in items) or tuple(items) in used:
            continue
        used.add(tuple(items))
        clips = list(dict.fromkeys(c for c, _, _ in items))
        row = (seconds(items), sum(sizes[c] for c in clips), name, clips)
        gap = row[0] - best[0] if best else 0
        if best is None or gap > TOLERANCE or abs(gap) <= TOLERANCE and row[1] > best[1]:
            best = row
    if not best:
        raise Unreadable("no playable playlist")
    clip = max(best[3], key=lambda c: (sizes[c], -best[3].index(c)))
    return best[2], clip, best[3].index(clip) + 1, len(best[3])


def main_feature(data) -> dict:
    """Where the main clip lies in the image, and what it was chosen by."""
    v = open_volume(data)
    lists = {k: e for k, (is_dir, e) in v.directory("BDMV", "PLAYLIST").items() if not is_dir and k.lower().endswith(".mpls")}
    clips = {k.rsplit(".", 1)[0]: v.entry(*e) for k, (is_dir, e) in v.directory("BDMV", "STREAM").items() if not is_dir and k.lower().endswith(".m2ts")}
    found = {}
    for name, e in lists.items():
        try:
            found[name] = playlist(v.small(v.entry(*e)))
        except Unreadable:
            continue
    name, clip, index, count = select(found, {k: e["size"] for k, e in clips.items()})
    extents = clips[clip]["extents"]
    if any(a + n != b for (a, n), (b, _) in zip(extents, extents[1:], strict=False)):
        raise Unreadable("the clip is not in one piece")
    start, end = extents[0][0], extents[-1][0] + extents[-1][1]
    if end > len(data) or not ts.layout(data[start : min(start + 4096, end)]):
        raise Unreadable("the clip is encrypted or not a transport stream")
    return {"start": start, "end": end, "bd_iso": {"playlist": name, "playlist_duration_secs": seconds(found[name]), "clip": f"{clip}.m2ts", "clip_index": index, "clip_count": count}}
