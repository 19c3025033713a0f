"""Small media files put together from a few numbers, after the formats' published definitions: what the queries over
files read back. Every function gives bytes that differ with its arguments, so that a parser can't guess them."""

from __future__ import annotations

import struct

from nitscope.sources import mkv as ebml

START = b"\x00\x00\x00\x01"
PICTURE, PARAMETERS = b"\x26\x01\xaf\x11", b"\x40\x01\x0c"


class Bits:
    """Writes bit fields, most significant bit first."""

    def __init__(self, *fields: tuple[int, int]):
        self.text = ""
        self.u(*fields)

    def u(self, *fields: tuple[int, int]) -> Bits:
        """(width, value) of each field."""
        self.text += "".join(format(v, f"0{n}b") for n, v in fields if n)
        return self

    def ue(self, *values: int) -> Bits:
        for v in values:
            code = format(v + 1, "b")
            self.text += "0" * (len(code) - 1) + code
        return self

    def se(self, *values: int) -> Bits:
        return self.ue(*(2 * v - 1 if v > 0 else -2 * v for v in values))

    def aligned(self) -> Bits:
        self.text += "0" * (-len(self.text) % 8)
        return self

    def bytes(self) -> bytes:
        text = self.text + "0" * (-len(self.text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""

    def stopped(self) -> bytes:
        """With the stop bit behind it."""
        return Bits().u(*((1, int(c)) for c in self.text), (1, 1)).bytes()


def number(n: int, *values: int) -> bytes:
    return b"".join(v.to_bytes(n, "big") for v in values)


def guarded(data: bytes) -> bytes:
    """With emulation prevention: no two zeros are followed by 0 to 3."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = (zeros + 1) * (b == 0)
    return bytes(out)


# ---- parameter sets


def hevc_sps(width: int, height: int, depth: int = 10, code: tuple[int, int, int] = (9, 16, 9), fps: tuple[int, int] = (24, 1)) -> bytes:
    b = Bits((4, 0), (3, 0), (1, 1), (2, 0), (1, 1), (5, 2), (32, 0x20000000), (48, 0), (8, 153))
    b.ue(0, 1, width, height).u((1, 0)).ue(depth - 8, depth - 8, 4).u((1, 0)).ue(4, 2, 0, 0, 3, 0, 3, 1, 1).u((1, 0), (2, 3), (1, 0)).ue(0).u((1, 0), (2, 3), (1, 1))
    b.u((1, 0), (1, 0), (1, 1), (3, 5), (1, 0), (1, 1), *((8, c) for c in code), (1, 0), (3, 0), (1, 0), (1, 1), (32, fps[1]), (32, fps[0]))
    return b"\x42\x01" + guarded(b.stopped())


def avc_sps(columns: int, rows: int, level: int = 40, fps: int = 24) -> bytes:
    """`columns` and `rows` of 16 pixels."""
    b = Bits((8, 100), (8, 0), (8, level)).ue(0, 1, 0, 0).u((1, 0), (1, 0)).ue(0, 0, 2, 4).u((1, 0)).ue(columns - 1, rows - 1).u((1, 1), (1, 1), (1, 0), (1, 1))
    b.u((1, 0), (1, 0), (1, 1), (3, 5), (1, 0), (1, 1), (8, 1), (8, 1), (8, 1), (1, 0), (1, 1), (32, 1), (32, 2 * fps))
    return b"\x67" + guarded(b.stopped())


def av1_sequence(width: int, height: int, level: int = 13, fps: int = 25, transfer: int = 16) -> bytes:
    b = Bits((3, 0), (1, 0), (1, 0), (1, 1), (32, 1), (32, fps), (1, 1)).ue(0).u((1, 0), (1, 0), (5, 0), (12, 0), (5, level), (1, 0))
    b.u((4, 15), (4, 15), (16, width - 1), (16, height - 1), (1, 0), (3, 0), (4, 0), (1, 1), (2, 0), (1, 1), (1, 1), (3, 6), (3, 0))
    return b.u((1, 1), (1, 0), (1, 1), (8, 9), (8, transfer), (8, 9), (1, 0), (2, 0)).stopped()


def vp9_key_frame(width: int, height: int, profile: int = 2, space: int = 5) -> bytes:
    """Profiles 0 and 2."""
    b = Bits((2, 2), (1, profile & 1), (1, profile >> 1), (1, 0), (1, 0), (2, 2), (24, 0x498342))
    return b.u(*[(1, 0)] * (profile > 1), (3, space), (1, 0), (16, width - 1), (16, height - 1)).stopped()


def dv_record(profile: int, level: int, el: bool = False, bl: bool = True, compat: int = 1, base_pid: int | None = None) -> bytes:
    dependency = [(13, base_pid), (3, 7)] if base_pid is not None else []
    return bytes([1, 0]) + Bits((7, profile), (6, level), (1, 1), (1, el), (1, bl), *dependency, (4, compat), (4, 0)).bytes()


def light(cll: int, fall: int) -> bytes:
    """An SEI unit with content light levels."""
    return b"\x4e\x01" + guarded(bytes([144, 4]) + number(2, cll, fall) + b"\x80")


def rpu(low: int, high: int, scene: int = 0, peak: int = 1000, el: str | None = None, sound: bool = True) -> bytes:
    """A payload with identity curves and a level 6 block; `el` FEL or MEL gives it a residual quantizer."""
    residual = el is not None
    b = Bits((6, 2), (11, 18), (4, 1), (4, 0), (1, 1), (1, 0), (2, 0)).ue(23).u((2, 1), (1, 0)).ue(2, 2, 4).u((1, 0), (3, 0), (1, residual), (1, not residual), (1, 1), (1, 0)).ue(0, 0, 0)
    for _ in range(3):
        b.ue(0).u((10, 0), (10, 1023))
    if residual:
        b.u((3, 0), (10, 0), (10, 1023))
    b.ue(0, 0)
    for _ in range(3):
        b.ue(0, 0).u((1, 0)).se(0).u((23, 0)).se(1).u((23, 0))
    for _ in range(3 if residual else 0):
        b.u((10, 0)).ue(1).u((23, 0)).ue(0).u((23, 5 if el == "FEL" else 0)).ue(0).u((23, 0))
    b.ue(0, 0, scene).u((144, 0), (96, 0), (144, 0), (48, 0), (32, 0), (5, 12), (2, 0), (2, 0), (2, 1), (12, low), (12, high), (10, 42))
    b.ue(1).aligned().ue(8).u((8, 6), (16, peak), (16, 50), (16, peak // 2), (16, 100)).aligned().ue(0).aligned()
    body = b.bytes()
    check = 0xFFFFFFFF
    for byte in body:
        check ^= byte << 24
        for _ in range(8):
            check = (check << 1 ^ 0x04C11DB7 * (check >> 31)) & 0xFFFFFFFF
    return b"\x19" + body + number(4, check ^ (not sound)) + b"\x80"


def rpu_unit(payload: bytes) -> bytes:
    return b"\x7c\x01" + guarded(payload)


def hvcc(sps: bytes, depth: int = 10) -> bytes:
    head = bytes([1, 0x22]) + bytes(10) + bytes([153]) + bytes(3) + bytes([0xFD, 0xF8 | depth - 8]) + bytes(3)
    return head + bytes([3, 1, 0xA1]) + number(2, 1, len(sps)) + sps


def avcc(sps: bytes) -> bytes:
    return bytes([1, 100, 0, sps[3], 0xFF, 0xE1]) + number(2, len(sps)) + sps + bytes([0])


def av1c(sequence: bytes, level: int) -> bytes:
    return bytes([0x81, level, 0x4C, 0]) + obu(1, sequence)


# ---- units


def with_codes(*units: bytes) -> bytes:
    return b"".join(START + u for u in units)


def with_sizes(*units: bytes) -> bytes:
    return b"".join(number(4, len(u)) + u for u in units)


def obu(kind: int, payload: bytes) -> bytes:
    return bytes([kind << 3 | 2, len(payload)]) + payload


def ivf(frames: list[bytes], code: bytes, width: int, height: int, rate: int) -> bytes:
    little = lambda n, v: v.to_bytes(n, "little")
    head = b"DKIF" + little(2, 0) + little(2, 32) + code + little(2, width) + little(2, height) + little(4, rate) + little(4, 1) + little(4, len(frames)) + bytes(4)
    return head + b"".join(little(4, len(f)) + little(8, i) + f for i, f in enumerate(frames))


# ---- MP4


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return number(4, 8 + len(body)) + kind.encode() + body


def _video(track: int, entry: bytes, tables: list[bytes], scale: int, span: int) -> bytes:
    stbl = box("stbl", box("stsd", number(4, 0, 1), entry), *tables)
    media = box("mdia", box("mdhd", number(4, 0, 0, 0, scale, span, 0)), box("hdlr", number(4, 0, 0), b"vide", bytes(12)), box("minf", stbl))
    return box("trak", box("tkhd", number(4, 0, 0, 0, track)), media)


def sample_entry(sps: bytes, width: int, height: int, depth: int, transfer: int, config: bytes | None) -> bytes:
    colour = box("colr", b"nclx", number(2, 9, transfer, 9), b"\x00")
    return box("hvc1", bytes(24), number(2, width, height), bytes(50), box("hvcC", hvcc(sps, depth)), colour, box("dvvC", config) if config else b"")


def mp4(tracks: list[dict], scale: int = 24000, step: int = 1000, brand: bytes = b"isom", per_chunk: int = 2) -> bytes:
    """Tracks (entry, samples); chunks of `per_chunk` samples, one track's after the other's."""
    head = box("ftyp", brand, number(4, 0))
    at, traks = len(head) + 8, []
    for i, t in enumerate(tracks, 1):
        sizes, places = list(map(len, t["samples"])), []
        for a in range(0, len(sizes), per_chunk):
            places.append(at)
            at += sum(sizes[a : a + per_chunk])
        tables = [box("stsz", number(4, 0, 0, len(sizes), *sizes)), box("stco", number(4, 0, len(places), *places)), box("stsc", number(4, 0, 1, 1, per_chunk, 1)), box("stts", number(4, 0, 1, len(sizes), step))]
        traks.append(_video(i, t["entry"], tables, scale, step * len(sizes)))
    return head + box("mdat", *(s for t in tracks for s in t["samples"])) + box("moov", box("mvhd", number(4, 0, 0, 0, 1000, 0)), *traks)


def fragmented_mp4(entry: bytes, fragments: list[list[bytes]], sized_by: str, scale: int = 24000, step: int = 1000) -> bytes:
    """Sizes stand in the run ("run"), the fragment's header ("head") or the track's defaults ("track"); the last two ask
    for samples of one size."""
    one = len(fragments[0][0])
    empty = [box("stsz", number(4, 0, 0, 0)), box("stco", number(4, 0, 0)), box("stsc", number(4, 0, 0)), box("stts", number(4, 0, 0))]
    extends = box("mvex", box("trex", number(4, 0, 1, 1, step, one if sized_by == "track" else 0, 0)))
    out = box("ftyp", b"isom", number(4, 0)) + box("moov", box("mvhd", number(4, 0, 0, 0, 1000, 0)), _video(1, entry, empty, scale, 0), extends)
    for samples in fragments:
        sizes = list(map(len, samples))

        def moof(offset: int, sizes: list[int] = sizes) -> bytes:
            head = box("tfhd", number(4, 0x20010, 1, one) if sized_by == "head" else number(4, 0x20000, 1))
            run = number(4, 0x201, len(sizes), offset, *sizes) if sized_by == "run" else number(4, 1, len(sizes), offset)
            return box("moof", box("traf", head, box("trun", run)))

        out += moof(len(moof(0)) + 8) + box("mdat", *samples)
    return out


def indexed(data: bytes, where: str) -> bytes:
    """The fragmented file with a segment index before its first fragment ("front") or a random-access index at its end
    ("end")."""
    starts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"moof":
            starts.append(at)
        at += size
    if where == "front":
        sizes = [z - a for a, z in zip(starts, [*starts[1:], len(data)], strict=True)]
        entries = b"".join(number(4, n, 1000, 1 << 31) for n in sizes)
        return data[: starts[0]] + box("sidx", number(4, 0, 1, 24000, 0, 0), number(2, 0, len(sizes)), entries) + data[starts[0] :]
    if where == "end":
        table = box("tfra", number(4, 0, 1, 0, len(starts)), *(number(4, i, a) + bytes([1, 1, 1]) for i, a in enumerate(starts)))
        return data + box("mfra", table, box("mfro", number(4, 0, 8 + len(table) + 16)))
    return data


# ---- Matroska


def element(kind: int, *parts: bytes, unknown: bool = False) -> bytes:
    body = b"".join(parts)
    size = (1 << 56) - 1 if unknown else len(body)
    return number((kind.bit_length() + 7) // 8, kind) + number(8, size | 1 << 56) + body


def unsigned(kind: int, value: int) -> bytes:
    return element(kind, number(8, value).lstrip(b"\x00") or b"\x00")


def mkv(entry: bytes, clusters: list[list[bytes]], secs: float, tags: list[bytes] = (), unknown: bool = False) -> bytes:
    """Clusters hold ready blocks; `tags` come last and are named by a seek head. With `unknown`, clusters do not say how
    long they are."""
    info = element(ebml.INFO, unsigned(ebml.SCALE, 1_000_000), element(ebml.DURATION, struct.pack(">d", 1000.0 * secs)))
    middle = info + element(ebml.TRACKS, entry) + b"".join(element(ebml.CLUSTER, *c, unknown=unknown) for c in clusters)
    last = element(ebml.TAGS, *tags) if tags else b""

    def seek(place: int) -> bytes:
        return element(ebml.SEEKHEAD, element(ebml.SEEK, element(ebml.SEEK_ID, number(4, ebml.TAGS)), element(ebml.SEEK_POSITION, number(8, place))))

    head = seek(len(seek(0)) + len(middle)) if tags else b""
    return element(ebml.EBML, unsigned(0x4282, 1)) + element(ebml.SEGMENT, head, middle, last)


def simple_block(track: int, payload: bytes, laced: bool = False) -> bytes:
    return element(ebml.SIMPLE, bytes([0x80 | track, 0, 0, 0x82 if laced else 0x80]), payload)


def block_with_addition(track: int, payload: bytes, kind: int, addition: bytes) -> bytes:
    more = element(ebml.ADDITIONS, element(ebml.MORE, unsigned(ebml.ADD_ID, kind), element(ebml.ADDITIONAL, addition)))
    return element(ebml.GROUP, element(ebml.BLOCK, bytes([0x80 | track, 0, 0, 0]), payload), more)


def statistics(uid: int, name: bytes, value: int) -> bytes:
    return element(ebml.TAG, element(ebml.TARGETS, unsigned(ebml.TAG_UID, uid)), element(ebml.SIMPLE_TAG, element(ebml.NAME, name), element(ebml.STRING, str(value).encode())))


def track_entry(uid: int, width: int, height: int, sps: bytes, transfer: int, cll: int, config: bytes | None) -> bytes:
    colour = element(ebml.COLOUR, unsigned(ebml.TRANSFER, transfer), unsigned(ebml.PRIMARIES, 9), unsigned(ebml.MATRIX, 9), unsigned(ebml.RANGE, 1), unsigned(ebml.CLL, cll), unsigned(ebml.FALL, cll // 2))
    mapping = element(ebml.MAPPING, unsigned(ebml.ADD_TYPE, int.from_bytes(b"dvvC", "big")), element(ebml.ADD_DATA, config)) if config else b""
    video = element(ebml.VIDEO, unsigned(ebml.WIDTH, width), unsigned(ebml.HEIGHT, height), colour)
    return element(ebml.ENTRY, unsigned(ebml.NUMBER, 1), unsigned(ebml.UID, uid), unsigned(ebml.TYPE, 1), element(ebml.CODEC, b"V_MPEGH/ISO/HEVC"), element(ebml.PRIVATE, hvcc(sps)), video, mapping)


# ---- transport stream


def _packet(pid: int, body: bytes, begins: bool = False, clock: int | None = None) -> bytes:
    field = b""
    if clock is not None:
        base, extension = divmod(clock, 300)
        field = bytes([0x10]) + number(6, base << 15 | 0x3F << 9 | extension)
    room = 184 - len(body) - (1 + len(field) if field else 0)
    if not field and not room:
        return bytes([0x47, 0x40 * begins | pid >> 8, pid & 255, 0x10]) + body
    if not field:
        field = (b"\x00" + b"\xff" * (room - 2)) if room > 1 else b""
    else:
        field += b"\xff" * room
    return bytes([0x47, 0x40 * begins | pid >> 8, pid & 255, 0x30, len(field)]) + field + body


def _section(table: int, body: bytes) -> bytes:
    return b"\x00" + bytes([table]) + number(2, 0xB000 | len(body) + 9) + bytes([0, 1, 0xC1, 0, 0]) + body + bytes(4)


CLOCK_PID, MAP_PID, BASE_PID, LAYER_PID = 0x1001, 0x100, 0x1011, 0x1015


def ts(frames: list[bytes], secs: int, config: bytes | None = None, layer: tuple[list[bytes], bytes] | None = None, stride: int = 188) -> bytes:
    """One program with a base stream and perhaps a layer (frames, configuration). A last unit of each stream, which no
    reader gives out, ends it."""
    streams = [(BASE_PID, frames, config)] + ([(LAYER_PID, *layer)] if layer else [])
    listed = b""
    for pid, _, record in streams:
        said = bytes([5, 4]) + b"HEVC" + (bytes([0xB0, len(record)]) + record if record else b"")
        listed += bytes([0x24]) + number(2, 0xE000 | pid, 0xF000 | len(said)) + said
    out = [_packet(0, _section(0, number(2, 1, 0xE000 | MAP_PID)), True), _packet(MAP_PID, _section(2, number(2, 0xE000 | CLOCK_PID, 0xF000) + listed), True), _packet(CLOCK_PID, b"", clock=1000)]
    for pid, own, _ in streams:
        for f in [*own, START + b"\x26"]:
            pes = b"\x00\x00\x01\xe0\x00\x00\x80\x00\x00" + f
            out += [_packet(pid, pes[i : i + 180], i == 0) for i in range(0, len(pes), 180)]
    out.append(_packet(CLOCK_PID, b"", clock=1000 + secs * 27_000_000))
    out += [_packet(0x1FFF, b"\xff" * 180)] * 2
    return b"".join(bytes(stride - 188) + p for p in out)


# ---- discs


def play_list(items: list[tuple[str, int, int]], cut: int = 0) -> bytes:
    rows = b"".join(number(2, 20) + c.encode() + b"M2TS" + bytes(3) + number(4, a, b) for c, a, b in items)
    whole = b"MPLS0200" + number(4, 20) + bytes(8) + bytes(6) + number(2, len(items)) + bytes(2) + rows
    return whole[: len(whole) - cut]


def disc(clips: dict[str, bytes], lists: dict[str, bytes], metadata: bool) -> bytes:
    """A UDF volume with one partition at sector 300. With `metadata`, directories and entries lie in a metadata partition
    whose file has two extents with a hole between them, so that a block is not where its number alone would say."""
    sectors: dict[int, bytes] = {}
    free, blocks = 400, 0
    extents = ((310, 6), (330, 60))
    little = lambda n, v: v.to_bytes(n, "little")

    def put(data: bytes) -> int:
        nonlocal free
        first = free
        for i in range(0, max(len(data), 1), 2048):
            sectors[free] = data[i : i + 2048]
            free += 1
        return first

    def put_block(data: bytes) -> int:
        """One sector in the partition of directories; its block there."""
        nonlocal blocks
        if not metadata:
            return put(data) - 300
        blocks += 1
        block = blocks - 1
        (a, n), (b, _) = extents
        sectors[a + block if block < n else b + block - n] = data
        return block

    def descriptor(size: int, form: int, allocation: bytes) -> bytes:
        b = bytearray(176)
        b[0:2], b[34:36], b[56:64], b[172:176] = little(2, 261), little(2, form), little(8, size), little(4, len(allocation))
        return bytes(b) + allocation

    def stored(data: bytes) -> int:
        at = put(data) - 300
        return put_block(descriptor(len(data), 1, little(4, len(data)) + little(4, at) + little(2, 0) + bytes(6)))

    def folder(items: list[tuple[str, int, bool]]) -> int:
        raw = b""
        for name, block, is_folder in items:
            text = b"\x08" + name.encode()
            b = bytearray(38)
            b[0:2], b[18], b[19], b[24:28], b[28:30] = little(2, 257), 2 * is_folder, len(text), little(4, block), little(2, int(metadata))
            raw += bytes(b) + text + bytes(-(38 + len(text)) % 4)
        return put_block(descriptor(len(raw), 3, raw))

    stream = folder([(k, stored(v), False) for k, v in clips.items()])
    listed = folder([(k, stored(v), False) for k, v in lists.items()])
    root = folder([("BDMV", folder([("PLAYLIST", listed, True), ("STREAM", stream, True)]), True)])
    files = bytearray(512)
    files[0:2], files[404:408], files[408:410] = little(2, 256), little(4, root), little(2, int(metadata))
    files_at = put_block(bytes(files))
    anchor, part, volume = bytearray(512), bytearray(512), bytearray(600)
    anchor[0:2], anchor[16:20], anchor[20:24] = little(2, 2), little(4, 3 * 2048), little(4, 260)
    part[0:2], part[188:192] = little(2, 5), little(4, 300)
    volume[0:2], volume[252:256], volume[256:258], volume[268:272], volume[440:446] = little(2, 6), little(4, files_at), little(2, int(metadata)), little(4, 1 + metadata), bytes([1, 6, 1, 0, 0, 0])
    if metadata:
        sectors[301] = descriptor(66 * 2048, 0, b"".join(little(4, n * 2048) + little(4, a - 300) for a, n in extents))
        named = bytearray(64)
        named[0:2], named[4:28], named[40:44] = bytes([2, 64]), b"\x00*UDF Metadata Partition", little(4, 1)
        volume[446:510] = named
    sectors |= {256: bytes(anchor), 260: bytes(part), 261: bytes(volume), 262: little(2, 8)}
    return b"".join(sectors.get(i, b"").ljust(2048, b"\x00") for i in range(free + 1))
