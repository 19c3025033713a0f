"""Small media files, written here from their formats' definitions."""

from tests.test_headers import BT2020, Writer, av1_sequence, escaped, hevc_sps, points


def hevc_sei(cll=1000, fall=400, transfer=None):
    body = points(*BT2020["g"], *BT2020["b"], *BT2020["r"], *BT2020["w"], unit=50000) + (10_000_000).to_bytes(4, "big") + (50).to_bytes(4, "big")
    msg = bytes([137, 24]) + body + bytes([144, 4]) + cll.to_bytes(2, "big") + fall.to_bytes(2, "big")
    msg += bytes([147, 1, transfer]) if transfer else b""
    return b"\x4e\x01" + escaped(msg + b"\x80")


PICTURE = b"\x26\x01\xaf\x11"
START = b"\x00\x00\x00\x01"


def crc32_mpeg(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def rpu(blocks=(), scene=0, low=7, high=3079, el=None, more=()):
    """An RPU with identity curves; `el` FEL or MEL gives it a residual quantizer."""
    w = Writer().u(6, 2).u(11, 18).u(4, 1).u(4, 0).u(1, 1).u(1, 0).u(2, 0).ue(23).u(2, 1).u(1, 0).ue(2).ue(2).ue(4).u(1, 0).u(3, 0).u(1, int(el is not None)).u(1, int(el is None)).u(1, 1).u(1, 0)
    w.ue(0).ue(0).ue(0)
    for _ in range(3):
        w.ue(0).u(10, 0).u(10, 1023)
    if el:
        w.u(3, 0).u(10, 0).u(10, 1023)
    w.ue(0).ue(0)
    for _ in range(3):
        w.ue(0).ue(0).u(1, 0).se(0).u(23, 0).se(1).u(23, 0)
    if el:
        for _ in range(3):
            w.u(10, 0).ue(1).u(23, 0).ue(0).u(23, 5 if el == "FEL" else 0).ue(0).u(23, 0)
    w.ue(0).ue(0).ue(scene).u(9 * 16, 0).u(3 * 32, 0).u(9 * 16, 0).u(48, 0).u(32, 0).u(5, 12).u(2, 0).u(2, 0).u(2, 1).u(12, low).u(12, high).u(10, 42)
    for group in (blocks, more) if more else (blocks,):
        w.ue(len(group))
        w.u(-len(w.s) % 8 if group else 0, 0)
        for level, raw in group:
            w.ue(len(raw)).u(8, level).u(8 * len(raw), int.from_bytes(raw, "big"))
        w.u(-len(w.s) % 8, 0)
    w.u(-len(w.s) % 8, 0)
    body = int(w.s, 2).to_bytes(len(w.s) // 8, "big")
    return b"\x19" + body + crc32_mpeg(body).to_bytes(4, "big") + b"\x80"


def bits(*pairs):
    w = Writer()
    for n, v in pairs:
        w.u(n, v)
    w.u(-len(w.s) % 8, 0)
    return int(w.s, 2).to_bytes(len(w.s) // 8, "big")


L5 = (5, bits((13, 0), (13, 0), (13, 276), (13, 276)))
L6 = (6, bits((16, 1000), (16, 50), (16, 0), (16, 0)))
L2 = (2, bits((12, 2081), (76, 0)))
L8 = (8, bits((8, 48), (72, 0)))
L9 = (9, b"\x00")
L11 = (11, bytes([1, 0x10, 0, 0]))
L254 = (254, bytes([0, 2]))


def frame(*units):
    return b"".join(START + u for u in units)


def hevc_stream(n=6, rpus=None, sei=True):
    out = frame(b"\x40\x01\x0c", hevc_sps(), b"\x44\x01\xc1")
    for i in range(n):
        parts = ([hevc_sei()] if sei and i == 0 else []) + [PICTURE] + ([b"\x7c\x01" + escaped(rpus[i])] if rpus else [])
        out += frame(*parts)
    return out


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind.encode() + body


def u32(*values):
    return b"".join(v.to_bytes(4, "big") for v in values)


def mp4(samples, config=None, fragmented=False):
    """One HEVC track at 24 frames a second, chunks of two samples."""
    sps = hevc_sps()
    hvcc = bytes([1, 0x22]) + bytes(10) + bytes([153]) + bytes(3) + bytes([0xFD, 0xFA]) + bytes(3) + bytes([3, 1, 0xA1]) + (1).to_bytes(2, "big") + len(sps).to_bytes(2, "big") + sps
    colr = box("colr", b"nclx", (9).to_bytes(2, "big"), (16).to_bytes(2, "big"), (9).to_bytes(2, "big"), b"\x00")
    extra = box("dvvC", config) if config else b""
    entry = box("hvc1", bytes(24), (3840).to_bytes(2, "big"), (2160).to_bytes(2, "big"), bytes(50), box("hvcC", hvcc), colr, extra)
    head = box("ftyp", b"isom", u32(0))
    total = b"".join(samples)
    mdat = box("mdat", total)
    first = len(head) + 8

    def moov(tables):
        stbl = box("stbl", box("stsd", u32(0, 1), entry), *tables)
        mdia = box("mdia", box("mdhd", u32(0, 0, 0, 24000, 0 if fragmented else 1000 * len(samples), 0)), box("hdlr", u32(0, 0), b"vide", bytes(12)), box("minf", stbl))
        trak = box("trak", box("tkhd", u32(0, 0, 0, 1)), mdia)
        mvex = box("mvex", box("trex", u32(0, 1, 1, 1000, 0, 0))) if fragmented else b""
        return box("moov", box("mvhd", u32(0, 0, 0, 1000, 0)), trak, mvex)

    if fragmented:
        empty = [box("stsz", u32(0, 0, 0)), box("stco", u32(0, 0)), box("stsc", u32(0, 0)), box("stts", u32(0, 0))]
        out = head + moov(empty)
        run = lambda off: box("moof", box("traf", box("tfhd", u32(0x20000, 1)), box("trun", u32(0x201, len(samples), off, *map(len, samples)))))
        return out + run(len(run(0)) + 8) + mdat
    places, at = [], first
    for i in range(0, len(samples), 2):
        places.append(at)
        at += sum(map(len, samples[i : i + 2]))
    tables = [box("stsz", u32(0, 0, len(samples), *map(len, samples))), box("stco", u32(0, len(places), *places)), box("stsc", u32(0, 1, 1, 2, 1)), box("stts", u32(0, 1, len(samples), 1000))]
    return head + mdat + moov(tables)


def sized(*units):
    return b"".join(len(u).to_bytes(4, "big") + u for u in units)


def el(kind, *parts):
    body = b"".join(parts)
    n = (kind.bit_length() + 7) // 8
    return kind.to_bytes(n, "big") + (len(body) | 1 << 56).to_bytes(8, "big") + body


def uint(kind, v):
    return el(kind, v.to_bytes(8, "big").lstrip(b"\x00") or b"\x00")


def mkv(frames, config=None, tags=True, t35=None):
    from nitscope.sources import mkv as m

    sps = hevc_sps(cicp=(2, 2, 2))
    hvcc = bytes([1, 0x22]) + bytes(10) + bytes([153]) + bytes(3) + bytes([0xFD, 0xFA]) + bytes(3) + bytes([3, 1, 0xA1]) + (1).to_bytes(2, "big") + len(sps).to_bytes(2, "big") + sps
    colour = el(m.COLOUR, uint(m.TRANSFER, 16), uint(m.PRIMARIES, 9), uint(m.MATRIX, 9), uint(m.RANGE, 1), uint(m.CLL, 900), uint(m.FALL, 200))
    mapping = el(m.MAPPING, uint(m.ADD_TYPE, int.from_bytes(b"dvvC", "big")), el(m.ADD_DATA, config)) if config else b""
    entry = el(m.ENTRY, uint(m.NUMBER, 1), uint(m.UID, (1 << 63) + 5), uint(m.TYPE, 1), el(m.CODEC, b"V_MPEGH/ISO/HEVC"), el(m.PRIVATE, hvcc), el(m.VIDEO, uint(m.WIDTH, 3840), uint(m.HEIGHT, 2160), colour), mapping)
    import struct

    info = el(m.INFO, uint(m.SCALE, 1_000_000), el(m.DURATION, struct.pack(">d", 1000.0 * len(frames) / 24)))
    blocks = b"".join(el(m.SIMPLE, b"\x81\x00\x00\x80", f) for f in frames[:-1])
    last = el(m.GROUP, el(m.BLOCK, b"\x81\x00\x00\x00", frames[-1]), el(m.ADDITIONS, el(m.MORE, uint(m.ADD_ID, 4), el(m.ADDITIONAL, t35))) if t35 else b"")
    tag = el(m.TAGS, el(m.TAG, el(m.TARGETS, uint(m.TAG_UID, (1 << 63) + 5)), el(m.SIMPLE_TAG, el(m.NAME, b"BPS"), el(m.STRING, b"12345")))) if tags else b""
    return el(m.EBML, uint(0x4282, 1)) + el(m.SEGMENT, info, el(m.TRACKS, entry), el(m.CLUSTER, blocks, last), tag)


def ts_packet(pid, body, begins=False, clock=None, count=0):
    field = b""
    if clock is not None:
        base, ext = divmod(clock, 300)
        field = bytes([0x10]) + (base << 15 | 0x3F << 9 | ext).to_bytes(6, "big")
    room = 184 - len(body) - (1 + len(field) if field else 0)
    if field or room:
        if not field:
            room -= 1
            field = (b"\x00" + b"\xff" * (room - 1)) if room > 0 else b""
        else:
            field += b"\xff" * room
        adapt = bytes([len(field)]) + field
        return bytes([0x47, 0x40 * begins | pid >> 8, pid & 255, 0x30 | count]) + adapt + body
    return bytes([0x47, 0x40 * begins | pid >> 8, pid & 255, 0x10 | count]) + body


def ts(frames, secs=10, config=None, stride=188, tail_clock=True):
    section = lambda table, body: b"\x00" + bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + bytes([0, 1, 0xC1, 0, 0]) + body + bytes(4)
    pat = section(0, (1).to_bytes(2, "big") + (0xE000 | 0x100).to_bytes(2, "big"))
    desc = bytes([5, 4]) + b"HEVC" + (bytes([0xB0, len(config)]) + config if config else b"")
    pmt = section(2, (0xE000 | 0x1001).to_bytes(2, "big") + b"\xf0\x00" + bytes([0x24]) + (0xE000 | 0x1011).to_bytes(2, "big") + (0xF000 | len(desc)).to_bytes(2, "big") + desc)
    out = [ts_packet(0, pat, True), ts_packet(0x100, pmt, True), ts_packet(0x1001, b"", clock=1000)]
    for f in [*frames, b"\x00\x00\x00\x01\x26"]:
        pes = b"\x00\x00\x01\xe0\x00\x00\x80\x00\x00" + f
        for i in range(0, len(pes), 180):
            out.append(ts_packet(0x1011, pes[i : i + 180], i == 0))
    out.append(ts_packet(0x1001, b"", clock=1000 + secs * 27_000_000))
    return b"".join(bytes(stride - 188) + p for p in out)[stride - 188 :] if stride == 192 else b"".join(out)


def ivf(frames, fourcc=b"AV01", rate=(24, 1)):
    head = b"DKIF" + (0).to_bytes(2, "little") + (32).to_bytes(2, "little") + fourcc + (3840).to_bytes(2, "little") + (2160).to_bytes(2, "little") + rate[0].to_bytes(4, "little") + rate[1].to_bytes(4, "little") + len(frames).to_bytes(4, "little") + bytes(4)
    return head + b"".join(len(f).to_bytes(4, "little") + i.to_bytes(8, "little") + f for i, f in enumerate(frames))


def obu(kind, payload):
    return bytes([kind << 3 | 2, len(payload)]) + payload


def av1_frames(n=4):
    light = obu(5, bytes([1]) + (1000).to_bytes(2, "big") + (400).to_bytes(2, "big"))
    return [obu(2, b"") + (obu(1, av1_sequence()) + light if i == 0 else b"") + obu(6, b"\x10\x00") for i in range(n)]
