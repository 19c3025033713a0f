import random

import pytest

from nitscope.functions import bits, headers, sei


class Writer:
    """Writes what the readers read."""

    def __init__(self):
        self.s = ""

    def u(self, n, v):
        self.s += format(v, f"0{n}b") if n else ""
        return self

    def ue(self, v):
        b = format(v + 1, "b")
        self.s += "0" * (len(b) - 1) + b
        return self

    def se(self, v):
        return self.ue(2 * v - 1 if v > 0 else -2 * v)

    def done(self):
        s = self.s + "1" + "0" * (-(len(self.s) + 1) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big")


def escaped(data):
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def test_numbers_round_trip():
    rnd = random.Random(0)
    w, want = Writer(), []
    for _ in range(3000):
        kind, v = rnd.choice(("u", "ue", "se")), rnd.choice((0, 1, 2, 255, 70000, rnd.randrange(1 << 20)))
        if kind == "u":
            w.u(32, v)
        elif kind == "ue":
            w.ue(v)
        else:
            v = rnd.choice((1, -1)) * v
            w.se(v)
        want.append((kind, v))
    b = bits.Bits(w.done())
    assert [(k, b.u(32) if k == "u" else getattr(b, k)()) for k, _ in want] == want
    with pytest.raises(bits.Short):
        b.u(64)


def test_exp_golomb_of_the_standard():
    b = bits.Bits(bytes([0b10100110, 0b01000000]))
    assert [b.ue() for _ in range(4)] == [0, 1, 2, 3]


def test_emulation_prevention():
    assert bits.rbsp(bytes([0, 0, 3, 0, 1, 3])) == bytes([0, 0, 0, 1, 3])
    rnd = random.Random(1)
    for _ in range(300):
        d = bytes(rnd.choice((0, 0, 0, 1, 2, 3, 9)) for _ in range(rnd.randrange(40)))
        assert bits.rbsp(escaped(d)) == d


def test_splitters():
    d = b"\x00\x00\x00\x01\x67\xaa\x00\x00\x00\x01\x1c\x19\x08\x00\x00"
    assert [d[a:z] for a, z in bits.annexb(d)] == [b"\x67\xaa", b"\x1c\x19\x08"]
    d = b"\x41\x42\x00\x00\x01\x43"
    assert [d[a:z] for a, z in bits.annexb(d)] == [b"\x41\x42", b"\x43"]
    assert list(bits.annexb(b"")) == [] and list(bits.annexb(b"\x00\x00\x01")) == []
    d = b"\x00\x02ab\x00\x01c\x00\x09x"
    assert [d[a:z] for a, z in bits.length_prefixed(d, 2)] == [b"ab", b"c"]
    assert bits.leb128(b"\x80\x01", 0) == (128, 2)


def hevc_sps(width=3840, height=2160, depth=10, crop=0, cicp=(9, 16, 9), fps=(24, 1), layers=0):
    w = Writer().u(4, 0).u(3, layers).u(1, 1).u(2, 0).u(1, 1).u(5, 2).u(32, 0x20000000).u(48, 0).u(8, 153)
    if layers:
        for _ in range(layers):
            w.u(2, 3)
        w.u(2 * (8 - layers), 0)
        for _ in range(layers):
            w.u(88, 0).u(8, 93)
    w.ue(0).ue(1).ue(width).ue(height + crop).u(1, int(crop > 0))
    if crop:
        w.ue(0).ue(0).ue(0).ue(crop // 2)
    w.ue(depth - 8).ue(depth - 8).ue(4).u(1, 0).ue(4).ue(2).ue(0)
    for v in (0, 3, 0, 3, 1, 1):
        w.ue(v)
    w.u(1, 0).u(2, 3).u(1, 0)
    w.ue(2).ue(1).ue(0).ue(0).u(1, 1).u(1, 1).u(1, 0).ue(0).u(1, 1).u(1, 0).u(1, 1)
    w.u(1, 0).u(2, 3).u(1, 1)
    w.u(1, 1).u(8, 1).u(1, 0).u(1, 1).u(3, 5).u(1, 0).u(1, 1)
    for v in cicp:
        w.u(8, v)
    w.u(1, 0).u(3, 0).u(1, 0).u(1, 1).u(32, fps[1]).u(32, fps[0])
    return b"\x42\x01" + escaped(w.done())


def test_hevc_parameter_set():
    got = headers.hevc_sps(hevc_sps(crop=8))
    assert got == {"width": 3840, "height": 2160, "bit_depth": 10, "chroma": "4:2:0", "profile": "Main 10, High tier @ L5.1", "color": headers.color(9, 16, 9, False), "fps": 24.0}
    assert headers.hevc_sps(hevc_sps(layers=2))["width"] == 3840
    whole = hevc_sps()
    for n in range(len(whole)):
        cut = headers.hevc_sps(whole[:n])
        assert cut is None or cut["width"] == 3840


def test_hevc_configuration_prefers_the_embedded_set():
    sps = hevc_sps()
    record = bytes([1, 0x22]) + bytes(10) + bytes([153]) + bytes(3) + bytes([0xFC, 0xF8]) + bytes(3) + bytes([3, 1, 0xA1]) + (1).to_bytes(2, "big") + len(sps).to_bytes(2, "big") + sps
    got = headers.hevc_config(record)
    assert (got["bit_depth"], got["chroma"], got["nal_length"], got["profile"]) == (10, "4:2:0", 4, "Main 10, High tier @ L5.1")
    assert headers.hevc_config(record[:22])["bit_depth"] == 8 and headers.hevc_config(record[:21]) is None


def avc_sps(profile=100, frame_only=1):
    w = Writer().u(8, profile).u(8, 0).u(8, 40).ue(0).ue(1).ue(0).ue(0).u(1, 0).u(1, 0).ue(0).ue(0).ue(2).ue(4).u(1, 0).ue(119).ue(67 if frame_only else 33).u(1, frame_only)
    if not frame_only:
        w.u(1, 0)
    w.u(1, 1).u(1, 1).ue(0).ue(0).ue(0).ue(4 if frame_only else 2).u(1, 1).u(1, 0).u(1, 0).u(1, 1).u(3, 5).u(1, 0).u(1, 1).u(8, 1).u(8, 1).u(8, 1).u(1, 0).u(1, 1).u(32, 1).u(32, 48)
    return b"\x67" + escaped(w.done())


@pytest.mark.parametrize("frame_only", (0, 1))
def test_avc_parameter_set(frame_only):
    got = headers.avc_sps(avc_sps(frame_only=frame_only))
    assert got == {"width": 1920, "height": 1080, "bit_depth": 8, "chroma": "4:2:0", "profile": "High @ L4", "color": headers.color(1, 1, 1, False), "fps": 24.0}


def test_labels():
    assert headers.avc_label(100, 42, False, False) == "High @ L4.2"
    assert headers.avc_label(100, 42, True, True) == "Constrained High @ L4.2"
    assert headers.avc_label(66, 31, False, False) == "Baseline @ L3.1"
    assert headers.av1_label(0, 0, 13) == "Main profile, Main tier @ L5.1" and headers.av1_label(0, 1, 31) == "Main profile, High tier"
    assert headers.vp9_label(2, 51) == "Profile 2 @ L5.1"


def av1_sequence():
    w = Writer().u(3, 0).u(1, 0).u(1, 0).u(1, 1).u(32, 1).u(32, 25).u(1, 1)
    w.s += "1"
    w.u(1, 0).u(1, 0).u(5, 0).u(12, 0).u(5, 13).u(1, 0).u(4, 11).u(4, 11).u(12, 3839).u(12, 2159).u(1, 0).u(3, 0).u(4, 0).u(1, 1).u(2, 0).u(1, 1).u(1, 1).u(3, 6).u(3, 0)
    return w.u(1, 1).u(1, 0).u(1, 1).u(8, 9).u(8, 16).u(8, 9).u(1, 0).u(2, 0).done()


def test_av1_sequence():
    got = headers.av1_sequence(av1_sequence())
    assert got == {"width": 3840, "height": 2160, "fps": 25.0, "bit_depth": 10, "chroma": "4:2:0", "profile": "Main profile, Main tier @ L5.1", "color": headers.color(9, 16, 9, False), "described": True}


def test_vp9_and_prores():
    w = Writer().u(2, 2).u(1, 0).u(1, 1).u(1, 0).u(1, 0).u(2, 2).u(24, 0x498342).u(1, 0).u(3, 5).u(1, 0).u(16, 3839).u(16, 2159)
    got = headers.vp9_frame(w.done())
    assert (got["profile"], got["bit_depth"], got["width"], got["color"]["matrix"]) == ("Profile 2", 10, 3840, "BT.2020 NCL")
    assert headers.vp9_private(b"\x01\x01\x02\x02\x01\x33\x03\x01\x0a\x04\x01\x01") == {"profile": 2, "level": 51, "bit_depth": 10, "chroma": "4:2:0"}
    frame = (148).to_bytes(2, "big") + bytes(6) + b"\x07\x80\x04\x38" + bytes([0x80, 0, 2, 2, 2, 0, 0, 0])
    assert headers.prores_frame(frame) == {"chroma": "4:2:2", "bit_depth": 10, "color": headers.NO_COLOR}
    assert headers.prores_frame(bytes(4) + b"icpf" + frame)["bit_depth"] == 10 and headers.prores_frame(frame[:19]) is None


def test_dolby_configuration():
    full = bytes([1, 0]) + Writer().u(7, 8).u(6, 6).u(1, 1).u(1, 0).u(1, 1).u(4, 1).u(4, 0).done()
    got = headers.dv_config(full)
    assert (got["profile"], got["level"], got["bl_present"], got["el_present"], got["bl_compatibility_id"]) == (8, 6, True, False, 1)
    layer = bytes([1, 0]) + Writer().u(7, 7).u(6, 6).u(1, 1).u(1, 1).u(1, 0).u(13, 4113).u(3, 0).u(4, 6).u(4, 0).done()
    got = headers.dv_config(layer, descriptor=True)
    assert (got["dependency_pid"], got["bl_compatibility_id"]) == (4113, 6)
    assert headers.dv_config(full[:4])["bl_compatibility_id"] is None and headers.dv_config(full[:3]) is None


def points(*values, unit):
    return b"".join(round(v * unit).to_bytes(2, "big") for v in values)


BT2020 = {"g": (0.17, 0.797), "b": (0.131, 0.046), "r": (0.708, 0.292), "w": (0.3127, 0.329)}


def test_static_messages():
    body = points(*BT2020["g"], *BT2020["b"], *BT2020["r"], *BT2020["w"], unit=50000) + (10_000_000).to_bytes(4, "big") + (50).to_bytes(4, "big")
    light = (3597).to_bytes(2, "big") + (505).to_bytes(2, "big")
    nal = b"\x4e\x01" + escaped(bytes([137, 24]) + body + bytes([144, 4]) + light + bytes([147, 1, 18, 0x80]))
    got = sei.unit(nal)
    assert got["mastering"] == {"max_luminance": 1000.0, "min_luminance": 0.005, "primaries": "BT.2020", "primaries_level": None}
    assert got["content_light"] == {"max_cll": 3597, "max_fall": 505, "zeroed": None} and got["preferred_transfer"] == 18
    twice = b"\x4e\x01" + bytes([144, 4]) + light + bytes([144, 4, 0, 0, 0, 0, 0x80])
    assert sei.unit(twice)["content_light"]["zeroed"] is True
    for n in range(len(nal)):
        sei.unit(nal[:n])


def test_av1_metadata():
    light = bytes([0x2A, 5, 1, 0x03, 0xE8, 0x01, 0x90])
    got, rpus = sei.av1_unit(light + bytes([0x2A, 5, 1, 0, 1, 0, 1]))
    assert (got["content_light"]["max_cll"], got["content_light"]["max_fall"], rpus) == (1000, 400, [])


def test_registered_payloads():
    target = bytes([9]) + (100).to_bytes(2, "big") + bytes(2)
    source = points(*BT2020["g"], *BT2020["b"], *BT2020["r"], *BT2020["w"], unit=50000) + (1000).to_bytes(2, "big") + (50).to_bytes(2, "big")
    p = b"\xb5\x00\x3a\x00" + bytes([0x11, 0x00, 0x30]) + target + source
    got = sei.sl_hdr(p)
    assert (got["mode"], got["spec_version"], got["payload_mode"], got["target_primaries"], got["target_max_luminance"], got["source_mastering"]["primaries"]) == (2, "1.0", 0, 9, 100, "BT.2020")
    assert sei.sl_hdr(p[:9])["target_primaries"] is None and sei.sl_hdr(b"\xb5\x00\x3a\x00\x30\x00") is None
    w = Writer().u(48, 0).u(1, 1).u(1, 1).u(12, 2770).u(1, 0).u(1, 1).u(1, 0).u(2, 1).u(40, 0).u(12, 2080).u(1, 0).u(1, 0)
    vivid = b"\x26\x00\x04\x00\x05\x01" + w.done()
    assert sei.hdr_vivid(vivid) == {"version": 1, "system_start_code": 1, "target_pq": [2770, 2080]}
    assert sei.hdr_vivid(vivid[:14])["target_pq"] == [2770] and sei.hdr_vivid(b"\x26\x00\x04\x00\x09\x01") is None
    many = {"version": 1, "system_start_code": 1, "target_pq": list(range(12))}
    assert sei.union_vivid(sei.hdr_vivid(vivid), many)["target_pq"] == [2770, 2080, 0, 1, 2, 3, 4, 5]
    w = Writer().u(8, 4).u(8, 1).u(2, 1).u(27, 400).u(1, 0).u(51, 0).u(17, 0).u(4, 1).u(24, 0).u(10, 0).u(1, 0).u(1, 1).u(24, 0).u(4, 2).u(20, 0).u(1, 0)
    assert sei.hdr10plus(b"\xb5\x00\x3c\x00\x01" + w.done()) == {"application_version": 1, "num_windows": 1, "profile": "B", "target_max_luminance": 400}


def test_gamut_in_any_order():
    for name, r, g, b, w in __import__("nitscope.functions.luminance", fromlist=["x"]).GAMUTS:
        assert {sei.gamut(*t, w) for t in ((r, g, b), (b, r, g), (g, b, r))} == {name}
    assert sei.gamut((0, 0), (0, 0), (0, 0), (0, 0)) is None
