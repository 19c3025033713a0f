import json
import random

import pytest

from nitscope.functions import bits
from nitscope.functions import rpu as rpu_functions
from nitscope.plans import files
from nitscope.sources import disc, dispatch, extract, mkv, mp4, raw, sidecar, ts
from nitscope.sources.model import Unreadable
from tests import media as m
from tests.test_headers import Writer

CONFIG = bytes([1, 0]) + Writer().u(7, 8).u(6, 6).u(1, 1).u(1, 0).u(1, 1).u(4, 1).u(4, 0).done()


def first_findings(path, data, **kw):
    return [r for r in extract.finding_rows(path, data, kw.get("full", True), 16)]


def test_raw_hevc():
    data = m.hevc_stream(5)
    t = dispatch.demux("a.hevc", data)["tracks"][0]
    assert (t["width"], t["height"], t["fps"], len(t["units"]), t["pinned"]) == (3840, 2160, 24.0, 5, 0)
    rows = first_findings("a.hevc", data)
    assert rows[0]["sei"]["content_light"] == {"max_cll": 1000, "max_fall": 400, "zeroed": None} and len(rows) == 1


def test_access_unit_rule_equals_the_automaton():
    import random

    rnd = random.Random(4)
    for _ in range(500):
        kinds = [rnd.choice((0, 1, 19, 32, 33, 34, 35, 39, 40, 62, 38)) for _ in range(rnd.randint(0, 12))]
        data, units = b"", []
        for k in kinds:
            units.append((len(data), len(data) + 2))
            data += bytes([k << 1, 1])
        want, has = [], False
        for (a, z), k in zip(units, kinds, strict=True):
            if not want or has and (k < 32 or k in raw.LEADERS):
                want.append([a, z])
                has = False
            want[-1][1] = z
            has |= k < 32
        assert raw.access_units(data, units) == [(a, z - a) for a, z in want]


def test_av1_raw_and_ivf():
    frames = m.av1_frames()
    t = raw.obu(b"".join(frames))
    assert (len(t["tracks"][0]["units"]), t["duration_secs"], t["tracks"][0]["fps"]) == (4, 4 / 25, 25.0)
    i = raw.ivf(m.ivf(frames))
    assert (i["container"], len(i["tracks"][0]["units"]), i["tracks"][0]["fps"], i["tracks"][0]["bit_depth"]) == ("raw AV1 (IVF)", 4, 24.0, 10)
    assert first_findings("a.obu", b"".join(frames))[0]["sei"]["content_light"]["max_cll"] == 1000
    cut = m.ivf(frames)[:-1]
    assert len(raw.ivf(cut)["tracks"][0]["units"]) == 3
    with pytest.raises(Unreadable):
        raw.ivf(m.ivf(frames, b"VP80"))


SAMPLES = [m.sized(m.hevc_sei(), m.PICTURE), m.sized(m.PICTURE), m.sized(m.PICTURE + b"x"), m.sized(m.PICTURE), m.sized(m.PICTURE)]


@pytest.mark.parametrize("fragmented", (False, True))
def test_mp4(fragmented):
    data = m.mp4(SAMPLES, CONFIG, fragmented)
    got = mp4.read(data)
    t = got["tracks"][0]
    assert [data[o : o + n] for o, n in t["units"]] == SAMPLES
    assert (got["container"], t["codec"], t["width"], t["fps"], t["track_number"], t["bit_depth"], t["nal"]) == ("MP4 (ISOBMFF)", "HEVC", 3840, 24.0, 1, 10, 4)
    assert got["duration_secs"] == pytest.approx(5 / 24) and t["dv_config"]["profile"] == 8 and t["color"]["transfer"].startswith("PQ")
    assert t["bitrate"]["bits_per_sec"] == pytest.approx(sum(map(len, SAMPLES)) * 8 / (5 / 24))


def test_matroska():
    frames = [m.sized(m.hevc_sei(), m.PICTURE), m.sized(m.PICTURE), m.sized(m.PICTURE)]
    data = m.mkv(frames, CONFIG, t35=b"abc")
    got = mkv.read(data)
    t = got["tracks"][0]
    assert [data[o : o + n] for o, n in t["units"]] == frames and [data[o : o + n] for o, n in t["t35"]] == [b"abc"]
    assert (t["track_number"], t["default"], t["fps"], t["bitrate"]["bits_per_sec"], t["content_light"]["max_cll"]) == (1, True, pytest.approx(24.0), 12345.0, 900)
    assert mkv.read(m.mkv(frames, tags=False))["tracks"][0]["bitrate"]["bits_per_sec"] == pytest.approx(sum(map(len, frames)) * 8 / (3 / 24))


@pytest.mark.parametrize("stride", (188, 192))
def test_transport_stream(stride):
    frames = [m.frame(b"\x46\x01\x10", *([m.hevc_sps(), m.hevc_sei()] if i == 0 else []), m.PICTURE + bytes([i + 1]) * 300) for i in range(3)]
    got = ts.read(m.ts(frames, config=CONFIG, stride=stride))
    t = got["tracks"][0]
    assert got["container"] == ("MPEG-2 TS" if stride == 188 else "MPEG-2 TS (M2TS/BDAV)") and got["duration_secs"] == 10.0
    assert [t["stream"][o : o + n] for o, n in t["units"]] == frames
    assert (t["width"], t["track_number"], t["program"], t["dv_config"]["level"]) == (3840, 0x1011, None, 6)


def test_groups_of_programs():
    s = lambda pid, kind=0x24, dovi=False, config=None, base=None: {"pid": pid, "kind": kind, "dovi": dovi, "config": config, "base": base}
    layer = {"bl_present": False}
    made = ts.groups([{"number": 1, "streams": [s(1), s(2), s(3, 6, True, layer, 2)]}])
    assert [([x["pid"] for x in g["streams"]], g["dual"]) for g in made] == [([1], False), ([2, 3], True)]
    made = ts.groups([{"number": 1, "streams": [s(1), s(2)]}, {"number": 2, "streams": [s(9, 0x0F)]}])
    assert [([x["pid"] for x in g["streams"]], g["dual"]) for g in made] == [([1, 2], True)]


def test_nothing_breaks_on_cut_or_damaged_files():
    import random

    rnd = random.Random(7)
    files = {"a.mp4": m.mp4(SAMPLES, CONFIG), "f.mp4": m.mp4(SAMPLES, CONFIG, True), "a.mkv": m.mkv(SAMPLES, CONFIG), "a.ts": m.ts([m.frame(m.hevc_sps(), m.PICTURE)] * 3), "a.hevc": m.hevc_stream(3), "a.ivf": m.ivf(m.av1_frames()), "a.obu": b"".join(m.av1_frames())}
    for name, data in files.items():
        for _ in range(60):
            cut = bytearray(data[: rnd.randrange(len(data))])
            for _ in range(rnd.randrange(3) if cut else 0):
                cut[rnd.randrange(len(cut))] = rnd.randrange(256)
            list(extract.track_rows(name, bytes(cut), True))
            list(extract.finding_rows(name, bytes(cut), True, 16))


def test_dispatch_by_extension_then_content():
    data = m.mkv(SAMPLES)
    assert dispatch.demux("film.mp4", data)["container"] == "Matroska" == dispatch.demux("film", data)["container"]
    with pytest.raises(Unreadable, match="no moov box"):
        dispatch.demux("film.mp4", b"nothing of the kind" * 10)
    row = next(iter(extract.track_rows("x.mkv", b"junk", False)))
    assert row["error"] and row["file"] == "x.mkv"


def test_sample_positions():
    chosen = extract.positions(1101, 16, False, None)
    assert 25 not in chosen and 25 in extract.positions(1101, 16, False, 25) and extract.positions(8, 16, False, None) == list(range(8))
    assert set(extract.positions(1101, 16, False, None)) <= set(extract.positions(1101, 16, True, None))


def test_rpu_facts_and_checksum():
    p = m.rpu([L for L in (m.L2, m.L5, m.L6)], scene=1, el="FEL", more=[m.L8, m.L9, m.L11, m.L254])
    got = rpu_functions.parse(p)
    assert (got["profile"], got["el_type"], got["vdr_bit_depth"], got["dm"]["source_max_pq"], got["dm"]["scene_refresh"]) == (7, "FEL", 12, 3079, 1)
    assert [b["level"] for b in got["dm"]["blocks"]] == [2, 5, 6, 8, 9, 11, 254]
    assert rpu_functions.parse(m.rpu(el="MEL"))["el_type"] == "MEL" and rpu_functions.parse(m.rpu())["el_type"] is None
    assert rpu_functions.parse(p[:30] + bytes([p[30] ^ 1]) + p[31:]) is None
    same, other = (rpu_functions.fingerprint(rpu_functions.parse(m.rpu([m.L6], scene=s))["dm"]) for s in (0, 1))
    assert same == other != rpu_functions.fingerprint(got["dm"])


def test_playlist_choice():
    tick = 45_000
    lists = {"00001.mpls": [("00001", 0, 10 * tick)] * 9, "00002.mpls": [("00002", 0, 100 * tick)], "00003.mpls": [("00002", 0, 100 * tick)], "00004.mpls": [("00009", 0, 900 * tick)], "00005.mpls": [("00003", 0, 100 * tick + tick // 2)]}
    sizes = {"00001": 10, "00002": 50, "00003": 60}
    assert disc.select(lists, sizes) == ("00005.mpls", "00003", 1, 1)
    assert disc.select(lists, sizes | {"00003": 50}) == ("00002.mpls", "00002", 1, 1)
    assert disc.seconds(lists["00001.mpls"]) == 10.0
    item = lambda c, a, b: (lambda body: len(body).to_bytes(2, "big") + body)(c.encode() + b"M2TS" + bytes(3) + a.to_bytes(4, "big") + b.to_bytes(4, "big"))
    raw_list = b"MPLS0200" + (20).to_bytes(4, "big") + bytes(8) + bytes(6) + (2).to_bytes(2, "big") + bytes(2) + item("00001", 0, 45) + item("00002", 1, 46)
    assert disc.playlist(raw_list) == [("00001", 0, 45), ("00002", 1, 46)] and disc.playlist(raw_list[:-1]) == [("00001", 0, 45)]


def udf_image(clips, lists):
    """A plain UDF volume: one partition from sector 300, embedded directories, contiguous files."""
    sectors, free = {}, [310]

    def put(data):
        n = free[0]
        for i in range(0, max(len(data), 1), 2048):
            sectors[free[0]] = data[i : i + 2048]
            free[0] += 1
        return n

    def le(n, v):
        return v.to_bytes(n, "little")

    def entry(data, inline):
        body = data if inline else None
        at = None if inline else put(data)
        ads = body if inline else le(4, len(data)) + le(4, at - 300)
        b = bytearray(176)
        b[0:2], b[34:36], b[56:64], b[172:176] = le(2, 261), le(2, 3 if inline else 0), le(8, len(data)), le(4, len(ads))
        return put(bytes(b) + ads) - 300

    def folder(items):
        raw_dir = b""
        for name, icb, is_dir in items:
            text = b"\x08" + name.encode()
            fid = bytearray(38)
            fid[0:2], fid[18], fid[19], fid[24:28] = le(2, 257), 2 * is_dir, len(text), le(4, icb)
            raw_dir += bytes(fid) + text + bytes(-(38 + len(text)) % 4)
        return entry(raw_dir, True)

    stream = folder([(k, entry(v, False), False) for k, v in clips.items()])
    plists = folder([(k, entry(v, False), False) for k, v in lists.items()])
    root = folder([("BDMV", folder([("PLAYLIST", plists, True), ("STREAM", stream, True)]), True)])
    fsd = bytearray(512)
    fsd[0:2], fsd[404:408] = le(2, 256), le(4, root)
    fsd_at = put(bytes(fsd)) - 300
    anchor, part, vol = bytearray(512), bytearray(512), bytearray(512)
    anchor[0:2], anchor[16:20], anchor[20:24] = le(2, 2), le(4, 3 * 2048), le(4, 260)
    part[0:2], part[188:192] = le(2, 5), le(4, 300)
    vol[0:2], vol[252:256], vol[268:272], vol[440:446] = le(2, 6), le(4, fsd_at), le(4, 1), bytes([1, 6, 1, 0, 0, 0])
    sectors |= {256: bytes(anchor), 260: bytes(part), 261: bytes(vol), 262: le(2, 8)}
    return b"".join(sectors.get(i, b"").ljust(2048, b"\x00") for i in range(free[0] + 1))


def test_disc_image():
    frames = [m.frame(m.hevc_sps(), m.hevc_sei(), m.PICTURE + bytes(300)), m.frame(m.PICTURE + b"\x01" * 400), m.frame(m.PICTURE)]
    clip = m.ts(frames * 4, stride=192)
    item = b"00001M2TS" + bytes(3) + (0).to_bytes(4, "big") + (450_000).to_bytes(4, "big")
    plist = b"MPLS0200" + (20).to_bytes(4, "big") + bytes(8) + bytes(6) + (1).to_bytes(2, "big") + bytes(2) + len(item).to_bytes(2, "big") + item
    image = udf_image({"00001.m2ts": clip}, {"00800.mpls": plist})
    got = dispatch.demux("film.iso", image)
    assert got["bd_iso"] == {"playlist": "00800.mpls", "playlist_duration_secs": 10.0, "clip": "00001.m2ts", "clip_index": 1, "clip_count": 1}
    assert got["tracks"][0]["width"] == 3840 and disc.is_image(image)
    for n in range(0, len(image), 30_000):
        list(extract.track_rows("film.iso", image[:n], False))


XML = """<?xml version="1.0"?><DolbyLabsMDF version="4.0.2"><Outputs><Output><Video><Track><Rate><n>24000</n><d>1001</d></Rate><Level0><MasteringDisplay><PeakBrightness>1000</PeakBrightness><MinimumBrightness>0.0001</MinimumBrightness>
<Primaries><Red>0.68,0.32</Red><Green>0.265,0.69</Green><Blue>0.15,0.06</Blue></Primaries><WhitePoint>0.3127,0.329</WhitePoint></MasteringDisplay></Level0>
<Shot><Record><In>0</In><Duration>10</Duration></Record></Shot><Shot><Record><In>10</In><Duration>5</Duration></Record><Frame><EditOffset>2</EditOffset></Frame></Shot></Track></Video></Output></Outputs></DolbyLabsMDF>"""


def test_sidecars():
    got = sidecar.dv_xml(XML.encode())
    assert (got["version"], got["fps"], got["cm_version"]) == ("4.0.2", 24000 / 1001, "CM v4.0")
    assert got["mastering"] == {"max_luminance": 1000.0, "min_luminance": 0.0001, "primaries": "DCI-P3 D65", "primaries_level": 0}
    assert (got["rpu_count"], got["scene_cuts"], got["frame_pairs"], got["changed_pairs"]) == (15, 2, 14, 2)
    assert [(n, s) for _, n, s in got["runs"]] == [(10, True), (2, True), (1, False), (2, False)]
    text = json.dumps({"JSONInfo": {"HDR10plusProfile": "B", "Version": "1.0"}, "SceneInfo": [{"NumberOfWindows": 1, "TargetedSystemDisplayMaximumLuminance": 400, "x": "}"}, {"NumberOfWindows": 3}]})
    assert sidecar.kind("a.json", text.encode()) == "json" and sidecar.kind("a.txt", text.encode()) is None
    assert sidecar.hdr10plus_json(text.encode()) == {"profile": "B", "application_version": 1, "num_windows": 1, "target_max_luminance": 400}
    with pytest.raises(Unreadable):
        sidecar.hdr10plus_json(text[:90].encode())
    unit = m.START + b"\x7c\x01" + m.escaped(m.rpu([m.L6]))
    other = m.START + b"\x7c\x01" + m.escaped(m.rpu([m.L5]))
    runs = sidecar.rpu_runs(unit * 3 + other + unit)
    assert [n for _, n in runs] == [3, 1, 1] and sidecar.kind("a.bin", unit) == "rpu"


def test_windows_change_nothing():
    import random

    from nitscope.functions import bits

    rnd = random.Random(8)
    for _ in range(300):
        data = bytes(rnd.choice((0, 0, 0, 1, 2, 65)) for _ in range(rnd.randrange(60)))
        for window in (1, 2, 3, 7, 100):
            assert list(raw.spans(data, window)) == list(bits.annexb(data)), (data, window)
    for _ in range(200):
        data = b"".join(m.obu(rnd.choice((1, 2, 5, 6)), bytes(rnd.randrange(40))) for _ in range(rnd.randrange(6)))
        cut = data[: rnd.randrange(len(data) + 1)]
        assert list(raw.unit_heads(cut, len(cut))) == [(k, a) for k, a, _, _ in bits.obus(cut)]


def test_walks_give_the_units_of_the_lists():
    frames = [m.frame(m.PICTURE + bytes([i + 1]) * 300) for i in range(5)]
    data = m.ts(frames, config=CONFIG)
    first, stride = ts.layout(data)
    got = list(ts.walk(data, first, stride, [[0x1011]]))
    assert [u for _, u in got] == frames == [b for raw_bytes, units in ts.streams(data, first, stride, [[0x1011]], None) for b in (raw_bytes[o : o + n] for o, n in units)]
    blocks = [m.sized(m.hevc_sei(), m.PICTURE), m.sized(m.PICTURE), m.sized(m.PICTURE)]
    film = m.mkv(blocks, CONFIG, t35=b"abc")
    whole, head = mkv.read(film, True), mkv.read(film)
    assert [(what, film[o : o + n]) for _, what, o, n in whole["walk"]()] == [("block", b) for b in blocks] + [("t35", b"abc")]
    same = ("fps", "bitrate", "track_number", "width")
    assert [whole["tracks"][0][k] for k in same] == [head["tracks"][0][k] for k in same] and whole["tracks"][0]["units"] == []
    for name, given in (("a.ts", data), ("a.mkv", film), ("a.hevc", m.hevc_stream(5)), ("a.mp4", m.mp4(SAMPLES, CONFIG))):
        rows = list(extract.scan(name, given, True, 16))
        few = list(extract.scan(name, given, False, 1000))
        assert [r for k, r in rows if k == "finding"] == [r for k, r in few if k == "finding"]
        assert [r["units"] for k, r in rows if k == "track"] == [r["units"] for k, r in few if k == "track"]


def test_memory_of_a_walk_does_not_grow():
    import tracemalloc

    peaks = []
    for n in (200, 2000):
        data = m.ts([m.frame(m.PICTURE + bytes([7]) * 1500)] * n)
        tracemalloc.start()
        assert sum(1 for _ in ts.walk(data, *ts.layout(data), [[0x1011]])) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_runs_without_sizes_are_as_long_as_the_file_allows():
    from nitscope.plans import samples

    entry = samples.sample_entry(samples.hevc_sps(640, 480), 640, 480, 10, 16, None)
    units = [m.sized(m.PICTURE)] * 50
    data = samples.fragmented_mp4(entry, [units], "track")
    assert len(mp4.read(data)["tracks"][0]["units"]) == 50
    at = data.index(b"trun") + 8
    claimed = data[:at] + (1 << 31).to_bytes(4, "big") + data[at + 4 :]
    assert len(mp4.read(claimed)["tracks"][0]["units"]) == 50


def test_dumps_are_dealt_over_tasks_however_small_their_table_is(spark, monkeypatch):
    monkeypatch.setattr(files, "ROWS", 100)
    df = files.rpu_dumps(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert df.count() == n and df.rdd.getNumPartitions() == -(-n // 100) > 1


def test_checksums_and_codes_match_the_plain_loops():
    rnd = random.Random(8)
    for n in (0, 1, 2, 3, 4, 31, 300):
        data = rnd.randbytes(n)
        assert rpu_functions.crc32_mpeg(data) == m.crc32_mpeg(data)
    for n in (0, 1, 3, 6, 300):
        data = bytes(rnd.choice((0, 0, 0, 1, 128, 255)) for _ in range(n))
        ones = [c == "1" for b in data for c in f"{b:08b}"]
        for at in range(len(ones) + 1):
            b = bits.Bits(data)
            b.skip(at)
            want = ones.index(True, at) - at if any(ones[at : at + 32]) else None
            try:
                got = b._zeros(31)
                assert b.at == at + got + 1
            except bits.Short:
                got = None
            assert got == want
