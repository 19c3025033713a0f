"""Whole inputs as queries: every row's file is put together from table values, read by the engine as any other, and must
give the values back, which the SQL twin reads off the table."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from nitscope.functions import bits, headers, sei
from nitscope.functions import rpu as rpu_functions
from nitscope.operators import ordered
from nitscope.plans import probe, progress, render, samples
from nitscope.runtime import scan_tasks, table
from nitscope.sources import disc, dispatch, extract, mp4, raw, reader, sidecar
from nitscope.sources.model import Unreadable

#: Rows of a task that puts together and reads a file for each.
ROWS = 20_000
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def over(df: DataFrame, keys: str, ddl: str, make: Callable[..., dict]) -> DataFrame:
    """The first of `keys` and the fields of `ddl`: what `make` says of the values of the key columns."""
    names = keys.split()
    schema = StructType.fromDDL(f"{names[0]} {df.schema[names[0]].dataType.simpleString()}, {ddl}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                said = make(*values)
                rows.append({f.name: said.get(f.name) for f in arrow} | {names[0]: values[0]})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.select(*names).mapInArrow(run, schema)


def dealt(df: DataFrame) -> DataFrame:
    """The rows in tasks of about `ROWS` each: a file of a few MB, which is one task to Spark, may hold a million."""
    return df.repartition(scan_tasks(df.sparkSession, df.count(), ROWS))


def parts(spark, sf_dir, ddl: str, make: Callable[[int, int], dict]) -> DataFrame:
    return over(table(spark, sf_dir, "part"), "p_partkey p_size", ddl, make)


def _first(media: dict) -> tuple[dict, dict]:
    """The file's facts and those of its first track, in one dict, and the track."""
    t = media["tracks"][0]
    said = {"container": media["container"], "duration_secs": media["duration_secs"], "units": len(t["units"]), "bytes": sum(n for _, n in t["units"])}
    said |= {k: t[k] for k in ("codec", "width", "height", "bit_depth", "chroma", "fps", "dual_track", "track_number")} | {"transfer": t["color"]["transfer"], "matrix": t["color"]["matrix"]}
    config = t["dv_config"] or {}
    return said | {"dv_profile": config.get("profile"), "dv_level": config.get("level"), "bits_per_sec": (t["bitrate"] or {}).get("bits_per_sec"), "scope": (t["bitrate"] or {}).get("scope")}, t


def picture(fill: int, n: int) -> bytes:
    return samples.PICTURE + bytes([fill % 256]) * n


PQ, HLG = "PQ (SMPTE ST 2084)", "HLG (ARIB STD-B67)"


@query(f"""
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'QuickTime (MOV)' ELSE 'MP4 (ISOBMFF)' END AS container, 'HEVC' AS codec, CAST(1280 + 8 * p_size AS BIGINT) AS width, CAST(720 AS BIGINT) AS height,
    CAST(8 + 2 * (p_partkey % 2) AS INTEGER) AS bit_depth, CASE WHEN p_partkey % 3 = 0 THEN '{HLG}' ELSE '{PQ}' END AS transfer, n AS units, n * (8 + p_partkey % 50) + n * (n - 1) // 2 AS bytes, 24.0::DOUBLE AS fps, n / 24.0::DOUBLE AS duration_secs,
    CASE WHEN p_partkey % 4 = 0 THEN CAST(1 + p_partkey % 9 AS INTEGER) END AS dv_level, (n * (8 + p_partkey % 50) + n * (n - 1) // 2) * 8 / (n / 24.0::DOUBLE) AS bits_per_sec, 'video_stream' AS scope
    FROM (SELECT *, CAST(1 + p_size % 6 AS BIGINT) AS n FROM part)""")
def mp4_files(spark, sf_dir):
    """SRC-04, SRC-05, SRC-06, FN-19, AGG-15: boxes, sample entries, sample tables, rates of MP4 and QuickTime files."""

    def make(k, s):
        width, depth = 1280 + 8 * s, 8 + 2 * (k % 2)
        entry = samples.sample_entry(samples.hevc_sps(width, 720, depth), width, 720, depth, 16 if k % 3 else 18, samples.dv_record(8, 1 + k % 9) if k % 4 == 0 else None)
        units = [samples.with_sizes(picture(i, k % 50 + i)) for i in range(1 + s % 6)]
        return _first(dispatch.demux("film.mp4", samples.mp4([{"entry": entry, "samples": units}], brand=b"qt  " if k % 5 == 0 else b"isom")))[0]

    return parts(spark, sf_dir, "container string, codec string, width long, height long, bit_depth int, transfer string, units long, bytes long, fps double, duration_secs double, dv_level int, bits_per_sec double, scope string", make)


@query("""
    SELECT p_partkey, n + 2 AS units, CASE WHEN p_partkey % 3 = 0 THEN n * 9 + n * (n - 1) // 2 + 19 ELSE (n + 2) * 9 END AS bytes, (n + 2) / 24.0::DOUBLE AS duration_secs, 24.0::DOUBLE AS fps, CAST((p_partkey + 1) % 256 AS INTEGER) AS last_byte
    FROM (SELECT *, CAST(1 + p_size % 4 AS BIGINT) AS n FROM part)""")
def mp4_fragments(spark, sf_dir):
    """SRC-07: two fragments, with sizes from the run, the fragment's header or the track's defaults."""

    def make(k, s):
        by = ("run", "head", "track")[k % 3]
        first = [samples.with_sizes(picture(k, 1 + i * (by == "run"))) for i in range(1 + s % 4)]
        second = [samples.with_sizes(picture(k + 1, 1 + i * (by == "run"))) for i in range(2)]
        entry = samples.sample_entry(samples.hevc_sps(1920, 1080), 1920, 1080, 10, 16, None)
        data = samples.fragmented_mp4(entry, [first, second], by)
        said, t = _first(dispatch.demux("film.mp4", data))
        o, n = t["units"][-1]
        return said | {"last_byte": data[o + n - 1]}

    return parts(spark, sf_dir, "units long, bytes long, duration_secs double, fps double, last_byte int", make)


@query("""
    SELECT p_partkey, CAST(1 AS INTEGER) AS tracks, p_partkey % 4 > 0 AS dual_track, CASE WHEN p_partkey % 4 > 0 THEN 2 * n ELSE n END AS units, CASE WHEN p_partkey % 4 > 0 THEN CAST(7 AS INTEGER) END AS dv_profile,
    CASE WHEN p_partkey % 4 > 0 THEN CAST((p_partkey + 7) % 256 AS INTEGER) END AS first_of_layer
    FROM (SELECT *, CAST(1 + p_size % 5 AS BIGINT) AS n FROM part)""")
def mp4_layers(spark, sf_dir):
    """JOIN-01, SET-02: a second track without a base layer is folded into the first; its units come after the base's."""

    def make(k, s):
        n = 1 + s % 5
        entry = lambda config: samples.sample_entry(samples.hevc_sps(3840, 2160), 3840, 2160, 10, 16, config)
        tracks = [{"entry": entry(None), "samples": [samples.with_sizes(picture(k, 5))] * n}]
        if k % 4:
            tracks.append({"entry": entry(samples.dv_record(7, 6, el=True, bl=False)), "samples": [samples.with_sizes(picture(k + 7, 9))] * n})
        data = samples.mp4(tracks)
        media = dispatch.demux("film.mp4", data)
        said, t = _first(media)
        o, size = t["units"][n] if len(t["units"]) > n else (0, 0)
        return said | {"tracks": len(media["tracks"]), "first_of_layer": data[o + size - 1] if size else None}

    return parts(spark, sf_dir, "tracks int, dual_track boolean, units long, dv_profile int, first_of_layer int", make)


@query(f"""
    SELECT p_partkey, 'Matroska' AS container, CAST(1280 + 8 * p_size AS BIGINT) AS width, CASE WHEN p_partkey % 3 = 0 THEN '{HLG}' ELSE '{PQ}' END AS transfer, CAST(100 + p_size AS INTEGER) AS max_cll, n AS units, CAST(n * (4 + p_partkey % 40) AS BIGINT) AS bytes, 25.0::DOUBLE AS fps, n / 25.0::DOUBLE AS duration_secs,
    CASE WHEN p_partkey % 2 = 0 THEN CAST(1 + p_size % 9 AS INTEGER) END AS dv_level, CASE WHEN p_partkey % 7 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS payloads,
    CASE p_partkey % 3 WHEN 0 THEN n * (4 + p_partkey % 40) * 8 / (n / 25.0::DOUBLE) WHEN 1 THEN CAST(1000 + p_partkey AS DOUBLE) ELSE (1000 + p_partkey) * 8 / (n / 25.0::DOUBLE) END AS bits_per_sec
    FROM (SELECT *, CAST(2 + p_size % 5 AS BIGINT) AS n FROM part)""")
def mkv_files(spark, sf_dir):
    """SRC-09 to SRC-13: segments with and without sizes of clusters, track entries, colour, laced blocks, additions of the
    right kind, statistics behind a seek head."""

    def make(k, s):
        n, uid = 2 + s % 5, (1 << 63) + k
        entry = samples.track_entry(uid, 1280 + 8 * s, 720, samples.hevc_sps(1920, 1080, code=(2, 2, 2)), 16 if k % 3 else 18, 100 + s, samples.dv_record(8, 1 + s % 9) if k % 2 == 0 else None)
        blocks = [samples.simple_block(1, picture(i, k % 40)) for i in range(n - 1)]
        blocks += [samples.simple_block(1, b"laced", laced=True), samples.simple_block(2, b"other")] * (k % 4 == 0)
        blocks.append(samples.block_with_addition(1, picture(9, k % 40), 4 if k % 7 == 0 else 1, b"payload"))
        tags = [samples.statistics(uid - 1, b"BPS", 7)] + [samples.statistics(uid, b"BPS" if k % 3 == 1 else b"NUMBER_OF_BYTES", 1000 + k)] if k % 3 else []
        said, t = _first(dispatch.demux("film.mkv", samples.mkv(entry, [blocks[:1], blocks[1:]], n / 25, tags, unknown=k % 5 == 0)))
        return said | {"max_cll": t["content_light"]["max_cll"], "payloads": len(t["t35"])}

    return parts(spark, sf_dir, "container string, width long, transfer string, max_cll int, units long, bytes long, fps double, duration_secs double, dv_level int, payloads long, bits_per_sec double", make)


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'MPEG-2 TS' ELSE 'MPEG-2 TS (M2TS/BDAV)' END AS container, CAST(1 + p_size AS DOUBLE) AS duration_secs, CASE WHEN p_partkey % 3 = 0 THEN 2 * n + 1 ELSE n + 1 END AS units,
    CAST(208 + p_partkey % 300 AS BIGINT) AS last_size, p_partkey % 3 = 0 AS dual_track, CAST(4113 AS BIGINT) AS track_number, CASE WHEN p_partkey % 3 = 0 THEN CAST(7 AS INTEGER) WHEN p_partkey % 4 = 1 THEN CAST(8 AS INTEGER) END AS dv_profile, CAST(1280 + 8 * p_size AS BIGINT) AS width
    FROM (SELECT *, CAST(1 + p_size % 5 AS BIGINT) AS n FROM part)""")
def ts_files(spark, sf_dir):
    """SRC-14, SRC-15, SRC-16, JOIN-04, WIN-05: packets of both strides, tables, descriptors that name a base, units put
    together, seconds by the clock."""

    def make(k, s):
        pictures = [samples.with_codes(picture(i, 200 + k % 300)) for i in range(1 + s % 5)]
        layer = (pictures, samples.dv_record(7, 6, el=True, bl=False, base_pid=samples.BASE_PID)) if k % 3 == 0 else None
        config = samples.dv_record(8, 6) if k % 4 == 1 and not layer else None
        data = samples.ts([samples.with_codes(samples.hevc_sps(1280 + 8 * s, 720)), *pictures], 1 + s, config, layer, 192 if k % 2 else 188)
        said, t = _first(dispatch.demux("film.m2ts", data))
        return said | {"last_size": t["units"][-1][1]}

    return parts(spark, sf_dir, "container string, duration_secs double, units long, last_size long, dual_track boolean, track_number long, dv_profile int, width long", make)


@query("SELECT p_partkey, 'raw HEVC (Annex-B)' AS container, CAST(1280 + 8 * p_size AS BIGINT) AS width, CAST(8 + 2 * (p_partkey % 2) AS INTEGER) AS bit_depth, CAST(20 + p_size % 30 AS DOUBLE) AS fps, CAST(1 + p_size % 7 AS BIGINT) AS units, CAST(p_partkey % 60000 AS INTEGER) AS max_cll, CAST(0 AS INTEGER) AS pinned FROM part")
def annexb_files(spark, sf_dir):
    """SRC-17, WIN-03, FN-14: raw HEVC: parameter sets and access units, the findings of the first."""

    def make(k, s):
        head = samples.with_codes(samples.PARAMETERS, samples.hevc_sps(1280 + 8 * s, 720, 8 + 2 * (k % 2), fps=(20 + s % 30, 1)), b"\x44\x01\xc1", samples.light(k % 60000, 1), samples.PICTURE)
        data = head + samples.with_codes(*[samples.PICTURE] * (s % 7))
        said, t = _first(dispatch.demux("film.hevc", data))
        o, n = t["units"][0]
        return said | {"pinned": t["pinned"], "max_cll": extract.look(data[o : o + n], "HEVC", 0)[0]["content_light"]["max_cll"]}

    return parts(spark, sf_dir, "container string, width long, bit_depth int, fps double, units long, max_cll int, pinned int", make)


@query("""
    SELECT p_partkey, 'raw VP9 (IVF)' AS container, CAST(100 + p_size AS BIGINT) AS width, CAST(50 + p_partkey % 1000 AS BIGINT) AS height, CAST(CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 10 END AS INTEGER) AS bit_depth, CASE WHEN p_partkey % 3 = 0 THEN 'BT.709' ELSE 'BT.2020 NCL' END AS matrix, CAST(3 AS BIGINT) AS units, 30.0::DOUBLE AS fps FROM part""")
def vp9_files(spark, sf_dir):
    """SRC-19, FN-18: VP9 in IVF: the first key frame among the first frames says what the file's head does not."""

    def make(k, s):
        key = samples.vp9_key_frame(100 + s, 50 + k % 1000, 2 * (k % 2), 2 if k % 3 == 0 else 5)
        return _first(dispatch.demux("film.ivf", samples.ivf([b"\x86\x00\x40\x92", key, b"\x86\x00"], b"VP90", 8, 8, 30)))[0]

    return parts(spark, sf_dir, "container string, width long, height long, bit_depth int, matrix string, units long, fps double", make)


@query("""
    SELECT p_partkey, CAST(16 + p_size AS BIGINT) AS width, CAST(16 + p_partkey % 4000 AS BIGINT) AS height, CAST(CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 10 END AS INTEGER) AS hevc_depth, CAST(1 + p_size AS DOUBLE) AS hevc_fps,
    CAST(16 * (1 + p_size) AS BIGINT) AS avc_width, CAST(16 * (1 + p_partkey % 200) AS BIGINT) AS avc_height, 'High @ L4' AS avc_profile, CAST(16 + p_size AS BIGINT) AS av1_width, CAST(2 + p_partkey % 58 AS DOUBLE) AS av1_fps, CAST(10 AS INTEGER) AS av1_depth, true AS same_after_cut FROM part""")
def parameter_sets(spark, sf_dir):
    """FN-13, FN-16, FN-17: HEVC, AVC and AV1 parameter sets, with emulation prevention; one that is cut off says nothing or
    the same."""

    def make(k, s):
        hevc = samples.hevc_sps(16 + s, 16 + k % 4000, 10 if k % 2 else 8, fps=(1 + s, 1))
        a, b, c = headers.hevc_sps(hevc), headers.avc_sps(samples.avc_sps(1 + s, 1 + k % 200)), headers.av1_sequence(samples.av1_sequence(16 + s, 16, fps=2 + k % 58))
        cut = headers.hevc_sps(hevc[: k % len(hevc)])
        return {"width": a["width"], "height": a["height"], "hevc_depth": a["bit_depth"], "hevc_fps": a["fps"], "avc_width": b["width"], "avc_height": b["height"], "avc_profile": b["profile"], "av1_width": c["width"], "av1_fps": c["fps"], "av1_depth": c["bit_depth"], "same_after_cut": cut is None or cut["width"] == a["width"]}

    return parts(spark, sf_dir, "width long, height long, hevc_depth int, hevc_fps double, avc_width long, avc_height long, avc_profile string, av1_width long, av1_fps double, av1_depth int, same_after_cut boolean", make)


@query("""
    SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 8 + 2 * (p_size % 2) WHEN 1 THEN 8 ELSE 10 END AS INTEGER) AS bit_depth, '4:2:0' AS chroma, CASE WHEN p_partkey % 3 < 2 THEN CAST(4 AS INTEGER) END AS nal_length,
    CASE p_partkey % 3 WHEN 0 THEN 16 + p_size WHEN 1 THEN 16 * (1 + p_size) ELSE 16 + p_size END AS width FROM part""")
def config_records(spark, sf_dir):
    """FN-19: HEVC, AVC and AV1 configuration records and the parameter sets in them."""

    def make(k, s):
        depth = 8 + 2 * (s % 2)
        if k % 3 == 0:
            said = headers.hevc_config(samples.hvcc(samples.hevc_sps(16 + s, 16, depth), depth))
        elif k % 3 == 1:
            said = headers.avc_config(samples.avcc(samples.avc_sps(1 + s, 2)))
        else:
            said = headers.av1_config(samples.av1c(samples.av1_sequence(16 + s, 16), 13))
        return {"bit_depth": said["bit_depth"], "chroma": said["chroma"], "nal_length": said.get("nal_length"), "width": said["sps"]["width"]}

    return parts(spark, sf_dir, "bit_depth int, chroma string, nal_length int, width int", make)


@query("SELECT p_partkey, printf('%06X%08X%04X%06X', p_partkey % 5, p_partkey % 3, p_size % 4, p_partkey) AS payload, true AS no_code FROM part")
def emulation(spark, sf_dir):
    """FN-13: payloads with many zeros, guarded and read again; guarded they hold no start code."""

    def make(k, s):
        given = samples.number(3, k % 5) + samples.number(4, k % 3) + samples.number(2, s % 4) + samples.number(3, k)
        guarded = samples.guarded(given)
        return {"payload": bits.rbsp(guarded).hex().upper(), "no_code": all(guarded.find(bytes([0, 0, i])) < 0 for i in range(3))}

    return parts(spark, sf_dir, "payload string, no_code boolean", make)


@query("""
    SELECT p_partkey, CASE WHEN ok THEN CAST(CASE WHEN p_partkey % 3 > 0 THEN 7 ELSE 8 END AS INTEGER) END AS profile, CASE WHEN ok AND p_partkey % 3 > 0 THEN CASE p_partkey % 3 WHEN 1 THEN 'FEL' ELSE 'MEL' END END AS el_type, CASE WHEN ok THEN CAST(p_size % 2 AS INTEGER) END AS scene_refresh,
    CASE WHEN ok THEN CAST(p_size AS INTEGER) END AS source_min_pq, CASE WHEN ok THEN CAST(2000 + p_partkey % 2000 AS INTEGER) END AS source_max_pq, CASE WHEN ok THEN CAST(500 + p_size AS INTEGER) END AS max_cll
    FROM (SELECT *, p_partkey % 7 > 0 AS ok FROM part)""")
def rpu_payloads(spark, sf_dir):
    """FN-23: RPU payloads in HEVC units; one with a wrong checksum says nothing."""

    def make(k, s):
        payload = samples.rpu(s, 2000 + k % 2000, s % 2, 1000 + 2 * s, (None, "FEL", "MEL")[k % 3], sound=k % 7 > 0)
        row = extract.rpu_row(rpu_functions.from_hevc(samples.rpu_unit(payload)))
        return row | {"max_cll": next(b["max_cll"] for b in row["blocks"] if b["level"] == 6)} if row else {}

    return parts(spark, sf_dir, "profile int, el_type string, scene_refresh int, source_min_pq int, source_max_pq int, max_cll int", make)


@query("SELECT p_partkey, CAST(3 AS BIGINT) AS runs, CAST(3 + p_partkey % 4 + p_size % 3 AS BIGINT) AS frames, CAST(1 + p_partkey % 4 AS BIGINT) AS first_run FROM part")
def rpu_dumps(spark, sf_dir):
    """SRC-24, WIN-02: dumps of RPUs: equal neighbours are parsed once and weigh as many frames."""
    one, other = (samples.START + samples.rpu_unit(samples.rpu(7, 3079, peak=p)) for p in (1000, 4000))

    def make(k, s):
        rows = list(extract.finding_rows("dump.rpu", one * (1 + k % 4) + other * (1 + s % 3) + one, True, 16))
        return {"runs": len(rows), "frames": sum(r["weight"] for r in rows), "first_run": rows[0]["weight"]}

    return over(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")), "p_partkey p_size", "runs long, frames long, first_run long", make)


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'rpu' WHEN 1 THEN 'rpu' WHEN 3 THEN 'xml' WHEN 5 THEN 'json' END AS kind, p_partkey % 8 IN (0, 1, 3, 5, 7) AS collected FROM part")
def sidecar_kinds(spark, sf_dir):
    """SRC-23, SRC-01: what stands beside videos, by extension and by content; and what a folder gives to a run."""
    cases = (("a.RPU", b"anything"), ("a.bin", samples.START + b"\x7c\x01\x19"), ("a.bin", b"none"), ("a.xml", b"<?xml?><DolbyLabsMDF>"), ("a.xml", b"<html>"), ("b.c.json", b'{"JSONInfo":1,"SceneInfo":2'), ("json", b'{"JSONInfo":1,"SceneInfo":2'), ("film.MKV", b""))
    return parts(spark, sf_dir, "kind string, collected boolean", lambda k, s: {"kind": sidecar.kind(*cases[k % 8]), "collected": reader.collected(*cases[k % 8])})


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Matroska' WHEN 1 THEN 'Matroska' WHEN 2 THEN 'raw AV1 (OBU)' WHEN 3 THEN 'raw HEVC (Annex-B)' END AS container, CASE p_partkey % 6 WHEN 4 THEN 'no moov box' WHEN 5 THEN 'not a known format' END AS error FROM part""")
def dispatched(spark, sf_dir):
    """SRC-02, SRC-03, PRJ-05: by extension, else by content; the first error stands where neither reads the input."""
    mkv = lambda s: samples.mkv(samples.track_entry(1, 640, 480, samples.hevc_sps(640, 480), 16, 1, None), [[samples.simple_block(1, picture(s, s))]], 1)
    av1 = samples.obu(2, b"") + samples.obu(1, samples.av1_sequence(64, 64))

    def make(k, s):
        name, data = (("film.mkv", mkv(s)), ("film.mp4", mkv(s)), ("film", av1), ("film.x", samples.with_codes(samples.hevc_sps(64, 64), samples.PICTURE)), ("film.mp4", b"nothing" * s), ("film.txt", b"nothing" * s))[k % 6]
        try:
            return {"container": dispatch.demux(name, data)["container"]}
        except Unreadable as e:
            return {"error": str(e)}

    return parts(spark, sf_dir, "container string, error string", make)


@query("""
    SELECT p_partkey, CAST(n AS INTEGER) AS items, CASE least(n, 3) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 3.0 ELSE 6.0 END AS secs
    FROM (SELECT *, 1 + p_size % 5 - CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS n FROM part)""")
def play_lists(spark, sf_dir):
    """SRC-22, AGG-14: items of playlists, looped ones counted once; a damaged tail keeps what came before it."""

    def make(k, s):
        items = disc.playlist(samples.play_list([(f"{i % 3:05d}", 10, 10 + 45_000 * (1 + i % 3)) for i in range(1 + s % 5)], 5 if k % 4 == 0 else 0))
        return {"items": len(items), "secs": disc.seconds(items)}

    return parts(spark, sf_dir, "items int, secs double", make)


@query("""
    SELECT n_nationkey, '00801.mpls' AS playlist, 100.0 + n_nationkey AS secs, '00002.m2ts' AS clip, CAST(2 AS BIGINT) AS clip_index, CAST(2 AS BIGINT) AS clip_count, CAST(1280 + 8 * n_nationkey AS BIGINT) AS width, CAST(3 + n_nationkey % 4 AS BIGINT) AS units FROM nation""")
def disc_images(spark, sf_dir):
    """SRC-20, SRC-21, JOIN-08, TOPK-04: images with plain and metadata partitions; the main playlist among a loop, one with
    a missing clip and a shorter one; its largest clip."""

    def make(k):
        stream = lambda n, w: samples.ts([samples.with_codes(samples.hevc_sps(w, 720)), *[samples.with_codes(picture(1, 300))] * n], 5, stride=192)
        clips, tick = {"00001.m2ts": stream(1, 640), "00002.m2ts": stream(2 + k % 4, 1280 + 8 * k)}, 45_000
        lists = {"00800.mpls": [("00001", 0, 10 * tick)] * 20, "00801.mpls": [("00001", 0, 50 * tick), ("00002", 0, (50 + k) * tick)], "00802.mpls": [("00009", 0, 999 * tick)], "00803.mpls": [("00002", 0, 9 * tick)]}
        got = dispatch.demux("film.iso", samples.disc(clips, {n: samples.play_list(i) for n, i in lists.items()}, metadata=k % 2 == 1))
        b = got["bd_iso"]
        return {"playlist": b["playlist"], "secs": b["playlist_duration_secs"], "clip": b["clip"], "clip_index": b["clip_index"], "clip_count": b["clip_count"]} | {k2: v for k2, v in _first(got)[0].items() if k2 in ("width", "units")}

    return over(table(spark, sf_dir, "nation"), "n_nationkey", "playlist string, secs double, clip string, clip_index long, clip_count long, width long, units long", make)


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN CAST(700 + p_size AS INTEGER) END AS max_cll, CAST(CASE WHEN p_partkey % 5 = 2 THEN 1 ELSE 0 END AS INTEGER) AS rpus FROM part""")
def unit_gate(spark, sf_dir):
    """PRJ-03: of an access unit only messages and RPU units are read, by their types and first bytes."""

    def make(k, s):
        message = samples.light(700 + s, 1)[2:]
        unit = (b"\x4e\x01" + message, b"\x50\x01" + message, samples.rpu_unit(samples.rpu(7, 3079)), b"\x26\x01" + message, b"\x7c\x01" + b"\x18" + samples.rpu(7, 3079)[1:])[k % 5]
        found, rpus = extract.look(samples.with_sizes(samples.PICTURE, unit), "HEVC", 4)
        return {"max_cll": (found["content_light"] or {}).get("max_cll"), "rpus": len(rpus)}

    return parts(spark, sf_dir, "max_cll int, rpus int", make)


@query("""
    SELECT p_partkey, CAST(1 AS INTEGER) AS application_version, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS profile, CASE WHEN p_partkey % 2 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(100 + p_size AS BIGINT) END AS target_max_luminance FROM part""")
def hdr10plus_payloads(spark, sf_dir):
    """FN-22: HDR10+ payloads with and without curve and target."""

    def make(k, s):
        curve = [(1, 1), (24, 0), (4, 2), (20, 0)] if k % 2 else [(1, 0)]
        w = samples.Bits((8, 4), (8, 1), (2, 1), (27, 100 + s if k % 2 else 0), (1, 0), (51, 0), (17, 0), (4, 1), (24, 0), (10, 0), (1, 0), *curve, (1, 0))
        return sei.hdr10plus(b"\xb5\x00\x3c\x00\x01" + w.stopped())

    return parts(spark, sf_dir, "application_version int, profile string, target_max_luminance long", make)


# ---- reports


def films(spark, sf_dir) -> DataFrame:
    """(file, content), one for each nation: raw HEVC with messages and RPUs, or an MP4 with a configuration and none."""
    nations = table(spark, sf_dir, "nation")

    def make(k):
        sps = samples.hevc_sps(3840, 2160)
        if k % 2:
            entry = samples.sample_entry(sps, 3840, 2160, 10, 16, samples.dv_record(8, 6))
            return {"file": f"film{k}.mp4", "content": samples.mp4([{"entry": entry, "samples": [samples.with_sizes(samples.light(1000 + k, 400), picture(1, 9))] * 3}])}
        head = samples.with_codes(samples.PARAMETERS, sps, b"\x44\x01\xc1", samples.light(1000 + k, 400))
        return {"file": f"film{k}.hevc", "content": head + b"".join(samples.with_codes(samples.PICTURE, samples.rpu_unit(samples.rpu(7, 3079, peak=1000 + 2 * k))) for _ in range(2 + k % 3))}

    return over(nations, "n_nationkey", "file string, content binary", make).select("file", "content")


_FILM = "'film' || n_nationkey || CASE WHEN n_nationkey % 2 = 1 THEN '.mp4' ELSE '.hevc' END"


@query(f"""
    SELECT {_FILM} AS file, '2.4' AS schema_version, CASE WHEN n_nationkey % 2 = 1 THEN 'MP4 (ISOBMFF)' ELSE 'raw HEVC (Annex-B)' END AS container, CAST(1 AS INTEGER) AS tracks, 'HEVC' AS codec, CAST(3840 AS BIGINT) AS width, CAST(1000 + n_nationkey AS INTEGER) AS max_cll,
    '8.1' AS dv_profile, CASE WHEN n_nationkey % 2 = 1 THEN CAST(0 AS BIGINT) ELSE CAST(2 + n_nationkey % 3 AS BIGINT) END AS rpu_count, CASE WHEN n_nationkey % 2 = 0 THEN CAST(1000 + 2 * n_nationkey AS INTEGER) END AS l6_max_mastering,
    CASE WHEN n_nationkey % 2 = 0 THEN 'CM v2.9' END AS cm_version FROM nation""")
def media_reports(spark, sf_dir):
    """FN-24, SRC-28, AGG-10, PRJ-05: reports of files, from their bytes to nested rows."""
    report, _ = probe.probe_bytes(films(spark, sf_dir))
    t = F.get("video_tracks", F.lit(0))
    dv = t["dolby_vision"]
    return report.select("file", "schema_version", "container", F.size("video_tracks").alias("tracks"), t["codec"].alias("codec"), t["width"].alias("width"), t["hdr"]["content_light"]["max_cll"].alias("max_cll"), dv["profile"].alias("dv_profile"), dv["rpu_count"].alias("rpu_count"), dv["l6"]["max_mastering"].alias("l6_max_mastering"), dv["cm_version"].alias("cm_version"))


@query(f"""
    SELECT {_FILM} AS file, '2.4' AS schema_version, '3840' AS width, CAST(1000 + n_nationkey AS VARCHAR) AS max_cll, CASE WHEN n_nationkey % 2 = 0 THEN CAST(2 + n_nationkey % 3 AS VARCHAR) ELSE '0' END AS rpu_count, CAST(NULL AS VARCHAR) AS stereo, n_nationkey % 2 = 1 AS has_duration FROM nation""")
def json_reports(spark, sf_dir):
    """SNK-01: one JSON object a file; absent fields are left out."""
    report, _ = probe.probe_bytes(films(spark, sf_dir))
    line = F.col("value")
    field = lambda path: F.get_json_object(line, path)
    return probe.to_json(report).select(field("$.file").alias("file"), field("$.schema_version").alias("schema_version"), field("$.video_tracks[0].width").alias("width"), field("$.video_tracks[0].hdr.content_light.max_cll").alias("max_cll"), field("$.video_tracks[0].dolby_vision.rpu_count").alias("rpu_count"), field("$.video_tracks[0].stereo").alias("stereo"), line.contains('"duration_secs"').alias("has_duration"))


@query(f"""
    SELECT {_FILM} AS file, {_FILM} || '  DV 8.1 · Dolby Vision / HDR10 (fallback) · 3840×2160' AS line FROM nation""")
def summary_lines(spark, sf_dir):
    """SNK-03: one summary line for each track of the reports."""
    return probe.quiet(probe.probe_bytes(films(spark, sf_dir))[0])


@query(f"""
    SELECT {_FILM} AS file, 'General' AS first_section, '3840×2160' AS size, CAST(1000 + n_nationkey AS VARCHAR) AS max_cll, CASE WHEN n_nationkey % 2 = 0 THEN CAST(2 + n_nationkey % 3 AS VARCHAR) ELSE '' END AS rpus FROM nation""")
def text_reports(spark, sf_dir):
    """SNK-02: the sections of the text form, in their order, and lines of them."""
    text = render.text(probe.probe_bytes(films(spark, sf_dir))[0])
    line = lambda pattern: F.regexp_extract("text", pattern, 1)
    return text.select("file", line(r"\n\n(\w+)\n").alias("first_section"), line(r"(?m)^  Size +(.*)$").alias("size"), line(r"MaxCLL (\d+)").alias("max_cll"), line(r"(?m)^  RPUs +(\d+)").alias("rpus"))


@query(f"SELECT {_FILM} AS file, true AS has_hdr, false AS has_dv FROM nation")
def sections(spark, sf_dir):
    """PRJ-01: only the sections asked for are in the report."""
    report = probe.sections(probe.probe_bytes(films(spark, sf_dir))[0], "general", "hdr")
    return probe.to_json(report).select(F.get_json_object("value", "$.file").alias("file"), F.col("value").contains('"hdr"').alias("has_hdr"), F.col("value").contains('"dolby_vision"').alias("has_dv"))


@query(f"SELECT {_FILM} AS file, CASE WHEN n_nationkey % 2 = 1 THEN '8.1' END AS dv_profile, CASE WHEN n_nationkey % 2 = 1 THEN CAST(0 AS BIGINT) END AS rpu_count, CASE WHEN n_nationkey % 2 = 1 THEN false END AS sampled FROM nation")
def container_only(spark, sf_dir):
    """PRJ-02: without RPUs, Dolby Vision is what the containers declare."""
    report, _ = probe.probe_bytes(films(spark, sf_dir), rpu=False)
    dv = F.get("video_tracks", F.lit(0))["dolby_vision"]
    return report.select("file", dv["profile"].alias("dv_profile"), dv["rpu_count"].alias("rpu_count"), dv["sampled"].alias("sampled"))


# ---- walks, heads, merges


@query("""
    SELECT p_partkey, n + 1 AS ts_units, CAST(52 AS BIGINT) + n * (8 + p_partkey % 400) AS ts_bytes, n AS mkv_units, n * (4 + p_partkey % 400) AS mkv_bytes, 3 * n AS spans, n AS delimiters
    FROM (SELECT *, CAST(1 + p_size % 5 AS BIGINT) AS n FROM part)""")
def whole_walks(spark, sf_dir):
    """STR-01, STR-02, STR-03, AGG-13: walks over whole inputs that hold a unit or a window at a time: units and bytes of a
    transport stream and of Matroska blocks, units across the borders of small windows, AV1 delimiters."""

    def make(k, s):
        n, fill = 1 + s % 5, k % 400
        units = [samples.with_codes(picture(i + 1, fill)) for i in range(n)]
        stream = dispatch.demux("film.ts", samples.ts([samples.with_codes(bytes([0x42, 1]) + b"\xff" * 46), *units], 3), full=True)
        entry = samples.track_entry(7, 640, 480, samples.hevc_sps(640, 480), 16, 1, None)
        film = dispatch.demux("film.mkv", samples.mkv(entry, [[samples.simple_block(1, picture(i, fill))] for i in range(n)], 1), full=True)
        got, blocks = [u for _, u in stream["walk"]()], [size for _, _, _, size in film["walk"]()]
        data = samples.with_codes(*[samples.PARAMETERS, samples.PICTURE, b"\x44\x01\xc1"] * n)
        heads = raw.unit_heads(av1 := (samples.obu(2, b"") + samples.obu(6, bytes(fill % 100))) * n, len(av1))
        return {"ts_units": len(got), "ts_bytes": sum(map(len, got)), "mkv_units": len(blocks), "mkv_bytes": sum(blocks), "spans": sum(1 for _ in raw.spans(data, 1 + k % 9)), "delimiters": sum(kind == 2 for kind, _ in heads)}

    return parts(spark, sf_dir, "ts_units long, ts_bytes long, mkv_units long, mkv_bytes long, spans long, delimiters long", make)


@query("""
    SELECT n_nationkey, cut AS truncated, CASE WHEN NOT (cut AND n_nationkey % 3 = 0) THEN CAST(CASE n_nationkey % 3 WHEN 0 THEN 9.0 WHEN 1 THEN 0.125 ELSE 0.12 END AS DOUBLE) END AS duration_secs, NOT cut OR n_nationkey % 3 = 1 AS has_rate
    FROM (SELECT *, n_nationkey % 2 = 1 AS cut FROM nation)""")
def stream_heads(spark, sf_dir):
    """SRC-27, PRJ-04: heads of streams that end within what is read of them or not; a cut one claims less."""

    def make(k):
        sps = samples.hevc_sps(1920, 1080)
        entry = samples.sample_entry(sps, 1920, 1080, 10, 16, None)
        made = (samples.ts([samples.with_codes(sps, samples.PICTURE)] * 4, 9), samples.mp4([{"entry": entry, "samples": [samples.with_sizes(picture(1, 9))] * 3}]), samples.mkv(samples.track_entry(1, 640, 480, sps, 16, 1, None), [[samples.simple_block(1, picture(1, 9))] * 3], 0.12))[k % 3]
        content, cut = reader.head(io.BytesIO(made + bytes(500 * (k % 2))), 64, lambda block: len(made))
        return {"file": f"{k}", "content": content, "truncated": cut}

    heads = over(table(spark, sf_dir, "nation"), "n_nationkey", "file string, content binary, truncated boolean", make)
    report, _ = probe.probe_bytes(heads.drop("n_nationkey"))
    said = report.select(F.col("file").cast("int").alias("n_nationkey"), "duration_secs", F.get("video_tracks", F.lit(0))["bitrate"].isNotNull().alias("has_rate"))
    return heads.select("n_nationkey", "truncated").join(said, "n_nationkey", "left")


@query("SELECT n_nationkey, CAST(100 + n_nationkey AS INTEGER) AS max_cll, CAST(2 AS BIGINT) AS said FROM nation")
def ordered_merge(spark, sf_dir):
    """STR-04, AGG-07: findings of the units of whole inputs, dealt anyhow: the first in order wins."""

    def make(k):
        unit = lambda cll: samples.with_codes(samples.light(cll, 50), samples.PICTURE)
        return {"file": f"{k}.hevc", "content": samples.with_codes(samples.PARAMETERS, samples.PICTURE) * 2 + unit(100 + k) + samples.with_codes(samples.PICTURE) * (30 + k) + unit(900)}

    films = over(table(spark, sf_dir, "nation"), "n_nationkey", "file string, content binary", make).select("file", "content")
    found = reader.findings(films, full=True).where("sei IS NOT NULL").repartition(7, "ord")
    first = found.groupBy("file").agg(ordered.first_known(F.col("sei.content_light"), F.col("ord")).alias("light"), F.count("*").alias("said"))
    return first.select(F.regexp_extract("file", r"\A(\d+)", 1).cast("int").alias("n_nationkey"), "light.max_cll", "said")


@query("""
    SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN CAST(0 AS INTEGER) ELSE CAST(1 + p_size % 5 AS INTEGER) END AS hints, p_partkey % 3 < 2 AS all_fragments FROM part""")
def fragment_hints(spark, sf_dir):
    """SRC-08: heads of fragments by a segment index in front, by an index at the end, or without any."""

    def make(k, s):
        n = 1 + s % 5
        entry = samples.sample_entry(samples.hevc_sps(640, 480), 640, 480, 10, 16, None)
        data = samples.fragmented_mp4(entry, [[samples.with_sizes(picture(i, 5 + k % 20))] for i in range(n)], "run")
        data = samples.indexed(data, ("front", "end", "none")[k % 3])
        heads = mp4.fragment_heads(data)
        return {"hints": len(heads), "all_fragments": bool(heads) and all(data[o + 4 : o + 8] == b"moof" for o in heads)}

    return parts(spark, sf_dir, "hints int, all_fragments boolean", make)


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN 100 ELSE least(p_partkey, p_size) * 100 // p_size END AS percent, 'progress' AS event FROM part")
def progress_events(spark, sf_dir):
    """SNK-05: lines that tell how far a stage is."""
    return parts(spark, sf_dir, "percent long, event string", lambda k, s: json.loads(progress.event("scan", k, s, 5)))


@query(f"SELECT {_FILM} AS file, true AS narrow, true AS same_words, true AS themed FROM nation")
def terminal_reports(spark, sf_dir):
    """SNK-04: reports for a terminal: no line but one of a single word is longer than the width, and without the codes and
    the breaks it is the text form."""
    report = probe.probe_bytes(films(spark, sf_dir))[0]
    squeezed = lambda x: F.regexp_replace(x, r"\s+", " ")
    plain = F.regexp_replace("text", "\x1b" + r"\[[0-9;]*m", "")
    shown = render.styled(report, "dark", 40).select("file", plain.alias("shown"), F.col("text").contains("\x1b[1;96mGeneral\x1b[0m").alias("themed"))
    both = shown.join(render.text(report), "file")
    long = F.exists(F.split("shown", "\n"), lambda x: (F.length(x) > 40) & F.trim(F.substr(x, F.lit(23), F.length(x))).contains(" "))
    return both.select("file", (~long).alias("narrow"), (squeezed(F.col("shown")) == squeezed(F.col("text"))).alias("same_words"), "themed")
