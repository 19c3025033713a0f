"""The byte parsers as queries: every row's bytes are put together from table values by expressions, parsed in Arrow
batches, and must give the values back, which the SQL twin reads off the table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from nitscope.functions import bits, headers, sei
from nitscope.runtime import table
from nitscope.sources import dispatch, raw, sidecar

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def parsed(df: DataFrame, data: Column, ddl: str, parse: Callable[[bytes], dict | None]) -> DataFrame:
    """(p_partkey, the fields of `ddl`): `parse` of the bytes of each row; all null where it says nothing."""
    schema = StructType.fromDDL(f"p_partkey long, {ddl}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"p_partkey": k} | (parse(d) or {}) for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in arrow} for r in rows], arrow)

    return df.select("p_partkey", data.alias("data")).mapInArrow(run, schema)


def h(value: Column, width: int) -> Column:
    """`width` bytes of a number, as hexadecimal digits."""
    return F.lpad(F.hex(value.cast("long")), 2 * width, "0")


def b(*parts) -> Column:
    return F.unhex(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def key() -> Column:
    return F.col("p_partkey")


def size() -> Column:
    return F.col("p_size")


@query("SELECT p_partkey, CAST(257 + p_partkey % 9000 AS INTEGER) AS max_cll, CAST(257 + p_size AS INTEGER) AS max_fall, CAST(1 + p_size AS INTEGER) AS preferred_transfer FROM part")
def sei_messages(spark, sf_dir):
    """FN-21, FN-12: content light and preferred transfer from an HEVC SEI unit."""
    data = b("4E019004", h(257 + key() % 9000, 2), h(257 + size(), 2), "9301", h(1 + size(), 1), "80")
    parse = lambda d: (lambda f: (f["content_light"] or {}) | {"preferred_transfer": f["preferred_transfer"]})(sei.unit(d))
    return parsed(parts(spark, sf_dir), data, "max_cll int, max_fall int, preferred_transfer int", parse)


@query("SELECT p_partkey, CAST(p_partkey % 60000 AS INTEGER) AS max_cll, CAST(p_size AS INTEGER) AS max_fall FROM part")
def av1_metadata(spark, sf_dir):
    """FN-15, FN-21: the same from an AV1 metadata unit behind a delimiter."""
    data = b("1200", "2A0501", h(key() % 60000, 2), h(size(), 2))
    return parsed(parts(spark, sf_dir), data, "max_cll int, max_fall int", lambda d: sei.av1_unit(d)[0]["content_light"])


@query("SELECT p_partkey, CAST(1 + p_size % 4 AS INTEGER) AS units, CAST((p_partkey % 40 + 20) AS INTEGER) AS first_type, CAST(2 + p_size % 4 * 3 AS BIGINT) AS unit_bytes FROM part")
def start_codes(spark, sf_dir):
    """FN-14, FN-27: units between start codes, their trailing zeros dropped."""
    first = F.concat(F.lit("00000001"), h((key() % 40 + 20) * 2, 1), F.lit("FF0000"))
    data = F.unhex(F.concat(first, F.repeat(F.lit("0000012601AA00"), (size() % 4).cast("int"))))

    def parse(d):
        u = [d[x:y] for x, y in bits.annexb(d)]
        return {"units": len(u), "first_type": u[0][0] >> 1 & 63, "unit_bytes": sum(map(len, u))}

    return parsed(parts(spark, sf_dir), data, "units int, first_type int, unit_bytes long", parse)


@query("SELECT p_partkey, CAST(1 + p_size % 4 AS INTEGER) AS units, CAST((1 + p_size % 4) * 3 AS BIGINT) AS unit_bytes FROM part")
def sized_units(spark, sf_dir):
    """FN-14: units behind their lengths; a length that can't be ends the walk."""
    data = F.unhex(F.concat(F.repeat(F.lit("000000032601AA"), (1 + size() % 4).cast("int")), F.lit("0000FFFF26")))
    parse = lambda d: {"units": len(u := list(bits.length_prefixed(d, 4))), "unit_bytes": sum(z - a for a, z in u)}
    return parsed(parts(spark, sf_dir), data, "units int, unit_bytes long", parse)


@query("SELECT p_partkey, CAST(p_partkey % 100 AS INTEGER) AS profile, CAST(p_size % 14 AS INTEGER) AS level, p_partkey % 2 = 0 AS el_present, p_partkey % 3 = 0 AS bl_present, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size % 7 AS INTEGER) END AS bl_compatibility_id FROM part")
def dv_records(spark, sf_dir):
    """FN-20: configuration records, the compact form without compatibility id among them."""
    flags = 4 + F.when(key() % 2 == 0, 2).otherwise(0) + F.when(key() % 3 == 0, 1).otherwise(0)
    word = (key() % 100) * 512 + (size() % 14) * 8 + flags
    data = b("0100", h(word, 2), F.when(key() % 5 > 0, h((size() % 7) * 16, 1)).otherwise(""))
    return parsed(parts(spark, sf_dir), data, "profile int, level int, el_present boolean, bl_present boolean, bl_compatibility_id int", headers.dv_config)


@query("SELECT p_partkey, CAST(10 + 2 * (p_size % 2) AS INTEGER) AS bit_depth, CASE WHEN p_size % 2 = 0 THEN '4:2:2' ELSE '4:4:4' END AS chroma, CASE p_partkey % 4 WHEN 1 THEN 'BT.709' END AS primaries FROM part")
def prores_headers(spark, sf_dir):
    """FN-18: frame headers with the atom's name before them."""
    data = b("00000000", "69637066", "0094", "000000000000", "07800438", h(F.when(size() % 2 == 0, 0x80).otherwise(0xC0), 1), "00", h(key() % 4, 1), "0202", "000000")
    parse = lambda d: (i := headers.prores_frame(d)) and i | {"primaries": i["color"]["primaries"]}
    return parsed(parts(spark, sf_dir), data, "bit_depth int, chroma string, primaries string", parse)


@query("SELECT p_partkey, CAST(p_size % 4 AS INTEGER) AS profile, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 3 * 10 AS INTEGER) END AS level, CAST(8 + p_size % 5 AS INTEGER) AS bit_depth FROM part")
def vp9_features(spark, sf_dir):
    """FN-18: features of a codec-private block; a level of 0 is not stated."""
    data = b("0101", h(size() % 4, 1), "0201", h(key() % 3 * 10, 1), "0301", h(8 + size() % 5, 1))
    return parsed(parts(spark, sf_dir), data, "profile int, level int, bit_depth int", headers.vp9_private)


@query("SELECT p_partkey, CAST(1 + p_partkey % 3 AS INTEGER) AS mode, CAST(p_size % 16 AS VARCHAR) || '.' || CAST(p_partkey % 100 AS VARCHAR) AS spec_version, CAST(100 + p_size AS BIGINT) AS target_max_luminance FROM part")
def sl_hdr_headers(spark, sf_dir):
    """FN-22: header and target of SL-HDR payloads."""
    data = b("B5003A00", h(key() % 3 * 16 + size() % 16, 1), h(key() % 100 * 2, 1), "2009", h(100 + size(), 2), "0000")
    return parsed(parts(spark, sf_dir), data, "mode int, spec_version string, target_max_luminance long", sei.sl_hdr)


@query("SELECT p_partkey, CAST(1 + p_partkey % 4 AS INTEGER) AS version, CAST(1 + p_size % 7 AS INTEGER) AS system_start_code, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey % 4096 AS INTEGER) END AS target FROM part")
def vivid_headers(spark, sf_dir):
    """FN-22: HDR Vivid payloads with and without a parameter set."""
    word = F.when(size() % 2 == 0, F.lit(1 << 15)).otherwise(F.lit(0)) + F.when(size() % 2 == 0, (key() % 4096) * 4).otherwise(0)
    data = b("26000400", h(5 + key() % 4, 1), h(1 + size() % 7, 1), "000000000000", h(word, 2))
    parse = lambda d: (i := sei.hdr_vivid(d)) and i | {"target": next(iter(i["target_pq"]), None)}
    return parsed(parts(spark, sf_dir), data, "version int, system_start_code int, target int", parse)


def le(value: Column, width: int) -> Column:
    """Little-endian hexadecimal digits."""
    return F.concat(*(h(F.pmod(F.floor(value / F.lit(256**i)), F.lit(256)), 1) for i in range(width)))


@query("SELECT p_partkey, CAST(2 + p_size % 5 AS BIGINT) AS frames, CAST(320 + p_size AS BIGINT) AS width, 25.0::DOUBLE AS fps, (2 + p_size % 5) / 25.0::DOUBLE AS duration_secs FROM part")
def ivf_files(spark, sf_dir):
    """SRC-18, WIN-07: IVF files: frames, size, rate from time stamps, duration."""
    n = 2 + size() % 5
    frame = lambda i: F.concat(F.lit("03000000"), le(i, 8), F.lit("32010A"))
    frames = F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), frame), "")
    data = b("444B494600002000", "41563031", le(320 + size(), 2), "6801", "1900000001000000", le(n, 4), "00000000", frames)

    def parse(d):
        m = raw.ivf(d)
        t = m["tracks"][0]
        return {"frames": len(t["units"]), "width": t["width"], "fps": t["fps"], "duration_secs": m["duration_secs"]}

    return parsed(parts(spark, sf_dir), data, "frames long, width long, fps double, duration_secs double", parse)


@query("SELECT p_partkey, CAST(1000 + p_size AS DOUBLE) AS max_luminance, 'DCI-P3 D65' AS primaries, CAST(10 + p_partkey % 100 AS BIGINT) AS rpu_count, CAST(2 AS INTEGER) AS scene_cuts FROM part")
def mastering_documents(spark, sf_dir):
    """SRC-25: mastering XML: display, shots and frames."""
    head = '<DolbyLabsMDF version="4.0.2"><Rate><n>24</n><d>1</d></Rate><MasteringDisplay><PeakBrightness>'
    tail = "</PeakBrightness><MinimumBrightness>0.0001</MinimumBrightness><Red>0.68,0.32</Red><Green>0.265,0.69</Green><Blue>0.15,0.06</Blue><WhitePoint>0.3127,0.329</WhitePoint></MasteringDisplay><Shot><Record><In>0</In><Duration>4</Duration></Record></Shot><Shot><Record><In>4</In><Duration>"
    data = F.encode(F.concat(F.lit(head), (1000 + size()).cast("string"), F.lit(tail), (6 + key() % 100).cast("string"), F.lit("</Duration></Record></Shot></DolbyLabsMDF>")), "utf-8")
    parse = lambda d: (x := sidecar.dv_xml(d)) | x["mastering"]
    return parsed(parts(spark, sf_dir), data, "max_luminance double, primaries string, rpu_count long, scene_cuts int", parse)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS profile, CAST(p_size * 10 AS BIGINT) AS target_max_luminance FROM part")
def hdr10plus_documents(spark, sf_dir):
    """SRC-26: the head of an HDR10+ JSON file; what follows its first scene is not read."""
    profile = F.when(key() % 2 == 0, "A").otherwise("B")
    text = F.concat(F.lit('{"JSONInfo":{"HDR10plusProfile":"'), profile, F.lit('"},"SceneInfo":[{"NumberOfWindows":1,"Note":"}{","TargetedSystemDisplayMaximumLuminance":'), (size() * 10).cast("string"), F.lit('},{"Numb'))
    return parsed(parts(spark, sf_dir), F.encode(text, "utf-8"), "profile string, target_max_luminance long", sidecar.hdr10plus_json)


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mkv' WHEN 2 THEN 'ivf' WHEN 3 THEN 'obu' WHEN 4 THEN 'hevc' END AS kind FROM part""")
def signatures(spark, sf_dir):
    """SRC-03: the first signature that the head of an input fits."""
    heads = ("00000018667479706D703432", "1A45DFA39342868101", "444B494600002000", "12000A0B000000", "0000000140010C01", "4E6F7468696E67")
    data = F.unhex(F.get(F.array(*map(F.lit, heads)), (key() % 6).cast("int")))
    names = {dispatch.mp4.read: "mp4", dispatch.mkv.read: "mkv", raw.ivf: "ivf", raw.obu: "obu", raw.hevc: "hevc"}
    return parsed(parts(spark, sf_dir), data, "kind string", lambda d: {"kind": names.get(dispatch.sniff(d))})


@query("SELECT p_partkey, CAST(p_partkey % 16384 AS BIGINT) AS leb, CAST(p_size AS BIGINT) AS be, CAST(p_size AS BIGINT) AS le, CAST(0 AS BIGINT) AS beyond FROM part")
def byte_fields(spark, sf_dir):
    """FN-12, FN-26: variable-length and fixed-width numbers; a field out of range reads as 0."""
    v = key() % 16384
    data = b(h(v % 128 + 128, 1), h(F.floor(v / 128), 1), h(size(), 4), le(size(), 4))
    parse = lambda d: {"leb": bits.leb128(d, 0)[0], "be": bits.big(d, 2, 4), "le": bits.little(d, 6, 4), "beyond": bits.big(d, 8, 4)}
    return parsed(parts(spark, sf_dir), data, "leb long, be long, le long, beyond long", parse)
