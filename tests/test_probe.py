import json

import pytest

from nitscope.plans import probe
from nitscope.sources import reader
from tests import media as m
from tests.test_sources import CONFIG, SAMPLES


def report(spark, files, **kw):
    df = spark.createDataFrame(list(files.items()), "file string, content binary")
    made, errors = probe.probe_bytes(df, **kw)
    return {r.file: r for r in made.collect()}, {r.file: r.error for r in errors.collect()}


RPUS = [m.rpu([m.L2, m.L5, m.L6], scene=int(i == 0), el="FEL", more=[m.L8, m.L9, m.L11, m.L254]) for i in range(4)] + [m.rpu([m.L2, m.L6], scene=1, el="FEL", more=[m.L254])] * 2


def test_hdr10_from_raw_stream(spark):
    got, errors = report(spark, {"a.hevc": m.hevc_stream(4), "b.mkv": b"junk"})
    t = got["a.hevc"].video_tracks[0]
    assert (t.hdr.format, t.hdr.content_light.max_cll, t.hdr.mastering.max_luminance, t.hdr.mastering.primaries) == ("HDR10", 1000, 1000.0, "BT.2020")
    assert t.dolby_vision is None and list(errors) == ["b.mkv"]


def test_dolby_vision_full_scan(spark):
    got, _ = report(spark, {"a.hevc": m.hevc_stream(6, RPUS)}, full=True)
    dv = got["a.hevc"].video_tracks[0].dolby_vision
    assert (dv.profile, dv.rpu_count, dv.el_type, dv.cm_version, dv.reconstructed_bit_depth) == ("7.6 (FEL)", 6, "FEL", "CM v4.0", 12)
    assert (dv.metadata_cadence.frame_pairs, dv.metadata_cadence.changed_pairs, dv.metadata_cadence.cadence) == (5, 1, "per-shot")
    assert (dv.census.scene_cuts, dv.census.dm_version_index) == (3, 2)
    assert {x.level: x.rpus_with for x in dv.census.level_presence} == {2: 6, 5: 4, 6: 6, 8: 4, 9: 4, 11: 4, 254: 6}
    assert [(x.nits, list(x.levels)) for x in dv.trim_targets] == [(100, [2]), (1000, [8])]
    assert (dv.l5_active_areas[0].height, dv.l5_active_areas[0].width) == (1608, 3840)
    assert (dv.mastering_display.max_luminance, dv.mastering_display.primaries, dv.l11_content, dv.l11_reference_mode) == (1000.0, "DCI-P3 D65", "Movies", True)
    assert dv.mastering_primaries_mismatch.bl_primaries == "BT.2020" and dv.level == 6 and dv.level_derived


def test_containers_and_sections(spark):
    files = {"a.mp4": m.mp4(SAMPLES, CONFIG), "a.mkv": m.mkv(SAMPLES, CONFIG), "a.ts": m.ts([m.frame(m.hevc_sps(), m.hevc_sei(), m.PICTURE)] * 3, config=CONFIG)}
    got, _ = report(spark, files)
    for r in got.values():
        t = r.video_tracks[0]
        assert (t.hdr.format, t.dolby_vision.profile, t.dolby_vision.rpu_count, t.dolby_vision.sampled) == ("Dolby Vision / HDR10 (fallback)", "8.1", 0, False)
    df = spark.createDataFrame(list(files.items()), "file string, content binary")
    made, _ = probe.probe_bytes(df)
    lines = {r.file: r.line for r in probe.quiet(made).collect()}
    assert lines["a.mp4"] == "a.mp4  DV 8.1 · Dolby Vision / HDR10 (fallback) · 3840×2160"
    value = json.loads(probe.to_json(made.where("file = 'a.mp4'")).first().value)
    assert value["schema_version"] == "2.4" and "stereo" not in value["video_tracks"][0] and value["video_tracks"][0]["default"] if "default" in value["video_tracks"][0] else True
    assert "dolby_vision" not in probe.sections(made, "general", "hdr").first().video_tracks[0].asDict()


def test_sidecar_dump_is_weighted(spark):
    unit = lambda p: m.START + b"\x7c\x01" + m.escaped(p)
    data = b"".join(map(unit, RPUS))
    got, _ = report(spark, {"a.bin": data}, full=True)
    dv = got["a.bin"].video_tracks[0].dolby_vision
    assert (dv.rpu_count, dv.metadata_cadence.frame_pairs, dv.metadata_cadence.changed_pairs, dv.profile, dv.profile_compat_assumed) == (6, 5, 1, "7.6 (FEL)", True)


def test_partition_counts_do_not_matter(spark):
    files = {"a.hevc": m.hevc_stream(6, RPUS), "a.mp4": m.mp4(SAMPLES, CONFIG)}
    df = spark.createDataFrame(list(files.items()), "file string, content binary")
    seen = {json.dumps(sorted(r.value for r in probe.to_json(probe.probe_bytes(df.repartition(n), full=True)[0]).collect())) for n in (1, 4)}
    assert len(seen) == 1


@pytest.fixture
def folder(tmp_path):
    for name, data in {"b.mp4": m.mp4(SAMPLES, CONFIG), "a.hevc": m.hevc_stream(4), "note.txt": b"x", "c.bin": b"no rpu"}.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_files_and_data_source(spark, folder):
    made, errors = probe.probe(spark, [str(folder)])
    assert sorted(r.file.rsplit("/", 1)[-1] for r in made.collect()) == ["a.hevc", "b.mp4"]
    assert errors.count() == 0  # a folder gives what is a video or a sidecar, a path is read whatever it is called
    made, errors = probe.probe(spark, [str(folder / "c.bin"), str(folder / "note.txt"), str(folder / "a.hevc")])
    assert sorted(r.file.rsplit("/", 1)[-1] for r in errors.collect()) == ["c.bin", "note.txt"] and made.count() == 1
    spark.dataSource.register(reader.MediaDataSource)
    rows = spark.read.format("hdr_media").load(str(folder)).select("file", "codec", "width").collect()
    assert [(r.file.rsplit("/", 1)[-1], r.codec, r.width) for r in rows] == [("a.hevc", "HEVC", 3840), ("b.mp4", "HEVC", 3840)]
    found = spark.read.format("hdr_media").option("rows", "findings").load(str(folder))
    assert found.where("sei.content_light.max_cll = 1000").count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from nitscope.plans import kernels
    from nitscope.streaming import tracks as live

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    shaped = events.select(F.col("user_id").alias("track"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("payload"), "value")
    ordered = shaped.orderBy("ts", "seq").collect()
    for i in range(3):
        part = ordered[i * len(ordered) // 3 : (i + 1) * len(ordered) // 3]
        spark.createDataFrame(part, shaped.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    src = spark.readStream.schema(shaped.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = live.cadence(src).writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT track, max_by(struct(frame_pairs, changed_pairs, cadence), frames) AS r FROM live GROUP BY track")
    got = {r.track: tuple(r.r) for r in last.collect()}
    assert got == {r.user_id: (r.frame_pairs, r.changed_pairs, r.cadence) for r in kernels.cadence(spark, "/root/testdata/sf0.001").collect()}


def test_new_files_stream(spark, folder, tmp_path):
    from nitscope.streaming import tracks as live

    q = live.track_stream(spark, str(folder)).select("file", "codec", "error").writeStream.format("memory").queryName("media").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT codec FROM media WHERE error IS NULL").count() == 2


def test_mastering_document_and_text(spark):
    from nitscope.plans import render
    from tests.test_sources import XML

    df = spark.createDataFrame([("a.xml", XML.encode()), ("a.hevc", m.hevc_stream(6, RPUS))], "file string, content binary")
    made, _ = probe.probe_bytes(df, full=True)
    got = {r.file: r for r in made.collect()}
    dv = got["a.xml"].video_tracks[0].dolby_vision
    assert (dv.rpu_count, dv.cm_version, dv.metadata_cadence.frame_pairs, dv.metadata_cadence.changed_pairs, dv.census.scene_cuts) == (15, "CM v4.0", 14, 2, 2)
    assert (dv.mastering_display.primaries, dv.mastering_display.primaries_level) == ("DCI-P3 D65", 0)
    lines = {r.file: r.text for r in render.text(made).collect()}["a.hevc"].split("\n")
    assert "  Format              Dolby Vision / HDR10 (fallback)" in lines and "  Trim targets        100 [L2], 1000 [L8]" in lines


def test_cut_inputs_claim_less(spark):
    files = [("a.mp4", m.mp4(SAMPLES), True), ("a.ts", m.ts([m.frame(m.hevc_sps(), m.PICTURE)] * 3), True), ("b.ts", m.ts([m.frame(m.hevc_sps(), m.PICTURE)] * 3), False)]
    made, _ = probe.probe_bytes(spark.createDataFrame(files, "file string, content binary, truncated boolean"))
    got = {r.file: r for r in made.collect()}
    assert got["a.mp4"].video_tracks[0].bitrate and got["a.mp4"].duration_secs
    assert got["a.ts"].duration_secs is None and got["a.ts"].video_tracks[0].bitrate is None and got["b.ts"].duration_secs == 10.0


def test_json_document_and_metrics(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([("a.mp4", m.mp4(SAMPLES, CONFIG)), ("b.mkv", b"junk")], "file string, content binary")
    made, _ = probe.probe_bytes(df)
    assert json.loads(probe.json_document(made, 2))[0]["file"] == "a.mp4" and json.loads(probe.json_document(made, 1))["container"] == "MP4 (ISOBMFF)"
    seen = Observation("probe")
    probe.observed(made, seen).count()
    assert seen.get == {"files": 1, "tracks": 1}
    assert probe.json_document(made.limit(0), 2) == "[]"


def test_files_beyond_two_gib(spark, tmp_path):
    """Sparse files, so that nothing of that size is on the disk: one that can be read, one that can't."""
    (tmp_path / "small.hevc").write_bytes(m.hevc_stream(4))
    for name, data in (("big.hevc", m.hevc_stream(4)), ("zeros.ts", b""), ("big.mkv", m.mkv([m.sized(m.hevc_sei(), m.PICTURE)] * 3))):
        with open(tmp_path / name, "wb") as f:
            f.write(data)
            f.truncate(2_306_867_200)
    made, errors = probe.probe(spark, [str(tmp_path)])
    got = {r.file.rsplit("/", 1)[-1]: r for r in made.collect()}
    assert sorted(got) == ["big.hevc", "big.mkv", "small.hevc"] and got["big.hevc"].size_bytes == 2_306_867_200
    assert {r.video_tracks[0].width for r in got.values()} == {3840}
    assert [r.file.rsplit("/", 1)[-1] for r in errors.collect()] == ["zeros.ts"]


def test_ranges_of_a_file_are_its_bytes(tmp_path, monkeypatch):
    import random

    from pyarrow import fs

    data = random.Random(2).randbytes(5000)
    (tmp_path / "x").write_bytes(data)
    monkeypatch.setattr(reader, "RANGE", 64)
    file = reader.Ranged(fs.LocalFileSystem().open_input_file(str(tmp_path / "x")))
    part = file.part(1000, 4000)
    for given, whole in ((file, data), (part, data[1000:4000]), (part.part(10), data[1010:4000])):
        assert len(given) == len(whole) and given[:] == whole and given[-5:] == whole[-5:]
        for a in (0, 63, 64, 900, len(whole) - 1):
            assert given[a] == whole[a] and given[a : a + 100] == whole[a : a + 100]
    stream = m.mkv([m.sized(m.hevc_sei(), m.PICTURE)] * 3)
    (tmp_path / "y").write_bytes(stream)
    read = reader.Ranged(fs.LocalFileSystem().open_input_file(str(tmp_path / "y")))
    rows = lambda d: [r for r in reader.extract.scan("y", d, True, 16)]
    assert rows(read) == rows(stream)


def test_head_of_a_stream(spark):
    import io

    budget = lambda block: 24 if block[:1] == b"G" else 16
    for first, limit in ((b"G", 24), (b"x", 16)):
        for n in (1, 7, 8, 9, 16, 17, 24, 25, 60):
            data = first + bytes(range(1, n))
            assert reader.head(io.BytesIO(data), 8, budget) == (data[:limit], n > limit and n >= 8)
    made, _ = probe.probe_stream(spark, io.BytesIO(m.mp4(SAMPLES, CONFIG)))
    assert made.first().file == "-" and made.first().video_tracks[0].bitrate
    with pytest.raises(ValueError):
        probe.probe_stream(spark, io.BytesIO(b""))


def test_progress_of_an_action(spark):
    import io
    import time

    from nitscope.plans import progress

    assert [progress.percent(*x) for x in ((0, 0), (0, 3), (1, 3), (2, 3), (3, 3), (9, 3), (999, 1000))] == [100, 0, 33, 66, 100, 100, 99]
    out = io.StringIO()
    with progress.Progress(spark, out, every=0.02):
        spark.range(0, 8, 1, 8).rdd.map(lambda x: time.sleep(0.1)).count()
    events = [json.loads(x) for x in out.getvalue().splitlines()]
    assert events and all(e["event"] == "progress" and 0 <= e["done"] <= e["total"] for e in events) and events[-1]["percent"] == 100


def test_files_are_read_ahead_and_stay_the_same(tmp_path):
    from nitscope.plans import samples

    entry = samples.sample_entry(samples.hevc_sps(640, 480), 640, 480, 10, 16, None)
    for where in ("front", "end", "none"):
        path = tmp_path / f"{where}.mp4"
        path.write_bytes(samples.indexed(samples.fragmented_mp4(entry, [[m.sized(m.PICTURE)]] * 3, "run"), where))
        data = reader.opened(str(path))
        for full in (False, True):
            reader.warm(str(path), data, full)
        assert data[:] == path.read_bytes() and len(reader.extract.dispatch.demux(str(path), data)["tracks"][0]["units"]) == 3


def test_long_values_go_on_below_themselves(spark):
    from nitscope.plans import render

    text = "General\n  " + "Color".ljust(20) + "BT.2020 / PQ (SMPTE ST 2084) / BT.2020 NCL / limited\n  " + "Name".ljust(20) + "x" * 50
    df = spark.createDataFrame([(text,)], "t string").select(render.reflow(__import__("pyspark.sql.functions", fromlist=["x"]).col("t"), 44).alias("t"))
    lines = df.first().t.split("\n")
    assert lines[0] == "General" and lines[1] == "  " + "Color".ljust(20) + "BT.2020 / PQ (SMPTE ST" and lines[2] == " " * 22 + "2084) / BT.2020 NCL /" and lines[-1].endswith("x" * 50)
    assert " ".join(" ".join(lines).split()) == " ".join(text.split())
