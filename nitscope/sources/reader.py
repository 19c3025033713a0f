"""Media files as DataFrames. `inputs` lists files through Spark's own file source, so any store that Spark reads will do.
Files up to `WHOLE` bytes come as values of rows; larger ones are opened by the task that reads them, in ranges: by path
where the path is local, else through Arrow's file systems. The `hdr_media` data source maps local files by path."""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from nitscope.sources import dispatch, extract

SIDECARS = ("rpu", "bin", "xml", "json")
#: Rows of one Arrow batch: findings are small, and a film has hundreds of thousands.
BATCH = 1024
#: Bytes of the largest file that is read into a row.
WHOLE = 64 << 20
#: Bytes that are read at a time from a file that can't be mapped.
RANGE = 1 << 20
#: Bytes of a fragment's head that are read ahead.
HEAD = 16 << 10
#: Bytes of a stream that its kind is told by, and those that are read of a transport stream and of any other.
SNIFF, TS_HEAD, OTHER_HEAD = 64 << 10, 24 << 20, 16 << 20


class Ranged:
    """A file of any store as something that can be sliced: one range is held at a time."""

    def __init__(self, file, start: int = 0, end: int | None = None):
        self.file, self.start, self.end = file, start, file.size() if end is None else end
        self.at, self.held = 0, b""

    def __len__(self) -> int:
        return self.end - self.start

    def part(self, start: int, end: int | None = None) -> Ranged:
        return Ranged(self.file, self.start + start, self.end if end is None else min(self.start + end, self.end))

    def _read(self, a: int, n: int) -> bytes:
        if not self.at <= a <= a + n <= self.at + len(self.held):
            self.file.seek(self.start + a)
            self.at, self.held = a, self.file.read(min(max(n, RANGE), len(self) - a))
        return self.held[a - self.at : a - self.at + n]

    def __getitem__(self, key):
        if isinstance(key, slice):
            a, z, _ = key.indices(len(self))
            return self._read(a, z - a) if z > a else b""
        if not 0 <= key < len(self):
            raise IndexError(key)
        return self._read(key, 1)[0]


def opened(path: str):
    """A file's bytes by path: mapped where it is local, in ranges else."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" not in local:
        with open(local, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return Ranged(system.open_input_file(name))


def warm(path: str, data, full: bool) -> None:
    """Tell the system what of a mapped file will be read: all of it in order, or the heads of an MP4's fragments, which are
    far apart. Files of other stores are read ahead by `Ranged` itself."""
    if not isinstance(data, mmap.mmap) or not hasattr(data, "madvise"):
        return
    if full:
        data.madvise(mmap.MADV_SEQUENTIAL)
    elif dispatch.PARSERS.get(dispatch.extension(path)) is dispatch.mp4.read:
        for at in dispatch.mp4.fragment_heads(data):
            data.madvise(mmap.MADV_WILLNEED, at - at % mmap.PAGESIZE, min(HEAD, len(data) - at))


def _plain(path):
    return F.regexp_replace(path, r"\Afile:(?://)?", "")


def inputs(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(file, path, content): files as given, whatever they are called; of folders the videos and what may be a sidecar.
    `content` is null for files of more than `WHOLE` bytes."""
    names = sorted(dispatch.VIDEO | set(SIDECARS))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    given = [p.removeprefix("file://").removeprefix("file:") for p in paths]
    file = _plain("path")
    chosen = read.where(F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1)).isin(names) | file.isin(given))
    rows = chosen.select(file.alias("file"), "path", "content", "length", file.isin(given).alias("named"))
    # conditions on the length reach the source, which then doesn't open the files they leave out
    small = rows.where(F.col("length") <= WHOLE).drop("length")
    large = chosen.where(F.col("length") > WHOLE).select(file.alias("file"), "path", F.lit(None).cast("binary").alias("content"), file.isin(given).alias("named"))
    return small.unionByName(large)


def _struct(ddl: str) -> str:
    return StructType.fromDDL(ddl).simpleString()


def scan(df: DataFrame, full: bool = False, samples: int = 16, look_inside: bool = True) -> DataFrame:
    """(track, finding), one of them null, for each (file, content) or (file, path, content, named): every file is read once.
    Of files that are not named, those that are no video and no sidecar give no row."""
    schema = StructType.fromDDL(f"track {_struct(extract.TRACK)}, finding {_struct(extract.FINDING)}")
    arrow = to_arrow_schema(schema)
    names = {k: [f.name for f in arrow.field(k).type] for k in ("track", "finding")}
    columns = ["file", "content", *(c for c in ("path", "named") if c in df.columns)]

    def rows(file: str, data, named: bool) -> Iterator[dict]:
        if not named and dispatch.extension(file) in SIDECARS and not collected(file, bytes(data[: extract.sidecar.HEAD])):
            return
        for kind, row in extract.scan(file, data, full, samples, look_inside):
            yield {"track": None, "finding": None} | {kind: {k: row.get(k) for k in names[kind]}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(columns)}
                try:
                    data = row["content"]
                    if data is None and row.get("path"):
                        warm(row["file"], data := opened(row["path"]), full)
                    said = rows(row["file"], data or b"", row.get("named", True))
                except Exception as e:  # a store that can't be read in ranges is an error of this file alone
                    said = iter([{"track": {k: None for k in names["track"]} | {"file": row["file"], "error": f"can't be opened: {e}"}, "finding": None}])
                while held := list(islice(said, BATCH)):
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def parted(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tracks and rows of findings."""
    return scanned.where("track IS NOT NULL").select("track.*"), scanned.where("finding IS NOT NULL").select("finding.*")


def tracks(df: DataFrame, full: bool = False) -> DataFrame:
    """One row for each track of each (file, content), or one with the error of a file that can't be read."""
    return parted(scan(df, full, 0, look_inside=full))[0]


def findings(df: DataFrame, full: bool = False, samples: int = 16) -> DataFrame:
    """(file, track_idx, ord, weight, sei, rpu): what the access units say that are looked at."""
    return parted(scan(df, full, samples))[1]


def head(stream, sniff: int = SNIFF, budget=None) -> tuple[bytes, bool]:
    """The beginning of a stream that can't be sought, and whether there was more: a block to tell its kind by, then as
    much as that kind may need. `budget` gives the number of bytes for a block."""
    budget = budget or (lambda b: TS_HEAD if dispatch.sniff(b) is dispatch.ts.read else OTHER_HEAD)

    def more(have: bytes, n: int) -> bytes:
        parts, left = [have], n - len(have)
        while left > 0 and (got := stream.read(left)):
            parts.append(got)
            left -= len(got)
        return b"".join(parts)

    data = more(b"", sniff)
    limit = budget(data)
    if len(data) >= sniff:
        data = more(data, limit + 1)
    return data[:limit], len(data) > limit


class MediaDataSource(DataSource):
    """`spark.read.format("hdr_media").option("rows", "tracks" | "findings").load(path)`: one partition for each file,
    which its task maps into memory and reads where it must."""

    @classmethod
    def name(cls) -> str:
        return "hdr_media"

    def schema(self) -> str:
        return extract.FINDING if self.options.get("rows") == "findings" else extract.TRACK

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MediaReader(schema, dict(self.options))


class _MediaReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.arrow, self.options = to_arrow_schema(schema), options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in collect_paths(self.options["path"].split(","), self.options.get("recursive") == "true")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, full = partition.value, self.options.get("full") == "true"
        warm(path, data := opened(path), full)
        rows = extract.finding_rows(path, data, full, int(self.options.get("samples", 16))) if self.options.get("rows") == "findings" else extract.track_rows(path, data, full)
        while held := [{c.name: row.get(c.name) for c in self.arrow} for row in islice(rows, BATCH)]:
            yield pa.RecordBatch.from_pylist(held, self.arrow)


def collect_paths(paths: list[str], recursive: bool = False) -> list[str]:
    """Files as given, whatever they are called; of folders the video files and sidecars, sorted by path."""
    out = []
    for p in paths:
        if not os.path.isdir(p):
            out.append(p)
            continue
        walk = os.walk(p) if recursive else [(p, [], [e.name for e in os.scandir(p) if e.is_file()])]
        out += sorted(f for d, _, names in walk for n in names if _is_collected(f := os.path.join(d, n)))
    return out


def collected(path: str, head: bytes) -> bool:
    """True of the files that a folder gives: videos by extension, sidecars by extension and content."""
    ext = dispatch.extension(path)
    return ext in dispatch.VIDEO or ext in SIDECARS and extract.sidecar.kind(path, head) is not None


def _is_collected(path: str) -> bool:
    if dispatch.extension(path) not in SIDECARS:
        return collected(path, b"")
    with open(path, "rb") as f:
        return collected(path, f.read(extract.sidecar.HEAD))
