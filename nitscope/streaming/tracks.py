"""Live forms of the walkers: frames arrive in order for each track, in micro-batches of any size.

State is small and fixed for each track: counts, the last fingerprint, the first known value. A restarted query goes on
from its checkpoint; the result after all batches equals that of the batch operators over all frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from nitscope.sources import reader

CADENCE = "track long, frames long, frame_pairs long, changed_pairs long, cadence string, first_value double"
STATE = "frames long, frame_pairs long, changed_pairs long, prev string, first_value double"


def _verdict(pairs: int, changed: int) -> str | None:
    return None if not pairs else "per-frame" if changed * 4 >= pairs else "per-shot"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    frames, pairs, changed, prev, first = state.get if state.exists else (0, 0, 0, None, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
    for payload, value in zip(rows["payload"], rows["value"], strict=True):
        if prev is not None:
            pairs, changed = pairs + 1, changed + (payload != prev)
        frames, prev = frames + 1, payload
        first = first if first is not None or pd.isna(value) else float(value)
    state.update((frames, pairs, changed, prev, first))
    yield pd.DataFrame([(key[0], frames, pairs, changed, _verdict(pairs, changed), first)], columns=[c.split()[0] for c in CADENCE.split(", ")])


def cadence(frames: DataFrame) -> DataFrame:
    """Streaming (track, ts, seq, payload, value) to the running cadence verdict and the first known value, one row for
    each track that a batch touches. Frames of a track must not arrive before those of an earlier batch."""
    return frames.groupBy("track").applyInPandasWithState(_fold, CADENCE, STATE, "update", GroupStateTimeout.NoTimeout)


def totals(frames: DataFrame) -> DataFrame:
    """Running bytes and frames of each track."""
    return frames.groupBy("track").agg(F.count("*").alias("frames"), F.sum("value").alias("bytes"))


def new_media(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of media files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder).select(F.regexp_replace("path", r"\Afile:(?://)?", "").alias("file"), "content")


def track_stream(spark: SparkSession, folder: str, full: bool = False) -> DataFrame:
    """Track rows of every media file that appears in a folder."""
    return reader.tracks(new_media(spark, folder), full)
