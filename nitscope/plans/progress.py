"""Progress of a running action as JSON lines, one for each stage that is at work, for the programs that started it.

Spark's own counts of finished tasks are what there is to tell: a thread on the driver reads them while the action runs,
writes a line for a stage when its share has grown by `STEP`, no more often than every `EVERY` seconds, and one for its end."""

from __future__ import annotations

import json
import sys
import threading
import time

from pyspark.sql import SparkSession

EVERY, STEP = 0.25, 0.005


def percent(done: int, total: int) -> int:
    """Whole percents, rounded down, so that 100 is the end and nothing else; an empty whole is done."""
    return 100 if total <= 0 else min(max(done, 0), total) * 100 // total


def event(phase: str, done: int, total: int, elapsed_ms: int) -> str:
    return json.dumps({"event": "progress", "phase": phase, "done": done, "total": total, "percent": percent(done, total), "elapsed_ms": elapsed_ms})


class Progress:
    """`with Progress(spark): action` writes events to `out` until the block ends."""

    def __init__(self, spark: SparkSession, out=None, every: float = EVERY):
        self.tracker, self.out, self.every = spark.sparkContext.statusTracker(), out or sys.stderr, every
        self.told: dict[int, tuple[str, int, int]] = {}
        self.stop, self.begun = threading.Event(), time.monotonic()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _tell(self, stage: int, name: str, done: int, total: int) -> None:
        before = self.told.get(stage)
        if before is None or done - before[1] >= max(1, STEP * total):
            self.told[stage] = (name, done, total)
            print(event(name, done, total, int(1000 * (time.monotonic() - self.begun))), file=self.out, flush=True)

    def _look(self) -> None:
        at_work = set(self.tracker.getActiveStageIds())
        for stage in sorted(at_work):
            if info := self.tracker.getStageInfo(stage):
                self._tell(stage, info.name, info.numCompletedTasks, info.numTasks)
        for stage in [s for s, (_, done, total) in self.told.items() if s not in at_work and done < total]:
            name, _, total = self.told[stage]
            self._tell(stage, name, total, total)

    def _run(self) -> None:
        while not self.stop.wait(self.every):
            self._look()

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        self.thread.join()
        for stage in [s for s, (_, done, total) in self.told.items() if done < total]:
            name, _, total = self.told[stage]
            self._tell(stage, name, total, total)
