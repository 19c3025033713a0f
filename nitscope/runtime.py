"""Session helpers: table access, lineage cuts in the shared checkpoint folder, unused names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`). Where that is unset, a local session gets a temporary one; on
    a cluster, whose machines would each write to their own disk, that is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="nitscope-")
    return _own_roots[app]


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: lineage is cut, and a lost executor
    costs a re-read instead of a recomputation. The files go when the session ends (or at `release`)."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/nitscope-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*frames: DataFrame) -> None:
    """Delete the files behind materialized frames that nothing will read again."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            folder = f.rsplit("/", 1)[0]
            for entry in [e for e in _written if e[1].split("/nitscope-", 1)[-1] == folder.split("/nitscope-", 1)[-1]]:
                _written.remove(entry)
                _delete(*entry)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone already; the cluster's own cleaner is left with the folder
            return


def scan_tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for `rows` rows at about `per_task` a task, never fewer than one."""
    return max(1, -(-rows // per_task))


def unused(name: str, taken) -> str:
    """`name`, made longer until no column has it (names differ in more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
