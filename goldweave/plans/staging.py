"""Written tables in the folder that all executors share, to cut long plans reliably."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset in local mode (tests), a temporary one is set for this context."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="goldweave-"))
        root = sc.getCheckpointDir()
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/goldweave-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def staged(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Write `df` once and read it back: later steps neither recompute it nor depend on lost executors.

    keep: a list that gets the folder, for callers that drop it early with drop_folder().
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_since(mark: int = 0) -> list[str]:
    """The folders made after the first `mark` ones, in order."""
    return [path for _, path in _made[mark:]]


def _clean() -> None:
    """Removes what is left; the JVM outlives its contexts, so a stopped one is no hindrance."""
    for spark, path in _made:
        try:
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            else:
                drop_folder(spark, path)
        except Exception:  # the folder's own cleaning applies; the others are still tried
            continue
