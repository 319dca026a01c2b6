"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the size-dependent work: small join sides are broadcast only
# below Spark's own threshold, skewed join partitions are split, tiny ones merged.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Shuffle partitions are planned for this much input each; adaptive execution merges
# those that turn out small, but never splits a plan that starts with too few.
BYTES_PER_PARTITION = 128 * 1024 * 1024
FEWEST_PARTITIONS = 200


def shuffle_partitions(input_bytes: int) -> int:
    return max(-(-input_bytes // BYTES_PER_PARTITION), FEWEST_PARTITIONS)


def configure(
    builder: SparkSession.Builder, input_bytes: int | None = None
) -> SparkSession.Builder:
    """Apply the recommended settings; with the size of the input also the number of
    shuffle partitions."""
    settings = dict(SETTINGS)
    if input_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions(input_bytes))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


_MADE: list[str] = []


def _own_disk(spark: SparkSession, path: str) -> bool:
    """Whether a path is in the file system of the machine itself."""
    if "://" in path and not path.startswith("file:"):
        return False
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getScheme() == "file"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name that driver and executors share: under the folder named by
    ``spark.checkpoint.dir`` or, where that is unset, under the warehouse directory. On a
    cluster a warehouse in a machine's own file system is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if _own_disk(spark, shared) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share, not {shared}")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that Spark uses for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _MADE:
        _MADE.remove(path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete every scratch folder of this process; call it when the results that were
    read from them are written or no longer needed."""
    for path in list(_MADE):
        drop_folder(spark, path)


@atexit.register
def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _MADE else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            clean_scratch(spark)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Compute a result once and go on from a written copy of it, so that many later
    queries neither repeat the work nor depend on an executor's memory."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
