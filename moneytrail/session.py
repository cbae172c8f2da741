"""Session settings and the shared scratch area used to cut long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on.  Skewed sort-merge joins are split by
# adaptive execution even when that costs one more shuffle further down.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts and index blocks are wide rows: an Arrow batch ends at this size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

# A task for so many bytes of a scratch table whose size is known: tables of a loop's rounds are often small.
BYTES_PER_TASK = 4 << 20

_local_scratch: str | None = None
_written: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a session that somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("moneytrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans are built from many column calls; recording the call site of each is costly.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine; on a
    cluster other executors could not read it.
    """
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    in_use = spark.sparkContext._jsc.sc().getCheckpointDir()
    if in_use.isDefined():
        return in_use.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="moneytrail-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release_at_exit, spark)
    _written.append(path)
    return path


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release_scratch(spark)
    except Exception:
        pass  # the JVM is gone already; what is left falls under the folder's own retention


def scratch_tables() -> int:
    """How many scratch tables this process holds now: a mark for ``release_scratch``."""
    return len(_written)


def release_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the scratch tables this process wrote, once the results built on them are stored.

    With ``since`` the first so many stay, with ``keep`` the last so many: a loop drops what its
    rounds are done with.  All go when the process ends.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    end, gone = max(since, len(_written) - keep), 0
    done, _written[since:end] = _written[since:end], []
    for name in reversed(done):
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame, label: str = "step", size: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage, fixes the rows (later branches of a plan all see the same
    ones) and survives the loss of executors.  ``size`` is how many bytes the rows have at most, if
    that is known: a small table is then written by a task per core, whatever the number of
    shuffle partitions; a large one by as many tasks as without.
    """
    path = scratch_path(df.sparkSession, label)
    if size is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, size // BYTES_PER_TASK))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
