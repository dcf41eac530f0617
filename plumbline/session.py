"""Session helpers: local sessions for tests and bench, checkpointing, sizing."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Inputs below this many leaf bytes are ordered inside one window per key;
#: above it they are split into value ranges first.
SMALL_BYTES_CONF = "spark.plumbline.smallBytes"
SMALL_BYTES_DEFAULT = 64 * 1024 * 1024


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Python kernels are pickled by reference, so a worker must be able to import them
    wherever it runs.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="plumbline-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session without one (tests, laptops) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(
            prefix="plumbline-ckpt-"
        )
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    A small input often sits in one file and one partition; it is spread over the
    cores here, because everything that reads the checkpoint inherits its layout.
    """
    checkpoint_folder(df.sparkSession)
    if is_small(df):
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)


#: Checkpointed rows are stored plain; this many bytes hold what one byte of
#: columnar file holds.
ROW_BYTES_PER_FILE_BYTE = 4


def _checkpoint_bytes(spark: SparkSession, rdd) -> int | None:
    file = rdd.getCheckpointFile()
    if not file.isDefined():
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength() // ROW_BYTES_PER_FILE_BYTE


def leaf_bytes(df: DataFrame) -> int:
    """Size summed over the leaves of the plan: Catalyst's estimate, or the files of
    a checkpoint."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        size = None
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            size = _checkpoint_bytes(df.sparkSession, leaf.rdd())
        total += int(str(leaf.stats().sizeInBytes())) if size is None else size
    return total


def is_small(df: DataFrame, fanout: float = 1.0) -> bool:
    """True when ordering one key's rows in one task is safe.

    ``fanout`` is how many rows the caller makes out of one input row. The answer
    only chooses between two plans with equal results.
    """
    limit = int(df.sparkSession.conf.get(SMALL_BYTES_CONF, str(SMALL_BYTES_DEFAULT)))
    return limit > 0 and leaf_bytes(df) * fanout <= limit
