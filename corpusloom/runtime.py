"""Session helpers shared by all operators: lineage cuts, size-checked broadcasts, code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few longs that may be broadcast; beyond this every operator joins by shuffle.
BROADCAST_ROWS = 1_000_000


def session(app: str = "corpusloom", cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local master without that setting gets a
    temporary folder, set as the checkpoint folder too."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """As ``cut`` but as a Parquet table, and a function that deletes it: for wide intermediates
    that are read by column and needed for a while only. Without a call it goes when the session's
    JVM ends."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(p.toString())
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(p)
    return spark.read.parquet(p.toString()), lambda: fs.delete(p, True) and None


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` cut and counted, with a broadcast hint if it has at most ``limit`` rows.

    Only for narrow rows (ids and hashes). The second value tells whether it was hinted.
    """
    df = cut(df)
    small = df.count() <= limit
    return (F.broadcast(df) if small else df), small


def spread(df: DataFrame, parts_per_core: int = 1) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores, for passes that cost
    far more than moving their rows. Large inputs have more splits than that and stay as they are.
    Filters on what is spread stay behind it: they are the work that it is done for."""
    n = df.sparkSession.sparkContext.defaultParallelism * parts_per_core
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n).where(F.monotonically_increasing_id() >= 0)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors if it is not on their path already."""
    root = Path(__file__).resolve().parent.parent
    on_path = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    sc = spark.sparkContext
    if root in on_path or getattr(sc, "_corpusloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="corpusloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/corpusloom", "zip", root, "corpusloom"))
    sc._corpusloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
