"""Session, table access and checkpoint folder, shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "organelia") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ORGANELIA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()
_sent: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of the session's executors, once: they need not have it installed.

    The driver makes an archive of the code and Spark sends it out; no task reads a folder of the driver's.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="organelia-code-")) / "organelia.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def send_file(spark: SparkSession, path: str) -> str:
    """Give a file of the driver's to every executor, once; returns the name by which a task finds it (``sent_file``)."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _sent:
        sc.addFile(path)
        _sent.add((sc.applicationId, path))
    return os.path.basename(path)


def sent_file(name: str, otherwise: str) -> str:
    """In a task: where a sent file is. On the driver, outside a job: the path itself."""
    found = SparkFiles.get(name) if TaskContext.get() is not None else otherwise
    return found if os.path.exists(found) else otherwise


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder, set if it is not yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="organelia-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, for files that are written and read again."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``. A session that names none gets a
    temporary one if its master is local (tests, a laptop); on a cluster that is an error, for a folder of
    the driver's machine is not seen by the executors.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)
