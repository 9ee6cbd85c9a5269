"""Session set-up, lineage cuts and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 8 << 20


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plenaria")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package with the session's tasks, for workers that can't import it; once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_plenaria_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="plenaria-")) / "plenaria.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(archive))
    sc._plenaria_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master may do without one and gets a folder of
    its own; on a cluster that's an error, as executors can't share a machine's folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plenaria-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new place in the shared folder, deleted in the end."""
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def mounted(place: str) -> str:
    """The path of a shared folder that all machines have in their file systems; an error for other storage."""
    scheme, colon, path = place.rpartition(":")
    if colon and scheme != "file":
        raise ValueError(f"{place} isn't in a file system")
    return f"/{path.lstrip('/')}" if colon else path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation.

    A checkpoint keeps the plan's estimated size, and a join's is the product of its sides': over rounds of joins it would
    double its digits again and again until the driver has neither time nor memory for it. One beyond 63 bits is dropped.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() < 1 << 63:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), done._jdf.schema(), False), spark)


def release(*frames: DataFrame) -> None:
    """Delete the checkpoints that cut() made for frames which nothing reads any more."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            delete(df.sparkSession, file.get())


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted size is proven small; unchanged (a shuffle join) otherwise."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
