"""Session building and the few places where the engine touches session state."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine assumes. Sizes are left to the cluster; AQE does the coalescing and skew splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(master).appName("brightloom")
    settings = BASE_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set, else, on a local master only, a temporary one set here."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not there:
        there = f"file://{tempfile.mkdtemp(prefix='brightloom-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


_SHIPPED: set[str] = set()
_HOMES: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it
    whatever their own path is."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="brightloom-code-"), "brightloom.zip")  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("brightloom", os.path.relpath(path, package)))
    context.addPyFile(archive)


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the application's own, which goes when the application ends."""
    ship(spark)
    home = os.path.join(shared_dir(spark), f"brightloom-{spark.sparkContext.applicationId}")
    if home not in _HOMES:
        fs, path = fs_of(spark, home)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _HOMES.add(home)
    return os.path.join(home, f"{what}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Materialise ``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a DataFrame."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fs_of(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath
