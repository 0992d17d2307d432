"""One way to make a session: UTC, adaptive execution, no UI."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_spark(app: str = "tradewind", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's settings win."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: dict[str, str] = {}
_SHARED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers as an archive, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="tradewind-"), "tradewind.zip")  # on the driver; Spark sends it out from here
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(archive)
    _SHIPPED[sc.applicationId] = archive


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that all machines share (spark.checkpoint.dir); it goes when the application ends.

    Only a local session, which is one machine, may do without that setting.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHARED:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = f"file://{tempfile.gettempdir()}/tradewind-shared"
        folder = f"{base.rstrip('/')}/tradewind/{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _SHARED[sc.applicationId] = folder
    return _SHARED[sc.applicationId]


def landed(df, label: str):
    """df written as Parquet to the application's shared folder and reread: the next layer plans on files, as layers do."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
