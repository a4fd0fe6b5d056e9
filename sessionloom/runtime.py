"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sessionloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC, adaptive session; anything in ``conf`` (dots as ``__``) wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below the shared folder that the cluster names in
    ``spark.checkpoint.dir``, with its scheme. Where that is unset, a session on
    one machine gets a folder of its own; any other is an error, as executors
    would not see each other's files. Deleted when the driver process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{qualified(spark, root)}/sessionloom/{uuid.uuid4().hex}"
    _delete_at_exit(spark, folder)
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    scheme, _, rest = full.partition(":")
    return full if rest.startswith("//") else f"{scheme}://{rest}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, reread it.
    The files survive lost executors, unlike a local checkpoint; they are
    deleted when the driver process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Hadoop deletes the folder when the driver's JVM ends in order."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
